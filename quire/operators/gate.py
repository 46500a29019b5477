"""A gate for redacted documents: what should be gone is looked for everywhere, a second means is tried on what failed, then it is looked for again.

A document is a row: its redacted pages, its side channels, and its targets (the value and page of every box). A value that is
still on the page of one of its boxes sends that page, and no other, to the fallback, which leaves no text of it. Values left
on other pages are leaks of the raw text, those in channels are leaks of their vector; no fallback mends these, so they block.
All steps are work inside the row: a document's targets are few, and values of one document are not looked for in others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: where a value can be left, by the names that channels use
VECTORS = ["page", "form-field", "annotation", "hidden-layer", "attachment", "raw-stream"]
LEAST = 3
LEAK = "struct<vector:string,page_no:int,label:string,needle:string>"


def forms(needle: Column) -> Column:
    """A value as text, as the hexadecimal digits of its UTF-8 and of its UTF-16BE bytes, all in lower case."""
    return F.array(F.lower(needle), F.lower(F.hex(F.encode(needle, "UTF-8"))), F.lower(F.hex(F.encode(needle, "UTF-16BE"))))


def holds(text: Column, needle: Column) -> Column:
    low = F.lower(text)
    return F.exists(forms(needle), lambda form: low.contains(form))


def leaks(pages: Column, channels: Column, targets: Column, burned: Column) -> Column:
    """Every place (``LEAK``) where a value of at least ``LEAST`` signs is left; pages that are ``burned`` have no text."""
    values = F.array_distinct(F.filter(F.transform(targets, lambda t: F.trim(t["text"])), lambda v: F.length(v) >= LEAST))
    leak = lambda vector, page, label, needle: F.struct(F.lit(vector).alias("vector") if isinstance(vector, str) else vector.alias("vector"), page.cast("int").alias("page_no"), label.cast("string").alias("label"), needle.alias("needle"))
    none, own = F.lit(None), F.filter(targets, lambda t: F.length(F.trim(t["text"])) >= LEAST)
    on_page = F.filter(own, lambda t: ~F.array_contains(burned, t["page_no"]) & holds(F.coalesce(F.get(pages, t["page_no"] - 1), F.lit("")), F.trim(t["text"])))
    at_box = F.transform(on_page, lambda t: leak("page", t["page_no"], none, F.trim(t["text"])))

    def elsewhere(v: Column) -> Column:
        boxes = F.transform(F.filter(own, lambda t: F.trim(t["text"]) == v), lambda t: t["page_no"])
        places = F.filter(F.transform(pages, lambda p, i: F.struct((i + 1).alias("page_no"), p.alias("text"))), lambda p: ~F.array_contains(burned, p["page_no"]) & ~F.array_contains(boxes, p["page_no"]) & holds(p["text"], v))
        return F.transform(places, lambda p: leak("raw-stream", p["page_no"], none, v))

    in_channels = lambda v: F.transform(F.filter(channels, lambda c: holds(F.coalesce(c["text"], F.lit("")), v)), lambda c: leak(c["vector"], none, c["label"], v))
    kind = f"array<{LEAK}>"
    return F.concat(at_box.cast(kind), F.flatten(F.transform(values, elsewhere)).cast(kind), F.flatten(F.transform(values, in_channels)).cast(kind))


def gated(docs: DataFrame, burn: str = "") -> DataFrame:
    """The other columns of ``docs`` (pages, channels, targets), and pages, burned (page numbers), leaks, removed and status.

    pages: array of texts; channels: array of (vector, label, text); targets: array of (page_no from 1, text). status: ``clean``,
    ``burned`` (pages had to be replaced by ``burn``) or ``blocked`` (something is left). removed: targets that are not on their page.
    Only documents that fail the first time are looked through again.
    """
    kept = [c for c in docs.columns if c not in ("pages", "channels", "targets")]
    nothing = F.array().cast("array<int>")
    first = docs.select(*kept, "pages", "channels", "targets", leaks(F.col("pages"), F.col("channels"), F.col("targets"), nothing).alias("_first"))
    failed = F.array_sort(F.array_distinct(F.transform(F.filter("_first", lambda x: x["vector"] == "page"), lambda x: x["page_no"])))
    first = first.select(*kept, "pages", "channels", "targets", "_first", failed.alias("burned"))
    again = F.when(F.size("burned") == 0, F.col("_first")).otherwise(leaks(F.col("pages"), F.col("channels"), F.col("targets"), F.col("burned")))
    second = first.select(*kept, "pages", "targets", "burned", again.alias("leaks"))
    left = F.size(F.filter("leaks", lambda x: x["vector"] == "page"))
    status = F.when(F.size("leaks") > 0, "blocked").when(F.size("burned") > 0, "burned").otherwise("clean")
    shown = F.transform("pages", lambda p, i: F.when(F.array_contains("burned", i + 1), F.lit(burn)).otherwise(p))
    return second.select(*kept, shown.alias("pages"), "burned", "leaks", (F.size("targets") - left).alias("removed"), status.alias("status"))


def enforced(gated_docs: DataFrame) -> DataFrame:
    """The same rows where none is blocked; the first that is fails the job and names the vectors."""
    summary = F.array_join(F.array_compact(F.array(*[F.when(n > 0, F.concat(n.cast("string"), F.lit(f" {v}"))) for v, n in _counts().items()])), ", ")
    told = F.concat(F.lit("redaction not verified: "), F.size("leaks").cast("string"), F.lit(" still present ("), summary, F.lit(")"))
    return gated_docs.withColumn("status", F.when(F.col("status") == "blocked", F.raise_error(told)).otherwise(F.col("status")))


def _counts() -> dict[str, Column]:
    of = lambda vector: F.filter("leaks", lambda x: x["vector"] == vector)
    return {v: F.size(of(v)) for v in VECTORS}


def leaks_by_vector(gated_docs: DataFrame) -> DataFrame:
    """One row: leaks of each vector over all documents, and how many targets were removed."""
    sums = [F.coalesce(F.sum(n), F.lit(0)).alias(v.replace("-", "_")) for v, n in _counts().items()]
    return gated_docs.agg(*sums, F.coalesce(F.sum("removed"), F.lit(0)).alias("removed"))
