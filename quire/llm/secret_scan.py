"""Secret scans with corpus-wide ownership frequency, in DataFrame operations only.

Each text is searched for the base kinds (assign, access, hex) and for generic tokens that mix letters of both cases and
digits. The hash of every candidate's value is aggregated over the corpus by distinct repositories (``source``) and
owners (classes of equal texts, so copies count once), both exactly. A value in at least ``example_repositories``
repositories is a widely copied example; below that, one with a single repository, or at most ``live_owners`` owners,
looks live, and any other is shared. Generic tokens that look live and overlap no base span are added as spans of kind
``live``; those that are shared are reported apart from them, not added; base spans always stay.

Positions come from splitting a text at its matches and adding up lengths, in code points, end exclusive.

Defined cases: a null text is empty; a null source is a repository of its own, apart from an empty name; rows with the same text
are one owner and get the same spans; an empty table gives an empty result; extra columns are not read, and those that
``carry`` names come back in the struct ``row``, so their names cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small, written

#: The contract's patterns. Runs of 24 and 20 characters at least are the matches of the shorter
#: patterns that pass, for those match maximal runs.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_HINT = r"(?i)(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]"
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
GENERIC = r"[A-Za-z0-9+/_=-]{20,}"
KINDS = ["assign", "access", "hex", "live", "shared"]
CLASSES = ["example", "live", "shared"]
BROADCAST_ROWS, SALTS = 100_000, 32
SPAN = "array<struct<start:int,rank:int,end:int,value:string>>"


def spans(text: Column, pattern: str, rank: int, value: Column | None = None, hint: str | None = None) -> Column:
    """All matches of ``pattern`` as (start, rank, end, value); ``value``: an array of values, or else the matches."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    parts = F.arrays_zip(found.alias("m"), (value if value is not None else found).alias("v"), gaps.alias("g"))
    step = lambda acc, x: F.struct(
        (acc["at"] + x["g"] + F.coalesce(F.length(x["m"]), F.lit(0))).alias("at"),
        F.when(
            x["m"].isNotNull(),
            F.concat(acc["out"], F.array(F.struct((acc["at"] + x["g"]).alias("start"), F.lit(rank).alias("rank"), (acc["at"] + x["g"] + F.length(x["m"])).alias("end"), x["v"].alias("value")))),
        ).otherwise(acc["out"]).alias("out"),
    )
    start = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out"))
    return F.when(text.rlike(hint or pattern), F.aggregate(parts, start, step, lambda acc: acc["out"])).otherwise(F.array().cast(SPAN))


def base_spans(text: Column) -> Column:
    """The contract's matches in order of start, then kind."""
    assign = spans(text, ASSIGN, 0, F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2)), ASSIGN_HINT)
    assign = F.filter(assign, lambda s: F.length(s["value"]) >= 6)
    return F.array_sort(F.concat(assign, spans(text, ACCESS, 1), spans(text, HEX, 2)))


def generic_spans(text: Column, base: Column) -> Column:
    """Long tokens of mixed signs that overlap no base span."""
    mixed = lambda s: s["value"].rlike("[a-z]") & s["value"].rlike("[A-Z]") & s["value"].rlike("[0-9]")
    apart = lambda s: ~F.exists(base, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
    return F.filter(F.filter(spans(text, GENERIC, 3), mixed), apart)


def written_out(found: Column) -> Column:
    kind = lambda s: F.element_at(F.array(*map(F.lit, KINDS)), s["rank"] + 1)
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", kind(s), s["start"], s["end"])), ",")


def ownership(candidates: DataFrame, example_repositories: int, live_owners: int) -> DataFrame:
    """For each value: n_repositories, n_owners and its class (example, live or shared)."""
    counted = candidates.groupBy("value_hash").agg(F.countDistinct("repository").alias("n_repositories"), F.countDistinct("owner").alias("n_owners"))
    return counted.withColumn(
        "class",
        F.when(F.col("n_repositories") >= example_repositories, "example").when((F.col("n_repositories") == 1) | (F.col("n_owners") <= live_owners), "live").otherwise("shared"),
    )


def scan(docs: DataFrame, example_repositories: int = 3, live_owners: int = 1, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, text, base, found, shared (arrays of spans), n_example, n_live, n_shared (base spans by class) and row (a struct of ``carry``) of every document."""
    text = F.coalesce(F.col("text"), F.lit(""))
    read = docs.select("doc_id", F.col("text"), text.alias("_text"), F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("repository"), F.xxhash64("text").alias("owner"), F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in carry]).alias("row"))
    based = read.withColumn("base", base_spans(F.col("_text"))).withColumn("generic", generic_spans(F.col("_text"), F.col("base")))
    return _with_added(based.drop("_text"), example_repositories, live_owners)


def _with_added(based: DataFrame, example_repositories: int, live_owners: int) -> DataFrame:
    candidates = based.select("owner", "repository", F.explode(F.concat("base", "generic")).alias("span")).distinct().select("owner", "repository", "span", F.xxhash64("span.value").alias("value_hash"))
    candidates = written(candidates, "secret-candidates")  # few rows, read twice
    classes = ownership(candidates, example_repositories, live_owners).select("value_hash", "class")
    generic = lambda kind: F.collect_list(F.when((F.col("span.rank") == 3) & (F.col("class") == kind), F.col("span")))
    count = lambda kind: F.count_if((F.col("span.rank") < 3) & (F.col("class") == kind)).alias(f"n_{kind}")
    added = candidates.select("owner", "span", "value_hash").distinct().join(classes, "value_hash")
    added = added.groupBy("owner").agg(generic("live").alias("added"), generic("shared").alias("shared"), *map(count, CLASSES))
    added, by = written(added, "secret-added"), ["owner"]
    few = small(added, BROADCAST_ROWS)
    if few is added:  # joined by shuffling, where the copies of one text must not all go to one task
        by = ["owner", "salt"]
        few = added.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        based = based.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(SALTS)))
    none = F.array().cast(SPAN)
    found = F.array_sort(F.concat("base", F.coalesce("added", none)))
    shared = F.array_sort(F.transform(F.coalesce("shared", none), lambda s: s.withField("rank", F.lit(4))))
    counts = [F.coalesce(f"n_{c}", F.lit(0)).alias(f"n_{c}") for c in CLASSES]
    return based.join(few, by, "left").select("doc_id", "text", "base", found.alias("found"), shared.alias("shared"), *counts, F.col("row").dropFields("_").alias("row") if len(based.schema["row"].dataType) > 1 else F.lit(None).alias("row"))


def digest(scanned: DataFrame) -> DataFrame:
    """Counts, the digest of the base spans, and all spans and the shared tokens written out."""
    count = lambda rank: F.size(F.filter("base", lambda s: s["rank"] == rank)).cast("long")
    return scanned.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(written_out(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        written_out(F.col("found")).alias("spans"), "n_example", "n_live", "n_shared", written_out(F.col("shared")).alias("shared_spans"),
    )


def redacted(text: Column, found: Column, mark: str = "[SECRET]") -> Column:
    """``text`` with ``mark`` in place of every span; spans that overlap become one mark."""
    step = lambda acc, s: F.struct(
        F.concat(acc["out"], F.when(s["start"] >= acc["at"], F.concat(F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark))).otherwise("")).alias("out"),
        F.greatest(acc["at"], s["end"]).alias("at"),
    )
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    return F.when(F.size(found) == 0, text).otherwise(F.aggregate(found, start, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text)))))
