"""Citations of five kinds on pages, and the table of authorities made of them.

A page is a row with its lines as an array; pages that hold a table of authorities already are passed over.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import patterns as P
from quire.functions.text import spans
from quire.functions.values import chosen

#: what a generated table of authorities carries
MARKER = "[table of authorities]"
#: cheap: every citation has a number before a capital letter
GATE = r"[0-9]\s+[UFAPNS]"
HIT = "struct<kind:string,start:int,length:int,text:string>"

# Names of cases before a citation, the year after it, rules among citations.
PARTY_WORD = r"(?:[A-Z][A-Za-z0-9.'\-]*|of|and|&|the|for|de|la|du|van|di|von)"
CASE_BEFORE = rf"((?:In re |Ex parte |Matter of )?{PARTY_WORD}(?:\s+{PARTY_WORD}){{0,6}}\s+v\.\s+{PARTY_WORD}(?:\s+{PARTY_WORD}){{0,6}}),?\s*$"
IN_RE_BEFORE = rf"((?:In re|Ex parte|Matter of)\s+{PARTY_WORD}(?:\s+{PARTY_WORD}){{0,7}}),?\s*$"
YEAR_AFTER = r"^\s*\(\s*(\d{4})\s*\)"
RULES = r"\b(?:Fed\.\s?R\.|F\.\s?R\.\s?(?:Civ|Crim|App|Evid|Bankr)\.?\s?P\.|C\.F\.R\.)\b"


def _open_pages(pages: DataFrame) -> DataFrame:
    return pages.where(~F.array_join("lines", " ").contains(MARKER) & F.exists("lines", lambda line: line.rlike(GATE) | line.rlike(r"[0-9]\s*$")))


def _of_kind(text: Column) -> Column:
    """All matches (``HIT``) of all kinds, in the order of the kinds."""
    named = lambda kind: lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["length"].alias("length"), s["text"].alias("text"))
    return F.concat(*[F.transform(spans(text, p), named(k)) for k, p in P.CITATIONS.items()])


def citations(pages: DataFrame) -> DataFrame:
    """(doc_id, page_no, line, kind, start, length, text): citations inside lines of three signs at least; one that meets one found before, in the order of kinds, is dropped."""
    lined = _open_pages(pages).select("doc_id", "page_no", F.posexplode("lines").alias("line", "_text")).where((F.length("_text") >= 3) & F.col("_text").rlike(GATE))

    def step(kept: Column, h: Column) -> Column:
        meets = F.exists(kept, lambda k: (k["start"] < h["start"] + h["length"]) & (h["start"] < k["start"] + k["length"]))
        return F.when(meets, kept).otherwise(F.concat(kept, F.array(h)))

    found = lined.select("doc_id", "page_no", "line", F.explode(F.aggregate(_of_kind(F.col("_text")), F.array().cast(f"array<{HIT}>"), step)).alias("h"))
    return found.select("doc_id", "page_no", "line", "h.*")


def section(kind: Column, text: Column) -> Column:
    return chosen([(text.rlike(P.java(RULES)), "rules"), (kind == "us-code", "statutes"), (kind.isin("us-supreme", "federal-reporter", "federal-supplement", "regional-reporter"), "cases")], "other")


def authorities(pages: DataFrame) -> DataFrame:
    """(doc_id, section, display, sort_key, pages, citation, kind): each authority of a document with its pages, and how it is first cited.

    Cases show the name right before the citation and the year right after it, also over a line's end; kinds may overlap.
    """
    plain = F.trim(F.regexp_replace(F.array_join("lines", " "), r"\s+", " "))
    texts = _open_pages(pages).select("doc_id", "page_no", plain.alias("_text"))
    found = texts.select("doc_id", "page_no", "_text", F.posexplode(_of_kind(F.col("_text"))).alias("n", "h"))
    before = F.substring(F.col("_text"), F.greatest(F.lit(0), F.col("h.start") - 160) + 1, F.least(F.col("h.start"), F.lit(160)))
    after = F.substring(F.col("_text"), F.col("h.start") + F.col("h.length") + 1, F.lit(12))
    kept = found.select("doc_id", "page_no", "n", F.col("h.kind").alias("kind"), F.col("h.text").alias("citation"), before.alias("_before"), after.alias("_after"))
    kept = kept.withColumn("section", section(F.col("kind"), F.col("citation")))
    name = F.coalesce(*[F.nullif(F.regexp_extract("_before", p, 1), F.lit("")) for p in (CASE_BEFORE, IN_RE_BEFORE)])
    year = F.nullif(F.regexp_extract("_after", YEAR_AFTER, 1), F.lit(""))
    shown = F.concat(F.coalesce(F.concat(name, F.lit(", ")), F.lit("")), F.col("citation"), F.coalesce(F.concat(F.lit(" ("), year, F.lit(")")), F.lit("")))
    kept = kept.withColumn("display", F.when(F.col("section") == "cases", shown).otherwise(F.col("citation")))
    first = F.struct("page_no", "n")
    grouped = kept.groupBy("doc_id", "display").agg(F.array_sort(F.collect_set("page_no")).alias("pages"), *[F.min_by(c, first).alias(c) for c in ("section", "citation", "kind")])
    key = F.trim(F.regexp_replace(F.lower("display"), r"^(in re\s+|ex parte\s+|matter of\s+|the\s+)", ""))
    return grouped.select("doc_id", "section", "display", key.alias("sort_key"), "pages", "citation", "kind")
