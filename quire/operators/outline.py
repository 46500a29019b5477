"""Headings of documents, and the stamps on their pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import patterns as P
from quire.functions.text import matches
from quire.functions.values import chosen


def pattern_key(heading: Column) -> Column:
    """The identifier that a heading begins with: its leading words in capitals or digits, in lower case, without marks of continuation."""
    plain = F.regexp_replace(F.regexp_replace(heading, r"(?i)\(\s*cont(?:inued|\.)?\s*\)", " "), P.java(r"(?i)\b(?:continued|cont\.?)\b"), " ")
    words = F.filter(F.split(plain, r"[^\p{L}\p{N}]+"), lambda w: w != "")
    state = F.struct(F.lit(True).alias("goes_on"), F.array().cast("array<string>").alias("kept"))
    same = lambda s, w: s["goes_on"] & (w == F.upper(w))
    step = lambda s, w: F.struct(same(s, w).alias("goes_on"), F.when(same(s, w), F.concat(s["kept"], F.array(F.lower(w)))).otherwise(s["kept"]).alias("kept"))
    return F.array_join(F.aggregate(words, state, step, lambda s: s["kept"]), " ")


def headings(rows: DataFrame, line: str = "line") -> DataFrame:
    """``rows`` that read like headings, with level (1 to 4) and score: numbered ones, and short ones mostly in capitals.

    All lines have one size and no weight here, so pattern and capitals alone decide; a line scores 30 at least.
    """
    text = F.trim(F.regexp_replace(line, r"\s+", " "))
    size = F.length(text)
    level = chosen([(text.rlike(P.java(p)), k) for p, k in P.HEADINGS], F.lit(None).cast("int"))
    letters = F.length(F.regexp_replace(text, "[^A-Za-z]", ""))
    caps = (letters >= 3) & (F.length(F.regexp_replace(text, "[^A-Z]", "")) >= 0.75 * letters)
    points = lambda held, n: F.when(held, n).otherwise(0)
    known = level.isNotNull()
    score = points(known, 60) + points(caps & (size <= 80), 15) + points(~text.rlike("[.:]$") | known, 5) - points((size > 100) & ~known, 20)
    fits = size.between(3, 160) & ~text.rlike("[,;]$") & (score >= 30)
    return rows.where(fits).withColumns({"level": F.coalesce(level, F.when(caps, 3).otherwise(4)), "score": score})


def capped(found: DataFrame, pages: DataFrame, least: int = 80, a_page: int = 6) -> DataFrame:
    """The headings of each document with the highest scores, ``least`` or ``a_page`` a page, whichever is more; pages: (doc_id, pages)."""
    order = Window.partitionBy("doc_id").orderBy(F.desc("score"), "page_no", "line_no")
    ranked = found.withColumn("_k", F.row_number().over(order)).join(pages, "doc_id")
    return ranked.where(F.col("_k") <= F.greatest(F.lit(least), a_page * F.col("pages"))).drop("_k", "pages")


def stamp_parts(stamp: Column) -> dict[str, Column]:
    """prefix, suffix, digits and number of a stamp; null where it is none: too short or long, few digits, no letters and no leading zero.

    A stamp has up to 36 digits, more than a long holds.
    """
    tight = F.regexp_replace(F.regexp_replace(F.trim(stamp), "[–—]", "-"), r"\s+", "")
    prefix, middle, suffix = (F.regexp_extract(tight, r"^(\D*)(\d.*\d|\d)(\D*)$", i) for i in (1, 2, 3))
    digits = F.regexp_replace(middle, r"\D", "")
    named = F.concat(prefix, suffix).rlike("[A-Za-z]")
    good = F.length(tight).between(4, 36) & (F.length(digits) >= 4) & (named | ((F.length(digits) >= 5) & digits.startswith("0")))
    only = lambda c: F.when(good, c)
    return {"prefix": only(prefix), "suffix": only(suffix), "digits": only(F.length(digits)), "number": only(digits.cast("decimal(38,0)")), "named": only(named)}


def stamps(rows: DataFrame) -> DataFrame:
    """(doc_id, page_no, line_no, text, prefix, suffix, digits, number, named, corner): stamps of any format near a page's top or bottom.

    A line's height is its number among the page's; its third says left, centre or right by the leading blanks.
    """
    sizes = rows.groupBy("doc_id", "page_no").agg(F.min("line_no").alias("_first"), F.count("*").alias("_lines"))
    likely = rows.where(F.col("line").rlike(r"\d")).join(sizes, ["doc_id", "page_no"])
    place = (F.col("line_no") - F.col("_first") + 0.5) / F.col("_lines")
    height = F.when(place <= 0.35, "t").when(place >= 0.65, "b")
    found = likely.select("doc_id", "page_no", "line_no", height.alias("corner"), F.explode(matches(F.col("line"), P.STAMP)).alias("text"))
    return found.withColumns(stamp_parts(F.col("text"))).where("digits IS NOT NULL AND corner IS NOT NULL")


def stamp_formats(found: DataFrame, pages: DataFrame) -> DataFrame:
    """(doc_id, prefix, suffix, digits, corner, n, score): each document's formats; pages: (doc_id, pages).

    score: 20 a page, 4 a stamp, 18 for each that goes on from the one before by as many as pages lie between, 12 times the share of
    pages (times the stamps of a single page), 14 if letters stand around the digits, and the digits, 8 at most.
    """
    keys = ["doc_id", "prefix", "suffix", "digits", "corner"]
    order = Window.partitionBy(*keys).orderBy("page_no", "number")
    on = F.col("page_no") - F.lag("page_no").over(order)
    follows = F.when((on > 0) & (F.col("number") - F.lag("number").over(order) == on), 1).otherwise(0)
    by = found.withColumn("follows", follows).groupBy(*keys, "named").agg(F.count("*").alias("n"), F.sum("follows").alias("follows"), F.countDistinct("page_no").alias("held")).join(pages, "doc_id")
    share = F.when(F.col("pages") <= 1, F.col("n").cast("double")).otherwise(F.col("held") / F.col("pages"))
    score = 20 * F.col("held") + 4 * F.col("n") + 18 * F.col("follows") + 12 * share + F.when(F.col("named"), 14).otherwise(0) + F.least("digits", F.lit(8))
    return by.select(*keys, "n", F.round(score, 6).alias("score"))


def best_format(formats: DataFrame) -> DataFrame:
    """Each document's format with the highest score, the first by name of equals."""
    order = Window.partitionBy("doc_id").orderBy(F.desc("score"), "prefix", "suffix", "digits", "corner")
    return formats.withColumn("_k", F.row_number().over(order)).where("_k = 1").drop("_k")


def stamp_pattern(prefix: str, digits: int, suffix: str = "") -> str:
    """A pattern for stamps of a known format: any separators, two digits more or fewer, any case."""
    gap = r"[\s._\-–—]*"
    literal = lambda s: "".join(gap if c in " \t._-–—" else ("\\" + c if c in r"\.^$|?*+()[]{}" else c) for c in s)
    return rf"(?i){literal(prefix)}{gap}\d(?:{gap}\d){{{max(1, digits - 2) - 1},{digits + 1}}}{gap}{literal(suffix)}"
