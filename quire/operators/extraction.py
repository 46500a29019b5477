"""Extraction: pattern matches in lines as rows."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import patterns as P
from quire.functions.text import matches, spans


def any_of(patterns: dict[str, str]) -> str:
    """One pattern that matches where any of ``patterns`` does: a cheap gate before the dear work."""
    return "|".join(f"(?:{P.java(p)})" for p in patterns.values())


def any_held(text: Column, patterns: dict[str, str]) -> Column:
    """Whether one of ``patterns`` is in the text: each looked for alone, and those of addresses only where there is an at sign."""
    held = lambda p: text.contains("@") & text.rlike(P.java(p)) if p == P.PERSONAL_DATA["email"] else text.rlike(P.java(p))
    return reduce(lambda a, b: a | b, map(held, patterns.values()), F.lit(False))


def gate_of(patterns: dict[str, str]) -> str:
    """A cheap pattern that matches wherever one of ``patterns`` does: personal data has a digit or an at sign."""
    return "[0-9@]" if patterns and all(p in P.PERSONAL_DATA.values() for p in patterns.values()) else any_of(patterns)


def pattern_hits(rows: DataFrame, patterns: dict[str, str], text: str = "line") -> DataFrame:
    """The columns of ``rows`` but the text, and category, start, length, text of every match; overlaps of categories stay."""
    gated = rows.where(F.col(text).rlike(gate_of(patterns)))

    def of_category(category: str, pattern: str):
        struct = lambda s: F.struct(F.lit(category).alias("category"), s["start"].alias("start"), s["length"].alias("length"), s["text"].alias("text"))
        return F.transform(spans(F.col(text), pattern), struct)

    per_category = [of_category(c, p) for c, p in patterns.items()]
    kept = [c for c in rows.columns if c != text]
    return gated.select(*kept, F.explode(F.concat(*per_category)).alias("h")).select(*kept, "h.*")


def keyword_pattern(keyword: str, match_case: bool = False, whole_word: bool = False, regex: bool = False) -> str:
    """The pattern of a keyword search; a bad pattern is an error here, before anything runs."""
    keyword = keyword.strip()
    pattern = keyword if regex else re.sub(r"[.*+?^${}()|\[\]\\]", r"\\\g<0>", keyword)
    if whole_word and not regex:
        pattern = rf"\b{pattern}\b"
    try:
        re.compile(pattern)
    except re.error as error:
        raise ValueError(f"not a pattern: {error}") from error
    return pattern if match_case else f"(?i){pattern}"


def keyword_hits(rows: DataFrame, keyword: str, scope: str = "word", **flags: bool) -> DataFrame:
    """(doc_id, page_no, line_no, start, text) of a keyword's hits: the word, its line, its sentence inside the line, or each page once."""
    pattern = keyword_pattern(keyword, **flags)
    found = pattern_hits(rows.withColumn("_line", F.col("line")), {"keyword": pattern}).where("length > 0") if keyword.strip() else rows.limit(0).withColumns({"_line": F.col("line"), "start": F.lit(0), "length": F.lit(0), "text": F.col("line")})
    line, keys = F.col("_line"), ["doc_id", "page_no", "line_no", "start"]
    if scope == "page":
        return found.select("doc_id", "page_no").distinct().select("doc_id", "page_no", *[F.lit(None).cast(t).alias(c) for c, t in (("line_no", "int"), ("start", "int"), ("text", "string"))])
    before, after = F.substring(line, F.lit(1), F.col("start")), F.substring(line, F.col("start") + 1, F.length(line))
    first = F.length(F.regexp_extract(before, r"^(.*[.?!]) ", 1))
    last = F.when(after.rlike("[.?!]"), F.col("start") + F.length(F.regexp_extract(after, r"^[^.?!]*[.?!]", 0))).otherwise(F.length(line))
    shown = {"word": F.col("text"), "line": line, "sentence": F.substring(line, first + 1, last - first)}[scope]
    return found.select(*keys, shown.alias("text"))


def normalised_hits(rows: DataFrame, patterns: dict[str, str]) -> DataFrame:
    """Matches in the lines and in their copies with confused digits put right, once for each category and span."""
    fixed = F.translate("line", P.CONFUSED, P.MEANT)
    kept = [c for c in rows.columns if c != "line"]
    both = rows.where(fixed.rlike(gate_of(patterns))).select(*kept, F.explode(F.array_distinct(F.array("line", fixed))).alias("line"))  # digits stay as they are
    return pattern_hits(both, patterns).drop("text").distinct()


def captions(rows: DataFrame, non_names: list[str]) -> DataFrame:
    """Both parties of every ``X v. Y``, but those made of headings' words only."""
    sides = F.concat(matches(F.col("line"), P.CAPTION, 1), matches(F.col("line"), P.CAPTION, 2))
    parties = rows.where(F.col("line").rlike(P.java(P.CAPTION))).select("doc_id", "line_no", F.explode(sides).alias("party"))
    bare = F.filter(F.transform(F.split("party", r"\s+"), lambda t: F.lower(F.regexp_replace(t, r"[.,'’\-]", ""))), lambda t: F.length(t) > 1)
    return parties.where(~((F.size(bare) > 0) & F.forall(bare, lambda t: t.isin(non_names))))


def first_by_priority(hits: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Hits that no hit of an earlier category in ``order`` overlaps."""
    ranked = hits.withColumn("rank", F.array_position(F.array(*map(F.lit, order)), F.col("category")))
    a, b = ranked.alias("a"), ranked.alias("b")
    same = reduce(lambda x, y: x & y, [F.col(f"a.{k}") == F.col(f"b.{k}") for k in keys])
    overlap = (F.col("b.start") < F.col("a.start") + F.col("a.length")) & (F.col("a.start") < F.col("b.start") + F.col("b.length"))
    return a.join(b, same & overlap & (F.col("b.rank") < F.col("a.rank")), "left_anti").drop("rank")


def merged_intervals(hits: DataFrame, keys: list[str], priority: list[str], gap: int) -> DataFrame:
    """Hits closer than ``gap`` as one: the union of the spans, the type of the highest priority, negated if any is."""
    w = Window.partitionBy(*keys).orderBy("start", "rank", "end")
    rank = F.array_position(F.array(*map(F.lit, priority)), F.col("type"))
    ranked = hits.withColumns({"rank": rank, "end": F.col("start") + F.col("length")})
    reached = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    opened = ranked.withColumn("opens", F.when(reached.isNull() | (F.col("start") > reached + gap), 1).otherwise(0))
    numbered = opened.withColumn("island", F.sum("opens").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*keys, "island").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.min_by("type", F.struct("rank", "start")).alias("type"), F.bool_or("negated").alias("negated")
    )


def near(hits: DataFrame, terms: DataFrame, keys: list[str], reach: int) -> DataFrame:
    """Hits within ``reach`` signs of a term on the same line, not overlapping it."""
    h, t = hits.alias("h"), terms.select(*keys, F.col("start").alias("t_start"), (F.col("start") + F.col("length")).alias("t_end")).alias("t")
    end = F.col("start") + F.col("length")
    close = (F.col("start") <= F.col("t_end") + reach) & (end >= F.col("t_start") - reach) & ((end <= F.col("t_start")) | (F.col("start") >= F.col("t_end")))
    return h.join(t, keys).where(close).drop("t_start", "t_end").distinct()
