"""Column functions on texts: matches with offsets, snippets, tokens."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .patterns import STOPWORDS, java


def matches(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(java(pattern)), F.lit(group))


def spans(text: Column, pattern: str, gate: Column | None = None) -> Column:
    """All matches as structs of start (from 0), length and text: one walk along the gaps between matches adds up the offsets.

    ``gate``: a cheaper test that holds wherever ``pattern`` matches.
    """
    kind = "array<struct<start:int,length:int,text:string>>"
    parts = F.arrays_zip(matches(text, pattern).alias("m"), F.transform(F.split(text, java(pattern), -1), F.length).alias("gap"))

    def walk(state: Column, part: Column) -> Column:
        start, length = state["at"] + part["gap"], F.coalesce(F.length(part["m"]), F.lit(0))
        found = F.struct(start.alias("start"), length.alias("length"), part["m"].alias("text"))
        return F.struct((start + length).alias("at"), F.when(part["m"].isNull(), state["out"]).otherwise(F.concat(state["out"], F.array(found))).alias("out"))

    walked = F.aggregate(parts, F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("out")), walk, lambda state: state["out"])
    return F.when(text.rlike(java(pattern)) if gate is None else gate, walked).otherwise(F.array().cast(kind))


def snippet(text: Column, start: Column, length: Column, reach: int) -> Column:
    """The match with ``reach`` signs on both sides, dots where something was cut, white space collapsed."""
    first = F.greatest(F.lit(0), start - reach)
    last = F.least(F.length(text), start + length + reach)
    cut = F.trim(F.regexp_replace(F.substring(text, first + 1, last - first), r"\s+", " "))
    return F.concat(F.when(first > 0, "…").otherwise(""), cut, F.when(last < F.length(text), "…").otherwise(""))


def words_around(text: Column, start: Column, end: Column, words: int = 10, reach: int = 240) -> Column:
    """(before, match, after): the match as whole words, and up to ``words`` words of the ``reach`` signs on both sides, dots where words were cut."""
    size = lambda s, pattern: F.length(F.regexp_extract(s, pattern, 0))
    first = start - size(F.substring(text, F.lit(1), start), r"\S*$")
    last = end + size(F.substring(text, end + 1, F.length(text)), r"^\S*")
    plain = lambda s: F.trim(F.regexp_replace(s, r"\s+", " "))
    tokens = lambda s: F.filter(F.split(plain(s), " "), lambda w: w != "")
    left = tokens(F.substring(text, F.greatest(F.lit(0), first - reach) + 1, F.least(first, F.lit(reach))))
    right = tokens(F.substring(text, last + 1, F.lit(reach)))
    kept = F.slice(left, F.greatest(F.lit(1), F.size(left) - words + 1), F.lit(words))
    before = F.concat(F.when(F.size(left) > words, "… ").otherwise(""), F.array_join(kept, " "), F.when(F.size(left) > 0, " ").otherwise(""))
    after = F.concat(F.when(F.size(right) > 0, " ").otherwise(""), F.array_join(F.slice(right, F.lit(1), F.lit(words)), " "), F.when(F.size(right) > words, " …").otherwise(""))
    return F.struct(before.alias("before"), plain(F.substring(text, first + 1, last - first)).alias("match"), after.alias("after"))


#: a search term in lower case: a whole run of letters and digits, two at least, that is no stop word
TERM = r"(?<![a-z0-9])(?!(?:%s)(?![a-z0-9]))[a-z0-9]{2,}" % "|".join(STOPWORDS)


def terms(text: Column) -> Column:
    """The search terms of a text, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0))


def n_terms(low: Column) -> Column:
    """How many search terms a text in lower case has."""
    return F.regexp_count(low, F.lit(TERM))


def n_of(low: Column, term: str) -> Column:
    """How often a text in lower case has ``term`` as a search term."""
    counts = bool(re.fullmatch(TERM, term))
    whole = F.lit(f"(?<![a-z0-9]){re.escape(term)}(?![a-z0-9])")
    return F.when(low.contains(term), F.regexp_count(low, whole)).otherwise(0) if counts else F.lit(0)


def mapped(keys: Column, table: dict[str, str], other: Column) -> Column:
    """``keys`` through a small fixed table."""
    out = other
    for k, v in table.items():
        out = F.when(keys == k, v).otherwise(out)
    return out
