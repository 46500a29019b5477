"""Privilege review: findings of seven kinds in the text of pages, also where a phrase goes on in the next line.

A page is a row with its lines as an array; its text is the lines that are not empty, with a space between them. Finding, placing
and merging are work inside the row, so nothing is shuffled and lines are made and counted once.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import patterns as P
from quire.functions.text import spans
from quire.functions.values import chosen

#: a finding: where it starts in the page's text and ends, the number of its line on the page from 0
FOUND = "struct<start:int,end:int,type:string,line:int,text:string,negated:boolean>"


def _lines(lines: Column) -> Column:
    """(at, size, line): the lines that are not empty, where each starts in the page's text, its length and its number."""
    held = F.filter(F.transform(lines, lambda line, i: F.struct(F.length(line).alias("size"), i.alias("line"))), lambda x: x["size"] > 0)
    step = lambda out, x: F.concat(out, F.array(F.struct(F.coalesce(F.get(out, F.size(out) - 1)["at"] + F.get(out, F.size(out) - 1)["size"] + 1, F.lit(0)).alias("at"), x["size"].alias("size"), x["line"].alias("line"))))
    return F.aggregate(held, F.array().cast("array<struct<at:int,size:int,line:int>>"), step)


def _has(text: Column, low: Column, words: Iterable[str]) -> Column:
    """Whether the text has one of ``words``, small letters in any case: plain searches, many times cheaper than a pattern of them all."""
    return reduce(lambda a, b: a | b, [(low if w == w.lower() and w != "@" else text).contains(w) for w in sorted(words)])


def _hits(text: Column, low: Column) -> Column:
    """All matches as (kind, start, length, text); none where no word of any pattern is there."""
    named = lambda kind: lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["length"].alias("length"), s["text"].alias("text"))
    found = F.concat(*[F.transform(spans(text, p, _has(text, low, P.REVIEW_WORDS[k])), named(k)) for k, p in P.REVIEW.items()])
    words = {w for held in P.REVIEW_WORDS.values() for w in held}
    return F.when(_has(text, low, words), found).otherwise(F.array().cast("array<struct<kind:string,start:int,length:int,text:string>>"))


def page_findings(pages: DataFrame, band: float = 0.15) -> DataFrame:
    """``pages`` (doc_id, page_no, lines) with matches, with text and found: an array of ``FOUND`` by start.

    A confidentiality phrase is a legend in the top or bottom ``band`` of its page and a privilege phrase elsewhere; its place is the
    middle of the line that it starts in, by that line's number among the page's. Addresses count if their domain sounds like
    lawyers. A negator in the forty signs before a finding marks it, unless they say ``not only``; addresses are never negated.
    """
    text = F.array_join(F.filter("lines", lambda line: line != ""), " ")
    bound = F.transform(F.array(F.struct(text.alias("text"), F.lower(text).alias("low"))), lambda t: F.struct(t["text"].alias("text"), _hits(t["text"], t["low"]).alias("hits")))
    kept = F.explode(F.filter(bound, lambda t: F.size(t["hits"]) > 0))  # not a predicate, which Spark would push below and work out twice
    located = pages.select("doc_id", "page_no", "lines", kept.alias("t")).select("doc_id", "page_no", "lines", "t.text", "t.hits", _lines(F.col("lines")).alias("starts"))
    own = lambda name: P.java(P.REVIEW[name])

    def counts(h: Column) -> Column:
        covered = h["text"].rlike(own("attorney-client")) | h["text"].rlike(own("work-product"))
        return ~((h["kind"] == "email") & ~h["text"].rlike(P.LAW_DOMAIN)) & ~((h["kind"] == "general") & covered)

    def found(h: Column) -> Column:
        kind, start = h["kind"], h["start"]
        line = F.get("starts", F.size(F.filter("starts", lambda x: x["at"] <= start)) - 1)["line"]
        place = (line + 0.5) / F.size("lines")
        legend = F.when((place < band) | (place > 1 - band), "confidentiality-legend").otherwise("privilege-phrase")
        names = [(kind == "legend", legend), (kind == "email", F.lit("law-firm-email")), (kind == "general", F.lit("privilege-phrase")), (kind.isin("esquire", "attorney-for"), F.lit("counsel-name"))]
        before = F.substring(F.col("text"), F.greatest(F.lit(1), start - 39), F.least(start, F.lit(40)))
        negated = (kind != "email") & before.rlike(P.java(P.NEGATION)) & ~before.rlike(P.java(r"(?i)\bnot\s+only\b"))
        return F.struct(start.alias("start"), (start + h["length"]).alias("end"), chosen(names, kind).alias("type"), line.alias("line"), h["text"].alias("text"), negated.alias("negated"))

    return located.select("doc_id", "page_no", "lines", "text", F.array_sort(F.transform(F.filter("hits", counts), found)).cast(f"array<{FOUND}>").alias("found"))


def findings(pages: DataFrame, band: float = 0.15) -> DataFrame:
    """(doc_id, page_no, line, type, start, length, text, negated) of every finding; start counts in the page's text."""
    rows = page_findings(pages, band).select("doc_id", "page_no", F.explode("found").alias("f"))
    return rows.select("doc_id", "page_no", "f.line", "f.type", "f.start", (F.col("f.end") - F.col("f.start")).alias("length"), "f.text", "f.negated")


def merged(pages: DataFrame, gap: int = 8, band: float = 0.15) -> DataFrame:
    """(doc_id, page_no, start, end, type, negated): findings of a page ``gap`` signs apart at most as one, of the more specific kind."""
    rank = lambda f: F.array_position(F.array(*map(F.lit, P.REVIEW_ORDER)), f["type"])

    def step(kept: Column, f: Column) -> Column:
        last = F.get(kept, F.size(kept) - 1)
        both = F.struct(
            F.least(last["start"], f["start"]).alias("start"), F.greatest(last["end"], f["end"]).alias("end"), F.when(rank(f) < rank(last), f["type"]).otherwise(last["type"]).alias("type"),
            last["line"].alias("line"), last["text"].alias("text"), (last["negated"] | f["negated"]).alias("negated"),
        )
        return F.when((F.size(kept) > 0) & (f["start"] <= last["end"] + gap), F.concat(F.slice(kept, F.lit(1), F.size(kept) - 1), F.array(both))).otherwise(F.concat(kept, F.array(f)))

    rows = page_findings(pages, band).select("doc_id", "page_no", F.explode(F.aggregate("found", F.array().cast(f"array<{FOUND}>"), step)).alias("f"))
    return rows.select("doc_id", "page_no", "f.start", "f.end", "f.type", "f.negated")
