"""Matches across the fragments that a page's text is drawn in: found on joined runs and cut back onto the fragments.

A page is a row with its positioned items as an array, so all of this is work inside the row: no shuffle, and a page is the
largest unit that is held.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.text import spans
from quire.operators.extraction import gate_of

ITEM = "struct<y:double,x0:double,item_no:int,str:string,x1:double,h:double>"
#: what a token ends at
OUTSIDE = r"[^\s:;=|,]*"


def _grouped(items: Column, joins: Callable[[Column, Column], Column]) -> Column:
    """Consecutive items as groups: one that ``joins`` the group before goes to it."""

    def step(groups: Column, item: Column) -> Column:
        last = F.get(groups, F.size(groups) - 1)
        longer = F.concat(F.slice(groups, F.lit(1), F.size(groups) - 1), F.array(F.concat(last, F.array(item))))
        return F.when((F.size(groups) > 0) & joins(last, item), longer).otherwise(F.concat(groups, F.array(F.array(item))))

    return F.aggregate(items, F.array().cast(f"array<array<{ITEM}>>"), step)


def lines_of_items(items: Column) -> Column:
    """Items by height, then place, as lines: an item belongs to the line whose first item it is nearer to than 0.6 of the larger height."""
    ordered = F.array_sort(F.transform(items, lambda i: F.struct(*[i[c].alias(c) for c in ("y", "x0", "item_no", "str", "x1", "h")]).cast(ITEM)))
    return _grouped(ordered, lambda line, i: F.abs(F.get(line, F.lit(0))["y"] - i["y"]) < F.greatest(F.get(line, F.lit(0))["h"], i["h"]) * 0.6)


def runs_of_line(line: Column) -> Column:
    """A line's items from left to right as runs: neighbours touch (half a height apart or over each other at most) and no white space parts them."""
    across = F.transform(F.array_sort(F.transform(line, lambda i: F.struct(i["x0"].alias("x0"), i["y"].alias("y"), i["item_no"].alias("n"), i.alias("item")))), lambda i: i["item"])

    def touches(run: Column, item: Column) -> Column:
        before = F.get(run, F.size(run) - 1)
        return (F.abs(item["x0"] - before["x1"]) <= F.greatest(before["h"], item["h"]) * 0.5) & ~before["str"].rlike(r"\s$") & ~item["str"].rlike(r"^\s")

    return _grouped(across, touches)


def runs(pages: DataFrame, items: str = "items") -> DataFrame:
    """The columns of ``pages`` but the items, and run: the items (``ITEM``) of each run of each line of a page."""
    kept = [c for c in pages.columns if c != items]
    lined = pages.select(*kept, F.explode(lines_of_items(F.col(items))).alias("_line"))
    return lined.select(*kept, F.explode(runs_of_line(F.col("_line"))).alias("run"))


def widened(text: Column, start: Column, length: Column) -> Column:
    """(first, last): the span with what its token has on both sides."""
    left = F.regexp_extract(F.substring(text, F.lit(1), start), OUTSIDE + "$", 0)
    right = F.regexp_extract(F.substring(text, start + length + 1, F.length(text)), "^" + OUTSIDE, 0)
    return F.struct((start - F.length(left)).alias("first"), (start + length + F.length(right)).alias("last"))


def fragment_hits(pages: DataFrame, patterns: dict[str, str], items: str = "items") -> DataFrame:
    """Distinct (columns of ``pages`` but the items, category, item_no, start, length, text): what to hide of each item.

    A match on the text of a run of several items is widened to its token and cut back onto the items by the running sums of their
    lengths. A match inside one item is widened there; where it then touches the item's edge, the items of the run on that side
    lose what their tokens have next to it. Items or runs without a sign of any pattern are passed over.
    """
    kept = [c for c in pages.columns if c != items]
    gated = pages.where(F.exists(items, lambda i: i["str"].rlike(gate_of(patterns))))
    parts = runs(gated, items).withColumn("text", F.array_join(F.transform("run", lambda i: i["str"]), "")).where(F.col("text").rlike(gate_of(patterns)))
    starts = F.transform("run", lambda i, n: F.struct(i["item_no"].alias("item_no"), i["str"].alias("str"), F.aggregate(F.slice("run", F.lit(1), n), F.lit(0), lambda a, p: a + F.length(p["str"])).alias("at")))
    parts = parts.select(*kept, "text", starts.alias("parts"))

    def of(text: Column) -> Column:
        named = lambda category: lambda s: F.struct(F.lit(category).alias("category"), s["start"].alias("start"), s["length"].alias("length"))
        return F.concat(*[F.transform(spans(text, p), named(c)) for c, p in patterns.items()])

    joined = parts.where(F.size("parts") > 1).select(*kept, "text", "parts", F.explode(of(F.col("text"))).alias("hit"))
    joined = joined.select(*kept, "parts", "hit.category", widened(F.col("text"), F.col("hit.start"), F.col("hit.length")).alias("w"))
    first = lambda p: F.greatest(F.lit(0), F.col("w.first") - p["at"])
    last = lambda p: F.least(F.length(p["str"]), F.col("w.last") - p["at"])
    across = F.filter(F.transform("parts", lambda p: _piece(p, first(p), last(p))), lambda p: p["length"] > 0)

    inside = parts.select(*kept, "parts", F.posexplode("parts").alias("n", "part")).where(F.col("part.str").rlike(gate_of(patterns)))
    inside = inside.select(*kept, "parts", "n", "part", F.explode(of(F.col("part.str"))).alias("hit"))
    inside = inside.select(*kept, "parts", "n", "part", "hit.category", widened(F.col("part.str"), F.col("hit.start"), F.col("hit.length")).alias("w"))
    size = lambda s, pattern: F.length(F.regexp_extract(s, pattern, 0))
    before = F.when(F.col("w.first") == 0, F.transform(F.slice("parts", F.lit(1), F.col("n")), lambda p: _piece(p, F.length(p["str"]) - size(p["str"], OUTSIDE + "$"), F.length(p["str"]))))
    after = F.when(F.col("w.last") == F.length("part.str"), F.transform(F.slice("parts", F.col("n") + 2, F.size("parts")), lambda p: _piece(p, F.lit(0), size(p["str"], "^" + OUTSIDE))))
    none = F.array().cast("array<struct<item_no:int,start:int,length:int,text:string>>")
    chained = F.filter(F.concat(F.array(_piece(F.col("part"), F.col("w.first"), F.col("w.last"))), F.coalesce(before, none), F.coalesce(after, none)), lambda p: p["length"] > 0)

    rows = joined.select(*kept, "category", F.explode(across).alias("p")).unionByName(inside.select(*kept, "category", F.explode(chained).alias("p")))
    return rows.select(*kept, "category", "p.*").distinct()


def _piece(part: Column, first: Column, last: Column) -> Column:
    length = (last - first).cast("int")
    return F.struct(part["item_no"].alias("item_no"), first.cast("int").alias("start"), length.alias("length"), F.substring(part["str"], first + 1, length).alias("text"))
