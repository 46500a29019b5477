"""Sequences of pages: ranges, breaks, numbers, islands, trees."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def strict_ranges(text: str, total: int) -> list[list[int]]:
    """Groups of pages from ``1-3, 5, 8-``; anything else is an error."""
    groups = []
    for part in filter(None, map(str.strip, text.split(","))):
        found = re.fullmatch(r"(\d+)(?:\s*(-)\s*(\d*))?", part)
        if not found:
            raise ValueError(f"not a range: {part}")
        first = int(found[1])
        last = first if not found[2] else int(found[3]) if found[3] else total
        if first < 1 or last > total:
            raise ValueError(f"out of bounds: {part}")
        if last < first:
            raise ValueError(f"backwards: {part}")
        groups.append(list(range(first, last + 1)))
    return groups


def lenient_range(text: str, total: int) -> list[int]:
    """Pages from a range text: backwards ones are turned, all are clamped, sorted and distinct; nothing means all."""
    pages: set[int] = set()
    if text.strip().lower() in ("", "all"):
        return list(range(1, total + 1))
    for first, last in re.findall(r"(\d+)(?:\s*-\s*(\d+))?", text):
        a, b = sorted((int(first), int(last or first)))
        pages |= set(range(max(1, a), min(total, b) + 1))
    return sorted(pages)


def selected(pages: DataFrame, numbers: list[int], page: str = "page_no") -> DataFrame:
    return pages.where(F.col(page).isin(numbers)) if numbers else pages.limit(0)


def parts_from_breaks(pages: DataFrame, is_break: Column, keys: list[str], order: str) -> DataFrame:
    """``pages`` with part: how many breaks lie at or before each page, from 1."""
    w = Window.partitionBy(*keys).orderBy(order)
    first = F.row_number().over(w) == 1
    return pages.withColumn("part", F.sum(F.when(is_break | first, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def after_gaps(pages: DataFrame, is_blank: Column, keys: list[str], order: str) -> DataFrame:
    """The first page after each run of blank ones."""
    marked = pages.withColumn("_blank", is_blank)
    return marked.withColumn("_before", F.lag("_blank").over(Window.partitionBy(*keys).orderBy(order))).where("_before AND NOT _blank").drop("_blank", "_before")


def key_changes(rows: DataFrame, key: str, keys: list[str], order: str) -> DataFrame:
    """Rows whose key differs from the last one that was not null."""
    known = rows.where(F.col(key).isNotNull())
    before = F.lag(key).over(Window.partitionBy(*keys).orderBy(order))
    return known.withColumn("_before", before).where(F.col("_before") != F.col(key)).drop("_before")


def condensed(rows: DataFrame, keys: list[str], page: str) -> DataFrame:
    """Pages as ``1–3, 5``: islands of consecutive numbers."""
    w = Window.partitionBy(*keys).orderBy(page)
    islands = rows.select(*keys, page).distinct().withColumn("island", F.col(page) - F.row_number().over(w))
    ends = islands.groupBy(*keys, "island").agg(F.min(page).alias("a"), F.max(page).alias("b"))
    shown = F.when(F.col("a") == F.col("b"), F.col("a").cast("string")).otherwise(F.concat_ws("–", "a", "b"))
    ordered = F.array_sort(F.collect_list(F.struct("a", shown.alias("s"))))
    return ends.groupBy(*keys).agg(F.array_join(F.transform(ordered, lambda x: x["s"]), ", ").alias("pages"))


def numbered(files: DataFrame, order: str, pages: str, start: int, rows_a_range: int = 100_000) -> DataFrame:
    """Continuous numbers over ``files`` by a numeric ``order``: first and last of each.

    Sums run inside ranges of the order; what lies before a range is a sum over one row a range, so no task sees all files.
    """
    rows, low, high = files.agg(F.count("*"), F.min(order), F.max(order)).first()
    ranges = max(1, -(-rows // rows_a_range))
    width = ((high - low) / ranges if rows else 0) or 1
    ranged = files.withColumn("_range", F.floor((F.col(order) - F.lit(low or 0)) / F.lit(width)).cast("bigint"))
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = ranged.groupBy("_range").agg(F.sum(pages).alias("_sum")).select("_range", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_range").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    last = F.col("_before") + F.sum(pages).over(inside) + start - 1
    summed = ranged.join(before, "_range").withColumn("last_number", last).drop("_range", "_before")
    return summed.withColumn("first_number", F.col("last_number") - F.col(pages) + 1)


def running(rows: DataFrame, keys: list[str], order: str, sums: dict[str, Column], ties: list[str] = (), descending: bool = False, ranges: int = 64) -> DataFrame:
    """``rows`` with a running sum, the row itself included, for each of ``sums`` in each group, by a numeric ``order``, then ``ties``.

    A group's rows lie in ``ranges`` of approximate quantiles of their order; sums run inside these, and what lies before a range is
    a sum over its group's ranges, so no task sees a whole group. Rows without an order come first, or last if it descends; null keys are a group.
    """
    bounds = rows.groupBy(*keys).agg(F.percentile_approx(order, [i / ranges for i in range(1, ranges)], 1000).alias("_bounds"))
    bounds = bounds.select(*[F.col(k).alias(f"_{k}") for k in keys], "_bounds")
    spot = F.coalesce(F.size(F.filter("_bounds", lambda b: b < F.col(order))), F.lit(-1))
    placed = rows.withColumns({f"_of_{name}": c for name, c in sums.items()}).join(bounds, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
    placed = placed.withColumn("_range", F.when(F.col(order).isNull(), -1).otherwise(spot)).drop("_bounds", *[f"_{k}" for k in keys])
    way = F.desc_nulls_last if descending else F.asc_nulls_first
    earlier = Window.partitionBy(*keys).orderBy(way("_range")).rowsBetween(Window.unboundedPreceding, -1)
    totals = placed.groupBy(*keys, "_range").agg(*[F.sum(f"_of_{n}").alias(f"_sum_{n}") for n in sums])
    before = totals.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("_range").alias("_r"), *[F.coalesce(F.sum(f"_sum_{n}").over(earlier), F.lit(0)).alias(f"_before_{n}") for n in sums])
    inside = Window.partitionBy(*keys, "_range").orderBy(way(order), *ties).rowsBetween(Window.unboundedPreceding, 0)
    met = placed.join(before, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys] + [F.col("_range") == F.col("_r")])
    return met.select(*rows.columns, *[(F.col(f"_before_{n}") + F.sum(f"_of_{n}").over(inside)).alias(n) for n in sums])


def concatenated(files: list[DataFrame], order: str, pages: str) -> DataFrame:
    """The rows of ``files`` one after the other, numbered on from 1: each file by ranges, then moved by what lies before it."""
    out, before = None, 0
    for file in files:
        now = numbered(file, order, pages, before + 1)
        before += file.agg(F.coalesce(F.sum(pages), F.lit(0))).first()[0]
        out = now if out is None else out.unionByName(now)
    return out


def every_n(pages: DataFrame, n: int, page: str = "page_no") -> DataFrame:
    """``pages`` with part: ``n`` pages each, from 1; ``n`` of 1 puts each page in a part of its own."""
    return pages.withColumn("part", (F.floor((F.col(page) - 1) / n) + 1).cast("int"))


def split_points(text: str, total: int) -> list[int]:
    """Pages at which a new part begins, from ``5, 12 18``; anything else than pages from 2 to ``total`` is an error."""
    points = set()
    for part in filter(None, re.split(r"[,\s]+", text)):
        if not part.isascii() or not part.isdigit() or not 2 <= int(part) <= total:
            raise ValueError(f"not a page from 2 to {total}: {part}")
        points.add(int(part))
    return sorted(points)


def preview_parts(pages: DataFrame, excluded: Column, keys: list[str], base: str, part: str = "part", page: str = "page_no") -> DataFrame:
    """(keys, part, index, start_page, end_page, pages, name): parts without the excluded pages; empty ones go, the rest are numbered on.

    Names have as many digits as the number of all parts, two at least.
    """
    of_all = pages.groupBy(*keys).agg(F.countDistinct(part).alias("_parts"))
    held = pages.where(~excluded).groupBy(*keys, part).agg(F.min(page).alias("start_page"), F.max(page).alias("end_page"), F.count("*").alias("pages")).join(of_all, keys)
    index = F.row_number().over(Window.partitionBy(*keys).orderBy(part))
    width = F.greatest(F.lit(2), F.length(F.col("_parts").cast("string")))
    named = held.withColumn("index", index)
    return named.withColumn("name", F.concat(F.lit(f"{base}-part"), F.lpad(F.col("index").cast("string"), width, F.lit("0")))).drop("_parts")


def parents(rows: DataFrame, keys: list[str], order: str, level: str, levels: list[int]) -> DataFrame:
    """``rows`` with parent: the nearest row before with a lower one of the ``levels``; of each level the last place is carried on."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    last = [F.when(F.col(level) > k, F.last(F.when(F.col(level) == k, F.col(order)), ignorenulls=True).over(w)) for k in levels]
    return rows.withColumn("parent", F.array_max(F.array(*last)))


def within_budget(rows: DataFrame, keys: list[str], newest: str, size: str, budget: int, most: int) -> DataFrame:
    """The rows with the largest ``newest`` until their sizes or their number exceed the limits."""
    held = running(rows, keys, newest, {"_sum": F.col(size), "_k": F.lit(1)}, descending=True)
    return held.where((F.col("_sum") <= budget) & (F.col("_k") <= most)).drop("_sum", "_k")


def kept_last(rows: DataFrame, keys: list[str], newest: list[Column]) -> DataFrame:
    """One row a key: the newest."""
    return rows.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(*newest))).where("_k = 1").drop("_k")
