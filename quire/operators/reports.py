"""Aggregates that the reports share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def nearest_rank(rows: DataFrame, keys: list[str], value: str, share: float, ranges: int = 64) -> DataFrame:
    """(keys, rank_value): the value at the floor of ``share`` of a group's count, the last one at most; nulls don't count.

    Equal values are counted first. A large group's values lie in ``ranges`` of approximate quantiles; the counts of these say which
    range holds the rank, and only that one is put in order, so no task sees a whole group.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_n"))
    if ranges == 1:  # small groups
        own = Window.partitionBy(*keys)
        summed = counts.withColumns({"_all": F.sum("_n").over(own), "_upto": F.sum("_n").over(own.orderBy(value))})
        return summed.where(F.col("_upto") > F.least(F.col("_all") - 1, F.floor(F.col("_all") * share))).groupBy(*keys).agg(F.min(value).alias("rank_value"))
    bounds = counts.groupBy(*keys).agg(F.percentile_approx(value, [i / ranges for i in range(1, ranges)], 1000).alias("_bounds"), F.sum("_n").alias("_all"))
    same = [F.col(f"c.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    placed = counts.alias("c").join(bounds.alias("b"), same, "inner").select("c.*", "_all", F.size(F.filter("_bounds", lambda b: b < F.col(f"c.{value}"))).alias("_range"))
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sums = placed.groupBy(*keys, "_range").agg(F.sum("_n").alias("_sum"), F.first("_all").alias("_all")).withColumn("_before", F.coalesce(F.sum("_sum").over(before), F.lit(0)))
    rank = F.least(F.col("_all") - 1, F.floor(F.col("_all") * share))
    of_rank = sums.where((F.col("_before") <= rank) & (rank < F.col("_before") + F.col("_sum"))).select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("_range").alias("_r"), "_before")
    chosen = placed.join(of_rank, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys] + [F.col("_range") == F.col("_r")])
    upto = F.sum("_n").over(Window.partitionBy(*keys).orderBy(value)) + F.col("_before")
    return chosen.withColumn("_upto", upto).where(F.col("_upto") > rank).groupBy(*keys).agg(F.min(value).alias("rank_value"))


def without_running_lines(rows: DataFrame, share: float = 0.6, least: int = 3) -> DataFrame:
    """Lines whose first forty signs don't recur on most pages of the document."""
    pages = rows.groupBy("doc_id").agg(F.countDistinct("page_no").alias("pages"))
    heads = rows.groupBy("doc_id", F.substring("line", 1, 40).alias("head")).agg(F.countDistinct("page_no").alias("n"))
    running = heads.join(pages, "doc_id").where(F.col("n") >= F.greatest(F.lit(least), F.floor(F.col("pages") * share))).select("doc_id", "head")
    return rows.withColumn("head", F.substring("line", 1, 40)).join(running, ["doc_id", "head"], "left_anti").drop("head")


def sort_key(name: Column) -> Column:
    """A name in lower case without the words that captions begin with."""
    return F.lower(F.regexp_replace(name, r"(?i)^(?:In re|Ex parte|Matter of|The)\s+", ""))
