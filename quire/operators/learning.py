"""What users choose again and again, from their choices in order.

A tool is preferred once it was chosen twice in a row for the same request, where another choice, or more than ``decay`` without
any, starts anew; a preference not used for ``decay`` is forgotten. Runs are found by sums and maxima that Spark forms before it shuffles, so a
request with most of the choices is no single task: pauses are looked for among stretches as long as ``decay``, not among choices.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: seconds: ninety days
DECAY = 90 * 24 * 3600


def runs(picks: DataFrame, key: str, choice: str, at: str, order: str, decay: int = DECAY) -> DataFrame:
    """(key, choice, count, last_at): each key's last choice and how often it was made without a break up to then.

    ``order`` tells choices of one moment apart. Rows without a key or choice don't count.
    """
    rows = picks.where(F.col(key).isNotNull() & F.col(choice).isNotNull()).select(F.col(key).alias("_key"), F.col(choice).alias("_choice"), F.struct(F.col(at).alias("at"), F.col(order).alias("o")).alias("_when"))
    last = rows.groupBy("_key").agg(F.max_by("_choice", "_when").alias("_last"), F.max("_when").alias("_at"))
    each = rows.groupBy("_key", "_choice").agg(F.max("_when").alias("_when")).join(last, "_key")
    other = each.where(F.col("_choice") != F.col("_last")).groupBy("_key").agg(F.max("_when").alias("_other"))
    stretch = F.floor(F.col("_when.at").cast("timestamp").cast("long") / decay)  # inside one no pause is long enough
    stretches = rows.groupBy("_key", stretch.alias("_stretch")).agg(F.min("_when").alias("_first"), F.max("_when").alias("_end"))
    before = F.lag("_end").over(Window.partitionBy("_key").orderBy("_stretch"))
    pauses = stretches.withColumn("_before", before).where(F.col("_first")["at"] > F.col("_before")["at"] + F.expr(f"INTERVAL {decay} SECONDS")).groupBy("_key").agg(F.max("_first").alias("_resumed"))
    bounds = last.join(other, "_key", "left").join(pauses, "_key", "left")
    held = rows.join(bounds, "_key")
    counts = (F.col("_other").isNull() | (F.col("_when") > F.col("_other"))) & (F.col("_resumed").isNull() | (F.col("_when") >= F.col("_resumed")))
    return held.where(counts).groupBy(F.col("_key").alias(key)).agg(F.any_value("_last").alias(choice), F.count("*").alias("count"), F.max("_when.at").alias("last_at"))


def preferred(picks: DataFrame, key: str, choice: str, at: str, order: str, now: Column, least: int = 2, decay: int = DECAY) -> DataFrame:
    """(key, choice): what was chosen ``least`` times in a row and within ``decay`` of ``now``."""
    found = runs(picks, key, choice, at, order, decay)
    return found.where((F.col("count") >= least) & (now <= F.col("last_at") + F.expr(f"INTERVAL {decay} SECONDS"))).select(key, choice)


def preferred_lane(picks: DataFrame, key: str, lane: str, lanes: list[str], least: int = 2, lead: int = 1) -> DataFrame:
    """(key, lane): the lane that was chosen ``least`` times and ``lead`` more often than the next."""
    counts = picks.where(F.col(lane).isin(lanes)).groupBy(key).agg(*[F.count_if(F.col(lane) == name).alias(name) for name in lanes])
    ranked = F.reverse(F.array_sort(F.array(*[F.struct(F.col(name).alias("n"), F.lit(-i).alias("i"), F.lit(name).alias("lane")) for i, name in enumerate(lanes)])))
    found = counts.select(key, ranked.alias("r"))
    return found.where((F.col("r")[0]["n"] >= least) & (F.col("r")[0]["n"] - F.coalesce(F.get("r", F.lit(1))["n"], F.lit(0)) >= lead)).select(key, F.col("r")[0]["lane"].alias(lane))
