"""Streams of files: keep-latest tables, first terminal states, and incremental matches."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout
from pyspark.sql.types import BooleanType, LongType, StringType, StructField, StructType

from quire.operators.extraction import pattern_hits
from quire.operators.sequence import kept_last
from quire.sources.tables import lines_of


def stream(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def hits(docs: DataFrame, patterns: dict[str, str]) -> DataFrame:
    """Matches of each new document's lines: stateless, so in append mode."""
    return pattern_hits(lines_of(docs), patterns)


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events by type and window of event time; later ones than ``late`` no longer count."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"))


def latest(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    return kept_last(rows, keys, [F.desc(order)])


def kept_table(rows: DataFrame, keys: list[str], order: str, path: str, mode: str = "append") -> DataFrame:
    """The newest row of each key of the stream ``rows``, after all files that there are: each batch writes its newest rows.

    Batches are folders of their own, written over when a batch is tried again, so a lost executor or driver changes nothing.
    """

    def keep(batch: DataFrame, number: int) -> None:
        latest(batch, keys, order).write.mode("overwrite").parquet(f"{path}/batch={number}")

    rows.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{path}-state").trigger(availableNow=True).start().awaitTermination()
    return latest(rows.sparkSession.read.schema(rows.schema).parquet(path).select(*rows.columns), keys, order)


def terminal_states(events: DataFrame, key: str, status: str, order: str, at: str, terminal: list[str], late: str = "2 days", forget: str = "90 days") -> DataFrame:
    """(key, status, order, ended): each key's state whenever new events change it, for a sink in update mode.

    The first terminal status absorbs all later events, also those of later batches; until then the newest status holds. A key's state
    is kept, however many events it has, as one small row, and forgotten once the watermark (``late`` behind the newest event) is
    ``forget`` beyond its last event. Events later than the watermark don't count.
    """
    forget_ms = int(pd.Timedelta(forget).total_seconds() * 1000)
    types = events.schema
    out = StructType([types[key], StructField(status, StringType()), StructField(order, LongType()), StructField("ended", BooleanType())])
    held = StructType([StructField("status", StringType()), StructField("at", LongType()), StructField("ended", BooleanType())])

    def advance(keys: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        now, place, ended = state.get if state.exists else (None, None, False)
        before, first, newest = (now, place, ended), (place, now) if ended else None, 0
        for batch in batches:
            newest = max(newest, int(batch["_at"].max().timestamp() * 1000)) if len(batch) else newest
            rows = batch[[order, status]].sort_values(order, kind="stable")
            over = rows[rows[status].isin(terminal)]
            if not ended and len(over) and (first is None or over[order].iloc[0] < first[0]):
                first = (int(over[order].iloc[0]), over[status].iloc[0])
            if first is None and len(rows) and (place is None or rows[order].iloc[-1] >= place):
                place, now = int(rows[order].iloc[-1]), rows[status].iloc[-1]
        if first is not None:
            (place, now), ended = first, True
        state.update((now, place, ended))
        state.setTimeoutTimestamp(max(newest, state.getCurrentWatermarkMs()) + forget_ms)
        if (now, place, ended) != before:
            yield pd.DataFrame({key: [keys[0]], status: [now], order: [place], "ended": [ended]})

    read = events.select(key, status, F.col(order).cast("long").alias(order), F.col(at).cast("timestamp").alias("_at")).withWatermark("_at", late)
    return read.groupBy(key).applyInPandasWithState(advance, out, held, "update", GroupStateTimeout.EventTimeTimeout)


def first_terminal(rows: DataFrame, key: str, status: str, order: str, terminal: list[str]) -> DataFrame:
    """A job's first terminal state, which absorbs all later ones; without one, its last state."""
    ended = F.when(F.col(status).isin(terminal), F.struct(F.col(order), F.col(status)))
    return rows.groupBy(key).agg(F.coalesce(F.min(ended)[status], F.max_by(status, order)).alias(status))
