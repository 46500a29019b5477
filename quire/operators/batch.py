"""Batches of documents that one bad document does not stop: every row says whether it was done, or what went wrong."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OUTCOME = "struct<status:string,error:string,out:string>"


def guarded(op: Callable[..., str | None]) -> Callable[..., Column]:
    """``op`` on the values of a row, as a column ``OUTCOME``: done with its result, or error with its message, and no failed task."""

    def outcome(values: tuple) -> tuple[str, str | None, str | None]:
        try:
            return "done", None, op(*(None if v is pd.NA else v for v in values))
        except Exception as error:  # what a row does wrong is that row's result
            return "error", str(error) or type(error).__name__, None

    @F.pandas_udf(OUTCOME)
    def run(*columns: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([outcome(row) for row in zip(*columns, strict=True)], columns=["status", "error", "out"], dtype=object)

    return run


def checked(value: Column, checks: list[tuple[Column, Column | str]]) -> Column:
    """``value`` as an ``OUTCOME``, or the message of the first check (what must not hold, message) that holds; it is not worked out then.

    For steps in column functions: what would raise an error inside ``value`` is named by a check before it.
    """
    error = F.lit(None).cast("string")
    for wrong, message in reversed(checks):
        error = F.when(F.coalesce(wrong, F.lit(False)), message if isinstance(message, Column) else F.lit(message)).otherwise(error)
    named = F.array(error)
    return F.transform(named, lambda e: F.struct(F.when(e.isNull(), "done").otherwise("error").alias("status"), e.alias("error"), F.when(e.isNull(), value).alias("out")))[0]


def progress(rows: DataFrame, outcome: str = "outcome", by: list[str] | None = None) -> DataFrame:
    """(by, total, done, failed) of a batch."""
    status = F.col(f"{outcome}.status")
    return rows.groupBy(*(by or [])).agg(F.count("*").alias("total"), F.count_if(status == "done").alias("done"), F.count_if(status == "error").alias("failed"))
