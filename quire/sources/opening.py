"""Sources that set aside what they can't read, with the reason, instead of failing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RAW = "_unread"


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Lines of JSON by ``schema``, with path and ``RAW``: a line that is no JSON or doesn't fit the schema, else null."""
    read = spark.read.schema(f"{schema}, {RAW} string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", RAW).json(path)
    return read.withColumn("path", F.col("_metadata.file_path"))


def split(rows: DataFrame, needed: list[str]) -> tuple[DataFrame, DataFrame]:
    """(good, quarantine): rows that were read and have all of ``needed``, and path, reason, raw of the others."""
    reason = F.when(F.col(RAW).isNotNull(), "malformed")
    for c in needed:
        reason = reason.when(F.col(c).isNull(), f"no {c}")
    judged = rows.withColumn("reason", reason)
    whole = F.to_json(F.struct(*[c for c in rows.columns if c not in (RAW, "path")]))
    return judged.where("reason IS NULL").drop("reason", RAW, "path"), judged.where("reason IS NOT NULL").select("path", "reason", F.coalesce(RAW, whole).alias("raw"))


def opened(content: Column) -> Column:
    """What a file's bytes say of it as a paginated document: ok, encrypted, malformed or empty."""
    text = F.decode(content, "ISO-8859-1")
    whole = F.substring(text, 1, 1024).contains("%PDF-") & F.substring(text, -2048, 2048).contains("%%EOF")
    return F.when(F.length(content) == 0, "empty").when(~whole, "malformed").when(text.rlike(r"/Encrypt\b"), "encrypted").otherwise("ok")


def open_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """path, length, status and content of files; content is null where the status is not ok. Spark doesn't list files without a byte."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    status = opened(F.col("content"))
    return files.select("path", "length", status.alias("status"), F.when(status == "ok", F.col("content")).alias("content"))
