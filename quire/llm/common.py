"""What the operators share: tables, the shared folder, checked broadcasts."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: partitions of a labelled sample
SAMPLE_PARTS = 24
ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_LOWER = "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors see; on a local master, where all share one disk, one of our own if the session names none."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named and not spark.sparkContext.master.startswith(("local[", "local ")) and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors see")
    if not named:
        named = getattr(spark.sparkContext, "_quire_shared", None) or tempfile.mkdtemp(prefix="quire-shared-")
        spark.sparkContext._quire_shared = named
    return named.rstrip("/")


def written(df: DataFrame, what: str) -> DataFrame:
    """``df`` as a table in the shared folder, read again: cuts the lineage and outlives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quire/{what}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def arrow_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Meanwhile, Arrow batches of at most ``rows`` rows: wide rows in large batches cost memory outside the heap, twice."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, rows)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def small(df: DataFrame, most_rows: int) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``most_rows`` rows (counted up to one more), else as it is."""
    return F.broadcast(df) if df.limit(most_rows + 1).count() <= most_rows else df


def lower_ascii(text):
    """``text`` with A-Z, and nothing else, in lower case."""
    return F.translate(text, ASCII_UPPER, ASCII_LOWER)


def without(df: DataFrame, names: list[str]) -> DataFrame:
    """``df`` without columns that an operator is about to add; names are compared as Spark compares them, without case."""
    gone = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in gone])


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with as many underscores after it as keep it apart from the columns of ``df``."""
    while name.lower() in map(str.lower, df.columns):
        name += "_"
    return name


def id_remainder(doc_id, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, held_out: int, rows: int) -> DataFrame:
    """(text, label) of ``rows`` labelled documents at most, spread by a hash of the id, none of the held-out fold.

    An id with several labels counts with each; of rows with the same id and text one does, and the bound holds for rows
    after the join, so ids that repeat don't exceed it: then the least hashes stay.
    """
    usable = labels.select("doc_id", F.col(label).cast("int").alias("label")).where(F.col("label").isNotNull() & F.col("doc_id").isNotNull())
    usable = usable.where(id_remainder(F.col("doc_id"), folds) != held_out)
    share = min(1.0, rows / max(1, usable.count()))
    picked = usable.where(F.pmod(F.xxhash64(F.lit(7), "doc_id"), F.lit(1 << 20)) < int(share * (1 << 20)))
    place = F.xxhash64(F.lit(8), "doc_id", "text", "label").alias("place")
    found = docs.select("doc_id", "text").join(small(picked.distinct(), 2 * rows), "doc_id").select("text", "label", place).dropDuplicates(["place"])
    return found.orderBy("place").limit(rows).select("text", "label").repartition(SAMPLE_PARTS)
