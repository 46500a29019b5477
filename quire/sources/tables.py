"""Tables, and documents as lines and pages."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]
LINES_A_PAGE = 40


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def run_sql(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """``text`` over the tables that it names."""
    for name in TABLES:
        if re.search(rf"\b{name}\b", text):
            table(spark, sf_dir, name).createOrReplaceTempView(name)
    return spark.sql(text)


def lines_of(docs: DataFrame) -> DataFrame:
    """doc_id, line_no (from 0), page_no (from 1) and line: a text's lines, forty a page."""
    split = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return split.withColumn("page_no", (F.floor(F.col("line_no") / LINES_A_PAGE) + 1).cast("int"))


def pages_of(docs: DataFrame) -> DataFrame:
    """doc_id, page_no (from 1) and lines: a text's lines as arrays of forty, without a shuffle."""
    split = docs.select("doc_id", F.split("text", "\n").alias("_lines"))
    starts = F.sequence(F.lit(0), F.floor((F.size("_lines") - 1) / LINES_A_PAGE).cast("int"))
    pages = F.transform(starts, lambda p: F.struct((p + 1).alias("page_no"), F.slice("_lines", p * LINES_A_PAGE + 1, F.lit(LINES_A_PAGE)).alias("lines")))
    return split.where(F.col("_lines").isNotNull()).select("doc_id", F.inline(pages))


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors see; on a local master, where all share one disk, one of our own if none is named."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors see")
    return (named or tempfile.mkdtemp(prefix="quire-stream-")).rstrip("/")


def kept_aside(df: DataFrame, what: str) -> DataFrame:
    """``df`` as a table in the shared folder, read again: for a small table that several jobs read and many rows make."""
    path = f"{shared_dir(df.sparkSession)}/quire/{what}_{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores where its files give fewer splits than these (as a file of one row group does); else as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id and text of the documents, for work that outweighs moving a few texts."""
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text"))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines_of(documents(spark, sf_dir))


def page_texts(rows: DataFrame) -> DataFrame:
    """doc_id, page_no, text: a page's lines joined by spaces, white space collapsed."""
    held = rows.groupBy("doc_id", "page_no").agg(F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("held"))
    joined = F.concat_ws(" ", F.col("held.line"))
    return held.select("doc_id", "page_no", F.trim(F.regexp_replace(joined, r"\s+", " ")).alias("text"))


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file with a header, all strings: quotes double, cells are trimmed, missing cells and rows are empty or gone."""
    raw = spark.read.csv(path, header=True, inferSchema=False, quote='"', escape='"', multiLine=True, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    return raw.na.drop("all").na.fill("").toDF(*[c.lstrip("﻿").strip() for c in raw.columns])


#: DuckDB's lines and page texts, for the SQL of the checks
LINES_SQL = """lines AS (SELECT doc_id, CAST(i - 1 AS INT) AS line_no, CAST(floor((i - 1) / 40) + 1 AS INT) AS page_no, line FROM
 (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents))"""
PAGES_SQL = LINES_SQL + """, doc_pages AS (SELECT doc_id, page_no, trim(regexp_replace(string_agg(line, ' ' ORDER BY line_no), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')) AS text FROM lines GROUP BY doc_id, page_no)"""
