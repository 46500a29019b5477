"""A corpus pipeline out of the training-data operators: each stage's decisions shape the next one's documents.

Defined cases, for all stages: a null text is an empty one, is judged as such and stays null; null ids stay rows; an empty
table gives an empty table of the same columns; texts of any length are read whole; all columns that the documents have, whatever
their names, are handed on by all stages but the last.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import bpe, decontamination, jaccard_join, secret_scan, toxicity
from quire.llm.common import table, written


def keep_civil(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Toxicity: documents that score 0.3 or more go; rows that repeat score alike, so all of them go or stay."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs.select(F.struct("*").alias("_row")), model, ("_row",), inside="_row")
    return scored.where("score < 0.3").select("_row").select("_row.*")


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """N-gram Jaccard join: of each group of near copies (five words, 0.8) the smallest id stays, null ids last; of ties, the least hash.

    Texts without words are in no group and stay; of rows equal in id and text, one does.
    """
    return jaccard_join.one_of_each(docs, width=5, percent=80)


def keep_uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark decontamination: documents with an occurring window of ten words go, and all rows that repeat them; no benchmark, none."""
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"), width=10)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secret scans: a mark takes the place of every span; a text without one stays as it is, n_chars too."""
    scanned = secret_scan.scan(docs, carry=tuple(docs.columns))
    text = secret_scan.redacted(F.col("text"), F.col("found"))
    changed = {"text": text, "n_chars": F.when(F.size("found") == 0, F.col("row.n_chars")).otherwise(F.length(text).cast("long"))}
    return scanned.select(*[changed[c].alias(c) if c in changed else F.col(f"row.`{c}`") for c in docs.columns])


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """BPE encoding and decoding: doc_id, n_tokens, ids and the decoded text of every row, repeated ones too; no tokens, empty strings."""
    return bpe.encode_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", keep_civil),
    ("n-gram Jaccard join", keep_one_of_each),
    ("benchmark decontamination", keep_uncontaminated),
    ("secret scans", redact_secrets),
    ("BPE encoding and decoding", encode),
]

#: SQL can express neither the classifier nor BPE; tests/llm holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), "stage-" + name.split(" ")[0].lower())
    return STAGES[-1][1](spark, docs, sf_dir)
