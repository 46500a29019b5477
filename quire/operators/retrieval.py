"""Retrieval: BM25, dot products, both in two stages."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.text import n_of, n_terms

K1, B = 1.5, 0.75


def bm25(docs: DataFrame, query_terms: list[str], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, score) of the texts that hold a query term.

    The texts are read once: what is kept of each is its length and a count a query term, numbers only, spilled to disk where
    memory is short. Documents, mean length and the terms' document counts are one row; ids that repeat add up.
    """
    query_terms = list(dict.fromkeys(query_terms))
    low = docs.select(doc_id, F.lower(text).alias("_low"))
    counted = low.select(doc_id, F.coalesce(n_terms(F.col("_low")), F.lit(0)).alias("n"), *[n_of(F.col("_low"), t).alias(f"tf{i}") for i, t in enumerate(query_terms)])
    counted = counted.persist(StorageLevel.MEMORY_AND_DISK)
    tfs = [F.col(f"tf{i}") for i in range(len(query_terms))]
    stats = counted.agg(F.count("*").alias("docs"), F.avg("n").alias("avg_len"), *[F.count_if(tf > 0).alias(f"df{i}") for i, tf in enumerate(tfs)])
    hits = counted.where(F.greatest(*tfs, F.lit(0), F.lit(0)) > 0).join(F.broadcast(stats))  # of one row

    def weight(i: int) -> Column:
        tf, df = F.col(f"tf{i}"), F.col(f"df{i}")
        idf = F.log(1 + (F.col("docs") - df + 0.5) / (df + 0.5))
        return F.when(tf > 0, idf * (tf * (K1 + 1)) / (tf + K1 * (1 - B + B * F.col("n") / F.col("avg_len")))).otherwise(0.0)

    score = sum((weight(i) for i in range(len(query_terms))), F.lit(0.0))
    return hits.groupBy(doc_id).agg(F.sum(score).alias("score"))


def top(scored: DataFrame, k: int, key: str = "doc_id") -> DataFrame:
    return scored.orderBy(F.desc("score"), key).limit(k)


def vector_of(vectors: DataFrame, vec_id: int) -> list[float]:
    row = vectors.where(F.col("vec_id") == vec_id).select("embedding").first()
    return [float(x) for x in row[0]] if row else []


def dot(vector: Column, other: list[float]) -> Column:
    fixed = F.array(*map(F.lit, other))
    return F.aggregate(F.zip_with(vector, fixed, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda a, x: a + x)


def scored_by_dot(vectors: DataFrame, query_vector: list[float]) -> DataFrame:
    return vectors.withColumn("score", dot(F.col("embedding"), query_vector))


def two_stage(docs: DataFrame, vectors: DataFrame, query_terms: list[str], query_vector: list[float], shortlist: int = 80, k: int = 20) -> DataFrame:
    """(doc_id, score): the BM25 shortlist (without any hit the first ids) ranked by dot product."""
    hits = top(bm25(docs, query_terms), shortlist).select("doc_id").withColumn("tier", F.lit(0))
    first = docs.select("doc_id").orderBy("doc_id").limit(shortlist).withColumn("tier", F.lit(1))
    both = hits.unionByName(first).withColumn("best", F.min("tier").over(Window.partitionBy(F.lit(0)))).where("tier = best")  # two shortlists at most
    chosen = vectors.join(F.broadcast(both.select(F.col("doc_id").alias("vec_id"))), "vec_id")
    return top(scored_by_dot(chosen, query_vector).select(F.col("vec_id").alias("doc_id"), "score"), k)
