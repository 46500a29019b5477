"""Ranked lexical search over document-sharded postings with whole-number impacts.

Documents are dealt into shards of about ``shard_bytes`` of text as their files are read. Each shard is a matrix of postings in
compressed sparse rows: for every term the places of its documents and their impacts, which are worked out when the index is
written (tf and length need only the corpus's size and total length, counted before). The index is a table, one row for a
term of a shard, so document frequencies are sums over it and a search reads what its terms need.

A search joins the terms of its items with the table and scores shard by shard: a dense accumulator over the shard's
documents takes one term after another, and a partition about the k-th largest score selects the best; of those equal to it
the smallest ids stay. Each shard hands over k rows for an item at most, and the best of all are taken from them.

Scores are sums of weight times impact in 64-bit integers, so they don't depend on shards, order or machine.

Defined cases: a null or empty text has no term: it is in the index but not in its counts, and no search finds it; rows that
repeat are documents of their own, found side by side; equal scores stand by ascending id, null ids last; items with the
same id (null too) are one item with the terms of all its texts; an item without terms finds nothing; an empty table or no
items give an empty result; long texts are read whole; other columns are not read, so their names cannot clash.
"""

from __future__ import annotations

from array import array
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_rows, lower_ascii, written

#: what a term is: a run of digits, letters and signs beyond ASCII
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
SHARD_BYTES, ROW_BYTES, SLICE = 16 << 20, 64, 4096
#: items of a block, which are scored together, and how many pairs of a term and an item are broadcast
BLOCK, BROADCAST_PAIRS = 1024, 1_000_000
INDEX = "shard long, term string, n int, docs array<int>, impacts array<int>, ids array<long>"


def plain_bytes() -> bytes:
    """A table for ``bytes.translate``: A-Z in lower case, all that no term has as space."""
    keep = lambda b: b >= 0x80 or chr(b).isalnum()
    return bytes(ord(chr(b).lower()) if b < 0x80 and keep(b) else b if keep(b) else 0x20 for b in range(256))


@dataclass(frozen=True)
class Index:
    """Postings as a table (``INDEX``; the row without a term has the ids of its shard's documents), and how many documents have terms."""

    table: DataFrame
    n_documents: int


class Shard:
    """Postings in the making: for each document its terms' numbers and counts."""

    def __init__(self) -> None:
        self.numbers: defaultdict[bytes, int] = defaultdict()
        self.numbers.default_factory = self.numbers.__len__
        self.terms, self.counts, self.distinct, self.lengths, self.ids = array("i"), array("i"), array("i"), array("q"), []
        self.bytes = 0

    def add(self, doc_id: int | None, words: list[bytes], size: int) -> None:
        held = Counter(words)
        self.terms.extend(map(self.numbers.__getitem__, held))
        self.counts.extend(held.values())
        self.distinct.append(len(held))
        self.lengths.append(len(words))
        self.ids.append(doc_id)
        self.bytes += size + ROW_BYTES

    def rows(self, number: int, n_documents: int, n_terms: int) -> Iterator[pa.RecordBatch]:
        """The shard in compressed sparse rows: terms in order, documents by ascending id."""
        order = sorted(range(len(self.ids)), key=lambda i: (self.ids[i] is None, self.ids[i] or 0))
        place = np.empty(len(order), np.int32)
        place[order] = np.arange(len(order), dtype=np.int32)
        terms = sorted(self.numbers)
        rank = np.empty(len(terms), np.int64)
        rank[[self.numbers[t] for t in terms]] = np.arange(len(terms))
        tf, of = np.frombuffer(self.counts, np.int32).astype(np.int64), np.repeat(np.arange(len(order)), np.frombuffer(self.distinct, np.int32))
        m = 50 + (50 * np.frombuffer(self.lengths, np.int64) * n_documents) // max(1, n_terms)
        impacts = (1_000_000_000 * tf) // (1000 * tf + 20 * m[of])
        term, doc = rank[np.frombuffer(self.terms, np.int32)], place[of]
        by = np.lexsort((doc, term))
        starts = np.concatenate([[0], np.cumsum(np.bincount(term, minlength=len(terms)))]).astype(np.int32)
        doc, impacts = doc[by], impacts[by].astype(np.int32)
        names = ["shard", "term", "n", "docs", "impacts", "ids"]
        none = pa.array([None], pa.list_(pa.int32()))
        yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([None], pa.string()), pa.array([len(order)], pa.int32()), none, none, pa.array([[self.ids[i] for i in order]], pa.list_(pa.int64()))], names)
        for a in range(0, len(terms), SLICE):
            b = min(a + SLICE, len(terms))
            cut, first, last = pa.array(starts[a : b + 1] - starts[a]), starts[a], starts[b]
            rows = [pa.ListArray.from_arrays(cut, pa.array(v[first:last])) for v in (doc, impacts)]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(b - a, number)), pa.array(terms[a:b], pa.binary()).cast(pa.string()), pa.array(np.diff(starts[a : b + 1])), *rows, pa.nulls(b - a, pa.list_(pa.int64()))], names)


def indexed(docs: DataFrame, shard_bytes: int = SHARD_BYTES) -> Index:
    """The index of all rows of ``docs`` (doc_id, text), written to the shared folder."""
    counted = F.coalesce(F.regexp_count("text", F.lit(TERM)), F.lit(0))
    n_documents, n_terms = docs.agg(F.count_if(counted > 0), F.coalesce(F.sum(counted), F.lit(0))).first()

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        table, shard, number = plain_bytes(), Shard(), TaskContext.get().partitionId() << 24
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                text = text or b""
                shard.add(doc_id, text.translate(table).split(), len(text))
                if shard.bytes >= shard_bytes:
                    yield from shard.rows(number, n_documents, n_terms)
                    shard, number = Shard(), number + 1
        if shard.ids:
            yield from shard.rows(number, n_documents, n_terms)

    with arrow_rows(docs.sparkSession, 500):
        read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
        return Index(written(read.mapInArrow(build, INDEX), "search-index"), n_documents)


def terms_of(text: Column) -> Column:
    return F.regexp_extract_all(lower_ascii(F.coalesce(text, F.lit(""))), F.lit(TERM), F.lit(0))


def weighted(index: Index, items: DataFrame) -> DataFrame:
    """(term, block, weight, items): the items of a block that have the term, which the index has too."""
    asked = items.select(F.struct("item_id").alias("item"), F.explode(terms_of(F.col("text"))).alias("term")).distinct()
    asked = written(asked, "search-terms")
    blocks = max(1, -(-asked.select("item").distinct().count() // BLOCK))
    few = F.broadcast if asked.count() <= BROADCAST_PAIRS else lambda df: df
    found = index.table.select("term", "n").join(few(asked.select("term").distinct()), "term").groupBy("term").agg(F.sum("n").alias("df"))
    weight = F.floor(1000 * F.log((2.0 * index.n_documents + 2) / (2 * F.col("df") + 1))).cast("long")
    grouped = asked.groupBy("term", F.pmod(F.xxhash64("item"), F.lit(blocks)).alias("block")).agg(F.collect_list("item").alias("items"))
    return few(written(grouped.join(found.select("term", weight.alias("weight")), "term"), "search-weights"))


def search(index: Index, items: DataFrame, k: int = 50) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` best documents of every item of ``items`` (item_id, text), scores above 0 only."""
    kind = items.schema["item_id"].dataType.simpleString()
    wanted = weighted(index, items)
    postings = index.table.join(wanted, "term").select("shard", "block", "weight", "items", "docs", "impacts", F.lit(None).cast("array<long>").alias("ids"))
    named = index.table.where("term IS NULL").select("shard", "ids").join(postings.select("shard", "block").distinct(), "shard")
    both = postings.unionByName(named.select("shard", "block", *[F.lit(None).cast(t).alias(c) for c, t in postings.drop("shard", "block", "ids").dtypes], "ids"))

    def best(held: pa.Table) -> pa.Table:
        held = held.combine_chunks()
        named = [i for i, x in enumerate(held.column("ids").is_valid().to_pylist()) if x]
        ids = held.column("ids")[named[0]].as_py()
        of: dict[tuple, list[int]] = defaultdict(list)
        for row, whose in enumerate(held.column("items").to_pylist()):
            for item in whose or ():
                of[item["item_id"],].append(row)
        weights, score = held.column("weight").to_pylist(), np.zeros(len(ids), np.int64)
        flat = {name: held.column(name).chunk(0) for name in ("docs", "impacts")}
        starts, docs, impacts = flat["docs"].offsets.to_numpy(), flat["docs"].values.to_numpy(), flat["impacts"].values.to_numpy()
        out: list[tuple] = []
        for (item,), rows in of.items():
            score[:] = 0
            for r in rows:
                at = slice(starts[r], starts[r + 1])
                score[docs[at]] += weights[r] * impacts[at].astype(np.int64)
            out += [(item, ids[i], int(score[i]), int(i)) for i in selected(score, k)]
        shard = held.column("shard")[0].as_py()
        columns = list(zip(*out, strict=True)) or [[]] * 4
        types = [pa.from_numpy_dtype(np.int64)] * 4
        types[0] = held.schema.field("items").type.value_type.field("item_id").type
        return pa.table([*[pa.array(c, t) for c, t in zip(columns, types, strict=True)], pa.array([shard] * len(out), pa.int64())], ["item_id", "doc_id", "score", "place", "shard"])

    scored = both.groupBy("shard", "block").applyInArrow(best, f"item_id {kind}, doc_id long, score long, place long, shard long")
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"), "shard", "place")
    ranked = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("item_id", "rank", "doc_id", "score")


def selected(score: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` largest scores above 0; of those equal to the last, the first places."""
    some = np.flatnonzero(score > 0)
    if len(some) <= k:
        return some
    values = score[some]
    least = values[np.argpartition(values, len(values) - k)[len(values) - k]]
    above = some[values > least]
    return np.concatenate([above, some[values == least][: k - len(above)]])
