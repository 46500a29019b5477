"""Benchmark decontamination by a distributed positional inverted index, in DataFrame operations only.

The training texts are tokenised once: every occurrence of a test term is a posting (term, document, position) in a
written table, from which list lengths, phrases and proximity all come; like a next-word index, it keeps 15 bits of a
hash of either neighbour. Every window of a benchmark item names its rarest term, an anchor of the item. Lists are
offset-adjusted by the place of a term in its item: an anchor's list gives alignments (document, item, shift), but for
those where neither neighbour can be the item's, as any longer window holds one of them. What remains is intersected with
the lists of all terms that share a window with the anchor. Where as many
consecutive terms of an item meet at one shift as a window has, its windows occur. Proximity matches ask that an item's
rarest terms lie within a span, in any order; terms that the texts don't have are left out, so an item with one term left
matches where that term is.

Defined cases: null and empty texts have no words and match nothing; an item without words occurs nowhere; an item of
fewer words than a window is one window; rows with the same id and text are one document of the index and each get the
result; items with the same id are one item of several texts; an empty benchmark or table gives an empty index; extra
columns are kept and not read, ones named like a result are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import lower_ascii, small, without, written

#: what stands between words: all but digits, letters and signs beyond ASCII (A-Z are in lower case by then)
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: a word of a text as given, A-Z included
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
BROADCAST_ROWS = 200_000
ALIGNED = ["doc_key", "item_key", "shift"]


def words_of(text: Column) -> Column:
    return F.filter(F.split(lower_ascii(F.coalesce(text, F.lit(""))), BETWEEN), lambda w: w != "")


def doc_key() -> Column:
    return F.xxhash64("doc_id", "text")


def items_of(benchmark: DataFrame, width: int) -> DataFrame:
    """Distinct (item_id, item_key, w, least): an item's words and how many of them make a window."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), words_of(F.col("text")).alias("w")).where(F.size("w") > 0).distinct()
    return items.select("item_id", F.xxhash64("item_id", "w").alias("item_key"), "w", F.least(F.size("w"), F.lit(width)).alias("least"))


def postings(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The index: (term, doc_key, position, before, after) of every term of the items in all of ``docs``."""
    terms = items.select(F.explode("w").alias("term")).distinct()
    tokens = docs.select(doc_key().alias("doc_key"), words_of(F.col("text")).alias("w")).select("doc_key", "w", F.posexplode("w").alias("position", "term"))
    return tokens.join(small(terms, BROADCAST_ROWS), "term").select("term", "doc_key", "position", *neighbours(F.col("position")))


def neighbours(place: Column) -> list[Column]:
    """Hashes of the words of ``w`` before and after ``place``; -1: there is none."""
    code = lambda at: F.when((at >= 0) & (at < F.size("w")), F.hash(F.get("w", at)).bitwiseAND(F.lit(0x7FFF))).otherwise(-1)
    return [code(place - 1).alias("before"), code(place + 1).alias("after")]


def with_lengths(items: DataFrame, index: DataFrame) -> DataFrame:
    """The items with n: the length of each word's list, in the order of ``w``."""
    lengths = index.groupBy("term").agg(F.count("*").alias("n"))
    placed = items.select("item_key", F.posexplode("w").alias("place", "term")).join(lengths, "term", "left")
    n = F.transform(F.array_sort(F.collect_list(F.struct("place", F.coalesce("n", F.lit(0)).alias("n")))), lambda x: x["n"])
    return items.join(placed.groupBy("item_key").agg(n.alias("n")), "item_key")


def anchors(items: DataFrame) -> DataFrame:
    """(item_key, place, term, and its neighbours): the rarest term of each window, but for windows with a term that has no postings."""
    window = lambda s: F.transform(F.slice("n", s + 1, F.col("least")), lambda n, i: F.struct(n.alias("n"), (s + i).alias("place")))
    rarest = F.transform(F.sequence(F.lit(0), F.size("w") - F.col("least")), lambda s: F.array_min(window(s)))
    places = F.array_distinct(F.transform(F.filter(rarest, lambda r: r["n"] > 0), lambda r: r["place"]))
    found = items.select("item_key", "w", "least", F.explode(places).alias("place"))
    own = [c.alias(f"item_{name}") for c, name in zip(neighbours(F.col("place")), ("before", "after"), strict=True)]
    return found.select("item_key", "place", F.get("w", F.col("place")).alias("term"), "least", *own)


def phrases(index: DataFrame, items: DataFrame) -> DataFrame:
    """Distinct (doc_key, item_id, start, length): runs of an item's words that hold a window at least, start from 0."""
    known = small(items.select("item_key", "w", "least"), BROADCAST_ROWS)
    starts = index.join(small(written(anchors(items), "anchors"), BROADCAST_ROWS), "term")
    beside = (F.col("least") == 1) | ((F.col("before") == F.col("item_before")) & (F.col("before") >= 0)) | ((F.col("after") == F.col("item_after")) & (F.col("after") >= 0))
    aligned = starts.where(beside).select("doc_key", "item_key", (F.col("position") - F.col("place")).alias("shift"), "place").distinct().join(known, "item_key")
    reach = F.sequence(F.greatest(F.lit(0), F.col("place") - F.col("least") + 1), F.least(F.size("w"), F.col("place") + F.col("least")) - 1)
    term, position = F.get("w", F.col("q")), F.col("shift") + F.col("q")
    around = aligned.select(*ALIGNED, "w", F.explode(reach).alias("q")).select(*ALIGNED, "q", position.alias("position"), term.alias("term")).where("position >= 0").distinct()
    met = index.select("doc_key", "position", "term").join(written(around, "wanted"), ["doc_key", "position", "term"]).select(*ALIGNED, "q").distinct()
    run = F.col("q") - F.row_number().over(Window.partitionBy(*ALIGNED).orderBy("q"))
    runs = met.withColumn("run", run).groupBy(*ALIGNED, "run").agg(F.min("q").alias("q"), F.count("*").cast("int").alias("length"))
    names = small(items.select("item_key", "item_id", "least"), BROADCAST_ROWS)
    return runs.join(names, "item_key").where(F.col("length") >= F.col("least")).select("doc_key", "item_id", (F.col("shift") + F.col("q")).alias("start"), "length").distinct()


def near_terms(items: DataFrame, rarest: int) -> DataFrame:
    """(item_id, term): the ``rarest`` terms of each item among those with postings."""
    terms = items.select("item_id", F.explode(F.arrays_zip("w", "n")).alias("t")).select("item_id", F.col("t.w").alias("term"), F.col("t.n").alias("n")).distinct()
    order = Window.partitionBy("item_id").orderBy("n", "term")
    found = terms.where("n > 0").withColumn("rank", F.row_number().over(order))
    return found.where(F.col("rank") <= rarest).select("item_id", "term")


def near(index: DataFrame, needed: DataFrame, span: int) -> DataFrame:
    """Distinct (doc_key, item_id): documents in which all terms ``needed`` for the item lie within ``span`` tokens, in any order."""
    sizes = needed.groupBy("item_id").agg(F.count("*").alias("needed"))
    at = index.select("doc_key", "position", "term").join(small(needed, BROADCAST_ROWS), "term").distinct()
    close = Window.partitionBy("doc_key", "item_id").orderBy("position").rangeBetween(-(span - 1), 0)
    found = at.withColumn("met", F.size(F.collect_set("term").over(close)))
    return found.join(small(sizes, BROADCAST_ROWS), "item_id").where(F.col("met") == F.col("needed")).select("doc_key", "item_id").distinct()


def indexed(docs: DataFrame, benchmark: DataFrame, width: int) -> tuple[DataFrame, DataFrame]:
    """The index and the items with their lists' lengths, both written."""
    items = written(items_of(benchmark, width), "items")
    index = written(postings(docs, items), "postings")
    return index, written(with_lengths(items, index), "items-with-lengths")


def phrase_matches(docs: DataFrame, benchmark: DataFrame, width: int = 10) -> DataFrame:
    """Distinct (doc_key, item_id, start, length): runs of an item's words that hold a window at least, start from 0."""
    return phrases(*indexed(docs, benchmark, width))


def proximity_matches(docs: DataFrame, benchmark: DataFrame, span: int = 20, rarest: int = 3) -> DataFrame:
    """(doc_key, item_id): documents in which the item's ``rarest`` terms lie within ``span`` tokens, in any order."""
    index, items = indexed(docs, benchmark, 1)
    return near(index, written(near_terms(items, rarest), "near-terms"), span)


def hits(matches: DataFrame) -> DataFrame:
    """Per document: n_hit (positions inside any occurrence) and the sorted item ids."""
    before = Window.partitionBy("doc_key").orderBy("start", "length").rowsBetween(Window.unboundedPreceding, -1)
    end = F.col("start") + F.col("length")
    spans = matches.select("doc_key", "start", "length").distinct().withColumn("reached", F.coalesce(F.max(end).over(before), F.lit(0)))
    covered = spans.groupBy("doc_key").agg(F.sum(F.greatest(F.lit(0), end - F.greatest("start", "reached"))).alias("n_hit"))
    items = matches.groupBy("doc_key").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    return covered.join(items, "doc_key")


def decontaminate(docs: DataFrame, benchmark: DataFrame, width: int = 10, span: int = 20, rarest: int = 3) -> DataFrame:
    """``docs`` with n_words, n_hit, items (sorted ids of items with occurring windows) and near_items (with proximity matches)."""
    kept = without(docs, ["n_words", "n_hit", "items", "near_items", "_doc_key"])
    index, items = indexed(docs, benchmark, width)
    needed = written(near_terms(items, rarest), "near-terms")
    close = near(index, needed, span).groupBy("doc_key").agg(F.array_sort(F.collect_set("item_id")).alias("near_items"))
    found = hits(written(phrases(index, items), "phrases")).join(close, "doc_key", "full")
    found = small(written(found.select(F.col("doc_key").alias("_doc_key"), "n_hit", "items", "near_items"), "hits"), BROADCAST_ROWS)
    n_words = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    counted = kept.withColumns({"_doc_key": doc_key(), "n_words": n_words})
    ids = lambda name: F.coalesce(name, F.array().cast("array<string>"))
    return counted.join(found, "_doc_key", "left").drop("_doc_key").withColumns(
        {"n_hit": F.coalesce("n_hit", F.lit(0)).cast("long"), "items": ids("items"), "near_items": ids("near_items")}
    )


def clean(docs: DataFrame, benchmark: DataFrame, width: int = 10) -> DataFrame:
    """The documents of ``docs`` in which no window of an item occurs."""
    found = written(phrase_matches(docs, benchmark, width).select("doc_key").distinct(), "contaminated")
    return docs.join(small(found.toDF("_found"), BROADCAST_ROWS), F.xxhash64("doc_id", "text") == F.col("_found"), "left_anti")


def digest(done: DataFrame) -> DataFrame:
    return done.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
        F.size("near_items").cast("long").alias("n_near_items"), F.sha2(F.concat_ws(",", "near_items").cast("binary"), 256).alias("near_items_sha256"),
    )
