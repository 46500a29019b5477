"""Words with typing errors: an index of what is left when signs are taken out, and edit distances of what meets there only.

Two words that few edits part have a common rest after as many deletions on both sides; a swap of neighbours is one deletion on
each. So words and anchors are joined by such rests as keys, in any number, and only pairs that meet are measured. Long
words have too many rests: they meet by pieces of the anchor, of which one is whole at nearly its place, as an edit spoils two at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.sources.tables import kept_aside

#: words of at least four signs, lengths three apart at most, at least so alike; sure from ``SURE`` on with a lead of ``LEAD``
SHORTEST, APART, LEAST, SURE, LEAD = 4, 3, 0.78, 0.88, 0.08
#: words up to this length meet by rests; anchors and words from ``PIECES_FROM`` on also by pieces
RESTS_TO, PIECES_FROM = 14, 12
MOST_BROADCAST = 200_000


def _edits(length: Column, least: float) -> Column:
    """How many edits a word of ``length`` can be from one that is ``least`` alike."""
    return F.floor(F.lit(1 - least) * F.least(length / least, length + APART) + 1e-9).cast("int")


def rests(word: Column, most: Column) -> Column:
    """The word without up to ``most`` of its signs."""
    without = lambda w: F.transform(F.sequence(F.lit(1), F.length(w)), lambda i: F.concat(F.substring(w, F.lit(1), i - 1), F.substring(w, i + 1, F.length(w))))
    rounds = F.when(most > 0, F.sequence(F.lit(1), most)).otherwise(F.array().cast("array<int>"))
    fewer = lambda words: F.array_distinct(F.flatten(F.transform(words, without)))
    levels = F.aggregate(rounds, F.array(F.array(word)), lambda out, _: F.concat(out, F.array(fewer(F.get(out, F.size(out) - 1)))))
    return F.array_distinct(F.flatten(levels))


def _pieces(least: float, length: Column) -> Column:
    """How many pieces an anchor of ``length`` is cut into: one more than its edits can spoil."""
    return 2 * F.floor(F.lit(1 - least) * (length + APART) + 1e-9).cast("int") + 1


def _piece(length: Column, n: Column, i: Column) -> tuple[Column, Column]:
    """Start (from 0) and length of piece ``i`` of ``n``."""
    start = F.floor(i * length / n).cast("int")
    return start, F.floor((i + 1) * length / n).cast("int") - start


def anchor_keys(anchor: Column, least: float = LEAST) -> Column:
    length = F.length(anchor)
    short = F.transform(rests(anchor, _edits(length, least)), lambda r: F.concat(F.lit("-"), r))

    def key(i: Column) -> Column:
        start, size = _piece(length, _pieces(least, length), i)
        return F.concat_ws(":", length, i, F.substring(anchor, start + 1, size))

    none = F.array().cast("array<string>")
    return F.concat(F.when(length <= RESTS_TO, short).otherwise(none), F.when(length >= PIECES_FROM, F.transform(F.sequence(F.lit(0), _pieces(least, length) - 1), key)).otherwise(none))


def word_edits(word: Column, lengths: list[int], least: float = LEAST) -> Column:
    """How many edits ``word`` can be from an anchor of one of ``lengths``; null: from none."""
    length = F.length(word)
    most = lambda m: F.floor(F.lit(1 - least) * F.greatest(length, F.lit(m)) + 1e-9).cast("int")
    each = [F.when(F.abs(length - m) <= F.least(most(m), F.lit(APART)), most(m)) for m in lengths]
    return F.array_max(F.array(*each)) if each else F.lit(None).cast("int")


def word_keys(word: Column, edits: Column, least: float = LEAST) -> Column:
    """The keys of all anchors that ``word`` can be like: its rests, and its parts where pieces of an anchor of each length could be."""
    length = F.length(word)
    short = F.transform(rests(word, edits), lambda r: F.concat(F.lit("-"), r))

    def at_length(other: Column) -> Column:
        def at_piece(i: Column) -> Column:
            start, size = _piece(other, _pieces(least, other), i)
            reach = F.floor(F.lit(1 - least) * (other + APART) + 1e-9).cast("int")
            return F.transform(F.sequence(F.greatest(F.lit(0), start - reach), F.greatest(F.lit(0), F.least(start + reach, length - size))), lambda s: F.concat_ws(":", other, i, F.substring(word, s + 1, size)))

        return F.flatten(F.transform(F.sequence(F.lit(0), _pieces(least, other) - 1), at_piece))

    long = F.flatten(F.transform(F.sequence(F.greatest(F.lit(PIECES_FROM), length - APART), length + APART), at_length))
    none = F.array().cast("array<string>")
    return F.array_distinct(F.concat(F.when(length <= RESTS_TO, short).otherwise(none), F.when(length >= PIECES_FROM, long).otherwise(none)))


def distance(a: Column, b: Column) -> Column:
    """Edits between two words: insert, delete, replace, or swap two neighbours once."""
    signs = F.split(b, "")
    step_type = "struct<row:array<int>,before:array<int>,last:string>"
    start = F.struct(F.sequence(F.lit(0), F.length(b)).alias("row"), F.array().cast("array<int>").alias("before"), F.lit("").alias("last")).cast(step_type)

    def next_row(state: Column, x: Column) -> Column:
        row, before = state["row"], state["before"]

        def cell(out: Column, j: Column) -> Column:
            y = F.get(signs, j - 1)
            best = F.least(F.get(row, j) + 1, F.get(out, j - 1) + 1, F.get(row, j - 1) + F.when(x == y, 0).otherwise(1))
            swapped = (F.size(before) > 0) & (j > 1) & (x == F.get(signs, j - 2)) & (state["last"] == y)
            return F.concat(out, F.array(F.when(swapped, F.least(best, F.get(before, j - 2) + 1)).otherwise(best)))

        made = F.aggregate(F.sequence(F.lit(1), F.length(b)), F.array(F.get(row, F.lit(0)) + 1), cell)
        return F.struct(made.alias("row"), row.alias("before"), x.alias("last")).cast(step_type)

    return F.aggregate(F.split(a, ""), start, next_row, lambda state: F.get(state["row"], F.length(b)))


def alike(words: DataFrame, anchors: DataFrame, least: float = LEAST) -> DataFrame:
    """(word, anchor, ratio) of all distinct words and anchors of four signs or more that are ``least`` alike at least."""
    held = anchors.where(F.length("anchor") >= SHORTEST).select("anchor").distinct()
    filed = held.select("anchor", F.explode(anchor_keys(F.col("anchor"), least)).alias("key"))
    filed = F.broadcast(filed) if filed.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST else filed
    lengths = [r[0] for r in held.select(F.length("anchor")).distinct().orderBy(F.length("anchor")).collect()]  # as many as words have lengths
    asked = words.where(F.length("word") >= SHORTEST).select("word", word_edits(F.col("word"), lengths, least).alias("_edits")).where(F.col("_edits").isNotNull()).distinct()
    dealt = max(asked.sparkSession.sparkContext.defaultParallelism, int(asked.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    asked = asked.repartition(dealt)  # few bytes make much work, so by number and not by size
    met = asked.select("word", F.explode(word_keys(F.col("word"), F.col("_edits"), least)).alias("key")).join(filed, "key").select("word", "anchor").distinct()
    met = met.where(F.abs(F.length("word") - F.length("anchor")) <= APART)
    ratio = 1 - distance(F.col("word"), F.col("anchor")) / F.greatest(F.length("word"), F.length("anchor"))
    return met.select("word", "anchor", ratio.alias("ratio")).where(F.col("ratio") >= least)


def suggestions(tokens: DataFrame, anchors: DataFrame, keys: list[str], k: int = 3) -> DataFrame:
    """(keys, rank, entry, score, word, anchor, decision) from tokens (keys, word) and anchors (entry, anchor).

    Each entry's best pair of a token and an anchor counts; the best ``k`` entries stay. decision: ``sure`` if the first is at least
    ``SURE`` and ``LEAD`` ahead of the second, else ``ask``.
    """
    pairs = kept_aside(alike(tokens, anchors), "alike")
    pairs = F.broadcast(pairs) if pairs.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST else pairs
    met = tokens.select(*keys, "word").join(pairs, "word").join(anchors.select("entry", "anchor").distinct(), "anchor")
    first = F.struct((-F.col("ratio")).alias("r"), "word", "anchor")
    best = met.groupBy(*keys, "entry").agg(F.max("ratio").alias("score"), F.min_by("word", first).alias("word"), F.min_by("anchor", first).alias("anchor"))
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "entry")
    ranked = best.withColumns({"rank": F.row_number().over(order), "_next": F.lead("score").over(order)}).where(F.col("rank") <= k)
    sure = F.first(F.when((F.col("score") >= SURE) & (F.col("_next").isNull() | (F.col("score") - F.col("_next") >= LEAD - 1e-12)), "sure").otherwise("ask")).over(order)
    return ranked.select(*keys, "rank", "entry", "score", "word", "anchor", sure.alias("decision"))
