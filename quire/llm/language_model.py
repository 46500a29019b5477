"""Language-model scoring with a probabilistic suffix tree over words.

Tokens are words (A-Z in lower case) and one end after each text. All training tokens are counted. The tree's states are
contexts of one to ``depth`` tokens, grown level by level: a context that occurs twice is tested if its suffix is retained,
its next-symbol counts of two or more are kept, and it is retained if they diverge from its suffix's distribution by more
than their number costs (half a log of the context's count each, in nats). Nothing depends on the size of the corpus.

A token is scored in its longest retained suffix state:
P(x|s) = (n(s,x) + (n(s) - kept(s) + 1) P(x|suffix)) / (n(s) + 1), down to P(x) = (c + 0.1) / (N + 0.1 (V + 1)), where
all unseen words share the one place more than V.

No task holds the tree. Tokens, each with those before it, are dealt into blocks by the context in which their part of the
tree begins, so a block grows its part and scores its tokens with it. Contexts of more than 2**CONTEXTS training tokens (there are
few) are tested before, by joins; such a context has blocks of its own, by the token before it, which get its counts. What
ends there is dealt by rows. The 2**SYMBOLS most frequent words that occur twice have numbers that are broadcast; others go by
their hashes and bring their counts along.

Defined cases: a null text is empty: one end token; a null id counts as empty text for its fold; without training
tokens P is 1 for the place of the unseen; repeated rows train and are scored each; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, id_remainder, written
from .hashing import U64, mix, word_hashes

#: logs of two: training tokens from which on a context is split, words with numbers
CONTEXTS, SYMBOLS = 20, 21
#: training tokens of a block: so many, unless the corpus is too small for ``BLOCKS``
LEAST_BLOCK, MOST_BLOCK, BLOCKS = 1 << 14, 1 << 19, 256
#: times that a context and a step must be seen
LEAST = 2
SHIFT, LOW = 32, (1 << 32) - 1
END = U64(0x51A7E0FE11D0C5)
ROWS, SLICE = 1 << 16, 1 << 20
#: tokens that are worked on at a time, texts of an Arrow batch: they bound the memory of a task
CHUNK, TEXTS = 1 << 17, 2000
ZSTD = "zstd"


def tokens(text: str | None) -> np.ndarray:
    return np.append(word_hashes(text), END)


def in_rows(columns: list[np.ndarray], names: list[str]) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(columns[0]), ROWS):
        yield pa.RecordBatch.from_arrays([pa.array(c[at : at + ROWS]) for c in columns], names)


def vocabulary(docs: DataFrame) -> DataFrame:
    """(word, c): hashes of all tokens of ``docs`` and their counts."""

    def summed(found: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        words, n = np.unique(np.concatenate(found), return_counts=True)
        yield from in_rows([words.view(np.int64), n.astype(np.int64)], ["word", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, size = [], 0
        for batch in batches:
            for text in batch.column("text"):
                found.append(tokens(text.as_py()))
                size += len(found[-1])
                if size >= 2 * SLICE:
                    yield from summed(found)
                    found, size = [], 0
        if found:
            yield from summed(found)

    return docs.select("text").mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("c"))


class Words:
    """The words that have numbers: most frequent first; ``at`` finds places, -1 for other words."""

    def __init__(self, words: np.ndarray, counts: np.ndarray):
        order = np.lexsort((words, -counts))
        self.counts, self.words = counts[order], words[order]
        by_hash = np.argsort(words[order])
        self.hashes, self.places = words[order][by_hash], by_hash.astype(np.int32)

    def at(self, words: np.ndarray) -> np.ndarray:
        if not len(self.hashes):
            return np.full(len(words), -1, np.int32)
        k = np.minimum(np.searchsorted(self.hashes, words), len(self.hashes) - 1)
        return np.where(self.hashes[k] == words, self.places[k], np.int32(-1))


def encoded(docs: DataFrame, shared, norm: float) -> DataFrame:
    """doc_id, held_out, the places of a text's tokens (4 bytes each, -1: none), the hashes of those without, and what the others add."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = shared.value
        logs = np.zeros(len(words.counts) + 1)
        known = logs[:-1]
        np.add(words.counts, 0.1, out=known)
        known /= norm
        np.log10(known, out=known)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                found = [tokens(t.as_py()) for t in part.column("text")]
                places = [words.at(x) for x in found]
                rare = [x[p < 0].view(np.int64) for x, p in zip(found, places, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").cast(pa.int64()), part.column("held_out"), pa.array([p.tobytes() for p in places], pa.binary()), pa.array(rare, pa.list_(pa.int64())),
                     pa.array([len(p) for p in places], pa.int64()), pa.array([int((p >= 0).sum()) for p in places], pa.int64()), pa.array([float(logs[p].sum()) for p in places], pa.float64())],
                    ["doc_id", "held_out", "places", "rare", "n_tokens", "n_known", "base"],
                )

    return docs.mapInArrow(run, "doc_id long, held_out boolean, places binary, rare array<long>, n_tokens long, n_known long, base double")


def with_rare(texts: DataFrame, vocab: DataFrame, norm: float, once: bool) -> DataFrame:
    """``texts`` (with a row number) and rare_c, the training counts of the tokens in ``rare``, with these in n_known and base; ``once``: all have one."""
    if once:
        counted = texts.withColumn("rare_c", F.transform("rare", lambda _: F.lit(1).cast("long")))
    else:
        texts = written(texts, "numbered")
        each = texts.select("row", F.posexplode("rare").alias("at", "word")).join(vocab, "word", "left").select("row", F.struct("at", F.coalesce("c", F.lit(0)).alias("c")).alias("s"))
        lists = each.groupBy("row").agg(F.transform(F.array_sort(F.collect_list("s")), lambda s: s["c"]).alias("rare_c"))
        counted = texts.join(lists, "row", "left").withColumn("rare_c", F.coalesce("rare_c", F.array().cast("array<long>")))
    more = F.aggregate("rare_c", F.lit(0.0), lambda sum_, c: sum_ + F.log10((c + 0.1) / F.lit(norm)))
    return counted.withColumns({"n_known": F.col("n_known") + F.size(F.filter("rare_c", lambda c: c > 0)), "base": F.col("base") + more})


class Level:
    """The retained contexts of one length and their next-symbol counts."""

    def __init__(self, keys: np.ndarray, n: np.ndarray, kept: np.ndarray, steps: np.ndarray, counts: np.ndarray):
        self.keys, self.n, self.kept = keys, n, kept  # by context
        self.steps, self.counts = steps, counts  # by context's place << SHIFT | symbol

    @staticmethod
    def find(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        """Places of ``wanted`` in the sorted ``keys``, -1 if absent."""
        if not len(keys):
            return np.full(len(wanted), -1, np.int64)
        k = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return np.where(keys[k] == wanted, k, -1)

    def after(self, context: np.ndarray, symbol: np.ndarray, lower: np.ndarray) -> np.ndarray:
        """P(symbol | context) for contexts by place (-1: not retained, as ``lower``)."""
        known = np.flatnonzero(context >= 0)
        if not len(known):
            return lower
        s = context[known]
        step = self.find(self.steps, s << SHIFT | symbol[known])
        count = np.where(step >= 0, self.counts[np.maximum(step, 0)] if len(self.counts) else 0, 0)
        out = lower.copy()
        out[known] = (count + (self.n[s] - self.kept[s] + 1) * lower[known]) / (self.n[s] + 1)
        return out


def joined(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The tokens of several texts in one array, each one's place in its text, and where texts start."""
    symbol = np.frombuffer(bytearray().join(blobs), np.int32)
    lengths = np.array([len(b) // 4 for b in blobs], np.int64)
    starts = np.cumsum(lengths) - lengths
    index = np.arange(len(symbol), dtype=np.int32)
    index -= np.repeat(starts.astype(np.int32), lengths)
    return symbol, index, starts


def back(symbol: np.ndarray, index: np.ndarray, k: int, end: int) -> np.ndarray:
    """For each token, by its place in its text, the one ``k`` before it: an end stands before the first, and nothing (-1) before that."""
    out = np.full(len(symbol), -1, symbol.dtype)
    out[k:] = symbol[:-k]
    out[index < k] = -1
    out[index == k - 1] = end
    return out


def retained(keys: np.ndarray, n: np.ndarray, steps: np.ndarray, counts: np.ndarray, lower: np.ndarray) -> Level:
    """The contexts whose next-symbol counts diverge from ``lower`` (of each step) by more than they cost."""
    context = steps >> SHIFT
    total = np.bincount(context, counts, len(keys))
    spare = np.bincount(context, lower, len(keys))
    gain = np.bincount(context, counts * np.log(np.maximum(counts, 1) / (n[context] * lower)), len(keys)).astype(np.float64)
    rest = np.maximum(n - total, 0)
    gain += np.where(rest > 0, rest * np.log(np.maximum(rest, 1e-9) / (n * np.maximum(1 - spare, 1e-9))), 0)
    cost = 0.5 * np.log(np.maximum(n, 2)) * np.bincount(context, minlength=len(keys))
    keep = (gain > cost) & (total > 0)
    place = np.cumsum(keep) - 1
    of = keep[context]
    return Level(keys[keep], n[keep].astype(np.float64), total[keep], place[context[of]] << SHIFT | steps[of] & LOW, counts[of].astype(np.float64))


class Tokens:
    """The tokens of several texts: ``codes[k]``, numbers of the ones ``k`` before them (0: their own), their texts, training counts of words without a place.

    A word seen less than ``LEAST`` times is in no state: its code is -2 and less by its count, and -1, none, stands for it and all before it.
    """

    def __init__(self, part: pa.RecordBatch, words: Words, depth: int):
        symbol, index, starts = joined(part.column("places").to_pylist())
        hashes, c = flat(part.column("rare")), flat(part.column("rare_c"))
        rare, place = np.unique(hashes[c >= LEAST], return_inverse=True)
        counts = np.zeros(len(rare), np.int64)
        counts[place] = c[c >= LEAST]
        self.first_rare, self.rare, self.rare_counts = len(words.counts), rare, counts
        self.counts = np.concatenate([words.counts, counts]) if len(rare) else words.counts
        codes = -2 - c
        codes[c >= LEAST] = self.first_rare + place
        symbol[symbol < 0] = codes
        self.hashes = np.concatenate([words.words, rare.view(U64)]) if len(rare) else words.words
        end = int(words.at(np.array([END]))[0])
        self.codes = np.empty((depth + 1, len(symbol)), np.int32)
        self.codes[0] = symbol
        for k in range(1, depth + 1):
            self.codes[k] = back(symbol, index, k, end)
            self.codes[k][(self.codes[k] < 0) | ((self.codes[k - 1] < 0) if k > 1 else False)] = -1
        self.row = part.column("row").to_numpy()
        self.text = np.repeat(np.arange(len(starts), dtype=np.int32), np.diff(starts, append=len(symbol)))


def packed(codec: pa.Codec, numbers: np.ndarray) -> bytes:
    """Numbers compressed as planes: all first bytes, all second ones and so on."""
    return codec.compress(np.ascontiguousarray(numbers.reshape(-1).view(np.uint8).reshape(-1, numbers.itemsize).T), asbytes=True)


def unpacked(codec: pa.Codec, data: bytes, n: int, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(codec.decompress(data, n * size), np.uint8).reshape(size, n).T).reshape(-1).view(kind)


def flat(lists) -> np.ndarray:
    return lists.flatten().to_numpy() if len(lists) else np.zeros(0, np.int64)


def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of about ``SLICE`` tokens each, of equal size."""
    ends = np.cumsum(batch.column("n_tokens").to_numpy())
    of = (ends - 1) // -(-ends[-1:] // np.maximum(1, np.rint(ends[-1:] / SLICE).astype(np.int64)))
    edges = [0, *(np.flatnonzero(np.diff(of)) + 1).tolist(), batch.num_rows]
    for a, b in zip(edges, edges[1:], strict=False):
        if b > a:
            yield batch.slice(a, b - a)


class Split:
    """The contexts that are split: node 0 is the empty one; of the others those that are retained are nodes."""

    def __init__(self, total: int):
        self.level, self.parent, self.n, self.kept = [0], [-1], [float(total)], [0.0]
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []  # sorted keys (node of the suffix << SHIFT | older token), nodes (-1: not retained)

    def chain(self, node: int) -> list[int]:
        """The nodes from level one to ``node``."""
        out = []
        while node > 0:
            out.append(node)
            node = self.parent[node]
        return out[::-1]

    def walk(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each token's longest retained split context, and whether its part of the tree ends there as the next one is not retained."""
        nodes, ends = np.zeros(codes.shape[1], np.int32), np.zeros(codes.shape[1], bool)
        for a in range(0, len(nodes), CHUNK):
            nodes[a : a + CHUNK], ends[a : a + CHUNK] = self.walked(codes[:, a : a + CHUNK])
        return nodes, ends

    def walked(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        node, on = np.zeros(codes.shape[1], np.int64), np.ones(codes.shape[1], bool)
        ends = np.zeros(codes.shape[1], bool)
        for k, (keys, nodes) in enumerate(self.levels, 1):
            at = Level.find(keys, np.where(on & (codes[k] >= 0), node << SHIFT | codes[k], -1))
            there = np.where(at >= 0, nodes[np.maximum(at, 0)], -1)
            ends |= (at >= 0) & (there < 0)
            on = there >= 0
            node = np.where(on, there, node)
        return node, ends


def split_counts(train: DataFrame, words, split: Split, depth: int, most: int) -> DataFrame:
    """(kind, node, word, n): how often each word follows (kind 0) and precedes (kind 1) the contexts of the last level of ``split``."""
    shared = train.sparkSession.sparkContext.broadcast(split)

    def counted(part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        split, k = shared.value, len(shared.value.levels)
        first = min(split.levels[-1][1])
        t = Tokens(part, words.value, depth)
        node, _ = split.walk(t.codes)
        for kind, code in enumerate((t.codes[0], t.codes[k + 1]) if k < depth else (t.codes[0],)):
            ok = (node >= first) & (code >= 0)
            if kind:
                ok[ok] = t.counts[code[ok]] > most  # else none of them is split
            keys, n = np.unique(node[ok].astype(np.int64) << SHIFT | code[ok], return_counts=True)
            yield from in_rows([np.full(len(keys), kind, np.int64), keys >> SHIFT, t.hashes[keys & LOW].view(np.int64), n.astype(np.int64)], ["kind", "node", "word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                yield from counted(part)

    return train.mapInArrow(run, "kind long, node long, word long, n long").groupBy("kind", "node", "word").agg(F.sum("n").alias("n"))


def split_contexts(train: DataFrame, vocab: DataFrame, shared_words, total: int, norm: float, depth: int, most: int) -> tuple[Split, DataFrame | None]:
    """The contexts of more than ``most`` training tokens, and the step counts (node, word, n) of those retained; both sides of the test are joined."""
    words, spark = shared_words.value, train.sparkSession
    split, all_steps = Split(total), None
    held = np.flatnonzero(words.counts > most).astype(np.int64)
    keys, n = held, words.counts[held]
    lower = vocab.select(F.lit(0).cast("long").alias("suffix"), "word", ((F.col("c") + 0.1) / F.lit(norm)).alias("lower"))
    while len(keys) and len(split.levels) < depth:
        order, first = np.argsort(keys), len(split.n)
        keys, n = keys[order], n[order]
        asked = first + np.arange(len(keys))
        split.levels.append((keys, asked))
        counted = written(split_counts(train, shared_words, split, depth, most).where((F.col("kind") == 0) & (F.col("n") >= LEAST) | (F.col("kind") == 1) & (F.col("n") > most)), "split")
        known = F.broadcast(spark.createDataFrame([(int(i), int(k) >> SHIFT, int(c)) for i, k, c in zip(asked, keys, n, strict=True)], "node long, suffix long, n_s long"))
        steps = counted.where("kind = 0").select("node", "word", "n").join(known, "node").join(lower, ["suffix", "word"])
        gain = F.sum(F.col("n") * F.log(F.col("n") / (F.col("n_s") * F.col("lower")))).alias("gain")
        tested = {r.node: r for r in steps.groupBy("node").agg(F.sum("n").alias("kept"), F.sum("lower").alias("spare"), gain, F.count("*").alias("m")).collect()}  # a row each, as many as total / most
        nodes, kept = np.full(len(keys), -1, np.int64), {}
        for i, (node, c) in enumerate(zip(asked.tolist(), n.tolist(), strict=True)):
            r = tested.get(node)
            if r is None:
                continue
            rest = c - r.kept
            gained = r.gain + (rest * np.log(rest / (c * max(1 - r.spare, 1e-9))) if rest > 0 else 0)
            if gained > 0.5 * np.log(max(c, 2)) * r.m:
                nodes[i] = len(split.n)
                kept[node] = (len(split.n), float(r.kept))
                split.level.append(len(split.levels)), split.parent.append(int(keys[i]) >> SHIFT), split.n.append(float(c)), split.kept.append(float(r.kept))
        split.levels[-1] = (keys, nodes)
        if not kept:
            break
        renamed = F.broadcast(spark.createDataFrame([(a, b, c) for a, (b, c) in kept.items()], "node long, id long, kept double"))
        p = (F.col("n") + (F.col("n_s") - F.col("kept") + 1) * F.col("lower")) / (F.col("n_s") + 1)
        steps = written(steps.join(renamed, "node").select(F.col("id").alias("node"), "word", "n", p.alias("p")), "split_steps")
        all_steps = steps.select("node", "word", "n") if all_steps is None else all_steps.unionByName(steps.select("node", "word", "n"))
        lower = steps.select(F.col("node").alias("suffix"), "word", F.col("p").alias("lower"))
        older = counted.where("kind = 1").join(renamed, "node").select("id", "word", "n").toArrow()  # as many as total / most
        place = words.at(older.column("word").to_numpy().view(U64)).astype(np.int64)
        keys, n = older.column("id").to_numpy() << SHIFT | place, older.column("n").to_numpy()
    return split, all_steps


def dealt(texts: DataFrame, shared_words, split: Split, first: np.ndarray, blocks: np.ndarray, depth: int) -> DataFrame:
    """The tokens of each slice of texts by block: numbers and rows (packed), hashes and counts of words without a place."""
    shared = texts.sparkSession.sparkContext.broadcast((split, first, blocks))

    def by_block(part: pa.RecordBatch) -> pa.RecordBatch:
        split, first, blocks = shared.value
        codec = pa.Codec(ZSTD, 1)
        t = Tokens(part, shared_words.value, depth)
        node, ends = split.walk(t.codes)
        at = np.array(split.level, np.int8)[node]
        for k in range(1, depth + 1):
            t.codes[k][(at >= k) | ends] = -1  # known of the block, or without a part in its tree
        place = np.empty(len(node), np.int64)
        for a in range(0, len(node), CHUNK):
            own = slice(a, a + CHUNK)
            older = np.take_along_axis(t.codes[:, own], np.minimum(at[own] + 1, depth)[None], 0)[0].astype(np.int64)
            older[at[own] >= depth] = -1
            by = mix(np.where(older >= 0, t.hashes[older], t.row[t.text[own]].view(U64)))
            place[own] = first[node[own]] + (by % blocks[node[own]].astype(U64)).astype(np.int64) << SHIFT | older & LOW
        del node, ends, at
        order = np.argsort(place, kind="stable")
        place >>= SHIFT
        block = place[order]
        del place
        edges = [*np.flatnonzero(np.diff(block, prepend=-1)).tolist(), len(block)]
        out: list[list] = [[], [], [], [], [], []]
        for a, b in zip(edges, edges[1:], strict=False):
            own, rows = t.codes[:, order[a:b]], t.row[t.text[order[a:b]]]
            is_rare = own >= t.first_rare
            named, place = np.unique(own[is_rare], return_inverse=True)
            own[is_rare] = -2 - LEAST - place
            own[1] = np.diff(own[1], prepend=np.int32(0))  # in order, so differences are small
            values = (block[a], b - a, packed(codec, own), packed(codec, rows), t.rare[named - t.first_rare], t.rare_counts[named - t.first_rare])
            for column, value in zip(out, values, strict=True):
                column.append(value)
        types = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64())]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], ["block", "n", "codes", "rows", "rare", "rare_c"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from map(by_block, slices(batch))  # nothing of a slice is kept for the next

    return texts.mapInArrow(run, "block long, n long, codes binary, rows binary, rare array<long>, rare_c array<long>")


def undealt(table: pa.Table, depth: int, numbered: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Numbers and rows of a block's tokens, hashes (sorted) of the words numbered from ``numbered`` on, and counts of these and of the numbers after them, for words in no state."""
    codec, sizes = pa.Codec(ZSTD), table.column("n").to_pylist()
    lists = table.column("rare").combine_chunks()
    rare, place = np.unique(flat(lists), return_inverse=True)
    counts = np.zeros(len(rare), np.int64)
    counts[place] = flat(table.column("rare_c").combine_chunks())
    codes, rows = np.empty((depth + 1, sum(sizes)), np.int32), np.empty(sum(sizes), np.int64)
    at = start = 0
    for code, row, n, own_rare in zip(table.column("codes"), table.column("rows"), sizes, lists, strict=True):
        own = codes[:, at : at + n]
        own[:] = unpacked(codec, code.as_py(), n * (depth + 1), np.int32).reshape(depth + 1, n)
        own[1] = np.cumsum(own[1], dtype=np.int32)
        is_rare = own < -1 - LEAST
        own[is_rare] = numbered + place[start - 2 - LEAST - own[is_rare]]
        seldom = own[0] < -1
        own[0][seldom] = numbered + len(rare) - 2 - own[0][seldom]
        rows[at : at + n] = unpacked(codec, row.as_py(), n, np.int64)
        at, start = at + n, start + len(own_rare)
    return codes, rows, rare, np.append(counts, np.arange(LEAST))


def grown(codes: np.ndarray, train: np.ndarray, p: np.ndarray, above: int, seldom: int) -> np.ndarray:
    """P of each token in its longest retained context, where ``p`` is that of the context of ``above`` tokens which all share; numbers from ``seldom`` on are in no state."""
    p = p.copy()
    if above + 1 >= len(codes):
        return p
    order = np.argsort(codes[above + 1], kind="stable").astype(np.int32)
    older, a = codes[above + 1][order], int((codes[above + 1] < 0).sum())
    while a < len(order):  # contexts as a whole, so each part has a tree of its own
        b = min(a + CHUNK, len(order))
        b = int(np.searchsorted(older, older[b - 1], side="right"))
        grow(codes, order[a:b], train, p, above, seldom)
        a = b
    return p


def grow(codes: np.ndarray, some: np.ndarray, train: np.ndarray, p: np.ndarray, above: int, seldom: int) -> None:
    """Puts into ``p`` what ``grown`` gives for the tokens ``some``: all those of some contexts of ``above`` + 1 tokens."""
    context = np.zeros(len(some), np.int64)
    for k in range(above + 1, len(codes)):
        older = codes[k][some]
        some, context, older = some[older >= 0], context[older >= 0], older[older >= 0]
        key, symbol, counts_here = context << SHIFT | older, codes[0][some], train[some]
        del context, older
        keys, n = np.unique(key[counts_here], return_counts=True)
        keys, n = keys[n >= LEAST], n[n >= LEAST]
        place = Level.find(keys, key)
        seen = np.flatnonzero((place >= 0) & counts_here & (symbol < seldom)).astype(np.int32)
        steps = place[seen]
        del place
        steps <<= SHIFT
        steps |= symbol[seen]
        steps, at, counts = np.unique(steps, return_index=True, return_counts=True)
        often = counts >= LEAST
        level = retained(keys, n.astype(np.float64), steps[often], counts[often], p[some[seen[at[often]]]])
        del seen, steps, at, counts, often
        context = Level.find(level.keys, key)
        some, context, symbol = some[context >= 0], context[context >= 0], symbol[context >= 0]
        if not len(some):
            break
        for a in range(0, len(some), CHUNK):
            own = some[a : a + CHUNK]
            p[own] = level.after(context[a : a + CHUNK], symbol[a : a + CHUNK], p[own])


def block_scores(tokens_: DataFrame, chains: DataFrame, shared_words, split: Split, first: np.ndarray, norm: float, depth: int) -> DataFrame:
    """(row, model): what the tokens of each block add to the log10 probability of their texts."""
    shared = tokens_.sparkSession.sparkContext.broadcast((split, first))

    def run(key, table: pa.Table, steps: pa.Table) -> pa.Table:
        names = pa.schema([("row", pa.int64()), ("model", pa.float64())])
        if not table.num_rows:
            return names.empty_table()
        words, (split, first) = shared_words.value, shared.value
        numbered = len(words.counts)
        codes, rows, rare, counts = undealt(table, depth, numbered)
        node = int(np.searchsorted(first, key[0].as_py(), side="right")) - 1
        word, level, n = (steps.column(c).to_numpy() for c in ("word", "level", "n"))
        code = words.at(word.view(U64)).astype(np.int64)
        other = Level.find(rare, word)
        code = np.where(code < 0, np.where(other >= 0, numbered + other, -1), code)
        chain = []
        for k, above in enumerate(split.chain(node), 1):
            own = np.flatnonzero((level == k) & (code >= 0))
            own = own[np.argsort(code[own])]
            chain.append(Level(np.zeros(1, np.int64), np.array([split.n[above]]), np.array([split.kept[above]]), code[own], n[own].astype(np.float64)))
        p = np.empty(len(rows))
        for a in range(0, len(rows), CHUNK):
            symbol = codes[0, a : a + CHUNK]
            has = symbol < numbered
            own = np.empty(len(symbol))
            own[has], own[~has] = words.counts[symbol[has]], counts[symbol[~has] - numbered]
            own = (own + 0.1) / norm
            for above in chain:
                own = above.after(np.zeros(len(symbol), np.int64), symbol, own)
            p[a : a + CHUNK] = own
        p = grown(codes, (rows & 1) == 0, p, split.level[node], numbered + len(rare))
        del codes
        found, at = np.unique(rows, return_inverse=True)
        return pa.table([pa.array(found), pa.array(np.bincount(at, np.log10(p), len(found)))], schema=names)

    return tokens_.groupBy("block").cogroup(chains.groupBy("block")).applyInArrow(run, "row long, model double")


def least_numbered(vocab: DataFrame, most_words: int, most: int) -> int:
    """The count from which on words get numbers: two, or more if ``most_words`` asks for it, but contexts that are split have theirs."""
    sizes = sorted(vocab.where(F.col("c") >= LEAST).groupBy("c").agg(F.count("*").alias("n")).collect(), key=lambda r: -r.c)  # as many as there are different counts
    room = np.cumsum([r.n for r in sizes]) <= most_words
    return LEAST if all(room) else min([most + 1, *(r.c for r, fits in zip(sizes, room, strict=True) if fits)])


def scored(docs: DataFrame, folds: int = 10, held_out: int = 0, depth: int = 4, most_words: int = 1 << SYMBOLS, most: int = 1 << CONTEXTS, block: int | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score (log10) of every document.

    most_words: words with numbers; most: training tokens from which on a context is split; block: training tokens of a block. None changes the result.
    """
    spark = docs.sparkSession
    marked = docs.select("doc_id", "text", (id_remainder(F.col("doc_id"), folds) == held_out).alias("held_out"))
    with arrow_rows(spark, TEXTS):
        vocab = written(vocabulary(marked.where("not held_out")), "vocabulary")
    total, distinct = vocab.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    norm = total + 0.1 * (distinct + 1)
    least = least_numbered(vocab, most_words, most)
    numbered = (F.col("c") >= least) | (F.col("word") == int(END.view(np.int64)))
    frequent = vocab.where(numbered).toArrow()
    words = Words(frequent.column("word").to_numpy().view(U64), frequent.column("c").to_numpy())
    shared_words = spark.sparkContext.broadcast(words)
    parts = []
    with arrow_rows(spark, TEXTS):
        for bit, part in enumerate((marked.where("not held_out"), marked.where("held_out"))):  # the last bit of a row's number tells
            rows = encoded(part, shared_words, norm).withColumn("row", F.monotonically_increasing_id() * 2 + bit)
            parts.append(with_rare(rows, vocab.where(~numbered), norm, once=not bit and least == LEAST).select("row", "doc_id", "held_out", "places", "rare", "rare_c", "n_tokens", "n_known", "base"))
        texts = written(parts[0].unionByName(parts[1]), "encoded")
        split, steps = split_contexts(texts.where("not held_out"), vocab, shared_words, total, norm, depth, most)
    block = block or min(MOST_BLOCK, max(LEAST_BLOCK, total // BLOCKS))
    blocks = np.maximum(1, -(-np.array(split.n, np.int64) // block))
    blocks[0] = max(1, -(-(total - int(sum(split.n[i] for i in range(len(split.n)) if split.level[i] == 1))) // block))
    first = np.cumsum(blocks) - blocks
    if steps is None:
        chains = spark.createDataFrame([], "block long, level int, word long, n long")
    else:
        lines = [(int(first[i]) + b, k, above) for i in range(1, len(blocks)) for b in range(int(blocks[i])) for k, above in enumerate(split.chain(i), 1)]
        chains = steps.join(F.broadcast(spark.createDataFrame(lines, "block long, level int, node long")), "node").select("block", "level", "word", "n")
    parts = block_scores(dealt(texts, shared_words, split, first, blocks, depth), chains, shared_words, split, first, norm, depth)
    with arrow_rows(spark, TEXTS):
        sums = written(parts.groupBy("row").agg(F.sum("model").alias("model")), "sums")
    return texts.select("row", "doc_id", "held_out", "n_tokens", "n_known", "base").join(sums, "row").select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(int(total)).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), F.col("model").alias("score"),
    )
