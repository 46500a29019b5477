"""N-gram Jaccard join: a size-aware heavy-light join with linked groups as its result.

A document's set holds its distinct word shingles (48-bit hashes). Two sets of s and t link when ``100 * common >=
percent * union``, that is, when they have ``need(s, t)`` in common at least. Equal sets are one class from the start.

* Light sets are small: every pair of light sizes (s, t) needs a fixed number of common shingles, so each light set
  enumerates its subsets of that size. Two sets with the same subset link, without further proof.
* Heavy sets are large: they, and the light sets near enough in size, scan inverted lists. Shingles have one order
  for all sets: those in few documents first, those in many last. Linked sets share a shingle among the first
  ``s - need + 1`` of each, so those alone are posted.
* The boundary is where the sum of both costs (subsets enumerated; postings times the mean list) is the lowest.

Lists are joined in two rounds. In the first, each list names one member as its head (the same in every list, as far as it
can be) and each set goes to the cluster of the head that it meets most often. A cluster is cut into blocks of bounded
bytes and sets, each with the head; a block's sets are compared with each other exactly, within one Arrow call, which
returns no more links than hold its linked sets together. Clusters of several blocks that these links leave in pieces are
compared block by block. A set of another cluster than most of a list then visits the one that it meets most often in this
way, and clusters with visitors are compared once more. The second round takes the pairs of a list that have met in no
cluster and lie in different components, if they meet in as many lists as linked sets must, and verifies these on the whole
sets. So a group of near copies makes rows in proportion to its members, whether all of them link or few do.

Defined cases: null texts and texts without words have empty sets, linked with nothing; rows with equal ids stay rows;
null ids are never smallest and a class of null ids alone has a null component; repeated rows are one class; an empty
table gives an empty result. The order of shingles decides speed only, never the result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_rows, small, written
from .components import components
from .hashing import U64, mix, shingles, word_hashes

#: bits and bytes of a shingle's hash
BITS, BYTES = 48, 6
#: buckets for the shingles' frequencies: shingles in the mean bucket, bits of a bucket's number, buckets sent as one row
BUCKET_MEAN, LEAST_BITS, MOST_BITS, CHUNK = 128, 12, 24, 1024
BROADCAST_ROWS = 1_000_000
#: what a candidate costs, with its two sets, in rows of a list or subsets
CANDIDATE = 4
#: bytes and sets in a block of a cluster
BLOCK_BYTES, BLOCK_SETS = 4 << 20, 4096
#: rows in an Arrow batch, as a row holds a whole set or two; hashes that a worker holds before it counts them
BATCH_ROWS, MOST_HELD = 500, 1_000_000


def need(s: int, t: int, percent: int) -> int:
    """Common shingles that sets of ``s`` and ``t`` need."""
    return -(-percent * (s + t) // (100 + percent))


def partners(s: int, percent: int) -> range:
    """Sizes that a set of ``s`` can link with."""
    return range(-(-percent * s // 100), 100 * s // percent + 1)


def posted(s: int, percent: int) -> int:
    """How many of its first shingles a set of ``s`` posts."""
    return s - -(-percent * s // 100) + 1


def subset_cost(s: int, percent: int) -> int:
    return sum(math.comb(s, k) for t in partners(s, percent) if (k := need(s, t, percent)) <= min(s, t))


def boundary(sizes: list[tuple[int, int]], mean_list: float, percent: int) -> int:
    """The largest light size, by the costs of (size, number of sets); 0: all are heavy."""
    best = cost = 0.0
    chosen = 0
    for s, n in sorted(sizes):
        enumerated = subset_cost(s, percent)
        if s > 64 or enumerated > 100_000:
            break
        cost += n * (enumerated - posted(s, percent) * (1 + CANDIDATE * mean_list))
        if cost <= best:
            best, chosen = cost, s
    return chosen


def packed(x: np.ndarray) -> bytes:
    """A set as bytes: first all lowest bytes, and so on."""
    return x.view(np.uint8).reshape(-1, 8)[:, :BYTES].T.tobytes()


def unpacked(blob: bytes) -> np.ndarray:
    out = np.zeros((len(blob) // BYTES, 8), np.uint8)
    out[:, :BYTES] = np.frombuffer(blob, np.uint8).reshape(BYTES, -1).T
    return out.view(U64).ravel()


def row_key() -> Column:
    return F.xxhash64("doc_id", "text").alias("row_key")


def sets_of(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, row_key (of id and text), n_shingles, class_key (of equal sets; null: empty) and the sorted set as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                sets = [shingles(word_hashes(t.as_py()), width) for t in part.column("text")]
                counts = [len(x) for x in sets]
                sets = [np.unique(x >> U64(64 - BITS)) for x in sets]
                keys = [int(mix(mix(x).sum(keepdims=True) + U64(len(x)))[0].view(np.int64)) if len(x) else None for x in sets]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").cast(pa.int64()), part.column("row_key"), pa.array(counts, pa.int64()), pa.array(keys, pa.int64()), pa.array(list(map(packed, sets)), pa.binary())],
                    ["doc_id", "row_key", "n_shingles", "class_key", "shingles"],
                )

    return docs.select("doc_id", "text", row_key()).mapInArrow(run, "doc_id long, row_key long, n_shingles long, class_key long, shingles binary")


def frequent_buckets(sets: DataFrame) -> tuple[np.ndarray, float]:
    """Which buckets (by a hash's lowest bits) hold a shingle of many sets, and the mean list of the others, as a posting sees it.

    There are about as many buckets as make the mean bucket hold BUCKET_MEAN shingles, 2**MOST_BITS at most; a bucket far above the
    mean holds a frequent one. Tasks send their counts in chunks; these are summed as they stream by, so no group is ever held.
    Lists vary as their buckets do: variance over mean of hashed counts is the mean list.
    """
    occurrences = sets.select(F.sum("n_shingles")).first()[0] or 0
    bits = min(MOST_BITS, max(LEAST_BITS, (occurrences // BUCKET_MEAN).bit_length()))
    mean = occurrences / (1 << bits)
    most = 2 * mean + 32

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, held, done = np.zeros(1 << bits, np.int32), [], set()

        def add() -> None:
            found, n = np.unique(np.concatenate([np.zeros(0, np.int64), *held]), return_counts=True)
            counts[found] += n.astype(np.int32)
            held.clear()

        for batch in batches:
            for key, blob in zip(batch.column("class_key").to_pylist(), batch.column("shingles"), strict=True):
                if key not in done:  # copies count once a task
                    done.add(key)
                    held.append((unpacked(blob.as_py()) & U64((1 << bits) - 1)).astype(np.int64))
            if sum(map(len, held)) > MOST_HELD:
                add()
        add()
        chunks = counts.reshape(-1, CHUNK)
        some = np.flatnonzero(chunks.any(1))
        planes = [chunks[k].view(np.uint8).reshape(-1, 4).T.tobytes() for k in some]  # mostly zeros, for the codec
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(planes, pa.binary())], ["chunk", "counts"])

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, blob in zip(batch.column("chunk").to_pylist(), batch.column("counts"), strict=True):
                part = np.ascontiguousarray(np.frombuffer(blob.as_py(), np.uint8).reshape(4, -1).T).view(np.int32).ravel()
                sums[chunk] = sums.get(chunk, 0) + part.astype(np.int64)
        light = [x[x <= most].astype(float) for x in sums.values()]
        columns = (list(sums), [np.packbits(x > most).tobytes() for x in sums.values()], [float(x.sum()) for x in light], [float((x * x).sum()) for x in light])
        kinds = (pa.int32(), pa.binary(), pa.float64(), pa.float64())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["chunk", "often", "n", "n2"])

    counted = sets.where(F.col("class_key").isNotNull()).select("class_key", "shingles").mapInArrow(count, "chunk int, counts binary")
    rows = counted.repartition("chunk").mapInArrow(total, "chunk int, often binary, n double, n2 double").collect()  # a bit a bucket
    often = np.zeros((1 << bits) // CHUNK * CHUNK, bool).reshape(-1, CHUNK)
    for row in rows:
        often[row.chunk] = np.unpackbits(np.frombuffer(bytes(row.often), np.uint8)).astype(bool)
    n, n2 = sum(r.n for r in rows), sum(r.n2 for r in rows)
    return often.ravel(), max(1.0, n2 / n - n / (1 << bits)) if n else 1.0


def in_order(x: np.ndarray, often: np.ndarray) -> np.ndarray:
    """The set ``x`` with its frequent shingles last; hashes go up otherwise."""
    late = often[(x & U64(len(often) - 1)).astype(np.int64)]
    return np.concatenate([x[~late], x[late]])


def heavy_postings(sets: DataFrame, often: np.ndarray, light: int, percent: int) -> DataFrame:
    """(shingle, class_key, size): the first shingles of all sets that a heavy set can link with."""
    shared = sets.sparkSession.sparkContext.broadcast(often)
    least = -(-percent * (light + 1) // 100)  # the smallest partner of a heavy set

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[int] = set()  # classes of this task; copies post once
        for batch in batches:
            rows = []
            for key, blob in zip(batch.column("class_key").to_pylist(), batch.column("shingles"), strict=True):
                x = unpacked(blob.as_py())
                if len(x) < least or key in done:
                    continue
                done.add(key)
                first = in_order(x, shared.value)[: posted(len(x), percent)]
                rows.append((first, np.full(len(first), key), np.full(len(first), len(x))))
            if rows:
                first, key, size = map(np.concatenate, zip(*rows, strict=True))
                for at in range(0, len(first), 1 << 16):
                    to = slice(at, at + (1 << 16))
                    yield pa.RecordBatch.from_arrays([pa.array(first[to].view(np.int64)), pa.array(key[to], pa.int64()), pa.array(size[to], pa.int32())], ["shingle", "class_key", "size"])

    return sets.where(F.col("class_key").isNotNull()).select("class_key", "shingles").mapInArrow(run, "shingle long, class_key long, size int")


def light_subsets(sets: DataFrame, light: int, percent: int) -> DataFrame:
    """(subset, small, large, size, class_key): what each light set enumerates for each pair of light sizes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[int] = set()
        for batch in batches:
            rows = []
            for key, blob in zip(batch.column("class_key").to_pylist(), batch.column("shingles"), strict=True):
                x = mix(unpacked(blob.as_py()))
                s = len(x)
                if s > light or key in done:
                    continue
                done.add(key)
                for t in partners(s, percent):
                    k = need(s, t, percent)
                    if not 0 < t <= light or k > min(s, t):
                        continue
                    gone = np.array(list(combinations(range(s), s - k)), np.int64).reshape(math.comb(s, k), s - k)
                    sums = x.sum() - x[gone].sum(1) if s > k else np.array([x.sum()])
                    a, b = min(s, t), max(s, t)
                    rows += [(v, a, b, s, key) for v in mix(sums + U64(a << 32 | b)).view(np.int64).tolist()]
            if rows:
                columns = list(zip(*rows, strict=True))
                kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["subset", "small", "large", "size", "class_key"])

    return sets.where(F.col("n_shingles").between(1, light)).select("class_key", "shingles").mapInArrow(run, "subset long, small int, large int, size int, class_key long")


def light_links(subsets: DataFrame) -> DataFrame:
    """(a, b): all sets of one list link to its least one; a list of two sizes links if it has both."""
    by = ["subset", "small", "large"]
    lists = subsets.groupBy(by).agg(F.min("class_key").alias("a"), F.min("size").alias("s"), F.max("size").alias("t"), F.count("*").alias("n"))
    lists = lists.where((F.col("n") > 1) & (F.col("s") == F.col("small")) & (F.col("t") == F.col("large")))
    return subsets.join(lists.select(*by, "a"), by).where("a <> class_key").select("a", F.col("class_key").alias("b")).distinct()


def close_in_size(s, t, percent: int):
    return 100 * F.least(s, t) >= percent * F.greatest(s, t)


def least_met(s, t, percent: int):
    """In how many lists linked sets of ``s`` and ``t`` meet at least.

    Of common shingles that the set with the earlier last posting doesn't meet the other in, it has posted none; so there are no
    more of them than it has shingles unposted.
    """
    unposted = lambda n: F.ceil(percent * n / 100) - 1
    return F.ceil(percent * (s + t) / (100 + percent)) - F.greatest(unposted(s), unposted(t))


def verified(pairs: DataFrame, sets: DataFrame, holders: DataFrame, percent: int) -> DataFrame:
    """Those (a, b) of ``pairs`` whose sets link; holders: (class_key, doc_id), one document of each class."""
    ends = pairs.select(F.col("a").alias("class_key")).union(pairs.select(F.col("b").alias("class_key"))).distinct()
    wanted = written(holders.join(ends, "class_key", "left_semi"), "jaccard-wanted")
    some = small(wanted, BROADCAST_ROWS).alias("w")
    same = (F.col("s.class_key") == F.col("w.class_key")) & F.col("s.doc_id").eqNullSafe(F.col("w.doc_id"))
    whole = sets.alias("s").join(some, same, "left_semi").select("class_key", "shingles")
    left = whole.select(F.col("class_key").alias("a"), F.col("shingles").alias("x"))
    right = whole.select(F.col("class_key").alias("b"), F.col("shingles").alias("y"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                x, y = unpacked(x.as_py()), unpacked(y.as_py())
                both = np.concatenate([x, y])
                both.sort()
                common = int((both[1:] == both[:-1]).sum())
                keep.append(100 * common >= percent * (len(both) - common))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def joined_in_block(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """For each of ``sets`` (sorted, distinct) the first set of its component by the links among them.

    Sets are held as their differences from what more than half of them contain; common = (s + t - differences) / 2.
    """
    n = len(sets)
    label, pieces = np.arange(n), n
    size = np.array([len(x) for x in sets])
    owner = np.repeat(np.arange(n), size)
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    usual = 2 * count > n
    place = np.cumsum(usual) - 1
    lacks = np.ones((n, int(usual.sum())), bool)
    of_usual = usual[column]
    lacks[owner[of_usual], place[column[of_usual]]] = False
    apart = lacks.sum(1) + np.bincount(owner[~of_usual], minlength=n)
    lone, gap = np.nonzero(lacks)
    recurs = ~of_usual & (count[column] > 1)
    owners, columns = np.concatenate([owner[recurs], lone]), np.concatenate([column[recurs], len(count) + gap])
    by_column = np.argsort(columns, kind="stable")
    held = owners[by_column]
    found, first, many = np.unique(columns[by_column], return_index=True, return_counts=True)
    of_row = np.searchsorted(found, columns)
    by_row = np.argsort(owners, kind="stable")
    ends = np.cumsum(np.bincount(owners, minlength=n))
    for i in np.argsort(apart, kind="stable"):  # the most usual sets first: they join most
        if pieces == 1:
            break
        own = of_row[by_row[ends[i - 1] if i else 0 : ends[i]]]
        steps = np.repeat(first[own] - np.append(0, np.cumsum(many[own])[:-1]), many[own]) + np.arange(many[own].sum())
        twice = (size[i] - apart[i]) + (size - apart) + 2 * np.bincount(held[steps], minlength=n)  # common shingles
        near = np.unique(label[100 * twice >= percent * (2 * (size[i] + size) - twice)])
        if len(near) > 1:
            label[np.isin(label, near)] = near[0]
            pieces -= len(near) - 1
    return label


def joined_in_clusters(placed: DataFrame, sets: DataFrame, holders: DataFrame, percent: int) -> DataFrame:
    """(a, b): links that hold together what links within each block of ``placed`` (cluster, block, class_key)."""
    wanted = placed.join(holders, "class_key").withColumnRenamed("doc_id", "of")
    same = (F.col("s.class_key") == F.col("w.class_key")) & F.col("s.doc_id").eqNullSafe(F.col("w.of"))
    whole = sets.alias("s").join(small(wanted, BROADCAST_ROWS).alias("w"), same).select("cluster", "block", "w.class_key", "shingles")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def links(held: dict[int, np.ndarray]) -> pa.RecordBatch:
            keys = np.array(list(held), np.int64)
            label = joined_in_block(list(held.values()), percent) if len(keys) > 1 else np.zeros(1, np.int64)
            tied = np.flatnonzero(label != np.arange(len(keys)))
            return pa.RecordBatch.from_arrays([pa.array(keys[label[tied]]), pa.array(keys[tied])], ["a", "b"])

        now, held = None, {}  # the sets of one block, by class
        for batch in batches:
            for *block, key, blob in zip(*[batch.column(c).to_pylist() for c in ("cluster", "block", "class_key")], batch.column("shingles"), strict=True):
                if block != now:
                    if held:
                        yield links(held)
                    now, held = block, {}
                if key not in held:
                    held[key] = unpacked(blob.as_py())
        if held:
            yield links(held)

    return whole.repartition("cluster", "block").sortWithinPartitions("cluster", "block").mapInArrow(run, "a long, b long")


def cluster_links(star: DataFrame, sets: DataFrame, holders: DataFrame, percent: int) -> DataFrame:
    """(a, b): links that hold together what links within each cluster of ``star`` (class_key, size, cluster, the head's size)."""
    n = F.greatest(F.ceil(F.sum("size") * BYTES / BLOCK_BYTES), F.ceil(F.count("*") / BLOCK_SETS)).cast("int")
    blocks = written(star.groupBy("cluster").agg(n.alias("blocks")), "jaccard-blocks")
    several = blocks.where("blocks > 1")
    dealt = star.join(small(several, BROADCAST_ROWS), "cluster", "left").select("cluster", F.pmod(F.xxhash64("class_key"), F.coalesce("blocks", F.lit(1))).cast("int").alias("block"), "class_key")
    heads = blocks.select("cluster", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.col("cluster").alias("class_key"))
    links = written(joined_in_clusters(dealt.union(heads), sets, holders, percent), "jaccard-links")
    if not several.head(1):
        return links
    joined = components(links, "a", "b").select(F.col("node").alias("class_key"), "component")
    component = F.coalesce("component", "class_key")
    in_pieces = star.join(several, "cluster").join(joined, "class_key", "left").groupBy("cluster", "blocks").agg(F.min(component).alias("low"), F.max(component).alias("high"))
    in_pieces = small(in_pieces.where("low <> high").select("cluster", "blocks"), BROADCAST_ROWS)
    own = F.pmod(F.xxhash64("class_key"), F.col("blocks")).cast("int")  # a block meets every other one
    meets = F.transform(F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: k != own), lambda k: F.least(k, own) * F.col("blocks") + F.greatest(k, own))
    paired = star.join(in_pieces, "cluster").select("cluster", F.explode(meets).alias("block"), "class_key")
    return links.union(written(joined_in_clusters(paired, sets, holders, percent), "jaccard-links"))


def linked(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest id reachable by links) of every document."""
    with arrow_rows(docs.sparkSession, BATCH_ROWS):
        return _linked(docs, width, percent).select("doc_id", "n_shingles", "component_id")


def _linked(docs: DataFrame, width: int, percent: int) -> DataFrame:
    sets = written(sets_of(docs, width), "jaccard-sets")
    holders = written(sets.where(F.col("class_key").isNotNull()).groupBy("class_key").agg(F.min("doc_id").alias("doc_id")), "jaccard-classes")
    often, mean_list = frequent_buckets(sets)
    sizes = [(int(s), int(n)) for s, n in sets.where(F.col("n_shingles").between(1, 64)).groupBy("n_shingles").count().collect()]
    light = boundary(sizes, mean_list, percent)

    posts = heavy_postings(sets, often, light, percent).repartition("shingle").dropDuplicates(["shingle", "class_key"])
    # the member of a list with the least scrambled key stands for it
    of_list = Window.partitionBy("shingle")
    head = F.min(F.struct(F.xxhash64("class_key").alias("order"), "class_key", "size")).over(of_list)
    lists = posts.withColumns({"n": F.count("*").over(of_list), "h": head}).where("n > 1")
    lists = written(lists.select("shingle", "class_key", "size", F.col("h.class_key").alias("head"), F.col("h.size").alias("head_size")), "jaccard-lists")

    met = lists.where(F.col("class_key") != F.col("head")).where(close_in_size(F.col("size"), F.col("head_size"), percent))
    met = met.groupBy("class_key", "head", "size", "head_size").agg(F.count("*").alias("met"))
    met = met.where(4 * F.col("met") >= least_met(F.col("size"), F.col("head_size"), percent))
    star = met.groupBy("class_key", "size").agg(F.max_by("head", F.struct("met", "head")).alias("cluster"))
    star = written(star, "jaccard-star")
    links = cluster_links(star, sets, holders, percent)
    if light:
        links = links.union(written(light_links(light_subsets(sets, light, percent)), "jaccard-light"))

    of_cluster, of_list = Window.partitionBy("shingle", "cluster"), Window.partitionBy("shingle")
    placed = lists.select("shingle", "class_key", "size").join(small(star.select("class_key", "cluster"), BROADCAST_ROWS), "class_key", "left").withColumn("cluster", F.coalesce("cluster", "class_key"))
    placed = placed.withColumn("n", F.count("*").over(of_cluster)).withColumns({"main": F.max(F.struct("n", "cluster")).over(of_list)["cluster"], "all": F.count("*").over(of_list), "most": F.max("n").over(of_list)})
    placed = written(placed.where("most < all").select("shingle", "class_key", "size", "cluster", "main"), "jaccard-placed")
    met = placed.where("cluster <> main").groupBy("class_key", "size", "main").agg(F.count("*").alias("met")).where(4 * F.col("met") >= least_met(F.col("size"), F.col("size"), percent))
    visits = written(met.groupBy("class_key", "size").agg(F.max_by("main", F.struct("met", "main")).alias("cluster")), "jaccard-visits")
    hosts = star.join(small(visits.select("cluster").distinct(), BROADCAST_ROWS), "cluster", "left_semi").select(*visits.columns)
    links = links.union(cluster_links(visits.union(hosts), sets, holders, percent))

    found = components(links, "a", "b")
    joined = found.select(F.col("node").alias("class_key"), "component")
    known = written(visits.select("class_key", F.col("cluster").alias("visited")).join(joined, "class_key", "full"), "jaccard-known")
    placed = placed.join(small(known, BROADCAST_ROWS), "class_key", "left").withColumns({"component": F.coalesce("component", "class_key"), "visited": F.coalesce("visited", "cluster")})
    placed = placed.withColumns({"low": F.min("component").over(of_list), "high": F.max("component").over(of_list)})
    several = written(placed.where("low <> high").drop("low", "high"), "jaccard-open")
    # what has not met a list's main cluster meets all of the list
    outside = (F.col("cluster") != F.col("main")) & (F.col("visited") != F.col("main"))
    several = several.withColumn("outside", outside)
    l, r = several.where("outside").alias("l"), several.alias("r")
    once = ~F.col("r.outside") | (F.col("l.class_key") < F.col("r.class_key"))
    never = (F.col("l.cluster") != F.col("r.cluster")) & (F.col("l.cluster") != F.col("r.visited")) & (F.col("l.visited") != F.col("r.cluster")) & (F.col("l.visited") != F.col("r.visited"))
    apart = (F.col("l.shingle") == F.col("r.shingle")) & never & (F.col("l.component") != F.col("r.component")) & once
    met = l.join(r, apart & close_in_size(F.col("l.size"), F.col("r.size"), percent))
    l_first = F.col("l.class_key") < F.col("r.class_key")
    ends = lambda name: (F.when(l_first, F.col(f"l.{name}")).otherwise(F.col(f"r.{name}")), F.when(l_first, F.col(f"r.{name}")).otherwise(F.col(f"l.{name}")))
    met = met.select(*[c.alias(x) for c, x in zip((*ends("class_key"), *ends("size")), "abst", strict=True)]).groupBy("a", "b", "s", "t").agg(F.count("*").alias("met"))
    pairs = met.where(F.col("met") >= least_met(F.col("s"), F.col("t"), percent)).select("a", "b")
    more = written(verified(written(pairs, "jaccard-pairs"), sets, holders, percent), "jaccard-more")
    return _named(sets, holders, components(links.union(more), "a", "b") if more.head(1) else found)


def one_of_each(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """One row of each component of ``docs``: of the smallest id (nulls last), then of the least hash of id and text.

    A text without words is linked with nothing and stays; of rows equal in id and text, one does.
    """
    with arrow_rows(docs.sparkSession, BATCH_ROWS):
        placed = _linked(docs, width, percent)
        least = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row_key"))["row_key"].alias("_row_key")
        first = placed.where("component IS NOT NULL").groupBy("component").agg(least).select("_row_key")
        first = written(first.union(placed.where("component IS NULL").select("row_key")).distinct(), "jaccard-first")
    single = docs.withColumn("_row_key", row_key()).dropDuplicates(["_row_key"])
    return single.join(first, "_row_key", "left_semi").drop("_row_key")


def _named(sets: DataFrame, holders: DataFrame, joined: DataFrame) -> DataFrame:
    """Components of classes as components of documents, named by the smallest id; component: a class key (null: empty text)."""
    classes = holders.join(joined.withColumnRenamed("node", "class_key"), "class_key", "left").select("class_key", "doc_id", F.coalesce("component", "class_key").alias("component"))
    names = classes.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    of_class = classes.join(names, "component").select("class_key", "component", "component_id")
    found = sets.select("doc_id", "row_key", "n_shingles", "class_key").join(of_class, "class_key", "left")
    own = F.when(F.col("class_key").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return found.select("doc_id", "row_key", "n_shingles", "component", own.alias("component_id"))
