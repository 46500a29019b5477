"""Merkle manifests of datasets: one tree per group, one over the groups, and a proof for every row.

A group's leaves are put in order by a range sort over all groups at once and numbered by running counts of its parts, so
a group that holds most rows is many tasks. Blocks of ``ARITY ** DEPTH`` consecutive leaves are fixed-size ordered arrays;
``sequence``, ``transform``, ``slice`` and ``aggregate`` collapse their levels inside the row, and block roots are the nodes
of the next round, until each group has one. The roots of the groups, in order of the groups, are a tree of the same kind.
Proofs come down the same way: a block hands the path above it to the nodes that it was made of, so the levels that many
leaves share are worked out once.

While several nodes remain, every ``ARITY`` consecutive ones become the hash of their hexadecimal digests, a last run of
fewer too, even of one; a lone leaf is its own root.

Defined cases: null fields are ``-`` in a leaf and differ from empty ones; a null group is a group of its own, the first; null
orders come first; rows of the same order in a group stand by their leaves, so rows that repeat are interchangeable and have
a place each; texts of any length are hashed whole; an empty table gives an empty manifest; columns that are not named are not
read, and those to be carried come back in the struct ``row``, so their names cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import small, written

ARITY, DEPTH = 3, 6
BLOCK = ARITY**DEPTH
#: rows with paths are about 2 KB each
BROADCAST_ROWS = 10_000
#: what a proof holds for each level: the digests of the run before and after the node, joined
STEP = "struct<left:string,right:string>"


def digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def leaf(*fields: Column) -> Column:
    """The digest of the fields: ``-`` for null, else UTF-8 byte count, colon, value."""
    shown = [f.cast("string") for f in fields]
    return digest(F.concat(*[F.coalesce(F.concat(F.octet_length(s), F.lit(":"), s), F.lit("-")) for s in shown]))


def folded(start: Column, path: Column) -> Column:
    """The root that a leaf and its path lead to."""
    return F.aggregate(path, start, lambda node, step: digest(F.concat(step["left"], node, step["right"])))


def siblings(path: Column) -> Column:
    """All digests of a path joined, level by level, left to right."""
    return F.array_join(F.transform(path, lambda step: F.concat(step["left"], step["right"])), "")


def manifest(rows: DataFrame, group: str = "source", order: str = "doc_id", node: str = "leaf", carry: tuple[str, ...] = ()) -> DataFrame:
    """group, order, leaf, subroot, root, path (steps from leaf to root) and row (a struct of ``carry``) of every row."""
    item = F.struct(F.col(f"`{group}`").alias("group"), F.col(f"`{order}`").alias("order"), F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in carry]).alias("row"))
    tree = F.coalesce(F.concat(F.lit("="), F.col(f"`{group}`").cast("string")), F.lit(""))  # null is the first, and apart from empty
    leaves = written(rows.select(tree.alias("tree"), F.col(f"`{order}`").alias("order"), F.col(f"`{node}`").alias("node"), item.alias("item")), "leaves")
    rounds, subroots = climbed(numbered(leaves))
    groups = subroots.select(F.lit("").alias("tree"), F.col("tree").alias("order"), "node", F.struct("tree", F.col("node").alias("subroot")).alias("item"))
    upper, root = climbed(numbered(groups))
    none = F.array().cast(f"array<{STEP}>")
    tops = descended(upper, root.select("tree", none.alias("path"), F.struct(F.col("node").alias("root")).alias("above")))
    tops = written(tops.select("item.tree", "path", F.struct("item.subroot", "above.root").alias("above")), "group-paths")
    own = F.col("item.row").dropFields("_") if carry else F.lit(None)
    return descended(rounds, tops).select(
        F.col("item.group").alias("group"), F.col("item.order").alias("order"), F.col("node").alias("leaf"), "above.subroot", "above.root", "path", own.alias("row")
    )


def numbered(nodes: DataFrame) -> DataFrame:
    """``nodes`` (tree, order, node, item) with at, the place from 0 in its tree by order and node, and n, the tree's size."""
    ranked = nodes.withColumn("salt", F.xxhash64(F.monotonically_increasing_id()))  # rows that repeat are not all in one part
    ranked = ranked.repartitionByRange("tree", "order", "node", "salt").sortWithinPartitions("tree", "order", "node", "salt")
    ranked = written(ranked.drop("order", "salt").withColumn("line", F.monotonically_increasing_id()), "ordered")
    part = F.shiftright("line", 33)
    parts = ranked.groupBy("tree", part.alias("part")).agg(F.min("line").alias("first"), F.count("*").alias("held"))
    whole, before = Window.partitionBy("tree"), Window.partitionBy("tree").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = written(parts.select("tree", "part", (F.coalesce(F.sum("held").over(before), F.lit(0)) - F.col("first")).alias("shift"), F.sum("held").over(whole).alias("n")), "parts")
    return ranked.withColumn("part", part).join(small(parts, BROADCAST_ROWS), ["tree", "part"]).select("tree", (F.col("line") + F.col("shift")).alias("at"), "n", "node", "item")


def climbed(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """The rounds of blocks (tree, block, n, items, levels), and (tree, node) with the root of every tree."""
    rounds, roots = [], None
    while True:
        rounds.append(written(blocks(nodes), "blocks"))
        top = F.element_at(F.element_at("levels", -1), 1).alias("node")
        done = rounds[-1].where(F.col("n") <= BLOCK).select("tree", top)
        roots = done if roots is None else roots.unionByName(done)
        if rounds[-1].where(F.col("n") > BLOCK).isEmpty():
            return rounds, written(roots, "roots")
        place = F.col("block").alias("at")
        nodes = rounds[-1].where(F.col("n") > BLOCK).select("tree", place, F.ceil(F.col("n") / BLOCK).alias("n"), top, F.col("block").alias("item"))


def blocks(nodes: DataFrame) -> DataFrame:
    """Consecutive nodes of a tree as blocks, with all levels of each; a tree of several blocks takes the whole depth of each."""
    held = nodes.groupBy("tree", "n", F.floor(F.col("at") / BLOCK).alias("block")).agg(F.array_sort(F.collect_list(F.struct("at", "node", "item"))).alias("held"))
    height = F.lit(DEPTH)
    for k in reversed(range(DEPTH)):
        height = F.when(F.col("n") <= ARITY**k, k).otherwise(height)
    held = held.select("tree", "block", "n", "held.item", "held.node", F.when(height > 0, F.sequence(F.lit(1), height)).otherwise(F.array().cast("array<int>")).alias("up"))
    return held.select("tree", "block", "n", F.col("item").alias("items"), F.aggregate("up", F.array("node"), lambda levels, _: F.concat(levels, F.array(collapsed(F.element_at(levels, -1))))).alias("levels"))


def collapsed(level: Column) -> Column:
    """The level above: a digest for each run."""
    runs = F.sequence(F.lit(0), F.floor((F.size(level) - 1) / ARITY).cast("int"))
    return F.transform(runs, lambda run: digest(F.array_join(F.slice(level, run * ARITY + 1, F.lit(ARITY)), "")))


def path_in(levels: Column, place: Column) -> Column:
    """The steps from the node at ``place`` of the first level up to the last level."""
    powers = F.array(*[F.lit(ARITY**k) for k in range(DEPTH)])

    def step(level: Column, k: Column) -> Column:
        at = F.floor(place / F.get(powers, k)).cast("int")
        inside = at % ARITY
        return F.struct(F.array_join(F.slice(level, at - inside + 1, inside), "").alias("left"), F.array_join(F.slice(level, at + 2, F.lit(ARITY - 1) - inside), "").alias("right"))

    return F.transform(F.slice(levels, F.lit(1), F.size(levels) - 1), step)


def descended(rounds: list[DataFrame], tops: DataFrame) -> DataFrame:
    """(item, node, path, above) of every node of the first round; ``tops``: (tree, path, above) of every tree's root."""
    handed = None
    for height, held in reversed(list(enumerate(rounds))):
        ended = held.where(F.col("n") <= BLOCK).select("tree", "block").join(small(tops, BROADCAST_ROWS), "tree")
        over = ended if handed is None else handed.unionByName(ended.select(*handed.columns))
        joined = held.join(small(over.withColumnRenamed("path", "rest"), BROADCAST_ROWS), ["tree", "block"])
        path = lambda i: F.concat(path_in(F.col("levels"), i), "rest").alias("path")
        own = F.transform("items", lambda item, i: F.struct(item.alias("item"), F.get(F.element_at("levels", 1), i).alias("node"), path(i)))
        found = joined.select("tree", "above", F.explode(own).alias("own")).select("tree", "own.item", "own.node", "own.path", "above")
        if height == 0:
            return found.select("item", "node", "path", "above")
        handed = written(found.select("tree", F.col("item").alias("block"), "path", "above"), "paths")
    raise ValueError("no rounds")


def checked(docs: DataFrame) -> DataFrame:
    """The manifest of ``docs`` by source, its proofs, and what they say after line feeds are lost from some texts.

    Documents whose crc32 of the decimal id (null: of no bytes) is even are tampered with; a null text stays null.
    """
    text = F.when(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 2 == 0, F.regexp_replace("text", "\n", "")).otherwise(F.col("text"))
    of = lambda body: leaf(F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), body)
    rows = docs.select("doc_id", "source", of(F.col("text")).alias("leaf"), F.when(~text.eqNullSafe(F.col("text")), of(text)).alias("tampered"))
    proven = manifest(rows, carry=("tampered",))
    found = folded(F.coalesce("row.tampered", "leaf"), F.col("path"))
    proven = proven.select(F.col("order").alias("doc_id"), "leaf", "subroot", "root", digest(siblings(F.col("path"))).alias("proof_sha256"), found.alias("folded_root"))
    return proven.withColumn("verified", F.col("folded_root") == F.col("root"))
