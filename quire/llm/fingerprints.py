"""Document fingerprints: invertible Bloom lookup sketches of paragraphs, in DataFrame operations only.

A text's paragraphs are its lines, long ones cut every ``LONGEST`` signs; each has a digest of 40 bits and a check of 20.
The fingerprint of a text, whatever its length, is the number of its digests, the SAMPLE least hashes among them, and one
sketch of ``3 * WIDE`` cells: every digest is added to one cell of each third (a count, and the exclusive or of the
digests). Two versions' cells subtract: what both have cancels, and peeling cells that hold a single digest recovers the
differing ones, each with the version that has it. The samples estimate how many differ; where these are more than a
sketch holds, digests are dealt by their hash to as many parts as the estimate needs, with a sketch each. If some cell
of a part stays, that part is retried larger, with 3, 9, 27 and 81 times the cells and other places. Likeness is common
over all distinct paragraphs, from the digests recovered. Should all retries fail, which takes digests that collide in
every one of them, it is the estimate.

Defined cases: a null text is empty and has no paragraphs; two empty texts are alike (1.0); paragraphs that repeat count
once; the next document is the one with the next smaller id, after the last the first; rows of equal ids follow one another in
order of their texts; null ids come last, in order of a hash of their texts; an empty table gives an empty result; a single document is its own next.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LONGEST, WIDE, PER_PART, ROUNDS, SAMPLE = 400, 10, 10, 12, 16
RETRIES = (3, 9, 27, 81)
FOUND = "array<struct<n:int,k:bigint>>"
CELL = "struct<n:int,x:bigint>"


def digests(text: Column) -> Column:
    """Distinct digests of the paragraphs: 40 bits, then 20 bits of their own hash."""
    parts = F.regexp_extract_all(text, F.lit(r"[^\n]{1,%d}" % LONGEST), F.lit(0))
    short = F.transform(parts, lambda p: F.shiftrightunsigned(F.xxhash64(p), 24))
    return F.array_distinct(F.transform(short, lambda d: F.shiftleft(d, 20).bitwiseOR(check(d))))


def check(d: Column) -> Column:
    return F.xxhash64(d, F.lit(5)).bitwiseAND(F.lit((1 << 20) - 1))


def placed(key: Column, seed: int = 0) -> Column:
    """A digest with its cells, one in each third, and the hash that deals it to a part."""
    h = F.xxhash64(key, F.lit(seed))
    at = lambda i: (F.pmod(F.shiftright(h, 16 * i), F.lit(WIDE)) + i * WIDE).cast("int")
    return F.struct(key.alias("k"), at(0).alias("a"), at(1).alias("b"), at(2).alias("c"), F.shiftrightunsigned(h, 50).alias("h"))


def let(value: Column, body) -> Column:
    """``body`` of ``value``, which is worked out once however often the body names it."""
    return F.transform(F.array(value), body)[0]


def parts_for(n: Column) -> Column:
    """The number of parts that leaves a part no more than PER_PART of ``n`` differing digests on average."""
    return F.greatest(F.lit(1), F.ceil(n / PER_PART)).cast("int")


def estimated(a: Column, b: Column) -> Column:
    """About how many digests only one of two versions has, by the least hashes of both together that both have."""
    both = F.slice(F.array_sort(F.array_union(a["sample"], b["sample"])), 1, SAMPLE)
    common = lambda u: F.size(F.filter(u, lambda h: F.array_contains(a["sample"], h) & F.array_contains(b["sample"], h)))
    share = let(both, lambda u: common(u) / F.greatest(F.size(u), F.lit(1)))
    return let(share, lambda j: (a["n"] + b["n"]) * (1 - j) / (1 + j))


def cells(keys: Column, parts: Column) -> Column:
    """Cells of each part of placed ``keys``."""
    cell = lambda held: F.struct(F.size(held).alias("n"), F.aggregate(held, F.lit(0).cast("bigint"), lambda x, k: x.bitwiseXOR(k["k"])).alias("x"))
    third = lambda own, field, i: F.transform(F.sequence(F.lit(i * WIDE), F.lit(i * WIDE + WIDE - 1)), lambda at: let(F.filter(own, lambda k: k[field] == at), cell))
    part = lambda own: F.concat(third(own, "a", 0), third(own, "b", 1), third(own, "c", 2))
    own = lambda p: F.filter(keys, lambda k: F.pmod(k["h"], parts) == p)
    return F.transform(F.sequence(F.lit(0), parts - 1), lambda p: let(own(p), part))


def minus(a: Column, b: Column) -> Column:
    """A part's cells of one version less those of another."""
    return F.zip_with(a, b, lambda x, y: F.struct((x["n"] - y["n"]).alias("n"), x["x"].bitwiseXOR(y["x"]).alias("x")))


def peeled(part: Column, seed: int = 0) -> Column:
    """The digests that peeling recovers from the cells of a part, with n: 1 if the first version has it, -1 if the second; null if some cell stays."""
    lone = lambda c: (F.abs(c["n"]) == 1) & (check(F.shiftright(c["x"], 20)) == c["x"].bitwiseAND(F.lit((1 << 20) - 1)))
    sign = lambda c: F.struct(c["n"].alias("n"), placed(c["x"], seed).alias("p"))
    remove = lambda c, s: F.struct((c["n"] - s["n"]).alias("n"), c["x"].bitwiseXOR(s["p"]["k"]).alias("x"))

    def taken(state: Column, found: Column) -> Column:
        hit = lambda i: F.filter(found, lambda s: (s["p"]["a"] == i) | (s["p"]["b"] == i) | (s["p"]["c"] == i))
        bit = lambda i: F.call_function("shiftleft", F.lit(1), i)
        touched = F.aggregate(found, F.lit(0), lambda m, s: m.bitwiseOR(bit(s["p"]["a"])).bitwiseOR(bit(s["p"]["b"])).bitwiseOR(bit(s["p"]["c"])))  # 3 * WIDE bits
        left = let(touched, lambda m: F.transform(state["cells"], lambda c, i: F.when(m.bitwiseAND(bit(i)) == 0, c).otherwise(F.aggregate(hit(i), c, remove))))
        out = F.concat(state["out"], F.transform(found, lambda s: F.struct(s["n"].alias("n"), s["p"]["k"].alias("k"))))
        return F.struct(left.alias("cells"), out.alias("out"), (F.size(found) == 0).alias("done"))

    def step(state: Column, _: Column) -> Column:
        """All lone digests out of their cells."""
        found = F.array_distinct(F.transform(F.filter(state["cells"], lone), sign))
        last = F.struct(state["cells"].alias("cells"), state["out"].alias("out"), F.lit(True).alias("done"))
        return F.when(state["done"], state).otherwise(let(found, lambda f: F.when(F.size(f) > 0, taken(state, f)).otherwise(last)))

    start = F.struct(part.cast(f"array<{CELL}>").alias("cells"), F.array().cast(FOUND).alias("out"), F.lit(False).alias("done"))
    gone = lambda s: F.when(F.forall(s["cells"], lambda c: (c["n"] == 0) & (c["x"] == 0)), s["out"])
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step, gone)


def together(found: Column) -> Column:
    """The digests of all parts in one array; null if a part has none to show."""
    return F.when(F.forall(found, lambda f: f.isNotNull()), F.flatten(found))


def version(text: Column) -> Column:
    """What is compared of a text: its placed digests, their number, the sample and the cells of one part."""
    least = lambda keys: F.slice(F.array_sort(F.transform(keys, lambda k: F.xxhash64(k["k"], F.lit(9)))), 1, SAMPLE)
    held = lambda keys: F.struct(keys.alias("keys"), F.size(keys).alias("n"), least(keys).alias("sample"), cells(keys, F.lit(1)).alias("cells"))
    return let(F.transform(digests(text), lambda d: placed(d)), held)


def retried(own: Column) -> Column:
    """The digests that differ between two versions of a part (x and y of ``own``), by larger and larger sketches."""

    def larger(parts: int, seed: int) -> Column:
        again = lambda keys: cells(F.transform(keys, lambda k: placed(k["k"], seed)), F.lit(parts))
        return together(F.transform(F.zip_with(again(own["x"]), again(own["y"]), minus), lambda part: peeled(part, seed)))

    return F.coalesce(*[larger(parts, seed) for seed, parts in enumerate(RETRIES, 1)])


def differing(a: Column, b: Column, parts: Column) -> Column:
    """The digests that only one of two versions has, by peeling each part; n: 1 for the first version, -1 for the second."""
    at = lambda v: F.when(parts == 1, v["cells"]).otherwise(cells(v["keys"], parts))
    of_part = lambda v, p: F.filter(v["keys"], lambda k: F.pmod(k["h"], parts) == p)
    both = F.struct(at(a).alias("x"), at(b).alias("y"))
    one = lambda s, p: F.coalesce(peeled(minus(F.get(s["x"], p), F.get(s["y"], p))), let(F.struct(of_part(a, p).alias("x"), of_part(b, p).alias("y")), retried))
    return let(both, lambda s: together(F.transform(F.sequence(F.lit(0), parts - 1), lambda p: one(s, p))))


def difference(a: Column, b: Column) -> Column:
    """What ``differing`` recovers, in as many parts as the samples' estimate needs."""
    return let(parts_for(estimated(a, b)), lambda p: differing(a, b, p))


def likeness(a: Column, b: Column, found: Column) -> Column:
    """Common over all distinct digests of two versions, by the digests ``found`` to differ."""
    total = a["n"] + b["n"]
    return F.when(total == 0, F.lit(1.0)).otherwise(let(F.when(found.isNull(), estimated(a, b)).otherwise(F.size(found)), lambda d: (total - d) / (total + d)))


def sketch(v: Column) -> Column:
    """The fingerprint: number of digests, the sample, then every cell as count and digests."""
    cell = lambda c: F.when(c["n"] == 0, F.lit("0")).otherwise(F.concat(F.hex(c["n"]), F.lit("."), F.hex(c["x"])))
    return F.concat_ws("|", v["n"].cast("string"), F.array_join(F.transform(v["sample"], lambda h: F.hex(h)), ","), F.array_join(F.transform(F.flatten(v["cells"]), cell), ","))


def with_next(docs: DataFrame, bucket_rows: int = 1000, most_bounds: int = 4096) -> DataFrame:
    """doc_id, text, its version, next_text and next_version: those of the document with the next smaller id, after the last that of the first.

    Ids are split into ranges of about ``bucket_rows`` (up to ``most_bounds`` quantiles, each in equal steps), null ids by a hash of
    their texts, so no task holds more than a few ranges, and the first row of each range is handed to the range before it. Rows of
    one id are one range, however many they are.
    """
    read = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows, named = read.agg(F.count("*"), F.count("doc_id")).first()
    ranges, unnamed = max(1, math.ceil(named / bucket_rows)), max(1, math.ceil((rows - named) / bucket_rows))
    bounds = []
    if ranges > 1:
        k = min(ranges, most_bounds)
        bounds = read.agg(F.percentile_approx("doc_id", [i / k for i in range(k + 1)], 10 * max(k, 1000))).first()[0] or []
    bounds = sorted(set(bounds))
    steps = max(1, math.ceil(ranges / max(1, len(bounds))))
    if len(bounds) > 1:
        place = _place(bounds, F.col("doc_id"))
        low, high = (F.element_at(F.array(*[F.lit(int(b)) for b in bounds]), place + i) for i in (0, 1))
        step = F.least(F.greatest(F.floor((F.col("doc_id") - low) / (high - low) * steps), F.lit(0)), F.lit(steps - 1))
        bucket = place.cast("bigint") * steps + step
    else:
        bucket = F.lit(0).cast("bigint")
    bucket = F.when(F.col("doc_id").isNull(), -1 - F.pmod(F.xxhash64("text"), F.lit(unnamed))).otherwise(bucket)
    ranged = read.withColumn("bucket", bucket)
    dealt = ranged.repartition(max(1, (ranges + unnamed) // 4), "bucket").withColumn("version", version(F.col("text")))
    firsts = ranged.groupBy("bucket").agg(F.max_by(F.struct("text"), F.struct("doc_id", "text")).alias("first"))
    down = Window.orderBy(F.desc("bucket"))  # over one row a range
    everything = down.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    after = firsts.select("bucket", F.coalesce(F.lead("first").over(down), F.first("first").over(everything)).alias("after"))
    order = Window.partitionBy("bucket").orderBy(F.desc("doc_id"), F.desc("text"))
    joined = dealt.withColumn("following", F.lead(F.struct("text", "version")).over(order)).join(after, "bucket")
    handed = F.struct(F.col("after.text").alias("text"), version(F.col("after.text")).alias("version"))
    following = F.when(F.col("following").isNotNull(), F.col("following")).otherwise(handed)
    return joined.select("doc_id", "text", "version", following.alias("next")).select("doc_id", "text", "version", F.col("next.text").alias("next_text"), F.col("next.version").alias("next_version"))


def _place(bounds: list[int], value: Column) -> Column:
    """The number of the last of ``bounds`` (sorted) up to ``value``, from 1, the last but one at most: first among every 64th, then among those after it."""
    held = [bounds[i : i + 64] for i in range(0, len(bounds), 64)]
    upto = lambda some: F.size(F.filter(some, lambda b: b <= value))
    blocks = F.array(*[F.array(*[F.lit(int(b)) for b in block]) for block in held])
    inside = let(F.greatest(upto(F.array(*[F.lit(int(block[0])) for block in held])), F.lit(1)), lambda k: (k - 1) * 64 + upto(F.element_at(blocks, k)))
    return F.least(F.greatest(inside, F.lit(1)), F.lit(len(bounds) - 1)).cast("int")


def compared(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited (the text with its end replaced), both fingerprints, likeness to the edited and the next text.

    lost and gained: the digests of paragraphs that only the text, or only the edited text, has, as peeling recovers them (null
    if all retries failed).
    """
    n = F.length("text")
    half = (n / 2).cast("int")
    rows = with_next(docs).select(
        "doc_id", n.cast("long").alias("n_chars"), F.concat(F.substring("text", 1, n - half), F.substring("next_text", 1, half)).alias("edited"), F.col("version").alias("a"), F.col("next_version").alias("c")
    )
    a, b, c = F.col("a"), F.col("b"), F.col("c")
    rows = rows.withColumn("b", version(F.col("edited"))).withColumns({"to_edited": difference(a, b), "to_next": difference(a, c)})
    only = lambda n: F.transform(F.filter("to_edited", lambda d: d["n"] == n), lambda d: d["k"])
    return rows.select(
        "doc_id", "n_chars", "edited", sketch(a).alias("fingerprint"), sketch(b).alias("edited_fingerprint"),
        likeness(a, b, F.col("to_edited")).alias("near_edited"), likeness(a, c, F.col("to_next")).alias("near_next"), only(1).alias("lost"), only(-1).alias("gained"),
    )


def digest(done: DataFrame) -> DataFrame:
    return done.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next",
        F.size("lost").cast("long").alias("n_lost"), F.size("gained").cast("long").alias("n_gained"),
    )
