"""Joins beyond equality: containment, rectangles, nearest anchors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.sources.tables import kept_aside

GRAM, MOST_BROADCAST = 3, 200_000


def contained_needles(texts: DataFrame, needles: DataFrame, text_id: str, needle_id: str, encoded: bool = False) -> DataFrame:
    """Distinct (text_id, needle_id) where the needle (three signs at least, any case) is part of the text.

    ``encoded``: the needle as it is written, its UTF-8 or UTF-16BE bytes as hexadecimal digits (any case, from an even digit of a run
    of digits on), or its UTF-16BE bytes as signs. An index joins them: each form is filed under one key that a text with the form has
    too, and a text looks up its own distinct keys; only what shares that key is compared. Keys are whole words (what stands between two
    spaces inside the form), three bytes of a run of digits, and runs of three signs for forms without an inner word; texts are cut
    into the last only if there are such forms. Neither side passes through the driver.
    """
    needle = needles.where(F.length("text") >= GRAM).select(F.col(needle_id).cast("bigint").alias(needle_id), (F.col("text") if encoded else F.lower("text")).alias("needle")).distinct()
    forms = needle.select(needle_id, F.explode(_forms(F.col("needle"), encoded)).alias("f")).select(needle_id, "f.*").withColumn("words", _inner_words(F.col("form")))
    by_sign = ~F.col("hex") & (F.size("words") == 0)
    keys = F.when(F.col("hex"), _byte_grams(F.col("form"))).when(by_sign, _grams(F.col("form"))).otherwise(F.col("words"))
    filed = forms.select(needle_id, "form", "low", "hex", by_sign.alias("by_sign"), F.explode(F.array_distinct(keys)).alias("key"))
    held = filed.groupBy("key").agg(F.count("*").alias("n"))
    rarest = F.min_by("key", F.struct("n", -F.length("key"), "key"))  # of equally rare ones the longest
    entries = kept_aside(filed.join(held, "key").groupBy(needle_id, "form", "low", "hex", "by_sign").agg(rarest.alias("key")), "needles")
    signs = entries.where("by_sign").limit(1).count() > 0
    small = entries.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST
    entries = entries.drop("by_sign")

    read = texts.select(text_id, F.col("text").alias("_text"), F.lower("text").alias("_low"))
    of = F.col("_text") if encoded else F.col("_low")
    own = [F.split(of, " "), *([_byte_grams(F.col("_low"))] if encoded else []), *([_grams(of)] if signs else [])]
    each = F.explode(F.array_distinct(F.concat(*own))).alias("key")  # as one expression: a column of keys takes twice the time
    if small:
        met = read.select(text_id, "_text", "_low", each).join(F.broadcast(entries), "key")
    else:  # no text moves with each of its keys
        met = read.select(text_id, each).join(entries, "key").join(read, text_id)
    within = F.when(F.col("low"), F.col("_low")).otherwise(F.col("_text")).contains(F.col("form"))
    aligned = ~F.col("hex") | F.regexp_like("_low", F.concat(F.lit("(?:^|[^0-9a-f])(?:[0-9a-f]{2})*?"), F.col("form")))
    return met.where(within & aligned).select(text_id, needle_id).distinct()


def _inner_words(form: Column) -> Column:
    """What stands between two spaces: every text with ``form`` has these as whole words."""
    words = F.split(form, " ")
    return F.array_remove(F.slice(words, F.lit(2), F.greatest(F.size(words) - 2, F.lit(0))), "")


def _byte_grams(text: Column) -> Column:
    """Three bytes each, from every even digit of the runs of hexadecimal digits on."""
    return F.regexp_extract_all(text, F.lit(r"(?=([0-9a-f]{6}))(?:\G|(?<![0-9a-f]))[0-9a-f]{2}"), F.lit(1))


def _grams(text: Column) -> Column:
    """The runs of three signs."""
    return F.regexp_extract_all(text, F.lit(r"(?s)(?=(...))"), F.lit(1))


def _forms(needle: Column, encoded: bool) -> Column:
    """What to look for: (form, low: in the text in lower case, hex: as digits)."""
    form = lambda text, low, digits: F.struct(text.alias("form"), F.lit(low).alias("low"), F.lit(digits).alias("hex"))
    if not encoded:
        return F.array(form(needle, True, False))
    wide = F.encode(needle, "UTF-16BE")
    return F.array(form(needle, False, False), form(F.decode(wide, "ISO-8859-1"), False, False), form(F.lower(F.hex(F.encode(needle, "UTF-8"))), True, True), form(F.lower(F.hex(wide)), True, True))


def first_meeting_box(targets: DataFrame, boxes: DataFrame) -> DataFrame:
    """page, target, box: the first box (by number) on the page that the target rectangle overlaps."""
    t, b = targets.alias("t"), boxes.alias("b")
    meets = (
        (F.col("t.page") == F.col("b.page"))
        & (F.col("t.x") < F.col("b.x") + F.col("b.w")) & (F.col("b.x") < F.col("t.x") + F.col("t.w"))
        & (F.col("t.y") < F.col("b.y") + F.col("b.h")) & (F.col("b.y") < F.col("t.y") + F.col("t.h"))
    )
    met = t.join(b, meets).select("t.page", "target", "box")
    first = F.row_number().over(Window.partitionBy("page", "target").orderBy("box"))
    return met.withColumn("k", first).where("k = 1").drop("k")


def nearest(value: Column, anchors: list[float]) -> Column:
    """The anchor nearest to ``value``, the first of equals."""
    ranked = F.array(*[F.struct(F.abs(value - a).alias("d"), F.lit(i).alias("i"), F.lit(a).alias("a")) for i, a in enumerate(anchors)])
    return F.array_min(ranked)["a"]
