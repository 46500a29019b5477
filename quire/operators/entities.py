"""Recognised entities: weak ones go, neighbours join, and every other place of each name is found."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ENTITY = "struct<start:int,end:int,type:string,text:string,score:double>"
#: the least score of a type; others need ``OTHER``
LEAST, OTHER = {"PER": 0.35, "ORG": 0.35}, 0.7
#: types that join and are looked for again, and what may lie between two parts of one name
NAMED = ["PER", "ORG"]
RUN, MOST_BROADCAST = "[A-Za-z0-9]+", 200_000
BETWEEN, MOST_BETWEEN = r"^[\s,'\-]*(?:[A-Z]\.?\s*)?$", 6


def tidied(text: Column, raw: Column, least: dict[str, float] | None = None) -> Column:
    """The entities (``ENTITY``) of known types that are sure enough and two signs long at least, by start, without the spaces around them."""
    known = LEAST if least is None else least
    kind = lambda r: F.regexp_replace(F.upper(r["type"]), "^[BI]-", "")
    trimmed = lambda r: F.regexp_replace(F.substring(text, r["start"] + 1, r["end"] - r["start"]), r"^\s+|\s+$", "")
    clean = F.transform(raw, lambda r: F.struct(r["start"].alias("start"), (r["start"] + F.length(trimmed(r))).alias("end"), kind(r).alias("type"), trimmed(r).alias("text"), r["score"].cast("double").alias("score"), r["end"].alias("last")))

    def stays(e: Column) -> Column:
        bound = F.lit(OTHER)
        for name, value in known.items():
            bound = F.when(e["type"] == name, value).otherwise(bound)
        return e["type"].isin("PER", "ORG", "LOC", "MISC") & (e["start"] >= 0) & (e["last"] > e["start"]) & (F.length(e["text"]) >= 2) & (e["score"] >= bound)

    return F.array_sort(F.transform(F.filter(clean, stays), lambda e: e.dropFields("last"))).cast(f"array<{ENTITY}>")


def joined(text: Column, entities: Column) -> Column:
    """Entities by start, where neighbours of a type in ``NAMED`` with next to nothing between them are one, as sure as the weaker."""

    def step(out: Column, e: Column) -> Column:
        last = F.get(out, F.size(out) - 1)
        between = F.substring(text, last["end"] + 1, e["start"] - last["end"])
        joins = (F.size(out) > 0) & (last["type"] == e["type"]) & e["type"].isin(NAMED) & (e["start"] - last["end"] <= MOST_BETWEEN) & between.rlike(BETWEEN)
        whole = F.regexp_replace(F.substring(text, last["start"] + 1, e["end"] - last["start"]), r"^\s+|\s+$", "")
        both = F.struct(last["start"].alias("start"), e["end"].alias("end"), last["type"].alias("type"), whole.alias("text"), F.least(last["score"], e["score"]).alias("score"))
        return F.when(joins, F.concat(F.slice(out, F.lit(1), F.size(out) - 1), F.array(both))).otherwise(F.concat(out, F.array(e)))

    return F.aggregate(entities, F.array().cast(f"array<{ENTITY}>"), step)


def places(text: Column, name: Column) -> Column:
    """Starts of ``name`` as a whole word in ``text``."""
    pattern = F.concat(F.lit(r"(?<![A-Za-z0-9])\Q"), F.replace(name, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E(?![A-Za-z0-9])"))
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    starts = F.aggregate(gaps, F.array().cast("array<int>"), lambda out, gap: F.concat(out, F.array(F.coalesce(F.get(out, F.size(out) - 1) + F.length(name), F.lit(0)) + gap)))
    return F.when(text.contains(name), F.slice(starts, F.lit(1), F.size(gaps) - 1)).otherwise(F.array().cast("array<int>"))


def swept(text: Column, entities: Column) -> Column:
    """The entities and every further place of the names among them (three signs at least), a tenth less sure but 0.5 at least, by start."""
    named = F.filter(entities, lambda e: e["type"].isin(NAMED) & (F.length(e["text"]) >= 3))
    first = F.filter(named, lambda e, i: ~F.exists(F.slice(named, F.lit(1), i), lambda o: (o["type"] == e["type"]) & (o["text"] == e["text"])))

    def step(out: Column, e: Column) -> Column:
        again = F.transform(places(text, e["text"]), lambda s: F.struct(s.alias("start"), (s + F.length(e["text"])).alias("end"), e["type"].alias("type"), e["text"].alias("text"), F.greatest(F.lit(0.5), e["score"] * 0.9).alias("score")))
        return F.concat(out, F.filter(again, lambda a: ~F.exists(out, lambda o: (o["start"] == a["start"]) & (o["end"] == a["end"]))).cast(f"array<{ENTITY}>"))

    return F.array_sort(F.aggregate(first, entities, step))


def processed(rows: DataFrame, text: str = "text", raw: str = "raw", least: dict[str, float] | None = None, sweep: bool = True) -> DataFrame:
    """The other columns of ``rows`` and entities: what is left of ``raw`` (array of start, end, type, score), joined and, with ``sweep``, looked for again in the row's text."""
    kept = [c for c in rows.columns if c != raw]
    strong = rows.select(*kept, tidied(F.col(text), F.col(raw), least).alias("_strong"))
    whole = strong.select(*kept, joined(F.col(text), F.col("_strong")).alias("_whole"))
    return whole.select(*kept, (swept(F.col(text), F.col("_whole")) if sweep else F.col("_whole")).alias("entities"))


def everywhere(texts: DataFrame, names: DataFrame, text_id: str, name_id: str) -> DataFrame:
    """(text_id, name_id, start, end): all places, as whole words, of every name (name_id, text) in every text (text_id, text).

    Names and texts meet by the first run of letters and digits of a name, which is a whole run wherever the name stands; only keys
    and ids are joined, then each text is read once more for the names that it can hold. Names without such a run are not looked for.
    """
    asked = names.select(name_id, F.col("text").alias("_name"), F.regexp_extract("text", RUN, 0).alias("_run")).where("_run <> ''").distinct()
    filed = asked.groupBy("_run").agg(F.collect_set(F.struct(name_id, "_name")).alias("_names"))
    filed = F.broadcast(filed) if asked.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST else filed
    runs = texts.select(text_id, F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(RUN), F.lit(0)))).alias("_run"))
    held = runs.join(filed, "_run").groupBy(text_id).agg(F.flatten(F.collect_set("_names")).alias("_asked"))
    met = texts.select(text_id, "text").join(held, text_id)
    found = F.flatten(F.transform("_asked", lambda n: F.transform(places(F.col("text"), n["_name"]), lambda s: F.struct(n[name_id].alias(name_id), s.alias("start"), (s + F.length(n["_name"])).alias("end")))))
    return met.select(text_id, F.explode(found).alias("f")).select(text_id, "f.*")
