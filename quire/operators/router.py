"""Routing of requests: a waterfall of ever dearer means, where only what is still open goes on.

What a row alone can tell (learned choices, names of entries, quotes, verbs) is one expression, kept as a table so that each text is
read once; patterns run behind plain words. Edit distances are worked out for the words of open requests only, vectors compared for
what is open then.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import patterns as P
from quire.operators import fuzzy
from quire.sources.tables import kept_aside

#: least score of a vector's best owner, the lead that it needs, and what the subject before adds in a follow-up
LEAST, LEAD, BOOST = 0.42, 0.035, 0.05
ROUTE = "struct<stage:string,kind:string,target:string,score:double>"

# How requests are told apart, as they must be for equal results.
NOUNS = [
    (r"(?i)\b(ssn|social\s+security(?:\s+number)?s?)\b", "ssn"),
    (r"(?i)\bphone(?:\s+numbers?)?\b", "phone"),
    (r"(?i)\bemail(?:\s+address(?:es)?)?\b", "email"),
    (r"(?i)\b(dob|dates?\s+of\s+birth|birthdays?)\b", "dob"),
    (r"(?i)\b(credit\s+card|card\s+numbers?|cc\s+numbers?)\b", "credit card"),
    (r"(?i)\b(account\s+numbers?|bank\s+accounts?)\b", "account"),
    (r"(?i)\b(addresses?|street\s+addresses?|mailing\s+addresses?)\b", "address"),
]
#: words of which each match of these patterns holds one, in small letters; a pattern of signs has the signs
NOUN_WORDS = {"ssn": ["ssn", "social"], "phone": ["phone"], "email": ["email"], "dob": ["dob", "birth"], "credit card": ["credit", "card", "cc"], "account": ["account"], "address": ["address"]}
QUOTED_SIGNS, REGEX_SIGNS, CUED_WORDS = ["\"", "“", "'", "‘"], ["/"], ["word", "phrase", "term", "string", "text", "exact"]
REDACT = r"(?i)\bredact(?:s|ing|ion)?\b"
ASKING = r"(?i)^\s*(?:analy[sz]e|examine|review)\b|^\s*summari[sz]e\b|^\s*(?:extract|pull)\b"
QUOTED = r"[\"“'‘]([^\"”'’]{1,120})[\"”'’]"
REGEX = r"(?i)\bregex\s+/([^/]+)/|^/([^/]+)/[gimsuy]*$"
CUED = r"(?i)\b(?:the\s+)?(?:word|phrase|term|string|text|exact(?:\s+match)?)\s+[\"“'‘]?([\w'\-.]{2,60})[\"”'’]?"
FIND = r"(?i)^\s*(?:find|show|list|search(?:\s+for)?|look\s+for|locate|get\s+me)\b"
MEANING = [
    r"(?i)\b(passages?|clauses?|sections?|paragraphs?|mentions?|references?|discussions?|topics?)\s+(?:about|on|regarding|related\s+to|that|which)\b",
    r"(?i)\b(?:sensitive|confidential|privileged|important|relevant|risky|financial|personal|private|key|critical|material)\s+\w+",
    r"(?i)\b(?:about|regarding|related\s+to|concerning|dealing\s+with)\b",
]
ACTION = (
    r"(?i)\b(add|apply|run|scan|detect|find|search|ask|summari[sz]e|redact|black\s*out|stamp|split|merge|combine|sanitize|scrub|ocr|repair|protect|unlock|sign|fill|convert|hash|compute|"
    r"generate|build|assemble|create|watermark|number)\b"
)
FINDING = r"(?i)^\s*(?:find|show|list|search|look\s+for|locate)\b"
FOLLOWING = r"(?i)^\s*(adjust|change|more|also|and|what\s+about|how\s+about|why|how|can\s+i|does\s+it|is\s+it|is\s+that|then|tell\s+me\s+more|explain|another)\b"
PRONOUN = r"(?i)^\s*(it|that|this|them|those|these)[\s?!.]*$"
TOOLS = (
    r"(?i)\b(redact|bates|sanitize|ocr|watermark|split|merge|organize|extract|rotate|crop|compress|convert|sign|protect|unlock|repair|comments?|highlight|outline|bookmark|compare|toa|citation|"
    r"privilege|exhibit|binder|workflow|chat|mail\s*merge|hash|checksum|header|footer|flatten|batch|image)\b"
)
SKIPPED = (
    "the a an of to for with and or on in my this that these those is are was were be do does did how what why which can i you it please help me us pdf pdfs doc docs document documents file files two"
).split()


def plain(text: Column) -> Column:
    """Lower case, apostrophes gone, all else but letters and digits as single spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), "[’']", ""), "[^a-z0-9]+", " "))


def request_key(text: Column) -> Column:
    """The first six words, by which choices are remembered."""
    return F.array_join(F.slice(F.split(plain(text), " "), F.lit(1), F.lit(6)), " ")


def _words(plain_text: Column) -> Column:
    return F.filter(F.split(plain_text, " "), lambda w: (w != "") & ~w.isin(SKIPPED))


def _named(padded: Column, entries: list[tuple[str, str, str]], kind: str) -> Column:
    """The entry of ``kind`` whose longest anchor (three signs or more) is in the plain request (between spaces) as whole words, the first of equals; else null."""
    out = F.lit(None).cast("string")
    for anchor, entry in sorted(((a, e) for e, k, a in entries if k == kind and len(a) >= 3), key=lambda x: -len(x[0]))[::-1]:
        out = F.when(padded.contains(f" {anchor} "), entry).otherwise(out)
    return out


def _any_of(low: Column, words: list[str]) -> Column:
    """Whether one of ``words`` is in the text in small letters: what a pattern needs, and cheaper."""
    return reduce(lambda a, b: a | b, [low.contains(w) for w in words])


def _by_words(text: Column, low: Column) -> Column:
    """The route (``ROUTE``) that the request's words, and the columns noun, tool, topic, learned and lane, give; null: open."""
    holds = lambda p: text.rlike(P.java(p))
    part = lambda p, i=1: F.nullif(F.trim(F.regexp_extract(text, P.java(p), i)), F.lit(""))
    route = lambda stage, kind, target, score=1.0: F.struct(F.lit(stage).alias("stage"), F.lit(kind).alias("kind"), (target if isinstance(target, Column) else F.lit(target)).cast("string").alias("target"), F.lit(score).alias("score")).cast(ROUTE)
    noun = F.col("_noun")
    meaning = reduce(lambda a, b: a | b, map(holds, MEANING))
    acts = holds(ACTION) & ~holds(FINDING)
    rest = F.trim(F.regexp_replace(text, P.java(FIND), ""))
    bare = F.trim(F.regexp_replace(F.regexp_replace(text, P.java(FIND), ""), r"[?.!]+$", ""))
    sensitive = noun.isNotNull() & ~holds(REDACT)
    cases = [
        (F.col("last_find").isNotNull() & holds(r"(?i)\bredact\b") & holds(r"(?i)\b(them|those|these|it|all|matches|results)\b"), route("staged", "tool", "redact")),
        (F.col("learned").isNotNull(), route("learned", "tool", F.col("learned"))),
        (sensitive & (F.col("lane") == "action"), route("noun", "tool", "redact")),
        (sensitive & (F.col("lane") == "literal"), route("noun", "literal", noun)),
        (sensitive, route("noun", "ask", noun)),
        (F.col("tool").isNotNull(), route("exact", "tool", F.col("tool"))),
        (F.col("topic").isNotNull(), route("exact", "topic", F.col("topic"))),
        (holds(ASKING), route("verb", "ask", None)),
        (_any_of(text, QUOTED_SIGNS) & part(QUOTED).isNotNull(), route("quoted", "literal", part(QUOTED))),
        (_any_of(text, REGEX_SIGNS) & holds(REGEX), route("regex", "literal", F.coalesce(part(REGEX), part(REGEX, 2)))),
        (_any_of(low, CUED_WORDS) & part(CUED).isNotNull(), route("cued", "literal", part(CUED))),
        (holds(FIND) & meaning & ~acts, route("meaning", "semantic", F.coalesce(F.nullif(rest, F.lit("")), text))),
        (holds(FIND) & ~meaning & ~acts & (bare != "") & (F.size(_words(plain(bare))) <= 3), route("bare", "literal", bare)),
    ]
    out = F.lit(None).cast(ROUTE)
    for holds_, there in reversed(cases):
        out = F.when(holds_, there).otherwise(out)
    return out


def _noun(text: Column, low: Column) -> Column:
    out = F.lit(None).cast("string")
    for pattern, term in reversed(NOUNS):
        out = F.when(_any_of(low, NOUN_WORDS[term]) & text.rlike(P.java(pattern)), term).otherwise(out)
    return out


def routed(requests: DataFrame, keys: list[str], entries: list[tuple[str, str, str]], learned: DataFrame | None = None, lanes: DataFrame | None = None, scores: DataFrame | None = None) -> DataFrame:
    """(keys, stage, kind, target, score) of every request (keys, text, and last_entry and last_find: what the one before was about).

    entries: (entry, ``tool`` or ``topic``, anchor as plain words), a bounded list. learned: (request_key, entry); lanes: (noun, lane);
    scores: (keys, owner, score) of vectors. A request that nothing settles is to be clarified.
    """
    none = lambda name: F.col(name) if name in requests.columns else F.lit(None).cast("string")
    text, low = F.col("text"), F.col("_low")
    read = requests.select(*keys, F.trim("text").alias("text"), none("last_entry").alias("last_entry"), none("last_find").alias("last_find"))
    read = read.withColumns({"_low": F.lower(text), "_padded": F.concat(F.lit(" "), plain(text), F.lit(" "))})
    read = read.withColumns({"_key": request_key(text), "_noun": _noun(text, low), "tool": _named(F.col("_padded"), entries, "tool"), "topic": _named(F.col("_padded"), entries, "topic")})
    left = lambda rows, other, on, name: rows.join(other.toDF(on, name), on, "left") if other is not None else rows.withColumn(name, F.lit(None).cast("string"))
    read = left(left(read, learned, "_key", "learned"), lanes, "_noun", "lane")
    follows = F.col("last_entry").isNotNull() & (text != "") & (text.rlike(PRONOUN) | (text.rlike(P.java(FOLLOWING)) & ~text.rlike(P.java(TOOLS))) | ((F.size(_words(plain(text))) <= 3) & ~text.rlike(P.java(TOOLS))))
    told = read.select(*keys, "_padded", "last_entry", follows.alias("follows"), _by_words(text, low).alias("route"))
    words = F.when(F.col("route").isNull() & ~F.col("follows"), _words(F.col("_padded")))
    told = kept_aside(told.select(*keys, "last_entry", "follows", "route", words.alias("words")), "routes")

    words = told.select(*keys, F.explode("words").alias("word"))
    anchors = told.sparkSession.createDataFrame([(e, w) for e, kind, a in entries if kind == "tool" for w in a.split(" ") if len(w) >= fuzzy.SHORTEST], "entry string, anchor string")
    near = fuzzy.suggestions(words, anchors, keys).where("rank = 1")
    near = near.select(*keys, F.struct(F.lit("fuzzy"), F.when(F.col("decision") == "sure", "tool").otherwise("typo"), "entry", "score").cast(ROUTE).alias("_near"))
    done = told.join(near, keys, "left").withColumn("route", F.coalesce("route", "_near")).drop("_near")

    fallback = F.struct(F.lit("none"), F.lit("clarify"), F.lit(None).cast("string"), F.lit(0.0)).cast(ROUTE)
    if scores is not None:
        asked = done.where(F.col("route").isNull()).select(*keys, "follows", "last_entry")
        boosted = F.col("score") + F.when(F.col("follows") & (F.col("owner") == F.col("last_entry")), BOOST).otherwise(0.0)
        pooled = asked.join(scores, keys).withColumn("score", boosted).groupBy(*keys, "follows", "last_entry", "owner").agg(F.max("score").alias("score"))
        order = Window.partitionBy(*keys).orderBy(F.desc("score"), "owner")
        first = pooled.withColumns({"_k": F.row_number().over(order), "_next": F.lead("score").over(order)}).where("_k = 1")
        enough = F.col("score") >= LEAST - F.when(F.col("follows"), BOOST).otherwise(0.0)
        clear = F.col("follows") | F.col("_next").isNull() | (F.col("score") - F.col("_next") >= LEAD)
        kind = F.when(~enough & F.col("follows"), "tool").when(~enough | ~clear, "clarify").otherwise("tool")
        target = F.when(~enough, F.when(F.col("follows"), F.col("last_entry"))).otherwise(F.col("owner"))
        by_vector = first.select(*keys, F.struct(F.lit("vectors"), kind, target, "score").cast(ROUTE).alias("_vector"))
        done = done.join(by_vector, keys, "left").withColumn("route", F.coalesce("route", "_vector"))
    return done.select(*keys, F.coalesce("route", fallback).alias("route")).select(*keys, "route.*")
