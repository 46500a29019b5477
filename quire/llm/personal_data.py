"""Personal data by weak supervision, in DataFrame operations only.

Every text is searched for the base kinds (email, ip, card, phone), which always stay, and for candidates of further kinds:
social security numbers, bank account numbers, phone numbers without a country, spelled-out addresses, names. Labelers of three
sorts vote on every candidate: by its form (regex), by lists of known and reserved values (gazetteer), by the words and signs
around it (context); each says yes, no, nothing, or does not apply to the kind. How often each combination of votes
occurs in the whole corpus goes into expectation-maximisation, which estimates what the votes of every labeler are worth
(how likely each is for personal data and for other strings) and how common personal data is in each kind. The
probabilities of the candidates are soft labels for the final span classifier, which reads shapes and neighbouring words
rather than votes (naive Bayes inside each kind); candidates that score ``least`` or more and overlap no base span are added.

The combinations of votes and the classifier's weights are bounded (``LABELERS``, ``BUCKETS``), whatever the corpus; only they
reach the driver. Texts are read once; a written table keeps the candidates of each row.

Defined cases: a null text is empty; rows that repeat all count and get the same spans; an empty table gives an empty result; texts of
any length are read whole (patterns take their runs possessively, so a long run is read once); of added candidates that overlap,
the one of the earlier kind, then the earlier one stays; extra columns are not read, and those that ``carry`` names come back in
the struct ``row``, so their names cannot clash.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii, small, written
from .secret_scan import spans

#: The contract's kinds and patterns. Runs are taken whole: a local part begins where a run of its signs does, or
#: right after the match before; a card is a whole run of 16 to 19 digits, for runs are maximal.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
HINTS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]"}
OCTETS = r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})(?:\.|$)){4}"

TITLES = ["Mr", "Mrs", "Ms", "Dr", "Prof", "Herr", "Frau", "Mme", "Señor", "Señora"]
GIVEN = (
    "Alexander Alice Andrea Anna Barbara Carlos Carmen Charles Christian Claire Daniel David Elena Elizabeth Emily Emma Francisco François Hans Helen Isabel "
    "James Jean Jennifer John José Juan Julia Karl Laura Linda Louis Lucía Manuel Maria María Marie Mark Martin Mary Michael Miguel Nicolas Olivia Patricia Paul "
    "Peter Pierre Richard Robert Sarah Sofia Sophie Stefan Susan Thomas Ursula William Wolfgang"
).split()
#: further kinds, in the order in which they are preferred
FURTHER = {
    "ssn": r"(?<![0-9A-Za-z.-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "local": r"(?<![0-9+.-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9-])",
    "spelled": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?(?:\(at\)|\[at\])\x20?[A-Za-z0-9-]{1,63}+(?:(?:\.|\x20?(?:\(dot\)|\[dot\])\x20?)[A-Za-z0-9-]{1,63}+){1,4}",
    "name": r"(?<![A-Za-z])(?:(?:%s)\.?\x20[A-ZÀ-Þ][a-zß-ÿ]+(?:\x20[A-ZÀ-Þ][a-zß-ÿ]+)?|(?:%s)\x20[A-ZÀ-Þ][a-zß-ÿ]{2,})(?![a-z])" % ("|".join(TITLES), "|".join(GIVEN)),
}
HINTS |= {"ssn": r"[0-9]-[0-9]{2}-[0-9]", "iban": r"[A-Z]{2}[0-9]{2}", "local": r"[0-9][\x20.-][0-9]{4}", "spelled": r"[(\[]at[)\]]", "name": FURTHER["name"]}
KINDS = [*BASE, *FURTHER]
REACH = 48
SPAN = "array<struct<start:int,rank:int,end:int,value:string>>"

#: lists that labelers look up
TOP_DOMAINS = "com org net edu gov io co info biz eu uk de fr es it nl ch at be us ca au br mx in jp".split()
CALLING = "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98 351 352 353 354 358 420 421".split()
BANKING = "AT BE BG CH CY CZ DE DK EE ES FI FR GB GR HR HU IE IT LT LU LV MT NL NO PL PT RO SE SI SK".split()
RESERVED = {
    "email": r"(?i)@(?:.*\.)?(?:example\.(?:com|org|net)|test|invalid|localhost)$",
    "ip": r"^(?:0|10|127|2[23]\d|24\d|25\d|169\.254|172\.(?:1[6-9]|2\d|3[01])|192\.168|192\.0\.2|198\.51\.100|203\.0\.113)\.",
    "card": r"^(?:4111111111111111|5555555555554444|4242424242424242|(\d)\1*)$",
    "phone": r"55501\d\d$|^(\d)\1*$",
    "ssn": r"^(?:078-05-1120|219-09-9999|123-45-6789|(\d)\1\1-\1\1-\1{4})$",
    "local": r"555.01\d\d$",
}
CUES = {
    "email": r"(?i)\b(?:e-?mail|mail|contact|write|kontakt|correo|courriel|address)\b",
    "ip": r"(?i)\b(?:ip|host|server|address|client|from)\b",
    "card": r"(?i)\b(?:card|visa|mastercard|amex|payment|credit|karte|tarjeta|carte)\b",
    "phone": r"(?i)\b(?:phone|tel|telephone|call|mobile|cell|fax|telefon|tel[ée]fono|rufen)\b",
    "ssn": r"(?i)\b(?:ssn|social\s+security|soc\.?\s+sec)\b",
    "iban": r"(?i)\b(?:iban|account|konto|bank|transfer|wire|cuenta|compte)\b",
    "name": r"(?i)\b(?:name|by|from|dear|contact|attn|signed|sincerely)\b",
}
CUES |= {"local": CUES["phone"], "spelled": CUES["email"]}
OTHERWISE = r"(?i)\b(?:version|isbn|issn|order|invoice|build|sku|part|serial|sha\d*|commit|page|section|ticket|case|model|item|ref|no)\b[.:#]?\s*$|§\s*$"
LABELERS = ["form", "apart", "known", "reserved", "cue", "other", "labelled"]
NO, NOTHING, YES, APART = 0, 1, 2, 3  # APART: the labeler does not apply

#: what votes are taken to be worth before any is seen (no, nothing, yes; of other strings, of personal data) and how many votes that counts as
BELIEFS, STRENGTH, ROUNDS = [[0.5, 0.4, 0.1], [0.1, 0.4, 0.5]], 10.0, 25
#: the classifier's hashed features of each kind, and how many observations a feature needs to outweigh its kind
BUCKETS, DOUBT = 2048, 2.0


def luhn(digits: Column) -> Column:
    """Whether the digits pass Luhn's test: from the end, every second one counts twice, with its own digits added."""
    twice = F.array(*[F.lit(d) for d in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)])
    back = F.transform(F.split(F.reverse(digits), ""), lambda d: d.try_cast("int"))
    return F.aggregate(F.transform(back, lambda d, i: F.when(i % 2 == 1, F.get(twice, d)).otherwise(d)), F.lit(0), lambda a, d: a + F.coalesce(d, F.lit(0))) % 10 == 0


def bank_check(value: Column) -> Column:
    """Whether an account number's remainder by 97 is 1: four signs go to the end, letters count from 10."""
    bare = F.regexp_replace(value, " ", "")
    turned = F.split(F.concat(F.substring(bare, F.lit(5), F.length(bare)), F.substring(bare, 1, 4)), "")
    code = lambda c: F.when(c.rlike("[0-9]"), c.try_cast("int")).otherwise(F.ascii(c) - 55)
    return F.aggregate(turned, F.lit(0), lambda rest, c: F.when(c == "", rest).otherwise((rest * F.when(code(c) > 9, 100).otherwise(10) + code(c)) % 97)) == 1


def digits_of(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def base_spans(text: Column) -> Column:
    """The contract's spans, by kind, then start; matches that fail their test are dropped."""
    good: dict[str, Callable[[Column], Column]] = {
        "email": lambda v: F.lit(True),
        "ip": lambda v: v.rlike(OCTETS),
        "card": lambda v: luhn(digits_of(v)),
        "phone": lambda v: F.length(digits_of(v)).between(8, 15),
    }
    kept = lambda found, test: F.filter(found, lambda s: test(s["value"]))
    return F.concat(*[kept(spans(text, BASE[k], rank, hint=HINTS[k]), good[k]) for rank, k in enumerate(BASE)])


def further_spans(text: Column) -> Column:
    """Candidates of the further kinds; account numbers that fail their test are none."""
    found = {k: spans(text, FURTHER[k], rank, hint=HINTS[k]) for rank, k in enumerate(FURTHER, len(BASE))}
    return F.concat(*(found | {"iban": F.filter(found["iban"], lambda s: bank_check(s["value"]))}).values())


def votes(kind: Column, value: Column, before: Column, after: Column) -> list[Column]:
    """One vote of each labeler, in their order."""
    digits, of = digits_of(value), {k: kind == rank for rank, k in enumerate(KINDS)}

    def by_kind(cases: dict[str, Column]) -> Column:
        out = F.lit(APART)
        for k, vote in cases.items():
            out = F.when(of[k], vote).otherwise(out)
        return out

    yes_no = lambda c: F.when(c, YES).otherwise(NO)
    listed = lambda c, words: F.when(c.isin(words), YES).otherwise(NOTHING)
    seems = lambda c: F.when(c, YES).otherwise(NOTHING)
    ending = F.lower(F.regexp_extract(value, r"([A-Za-z]+)$", 1))
    called = F.regexp_extract(digits, "^(?:%s)" % "|".join(sorted(CALLING, key=len, reverse=True)), 0)
    form = by_kind({
        "email": yes_no(value.rlike(r"\.[A-Za-z]{2,}$")), "ip": yes_no(~value.rlike(r"(?:^|\.)0[0-9]")), "card": yes_no(~value.rlike(r" .*-|-.* ")), "phone": yes_no(F.length(digits) >= 10),
        "ssn": yes_no(~value.rlike(r"^(?:000|666|9)|-00-|-0000$")), "iban": seems(value.rlike(" ")), "local": yes_no(value.rlike(r"^\(?[2-9][0-9]{2}\)?[ .-][2-9]")),
        "spelled": yes_no(ending.isin(TOP_DOMAINS)), "name": seems(value.rlike(r" [^ ]+ ")),
    })
    inside = before.rlike(r"[A-Za-z0-9_=/]$") | after.rlike(r"^[A-Za-z0-9_=/]")
    known = by_kind({
        "email": listed(ending, TOP_DOMAINS), "spelled": listed(ending, TOP_DOMAINS), "card": yes_no(digits.rlike(r"^(?:4|5[1-5]|2[2-7]|3[47]|6011|65|35)")), "phone": yes_no(called != ""),
        "iban": yes_no(F.substring(value, 1, 2).isin(BANKING)), "name": seems(value.rlike("(?:^| )(?:%s)(?: |$)" % "|".join(GIVEN))),
    })
    bare = {"card": digits, "phone": digits}
    reserved = by_kind({k: F.when(bare.get(k, value).rlike(p), NO).otherwise(NOTHING) for k, p in RESERVED.items()})
    cue = by_kind({k: seems(before.rlike(p)) for k, p in CUES.items()})
    other = F.when(before.rlike(OTHERWISE), NO).otherwise(NOTHING)
    return [form, yes_no(~inside), known, reserved, cue, other, seems(before.rlike(r"[:=]\s*$"))]


def features(kind: Column, value: Column, before: Column, after: Column) -> Column:
    """Buckets of what the classifier reads: shape, length, the signs beside and the words around."""
    shape = F.substring(F.regexp_replace(F.regexp_replace(F.regexp_replace(value, "[A-ZÀ-Þ]", "A"), "[a-zß-ÿ]+", "a"), "[0-9]", "9"), 1, 32)
    word = lambda text, pattern: lower_ascii(F.regexp_extract(text, pattern, 1))
    last, last_but_one, following = word(before, r"([A-Za-z]+)[^A-Za-z]*$"), word(before, r"([A-Za-z]+)[^A-Za-z]+[A-Za-z]+[^A-Za-z]*$"), word(after, r"^[^A-Za-z]*([A-Za-z]+)")
    read = [("shape", shape), ("length", F.length(value).cast("string")), ("left", F.substring(before, -1, 1)), ("right", F.substring(after, 1, 1)), ("last", last), ("last but one", last_but_one), ("next", following)]
    return F.array(*[F.pmod(F.xxhash64(F.lit(name), c), F.lit(BUCKETS)).cast("int") for name, c in read])


def candidates(docs: DataFrame, carry: tuple[str, ...]) -> DataFrame:
    """doc_id, row and found (kind, start, end, value, code of the votes, features) of every row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    read = docs.select("doc_id", text.alias("_text"), F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in carry]).alias("row"))

    def judged(s: Column) -> Column:
        """``s`` with its votes and features; what stands around it is cut out once."""
        around = F.array(F.struct(F.substring(F.col("_text"), F.greatest(F.lit(1), s["start"] - REACH + 1), F.least(s["start"], F.lit(REACH))).alias("before"), F.substring(F.col("_text"), s["end"] + 1, F.lit(16)).alias("after")))

        def with_votes(a: Column) -> Column:
            code = sum((v * 4**j for j, v in enumerate(votes(s["rank"], s["value"], a["before"], a["after"]))), F.lit(0))
            return F.struct(s["rank"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"), code.alias("code"), features(s["rank"], s["value"], a["before"], a["after"]).alias("features"))

        return F.transform(around, with_votes)[0]

    return read.select("doc_id", "row", F.transform(F.concat(base_spans(F.col("_text")), further_spans(F.col("_text"))), judged).alias("found"))


def combinations(found: DataFrame) -> DataFrame:
    """(kind, code, n): how many candidates of the corpus have each combination of votes."""
    return found.select(F.explode("found").alias("f")).groupBy("f.kind", "f.code").agg(F.count("*").cast("double").alias("n"))


def reliabilities(counted: DataFrame) -> DataFrame:
    """One row: worth (of labeler j's vote v for class y at (y * labelers + j) * 3 + v, then the share of personal data in each kind) and judged (kind, code, p)."""
    n_labelers, n_kinds = len(LABELERS), len(KINDS)
    decoded = F.transform(F.sequence(F.lit(0), F.lit(n_labelers - 1)), lambda j: F.pmod(F.floor(F.col("code") / F.pow(F.lit(4), j)), F.lit(4)).cast("int"))
    held = counted.select(F.struct("kind", "code", decoded.alias("votes"), "n").alias("c")).agg(F.array_sort(F.collect_list("c")).alias("held"))
    beliefs = [p for y in (0, 1) for _ in LABELERS for p in BELIEFS[y]]
    start = F.array(*[F.lit(p) for p in [*beliefs, *[0.5] * n_kinds]])

    def expected(worth: Column) -> Column:
        def p_of(c: Column) -> Column:
            share = F.get(worth, c["kind"] + 6 * n_labelers)
            ratio = lambda v, j: F.when(v < APART, F.log(F.get(worth, (j + n_labelers) * 3 + v) / F.get(worth, j * 3 + v))).otherwise(0.0)
            logit = F.aggregate(F.transform(c["votes"], ratio), F.log(share / (1 - share)), lambda a, x: a + x)
            return F.struct(c["kind"].alias("kind"), c["code"].alias("code"), c["votes"].alias("votes"), c["n"].alias("n"), (1 / (1 + F.exp(-logit))).alias("p"))

        return F.transform("held", p_of)

    def maximised(judged: Column) -> Column:
        total = lambda weight: F.aggregate(judged, F.lit(0.0), lambda a, c: a + weight(c))

        def worth_of(belief: Column, i: Column) -> Column:
            y, j, v = F.floor(i / (3 * n_labelers)), F.floor(i / 3) % n_labelers, i % 3
            share = lambda c: c["n"] * F.when(y == 1, c["p"]).otherwise(1 - c["p"])
            cast = lambda c: F.get(c["votes"], j.cast("int"))
            return (STRENGTH * belief + total(lambda c: F.when(cast(c) == v, share(c)).otherwise(0.0))) / (STRENGTH + total(lambda c: F.when(cast(c) < APART, share(c)).otherwise(0.0)))

        of_kind = lambda k: (1 + total(lambda c: F.when(c["kind"] == k, c["n"] * c["p"]).otherwise(0.0))) / (2 + total(lambda c: F.when(c["kind"] == k, c["n"]).otherwise(0.0)))
        return F.concat(F.transform(F.array(*map(F.lit, beliefs)), worth_of), F.transform(F.sequence(F.lit(0), F.lit(n_kinds - 1)), of_kind))

    again = lambda worth, _: F.transform(F.array(expected(worth)), maximised)[0]
    done = held.select("held", F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, again).alias("worth"))
    return done.select("worth", F.transform(expected(F.col("worth")), lambda c: F.struct(c["kind"].alias("kind"), c["code"].alias("code"), c["p"].alias("p"))).alias("judged"))


def trained(found: DataFrame, judged: DataFrame) -> dict[tuple[int, int], float]:
    """Weights of the classifier by kind and bucket, at bucket -1 the kind's own log-odds; kinds without a candidate have none."""
    labelled = found.select(F.explode("found").alias("f")).where(F.col("f.kind") >= len(BASE)).select("f.kind", "f.code", "f.features")
    labelled = labelled.join(small(judged, len(KINDS) * 4 ** len(LABELERS)), ["kind", "code"])
    seen = labelled.select("kind", "p", F.explode(F.concat(F.array(F.lit(-1)), "features")).alias("bucket")).groupBy("kind", "bucket").agg(F.sum("p").alias("pro"), F.sum(1 - F.col("p")).alias("con"))
    counts = {(r.kind, r.bucket): (r.pro, r.con) for r in seen.collect()}  # BUCKETS + 1 for each kind at most
    share = {k: (pro + 1) / (pro + con + 2) for (k, b), (pro, con) in counts.items() if b < 0}
    ratio = lambda pro, con, s: math.log((pro + DOUBT * s) / (con + DOUBT * (1 - s))) - math.log(s / (1 - s))
    return {(k, b): math.log(share[k] / (1 - share[k])) if b < 0 else ratio(*counts[k, b], share[k]) for k, b in counts}


def detect(docs: DataFrame, least: float = 0.5, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, base and found (arrays of spans: rank of the kind, start, end, value; found holds the added ones too) and row (a struct of ``carry``)."""
    held = written(candidates(docs, carry), "personal-candidates")
    judged = written(reliabilities(combinations(held)).select(F.explode("judged").alias("j")).select("j.*"), "personal-votes")
    return added(held, trained(held, judged), least)


def added(held: DataFrame, weights: dict[tuple[int, int], float], least: float) -> DataFrame:
    flat = [round(weights.get((k, b), 0.0), 6) for k in range(len(BASE), len(KINDS)) for b in range(-1, BUCKETS)]
    table = F.from_json(F.lit(json.dumps(flat)), "array<double>")
    place = lambda kind, bucket: (kind - len(BASE)) * (BUCKETS + 1) + bucket + 1
    score = lambda f: F.aggregate(f["features"], F.get(table, place(f["kind"], F.lit(-1))), lambda a, b: a + F.get(table, place(f["kind"], b)))
    likely = lambda f: 1 / (1 + F.exp(-score(f))) >= least
    meets = lambda a, b: (a["start"] < b["end"]) & (b["start"] < a["end"])
    plain = lambda f: F.struct(f["kind"].alias("rank"), f["start"].alias("start"), f["end"].alias("end"), f["value"].alias("value"))
    base, rest = F.filter("found", lambda f: f["kind"] < len(BASE)), F.filter("found", lambda f: (f["kind"] >= len(BASE)) & likely(f))
    split = held.select("doc_id", "row", F.transform(base, plain).alias("base"), F.transform(rest, plain).alias("rest"))
    free = F.filter("rest", lambda f: ~F.exists("base", lambda b: meets(b, f)))
    kept = F.aggregate(F.array_sort(free), F.array().cast("array<struct<rank:int,start:int,end:int,value:string>>"), lambda out, f: F.when(F.exists(out, lambda o: meets(o, f)), out).otherwise(F.concat(out, F.array(f))))
    own = F.col("row").dropFields("_") if len(held.schema["row"].dataType) > 1 else F.lit(None)
    return split.select("doc_id", "base", F.array_sort(F.concat("base", kept)).alias("found"), own.alias("row"))


def written_out(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", F.get(F.array(*map(F.lit, KINDS)), s["rank"]), s["start"], s["end"])), ",")


def digest(detected: DataFrame) -> DataFrame:
    """Counts, the digest of the base spans, and all spans written out, by kind, then start."""
    count = lambda k: F.size(F.filter("base", lambda s: s["rank"] == KINDS.index(k))).cast("long").alias(f"n_{k}")
    return detected.select("doc_id", *map(count, BASE), F.sha2(written_out(F.col("base")).cast("binary"), 256).alias("base_sha256"), written_out(F.col("found")).alias("spans"))
