"""Ranked search, Merkle manifests and personal data against brute force, on odd tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.llm import merkle, personal_data, queries, ranked_search

from ..compare import compare, connection

rng = random.Random(5)
WORDS = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 4))) for _ in range(50)]


def sentence(n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


PERSONAL = [
    "a@b.c@d.e a@b.c.@d.e @@x@y.z.", "1.2.3.4.5.6.7.8 256.1.1.1 0255.1.1.1 1.1.1.1.", "5 - 4111 1111 1111 1111 4111-1111-1111-1111-1 4111111111111111222 5  4111 1111 1111 1111",
    "+1 (415) 555-0142 +12345678((( +1(((", "x" * 20000 + "@a.b", "1" * 20000, "+1" * 5000, "é 😀 a@b.cd", "SSN: 536-22-1234", "IBAN DE89 3704 0044 0532 0130 00 or DE88 3704 0044 0532 0130 00",
    "Call (415) 555-2671 or write to bob (at) mail.com, Dr. Anna Schmidt", "part no. 536-22-9999/7 and build 078-05-1120",
]
TEXTS = [None, "", " \n ", "Ab\ncD", *PERSONAL, sentence(3000), *[sentence(rng.randint(1, 40)) + "\n" + sentence(3) for _ in range(60)]]
ROWS = [(i if i != 5 else None, t, "hot" if i % 3 else f"s{i % 7}" if i % 2 else None, "en" if i % 4 else None, len(t) if t else None, "clash", 1.0) for i, t in enumerate(TEXTS)]
ROWS += ROWS[3:5] + [(7, "another text of the same id", "hot", None, None, "clash", 0.0)]
SCHEMA = "doc_id long, text string, source string, lang string, n_chars long, leaf string, score double"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def in_threes(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][k : k + 3])) for k in range(0, len(levels[-1]), 3)])
    return levels


def steps(levels, place):
    for level in levels[:-1]:
        first = place // 3 * 3
        yield "".join(level[first:place]), "".join(level[place + 1 : first + 3])
        place //= 3


def manifest_by_hand(rows):
    """The contract's rows, as a bag."""
    shown = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    trees = defaultdict(list)
    for i, text, source, lang, n_chars, *_ in rows:
        lost = text.replace("\n", "") if text is not None and zlib.crc32(str("" if i is None else i).encode()) % 2 == 0 else text
        leaf, tampered = (sha("".join(map(shown, (i, source, lang, n_chars, t)))) for t in (text, lost))
        trees[source].append((i is not None, i or 0, leaf, tampered, i))
    order = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    levels = {s: in_threes([x[2] for x in sorted(trees[s])]) for s in order}
    top = in_threes([levels[s][-1][0] for s in order])
    out, root = Counter(), top[-1][0]
    for g, s in enumerate(order):
        for place, (_, _, leaf, tampered, i) in enumerate(sorted(trees[s])):
            path = [*steps(levels[s], place), *steps(top, g)]
            node = tampered
            for left, right in path:
                node = sha(left + node + right)
            out[i, leaf, levels[s][-1][0], root, sha("".join(a + b for a, b in path)), node, node == root] += 1
    return out


@pytest.mark.parametrize("depth", [1, 2, 6])
def test_manifest(docs, none, depth, monkeypatch):
    monkeypatch.setattr(merkle, "DEPTH", depth)
    monkeypatch.setattr(merkle, "BLOCK", 3**depth)
    monkeypatch.setattr(merkle, "BROADCAST_ROWS", 0 if depth == 2 else 10_000)
    assert Counter(map(tuple, merkle.checked(docs).collect())) == manifest_by_hand(ROWS)
    assert merkle.checked(none).count() == 0
    lone = merkle.checked(docs.where("doc_id = 3 and n_chars > 0").limit(1)).first()
    assert lone.leaf == lone.subroot == lone.root and lone.proof_sha256 == sha("")


def test_manifest_carries(docs):
    rows = docs.select("doc_id", "source", F.sha2(F.coalesce("text", F.lit("")), 256).alias("leaf"), F.col("text").alias("root"))
    done = merkle.manifest(rows, carry=("root",)).select("leaf", "root", "row.root", merkle.folded(F.col("leaf"), F.col("path")).alias("found")).toDF("leaf", "root", "text", "found").collect()
    assert len(done) == len(ROWS) and all(r.found == r.root and r.leaf == sha(r.text or "") for r in done)


def search_by_hand(rows, items, k):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate({65 + c: 97 + c for c in range(26)}))
    held = [(i, words(t)) for i, t, *_ in rows]
    n_docs, total = sum(1 for _, w in held if w), sum(len(w) for _, w in held)
    df = Counter(t for _, w in held for t in set(w))
    asked = defaultdict(set)
    for item, text in items:
        asked[item] |= set(words(text))
    out = []
    for item, terms in asked.items():
        scored = []
        for i, w in held:
            tf, m = Counter(w), 50 + (50 * len(w) * n_docs) // max(1, total)
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * tf[t]) // (1000 * tf[t] + 20 * m)) for t in terms if tf[t])
            if score > 0:
                scored.append((-score, i is None, i or 0, i))
        out += [(item, rank, s[3], -s[0]) for rank, s in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=repr)


@pytest.mark.parametrize(("shard_bytes", "k", "pairs"), [(16 << 20, 50, 10**6), (300, 3, 10**6), (2000, 5, 0)])
def test_search(spark, docs, none, shard_bytes, k, pairs, monkeypatch):
    monkeypatch.setattr(ranked_search, "BROADCAST_PAIRS", pairs)
    monkeypatch.setattr(ranked_search, "BLOCK", 4)
    items = [(1, sentence(8)), (2, "AB cd"), (2, sentence(4)), (3, None), (4, "  "), (5, "absent1"), (None, WORDS[0]), *[(10 + j, sentence(3)) for j in range(9)]]
    asked = spark.createDataFrame([(*x, "clash") for x in items], "item_id long, text string, shard string")
    found = ranked_search.search(ranked_search.indexed(docs, shard_bytes), asked, k).collect()
    assert sorted(map(tuple, found), key=repr) == search_by_hand(ROWS, items, k)
    assert ranked_search.search(ranked_search.indexed(none), asked).count() == 0
    assert ranked_search.search(ranked_search.indexed(docs), asked.limit(0)).count() == 0


def test_selection_keeps_the_first_of_ties():
    for _ in range(200):
        score = np.array([rng.randint(0, 4) for _ in range(rng.randint(1, 30))])
        k = rng.randint(1, 8)
        want = sorted((i for i in range(len(score)) if score[i] > 0), key=lambda i: (-score[i], i))[:k]
        assert sorted(ranked_search.selected(score, k)) == sorted(want)


def base_by_hand(text):
    digits = lambda v: re.sub("[^0-9]", "", v)
    luhn = lambda d: sum(x if i % 2 == 0 else 2 * x - 9 * (2 * x > 9) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0
    kinds = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda v: True), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda v: all(int(x) <= 255 for x in v.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda v: 16 <= len(digits(v)) <= 19 and luhn(digits(v))), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda v: 8 <= len(digits(v)) <= 15),
    ]
    return [f"{k}:{m.start()}:{m.end()}" for k, p, good in kinds for m in re.finditer(p, text) if len(m[0]) < 19999 and good(m[0]) or k == "email"]


def test_personal_base(docs, none):
    done = personal_data.digest(personal_data.detect(docs)).collect()
    want = {i: base_by_hand(t or "") for i, t, *_ in ROWS if i != 7}
    assert len(done) == len(ROWS)
    for r in done:
        if r.doc_id != 7:
            assert r.base_sha256 == sha(",".join(want[r.doc_id])), r
            assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s.startswith(k + ":") for s in want[r.doc_id]) for k in personal_data.BASE]
            assert set(want[r.doc_id]) <= set(r.spans.split(",")) | {""}
    spans = {r.doc_id: r.spans for r in done}
    at = {text[:4]: i for i, text in enumerate(TEXTS) if text}
    assert spans[at["SSN:"]] == "ssn:5:16" and spans[at["IBAN"]] == "iban:5:32" and "local:5:19" in spans[at["Call"]] and "spelled:32:49" in spans[at["Call"]]
    assert personal_data.digest(personal_data.detect(none)).count() == 0
    carried = personal_data.detect(docs, carry=("leaf", "text")).where("doc_id = 12").first()
    assert carried.row.leaf == "clash" and carried.row.text == TEXTS[12] and carried.base == [] and [s.value for s in carried.found] == ["536-22-1234"]


def test_personal_reliabilities(docs):
    """Expectation-maximisation and the classifier's weights, in plain Python over the same votes."""
    held = personal_data.candidates(docs, ())
    counted = [(r.kind, r.code, r.n) for r in personal_data.combinations(held).collect()]
    n, belief = len(personal_data.LABELERS), [[personal_data.BELIEFS[y]] * len(personal_data.LABELERS) for y in (0, 1)]
    worth, share = belief, [0.5] * len(personal_data.KINDS)
    vote = lambda code, j: code // 4**j % 4

    def expected():
        out = {}
        for kind, code, _ in counted:
            logit = math.log(share[kind] / (1 - share[kind])) + sum(math.log(worth[1][j][vote(code, j)] / worth[0][j][vote(code, j)]) for j in range(n) if vote(code, j) < 3)
            out[kind, code] = 1 / (1 + math.exp(-logit))
        return out

    for _ in range(personal_data.ROUNDS):
        p = expected()
        weight = lambda y, kind, code: p[kind, code] if y else 1 - p[kind, code]
        worth = [
            [[(10 * belief[y][j][v] + sum(c * weight(y, k, code) for k, code, c in counted if vote(code, j) == v)) / (10 + sum(c * weight(y, k, code) for k, code, c in counted if vote(code, j) < 3)) for v in range(3)] for j in range(n)]
            for y in (0, 1)
        ]
        share = [(1 + sum(c * p[k, code] for k, code, c in counted if k == kind)) / (2 + sum(c for k, code, c in counted if k == kind)) for kind in range(len(share))]
    p, got = expected(), personal_data.reliabilities(personal_data.combinations(held)).first()
    assert len(got.judged) == len(p) and all(abs(p[j.kind, j.code] - j.p) < 1e-9 for j in got.judged)
    flat = [x for y in (0, 1) for j in range(n) for x in worth[y][j]] + share
    assert np.allclose(flat, got.worth)
    judged = personal_data.reliabilities(personal_data.combinations(held)).select(F.explode("judged").alias("j")).select("j.*")
    weights, counts = personal_data.trained(held, judged), defaultdict(lambda: [0.0, 0.0])
    for (f,) in held.select(F.explode("found")).collect():
        if f.kind >= 4:
            for b in [-1, *f.features]:
                counts[f.kind, b][0] += p[f.kind, f.code]
                counts[f.kind, b][1] += 1 - p[f.kind, f.code]
    assert counts.keys() == weights.keys()
    for (k, b), (pro, con) in counts.items():
        s = (counts[k, -1][0] + 1) / (sum(counts[k, -1]) + 2)
        want = math.log(s / (1 - s)) if b < 0 else math.log((pro + 2 * s) / (con + 2 * (1 - s))) - math.log(s / (1 - s))
        assert abs(weights[k, b] - want) < 1e-9


@pytest.mark.parametrize("name", ["op11_ranked_search", "op12_merkle_manifest"])
def test_same_rows_as_sql(spark, sf_dir, name):
    compare(queries.QUERIES[name](spark, sf_dir), connection(sf_dir), queries.ORACLE_SQL[name])
