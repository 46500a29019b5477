"""Operators on pages, batches, words, choices and streams, on small tables with odd rows."""

import datetime as dt
import random
import re

import pytest
from pyspark.sql import functions as F

from quire.functions import patterns as P
from quire.functions.text import words_around
from quire.operators import batch, citations, entities, fragments, fuzzy, gate, learning, review, router
from quire.sources import opening
from quire.sources.tables import pages_of
from quire.streaming import feeds

rng = random.Random(3)
ITEMS = "doc_id long, page_no int, items array<struct<item_no:int,str:string,x0:double,x1:double,y:double,h:double>>"


def test_pages(spark):
    docs = spark.createDataFrame([(1, "\n".join(map(str, range(81)))), (2, ""), (3, None)], "doc_id long, text string")
    assert [(r.doc_id, r.page_no, len(r.lines)) for r in pages_of(docs).orderBy("doc_id", "page_no").collect()] == [(1, 1, 40), (1, 2, 40), (1, 3, 1), (2, 1, 1)]


def test_fragments(spark):
    at = lambda n, s, x, y=10.0, h=10.0: (n, s, x, x + 6.0 * len(s), y, h)
    pages = [
        (1, 1, [at(3, "ple.org now", 66.0), at(1, "to bob@", 0.0, 12.0), at(2, "exam", 42.0)]),  # one run, out of order, drawn up and down
        (1, 2, [at(1, "a@b", 0.0), at(2, ".example", 40.0)]),  # a gap opens a run
        (1, 3, [at(1, "ssn: 123-45", 0.0), at(2, "-6789", 66.0, 30.0)]),  # another line
        (1, 4, [at(1, "x;078", 0.0), at(2, "123-45-6789", 30.0), at(3, "1,y", 96.0)]),  # inside one item: the neighbours lose what touches it
        (1, 5, [at(1, "12", 0.0), at(2, " 3", 12.0)]), (2, 1, []), (3, 1, None),
    ]
    found = fragments.fragment_hits(spark.createDataFrame(pages, ITEMS), {k: P.PERSONAL_DATA[k] for k in ("email", "ssn")}).collect()
    assert sorted((r.page_no, r.category, r.item_no, r.start, r.length, r.text) for r in found) == [
        (1, "email", 1, 3, 4, "bob@"), (1, "email", 2, 0, 4, "exam"), (1, "email", 3, 0, 7, "ple.org"), (4, "ssn", 1, 2, 3, "078"), (4, "ssn", 2, 0, 11, "123-45-6789"), (4, "ssn", 3, 0, 1, "1"),
    ]


def test_review_over_lines(spark):
    lines = ["a memo of attorney-", "", "client and not only work", "product", *["plain"] * 8, "under", "seal"]
    pages = spark.createDataFrame([(1, 1, lines), (2, 1, [""]), (3, 1, ["nothing"])], "doc_id long, page_no int, lines array<string>")
    found = [(r.line, r.type, r.text, r.negated) for r in review.findings(pages).orderBy("start").collect()]
    assert found == [(2, "work-product", "work product", False), (12, "confidentiality-legend", "under seal", False), (12, "privilege-phrase", "under seal", False)]
    joined = spark.createDataFrame([(1, 1, ["no attorney", "client privileged and confidential terms"])], "doc_id long, page_no int, lines array<string>")
    assert [(r.type, r.start, r.end, r.negated) for r in review.merged(joined).collect()] == [("attorney-client", 3, 46, True)]


def test_words_around(spark):
    text = " ".join(f"w{i}" for i in range(30))
    at = text.index("15")
    shown = spark.createDataFrame([(text,)], "t string").select(words_around(F.col("t"), F.lit(at), F.lit(at + 1)).alias("w")).first().w
    assert shown.match == "w15" and shown.before == "… " + " ".join(f"w{i}" for i in range(5, 15)) + " " and shown.after == " " + " ".join(f"w{i}" for i in range(16, 26)) + " …"


GATED = "doc_id long, pages array<string>, channels array<struct<vector:string,label:string,text:string>>, targets array<struct<page_no:int,text:string>>"


def test_gate(spark):
    secret = "987-65-4321"
    rows = [
        (1, ["hidden ███", "x"], [], [(1, secret)]), (2, [f"again {secret}", "x"], [], [(1, secret)]), (3, ["███", f"a copy {secret}"], [], [(1, secret)]),
        (4, ["███"], [("form-field", "ssn", f"SSN {secret}"), ("annotation", "note", None)], [(1, secret)]), (5, [secret.encode().hex().upper()], [], [(1, secret)]), (6, ["ab"], [], [(1, "ab"), (9, "gone")]), (7, [], [], []), (8, ["x", secret, f"y {secret}"], [], [(2, secret), (3, secret)]),
    ]
    done = gate.gated(spark.createDataFrame(rows, GATED), "[burned]").orderBy("doc_id").collect()
    assert [(r.doc_id, r.status, r.burned, [(x.vector, x.page_no, x.label) for x in r.leaks], r.removed) for r in done] == [
        (1, "clean", [], [], 1), (2, "burned", [1], [], 1), (3, "blocked", [], [("raw-stream", 2, None)], 1), (4, "blocked", [], [("form-field", None, "ssn")], 1), (5, "burned", [1], [], 1),
        (6, "clean", [], [], 2), (7, "clean", [], [], 0), (8, "burned", [2, 3], [], 2),
    ]
    assert done[1].pages == ["[burned]", "x"]
    sums = gate.leaks_by_vector(gate.gated(spark.createDataFrame(rows, GATED))).first()
    assert (sums.page, sums.form_field, sums.raw_stream, sums.removed) == (0, 1, 1, 9)
    assert gate.enforced(gate.gated(spark.createDataFrame(rows[:2], GATED))).count() == 2
    with pytest.raises(Exception, match=r"1 still present \(1 form-field\)"):
        gate.enforced(gate.gated(spark.createDataFrame(rows[3:4], GATED))).collect()


def test_batches(spark):
    def op(text, n):
        if n == 2:
            raise RuntimeError("broken")
        return text[:n]

    rows = spark.createDataFrame([("abcd", 1), ("abcd", 2), (None, 3), ("", 0)], "text string, n int").withColumn("outcome", batch.guarded(op)(F.col("text"), F.col("n")))
    got = [(r.outcome.status, r.outcome.error, r.outcome.out) for r in rows.collect()]
    assert got[0] == ("done", None, "a") and got[1] == ("error", "broken", None) and got[2][0] == "error" and got[3] == ("done", None, "")
    assert [tuple(r) for r in batch.progress(rows).collect()] == [(4, 2, 2)]
    checked = rows.select(batch.checked(F.when(F.col("n") == 2, F.raise_error(F.lit("fails the job"))).otherwise(F.col("text")), [(F.col("n") == 2, "two"), (F.col("text").isNull(), F.lit("none"))]).alias("o"))
    assert [(r.o.status, r.o.error) for r in checked.collect()] == [("done", None), ("error", "two"), ("error", "none"), ("done", None)]


def test_entities(spark):
    text = "Ann B. Lee met Ann B. Lee's aunt, Roe Inc and Ann. Poe (Roe Inc)"
    raw = [(0, 4, "B-PER", 0.9), (7, 10, "per", 0.5), (34, 41, "ORG", 0.4), (46, 49, "PER", 0.3), (51, 54, "LOC", 0.6), (5, 5, "PER", 0.9), (15, 16, "PER", 0.9), (0, 3, "OTHER", 1.0)]
    rows = spark.createDataFrame([(1, text, raw), (2, "", []), (3, None, None)], "doc_id long, text string, raw array<struct<start:int,end:int,type:string,score:double>>")
    found = {r.doc_id: r.entities for r in entities.processed(rows).collect()}
    assert [(e.start, e.end, e.type, e.text, round(e.score, 6)) for e in found[1]] == [(0, 10, "PER", "Ann B. Lee", 0.5), (15, 25, "PER", "Ann B. Lee", 0.5), (34, 41, "ORG", "Roe Inc", 0.4), (56, 63, "ORG", "Roe Inc", 0.5)]
    assert found[2] == [] and not found[3]
    texts = spark.createDataFrame([(1, text), (2, "Roe Income; roe Inc; Roe Inc"), (3, None)], "doc_id long, text string")
    names = spark.createDataFrame([(7, "Roe Inc"), (8, "Ann. Poe"), (9, "No One")], "name_id long, text string")
    got = sorted((r.doc_id, r.name_id, r.start, r.end) for r in entities.everywhere(texts, names, "doc_id", "name_id").collect())
    assert got == [(1, 7, 34, 41), (1, 7, 56, 63), (1, 8, 46, 54), (2, 7, 21, 28)]


def osa(a, b):
    d = {(i, 0): i for i in range(len(a) + 1)} | {(0, j): j for j in range(len(b) + 1)}
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a), len(b)]


def typed(word):
    for _ in range(rng.randint(0, 5)):
        i = rng.randrange(len(word))
        word = rng.choice([word[:i] + word[i + 1 :], word[:i] + rng.choice("abc") + word[i:], word[:i] + rng.choice("abc") + word[i + 1 :], word[:i] + word[i : i + 2][::-1] + word[i + 2 :]]) or "a"
    return word


def test_fuzzy(spark):
    anchors = ["".join(rng.choice("abcdef") for _ in range(rng.randint(3, 24))) for _ in range(60)]
    words = sorted({typed(a) for a in anchors for _ in range(8)})
    want = {(w, a): 1 - osa(w, a) / max(len(w), len(a)) for w in words for a in set(anchors) if min(len(w), len(a)) >= 4 and abs(len(w) - len(a)) <= 3}
    want = {k: v for k, v in want.items() if v >= 0.78}
    got = {(r.word, r.anchor): r.ratio for r in fuzzy.alike(spark.createDataFrame([(w,) for w in words], "word string"), spark.createDataFrame([(a,) for a in anchors], "anchor string")).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want) and any(len(a) > 17 for _, a in got)


def test_suggestions(spark):
    tokens = spark.createDataFrame([(1, "reduct"), (2, "splitt"), (3, "nothing"), (4, "abcdefghx"), (5, None)], "id long, word string")
    anchors = spark.createDataFrame([("redact", "redact"), ("split", "split"), ("one", "abcdefghi"), ("two", "abcdefghj")], "entry string, anchor string")
    got = sorted((r.id, r["rank"], r.entry, r.decision) for r in fuzzy.suggestions(tokens, anchors, ["id"]).collect())
    assert got == [(1, 1, "redact", "ask"), (2, 1, "split", "ask"), (4, 1, "one", "ask"), (4, 2, "two", "ask")]


def test_learning(spark):
    start, rows = dt.datetime(2024, 1, 1), []
    for key in ("a", "b", "c", "d", None):
        at = start
        for n in range(40):
            at += dt.timedelta(days=rng.choice([0, 1, 3, 20, 89, 90, 91, 200]))
            rows.append((key, rng.choice(["x", "x", "x", "y", None]), at, n))
    want = {}
    for key, choice, at, _ in rows:
        if key and choice:
            before = want.get(key)
            follows = before and before[0] == choice and at <= before[2] + dt.timedelta(days=90)
            want[key] = (choice, before[1] + 1 if follows else 1, at)
    picks = spark.createDataFrame(rows, "key string, choice string, at timestamp_ntz, n int")
    assert {r.key: (r.choice, r["count"], r.last_at) for r in learning.runs(picks, "key", "choice", "at", "n").collect()} == want
    now = max(x[2] for x in want.values())
    kept = {k: v[0] for k, v in want.items() if v[1] >= 2 and now <= v[2] + dt.timedelta(days=90)}
    assert {r.key: r.choice for r in learning.preferred(picks, "key", "choice", "at", "n", F.lit(now)).collect()} == kept


ENTRIES = [("redact", "tool", "redact"), ("sanitize", "tool", "sanitize"), ("outline", "tool", "outline"), ("compare", "tool", "compare"), ("pricing", "topic", "how much is pro")]


def test_routes(spark):
    said = {
        1: ("santize", "fuzzy", "typo", "sanitize"), 2: ("how much is Pro?", "exact", "topic", "pricing"), 3: ('find "contract"', "quoted", "literal", "contract"), 4: ("search for the word John", "cued", "literal", "John"),
        5: ("find sensitive contracts", "meaning", "semantic", "sensitive contracts"), 6: ("find contracts", "bare", "literal", "contracts"), 7: ("redact SSNs", "none", "clarify", None), 8: ("count ssn", "noun", "ask", "ssn"), 9: ("summarise it", "verb", "ask", None),
        10: ("regex /a+b/", "regex", "literal", "a+b"), 11: ("", "vectors", "clarify", None), 12: ("my usual thing", "learned", "tool", "outline"), 13: ("phone numbers", "noun", "literal", "phone"), 14: ("sanitizze", "fuzzy", "tool", "sanitize"), 15: ("quite another thing", "vectors", "tool", "compare"),
    }
    rows = [(i, s[0], None, None) for i, s in said.items()] + [(20, "now redact them", "redact", "John"), (21, "what about it", "outline", None), (22, None, None, None)]
    said |= {20: ("", "staged", "tool", "redact"), 21: ("", "vectors", "tool", "outline")}
    learned = spark.createDataFrame([("my usual thing", "outline")], "k string, e string")
    lanes = spark.createDataFrame([("phone", "literal")], "n string, l string")
    scores = spark.createDataFrame([(11, "redact", 0.9), (11, "compare", 0.89), (15, "compare", 0.5), (15, "compare", 0.1), (15, "redact", 0.2), (21, "redact", 0.41), (21, "outline", 0.39)], "id long, owner string, score double")
    done = router.routed(spark.createDataFrame(rows, "id long, text string, last_entry string, last_find string"), ["id"], ENTRIES, learned, lanes, scores)
    got = {r.id: (r.stage, r.kind, r.target) for r in done.collect()}
    want = {i: s[1:] for i, s in said.items()} | {7: ("exact", "tool", "redact"), 11: ("vectors", "clarify", "redact"), 22: got[22]}
    assert got == want


def test_terminal_states(spark, tmp_path):
    schema = "user long, status string, n long, ts timestamp"
    at = dt.datetime(2024, 1, 1)
    batches = [[(1, "run", 1), (1, "done", 3), (2, "run", 2)], [(1, "failed", 4), (2, "wait", 5), (3, "run", 6)], [(2, "failed", 7), (2, "done", 8), (3, "run", 9)]]
    for i, held in enumerate(batches):
        spark.createDataFrame([(u, s, n, at + dt.timedelta(hours=n)) for u, s, n in held], schema).coalesce(1).write.parquet(str(tmp_path / "in" / str(i)))
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    states = feeds.terminal_states(rows, "user", "status", "n", "ts", ["done", "failed"])
    done = feeds.kept_table(states.withColumn("r", F.col("ended").cast("long") * 1000 + F.col("n")), ["user"], "r", str(tmp_path / "out"), "update")
    assert sorted((r.user, r.status, r.n, r.ended) for r in done.collect()) == [(1, "done", 3, True), (2, "failed", 7, True), (3, "run", 9, False)]


def test_sources_set_aside(spark, tmp_path):
    (tmp_path / "x.json").write_text('{"id": 1, "text": "a"}\n{"id": 2, "te\n{"id": "x", "text": "b"}\n{"id": 4}\n', encoding="utf-8")
    good, bad = opening.split(opening.read_json(spark, str(tmp_path / "x.json"), "id long, text string"), ["id", "text"])
    assert [tuple(r) for r in good.collect()] == [(1, "a")]
    assert sorted((r.reason, r.raw) for r in bad.collect()) == [("malformed", '{"id": "x", "text": "b"}'), ("malformed", '{"id": 2, "te'), ("no text", '{"id":4}')] and all(r.path.endswith("x.json") for r in bad.collect())
    folder = tmp_path / "files"
    folder.mkdir()
    for name, content in {"ok": b"%PDF-1.7 ... %%EOF\n", "locked": b"%PDF-1.7 /Encrypt 5 0 R %%EOF", "cut": b"%PDF-1.7 ..."}.items():
        (folder / f"{name}.pdf").write_bytes(content)
    assert {re.sub(r".*/|\.pdf", "", r.path): (r.status, r.content is None) for r in opening.open_files(spark, str(folder)).collect()} == {"ok": ("ok", False), "locked": ("encrypted", True), "cut": ("malformed", True)}


def test_citations(spark):
    pages = [
        (1, 1, ["See Miranda v. Arizona,", "384 U.S. 436 (1966) and 42 U.S.C. § 1983.", "In re Gault, 387 U.S. 1"]), (1, 2, ["Miranda v. Arizona, 384 U.S. 436 (1966)", "Fed. R. 12 F.3d 5"]), (1, 3, ["[table of authorities]", "Miranda v. Arizona, 384 U.S. 436 (1966) ... 1"]),
        (2, 1, ["", "no 12"]), (3, 1, None),
    ]
    rows = spark.createDataFrame(pages, "doc_id long, page_no int, lines array<string>")
    got = {(r.section, r.display, r.sort_key, tuple(r.pages), r.kind) for r in citations.authorities(rows).collect()}
    assert got == {
        ("cases", "See Miranda v. Arizona, 384 U.S. 436 (1966)", "see miranda v. arizona, 384 u.s. 436 (1966)", (1,), "us-supreme"), ("statutes", "42 U.S.C. § 1983", "42 u.s.c. § 1983", (1,), "us-code"), ("cases", "In re Gault, 387 U.S. 1", "gault, 387 u.s. 1", (1,), "us-supreme"),
        ("cases", "Miranda v. Arizona, 384 U.S. 436 (1966)", "miranda v. arizona, 384 u.s. 436 (1966)", (2,), "us-supreme"), ("cases", "12 F.3d 5", "12 f.3d 5", (2,), "federal-reporter"),
    }
    assert sorted((r.page_no, r.line, r.kind, r.start) for r in citations.citations(rows).collect()) == [(1, 1, "us-code", 24), (1, 1, "us-supreme", 0), (1, 2, "us-supreme", 13), (2, 0, "us-supreme", 20), (2, 1, "federal-reporter", 8)]


def test_page_steps(spark):
    from quire.operators import pipeline

    text = "\n".join([*(["line"] * 40), *([" "] * 40), "last page"])
    docs = spark.createDataFrame([(1, text), (2, "x"), (3, None), (4, "")], "doc_id long, text string")
    run = lambda *steps: {r.doc_id: r.text for r in pipeline.run(docs, [pipeline.Step(*s) for s in steps]).collect()}
    page = "\n".join(["line"] * 40)
    done = run(("drop-blank-pages",), ("page-numbers",))
    assert done[1] == f"{page}\n1 of 2\nlast page\n2 of 2" and done[3] is None
    assert run(("drop-blank-pages",), ("bates", {"prefix": "A", "digits": 3}))[1] == f"{page}\nA001\nlast page\nA002"
    assert run(("drop-blank-pages",))[1] == f"{page}\nlast page" and run(("drop-blank-pages",))[2] == ""
    assert run(("extract-pages", {"pages": "3, 1"}))[1] == f"{page}\nlast page" and run(("extract-pages", {"pages": "all"}))[1] == text
    assert run(("reverse-pages",))[1].startswith("last page\n ") and run(("page-numbers", {"template": "p{i}"}))[2] == "x\np1"
    assert run(("bates", {"first": 8}))[4] == "\n000008"
