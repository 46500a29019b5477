"""Golden values of the fixtures."""

import re

import pytest
from pyspark.sql import functions as F

from quire.functions import patterns as P
from quire.functions import values as V
from quire.functions.text import spans
from quire.operators import chunks, fuzzy, pipeline, sequence

# What the fixtures say.
GOLDEN = [
    ("ssn", "DOB on file, SSN 123-45-6789 confirmed.", "123-45-6789"),
    ("ssn", "Order #12-34 from 2024.", None),
    ("email", "Contact counsel at Sarah.Kline@acme-law.example.", "Sarah.Kline@acme-law.example"),
    ("phone", "Call (415) 555-0142 to confirm.", "(415) 555-0142"),
    ("phone", "Direct: +1 415.555.0199", "+1 415.555.0199"),
    ("creditCard", "Card on file: 4111 1111 1111 1111.", "4111 1111 1111 1111"),
    ("creditCard", "Card 4111-1111-1111-1111.", "4111-1111-1111-1111"),
    ("iban", "Wire to DE89 3704 0044 0532 0130 00 by Friday.", "DE89 3704 0044 0532 0130 00"),
    ("ipAddress", "Logged from 192.168.10.42 at 09:14.", "192.168.10.42"),
    ("date", "Filed 03/14/2024 and served the same day.", "03/14/2024"),
]


@pytest.mark.parametrize("category,text,expected", GOLDEN)
def test_patterns(spark, category, text, expected):
    row = spark.createDataFrame([(text,)], "t string").select(spans(F.col("t"), P.PERSONAL_DATA[category]).alias("s")).first()
    found = [s.text for s in row.s]
    assert found[:1] == ([expected] if expected else [])
    for s in row.s:
        assert text[s.start : s.start + s.length] == s.text


def test_labels(spark):
    rows = spark.range(1).select(
        *[V.bates(F.lit(n), "ACME").alias(f"b{n}") for n in (1, 100, 1234567)], V.bates(F.lit(7), "X-", "-Z", 4).alias("x"), *[V.letters(F.lit(i)).alias(f"l{i}") for i in (0, 25, 26, 51, 52, 702)]
    ).first()
    assert list(rows) == ["ACME000001", "ACME000100", "ACME1234567", "X-0007-Z", "A", "Z", "AA", "AZ", "BA", "AAA"]


def test_ranges():
    assert sequence.strict_ranges("1-3, 5, 8-", 10) == [[1, 2, 3], [5], [8, 9, 10]]
    for bad in ("5-3", "0", "x", "11"):
        with pytest.raises(ValueError):
            sequence.strict_ranges(bad, 10)
    assert sequence.lenient_range("7-5, 2, 99", 10) == [2, 5, 6, 7]
    assert sequence.lenient_range("all", 3) == [1, 2, 3]


def test_edit_distance(spark):
    pairs = spark.createDataFrame([("reduct", "redact"), ("ab", "ba"), ("ca", "abc"), ("x", "ab")], "a string, b string")
    assert [r[0] for r in pairs.select(fuzzy.distance(F.col("a"), F.col("b"))).collect()] == [1, 1, 3, 2]


def test_chunks():
    text = "One sentence here. " * 200
    parts = chunks.windows_of(text.strip(), 1200, 150)
    assert all(len(p) <= 1200 for p in parts) and parts[0].endswith(".") and "".join(parts).count("One") >= 200
    assert chunks.windows_of("", 10, 2) == [] and chunks.windows_of("short", 10, 2) == ["short"]
    merged = chunks.paragraphs_of("A b.\n\nC d.\n" + "word " * 200, 300, 120)
    assert re.sub(r"\s+", "", "".join(merged)) == re.sub(r"\s+", "", "A b.C d." + "word " * 200)


def test_gate(spark):
    docs = spark.createDataFrame([(1, "mail a.b@c.example now"), (2, None)], "doc_id long, text string")
    kept = {"email": P.PERSONAL_DATA["email"]}
    with pytest.raises(Exception, match="still there"):
        pipeline.gate(docs, kept).collect()
    done = pipeline.run(docs, [pipeline.Step("redact-pattern", {"pattern": kept["email"]}, "sensitive")])
    assert {r.doc_id: r.text for r in pipeline.gate(done, kept).collect() if r.doc_id == 1} == {1: "mail █ now"}


def test_csv(spark, tmp_path):
    from quire.sources.tables import read_csv

    path = tmp_path / "x.csv"
    path.write_text('﻿a , b\n1,"x ""y"", z"\n , \n2,\n', encoding="utf-8")
    assert [tuple(r) for r in read_csv(spark, str(path)).collect() if any(r)] == [("1", 'x "y", z'), ("2", "")]


def test_numbers_over_many_ranges(spark):
    files = spark.createDataFrame([(i * i, i % 7) for i in range(200)], "k long, pages int")
    got = [tuple(r) for r in sequence.numbered(files, "k", "pages", 5, rows_a_range=9).orderBy("k").select("first_number", "last_number").collect()]
    at, want = 5, []
    for i in range(200):
        want.append((at, at + i % 7 - 1))
        at += i % 7
    assert got == want


def test_running_sums(spark):
    import random

    rng = random.Random(4)
    rows = [(rng.choice(["hot", "hot", "hot", "b", None]), rng.choice([rng.randint(0, 300), None]), i, rng.randint(0, 9)) for i in range(900)]
    df = spark.createDataFrame(rows, "k string, o long, t long, v long")
    for descending in (False, True):
        got = {r.t: (r.s, r.n) for r in sequence.running(df, ["k"], "o", {"s": F.col("v"), "n": F.lit(1)}, ["t"], descending, ranges=7).collect()}
        for key in ("hot", "b", None):
            held = sorted((r for r in rows if r[0] == key), key=lambda r: ((r[1] is None) if descending else (r[1] is not None), -(r[1] or 0) if descending else (r[1] or 0), r[2]))
            total = 0
            for n, r in enumerate(held, 1):
                total += r[3]
                assert got[r[2]] == (total, n)
    assert sequence.running(df.limit(0), ["k"], "o", {"s": F.col("v")}).count() == 0
