"""Cases that a reviewer's findings named."""

from quire.operators import outline


def test_stamps_longer_than_a_long(spark):
    rows = [(1, page, page * 100, f"A3197255105974300{5343 + page}") for page in (1, 2)]
    lines = spark.createDataFrame(rows, "doc_id long, page_no int, line_no int, line string").unionByName(spark.createDataFrame([(1, p, p * 100 + i, "x") for p in (1, 2) for i in range(1, 9)], "doc_id long, page_no int, line_no int, line string"))
    found = outline.stamps(lines)
    assert sorted(int(r.number) for r in found.collect()) == [31972551059743005344, 31972551059743005345]
    pages = spark.createDataFrame([(1, 2)], "doc_id long, pages int")
    [best] = outline.best_format(outline.stamp_formats(found, pages)).collect()
    assert (best.prefix, best.digits, best.n, best.score) == ("A", 20, 2, 20 * 2 + 4 * 2 + 18 + 12 + 14 + 8)


def test_shards_move_the_texts_once(spark):
    from quire.llm import sharding

    key = "spark.sql.autoBroadcastJoinThreshold"
    spark.conf.set(key, "-1")  # as where Spark expects a large table
    try:
        done = sharding.shard(spark.createDataFrame([(i, "a text") for i in range(99)], "doc_id long, text string"))
        plan = done._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan
        assert done.count() == 99
    finally:
        spark.conf.unset(key)


def test_typed_columns_are_worked_out_once(spark):
    from quire.operators import tables

    rows = [(1, 0, ["Date", "Atty", "Task", "Act", "Hrs", "Rate", "Value", "Notes"]), (1, 1, ["Jan 5, 24", "AB", "l 110", "a1", "1.5", "$1,200.00", "(300.00)", "x"]), (1, 2, ["5/6/2024", None, "", "", "2 CR", "1.200,5", "3 DR", None])]
    done = tables.time_sheet_rows(spark.createDataFrame(rows, "doc_id long, row_no int, cells array<string>"), 2024)
    assert sorted(tuple(r) for r in done.collect()) == [(1, 1, "2024-01-05", "AB", "L110", "A1", 1.5, 1200.0, -300.0, "x"), (1, 2, "2024-05-06", "", "", "", 2.0, 1200.5, -3.0, "")]
    plan = done._jdf.queryExecution().optimizedPlan().toString()
    assert len(plan) < 150_000 and plan.count("(DR|CR|debit|credit)") <= 6  # each amount reads its text once (before: dozens of times)


def test_chunks_of_null_texts_and_by_slices(spark):
    from quire.operators import chunks

    rows = [(i, 1, "One. " * (i % 90)) for i in range(450)] + [(None, 2, "no id"), (900, 3, None), (901, 4, "")]
    done = chunks.chunks(spark.createDataFrame(rows, "doc_id long, page_no int, text string").coalesce(1), chunks.paragraphs_of, 300, 120).collect()
    want = [(d, p, k, t) for d, p, text in rows for k, t in enumerate(chunks.paragraphs_of(text or "", 300, 120))]
    assert sorted(map(tuple, done), key=repr) == sorted(want, key=repr)


def test_text_in_a_carried_row_is_moved_once(spark):
    import numpy as np
    from pyspark.sql import functions as F

    from quire.llm import toxicity

    model = {"weights": np.linspace(-1, 1, 1 << toxicity.BITS).astype(np.float32), "intercept": 0.1}
    docs = spark.createDataFrame([(i, "some text " * (i % 7)) for i in range(1203)] + [(None, None)], "doc_id long, text string")
    plain = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    held = toxicity.score(docs.select(F.struct("*").alias("_row")), model, ("_row",), inside="_row").collect()
    assert len(held) == 1204 and {r._row.doc_id: r.score for r in held} == plain


def test_any_held_is_the_union(spark):
    from pyspark.sql import functions as F

    from quire.functions import patterns as P
    from quire.operators.extraction import any_held, any_of

    texts = ["a@b.org", "a@b", "@", "1.2.3.4", "1.2.3", "123-45-6789", "call 555 123 4567", "DE89 3704 0044 0532", "01/02/2024", "4111 1111 1111 1111", "x", "", None]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").select(any_held(F.col("text"), P.PERSONAL_DATA).alias("a"), F.col("text").rlike(any_of(P.PERSONAL_DATA)).alias("b")).collect()
    assert all(bool(r.a) == bool(r.b) and (r.a is None) == (r.b is None) for r in rows) and sum(bool(r.a) for r in rows) == 7


def test_requests_are_read_once(spark):
    from pyspark.sql import functions as F

    from quire.operators import router

    read = spark.sparkContext.accumulator(0)

    def seen(text):
        read.add(1)
        return text

    said = ["santize it", "My BIRTHDAYS", "two CC  numbers", "cc card", "a Social\tSecurity number", "list mailing ADDRESSES", "Credit Card", "l’ami dit ‘tout’", "ExACT match word", "quite another thing", None]
    rows = spark.createDataFrame(list(enumerate(said)), "id long, said string").select("id", F.udf(seen, "string").asNondeterministic()("said").alias("text"))
    done = router.routed(rows, ["id"], [("sanitize", "tool", "sanitize")], scores=spark.createDataFrame([(9, "x", 0.5)], "id long, owner string, score double"))
    got = {r.id: (r.stage, r.target) for r in done.collect()}
    nouns = {1: "dob", 2: "credit card", 4: "ssn", 5: "address", 6: "credit card"}
    assert got == {0: ("fuzzy", "sanitize"), 3: ("none", None), 7: ("quoted", "tout"), 8: ("cued", "word"), 9: ("vectors", "x"), 10: ("none", None)} | {i: ("noun", n) for i, n in nouns.items()}
    assert read.value == len(said)


def test_needles_meet_texts_by_whole_words(spark, monkeypatch):
    import random
    import re

    from quire.operators import joins

    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abéX") for _ in range(rng.randint(1, 4)))
    needles = [" ".join(word() for _ in range(rng.randint(3, 6))) for _ in range(25)] + ["a  b c", "x   y", "b\nb a bX", "😀 b 😀a"]
    short = ["abX", "b éa", "😀ab"]

    def texts_of(some):
        texts = ["", None, "a b", "face 616", *(" ".join(word() for _ in range(30)) for _ in range(20))]
        for n in some:
            wide, raw = n.encode("utf-16-be"), n.encode()
            texts += [f"x{n}y", f"{word()} {n} {word()}", n.upper(), wide.decode("latin-1"), f"id:{raw.hex()}", f"0{raw.hex()}", f"ab{wide.hex().upper()}f", f"{wide.hex()[:-1]}", f"g1 {raw.hex()}{raw.hex()}"]
        return list(enumerate(texts))

    def has(text, n, encoded):
        if not encoded:
            return n.lower() in text.lower()
        runs = re.findall("[0-9a-f]+", text.lower())
        digits = lambda h: any(r.startswith(h, i) for r in runs for i in range(0, len(r), 2))
        return n in text or n.encode("utf-16-be").decode("latin-1") in text or digits(n.encode().hex()) or digits(n.encode("utf-16-be").hex())

    for some, encoded, most in ((needles, True, 200_000), (needles + short, True, 200_000), (needles + short, False, 0), (needles, True, 0)):
        monkeypatch.setattr(joins, "MOST_BROADCAST", most)
        rows, items = texts_of(some), list(enumerate(some))
        met = joins.contained_needles(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), "doc_id", "item_id", encoded)
        assert sorted(map(tuple, met.collect())) == [(d, i) for d, t in rows if t is not None for i, n in items if has(t, n, encoded)]
        assert "lambda" not in met._jdf.queryExecution().optimizedPlan().toString()  # no step for each sign, which took most of the time
