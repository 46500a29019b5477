from quire.operators import joins


def test_encoded_needles(spark):
    wide = "Acct 42".encode("utf-16-be")
    rows = [(1, "the Acct 42 here"), (2, "x" + "Acct 42".encode().hex().upper() + "y"), (3, "<" + wide.decode("latin-1") + ">"), (4, "id " + wide.hex()), (5, "acct 42"), (6, "AcA 2 0" + "Acct 42".encode().hex()), (7, None), (8, "")]
    texts = spark.createDataFrame(rows, "doc_id long, text string")
    needles = spark.createDataFrame([(1, "Acct 42"), (2, "no"), (3, None), (4, "\x14\x34\x12")], "item_id long, text string")
    assert sorted(tuple(r) for r in joins.contained_needles(texts, needles, "doc_id", "item_id", encoded=True).collect()) == [(1, 1), (2, 1), (3, 1), (4, 1)]
    assert sorted(tuple(r) for r in joins.contained_needles(texts, needles, "doc_id", "item_id").collect()) == [(1, 1), (5, 1)]
