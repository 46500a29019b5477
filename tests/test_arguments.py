"""Arguments that are wrong are errors before anything runs; right ones read as they should."""

import pytest

from quire.operators import extraction, outline, pipeline, sequence


def test_split_points():
    assert sequence.split_points("5, 2 5", 10) == [2, 5] and sequence.split_points(" ", 10) == []
    for wrong in ("1", "11", "x", "2-3"):
        with pytest.raises(ValueError):
            sequence.split_points(wrong, 10)


def test_keyword_pattern():
    assert extraction.keyword_pattern(" a.b ") == r"(?i)a\.b" and extraction.keyword_pattern("a.b", match_case=True, regex=True) == "a.b"
    assert extraction.keyword_pattern("ab", whole_word=True) == r"(?i)\bab\b"
    with pytest.raises(ValueError):
        extraction.keyword_pattern("(", regex=True)


def test_flatten_refuses(spark):
    texts = spark.createDataFrame([(1, "call 555-123-4567"), (2, "plain"), (3, None)], "doc_id long, text string")
    assert {r.doc_id: r.text for r in pipeline.flatten(texts, clear_sensitive_first=True).collect()} == {1: "", 2: "plain", 3: None}
    assert pipeline.flatten(texts.where("doc_id > 1")).count() == 2
    with pytest.raises(Exception, match="still there"):
        pipeline.flatten(texts).collect()


def test_keyword_hits(spark):
    rows = spark.createDataFrame([(1, 1, 0, "No one. The memo came late! Then"), (1, 1, 1, "memorandum"), (2, 1, 0, None)], "doc_id long, page_no int, line_no int, line string")
    found = lambda **flags: sorted((r.line_no, r.start, r.text) for r in extraction.keyword_hits(rows, "memo", **flags).collect())
    assert found() == [(0, 12, "memo"), (1, 0, "memo")] and found(whole_word=True, scope="line") == [(0, 12, "No one. The memo came late! Then")]
    assert found(whole_word=True, scope="sentence") == [(0, 12, " The memo came late!")]
    assert extraction.keyword_hits(rows, "memo", scope="page").count() == 1 and extraction.keyword_hits(rows, " ").count() == 0


def test_stamp_pattern():
    import re

    known = re.compile(outline.stamp_pattern("ABC-", 6, "X"))
    assert [bool(known.fullmatch(s)) for s in ("ABC000123X", "abc - 0001 23 x", "ABC0001X", "ABC001X", "ABC000000001X")] == [True, True, True, False, False]
