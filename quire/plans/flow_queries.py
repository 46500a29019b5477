"""Retrieval, sequences, sinks, pipelines and feeds."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from quire.functions import patterns as P
from quire.operators import chunks as C
from quire.operators import fuzzy, learning, pipeline, retrieval, router, sequence
from quire.operators.extraction import any_held, any_of
from quire.sources import opening
from quire.sources.tables import LINES_SQL, PAGES_SQL, documents, lines, page_texts, shared_dir, spread, table
from quire.streaming import feeds

from .registry import query, sql_query

_STOP = "[" + ",".join(f"'{w}'" for w in P.STOPWORDS) + "]"
_BAG = f"list_filter(regexp_split_to_array(regexp_replace(lower(text), '[^a-z0-9 \\t\\n\\x0B\\f\\r]', ' ', 'g'), '[ \\t\\n\\x0B\\f\\r]+'), lambda t: length(t) > 1 AND NOT list_contains({_STOP}, t))"
TERMS = ["license", "copyright", "contact", "thanedble", "erer"]
_BM25 = f"""b AS (SELECT doc_id, {_BAG} AS bag FROM documents), s AS (SELECT count(*) AS docs, avg(len(bag)) AS avg_len FROM b),
 f AS (SELECT doc_id, len(bag) AS n, q, len(list_filter(bag, lambda t: t = q)) AS tf FROM b, (SELECT unnest({TERMS}) AS q)), g AS (SELECT * FROM f WHERE tf > 0), d AS (SELECT q, count(*) AS df FROM g GROUP BY q),
 bm AS (SELECT doc_id, sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * (tf * 2.5) / (tf + 1.5 * (0.25 + 0.75 * n / avg_len))) AS score FROM g JOIN d USING (q), s GROUP BY doc_id)"""
_DOT = "list_dot_product(CAST(embedding AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 0))"


@query(f"WITH {_BM25} SELECT doc_id, round(score, 6) AS score FROM bm")
def ret2_bm25(spark, sf_dir):
    return retrieval.bm25(documents(spark, sf_dir), TERMS).select("doc_id", F.round("score", 6).alias("score"))


@query(f"WITH {_BM25} SELECT doc_id, round(score, 6) AS score FROM bm ORDER BY bm.score DESC, doc_id LIMIT 20")
def top1_bm25(spark, sf_dir):
    return retrieval.top(retrieval.bm25(documents(spark, sf_dir), TERMS), 20).select("doc_id", F.round("score", 6).alias("score"))


@query(f"SELECT vec_id, round({_DOT}, 6) AS score FROM embeddings ORDER BY {_DOT} DESC, vec_id LIMIT 20")
def top2_cosine(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    return retrieval.top(retrieval.scored_by_dot(vectors, retrieval.vector_of(vectors, 0)), 20, "vec_id").select("vec_id", F.round("score", 6).alias("score"))


@query(f"WITH {_BM25}, c AS (SELECT doc_id FROM bm ORDER BY score DESC, doc_id LIMIT 80) SELECT doc_id, round({_DOT}, 6) AS score FROM embeddings JOIN c ON vec_id = doc_id ORDER BY {_DOT} DESC, doc_id LIMIT 20")
def ret4_two_stage(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    return retrieval.two_stage(documents(spark, sf_dir), vectors, TERMS, retrieval.vector_of(vectors, 0)).select("doc_id", F.round("score", 6).alias("score"))


@query("SELECT conv_id, turn, len(regexp_extract_all(text, '(?i)\\b(?:the|and)\\b')) AS marked, len(regexp_split_to_array(text, '(?i)\\b(?:the|and)\\b')) AS plain FROM conversations")
def ret3_highlights(spark, sf_dir):
    pattern = P.java(r"(?i)\b(?:the|and)\b")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.size(F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).cast("bigint").alias("marked"), F.size(F.split("text", pattern, -1)).cast("bigint").alias("plain"))


_ENTRIES = ["redact", "sanitize", "watermark", "outline", "compare", "bookmark", "split", "merge"]


_TYPED = ["santize", "reduct", "watermak", "outlin", "compair", "bokmark", "splitt"]


def _tokens(spark, sf_dir):
    """Words of four signs or more of the turns, and of requests with typing errors (negative numbers)."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text").unionByName(spark.createDataFrame([(-1 - i, 0, f"please {w} it") for i, w in enumerate(_TYPED)], "conv_id long, turn long, text string"))
    plain = F.trim(F.regexp_replace(F.regexp_replace(F.lower("text"), "[’']", ""), "[^a-z0-9]+", " "))
    return turns.select("conv_id", "turn", F.explode(F.split(plain, " ")).alias("word")).where(F.length("word") >= 4)


_TOKENS_SQL = f"""t AS (SELECT conv_id, turn, text FROM conversations UNION ALL SELECT * FROM (VALUES {", ".join(f"({-1 - i}, 0, 'please {w} it')" for i, w in enumerate(_TYPED))}) v(conv_id, turn, text)),
 w AS (SELECT DISTINCT conv_id, turn, unnest(string_split(trim(regexp_replace(regexp_replace(lower(text), '[’'']', '', 'g'), '[^a-z0-9]+', ' ', 'g')), ' ')) AS word FROM t), k AS (SELECT * FROM w WHERE length(word) >= 4), e AS (SELECT unnest({_ENTRIES}) AS entry),
 pairs AS (SELECT word, entry, 1 - damerau_levenshtein(word, entry) / greatest(length(word), length(entry)) AS ratio FROM (SELECT DISTINCT word FROM k), e WHERE abs(length(word) - length(entry)) <= 3)"""


@query(f"WITH {_TOKENS_SQL} SELECT word, entry AS anchor, round(ratio, 9) AS ratio FROM pairs WHERE ratio >= 0.78")
def ret8_fuzzy(spark, sf_dir):
    """Entries like each word of the turns and of requests with typing errors."""
    anchors = spark.createDataFrame([(e,) for e in _ENTRIES], "anchor string")
    return fuzzy.alike(_tokens(spark, sf_dir), anchors).select("word", "anchor", F.round("ratio", 9).alias("ratio"))


@query("""WITH p AS (SELECT DISTINCT p_name AS name FROM part), x AS (SELECT unnest(string_split(name, ' ')) AS word FROM p), v AS (SELECT DISTINCT word FROM x WHERE length(word) >= 4),
 y AS (SELECT DISTINCT substr(word, 1, 2) || substr(word, 4, 1) || substr(word, 3, 1) || substr(word, 5) AS typed FROM v) SELECT typed AS word, word AS anchor, round(1 - damerau_levenshtein(typed, word) / greatest(length(typed), length(word)), 9) AS ratio FROM y, v
 WHERE length(typed) >= 4 AND abs(length(typed) - length(word)) <= 3 AND 1 - damerau_levenshtein(typed, word) / greatest(length(typed), length(word)) >= 0.78""")
def ret8_part_words(spark, sf_dir):
    """Words of the parts' names against the same words with two signs swapped."""
    words = table(spark, sf_dir, "part").select(F.explode(F.split("p_name", " ")).alias("anchor")).where(F.length("anchor") >= 4).distinct()
    typed = words.select(F.concat(F.substring("anchor", 1, 2), F.substring("anchor", 4, 1), F.substring("anchor", 3, 1), F.substring(F.col("anchor"), F.lit(5), F.length("anchor"))).alias("word"))
    return fuzzy.alike(typed, words).select("word", "anchor", F.round("ratio", 9).alias("ratio"))


@query(f"""WITH {_TOKENS_SQL}, b AS (SELECT conv_id, turn, entry, max(ratio) AS score FROM k JOIN pairs USING (word) WHERE ratio >= 0.78 GROUP BY conv_id, turn, entry),
 r AS (SELECT *, row_number() OVER o AS rank, lead(score) OVER o AS next FROM b WINDOW o AS (PARTITION BY conv_id, turn ORDER BY score DESC, entry)),
 d AS (SELECT conv_id, turn, CASE WHEN score >= 0.88 AND (next IS NULL OR score - next >= 0.08 - 1e-12) THEN 'sure' ELSE 'ask' END AS decision FROM r WHERE rank = 1) SELECT conv_id, turn, CAST(rank AS INT) AS rank, entry, round(score, 9) AS score, decision FROM r JOIN d USING (conv_id, turn) WHERE rank <= 3""")
def top4_suggestions(spark, sf_dir):
    """The three likeliest entries of each turn, and whether the first is sure."""
    anchors = spark.createDataFrame([(e, e) for e in _ENTRIES], "entry string, anchor string")
    return fuzzy.suggestions(_tokens(spark, sf_dir), anchors, ["conv_id", "turn"]).select("conv_id", "turn", "rank", "entry", F.round("score", 9).alias("score"), "decision")


_PICKS_SQL = """p AS (SELECT user_id, event_type, ts, event_id, lag(event_type) OVER w AS was, lag(ts) OVER w AS before FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
 g AS (SELECT *, sum(CASE WHEN was = event_type AND ts <= before + INTERVAL {0} THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS island FROM p),
 l AS (SELECT user_id, max(island) AS island FROM g GROUP BY user_id), r AS (SELECT user_id, any_value(event_type) AS event_type, count(*) AS count, max(ts) AS last_at FROM g JOIN l USING (user_id, island) GROUP BY user_id)"""


@query(f"WITH {_PICKS_SQL.format('8 HOURS')} SELECT user_id, event_type, count FROM r")
def ret13_runs(spark, sf_dir):
    """Each user's last choice and how often it was made in a row, with no pause of more than eight hours."""
    return learning.runs(table(spark, sf_dir, "events"), "user_id", "event_type", "ts", "event_id", 8 * 3600).select("user_id", "event_type", "count")


@query(f"WITH {_PICKS_SQL.format('90 DAYS')} SELECT user_id, event_type FROM r WHERE count >= 2 AND TIMESTAMP '2024-04-29 00:00:00' <= last_at + INTERVAL 90 DAYS")
def ret13_learned(spark, sf_dir):
    """What users chose twice in a row and have used within ninety days of a day."""
    now = F.lit("2024-04-29 00:00:00").cast("timestamp_ntz")
    return learning.preferred(table(spark, sf_dir, "events"), "user_id", "event_type", "ts", "event_id", now)


@query("""WITH c AS (SELECT user_id, unnest(['view', 'click', 'signup']) AS lane, unnest([count(*) FILTER (WHERE event_type = 'view'), count(*) FILTER (WHERE event_type = 'click'), count(*) FILTER (WHERE event_type = 'signup')]) AS n, unnest([1, 2, 3]) AS i FROM events GROUP BY user_id),
 r AS (SELECT *, row_number() OVER o AS k, lead(n) OVER o AS next FROM c WINDOW o AS (PARTITION BY user_id ORDER BY n DESC, i)) SELECT user_id, lane AS event_type FROM r WHERE k = 1 AND n >= 2 AND n - coalesce(next, 0) >= 1""")
def ret13_lanes(spark, sf_dir):
    """The lane of three that a user takes most, twice at least and once more than the next."""
    return learning.preferred_lane(table(spark, sf_dir, "events"), "user_id", "event_type", ["view", "click", "signup"])


_SAID = ['find "contract"', "find sensitive contracts", "redact SSNs", "santize", "how much is pro", "is my file uploaded?", "compare two pdfs", "", "count ssn"]
_ROUTES = [(r"^\s*$", "empty"), (r"^(?:find|search)\b.*\"[^\"]+\"", "literal"), (r"^redact\b", "redact"), (r"^find\b", "semantic"), (r"^count\b", "clarify"), (r"^(?:how|what|is|does)\b|\?$", "help"), (r"^(?:compare|merge|split)\b", "action")]


@query("SELECT said, CASE " + " ".join(f"WHEN regexp_matches(said, '{p}') THEN '{r}'" for p, r in _ROUTES) + " ELSE 'search' END AS route FROM (VALUES " + ",".join(f"('{s}')" for s in _SAID) + ") t(said)")
def ret10_routes(spark, sf_dir):
    """The first rule that matches an utterance."""
    from quire.functions.values import chosen

    said = spark.createDataFrame([(s,) for s in _SAID], "said string")
    return said.select("said", chosen([(F.col("said").rlike(p), r) for p, r in _ROUTES], "search").alias("route"))


#: entries that requests can name: (entry, kind, anchor)
_NAMED = [
    ("redact", "tool", "redact"), ("redact", "tool", "black out"), ("sanitize", "tool", "sanitize"), ("sanitize", "tool", "remove metadata"), ("watermark", "tool", "watermark"), ("outline", "tool", "outline"),
    ("compare", "tool", "compare"), ("compare", "tool", "compare versions"), ("bookmarks", "tool", "add bookmarks"), ("split", "tool", "smart split"), ("crop", "tool", "crop pages"),
    ("pricing", "topic", "how much is pro"), ("offline", "topic", "offline"), ("privacy", "topic", "uploaded"), ("models", "topic", "what model"),
]
_ASKED = [
    "santize", "reduct", "watermak", "outlin", "compair versions", "how much is pro", "does it work offline", "is my file uploaded", "what model do you use", "compare two files", "add bookmarks", "crop pages", "smart split",
    'find "contract"', "search for the word John", "find sensitive contracts", "find passages about damages", "find contracts", "redact SSNs", "count ssn", "phone numbers", "summarize this", "regex /a+b/", "", "quite another thing altogether here",
]
_OWNERS = ["redact", "sanitize", "watermark", "outline", "compare", "bookmarks", "split", "crop", "merge", "rotate"]


def _requests(spark, sf_dir):
    """The turns, and requests (negative numbers)."""
    own = spark.createDataFrame([(-1 - i, 0, said) for i, said in enumerate(_ASKED)], "conv_id long, turn long, text string")
    return spread(table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")).unionByName(own)


def _owner_scores(spark, sf_dir):
    """(conv_id, turn, owner, score): cosines of a turn's vector (the one of its conversation's number) and the mean vector of every label."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))
    means = vectors.select("label", F.posexplode("v").alias("i", "x")).groupBy("label", "i").agg(F.avg("x").alias("x")).groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda p: p["x"]).alias("m"))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    owner = F.get(F.array(*map(F.lit, _OWNERS)), (F.col("label") % len(_OWNERS)).cast("int"))
    size = lambda v: F.sqrt(dot(v, v))
    near = vectors.select(F.col("vec_id").alias("conv_id"), "v", size("v").alias("s")).join(F.broadcast(means.select(owner.alias("owner"), "m", size("m").alias("t"))))  # as many means as labels
    scored = near.select("conv_id", "owner", (dot("v", "m") / F.col("s") / F.col("t")).alias("score"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn").join(scored, "conv_id")


def _route_sql() -> str:
    R = router
    q = lambda p: P.re2(p)
    noun = "CASE " + " ".join(f"WHEN regexp_matches(text, '{q(p)}') THEN '{t}'" for p, t in R.NOUNS) + " END"
    tool = lambda kind: "(list_sort(list_filter([" + ", ".join(f"{{'n': {len(a)}, 'i': {-i}, 'a': '{a}', 'e': '{e}'}}" for i, (e, k, a) in enumerate(_NAMED) if k == kind) + "], lambda x: contains(' ' || plain || ' ', ' ' || x.a || ' ')), 'DESC')[1]).e"
    part = lambda p, i=1: f"nullif(trim(regexp_extract(text, '{q(p)}', {i})), '')"
    has = lambda p: f"regexp_matches(text, '{q(p)}')"
    meaning = "(" + " OR ".join(map(has, R.MEANING)) + ")"
    acts = f"({has(R.ACTION)} AND NOT {has(R.FINDING)})"
    bare = f"trim(regexp_replace(regexp_replace(text, '{q(R.FIND)}', ''), '[?.!]+$', ''))"
    skipped = "[" + ", ".join(f"'{w}'" for w in R.SKIPPED) + "]"
    words = lambda c: f"list_filter(string_split(trim(regexp_replace(regexp_replace(lower({c}), '[’'']', '', 'g'), '[^a-z0-9]+', ' ', 'g')), ' '), lambda w: w <> '' AND NOT list_contains({skipped}, w))"
    cases = [
        (f"noun IS NOT NULL AND NOT {has(R.REDACT)}", "noun", "ask", "noun"), ("tool IS NOT NULL", "exact", "tool", "tool"), ("topic IS NOT NULL", "exact", "topic", "topic"), (has(R.ASKING), "verb", "ask", "NULL"),
        (f"{part(R.QUOTED)} IS NOT NULL", "quoted", "literal", part(R.QUOTED)), (has(R.REGEX), "regex", "literal", f"coalesce({part(R.REGEX)}, {part(R.REGEX, 2)})"), (f"{part(R.CUED)} IS NOT NULL", "cued", "literal", part(R.CUED)),
        (f"{has(R.FIND)} AND {meaning} AND NOT {acts}", "meaning", "semantic", f"coalesce(nullif(trim(regexp_replace(text, '{q(R.FIND)}', '')), ''), text)"),
        (f"{has(R.FIND)} AND NOT {meaning} AND NOT {acts} AND {bare} <> '' AND len({words(bare)}) <= 3", "bare", "literal", bare),
    ]
    told = "CASE " + " ".join(f"WHEN {c} THEN {{'stage': '{s}', 'kind': '{k}', 'target': CAST({t} AS VARCHAR), 'score': 1.0::DOUBLE}}" for c, s, k, t in cases) + " END"
    anchors = ", ".join(f"('{e}', '{w}')" for e, k, a in _NAMED if k == "tool" for w in a.split(" ") if len(w) >= 4)
    asked = ", ".join(f"({-1 - i}, 0, '{said}')" for i, said in enumerate(_ASKED))
    owners = "[" + ", ".join(f"'{o}'" for o in _OWNERS) + "]"
    return f"""WITH r AS (SELECT conv_id, turn, trim(text) AS text FROM (SELECT conv_id, turn, text FROM conversations UNION ALL SELECT * FROM (VALUES {asked}) v(conv_id, turn, text))), p AS (SELECT *, trim(regexp_replace(regexp_replace(lower(text), '[’'']', '', 'g'), '[^a-z0-9]+', ' ', 'g')) AS plain FROM r),
 n AS (SELECT *, {noun} AS noun, {tool('tool')} AS tool, {tool('topic')} AS topic FROM p), t AS (SELECT conv_id, turn, text, {told} AS route FROM n), w AS (SELECT DISTINCT conv_id, turn, unnest({words('text')}) AS word FROM t WHERE route IS NULL),
 a AS (SELECT DISTINCT * FROM (VALUES {anchors}) v(entry, anchor)), m AS (SELECT conv_id, turn, entry, max(1 - damerau_levenshtein(word, anchor) / greatest(length(word), length(anchor))) AS score FROM w, a WHERE length(word) >= 4 AND abs(length(word) - length(anchor)) <= 3 GROUP BY ALL),
 f AS (SELECT *, row_number() OVER o AS k, lead(score) OVER o AS next FROM m WHERE score >= 0.78 WINDOW o AS (PARTITION BY conv_id, turn ORDER BY score DESC, entry)), g AS (SELECT conv_id, turn, CASE WHEN score >= 0.88 AND (next IS NULL OR score - next >= 0.08 - 1e-12) THEN 'tool' ELSE 'typo' END AS kind, entry, score FROM f WHERE k = 1),
 e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), u AS (SELECT label, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM e), c AS (SELECT label, list(x ORDER BY i) AS mean FROM (SELECT label, i, avg(x) AS x FROM u GROUP BY label, i) GROUP BY label),
 b AS (SELECT conv_id, owner, score, row_number() OVER o AS k, lead(score) OVER o AS next FROM (SELECT conv_id, {owners}[other % {len(_OWNERS)} + 1] AS owner, max(score) AS score FROM (SELECT e.vec_id AS conv_id, c.label AS other, list_dot_product(v, mean) / sqrt(list_dot_product(v, v)) / sqrt(list_dot_product(mean, mean)) AS score FROM e, c) GROUP BY ALL) WINDOW o AS (PARTITION BY conv_id ORDER BY score DESC, owner)),
 d AS (SELECT conv_id, CASE WHEN score < 0.42 OR score - next < 0.035 THEN 'clarify' ELSE 'tool' END AS kind, CASE WHEN score >= 0.42 THEN owner END AS owner, score FROM b WHERE k = 1)
 SELECT t.conv_id, t.turn, CASE WHEN t.route IS NOT NULL THEN t.route.stage WHEN g.kind IS NOT NULL THEN 'fuzzy' WHEN d.kind IS NOT NULL THEN 'vectors' ELSE 'none' END AS stage, coalesce(t.route.kind, g.kind, d.kind, 'clarify') AS kind,
 CASE WHEN t.route IS NOT NULL THEN t.route.target WHEN g.kind IS NOT NULL THEN g.entry ELSE d.owner END AS target, round(coalesce(t.route.score, g.score, d.score, 0.0), 6) AS score FROM t LEFT JOIN g ON g.conv_id = t.conv_id AND g.turn = t.turn LEFT JOIN d ON d.conv_id = t.conv_id"""


@query(_route_sql())
def ret10_cascade(spark, sf_dir):
    """Where every turn and request goes: by its words, by words like entries' names, by vectors."""
    done = router.routed(_requests(spark, sf_dir), ["conv_id", "turn"], _NAMED, scores=_owner_scores(spark, sf_dir))
    return done.withColumn("score", F.round("score", 6))


sql_query("ret12_fallback", "SELECT conv_id, turn, CASE WHEN trim(text) = '' THEN 'search' WHEN text LIKE '%?' THEN 'question' ELSE 'search' END AS route FROM conversations")
sql_query("ret13_preferences", "WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY user_id, event_type), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) AS k, lead(n) OVER (PARTITION BY user_id ORDER BY n DESC, event_type) AS second FROM c) SELECT user_id, event_type FROM r WHERE k = 1 AND n >= 2 AND n - coalesce(second, 0) >= 1")
sql_query("ret9_thresholds", "SELECT event_id, CASE WHEN value >= 60 THEN 'action' WHEN value >= 50 THEN 'command' WHEN value >= 42 THEN 'assist' ELSE 'none' END AS lane FROM events")
sql_query("ret7_exact_anchor", "WITH a AS (SELECT * FROM (VALUES ('view'), ('error'), ('purchase')) t(needle)), m AS (SELECT e.event_id, a.needle, row_number() OVER (PARTITION BY e.event_id ORDER BY length(a.needle) DESC, a.needle) AS k FROM events e JOIN a ON contains(concat(' ', e.event_type, ' '), concat(' ', a.needle, ' '))) SELECT event_id, needle FROM m WHERE k = 1")


# ---- sources and sinks
@query(f"WITH {PAGES_SQL} SELECT doc_id, page_no, text FROM doc_pages")
def src2_page_texts(spark, sf_dir):
    return page_texts(lines(spark, sf_dir))


@query()
def src3_windows(spark, sf_dir):
    return C.chunks(page_texts(lines(spark, sf_dir)), C.windows_of, 1200, 150)


@query()
def src4_paragraphs(spark, sf_dir):
    pages = table(spark, sf_dir, "documents").select("doc_id", F.lit(1).alias("page_no"), "text")
    return C.chunks(pages, C.paragraphs_of, 300, 120)


def _csv_files(spark, sf_dir):
    """Part of the customers as CSV files with odd cells, written and read again."""
    from quire.sources.tables import read_csv

    folder = f"{shared_dir(spark)}/quire/csv_{uuid.uuid4().hex}"
    rows = table(spark, sf_dir, "customer").select(F.concat(F.lit('a "b", '), F.col("c_name")).alias("name"), F.concat(F.lit("  "), F.col("c_mktsegment"), F.lit(" ")).alias("segment"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_custkey").cast("string")).alias("key"))
    rows.write.csv(folder, header=True, quote='"', escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False, emptyValue="")
    return read_csv(spark, folder)


@query("SELECT 'a \"b\", ' || c_name AS name, c_mktsegment AS segment, CASE WHEN c_custkey % 2 = 0 THEN CAST(c_custkey AS VARCHAR) ELSE '' END AS key FROM customer")
def src5_csv(spark, sf_dir):
    """CSV with quotes, separators and blanks in cells; missing cells are empty."""
    return _csv_files(spark, sf_dir)


@query("SELECT segment, count(*) AS n, count(*) FILTER (WHERE keyed) AS keyed FROM (SELECT c_mktsegment AS segment, c_custkey % 2 = 0 AS keyed FROM customer) GROUP BY segment")
def src6_csv_rows(spark, sf_dir):
    """Rows of CSV files by one of their columns, without rows that are empty throughout."""
    return _csv_files(spark, sf_dir).groupBy("segment").agg(F.count("*").alias("n"), F.count_if(F.col("key") != "").alias("keyed"))


@query(f"WITH {PAGES_SQL} SELECT doc_id, page_no, length(replace(text, ' ', '')) < 20 AS needs_ocr FROM doc_pages")
def src7_pages_to_recognise(spark, sf_dir):
    """Pages with so little text that they would be recognised from their picture."""
    return page_texts(lines(spark, sf_dir)).select("doc_id", "page_no", (F.length(F.replace("text", F.lit(" "))) < 20).alias("needs_ocr"))


sql_query("src1_documents", "SELECT lang, count(*) AS n, min(length(text)) AS shortest, max(length(text)) AS longest FROM documents GROUP BY lang")
sql_query("src8_builder", "SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'BUILDING' ORDER BY c_custkey DESC LIMIT 100")


@query("SELECT p_partkey, '\"' || replace(p_name || ', \"x\"', '\"', '\"\"') || '\",' || p_brand AS line FROM part")
def snk1_csv_lines(spark, sf_dir):
    cell = lambda c: F.when(c.rlike('["\n,]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)
    return table(spark, sf_dir, "part").select("p_partkey", F.concat_ws(",", cell(F.concat(F.col("p_name"), F.lit(', "x"'))), cell(F.col("p_brand"))).alias("line"))


@query("SELECT p_partkey, to_json(struct_pack(brand := p_brand, size := p_size)) AS line FROM part")
def snk3_json_lines(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.to_json(F.struct(F.col("p_brand").alias("brand"), F.col("p_size").alias("size"))).alias("line"))


@query("SELECT doc_id, CASE WHEN k = 1 THEN concat(source, '.pdf') ELSE concat(source, '-', CAST(k AS VARCHAR(20)), '.pdf') END AS name FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM documents) t")
def snk4_unique_names(spark, sf_dir):
    """Names of outputs: those that repeat get numbers, by ranges of the ids."""
    named = sequence.running(table(spark, sf_dir, "documents").select("doc_id", "source"), ["source"], "doc_id", {"k": F.lit(1)})
    return named.select("doc_id", F.when(F.col("k") == 1, F.concat("source", F.lit(".pdf"))).otherwise(F.concat("source", F.lit("-"), F.col("k").cast("string"), F.lit(".pdf"))).alias("name"))




# ---- windows and sequences
@query("SELECT o_orderkey, n AS pages, sum(n) OVER (ORDER BY o_orderkey) - n + 1 AS first_number, sum(n) OVER (ORDER BY o_orderkey) AS last_number FROM (SELECT p_partkey AS o_orderkey, p_size AS n FROM part)".replace("sum(n) OVER (ORDER BY o_orderkey)", "CAST(sum(n) OVER (ORDER BY o_orderkey) AS BIGINT)"))
def win1_continuous_numbers(spark, sf_dir):
    files = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("o_orderkey"), F.col("p_size").alias("pages"))
    return sequence.numbered(files, "o_orderkey", "pages", 1)


sql_query("win2_page_numbers", "SELECT l_orderkey, l_linenumber, 100 + row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS number FROM lineitem")
@query("WITH n AS (SELECT source, doc_id, CAST(ceil(n_chars / 2000.0) AS BIGINT) AS pages FROM documents) SELECT source, doc_id, CAST(2 + coalesce(sum(pages + 1) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS starts FROM n")
def win3_binder_layout(spark, sf_dir):
    """Where each document of a binder starts: after a cover and a sheet for each before it."""
    pages = table(spark, sf_dir, "documents").select("source", "doc_id", F.ceil(F.col("n_chars") / 2000.0).alias("pages"))
    held = sequence.running(pages, ["source"], "doc_id", {"upto": F.col("pages") + 1})
    return held.select("source", "doc_id", (F.col("upto") - F.col("pages") + 1).cast("long").alias("starts"))




@query(f"WITH {LINES_SQL}, b AS (SELECT doc_id, line_no, length(line) < 8 AS blank, lag(length(line) < 8) OVER (PARTITION BY doc_id ORDER BY line_no) AS was FROM lines) SELECT doc_id, line_no FROM b WHERE was AND NOT blank")
def win4_after_blank_runs(spark, sf_dir):
    return sequence.after_gaps(lines(spark, sf_dir), F.length("line") < 8, ["doc_id"], "line_no").select("doc_id", "line_no")


@query("WITH k AS (SELECT user_id, event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS was FROM events) SELECT user_id, event_id, event_type FROM k WHERE was <> event_type")
def win5_key_changes(spark, sf_dir):
    return sequence.key_changes(table(spark, sf_dir, "events"), "event_type", ["user_id"], "event_id").select("user_id", "event_id", "event_type")


sql_query("win6_signed_amounts", "WITH b AS (SELECT o_custkey, o_orderkey, o_totalprice AS amount, sum(CASE WHEN o_orderstatus = 'F' THEN -o_totalprice ELSE o_totalprice END) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS balance FROM orders), d AS (SELECT *, balance - lag(balance) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS delta FROM b) SELECT o_orderkey, CASE WHEN delta IS NULL THEN amount WHEN abs(abs(delta) - amount) <= 0.02 THEN sign(delta) * amount ELSE amount END AS signed FROM d")


@query("""WITH n AS (SELECT conv_id, turn, role, text, count(CASE WHEN role = 'user' THEN 1 END) OVER (PARTITION BY conv_id ORDER BY turn) AS island FROM conversations) SELECT conv_id, island, string_agg(text, ' ' ORDER BY turn) AS joined FROM n GROUP BY conv_id, island""")
def win7_continuations(spark, sf_dir):
    """Turns after a user's turn belong to it."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    turns = table(spark, sf_dir, "conversations").withColumn("island", F.count(F.when(F.col("role") == "user", 1)).over(w))
    held = F.array_sort(F.collect_list(F.struct("turn", "text")))
    return turns.groupBy("conv_id", "island").agg(F.array_join(F.transform(held, lambda x: x["text"]), " ").alias("joined"))


@query(f"WITH {LINES_SQL}, p AS (SELECT *, lag(line) OVER (PARTITION BY doc_id ORDER BY line_no) AS was FROM lines) SELECT doc_id, line_no FROM p WHERE was IS NULL OR was <> line")
def win8_adjacent_repeats(spark, sf_dir):
    before = F.lag("line").over(Window.partitionBy("doc_id").orderBy("line_no"))
    return lines(spark, sf_dir).withColumn("was", before).where("was IS NULL OR was <> line").select("doc_id", "line_no")


@query("WITH r AS (SELECT conv_id, turn, CASE role WHEN 'system' THEN 0 WHEN 'user' THEN 1 ELSE 2 END AS level FROM conversations) SELECT a.conv_id, a.turn, max(b.turn) AS parent FROM r a LEFT JOIN r b ON a.conv_id = b.conv_id AND b.turn < a.turn AND b.level < a.level GROUP BY a.conv_id, a.turn")
def win9_parents(spark, sf_dir):
    level = F.when(F.col("role") == "system", 0).when(F.col("role") == "user", 1).otherwise(2)
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", level.alias("level"))
    return sequence.parents(rows, ["conv_id"], "turn", "level", [0, 1, 2]).select("conv_id", "turn", "parent")


_RUNNING = "sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id DESC ROWS UNBOUNDED PRECEDING)"
@query(f"SELECT source, doc_id FROM (SELECT source, doc_id, lang, {_RUNNING} AS used FROM documents) t WHERE used > 50000 AND lang <> 'fr'")
def win10_evicted(spark, sf_dir):
    """What a budget by source sends away, newest kept first, but for one language."""
    held = sequence.running(table(spark, sf_dir, "documents").select("source", "doc_id", "lang", "n_chars"), ["source"], "doc_id", {"used": F.col("n_chars")}, descending=True)
    return held.where("used > 50000 AND lang <> 'fr'").select("source", "doc_id")




@query(f"SELECT source, doc_id FROM (SELECT source, doc_id, {_RUNNING} AS used, row_number() OVER (PARTITION BY source ORDER BY doc_id DESC) AS k FROM documents) WHERE used <= 50000 AND k <= 10")
def win11_recents(spark, sf_dir):
    return sequence.within_budget(table(spark, sf_dir, "documents"), ["source"], "doc_id", "n_chars", 50000, 10).select("source", "doc_id")


@query("SELECT source, lang, max(doc_id) AS doc_id FROM documents GROUP BY source, lang")
def win12_newest_wins(spark, sf_dir):
    return sequence.kept_last(table(spark, sf_dir, "documents"), ["source", "lang"], [F.desc("doc_id")]).select("source", "lang", "doc_id")


sql_query("win13_ring_buffer", "SELECT event_id FROM (SELECT event_id FROM events ORDER BY event_id DESC LIMIT 1000) t ORDER BY event_id DESC LIMIT 200")


@query("""WITH d AS (SELECT DISTINCT source, doc_id FROM documents), i AS (SELECT *, doc_id - row_number() OVER (PARTITION BY source ORDER BY doc_id) AS island FROM d), e AS (SELECT source, min(doc_id) AS a, max(doc_id) AS b FROM i GROUP BY source, island)
 SELECT source, string_agg(CASE WHEN a = b THEN CAST(a AS VARCHAR) ELSE CAST(a AS VARCHAR) || '–' || CAST(b AS VARCHAR) END, ', ' ORDER BY a) AS pages FROM e GROUP BY source""")
def win15_condensed_pages(spark, sf_dir):
    return sequence.condensed(table(spark, sf_dir, "documents"), ["source"], "doc_id")


@query(f"WITH {PAGES_SQL} SELECT doc_id, page_no FROM doc_pages WHERE page_no IN (1, 2, 3, 5)")
def set3_strict_ranges(spark, sf_dir):
    wanted = [p for group in sequence.strict_ranges("1-3, 5", 10) for p in group]
    return sequence.selected(page_texts(lines(spark, sf_dir)), wanted).select("doc_id", "page_no")


@query(f"WITH {PAGES_SQL} SELECT doc_id, page_no FROM doc_pages WHERE page_no IN (2, 5, 6, 7)")
def set4_lenient_ranges(spark, sf_dir):
    return sequence.selected(page_texts(lines(spark, sf_dir)), sequence.lenient_range("7-5, 2, 99", 10)).select("doc_id", "page_no")


@query(f"WITH {LINES_SQL}, p AS (SELECT DISTINCT doc_id, page_no FROM lines) SELECT doc_id, page_no, CAST(sum(CASE WHEN page_no IN (1, 3, 6) THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY page_no) AS BIGINT) AS part FROM p")
def set6_split_points(spark, sf_dir):
    pages = lines(spark, sf_dir).select("doc_id", "page_no").distinct()
    return sequence.parts_from_breaks(pages, F.col("page_no").isin(3, 6), ["doc_id"], "page_no")


@query(f"WITH {LINES_SQL}, p AS (SELECT DISTINCT doc_id, page_no FROM lines) SELECT doc_id, page_no, page_no AS single, CAST(floor((page_no - 1) / 3) + 1 AS INT) AS by_three, CAST(1 + CASE WHEN page_no >= 2 THEN 1 ELSE 0 END + CASE WHEN page_no >= 5 THEN 1 ELSE 0 END AS BIGINT) AS by_points FROM p")
def set6_split_modes(spark, sf_dir):
    """Each page alone, three pages each, and parts from given points."""
    pages = lines(spark, sf_dir).select("doc_id", "page_no").distinct()
    points = sequence.split_points("5, 2 5", 10)
    by = sequence.every_n(sequence.every_n(pages, 1).withColumnRenamed("part", "single"), 3).withColumnRenamed("part", "by_three")
    return sequence.parts_from_breaks(by, F.col("page_no").isin(points), ["doc_id"], "page_no").withColumnRenamed("part", "by_points")


@query("""WITH p AS (SELECT l_orderkey AS doc, l_linenumber AS page, CAST(CASE WHEN l_linenumber >= 4 THEN 2 ELSE 1 END + CASE WHEN l_linenumber >= 6 THEN 1 ELSE 0 END AS INT) AS part, l_returnflag = 'A' AS out_ FROM lineitem),
 a AS (SELECT doc, greatest(2, length(CAST(count(DISTINCT part) AS VARCHAR))) AS width FROM p GROUP BY doc), h AS (SELECT doc, part, min(page) AS start_page, max(page) AS end_page, count(*) AS pages FROM p WHERE NOT out_ GROUP BY doc, part),
 n AS (SELECT h.*, CAST(row_number() OVER (PARTITION BY doc ORDER BY part) AS INT) AS index, width FROM h JOIN a USING (doc)) SELECT doc, part, index, start_page, end_page, pages, 'file-part' || lpad(CAST(index AS VARCHAR), CAST(width AS INT), '0') AS name FROM n""")
def set8_preview_parts(spark, sf_dir):
    """Parts that begin at pages 4 and 6, without pages returned; empty ones are dropped, names are padded."""
    n = F.col("l_linenumber")
    part = (F.when(n >= 4, 2).otherwise(1) + F.when(n >= 6, 1).otherwise(0)).cast("int")
    pages = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc"), n.alias("page"), part.alias("part"), "l_returnflag")
    return sequence.preview_parts(pages, F.col("l_returnflag") == "A", ["doc"], "file", page="page")


@query(f"WITH {LINES_SQL}, b AS (SELECT DISTINCT doc_id, page_no, 'short' AS why FROM lines WHERE length(line) < 8 AND page_no > 1 UNION SELECT DISTINCT doc_id, page_no, 'caps' FROM lines WHERE page_no > 1 AND regexp_matches(line, '^[A-Z ]+$')) SELECT doc_id, page_no, string_agg(why, ',' ORDER BY why) AS why FROM b GROUP BY doc_id, page_no")
def set7_break_reasons(spark, sf_dir):
    later = lines(spark, sf_dir).where("page_no > 1")
    reasons = F.array_compact(F.array(F.when(F.length("line") < 8, "short"), F.when(F.col("line").rlike("^[A-Z ]+$"), "caps")))
    found = later.select("doc_id", "page_no", F.explode(reasons).alias("why"))
    return found.groupBy("doc_id", "page_no").agg(F.array_join(F.array_sort(F.collect_set("why")), ",").alias("why"))


sql_query("set9_rotated", "SELECT l_orderkey, l_linenumber, (l_linenumber * 90 + 270) % 360 AS rotation FROM lineitem")


# ---- pipelines
_PHONE, _SSN = P.PERSONAL_DATA["phone"], P.PERSONAL_DATA["ssn"]
STEPS = [pipeline.Step("redact-pattern", {"pattern": _PHONE, "mark": "[phone]"}, "sensitive"), pipeline.Step("footer", {"label": "reviewed"}, "privilege"), pipeline.Step("collapse-space", {}, "has-text")]
_ANY = " OR ".join(f"regexp_matches(text, '{P.re2(p)}')" for p in P.PERSONAL_DATA.values())


@query(f"""WITH a AS (SELECT doc_id, CASE WHEN {_ANY} THEN regexp_replace(text, '{_PHONE}', '[phone]', 'g') ELSE text END AS text, CASE WHEN {_ANY} THEN 0 ELSE 1 END AS s FROM documents),
 b AS (SELECT doc_id, CASE WHEN regexp_matches(text, '{P.PRIVILEGE}') THEN text || chr(10) || 'reviewed' ELSE text END AS text, s + CASE WHEN regexp_matches(text, '{P.PRIVILEGE}') THEN 0 ELSE 1 END AS s FROM a),
 c AS (SELECT *, length(regexp_replace(text, '[ \\t\\n\\x0B\\f\\r]+', '', 'g')) >= 20 AS t FROM b)
 SELECT doc_id, sha256(CASE WHEN t THEN trim(regexp_replace(text, '[ \\t]+', ' ', 'g')) ELSE text END) AS digest, s + CASE WHEN t THEN 0 ELSE 1 END AS skipped FROM c""")
def pipe1_conditional_steps(spark, sf_dir):
    done = pipeline.run(documents(spark, sf_dir), STEPS)
    return done.select("doc_id", F.sha2("text", 256).alias("digest"), "skipped")


@query(f"SELECT doc_id, ({_ANY}) AS sensitive, regexp_matches(text, '{P.PRIVILEGE}') AS privilege, strlen(text) / 1048576.0 > 5 AS large FROM documents")
def pipe3_conditions(spark, sf_dir):
    c = lambda name: pipeline.CONDITIONS[name](F.col("text"))
    return documents(spark, sf_dir).select("doc_id", c("sensitive").alias("sensitive"), c("privilege").alias("privilege"), c("size-over").alias("large"))


@query(f"SELECT doc_id, sha256(regexp_replace(text, '{P.PERSONAL_DATA['email']}', '█', 'g')) AS digest FROM documents")
def pipe4_redacted(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", F.sha2(pipeline.redact(F.col("text"), P.PERSONAL_DATA["email"]), 256).alias("digest"))


@query("SELECT CAST(0 AS BIGINT) AS email, CAST(0 AS BIGINT) AS \"ipAddress\"")
def pipe5_gate(spark, sf_dir):
    """Redact, then count what is left: nothing."""
    kept = {k: P.PERSONAL_DATA[k] for k in ("email", "ipAddress")}
    done = documents(spark, sf_dir).withColumn("text", F.when(any_held(F.col("text"), kept), F.regexp_replace("text", any_of(kept), "█")).otherwise(F.col("text")))
    return pipeline.leaks(pipeline.gate(done, kept), kept)


sql_query("pipe7_batch_status", "SELECT source, count(*) FILTER (WHERE n_chars > 0) AS done, count(*) FILTER (WHERE n_chars = 0) AS failed FROM documents GROUP BY source")
sql_query("pipe8_upserts", "WITH u AS (SELECT c_custkey AS id, lower(c_name) AS name, 1 AS version FROM customer UNION ALL SELECT c_custkey AS id, lower(c_name) AS name, 2 AS version FROM customer WHERE c_acctbal > 5000), r AS (SELECT *, row_number() OVER (PARTITION BY id, name ORDER BY version DESC) AS k FROM u) SELECT id, name, version FROM r WHERE k = 1")
sql_query("pipe9_latest_rows", "SELECT user_id, event_type, value FROM (SELECT user_id, event_type, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS k FROM events) t WHERE k = 1")
sql_query("pipe10_mail_merge", "SELECT c_custkey, concat('Dear ', c_name, ', your balance is ', CASE WHEN c_acctbal < 0 THEN 'negative' ELSE 'positive' END, '.') AS letter, concat(lower(c_mktsegment), '_', lpad(CAST(c_custkey AS VARCHAR(20)), 6, '0')) AS file FROM customer")
sql_query("pipe11_smallest", "SELECT o_orderkey, least(o_totalprice, o_totalprice * 0.9 + 100, 200000) AS size FROM orders")


# ---- compared versions and feeds
@query("SELECT a.doc_id, CASE WHEN b.doc_id IS NULL THEN 'missing' WHEN sha256(a.text) = sha256(b.text) THEN 'same' ELSE 'changed' END AS state FROM documents a LEFT JOIN documents b ON b.doc_id = a.doc_id + 1")
def cmp1_versions(spark, sf_dir):
    """Each text against that of the next id, by digest."""
    digests = documents(spark, sf_dir).select("doc_id", F.sha2("text", 256).alias("digest"))
    other = digests.select((F.col("doc_id") - 1).alias("doc_id"), F.col("digest").alias("other"))
    state = F.when(F.col("other").isNull(), "missing").when(F.col("digest") == F.col("other"), "same").otherwise("changed")
    return digests.join(other, "doc_id", "left").select("doc_id", state.alias("state"))


def _streamed(spark, out, name):
    """All rows that the stream has after one pass over its files."""
    sink = f"{name}_{uuid.uuid4().hex}"
    target = f"{shared_dir(spark)}/quire/{sink}"
    out.writeStream.format("parquet").outputMode("append").option("path", target).option("checkpointLocation", f"{target}-state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(out.schema).parquet(target)


@query(f"WITH {LINES_SQL} SELECT doc_id, line_no, unnest(regexp_extract_all(line, '{P.re2(P.PERSONAL_DATA['email'])}')) AS text FROM lines")
def stream1_incremental_hits(spark, sf_dir):
    """Matches of new documents as they arrive."""
    schema = table(spark, sf_dir, "documents").schema
    docs = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/documents.parquet*")
    return _streamed(spark, feeds.hits(docs, {"email": P.PERSONAL_DATA["email"]}).select("doc_id", "line_no", "text"), "hits")


@query("SELECT user_id, max(event_id) AS event_id FROM events GROUP BY user_id")
def stream2_latest(spark, sf_dir):
    """A table that keeps the newest row of each user as events arrive."""
    events = spark.readStream.schema(table(spark, sf_dir, "events").schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/events.parquet*")
    return feeds.kept_table(events, ["user_id"], "event_id", f"{shared_dir(spark)}/quire/latest_{uuid.uuid4().hex}").select("user_id", "event_id")


@query("SELECT CAST(time_bucket(INTERVAL '1 day', ts) AS TIMESTAMP) AS day, event_type, count(*) AS n FROM events GROUP BY ALL")
def stream4_windowed_counts(spark, sf_dir):
    """Events by type and day of event time, in update mode over files that arrive; the last count of each window is kept."""
    events = spark.readStream.schema(table(spark, sf_dir, "events").schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/events.parquet*")
    counts = feeds.windowed_counts(events, "1 day", "2 days").select(F.col("window.start").alias("day"), "event_type", "n")
    return feeds.kept_table(counts, ["day", "event_type"], "n", f"{shared_dir(spark)}/quire/windows_{uuid.uuid4().hex}", "update")




@query("SELECT user_id, coalesce(arg_min(event_type, event_id) FILTER (WHERE event_type IN ('purchase', 'error')), arg_max(event_type, event_id)) AS event_type FROM events GROUP BY user_id")
def stream3_first_terminal(spark, sf_dir):
    return feeds.first_terminal(table(spark, sf_dir, "events"), "user_id", "event_type", "event_id", ["purchase", "error"])


@query("""WITH s AS (SELECT user_id, min(event_id) FILTER (WHERE event_type IN ('purchase', 'error')) AS over, max(event_id) AS last FROM events GROUP BY user_id)
 SELECT s.user_id, e.event_type, e.event_id, over IS NOT NULL AS ended FROM s JOIN events e ON e.user_id = s.user_id AND e.event_id = coalesce(over, last)""")
def stream3_terminal_states(spark, sf_dir):
    """Each user's state as events arrive: the first purchase or error stays, with its place; state is kept by key."""
    events = spark.readStream.schema(table(spark, sf_dir, "events").schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/events.parquet*")
    states = feeds.terminal_states(events, "user_id", "event_type", "event_id", "ts", ["purchase", "error"])
    ranked = states.withColumn("rank", F.col("ended").cast("long") * (1 << 60) + F.col("event_id"))
    return feeds.kept_table(ranked, ["user_id"], "rank", f"{shared_dir(spark)}/quire/states_{uuid.uuid4().hex}", "update").drop("rank")


@query("""SELECT doc_id, CASE WHEN regexp_matches(text, '[0-9]{16}') THEN 'malformed' WHEN lang = 'fr' THEN 'no text' ELSE 'ok' END AS status, CASE WHEN NOT regexp_matches(text, '[0-9]{16}') AND lang <> 'fr' THEN length(text) END AS size FROM documents""")
def src1_quarantine(spark, sf_dir):
    """Documents as lines of JSON, some cut off, some without a text: what can be read, and what is set aside and why."""
    folder = f"{shared_dir(spark)}/quire/json_{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    cut = F.col("text").rlike("[0-9]{16}")
    whole = F.to_json(F.struct("doc_id", F.when(cut | (F.col("lang") != "fr"), F.col("text")).alias("text")))
    docs.select(F.when(cut, F.substring(whole, F.lit(1), F.floor(F.length(whole) / 2).cast("int"))).otherwise(whole).alias("value")).write.text(folder)
    good, bad = opening.split(opening.read_json(spark, folder, "doc_id long, text string"), ["doc_id", "text"])
    named = bad.select(F.regexp_extract("raw", r'"doc_id":(\d+)', 1).cast("long").alias("doc_id"), F.col("reason").alias("status"), F.lit(None).cast("int").alias("size"))
    return good.select("doc_id", F.lit("ok").alias("status"), F.length("text").alias("size")).unionByName(named)


# ---- fragments, votes and flows
@query("""WITH i AS (SELECT l_orderkey AS page, l_linenumber AS n, l_partkey AS p, l_extendedprice AS e, l_linenumber * 10.0 AS x, l_linenumber * 10.0 + l_quantity / 5 AS x1 FROM lineitem),
 g AS (SELECT *, CASE WHEN x - lag(x1) OVER (PARTITION BY page ORDER BY n, p, e) BETWEEN -5 AND 5 THEN 0 ELSE 1 END AS opens FROM i),
 r AS (SELECT *, sum(opens) OVER (PARTITION BY page ORDER BY n, p, e ROWS UNBOUNDED PRECEDING) AS run FROM g) SELECT page, CAST(run AS BIGINT) AS run, count(*) AS fragments, min(x) AS x0, max(x1) AS x1 FROM r GROUP BY page, run""")
def ext10_runs(spark, sf_dir):
    """Fragments of a line that touch make one run: a wide gap opens the next."""
    w = Window.partitionBy("page").orderBy("n", "p", "e")
    x = F.col("l_linenumber") * 10.0
    items = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("p"), F.col("l_extendedprice").alias("e"), x.alias("x"), (x + F.col("l_quantity") / 5).alias("x1"))
    opens = F.when((F.col("x") - F.lag("x1").over(w)).between(-5, 5), 0).otherwise(1)
    runs = items.withColumn("opens", opens).withColumn("run", F.sum("opens").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy("page", "run").agg(F.count("*").alias("fragments"), F.min("x").alias("x0"), F.max("x1").alias("x1"))


_NUMERIC = r"\b(\d{1,2})[/.\-](\d{1,2})[/.\-]\d{2,4}\b"


@query(f"""WITH v AS (SELECT doc_id, len(list_filter(regexp_extract_all(text, '{_NUMERIC}', 1), lambda x: CAST(x AS INT) > 12)) AS day_first, len(list_filter(regexp_extract_all(text, '{_NUMERIC}', 2), lambda x: CAST(x AS INT) > 12)) AS month_first FROM documents)
 SELECT doc_id, CASE WHEN day_first > month_first THEN 'EU' WHEN month_first > day_first THEN 'US' ELSE 'open' END AS locale FROM v""")
def fn5_date_votes(spark, sf_dir):
    """Numbers above twelve tell days from months."""
    votes = lambda i: F.size(F.filter(F.regexp_extract_all("text", F.lit(P.java(_NUMERIC)), F.lit(i)), lambda x: x.cast("int") > 12))
    locale = F.when(votes(1) > votes(2), "EU").when(votes(2) > votes(1), "US").otherwise("open")
    return documents(spark, sf_dir).select("doc_id", locale.alias("locale"))


_FLOWS = [(r"(?i)\b(?:cancel|never mind)\b", "cancel"), (r"(?i)\bredact\b.*\b(?:ssn|phone|email|name|date)s?\b", "redact-category"), (r"(?i)\bredact\b", "redact-term"), (r"(?i)\b(?:split|extract)\b.*\bpages?\b", "pages"), (r"(?i)\b(?:number|stamp|bates)\b", "number")]


@query("SELECT conv_id, turn, CASE " + " ".join(f"WHEN regexp_matches(text, '{p}') THEN '{f}'" for p, f in _FLOWS) + " ELSE 'none' END AS flow FROM conversations")
def ret11_flows(spark, sf_dir):
    """The first flow whose words a turn has."""
    from quire.functions.values import chosen

    return table(spark, sf_dir, "conversations").select("conv_id", "turn", chosen([(F.col("text").rlike(P.java(p)), f) for p, f in _FLOWS], "none").alias("flow"))
