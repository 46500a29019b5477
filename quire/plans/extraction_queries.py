"""Extraction over documents' lines, with the SQL that checks each query."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions import patterns as P
from quire.functions.text import matches, snippet, spans
from quire.operators import extraction as X
from quire.sources.tables import LINES_SQL, PAGES_SQL, documents, kept_aside, lines, page_texts, table

from . import legal_queries
from .legal_queries import spans_sql
from .registry import query

#: words that headings and captions are made of, our own choice; a caller with a longer list gives it instead
NON_NAMES = [
    "accounts", "affidavit", "agenda", "agreement", "amendment", "analysis", "answer", "appeal", "application", "assignment", "attachment", "audit",
    "balance", "bid", "board", "brief", "budget", "bulletin", "calendar", "certificate", "charter", "checklist", "claim", "client", "code",
    "committee", "company", "complaint", "confidential", "contract", "copy", "corporation", "council", "county", "court", "covenant", "credit",
    "date", "deed", "defendant", "delivery", "department", "deposit", "directory", "discovery", "district", "division", "document", "draft",
    "earnings", "equity", "escrow", "estimate", "evidence", "executive", "exhibit", "expenses", "federal", "file", "filing", "finance", "form",
    "general", "guide", "hearing", "inc", "index", "information", "inspection", "insurance", "interest", "inventory", "invoice", "judgment", "jury",
    "lease", "ledger", "letter", "license", "list", "loan", "manual", "memo", "memorandum", "minutes", "mortgage", "motion", "notice", "office",
    "opinion", "order", "page", "part", "patent", "payment", "payroll", "permit", "petition", "plaintiff", "plan", "policy", "price", "project",
    "property", "proposal", "purchase", "question", "receipt", "record", "reference", "register", "release", "report", "request", "response",
    "review", "rule", "sale", "schedule", "section", "security", "service", "settlement", "sheet", "state", "statement", "states", "statute",
    "stipulation", "study", "subject", "subpoena", "summary", "survey", "table", "tax", "term", "testimony", "title", "total", "transcript",
    "treaty", "trial", "trust", "united", "update", "verdict", "volume", "warranty", "witness",
]


def unnested(patterns: dict[str, str], text: str = "line", keys: str = "doc_id, line_no") -> str:
    """SQL: a row for each match of each category."""
    return " UNION ALL ".join(f"SELECT {keys}, '{c}' AS category, unnest(regexp_extract_all({text}, '{P.re2(p)}')) AS text FROM lines" for c, p in patterns.items())


@query(f"WITH {LINES_SQL} {unnested(P.PERSONAL_DATA)}")
def ext1_personal_data(spark, sf_dir):
    """All matches of all categories; overlaps stay."""
    return X.pattern_hits(lines(spark, sf_dir), P.PERSONAL_DATA).select("doc_id", "line_no", "category", "text")


@query(f"WITH {LINES_SQL}, {spans_sql(P.PERSONAL_DATA)} SELECT * FROM spans")
def ext2_offsets(spark, sf_dir):
    return X.pattern_hits(lines(spark, sf_dir), P.PERSONAL_DATA).drop("page_no")


_CAPTION_SQL = f"""WITH {legal_queries.ALL_SQL}, p AS (SELECT doc_id, line_no, unnest(list_concat(regexp_extract_all(line, '{P.re2(P.CAPTION)}', 1), regexp_extract_all(line, '{P.re2(P.CAPTION)}', 2))) AS party FROM lines),
 b AS (SELECT *, list_filter(list_transform(regexp_split_to_array(party, '\\s+'), lambda t: lower(regexp_replace(t, '[.,''’\\-]', '', 'g'))), lambda t: length(t) > 1) AS bare FROM p)
 SELECT doc_id, line_no, party FROM b WHERE NOT (len(bare) > 0 AND len(list_filter(bare, lambda t: NOT list_contains([{",".join(f"'{w}'" for w in NON_NAMES)}], t))) = 0)"""


@query(_CAPTION_SQL)
def ext5_captions(spark, sf_dir):
    from .legal_queries import all_lines

    return X.captions(all_lines(spark, sf_dir), NON_NAMES)


_DIGITS = {k: P.PERSONAL_DATA[k] for k in ("ssn", "phone", "creditCard", "date", "ipAddress")}


@query(
    f"WITH {LINES_SQL.replace('lines AS', 'given AS')}, lines AS (SELECT doc_id, line_no, line FROM given UNION ALL SELECT doc_id, line_no, translate(line, '{P.CONFUSED}', '{P.MEANT}') FROM given), "
    f"{spans_sql(_DIGITS)} SELECT DISTINCT doc_id, line_no, category, start, length FROM spans"
)
def ext6_confused_digits(spark, sf_dir):
    return X.normalised_hits(lines(spark, sf_dir).drop("page_no"), _DIGITS)


@query(
    f"""WITH {LINES_SQL}, {spans_sql({"email": P.PERSONAL_DATA["email"]})}
 SELECT s.doc_id, s.line_no, s.text, regexp_extract(substr(line, 1, start), '[^\\s:;=|,]*$') || s.text || regexp_extract(substr(line, start + length + 1), '^[^\\s:;=|,]*') AS token FROM spans s JOIN lines USING (doc_id, line_no)"""
)
def ext9_whole_tokens(spark, sf_dir):
    """Each e-mail address widened to the next white space or separator on both sides."""
    rows = lines(spark, sf_dir).where(F.col("line").rlike(P.java(P.PERSONAL_DATA["email"])))
    found = rows.select("doc_id", "line_no", "line", F.explode(spans(F.col("line"), P.PERSONAL_DATA["email"])).alias("s"))
    left = F.regexp_extract(F.substring(F.col("line"), F.lit(1), F.col("s.start")), r"[^\s:;=|,]*$", 0)
    right = F.regexp_extract(F.substring(F.col("line"), F.col("s.start") + F.col("s.length") + 1, F.length("line")), r"^[^\s:;=|,]*", 0)
    return found.select("doc_id", "line_no", F.col("s.text").alias("text"), F.concat(left, F.col("s.text"), right).alias("token"))


@query(f"WITH {LINES_SQL} SELECT doc_id, page_no, line_no, CAST(len(regexp_extract_all(line, '(?i)\\blicense\\b')) AS INT) AS n FROM lines WHERE regexp_matches(line, '(?i)\\blicense\\b')")
def ext11_keyword_lines(spark, sf_dir):
    """Whole-word keyword, any case, scope line."""
    pattern = r"(?i)\blicense\b"
    return lines(spark, sf_dir).where(F.col("line").rlike(P.java(pattern))).select("doc_id", "page_no", "line_no", F.size(matches(F.col("line"), pattern)).alias("n"))


@query(f"WITH {PAGES_SQL} SELECT DISTINCT doc_id, page_no FROM doc_pages WHERE contains(lower(text), 'license')")
def ext11_keyword_pages(spark, sf_dir):
    return page_texts(lines(spark, sf_dir)).where(F.lower("text").contains("license")).select("doc_id", "page_no")


@query(
    f"""WITH {PAGES_SQL}, f AS (SELECT doc_id, page_no, text, instr(lower(text), 'license') AS p FROM doc_pages WHERE contains(lower(text), 'license')),
 s AS (SELECT doc_id, page_no, (CASE WHEN p > 31 THEN '…' ELSE '' END) || trim(regexp_replace(substr(text, greatest(1, p - 30), least(length(text), p - 1 + 37) - greatest(1, p - 30) + 1), '\\s+', ' ', 'g')) || (CASE WHEN p + 36 < length(text) THEN '…' ELSE '' END) AS snippet FROM f),
 r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, lower(snippet) ORDER BY page_no) AS k FROM s) SELECT doc_id, page_no, snippet FROM r WHERE k = 1"""
)
def ext12_literal_snippets(spark, sf_dir):
    """The first hit of each page with thirty signs around, each snippet once a document."""
    from pyspark.sql import Window

    pages = page_texts(lines(spark, sf_dir)).where(F.lower("text").contains("license"))
    cut = pages.select("doc_id", "page_no", snippet(F.col("text"), F.instr(F.lower("text"), "license") - 1, F.lit(7), 30).alias("snippet"))
    first = F.row_number().over(Window.partitionBy("doc_id", F.lower("snippet")).orderBy("page_no"))
    return cut.withColumn("k", first).where("k = 1").drop("k")


_TERMS = ["attorney", "privileged", "confidential", "license", "copyright", "password", "secret", "contact", "account", "invoice"]


@query("SELECT term, CAST(sum(len(regexp_extract_all(lower(text), term))) AS BIGINT) AS hits, count(*) AS docs FROM documents JOIN (SELECT unnest([" + ",".join(f"'{t}'" for t in _TERMS) + "]) AS term) ON contains(lower(text), term) GROUP BY term")
def ext13_multi_term_scan(spark, sf_dir):
    """Terms with a hit at least, their hits and documents: one pass over the texts, no join."""
    counts = F.array(*[F.struct(F.lit(t).alias("term"), F.regexp_count(F.lower("text"), F.lit(t)).alias("n")) for t in _TERMS])
    found = documents(spark, sf_dir).select(F.explode(counts).alias("c")).where("c.n > 0")
    return found.groupBy("c.term").agg(F.sum("c.n").alias("hits"), F.count("*").alias("docs"))


@query("""WITH v AS (SELECT page_id, 'url' AS vector, url AS value FROM pages UNION ALL SELECT page_id, 'markup', html FROM pages)
 SELECT DISTINCT page_id, vector, lower(e) AS value FROM (SELECT page_id, vector, unnest(regexp_extract_all(value, '(?i)\\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\\.[A-Z]{2,}\\b')) AS e FROM v)""")
def ext17_side_channels(spark, sf_dir):
    """Addresses in a page's side channels, each once a channel."""
    pages = table(spark, sf_dir, "pages")
    channels = F.array(*[F.struct(F.lit(v).alias("vector"), F.col(c).alias("value")) for v, c in (("url", "url"), ("markup", "html"))])
    found = pages.select("page_id", F.explode(channels).alias("v")).select("page_id", "v.vector", F.explode(matches(F.col("v.value"), P.PERSONAL_DATA["email"])).alias("e"))
    return found.select("page_id", "vector", F.lower("e").alias("value")).distinct()


_LEGAL = ["See Miranda v. Arizona, 384 U.S. 436 (1966) and 42 U.S.C. § 1983.", "123 F. Supp. 2d 456; 410 F.3d 123; 99 N.E.2d 55", "17 So. 3d 900, 384 U. S. 436", "no citation here", "42 U.S.C. §§ 1981-1988(a) and 200 F. 2d 45"]


def _legal(spark):
    return spark.createDataFrame([(i, t) for i, t in enumerate(_LEGAL)], "line_no int, line string").withColumn("doc_id", F.lit(0).cast("bigint"))


_LEGAL_SQL = "lines AS (SELECT CAST(0 AS BIGINT) AS doc_id, line_no, line FROM (VALUES " + ",".join(f"({i}, '{t}')" for i, t in enumerate(_LEGAL)) + ") t(line_no, line))"


@query(
    f"""WITH {_LEGAL_SQL}, {spans_sql(P.CITATIONS)}, r AS (SELECT *, list_position({list(P.CITATIONS)}, category) AS rank FROM spans)
 SELECT doc_id, line_no, category, start, length, text FROM r a WHERE NOT EXISTS (SELECT 1 FROM r b WHERE a.doc_id = b.doc_id AND a.line_no = b.line_no AND b.rank < a.rank AND b.start < a.start + a.length AND a.start < b.start + b.length)"""
)
def ext18_citations(spark, sf_dir):
    """Citations of five kinds; where two overlap, the more specific kind."""
    return X.first_by_priority(X.pattern_hits(_legal(spark), P.CITATIONS), ["doc_id", "line_no"], list(P.CITATIONS))


@query("SELECT doc_id, 'https://scholar.google.com/scholar?q=' || replace(url_encode(source || ' ' || lang), '+', '%20') AS url FROM documents")
def ext19_lookup_urls(spark, sf_dir):
    query_text = F.replace(F.url_encode(F.concat_ws(" ", "source", "lang")), F.lit("+"), F.lit("%20"))
    return table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("https://scholar.google.com/scholar?q="), query_text).alias("url"))


@query(f"SELECT page_id, unnest(regexp_extract_all(url || ' ' || html, '{P.re2(P.URL)}')) AS link FROM pages")
def ext20_links(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.explode(matches(F.concat_ws(" ", "url", "html"), P.URL)).alias("link"))


@query("SELECT page_id, unnest(regexp_extract_all(html, '<(?:h1|h2|p|title|li|a)[^>]*>([^<]+)<', 1)) AS value FROM pages")
def ext23_markup_values(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.explode(matches(F.col("html"), r"<(?:h1|h2|p|title|li|a)[^>]*>([^<]+)<", 1)).alias("value"))




@query()
def ext3_names(spark, sf_dir):
    """Names by title case or, with a signal in the line, in capitals (EXT4)."""
    from quire.operators.names import names

    return names(lines(spark, sf_dir), NON_NAMES)


@query()
def win14_reconstructed_tables(spark, sf_dir):
    """Cells out of positioned words: each line's words at the places that they have in print."""
    from quire.operators.tables import reconstructed

    words = lines(spark, sf_dir).where(F.col("line").contains("|")).select("doc_id", "page_no", "line_no", F.posexplode(F.split("line", r" \| ")).alias("k", "str"))
    items = words.where("str <> ''").select("doc_id", "page_no", "str", (F.col("k") * 120.0).alias("x"), (F.col("line_no") * 12.0).alias("y"), (F.length("str") * 5.0).alias("w"), F.lit(10.0).alias("h"))
    return reconstructed(items)


@query()
def fn26_bank_rows(spark, sf_dir):
    """Every customer's orders as a statement, parsed back into typed transactions."""
    from pyspark.sql import Window

    from quire.operators.tables import bank_rows

    orders = table(spark, sf_dir, "orders")
    own = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    signed = F.when(F.col("o_orderstatus") == "F", -F.col("o_totalprice")).otherwise(F.col("o_totalprice"))
    money = lambda c: F.format_number(c, 2)
    rows = orders.withColumn("balance", F.sum(signed).over(own)).select(
        F.col("o_custkey").alias("doc_id"), F.row_number().over(own).alias("row_no"),
        F.array(F.date_format("o_orderdate", "MM/dd/yyyy"), F.concat(F.lit("transfer "), F.col("o_orderpriority")), money("o_totalprice"), money("balance")).alias("cells"),
    )
    return bank_rows(rows, 2020)


_RAW_SQL = """t AS (SELECT conv_id, turn, text, string_split(regexp_replace(text, '[^A-Za-z]', ' ', 'g'), ' ') AS words FROM conversations), w AS (SELECT conv_id, turn, text, unnest(words) AS word, generate_subscripts(words, 1) AS i, words FROM t),
 o AS (SELECT conv_id, turn, text, word, CAST(list_sum(list_transform(words[1:i - 1], lambda x: length(x) + 1)) AS BIGINT) AS at_ FROM w WHERE regexp_full_match(word, '[A-Z][a-z]+')),
 r AS (SELECT conv_id, turn, text, {'start': coalesce(at_, 0), 'end': coalesce(at_, 0) + length(word), 'type': CASE length(word) % 3 WHEN 0 THEN 'LOC' WHEN 1 THEN 'ORG' ELSE 'PER' END, 'score': (2 + length(word) % 8) / 10.0::DOUBLE, 'text': word} AS e FROM o),
 s AS (SELECT conv_id, turn, any_value(text) AS text, list(e ORDER BY e.start) AS es FROM r WHERE e.score >= CASE e.type WHEN 'LOC' THEN 0.7 ELSE 0.35 END AND length(e.text) >= 2 GROUP BY conv_id, turn),
 pairs AS (SELECT conv_id, turn, text, unnest(es) AS e, generate_subscripts(es, 1) AS i, es FROM s), b AS (SELECT conv_id, turn, text, e, i, CASE WHEN i > 1 AND es[i - 1].type = e.type AND e.type <> 'LOC' AND e.start - es[i - 1]."end" <= 6
 AND regexp_full_match(substr(text, es[i - 1]."end" + 1, e.start - es[i - 1]."end"), '[\\s,''\\-]*(?:[A-Z]\\.?\\s*)?') THEN 0 ELSE 1 END AS opens FROM pairs),
 isl AS (SELECT *, sum(opens) OVER (PARTITION BY conv_id, turn ORDER BY i ROWS UNBOUNDED PRECEDING) AS k FROM b),
 m AS (SELECT conv_id, turn, any_value(text) AS text, min(e.start) AS start, max(e."end") AS fin, any_value(e.type) AS type, min(e.score) AS score FROM isl GROUP BY conv_id, turn, k),
 n AS (SELECT *, substr(text, start + 1, fin - start) AS name FROM m), p AS (SELECT conv_id, turn, text, type, name, arg_min(score, start) AS score, min(start) AS first FROM n WHERE type <> 'LOC' AND length(name) >= 3 GROUP BY conv_id, turn, text, type, name),
 z AS (SELECT *, string_split(text, name) AS gaps FROM p), g AS (SELECT *, unnest(range(1, len(gaps))) AS i FROM z), q AS (SELECT conv_id, turn, text, type, name, score, first, CAST(list_sum(list_transform(gaps[1:i], lambda x: length(x))) + (i - 1) * length(name) AS BIGINT) AS start FROM g),
 v AS (SELECT *, start + length(name) AS fin, row_number() OVER (PARTITION BY conv_id, turn, start, length(name) ORDER BY first) AS k FROM q WHERE NOT regexp_matches(substr(text, start, CASE WHEN start > 0 THEN 1 ELSE 0 END), '[A-Za-z0-9]') AND NOT regexp_matches(substr(text, start + length(name) + 1, 1), '[A-Za-z0-9]'))"""


def _raw_entities(spark, sf_dir):
    """Turns with capitalised words as what a model would say, with types and scores by length."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    kind = lambda s: F.when(s["length"] % 3 == 0, "LOC").when(s["length"] % 3 == 1, "ORG").otherwise("PER")
    return turns.select("*", F.transform(spans(F.col("text"), r"(?<![A-Za-z])[A-Z][a-z]+(?![A-Za-z])"), lambda s: F.struct(s["start"].alias("start"), (s["start"] + s["length"]).alias("end"), kind(s).alias("type"), ((2 + s["length"] % 8) / 10).alias("score"))).alias("raw"))


@query(f"""WITH {_RAW_SQL} SELECT conv_id, turn, CAST(start AS INT) AS start, CAST(fin AS INT) AS "end", type, score FROM n
 UNION ALL SELECT v.conv_id, v.turn, CAST(v.start AS INT), CAST(v.fin AS INT), v.type, greatest(0.5, v.score * 0.9) FROM v LEFT JOIN n ON n.conv_id = v.conv_id AND n.turn = v.turn AND n.start = v.start AND n.fin = v.fin WHERE v.k = 1 AND n.start IS NULL""")
def ext25_entities(spark, sf_dir):
    """Capitalised words as a stand-in for a model's entities: thresholded, joined, and all places of each in its text."""
    from quire.operators.entities import processed

    return processed(_raw_entities(spark, sf_dir)).select("conv_id", "turn", F.explode("entities").alias("e")).select("conv_id", "turn", "e.start", "e.end", "e.type", "e.score")


@query(f"""WITH {_RAW_SQL}, nm AS (SELECT DISTINCT name FROM n WHERE type <> 'LOC' AND length(name) >= 8), x AS (SELECT doc_id, text, name FROM documents JOIN nm ON contains(text, name)), y AS (SELECT *, string_split(text, name) AS gaps FROM x), u AS (SELECT doc_id, text, name, gaps, unnest(range(1, len(gaps))) AS i FROM y),
 h AS (SELECT doc_id, text, name, CAST(list_sum(list_transform(gaps[1:i], lambda x: length(x))) + (i - 1) * length(name) AS INT) AS start FROM u) SELECT doc_id, name, start FROM h WHERE NOT regexp_matches(substr(text, start, CASE WHEN start > 0 THEN 1 ELSE 0 END), '[A-Za-z0-9]') AND NOT regexp_matches(substr(text, start + length(name) + 1, 1), '[A-Za-z0-9]')""")
def ext25_everywhere(spark, sf_dir):
    """All places in the documents of the longer names (eight signs or more) that the turns have."""
    from quire.operators.entities import everywhere, processed

    found = processed(_raw_entities(spark, sf_dir), sweep=False).select(F.explode(F.filter("entities", lambda e: e["type"].isin("PER", "ORG") & (F.length(e["text"]) >= 8))).alias("e"))
    names = kept_aside(found.select(F.col("e.text").alias("text")).distinct().select(F.xxhash64("text").alias("name_id"), "text"), "names")  # read several times
    hits = everywhere(documents(spark, sf_dir), names, "doc_id", "name_id")
    return hits.join(names, "name_id").select("doc_id", F.col("text").alias("name"), "start")
