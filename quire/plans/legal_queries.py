"""Review of legal papers, outlines, stamps, statements and invoices, over the documents' lines and a few papers beside them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.functions import patterns as P
from quire.functions import values as V
from quire.functions.text import words_around
from quire.operators import extraction as X
from quire.operators import outline, pipeline, review, tables
from quire.sources.tables import LINES_SQL, documents, lines, pages_of

from .registry import query

#: pages of papers, one text a page: what the documents of the tables lack
PAPERS = [
    (-1, 1, "PRIVILEGED AND CONFIDENTIAL\nThis is an attorney-client privileged memo.\nIt is not attorney client privilege, said Reed.\nnot only work product but more\nfrom ann.lee@brownlaw.com to bob@shop.example\nplain words\nfor internal use only\nSmith & Jones LLP wrote it\nplain words\nConfidentiality notice"),
    (-1, 2, "Ann Lee, Esq. and Attorneys for the plaintiff Mary Poe\nprepared in anticipation of litigation\nsettlement offer\nno words of note\nunder seal"),
    (-2, 1, "See Roe v. Wade and Brown vs. Board Members\nSummary Report v. Table Data\nno caption here v\nCall 555-123-4567 or write ann@x.example now\nphone 212 555 0187 at any time\nann@y.example alone"),
    (-3, 1, "CHAPTER IV The long way\nARTICLE 2 Rules\nSection 3.1 Terms\nSECTION 4 Costs\n1.2.3 deep point\n1.2 point\n7. first point\nIX. roman\nB. letter\nALL CAPITALS HERE\nALL CAPITALS WITH A STOP.\nExhibit B,\nplain line of words\nNo.\nAPPENDIX C Lists\nEXHIBIT A (continued) Notes of the day\nEXHIBIT A — cont. Notes\nExhibit a notes"),
    (-4, 1, "ABC000123\nplain\nplain\nplain\nplain\nABC 000124 middle"),
    (-4, 2, "ABC-000124\nplain\nplain\nplain\nplain\nXY9-0007"),
    (-4, 3, "abc000125\nplain\nplain\nplain\nplain\n00450"),
    (-5, 1, "Statement of Account\nAccount No. 12-3456\nBeginning balance: $1,000.50\nEnding balance (200.25)\nWithdrawals and Deposits\nDate Description Balance"),
    (-6, 1, "Invoice # A-77/3\nInvoice date: 01/15/2024\nDue date: 2024-02-14\nBill To: Roe\nQty and Unit price\nSubtotal: 90.00\nTax: 9.00\nTotal due: $99.00\nVendor: Poe & Sons"),
    (-7, 1, "INVOICE_DATE|INVOICE_NUMBER|LINE_ITEM_TOTAL\n20240105|77|100.50"),
    (-8, 1, "Timekeeper and Task Code\nHours Rate Amount\nAttorney time"),
    (-9, 1, "nothing to see"),
    (-10, 1, "a memo by our attorney-\nclient is attorney\nclient privileged and work\n\nproduct of Poe\nRoe & Sons\nLaw Group and\nnothing\nunder\nseal or confidential\nwords\nMary T. Poe,\nEsq. said so"),
]


def _literal(text: str) -> str:
    return "'" + text.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


PAPERS_SQL = "papers AS (SELECT * FROM (VALUES " + ", ".join(f"(CAST({d} AS BIGINT), {p}, {_literal(t)})" for d, p, t in PAPERS) + ") t(doc_id, page_no, text))"
OWN_SQL = PAPERS_SQL + """, own AS (SELECT doc_id, CAST(page_no * 100 + i - 1 AS INT) AS line_no, page_no, line FROM
 (SELECT doc_id, page_no, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM papers))"""
#: all lines: of the documents and of the papers
ALL_SQL = LINES_SQL.replace("lines AS", "given AS", 1) + f", {OWN_SQL}, lines AS (SELECT doc_id, line_no, page_no, line FROM given UNION ALL SELECT doc_id, line_no, page_no, line FROM own)"


def papers(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PAPERS, "doc_id long, page_no int, text string")


def own_lines(spark: SparkSession) -> DataFrame:
    split = papers(spark).select("doc_id", "page_no", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    return split.select("doc_id", (F.col("page_no") * 100 + F.col("i")).alias("line_no"), "page_no", "line")


def all_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(spark, sf_dir).select("doc_id", "line_no", "page_no", "line").unionByName(own_lines(spark))


def spans_sql(patterns: dict[str, str]) -> str:
    """SQL: matches with their offsets, from the lengths of gaps and matches before each."""
    found = " UNION ALL ".join(f"SELECT doc_id, line_no, '{c}' AS category, regexp_split_to_array(line, '{P.re2(p)}') AS gaps, regexp_extract_all(line, '{P.re2(p)}') AS found FROM lines WHERE regexp_matches(line, '{P.re2(p)}')" for c, p in patterns.items())
    return f"""found AS ({found}), located AS (SELECT *, generate_subscripts(found, 1) AS i FROM found),
 spans AS (SELECT doc_id, line_no, category, CAST(list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(found[1:i-1], lambda x: length(x))), 0) AS INT) AS start,
 CAST(length(found[i]) AS INT) AS length, found[i] AS text FROM located)"""


def located_sql(name: str, source: str, patterns: dict[str, str], keys: str, text: str) -> str:
    """SQL: ``name`` with category, start, length and text of the matches in ``text`` of ``source``, by ``keys``."""
    found = " UNION ALL ".join(f"SELECT {keys}, '{c}' AS category, regexp_split_to_array({text}, '{P.re2(p)}') AS gaps, regexp_extract_all({text}, '{P.re2(p)}') AS found FROM {source} WHERE regexp_matches({text}, '{P.re2(p)}')" for c, p in patterns.items())
    return f"""{name}_found AS ({found}), {name} AS (SELECT {keys}, category, CAST(list_sum(list_transform(gaps[1:nth_], lambda x: length(x))) + coalesce(list_sum(list_transform(found[1:nth_-1], lambda x: length(x))), 0) AS INT) AS start,
 CAST(length(found[nth_]) AS INT) AS length, found[nth_] AS text FROM (SELECT *, generate_subscripts(found, 1) AS nth_ FROM {name}_found))"""


# ---- privilege review, on the text of pages: a phrase may go on in the next line
PAGE_TEXT_SQL = f"""{ALL_SQL}, sized AS (SELECT doc_id, page_no, min(line_no) AS first_no, count(*) AS n FROM lines GROUP BY doc_id, page_no),
 kept AS (SELECT doc_id, page_no, line_no - first_no AS line, n, length(line) AS size, CAST(sum(length(line) + 1) OVER (PARTITION BY doc_id, page_no ORDER BY line_no) AS BIGINT) - length(line) - 1 AS at_, line AS shown FROM lines JOIN sized USING (doc_id, page_no) WHERE line <> ''),
 whole AS (SELECT doc_id, page_no, string_agg(shown, ' ' ORDER BY at_) AS body FROM kept GROUP BY doc_id, page_no)"""
_REVIEW_SQL = f"""{PAGE_TEXT_SQL}, {located_sql('hits', 'whole', P.REVIEW, 'doc_id, page_no, body', 'body')},
 held AS (SELECT h.doc_id, h.page_no, category, start, length, text, body, line, (line + 0.5) / n AS place, substr(body, greatest(1, start - 39), least(start, 40)) AS before FROM hits h JOIN kept k ON k.doc_id = h.doc_id AND k.page_no = h.page_no AND start BETWEEN at_ AND at_ + size),
 reviewed AS (SELECT doc_id, page_no, CAST(line AS INT) AS line, CASE WHEN category = 'legend' THEN CASE WHEN place < 0.15 OR place > 0.85 THEN 'confidentiality-legend' ELSE 'privilege-phrase' END WHEN category = 'email' THEN 'law-firm-email'
 WHEN category = 'general' THEN 'privilege-phrase' WHEN category IN ('esquire', 'attorney-for') THEN 'counsel-name' ELSE category END AS type, start, length, text, body,
 category <> 'email' AND regexp_matches(before, '{P.re2(P.NEGATION)}') AND NOT regexp_matches(before, '(?i)\\bnot\\s+only\\b') AS negated FROM held
 WHERE NOT (category = 'email' AND NOT regexp_matches(text, '{P.LAW_DOMAIN}')) AND NOT (category = 'general' AND (regexp_matches(text, '{P.REVIEW["attorney-client"]}') OR regexp_matches(text, '{P.REVIEW["work-product"]}'))))"""


def all_pages(spark, sf_dir):
    """doc_id, page_no, lines: of the documents and of the papers."""
    return pages_of(documents(spark, sf_dir)).unionByName(papers(spark).select("doc_id", "page_no", F.split("text", "\n").alias("lines")))


@query(f"WITH {_REVIEW_SQL} SELECT doc_id, page_no, line, type, start, length, text, negated FROM reviewed")
def ext14_privilege_review(spark, sf_dir):
    """Findings of seven kinds, with the place of a legend on its page and negators before (EXT15)."""
    return review.findings(all_pages(spark, sf_dir))


@query(
    f"""WITH {_REVIEW_SQL}, r AS (SELECT *, start + length AS fin, list_position({P.REVIEW_ORDER}, type) AS rank FROM reviewed),
 o AS (SELECT *, max(fin) OVER (PARTITION BY doc_id, page_no ORDER BY start, rank, fin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reached FROM r),
 n AS (SELECT *, sum(CASE WHEN reached IS NULL OR start > reached + 8 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, page_no ORDER BY start, rank, fin ROWS UNBOUNDED PRECEDING) AS island FROM o)
 SELECT doc_id, page_no, min(start) AS start, max(fin) AS "end", arg_min(type, rank * 1000000 + start) AS type, bool_or(negated) AS negated FROM n GROUP BY doc_id, page_no, island"""
)
def ext16_merged_findings(spark, sf_dir):
    """Findings of a page eight signs apart at most as one, of the more specific kind."""
    return review.merged(all_pages(spark, sf_dir))


_TOKENS = "list_filter(string_split(trim(regexp_replace({0}, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')), ' '), lambda w: w <> '')"


@query(
    f"""WITH {_REVIEW_SQL}, e AS (SELECT DISTINCT doc_id, page_no, start, length, body, start - length(regexp_extract(substr(body, 1, start), '[^ \\t\\n\\x0B\\f\\r]*$')) AS a,
 start + length + length(regexp_extract(substr(body, start + length + 1), '^[^ \\t\\n\\x0B\\f\\r]*')) AS b FROM reviewed),
 t AS (SELECT *, {_TOKENS.format("substr(body, greatest(0, a - 240) + 1, least(a, 240))")} AS l, {_TOKENS.format("substr(body, b + 1, 240)")} AS r FROM e)
 SELECT doc_id, page_no, start, length, (CASE WHEN len(l) > 10 THEN '… ' ELSE '' END) || array_to_string(l[greatest(1, len(l) - 9):], ' ') || (CASE WHEN len(l) > 0 THEN ' ' ELSE '' END) AS before,
 trim(regexp_replace(substr(body, a + 1, b - a), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')) AS match, (CASE WHEN len(r) > 0 THEN ' ' ELSE '' END) || array_to_string(r[1:10], ' ') || (CASE WHEN len(r) > 10 THEN ' …' ELSE '' END) AS after FROM t"""
)
def prj2_words_around(spark, sf_dir):
    """Every place of a finding as whole words, with ten words on both sides."""
    found = review.page_findings(all_pages(spark, sf_dir)).select("doc_id", "page_no", "text", F.explode(F.array_distinct(F.transform("found", lambda f: F.struct(f["start"].alias("start"), f["end"].alias("end"))))).alias("f"))
    around = words_around(F.col("text"), F.col("f.start"), F.col("f.end"))
    return found.select("doc_id", "page_no", "f.start", (F.col("f.end") - F.col("f.start")).alias("length"), around.alias("w")).select("doc_id", "page_no", "start", "length", "w.*")


# ---- keyword search
_KEYWORDS = {"word": ("Attorney", {"match_case": True}), "line": ("memo", {"whole_word": True}), "sentence": ("license", {}), "page": (r"settle\w+", {"regex": True})}


def _keyword_sql(scope: str, pattern: str) -> str:
    before = "substr(line, 1, start)"
    stop = f"greatest(0, coalesce(length({before}) - strpos(reverse({before}), ' .') - 0, 0))"
    first = f"CASE WHEN regexp_matches({before}, '[.?!] ') THEN length(regexp_extract({before}, '^(.*[.?!]) ', 1)) ELSE 0 END"
    last = "CASE WHEN regexp_matches(substr(line, start + 1), '[.?!]') THEN start + length(regexp_extract(substr(line, start + 1), '^[^.?!]*[.?!]')) ELSE length(line) END"
    shown = {"word": "text", "line": "line", "sentence": f"substr(line, {first} + 1, {last} - {first})", "page": "NULL"}[scope]
    del stop
    if scope == "page":
        return f"WITH {ALL_SQL}, {spans_sql({'k': pattern})} SELECT DISTINCT 'page' AS scope, doc_id, page_no, CAST(NULL AS INT) AS line_no, CAST(NULL AS INT) AS start, CAST(NULL AS VARCHAR) AS text FROM spans JOIN lines USING (doc_id, line_no)"
    return f"WITH {ALL_SQL}, {spans_sql({'k': pattern})} SELECT '{scope}' AS scope, doc_id, page_no, line_no, start, {shown} AS text FROM spans JOIN lines USING (doc_id, line_no)"


@query(" UNION ALL ".join(f"({_keyword_sql(scope, X.keyword_pattern(word, **flags))})" for scope, (word, flags) in _KEYWORDS.items()))
def ext11_keyword_scopes(spark, sf_dir):
    """A keyword's hits as words, lines, sentences and pages, with case, whole words and patterns as flags."""
    rows = all_lines(spark, sf_dir)
    parts = [X.keyword_hits(rows, word, scope, **flags).select(F.lit(scope).alias("scope"), "doc_id", "page_no", "line_no", "start", "text") for scope, (word, flags) in _KEYWORDS.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


# ---- outlines
_TIDY = "trim(regexp_replace(line, '\\s+', ' ', 'g'))"
_LEVEL = "CASE " + " ".join(f"WHEN regexp_matches(t, '{p}') THEN {k}" for p, k in P.HEADINGS) + " END"
_HEADINGS_SQL = f"""{ALL_SQL}, a AS (SELECT doc_id, page_no, line_no, line, {_TIDY} AS t FROM lines), b AS (SELECT *, {_LEVEL} AS known, length(regexp_replace(t, '[^A-Za-z]', '', 'g')) AS letters, length(regexp_replace(t, '[^A-Z]', '', 'g')) AS capitals FROM a),
 c AS (SELECT *, letters >= 3 AND capitals >= 0.75 * letters AS caps FROM b), d AS (SELECT *, CASE WHEN known IS NOT NULL THEN 60 ELSE 0 END + CASE WHEN caps AND length(t) <= 80 THEN 15 ELSE 0 END + CASE WHEN NOT regexp_matches(t, '[.:]$') OR known IS NOT NULL THEN 5 ELSE 0 END
 - CASE WHEN length(t) > 100 AND known IS NULL THEN 20 ELSE 0 END AS score FROM c), headed AS (SELECT doc_id, page_no, line_no, CAST(coalesce(known, CASE WHEN caps THEN 3 ELSE 4 END) AS INT) AS level, CAST(score AS INT) AS score FROM d WHERE length(t) BETWEEN 3 AND 160 AND NOT regexp_matches(t, '[,;]$') AND score >= 30)"""


@query(f"WITH {_HEADINGS_SQL} SELECT * FROM headed")
def fn20_headings(spark, sf_dir):
    """Headings by nine patterns and by capitals, with their levels and scores."""
    return outline.headings(all_lines(spark, sf_dir)).select("doc_id", "page_no", "line_no", "level", "score")


@query(f"""WITH {_HEADINGS_SQL}, p AS (SELECT doc_id, max(page_no) AS pages FROM lines GROUP BY doc_id), r AS (SELECT h.*, row_number() OVER (PARTITION BY h.doc_id ORDER BY score DESC, page_no, line_no) AS k, pages FROM headed h JOIN p USING (doc_id))
 SELECT doc_id, page_no, line_no, level, score FROM r WHERE k <= greatest(3, 2 * pages)""")
def top3_heading_cap(spark, sf_dir):
    """The headings with the highest scores of each document, three or two a page (80 and 6 in use)."""
    rows = all_lines(spark, sf_dir)
    pages = rows.groupBy("doc_id").agg(F.max("page_no").alias("pages"))
    return outline.capped(outline.headings(rows), pages, 3, 2).select("doc_id", "page_no", "line_no", "level", "score")


@query(f"""WITH {ALL_SQL}, w AS (SELECT doc_id, line_no, list_filter(regexp_split_to_array(regexp_replace(regexp_replace(line, '(?i)\\(\\s*cont(?:inued|\\.)?\\s*\\)', ' ', 'g'), '(?i)\\b(?:continued|cont\\.?)\\b', ' ', 'g'), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS words FROM lines),
 n AS (SELECT *, list_position(list_transform(words, lambda x: x = upper(x)), false) AS p FROM w) SELECT doc_id, line_no, lower(array_to_string(CASE WHEN p IS NULL OR p = 0 THEN words ELSE words[1:p - 1] END, ' ')) AS key FROM n WHERE length(array_to_string(CASE WHEN p IS NULL OR p = 0 THEN words ELSE words[1:p - 1] END, ' ')) > 0""")
def fn15_pattern_keys(spark, sf_dir):
    """The identifiers that lines begin with."""
    return all_lines(spark, sf_dir).select("doc_id", "line_no", outline.pattern_key(F.col("line")).alias("key")).where("key <> ''")


# ---- stamps
_STAMPS_SQL = f"""{ALL_SQL}, sized AS (SELECT doc_id, page_no, min(line_no) AS first_no, count(*) AS n FROM lines GROUP BY doc_id, page_no),
 f AS (SELECT l.doc_id, l.page_no, l.line_no, CASE WHEN (l.line_no - first_no + 0.5) / n <= 0.35 THEN 't' WHEN (l.line_no - first_no + 0.5) / n >= 0.65 THEN 'b' END AS corner, unnest(regexp_extract_all(line, '{P.STAMP}')) AS text FROM lines l JOIN sized z ON l.doc_id = z.doc_id AND l.page_no = z.page_no),
 c AS (SELECT *, regexp_replace(regexp_replace(trim(text), '[–—]', '-', 'g'), '\\s+', '', 'g') AS tight FROM f WHERE corner IS NOT NULL),
 q AS (SELECT *, regexp_extract(tight, '^(\\D*)(\\d.*\\d|\\d)(\\D*)$', 1) AS prefix, regexp_replace(regexp_extract(tight, '^(\\D*)(\\d.*\\d|\\d)(\\D*)$', 2), '\\D', '', 'g') AS figures, regexp_extract(tight, '^(\\D*)(\\d.*\\d|\\d)(\\D*)$', 3) AS suffix FROM c),
 stamped AS (SELECT doc_id, page_no, line_no, corner, text, prefix, suffix, CAST(length(figures) AS INT) AS digits, CAST(figures AS BIGINT) AS number, regexp_matches(prefix || suffix, '[A-Za-z]') AS named FROM q
 WHERE length(tight) BETWEEN 4 AND 36 AND length(figures) >= 4 AND (regexp_matches(prefix || suffix, '[A-Za-z]') OR (length(figures) >= 5 AND starts_with(figures, '0'))))"""
_FORMATS_SQL = f"""{_STAMPS_SQL}, g AS (SELECT *, page_no - lag(page_no) OVER w AS on_, number - lag(number) OVER w AS by_ FROM stamped WINDOW w AS (PARTITION BY doc_id, prefix, suffix, digits, corner ORDER BY page_no, number)),
 p AS (SELECT doc_id, max(page_no) AS pages FROM lines GROUP BY doc_id), h AS (SELECT g.doc_id, prefix, suffix, digits, corner, named, pages, count(*) AS n, count(DISTINCT page_no) AS held, count(*) FILTER (WHERE on_ > 0 AND by_ = on_) AS follows FROM g JOIN p USING (doc_id) GROUP BY g.doc_id, prefix, suffix, digits, corner, named, pages),
 formats AS (SELECT doc_id, prefix, suffix, digits, corner, n, round(20 * held + 4 * n + 18 * follows + 12 * (CASE WHEN pages <= 1 THEN CAST(n AS DOUBLE) ELSE CAST(held AS DOUBLE) / pages END) + CASE WHEN named THEN 14 ELSE 0 END + least(digits, 8), 6) AS score FROM h)"""


@query(f"WITH {_FORMATS_SQL} SELECT * FROM formats")
def ext22_stamp_formats(spark, sf_dir):
    """Formats inferred from what looks like stamps, scored."""
    rows = all_lines(spark, sf_dir)
    return outline.stamp_formats(outline.stamps(rows), rows.groupBy("doc_id").agg(F.max("page_no").alias("pages")))


@query(f"WITH {_FORMATS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, prefix, suffix, digits, corner) AS k FROM formats) SELECT doc_id, prefix, suffix, digits, corner, n, score FROM r WHERE k = 1")
def ext22_best_format(spark, sf_dir):
    """Each document's likeliest stamp format."""
    rows = all_lines(spark, sf_dir)
    return outline.best_format(outline.stamp_formats(outline.stamps(rows), rows.groupBy("doc_id").agg(F.max("page_no").alias("pages"))))


@query(f"WITH {ALL_SQL}, {spans_sql({'stamp': outline.stamp_pattern('ABC', 6)})}, z AS (SELECT doc_id, page_no, min(line_no) AS first_no, count(*) AS n FROM lines GROUP BY doc_id, page_no) SELECT doc_id, page_no, line_no, start, text FROM spans JOIN lines l USING (doc_id, line_no) JOIN z USING (doc_id, page_no) WHERE (line_no - first_no + 0.5) / n <= 0.22")
def ext21_known_stamps(spark, sf_dir):
    """Stamps of a known format (ABC and six digits) in the top band of their page."""
    rows = all_lines(spark, sf_dir)
    sizes = rows.groupBy("doc_id", "page_no").agg(F.min("line_no").alias("first_no"), F.count("*").alias("n"))
    found = X.pattern_hits(rows, {"stamp": outline.stamp_pattern("ABC", 6)}).join(sizes, ["doc_id", "page_no"])
    return found.where((F.col("line_no") - F.col("first_no") + 0.5) / F.col("n") <= 0.22).select("doc_id", "page_no", "line_no", "start", "text")


# ---- statements and invoices
def _count_sql(signs: list[tuple[str, ...]]) -> str:
    return " + ".join("CAST(" + " AND ".join(f"regexp_matches(t, '{p}')" for p in group) + " AS INT)" for group in signs)


_TYPES_SQL = f"""{PAPERS_SQL}, x AS (SELECT conv_id AS id, turn AS part, substr(text, 1, 20000) AS t FROM conversations UNION ALL SELECT doc_id, page_no, substr(text, 1, 20000) FROM papers),
 s AS (SELECT *, {_count_sql(P.TYPE_SIGNS['bank'])} AS bank, {_count_sql(P.TYPE_SIGNS['ledes'])} AS timed, {_count_sql(P.TYPE_SIGNS['invoice'])} AS inv FROM x), c AS (SELECT *, timed - CASE WHEN bank = 0 THEN 0 ELSE 0.5 END AS led FROM s)"""


@query(
    f"""WITH {_TYPES_SQL} SELECT id, part, CASE WHEN regexp_matches(t, '{P.LEDES_BLOCK}') THEN 'ledes high' WHEN led >= 3 AND led > inv THEN CASE WHEN led >= 4 THEN 'ledes high' ELSE 'ledes medium' END
 WHEN bank >= 2 AND bank >= inv THEN CASE WHEN bank >= 3 THEN 'bank_statement high' ELSE 'bank_statement medium' END WHEN inv >= 2 THEN CASE WHEN inv >= 3 THEN 'invoice high' ELSE 'invoice medium' END
 WHEN bank >= 1 THEN 'bank_statement low' WHEN inv >= 1 THEN 'invoice low' WHEN led >= 1 THEN 'ledes low' ELSE 'generic low' END AS kind FROM c"""
)
def fn6_document_types(spark, sf_dir):
    """Bank statement, time sheet or invoice, by the signs in the first 20,000 characters, and how sure that is."""
    from quire.sources.tables import table

    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("id"), F.col("turn").alias("part"), "text")
    texts = turns.unionByName(papers(spark).select(F.col("doc_id").alias("id"), F.col("page_no").alias("part"), "text"))
    return texts.select("id", "part", tables.document_type(F.substring("text", 1, 20000)).alias("kind"))


def _field_sql(fields: dict[str, str]) -> str:
    return ", ".join(f"nullif(trim(regexp_extract(text, '{p}', 1)), '') AS {k}" for k, p in fields.items())


@query(f"WITH {PAPERS_SQL} SELECT doc_id, {_field_sql(P.STATEMENT_FIELDS)}, {_field_sql(P.INVOICE_FIELDS)} FROM papers")
def ext24_header_fields(spark, sf_dir):
    """What statements and invoices say at their head, as written."""
    found = tables.header_fields(F.col("text"), P.STATEMENT_FIELDS | P.INVOICE_FIELDS)
    return papers(spark).select("doc_id", *[c.alias(k) for k, c in found.items()])


@query(
    """SELECT * FROM (VALUES (-5, 1000.5, -200.25, CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR), CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE)),
 (-6, NULL, NULL, '2024-01-15', '2024-02-14', 90.0, 9.0, 90.0)) t(doc_id, beginning_balance, ending_balance, invoice_date, due_date, subtotal, tax, total)"""
)
def ext24_typed_fields(spark, sf_dir):
    """The same fields as money and dates; the first total that a text names may be its subtotal."""
    found = tables.header_fields(F.col("text"), P.STATEMENT_FIELDS | P.INVOICE_FIELDS)
    money = {k: V.amount(found[k]).alias(k) for k in ("beginning_balance", "ending_balance", "subtotal", "tax", "total")}
    dates = {k: V.iso_date(found[k], False, 2024).alias(k) for k in ("invoice_date", "due_date")}
    named = money | dates
    order = ["beginning_balance", "ending_balance", "invoice_date", "due_date", "subtotal", "tax", "total"]
    return papers(spark).where("doc_id IN (-5, -6)").select(F.col("doc_id").cast("int").alias("doc_id"), *[named[k] for k in order])


# Words by which an invoice's columns are known.
_INVOICE_GROUPS = [["description", "item", "service"], ["qty", "quantity", "hours"], ["unit", "rate", "price"], ["amount", "total", "line total"], ["tax", "vat"]]


def invoice_cells(spark, sf_dir):
    """Every order's lines as the rows of an invoice: a title, a header, the items and a total without description."""
    from quire.sources.tables import table

    own = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    money = lambda c: F.concat(F.lit("$"), F.format_number(c, 2))
    items = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("doc_id"), (F.row_number().over(own) + 1).alias("row_no"),
        F.array(F.concat(F.lit("part "), F.col("l_partkey").cast("string")), F.format_number("l_quantity", 0), money(F.floor(F.col("l_extendedprice")) / 2), money(F.floor("l_extendedprice"))).alias("cells"),
    )
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"))
    fixed = lambda n, *cells: orders.select("doc_id", F.lit(n).alias("row_no"), F.array(*map(F.lit, cells)).alias("cells"))
    return items.unionByName(fixed(0, "Invoice", "", "", "")).unionByName(fixed(1, "Item description", "Qty", "Unit price", "Amount")).unionByName(fixed(10_000, "", "", "", "$1.00"))


@query("SELECT o_orderkey AS doc_id, 1 AS header_row FROM orders")
def fn25_header_rows(spark, sf_dir):
    """The first of thirty rows that names at least half of an invoice's columns."""
    return tables.header_columns(invoice_cells(spark, sf_dir), _INVOICE_GROUPS).select("doc_id", "header_row")


@query("""SELECT l_orderkey AS doc_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS INT) AS entry, 'part ' || l_partkey AS description, CAST(l_quantity AS DOUBLE) AS qty,
 floor(l_extendedprice) / 2 AS unit_price, CAST(floor(l_extendedprice) AS DOUBLE) AS amount FROM lineitem""")
def fn26_invoice_rows(spark, sf_dir):
    """Every order's lines as an invoice, parsed back into line items."""
    return tables.invoice_rows(invoice_cells(spark, sf_dir), _INVOICE_GROUPS).select("doc_id", "entry", "description", "qty", "unit_price", "amount")


@query(f"""WITH {PAPERS_SQL} SELECT doc_id, page_no, CASE WHEN {" OR ".join(f"regexp_matches(text, '{P.re2(p)}')" for p in P.PERSONAL_DATA.values())} THEN '' ELSE text END AS text FROM papers""")
def pipe6_safe_flatten(spark, sf_dir):
    """Texts with sensitive values are emptied before they are made part of a page."""
    return pipeline.flatten(papers(spark), clear_sensitive_first=True)


# ---- captions, terms and contacts, with rows that match
@query(f"WITH {ALL_SQL} SELECT doc_id, line_no, 'privilege' AS category, unnest(regexp_extract_all(line, '{P.re2(P.PRIVILEGE)}')) AS text FROM lines")
def ext7_privilege_terms(spark, sf_dir):
    return X.pattern_hits(all_lines(spark, sf_dir), {"privilege": P.PRIVILEGE}).select("doc_id", "line_no", "category", "text")


_NEAR = {"email": P.PERSONAL_DATA["email"], "phone": P.PERSONAL_DATA["phone"]}
_LABEL = {"label": r"(?i)\b(?:call|contact|mail|email|phone|tel|visit|write)\b"}


@query(
    f"""WITH {ALL_SQL}, {spans_sql(_NEAR | _LABEL)}
 SELECT DISTINCT h.doc_id, h.line_no, h.page_no, h.category, h.start, h.length, h.text FROM (SELECT * FROM spans JOIN lines USING (doc_id, line_no)) h JOIN spans t ON h.doc_id = t.doc_id AND h.line_no = t.line_no
 WHERE h.category <> 'label' AND t.category = 'label' AND h.start <= t.start + t.length + 90 AND h.start + h.length >= t.start - 90 AND (h.start + h.length <= t.start OR h.start >= t.start + t.length)"""
)
def ext8_near_terms(spark, sf_dir):
    """Values within ninety signs of a term on the same line, not overlapping it."""
    rows = all_lines(spark, sf_dir)
    return X.near(X.pattern_hits(rows, _NEAR), X.pattern_hits(rows, _LABEL).drop("page_no"), ["doc_id", "line_no"], 90)


@query(f"WITH {ALL_SQL} SELECT doc_id, line_no FROM (SELECT * FROM lines UNION ALL SELECT doc_id, line_no + 50, page_no, repeat(' ', line_no % 3) FROM own) WHERE length(trim(line)) = 0")
def pred15_empty_lines(spark, sf_dir):
    blank = own_lines(spark).select("doc_id", (F.col("line_no") + 50).alias("line_no"), "page_no", F.repeat(F.lit(" "), F.col("line_no") % 3).alias("line"))
    return all_lines(spark, sf_dir).unionByName(blank).where(F.length(F.trim("line")) == 0).select("doc_id", "line_no")
