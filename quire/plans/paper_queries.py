"""Invoices, time sheets, statements and searches made of the given tables, with the SQL that checks each query."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quire.functions import patterns as P
from quire.functions import values as V
from quire.functions.text import snippet, spans
from quire.operators import extraction as X
from quire.operators import pipeline, tables
from quire.sources.tables import LINES_SQL, PAGES_SQL, documents, lines, pages_of, table

from .legal_queries import located_sql
from .registry import query
from .scalar_queries import _TASK_CODES

_CODES = "[" + ", ".join(f"'{c}'" for c in _TASK_CODES) + "]"
_N = "row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey)"
_TIME_SQL = f"""s AS (SELECT l_orderkey AS doc_id, CAST({_N} AS INT) AS row_no, strftime(l_shipdate, '%Y-%m-%d') AS date, 'TK' || (l_suppkey % 50) AS timekeeper_id,
 CASE WHEN l_orderkey % 3 = 0 THEN 'Z' ELSE 'L' END || (100 + 10 * (l_partkey % 50)) AS task_code, 'A10' || (l_linenumber % 9) AS activity_code, CAST(floor(l_quantity) AS DOUBLE) AS hours, floor(l_extendedprice) / 2 AS rate, CAST(floor(l_extendedprice) AS DOUBLE) AS amount, 'work on ' || l_partkey AS narrative FROM lineitem)"""


def time_cells(spark, sf_dir):
    """Every order's lines as a time sheet: a title, a header, the lines."""
    own = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    s = lambda c: F.col(c).cast("string") if isinstance(c, str) else c.cast("string")
    money = lambda c: F.concat(F.lit("$"), F.format_number(c, 2))
    cells = F.array(
        F.date_format("l_shipdate", "MM/dd/yyyy"), F.concat(F.lit("TK"), s(F.col("l_suppkey") % 50)), F.concat(F.when(F.col("l_orderkey") % 3 == 0, "z ").otherwise("l"), s(100 + 10 * (F.col("l_partkey") % 50))), F.concat(F.lit(" a10"), s(F.col("l_linenumber") % 9)),
        F.format_number(F.floor("l_quantity"), 0), money(F.floor("l_extendedprice") / 2), money(F.floor("l_extendedprice")), F.concat(F.lit("work on "), s("l_partkey")),
    )
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), (F.row_number().over(own) + 1).alias("row_no"), cells.alias("cells"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"))
    fixed = lambda n, *held: orders.select("doc_id", F.lit(n).alias("row_no"), F.array(*map(F.lit, held)).alias("cells"))
    return rows.unionByName(fixed(0, "Time sheet")).unionByName(fixed(1, "Date", "Timekeeper", "Task Code", "Activity", "Hours", "Rate", "Amount", "Narrative"))


@query(f"WITH {_TIME_SQL} SELECT doc_id, row_no + 1 AS row_no, date, timekeeper_id, task_code, activity_code, hours, rate, amount, narrative FROM s")
def fn26_time_sheets(spark, sf_dir):
    """Every order's lines as a time sheet, parsed back by its header."""
    return tables.time_sheet_rows(time_cells(spark, sf_dir), 2020)


@query(f"WITH {_TIME_SQL}, c AS (SELECT doc_id, count(*) FILTER (WHERE list_contains({_CODES}, task_code)) AS known, count(*) AS checked FROM s GROUP BY doc_id) SELECT * FROM c WHERE checked > 3 AND known / checked < 0.3")
def fn26_unknown_codes(spark, sf_dir):
    """Time sheets most of whose task codes are unknown."""
    return tables.time_sheet_warnings(tables.time_sheet_rows(time_cells(spark, sf_dir), 2020), _TASK_CODES)


@query(f"WITH {_TIME_SQL} SELECT doc_id, row_no AS line_no, '7' || doc_id AS invoice, date, task_code, hours, amount FROM s")
def fn24_pipe_blocks(spark, sf_dir):
    """Every order's lines as a pipe-separated block with its columns in another order, parsed by the names in its first line."""
    cell = lambda i: F.get("cells", F.lit(i))
    line = F.concat_ws("|", F.concat(F.lit("7"), F.col("doc_id").cast("string")), cell(6), cell(0), cell(2), cell(4), F.lit(""))
    rows = time_cells(spark, sf_dir).where("row_no > 1").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("row_no", line.alias("line")))).alias("held"))
    text = F.concat(F.lit("a block\\nINVOICE_NUMBER|LINE_ITEM_TOTAL|Line_Item_Date|LINE_ITEM_TASK_CODE|LINE_ITEM_NUMBER_OF_UNITS|X\\n".replace("\\n", "\n")), F.array_join(F.transform("held", lambda x: x["line"]), "\n"))
    return tables.pipe_rows(rows.select("doc_id", text.alias("text")), 2020).select("doc_id", "line_no", "invoice", "date", "task_code", "hours", "amount")


_HEAD_SQL = """g AS (SELECT l_orderkey, CAST(sum(floor(l_extendedprice)) AS DOUBLE) AS amount FROM lineitem GROUP BY l_orderkey), h AS (SELECT o_orderkey AS doc_id, 'A-' || o_orderkey || '/1' AS invoice_no, strftime(o_orderdate, '%Y-%m-%d') AS invoice_date,
 strftime(o_orderdate + INTERVAL 30 DAYS, '%Y-%m-%d') AS due_date, coalesce(amount, 0) + CASE WHEN o_orderkey % 5 = 0 THEN 1.5 ELSE 0.0 END AS subtotal, 'Clerk ' || (o_orderkey % 100) AS vendor, amount FROM orders LEFT JOIN g ON l_orderkey = o_orderkey)"""


def invoice_heads(spark, sf_dir):
    """doc_id and text: what the invoices of all orders say above their lines."""
    sums = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sum(F.floor("l_extendedprice")).cast("double").alias("amount"))
    orders = table(spark, sf_dir, "orders").join(sums, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    key, s = F.col("o_orderkey"), lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    subtotal = F.coalesce("amount", F.lit(0.0)) + F.when(key % 5 == 0, 1.5).otherwise(0.0)
    dated = F.when(key % 2 == 0, s("Invoice date: ", F.date_format("o_orderdate", "MM/dd/yyyy"))).otherwise(s("Date - ", F.date_format("o_orderdate", "MMM d, yyyy")))
    text = s("Invoice # A-", key.cast("string"), "/1\n", dated, "\nDue date: ", F.date_format(F.date_add("o_orderdate", 30), "yyyy-MM-dd"), "\nSubtotal: $", F.format_number(subtotal, 2), "\nVendor: Clerk ", (key % 100).cast("string"))
    return orders.select(key.alias("doc_id"), text.alias("text"))


@query(f"WITH {_HEAD_SQL} SELECT doc_id, invoice_no, invoice_date, due_date, subtotal, vendor FROM h")
def ext24_invoice_heads(spark, sf_dir):
    """Number, dates, subtotal and vendor of every order's invoice, typed; half of them say only ``Date``."""
    found = tables.invoice_head(F.col("text"), False, 2020)
    return invoice_heads(spark, sf_dir).select("doc_id", *[found[k].alias(k) for k in ("invoice_no", "invoice_date", "due_date", "subtotal", "vendor")])


@query(f"WITH {_HEAD_SQL} SELECT doc_id, printf('items %.2f, subtotal %.2f', coalesce(amount, 0.0), subtotal) AS warning FROM h WHERE abs(coalesce(amount, 0) - subtotal) > 0.05 UNION ALL SELECT doc_id, 'no items' FROM h WHERE amount IS NULL")
def fn26_subtotal_warnings(spark, sf_dir):
    """Invoices whose items don't add up to the subtotal that their head names."""
    heads = invoice_heads(spark, sf_dir).select("doc_id", tables.invoice_head(F.col("text"), False, 2020)["subtotal"].alias("subtotal"))
    items = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.floor("l_extendedprice").cast("double").alias("amount"))
    return tables.invoice_warnings(items, heads)


@query("""WITH f AS (SELECT DISTINCT p_type AS field FROM part), h AS (SELECT DISTINCT lower(replace(p_type, ' ', '_')) AS header FROM part WHERE p_size > 1 UNION SELECT DISTINCT p_brand FROM part)
 SELECT field, (SELECT min(header) FROM h WHERE regexp_replace(lower(header), '[^a-z0-9]', '', 'g') = regexp_replace(lower(field), '[^a-z0-9]', '', 'g')) AS header FROM f""")
def join10_part_fields(spark, sf_dir):
    """The parts' types as fields, and headers that write them otherwise."""
    part = table(spark, sf_dir, "part")
    headers = part.where("p_size > 1").select(F.lower(F.replace("p_type", F.lit(" "), F.lit("_"))).alias("header")).union(part.select("p_brand")).distinct()
    return tables.field_map(part.select(F.col("p_type").alias("field")).distinct(), headers)


_ANY = " OR ".join(f"regexp_matches(text, '{P.re2(p)}')" for p in P.PERSONAL_DATA.values())


@query(f"SELECT doc_id, sha256(CASE WHEN {_ANY} THEN '' ELSE text END) AS digest FROM documents")
def pipe6_safe_documents(spark, sf_dir):
    """Documents with sensitive values are emptied before they are made part of a page."""
    return pipeline.flatten(documents(spark, sf_dir), clear_sensitive_first=True).select("doc_id", F.sha2("text", 256).alias("digest"))


@query(f"""SELECT doc_id, true AS always, NOT t AS scanned, t AS has_text, ({_ANY}) AS sensitive, regexp_matches(text, '{P.PRIVILEGE}') AS privilege, strlen(text) / 1048576.0 > 0.01 AS large
 FROM (SELECT *, length(regexp_replace(text, '[ \\t\\n\\x0B\\f\\r]+', '', 'g')) >= 20 AS t FROM documents)""")
def pipe3_all_conditions(spark, sf_dir):
    """All six conditions of pipelines on every document."""
    named = {"always": "always", "scanned": "scanned", "has_text": "has-text", "sensitive": "sensitive", "privilege": "privilege"}
    found = {k: pipeline.CONDITIONS[c](F.col("text")).alias(k) for k, c in named.items()} | {"large": pipeline.CONDITIONS["size-over"](F.col("text"), megabytes=0.01).alias("large")}
    return documents(spark, sf_dir).select("doc_id", *found.values())


_SAID_SQL = """lines AS (SELECT o_orderkey AS doc_id, 0 AS line_no, CASE o_orderkey % 4 WHEN 0 THEN 'The settlement amount of $' || format('{:,}', CAST(floor(o_totalprice) AS BIGINT)) || '.50 was sealed' WHEN 1 THEN 'EUR 250.000 paid, 5 million dollars open; ' || repeat('x', CAST(o_custkey % 120 AS INT)) || ' under seal'
 WHEN 2 THEN 'confidential ' || CAST(floor(o_totalprice) AS BIGINT) || ' and 1,234,567 pounds' ELSE 'paid $' || o_custkey END AS line FROM orders)"""


@query(
    f"""WITH {_SAID_SQL}, {located_sql('v', 'lines', {'value': P.VALUE_NEAR}, 'doc_id, line_no', 'line')}, {located_sql('t', 'lines', {'term': P.PRIVILEGE}, 'doc_id, line_no', 'line')}
 SELECT DISTINCT v.doc_id, v.start, v.length, v.text FROM v JOIN t USING (doc_id, line_no) WHERE v.start + v.length >= t.start - 90 AND v.start <= t.start + t.length + 90 AND (v.start + v.length <= t.start OR v.start >= t.start + t.length)"""
)
def ext8_values_near_terms(spark, sf_dir):
    """Amounts within ninety signs of a privilege term, in a sentence for every order."""
    key, s = F.col("o_orderkey"), lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    whole = F.floor("o_totalprice")
    said = F.get(F.array(s("The settlement amount of $", F.format_number(whole, 0), ".50 was sealed"), s("EUR 250.000 paid, 5 million dollars open; ", F.repeat(F.lit("x"), (F.col("o_custkey") % 120).cast("int")), " under seal"), s("confidential ", whole.cast("string"), " and 1,234,567 pounds"), s("paid $", F.col("o_custkey").cast("string"))), (key % 4).cast("int"))
    rows = table(spark, sf_dir, "orders").select(key.alias("doc_id"), F.lit(0).alias("line_no"), said.alias("line"))
    found = X.near(X.pattern_hits(rows, {"value": P.VALUE_NEAR}), X.pattern_hits(rows, {"term": P.PRIVILEGE}), ["doc_id", "line_no"], 90)
    return found.select("doc_id", "start", "length", "text")


_WORD = "(?i)license"


@query(
    f"""WITH {PAGES_SQL}, {located_sql('h', 'doc_pages', {'k': _WORD}, 'doc_id, page_no, text', 'text').replace('found[nth_] AS text', 'found[nth_] AS said')},
 s AS (SELECT doc_id, page_no, start, (CASE WHEN start > 60 THEN '…' ELSE '' END) || trim(regexp_replace(substr(text, greatest(0, start - 60) + 1, least(length(text), start + length + 60) - greatest(0, start - 60)), '\\s+', ' ', 'g')) || (CASE WHEN start + length + 60 < length(text) THEN '…' ELSE '' END) AS snippet FROM h),
 d AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page_no, lower(snippet) ORDER BY start) AS k FROM s), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page_no, start) AS n FROM d WHERE k = 1) SELECT doc_id, page_no, start, snippet FROM r WHERE n <= 50"""
)
def ext12_literal_hits(spark, sf_dir):
    """The first fifty places of a word in each document with sixty signs around, each snippet once a page."""
    plain = F.trim(F.regexp_replace(F.array_join("lines", " "), r"\s+", " "))
    found = pages_of(documents(spark, sf_dir)).select("doc_id", "page_no", plain.alias("text")).where(F.col("text").rlike(_WORD))
    each = F.transform(spans(F.col("text"), _WORD), lambda s: F.struct(s["start"].alias("start"), snippet(F.col("text"), s["start"], s["length"], 60).alias("snippet")))
    placed = found.select("doc_id", "page_no", each.alias("hits"))
    once = F.filter("hits", lambda h, i: ~F.exists(F.slice("hits", F.lit(1), i), lambda o: F.lower(o["snippet"]) == F.lower(h["snippet"])))
    rows = placed.select("doc_id", "page_no", F.explode(once).alias("h")).select("doc_id", "page_no", "h.*")
    order = F.row_number().over(Window.partitionBy("doc_id").orderBy("page_no", "start"))
    return rows.withColumn("n", order).where("n <= 50").drop("n")


def _dots(ahead: str) -> str:
    """SQL: digits that ``ahead`` follows as dots."""
    return f"array_to_string(list_transform(string_split(text, ''), lambda c, i: CASE WHEN regexp_matches(c, '\\d') AND regexp_matches(substr(text, i + 1), '{ahead}') THEN '•' ELSE c END), '')"


_MASK_SQL = f"""CASE WHEN category IN ('ssn', 'phone') THEN {_dots('^[0-9]{4}')} WHEN category = 'creditCard' THEN {_dots('[0-9]{4}')}
 WHEN category = 'email' THEN CASE WHEN strpos(text, '@') <= 2 THEN text ELSE substr(text, 1, 1) || repeat('•', greatest(1, strpos(text, '@') - 2)) || substr(text, strpos(text, '@')) END
 WHEN category = 'iban' THEN substr(text, 1, 4) || repeat('•', greatest(0, length(text) - 8)) || right(text, 4) ELSE text END"""


@query(f"""WITH {LINES_SQL}, found AS ({" UNION ALL ".join(f"SELECT doc_id, line_no, '{c}' AS category, unnest(regexp_extract_all(line, '{P.re2(p)}')) AS text FROM lines" for c, p in P.PERSONAL_DATA.items())}) SELECT doc_id, line_no, category, {_MASK_SQL} AS masked FROM found""")
def fn27_masked_values(spark, sf_dir):
    """Personal data of the documents as it may be shown."""
    found = X.pattern_hits(lines(spark, sf_dir), P.PERSONAL_DATA)
    return found.select("doc_id", "line_no", "category", V.masked(F.col("category"), F.col("text")).alias("masked"))
