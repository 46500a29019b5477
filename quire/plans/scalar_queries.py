"""Scalar functions over whole columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions import values as V
from quire.functions.text import terms
from quire.operators import sequence
from quire.sources.tables import table

from .registry import query, sql_query

_RAW = ["$1,234.56", "(1,234.56)", "1.234,56", "500.00 DR", "500.00 CR", "-7", "€12", "abc", "", "1,000", "12.5-", "(3) CR"]
_RAW_SQL = "(VALUES " + ",".join(f"({i}, '{x}')" for i, x in enumerate(_RAW)) + ") t(id, raw)"


@query("SELECT id, value FROM (VALUES (0, 1234.56), (1, -1234.56), (2, 1234.56), (3, -500.0), (4, 500.0), (5, -7.0), (6, 12.0), (7, NULL), (8, NULL), (9, 1.0), (10, NULL), (11, 3.0)) t(id, value)")
def fn1_amounts(spark, sf_dir):
    rows = spark.createDataFrame(list(enumerate(_RAW)), "id int, raw string")
    return rows.select("id", V.amount(F.col("raw")).alias("value"))


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN -o_totalprice ELSE o_totalprice END AS value FROM orders")
def fn1_order_amounts(spark, sf_dir):
    """Every order's price written as a statement would write it, and read back."""
    written = F.concat(F.lit("$"), F.format_number("o_totalprice", 2))
    written = F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("("), written, F.lit(")"))).otherwise(written)
    return table(spark, sf_dir, "orders").select("o_orderkey", V.amount(written).alias("value"))


@query("SELECT id, us, eu FROM (VALUES (0, '2024-03-04', '2024-04-03'), (1, '2024-12-25', '2024-12-25'), (2, '2025-04-04', '2025-04-04'), (3, '2024-01-05', '2024-01-05'), (4, '2020-01-05', '2020-01-05'), (5, NULL, NULL), (6, '2024-02-31', '2024-02-31'), (7, '1999-01-02', '1999-02-01')) t(id, us, eu)")
def fn2_dates(spark, sf_dir):
    raw = ["03/04/2024", "25/12/24", "04-APR-2025", "Jan 5, 2024", "5 Jan", "nothing", "2024-02-31", "1.2.99"]
    rows = spark.createDataFrame(list(enumerate(raw)), "id int, raw string")
    return rows.select("id", V.iso_date(F.col("raw"), False, 2020).alias("us"), V.iso_date(F.col("raw"), True, 2020).alias("eu"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders")
def fn2_order_dates(spark, sf_dir):
    written = F.date_format("o_orderdate", "MM/dd/yyyy")
    return table(spark, sf_dir, "orders").select("o_orderkey", V.iso_date(written, False, 2020).alias("day"))


@query("""SELECT doc_id, CASE WHEN len(regexp_extract_all(text, '€|£')) > 1.5 * len(regexp_extract_all(text, '\\$')) THEN 'EU' WHEN len(regexp_extract_all(text, '\\d\\.\\d{3},\\d{2}')) > len(regexp_extract_all(text, '\\d,\\d{3}\\.\\d{2}')) THEN 'EU' ELSE 'US' END AS locale FROM documents""")
def fn3_locales(spark, sf_dir):
    n = lambda pattern: F.regexp_count("text", F.lit(pattern))
    locale = F.when(n("€|£") > 1.5 * n(r"\$"), "EU").when(n(r"\d\.\d{3},\d{2}") > n(r"\d,\d{3}\.\d{2}"), "EU").otherwise("US")
    return table(spark, sf_dir, "documents").select("doc_id", locale.alias("locale"))


@query("SELECT p_partkey, regexp_matches(regexp_replace(p_brand, '(?i)[\\s$€£¥()DRCR,.\\-]', '', 'g'), '^\\d+$') AS numeric_looking FROM part")
def fn4_numeric_looking(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.regexp_replace("p_brand", r"(?i)[\s$€£¥()DRCR,.\-]", "").rlike(r"^\d+$").alias("numeric_looking"))


@query("SELECT event_id, CASE " + " ".join(f"WHEN regexp_matches(lower(event_type || ' ' || props), '{p}') THEN '{c}'" for p, c in V.CATEGORIES) + " ELSE '' END AS category FROM events")
def fn7_categories(spark, sf_dir):
    d = F.lower(F.concat_ws(" ", "event_type", "props"))
    return table(spark, sf_dir, "events").select("event_id", V.chosen([(d.rlike(p), c) for p, c in V.CATEGORIES], "").alias("category"))


# Task and activity codes of time sheets, as they must be for equal results.
_TASK_CODES = [
    "L110", "L120", "L130", "L140", "L150", "L160", "L190",
    "L210", "L220", "L230", "L240", "L250", "L260", "L270", "L280", "L290",
    "L310", "L320", "L330", "L340", "L350", "L390",
    "L410", "L420", "L430", "L440", "L450", "L460", "L470", "L490",
    "L510", "L520", "L530", "L540", "L590",
    "B110", "B120", "B130", "B140", "B150", "B160", "B170", "B180", "B190",
    "B210", "B220", "B230", "B240", "B250", "B260",
    "B310", "B320",
    "B410", "B420", "B430", "B440",
    "C100", "C200", "C300",
    "A101", "A102", "A103", "A104", "A105", "A106", "A107", "A108", "A109", "A110", "A111", "A112",
]
_CODE = "concat('L', CAST(100 + 10 * (l_partkey % 50) AS VARCHAR(9)))"
sql_query("fn8_code_validity", f"SELECT l_suppkey % 10 AS code_group, count(*) AS n, count(*) > 3 AND round(avg(CASE WHEN {_CODE} IN ({', '.join(repr(c) for c in _TASK_CODES)}) THEN 1.0 ELSE 0.0 END), 6) < 0.3 AS doubtful FROM lineitem GROUP BY l_suppkey % 10")


@query("SELECT doc_id, 'ACME' || CASE WHEN length(CAST(doc_id AS VARCHAR)) >= 6 THEN CAST(doc_id AS VARCHAR) ELSE lpad(CAST(doc_id AS VARCHAR), 6, '0') END AS label, 'X-' || lpad(CAST(doc_id % 10000 AS VARCHAR), 4, '0') || '-Z' AS other FROM documents")
def fn9_bates(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", V.bates(F.col("doc_id"), "ACME").alias("label"), V.bates(F.col("doc_id") % 10000, "X-", "-Z", 4).alias("other"))


@query("SELECT c_custkey, CASE WHEN k < 26 THEN chr(CAST(65 + k AS INT)) WHEN k < 702 THEN chr(CAST(65 + (k - 26) // 26 AS INT)) || chr(CAST(65 + (k - 26) % 26 AS INT)) ELSE chr(CAST(65 + (k - 702) // 676 AS INT)) || chr(CAST(65 + (k - 702) // 26 % 26 AS INT)) || chr(CAST(65 + (k - 702) % 26 AS INT)) END AS label FROM (SELECT c_custkey, c_custkey % 18278 AS k FROM customer)")
def fn10_exhibit_labels(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", V.letters(F.col("c_custkey") % 18278).alias("label"))


@query("SELECT p_partkey, array_to_string(list_transform(string_split(trim(regexp_replace(regexp_replace(lower(p_name), '^\\d+[_\\-\\s]*', ''), '[_\\-\\s]+', ' ', 'g')), ' '), lambda w: upper(w[1]) || substr(w, 2)), ' ') AS title FROM part")
def fn11_titles(spark, sf_dir):
    plain = F.trim(F.regexp_replace(F.regexp_replace(F.lower("p_name"), r"^\d+[_\-\s]*", ""), r"[_\-\s]+", " "))
    words = F.transform(F.split(plain, " "), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1000)))
    return table(spark, sf_dir, "part").select("p_partkey", F.concat_ws(" ", words).alias("title"))


_ROMAN = lambda k, one, five, ten: f"(['', '{one}', '{one * 2}', '{one * 3}', '{one}{five}', '{five}', '{five}{one}', '{five}{one * 2}', '{five}{one * 3}', '{one}{ten}'])[CAST(n // {k} % 10 + 1 AS INT)]"


@query(f"SELECT c_custkey, CAST(n AS VARCHAR) || ' of 3999' AS plain, {_ROMAN(1000, 'm', '', '')} || {_ROMAN(100, 'c', 'd', 'm')} || {_ROMAN(10, 'x', 'l', 'c')} || {_ROMAN(1, 'i', 'v', 'x')} AS roman FROM (SELECT c_custkey, c_custkey % 3999 + 1 AS n FROM customer)")
def fn12_page_numbers(spark, sf_dir):
    n = F.col("c_custkey") % 3999 + 1
    return table(spark, sf_dir, "customer").select("c_custkey", F.concat(n.cast("string"), F.lit(" of 3999")).alias("plain"), V.roman(n).alias("roman"))


@query("SELECT conv_id, turn, regexp_replace(replace(replace('{role}_{i}: {col:conv}', '{role}', role), '{i}', CAST(turn AS VARCHAR)), '\\{[^}]*\\}', CAST(conv_id AS VARCHAR)) AS name FROM conversations")
def fn13_templates(spark, sf_dir):
    filled = F.replace(F.replace(F.lit("{role}_{i}: {col:conv}"), F.lit("{role}"), F.col("role")), F.lit("{i}"), F.col("turn").cast("string"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.regexp_replace(filled, F.lit(r"\{[^}]*\}"), F.col("conv_id").cast("string")).alias("name"))


@query("SELECT page_id, substr(trim(regexp_replace(url, '[^A-Za-z0-9._-]+', '_', 'g')), 1, 80) AS name FROM pages")
def fn14_safe_names(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.substring(F.trim(F.regexp_replace("url", r"[^A-Za-z0-9._-]+", "_")), 1, 80).alias("name"))


sql_query("fn16_hashes", "SELECT doc_id, sha2(text, 256) AS digest FROM documents", "SELECT doc_id, sha256(text) AS digest FROM documents")
sql_query("fn18_sizes", "SELECT o_orderkey, CASE WHEN o_totalprice < 1024 THEN 'B' WHEN o_totalprice < 1048576 THEN 'KB' ELSE 'MB' END AS unit, round(CASE WHEN o_totalprice < 1024 THEN o_totalprice WHEN o_totalprice < 1048576 THEN o_totalprice / 1024 ELSE o_totalprice / 1048576 END, 1) AS shown FROM orders")
sql_query(
    "fn19_password_strength",
    "SELECT c_custkey, CAST(length(c_name) >= 8 AS INT) + CAST(length(c_name) >= 12 AS INT) + CAST(c_name RLIKE '[a-z]' AND c_name RLIKE '[A-Z]' AS INT) + CAST(c_name RLIKE '[0-9]' AS INT) + CAST(c_name RLIKE '[^A-Za-z0-9]' AS INT) AS score FROM customer",
    "SELECT c_custkey, CAST(length(c_name) >= 8 AS INT) + CAST(length(c_name) >= 12 AS INT) + CAST(regexp_matches(c_name, '[a-z]') AND regexp_matches(c_name, '[A-Z]') AS INT) + CAST(regexp_matches(c_name, '[0-9]') AS INT) + CAST(regexp_matches(c_name, '[^A-Za-z0-9]') AS INT) AS score FROM customer",
)


sql_query("fn21_html_escape", "SELECT page_id, replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;') AS escaped FROM pages")
sql_query("fn22_fingerprint", "SELECT p_partkey, concat_ws('|', p_brand, p_type, CAST(p_size AS STRING)) AS settings FROM part", "SELECT p_partkey, concat_ws('|', p_brand, p_type, CAST(p_size AS VARCHAR)) AS settings FROM part")


@query("SELECT event_id, CASE WHEN regexp_matches(k, '^\\d+$') THEN 'number' ELSE 'text' END AS kind, CAST(k AS DOUBLE) AS n FROM (SELECT event_id, json_extract_string(props, '$.k') AS k FROM events)")
def fn23_typed_cells(spark, sf_dir):
    k = F.get_json_object("props", "$.k")
    return table(spark, sf_dir, "events").select("event_id", F.when(k.rlike(r"^\d+$"), "number").otherwise("text").alias("kind"), k.try_cast("double").alias("n"))


_LEDES = ["INVOICE_DATE|INVOICE_NUMBER|LINE_ITEM_TOTAL", "20240105|77|100.50", "20240106|78|-3.25", "20240107|79|"]


@query("SELECT * FROM (VALUES (1, '77', 100.5), (2, '78', -3.25), (3, '79', NULL)) t(line_no, invoice, total)")
def fn24_ledes(spark, sf_dir):
    """Pipe-separated lines by the names in their header."""
    rows = spark.createDataFrame(list(enumerate(_LEDES)), "line_no int, line string")
    header = F.first(F.when(F.col("line_no") == 0, F.split("line", r"\|")), ignorenulls=True)
    from pyspark.sql import Window

    named = rows.withColumn("names", header.over(Window.partitionBy(F.lit(0)).orderBy("line_no"))).where("line_no > 0")
    cell = lambda name: F.get(F.split("line", r"\|"), F.array_position("names", name).cast("int") - 1)
    return named.select("line_no", cell("INVOICE_NUMBER").alias("invoice"), V.amount(cell("LINE_ITEM_TOTAL")).alias("total"))


@query("SELECT event_id, regexp_replace(props || ' user' || CAST(user_id AS VARCHAR) || '@mail.example', '(^|\\s)(\\w)\\w*@', '\\1\\2***@', 'g') AS masked FROM events")
def fn27_masked(spark, sf_dir):
    address = F.concat(F.col("props"), F.lit(" user"), F.col("user_id").cast("string"), F.lit("@mail.example"))
    return table(spark, sf_dir, "events").select("event_id", F.regexp_replace(address, r"(^|\s)(\w)\w*@", "$1$2***@").alias("masked"))


sql_query("fn28_relative_time", "SELECT o_orderkey, CASE WHEN d < 60 THEN 'm' WHEN d < 1440 THEN 'h' ELSE 'd' END AS unit FROM (SELECT o_orderkey, o_orderkey % 3000 AS d FROM orders) t")
@query("SELECT c_custkey, CASE WHEN k = 1 THEN base ELSE base || '-' || CAST(k AS VARCHAR) END AS name FROM (SELECT c_custkey, lower(c_mktsegment) AS base, row_number() OVER (PARTITION BY lower(c_mktsegment) ORDER BY c_custkey) AS k FROM customer) t")
def fn29_file_names(spark, sf_dir):
    """Names of outputs by segment; those that repeat get numbers, by ranges of the keys."""
    named = sequence.running(table(spark, sf_dir, "customer").select("c_custkey", F.lower("c_mktsegment").alias("base")), ["base"], "c_custkey", {"k": F.lit(1)})
    return named.select("c_custkey", F.when(F.col("k") == 1, F.col("base")).otherwise(F.concat("base", F.lit("-"), F.col("k").cast("string"))).alias("name"))


sql_query("fn30_preflight", "SELECT doc_id, CASE WHEN n_chars > 20000 THEN 'block' WHEN n_chars > 5000 THEN 'warn' WHEN n_chars > 2000 THEN 'info' ELSE 'ok' END AS level, round(n_chars * 0.03 / 1000, 6) AS minutes FROM documents")


@query("SELECT doc_id, array_to_string(list_filter(regexp_split_to_array(regexp_replace(lower(text), '[^a-z0-9 \\t\\n\\x0B\\f\\r]', ' ', 'g'), '[ \\t\\n\\x0B\\f\\r]+'), lambda t: length(t) > 1 AND NOT list_contains([" + ",".join(f"'{w}'" for w in __import__("quire.functions.patterns", fromlist=["STOPWORDS"]).STOPWORDS) + "], t))[1:6], ' ') AS key FROM documents")
def ret6_query_keys(spark, sf_dir):
    """The first six terms."""
    return table(spark, sf_dir, "documents").select("doc_id", F.concat_ws(" ", F.slice(terms(F.col("text")), 1, 6)).alias("key"))
