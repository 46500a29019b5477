"""Predicates and projections over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions import patterns as P
from quire.operators.extraction import any_of
from quire.sources.tables import LINES_SQL, PAGES_SQL, documents, lines, page_texts, table

from .registry import query, sql_query

_ANY = " OR ".join(f"regexp_matches(text, '{P.re2(p)}')" for p in P.PERSONAL_DATA.values())

@query(f"SELECT doc_id, ({_ANY}) AS sensitive FROM documents")
def pred1_sensitive(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", F.col("text").rlike(any_of(P.PERSONAL_DATA)).alias("sensitive"))


@query(f"SELECT doc_id, regexp_matches(text, '{P.PRIVILEGE}') AS privileged FROM documents")
def pred2_privileged(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", F.col("text").rlike(P.java(P.PRIVILEGE)).alias("privileged"))


@query(f"WITH {LINES_SQL} SELECT doc_id, sum(length(regexp_replace(line, '[ \\t\\n\\x0B\\f\\r]+', '', 'g'))) * 1.0 / count(DISTINCT page_no) < 20 AS scanned FROM lines WHERE page_no <= 10 GROUP BY doc_id")
def pred3_scanned(spark, sf_dir):
    signs = F.length(F.regexp_replace("line", r"\s+", ""))
    return lines(spark, sf_dir).where("page_no <= 10").groupBy("doc_id").agg((F.sum(signs) / F.countDistinct("page_no") < 20).alias("scanned"))


@query("SELECT doc_id, strlen(text) AS bytes FROM documents WHERE strlen(text) / 1048576.0 > 0.01")
def pred4_large(spark, sf_dir):
    size = F.octet_length("text")
    return documents(spark, sf_dir).where(size / 1048576 > 0.01).select("doc_id", size.cast("bigint").alias("bytes"))


@query(f"SELECT doc_id, regexp_matches(text, '{P.STRUCTURED}') AS structured FROM documents")
def pred5_structured(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", F.col("text").rlike(P.java(P.STRUCTURED)).alias("structured"))


sql_query("pred6_active_window", "SELECT event_id, user_id FROM events WHERE event_type <> 'error' AND ts <= TIMESTAMP '2024-01-15 00:00:00' AND (value IS NULL OR value > 0)")
sql_query("pred7_first_visible", "SELECT user_id, CAST(ts AS DATE) AS day, min(event_id) AS event_id FROM events e WHERE (event_type = 'view' OR event_type = 'signup') AND NOT EXISTS (SELECT 1 FROM events d WHERE d.user_id = e.user_id AND CAST(d.ts AS DATE) = CAST(e.ts AS DATE) AND d.event_type = 'purchase') GROUP BY user_id, CAST(ts AS DATE)")


@query("SELECT c_custkey, regexp_matches(lower(replace(c_name, '#', '@')) || '.example', '^[^@\\s]+@[^@\\s]+\\.[^@\\s]+$') AND length(c_name) <= 255 AS valid FROM customer")
def pred8_email_check(spark, sf_dir):
    address = F.concat(F.lower(F.replace("c_name", F.lit("#"), F.lit("@"))), F.lit(".example"))
    return table(spark, sf_dir, "customer").select("c_custkey", (address.rlike(r"^[^@\s]+@[^@\s]+\.[^@\s]+$") & (F.length("c_name") <= 255)).alias("valid"))


sql_query("pred9_support_check", "SELECT conv_id, turn FROM conversations WHERE role IN ('user', 'assistant') AND length(text) BETWEEN 10 AND 2000")


@query(f"WITH {PAGES_SQL} SELECT doc_id, page_no FROM doc_pages WHERE length(replace(text, ' ', '')) < 8")
def pred10_blank_pages(spark, sf_dir):
    return page_texts(lines(spark, sf_dir)).where(F.length(F.replace("text", F.lit(" "))) < 8).select("doc_id", "page_no")


@query(f"WITH {LINES_SQL} SELECT DISTINCT doc_id, page_no, CASE WHEN page_no = 1 THEN 'first' WHEN page_no % 2 = 1 THEN 'odd' ELSE 'even' END AS scope FROM lines")
def pred11_page_scope(spark, sf_dir):
    scope = F.when(F.col("page_no") == 1, "first").when(F.col("page_no") % 2 == 1, "odd").otherwise("even")
    return lines(spark, sf_dir).select("doc_id", "page_no", scope.alias("scope")).distinct()


sql_query("pred12_owner_rows", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey = 7)")


@query(f"WITH {LINES_SQL}, n AS (SELECT doc_id, max(page_no) AS pages, max(line_no) + 1 AS n_lines FROM lines GROUP BY doc_id) SELECT doc_id, pages, CASE WHEN n_lines > 5000 THEN 'block' WHEN n_lines > 150 THEN 'warn' ELSE 'ok' END AS level FROM n")
def pred14_large_guard(spark, sf_dir):
    n = lines(spark, sf_dir).groupBy("doc_id").agg(F.max("page_no").alias("pages"), (F.max("line_no") + 1).alias("n_lines"))
    return n.select("doc_id", "pages", F.when(F.col("n_lines") > 5000, "block").when(F.col("n_lines") > 150, "warn").otherwise("ok").alias("level"))


sql_query("pred16_search_box", "SELECT c_custkey, c_name FROM customer WHERE contains(lower(c_name), '77') OR contains(lower(c_mktsegment), 'auto')")


@query("SELECT conv_id, turn, (CASE WHEN length(t) > 60 THEN substr(t, 1, 60) || '…' ELSE t END) AS snippet FROM (SELECT *, trim(regexp_replace(text, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')) AS t FROM conversations)")
def prj1_snippets(spark, sf_dir):
    t = F.trim(F.regexp_replace("text", r"\s+", " "))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.when(F.length(t) > 60, F.concat(F.substring(t, 1, 60), F.lit("…"))).otherwise(t).alias("snippet"))


@query("SELECT doc_id, array_to_string(string_split(text, ' ')[1:10], ' ') AS head FROM documents")
def prj2_word_snippets(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", F.concat_ws(" ", F.slice(F.split("text", " "), 1, 10)).alias("head"))


sql_query("prj3_labels", "SELECT event_type, CASE event_type WHEN 'view' THEN 'Page view' WHEN 'signup' THEN 'New account' WHEN 'purchase' THEN 'Sale' WHEN 'error' THEN 'Failure' ELSE 'Other' END AS label, count(*) AS n FROM events GROUP BY event_type")
sql_query("prj4_log_entries", "SELECT o_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS entry, CASE l_returnflag WHEN 'A' THEN 'auto' WHEN 'R' THEN 'keyword' ELSE 'manual' END AS origin, CAST(floor(l_extendedprice) AS BIGINT) AS amount FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
