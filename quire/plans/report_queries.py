"""Joins, aggregates, top-k and set operations as reports."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quire.operators import joins, reports
from quire.sources.tables import LINES_SQL, documents, lines, table

from .registry import query, sql_query

# ---- joins
sql_query("join1_users", "SELECT c.c_custkey, c.c_name, coalesce(n.n_name, 'none') AS nation, coalesce(CASE WHEN c.c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 'pro' END, 'free') AS plan FROM customer c LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey")
sql_query("join2_lookup", "SELECT o.o_orderkey, c.c_name AS owner FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey")
sql_query("join3_backfill", "SELECT c.c_custkey FROM customer c LEFT JOIN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000) o ON c.c_custkey = o.o_custkey WHERE o.o_custkey IS NULL")
sql_query("join4_dismissed", "SELECT e.event_id, e.user_id FROM events e WHERE e.event_type = 'view' AND NOT EXISTS (SELECT 1 FROM events d WHERE d.event_type = 'error' AND d.user_id = e.user_id AND CAST(d.ts AS DATE) = CAST(e.ts AS DATE))")


@query("SELECT d.doc_id, CAST(b.item_id AS BIGINT) AS item_id FROM documents d JOIN benchmark b ON length(b.text) >= 3 AND contains(lower(d.text), lower(b.text))")
def join5_leaks(spark, sf_dir):
    """Needles (a stated set, in blocks) that survive in any text."""
    return joins.contained_needles(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"), "doc_id", "item_id")


@query("""WITH t AS (SELECT doc_id, text FROM documents UNION ALL SELECT -1 - item_id, 'x ' || lower(hex(text)) || ' y' FROM benchmark WHERE item_id % 3 = 0 UNION ALL SELECT -100000 - item_id, 'x 0' || hex(text) FROM benchmark WHERE item_id % 3 = 1)
 SELECT DISTINCT t.doc_id, CAST(b.item_id AS BIGINT) AS item_id FROM t JOIN benchmark b ON length(b.text) >= 3 AND (contains(t.text, b.text) OR regexp_matches(lower(t.text), '(?:^|[^0-9a-f])(?:[0-9a-f][0-9a-f])*' || lower(hex(b.text))))""")
def join6_encoded_leaks(spark, sf_dir):
    """Needles in any text as they are, as hexadecimal digits, as UTF-16BE, or as hexadecimal digits of that; some planted, on a byte and beside one."""
    items = table(spark, sf_dir, "benchmark")
    key, digits = F.col("item_id").cast("bigint"), F.hex(F.encode("text", "UTF-8"))
    planted = items.where(key % 3 == 0).select((-1 - key).alias("doc_id"), F.concat(F.lit("x "), F.lower(digits), F.lit(" y")).alias("text"))
    beside = items.where(key % 3 == 1).select((-100000 - key).alias("doc_id"), F.concat(F.lit("x 0"), digits).alias("text"))
    return joins.contained_needles(documents(spark, sf_dir).unionByName(planted).unionByName(beside), items, "doc_id", "item_id", encoded=True)




@query("""WITH t AS (SELECT l_orderkey AS page, l_linenumber AS target, l_quantity AS x, l_discount * 100 AS y FROM lineitem WHERE l_returnflag = 'R'),
 b AS (SELECT l_orderkey AS page, l_linenumber AS box, l_quantity AS x, l_discount * 100 AS y FROM lineitem WHERE l_returnflag <> 'R'),
 h AS (SELECT t.page, target, box, row_number() OVER (PARTITION BY t.page, target ORDER BY box) AS k FROM t JOIN b ON t.page = b.page AND t.x < b.x + 10 AND b.x < t.x + 10 AND t.y < b.y + 4 AND b.y < t.y + 4) SELECT page, target, box FROM h WHERE k = 1""")
def join7_rectangles(spark, sf_dir):
    """The first text box that each target rectangle meets, on its own page (PRED13)."""
    box = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("box"), F.col("l_quantity").alias("x"), (F.col("l_discount") * 100).alias("y"), F.lit(10.0).alias("w"), F.lit(4.0).alias("h"), "l_returnflag")
    targets = box.where("l_returnflag = 'R'").withColumnRenamed("box", "target")
    return joins.first_meeting_box(targets, box.where("l_returnflag <> 'R'")).select("page", "target", "box")


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity <= 15 THEN 10.0 WHEN l_quantity <= 25 THEN 20.0 WHEN l_quantity <= 35 THEN 30.0 WHEN l_quantity <= 45 THEN 40.0 ELSE 50.0 END AS column_x FROM lineitem")
def join8_nearest_column(spark, sf_dir):
    """Each cell's nearest anchor, the first of equals."""
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", joins.nearest(F.col("l_quantity"), [10.0, 20.0, 30.0, 40.0, 50.0]).alias("column_x"))


@query(f"""WITH {LINES_SQL}, s AS (SELECT doc_id, line_no, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS starts, length(line) AS n FROM lines),
 d AS (SELECT doc_id, least(100, length(text) - 1) AS spot FROM documents WHERE length(text) > 0) SELECT d.doc_id, s.line_no FROM d JOIN s ON d.doc_id = s.doc_id AND d.spot BETWEEN s.starts AND s.starts + s.n""")
def join9_offset_to_line(spark, sf_dir):
    """The line that holds the sign at place 100."""
    w = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    starts = lines(spark, sf_dir).select("doc_id", "line_no", F.coalesce(F.sum(F.length("line") + 1).over(w), F.lit(0)).alias("starts"), F.length("line").alias("n"))
    spots = table(spark, sf_dir, "documents").where(F.length("text") > 0).select("doc_id", F.least(F.lit(100), F.length("text") - 1).alias("spot"))
    return starts.join(spots, "doc_id").where("spot BETWEEN starts AND starts + n").select("doc_id", "line_no")


sql_query(
    "join10_field_map",
    "WITH f AS (SELECT * FROM (VALUES ('Cust Key'), ('nation-key'), ('ACCT_BAL'), ('missing')) t(field)), h AS (SELECT * FROM (VALUES ('custkey'), ('Nation Key'), ('acctbal'), ('name')) t(header)) SELECT field, header FROM f LEFT JOIN h ON regexp_replace(lower(field), '[^a-z0-9]', '', 'g') = regexp_replace(lower(header), '[^a-z0-9]', '', 'g')".replace(", '', 'g')", ", '')"),
    "WITH f AS (SELECT * FROM (VALUES ('Cust Key'), ('nation-key'), ('ACCT_BAL'), ('missing')) t(field)), h AS (SELECT * FROM (VALUES ('custkey'), ('Nation Key'), ('acctbal'), ('name')) t(header)) SELECT field, header FROM f LEFT JOIN h ON regexp_replace(lower(field), '[^a-z0-9]', '', 'g') = regexp_replace(lower(header), '[^a-z0-9]', '', 'g')",
)
sql_query("join11_cache_split", "SELECT d.doc_id, CASE WHEN e.vec_id IS NULL THEN 'miss' ELSE 'hit' END AS cache FROM documents d LEFT JOIN embeddings e ON d.doc_id = e.vec_id")

# ---- aggregates
sql_query(
    "agg1_by_month",
    "SELECT date_format(o_orderdate, 'yyyy-MM') AS month, round(sum(CASE WHEN o_orderstatus = 'F' THEN o_totalprice ELSE 0 END), 2) AS debit, round(sum(CASE WHEN o_orderstatus <> 'F' THEN o_totalprice ELSE 0 END), 2) AS credit FROM orders WHERE o_orderdate IS NOT NULL GROUP BY date_format(o_orderdate, 'yyyy-MM')",
    "SELECT strftime(o_orderdate, '%Y-%m') AS month, round(sum(CASE WHEN o_orderstatus = 'F' THEN o_totalprice ELSE 0 END), 2) AS debit, round(sum(CASE WHEN o_orderstatus <> 'F' THEN o_totalprice ELSE 0 END), 2) AS credit FROM orders WHERE o_orderdate IS NOT NULL GROUP BY 1",
)
sql_query("agg2_by_category", "SELECT coalesce(nullif(p_brand, ''), 'uncategorized') AS category, round(sum(p_retailprice), 2) AS total FROM part GROUP BY coalesce(nullif(p_brand, ''), 'uncategorized') ORDER BY abs(sum(p_retailprice)) DESC")
sql_query("agg3_snapshot", "SELECT c_mktsegment AS plan, CASE WHEN c_acctbal < 0 THEN 'past_due' WHEN c_acctbal < 1000 THEN 'trialing' ELSE 'active' END AS status, count(*) AS n, count(*) FILTER (WHERE c_acctbal > 0) AS active, round(sum(CASE WHEN c_acctbal > 0 THEN c_acctbal ELSE 0 END), 2) AS revenue FROM customer GROUP BY GROUPING SETS ((c_mktsegment), (CASE WHEN c_acctbal < 0 THEN 'past_due' WHEN c_acctbal < 1000 THEN 'trialing' ELSE 'active' END), ())")
sql_query("agg4_counts_by_type", "SELECT event_type, user_id % 10 AS page, count(*) AS n FROM events GROUP BY event_type, user_id % 10")
sql_query("agg5_ledger", "SELECT l_returnflag AS label, l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_returnflag, l_orderkey ORDER BY l_linenumber) AS entry, count(*) OVER (PARTITION BY l_returnflag, l_orderkey) AS group_size FROM lineitem")
sql_query("agg6_type_counts", "SELECT role, count(*) AS n, count(DISTINCT conv_id) AS conversations FROM conversations GROUP BY role")
sql_query("agg7_leak_vectors", "SELECT count(*) FILTER (WHERE event_type = 'view') AS pages, count(*) FILTER (WHERE event_type = 'click') AS fields, count(*) FILTER (WHERE event_type = 'signup') AS annotations, count(*) FILTER (WHERE event_type = 'purchase') AS layers, count(*) FILTER (WHERE event_type = 'error') AS attachments, count(*) - count(*) FILTER (WHERE event_type = 'view') AS removed FROM events")


@query("SELECT count(*) AS n, round(avg(len(string_split(text, ' '))), 6) AS avg_len, CAST(max(len(string_split(text, ' '))) AS INT) AS longest FROM documents")
def agg8_corpus_lengths(spark, sf_dir):
    n = F.size(F.split("text", " "))
    return table(spark, sf_dir, "documents").agg(F.count("*").alias("n"), F.round(F.avg(n), 6).alias("avg_len"), F.max(n).alias("longest"))


@query("SELECT l_orderkey, list_sort(list(l_quantity))[CAST(floor(count(*) / 2) AS INT) + 1] AS upper_median FROM lineitem GROUP BY l_orderkey")
def agg9_upper_median(spark, sf_dir):
    return reports.nearest_rank(table(spark, sf_dir, "lineitem"), ["l_orderkey"], "l_quantity", 0.5, 1).withColumnRenamed("rank_value", "upper_median")


@query(f"""WITH {LINES_SQL}, p AS (SELECT doc_id, count(DISTINCT page_no) AS pages FROM lines GROUP BY doc_id), r AS (SELECT doc_id, substr(line, 1, 40) AS head, count(DISTINCT page_no) AS n FROM lines GROUP BY 1, 2),
 x AS (SELECT r.doc_id, head FROM r JOIN p USING (doc_id) WHERE n >= greatest(3, floor(0.6 * pages))) SELECT l.doc_id, l.line_no FROM lines l WHERE NOT EXISTS (SELECT 1 FROM x WHERE x.doc_id = l.doc_id AND x.head = substr(l.line, 1, 40))""")
def agg10_without_running_lines(spark, sf_dir):
    """Lines without running headers: those that recur on most pages."""
    return reports.without_running_lines(lines(spark, sf_dir)).select("doc_id", "line_no")


@query("SELECT event_type, string_agg(DISTINCT CAST(user_id % 20 AS VARCHAR), ',' ORDER BY CAST(user_id % 20 AS VARCHAR)) AS pages, arg_min(event_id, event_id) AS first_seen FROM events GROUP BY event_type")
def agg11_authorities(spark, sf_dir):
    pages = F.array_join(F.array_sort(F.collect_set((F.col("user_id") % 20).cast("string"))), ",")
    return table(spark, sf_dir, "events").groupBy("event_type").agg(pages.alias("pages"), F.min_by("event_id", "event_id").alias("first_seen"))


sql_query("agg12_usage_share", "WITH t AS (SELECT count(DISTINCT l_orderkey) AS pages FROM lineitem) SELECT l_suppkey, count(DISTINCT l_orderkey) AS used_on, round(count(DISTINCT l_orderkey) * 1.0 / max(pages), 9) AS share FROM lineitem CROSS JOIN t GROUP BY l_suppkey HAVING count(DISTINCT l_orderkey) >= 2")


@query("SELECT label, max(round(list_dot_product(CAST(embedding AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 0)), 6)) AS score FROM embeddings GROUP BY label")
def agg13_max_pool(spark, sf_dir):
    from quire.operators import retrieval

    vectors = table(spark, sf_dir, "embeddings")
    return retrieval.scored_by_dot(vectors, retrieval.vector_of(vectors, 0)).groupBy("label").agg(F.max(F.round("score", 6)).alias("score"))


@query("SELECT event_type, round(avg(value), 6) AS mean, list_sort(list(value))[CAST(least(count(value) - 1, floor(0.95 * count(value))) AS INT) + 1] AS p95 FROM events GROUP BY event_type")
def agg14_mean_and_p95(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    ranked = reports.nearest_rank(events, ["event_type"], "value", 0.95).withColumnRenamed("rank_value", "p95")
    return events.groupBy("event_type").agg(F.round(F.avg("value"), 6).alias("mean")).join(ranked, "event_type", "left")


sql_query("agg15_reconciliation", "SELECT o.o_orderkey, abs(sum(l.l_extendedprice) - max(o.o_totalprice)) > 0.05 AS off FROM orders o JOIN lineitem l ON o.o_orderkey = l.l_orderkey GROUP BY o.o_orderkey")


@query("SELECT source, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY doc_id) AS ids FROM documents GROUP BY source")
def agg16_grouped_ids(spark, sf_dir):
    ids = F.transform(F.array_sort(F.collect_list("doc_id")), lambda x: x.cast("string"))
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.array_join(ids, ",").alias("ids"))


sql_query("agg17_readiness", "SELECT user_id, bool_or(event_type = 'error') AS any_warn, bool_or(event_type = 'purchase') AS any_fixable, count(*) FILTER (WHERE event_type = 'click') AS clicks FROM events GROUP BY user_id")
sql_query("agg18_bounding_boxes", "SELECT l_orderkey, min(l_quantity) AS x0, max(l_quantity) AS x1, min(l_extendedprice) AS y0, max(l_extendedprice) AS y1 FROM lineitem GROUP BY l_orderkey")
sql_query("agg19_two_levels", "WITH g AS (SELECT event_type, user_id % 5 AS snippet, count(*) AS n FROM events GROUP BY event_type, user_id % 5) SELECT event_type, snippet, n, CAST(sum(n) OVER (PARTITION BY event_type) AS BIGINT) AS of_type FROM g")


@query("SELECT source, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS signs, string_agg(DISTINCT lang, ',' ORDER BY lang) AS langs FROM documents GROUP BY source")
def agg20_merged_summaries(spark, sf_dir):
    """Partial summaries of id ranges, merged: counts add up, sets unite."""
    docs = table(spark, sf_dir, "documents")
    parts = docs.groupBy("source", (F.col("doc_id") % 8).alias("part")).agg(F.count("*").alias("n"), F.sum("n_chars").alias("signs"), F.collect_set("lang").alias("langs"))
    langs = F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list("langs")))), ",")
    return parts.groupBy("source").agg(F.sum("n").alias("n"), F.sum("signs").alias("signs"), langs.alias("langs"))


# ---- top-k
sql_query("top5_latest", "SELECT event_id, user_id FROM events ORDER BY event_id DESC LIMIT 500")
sql_query("top6_margin", "WITH s AS (SELECT o_custkey, o_totalprice AS score, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS k, lead(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS runner_up FROM orders) SELECT o_custkey, CASE WHEN runner_up IS NULL OR score - runner_up >= 0.05 * score THEN 'clear' ELSE 'ambiguous' END AS verdict FROM s WHERE k = 1")


@query("""SELECT p_partkey, CASE WHEN p_size <= 10 THEN 0 WHEN p_size <= 30 THEN 1 ELSE 2 END AS section, lower(regexp_replace(p_name, '^(?:In re|Ex parte|Matter of|The)\\s+', '', 'i')) AS sort_key FROM part""")
def top7_sort_keys(spark, sf_dir):
    section = F.when(F.col("p_size") <= 10, 0).when(F.col("p_size") <= 30, 1).otherwise(2)
    return table(spark, sf_dir, "part").select("p_partkey", section.alias("section"), reports.sort_key(F.col("p_name")).alias("sort_key")).orderBy("section", "sort_key", "p_partkey")


sql_query("top8_pins", "WITH c AS (SELECT event_type AS tool, 1 AS tier, -count(*) AS rank FROM events GROUP BY event_type HAVING count(*) >= 2 UNION ALL SELECT * FROM (VALUES ('purchase', 0, 0), ('merge', 2, 0), ('split', 2, 1), ('view', 2, 2)) t(tool, tier, rank)), d AS (SELECT *, row_number() OVER (PARTITION BY tool ORDER BY tier, rank) AS k FROM c) SELECT tool, tier FROM d WHERE k = 1 ORDER BY tier, rank, tool LIMIT 6")

# ---- set operations
sql_query("set1_union", "SELECT 'customer' AS kind, c_custkey AS id FROM customer UNION ALL SELECT 'supplier' AS kind, s_suppkey AS id FROM supplier")
@query("SELECT row_number() OVER (ORDER BY file, id) AS ord, file, id FROM (SELECT 1 AS file, c_custkey AS id FROM customer UNION ALL SELECT 2 AS file, o_orderkey AS id FROM orders) t")
def set2_concatenated(spark, sf_dir):
    """The pages of several files as one, numbered on: by ranges in each file, after all that the files before it hold."""
    from quire.operators import sequence

    files = [table(spark, sf_dir, name).select(F.lit(k).alias("file"), F.col(key).alias("id"), F.lit(1).alias("one")) for k, (name, key) in enumerate((("customer", "c_custkey"), ("orders", "o_orderkey")), 1)]
    return sequence.concatenated(files, "id", "one").select(F.col("last_number").alias("ord"), "file", "id")


sql_query("set5_ordered_distinct", "SELECT o_custkey, o_orderpriority, first_order, row_number() OVER (PARTITION BY o_custkey ORDER BY first_order) AS ord FROM (SELECT o_custkey, o_orderpriority, min(o_orderkey) AS first_order FROM orders GROUP BY o_custkey, o_orderpriority) t")
sql_query("set10_distinct", "SELECT DISTINCT lower(event_type) AS needle FROM events WHERE length(event_type) >= 3")
