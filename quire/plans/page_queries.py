"""Pages as arrays of lines or positioned items: matches across fragments and line breaks, with the SQL that checks each query."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions import patterns as P
from quire.functions.text import matches
from quire.operators import batch, citations, fragments, gate, pipeline
from quire.operators.extraction import any_of
from quire.operators.sequence import strict_ranges
from quire.sources.tables import LINES_A_PAGE, LINES_SQL, documents, pages_of, table

from .legal_queries import located_sql
from .registry import query


# ---- fragments: every line is drawn in pieces of five to eight signs, a little up and down, with a gap before every eleventh
_PIECE_SQL = f"""{LINES_SQL}, cut AS (SELECT doc_id, page_no, line_no, unnest(range(CAST(ceil(length(line) / (5.0 + line_no % 4)) AS BIGINT))) AS i, line, 5 + line_no % 4 AS k FROM lines WHERE length(line) > 0),
 pieces AS (SELECT doc_id, page_no, line_no, i, substr(line, i * k + 1, k) AS str, CAST((line_no % 40) * 1000000 + i AS INT) AS item_no FROM cut),
 edges AS (SELECT *, CASE WHEN i = 0 OR i % 11 = 0 OR regexp_matches(str, '^\\s') OR regexp_matches(lag(str) OVER w, '\\s$') THEN 1 ELSE 0 END AS opens FROM pieces WINDOW w AS (PARTITION BY doc_id, line_no ORDER BY i)),
 placed AS (SELECT *, sum(opens) OVER (PARTITION BY doc_id, line_no ORDER BY i ROWS UNBOUNDED PRECEDING) AS run FROM edges), parts AS (SELECT *, sum(length(str)) OVER (PARTITION BY doc_id, line_no, run ORDER BY i ROWS UNBOUNDED PRECEDING) - length(str) AS at_ FROM placed),
 runs AS (SELECT doc_id, page_no, line_no, run, string_agg(str, '' ORDER BY i) AS line FROM parts GROUP BY doc_id, page_no, line_no, run HAVING count(*) > 1)"""
_EDGES = "length(regexp_extract(substr({0}, 1, h.start), '[^\\s:;=|,]*$'))", "length(regexp_extract(substr({0}, h.start + h.length + 1), '^[^\\s:;=|,]*'))"


@query(
    f"""WITH {_PIECE_SQL}, {located_sql('over', 'runs', P.PERSONAL_DATA, 'doc_id, page_no, line_no, run', 'line')}, {located_sql('own', 'placed', P.PERSONAL_DATA, 'doc_id, page_no, line_no, run, i, str', 'str')},
 wide AS (SELECT h.doc_id, h.page_no, h.line_no, h.run, category, h.start - {_EDGES[0].format('r.line')} AS first, h.start + h.length + {_EDGES[1].format('r.line')} AS last FROM over h JOIN runs r USING (doc_id, line_no, run)),
 across AS (SELECT p.doc_id, p.page_no, category, item_no, str, greatest(0, first - at_) AS first, least(length(str), last - at_) AS last FROM wide w JOIN parts p USING (doc_id, line_no, run) WHERE at_ + length(str) > first AND at_ < last),
 held AS (SELECT h.*, h.start - {_EDGES[0].format('h.str')} AS first, h.start + h.length + {_EDGES[1].format('h.str')} AS last FROM own h),
 chained AS (SELECT p.doc_id, p.page_no, category, item_no, p.str, CASE WHEN p.i = h.i THEN first WHEN p.i < h.i THEN length(p.str) - length(regexp_extract(p.str, '[^\\s:;=|,]*$')) ELSE 0 END AS first,
 CASE WHEN p.i = h.i THEN last WHEN p.i < h.i THEN length(p.str) ELSE length(regexp_extract(p.str, '^[^\\s:;=|,]*')) END AS last FROM held h JOIN placed p USING (doc_id, line_no, run) WHERE p.i = h.i OR (p.i < h.i AND first = 0) OR (p.i > h.i AND last = length(h.str)))
 SELECT DISTINCT doc_id, page_no, category, item_no, CAST(first AS INT) AS start, CAST(last - first AS INT) AS length, substr(str, CAST(first AS INT) + 1, CAST(last - first AS INT)) AS text FROM (SELECT * FROM across UNION ALL SELECT * FROM chained) WHERE last > first"""
)
def ext10_fragments(spark, sf_dir):
    """Personal data that is drawn in several pieces: what to hide of each piece.

    Lines without a digit or an at sign are not cut into pieces, for no pattern can match there.
    """

    def pieces(line, n):
        k = 5 + n % 4
        count = F.ceil(F.length(line) / k).cast("int")
        many = F.sequence(F.lit(0), count - 1)
        return F.when(line.rlike("[0-9@]"), F.transform(many, lambda i: F.struct(
            (n * 1_000_000 + i).cast("int").alias("item_no"), F.substring(line, i * k + 1, k).alias("str"), (6.0 * (i * k + 2 * F.floor(i / 11))).alias("x0"),
            (6.0 * (i * k + 2 * F.floor(i / 11) + F.length(F.substring(line, i * k + 1, k)))).alias("x1"), (12.0 * n + 3.0 * (i % 2)).alias("y"), F.lit(10.0).alias("h"),
        )))

    drawn = F.flatten(F.filter(F.transform("lines", pieces), lambda p: p.isNotNull()))
    return fragments.fragment_hits(pages_of(documents(spark, sf_dir)).select("doc_id", "page_no", drawn.alias("items")), P.PERSONAL_DATA)


# ---- the gate: every value's first place is hidden, titles lose their addresses, then all of it is verified
_KEPT = {k: P.PERSONAL_DATA[k] for k in ("email", "ipAddress")}


def gated_documents(spark, sf_dir):
    """Documents whose addresses and network numbers are hidden where each is first, and whose first line is a title with its addresses hidden."""
    split = documents(spark, sf_dir).where(F.col("text").isNotNull()).select("doc_id", F.split("text", "\n").alias("lines"))
    starts = F.sequence(F.lit(0), F.floor((F.size("lines") - 1) / LINES_A_PAGE).cast("int"))
    pages = F.transform(starts, lambda p: F.array_join(F.slice("lines", p * LINES_A_PAGE + 1, F.lit(LINES_A_PAGE)), "\n"))
    read = split.select("doc_id", pages.alias("pages"), F.get("lines", F.lit(0)).alias("title"))
    of = lambda page: F.concat(*[matches(page, p) for p in _KEPT.values()])
    found = F.flatten(F.transform("pages", lambda t, i: F.transform(of(t), lambda v: F.struct((i + 1).alias("page_no"), v.alias("text")))))
    named = read.select("doc_id", "pages", "title", F.when(F.exists("pages", lambda t: t.rlike(any_of(_KEPT))), found).otherwise(F.array().cast("array<struct<page_no:int,text:string>>")).alias("found"))
    first = F.filter("found", lambda t, i: ~F.exists(F.slice("found", F.lit(1), i), lambda o: o["text"] == t["text"]))
    named = named.select("doc_id", "pages", "title", first.alias("targets"))
    hide = lambda page, t: F.concat(F.substring(page, F.lit(1), F.instr(page, t["text"]) - 1), F.repeat(F.lit("█"), F.length(t["text"])), F.substring(page, F.instr(page, t["text"]) + F.length(t["text"]), F.length(page)))
    hidden = F.transform("pages", lambda p, i: F.aggregate(F.filter("targets", lambda t: t["page_no"] == i + 1), p, lambda page, t: F.when(F.instr(page, t["text"]) > 0, hide(page, t)).otherwise(page)))
    title = F.regexp_replace("title", F.lit(P.java(_KEPT["email"])), F.lit("█"))
    channels = F.array(F.struct(F.lit("annotation").alias("vector"), F.lit("title").alias("label"), title.alias("text")))
    return gate.gated(named.select("doc_id", hidden.alias("pages"), channels.alias("channels"), "targets"), "[page burned]")


_WIDE = "array_to_string(list_transform(string_split({1}, ''), lambda c: printf('%04x', unicode(c))), '')"
_HOLDS = "(contains(lower({0}), lower({1})) OR contains(lower({0}), lower(hex(encode({1})))) OR contains(lower({0}), " + _WIDE + "))"
_GATE_SQL = f"""WITH ln AS (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents WHERE text IS NOT NULL),
 pg AS (SELECT doc_id, lines[1] AS title, list_transform(range(CAST(floor((len(lines) - 1) / 40) AS BIGINT) + 1), lambda p: array_to_string(lines[p * 40 + 1:p * 40 + 40], chr(10))) AS pages FROM ln),
 fv AS (SELECT doc_id, title, pages, list_filter(flatten(list_transform(pages, lambda t, i: list_transform(list_concat({", ".join(f"regexp_extract_all(t, '{P.re2(p)}')" for p in _KEPT.values())}), lambda v: {{'page_no': i, 'text': v}}))), lambda x: true) AS found FROM pg),
 tg AS (SELECT doc_id, title, pages, list_filter(found, lambda t, i: len(list_filter(found[1:i - 1], lambda o: o.text = t.text)) = 0) AS targets FROM fv),
 hd AS (SELECT doc_id, regexp_replace(title, '{P.re2(_KEPT["email"])}', '█', 'g') AS title, targets, list_transform(pages, lambda p, i: (list_reduce(list_prepend({{'page_no': CAST(0 AS BIGINT), 'text': p}}, list_filter(targets, lambda t: t.page_no = i)),
 lambda page, t: {{'page_no': CAST(0 AS BIGINT), 'text': CASE WHEN strpos(page.text, t.text) > 0 THEN substr(page.text, 1, strpos(page.text, t.text) - 1) || repeat('█', length(t.text)) || substr(page.text, strpos(page.text, t.text) + length(t.text)) ELSE page.text END}})).text) AS pages FROM tg),
 bx AS (SELECT doc_id, unnest(targets) AS t FROM hd), ps AS (SELECT doc_id, unnest(pages) AS page, generate_subscripts(pages, 1) AS page_no FROM hd),
 lk AS (SELECT DISTINCT b.doc_id, p.page_no, b.t.text AS needle, b.t.page_no = p.page_no AS own FROM bx b JOIN ps p USING (doc_id) WHERE {_HOLDS.format("p.page", "b.t.text")}),
 bu AS (SELECT DISTINCT doc_id, page_no FROM lk WHERE own), rs AS (SELECT doc_id, count(*) AS n FROM lk ANTI JOIN bu USING (doc_id, page_no) GROUP BY doc_id),
 ch AS (SELECT h.doc_id, count(*) AS n FROM hd h JOIN bx b USING (doc_id) WHERE {_HOLDS.format("h.title", "b.t.text")} GROUP BY h.doc_id),
 bl AS (SELECT doc_id, string_agg(page_no, ',' ORDER BY page_no) AS burned FROM bu GROUP BY doc_id),
 gate AS (SELECT h.doc_id, CASE WHEN coalesce(rs.n, 0) + coalesce(ch.n, 0) > 0 THEN 'blocked' WHEN burned IS NOT NULL THEN 'burned' ELSE 'clean' END AS status, coalesce(burned, '') AS burned, coalesce(ch.n, 0) AS annotation, coalesce(rs.n, 0) AS raw_stream, len(targets) AS removed
 FROM hd h LEFT JOIN rs USING (doc_id) LEFT JOIN ch USING (doc_id) LEFT JOIN bl USING (doc_id))"""


@query(f"{_GATE_SQL} SELECT doc_id, status, burned, annotation + raw_stream AS leaks, CAST(removed AS BIGINT) AS removed FROM gate")
def pipe5_verified_gate(spark, sf_dir):
    """What the gate says of every document: clean, some pages burned, or blocked."""
    done = gated_documents(spark, sf_dir)
    return done.select("doc_id", "status", F.array_join(F.transform("burned", lambda p: p.cast("string")), ",").alias("burned"), F.size("leaks").cast("long").alias("leaks"), F.col("removed").cast("long").alias("removed"))


@query(f"{_GATE_SQL} SELECT CAST(0 AS BIGINT) AS page, CAST(0 AS BIGINT) AS form_field, CAST(sum(annotation) AS BIGINT) AS annotation, CAST(0 AS BIGINT) AS hidden_layer, CAST(0 AS BIGINT) AS attachment, CAST(sum(raw_stream) AS BIGINT) AS raw_stream, CAST(sum(removed) AS BIGINT) AS removed FROM gate")
def agg7_leaks_by_vector(spark, sf_dir):
    """Leaks of each vector over all documents, after the fallback."""
    return gate.leaks_by_vector(gated_documents(spark, sf_dir))


# ---- batches in which documents fail alone
_RANGE = "2-3"


def _extracted(text: str | None) -> str:
    """The pages of a range; a document that lacks one is an error of its own."""
    if text is None:
        raise ValueError("no text")
    lines = text.split("\n")
    pages = -(-len(lines) // LINES_A_PAGE)
    return "\n".join("\n".join(lines[(p - 1) * LINES_A_PAGE : p * LINES_A_PAGE]) for group in strict_ranges(_RANGE, pages) for p in group)


_BATCH_SQL = f"""WITH l AS (SELECT doc_id, source, string_split(text, chr(10)) AS lines FROM documents),
 b AS (SELECT doc_id, source, CASE WHEN lines IS NULL THEN 'no text' WHEN ceil(len(lines) / 40.0) < 3 THEN 'out of bounds: {_RANGE}' END AS error, array_to_string(lines[41:120], chr(10)) AS out FROM l)"""


@query(f"{_BATCH_SQL} SELECT doc_id, CASE WHEN error IS NULL THEN 'done' ELSE 'error' END AS status, error, CASE WHEN error IS NULL THEN sha256(out) END AS digest FROM b")
def pipe7_isolated(spark, sf_dir):
    """Two pages extracted of every document; those that lack them fail alone, with their message."""
    done = documents(spark, sf_dir).select("doc_id", batch.guarded(_extracted)(F.col("text")).alias("outcome"))
    return done.select("doc_id", "outcome.status", "outcome.error", F.sha2("outcome.out", 256).alias("digest"))


@query(f"{_BATCH_SQL} SELECT source, count(*) AS total, count(*) FILTER (WHERE error IS NULL) AS done, count(*) FILTER (WHERE error IS NOT NULL) AS failed FROM b GROUP BY source")
def pipe7_progress(spark, sf_dir):
    """The same in column functions, counted by source."""
    lines = F.split("text", "\n")
    out = F.array_join(F.slice(lines, F.lit(LINES_A_PAGE + 1), F.lit(2 * LINES_A_PAGE)), "\n")
    checks = [(F.col("text").isNull(), "no text"), (F.size(lines) <= 2 * LINES_A_PAGE, f"out of bounds: {_RANGE}")]
    return batch.progress(table(spark, sf_dir, "documents").select("source", batch.checked(out, checks).alias("outcome")), by=["source"])


# ---- citations: a brief for every customer, a page for every month with orders, a line for each of these
_PARTIES = "['Building', 'Machinery & Sons', 'Automobile of the North', 'Furniture', 'Household']"
_BRIEF_SQL = f"""p AS (SELECT o_custkey AS doc_id, month(o_orderdate) AS page_no, o_orderkey, {_PARTIES}[o_orderkey % 5 + 1] AS a, {_PARTIES}[o_custkey % 5 + 1] AS b, o_orderkey % 400 + 1 AS v, o_custkey % 90 + 1 AS n, year(o_orderdate) AS y FROM orders),
 k AS (SELECT *, CASE (o_orderkey // 7) % 6 WHEN 0 THEN 'See ' || a || ' v. ' || b || ', ' || v || ' U.S. ' || n || ' (' || y || ') and' WHEN 1 THEN 'so In re ' || a || ', ' || v || ' F.3d ' || n || ' ( ' || y || ' ).' WHEN 2 THEN 'under ' || (v % 50 + 1) || ' U.S.C. § ' || n || '(a).'
 WHEN 3 THEN 'as in ' || v || ' F. Supp. 2d ' || n || ', 12 N.E.2d 3' WHEN 4 THEN 'Held in ' || b || ' v. ' || a || ',' || chr(10) || v || ' U. S. ' || n ELSE 'No authority' || CASE WHEN doc_id % 4 = 0 THEN ' [table of authorities]' ELSE '' END END AS said FROM p),
 t AS (SELECT doc_id, page_no, string_split(string_agg(said, chr(10) ORDER BY o_orderkey), chr(10)) AS lines FROM k GROUP BY doc_id, page_no), open AS (SELECT * FROM t WHERE NOT contains(array_to_string(lines, ' '), '[table of authorities]'))"""


def briefs(spark, sf_dir):
    """doc_id, page_no, lines."""
    key, cust, name = F.col("o_orderkey"), F.col("o_custkey"), F.array(*map(F.lit, ["Building", "Machinery & Sons", "Automobile of the North", "Furniture", "Household"]))
    a, b, v, n, y = F.get(name, (key % 5).cast("int")), F.get(name, (cust % 5).cast("int")), (key % 400 + 1).cast("string"), (cust % 90 + 1).cast("string"), F.year("o_orderdate").cast("string")
    s = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    said = [
        s("See ", a, " v. ", b, ", ", v, " U.S. ", n, " (", y, ") and"), s("so In re ", a, ", ", v, " F.3d ", n, " ( ", y, " )."), s("under ", (key % 400 + 1) % 50 + 1, " U.S.C. § ", n, "(a)."),
        s("as in ", v, " F. Supp. 2d ", n, ", 12 N.E.2d 3"), s("Held in ", b, " v. ", a, ",\n", v, " U. S. ", n), s("No authority", F.when(cust % 4 == 0, " [table of authorities]").otherwise("")),
    ]
    line = F.get(F.array(*said), (F.floor(key / 7) % 6).cast("int"))
    rows = table(spark, sf_dir, "orders").select(cust.alias("doc_id"), F.month("o_orderdate").alias("page_no"), F.struct(key, line.alias("line")).alias("said"))
    return rows.groupBy("doc_id", "page_no").agg(F.split(F.array_join(F.transform(F.array_sort(F.collect_list("said")), lambda x: x["line"]), "\n"), "\n").alias("lines"))


@query(
    f"""WITH {_BRIEF_SQL}, lined AS (SELECT doc_id, page_no, unnest(lines) AS shown, generate_subscripts(lines, 1) - 1 AS line FROM open), {located_sql('spans', 'lined', P.CITATIONS, 'doc_id, page_no, line', 'shown')},
 r AS (SELECT *, list_position({list(P.CITATIONS)}, category) AS rank FROM spans) SELECT doc_id, page_no, CAST(line AS INT) AS line, category AS kind, start, length, text FROM r a WHERE NOT EXISTS (SELECT 1 FROM r b
 WHERE a.doc_id = b.doc_id AND a.page_no = b.page_no AND a.line = b.line AND b.rank < a.rank AND b.start < a.start + a.length AND a.start < b.start + b.length)"""
)
def ext18_cited(spark, sf_dir):
    """Citations of five kinds in briefs; where two overlap, the more specific kind; pages with a table of authorities are passed over."""
    return citations.citations(briefs(spark, sf_dir))


@query(
    f"""WITH {_BRIEF_SQL}, whole AS (SELECT doc_id, page_no, trim(regexp_replace(array_to_string(lines, ' '), '\\s+', ' ', 'g')) AS body FROM open), {located_sql('spans', 'whole', P.CITATIONS, 'doc_id, page_no, body', 'body')},
 b AS (SELECT *, list_position({list(P.CITATIONS)}, category) AS rank, substr(body, greatest(0, start - 160) + 1, least(start, 160)) AS before, substr(body, start + length + 1, 12) AS after, CASE WHEN category = 'us-code' THEN 'statutes' ELSE 'cases' END AS section FROM spans),
 d AS (SELECT *, CASE WHEN section = 'cases' THEN coalesce(coalesce(nullif(regexp_extract(before, '{P.re2(citations.CASE_BEFORE)}', 1), ''), nullif(regexp_extract(before, '{P.re2(citations.IN_RE_BEFORE)}', 1), '')) || ', ', '') || text
 || coalesce(' (' || nullif(regexp_extract(after, '{citations.YEAR_AFTER}', 1), '') || ')', '') ELSE text END AS display FROM b)
 SELECT doc_id, any_value(section) AS section, display, trim(regexp_replace(lower(display), '^(in re\\s+|ex parte\\s+|matter of\\s+|the\\s+)', '')) AS sort_key, array_to_string(list_sort(list(DISTINCT page_no)), ', ') AS pages,
 arg_min(text, page_no * 100000000 + rank * 10000000 + start) AS citation, arg_min(category, page_no * 100000000 + rank * 10000000 + start) AS kind FROM d GROUP BY doc_id, display"""
)
def agg11_table_of_authorities(spark, sf_dir):
    """Each brief's authorities with the names and years of cases, and the pages that cite them."""
    found = citations.authorities(briefs(spark, sf_dir))
    return found.withColumn("pages", F.array_join(F.transform("pages", lambda p: p.cast("string")), ", "))


# ---- steps on pages
_STEPS = [
    pipeline.Step("drop-blank-pages"), pipeline.Step("extract-pages", {"pages": "4-1, 6"}, "size-over", {"megabytes": 0.002}), pipeline.Step("page-numbers"), pipeline.Step("bates", {"prefix": "ACME", "first": 7}, "sensitive"), pipeline.Step("reverse-pages"),
]
_SIGNS = " OR ".join(f"regexp_matches(v, '{P.re2(p)}')" for p in P.PERSONAL_DATA.values())


def _pages_sql(source: str, text: str) -> str:
    return f"SELECT *, list_transform(range(CAST(floor((len(string_split({text}, chr(10))) - 1) / 40) AS BIGINT) + 1), lambda p: array_to_string(string_split({text}, chr(10))[p * 40 + 1:p * 40 + 40], chr(10))) AS pages FROM {source}"


def _joined_sql(pages: str) -> str:
    return f"array_to_string({pages}, chr(10))"


@query(
    f"""WITH a AS ({_pages_sql('documents', 'text')}), b AS (SELECT doc_id, {_joined_sql("list_filter(pages, lambda p: length(regexp_replace(p, '[ \\t\\n\\x0B\\f\\r]+', '', 'g')) >= 8)")} AS t FROM a),
 c AS ({_pages_sql('b', 't')}), d AS (SELECT doc_id, CASE WHEN strlen(t) / 1048576.0 > 0.002 THEN {_joined_sql("list_filter(pages, lambda p, i: i IN (1, 2, 3, 4, 6))")} ELSE t END AS u, CASE WHEN strlen(t) / 1048576.0 > 0.002 THEN 0 ELSE 1 END AS skipped FROM c),
 e AS ({_pages_sql('d', 'u')}), f AS (SELECT doc_id, skipped, {_joined_sql("list_transform(pages, lambda p, i: p || chr(10) || i || ' of ' || len(pages))")} AS v FROM e), g AS ({_pages_sql('f', 'v')}),
 h AS (SELECT doc_id, CASE WHEN {_SIGNS} THEN {_joined_sql("list_transform(pages, lambda p, i: p || chr(10) || 'ACME' || lpad(CAST(i + 6 AS VARCHAR), 6, '0'))")} ELSE v END AS w, skipped + CASE WHEN {_SIGNS} THEN 0 ELSE 1 END AS skipped FROM g), k AS ({_pages_sql('h', 'w')})
 SELECT doc_id, sha256({_joined_sql('list_reverse(pages)')}) AS digest, skipped FROM k"""
)
def pipe2_page_steps(spark, sf_dir):
    """Steps on the pages of every document: blank ones go, some are taken out of the longer texts, numbers, stamps, the order turned."""
    return pipeline.run(documents(spark, sf_dir), _STEPS).select("doc_id", F.sha2("text", 256).alias("digest"), "skipped")
