"""The registered queries op1 to op13: thin, over whole tables, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontamination, fingerprints, jaccard_join, language_model, merkle, personal_data, quality, ranked_search, secret_scan, sharding, token_counts, toxicity
from .common import ASCII_LOWER, ASCII_UPPER, table


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = sharding.shard(table(spark, sf_dir, "documents"), shards=24)
    return done.select("doc_id", "size", F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"), "law", "shard", "slot", "grown_shard")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.linked(table(spark, sf_dir, "documents"), width=4, percent=85)


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.digest(decontamination.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(secret_scan.scan(table(spark, sf_dir, "documents")))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), digests=True)


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.digest(fingerprints.compared(table(spark, sf_dir, "documents")))


def op8_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.scored(table(spark, sf_dir, "documents"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return counted.withColumn("over_limit", F.col("n_tokens") > 1024)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = ranked_search.indexed(table(spark, sf_dir, "documents"))
    return ranked_search.search(index, table(spark, sf_dir, "benchmark"), k=50)


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.checked(table(spark, sf_dir, "documents"))


def op13_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data.digest(personal_data.detect(table(spark, sf_dir, "documents")))


OPERATORS = [
    op1_sharding, op2_quality, op3_jaccard_join, op4_decontamination, op5_secret_scan, op6_bpe, op7_fingerprints, op8_language_model, op9_token_counts, op10_toxicity,
    op11_ranked_search, op12_merkle_manifest, op13_personal_data,
]
QUERIES = {f.__name__: f for f in OPERATORS}

# ---- DuckDB's rows for what SQL can express
_LOW = f"translate(coalesce(text, ''), '{ASCII_UPPER}', '{ASCII_LOWER}')"
_WINDOWED = "string_agg(term, ' ') OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN CURRENT ROW AND {} FOLLOWING)"

_JACCARD_SQL = f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOW}, '[^\\x20\\x09-\\x0D]+') AS words FROM documents), t AS (SELECT doc_id, len(words) AS n, unnest(words) AS term, generate_subscripts(words, 1) AS p FROM w),
 g AS (SELECT doc_id, n, p, {_WINDOWED.format(3)} AS g FROM t), s AS (SELECT DISTINCT doc_id, hash(g) AS g FROM g WHERE p <= greatest(1, n - 3)), z AS (SELECT doc_id, count(*) AS size FROM s GROUP BY doc_id),
 c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
 l AS (SELECT a, b FROM c JOIN z x ON x.doc_id = a JOIN z y ON y.doc_id = b WHERE 100 * common >= 85 * (x.size + y.size - common)), e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
 r AS (SELECT a AS node, a AS reached FROM e UNION SELECT r.node, e.b FROM r JOIN e ON r.reached = e.a), m AS (SELECT node, min(reached) AS least FROM r GROUP BY node)
 SELECT d.doc_id, coalesce(size, 0) AS n_shingles, coalesce(least, d.doc_id) AS component_id FROM documents d LEFT JOIN z ON z.doc_id = d.doc_id LEFT JOIN m ON m.node = d.doc_id"""

_RUNS = " UNION ALL ".join(f"SELECT doc_id, p, {n} AS n, {_WINDOWED.format(n - 1)} AS g FROM t WHERE EXISTS (SELECT 1 FROM iw WHERE iw.n = {n})" for n in range(1, 11))
_LEAKS_SQL = f"""WITH w AS (SELECT doc_id, list_filter(string_split_regex({_LOW}, '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS words FROM documents), t AS (SELECT doc_id, len(words) AS n_words, unnest(words) AS term, generate_subscripts(words, 1) AS p FROM w),
 i AS (SELECT CAST(item_id AS VARCHAR) AS item_id, list_filter(string_split_regex({_LOW}, '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS words FROM benchmark), iw AS (SELECT DISTINCT item_id, least(len(words), 10) AS n, array_to_string(words[s:s + least(len(words), 10) - 1], ' ') AS g
 FROM (SELECT item_id, words, unnest(range(1, greatest(1, len(words) - 9) + 1)) AS s FROM i WHERE len(words) > 0)), runs AS ({_RUNS}), m AS (SELECT DISTINCT doc_id, item_id, p, n FROM runs JOIN iw USING (n, g)),
 h AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM m) GROUP BY doc_id), k AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS ids FROM m GROUP BY doc_id),
 ln AS (SELECT term, count(*) AS n FROM t WHERE term IN (SELECT unnest(words) FROM i) GROUP BY term), need AS (SELECT item_id, term FROM (SELECT item_id, term, row_number() OVER (PARTITION BY item_id ORDER BY n, term) AS k FROM (SELECT DISTINCT item_id, unnest(words) AS term FROM i) JOIN ln USING (term)) WHERE k <= 3),
 sizes AS (SELECT item_id, count(*) AS needed FROM need GROUP BY item_id), spot AS (SELECT DISTINCT doc_id, item_id, p, term FROM t JOIN need USING (term)),
 close AS (SELECT DISTINCT doc_id, item_id FROM (SELECT a.doc_id, a.item_id, a.p, count(DISTINCT b.term) AS met FROM spot a JOIN spot b ON a.doc_id = b.doc_id AND a.item_id = b.item_id AND b.p BETWEEN a.p - 19 AND a.p GROUP BY a.doc_id, a.item_id, a.p) JOIN sizes USING (item_id) WHERE met = needed),
 c AS (SELECT doc_id, count(*) AS n_near, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM close GROUP BY doc_id)
 SELECT w.doc_id, len(words) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(k.ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, coalesce(n_near, 0) AS n_near_items, sha256(coalesce(c.ids, '')) AS near_items_sha256
 FROM w LEFT JOIN h USING (doc_id) LEFT JOIN k USING (doc_id) LEFT JOIN c USING (doc_id)"""

#: the contract's patterns as DuckDB reads them, and the method's own tokens
_KINDS = [("assign", 0, "(?i)(password|passwd|secret|token|api_?key)[\"'']?\\x20*[:=]\\x20*[\"'']?([A-Za-z0-9+/_.=-]+)", 2), ("access", 1, "AKIA[A-Z0-9]+", 0), ("hex", 2, "[0-9a-f]+", 0), ("live", 3, "[A-Za-z0-9+/_=-]{20,}", 0)]
_FOUND = " UNION ALL ".join(f"SELECT doc_id, source, body, {rank} AS rank, regexp_extract_all(body, '{p}') AS m, regexp_extract_all(body, '{p}', {group}) AS v, string_split_regex(body, '{p}') AS gaps FROM d" for _, rank, p, group in _KINDS)
_NAMES = "['assign', 'access', 'hex', 'live', 'shared'][rank + 1]"
_SECRETS_SQL = f"""WITH d AS (SELECT doc_id, source, coalesce(text, '') AS body FROM documents), f AS ({_FOUND}), u AS (SELECT doc_id, source, body, rank, unnest(m) AS m, unnest(v) AS v, unnest(list_transform(gaps[1:len(m)], lambda x: length(x))) AS gap, generate_subscripts(m, 1) AS i FROM f WHERE len(m) > 0),
 o AS (SELECT doc_id, source, body, rank, v, CAST(sum(gap + length(m)) OVER (PARTITION BY doc_id, rank ORDER BY i ROWS UNBOUNDED PRECEDING) AS BIGINT) AS fin, length(m) AS n FROM u),
 s AS (SELECT doc_id, source, body, rank, v, fin - n AS start, fin FROM o WHERE (rank = 0 AND length(v) >= 6) OR (rank = 1 AND n >= 20) OR (rank = 2 AND n >= 24) OR (rank = 3 AND regexp_matches(v, '[a-z]') AND regexp_matches(v, '[A-Z]') AND regexp_matches(v, '[0-9]'))),
 kept AS (SELECT * FROM s x WHERE rank < 3 OR NOT EXISTS (SELECT 1 FROM s y WHERE y.doc_id = x.doc_id AND y.rank < 3 AND y.start < x.fin AND x.start < y.fin)),
 classes AS (SELECT v, CASE WHEN repositories >= 3 THEN 'example' WHEN repositories = 1 OR owners <= 1 THEN 'live' ELSE 'shared' END AS class FROM (SELECT v, count(DISTINCT coalesce('=' || source, '')) AS repositories, count(DISTINCT body) AS owners FROM kept GROUP BY v)),
 j AS (SELECT *, start || ':' || fin AS place FROM kept JOIN classes USING (v)), b AS (SELECT doc_id, count(*) FILTER (WHERE rank = 0) AS n_assign, count(*) FILTER (WHERE rank = 1) AS n_access, count(*) FILTER (WHERE rank = 2) AS n_hex,
 string_agg({_NAMES} || ':' || place, ',' ORDER BY start, rank) FILTER (WHERE rank < 3) AS base, string_agg({_NAMES} || ':' || place, ',' ORDER BY start, rank) FILTER (WHERE rank < 3 OR class = 'live') AS spans,
 count(*) FILTER (WHERE rank < 3 AND class = 'example') AS n_example, count(*) FILTER (WHERE rank < 3 AND class = 'live') AS n_live, count(*) FILTER (WHERE rank < 3 AND class = 'shared') AS n_shared,
 string_agg('shared:' || place, ',' ORDER BY start) FILTER (WHERE rank = 3 AND class = 'shared') AS shared_spans FROM j GROUP BY doc_id)
 SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_example, 0) AS n_example, coalesce(n_live, 0) AS n_live,
 coalesce(n_shared, 0) AS n_shared, coalesce(shared_spans, '') AS shared_spans FROM d LEFT JOIN b USING (doc_id)"""

_SEARCH_SQL = f"""WITH w AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all({_LOW}, '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS words FROM documents), s AS (SELECT count(*) FILTER (WHERE len(words) > 0) AS docs, sum(len(words)) AS total FROM w),
 t AS (SELECT r, doc_id, len(words) AS n, unnest(words) AS term FROM w), q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all({_LOW}, '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM benchmark),
 c AS (SELECT r, doc_id, n, term, count(*) AS tf FROM t WHERE term IN (SELECT term FROM q) GROUP BY r, doc_id, n, term), f AS (SELECT term, CAST(floor(1000 * ln((2.0::DOUBLE * any_value(docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS weight FROM c, s GROUP BY term),
 p AS (SELECT r, doc_id, term, (1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // CAST(total AS BIGINT))) AS impact FROM c, s),
 g AS (SELECT item_id, doc_id, r, CAST(sum(weight * impact) AS BIGINT) AS score FROM q JOIN f USING (term) JOIN p USING (term) GROUP BY item_id, doc_id, r)
 SELECT item_id, CAST(rank AS INT) AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM g WHERE score > 0) WHERE rank <= 50"""

_FIELDS = " || ".join(f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')" for c in ("doc_id", "source", "lang", "n_chars"))
_CRC = "list_reduce(list_prepend(4294967295, list_transform(str_split(coalesce(CAST(doc_id AS VARCHAR), ''), ''), lambda d: CASE d WHEN '' THEN NULL ELSE CAST(ascii(d) AS BIGINT) END)), lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, k: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END))"
_CLIMB = "SELECT tree, level + 1, pos // 3, (n + 2) // 3, sha256(string_agg(node, '' ORDER BY pos)) FROM {0} WHERE n > 1 GROUP BY tree, level, pos // 3, n"
_MERKLE_SQL = f"""WITH RECURSIVE raw AS (SELECT doc_id, source, text, {_FIELDS} AS fields, CASE WHEN doc_id IS NULL OR xor({_CRC}, 4294967295) % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS changed FROM documents),
 hashed AS (SELECT doc_id, source, sha256(fields || coalesce(strlen(text) || ':' || text, '-')) AS leaf, sha256(fields || coalesce(strlen(changed) || ':' || changed, '-')) AS tampered FROM raw),
 leaves AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n, row_number() OVER () AS r FROM hashed),
 up AS (SELECT source AS tree, 0 AS level, pos, n, leaf AS node FROM leaves UNION ALL {_CLIMB.format('up')}), tops AS (SELECT tree, node, row_number() OVER (ORDER BY tree NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM up WHERE n = 1),
 over AS (SELECT 0 AS tree, 0 AS level, pos, n, node FROM tops UNION ALL {_CLIMB.format('over')}), runs AS (SELECT tree, level, pos // 3 AS run, list(node ORDER BY pos) AS nodes FROM up WHERE n > 1 GROUP BY tree, level, pos // 3),
 higher AS (SELECT level, pos // 3 AS run, list(node ORDER BY pos) AS nodes FROM over WHERE n > 1 GROUP BY level, pos // 3), cut AS (
 SELECT l.r, runs.level, nodes, CAST((l.pos // CAST(pow(3, level) AS BIGINT)) % 3 AS BIGINT) AS k FROM leaves l JOIN runs ON runs.tree IS NOT DISTINCT FROM l.source AND run = l.pos // CAST(pow(3, level + 1) AS BIGINT)
 UNION ALL SELECT l.r, 1000 + higher.level, nodes, CAST((t.pos // CAST(pow(3, level) AS BIGINT)) % 3 AS BIGINT) FROM leaves l JOIN tops t ON t.tree IS NOT DISTINCT FROM l.source JOIN higher ON run = t.pos // CAST(pow(3, level + 1) AS BIGINT)),
 steps AS (SELECT r, list({{'a': array_to_string(nodes[1:k], ''), 'b': array_to_string(nodes[k + 2:], '')}} ORDER BY level) AS path FROM cut GROUP BY r), root AS (SELECT node AS root FROM over WHERE n = 1),
 done AS (SELECT doc_id, leaf, t.node AS subroot, root, sha256(coalesce(array_to_string(list_transform(path, lambda x: x.a || x.b), ''), '')) AS proof_sha256,
 (list_reduce(list_prepend({{'a': tampered, 'b': ''}}, coalesce(path, [])), lambda h, x: {{'a': sha256(x.a || h.a || x.b), 'b': ''}})).a AS folded_root FROM leaves l JOIN tops t ON t.tree IS NOT DISTINCT FROM l.source CROSS JOIN root LEFT JOIN steps USING (r))
 SELECT *, folded_root = root AS verified FROM done"""

ORACLE_SQL: dict[str, str] = {"op3_jaccard_join": _JACCARD_SQL, "op4_decontamination": _LEAKS_SQL, "op5_secret_scan": _SECRETS_SQL, "op11_ranked_search": _SEARCH_SQL, "op12_merkle_manifest": _MERKLE_SQL}
