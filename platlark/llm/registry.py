"""Queries of the training-data operators and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from platlark.llm import collocations, imatch, mixing, native_quality, ordering, packing, retention, simhash, spans, suffix_dedup, templates, url_rules, warc


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    trusted = _read(spark, sf_dir, "labels").filter("quality = 1").select("doc_id")
    return native_quality.quality(docs, trusted)


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.components(_read(spark, sf_dir, "documents"))
    return found.select(
        F.col("id").alias("doc_id"),
        F.lower(F.hex("code")).alias("fingerprint"),
        F.col("component").alias("component_id"),
    )


#: The rules that the url query applies: action, host, path.
URL_RULES = [
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
]


def op5_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "action string, host string, path string")
    return url_rules.judge(_read(spark, sf_dir, "pages"), rules).withColumnRenamed("id", "page_id")


OP5_SQL = """
WITH cut AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
  FROM pages
), parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM cut
), hits AS (
  SELECT p.page_id, p.host, p.path, r.host || r.path AS rule, r.action, length(r.host || r.path) AS size
  FROM parts p JOIN (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'),
                            ('allow', 'org', '/fr/')) r(action, host, path)
    ON (p.host = r.host OR p.host LIKE '%.' || r.host) AND starts_with(p.path, r.path)
), best AS (SELECT page_id, arg_max(rule, size) AS rule, arg_max(action, size) AS action FROM hits GROUP BY page_id)
SELECT p.page_id, coalesce(p.host, '') AS host, coalesce(p.path, '') AS path, b.rule, coalesce(b.action, 'allow') AS verdict
FROM parts p LEFT JOIN best b USING (page_id)
"""


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_read(spark, sf_dir, "documents"))


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = spans.remove_repeats(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_sentences", "n_removed", "text")


def op8_poisson_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_read(spark, sf_dir, "documents"))


OP8_SQL = """
WITH sizes AS (SELECT source, sum(length(coalesce(text, '')))::DOUBLE AS size FROM documents GROUP BY source),
rates AS (
  SELECT source, CASE WHEN size > 0
           THEN pow(size, 0.5) / (SELECT sum(pow(size, 0.5)) FROM sizes) * (SELECT sum(size) FROM sizes) / size
           ELSE 1.0 END AS rate
  FROM sizes
), means AS (SELECT source, greatest(1, ceil(rate / 8.0))::INT AS draws, rate / greatest(1, ceil(rate / 8.0)) AS mean FROM rates),
cdf AS (
  SELECT source, k, sum(exp(-mean + k * ln(mean) - lgamma(k + 1.0))) OVER (PARTITION BY source ORDER BY k) AS c
  FROM means, range(64) t(k)
), draws AS (
  SELECT d.k, d.source, j, ('0x' || substr(md5(d.k || ':42:' || j), 1, 13))::BIGINT / 4503599627370496.0 AS u
  FROM (SELECT DISTINCT coalesce(doc_id::VARCHAR, md5(coalesce(text, ''))) AS k, source FROM documents) d JOIN means m ON d.source IS NOT DISTINCT FROM m.source, LATERAL (SELECT unnest(range(1, m.draws + 1)) AS j)
), counts AS (
  SELECT w.k, w.source, count(*) AS n FROM draws w JOIN cdf c ON w.source IS NOT DISTINCT FROM c.source AND c.c <= w.u GROUP BY w.k, w.source
)
SELECT d.*, copy::INT AS copy, md5(c.k || ':42:order:' || copy) AS shuffle_key
FROM documents d JOIN counts c ON c.k = coalesce(d.doc_id::VARCHAR, md5(coalesce(d.text, ''))) AND c.source IS NOT DISTINCT FROM d.source, LATERAL (SELECT unnest(range(1, n + 1)) AS copy)
"""


#: Base32 of a SHA-1: five hex digits at a time are four letters.
_BASE32 = "array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (('0x' || substr(s, 5 * (k // 4) + 1, 5))::BIGINT >> (15 - 5 * (k % 4))) % 32 + 1, 1) FOR k IN range(32)], '')"
OP2_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS s FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY s) AS first FROM p)
SELECT page_id, strlen(h)::BIGINT AS payload_bytes, {_BASE32} AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM f
"""


def op2_warc_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_read(spark, sf_dir, "pages"))


def op3_imatch_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imatch.compare_next(_read(spark, sf_dir, "documents"))


def op9_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordering.round_trip(_read(spark, sf_dir, "documents"))


def op4_template_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return templates.main_text(_read(spark, sf_dir, "pages"))


def op11_retention_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retention.retention(_read(spark, sf_dir, "clicks"), _read(spark, sf_dir, "clients"))


#: CRC-32 of a decimal number: its table of 256 follows from the reversed polynomial.
_CRC_TABLE = """crc AS (
  SELECT list(list_reduce([b] || range(8), lambda x, i: CASE WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END) ORDER BY b) AS t FROM range(256) r(b)
)"""
_CRC = "xor(4294967295, list_reduce([4294967295] || [ascii(c)::BIGINT FOR c IN string_split({0}::VARCHAR, '')], lambda x, b: xor(x >> 8, t[xor(x, b) % 256 + 1])))"
OP11_SQL = f"""
WITH {_CRC_TABLE}, seen AS (SELECT DISTINCT * FROM clicks WHERE ts IS NOT NULL AND client_id IS NOT NULL),
hashed AS (SELECT click_id, {_CRC.format("click_id")} AS h FROM (SELECT DISTINCT click_id FROM seen), crc),
members AS (SELECT client_id, {_CRC.format("client_id")} AS crc FROM (SELECT DISTINCT client_id FROM seen), crc),
timed AS (
  SELECT s.client_id, s.ts, s.kind, coalesce(CASE WHEN isfinite(s.value) THEN floor(100 * s.value + 0.5)::BIGINT END, 0) AS cents,
         coalesce(arrived_at + to_days(CASE WHEN h % 3 = 0 THEN h % 100 ELSE 0 END::INT) < TIMESTAMP '2024-02-01', false) AS early
  FROM seen s LEFT JOIN hashed USING (click_id)
), starts AS (
  SELECT client_id, min(ts) FILTER (early) AS s0, min(ts) AS s1 FROM timed WHERE kind = 'error' GROUP BY client_id
), weeks AS (
  SELECT *, floor(datediff('day', DATE '1970-01-01', s0::DATE) / 7)::BIGINT AS w0, floor(datediff('day', DATE '1970-01-01', s1::DATE) / 7)::BIGINT AS w1 FROM starts
), known AS (
  SELECT 0 AS state, t.client_id, w0 AS cohort, (epoch_us(ts) - epoch_us(s0)) // 604800000000 AS period, coalesce(w0 <> w1, false) AS moved, cents
  FROM timed t JOIN weeks USING (client_id) WHERE early AND ts >= s0
  UNION ALL
  SELECT 1, t.client_id, w1, (epoch_us(ts) - epoch_us(s1)) // 604800000000, coalesce(w0 <> w1, false), cents
  FROM timed t JOIN weeks USING (client_id) WHERE ts >= s1
), visits AS (
  SELECT state, client_id, cohort, period, bool_or(moved) AS moved, sum(cents) AS cents FROM known GROUP BY ALL
), segments AS (SELECT client_id, min(source) AS segment FROM clients GROUP BY client_id)
SELECT state::INT AS state, coalesce(segment, '') AS segment, cohort, period, count(*) AS users, sum(crc)::BIGINT AS users_crc32,
       sum(moved::INT)::BIGINT AS moved, sum(cents)::BIGINT AS cents
FROM visits JOIN members USING (client_id) LEFT JOIN segments USING (client_id) GROUP BY ALL
"""


def op12_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.remove_repeats(_read(spark, sf_dir, "documents"))
    return found.select(
        F.col("id").alias("doc_id"),
        "n_bytes",
        (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


OP12_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, ''))::BIGINT AS n FROM documents),
windows AS (SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS s FROM (SELECT doc_id, h, unnest(range(0, n - 49)) AS i FROM d WHERE n >= 50)),
firsts AS (SELECT s, min(doc_id) AS first FROM windows GROUP BY s HAVING min(doc_id) < max(doc_id)),
hits AS (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM windows JOIN firsts USING (s) WHERE first < doc_id),
runs AS (SELECT doc_id, i, sum((before IS NULL OR i > before + 50)::INT) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM hits),
spans AS (SELECT doc_id, run, min(i) AS a, max(i) + 50 AS b FROM runs GROUP BY doc_id, run),
gaps AS (
  SELECT doc_id, a, b, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS kept_from FROM spans
), cut AS (
  SELECT d.doc_id, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans,
         string_agg(substr(h, 2 * kept_from + 1, 2 * (a - kept_from)), '' ORDER BY a) || substr(any_value(h), 2 * max(b) + 1) AS kept
  FROM gaps JOIN d USING (doc_id) GROUP BY d.doc_id
)
SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256
FROM d LEFT JOIN cut USING (doc_id)
"""


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_read(spark, sf_dir, "documents"))


OP13_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM pieces),
totals AS (SELECT lang, sum(len(ws))::BIGINT AS n FROM w GROUP BY lang),
grams AS (
  SELECT lang, k, ws[i:i + k - 1] AS ws FROM (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM w), range(1, 6) t(k) WHERE i + k - 1 <= len(ws)
), f AS (SELECT lang, k, ws, count(*) AS f FROM grams GROUP BY ALL),
cand AS (SELECT * FROM f WHERE k >= 2 AND f >= 100),
inner_parts AS (
  SELECT c.lang, c.ws[i:j] AS ws, max(c.f) AS around FROM cand c, range(1, 6) a(i), range(1, 6) b(j)
  WHERE j > i AND j <= k AND j - i + 1 < k GROUP BY ALL
), kept AS (
  SELECT c.* FROM cand c LEFT JOIN inner_parts p USING (lang, ws) WHERE coalesce(100 * around, 0) < 100 * c.f
), cuts AS (
  SELECT c.lang, c.ws, c.f AS a, n, i, x.f AS l, y.f AS r, (1000::HUGEINT * c.f * n) // (x.f::HUGEINT * y.f) AS score
  FROM kept c, range(1, 5) t(i), totals t2, f x, f y
  WHERE i < c.k AND t2.lang = c.lang AND x.lang = c.lang AND x.ws = c.ws[1:i] AND y.lang = c.lang AND y.ws = c.ws[i + 1:c.k]
), best AS (
  SELECT lang, array_to_string(ws, ' ') AS phrase, a, n, l, r, score FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, ws ORDER BY score, i) = 1
)
SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM best) WHERE rank <= 2000
"""


QUERIES = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_warc_segments": op2_warc_segments,
    "op3_imatch_fingerprints": op3_imatch_fingerprints,
    "op4_template_extraction": op4_template_extraction,
    "op5_url_rules": op5_url_rules,
    "op6_best_fit_packing": op6_best_fit_packing,
    "op7_quality_rules": op7_quality_rules,
    "op8_poisson_mixing": op8_poisson_mixing,
    "op9_training_order": op9_training_order,
    "op10_simhash_near_dedup": op10_simhash_near_dedup,
    "op11_retention_shards": op11_retention_shards,
    "op12_suffix_dedup": op12_suffix_dedup,
    "op13_collocations": op13_collocations,
}

ORACLE: dict[str, str] = {
    "op2_warc_segments": OP2_SQL,
    "op5_url_rules": OP5_SQL,
    "op8_poisson_mixing": OP8_SQL,
    "op11_retention_shards": OP11_SQL,
    "op12_suffix_dedup": OP12_SQL,
    "op13_collocations": OP13_SQL,
}
