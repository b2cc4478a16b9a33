"""Registered queries of the numbered operators, and the SQL that some of them equal."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from readloom.llm import collocations, exact_dedup, importance, jaccard, langid, mixing, packing, quality, secrets, simhash, suffixes, toxicity, voronoi
from readloom.llm.common import table


def op1_language_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.train(docs))


def op2_voronoi_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return voronoi.top_k(table(spark, sf_dir, "embeddings"))


def op3_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.predict(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op4_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.repeated_passages(table(spark, sf_dir, "documents"))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path(packing.TOKENIZER))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secrets(table(spark, sf_dir, "documents"))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_mixing_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.decisions(table(spark, sf_dir, "documents"))


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents")).drop("doc_id")


def op12_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar(table(spark, sf_dir, "documents"))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


OP9_SQL = r"""
WITH flat AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       row_number() OVER (PARTITION BY t ORDER BY doc_id) = 1 AS kept, sha256(t) AS text_sha256
FROM flat WINDOW same AS (PARTITION BY t)
"""


OP2_SQL = """
WITH v AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS DOUBLE)) AS c FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), p AS (
  SELECT q.vec_id AS query_id, q.c, d.vec_id AS vec_id, CAST(list_inner_product(q.c, d.c) AS BIGINT) AS score
  FROM v AS q JOIN v AS d ON q.vec_id % 20 = 0 AND q.vec_id <> d.vec_id
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id, c ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM p QUALIFY rank <= 20
"""

OP4_SQL = r"""
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL
), p AS (
  SELECT doc_id, i, array_to_string(ws[i + 1:i + 50], ' ') AS g FROM w, unnest(range(0, len(ws) - 49)) AS t(i)
), r AS (
  SELECT doc_id, i, min(doc_id) OVER same AS lo, max(doc_id) OVER same AS hi FROM p WINDOW same AS (PARTITION BY g)
), n AS (
  SELECT doc_id, i, lo, coalesce(CAST(i > 50 + max(i) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS INTEGER), 1) AS fresh
  FROM r WHERE lo < hi
), s AS (SELECT doc_id, i, lo, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS span FROM n)
SELECT doc_id, min(i) AS start_word, max(i) + 50 AS end_word, max(i) + 50 - min(i) AS n_words, min(lo) AS first_doc_id
FROM s GROUP BY doc_id, span
"""


OP11_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents
), w AS (SELECT lang, list_filter(regexp_split_to_array(p, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM pieces),
totals AS (SELECT lang, CAST(sum(len(ws)) AS BIGINT) AS n FROM w GROUP BY lang),
f AS MATERIALIZED (
  SELECT lang, ws[i:i + k - 1] AS ws, count(*) AS a FROM w, unnest(range(1, 5)) AS n(k), unnest(range(1, len(ws) - k + 2)) AS p(i) GROUP BY ALL HAVING count(*) >= 30
), inner_ AS (
  SELECT lang, ws[i:i + m - 1] AS ws, max(a) AS most FROM f, unnest(range(2, len(ws))) AS s(m), unnest(range(1, len(ws) - m + 2)) AS p(i) WHERE len(ws) > 2 GROUP BY ALL
), cuts AS (
  SELECT c.lang, c.ws, c.a, k, x.a AS l, y.a AS r, CAST(2000000 * CAST(c.a AS HUGEINT) // (x.a + y.a) AS BIGINT) AS score
  FROM f AS c, unnest(range(1, len(c.ws))) AS t(k), f AS x, f AS y
  WHERE len(c.ws) > 1 AND x.lang = c.lang AND x.ws = c.ws[1:k] AND y.lang = c.lang AND y.ws = c.ws[k + 1:]
), lowest AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, ws ORDER BY score, k) = 1),
kept AS (SELECT lowest.* FROM lowest LEFT JOIN inner_ USING (lang, ws) WHERE most IS NULL OR 100 * most < 80 * a)
SELECT lang, row_number() OVER best AS rank, array_to_string(ws, ' ') AS phrase, a, l, r, n, score
FROM kept JOIN totals USING (lang) WINDOW best AS (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(ws, ' ')) QUALIFY rank <= 2000
"""

OP12_SQL = r"""
WITH RECURSIVE w AS (
  SELECT row_number() OVER () AS row, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents
), s AS MATERIALIZED (
  SELECT DISTINCT row, doc_id, array_to_string(ws[i:i + 2], ' ') AS g FROM w, unnest(range(1, greatest(len(ws) - 2, CAST(len(ws) > 0 AS INTEGER)) + 1)) AS p(i)
), n AS MATERIALIZED (SELECT row, any_value(doc_id) AS doc_id, count(*) AS n FROM s GROUP BY row),
common AS (SELECT a.row AS a, b.row AS b, count(*) AS c FROM s AS a JOIN s AS b ON a.g = b.g AND a.row <> b.row GROUP BY ALL),
link AS MATERIALIZED (SELECT common.a, common.b FROM common JOIN n AS x ON x.row = common.a JOIN n AS y ON y.row = common.b WHERE 100 * c >= 90 * (x.n + y.n - c)),
reach AS (SELECT row AS a, row AS b FROM n UNION SELECT reach.a, link.b FROM reach JOIN link ON link.a = reach.b),
least AS (SELECT reach.a AS row, min(n.doc_id) AS component_id FROM reach JOIN n ON n.row = reach.b GROUP BY reach.a)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, CASE WHEN n.row IS NULL THEN w.doc_id ELSE component_id END AS component_id
FROM w LEFT JOIN n USING (row) LEFT JOIN least USING (row)
"""

OP13_SQL = r"""
WITH RECURSIVE byte AS (
  SELECT b, list_reduce(list_prepend(b, range(8)), lambda c, i: xor(c >> 1, (c & 1) * 3988292384)) AS t FROM range(256) AS r(b)
), texts AS (
  SELECT 0 AS part, row_number() OVER () AS row, doc_id, text FROM documents UNION ALL SELECT 1, row_number() OVER (), NULL, text FROM benchmark
), w AS (
  SELECT part, row, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM texts
), f AS MATERIALIZED (
  SELECT part, row, array_to_string(ws[i:i + k - 1], ' ') AS f FROM w, unnest(range(1, 4)) AS n(k), unnest(range(1, len(ws) - k + 2)) AS p(i)
), forms AS MATERIALIZED (SELECT f, hex(f) AS h, strlen(f) AS n FROM f GROUP BY f),
after AS (  -- what a byte adds to the CRC of a text in which d more bytes follow
  SELECT b, 0 AS d, t AS c FROM byte
  UNION ALL SELECT a.b, d + 1, xor(c >> 8, t) FROM after AS a JOIN byte ON byte.b = c & 255 WHERE d < (SELECT max(n) FROM forms)
), zeros AS (  -- what the initial value becomes after n bytes
  SELECT 0 AS n, 4294967295 AS c UNION ALL SELECT n + 1, xor(c >> 8, t) FROM zeros JOIN byte ON byte.b = c & 255 WHERE n < (SELECT max(n) FROM forms)
), bits AS (
  SELECT f, n, ('0x' || h[2 * i + 1:2 * i + 2])::INTEGER AS b, n - 1 - i AS d FROM forms, unnest(range(0, n)) AS p(i)
), crc AS (
  SELECT f, xor(xor(bit_xor(after.c), any_value(zeros.c)), 4294967295) % 10000 AS bucket
  FROM bits JOIN after ON after.b = bits.b AND after.d = bits.d JOIN zeros ON zeros.n = bits.n GROUP BY f
), held AS MATERIALIZED (SELECT part, row, bucket, count(*) AS n FROM f JOIN crc USING (f) GROUP BY ALL),
totals AS (SELECT bucket, sum(n) FILTER (part = 0) AS s, sum(n) FILTER (part = 1) AS t FROM held GROUP BY bucket),
gain AS (
  SELECT bucket, CAST(floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * (sum(s) OVER () + 10000)::DOUBLE / ((coalesce(s, 0) + 1)::DOUBLE * (coalesce(sum(t) OVER (), 0) + 10000)::DOUBLE))) AS BIGINT) AS g
  FROM totals
), weighed AS (SELECT row, sum(n) AS n_features, sum(n * g) AS weight FROM held JOIN gain USING (bucket) WHERE part = 0 GROUP BY row),
scored AS (
  SELECT doc_id, len(ws) >= 20 AS enough, CAST(coalesce(n_features, 0) AS BIGINT) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight, CAST(coalesce(weight, 0)
    + floor(-1000 * ln(-ln((('0x' || sha256('42:' || coalesce(doc_id::VARCHAR, ''))[1:8])::BIGINT + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score
  FROM texts JOIN w USING (part, row) LEFT JOIN weighed USING (row) WHERE part = 0
)
SELECT doc_id, n_features, weight, score, CASE WHEN enough AND row_number() OVER best <= 5 * count(*) FILTER (enough) OVER () // 100 THEN row_number() OVER best END AS rank
FROM scored WINDOW best AS (ORDER BY enough DESC, score DESC, doc_id)
"""


def all_sql() -> dict[str, str]:
    return {
        "op2_voronoi_top_k": OP2_SQL,
        "op4_repeated_passages": OP4_SQL,
        "op9_exact_dedup": OP9_SQL,
        "op11_phrase_collocations": OP11_SQL,
        "op12_ngram_jaccard_join": OP12_SQL,
        "op13_importance_resampling": OP13_SQL,
    }
