"""The subpackage's registered queries: whole tables, production parameters."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import balltree, bpe, chosenpath, divergence, exact, kneser, packing, planes, quality, repeats, structure, toxicity, webp
from .common import documents


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.removals(documents(spark, sf_dir))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(documents(spark, sf_dir), labels(spark, sf_dir))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(documents(spark, sf_dir), labels(spark, sf_dir))


def op4_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(documents(spark, sf_dir))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chosenpath.near_duplicates(documents(spark, sf_dir))


def op6_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kneser.perplexities(documents(spark, sf_dir))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir))


def op8_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return balltree.top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planes.round_trip(documents(spark, sf_dir))


def op10_webp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return webp.media_round_trip(documents(spark, sf_dir))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(documents(spark, sf_dir))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = structure.damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return structure.audits(rows).withColumnRenamed("conv", "conv_id")


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.classes(documents(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (
        op1_suffix_dedup, op2_toxicity, op3_quality, op4_bpe_round_trip, op5_jaccard_join,
        op6_kneser_ney, op7_packing, op8_top_k, op9_token_files, op10_webp,
        op11_source_divergence, op12_conversation_repair, op13_exact_dedup,
    )
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {"op8_top_k": OP8_SQL, "op11_source_divergence": OP11_SQL, "op12_conversation_repair": OP12_SQL, "op13_exact_dedup": OP13_SQL}


OP8_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e)
  WHERE q.vec_id % 50 = 0
), r AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM s
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""

OP11_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(coalesce(text, ''), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents
), t AS (
  SELECT lang, source, r, translate(unnest(w), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM d
), k AS (SELECT lang, term FROM t GROUP BY 1, 2 HAVING count(DISTINCT r) >= 3),
c AS (SELECT lang, source, term, count(*) AS n FROM t JOIN k USING (lang, term) GROUP BY 1, 2, 3),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY 1),
g AS (SELECT DISTINCT lang, source FROM d),
p AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, v,
         1 + CAST(1000000000 AS HUGEINT) * (coalesce(c.n, 0) + 1) // (sum(coalesce(c.n, 0)) OVER (PARTITION BY g.lang, g.source) + v) AS p
  FROM g JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), l AS (
  SELECT lang, term, 1 + CAST(1000000000 AS HUGEINT) * (sum(n) + 1) // (sum(sum(n)) OVER (PARTITION BY lang) + any_value(v)) AS q
  FROM p GROUP BY 1, 2
), pairs AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(f, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN (
    SELECT x.lang, x.source, y.source AS other, sum((x.p - y.p) * (x.p - y.p) // y.p) AS f
    FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY 1, 2, 3
  ) s ON s.lang = a.lang AND s.source = a.source AND s.other = b.source
), ranked AS (
  SELECT lang, source, 'pair' AS part, item, value FROM pairs
  UNION ALL
  SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM p JOIN l USING (lang, term) WHERE n > 0 AND p > q
)
SELECT * FROM (
  SELECT lang, source, part, item, CAST(value AS BIGINT) AS value,
         CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
  FROM ranked
) WHERE part = 'pair' OR rank <= 200
"""

#: States of the repair: 0 nothing kept yet, 1 the system's row, 2 a user's, 3 an assistant's. Each holds the cheapest
#: (cost, edits, repaired text), by cost and then by edits.
OP12_SQL = """
WITH RECURSIVE raw AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         encode(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')) AS key
  FROM conversations
), coded AS (
  SELECT conv_id, turn, role, text, xor(4294967295, list_reduce(
    list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(1, octet_length(key) + 1), lambda i: CAST(ascii(decode(key[i:i])) AS BIGINT))),
    lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, (x & 1) * 3988292384) + 0 * y)
  )) % 20 AS code FROM raw
), damaged AS (
  SELECT conv_id, turn, CASE WHEN code = 4 THEN 'user' ELSE role END AS role,
         CASE code WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM coded, range(0, 2) r(copy) WHERE code <> 0 AND (copy = 0 OR code = 3)
), met AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST) AS seen FROM damaged
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, seen) AS i,
         rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS ended
  FROM met
), rows AS (
  SELECT *, CASE WHEN ended = '' THEN 1 WHEN seen > 1 THEN 2 WHEN right(ended, 1) IN ('.', '!', '?') THEN 0 ELSE 3 END AS fault,
         left(role, 1) AS initial, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before
  FROM placed
), found AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank,
         count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated,
         count(*) FILTER (before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n
  FROM rows GROUP BY 1
), search AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS i, {'c': 0, 'e': '', 't': ''} AS s0, {'c': 1000000000, 'e': '', 't': ''} AS s1,
         {'c': 5, 'e': 'I', 't': chr(10) || 'user:'} AS s2, {'c': 10, 'e': 'II', 't': chr(10) || 'user:' || chr(10) || 'assistant:'} AS s3
  FROM found
  UNION ALL
  SELECT conv_id, i, s0, s1,
         list_min([s2, {'c': s3.c + 5, 'e': s3.e || 'I', 't': s3.t || chr(10) || 'user:'}, {'c': s0.c + 5, 'e': s0.e || 'I', 't': s0.t || chr(10) || 'user:'}, {'c': s1.c + 5, 'e': s1.e || 'I', 't': s1.t || chr(10) || 'user:'}]),
         list_min([s3, {'c': s2.c + 5, 'e': s2.e || 'I', 't': s2.t || chr(10) || 'assistant:'}, {'c': s0.c + 10, 'e': s0.e || 'II', 't': s0.t || chr(10) || 'user:' || chr(10) || 'assistant:'}, {'c': s1.c + 10, 'e': s1.e || 'II', 't': s1.t || chr(10) || 'user:' || chr(10) || 'assistant:'}])
  FROM (
    SELECT s.conv_id, r.i, d0 AS s0,
           CASE WHEN initial = 's' THEN list_min([d1, {'c': s0.c + k, 'e': s0.e || 'K', 't': s0.t || kept}]) ELSE d1 END AS s1,
           list_min([d2, {'c': s0.c + r1, 'e': s0.e || 'R', 't': s0.t || as_user}, {'c': s1.c + r1, 'e': s1.e || 'R', 't': s1.t || as_user}, {'c': s3.c + r1, 'e': s3.e || 'R', 't': s3.t || as_user},
             {'c': s0.c + ku, 'e': s0.e || 'K', 't': s0.t || kept}, {'c': s1.c + ku, 'e': s1.e || 'K', 't': s1.t || kept}, {'c': s3.c + ku, 'e': s3.e || 'K', 't': s3.t || kept}]) AS s2,
           list_min([d3, {'c': s2.c + r1, 'e': s2.e || 'R', 't': s2.t || as_assistant}, {'c': s2.c + ka, 'e': s2.e || 'K', 't': s2.t || kept}]) AS s3
    FROM search s JOIN (
      SELECT *, CASE fault WHEN 0 THEN 0 WHEN 3 THEN 5 ELSE 1000000000 END AS k, k + 1 AS r1,
             CASE WHEN initial = 'u' THEN k ELSE 1000000000 END AS ku, CASE WHEN initial = 'a' THEN k ELSE 1000000000 END AS ka,
             chr(10) || role || ':' || text AS kept, chr(10) || 'user:' || text AS as_user, chr(10) || 'assistant:' || text AS as_assistant
      FROM rows
    ) r ON r.conv_id IS NOT DISTINCT FROM s.conv_id AND r.i = s.i + 1,
    LATERAL (SELECT {'c': s0.c + 2, 'e': s0.e || 'D', 't': s0.t} AS d0, {'c': s1.c + 2, 'e': s1.e || 'D', 't': s1.t} AS d1,
                    {'c': s2.c + 2, 'e': s2.e || 'D', 't': s2.t} AS d2, {'c': s3.c + 2, 'e': s3.e || 'D', 't': s3.t} AS d3)
  )
), best AS (
  SELECT f.*, list_min([s0, s3]) AS b FROM found f JOIN search s ON s.conv_id IS NOT DISTINCT FROM f.conv_id AND s.i = f.n
)
SELECT c.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate,
       CAST(coalesce(truncated, 0) AS BIGINT) AS truncated, CAST(coalesce(illegal, 0) AS BIGINT) AS illegal,
       CAST(coalesce(b.c, 0) AS BIGINT) AS cost, coalesce(b.e, '') AS audit, sha256(coalesce(substr(b.t, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN best ON best.conv_id IS NOT DISTINCT FROM c.conv_id
"""

OP13_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
