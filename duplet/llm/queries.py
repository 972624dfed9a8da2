"""The registered queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from duplet.llm import embedding_dedup, html_extract, minhash, mixing, ogg_media, quality, sentencepiece_sampling, sharding, substring_dedup, toxicity

WEIGHTS = (5.0, 2.0, 1.0)


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.digest(_read(spark, sf_dir, "documents"), 35)


def op2_ogg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ogg_media.digest(_read(spark, sf_dir, "documents"))


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(_read(spark, sf_dir, "documents"), WEIGHTS, 1.5, 2.0)
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op4_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_read(spark, sf_dir, "documents"), 85, 3)


def op5_sentencepiece_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_sampling.encode(_read(spark, sf_dir, "documents"), 2)


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(_read(spark, sf_dir, "embeddings"), 0.93)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    test = quality.held_out(F.col("doc_id"), 3, 1)
    index = toxicity.train(docs, _read(spark, sf_dir, "labels"), ~test)
    return toxicity.score(docs, index).select("doc_id", test.alias("held_out"), "score", "predicted", "evidence")


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(_read(spark, sf_dir, "pages"))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    test = quality.held_out(F.col("doc_id"), 4, 2)
    model = quality.train(docs, _read(spark, sf_dir, "labels"), ~test)
    return quality.score(docs, model).select("doc_id", test.alias("held_out"), "score", "predicted")


def op10_shard_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.assign(_read(spark, sf_dir, "documents"), 24)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_substring_dedup, op2_ogg_media, op3_source_mixing, op4_minhash_dedup, op5_sentencepiece_sampling, op6_embedding_dedup, op7_toxicity, op8_html_extraction, op9_quality_classifier, op10_shard_assignment)}

_OP3 = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
), per_source AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source
), weighed AS (
  SELECT *, row_number() OVER (ORDER BY encode(source) ASC NULLS LAST) - 1 AS rank FROM per_source
), limits AS (
  SELECT *, CASE rank % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight, source_size * 2.0::DOUBLE AS full_at FROM weighed
), levels AS (
  SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(full_at) OVER before, 0.0::DOUBLE))
    / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0.0::DOUBLE)) AS level
  FROM limits WINDOW before AS (ORDER BY full_at / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), level AS (
  SELECT arg_min(level, (full_at / weight, rank)) FILTER (level * weight <= full_at) AS level FROM levels
), targets AS (
  SELECT source, source_size, CASE WHEN full_at > 0 THEN least(full_at, coalesce(level.level * weight, full_at)) ELSE 0.0::DOUBLE END AS target
  FROM levels, level
), rates AS (
  SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0::DOUBLE END AS rate FROM targets
)
SELECT doc_id, size, r.source_size, r.target,
  size * least(floor(rate)::BIGINT + (CASE WHEN ('0x' || substr(md5('17:' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0::DOUBLE < rate - floor(rate) THEN 1 ELSE 0 END), 2)::BIGINT AS taken
FROM sized s JOIN rates r ON s.source IS NOT DISTINCT FROM r.source
"""

_OP1 = r"""
WITH texts AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS words FROM documents
), starts AS (
  SELECT r, words, unnest(range(1, len(words) - 33)) AS pos FROM texts WHERE len(words) >= 35
), windows AS (
  SELECT r, pos, sha256(array_to_string(words[pos : pos + 34], ' ')) AS w FROM starts
), covered AS (
  SELECT DISTINCT r, unnest(range(pos, pos + 35)) AS i FROM windows WHERE w IN (SELECT w FROM windows GROUP BY w HAVING count(*) > 1)
), placed AS (
  SELECT r, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM texts
), kept AS (
  SELECT r, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS text FROM placed ANTI JOIN covered USING (r, i) GROUP BY r
)
SELECT doc_id, len(words)::BIGINT AS n_words, (len(words) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM texts LEFT JOIN kept USING (r)
"""

# smallest id reachable over links (a, b), both ways
_REACHED = """both_ways AS MATERIALIZED (
  SELECT a, b FROM links UNION SELECT b, a FROM links
), walk(id, seen) AS (
  SELECT a, b FROM both_ways UNION SELECT w.id, l.b FROM walk w JOIN both_ways l ON w.seen = l.a
), reached AS (
  SELECT id, least(id, min(seen)) AS component FROM walk GROUP BY id
)"""

_OP4 = rf"""
WITH RECURSIVE texts AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS words FROM documents
), shingles AS MATERIALIZED (
  SELECT DISTINCT doc_id, array_to_string(words[pos : pos + 2], ' ') AS shingle
  FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 1, 2))) AS pos FROM texts WHERE len(words) > 0)
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), met AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS met FROM shingles x JOIN shingles y ON x.shingle = y.shingle AND x.doc_id < y.doc_id GROUP BY x.doc_id, y.doc_id
), links AS MATERIALIZED (
  SELECT a, b FROM met JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * met >= 85 * (x.n + y.n - met)
), {_REACHED}
SELECT t.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(component, t.doc_id)::BIGINT AS component_id, coalesce(component, t.doc_id) = t.doc_id AS kept
FROM texts t LEFT JOIN sizes s ON s.doc_id = t.doc_id LEFT JOIN reached ON id = t.doc_id
"""

_OP6 = rf"""
WITH RECURSIVE parts AS (
  SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings WHERE label IS NOT NULL
), norms AS (
  SELECT vec_id, count(*) AS dims, sqrt(sum(x * x)) AS norm FROM parts GROUP BY vec_id HAVING bool_and(coalesce(isfinite(x), false)) AND max(abs(x)) > 0
), units AS MATERIALIZED (
  SELECT vec_id, label, dims, i, x / norm AS x FROM parts JOIN norms USING (vec_id)
), links AS MATERIALIZED (
  SELECT p.vec_id AS a, q.vec_id AS b FROM units p JOIN units q ON p.label = q.label AND p.dims = q.dims AND p.i = q.i AND p.vec_id < q.vec_id
  GROUP BY p.vec_id, q.vec_id HAVING sum(p.x * q.x) >= 0.93
), {_REACHED}, counted AS (
  SELECT a, count(*) AS n FROM both_ways GROUP BY a
)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, coalesce(component, vec_id)::BIGINT AS component_id, coalesce(component, vec_id) = vec_id AS kept
FROM embeddings LEFT JOIN counted ON a = vec_id LEFT JOIN reached ON id = vec_id
"""

ORACLE_SQL: dict[str, str] = {"op1_substring_dedup": _OP1, "op3_source_mixing": _OP3, "op4_minhash_dedup": _OP4, "op6_embedding_dedup": _OP6}
