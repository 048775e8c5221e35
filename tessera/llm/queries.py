"""The registered queries of this subpackage, and their SQL where it can express them."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, filter_audit, jaccard_join, language_id, license_scan, mixing, quality_classifier, quality_rules, secret_scan, sharding, token_alignment, token_counts, topk_search
from tessera.llm.common import is_held_out, shared_dir

TOKENIZER, PIECES = "byte_bpe_50k.json", "piece_bpe_32k.model"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(table(spark, sf_dir, "documents"))


def op2_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search.top_k(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0, k=5)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as six arrivals of uneven size, compacted as they come, read back from the last version."""
    docs = table(spark, sf_dir, "documents")
    part = F.coalesce(F.crc32(F.col("doc_id").cast("string")), F.lit(0)) % 12
    arrivals = [docs.where(part.between(a, b)) for a, b in ((0, 3), (4, 6), (7, 8), (9, 9), (10, 10), (11, 11))]
    store = sharding.ShardStore(spark, f"{shared_dir(spark)}/shard-store-{uuid.uuid4().hex}")
    rows = sharding.shard(store, arrivals)
    return rows.select("doc_id", "lang", "source", "n_chars", F.octet_length("text").cast("long").alias("n_bytes"), F.md5(F.col("text").cast("binary")).alias("text_md5"))


OP4_SQL = """
SELECT doc_id, lang, source, n_chars, strlen(text)::BIGINT AS n_bytes, md5(text) AS text_md5 FROM documents
"""


def digests(ids: bytes, decoded: bytes) -> tuple:
    return len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded).hexdigest()


def op5_bpe_round_trip(spark: SparkSession, sf_dir: str, docs: DataFrame | None = None) -> DataFrame:
    docs = table(spark, sf_dir, "documents") if docs is None else docs
    out = bpe.encode_documents(docs, public_tokenizers.path(TOKENIZER), emit=digests, schema="n_tokens long, ids_sha256 string, decoded_sha256 string")
    return out.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "n_chunks", "n_reused")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_id.fit(docs, ~is_held_out(F.col("doc_id")))
    return language_id.identify(docs, model, keep=[F.col("doc_id"), is_held_out(F.col("doc_id")).alias("held_out")])


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents"))


#: Every similar pair by shared n-grams, then the smallest document reachable.
OP7_SQL = r"""
WITH RECURSIVE low AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) END AS s FROM low
), classes AS (
  SELECT list_sort(s) AS s, min(doc_id) AS rep FROM sets WHERE len(s) > 0 GROUP BY 1
), grams AS (
  SELECT rep, len(s) AS n, unnest(s) AS g FROM classes
), pairs AS (
  SELECT a.rep AS x, b.rep AS y FROM grams a JOIN grams b ON a.g = b.g AND a.rep < b.rep
  GROUP BY a.rep, b.rep, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
), edges AS (
  SELECT x, y FROM pairs UNION SELECT y, x FROM pairs UNION SELECT rep, rep FROM classes
), reach AS (
  SELECT x AS node, x AS seen FROM edges UNION SELECT r.node, e.y FROM reach r JOIN edges e ON r.seen = e.x
), least AS (
  SELECT node, min(seen) AS component FROM reach GROUP BY node
)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, coalesce(l.component, s.doc_id) AS component_id
FROM sets s LEFT JOIN classes c ON len(s.s) > 0 AND list_sort(s.s) = c.s LEFT JOIN least l ON c.rep = l.node
"""


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), leaning=mixing.middling)


OP8_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source
), w AS (
  SELECT *, [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w, source_size * 2.0::DOUBLE AS cap FROM s
), f AS (
  SELECT *, sum(source_size) OVER () * 1.5::DOUBLE AS total, sum(w) OVER () AS all_w,
    coalesce(sum(cap) OVER o, 0.0::DOUBLE) AS less, coalesce(sum(w) OVER o, 0.0::DOUBLE) AS less_w
  FROM w WINDOW o AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), l AS (
  SELECT *, (total - less) / (all_w - less_w) AS level FROM f
), t AS (
  SELECT *, least(cap, max(CASE WHEN level <= cap / w THEN level END) OVER () * w) AS target FROM l
), g AS (
  SELECT source, CASE WHEN size BETWEEN 100 AND 1000 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS lean, sum(size)::BIGINT AS words FROM d GROUP BY ALL
), h AS (
  SELECT g.*, t.source_size, t.target,
    (t.target - coalesce(sum(words) OVER (PARTITION BY g.source ORDER BY lean DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE * 2.0::DOUBLE)
      / nullif(sum(words::DOUBLE * lean) OVER (PARTITION BY g.source ORDER BY lean DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0) AS factor
  FROM g JOIN t ON g.source IS NOT DISTINCT FROM t.source
), i AS (
  SELECT *, least(2.0::DOUBLE, arg_max(factor, lean) FILTER (factor * lean <= 2.0::DOUBLE) OVER (PARTITION BY source) * lean) AS fitted FROM h
), e AS (
  SELECT d.doc_id, d.source, d.size, i.source_size, i.target, coalesce(i.fitted, 2.0::DOUBLE) AS e,
    (('0x' || substr(md5('mix-1:' || d.doc_id), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0::DOUBLE AS u
  FROM d JOIN i ON d.source IS NOT DISTINCT FROM i.source AND i.lean = CASE WHEN d.size BETWEEN 100 AND 1000 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END
), r AS (
  SELECT *, floor(e)::BIGINT AS certain, e - floor(e) AS p,
    CASE WHEN e - floor(e) > 0 AND size > 0 THEN (u / (1 - u)) / ((e - floor(e)) / (1 - (e - floor(e)))) END AS rank FROM e
), c AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY source, rank IS NULL ORDER BY rank, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
    sum(certain * size) OVER (PARTITION BY source) AS sure FROM r
), k AS (
  SELECT *, CASE WHEN size = 0 THEN 0 ELSE certain + (CASE WHEN rank IS NOT NULL AND before + size / 2.0::DOUBLE <= target - sure THEN 1 ELSE 0 END) END AS copies FROM c
)
SELECT doc_id, size, source_size, target, copies::BIGINT AS copies, (copies * size)::BIGINT AS taken FROM k
"""

OP2_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(table(spark, sf_dir, "documents")).drop("spans")


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality_classifier.fit(docs, table(spark, sf_dir, "labels"), ~is_held_out(F.col("id")))
    return quality_classifier.score(docs, model).select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = filter_audit.document_stream(spark, f"{sf_dir}/documents.parquet")
    return filter_audit.audit(docs, table(spark, sf_dir, "labels"))


#: Failures of every document at once, then each order and step over the counts of each set of failures.
OP11_SQL = r"""
WITH l AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id
), w AS (
  SELECT d.doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic FROM documents d LEFT JOIN l ON d.doc_id = l.doc_id
), m AS (
  SELECT part, good, toxic, CASE WHEN len(w) < 100 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(w)) < 80 * len(w) THEN 2 ELSE 0 END
    + CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) THEN 4 ELSE 0 END + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END
    + CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 16 ELSE 0 END AS mask FROM w
), c AS (
  SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY ALL
), f AS (
  SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) AS x(letter, bit)
), o AS (
  SELECT a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
  FROM f a JOIN f b ON a.bit <> b.bit JOIN f c ON c.bit NOT IN (a.bit, b.bit) JOIN f d ON d.bit NOT IN (a.bit, b.bit, c.bit) JOIN f e ON e.bit NOT IN (a.bit, b.bit, c.bit, d.bit)
), s AS (
  SELECT filter_order, i AS step, bits[i] AS own, coalesce(list_sum(bits[:i - 1]), 0)::INTEGER AS before FROM o, range(1, 6) AS r(i)
), r AS (
  SELECT part, filter_order, step::INTEGER AS step, mask, own, n, good, toxic, mask & own <> 0 AS fails, mask & before <> 0 AS gone FROM c CROSS JOIN s
), z AS (
  SELECT part, filter_order, step, any_value(own) AS own, sum(CASE WHEN NOT fails AND NOT gone THEN n ELSE 0 END)::BIGINT AS kept,
    sum(CASE WHEN fails AND NOT gone THEN n ELSE 0 END)::BIGINT AS removed, sum(CASE WHEN fails AND gone THEN n ELSE 0 END)::BIGINT AS redundant,
    sum(CASE WHEN mask = own THEN n ELSE 0 END)::BIGINT AS unique_fails, sum(CASE WHEN fails AND NOT gone THEN good ELSE 0 END)::BIGINT AS good_lost,
    sum(CASE WHEN fails AND NOT gone THEN toxic ELSE 0 END)::BIGINT AS toxic_lost FROM r GROUP BY part, filter_order, step
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley FROM z
"""


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.align_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER), public_tokenizers.path(PIECES))


def op13_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan_secrets(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import corpus_pipeline

    every = [op1_quality_rules, op2_exact_top_k, op3_token_counts, op4_sharding, op5_bpe_round_trip, op6_language_id, op7_jaccard_join, op8_mixing, op9_license_scan, op10_quality_classifier, op11_filter_audit, op12_token_alignment, op13_secret_scan]
    return {f.__name__: f for f in every} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return {"op2_exact_top_k": OP2_SQL, "op4_sharding": OP4_SQL, "op7_jaccard_join": OP7_SQL, "op8_mixing": OP8_SQL, "op11_filter_audit": OP11_SQL}
