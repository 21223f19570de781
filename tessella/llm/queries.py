"""The queries of the training-data operators over their whole tables, and SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import alignment, byte_bpe, chat, delta_lloyd, embed_dedup, fingerprints, minhash, mixing, packing, quality, substring_dedup, suffix_dedup, url_filters

TOKENIZER, RANKS, PIECES = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken", "piece_bpe_32k.model"
#: host, path, verdict
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_best_fit_packing(spark, sf_dir):
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())


def op2_document_fingerprints(spark, sf_dir):
    return fingerprints.compare_neighbours(table(spark, sf_dir, "documents"))


def op3_chat_perspectives(spark, sf_dir):
    return chat.perspectives(table(spark, sf_dir, "conversations"))


def op4_embedding_near_dedup(spark, sf_dir):
    return embed_dedup.near_embeddings(table(spark, sf_dir, "embeddings"))


def op5_minhash_near_dedup(spark, sf_dir):
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op6_suffix_array_dedup(spark, sf_dir):
    return suffix_dedup.removal_report(table(spark, sf_dir, "documents"))


def op7_quality_classifier(spark, sf_dir):
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_substring_dedup(spark, sf_dir):
    return substring_dedup.removal_report(table(spark, sf_dir, "documents"))


def op9_source_mixing(spark, sf_dir):
    return mixing.mix_sizes(table(spark, sf_dir, "documents"))


def op10_url_filters(spark, sf_dir):
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_filters.url_filter(table(spark, sf_dir, "pages"), rules)


def op11_byte_bpe(spark, sf_dir):
    return byte_bpe.roundtrip_report(table(spark, sf_dir, "documents"), tokenizer_path(RANKS))


def op12_centroid_clustering(spark, sf_dir):
    return delta_lloyd.cluster_vectors(table(spark, sf_dir, "embeddings"))


def op13_tokenizer_alignment(spark, sf_dir):
    return alignment.alignment_report(table(spark, sf_dir, "documents"), tokenizer_path(RANKS), tokenizer_path(PIECES))


OP3_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, 'unknown') AS speaker,
         replace(coalesce(text, ''), '<|', '< |') AS text
  FROM conversations),
who AS (SELECT DISTINCT conv_id, speaker AS perspective FROM turns),
parts AS (
  SELECT t.*, w.perspective, t.speaker = w.perspective AS mine,
         CASE WHEN t.speaker = w.perspective THEN '<|assistant|>' || chr(10)
              ELSE '<|user:' || t.speaker || '|>' || chr(10) END AS head
  FROM turns t JOIN who w ON t.conv_id IS NOT DISTINCT FROM w.conv_id),
segments AS (SELECT *, head || text || '<|end|>' || chr(10) AS segment FROM parts),
placed AS (
  SELECT *, CAST(sum(length(segment)) OVER (PARTITION BY conv_id, perspective
              ORDER BY turn NULLS LAST, speaker, md5(text) ROWS UNBOUNDED PRECEDING) - length(segment) AS BIGINT) AS start
  FROM segments)
SELECT conv_id, perspective, turn, speaker, CASE WHEN mine THEN 'assistant' ELSE 'user' END AS role, segment, start,
       CASE WHEN mine THEN start + length(head) END AS mask_start,
       CASE WHEN mine THEN start + length(segment) - 1 END AS mask_end
FROM placed
"""

OP9_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         CAST('0x' || substr(md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), text, '')), 1, 13) AS BIGINT)
           / 4503599627370496.0 AS u
  FROM documents),
per AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
ranked AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM per),
weighed AS (
  SELECT *, CASE place % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight,
         source_size * 2.0::DOUBLE AS cap, (SELECT sum(source_size) FROM per) * 1.5::DOUBLE AS share
  FROM ranked),
steps AS (
  SELECT *, (share - coalesce(sum(cap) OVER (ORDER BY cap / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (ORDER BY cap / weight, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighed),
settled AS (SELECT coalesce(arg_min(level, cap / weight), 0.0) AS level FROM steps WHERE cap > level * weight),
targets AS (SELECT source, source_size, least(cap, (SELECT level FROM settled) * weight) AS target FROM weighed),
rated AS (
  SELECT doc_id, size, source_size, target, u,
         CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS rate
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       CAST((floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END) * size AS BIGINT) AS taken
FROM rated
"""

OP10_SQL = r"""
WITH rest AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (
  SELECT page_id,
         translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM rest),
rules(rhost, rpath, rverdict) AS (
  VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
fits AS (
  SELECT p.*, rhost || rpath AS rule, rverdict,
         row_number() OVER (PARTITION BY p.rid ORDER BY length(rhost || rpath) DESC NULLS LAST, length(rhost) DESC) AS n
  FROM (SELECT *, row_number() OVER () AS rid FROM parts) p
  LEFT JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath))
SELECT page_id, host, path, rule, coalesce(rverdict, 'allow') AS verdict FROM fits WHERE n = 1
"""


def queries() -> dict:
    return {f.__name__: f for f in (
        op1_best_fit_packing, op2_document_fingerprints, op3_chat_perspectives, op4_embedding_near_dedup, op5_minhash_near_dedup, op6_suffix_array_dedup, op7_quality_classifier,
        op8_substring_dedup, op9_source_mixing, op10_url_filters,
        op11_byte_bpe, op12_centroid_clustering, op13_tokenizer_alignment,
    )}


def oracle_sql() -> dict[str, str]:
    return {"op3_chat_perspectives": OP3_SQL, "op9_source_mixing": OP9_SQL, "op10_url_filters": OP10_SQL}
