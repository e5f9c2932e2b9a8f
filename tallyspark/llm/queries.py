"""The thin queries over the driver's tables; each derives its contract's columns from its operator's results."""

from __future__ import annotations

import hashlib

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, fill_in_middle, langid, lz_fingerprint, media, neardup, packing, pii, quality, suffix_dedup, toxicity, url_filter, yinyang
from .common import documents, fold

#: The rules of op1.
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return url_filter.judge(pages, rules).select("page_id", "host", "path", "rule", "verdict")


OP1_SQL = """
WITH rules(h, p, v) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'),
    ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
a AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
b AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM a),
c AS (SELECT row_number() OVER () AS n, page_id,
    translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM b),
d AS (SELECT n, h || p AS rule, v, row_number() OVER (PARTITION BY n ORDER BY length(h || p) DESC, h || p) AS k
    FROM c JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p))
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM c LEFT JOIN (SELECT * FROM d WHERE k = 1) USING (n)
"""


def op2_pii_semi_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.spans(documents(spark, sf_dir))


def op3_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(documents(spark, sf_dir), neardup.Rule(words=3, share=85))


def op4_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = media.media_columns(documents(spark, sf_dir))
    return rows.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "shard", "offset", "width", "height", "depth")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(docs, model).select("doc_id", (F.coalesce(fold(), F.lit(1)) == 0).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def op6_lz_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lz_fingerprint.fingerprints(documents(spark, sf_dir))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bpe.encode_documents(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, digests_only=True)
    return rows.select("doc_id", "n_tokens", F.lower(F.hex("ids")).alias("ids_sha256"), F.lower(F.hex("decoded")).alias("decoded_sha256"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return langid.predict(docs, langid.train(docs)).select("doc_id", (F.coalesce(fold(), F.lit(1)) == 0).alias("held_out"), "lang_pred", "score")


def op10_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.summary(suffix_dedup.deduplicated(documents(spark, sf_dir)))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fill_in_middle.fill_in_middle(documents(spark, sf_dir))
    restored = fill_in_middle.restored(F.col("output"), F.col("form"))
    digests = F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"), F.sha2(restored.cast("binary"), 256).alias("restored_sha256")
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


OP11_SQL = """
WITH a AS (SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
b AS (SELECT *, regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]') AS tokens, ('0x' || substr(h, 1, 8))::BIGINT AS h1, ('0x' || substr(h, 9, 8))::BIGINT AS h2,
    ('0x' || substr(h, 17, 8))::BIGINT AS h3, ('0x' || substr(h, 25, 8))::BIGINT AS h4 FROM a),
c AS (SELECT *, len(tokens) AS n, least(h1 % (len(tokens) + 1), h2 % (len(tokens) + 1)) AS p, greatest(h1 % (len(tokens) + 1), h2 % (len(tokens) + 1)) AS q FROM b),
d AS (SELECT *, array_to_string(tokens[1:p], '') AS prefix, array_to_string(tokens[p + 1:q], '') AS middle, array_to_string(tokens[q + 1:], '') AS suffix,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
    sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
    sha256(text) AS restored_sha256 FROM d
"""


def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = yinyang.cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in found.centroids.tolist()]
    whole = sum(found.inertia)
    facts = [(c, own, whole, digest) for c, (own, digest) in enumerate(zip(found.inertia, digests, strict=True))]  # a row for each centroid
    facts = spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.rows.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op12_sql(rounds: int = yinyang.Rule.rounds) -> str:
    """Plain rounds: every vector against every centroid, component by component. The rounds stand one after the other, as recursion can't aggregate."""
    steps = [
        "WITH e AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, embedding FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64)",
        "v AS MATERIALIZED (SELECT r, i, floor(1024 * embedding[i]::DOUBLE)::BIGINT AS x FROM e, range(1, 65) AS t(i))",
        "s AS (SELECT r, row_number() OVER (ORDER BY sha256('3:' || vec_id::VARCHAR), vec_id) - 1 AS c FROM e)",
        "c0 AS MATERIALIZED (SELECT c, i, x FROM s JOIN v USING (r) WHERE c < 8)",
    ]
    for k in range(rounds + 1):
        steps += [
            f"d{k} AS (SELECT r, c, sum((v.x - c{k}.x) * (v.x - c{k}.x)) AS d FROM v JOIN c{k} USING (i) GROUP BY r, c)",
            f"a{k} AS MATERIALIZED (SELECT r, arg_min(c, (d, c)) AS c, min(d)::BIGINT AS d FROM d{k} GROUP BY r)",
        ]
        if k < rounds:
            steps += [
                f"m{k} AS (SELECT c, i, sum(x)::BIGINT AS s, count(*) AS n FROM a{k} JOIN v USING (r) GROUP BY c, i)",
                f"c{k + 1} AS MATERIALIZED (SELECT c, i, CASE WHEN n IS NULL THEN x ELSE (s - ((s % n) + n) % n) // n END AS x FROM c{k} LEFT JOIN m{k} USING (c, i))",
            ]
    steps += [
        f"h AS (SELECT c, sha256(string_agg(x::VARCHAR, ',' ORDER BY i)) AS h FROM c{rounds} GROUP BY c)",
        f"t AS (SELECT c, sum(d)::BIGINT AS own FROM a{rounds} GROUP BY c)",
    ]
    return ",\n".join(steps) + f"\nSELECT vec_id, a.c::INTEGER AS cluster, d AS distance, own AS cluster_inertia, (SELECT sum(d)::BIGINT FROM a{rounds}) AS inertia, h AS centroid_sha256 FROM a{rounds} a JOIN e USING (r) JOIN h USING (c) JOIN t USING (c)"


def op13_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.score(docs, model).select("doc_id", quality.held_out().alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


QUERIES = {f.__name__: f for f in (op1_url_filter, op2_pii_semi_crf, op3_minhash_neardup, op4_media_columns, op5_toxicity, op6_lz_fingerprint, op7_packing, op8_byte_bpe, op9_language_id, op10_suffix_array_dedup, op11_fill_in_middle, op12_centroid_clustering, op13_quality)}
ORACLES = {"op1_url_filter": OP1_SQL, "op11_fill_in_middle": OP11_SQL, "op12_centroid_clustering": op12_sql()}
