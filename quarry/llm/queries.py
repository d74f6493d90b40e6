"""The registered query of each corpus operator, with production parameters over whole tables, and SQL where it can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import byte_bpe, decontaminate, language_model, license_scan, line_dedup, pii, sharding, simhash, topk_search, toxicity
from quarry.llm.common import table

BPE_RANKS, BPE_PATTERN = "byte_bpe_multi_50k.tiktoken", public_tokenizers.PATTERN


def op1_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = topk_search.quantize(table(spark, sf_dir, "embeddings"))
    return topk_search.exact_topk(rows.where(F.col("id") % 50 == 0), rows, k=5)


def op2_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.score_texts(table(spark, sf_dir, "documents"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path(BPE_RANKS), BPE_PATTERN)


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.stratified_shards(table(spark, sf_dir, "documents")).drop("source")


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_spans(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        *[F.size(_of_kind("base", k)).cast("long").alias(f"n_{kind}") for k, kind in enumerate(pii.BASE)],
        F.sha2(pii.span_text(F.col("base")), 256).alias("base_sha256"),
        pii.span_text(F.col("spans")).alias("spans"),
    )


def _of_kind(spans: str, k: int) -> Column:
    return F.filter(spans, lambda s: s["kind"] == k)


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = line_dedup.mark_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    n, kept = F.size("lines").cast("long"), F.size("kept").cast("long")
    return marked.select("doc.doc_id", n.alias("n_lines"), (n - kept).alias("n_dropped"), F.sha2(F.array_join("kept", "\n"), 256).alias("kept_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_exact_topk": op1_exact_topk,
    "op2_language_model": op2_language_model,
    "op3_license_scan": op3_license_scan,
    "op4_toxicity": op4_toxicity,
    "op5_decontamination": op5_decontamination,
    "op6_byte_bpe": op6_byte_bpe,
    "op7_sharding": op7_sharding,
    "op8_pii": op8_pii,
    "op9_simhash": op9_simhash,
    "op10_line_dedup": op10_line_dedup,
}

ORACLES: dict[str, str] = {
    "op1_exact_topk": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS w
            FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
        q AS (SELECT vec_id AS query_id, w, row_number() OVER () AS query FROM v WHERE vec_id % 50 = 0),
        s AS (
            SELECT query, query_id, c.vec_id, CAST(list_dot_product(q.w, c.w) AS BIGINT) AS score
            FROM q JOIN v c ON query_id <> c.vec_id),
        r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, vec_id) AS rank FROM s)
        SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5""",
    "op7_sharding": f"""
        WITH crc AS (
            SELECT list(list_reduce(list_prepend(i, [0 for k in range(8)]), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t
            FROM range(256) r(i)),
        d AS (
            SELECT doc_id, coalesce('=' || source, '') AS stratum, md5('{sharding.SEED}:' || coalesce(text, '')) AS mix,
                list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: CAST('0x' || h AS BIGINT)) AS bytes
            FROM documents),
        r AS (
            SELECT *, (2 * (row_number() OVER (PARTITION BY stratum ORDER BY mix, doc_id) - 1) + 1) / (2 * count(*) OVER (PARTITION BY stratum)) AS frac FROM d),
        p AS (SELECT *, row_number() OVER (ORDER BY frac, stratum, mix, doc_id) - 1 AS pos, count(*) OVER () AS n FROM r),
        s AS (SELECT *, (pos * {sharding.SHARDS}) // n AS shard FROM p)
        SELECT doc_id, CAST(len(bytes) + 1 AS BIGINT) AS size,
            CAST(xor(list_reduce(list_prepend(4294967295, bytes), lambda c, b: xor(c >> 8, crc.t[xor(c & 255, b) + 1])), 4294967295) AS BIGINT) AS text_crc32,
            'rows' AS law, CAST(shard AS INTEGER) AS shard, CAST(pos - (shard * n + {sharding.SHARDS} - 1) // {sharding.SHARDS} AS BIGINT) AS slot,
            CAST(NULL AS INTEGER) AS grown_shard
        FROM s, crc""",
    "op10_line_dedup": """
        WITH parts AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
        l AS (SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS pos FROM parts),
        k AS (
            SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
        often AS (
            SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 20
            GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
        m AS (SELECT k.*, keeper IS NULL OR doc_id = keeper AS stays FROM k LEFT JOIN often USING (key))
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (NOT stays) AS n_dropped,
            sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (stays), '')) AS kept_sha256
        FROM m GROUP BY doc_id""",
}
