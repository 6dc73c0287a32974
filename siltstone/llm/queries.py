"""One query per operator, over whole tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, exact_dedup, html_extract, license_scan, line_dedup, packing, resharding, simhash, toxicity, vector_dedup
from .common import scratch_path


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))
    return packed.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = html_extract.extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return texts.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document; toxic ones are those that the pipeline drops."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(docs, model).select("doc_id", "severity", "grade", "p_toxic", "toxic", (~F.col("toxic")).alias("kept"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = exact_dedup.exact_dedup(documents(spark, sf_dir), keep="max")
    return marked.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = public_tokenizers.path("byte_bpe_50k.tiktoken")
    both = byte_bpe.encode(documents(spark, sf_dir), vocabulary, public_tokenizers.PATTERN, decoded=True)
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    linked = simhash.near_dedup(documents(spark, sf_dir), size=4, seed=42, radius=4)
    return linked.select("doc_id", F.lower(F.hex("code")).alias("fingerprint"), "component_id")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.line_dedup(documents(spark, sf_dir).select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op8_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dedup.near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


#: The layout that op9 starts from: shards by source, so one of them holds all rows of a hot source.
OLD_SHARDS, NEW_SHARDS = 32, 40


def op9_resharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of shards that change come from the rewritten files, the others from where they stay."""
    docs = documents(spark, sf_dir)
    old = F.pmod(F.crc32(F.coalesce(F.col("source"), F.lit("")).cast("binary")), F.lit(OLD_SHARDS)).cast("int")
    placed, made = resharding.reshard(docs, old, OLD_SHARDS, NEW_SHARDS)
    path = scratch_path(spark, "reshard-files")
    changed = resharding.rewrite(docs.select("doc_id", "text", "source"), old, made, path)
    kept = placed.filter(~F.col("shard").isin(changed)) if changed else placed
    if changed:
        text = F.coalesce(F.col("text"), F.lit(""))
        files = spark.read.schema(f"doc_id {dict(docs.dtypes)['doc_id']}, text string, source string, slot long, shard int").parquet(path)
        kept = kept.unionByName(files.select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), old.alias("old_shard"), "shard", "slot"))
    law, grown = F.lit("bytes").alias("law"), F.lit(None).cast("int").alias("grown_shard")
    return kept.select("doc_id", "size", "text_crc32", law, "shard", "slot", grown, "old_shard")


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.scan(documents(spark, sf_dir))
    labels = F.transform("phrases", lambda x: x.label)
    own = F.transform("matches", lambda x: x.label)
    joined = lambda x: F.array_join(F.array_sort(F.array_distinct(x)), ",")
    first = F.array_min(F.transform("phrases", lambda x: x.first))
    last = F.array_max(F.transform("phrases", lambda x: x.first))
    return found.select("doc_id", "n_words", F.size("phrases").cast("long").alias("n_base"), first.alias("first_word"), last.alias("last_word"), joined(labels).alias("base_labels"), joined(F.concat(labels, own)).alias("labels"), "score")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_best_fit_packing,
        op2_html_extraction,
        op3_toxicity,
        op4_exact_dedup,
        op5_byte_bpe,
        op6_simhash_near_dedup,
        op7_line_dedup,
        op8_embedding_near_dedup,
        op9_resharding,
        op10_license_scan,
    )
}

ORACLE_SQL: dict[str, str] = {
    "op4_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
    """,
    "op7_line_dedup": """
        WITH lines AS (
            SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                   generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS place
            FROM documents
        ), keyed AS (
            SELECT doc_id, line, place,
                   translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                             'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS line_key
            FROM lines
        ), firsts AS (
            SELECT line_key, min(doc_id) AS first_doc FROM keyed WHERE length(line_key) >= 10
            GROUP BY line_key HAVING count(DISTINCT doc_id) >= 2
        ), marked AS (
            SELECT doc_id, line, place, coalesce(doc_id <> first_doc, false) AS gone
            FROM keyed LEFT JOIN firsts USING (line_key)
        )
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (WHERE NOT gone), '')) AS kept_sha256
        FROM marked GROUP BY doc_id
    """,
}
