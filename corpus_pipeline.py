"""A training corpus from `documents`: toxic documents go, repeated lines go, of near-duplicates one stays, and what
is left is packed into token sequences.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept. Documents with a null doc_id
can't be told apart and are never dropped as near-duplicates; rows that repeat a doc_id are one document.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm import line_dedup, packing, simhash, toxicity
from siltstone.llm.common import materialize


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that are more likely toxic than not, by a model of the labelled ones among them."""
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(docs, model).filter(~F.col("toxic")).select(*docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A line of 10 characters or more stays in the smallest document that holds it."""
    out = line_dedup.line_dedup(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast("long"))
    return out.select(*docs.columns)


#: Of 256 bits of fingerprint. Two texts whose sets of five-word shingles have a Jaccard similarity of 0.8 differ in
#: 38.7 bits on average (256 / pi * acos(2 * 0.8 / 1.8)), give or take 5.7; the fewest shingles, 4 of 5, in 48, give or
#: take 6.2. This is five deviations above both; what it lets pass is compared by the shingles.
NEAR_BITS = 80


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that are linked by shingles of five words at a similarity of 0.8, the smallest doc_id stays."""
    gone = simhash.near_sets(docs, percent=80, radius=NEAR_BITS, size=5).select(F.col("node").alias("doc_id"))
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of at most 4096."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", keep_one_of_near_copies),
    ("packing", pack_sequences),
]

#: SQL can express neither the classifier nor the fingerprints' hashes; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each one's result written and read again before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
