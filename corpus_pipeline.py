"""A training corpus from raw documents in five stages, each written and read again.

quality rules -> one of each group of near copies -> secrets removed -> sources mixed to
target weights -> best-fit packing. Filtering stages keep every clean document: mixing
repeats documents where a domain falls short and thins none.

Nulls: a null text is empty, so the quality rules reject it; a null id, lang or source
passes through as it is, and n_chars is counted anew after secrets go. Rows of equal text
are near copies of each other, whole repeated rows and rows without an id included: one of
them stays. Texts of any length are read whole, and packing cuts them into sequences.
Columns beyond those of documents, with any names, pass through the first four stages. An
empty table passes as an empty one; without labels nothing is known of domains, and each
document then counts to all alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bytefold.functions.ship import ship
from bytefold.llm import mixing, neardup, packing, quality, queries, secrets, workspace


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return quality.accepted(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return neardup.distinct(docs)


def remove_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    clean = secrets.redacted(docs)
    return clean.withColumn("n_chars", F.length("text").cast("long"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    known = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return mixing.mixed(docs, docs, queries.MIX_TARGETS, domain="lang", least=1.0, known=known)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return packing.pack(docs)


STAGES = [
    ("quality rules", keep_quality),
    ("SimHash near-dedup", drop_near_copies),
    ("secret scans", remove_secrets),
    ("mixing to target weights", mix_sources),
    ("best-fit packing", pack_sequences),
]

#: Fingerprints, forests and packing are beyond SQL; tests hold the stages to brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = workspace.keep(docs, f"stage{i}")
    return docs
