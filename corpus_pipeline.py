"""Corpus cleaning as five stages over documents, each calling one operator of hourglass.llm.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes
each result as parquet in the shared folder and hands the written table on.
Stages 1 to 4 return the columns of documents, the last one the packed
pieces.  Null, empty, repeated and very long texts follow the operators'
docstrings; an empty table passes through every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hourglass.llm import decontaminate, queries, radix_dedup, simhash_golay, toxicity, vector_packing
from hourglass.session import configure, materialize


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the toxicity threshold."""
    configure(spark)
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts."""
    configure(spark)
    return radix_dedup.dedup(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked fingerprints."""
    configure(spark)
    return simhash_golay.drop_near_duplicates(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark spans cut out of the texts (n_chars follows); mostly contaminated documents go whole."""
    configure(spark)
    clean = decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    if "n_chars" in clean.columns:
        clean = clean.withColumn("n_chars", F.length("text").cast(clean.schema["n_chars"].dataType))
    return clean


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The packed pieces of the documents that are left."""
    configure(spark)
    pieces = vector_packing.pack_documents(docs, queries.tokenizer_path(), queries.END_ID)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("toxicity", without_toxic),
    ("exact dedup", without_copies),
    ("near-duplicate removal", without_near_copies),
    ("benchmark decontamination", without_benchmark),
    ("packing", packed),
]

#: A learned score and a heuristic packing are not expressible in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    configure(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, f"stage-{k}")
    return docs
