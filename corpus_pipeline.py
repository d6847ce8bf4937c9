"""A training corpus from ``documents``: quality classifier, quality rules, near-duplicates, mixing, and byte-level BPE.

Each stage works on all that the one before kept. All but the last return the columns of ``documents``.

Nulls in any column, empty and very long texts, repeated rows and empty tables are what the stages' operators say of them: a null text counts as empty, so the quality
rules reject it; a null in the metadata is a category of its own; of rows with one id near-duplicates keep one; rows without an id stay; a null source is a source.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspan.llm import bpe, cotrain, fertility, mixing, near_copies, simhash
from veilspan.llm.base import scratch
from veilspan.llm.queries import tokenizer_file, tokenizer_pattern


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier takes for good."""
    return cotrain.classify(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), carry=True)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the fertility bands."""
    return fertility.apply_rules(docs, tokenizer_file("byte_bpe_50k.json"), tokenizer_file("piece_bpe_32k.model"), carry=True)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: shingles of five words, similarity 0.8 or more."""
    return simhash.keep_one(docs, near_copies.near_copies)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated to the target weights of their sources, in a global random order."""
    return mixing.mix(docs, added=False)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, as digests, with the bytes that they decode to."""
    coded = bpe.round_trip(docs, tokenizer_file("byte_bpe_50k.tiktoken"), tokenizer_pattern())
    return coded.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality classifier", quality_classifier),
    ("quality rules", quality_rules),
    ("near-duplicates", near_duplicates),
    ("mixing", mix_sources),
    ("byte-level BPE", byte_bpe),
]

#: The classifier and the tokenisers are beyond SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet in the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = scratch(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
