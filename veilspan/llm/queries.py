"""The registered query of each operator, and its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspan.llm import bloom_lm, bpe, chroma, cotrain, fertility, html_extract, mixing, simhash, token_store, toxicity


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def tokenizer_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_pages(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cotrain.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.round_trip(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.tiktoken"), tokenizer_pattern())
    return coded.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op4_chroma_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    found = chroma.align(chroma.fingerprints(chroma.rendered(vectors), "id", "media"), vectors.where("vec_id % 100 = 0").select(F.col("vec_id").alias("id")))
    return found.withColumnRenamed("id", "vec_id")


def op5_bloom_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bloom_lm.score(table(spark, sf_dir, "documents"))


def op6_fertility_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fertility.apply_rules(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"), tokenizer_file("piece_bpe_32k.model"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = token_store.store_and_read(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"))
    return stored.select("doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


#: Copies from 1 to MIX_MOST; beyond, the Poisson tail is below 1e-15 for the rates up to 4 that flattened weights give.
MIX_MOST = 30

SQL = {
    "op10_mixing": f"""
WITH sizes AS (
  SELECT source, CAST(sum(coalesce(length(text), 0)) AS DOUBLE) AS size FROM documents GROUP BY source
), sums AS (
  SELECT sum(size) AS all_size, sum(CASE WHEN size > 0 THEN pow(size, {mixing.TEMPERATURE}) END) AS all_weight FROM sizes
), rates AS (
  SELECT source, coalesce(CASE WHEN size > 0 THEN all_size * pow(size, {mixing.TEMPERATURE}) / all_weight / size ELSE 1.0 END, 0.0) AS rate
  FROM sizes, sums
), drawn AS (
  SELECT d.*, rate,
    CAST(('0x' || substr(md5('{mixing.SEED}|' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, {mixing.DIGITS})) AS UBIGINT) / {16**mixing.DIGITS}.0::DOUBLE AS u
  FROM documents d JOIN rates r ON d.source IS NOT DISTINCT FROM r.source
), counted AS (
  SELECT *, list_sum([CASE WHEN u >= list_sum([exp(-rate) * pow(rate, j) / factorial(CAST(j AS INTEGER)) FOR j IN range(0, CAST(k AS INTEGER))]) THEN 1 ELSE 0 END
                      FOR k IN range(1, {MIX_MOST + 1})]) AS copies
  FROM drawn
), repeated AS (
  SELECT *, unnest(range(0, CAST(copies AS BIGINT))) AS copy_no FROM counted WHERE copies > 0
)
SELECT doc_id, text, lang, source, n_chars, CAST(copy_no AS INTEGER) AS copy,
  CAST(('0x' || substr(md5('{mixing.SEED}|order|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || copy_no), 1, {mixing.DIGITS})) AS UBIGINT) / {16**mixing.DIGITS}.0::DOUBLE AS mix_key
FROM repeated
""",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (
            op1_html_extraction,
            op2_quality_classifier,
            op3_byte_bpe,
            op4_chroma_fingerprints,
            op5_bloom_lm,
            op6_fertility_rules,
            op7_simhash,
            op8_toxicity,
            op9_token_store,
            op10_mixing,
        )
    }


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
