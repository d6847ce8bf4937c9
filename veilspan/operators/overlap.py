"""Training texts that are held out elsewhere, and samples that every engine draws alike."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspan.functions.text import text_key


def held_texts(texts: DataFrame) -> DataFrame:
    """(key, splits): keys of held-out texts (split, text) with the splits that hold them; texts without a visible character have no key."""
    keyed = texts.select("split", text_key(F.col("text")).alias("key")).where("key IS NOT NULL")
    return keyed.groupBy("key").agg(F.array_sort(F.collect_set("split")).alias("splits"))


def without_held(texts: DataFrame, held: DataFrame) -> DataFrame:
    """Texts whose key isn't held out; those without a key stay."""
    keyed = texts.withColumn("_key", text_key(F.col("text")))
    return keyed.join(held.select(F.col("key").alias("_key")), "_key", "left_anti").select(*texts.columns)


def overlap_counts(texts: DataFrame, held: DataFrame) -> DataFrame:
    """(split, n): how many texts were left out because of each split."""
    keyed = texts.select(text_key(F.col("text")).alias("key")).where("key IS NOT NULL")
    return keyed.join(held, "key").select(F.explode("splits").alias("split")).groupBy("split").agg(F.count("*").alias("n"))


def seed_for(seed: int, purpose: str) -> Column:
    """A number of 64 bits for a purpose, from a hash of both."""
    return F.conv(F.substring(F.sha2(F.lit(f"{seed}/{purpose}").cast("binary"), 256), 1, 16), 16, 10).cast("decimal(20,0)")


def seeded_sample(rows: DataFrame, key: str, count: int, seed: int) -> DataFrame:
    """``count`` rows (an exact number, the operator's feature) by a hash of the seed and the key."""
    return rows.orderBy(F.md5(F.concat_ws("|", F.lit(seed), F.col(key).cast("string")).cast("binary")), key).limit(count)


def repeated(rows: DataFrame, times: Column) -> DataFrame:
    """Each row as often as ``times`` says, with its number."""
    return rows.where(times > 0).withColumn("repeat", F.explode(F.sequence(F.lit(1), times)))
