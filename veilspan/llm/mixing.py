"""Mixing sources to target weights by Poisson replication.

A source's rate is the mean number of times that each of its documents is to appear: the target's share of the budget
over the source's own size. A document's copies are drawn by inverting the Poisson distribution at a uniform number that a
hash of the seed and the id gives, so any task draws the same number again. Documents are exploded by their count and
dealt out by a hash of seed, id and copy, which is a global shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspan.llm.base import pick, positional, staged

TEMPERATURE = 0.7
SEED = 17
MOST_BROADCAST, SALTS = 10_000, 32
TAIL = 1e-15
DIGITS = 12  # hexadecimal digits of a hash that make a uniform number


def target_rates(docs: DataFrame, weights: Mapping[str, float] | None = None, temperature: float = TEMPERATURE, epochs: float = 1.0, source_col: str = "source", text_col: str = "text") -> DataFrame:
    """(source, rate): the mean repetitions of each source's documents.

    Sizes are characters of whole texts over all rows (summed before the shuffle, so a hot source is no hot task). Weights are
    relative; without them a source has its size to the power ``temperature``. A source without a weight, or without any
    character, gets rate zero or one. The budget is ``epochs`` times all characters.
    """
    sizes = pick(docs, source=source_col, text=text_col).groupBy("source").agg(F.sum(F.coalesce(F.length("text"), F.lit(0))).cast("double").alias("size"))
    if weights is None:
        weighted = sizes.withColumn("weight", F.pow("size", F.lit(temperature)))
    else:
        table = F.create_map(*(F.lit(x) for pair in weights.items() for x in pair)) if weights else None
        weighted = sizes.withColumn("weight", F.coalesce(F.try_element_at(table, "source"), F.lit(0.0)) if table is not None else F.lit(0.0))
    sums = weighted.agg(F.sum("size").alias("all_size"), F.sum(F.when(F.col("size") > 0, F.col("weight"))).alias("all_weight"))
    rate = F.when(F.col("size") > 0, F.lit(float(epochs)) * F.col("all_size") * F.col("weight") / F.col("all_weight") / F.col("size")).otherwise(F.lit(1.0))
    return weighted.join(F.broadcast(sums)).select("source", F.coalesce(rate, F.lit(0.0)).alias("rate"))  # sums is one row


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) from the md5 hash of the parts joined by bars; a null part counts as empty."""
    text = F.concat_ws("|", *(F.coalesce(x.cast("string"), F.lit("")) for x in parts))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, DIGITS), 16, 10).cast("double") / F.lit(float(16**DIGITS))


def poisson_inverse(u: Column, rate: Column, most: int) -> Column:
    """The smallest k with P(X <= k) > u, up to ``most``, for which the tail must be below ``TAIL``.

    The fold keeps the probability of k and the sum so far; k counts the sums that u has reached.
    """
    zero = F.struct(F.exp(-rate).alias("p"), F.exp(-rate).alias("sum"), F.lit(0).alias("k"))

    def step(state: Column, i: Column) -> Column:
        p = state["p"] * rate / i
        return F.struct(p.alias("p"), (state["sum"] + p).alias("sum"), (state["k"] + F.when(u >= state["sum"], 1).otherwise(0)).alias("k"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(most)), zero, step, lambda state: state["k"])


def most_copies(rate: float) -> int:
    """A number of copies beyond which the tail of the Poisson distribution is below ``TAIL``."""
    k, p, total = 0, math.exp(-rate), math.exp(-rate)
    while 1 - total > TAIL and k < 20 * rate + 60:
        k += 1
        p *= rate / k
        total += p
    return k + 2


MOST_RATE = 600


def mix(docs: DataFrame, weights: Mapping[str, float] | None = None, temperature: float = TEMPERATURE, epochs: float = 1.0, seed: int = SEED, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", added: bool = True) -> DataFrame:
    """``docs`` with each row repeated by its count, in a global random order; with ``added`` also ``copy`` (from 0) and ``mix_key``, whose order it is.

    Rows with one id have one count. A null id hashes as the empty text; null and empty texts have size zero; a null source is
    a source of its own. With ``added``, columns named ``copy`` or ``mix_key`` of ``docs`` give way; other names, also such that differ only by case, do no harm. An empty table stays
    empty. A rate above ``MOST_RATE`` is an error, as its probabilities would vanish.
    """
    plain, at = positional(docs)
    rates = staged(target_rates(docs, weights, temperature, epochs, source_col, text_col), "rates")
    highest = rates.agg(F.max("rate")).first()[0] or 0.0
    if highest > MOST_RATE:
        raise ValueError(f"a source would be repeated {highest:.0f} times; lower its weight or the epochs")
    kept = [(new, name) for new, name in zip(plain.columns, docs.columns, strict=True) if not (added and name.lower() in ("copy", "mix_key"))]
    own, key = F.col(at[source_col]), F.col(at[id_col])
    if _small(rates):
        rated = plain.join(F.broadcast(rates), own.eqNullSafe(F.col("source")))
    else:
        # A hot source's documents meet the rates in SALTS places.
        named = rates.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).withColumnRenamed("rate", "r").select("source", "salt", "r")
        rated = plain.withColumn("place", F.pmod(F.xxhash64(key, F.col(at[text_col])), F.lit(SALTS)).cast("int")).join(named, (F.col("place") == F.col("salt")) & own.eqNullSafe(F.col("source"))).withColumnRenamed("r", "rate")
    counted = rated.withColumn("count", poisson_inverse(uniform(F.lit(seed), key), F.col("rate"), most_copies(highest))).where("count > 0")
    repeated = counted.select(*(new for new, _ in kept), key.alias("key"), F.explode(F.sequence(F.lit(0), F.col("count") - 1)).alias("copy"))
    keyed = repeated.withColumn("mix_key", uniform(F.lit(seed), F.lit("order"), F.col("key"), F.col("copy")))
    dealt = keyed.repartitionByRange("mix_key").sortWithinPartitions("mix_key")
    more = ["copy", "mix_key"] if added else []
    return dealt.select(*(new for new, _ in kept), *more).toDF(*(name for _, name in kept), *more)


def _small(rates: DataFrame, most: int = MOST_BROADCAST) -> bool:
    """Whether the rates may be broadcast: ``most`` sources or fewer, each with a name of 1,000 characters or fewer."""
    count, longest = rates.agg(F.count("*"), F.coalesce(F.max(F.length("source")), F.lit(0))).first()
    return count <= most and longest <= 1000
