"""Scores of predicted spans against gold spans: matches, coverage, intervals, comparisons.

Spans are rows (doc_id, page_index, type, start, end). Tallies are rows of whole numbers for each document, so sums over documents, draws
and groups are plain sums.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilspan.functions.text import visible_length
from veilspan.functions.spans import piece
from veilspan.operators.intervals import intersect_ranges, union_ranges

ANY = "any"
COUNTS = ["predicted", "predicted_matched", "gold", "gold_matched"]
COVERAGE = ["gold_characters", "residual_characters", "gold_items", "hidden_items", "over_characters", "text_characters"]
PLACE = ["doc_id", "page_index"]
SPAN = [*PLACE, "start", "end"]


def scoreable(entities: DataFrame, types: list[str]) -> DataFrame:
    """Entities in page text of the types that are scored."""
    inside = F.col("start").isNotNull() & F.col("type").isin(*types)
    return entities.where(inside & F.col("surface_id").isNull() if "surface_id" in entities.columns else inside)


def _kinds(spans: DataFrame, types: list[str]) -> DataFrame:
    """Distinct spans by type, and with several types also as ``any``."""
    typed = spans.select(*SPAN, "type").distinct()
    return typed if len(types) < 2 else typed.unionByName(spans.select(*SPAN, F.lit(ANY).alias("type")).distinct())


def match_counts(predicted: DataFrame, gold: DataFrame, types: list[str]) -> DataFrame:
    """(doc_id, mode, type, ``COUNTS``): strict matches are equal spans; partial ones overlap, counted on each side by itself.

    Both sides are dealt once, by document. A place's spans are walked in order: a span overlaps one of the other side if, of those that begin before its end, one ends behind its start.
    """
    sided = lambda spans, own: scoreable(spans, types).select(*SPAN, "type", F.lit(own).alias("_p"), F.lit(not own).alias("_g"))
    rows = sided(predicted, True).unionByName(sided(gold, False)).repartition("doc_id")
    if len(types) > 1:
        rows = rows.withColumn("type", F.explode(F.array("type", F.lit(ANY))))
    spans = rows.groupBy(*SPAN, "type").agg(F.bool_or("_p").alias("_p"), F.bool_or("_g").alias("_g"))
    events = spans.withColumn("_asks", F.explode(F.array(F.lit(True), F.lit(False)))).withColumn("_at", F.when(F.col("_asks"), F.col("end")).otherwise(F.col("start")))
    order = Window.partitionBy(*PLACE, "type").orderBy("_at", F.desc("_asks")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    reach = lambda side: F.max(F.when(~F.col("_asks") & F.col(side), F.col("end"))).over(order)
    seen = events.withColumns({"_to_p": reach("_p"), "_to_g": reach("_g")}).where("_asks")
    placed = F.col("page_index").isNotNull()  # without a page nothing matches
    n = lambda c, name: F.count_if(c & placed).alias(name)
    tallies = seen.groupBy("doc_id", "type").agg(
        F.count_if("_p").alias("predicted"), F.count_if("_g").alias("gold"), n(F.col("_p") & F.col("_g"), "both"), n(F.col("_p") & (F.col("_to_g") > F.col("start")), "p"), n(F.col("_g") & (F.col("_to_p") > F.col("start")), "g")
    )
    mode = lambda name, p, g: F.struct(F.lit(name).alias("mode"), F.col(p).alias("predicted_matched"), F.col(g).alias("gold_matched"))
    modes = tallies.select("doc_id", "type", "predicted", "gold", F.explode(F.array(mode("strict", "both", "both"), mode("partial", "p", "g"))).alias("m"))
    return modes.select("doc_id", "m.mode", "type", "predicted", "m.predicted_matched", "gold", "m.gold_matched")


def coverage(predicted: DataFrame, gold: DataFrame, types: list[str], pages: DataFrame) -> DataFrame:
    """(doc_id, type, ``COVERAGE``): how many characters of gold spans no prediction covers, and how much is covered beyond them.

    Any prediction in page text covers, whatever its type; only predictions of scored types count as over-redaction. White space never counts. A gold span without
    visible characters counts as hidden. Every type has a row for each document of ``pages``.
    """
    page = pages.select(*PLACE, F.coalesce("text", F.lit("")).alias("_page"), F.length(F.coalesce("text", F.lit(""))).alias("_length"))

    def ranges(spans: DataFrame, keys: list[str]) -> DataFrame:
        cut = spans.join(page.select(*PLACE, "_length"), PLACE).select(*keys, F.least("start", "_length").alias("start"), F.least("end", "_length").alias("end"))
        return union_ranges(cut, keys)

    def visible(spans: DataFrame) -> Column:
        return spans.join(page, PLACE).withColumn("_n", visible_length(piece(F.col("_page"), F.col("start"), F.col("end"))))

    def by_type(spans: DataFrame, name: str) -> DataFrame:
        return visible(spans).groupBy("doc_id", "type").agg(F.sum("_n").alias(name))

    redacted = predicted.where("start IS NOT NULL")
    redacted = redacted.where("surface_id IS NULL") if "surface_id" in predicted.columns else redacted
    covered = ranges(redacted.select(*SPAN), PLACE)
    p, g = (_kinds(scoreable(x, types), types) for x in (predicted, gold))
    keys = [*PLACE, "type"]
    gold_ranges, own_ranges, anywhere = ranges(g, keys), ranges(p, keys), ranges(scoreable(gold, types).select(*SPAN), PLACE)

    def met(a: DataFrame, b: DataFrame, columns: list[str]) -> DataFrame:
        joined = a.alias("a").join(b.alias("b"), PLACE).where("a.start < b.end AND b.start < a.end")
        return joined.select(*PLACE, *columns, F.greatest("a.start", "b.start").alias("start"), F.least("a.end", "b.end").alias("end"))

    items = g.join(page.select(*PLACE, "_length"), PLACE).select(*keys, F.least("start", "_length").alias("start"), F.least("end", "_length").alias("end")).distinct()
    items = items.withColumn("_start", F.col("start")).withColumn("_end", F.col("end"))
    item_keys = [*keys, "_start", "_end"]
    seen = visible(items).select(*item_keys, F.col("_n").alias("all"))
    hidden = visible(met(items, covered, ["type", "_start", "_end"])).groupBy(*item_keys).agg(F.sum("_n").alias("hidden"))
    judged = seen.join(hidden, item_keys, "left").groupBy("doc_id", "type").agg(F.count("*").alias("gold_items"), F.count_if(F.col("all") == F.coalesce("hidden", F.lit(0))).alias("hidden_items"))
    names = F.explode(F.array(*(F.lit(x) for x in ([*types, ANY] if len(types) > 1 else types))))
    out = page.groupBy("doc_id").agg(F.sum(visible_length(F.col("_page"))).alias("text_characters")).select("doc_id", "text_characters", names.alias("type"))
    parts = [
        by_type(gold_ranges, "gold_characters"),
        by_type(met(gold_ranges, covered, ["type"]), "_hidden"),
        judged,
        by_type(own_ranges, "_own"),
        by_type(met(own_ranges, anywhere, ["type"]), "_right"),
    ]
    for part in parts:
        out = out.join(part, ["doc_id", "type"], "left")
    out = out.na.fill(0)
    return out.select("doc_id", "type", "gold_characters", (F.col("gold_characters") - F.col("_hidden")).alias("residual_characters"), "gold_items", "hidden_items", (F.col("_own") - F.col("_right")).alias("over_characters"), "text_characters")


def ratio(a: Column | str, b: Column | str) -> Column:
    """A share, or null of nothing."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    return F.try_divide(a.cast("double"), F.when(b != 0, b).cast("double"))


def precision() -> Column:
    return ratio("predicted_matched", "predicted")


def recall() -> Column:
    return ratio("gold_matched", "gold")


def f_beta(beta: float) -> Column:
    """Null without gold spans; without predictions the precision counts as 0."""
    p, r, w = F.coalesce(precision(), F.lit(0.0)), recall(), beta * beta
    return F.when(r.isNotNull(), F.coalesce(F.try_divide((1 + w) * p * r, F.when(w * p + r != 0, w * p + r)), F.lit(0.0)))


def count_metrics() -> dict[str, Column]:
    return {"precision": precision(), "recall": recall(), "f1": f_beta(1.0), "f2": f_beta(2.0)}


def coverage_metrics() -> dict[str, Column]:
    return {"residual": ratio("residual_characters", "gold_characters"), "hidden_whole": ratio("hidden_items", "gold_items"), "over_redaction": 1000.0 * ratio("over_characters", "text_characters")}


def total(tallies: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    return tallies.groupBy(*keys).agg(*(F.sum(x).alias(x) for x in columns))


def draws(documents: DataFrame, count: int, seed: int) -> DataFrame:
    """(draw, doc_id, weight): ``count`` bootstrap samples of the documents (doc_id), with replacement, as large as their number.

    Each place of a draw takes the document at a number that md5 gives, so every engine draws alike. ``documents`` is numbered in the order of ids.
    """
    numbered, size = in_order(documents.select("doc_id").distinct(), "doc_id")
    places = documents.sparkSession.range(count * size).select(F.expr(f"cast(id div {max(size, 1)} as int)").alias("draw"), (F.col("id") % max(size, 1)).alias("place"))
    n = F.conv(F.substring(F.md5(F.concat_ws("/", F.lit(seed), "draw", "place").cast("binary")), 1, 8), 16, 10).cast("long") % max(size, 1)
    weights = places.groupBy("draw", n.alias("n")).agg(F.count("*").alias("weight"))
    return weights.join(numbered, "n").select("draw", "doc_id", "weight")


def in_order(rows: DataFrame, key: str, parts: int = 256) -> tuple[DataFrame, int]:
    """``rows`` with their number ``n`` in the order of a whole-number key, and how many there are. Ranges of the key are counted first, then each is numbered by itself."""
    from pyspark.sql import Window

    least, most = rows.agg(F.min(key), F.max(key)).first()
    if least is None:
        return rows.withColumn("n", F.lit(0).cast("long")), 0
    width = (most - least) // parts + 1
    bucket = F.expr(f"cast(({key} - {least}) div {width} as int)")
    counts = dict(rows.groupBy(bucket.alias("_b")).count().collect())  # at most ``parts`` rows
    before, total = {}, 0
    for name in sorted(counts):
        before[name] = total
        total += counts[name]
    offsets = F.create_map(*(F.lit(x) for pair in before.items() for x in pair))
    order = Window.partitionBy("_b").orderBy(key)
    return rows.withColumn("_b", bucket).withColumn("n", (F.row_number().over(order) - 1 + F.element_at(offsets, F.col("_b"))).cast("long")).drop("_b"), total


def resampled(tallies: DataFrame, drawn: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """(draw, keys, columns): the tallies (doc_id, keys, columns) summed over each draw. Rows of zeros only are left out before the join, and come back as zeros."""
    some = tallies.where(" OR ".join(f"{x} <> 0" for x in columns))
    sums = drawn.join(some, "doc_id").groupBy("draw", *keys).agg(*(F.sum(F.col("weight") * F.col(x)).alias(x) for x in columns))
    if not keys:
        return drawn.select("draw").distinct().join(sums, "draw", "left").na.fill(0, columns)
    every = drawn.agg(F.collect_set("draw").alias("draws"))  # one row: the draws' numbers, not their documents
    groups = tallies.select(*keys).distinct().join(F.broadcast(every)).select(*keys, F.explode("draws").alias("draw"))
    return groups.join(sums, ["draw", *keys], "left").na.fill(0, columns)


def intervals(tallies: DataFrame, drawn: DataFrame, keys: list[str], columns: list[str], metrics: dict[str, Column]) -> DataFrame:
    """(keys, metric, value, low, high): each metric over all documents, with the 2.5 and 97.5 percentiles (nearest rank) over the draws where it is defined."""
    long = lambda df, extra: df.select(*extra, F.explode(F.array(*(F.struct(F.lit(name).alias("metric"), value.alias("value")) for name, value in metrics.items()))).alias("m")).select(*extra, "m.*")
    whole = long(total(tallies, keys, columns) if keys else tallies.agg(*(F.sum(x).alias(x) for x in columns)), keys)
    sampled = long(resampled(tallies, drawn, keys, columns), ["draw", *keys]).where("value IS NOT NULL")
    bounds = sampled.groupBy(*keys, "metric").agg(F.expr("percentile_disc(0.025) WITHIN GROUP (ORDER BY value)").alias("low"), F.expr("percentile_disc(0.975) WITHIN GROUP (ORDER BY value)").alias("high"))
    return whole.join(bounds, [*keys, "metric"], "left").select(*keys, "metric", "value", "low", "high")


def paired_differences(baseline: DataFrame, candidate: DataFrame, drawn: DataFrame, keys: list[str], columns: list[str], metrics: dict[str, Column]) -> DataFrame:
    """(keys, metric, delta, low, high, p_value): candidate less baseline on the same draws; the p-value is two-sided."""
    long = lambda df, extra, name: df.select(*extra, F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), value.alias(name)) for m, value in metrics.items()))).alias("m")).select(*extra, "m.*")
    plain = lambda df, name: long(total(df, keys, columns) if keys else df.agg(*(F.sum(x).alias(x) for x in columns)), keys, name)
    whole = plain(baseline, "a").join(plain(candidate, "b"), [*keys, "metric"]).select(*keys, "metric", (F.col("b") - F.col("a")).alias("delta"))
    on = ["draw", *keys]
    pairs = long(resampled(baseline, drawn, keys, columns), on, "a").join(long(resampled(candidate, drawn, keys, columns), on, "b"), [*on, "metric"]).select(*keys, "metric", (F.col("b") - F.col("a")).alias("d")).where("d IS NOT NULL")
    low, high = (F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY d)") for q in (0.025, 0.975))
    share = lambda condition: F.avg(F.when(condition, 1.0).otherwise(0.0))
    p = F.least(F.lit(1.0), 2 * F.least(share(F.col("d") <= 0), share(F.col("d") >= 0)))
    bounds = pairs.groupBy(*keys, "metric").agg(low.alias("low"), high.alias("high"), p.alias("p_value"))
    return whole.join(bounds, [*keys, "metric"], "left").select(*keys, "metric", "delta", "low", "high", "p_value")


def spread(values: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n, mean, sd, lowest, highest, above_zero, by_seed): of a metric's values (keys, seed, value) over replicates; the deviation needs two."""
    by_seed = F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("seed").cast("string").alias("key"), F.col("value").alias("value")))))
    return values.groupBy(*keys).agg(
        F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"), F.min("value").alias("lowest"), F.max("value").alias("highest"),
        F.count_if(F.col("value") > 0).alias("above_zero"), by_seed.alias("by_seed"),
    )


def seed_differences(baseline: DataFrame, candidate: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, seed, value): candidate less baseline by seed; a side without seeds (null) meets every seed of the other."""
    a, b = baseline.select(*keys, F.col("seed").alias("s1"), F.col("value").alias("v1")), candidate.select(*keys, F.col("seed").alias("s2"), F.col("value").alias("v2"))
    pairs = a.join(b, keys).where("s1 = s2 OR s1 IS NULL OR s2 IS NULL")
    return pairs.select(*keys, F.coalesce("s2", "s1").alias("seed"), (F.col("v2") - F.col("v1")).alias("value"))


def outcome(f2_low: Column, f2_high: Column, residual_low: Column, residual_high: Column) -> Column:
    """``loss`` if either interval speaks against the candidate, ``win`` if both speak for it, else ``tie``."""
    return F.when((f2_high < 0) | (residual_low > 0), "loss").when((f2_low > 0) & (residual_high < 0), "win").otherwise("tie")


def verdict_sentence(outcomes: DataFrame, opponent: str) -> DataFrame:
    """(wins, losses, ties, sentence) of a relation (corpus, outcome): one of four fixed sentences."""
    n = lambda name: F.count_if(F.col("outcome") == name)
    names = lambda name: F.array_join(F.array_sort(F.collect_list(F.when(F.col("outcome") == name, F.col("corpus")))), ", ")
    counts = outcomes.agg(n("win").alias("wins"), n("loss").alias("losses"), n("tie").alias("ties"), names("win").alias("_better"), names("loss").alias("_worse"))
    text = (
        F.when(F.col("losses") > 0, F.concat(F.lit(f"does not beat {opponent}; better on "), F.when(F.col("_better") == "", "none").otherwise(F.col("_better")), F.lit(", worse on "), F.col("_worse")))
        .when((F.col("wins") > 0) & (F.col("ties") == 0), F.lit(f"beats {opponent} on the reserved test data"))
        .when(F.col("wins") > 0, F.concat(F.lit(f"at least as good as {opponent}; better on "), F.col("_better")))
        .otherwise(F.lit(f"no measurable difference from {opponent}"))
    )
    return counts.withColumn("sentence", text).drop("_better", "_worse")


def largest_residuals(tallies: DataFrame, count: int = 5) -> DataFrame:
    """The documents (doc_id, residual_characters) with most characters left, the first of equals; those with none are left out."""
    return tallies.where("residual_characters > 0").orderBy(F.desc("residual_characters"), "doc_id").limit(count)


__all__ = ["ANY", "COUNTS", "COVERAGE", "coverage", "draws", "f_beta", "intersect_ranges", "intervals", "match_counts", "paired_differences", "resampled", "spread"]
