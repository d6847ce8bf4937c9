"""Labelled text: confirmed and pending values replaced by their labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilspan.functions.spans import piece
from veilspan.operators.geometry import touches

PAGE_SEPARATOR = "\f"
REGION_LABEL = "[REDACTED]"
KEYS = ["doc_id", "page_index"]


def entity_label(kind: Column) -> Column:
    return F.concat(F.lit("["), F.upper(kind), F.lit("]"))


def whole_words(text: Column, start: Column, end: Column, words: Column | None = None) -> tuple[Column, Column]:
    """A span widened to the words that it overlaps: those of a page's word array, or runs without white space."""
    if words is not None:
        hit = F.filter(words, lambda w: (w["start"] < end) & (start < w["end"]))
        return F.least(start, F.coalesce(F.array_min(F.transform(hit, lambda w: w["start"])), start)), F.greatest(end, F.coalesce(F.array_max(F.transform(hit, lambda w: w["end"])), end))
    # A span that begins or ends in white space touches no word there.
    inner = piece(text, start, end)
    left = F.when(inner.rlike(r"(?U)^\S"), F.length(F.regexp_extract(piece(text, F.lit(0), start), r"(?U)\S*\z", 0))).otherwise(0)
    right = F.when(inner.rlike(r"(?U)\S\z"), F.length(F.regexp_extract(F.substring(text, end + 1, F.length(text)), r"(?U)^\S*", 0))).otherwise(0)
    return start - left, end + right


def replacements(pages: DataFrame, entities: DataFrame, regions: DataFrame | None = None) -> DataFrame:
    """(doc_id, page_index, start, end, label): what is replaced on each page, widened to words and merged where spans overlap (not where they meet).

    The label is the first span's: the earliest, of several the longest. ``regions`` (doc_id, page_index, box) hide the words that they touch; pages
    then need their ``words``.
    """
    usable = entities.where("review <> 'rejected' AND start IS NOT NULL")
    if "surface_id" in entities.columns:
        usable = usable.where("surface_id IS NULL")
    has_words = "words" in pages.columns
    page = pages.select(*KEYS, F.col("text").alias("_page"), *(["words"] if has_words else []))
    joined = usable.select(*KEYS, "type", "start", "end").join(page, KEYS)
    a, b = whole_words(F.col("_page"), F.col("start"), F.col("end"), F.col("words") if has_words else None)
    spans = joined.select(*KEYS, a.alias("start"), b.alias("end"), entity_label(F.col("type")).alias("label"))
    if regions is not None:
        words = pages.select(*KEYS, F.explode("words").alias("w"))
        hit = words.join(regions.select(*KEYS, "box"), KEYS).where(touches(F.col("w.bbox"), F.col("box")))
        spans = spans.unionByName(hit.select(*KEYS, F.col("w.start").alias("start"), F.col("w.end").alias("end"), F.lit(REGION_LABEL).alias("label")).distinct())
    return merged_labels(spans)


def merged_labels(spans: DataFrame) -> DataFrame:
    order = Window.partitionBy(*KEYS).orderBy("start", F.desc("end"), "label")
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    flagged = spans.withColumn("_new", F.coalesce((F.col("start") >= before).cast("int"), F.lit(1)))
    numbered = flagged.withColumn("_n", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    first = F.min_by("label", F.struct("start", (-F.col("end")).alias("end"), "label"))
    return numbered.groupBy(*KEYS, "_n").agg(F.min("start").alias("start"), F.max("end").alias("end"), first.alias("label")).drop("_n")


def spliced(text: Column, spans: Column) -> Column:
    """The text with sorted, disjoint spans (start, end, label) replaced."""
    zero = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    step = lambda a, s: F.struct(F.concat(a["out"], piece(text, a["at"], s["start"]), s["label"]).alias("out"), s["end"].alias("at"))
    return F.aggregate(spans, zero, step, lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text))))


def redacted_pages(pages: DataFrame, entities: DataFrame, regions: DataFrame | None = None) -> DataFrame:
    """(doc_id, page_index, text): every page with its values replaced; a form feed inside a page becomes a line break. A null text is empty."""
    spans = replacements(pages, entities, regions).groupBy(*KEYS).agg(F.array_sort(F.collect_list(F.struct(F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"), "label"))).alias("_spans"))
    text = F.coalesce("text", F.lit(""))
    joined = pages.select(*KEYS, text.alias("text")).join(spans, KEYS, "left")
    out = F.when(F.col("_spans").isNull(), F.col("text")).otherwise(spliced(F.col("text"), F.col("_spans")))
    return joined.select(*KEYS, F.translate(out, PAGE_SEPARATOR, "\n").alias("text"))


def redact_text(pages: DataFrame, entities: DataFrame, regions: DataFrame | None = None) -> DataFrame:
    """(doc_id, text): the pages of each document joined by form feeds."""
    parts = F.array_sort(F.collect_list(F.struct("page_index", "text")))
    return redacted_pages(pages, entities, regions).groupBy("doc_id").agg(F.array_join(F.transform(parts, lambda x: x["text"]), PAGE_SEPARATOR).alias("text"))
