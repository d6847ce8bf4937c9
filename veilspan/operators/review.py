"""Review: changes to findings, and the checks that they keep to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspan.functions.spans import contains, piece
from veilspan.operators.detect import entity_id
from veilspan.operators.geometry import boxes_for_span, enclosing
from veilspan.operators.propagate import propagate_occurrences, remove_with_repeats
from veilspan.operators.redact import whole_words
from veilspan.schema import REGION, REVIEWS

KEY = ["doc_id", "entity_id"]


def trimmed(text: Column, start: Column, end: Column) -> Column:
    """(start, end) narrowed past signs at the edges unless nothing would be left."""
    inner = piece(text, start, end)
    left, right = F.length(F.regexp_extract(inner, r"(?U)^\W*", 0)), F.length(F.regexp_extract(inner, r"(?U)\W*\z", 0))
    some = left < F.length(inner)
    return F.struct(F.when(some, start + left).otherwise(start).cast("int").alias("start"), F.when(some, end - right).otherwise(end).cast("int").alias("end"))


def set_reviews(entities: DataFrame, chosen: DataFrame, state: str) -> DataFrame:
    """``entities`` with the state of ``chosen`` (doc_id, entity_id) set."""
    if state not in REVIEWS:
        raise ValueError(f"no review state {state!r}")
    marked = entities.join(chosen.select(*KEY).distinct().withColumn("_chosen", F.lit(True)), KEY, "left")
    return marked.withColumn("review", F.when(F.col("_chosen"), F.lit(state)).otherwise(F.col("review"))).select(*entities.columns)


def adjust_spans(entities: DataFrame, changes: DataFrame, pages: DataFrame) -> DataFrame:
    """``entities`` with the spans of ``changes`` (doc_id, entity_id, new_start, new_end), and texts to match; spans outside the page stay."""
    joined = entities.join(changes.select(*KEY, "new_start", "new_end"), KEY, "left").join(pages.select("doc_id", "page_index", F.col("text").alias("_page")), ["doc_id", "page_index"], "left")
    valid = F.coalesce((F.col("new_start") >= 0) & (F.col("new_start") < F.col("new_end")) & (F.col("new_end") <= F.length("_page")), F.lit(False))
    start, end = F.when(valid, F.col("new_start")).otherwise(F.col("start")), F.when(valid, F.col("new_end")).otherwise(F.col("end"))
    text = F.when(valid, piece(F.col("_page"), F.col("new_start"), F.col("new_end"))).otherwise(F.col("text"))
    return joined.select(*(c for c in entities.columns if c not in ("start", "end", "text")), start.alias("start"), end.alias("end"), text.alias("text"))


def new_spans(pages: DataFrame, entities: DataFrame, selected: DataFrame) -> DataFrame:
    """Confirmed manual findings for ``selected`` (doc_id, page_index, start, end, type): whole words, signs at the edges trimmed, none inside a finding that counts."""
    joined = selected.join(pages.select("doc_id", "page_index", F.col("text").alias("_page")), ["doc_id", "page_index"])
    a, b = whole_words(F.col("_page"), F.col("start"), F.col("end"))
    cut = joined.withColumn("_cut", trimmed(F.col("_page"), a, b)).select("doc_id", "page_index", "type", F.col("_cut.start").alias("start"), F.col("_cut.end").alias("end"), "_page")
    cut = cut.where(F.regexp_like(piece(F.col("_page"), F.col("start"), F.col("end")), F.lit(r"\S")))
    usable = entities.where("review <> 'rejected' AND start IS NOT NULL").select("doc_id", "page_index", "start", "end")
    inside = (F.col("n.doc_id") == F.col("e.doc_id")) & (F.col("n.page_index") == F.col("e.page_index")) & contains(F.col("e.start"), F.col("e.end"), F.col("n.start"), F.col("n.end"))
    free = cut.alias("n").join(usable.alias("e"), inside, "left_anti")
    text = piece(F.col("_page"), F.col("start"), F.col("end"))
    out = free.withColumn("text", text).drop("_page").withColumn("surface_id", F.lit(None).cast("string")).withColumn("source", F.lit("manual")).withColumn("review", F.lit("confirmed"))
    return out.withColumn("entity_id", entity_id("doc_id", "page_index", "surface_id", "type", "start", "end"))


def add_findings(pages: DataFrame, entities: DataFrame, selected: DataFrame, propagate: bool = True) -> DataFrame:
    """``entities`` with manual findings and the further occurrences of their texts."""
    added = new_spans(pages, entities, selected).withColumn("ordinal", F.lit(1 << 40) + F.monotonically_increasing_id())
    columns = ["doc_id", "page_index", "type", "start", "end", "text", "source", "review"]
    out = entities.select(*columns).unionByName(added.select(*columns))
    if propagate:
        base = entities.select(*columns, "ordinal").unionByName(added.select(*columns, "ordinal"))
        out = out.unionByName(propagate_occurrences(pages, base, added).select(*columns))
    return out


def new_regions(pages: DataFrame, selected: DataFrame) -> DataFrame:
    """Confirmed regions of boxes (doc_id, page_index, box) clipped to their pages; those without area are left out."""
    joined = selected.join(pages.select("doc_id", "page_index", "width", "height"), ["doc_id", "page_index"])
    clip = lambda x, most: F.least(F.greatest(x, F.lit(0.0)), most)
    b = F.struct(clip(F.col("box.x0"), F.col("width")).alias("x0"), clip(F.col("box.y0"), F.col("height")).alias("y0"), clip(F.col("box.x1"), F.col("width")).alias("x1"), clip(F.col("box.y1"), F.col("height")).alias("y1"))
    out = joined.withColumn("box", b).where("box.x0 < box.x1 AND box.y0 < box.y1")
    return out.select("doc_id", "page_index", F.lit(REGION).alias("type"), F.array("box").alias("bboxes"), F.lit("manual").alias("source"), F.lit("confirmed").alias("review"))


def remove_entities(entities: DataFrame, removed: DataFrame) -> DataFrame:
    return entities.join(removed.select(*KEY), KEY, "left_anti")


def resolve_boxes(entities: DataFrame, pages: DataFrame, surfaces: DataFrame | None = None) -> DataFrame:
    """``entities`` with missing boxes filled from the words of their spans, or from their surface's box."""
    joined = entities.join(pages.select("doc_id", "page_index", F.col("words").alias("_words")), ["doc_id", "page_index"], "left")
    own = F.when(F.col("surface_id").isNull() & F.col("start").isNotNull(), boxes_for_span(F.col("_words"), F.col("start"), F.col("end")))
    if surfaces is not None:
        joined = joined.join(surfaces.select("doc_id", "surface_id", F.col("bbox").alias("_box")), ["doc_id", "surface_id"], "left")
        own = F.coalesce(own, F.when(F.col("_box").isNotNull(), F.array("_box")))
    boxes = F.when(F.size(F.coalesce("bboxes", F.array().cast("array<struct<x0: double, y0: double, x1: double, y1: double>>"))) > 0, F.col("bboxes")).otherwise(own)
    return joined.withColumn("bboxes", boxes).select(*entities.columns)


def broken_spans(entities: DataFrame) -> DataFrame:
    """Entities whose offsets, or whose region, aren't well-formed."""
    region = F.col("type") == REGION
    one = (F.size("bboxes") == 1) & (F.element_at("bboxes", 1)["x0"] < F.element_at("bboxes", 1)["x1"]) & (F.element_at("bboxes", 1)["y0"] < F.element_at("bboxes", 1)["y1"])
    good_region = one & F.col("start").isNull() & F.col("end").isNull() & F.col("text").isNull()
    good_span = (F.col("start") >= 0) & (F.col("end") > F.col("start")) & F.col("text").isNotNull() & F.coalesce(F.col("score").between(0, 1), F.lit(True))
    return entities.where(~F.coalesce(F.when(region, good_region).otherwise(good_span), F.lit(False)))


def dangling(entities: DataFrame, pages: DataFrame, surfaces: DataFrame) -> DataFrame:
    """Entities whose page or surface isn't there, or whose surface is on another page."""
    on_page = entities.where("surface_id IS NULL").join(pages.select("doc_id", "page_index"), ["doc_id", "page_index"], "left_anti")
    s = surfaces.select("doc_id", "surface_id", F.col("page_index").alias("_page"))
    there = entities.where("surface_id IS NOT NULL").join(s, ["doc_id", "surface_id"], "left_semi")
    lost = entities.where("surface_id IS NOT NULL").join(s, ["doc_id", "surface_id"], "left_anti")
    moved = there.join(s, ["doc_id", "surface_id"]).where(~F.col("page_index").eqNullSafe(F.col("_page"))).select(*entities.columns)
    return on_page.select(*entities.columns).unionByName(lost.select(*entities.columns)).unionByName(moved)


def stale(entities: DataFrame, pages: DataFrame) -> DataFrame:
    """Entities in page text whose text isn't what the page has at their offsets."""
    joined = entities.where("surface_id IS NULL AND start IS NOT NULL").join(pages.select("doc_id", "page_index", F.col("text").alias("_page")), ["doc_id", "page_index"], "left")
    return joined.where(~piece(F.col("_page"), F.col("start"), F.col("end")).eqNullSafe(F.col("text"))).select(*entities.columns)


def document_boxes(entities: DataFrame) -> DataFrame:
    """(doc_id, entity_id, box): the box around all of an entity's boxes."""
    return entities.select(*KEY, enclosing(F.col("bboxes")).alias("box")).where("box IS NOT NULL")


def review_counts(entities: DataFrame) -> DataFrame:
    return entities.groupBy("doc_id", "review").agg(F.count("*").alias("n"))


__all__ = ["add_findings", "adjust_spans", "broken_spans", "dangling", "new_regions", "new_spans", "remove_entities", "remove_with_repeats", "resolve_boxes", "review_counts", "set_reviews", "stale", "trimmed"]
