"""Scores of what a reader made of scanned pages: boxes, ink, places of planted items.

Truth words are rows (doc_id, page_index, word_no, text, corners array<struct<x, y>>, ink), read words are rows (doc_id, page_index, text, start, end, box).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspan.functions.spans import exploded, matches
from veilspan.functions.text import words_pattern
from veilspan.operators.geometry import area, covers, iou, shared_area, touches

PAGE = ["doc_id", "page_index"]
BOXED, COVERED, UNDER = 0.5, 0.99, 0.3


def around(corners: Column) -> Column:
    """The box around a word's corners."""
    side = lambda name: F.transform(corners, lambda p: p[name])
    return F.struct(F.array_min(side("x")).alias("x0"), F.array_min(side("y")).alias("y0"), F.array_max(side("x")).alias("x1"), F.array_max(side("y")).alias("y1"))


def box_scores(truth: DataFrame, read: DataFrame) -> DataFrame:
    """(doc_id, words, boxed): truth words, and those that one read box matches by half of the joint area."""
    words = truth.withColumn("box", around(F.col("corners"))).alias("t")
    met = (F.col("t.doc_id") == F.col("r.doc_id")) & (F.col("t.page_index") == F.col("r.page_index")) & (iou(F.col("t.box"), F.col("r.box")) >= BOXED)
    hit = words.join(read.alias("r"), met, "left_semi").groupBy("doc_id").agg(F.count("*").alias("boxed"))
    return words.groupBy("doc_id").agg(F.count("*").alias("words")).join(hit, "doc_id", "left").select("doc_id", "words", F.coalesce("boxed", F.lit(0)).alias("boxed"))


def ink_scores(ink: DataFrame) -> DataFrame:
    """(doc_id, ink, covered, partly_outside) of words (doc_id, ink, covered), ``covered`` being the ink inside boxes."""
    outside = F.col("covered") < F.col("ink") * COVERED
    return ink.groupBy("doc_id").agg(F.sum("ink").alias("ink"), F.sum("covered").alias("covered"), F.count_if(outside).alias("partly_outside"))


def item_locations(item_words: DataFrame, read: DataFrame, pages: DataFrame) -> DataFrame:
    """(doc_id, item, page_index, start, end): planted items in the read text, by the read words whose centres lie in the items' truth words.

    ``item_words`` (doc_id, item, page_index, text, corners), a row for each truth word of an item. A whole-word occurrence of the item's text is taken instead where it
    overlaps most.
    """
    x, y = (F.col("r.box.x0") + F.col("r.box.x1")) / 2, (F.col("r.box.y0") + F.col("r.box.y1")) / 2
    on = item_words.alias("i").join(read.alias("r"), PAGE).where(covers(F.col("i.corners"), x, y))
    rough = on.groupBy("doc_id", "item", "page_index", F.col("i.text").alias("wanted")).agg(F.min("r.start").alias("start"), F.max("r.end").alias("end"))
    page = rough.join(pages.select(*PAGE, F.col("text").alias("page")), PAGE)
    exact = page.withColumn("_spans", matches("page", words_pattern(F.col("wanted"))))
    places = exploded(exact.withColumnsRenamed({"start": "s0", "end": "e0"}), "_spans", ["doc_id", "item", "page_index", "s0", "e0"]).where("start < e0 AND s0 < end")
    best = places.groupBy("doc_id", "item", "page_index").agg(F.max_by(F.struct("start", "end"), F.struct((F.least("end", "e0") - F.greatest("start", "s0")).alias("n"), (-F.col("start")).alias("first"))).alias("b"))
    return rough.join(best, ["doc_id", "item", "page_index"], "left").select("doc_id", "item", "page_index", F.coalesce("b.start", "start").alias("start"), F.coalesce("b.end", "end").alias("end"))


def item_residue(shares: DataFrame) -> DataFrame:
    """(doc_id, item, share): the largest share of a word's ink that is left, of words (doc_id, item, before, after); an item that isn't found (null) counts as whole."""
    share = F.when(F.col("before").isNull(), 1.0).otherwise(F.coalesce(F.try_divide("after", "before"), F.lit(0.0)))
    return shares.groupBy("doc_id", "item").agg(F.max(share).alias("share"))


def reach(read: DataFrame, margin: float) -> DataFrame:
    """(doc_id, words, reaching): read words (with a ``line``) whose boxes, grown by a share of their height, touch a word of another line."""
    grow = (F.col("box.y1") - F.col("box.y0")) * margin
    grown = read.withColumn("_n", F.monotonically_increasing_id()).withColumn("wide", F.struct((F.col("box.x0") - grow).alias("x0"), (F.col("box.y0") - grow).alias("y0"), (F.col("box.x1") + grow).alias("x1"), (F.col("box.y1") + grow).alias("y1")))
    a, b = grown.alias("a"), read.alias("b")
    met = (F.col("a.doc_id") == F.col("b.doc_id")) & (F.col("a.page_index") == F.col("b.page_index")) & (F.col("a.line") != F.col("b.line")) & touches(F.col("a.wide"), F.col("b.box"))
    hit = a.join(b, met, "left_semi").groupBy("doc_id").agg(F.count("*").alias("reaching"))
    return read.groupBy("doc_id").agg(F.count("*").alias("words")).join(hit, "doc_id", "left").na.fill(0, ["reaching"])


def read_there(boxes: DataFrame, ingested: DataFrame) -> DataFrame:
    """Boxes (doc_id, page_index, box) of which a read word (doc_id, page_index, box) covers more than a third or so."""
    met = (F.col("a.doc_id") == F.col("b.doc_id")) & (F.col("a.page_index") == F.col("b.page_index")) & (shared_area(F.col("a.box"), F.col("b.box")) > UNDER * area(F.col("a.box")))
    return boxes.alias("a").join(ingested.alias("b"), met, "left_semi")


def scan_totals(scores: DataFrame) -> DataFrame:
    """(engine, level, characters, character_errors, words, boxed, error_rate, boxed_rate): pooled, so long documents count by their length."""
    sums = scores.groupBy("engine", "level").agg(*(F.sum(c).alias(c) for c in ("characters", "character_errors", "words", "boxed")))
    return sums.withColumn("error_rate", F.try_divide("character_errors", "characters")).withColumn("boxed_rate", F.try_divide("boxed", "words"))


def oracle_entities(items: DataFrame, locations: DataFrame, pages: DataFrame) -> DataFrame:
    """A confirmed finding for each planted page item that was located."""
    from veilspan.functions.spans import piece

    joined = items.where("carrier = 'page'").select("doc_id", "item", "type").join(locations, ["doc_id", "item"]).join(pages.select(*PAGE, F.col("text").alias("_page")), PAGE)
    return joined.select("doc_id", "page_index", "type", "start", "end", piece(F.col("_page"), F.col("start"), F.col("end")).alias("text"), F.lit("manual").alias("source"), F.lit("confirmed").alias("review"))
