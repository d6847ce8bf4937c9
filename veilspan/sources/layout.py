"""Pages from placed words, and words from plain text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilspan.functions.spans import _col, matches
from veilspan.functions.text import normalize_text

KEYS = ["doc_id", "page_index"]
LINE_HEIGHT, CHAR_WIDTH, LEAST_WIDTH, LEAST_HEIGHT = 14.0, 5.0, 595.0, 842.0


def place_words(words: DataFrame) -> DataFrame:
    """(doc_id, page_index, word_no, text, separator, start, end): placed words (doc_id, page_index, block, line, word_no, text) in reading order.

    Words are put in normal form and empty ones dropped; a line's words are apart by a space, lines by a line break, blocks by an empty line.
    """
    normal = words.withColumn("text", normalize_text("text")).where(F.length(F.trim("text")) > 0)
    order = Window.partitionBy(*KEYS).orderBy("block", "line", "word_no")
    block, line = F.lag("block").over(order), F.lag("line").over(order)
    separator = F.when(block.isNull(), "").when(block != F.col("block"), "\n\n").when(line != F.col("line"), "\n").otherwise(" ")
    laid = normal.withColumn("separator", separator)
    end = F.sum(F.length("separator") + F.length("text")).over(order.rowsBetween(Window.unboundedPreceding, 0)).cast("int")
    return laid.withColumn("end", end).withColumn("start", F.col("end") - F.length("text"))


def assemble(words: DataFrame) -> DataFrame:
    """(doc_id, page_index, text, words): pages of placed words, each word with its offsets and box."""
    laid = place_words(words)
    box = F.col("bbox") if "bbox" in words.columns else F.lit(None).cast("struct<x0: double, y0: double, x1: double, y1: double>")
    parts = F.array_sort(F.collect_list(F.struct("start", "end", "separator", "text", box.alias("bbox"))))
    pages = laid.groupBy(*KEYS).agg(parts.alias("_parts"))
    text = F.array_join(F.transform("_parts", lambda p: F.concat(p["separator"], p["text"])), "")
    return pages.select(*KEYS, text.alias("text"), F.transform("_parts", lambda p: F.struct(p["text"].alias("text"), p["start"].alias("start"), p["end"].alias("end"), p["bbox"].alias("bbox"))).alias("words"))


def is_stamped_scan() -> list[Column]:
    """Aggregates over a page's pictures (area, page_area, words_over, visible): whether a picture page has only a few stamped words."""
    share = F.try_divide(F.sum("area"), F.max("page_area"))
    return [(F.coalesce(share >= 0.5, F.lit(False)) & F.bool_and("visible") & (F.max("words_over") < 20)).alias("is_scan")]


def pages_needing_ocr(pages: DataFrame) -> DataFrame:
    """Pages without a text layer that no reader has read."""
    return pages.where(~F.col("has_text_layer") & F.col("raster_dpi").isNull())


def synthetic_words(text: Column | str) -> Column:
    """Words of plain text with made-up boxes: a character is five points wide, a line fourteen high."""
    text = _col(text)

    def boxed(w: Column) -> Column:
        before = F.substring(text, F.lit(1), w["start"])
        line = F.length(before) - F.length(F.translate(before, "\n", ""))
        column = F.length(F.regexp_extract(before, r"[^\n]*\z", 0))
        box = F.struct((column * CHAR_WIDTH).alias("x0"), (line * LINE_HEIGHT).alias("y0"), ((column + F.length(w["text"])) * CHAR_WIDTH).alias("x1"), ((line + 1) * LINE_HEIGHT - 2).alias("y1"))
        return F.struct(w["text"].alias("text"), w["start"].alias("start"), w["end"].alias("end"), box.alias("bbox"))

    return F.transform(matches(text, r"(?U)\S+", "word"), boxed)


def make_pages(texts: DataFrame) -> DataFrame:
    """Pages of plain texts (doc_id, page_index, text), with words, boxes and sizes."""
    worded = texts.withColumn("words", synthetic_words("text"))
    width = F.greatest(F.lit(LEAST_WIDTH), F.coalesce(F.array_max(F.transform("words", lambda w: w["bbox"]["x1"])), F.lit(0.0)))
    lines = F.length("text") - F.length(F.translate("text", "\n", "")) + 1
    return worded.select(*KEYS, width.alias("width"), F.greatest(F.lit(LEAST_HEIGHT), lines * LINE_HEIGHT).alias("height"), "text", "words", F.lit(True).alias("has_text_layer"), F.lit(None).cast("double").alias("raster_dpi"))


def paged_sentences(sentences: DataFrame, per_page: int = 12) -> DataFrame:
    """(doc_id, page_index, sentence, text, offset): sentences (doc_id, sentence, text) dealt to pages, with their offsets there; apart by line breaks."""
    order = Window.partitionBy("doc_id").orderBy("sentence")
    numbered = sentences.withColumn("page_index", F.floor((F.row_number().over(order) - 1) / per_page).cast("int"))
    on_page = Window.partitionBy("doc_id", "page_index").orderBy("sentence").rowsBetween(Window.unboundedPreceding, -1)
    return numbered.withColumn("offset", F.coalesce(F.sum(F.length("text") + 1).over(on_page), F.lit(0)).cast("int"))


def reading_order(boxes: DataFrame) -> DataFrame:
    """(doc_id, box_no, line): boxes sorted by the height of their centres; a box is on a line while its centre is above the bottom of the line's first box.

    The walk depends on its own steps, so it folds over each page's sorted boxes.
    """
    centre = (F.col("box.y0") + F.col("box.y1")) / 2
    rows = boxes.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(centre.alias("y"), F.col("box.x0").alias("x"), F.col("box.y1").alias("bottom"), "box_no"))).alias("_b"))
    zero = F.struct(F.lit(-1).alias("line"), F.lit(None).cast("double").alias("bottom"), F.array().cast("array<struct<line: int, x: double, box_no: bigint>>").alias("out"))

    def step(a: Column, b: Column) -> Column:
        new = a["bottom"].isNull() | (b["y"] >= a["bottom"])
        line = a["line"] + F.when(new, 1).otherwise(0)
        item = F.struct(line.cast("int").alias("line"), b["x"].alias("x"), b["box_no"].cast("bigint").alias("box_no"))
        return F.struct(line.alias("line"), F.when(new, b["bottom"]).otherwise(a["bottom"]).alias("bottom"), F.concat(a["out"], F.array(item)).alias("out"))

    placed = rows.select("doc_id", F.posexplode(F.array_sort(F.aggregate("_b", zero, step, lambda a: a["out"]))).alias("n", "b"))
    return placed.select("doc_id", F.col("b.box_no").alias("box_no"), F.col("b.line").alias("line"), "n")
