"""The leak check: nothing of a redacted value may be left in what is published."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilspan.functions.spans import let
from veilspan.functions.text import compact, leak_pattern, literal_pattern
from veilspan.operators.geometry import mostly_inside, off_page, overlaps_inside

LEAK = "doc_id long, layer string, where string, text string, entity_id string, page_index int, kind string"
SHORTEST_LITERAL = 4


def leak(layer: str, where: Column, text: Column, entity_id: Column | None = None, page_index: Column | None = None, kind: str = "text") -> list[Column]:
    return [
        F.lit(layer).alias("layer"), where.alias("where"), text.alias("text"), (F.lit(None).cast("string") if entity_id is None else entity_id).alias("entity_id"),
        (F.lit(None).cast("int") if page_index is None else page_index.cast("int")).alias("page_index"), F.lit(kind).alias("kind"),
    ]


def targets(entities: DataFrame) -> DataFrame:
    """(doc_id, entity_id, text): the texts to look for, each once without regard to spacing; the first entity counts."""
    usable = entities.where("review <> 'rejected' AND text IS NOT NULL").withColumn("_bare", compact(F.col("text"))).where("_bare <> ''")
    first = usable.groupBy("doc_id", "_bare").agg(F.min(F.struct("ordinal", "entity_id", "text")).alias("t"))
    return first.select("doc_id", F.col("t.entity_id").alias("entity_id"), F.col("t.text").alias("text"))


def kept_texts(entities: DataFrame) -> DataFrame:
    """(doc_id, page_index, kept): page texts that review rejected, so that they stay readable."""
    rejected = entities.where("review = 'rejected' AND start IS NOT NULL")
    if "surface_id" in entities.columns:
        rejected = rejected.where("surface_id IS NULL")
    return rejected.groupBy("doc_id", "page_index").agg(F.collect_list(F.coalesce("text", F.lit(""))).alias("kept"))


def copies(text: Column, pattern: Column) -> Column:
    return F.coalesce(F.regexp_count(text, pattern), F.lit(0))


def text_leaks(exported: DataFrame, entities: DataFrame, layer: str = "page_text") -> DataFrame:
    """Targets that a page of (doc_id, page_index, text) holds more often than the copies that review kept on that page."""
    wanted = targets(entities).withColumn("_pattern", leak_pattern(F.col("text"))).withColumnRenamed("text", "target")
    pages = exported.join(wanted, "doc_id").join(kept_texts(entities), ["doc_id", "page_index"], "left")
    # Cheap first: the target's first character run must occur at all.
    pages = pages.where(F.contains("text", F.regexp_extract("target", r"(?U)\S", 0)))
    kept = F.aggregate(F.coalesce("kept", F.array().cast("array<string>")), F.lit(0), lambda a, x: a + copies(x, F.col("_pattern")))
    found = pages.where(copies(F.col("text"), F.col("_pattern")) > kept)
    return found.select("doc_id", *leak(layer, F.concat(F.lit("page "), F.col("page_index")), F.col("target"), F.col("entity_id"), F.col("page_index")))


def missing_pages(exported: DataFrame, pages: DataFrame) -> DataFrame:
    """(doc_id): documents whose export hasn't the pages of the original."""
    a, b = (x.groupBy("doc_id").agg(F.count("*").alias(n)) for x, n in ((exported, "n"), (pages, "m")))
    return a.join(b, "doc_id", "full").where(~F.col("n").eqNullSafe(F.col("m"))).select("doc_id")


def region_leaks(words: DataFrame, regions: DataFrame) -> DataFrame:
    """Words (doc_id, page_index, text, box) left inside redacted regions (doc_id, page_index, entity_id, box)."""
    hit = words.alias("w").join(regions.alias("r"), ["doc_id", "page_index"]).where(overlaps_inside(F.col("w.box"), F.col("r.box")))
    return hit.select("doc_id", *leak("region", F.concat(F.lit("page "), F.col("page_index")), F.col("w.text"), F.col("r.entity_id"), F.col("page_index"), "under_box"))


def off_page_leaks(words: DataFrame) -> DataFrame:
    """Words (doc_id, page_index, text, box, visible) outside the visible area."""
    return words.where(off_page(F.col("box"), F.col("visible"))).select("doc_id", *leak("off_page", F.concat(F.lit("page "), F.col("page_index")), F.col("text"), None, F.col("page_index"), "leftover"))


def thumbnail_leaks(objects: DataFrame) -> DataFrame:
    """Pages that still have a picture of themselves: page dictionaries (doc_id, page_index, content) with a thumbnail that isn't null."""
    has = F.col("content").rlike(r"/Thumb(?![A-Za-z0-9])\s*(?!\s|null(?![A-Za-z0-9]))")
    return objects.where(has).select("doc_id", *leak("thumbnail", F.concat(F.lit("page "), F.col("page_index")), F.lit("page thumbnail"), None, F.col("page_index"), "leftover"))


def surface_leaks(surfaces: DataFrame) -> DataFrame:
    """Any hidden item that an export still has."""
    return surfaces.select("doc_id", *leak("surface", F.col("surface_id"), F.col("value"), None, F.col("page_index"), "leftover"))


def literal_leaks(objects: DataFrame, entities: DataFrame, layer: str = "object") -> DataFrame:
    """Targets of ``SHORTEST_LITERAL`` characters or more, kept nowhere by review, in stored objects (doc_id, where, content)."""
    kept = entities.where("review = 'rejected'").select("doc_id", compact(F.col("text")).alias("_bare")).distinct()
    wanted = targets(entities).withColumn("_bare", compact(F.col("text"))).where(F.length("_bare") >= SHORTEST_LITERAL).join(kept, ["doc_id", "_bare"], "left_anti")
    wanted = wanted.withColumn("_pattern", literal_pattern(F.col("text")))
    found = objects.join(wanted, "doc_id").where(F.regexp_like("content", F.col("_pattern")))
    return found.select("doc_id", *leak(layer, F.col("where"), F.col("text"), F.col("entity_id")))


def searchable(content: Column) -> Column:
    """A file's bytes as text, without the bodies of streams that are compressed or hold a picture.

    The file is cut at each ``endstream``: a part ends with one body at most. What stands before it, back to its object's beginning, says what it holds.
    """

    def kept(part: Column) -> Column:
        before = F.regexp_extract(part, r"(?s)^.*?>>\s*stream\r?\n", 0)
        return let(before, lambda own: F.when((own != "") & F.substring_index(own, "obj", -1).rlike(r"/Filter\b|/Subtype\s*/Image\b"), own).otherwise(part))

    def whole(parts: Column) -> Column:
        n = F.size(parts)
        bodies = F.transform(F.slice(parts, F.lit(1), n - 1), kept)
        return F.array_join(F.concat(bodies, F.slice(parts, n, F.lit(1))), "endstream")

    return let(F.split(F.decode(content, "ISO-8859-1"), "endstream"), whole)


def file_leaks(files: DataFrame, entities: DataFrame) -> DataFrame:
    """The same in raw bytes (doc_id, path, content), bodies of binary streams left out."""
    return literal_leaks(files.select("doc_id", F.lit("file").alias("where"), searchable(F.col("content")).alias("content")), entities, "file_bytes")


def scanned_leaks(reread: DataFrame, boxes: DataFrame, entities: DataFrame) -> DataFrame:
    """What a reader still finds on redacted pictures: words (doc_id, page_index, text, box), mostly under a redacted box, and targets in its text."""
    under = reread.alias("w").join(boxes.alias("b"), ["doc_id", "page_index"]).where(mostly_inside(F.col("w.box"), F.col("b.box")))
    first = under.withColumn("_n", F.row_number().over(Window.partitionBy("doc_id", "page_index", "w.text", "w.box").orderBy("b.entity_id"))).where("_n = 1")
    hidden = first.select("doc_id", *leak("ocr", F.concat(F.lit("page "), F.col("page_index")), F.col("w.text"), F.col("b.entity_id"), F.col("page_index"), "under_box"))
    pages = reread.groupBy("doc_id", "page_index").agg(F.array_join(F.collect_list("text"), " ").alias("text"))
    return text_leaks(pages, entities, "ocr").unionByName(hidden)


def find_leaks(*layers: DataFrame) -> DataFrame:
    """All layers as one report."""
    out = layers[0]
    for other in layers[1:]:
        out = out.unionByName(other)
    return out


def grouped_leaks(leaks: DataFrame, entities: DataFrame, salt: str) -> DataFrame:
    """(doc_id, layer, page_index, name, n, types): leaks of one text together, named by a salted hash instead of the text."""
    named = leaks.join(entities.select("doc_id", "entity_id", "type"), ["doc_id", "entity_id"], "left")
    name = F.substring(F.sha2(F.concat(F.lit(salt), F.col("text")).cast("binary"), 256), 1, 16)
    return named.groupBy("doc_id", "layer", "page_index", name.alias("name")).agg(F.count("*").alias("n"), F.array_sort(F.collect_set("type")).alias("types"))
