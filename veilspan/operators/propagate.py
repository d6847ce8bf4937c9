"""Further occurrences of marked texts, and titles beside names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilspan.functions.spans import contains, exploded, matches, overlap, piece
from veilspan.functions.text import words_pattern
from veilspan.operators.merge import with_places

# Titles before a name and degrees after it.
TITLES = ["Bc.", "BcA.", "Ing.", "Ing. arch.", "Mgr.", "MgA.", "MUDr.", "MDDr.", "MVDr.", "JUDr.", "PhDr.", "RNDr.", "PharmDr.", "PaedDr.", "ThDr.", "ThLic.", "ICDr.", "RSDr.", "Dr.", "doc.", "prof."]
DEGREES = ["Ph.D.", "PhD.", "Ph.D", "PhD", "Th.D.", "ArtD.", "CSc.", "DrSc.", "DiS.", "MBA", "MPA", "LL.M.", "DBA"]
LOOK_BACK = 80


def _choices(names: list[str]) -> str:
    longest_first = sorted(names, key=lambda x: (-len(x), x))
    return "|".join(r"\s+".join("\\Q" + part + "\\E" for part in name.split()) for name in longest_first)


BEFORE = r"(?iuU)(?:(?<!\w)(?:" + _choices(TITLES) + r")\s*)+\z"
AFTER = r"(?iuU)^(?:\s*,?\s*(?:" + _choices(DEGREES) + r")(?!\w))+"


def marked_texts(entities: DataFrame) -> DataFrame:
    """(doc_id, marked, type, place): distinct texts of entities that aren't rejected; the first one's type counts. Longer texts come first."""
    usable = entities.where((F.col("review") != "rejected") & (F.col("text") != ""))
    first = usable.groupBy("doc_id", "text").agg(F.min(F.struct("ordinal", "type")).alias("f"))
    place = F.struct((-F.length("text")).alias("size"), F.col("f.ordinal").alias("ordinal"))
    return first.select("doc_id", F.col("text").alias("marked"), F.col("f.type").alias("type"), place.alias("place"))


def propagate_occurrences(pages: DataFrame, entities: DataFrame, marked: DataFrame | None = None) -> DataFrame:
    """New spans where marked texts occur again in page text, as whole words with any spacing.

    An occurrence is left out if it overlaps a rejected entity, lies in an existing one, or lies in an occurrence that was claimed
    before it (longer texts claim first). ``entities`` needs an ``ordinal`` for the order of first sight. (doc_id, page_index, type, start, end, text)
    """
    entities = with_places(entities)
    on_page = entities.where(F.col("surface_id").isNull() & F.col("start").isNotNull())
    asked = marked_texts(entities if marked is None else with_places(marked))
    pairs = pages.select("doc_id", "page_index", F.col("text").alias("page")).join(asked, "doc_id")
    # A cheap test first: the first word must stand somewhere on the page.
    pairs = pairs.where(F.contains("page", F.regexp_extract("marked", r"(?U)\S+", 0)))
    found = pairs.withColumn("_spans", matches("page", words_pattern(F.col("marked"))))
    rows = exploded(found.withColumn("kind", F.col("type")), "_spans", ["doc_id", "page_index", "kind", "place"]).select("doc_id", "page_index", F.col("kind").alias("type"), "place", "start", "end", "text")
    # One exchange, which all joins below and both sides of the last one share, so occurrences are searched once.
    rows = rows.repartition("doc_id", "page_index")
    here = lambda b: (F.col("a.doc_id") == F.col(f"{b}.doc_id")) & (F.col("a.page_index") == F.col(f"{b}.page_index"))
    cols = lambda a, b: (F.col(f"{a}.start"), F.col(f"{a}.end"), F.col(f"{b}.start"), F.col(f"{b}.end"))
    rejected = on_page.where("review = 'rejected'").select("doc_id", "page_index", "start", "end")
    rows = rows.alias("a").join(rejected.alias("r"), here("r") & overlap(*cols("a", "r")), "left_anti")
    taken = on_page.select("doc_id", "page_index", "start", "end")
    rows = rows.alias("a").join(taken.alias("t"), here("t") & contains(*cols("t", "a")), "left_anti")
    earlier = (F.col("b.place") < F.col("a.place")) | ((F.col("b.place") == F.col("a.place")) & (F.col("b.start") < F.col("a.start")))
    rows = rows.alias("a").join(rows.alias("b"), here("b") & contains(*cols("b", "a")) & earlier, "left_anti")
    return rows.select("doc_id", "page_index", "type", "start", "end", "text", F.lit("propagated").alias("source"), F.lit("pending").alias("review"))


def widened_over_titles(text: Column, start: Column, end: Column) -> tuple[Column, Column]:
    """Start and end of a name with the titles before it and the degrees after it."""
    before = F.regexp_extract(piece(text, F.greatest(start - LOOK_BACK, F.lit(0)), start), BEFORE, 0)
    after = F.regexp_extract(piece(text, end, end + 200), AFTER, 0)
    return start - F.length(before), end + F.length(after)


def extend_with_titles(pages: DataFrame, entities: DataFrame) -> DataFrame:
    """``entities`` with persons in page text widened over titles and degrees, unless that reaches into another entity.

    Two persons that would meet only when both are widened: the earlier one is widened, the later one isn't.
    """
    # An entity's name is what it is, so a step that runs again names it alike; entities that are alike in all collide with one another.
    entities = with_places(entities)
    entities = entities.withColumn("_n", F.xxhash64("doc_id", "page_index", "surface_id", "type", "start", "end"))
    persons = entities.where("type = 'person' AND surface_id IS NULL").groupBy("_n", "doc_id", "page_index", "start", "end").count().where("count = 1").drop("count")
    joined = persons.join(pages.select("doc_id", "page_index", F.col("text").alias("page")), ["doc_id", "page_index"])
    new_start, new_end = widened_over_titles(F.col("page"), F.col("start"), F.col("end"))
    wide = joined.select("_n", "doc_id", "page_index", "start", "end", new_start.cast("int").alias("new_start"), new_end.cast("int").alias("new_end"), "page")
    wide = wide.where("new_start <> start OR new_end <> end")
    others = entities.where("surface_id IS NULL AND start IS NOT NULL").select("_n", "doc_id", "page_index", "start", "end")
    here = (F.col("w.doc_id") == F.col("o.doc_id")) & (F.col("w.page_index") == F.col("o.page_index")) & (F.col("w._n") != F.col("o._n"))
    free = wide.alias("w").join(others.alias("o"), here & overlap(F.col("w.new_start"), F.col("w.new_end"), F.col("o.start"), F.col("o.end")), "left_anti")
    # Among those that may be widened, only neighbours in order can meet.
    order = Window.partitionBy("doc_id", "page_index").orderBy("start", "end", "_n")
    free = free.withColumn("_before", F.lag("new_end").over(order)).where("_before IS NULL OR new_start >= _before")
    moved = free.select("_n", "new_start", "new_end", piece(F.col("page"), F.col("new_start"), F.col("new_end")).alias("new_text"))
    out = entities.join(moved, "_n", "left")
    kept = [c for c in entities.columns if c not in ("_n", "start", "end", "text")]
    return out.select(*kept, F.coalesce("new_start", "start").alias("start"), F.coalesce("new_end", "end").alias("end"), F.coalesce("new_text", "text").alias("text"))


def remove_with_repeats(entities: DataFrame, removed: DataFrame) -> DataFrame:
    """``entities`` without those of ``removed`` (doc_id, entity_id), and without propagated, unconfirmed repeats of their texts that nothing else marks."""
    spaced = lambda c: F.trim(F.regexp_replace(c, r"(?U)\s+", " "))
    gone = entities.join(removed.select("doc_id", "entity_id"), ["doc_id", "entity_id"], "left_semi")
    left = entities.join(removed.select("doc_id", "entity_id"), ["doc_id", "entity_id"], "left_anti").withColumn("_text", spaced(F.col("text")))
    texts = gone.select("doc_id", spaced(F.col("text")).alias("_text")).distinct()
    still = left.where("source <> 'propagated' AND review <> 'rejected'").select("doc_id", "_text").distinct()
    orphaned = texts.join(still, ["doc_id", "_text"], "left_anti").withColumn("_orphan", F.lit(True))
    out = left.join(orphaned, ["doc_id", "_text"], "left")
    drop = F.coalesce("_orphan", F.lit(False)) & (F.col("source") == "propagated") & (F.col("review") == "pending")
    return out.where(~drop).select(*entities.columns)


