"""What kinds of spans a system misses or invents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilspan.functions.spans import _col, overlap, piece
from veilspan.operators.propagate import TITLES
from veilspan.operators.roles import role_noun

ALL = "all"
# Categories, honorifics and the signs around words.
MISS_CATEGORIES = ["all", "words=1", "words=2", "words=3+", "title", "sentence_start", "after_label", "all_caps", "hyphen_apostrophe", "diacritics", "initial"]
ALARM_CATEGORIES = ["all", "words=1", "words=2", "words=3+", "capitalised_word", "all_caps", "title", "sentence_start", "after_label", "role_noun", "organization", "other_type"]
HONORIFICS = (
    "pan pana panu pane panem panovi páni pánové pánům pány paní slečna slečny slečně slečnu slečno slečnou p sl pán pána pánovi pánom pánov pani panej paniu paňou panie slečne "
    "mr mrs ms miss mx sir"
)
TITLE_WORDS = sorted({word.rstrip(".").lower() for title in TITLES for word in title.split()} | set(HONORIFICS.split()))
EDGE = r""",;:!?()\[\]{}"'„“”«»"""
OPENERS = r""" \t"'„“‚‘«»(\[{\-–—"""
TAIL = 200  # characters
HYPHENS = r"[-‐‑–'’ʼ]"


def _is_title(word: Column) -> Column:
    bare = F.regexp_replace(F.regexp_replace(word, rf"^[{EDGE}]+|[{EDGE}]+\z", ""), r"\.+\z", "")
    return F.lower(bare).isin(*TITLE_WORDS)


def _is_initial(word: Column) -> Column:
    return F.regexp_replace(word, rf"^[{EDGE}]+|[{EDGE}]+\z", "").rlike(r"^\p{Lu}\.?\z")


def _words(text: Column) -> Column:
    return F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")


def shape(text: Column | str, start: Column, end: Column) -> Column:
    """The categories of a span that its text and the line before it tell, as a sorted array (``all`` apart)."""
    text = _col(text)
    value = piece(text, start, end)
    words = _words(value)
    before = F.substring_index(piece(text, F.lit(0), start), "\n", -1)
    # No title or initial is as long as the tail, so its words tell the same as the whole line's.
    tail = F.right(before, F.lit(TAIL))
    earlier = _words(tail)
    trimmed = F.regexp_replace(tail, rf"[{OPENERS}]+\z", "")
    last = F.try_element_at(_words(trimmed), F.lit(-1))
    head = F.substring_index(before, ":", 1)
    label = F.when(before.contains(":"), F.size(_words(head)).between(1, 4) & F.ltrim(head).rlike(r"(?U)^\s*\p{L}")).otherwise(False)
    letters = F.regexp_replace(value, r"\P{L}", "")
    first_title = F.coalesce(_is_title(F.try_element_at(earlier, F.lit(-1))), F.lit(False)) | F.coalesce(_is_title(F.try_element_at(words, F.lit(1))), F.lit(False))
    sentence = before.rlike(rf"^[{OPENERS}]*\z") | (trimmed.rlike("[.!?…]$") & ~F.coalesce(_is_title(last) | _is_initial(last), F.lit(False)))
    n = F.size(words)
    found = [
        F.when(n >= 3, "words=3+").when(n >= 0, F.concat(F.lit("words="), n)),
        F.when(first_title, "title"),
        F.when(sentence, "sentence_start"),
        F.when(label, "after_label"),
        F.when((F.length(letters) >= 2) & ~letters.rlike(r"[^\p{Lu}]"), "all_caps"),
        F.when(value.rlike(HYPHENS), "hyphen_apostrophe"),
        F.when(letters.rlike(r"[^\x00-\x7f]"), "diacritics"),
        F.when(F.exists(words, _is_initial), "initial"),
    ]
    return F.array_sort(F.array_compact(F.array(*found)))


def alarm_categories(text: Column | str, start: Column, end: Column, overlapped: Column, kind: Column, language: str | None = None) -> Column:
    """The categories of a false alarm. ``overlapped``: types of gold spans that it overlaps."""
    text = _col(text)
    value = piece(text, start, end)
    words = _words(value)
    own = F.filter(shape(text, start, end), lambda c: c.isin(*ALARM_CATEGORIES))
    letters = F.regexp_replace(value, r"\P{L}", "")
    caps = (F.length(letters) >= 2) & ~letters.rlike(r"[^\p{Lu}]")
    others = F.filter(F.coalesce(overlapped, F.array().cast("array<string>")), lambda t: t != kind)
    more = F.array_compact(
        F.array(
            F.when((F.size(words) == 1) & value.rlike(r"^\p{Lu}") & ~caps, "capitalised_word"),
            F.when(role_noun(F.lower(F.regexp_extract(F.coalesce(F.try_element_at(words, F.lit(1)), F.lit("")), r"\p{L}+", 0)), language), "role_noun"),
            F.when(F.exists(others, lambda t: t == "organization"), "organization"),
            F.when(F.exists(others, lambda t: t != "organization"), "other_type"),
        )
    )
    return F.array_sort(F.array_distinct(F.concat(own, more)))


PLACE = ["doc_id", "page_index"]


def _met(a: DataFrame, b: DataFrame, same_type: bool) -> Column:
    on = (F.col("a.doc_id") == F.col("b.doc_id")) & (F.col("a.page_index") == F.col("b.page_index")) & overlap(F.col("a.start"), F.col("a.end"), F.col("b.start"), F.col("b.end"))
    return on & (F.col("a.type") == F.col("b.type")) if same_type else on


def misses(predicted: DataFrame, gold: DataFrame, pages: DataFrame) -> DataFrame:
    """(doc_id, page_index, type, start, end, outcome, categories): every gold span, ``found`` (an overlap of its type, every visible character covered), ``partly``,
    ``other_type`` (only other types overlap) or ``missed``."""
    a, b = gold.select(*PLACE, "type", "start", "end").distinct().alias("a"), predicted.select(*PLACE, "type", "start", "end").distinct().alias("b")
    ranges = F.collect_list(F.when(F.col("b.start").isNotNull(), F.struct(F.col("b.start").cast("int").alias("start"), F.col("b.end").cast("int").alias("end"))))
    from veilspan.operators.intervals import array_union

    joined = a.join(b, _met(a, b, False), "left").groupBy("a.doc_id", "a.page_index", "a.type", "a.start", "a.end")
    seen = joined.agg(F.bool_or(F.col("b.type") == F.col("a.type")).alias("_same"), F.count("b.type").alias("_n"), ranges.alias("_ranges"))
    page = seen.join(pages.select(*PLACE, F.col("text").alias("_page")), PLACE)
    inside = F.transform(array_union(F.col("_ranges")), lambda r: piece(F.col("_page"), F.greatest(r["start"], F.col("start")), F.least(r["end"], F.col("end"))))
    bare = lambda x: F.length(F.regexp_replace(x, r"(?U)\s", ""))
    covered = F.aggregate(inside, F.lit(0), lambda total, x: total + bare(x))
    whole = bare(piece(F.col("_page"), F.col("start"), F.col("end")))
    state = F.when((F.col("_n") == 0), "missed").when(~F.coalesce("_same", F.lit(False)), "other_type").when(covered < whole, "partly").otherwise("found")
    return page.select(*PLACE, "type", "start", "end", state.alias("outcome"), shape("_page", F.col("start"), F.col("end")).alias("categories"))


def alarms(predicted: DataFrame, gold: DataFrame, pages: DataFrame, language: str | None = None) -> DataFrame:
    """(doc_id, page_index, type, start, end, categories): predictions that no gold span of their type overlaps."""
    a, b = predicted.select(*PLACE, "type", "start", "end").distinct().alias("a"), gold.select(*PLACE, "type", "start", "end").distinct().alias("b")
    wrong = a.join(b, _met(a, b, True), "left_anti").alias("a")
    types = wrong.join(b, _met(wrong, b, False), "left").groupBy("a.doc_id", "a.page_index", "a.type", "a.start", "a.end").agg(F.array_sort(F.collect_set("b.type")).alias("_types"))
    page = types.join(pages.select(*PLACE, F.col("text").alias("_page")), PLACE)
    return page.select(*PLACE, "type", "start", "end", alarm_categories("_page", F.col("start"), F.col("end"), F.col("_types"), F.col("type"), language).alias("categories"))


def miss_tallies(missed: DataFrame) -> DataFrame:
    """(doc_id, type, category, gold, missed, partly, other_type): counts of gold spans by category, ``all`` among them."""
    n = lambda name: F.count_if(F.col("outcome") == name).alias(name)
    rows = missed.withColumn("category", F.explode(F.concat(F.array(F.lit(ALL)), "categories")))
    return rows.groupBy("doc_id", "type", "category").agg(F.count("*").alias("gold"), n("missed"), n("partly"), n("other_type"))


def alarm_tallies(wrong: DataFrame) -> DataFrame:
    rows = wrong.withColumn("category", F.explode(F.concat(F.array(F.lit(ALL)), "categories")))
    return rows.groupBy("doc_id", "type", "category").agg(F.count("*").alias("alarms"))


def examples(rows: DataFrame, side: str, count: int = 5) -> DataFrame:
    """The first ``count`` spans of each type and category (a report's feature): (side, type, category, n, doc_id, page_index, start, end)."""
    exploded = rows.withColumn("category", F.explode(F.concat(F.array(F.lit(ALL)), "categories")))
    order = Window.partitionBy("type", "category").orderBy("doc_id", "page_index", "start", "end")
    return exploded.withColumn("n", F.row_number().over(order)).where(F.col("n") <= count).select(F.lit(side).alias("side"), "type", "category", "n", "doc_id", "page_index", "start", "end")


def tag_recall(found: DataFrame, tags: DataFrame) -> DataFrame:
    """(facet, value, gold, found): recall of gold spans by tag. ``found`` (doc_id, page_index, start, end, found), ``tags`` (doc_id, page_index, start, end, facet, value)."""
    joined = tags.join(found, ["doc_id", "page_index", "start", "end"])
    return joined.groupBy("facet", "value").agg(F.count("*").alias("gold"), F.count_if("found").alias("found"))
