"""Running finders over pages and surfaces."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspan.functions.spans import exploded, let
from veilspan.operators import finders
from veilspan.operators.merge import merged_spans


def entity_id(*parts: str) -> Column:
    """A name that the same finding has in every run."""
    return F.substring(F.sha2(F.concat_ws("|", *(F.coalesce(F.col(x).cast("string"), F.lit("-")) for x in parts)).cast("binary"), 256), 1, 32)


def as_entities(spans: DataFrame, source: str = "rule", review: str = "pending") -> DataFrame:
    """Spans as pending entities."""
    named = spans.withColumn("entity_id", entity_id("doc_id", "page_index", "surface_id", "type", "start", "end"))
    return named.withColumn("source", F.lit(source)).withColumn("review", F.lit(review))


def scan(places: DataFrame, language: Column | None = None, scanned: Column | None = None, only: list[finders.Finder] | None = None, merged: bool = False, keep: Sequence[str] = ()) -> DataFrame:
    """(doc_id, page_index, surface_id, ``keep``, ordinal, type, start, end, text): what the finders find in a relation with ``text``, before merging or ``merged``.

    All finders run in one projection, so a text is read once, and a place's spans are merged where they stand.
    """
    spans = finders.find_all("text", language, scanned, only)
    # No filter on empty arrays: it would be pushed below and find all over again.
    found = places.withColumn("_spans", merged_spans(spans) if merged else spans)
    for name, kind in (("page_index", "int"), ("surface_id", "string")):
        if name not in found.columns:
            found = found.withColumn(name, F.lit(0 if name == "page_index" else None).cast(kind))
    return exploded(found, "_spans", ["doc_id", "page_index", "surface_id", *keep])


def detect(places: DataFrame, language: Column | None = None, scanned: Column | None = None, only: list[finders.Finder] | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """The merged findings of the rules as entities, with the columns ``keep`` of their places."""
    return as_entities(scan(places, language, scanned, only, merged=True, keep=keep).withColumn("score", F.lit(None).cast("double")))


def places_of(pages: DataFrame, surfaces: DataFrame) -> DataFrame:
    """Pages and surfaces as one relation that can be scanned: (doc_id, page_index, surface_id, text)."""
    text = pages.select("doc_id", "page_index", F.lit(None).cast("string").alias("surface_id"), "text")
    return text.unionByName(surfaces.select("doc_id", "page_index", "surface_id", F.col("value").alias("text")))


def pages_of_documents(documents: DataFrame) -> DataFrame:
    """(doc_id, page_index, text, lang) of the table ``documents``: each is one page."""
    return documents.select("doc_id", F.lit(0).alias("page_index"), "text", "lang")


def pages_of_conversations(conversations: DataFrame) -> DataFrame:
    """(doc_id, page_index, text): a conversation is a document, its turns are pages."""
    return conversations.select(F.col("conv_id").alias("doc_id"), F.col("turn").cast("int").alias("page_index"), "text")


def recognised_language(text: Column, least_letters: int = 100, least_share: float = 0.9) -> Column:
    """The language of a text by its most frequent small words, or null.

    Null below ``least_letters`` letters in the first 20,000 characters, or where no language has ``least_share`` of the small words
    found, or where that language has no rules. A stand-in for a trained classifier, which plugs in as a function of the text.
    """
    every = sorted({word for own in SMALL_WORDS.values() for word in own})

    def told(head: Column) -> Column:
        letters = F.length(F.regexp_replace(head, r"\P{L}+", ""))
        small = F.filter(F.split(F.lower(head), r"[^\p{L}]+"), lambda w: w.isin(*every))
        return F.when(letters >= least_letters, let(let(small, counted), likeliest))

    def counted(small: Column) -> Column:
        among = lambda own: F.size(F.filter(small, lambda w: w.isin(*own)))
        return F.struct(*(among(own).alias(tag) for tag, own in SMALL_WORDS.items()))

    def likeliest(counts: Column) -> Column:
        total, best = sum((counts[tag] for tag in SMALL_WORDS), F.lit(0)), F.greatest(*(counts[tag] for tag in SMALL_WORDS))
        out = F.lit(None).cast("string")
        for tag in SMALL_WORDS:
            out = F.when((counts[tag] == best) & (counts[tag] >= F.lit(least_share) * total) & (total > 0), F.lit(tag if tag in finders.BY_LANGUAGE else None)).otherwise(out)
        return out

    return let(F.substring(text, 1, 20_000), told)


# Frequent words that tell the languages apart.
SMALL_WORDS = {
    "cs": ["je", "se", "že", "která", "který", "jsem", "jsou", "byl", "byla", "bylo", "nebo", "při", "není", "podle", "pro", "jako", "také"],
    "sk": ["je", "sa", "že", "ktorá", "ktorý", "som", "sú", "bol", "bola", "bolo", "alebo", "pri", "nie", "podľa", "pre", "ako", "tiež"],
    "en": ["the", "of", "and", "to", "in", "is", "that", "for", "was", "with", "are", "this", "by", "from", "at"],
    "de": ["der", "die", "und", "das", "ist", "nicht", "mit", "den", "von", "sich", "auch", "für", "auf", "ein", "eine"],
    "fr": ["le", "les", "des", "est", "une", "dans", "pour", "que", "qui", "sur", "pas", "avec", "du", "au", "et"],
    "es": ["el", "los", "las", "del", "una", "por", "con", "para", "que", "se", "es", "no", "en", "lo"],
}


def document_language(pages: DataFrame, requested: Column | None = None) -> DataFrame:
    """(doc_id, language): the requested tag, or what all pages together are recognised as where it is ``auto`` or missing."""
    whole = pages.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_index", "text"))), lambda x: x["text"]), "\n").alias("text"))
    found = recognised_language(F.col("text"))
    if requested is None:
        return whole.select("doc_id", found.alias("language"))
    return whole.select("doc_id", F.when(requested == "auto", found).otherwise(requested).alias("language"))
