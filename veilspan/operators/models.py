"""Plug-in models and readers: protocols, a registry, and a cache of what models said.

A model runs in Arrow batches, loaded once in each worker. What it said above its floor is kept by a hash of model, labels and text, so a lower threshold
later asks nothing again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspan.functions.spans import piece
from veilspan.operators.merge import merge_entities
from veilspan.operators.windows import model_entities, model_tokens, token_windows

SPANS = "array<struct<start: int, end: int, label: string, score: double>>"


class SpanModel(Protocol):
    """Says which spans of each text have which label."""

    def inference(self, texts: list[str], labels: list[str], threshold: float) -> list[list[dict]]: ...


class OcrEngine(Protocol):
    """Reads words (text, box, block, line) off a picture."""

    name: str
    box_margin: float

    def read(self, image: bytes) -> list[dict]: ...


class Tagger(Protocol):
    """Labels tokens of sentences, outermost first."""

    def tag(self, sentences: list[list[str]]) -> list[list[list[tuple[str, float]]]]: ...


ENGINES: dict[str, Callable[..., object]] = {}
THRESHOLDS: dict[str, float] = {}


def register(name: str, loader: Callable[..., object], threshold: float = 0.5) -> None:
    """Names an engine, with the function that loads it and its usual threshold."""
    ENGINES[name] = loader
    THRESHOLDS[name] = threshold


def threshold_for(name: str, entry: float | None = None, asked: float | None = None) -> float:
    """The caller's threshold, else the catalogue entry's, else the engine's."""
    return next(x for x in (asked, entry, THRESHOLDS.get(name, 0.5)) if x is not None)


@lru_cache(maxsize=4)
def _loaded(loader: Callable[[], SpanModel]) -> SpanModel:
    return loader()


def cache_floor(threshold: float) -> float:
    """What is asked of a model so that its answers can be kept: 0.1, or 0.02 for a lower threshold."""
    if threshold < 0.02:
        raise ValueError("a threshold below 0.02 isn't kept")
    return 0.1 if threshold >= 0.1 else 0.02


def cache_key(model: str, labels: list[str], text: Column) -> Column:
    return F.sha2(F.concat(F.lit(f"{model}\n{','.join(labels)}\n"), text).cast("binary"), 256)


def predict(texts: DataFrame, loader: Callable[[], SpanModel], labels: list[str], threshold: float, keys: Sequence[str] = ("key",)) -> DataFrame:
    """(key, spans): what a model says of texts (key, text), above the threshold. ``keys``: other columns that name a text."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = _loaded(loader)
        for frame in frames:
            found = model.inference(frame["text"].fillna("").tolist(), labels, threshold)
            yield pd.DataFrame({**{key: frame[key] for key in keys}, "spans": [[{k: s[k] for k in ("start", "end", "label", "score")} for s in own if s["score"] > threshold] for own in found]})

    rows = texts.select(*keys, "text")
    named = ", ".join(f"`{key}` {rows.schema[key].dataType.simpleString()}" for key in keys)
    return rows.mapInPandas(run, f"{named}, spans {SPANS}")


def cached_predictions(texts: DataFrame, cache: DataFrame, loader: Callable[[], SpanModel], model: str, labels: list[str], threshold: float) -> tuple[DataFrame, DataFrame]:
    """Answers (key, text, spans) above the threshold, and the new ones (key, spans) at the floor, for the cache (key, spans)."""
    keyed = texts.select("text").distinct().withColumn("key", cache_key(model, labels, F.col("text")))
    asked = keyed.join(cache.select("key"), "key", "left_anti")
    new = predict(asked, loader, labels, cache_floor(threshold))
    every = cache.select("key", "spans").unionByName(new)
    answers = keyed.join(every, "key").withColumn("spans", F.filter("spans", lambda s: s["score"] > threshold))
    return answers, new


def hits_and_misses(texts: DataFrame, cache: DataFrame, model: str, labels: list[str]) -> DataFrame:
    """(hits, misses): how many distinct texts a cache knows."""
    keyed = texts.select("text").distinct().select(cache_key(model, labels, F.col("text")).alias("key"))
    return keyed.join(cache.select("key").distinct().withColumn("_hit", F.lit(True)), "key", "left").agg(F.count_if(F.col("_hit").isNotNull()).alias("hits"), F.count_if(F.col("_hit").isNull()).alias("misses"))


def detect_with_model(pages: DataFrame, loader: Callable[[], SpanModel], labels: dict[str, str], threshold: float) -> DataFrame:
    """Merged model findings of pages: windows of tokens, inference, whole words, merge."""
    cut = pages.select("doc_id", "page_index", "text", F.explode(token_windows(model_tokens("text"))).alias("w"))
    windows = cut.select("doc_id", "page_index", F.col("w.start").alias("offset"), piece(F.col("text"), F.col("w.start"), F.col("w.end")).alias("text"))
    said = predict(windows, loader, list(labels), threshold, ["doc_id", "page_index", "offset"])
    spans = said.select("doc_id", "page_index", "offset", F.posexplode("spans").alias("n", "s"))
    placed = spans.select("doc_id", "page_index", (F.col("s.start") + F.col("offset")).cast("int").alias("start"), (F.col("s.end") + F.col("offset")).cast("int").alias("end"), "s.label", "s.score")
    found = model_entities(pages, placed, labels).withColumn("ordinal", F.xxhash64("doc_id", "page_index", "start", "end", "type", "score"))
    return merge_entities(found.dropDuplicates(["doc_id", "page_index", "type", "start", "end"]).withColumn("surface_id", F.lit(None).cast("string")))


def read_scans(images: DataFrame, loader: Callable[[], OcrEngine]) -> DataFrame:
    """(doc_id, page_index, block, line, word_no, text, bbox): words that a reader finds on pictures (doc_id, page_index, image)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        engine = _loaded(loader)
        for frame in frames:
            rows = []
            for doc_id, page_index, image in frame[["doc_id", "page_index", "image"]].itertuples(index=False, name=None):
                for n, word in enumerate(engine.read(image)):
                    rows.append((doc_id, page_index, word["block"], word["line"], n, word["text"], dict(zip(("x0", "y0", "x1", "y1"), map(float, word["box"]), strict=True))))
            yield pd.DataFrame(rows, columns=["doc_id", "page_index", "block", "line", "word_no", "text", "bbox"])

    return images.mapInPandas(run, "doc_id long, page_index int, block int, line int, word_no int, text string, bbox struct<x0: double, y0: double, x1: double, y1: double>")


class DictionaryModel:
    """A stand-in model: capitalised pairs of words as persons, and a list of words with their labels."""

    def __init__(self, words: dict[str, tuple[str, float]]) -> None:
        self.words = words

    def inference(self, texts: list[str], labels: list[str], threshold: float) -> list[list[dict]]:
        import re

        out = []
        for text in texts:
            found = [{"start": m.start(), "end": m.end(), "label": self.words[m[0]][0], "score": self.words[m[0]][1]} for m in re.finditer(r"\w+", text) if m[0] in self.words]
            out.append([s for s in found if s["label"] in labels and s["score"] > threshold])
        return out
