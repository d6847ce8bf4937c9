"""Quality classification by co-training.

Two classifiers see a document from two sides: its text (figures of its characters, words and lines, and hashed words), or its metadata (source, language,
recorded length). Both start from labelled documents. In each round each of them scores all unlabelled documents, and the ``EACH_ROUND`` of each label that it is most
sure of are labelled for the other one to learn from. At the end each view is calibrated on labelled documents that neither has seen, the calibrated
log-odds are combined on others that neither has seen, and all documents are scored in one pass.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspan.llm.base import discard, groups_by_size, map_batches, pick, positional, resident, staged
from veilspan.llm.toxicity import logistic

#: Bound of the labelled documents of each label that are learned from.
MAX_LABELLED = 4_000
ROUNDS, EACH_ROUND, SURE = 4, 200, 0.95
CALIBRATE = 0.3
THRESHOLD = 0.5
CHUNK_CHARS = 2_000_000
PLACES = 64  # of a hashed category

HASHED = 128  # places of hashed words
REMEMBERED_WORDS = 300_000

_SIGNS = b".,;:!?|#*$%&<>@=\"'()/-_\\{}[]~^+`"


class _Places(dict):
    """Hashed words' places, remembered within a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > REMEMBERED_WORDS:
            self.clear()
        place = self[word] = zlib.crc32(word.lower().strip(_SIGNS)) % HASHED
        return place



def text_view(text: str | None) -> np.ndarray:
    """Figures of the whole text: shares of kinds of characters, of repeated lines and words, lengths; the roots of hashed words' shares."""
    raw = (text or "").encode()
    n = max(len(raw), 1)
    counts = np.zeros(256)
    for start in range(0, len(raw), 1 << 20):
        counts += np.bincount(np.frombuffer(raw, np.uint8, min(1 << 20, len(raw) - start), start), minlength=256)
    words, lines = raw.split(), [line for line in raw.split(b"\n") if line.strip()]
    distinct = set(words)
    n_words, n_lines = max(len(words), 1), max(len(lines), 1)
    groups = [counts[97:123].sum(), counts[65:91].sum(), counts[48:58].sum(), counts[[9, 10, 11, 12, 13, 32]].sum(), counts[128:].sum()]
    hashed = np.bincount(np.fromiter(map(resident("places", _Places).__getitem__, words), np.int64, len(words)), minlength=HASHED)
    signed = sum(1 for word in distinct if word[-1:] in b"#*$%&|<>!@~^")
    return np.array(
        [
            *(x / n for x in groups),
            *np.sqrt(counts[np.frombuffer(_SIGNS, np.uint8)] / n),
            np.log1p(len(words)),
            np.log((len(raw) + 1) / n_words),
            len(distinct) / n_words,
            np.log1p(len(distinct)),
            signed / max(len(distinct), 1),
            1 - len(set(lines)) / n_lines if lines else 0.0,
            np.log(n_words / n_lines),
            *np.sqrt(hashed / n_words),
        ]
    )


N_TEXT = 5 + len(_SIGNS) + 7 + HASHED
N_META = 2 * PLACES + 1


def meta_view(source: str | None, lang: str | None, n_chars: int | None) -> np.ndarray:
    """The metadata: hashed source and language, and the recorded length; a null is a category of its own."""
    out = np.zeros(N_META)
    for k, name in enumerate((source, lang)):
        out[k * PLACES + zlib.crc32(b"\0" if name is None else str(name).encode()) % PLACES] = 1.0
    out[-1] = np.log1p(max(n_chars or 0, 0)) / 10.0
    return out


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class View:
    """A linear classifier of one view, and its calibration (slope, constant)."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    calibration: tuple[float, float] = (1.0, 0.0)

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8) @ self.weights[:-1] + self.weights[-1]

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self.calibration[0] * self.raw(x) + self.calibration[1], -12, 12)


def fit_view(x: np.ndarray, y: np.ndarray, weights: np.ndarray) -> View:
    mean, scale = x.mean(0), x.std(0)
    scale = np.where(scale > 1e-6, scale, 1.0)
    return View(mean, scale, logistic(np.clip((x - mean) / scale, -8, 8), y, ridge=2.0, weights=weights))


@dataclass
class Model:
    """Both views and how their calibrated log-odds combine: (text, metadata, constant)."""

    text: View | None
    meta: View | None
    combine: np.ndarray
    prior: float

    def probability(self, text: np.ndarray, meta: np.ndarray) -> np.ndarray:
        """Of good quality, for rows of both views."""
        if self.text is None or self.meta is None:
            return np.full(len(text), self.prior)
        return sigmoid(self.combine[0] * self.text.log_odds(text) + self.combine[1] * self.meta.log_odds(meta) + self.combine[2])


def _balanced(y: np.ndarray) -> np.ndarray:
    ones = max(y.sum(), 1.0)
    return np.where(y > 0, len(y) / (2 * ones), len(y) / (2 * max(len(y) - ones, 1.0)))


#: Asks for the surest unlabelled documents: given both views, for (whose view is sure, the label) the rows (text, metadata) to learn from.
Ask = Callable[["tuple[View, View]"], Mapping["tuple[int, int]", "tuple[np.ndarray, np.ndarray]"]]


def co_train(text: np.ndarray, meta: np.ndarray, labels: np.ndarray, ask: Ask, rounds: int = ROUNDS) -> Model:
    """The model from rows of both views with a label of 1 or 0. A part of the rows of each label is left for calibration, another for the combination."""
    if len(set(labels.tolist())) < 2:
        return Model(None, None, np.zeros(3), float(labels.mean()) if len(labels) else 1.0)
    order = np.random.default_rng(5).permutation(len(labels))
    part = np.zeros(len(labels), int)
    for label in (0, 1):
        own = order[labels[order] == label]
        aside = int(CALIBRATE * len(own))
        part[own[:aside]] = 1 + np.arange(aside) % 2
    views, y = (text, meta), labels.astype(float)
    taught = [(x[part == 0], y[part == 0]) for x in views]
    fitted = tuple(fit_view(x, own, _balanced(own)) for x, own in taught)
    for _ in range(rounds):
        found = ask(fitted)
        for (sure, label), rows in found.items():
            other = 1 - sure
            x, own = taught[other]
            taught[other] = np.concatenate((x, rows[other])), np.concatenate((own, np.full(len(rows[other]), float(label))))
        fitted = tuple(fit_view(x, own, _balanced(own)) for x, own in taught)
    for view, x in zip(fitted, views, strict=True):
        if len(set(y[part == 1])) == 2:
            slope, constant = logistic(view.raw(x[part == 1])[:, None], y[part == 1], ridge=1e-2)
            view.calibration = (max(float(slope), 0.0), float(constant))
    combine = np.array([1.0, 1.0, 0.0])
    if len(set(y[part == 2])) == 2:
        both = np.stack([view.log_odds(x[part == 2]) for view, x in zip(fitted, views, strict=True)], axis=1)
        combine = logistic(both, y[part == 2], ridge=1.0)
    return Model(fitted[0], fitted[1], combine, float(labels.mean()))


def _views(part: pa.RecordBatch, first: int) -> tuple[np.ndarray, np.ndarray]:
    text, source, lang, n_chars = (part.column(first + i).to_pylist() for i in range(4))
    return np.array([text_view(x) for x in text]).reshape(-1, N_TEXT), np.array([meta_view(*x) for x in zip(source, lang, n_chars, strict=True)]).reshape(-1, N_META)


def _parts(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    sizes = [len(x.as_buffer()) if x.is_valid else 0 for x in batch.column(column).cast(pa.binary())]
    for start, end in groups_by_size(sizes, CHUNK_CHARS):
        yield batch.slice(start, end - start)


def _rows(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Both views of staged rows."""
    table = np.frombuffer(b"".join(raw), np.float32).astype(float).reshape(-1, N_TEXT + N_META)
    return table[:, :N_TEXT], table[:, N_TEXT:]


def _surest(frame: DataFrame, views: tuple[View, View], taken: list[str], labelled: DataFrame | None = None) -> dict[tuple[int, int], tuple[np.ndarray, np.ndarray]]:
    """The ``EACH_ROUND`` documents of each label that each view is most sure of, among all unlabelled ones that it hasn't told yet; ``taken`` notes them. Only ids and
    probabilities meet the labels; the views stay where they are until the few rows are chosen."""
    spark, paths = frame.sparkSession, []
    named = frame.select(*([] if labelled is None else ["doc_id"]), "place", "x")
    names = [*named.columns[:-1], "p0", "p1"]

    def judge(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        *own, x = batch.columns
        p = [sigmoid(view.raw(x)) for view, x in zip(views, _rows(x.to_pylist()), strict=True)] if batch.num_rows else [np.zeros(0)] * 2
        sure = np.logical_or.reduce([(x >= SURE) | (1 - x >= SURE) for x in p])
        yield pa.RecordBatch.from_arrays([*own, pa.array(p[0]), pa.array(p[1])], names=names).filter(pa.array(sure))

    judged = map_batches(named, judge, ", ".join(f"{name} {kind}" for name, kind in [*named.dtypes[:-1], ("p0", "double"), ("p1", "double")]))
    if labelled is not None:
        judged = judged.join(labelled, "doc_id", "left_anti")
    judged = staged(judged.select("place", "p0", "p1"), "judged", paths)
    best = None
    for view in (0, 1):
        for label in (1, 0):
            sure = F.col(f"p{view}") if label else 1 - F.col(f"p{view}")
            told = F.lit(f"{1 - view} ")
            own = judged.where(sure >= SURE).where(~F.concat(told, F.col("place")).isin(taken) if taken else F.lit(True))
            own = own.select(F.lit(view).alias("view"), F.lit(label).alias("label"), sure.alias("sure"), "place").orderBy(F.desc("sure"), "place").limit(EACH_ROUND)
            best = own if best is None else best.unionByName(own)
    rows = sorted(best.collect())  # at most 4 * EACH_ROUND
    discard(spark, paths)
    taken += [f"{1 - row.view} {row.place}" for row in rows]
    places = spark.createDataFrame([(place,) for place in sorted({row.place for row in rows})], "place string")
    at = {row.place: bytes(row.x) for row in frame.select("place", "x").join(F.broadcast(places), "place").groupBy("place").agg(F.first("x").alias("x")).collect()} if rows else {}  # a place has one view
    return {(view, label): _rows([at[row.place] for row in rows if (row.view, row.label) == (view, label)]) for view in (0, 1) for label in (0, 1)}


def train(docs: DataFrame, labels: DataFrame, label_id: str = "doc_id", label_col: str = "quality") -> Model:
    """The model for ``docs`` (columns of documents): from at most ``MAX_LABELLED`` labelled documents of each label, by a hash of the id, and in each round the surest of all
    others. Of several labels of one id the lowest counts; null labels don't. Of several rows with one id that is learned from, one counts: that with the smallest text."""
    spark, paths = docs.sparkSession, []
    named = pick(labels, doc_id=label_id, quality=label_col).where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.when(F.min("quality") > 0, 1).otherwise(0).alias("quality"))
    order = F.md5(F.concat(F.lit("quality "), F.col("doc_id").cast("string")).cast("binary"))
    sample = None
    for label in (0, 1):
        own = named.where(F.col("quality") == label).orderBy(order).limit(MAX_LABELLED)
        sample = own if sample is None else sample.unionByName(own)
    chosen = pick(docs, doc_id="doc_id", text="text", source="source", lang="lang", n_chars="n_chars")
    kind = dict(chosen.dtypes)["doc_id"]
    told = chosen.select("text", F.col("source").cast("string"), F.col("lang").cast("string"), F.col("n_chars").cast("long"), "doc_id")

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for part in _parts(batch, 0):
            rows = np.hstack(_views(part, 0)).astype(np.float32)
            yield pa.RecordBatch.from_arrays([part.column(4), pa.array([x.tobytes() for x in rows], pa.binary())], names=["doc_id", "x"])

    frame = staged(map_batches(told, run, f"doc_id {kind}, x binary").withColumn("place", F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"), "x"))), "views", paths)
    known = frame.join(F.broadcast(sample), "doc_id").groupBy("doc_id", "quality").agg(F.min_by("x", "place").alias("x"))  # at most 2 * MAX_LABELLED rows
    rows = sorted(known.select(order.alias("place"), "quality", "x").collect())
    labelled = named.select("doc_id")
    taken: list[str] = []
    model = co_train(*_rows([bytes(row.x) for row in rows]), np.array([row.quality for row in rows], int), lambda views: _surest(frame, views, taken, labelled))
    discard(spark, paths)
    return model


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, label_id: str = "doc_id", label_col: str = "quality", carry: bool = False) -> DataFrame:
    """(doc_id, quality_score, kept) of every row of ``docs``, or with ``carry`` the rows of ``docs`` that are kept, with their own columns.

    Null and empty texts have the figures of no characters; a null in the metadata is a category of its own. Without labels of both kinds the
    score is the labels' mean (1 without any). Repeated rows each give a row; an empty table gives no rows; further columns are ignored or
    carried along, whatever their names.
    """
    model = train(docs, labels, label_id, label_col)
    plain, at = positional(docs)
    for name in ("doc_id", "text", "source", "lang", "n_chars"):
        if name not in at:
            raise ValueError(f"no column {name!r}; there are {docs.columns}")
    told = [F.col(at["text"]).alias("t"), F.col(at["source"]).cast("string").alias("s"), F.col(at["lang"]).cast("string").alias("l"), F.col(at["n_chars"]).cast("long").alias("n")]
    chosen = plain.select("*", *told) if carry else plain.select(F.col(at["doc_id"]).alias("doc_id"), *told)
    first = len(chosen.columns) - 4

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _parts(batch, first):
                p = model.probability(*_views(part, first))
                kept = pa.array(p >= threshold)
                if carry:
                    yield part.select(range(first)).filter(kept)
                else:
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array(p), kept], names=["doc_id", "quality_score", "kept"])

    if carry:
        return chosen.mapInArrow(run, plain.schema).toDF(*docs.columns)
    return chosen.mapInArrow(run, f"doc_id {dict(chosen.dtypes)['doc_id']}, quality_score double, kept boolean")
