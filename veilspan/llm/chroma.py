"""Chroma audio fingerprints and their alignment.

A recording (PCM, or a WAV file) is cut into overlapping frames; each frame's spectrum is folded into twelve pitch classes, smoothed and
normalised. Filters of six shapes are laid over the frames by an integral image: each compares the sums of two areas, and the logarithm
of their ratio falls into one of four ranges, written as two bits. Sixteen filters give an integer of 32 bits for each position.

Recordings with one fingerprint form a class. Queries meet the other classes wherever an integer of one differs from one of the other in at most
``NEAR_BITS`` bits: such integers agree in one half of 16 bits but for a bit, so the queries' integers stand in a table for each half. Every offset at which a
pair meets is verified over the whole overlap, and that with the least share of differing bits decides. Recordings without such a place don't meet.
Queries go to the workers in blocks of bounded size, so nothing is shuffled to search.
"""

from __future__ import annotations

import hashlib
import io
import uuid
import wave
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspan.llm.base import groups_by_size, join_one, map_batches, pick, resident, staged

RATE, FRAME, HOP = 5512, 1024, 256
LOWEST, HIGHEST = 60.0, 2600.0
SMOOTHING = np.array([0.25, 0.75, 1.0, 0.75, 0.25])
WIDTH = 16
FILTERS = 16
#: Bounds of a ratio's four ranges, by the filter's shape; each range is about as frequent in music of single notes.
CUTS = [(-1.1, -0.5, -0.2), (-0.55, 0.05, 0.7), (-0.24, 0.0, 0.24), (-0.54, 0.0, 0.54), (-1.3, -0.55, 0.05), (-0.45, -0.2, -0.05)]
MAX_ERRORS = 0.15  # share of differing bits in an overlap
NEAR_BITS = 2  # of a place's integers; the halves' tables hold up to three
LEAST_OVERLAP = 0.5  # of the shorter recording
QUERY_PLACES = 2_000_000  # integers of the queries of a block
AT_ONCE = 1 << 20  # comparisons


def samples(media: bytes | None, rate: int = RATE) -> np.ndarray:
    """Samples in [-1, 1] at ``RATE``: of a WAV file (any rate, 16 bits, channels averaged) or of raw 16-bit little-endian PCM at ``rate``."""
    if not media:
        return np.zeros(0)
    channels = 1
    if media[:4] == b"RIFF" and media[8:12] == b"WAVE":
        with wave.open(io.BytesIO(media)) as source:
            rate, channels = source.getframerate(), source.getnchannels()
            if source.getsampwidth() != 2:
                raise ValueError("only 16-bit samples are read")
            media = source.readframes(source.getnframes())
    raw = np.frombuffer(media[: len(media) // (2 * channels) * 2 * channels], "<i2").reshape(-1, channels).mean(axis=1) / 32768.0
    if rate == RATE or not len(raw):
        return raw
    at = np.arange(int(len(raw) * RATE / rate)) * (rate / RATE)
    return np.interp(at, np.arange(len(raw)), raw)


@lru_cache(maxsize=1)
def _folding() -> np.ndarray:
    """A row for each pitch class: which bins of the spectrum belong to it."""
    frequency = np.fft.rfftfreq(FRAME, 1 / RATE)
    inside = (frequency >= LOWEST) & (frequency <= HIGHEST)
    classes = np.round(12 * np.log2(np.maximum(frequency, 1.0) / 440.0)).astype(int) % 12
    return np.array([(classes == k) & inside for k in range(12)], float)


def pitch_classes(sound: np.ndarray) -> np.ndarray:
    """Frames by twelve pitch classes, each frame of length one (zero if silent)."""
    if len(sound) < FRAME:
        return np.zeros((0, 12))
    frames = np.lib.stride_tricks.sliding_window_view(sound, FRAME)[::HOP]
    power = np.abs(np.fft.rfft(frames * np.hanning(FRAME), axis=1)) ** 2
    chroma = power @ _folding().T
    pad = len(SMOOTHING) // 2
    padded = np.pad(chroma, ((pad, pad), (0, 0)), mode="edge")
    chroma = sum(weight * padded[i : i + len(chroma)] for i, weight in enumerate(SMOOTHING))
    norms = np.linalg.norm(chroma, axis=1, keepdims=True)
    return np.where(norms > 1e-9, chroma / np.maximum(norms, 1e-9), 0.0)


def filters() -> list[tuple[int, int, int, int]]:
    """(shape, first class, height, width) of each filter, by a rule: shapes in turn, classes and sizes spread over the image."""
    return [(i % 6, (5 * i + i // 3) % (12 - h + 1), h, w) for i in range(FILTERS) for h, w in [(4 + 2 * (i % 3), 4 + 4 * (i * 7 % 4))]]


def integers(chroma: np.ndarray) -> np.ndarray:
    """The packed integers: one for each position where ``WIDTH`` frames follow."""
    n = len(chroma) - WIDTH + 1
    if n <= 0:
        return np.zeros(0, np.uint32)
    image = np.zeros((len(chroma) + 1, 13))
    image[1:, 1:] = chroma.cumsum(0).cumsum(1)
    at = np.arange(n)

    def area(t0: int, t1: int, c0: int, c1: int) -> np.ndarray:
        return image[at + t1, c1] - image[at + t0, c1] - image[at + t1, c0] + image[at + t0, c0]

    packed = np.zeros(n, np.uint32)
    for shape, c, h, w in filters():
        whole, half_w, half_h = area(0, w, c, c + h), w // 2, h // 2
        if shape == 0:
            part, rest = whole, np.full(n, w * h / 4.0)
        elif shape == 1:
            part, rest = area(0, w, c, c + half_h), area(0, w, c + half_h, c + h)
        elif shape == 2:
            part, rest = area(0, half_w, c, c + h), area(half_w, w, c, c + h)
        elif shape == 3:
            part = area(0, half_w, c, c + half_h) + area(half_w, w, c + half_h, c + h)
            rest = whole - part
        elif shape == 4:
            part = area(0, w, c + h // 3, c + h - h // 3)
            rest = whole - part
        else:
            part = area(w // 3, w - w // 3, c, c + h)
            rest = whole - part
        ratio = np.log((1 + part) / (1 + rest))
        step = np.searchsorted(CUTS[shape], ratio, side="right").astype(np.uint32)
        packed = (packed << np.uint32(2)) | (step ^ (step >> np.uint32(1)))
    return packed


def fingerprint(media: bytes | None, rate: int = RATE) -> np.ndarray:
    return integers(pitch_classes(samples(media, rate)))


def fingerprints(recordings: DataFrame, id_col: str, media_col: str, rate: int = RATE) -> DataFrame:
    """(id, fingerprint array<long>) of each recording. Null, empty and too short media have no integers; rows are kept as they are."""
    chosen = pick(recordings, id=id_col, media=media_col)

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for start in range(0, batch.num_rows, 64):
            part = batch.slice(start, 64)
            found = [fingerprint(x, rate).astype(np.int64) for x in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, pa.list_(pa.int64()))], names=["id", "fingerprint"])

    return map_batches(chosen, run, f"id {dict(chosen.dtypes)['id']}, fingerprint array<long>")


def bit_errors(a: np.ndarray, b: np.ndarray, offset: int) -> tuple[int, int]:
    """(differing bits, positions) where ``a`` at i meets ``b`` at i + offset."""
    first, last = max(0, -offset), min(len(a), len(b) - offset)
    if last <= first:
        return 0, 0
    return int(np.bitwise_count(a[first:last] ^ b[first + offset : last + offset]).sum()), last - first


def _ragged(starts: np.ndarray, counts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, place) of each of ``counts`` places from ``starts`` on, for all rows, about ``AT_ONCE`` at once; a row may come in parts."""
    ends = np.cumsum(counts)
    total = int(ends[-1]) if len(ends) else 0
    for begin in range(0, total, AT_ONCE):
        at = np.arange(begin, min(begin + AT_ONCE, total))
        first, last = np.searchsorted(ends, at[[0, -1]], side="right")
        inside = np.diff(np.minimum(np.maximum(ends[first : last + 1], begin), at[-1] + 1), prepend=begin)
        rows = np.repeat(np.arange(first, last + 1), inside)
        yield rows, starts[rows] + at - (ends[rows] - counts[rows])


class QueryIndex:
    """The integers of some fingerprints, by each half of 16 bits."""

    FLIPS = np.append(0, 1 << np.arange(16))

    def __init__(self, prints: list[np.ndarray]) -> None:
        self.lengths = np.array([len(x) for x in prints], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.values = np.concatenate([*prints, np.zeros(0, np.uint32)]).astype(np.uint32)
        self.tables = []
        for shift in (16, 0):
            half = (self.values >> np.uint32(shift)) & np.uint32(0xFFFF)
            order = np.argsort(half, kind="stable")
            self.tables.append((shift, order, np.searchsorted(half[order], np.arange((1 << 16) + 1))))

    def meetings(self, values: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(place in ``values``, place among the queries' integers) of all that differ in at most ``NEAR_BITS`` bits; some come twice."""
        for shift, order, bounds in self.tables:
            halves = ((values >> np.uint32(shift)) & np.uint32(0xFFFF)).astype(np.int64)[:, None] ^ self.FLIPS
            first = bounds[halves].ravel()
            for rows, at in _ragged(first, bounds[halves + 1].ravel() - first):
                place, met = rows // len(self.FLIPS), order[at]
                near = np.bitwise_count(values[place] ^ self.values[met]) <= NEAR_BITS
                yield place[near], met[near]

    def search(self, prints: list[np.ndarray], max_errors: float, least_overlap: float) -> tuple[np.ndarray, ...]:
        """(query, print, offset, errors, overlap) of the best offset of each pair that aligns; offset: positions by which the print starts later."""
        lengths = np.array([len(x) for x in prints], np.int64)
        starts = np.cumsum(lengths) - lengths
        values = np.concatenate([*prints, np.zeros(0, np.uint32)]).astype(np.uint32)
        owner, query = np.repeat(np.arange(len(prints)), lengths), np.repeat(np.arange(len(self.lengths)), self.lengths)
        found = [np.zeros((0, 3), np.int64)]
        for place, met in self.meetings(values):
            b, a = owner[place], query[met]
            offset = (place - starts[b]) - (met - self.starts[a])
            overlap = np.minimum(self.lengths[a], lengths[b] - offset) - np.maximum(0, -offset)
            enough = overlap >= least_overlap * np.minimum(self.lengths[a], lengths[b])
            found.append(_distinct(np.stack((a, b, offset), axis=1)[enough]))
        a, b, offset = _distinct(np.concatenate(found)).T
        first = np.maximum(0, -offset)
        overlap = np.minimum(self.lengths[a], lengths[b] - offset) - first
        errors = np.zeros(len(a), np.int64)
        for rows, at in _ragged(first, overlap):
            differ = np.bitwise_count(self.values[self.starts[a[rows]] + at] ^ values[starts[b[rows]] + at + offset[rows]])
            errors[rows[0] : rows[-1] + 1] += np.bincount(rows - rows[0], weights=differ).astype(np.int64)
        good = np.flatnonzero(errors <= max_errors * 32 * overlap)
        a, b, offset, errors, overlap = (x[good] for x in (a, b, offset, errors, overlap))
        order = np.lexsort((offset, np.abs(offset), -overlap, errors / (32.0 * np.maximum(overlap, 1)), b, a))
        a, b, offset, errors, overlap = (x[order] for x in (a, b, offset, errors, overlap))
        best = np.flatnonzero((np.diff(a, prepend=-1) != 0) | (np.diff(b, prepend=-1) != 0))
        return tuple(x[best] for x in (a, b, offset, errors, overlap))


def _distinct(rows: np.ndarray) -> np.ndarray:
    if not len(rows):
        return rows
    least = rows.min(axis=0)
    _, b, c = (rows.max(axis=0) - least + 1).tolist()
    packed = np.unique(((rows[:, 0] - least[0]) * b + rows[:, 1] - least[1]) * c + rows[:, 2] - least[2])
    return np.stack((packed // (b * c), packed // c % b, packed % c), axis=1) + least


def align(prints: DataFrame, queries: DataFrame, max_errors: float = MAX_ERRORS, least_overlap: float = LEAST_OVERLAP, query_places: int = QUERY_PLACES) -> DataFrame:
    """(id, n_integers, digest, class_id, n_links, links array<struct<class_id, offset, errors, overlap>>): a row for each row of ``prints`` (id, fingerprint).

    ``class_id`` is the smallest id with the same fingerprint; steady ones, which repeat one integer as silence and held notes do, count as the same whatever their length. The classes of
    ``queries`` (id) are searched for among all classes. ``n_links`` says for each member of such a class how many other classes it aligns with; ``links`` holds them on the rows of
    the class's own id, and both are null elsewhere. ``offset``: positions by which the other one starts later. Empty fingerprints form one class
    without links. Copies are not expanded: a class meets a class. Classes are read once for each block of queries of ``query_places`` integers.

    A null fingerprint counts as empty, a null id stays null and names its class only where no other does (then nobody finds the class, as a query's id is no null); repeated rows each
    give a row, repeated and unknown queries do no harm, an empty table gives no rows. Further columns are ignored.
    """
    spark = prints.sparkSession
    prints = prints.select("id", F.coalesce("fingerprint", F.array().cast("array<bigint>")).alias("fingerprint"))
    digest = F.sha2(F.array_join("fingerprint", ",").cast("binary"), 256)
    steady = (F.size("fingerprint") > 0) & (F.array_min("fingerprint") == F.array_max("fingerprint"))
    same = F.when(steady, F.concat(F.lit("steady "), F.element_at("fingerprint", 1).cast("string"))).otherwise(F.col("digest"))
    named = staged(prints.select("id", "fingerprint", F.size("fingerprint").alias("n_integers"), digest.alias("digest")).withColumn("same", F.when(F.col("n_integers") > 0, same).otherwise(F.col("digest"))), "prints")
    classes = staged(named.groupBy("same").agg(F.min("id").alias("class_id"), F.max_by("fingerprint", F.struct("n_integers", "digest")).alias("fingerprint"), F.max("n_integers").alias("n")), "classes")
    asked = named.join(queries.select("id").distinct(), "id", "left_semi").select("same").distinct()
    chosen = staged(classes.join(asked, "same", "left_semi").select("same", "class_id", "fingerprint"), "asked")
    kind = dict(prints.dtypes)["id"]
    schema = f"class_id {kind}, link struct<class_id: {kind}, offset: long, errors: double, overlap: long>"
    # Even shares: the search is the work, and the classes' files are few.
    dealt = classes.where("n > 0").select("class_id", "fingerprint").repartition(max(4 * spark.sparkContext.defaultParallelism, 1))

    def search(block: list[tuple[object, np.ndarray]]) -> DataFrame:
        sent, key = spark.sparkContext.broadcast(block), uuid.uuid4().hex

        def verify(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            asked_ids, index = resident(key, lambda: ([x[0] for x in sent.value], QueryIndex([x[1] for x in sent.value])))
            ids, own = batch.column(0).to_pylist(), batch.column(1)
            for start, end in groups_by_size(own.value_lengths().to_pylist(), 4_000):
                given = [own[k].values.to_numpy(zero_copy_only=False).astype(np.uint32) for k in range(start, end)]
                found = index.search(given, max_errors, least_overlap)
                rows = [(asked_ids[a], ids[start + b], o, e / (32.0 * n), n) for a, b, o, e, n in zip(*(x.tolist() for x in found), strict=True) if asked_ids[a] != ids[start + b]]
                own_kind = batch.schema.field(0).type
                link = pa.struct([("class_id", own_kind), ("offset", pa.int64()), ("errors", pa.float64()), ("overlap", pa.int64())])
                links = [dict(zip(("class_id", "offset", "errors", "overlap"), row[1:], strict=True)) for row in rows]
                yield pa.RecordBatch.from_arrays([pa.array([row[0] for row in rows], own_kind), pa.array(links, link)], names=["class_id", "link"])

        found = staged(map_batches(dealt, verify, schema), "links")
        sent.destroy()
        return found

    verified, block, held = spark.createDataFrame([], schema), [], 0
    for row in chosen.toLocalIterator():
        own = np.array(row["fingerprint"] or [], np.uint32)
        if block and held + len(own) > query_places:
            verified, block, held = verified.unionByName(search(block)), [], 0
        if len(own):
            block.append((row["class_id"], own))
            held += len(own)
    if block:
        verified = verified.unionByName(search(block))
    links = chosen.select("class_id").join(verified, "class_id", "left").groupBy("class_id").agg(F.sort_array(F.collect_list("link")).alias("links"))
    told = chosen.select("same", "class_id").join(links, "class_id").select("same", F.size("links").alias("n_links"))
    rows = join_one(named.select("id", "n_integers", "digest", "same"), classes.select("same", "class_id"), "same")
    rows = join_one(rows, told.unionByName(classes.join(asked, "same", "left_anti").select("same", F.lit(None).cast("int").alias("n_links"))), "same")
    own = links.withColumnRenamed("class_id", "id")
    return rows.join(own.withColumn("owner", F.col("id")), "id", "left").select("id", "n_integers", "digest", "class_id", "n_links", F.when(F.col("class_id") == F.col("owner"), F.col("links")).alias("links"))


def render(values: list[float] | None, rate: int = RATE, note: int = 512) -> bytes:
    """A vector as a recording: each component is a note whose pitch follows its value; 16-bit PCM. Null or empty: no sound."""
    if not values:
        return b""
    own = np.nan_to_num(np.array(values, float), posinf=0.0, neginf=0.0)
    pitch = 440.0 * 2 ** (np.round(12 * own / max(float(np.abs(own).max()), 1e-9)) / 12.0)
    phase = np.cumsum(np.repeat(2 * np.pi * pitch / rate, note))
    return (np.sin(phase) * 0.6 * 32767).astype("<i2").tobytes()


def rendered(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, media): a recording for each vector, so that the tables hold a media column. Null and empty vectors give no sound; each row gives a row, whatever its id."""
    chosen = pick(vectors, id=id_col, vector=vector_col)

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for start in range(0, batch.num_rows, 64):
            part = batch.slice(start, 64)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([render(x) for x in part.column(1).to_pylist()], pa.binary())], names=["id", "media"])

    return map_batches(chosen, run, f"id {dict(chosen.dtypes)['id']}, media binary")


def digest_of(ints: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, ints.tolist())).encode()).hexdigest()
