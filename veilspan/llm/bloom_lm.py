"""Language-model scoring from a log-frequency Bloom filter.

Counts of words and word pairs are gathered over all training documents, quantised to levels that grow geometrically, and held in a Bloom
filter: an entry of level L is stored as the keys (entry, 1) to (entry, L), and a reader probes level after level until one is
missing. The filter also holds, for each first word, the discounted mass of its pairs. It is broadcast to the workers. A
text's probability interpolates pairs with words:

    p(w)     = (c(w) + 1/2) / (N + (V + 1) / 2)                an unknown word is one further type
    p(w | v) = max(c(v w) - D, 0) / (c(v) + MU) + g(v) p(w)    g(v): what the discounted pairs of v leave over

Every pair counts, also one that is seen once. The filter is cut into segments by a hash of the entry; one task builds a segment
from the sorted counts of all partitions, so nothing is gathered whole but the filter itself, whose size follows the counted entries.
Up to ``MOST_BITS`` it is broadcast. A larger one stays in its segments, and the distinct words and pairs of chunks of texts go to them, packed,
to be probed there: the same bits answer, so the scores are the same.

Texts are split, and their distinct words told apart, a group of texts at a time by Arrow; a group's distinct pairs are probed once.

Exact counts (for the base score) come by a join: the ``HEAVY`` most frequent words are looked up in a broadcast table, each
document's other words are joined with the table of all words, where no key is hot any more.
"""

from __future__ import annotations

import hashlib
import io
import itertools
import os
import pickle
import uuid
import zlib
from collections.abc import Iterable, Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspan.llm.base import groups_by_size, map_batches, pick, release, resident, shuffles_freed, staged

FOLDS, HELD_OUT = 5, 1  # documents whose hash has remainder HELD_OUT aren't learned from
GROWTH = 1.25  # of the counts that bound the levels
DISCOUNT, MU = 0.75, 2.0
PROBES, BITS_PER_KEY = 6, 16
MOST_BITS = 1 << 32
CHUNK_BYTES = 1 << 25
HEAVY = 1 << 17
LONG_WORD = 64  # bytes; a longer word goes by its digest
SEGMENT_ENTRIES = 1 << 20  # pairs of a segment, with repeats; of words fewer, as one has more levels
SEGMENT_WORDS = 1 << 18
FLUSH_PAIRS = 1_500_000
REMEMBERED_WORDS = 300_000
SALTS = 64
GROUP_BYTES = 1 << 21  # of texts that are split and scored at once
PROBED_KEYS = 1 << 16  # at once, so that what is computed on the way stays in a core's cache
ASKED_TOKENS = 1 << 20  # of a chunk of texts whose keys go to the segments together
BLOCKS = 8  # of chunks, one after the other

END = b""  # no word is empty
WORD, PAIR, REST = 1, 2, 3
_START = np.uint64(0x9AE16A3B2F90404F)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _bounds(most: int = 1 << 62) -> np.ndarray:
    bounds = [1]
    while bounds[-1] < most:
        bounds.append(max(bounds[-1] + 1, int(bounds[-1] * GROWTH)))
    return np.array(bounds, np.int64)


BOUNDS = _bounds()
#: What a level stands for: the mean of the counts in it; level 0 is no entry.
VALUES = np.concatenate(([0.0], (BOUNDS[:-1] + BOUNDS[1:] - 1) / 2.0))


def level(counts: np.ndarray) -> np.ndarray:
    """Levels of counts, from 1; 0 for none."""
    return np.searchsorted(BOUNDS, counts, side="right")


def value(levels: np.ndarray) -> np.ndarray:
    return VALUES[np.minimum(levels, len(VALUES) - 1)]


def mixed(x: np.ndarray) -> np.ndarray:
    x = x * _MIX
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def short(word: bytes) -> bytes:
    """A word as a key: itself, or a zero byte and its digest."""
    return word if len(word) <= LONG_WORD else b"\0" + hashlib.sha256(word).digest()


def word_hash(word: bytes) -> int:
    return xxhash.xxh64_intdigest(short(word), 7)


def rest_keys(first: np.ndarray) -> np.ndarray:
    """The keys of first words' masses: the upper half of their pairs' keys."""
    return mixed(first) & np.uint64(0xFFFFFFFF00000000)


def pair_keys(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """A pair's key: the upper half tells the first word, the lower half the second."""
    return (mixed(first) & np.uint64(0xFFFFFFFF00000000)) | (mixed(second + np.uint64(1)) >> np.uint64(32))


def segments(keys: np.ndarray, count: int) -> np.ndarray:
    """The segment of an entry. A first word's pairs are spread over ``SALTS`` places, so a frequent word fills no segment."""
    spread = (keys >> np.uint64(32)) * np.uint64(SALTS) + (keys & np.uint64(SALTS - 1))
    return (mixed(spread) >> np.uint64(33)) % np.uint64(count)


class Filter:
    """Segments of 64-bit words, end to end, by kind of entry. A level of an entry is ``PROBES`` bits of one word, so a probe reads memory once."""

    def __init__(self, words: np.ndarray, starts: dict[int, np.ndarray], texts: float) -> None:
        self.words, self.starts, self.texts = words, starts, texts

    def levels(self, kind: int, keys: np.ndarray) -> np.ndarray:
        """The level of each key, by probing levels 1, 2, ... until one is missing."""
        starts = self.starts[kind]
        own = segments(keys, len(starts) - 1).astype(np.int64)
        return probed(self.words, kind, keys, starts[own], (starts[own + 1] - starts[own]).astype(np.uint64))


def probed(words: np.ndarray, kind: int, keys: np.ndarray, base: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The level of each key in its segment, which begins at ``base`` and has ``size`` words."""
    if len(keys) > PROBED_KEYS:
        cuts = [slice(i, i + PROBED_KEYS) for i in range(0, len(keys), PROBED_KEYS)]
        return np.concatenate([probed(words, kind, keys[x], base[x], size[x]) for x in cuts])
    out = np.zeros(len(keys), np.int64)
    at = np.flatnonzero(size > 0)
    keys, base, size, j = keys[at], base[at], size[at], 1
    while len(at):
        place, mask = probe(level_hash(kind, keys, j), size)
        hit = np.flatnonzero((words[base + place] & mask) == mask)
        at, keys, base, size = at[hit], keys[hit], base[hit], size[hit]
        out[at] = j
        j += 1
    return out


def level_hash(kind: int, keys: np.ndarray, j: int | np.ndarray) -> np.ndarray:
    return mixed(keys ^ (np.asarray(j, np.uint64) * np.uint64(0xA24BAED4963EE407) + np.uint64(kind)))


#: The two bits that twelve bits of a hash name.
_TWO_BITS = (np.uint64(1) << (np.arange(1 << 12, dtype=np.uint64) & np.uint64(63))) | (np.uint64(1) << (np.arange(1 << 12, dtype=np.uint64) >> np.uint64(6)))


def probe(hashes: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The word of a segment of ``size`` words, and its bits."""
    place = ((hashes >> np.uint64(36)) * size) >> np.uint64(28)
    mask = np.zeros(len(hashes), np.uint64)
    for i in range(0, PROBES, 2):
        mask |= _TWO_BITS[((hashes >> np.uint64(6 * i)) & np.uint64(4095)).view(np.int64)]
    return place.astype(np.int64), mask


def segment_words(kind: int, keys: np.ndarray, levels: np.ndarray) -> bytes:
    """The words of a segment: ``BITS_PER_KEY`` bits for each level of each entry."""
    total = int(levels.sum())
    if not total:
        return b""
    words = np.zeros(-(-total * BITS_PER_KEY // 64), np.uint64)
    ends = np.cumsum(levels)
    j = np.arange(total) - np.repeat(ends - levels, levels) + 1
    place, mask = probe(level_hash(kind, np.repeat(keys, levels), j.astype(np.uint64)), np.full(total, len(words), np.uint64))
    np.bitwise_or.at(words, place, mask)
    return words.astype("<u8").tobytes()


class Tokens(NamedTuple):
    """Tokens of texts, end to end: the distinct words, the place there of each token's word, and where each text starts. A text's last token is its end."""

    words: pa.BinaryArray
    at: np.ndarray
    starts: np.ndarray


def tokenised(texts: pa.Array) -> Tokens:
    """Lower-case words between white space and the end of each text (null: empty), split and told apart by Arrow: Python sees the distinct words alone."""
    plain = pc.ascii_trim_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    # What follows the last space is the end; an empty text is split into one empty word, its end.
    found = pc.ascii_split_whitespace(pc.if_else(pc.equal(plain, ""), plain, pc.binary_join_element_wise(plain, *(pa.scalar(x, plain.type) for x in (" ", "")))))
    words = found.flatten().dictionary_encode()
    offsets = found.offsets.to_numpy()
    return Tokens(words.dictionary.cast(pa.binary()), words.indices.to_numpy(), (offsets - offsets[0])[:-1].astype(np.int64))


def objects(words: pa.BinaryArray) -> np.ndarray:
    return words.to_numpy(zero_copy_only=False)


def shortened(words: pa.BinaryArray) -> pa.BinaryArray:
    """``short`` of each word."""
    return pa.array(map(short, objects(words)), pa.binary()) if (pc.max(pc.binary_length(words)).as_py() or 0) > LONG_WORD else words


def hashed(words: pa.BinaryArray) -> np.ndarray:
    """``word_hash`` of each word."""
    return np.fromiter(map(xxhash.xxh64_intdigest, objects(shortened(words)), itertools.repeat(7)), np.uint64, len(words))


def hashed_pairs(found: Tokens) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of the distinct words, and the key of each token with the one before it."""
    words = hashed(found.words)
    own = words[found.at]
    first = np.concatenate((own[:1], own[:-1]))
    first[found.starts] = _START
    return words, pair_keys(first, own)


def grouped_texts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Parts of a batch, whose second column is the text, with about ``GROUP_BYTES`` of text each."""
    for first, end in groups_by_size(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_pylist(), GROUP_BYTES):
        yield batch.slice(first, end - first)


def learned_from(ids: pa.Array) -> np.ndarray:
    return np.array([not is_held_out(x) for x in ids.to_pylist()], bool)


def is_held_out(doc_id: object) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % FOLDS == HELD_OUT


def word_counts(chosen: DataFrame) -> DataFrame:
    """(word, n_all, n_train) over all documents; the end is the empty word. Summed within each task before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        held: list[pa.Table] = []
        size = 0

        def merged() -> pa.Table:
            return pa.concat_tables(held).group_by("word", use_threads=False).aggregate([("n_all", "sum"), ("n_train", "sum")]).select([0, 1, 2]).rename_columns(["word", "n_all", "n_train"])

        for part in itertools.chain.from_iterable(map(grouped_texts, batches)):
            found = tokenised(part.column(1))
            train = np.repeat(learned_from(part.column(0)), np.diff(found.starts, append=len(found.at)))
            counts = [np.bincount(x, minlength=len(found.words)) for x in (found.at, found.at[train])]
            held.append(pa.Table.from_arrays([shortened(found.words), *map(pa.array, counts)], names=["word", "n_all", "n_train"]))
            size += len(found.words)
            if size > 2 * REMEMBERED_WORDS:
                held = [merged()]
                size = len(held[0])
                if size > REMEMBERED_WORDS:
                    yield from held[0].to_batches()
                    held, size = [], 0
        if held:
            yield from merged().to_batches()

    rows = chosen.mapInArrow(run, "word binary, n_all long, n_train long")
    return rows.groupBy("word").agg(F.sum("n_all").alias("n_all"), F.sum("n_train").alias("n_train"))


def pair_blobs(chosen: DataFrame, count: int) -> DataFrame:
    """(segment, keys, counts): sorted pair counts of the training documents, in parts of a task, packed by segment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        held: list[np.ndarray] = []
        size = 0

        def out() -> Iterator[pa.RecordBatch]:
            nonlocal size
            keys, counts = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            size = 0
            own = segments(keys, count)
            order = np.argsort(own, kind="stable")
            keys, counts, own = keys[order], np.minimum(counts[order], 0xFFFFFFFF).astype(np.uint32), own[order]
            names, starts = np.unique(own, return_index=True)
            ends = np.append(starts[1:], len(own))
            for i in range(0, len(names), 256):
                cuts = list(zip(starts[i : i + 256].tolist(), ends[i : i + 256].tolist(), strict=True))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(names[i : i + 256].astype(np.int64)), pa.array([keys[a:b].tobytes() for a, b in cuts], pa.binary()), pa.array([packed_counts(counts[a:b]) for a, b in cuts], pa.binary())],
                    names=["segment", "keys", "counts"],
                )

        for part in itertools.chain.from_iterable(map(grouped_texts, batches)):
            texts = part.column(1).filter(pa.array(learned_from(part.column(0))))
            if not len(texts):
                continue
            held.append(hashed_pairs(tokenised(texts))[1])
            size += len(held[-1])
            if size > FLUSH_PAIRS:
                yield from out()
        if held:
            yield from out()

    return chosen.mapInArrow(run, "segment long, keys binary, counts binary")


def packed_counts(counts: np.ndarray) -> bytes:
    """Counts as bytes; where one needs more, a zero byte stands in and the whole count follows after all of them."""
    small = np.where(counts < 256, counts, 0).astype(np.uint8)
    return small.tobytes() + counts[counts > 255].astype("<u4").tobytes()


def unpacked_counts(raw: bytes, n: int) -> np.ndarray:
    counts = np.frombuffer(raw[:n], np.uint8).astype(np.int64)
    counts[counts == 0] = np.frombuffer(raw[n:], "<u4")
    return counts


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[dict]]]:
    """Rows of sorted batches by their first column."""
    name, held = None, []
    for batch in batches:
        for row in batch.to_pylist():
            key = row[batch.schema.names[0]]
            if held and key != name:
                yield name, held
                held = []
            name = key
            held.append(row)
    if held:
        yield name, held


def summed(rows: list[dict]) -> tuple[np.ndarray, np.ndarray]:
    keys = np.concatenate([np.frombuffer(row["keys"], np.uint64) for row in rows])
    counts = np.concatenate([unpacked_counts(row["counts"], len(row["keys"]) // 8) for row in rows])
    unique, where = np.unique(keys, return_inverse=True)
    return unique, np.bincount(where, counts, len(unique)).astype(np.int64)


def pair_segments(blobs: DataFrame) -> DataFrame:
    """(segment, bits, first, mass): each segment's filter, and its first words (half keys) with the discounted mass of their pairs there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, rows in _grouped(batches):
            keys, counts = summed(rows)
            levels = level(counts)
            first, where = np.unique(keys >> np.uint64(32), return_inverse=True)
            mass = np.bincount(where, np.maximum(value(levels) - DISCOUNT, 0.0), len(first))
            yield pa.RecordBatch.from_pydict(
                {"segment": pa.array([name], pa.int64()), "bits": pa.array([segment_words(PAIR, keys, levels)], pa.binary()), "first": pa.array([first.astype(np.int64)], pa.list_(pa.int64())), "mass": pa.array([mass], pa.list_(pa.float64()))}
            )

    dealt = blobs.repartition("segment").sortWithinPartitions("segment")
    return dealt.mapInArrow(run, "segment long, bits binary, first array<long>, mass array<double>")


def entry_segments(entries: DataFrame, kind: int, count: int) -> DataFrame:
    """(segment, bits) for entries of other kinds than pairs: (key or word, n)."""

    def name(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        if pa.types.is_binary(batch.schema.field(0).type):
            keys = hashed(batch.column(0))
        else:
            keys = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
        yield pa.RecordBatch.from_arrays([pa.array(segments(keys, count).astype(np.int64)), pa.array(keys.view(np.int64)), batch.column(1)], names=["segment", "key", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_name, keys, counts = None, [], []

        def out() -> pa.RecordBatch:
            own = np.concatenate(keys).view(np.uint64)
            return pa.RecordBatch.from_pydict({"segment": pa.array([held_name], pa.int64()), "bits": pa.array([segment_words(kind, own, level(np.concatenate(counts)))], pa.binary())})

        for batch in batches:
            names = batch.column(0).to_numpy(zero_copy_only=False)
            for part in np.unique(names):
                chosen = names == part
                if keys and part != held_name:
                    yield out()
                    keys, counts = [], []
                held_name = part
                keys.append(batch.column(1).to_numpy(zero_copy_only=False)[chosen])
                counts.append(batch.column(2).to_numpy(zero_copy_only=False)[chosen])
        if keys:
            yield out()

    named = map_batches(entries, name, "segment long, key long, n long")
    return named.repartition("segment").sortWithinPartitions("segment").mapInArrow(run, "segment long, bits binary")


def _starts(parts: dict[int, tuple[int, DataFrame]]) -> tuple[dict[int, np.ndarray], int]:
    """Where each segment of each kind begins, laid end to end, and the words of all."""
    starts, at = {}, 0
    for kind, (count, rows) in parts.items():
        sizes = np.zeros(count, np.int64)
        for row in rows.select("segment", F.octet_length("bits").alias("n")).collect():
            sizes[row.segment] = row.n // 8
        starts[kind] = at + np.concatenate(([0], np.cumsum(sizes)))
        at += int(sizes.sum())
    return starts, at


def _segments(parts: dict[int, tuple[int, DataFrame]]) -> Iterator[tuple[int, int, bytes]]:
    """(kind, segment, bits) of all segments, one after the other: the driver never holds the whole filter."""
    for kind, (_, rows) in parts.items():
        for row in rows.select("segment", "bits").toLocalIterator():
            yield kind, row.segment, row.bits


def _laid(starts: dict[int, np.ndarray], total: int, found: Iterable[tuple[int, int, bytes]]) -> np.ndarray:
    laid = np.zeros(max(total, 1), np.uint64)
    for kind, segment, bits in found:
        own = np.frombuffer(bits, "<u8")
        first = int(starts[kind][segment])
        laid[first : first + len(own)] = own
    return laid


class Model:
    """What the workers get: the filter, the totals and the most frequent words' exact counts (at most ``HEAVY``)."""

    def __init__(self, table: Filter | SharedFilter | Answers, n: int, v: int, heavy: dict[bytes, int]) -> None:
        self.table, self.n, self.v, self.heavy = table, n, v, heavy

    @property
    def total(self) -> float:
        return self.n + 0.5 * (self.v + 1)


class Scorer(dict):
    """Scores texts in a worker. Words have numbers, and by number what the model says of each: hash, count, discounted mass, exact count (or -1). A new word gets
    the next number at once; what the model says of it is looked up before it is used."""

    def __init__(self, model: Model, most: int = REMEMBERED_WORDS) -> None:
        super().__init__()
        self.model, self.most = model, most
        self.names: list[bytes] = []
        self.looked_up = 0
        self.hashes = np.zeros(1 << 14, np.uint64)
        self.figures = np.zeros((1 << 14, 3))
        self.start_mass = float(value(model.table.levels(REST, rest_keys(_START[None])))[0])

    def numbered(self, words: pa.BinaryArray) -> np.ndarray:
        """Words by their numbers."""
        every, first = objects(words), len(self.names)
        numbers = np.fromiter(map(self.get, every, itertools.repeat(-1)), np.int64, len(every))
        fresh = np.flatnonzero(numbers < 0)
        numbers[fresh] = np.arange(first, first + len(fresh))
        self.names += every[fresh].tolist()
        self.update(zip(self.names[first:], range(first, len(self.names)), strict=True))
        return numbers

    def numbers(self, text: str | None) -> np.ndarray:
        """The words of a text and its end, by their numbers."""
        found = tokenised(pa.array([text], pa.string()))
        return self.numbered(found.words)[found.at]

    def shorten(self) -> None:
        """Forgets half of the words where there are too many: those that came last, as words that come often come early."""
        if len(self.names) > self.most:
            del self.names[self.most // 2 :]
            self.looked_up = min(self.looked_up, len(self.names))
            self.clear()
            self.update(zip(self.names, range(len(self.names)), strict=True))

    def look_up(self) -> None:
        first, n = self.looked_up, len(self.names)
        if first == n:
            return
        if n > len(self.hashes):
            for name in ("hashes", "figures"):
                old = getattr(self, name)
                new = np.zeros((max(n, 2 * len(old)), *old.shape[1:]), old.dtype)
                new[: len(old)] = old
                setattr(self, name, new)
        fresh, table, heavy = self.names[first:n], self.model.table, self.model.heavy
        fresh = list(map(short, fresh))
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, fresh, itertools.repeat(7)), np.uint64, n - first)
        self.hashes[first:n] = hashes
        self.figures[first:n, 0] = value(table.levels(WORD, hashes))
        self.figures[first:n, 1] = value(table.levels(REST, rest_keys(hashes)))
        self.figures[first:n, 2] = np.fromiter(map(heavy.get, fresh, itertools.repeat(-1)), np.float64, n - first)
        self.looked_up = n

    def logs(self, texts: list[np.ndarray]) -> np.ndarray:
        """log10 probability of each text, given by its numbers; all are probed together."""
        sizes = np.array([len(x) for x in texts])
        return self.log_sums(np.concatenate(texts), np.cumsum(sizes) - sizes)

    def log_sums(self, own: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """log10 probability of each of the texts that lie end to end in ``own``, by numbers."""
        self.look_up()
        table = self.model.table
        before = np.concatenate((own[:1], own[:-1]))
        hashes, first = self.hashes[own], self.hashes[before]
        count, mass = self.figures[before, 0], self.figures[before, 1]
        first[starts], count[starts], mass[starts] = _START, table.texts, self.start_mass
        keys, where = np.unique(pair_keys(first, hashes), return_inverse=True)
        pairs = value(table.levels(PAIR, keys))[where]
        word = (self.figures[own, 0] + 0.5) / self.model.total
        below = np.maximum(count, mass) + MU
        p = np.maximum(pairs - DISCOUNT, 0.0) / below + (1.0 - mass / below) * word
        return np.add.reduceat(np.log10(p), starts)

    def exact(self, own: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Known tokens and base score of each text's words whose exact counts are at hand; which tokens are the others."""
        counts = self.figures[own, 2]
        here = counts >= 0
        base = np.add.reduceat(np.where(here, np.log10((np.where(here, counts, 0.0) + 0.5) / self.model.total), 0.0), starts)
        return np.add.reduceat((counts > 0).astype(np.int64), starts), base, ~here


class Trained(NamedTuple):
    """The table (word, n_all, n_train) of all words; all tokens; tokens and distinct words learned from; texts learned from; the most frequent words' exact counts (at most
    ``HEAVY``); by kind of entry the number of segments and the table (segment, bits)."""

    vocabulary: DataFrame
    tokens: int
    n: int
    v: int
    texts: float
    heavy: dict[bytes, int]
    parts: dict[int, tuple[int, DataFrame]]

    def bits(self) -> int:
        return sum(8 * (rows.agg(F.sum(F.octet_length("bits"))).first()[0] or 0) for _, rows in self.parts.values())


def train(chosen: DataFrame) -> Trained:
    """What is learned from ``chosen`` (doc_id, text). Each step is staged, and its shuffle is given up then."""
    with shuffles_freed(chosen.sparkSession):
        return _trained(chosen)


def _trained(chosen: DataFrame) -> Trained:
    vocabulary = staged(word_counts(chosen), "vocabulary")
    step = F.floor(F.log2("n_all") * 8)
    by_count = {row[0]: tuple(row[1:]) for row in vocabulary.groupBy(step).agg(F.count("*"), F.sum("n_train"), F.count(F.when(F.col("n_train") > 0, 1)), F.sum("n_all")).collect()}  # at most 512 rows
    n, v = sum(x[1] for x in by_count.values()), sum(x[2] for x in by_count.values())
    taken, least = 0, None
    for bucket in sorted(by_count, reverse=True):
        taken += by_count[bucket][0]
        if taken > HEAVY:
            break
        least = bucket
    found = vocabulary.where(step >= least).select("word", "n_train").toArrow() if least is not None else None  # at most HEAVY
    heavy = dict(zip(*(x.to_numpy().tolist() for x in found.columns), strict=True)) if found else {}
    ends = vocabulary.where(F.length("word") == 0).first()
    n_texts = ends.n_train if ends else 0

    n_segments = max(8, -(-n // SEGMENT_ENTRIES))
    pairs = staged(pair_segments(pair_blobs(chosen, n_segments)), "pairs")
    masses = pairs.select(F.explode(F.arrays_zip("first", "mass")).alias("x")).groupBy(F.shiftleft(F.col("x.first"), 32).alias("key")).agg(F.round(F.sum("x.mass")).cast("long").alias("n")).where("n > 0")
    n_words = max(1, -(-v // SEGMENT_WORDS))
    words = staged(entry_segments(vocabulary.where("n_train > 0").select("word", "n_train"), WORD, n_words), "words")
    rests = staged(entry_segments(masses, REST, n_words), "rests")
    return Trained(vocabulary, sum(x[3] for x in by_count.values()), n, v, float(n_texts), heavy, {WORD: (n_words, words), PAIR: (n_segments, pairs.select("segment", "bits")), REST: (n_words, rests)})


def broadcastable(trained: Trained) -> Model:
    """The model on the driver, whole."""
    starts, total = _starts(trained.parts)
    return Model(Filter(_laid(starts, total, _segments(trained.parts)), starts, trained.texts), trained.n, trained.v, trained.heavy)


#: What stands before the bytes in a broadcast's file, and what fills it up to a whole word.
PICKLED = len(pickle.dumps(bytes(1 << 17), pickle.HIGHEST_PROTOCOL)) - (1 << 17) - 2
FILL = -PICKLED % 8


def mapped(chunk: Broadcast) -> np.ndarray:
    """The words of a broadcast chunk, in a worker. All workers of an executor map one file, so they don't hold copies; where there is no such file they load it."""
    path, first = getattr(chunk, "_path", None), PICKLED + FILL
    if path and (size := os.path.getsize(path)) >= 1 << 17 and (size - 2 - first) % 8 == 0:
        with open(path, "rb") as file:
            head = file.read(first)
        if head.endswith((size - 2 - PICKLED).to_bytes(4, "little") + bytes(FILL)):
            return np.memmap(path, "<u8", "r", first, ((size - 2 - first) // 8,))
    raw = chunk.value
    chunk.__dict__.pop("_value", None)
    return np.frombuffer(raw, "<u8", offset=FILL)


class SharedFilter:
    """A filter in chunks, each of whole segments."""

    def __init__(self, chunks: list[np.ndarray], places: dict[int, np.ndarray], texts: float) -> None:
        self.chunks, self.places, self.texts = chunks, places, texts

    def levels(self, kind: int, keys: np.ndarray) -> np.ndarray:
        places = self.places[kind]
        chunk, base, size = places[segments(keys, len(places)).astype(np.int64)].T
        out = np.zeros(len(keys), np.int64)
        for i in np.unique(chunk):
            at = np.flatnonzero(chunk == i)
            out[at] = probed(self.chunks[i], kind, keys[at], base[at], size[at].astype(np.uint64))
        return out


class Shared:
    """A model as the workers get it: the filter in broadcasts of ``CHUNK_BYTES``, which they map into memory."""

    def __init__(self, trained: Trained) -> None:
        context = trained.vocabulary.sparkSession.sparkContext
        self.name = uuid.uuid4().hex
        self.places = {kind: np.zeros((count, 3), np.int64) for kind, (count, _) in trained.parts.items()}  # of a segment: chunk, first word, words
        self.chunks = []
        held = io.BytesIO(bytes(FILL))  # a chunk grows in place, and its bytes aren't copied to be sent
        held.seek(FILL)
        for kind, segment, bits in _segments(trained.parts):
            if held.tell() - FILL > CHUNK_BYTES:
                self.chunks.append(context.broadcast(held.getvalue()))
                held = io.BytesIO(bytes(FILL))
                held.seek(FILL)
            self.places[kind][segment] = len(self.chunks), (held.tell() - FILL) // 8, len(bits) // 8
            held.write(bits)
        self.chunks.append(context.broadcast(held.getvalue()))
        self.rest = context.broadcast((trained.n, trained.v, trained.heavy, trained.texts))

    def model(self) -> Model:
        """The whole model, in a worker."""
        n, v, heavy, texts = self.rest.value
        return Model(SharedFilter([mapped(chunk) for chunk in self.chunks], self.places, texts), n, v, heavy)

    def destroy(self) -> None:
        """Takes the broadcasts from the driver's memory too, when nothing is left to be scored."""
        for chunk in (*self.chunks, self.rest):
            chunk.destroy()


class Answers:
    """Levels of the keys that were asked for, as the filter's segments told them; it stands in for a ``Filter``."""

    def __init__(self, told: dict[int, list[tuple[bytes, bytes]]], texts: float) -> None:
        self.texts, self.at = texts, {}
        for kind in (WORD, PAIR, REST):
            keys = np.frombuffer(b"".join(x for x, _ in told.get(kind, [])), "<u8")
            order = np.argsort(keys)
            self.at[kind] = keys[order], np.frombuffer(b"".join(x for _, x in told.get(kind, [])), np.uint8)[order]

    def levels(self, kind: int, keys: np.ndarray) -> np.ndarray:
        own, levels = self.at[kind]
        at = np.searchsorted(own, keys)
        if len(keys) and (not len(own) or not (own[np.minimum(at, len(own) - 1)] == keys).all()):
            raise ValueError("a key has no answer")
        return levels[at].astype(np.int64)


def asked_keys(texts: DataFrame, counts: dict[int, int]) -> DataFrame:
    """(kind, segment, chunk, keys): the distinct keys that scoring the chunks of ``texts`` (chunk, text; sorted by chunk) takes, packed by segment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start = rest_keys(_START[None])
        at, size = None, 0
        held: dict[int, list[np.ndarray]] = {WORD: [], PAIR: []}

        def shorten() -> None:
            nonlocal size
            for kind in held:
                held[kind] = [np.unique(np.concatenate(held[kind]))]
            size = 0

        def out() -> Iterator[pa.RecordBatch]:
            shorten()
            words, pairs = held[WORD][0], held[PAIR][0]
            for kind, keys in ((WORD, words), (REST, np.unique(np.concatenate((rest_keys(words), start)))), (PAIR, pairs)):
                own = segments(keys, counts[kind])
                order = np.argsort(own, kind="stable")
                keys, own = keys[order], own[order]
                names, starts = np.unique(own, return_index=True)
                cuts = list(zip(starts.tolist(), [*starts[1:].tolist(), len(own)], strict=True))
                for i in range(0, len(names), 256):
                    n = len(names[i : i + 256])
                    packed = [keys[a:b].astype("<u8").tobytes() for a, b in cuts[i : i + 256]]
                    columns = [pa.array([kind] * n, pa.int32()), pa.array(names[i : i + 256].astype(np.int64)), pa.array([at] * n, pa.int64()), pa.array(packed, pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, names=["kind", "segment", "chunk", "keys"])
            held.update({WORD: [], PAIR: []})

        for batch in batches:
            chunks = batch.column(0).to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(np.diff(chunks)) + 1).tolist(), len(chunks)]
            for first, end in zip(cuts, cuts[1:]):
                if held[WORD] and first < end and chunks[first] != at:
                    yield from out()
                for part in grouped_texts(batch.slice(first, end - first)):
                    at = int(chunks[first])
                    words, pairs = hashed_pairs(tokenised(part.column(1)))
                    held[WORD].append(words)
                    held[PAIR].append(pairs)
                    size += len(pairs)
                    if size > FLUSH_PAIRS:
                        shorten()
        if held[WORD]:
            yield from out()

    return texts.mapInArrow(run, "kind int, segment long, chunk long, keys binary")


def answered(asked: DataFrame, parts: dict[int, tuple[int, DataFrame]]) -> DataFrame:
    """(chunk, kind, keys, levels) for ``asked``, probed where the segments of the filter are. A chunk asks for a key once, so none is hot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, bits = None, np.zeros(0, np.uint64)
        for batch in batches:
            chunks, kinds, every, levels = [], [], [], []
            for kind, segment, chunk, keys in zip(*(batch.column(i) for i in range(4)), strict=True):
                if (kind.as_py(), segment.as_py()) != at:
                    at, bits = (kind.as_py(), segment.as_py()), np.zeros(0, np.uint64)
                if not chunk.is_valid:  # a segment's bits stand before what is asked of it
                    bits = np.frombuffer(keys.as_py(), "<u8")
                    continue
                own = np.frombuffer(keys.as_py(), "<u8")
                found = probed(bits, at[0], own, np.zeros(len(own), np.int64), np.full(len(own), len(bits), np.uint64))
                chunks.append(chunk.as_py())
                kinds.append(at[0])
                every.append(keys.as_py())
                levels.append(np.minimum(found, len(VALUES) - 1).astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(chunks, pa.int64()), pa.array(kinds, pa.int32()), pa.array(every, pa.binary()), pa.array(levels, pa.binary())], names=["chunk", "kind", "keys", "levels"])

    rows = asked
    for kind, (_, table) in parts.items():
        rows = rows.unionByName(table.select(F.lit(kind).alias("kind"), "segment", F.lit(None).cast("long").alias("chunk"), F.col("bits").alias("keys")))
    dealt = rows.repartition("kind", "segment").sortWithinPartitions("kind", "segment", F.col("chunk").asc_nulls_first())
    return dealt.mapInArrow(run, "chunk long, kind int, keys binary, levels binary")


def score_in_place(chosen: DataFrame, trained: Trained) -> DataFrame:
    """What ``score`` returns, for a filter that is too large to be broadcast. Texts are dealt into chunks of about ``ASKED_TOKENS``; a chunk sends its distinct keys to the
    segments, and their levels come back to the texts. At most ``BLOCKS`` blocks of chunks go one after the other, so what is on its way is a part of the whole."""
    spark, kind = chosen.sparkSession, dict(chosen.dtypes)["doc_id"]
    count = max(1, -(-trained.tokens // ASKED_TOKENS))
    dealt = chosen.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text"), F.lit(count)))
    shared = spark.sparkContext.broadcast((trained.n, trained.v, trained.heavy))
    texts, counts = trained.texts, {name: own for name, (own, _) in trained.parts.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        n, v, heavy = shared.value
        numbers, at, told, scorer = count_from(TaskContext.get().partitionId()), None, {}, None
        for batch in batches:
            chunks = batch.column(0).to_numpy(zero_copy_only=False)
            answers = pc.is_valid(batch.column(1)).to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero((np.diff(chunks) != 0) | (np.diff(answers.astype(np.int8)) != 0)) + 1).tolist(), len(chunks)]
            for first, end in zip(cuts, cuts[1:]):
                if first == end:
                    continue
                if chunks[first] != at:
                    at, told, scorer = chunks[first], {}, None
                part = batch.slice(first, end - first)
                if answers[first]:  # they stand before the texts of their chunk
                    for name, keys, levels in zip(*(part.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                        told.setdefault(name, []).append((keys, levels))
                    continue
                if scorer is None:
                    scorer = Scorer(Model(Answers(told, texts), n, v, heavy))
                    told = {}
                yield from scored(part.select([4, 5]), scorer, numbers)

    parts = []
    with shuffles_freed(spark):
        blocks = min(BLOCKS, count)
        for block in range(blocks):
            own = dealt.where(F.col("chunk") % blocks == block)
            asked = asked_keys(own.select("chunk", "text").repartition("chunk").sortWithinPartitions("chunk"), counts)
            told = answered(asked, trained.parts).select("chunk", "kind", "keys", "levels", F.lit(None).cast(kind).alias("doc_id"), F.lit(None).cast("string").alias("text"))
            nothing = [F.lit(None).cast(x).alias(name) for name, x in (("kind", "int"), ("keys", "binary"), ("levels", "binary"))]
            both = told.unionByName(own.select("chunk", *nothing, "doc_id", "text")).repartition("chunk").sortWithinPartitions("chunk", F.col("kind").asc_nulls_last())
            parts.append(staged(summed_scores(both.mapInArrow(run, scored_schema(kind)), trained), "scores"))
    shared.unpersist()
    return reduce(DataFrame.unionByName, parts)


def scored_schema(kind: str) -> str:
    return f"row long, word binary, tf long, doc_id {kind}, held_out boolean, n_tokens long, n_known long, base double, score double"


def count_from(partition: int) -> Iterator[int]:
    """Numbers of a task's rows."""
    return itertools.count(partition << 36)


def scored(batch: pa.RecordBatch, scorer: Scorer, numbers: Iterator[int]) -> Iterator[pa.RecordBatch]:
    """Rows of ``scored_schema`` for a batch (doc_id, text): one for each document, and one for each of its words whose exact count isn't at hand."""
    names = ["row", "word", "tf", "doc_id", "held_out", "n_tokens", "n_known", "base", "score"]
    kind = batch.schema.field(0).type

    for part in grouped_texts(batch):
        found, n = tokenised(part.column(1)), part.num_rows
        own = scorer.numbered(found.words)[found.at]
        logs = scorer.log_sums(own, found.starts)
        known, base, others = scorer.exact(own, found.starts)
        sizes = np.diff(found.starts, append=len(own))
        rows = np.array(list(itertools.islice(numbers, n)), np.int64)
        kinds = [pa.int64(), pa.binary(), pa.int64(), kind, pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
        # No word holds a space, so such a row's key meets none.
        columns = [rows, [b" %d" % row for row in rows.tolist()], np.zeros(n, np.int64), part.column(0), ~learned_from(part.column(0)), sizes, known, base, logs]
        yield pa.RecordBatch.from_arrays([pa.array(column, kind) for column, kind in zip(columns, kinds, strict=True)], names=names)
        if others.any():
            pairs, times = np.unique(np.repeat(np.arange(n) << 32, sizes)[others] | found.at[others], return_counts=True)
            columns = [pa.array(rows[pairs >> 32]), shortened(found.words.take(pa.array(pairs & 0xFFFFFFFF))), pa.array(times)]
            yield pa.RecordBatch.from_arrays([*columns, *(pa.nulls(len(pairs), kind) for kind in kinds[3:])], names=names)
        scorer.shorten()


def summed_scores(rows: DataFrame, trained: Trained) -> DataFrame:
    """The result from rows of ``scored_schema``: words whose exact count wasn't at hand get it from the table of all words."""
    n, total = trained.n, trained.n + 0.5 * (trained.v + 1)
    counted = rows.join(trained.vocabulary.select("word", "n_train"), "word", "left")
    c = F.coalesce("n_train", F.lit(0))
    part = F.when(F.col("tf") > 0, F.col("tf") * F.log10((c + 0.5) / F.lit(total)))
    found = counted.select("row", "doc_id", "held_out", "n_tokens", "score", F.coalesce("n_known", F.when(c > 0, F.col("tf")), F.lit(0)).alias("n_known"), F.coalesce("base", part).alias("base"))
    return (
        found.groupBy("row")
        .agg(*(F.max(x).alias(x) for x in ("doc_id", "held_out", "n_tokens", "score")), F.sum("n_known").alias("n_known"), F.sum("base").alias("base_score"))
        .select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")
    )


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row.

    A null or empty text is its end alone. A null id hashes as the empty text, and its row stays. Repeated rows each give a row. Without
    any training document every token has the base probability of an empty table. An empty table gives no rows; further columns are ignored,
    whatever their names. Texts are taken whole.
    """
    chosen = pick(docs, doc_id=id_col, text=text_col)
    trained = train(chosen)
    if trained.bits() > MOST_BITS:
        return score_in_place(chosen, trained)
    shared = Shared(trained)  # the filter, at most MOST_BITS, and HEAVY words

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        scorer, numbers = Scorer(resident(("bloom", shared.name), shared.model)), count_from(TaskContext.get().partitionId())
        for batch in batches:
            yield from scored(batch, scorer, numbers)

    with shuffles_freed(chosen.sparkSession):
        found = staged(summed_scores(chosen.mapInArrow(run, scored_schema(dict(chosen.dtypes)["doc_id"])), trained), "scores")
    shared.destroy()
    return found
