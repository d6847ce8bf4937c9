"""Near copies by exact similarity of word shingles.

A text is the set of its shingles of ``SHINGLE`` words (Jaccard); texts link from ``SIMILARITY`` on. Hashes give all shingles one order, in which the ``COMMON``
most frequent ones stand last. Sets meet under their first shingles:

- Of n shingles the first n - ceil(4 n / 5) + 1 are always enough: a similar set holds one of them among its own first ones.
- Fewer do where a set is long. Two similar sets of n and more shingles differ in n / 4 of them at most, so of the first k of their m that aren't common all
  differ with a probability of (n / 4 m) ** k at most. ``SURE`` makes that 2 ** -56, with 28 shingles for a set without common ones.

Sets that meet alone under a key are discarded by size and by SimHash (long sets more than ``FAR`` bits apart, as pivot distances or all bits show: expected are 10 of
64 at the least similarity, more than 28 with a probability of 1e-8). The rows that stay get a parity sketch: a bit for each place that an odd number of a set's shingles hash to. Two
sketches differ in no more bits than their sets in shingles, so a difference above what similar sets may have is proof, and a key's pairs that pass are mostly links. A key first gives
a star for each bundle of such sets; these pairs are verified on whole texts, and then only pairs of different components meet, so a group of copies costs a pair or two for each member.
Keys that are common shingles, which only sets made of common ones have, never gather in a task: their smallest sets are broadcast, and what is left outside a key's largest component
meets the others in cells of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, inf, log2

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspan.llm.base import discard, heavy_keys, join_one, map_batches, pick, release, staged
from veilspan.llm.simhash import SEED, components, pivot_tables

SHINGLE = 5
SIMILARITY = (4, 5)
SURE = 56
FIRST = 28  # first shingles of a set, by hash alone
FAR, LONG = 28, 40
COMMON, OFTEN = 1 << 16, 64  # how many shingles may be common, and among how many texts' first ones such a shingle stands at least
MOST_NAMED = 1_000_000  # texts whose digests are broadcast to find them; beyond, a merge join does
CELL = 4_096
SALTS = 64


def shingles(text: str | None) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles; one for a text of fewer words, none without a word."""
    words = text.encode().lower().split() if text else []
    digest = xxhash.xxh64_intdigest
    if len(words) <= SHINGLE:
        return np.array([digest(b" ".join(words), SEED)] if words else [], np.uint64)
    laid = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    return np.unique(np.fromiter((digest(laid[a:b], SEED) for a, b in zip(starts[: 1 - SHINGLE].tolist(), ends[SHINGLE - 1 :].tolist(), strict=True)), np.uint64))


def sketch(hashes: np.ndarray) -> int:
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 18):
        ones += np.unpackbits(hashes[i : i + (1 << 18)].astype(">u8").view(np.uint8)).reshape(-1, 64).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big", signed=True)


def parity(hashes: np.ndarray) -> bytes:
    """The parity sketch: a power of two of places, twice the set's size or more."""
    if not len(hashes):
        return b""
    places = max(64, 1 << int(2 * len(hashes) - 1).bit_length())
    return np.packbits(np.bincount((hashes & np.uint64(places - 1)).astype(np.int64), minlength=places).astype(np.uint8) & 1).tobytes()


def folded(raw: bytes, size: int) -> np.ndarray:
    """A parity sketch with ``size`` bytes."""
    bits = np.frombuffer(raw, np.uint8)
    while len(bits) > size:
        bits = bits[: len(bits) // 2] ^ bits[len(bits) // 2 :]
    return bits


class Sketches:
    """Sizes and parity sketches of some sets, laid out by the sketches' sizes."""

    def __init__(self, n: np.ndarray, odd: list[bytes]) -> None:
        self.n, self.odd, self.laid = n, odd, {}
        self.sizes = np.fromiter(map(len, odd), np.int64, len(odd))

    def _laid(self, size: int) -> np.ndarray:
        """All sketches with ``size`` bytes; smaller ones have none."""
        if size not in self.laid:
            out = np.zeros((len(self.odd), size), np.uint8)
            for i in np.flatnonzero(self.sizes >= size):
                out[i] = folded(self.odd[i], size)
            self.laid[size] = out.view(np.uint64)
        return self.laid[size]

    def close(self, row: int, columns: np.ndarray) -> np.ndarray:
        """Which of ``columns`` can be similar to ``row``."""
        n, own = self.n[columns], self.n[row]
        columns = columns[(SIMILARITY[0] * n <= SIMILARITY[1] * own) & (SIMILARITY[0] * own <= SIMILARITY[1] * n)]
        sizes, kept = np.minimum(self.sizes[columns], self.sizes[row]), []
        for size in set(sizes.tolist()):
            part, laid = columns[sizes == size], self._laid(size)
            differ = np.bitwise_count(laid[part] ^ laid[row]).sum(1, dtype=np.int64)
            kept.append(part[(SIMILARITY[1] + SIMILARITY[0]) * differ <= (SIMILARITY[1] - SIMILARITY[0]) * (self.n[part] + own)])
        return np.sort(np.concatenate(kept)) if kept else columns


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sorted sets are similar enough."""
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return SIMILARITY[1] * shared >= SIMILARITY[0] * (len(a) + len(b) - shared)


def prefix(n: int) -> int:
    """How many of a set's first shingles any set similar to it shares one of, in whatever order."""
    return n + -SIMILARITY[0] * n // SIMILARITY[1] + 1


def enough(n: int, rare: int) -> float:
    """How many of a set's ``rare`` shingles, by hash, are enough but for a probability of 2 ** -SURE."""
    differ = n / (4 * rare) if rare else inf
    return ceil(SURE / -log2(differ)) if differ < 1 else inf


def keys_of(hashes: np.ndarray, common: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The shingles under which a set meets others: those that aren't common, and those that are."""
    n = len(hashes)
    if not n:
        return hashes, hashes
    at = np.minimum(np.searchsorted(common, hashes), max(len(common) - 1, 0))
    is_common = common[at] == hashes if len(common) else np.zeros(n, bool)
    rare = hashes[~is_common]
    most = prefix(n)
    if enough(n, len(rare)) < most:
        return rare[: int(enough(n, len(rare)))], hashes[:0]
    return rare[:most], hashes[is_common][: max(most - len(rare), 0)]


def _first_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, n): among how many texts' first shingles each one stands, summed within parts of a task."""
    release()
    held, size = [], 0

    def out() -> pa.RecordBatch:
        keys, counts = np.unique(np.concatenate([np.zeros(0, np.uint64), *held]), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(counts)], names=["key", "n"])

    for batch in batches:
        for raw in batch.column(0).to_pylist():
            held.append(np.frombuffer(raw, np.uint64))
            size += len(held[-1])
        if size > 1 << 20:
            yield out()
            held, size = [], 0
    yield out()


def _sets(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    release()
    found = [shingles(x.as_py()) for x in batch.column(1)]
    names = np.fromiter((xxhash.xxh64_intdigest(x.tobytes(), SEED) for x in found), np.uint64, len(found)).view(np.int64)
    first = pa.array([x[:FIRST].tobytes() for x in found], pa.binary())
    odd = pa.array([parity(x) for x in found], pa.binary())
    columns = [batch.column(0), batch.column(2), pa.array(names), pa.array([sketch(x) for x in found], pa.int64()), pa.array([len(x) for x in found], pa.int64()), first, odd]
    yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "row", "s", "fp", "n", "first", "odd"])


def _keys(common: np.ndarray):
    """(key, hot, s, fp, n) for each key of a set. ``first`` is all that is needed where no common shingle stands in it and it is enough; else the text is."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        columns: list[list[np.ndarray]] = [[np.zeros(0, np.int64)] for _ in range(5)]
        for text, s, fp, n in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            for keys, hot in zip(keys_of(shingles(text), common), (0, 1), strict=True):
                for column, value in zip(columns, (keys.view(np.int64), *(np.full(len(keys), x, np.int64) for x in (hot, s, fp, n))), strict=True):
                    column.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in columns], names=["key", "hot", "s", "fp", "n"])

    return run


def _groups(batches: Iterator[pa.RecordBatch], by: int = 1) -> Iterator[list[np.ndarray]]:
    """The columns of each run of rows that agree in the first ``by`` columns, for sorted batches."""
    held: list[list[np.ndarray]] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(i).to_numpy(zero_copy_only=False) if pa.types.is_integer(batch.column(i).type) else np.array([*batch.column(i).to_pylist(), None], object)[:-1] for i in range(batch.num_columns)]
        new = np.zeros(batch.num_rows, bool)
        for column in columns[:by]:
            new[1:] |= column[1:] != column[:-1]
        bounds = [0, *np.flatnonzero(new).tolist(), batch.num_rows]
        for start, end in zip(bounds, bounds[1:]):
            part = [x[start:end] for x in columns]
            if held and any(held[-1][i][-1] != part[i][0] for i in range(by)):
                yield [np.concatenate(x) for x in zip(*held, strict=True)]
                held = []
            held.append(part)
    if held:
        yield [np.concatenate(x) for x in zip(*held, strict=True)]


class _Pairs:
    """Pairs of names, each once within a part of a task."""

    def __init__(self) -> None:
        self.a: list[np.ndarray] = []
        self.b: list[np.ndarray] = []
        self.size = 0

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        if len(a):
            self.a.append(np.minimum(a, b))
            self.b.append(np.maximum(a, b))
            self.size += len(a)

    def out(self) -> tuple[np.ndarray, np.ndarray]:
        a, b = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (self.a, self.b))
        self.__init__()
        both = np.unique(np.stack((a, b)), axis=1)
        return both[0], both[1]

    def batch(self) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(list(map(pa.array, self.out())), names=["a", "b"])


def _together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, s, n) of the rows that have a possible partner under their key, by sizes, pivot distances and SimHash."""
    release()
    tables, kept, many = pivot_tables(), [], 0

    def out() -> pa.RecordBatch:
        columns = [np.concatenate([np.zeros(0, np.int64), *x]) for x in zip(*kept, strict=True)] if kept else [np.zeros(0, np.int64)] * 3
        return pa.RecordBatch.from_arrays(list(map(pa.array, columns)), names=["key", "s", "n"])

    for key, s, fp, n in _groups(batches):
        if len(s) < 2:
            continue
        order = np.argsort(n, kind="stable")
        key, s, fp, n = key[order], s[order], fp[order].view(np.uint64), n[order]
        at, good = tables.coordinates(fp), np.zeros(len(s), bool)
        ends = np.searchsorted(n, SIMILARITY[1] * n // SIMILARITY[0], side="right").tolist()
        for i, end in enumerate(ends):
            far = np.abs(at[i + 1 : end] - at[i]).max(axis=1, initial=0) > FAR
            far[~far] = np.bitwise_count(fp[i + 1 : end][~far] ^ fp[i]) > FAR
            near = ~far | (n[i] < LONG)
            good[i + 1 : end] |= near
            good[i] |= near.any()
        if good.any():
            kept.append((key[good], s[good], n[good]))
            many += len(kept[-1][0])
        if many > 200_000:
            yield out()
            kept, many = [], 0
    yield out()


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b) of a star for each bundle of sets of a key whose sketches are close: the set with most close ones is the first star's middle."""
    release()
    pairs = _Pairs()
    for _, s, n, odd in _groups(batches):
        left, sketches = np.arange(len(s)), Sketches(n, odd)
        if 2 < len(s) <= 4 * OFTEN:
            near = np.array([len(sketches.close(i, left)) for i in left])
            left = left[np.lexsort((s, -near))]
        while len(left) > 1:
            middle, left = left[0], left[1:]
            found = sketches.close(middle, left)
            pairs.add(np.full(len(found), s[middle]), s[found])
            left = left[~np.isin(left, found)]
        if pairs.size > 200_000:
            yield pairs.batch()
    yield pairs.batch()


def _meets_before(key: int, a: bytes, b: bytes) -> bool:
    """Whether two sets, by their sorted keys, meet under a key before this one too."""
    a, b = (x[: np.searchsorted(x, key)] for x in (np.frombuffer(a, np.int64), np.frombuffer(b, np.int64)))
    return len(np.intersect1d(a, b, assume_unique=True)) > 0


def _across(pairs: _Pairs, own: list[np.ndarray], others: list[np.ndarray], key: int | None = None, keys: np.ndarray | None = None) -> None:
    """Adds the pairs of ``own`` with ``others`` (each s, n, odd, root) that are in different components and whose sketches are close; with ``keys`` (of both) under their first common key alone."""
    s, n, odd, root = (np.concatenate(x) for x in zip(own, others, strict=True))
    columns, sketches = np.arange(len(own[0]), len(s)), Sketches(n, odd)
    for i in range(len(own[0])):
        found = sketches.close(i, columns[root[columns] != root[i]])
        if keys is not None:
            found = found[[not _meets_before(key, keys[i], keys[j]) for j in found]] if len(found) else found
        pairs.add(np.full(len(found), s[i]), s[found])


def _packed(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """(s, keys): each set's sorted keys as bytes."""
    keys = [x.values.to_numpy(zero_copy_only=False).astype(np.int64).tobytes() for x in batch.column(1)]
    yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.binary())], names=["s", "keys"])


def _second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The close pairs of a key that are in different components: what stands outside the largest component, with all. A pair comes under its first key alone."""
    release()
    pairs = _Pairs()
    for key, *columns, keys in _groups(batches):
        roots, where, counts = np.unique(columns[3], return_inverse=True, return_counts=True)
        if len(roots) > 1:
            outside = where != counts.argmax()
            _across(pairs, [x[outside] for x in columns], columns, int(key[0]), np.concatenate((keys[outside], keys)))
        if pairs.size > 200_000:
            yield pairs.batch()
    yield pairs.batch()


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The close pairs of a cell (key, i, j) of a common key: rows marked as outside with the others."""
    release()
    pairs = _Pairs()
    for _, _, _, outside, *columns in _groups(batches, 3):
        _across(pairs, [x[outside == 1] for x in columns], [x[outside == 0] for x in columns])
        if pairs.size > 200_000:
            yield pairs.batch()
    yield pairs.batch()


def _close_pairs(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """(a, b) of rows (a, b, na, nb, oa, ob) whose sketches are close."""
    a, b, na, nb, oa, ob = (batch.column(i).to_pylist() for i in range(6))
    keep = [len(Sketches(np.array(x[:2]), x[2:]).close(0, np.array([1]))) > 0 for x in zip(na, nb, oa, ob, strict=True)]
    yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b) of similar pairs, for rows (a, salt, b, text) where a row without ``b`` holds a's own text and stands before the others."""
    release()
    center, own = None, np.zeros(0, np.uint64)
    for batch in batches:
        found = ([], [])
        for a, b, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3), strict=True):
            if b is None:
                if a != center:
                    center, own = a, shingles(text.as_py())
            elif similar(own, shingles(text.as_py())):
                found[0].append(a)
                found[1].append(b)
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], names=["a", "b"])


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, row, component_id) of every row: the smallest id that links reach from it. ``row`` is the text's md5, null for a null.

    Texts without a word are copies of one another. A null id stays null and is never a component's id while the component has another. Repeated rows each
    give a row, an empty table gives none, and further columns are ignored, whatever their names. The result is staged; other tables made on the way are deleted.
    """
    spark, paths = docs.sparkSession, []
    keep = lambda df, label: staged(df, label, paths)
    chosen = pick(docs, doc_id=id_col, text=text_col).withColumn("row", F.md5(F.col("text").cast("binary")))
    sets = keep(map_batches(chosen, _sets, f"doc_id {dict(chosen.dtypes)['doc_id']}, row string, s long, fp long, n long, first binary, odd binary"), "sets")
    distinct = keep(sets.groupBy("s").agg(F.min("doc_id").alias("least"), F.min("row").alias("row"), F.first("fp").alias("fp"), F.first("n").alias("n"), F.first("first").alias("first"), F.first("odd").alias("odd")), "distinct-sets")
    frequent = distinct.select("first").mapInArrow(_first_counts, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") > OFTEN)
    common = np.sort(np.array([row.key for row in frequent.orderBy(F.desc("n"), "key").limit(COMMON).collect()], np.int64).view(np.uint64))  # at most COMMON

    def texts(named: DataFrame) -> DataFrame:
        """(s, text, fp, n) of distinct sets, by one text of each."""
        wanted = named.hint("broadcast" if named.count() <= MOST_NAMED else "merge")
        return chosen.select("row", "text").join(wanted, "row").groupBy("s").agg(F.first("text").alias("text"))

    def by_first(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        """The keys of sets whose first shingles are enough and not common; (s) of the others."""
        own = [batch.column(i).to_pylist() for i in range(4)]
        columns: list[list[np.ndarray]] = [[np.zeros(0, np.int64)] for _ in range(5)]
        for s, fp, n, raw in zip(*own, strict=True):
            first = np.frombuffer(raw, np.uint64)
            at = np.minimum(np.searchsorted(common, first), max(len(common) - 1, 0))
            if len(common) and (common[at] == first).any():
                keys, hot = np.zeros(1, np.int64), 2
            else:
                keys, hot = first[: prefix(n)].view(np.int64), 0
            for column, value in zip(columns, (keys, *(np.full(len(keys), x, np.int64) for x in (hot, s, fp, n))), strict=True):
                column.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in columns], names=["key", "hot", "s", "fp", "n"])

    kinds = "key long, hot long, s long, fp long, n long"
    easy = map_batches(distinct.select("s", "fp", "n", "first"), by_first, kinds)
    rows = easy.where("hot = 0")
    hot = None
    if len(common):
        other = keep(easy.where("hot = 2").select("s", "fp", "n").join(distinct.select("s", "row"), "s"), "common-sets")
        told = texts(other.select("row", "s")).join(other.select("s", "fp", "n"), "s").select("text", "s", "fp", "n")
        keyed = keep(map_batches(told, _keys(common), kinds), "common-keys")
        rows, hot = rows.unionByName(keyed.where("hot = 0")), keyed.where("hot = 1").select("key", "s", "n")
    dealt = rows.select("key", "s", "fp", "n").repartition("key").sortWithinPartitions("key")
    met = keep(dealt.mapInArrow(_together, "key long, s long, n long"), "met")
    parities = distinct.select("s", "odd")
    sketched = lambda df: df.join(parities, "s").repartition("key").sortWithinPartitions("key")

    def verified(pairs: DataFrame, label: str) -> DataFrame:
        pairs = keep(pairs.distinct(), f"{label}-pairs")
        named = keep(pairs.select(F.explode(F.array("a", "b")).alias("s")).distinct().join(distinct.select("s", "row"), "s").select("row", "s"), f"{label}-named")
        whole = keep(texts(named), f"{label}-texts")
        heavy = heavy_keys(pairs, "a")
        salt = F.lit(0)
        if heavy is not None:
            pairs = pairs.join(F.broadcast(heavy.withColumn("is_heavy", F.lit(True))), "a", "left")
            salt = F.when(F.col("is_heavy"), F.pmod(F.xxhash64("b"), F.lit(SALTS))).otherwise(0)
        salted = pairs.select("a", salt.cast("long").alias("salt"), "b")
        members = salted.join(whole.withColumnRenamed("s", "b"), "b").select("a", "salt", "b", "text")
        centers = salted.select("a", "salt").distinct().join(whole.withColumnRenamed("s", "a"), "a").select("a", "salt", F.lit(None).cast("long").alias("b"), "text")
        together = members.unionByName(centers).repartition("a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())
        return keep(together.mapInArrow(_verify, "a long, b long"), label)

    pairs = sketched(met).select("key", "s", "n", "odd").mapInArrow(_stars, "a long, b long")
    if hot is not None:
        least = F.broadcast(hot.groupBy("key").agg(F.min(F.struct("s", "n")).alias("x")))  # at most COMMON rows
        sizes = F.lit(SIMILARITY[0]) * F.greatest("n", "x.n") <= F.lit(SIMILARITY[1]) * F.least("n", "x.n")
        star = hot.join(least, "key").where(F.col("s") != F.col("x.s")).where(sizes).select(F.col("x.s").alias("a"), F.col("s").alias("b")).distinct()
        a, b = (distinct.select(F.col("s").alias(x), F.col("n").alias(f"n{x}"), F.col("odd").alias(f"o{x}")) for x in "ab")
        near = map_batches(join_one(star.join(b, "b"), a, "a", heavy_keys(star, "a")).select("a", "b", "na", "nb", "oa", "ob"), _close_pairs, "a long, b long")
        pairs = pairs.unionByName(near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))
    edges = verified(pairs, "links")

    roots = components(edges, paths=paths)
    rooted = lambda df: df.join(roots.select(F.col("node").alias("s"), "root"), "s", "left").withColumn("root", F.coalesce("root", "s"))
    listed = map_batches(met.groupBy("s").agg(F.array_sort(F.collect_set("key")).alias("keys")), _packed, "s long, keys binary")
    more = sketched(rooted(met).join(listed, "s")).select("key", "s", "n", "odd", "root", "keys").mapInArrow(_second, "a long, b long")
    if hot is not None:
        placed = keep(rooted(hot), "hot-rooted")
        counts = placed.groupBy("key", "root").count()
        largest = counts.groupBy("key").agg(F.max_by("root", F.struct("count", "root")).alias("main"), F.sum("count").alias("total"), F.max("count").alias("most")).where("total > most")
        told = placed.join(parities, "s").join(F.broadcast(largest), "key").withColumn("out", F.col("root") != F.col("main"))  # at most COMMON rows are broadcast
        blocks = lambda size: F.ceil(size / F.lit(CELL)).cast("long")
        block = lambda size: F.pmod(F.xxhash64("s"), blocks(size))
        outside = F.col("total") - F.col("most")
        own = told.where("out").select("key", block(outside).alias("i"), F.explode(F.sequence(F.lit(0).cast("long"), blocks(F.col("total")) - 1)).alias("j"), F.lit(1).cast("long").alias("outside"), "s", "n", "odd", "root")
        every = told.select("key", F.explode(F.sequence(F.lit(0).cast("long"), blocks(outside) - 1)).alias("i"), block(F.col("total")).alias("j"), F.lit(0).cast("long").alias("outside"), "s", "n", "odd", "root")
        more = more.unionByName(own.unionByName(every).repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(_cells, "a long, b long"))
    edges = edges.unionByName(verified(more, "more-links"))
    roots = components(edges, paths=paths)
    labelled = distinct.select("s", "least").join(roots.select(F.col("node").alias("s"), "root"), "s", "left").select("s", "least", F.coalesce("root", "s").alias("root"))
    labelled = keep(labelled, "labelled")
    smallest = labelled.groupBy("root").agg(F.min("least").alias("component_id"), F.min("root").alias("r"))
    named = join_one(labelled, smallest.select("root", "component_id"), "root").select("s", "component_id", "root")
    found = staged(join_one(sets.select("doc_id", "row", "s"), named, "s").select("doc_id", "row", "component_id", F.col("root").alias("component")), "near-copies")
    discard(spark, paths)
    return found
