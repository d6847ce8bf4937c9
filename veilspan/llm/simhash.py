"""SimHash near-duplicates by pivot distance tables.

Reference fingerprints ("pivots") are fixed. For each of ``BANDS`` bands of 16 bits a table holds the Hamming distance of
every band value to the same band of every pivot. A fingerprint's distances in a band depend on its bits there alone, so
fingerprints that agree in a band have the same distance vector there. Two fingerprints that differ in at most ``RADIUS``
bits agree in ``BANDS - RADIUS`` bands or more; each choice of so many bands is a table whose key is their distance
vectors, and such a pair meets under one key at least. Within a key, pairs are discarded by the largest difference of
their whole distances to the pivots (the triangle inequality: above the radius there is no link), and the survivors are
verified bit by bit. Only a spanning star of each key's links is passed on, never all pairs.

Exact copies share a fingerprint and count once from the start. Keys with more than ``SPLIT`` fingerprints are cut into narrower ones by
the bits that they leave open: in ``RADIUS + 1`` parts of these, linked fingerprints agree in one at least, so they still meet. Links become
components by alternating star contraction, which keeps every step distributed and staged in the shared folder.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veilspan.llm.base import discard, join_one, map_batches, pick, staged

SHINGLE = 3
SEED = 42
RADIUS = 2
BANDS = 4
PIVOTS = 16
SPLIT = 4096
BLOCK = 512
BITS_AT_ONCE = 1 << 18


def fingerprint(text: str | None) -> int:
    """The 64-bit fingerprint of a text; 0 without a word."""
    words = text.encode().lower().split() if text else []
    if not words:
        return 0
    if len(words) < SHINGLE:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    digest = xxhash.xxh64_intdigest
    laid = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    hashes = np.fromiter((digest(laid[a:b], SEED) for a, b in zip(starts[: 1 - SHINGLE].tolist(), ends[SHINGLE - 1 :].tolist(), strict=True)), np.uint64)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), BITS_AT_ONCE):
        part = hashes[i : i + BITS_AT_ONCE].astype(">u8")
        ones += np.unpackbits(part.view(np.uint8)).reshape(-1, 64).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): each row's fingerprint, as a signed 64-bit integer. A null or empty text has fingerprint zero."""
    chosen = pick(docs, doc_id=id_col, text=text_col)

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        fps = np.fromiter((fingerprint(x.as_py()) for x in batch.column(1)), np.uint64, batch.num_rows)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    return map_batches(chosen, run, f"doc_id {dict(chosen.dtypes)['doc_id']}, fp long")


class PivotTables:
    """Distances of every 16-bit value to the pivots, by band, and a key for each distance vector."""

    def __init__(self) -> None:
        self.pivots = np.array([xxhash.xxh64_intdigest(f"pivot {i}", SEED) for i in range(PIVOTS)], np.uint64)
        values = np.arange(1 << 16, dtype=np.uint64)
        self.distances, self.keys = [], []
        for band in range(BANDS):
            own = (self.pivots >> np.uint64(16 * band)) & np.uint64(0xFFFF)
            table = np.bitwise_count(values[:, None] ^ own[None, :]).astype(np.uint8)
            self.distances.append(table)
            rows = table.astype(np.uint64) @ np.array([xxhash.xxh64_intdigest(f"key {band} {i}", SEED) | 1 for i in range(PIVOTS)], np.uint64)
            self.keys.append(rows)

    def bands(self, fps: np.ndarray) -> list[np.ndarray]:
        return [((fps >> np.uint64(16 * band)) & np.uint64(0xFFFF)).astype(np.int64) for band in range(BANDS)]

    def coordinates(self, fps: np.ndarray) -> np.ndarray:
        """Whole distances to each pivot, a row for each fingerprint."""
        return sum(table[values] for table, values in zip(self.distances, self.bands(fps), strict=True)).astype(np.int16)

    def table_keys(self, fps: np.ndarray) -> Iterator[np.ndarray]:
        own = [keys[values] for keys, values in zip(self.keys, self.bands(fps), strict=True)]
        for number, chosen in enumerate(combinations(range(BANDS), BANDS - RADIUS)):
            key = np.full(len(fps), xxhash.xxh64_intdigest(f"table {number}", SEED), np.uint64)
            for band in chosen:
                key = (key ^ own[band]) * np.uint64(0x9E3779B97F4A7C15)
                key ^= key >> np.uint64(29)
            yield key


@lru_cache(maxsize=1)
def pivot_tables() -> PivotTables:
    """The tables, made once in a worker."""
    return PivotTables()


def joined(labels: np.ndarray, rows: np.ndarray, columns: np.ndarray) -> None:
    """Joins the components (each place's smallest one) of linked places."""
    while len(rows):
        a, b = labels[rows], labels[columns]
        apart = a != b
        rows, columns, a, b = rows[apart], columns[apart], a[apart], b[apart]
        np.minimum.at(labels, np.maximum(a, b), np.minimum(a, b))
        while (labels[labels] != labels).any():
            labels[:] = labels[labels]


def linked_stars(fps: np.ndarray, tables: PivotTables) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprint, smallest fingerprint of its component) for the links among ``fps``; those without links are left out."""
    at = tables.coordinates(fps)
    order = np.argsort(at[:, 0], kind="stable")
    fps, at = fps[order], at[order]
    labels = np.arange(len(fps))
    linked = np.zeros(len(fps), bool)
    for start in range(0, len(fps), BLOCK):
        end = min(start + BLOCK, len(fps))
        far = int(np.searchsorted(at[:, 0], at[end - 1, 0] + RADIUS, side="right"))
        rows, columns = np.nonzero(np.triu(np.ones((end - start, far - start), bool), 1))
        for pivot in range(PIVOTS):
            near = np.abs(at[rows + start, pivot] - at[columns + start, pivot]) <= RADIUS
            rows, columns = rows[near], columns[near]
        rows, columns = rows + start, columns + start
        sure = np.bitwise_count(fps[rows] ^ fps[columns]) <= RADIUS
        rows, columns = rows[sure], columns[sure]
        linked[rows] = linked[columns] = True
        joined(labels, rows, columns)
    if not linked.any():
        return fps[:0], fps[:0]
    least = np.full(len(fps), np.iinfo(np.uint64).max, np.uint64)
    np.minimum.at(least, labels, fps)
    stars = least[labels]
    keep = linked & (stars != fps)
    return fps[keep], stars[keep]


def links(distinct: DataFrame, split: int = SPLIT) -> DataFrame:
    """(a, b): links between distinct fingerprints ``fp`` that have the components of all links within ``RADIUS`` bits."""

    def keyed(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        tables = pivot_tables()
        fps = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
        keys = list(tables.table_keys(fps))
        numbers = np.repeat(np.arange(len(keys), dtype=np.int32), len(fps))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(numbers), pa.array(np.tile(fps.view(np.int64), len(keys)))], names=["key", "number", "fp"])

    def cut(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        """A large key's rows under ``RADIUS + 1`` narrower ones: linked fingerprints agree in one part at least of the bits that the key leaves open."""
        key, number, fp = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        own = pivot_tables().bands(fp.astype(np.int64).view(np.uint64))
        rest = np.zeros(len(fp), np.uint64)
        for i, chosen in enumerate(combinations(range(BANDS), BANDS - RADIUS)):
            left = [own[band].astype(np.uint64) for band in range(BANDS) if band not in chosen]
            rest = np.where(number == i, sum(x << np.uint64(16 * k) for k, x in enumerate(left)), rest)
        bounds = np.linspace(0, 16 * RADIUS, RADIUS + 2).astype(int).tolist()
        keys = []
        for i, (first, last) in enumerate(zip(bounds, bounds[1:])):
            part = (rest >> np.uint64(first)) & np.uint64((1 << (last - first)) - 1)
            mixed = (key.astype(np.int64).view(np.uint64) ^ (part * np.uint64(len(bounds)) + np.uint64(i + 1))) * np.uint64(0x9E3779B97F4A7C15)
            keys.append((mixed ^ (mixed >> np.uint64(31))).view(np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.tile(fp, len(keys)))], names=["key", "fp"])

    rows = map_batches(distinct.select("fp"), keyed, "key long, number int, fp long")
    large = staged(rows.groupBy("key").count().where(F.col("count") > split).select("key"), "large-keys")
    if not large.isEmpty():
        told = rows.join(large.withColumn("is_large", F.lit(True)), "key", "left")
        narrow = map_batches(told.where("is_large").select("key", "number", "fp"), cut, "key long, fp long")
        rows = told.where("is_large IS NULL").select("key", "fp").unionByName(narrow)
    else:
        rows = rows.select("key", "fp")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = pivot_tables()
        held_key, held = None, []
        found_a: list[np.ndarray] = []
        found_b: list[np.ndarray] = []

        def end_group() -> None:
            fps = np.unique(np.concatenate(held)) if held else np.zeros(0, np.uint64)
            if len(fps) > 1:
                a, b = linked_stars(fps, tables)
                found_a.append(a)
                found_b.append(b)

        def out() -> pa.RecordBatch:
            a = np.concatenate(found_a) if found_a else np.zeros(0, np.uint64)
            b = np.concatenate(found_b) if found_b else np.zeros(0, np.uint64)
            found_a.clear()
            found_b.clear()
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            fps = batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
            if not len(keys):
                continue
            starts = np.flatnonzero(np.diff(keys, prepend=keys[0] - 1 if keys[0] > np.iinfo(np.int64).min else keys[0] + 1))
            ends = np.append(starts[1:], len(keys))
            if held_key is not None and keys[0] != held_key:
                end_group()
                held = []
            elif held_key is None:
                held = []
            if len(starts) > 1:
                held.append(fps[: ends[0]])
                end_group()
                for start, end in zip(starts[1:-1].tolist(), ends[1:-1].tolist(), strict=True):
                    if end - start > 1:
                        held = [fps[start:end]]
                        end_group()
                held = [fps[starts[-1] :].copy()]
            else:
                held.append(fps.copy())
            held_key = keys[-1]
            yield out()
        end_group()
        yield out()

    met = rows.repartition("key").sortWithinPartitions("key").mapInArrow(meet, "a long, b long")
    return met.distinct()


def components(edges: DataFrame, label: str = "components", paths: list[str] | None = None) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b): the smallest node that it reaches, by alternating star contraction.

    Each step is staged, and the one before it deleted; the last one's path goes to ``paths``. A hub's edges meet a broadcast, so no node fills a task.
    """
    spark, last = edges.sparkSession, []
    edges = staged(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), label, last)

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())

    before = mark(edges)
    while before[0]:
        # Large star: a node's larger neighbours go to the smallest of its neighbours and itself.
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m"))
        large = staged(join_one(both.where("b > a"), least, "a").select(F.col("b").alias("a"), F.least("a", "m").alias("b")).distinct(), label, last)
        # Small star: a node and its smaller neighbours go to the smallest of them.
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = join_one(large, least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))).distinct()
        done, last = last, []
        edges = staged(small, label, last)
        discard(spark, done)
        after = mark(edges)
        if after == before:
            break
        before = after
    if paths is not None:
        paths += last
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", split: int = SPLIT) -> DataFrame:
    """(doc_id, fp, component_id) of every row: its fingerprint and the smallest id that links reach from it.

    Null and empty texts have fingerprint zero and are linked like any other. Repeated rows each give a row. A null id
    stays null and is never a component's id while the component has another. An empty table gives no rows; further columns are
    ignored, whatever their names. Texts are taken whole, of any length.
    """
    fps = staged(fingerprints(docs, id_col, text_col), "fingerprints")
    distinct = staged(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    roots = components(links(distinct, split))
    labelled = staged(distinct.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root")), "labelled")
    smallest = labelled.groupBy("root").agg(F.min("least").alias("component_id"))
    named = join_one(labelled, smallest, "root").select("fp", "component_id")
    return join_one(fps, named, "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, groups: Callable[[DataFrame, str, str], DataFrame], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each near-duplicate group: that with the smallest id, of several such the one whose text has the smallest md5.

    ``groups`` gives each row's (doc_id, row, component): ``row`` is the md5 of its text. Rows that agree in id and text are one document; of them the one stays whose other columns come
    first as JSON. An id that stands with several texts is several documents, each in its own group. A row without an id stays only where its group has none with one.
    """
    key = lambda i, row: F.md5(F.concat_ws("|", F.coalesce(F.concat(F.lit("i"), i.cast("string")), F.lit("n")), F.coalesce(row, F.lit("n"))).cast("binary"))
    found = staged(groups(docs, id_col, text_col).select("doc_id", "row", "component"), "groups")
    # Nulls come last: an id that is there makes the first field false, which is smaller.
    best = found.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", F.col("row").isNull().alias("m"), "row")).alias("x"))
    stays = best.select(key(F.col("x.doc_id"), F.col("x.row")).alias("key")).distinct()
    counted = found.select(key(F.col("doc_id"), F.col("row")).alias("key")).groupBy("key").count()
    told = counted.join(stays.withColumn("stays", F.lit(True)), "key", "left")
    told = staged(told.where("stays IS NULL OR count > 1").select("key", F.col("stays").isNotNull().alias("stays")), "gone")
    names = [f"c{i}" for i in range(len(docs.columns))]
    at = {name: i for i, name in reversed(list(enumerate(docs.columns)))}
    plain = docs.toDF(*names).withColumn("key", key(F.col(names[at[id_col]]), F.md5(F.col(names[at[text_col]]).cast("binary"))))
    # Always a merge join: a size at which the list of keys fits a broadcast would only hide what the next size costs.
    kept = plain.join(told.select("key").hint("merge"), "key", "left_anti").select(*names)
    again = told.where("stays").select("key")
    if not again.isEmpty():
        order = Window.partitionBy("key").orderBy(F.to_json(F.struct(*names)))
        first = plain.join(again.hint("merge"), "key", "left_semi").withColumn("place", F.row_number().over(order)).where("place = 1").select(*names)
        kept = kept.unionByName(first)
    return kept.toDF(*docs.columns)
