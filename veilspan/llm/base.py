"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def pick(df: DataFrame, **wanted: str) -> DataFrame:
    """Columns of ``df`` by exact name, under new names.

    Columns are found by position, so further columns whose names clash (also only by case) do no harm; of several with
    the same exact name the first counts.
    """
    small_batches(df.sparkSession)
    at = {name: i for i, name in reversed(list(enumerate(df.columns)))}
    for source in wanted.values():
        if source not in at:
            raise ValueError(f"no column {source!r}; there are {df.columns}")
    plain = df.toDF(*(f"_{i}" for i in range(len(df.columns))))
    return plain.select(*(F.col(f"_{at[source]}").alias(new) for new, source in wanted.items()))


def positional(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``df`` with its columns named by position, and by exact name the first column of that name. Whatever the names, new columns can't clash."""
    small_batches(df.sparkSession)
    names = [f"c{i}" for i in range(len(df.columns))]
    return df.toDF(*names), {name: new for name, new in reversed(list(zip(df.columns, names, strict=True)))}


#: Rows of documents that go to a Python worker at once, where the session has Spark's default: long texts make large batches, held by the JVM and by the worker.
BATCH_ROWS = 500


def small_batches(spark: SparkSession) -> None:
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key, "10000") == "10000":
        spark.conf.set(key, str(BATCH_ROWS))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or the context's own checkpoint folder.

    Where neither is set, a local session gets a temporary one; a cluster's executors couldn't read that, so there it is an error.
    """
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="veilspan-"))
        found = sc.getCheckpointDir()
    return found.rstrip("/")


def scratch(spark: SparkSession, label: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark)}/veilspan/{label}-{uuid.uuid4().hex}"


def staged(df: DataFrame, label: str, paths: list[str] | None = None) -> DataFrame:
    """``df`` written to the shared folder and read back: later steps don't depend on its lineage. ``paths`` takes note of the path."""
    spark = df.sparkSession
    path = scratch(spark, label)
    df.write.parquet(path)
    if paths is not None:
        paths.append(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, paths: list[str]) -> None:
    """Deletes staged tables on which nothing depends any more."""
    jvm = spark.sparkContext._jvm
    for path in paths:
        place = jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
    paths.clear()


@contextlib.contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Within it, a query's shuffle files go when it has ended (else when the driver's garbage is collected). Only for queries that run once, as those of ``staged`` do."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


#: Keys that are joined by broadcast, as each of them has many rows; so many at most, at every size.
MOST_HEAVY, LEAST_HEAVY = 10_000, 1_000


def heavy_keys(df: DataFrame, key: str) -> DataFrame | None:
    """The ``MOST_HEAVY`` most frequent values of ``key`` among those with at least ``LEAST_HEAVY`` rows; None without any."""
    counts = df.where(F.col(key).isNotNull()).groupBy(key).count()
    many = counts.where(F.col("count") >= LEAST_HEAVY)
    found = many.orderBy(F.desc("count"), key).limit(MOST_HEAVY)
    rows = [(row[0],) for row in found.select(key).collect()]
    return df.sparkSession.createDataFrame(rows, df.select(key).schema) if rows else None


def join_one(left: DataFrame, right: DataFrame, key: str, heavy: DataFrame | str | None = "ask") -> DataFrame:
    """``left`` joined with ``right``, which has at most one row of bounded size for each key. Heavy keys of ``left`` meet a broadcast of their rows, so none fills a task."""
    if isinstance(heavy, str):
        heavy = heavy_keys(left, key)
    if heavy is None:
        return left.join(right, key)
    rest = left.join(F.broadcast(heavy), key, "left_anti").join(right, key)
    few = right.join(F.broadcast(heavy), key, "left_semi")
    return rest.unionByName(left.join(F.broadcast(few), key))


def hash_remainder(id_col: Column, modulus: int) -> Column:
    """crc32 of an id as text, modulo; a null id counts as the empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % modulus


def groups_by_size(sizes: Iterable[int], most: int) -> Iterator[tuple[int, int]]:
    """Half-open ranges of consecutive rows of about ``most`` units each; a larger row stands alone."""
    start = total = at = 0
    for at, size in enumerate(sizes):
        if total and total + size > most:
            yield start, at
            start, total = at, 0
        total += size
    if sizes:
        yield start, at + 1


def map_batches(df: DataFrame, function: Callable[[pa.RecordBatch], Iterable[pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` for a function from one batch to some batches."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from function(batch)

    return df.mapInArrow(over, schema)


_RESIDENT: dict[object, object] = {}


def resident(key: object, load: Callable[[], object]) -> object:
    """A worker's model: loaded once for a key, and given up for the next one, so a worker that serves many stages holds one at a time."""
    if key not in _RESIDENT:
        release()
        _RESIDENT[key] = load()
    return _RESIDENT[key]


def release() -> None:
    """Gives up a worker's resident model, for a step that has none: workers serve one stage after the other, and keep what they hold."""
    if _RESIDENT:
        _RESIDENT.clear()
        gc.collect()
        with contextlib.suppress(OSError, AttributeError):  # where the C library has no such function
            ctypes.CDLL(None).malloc_trim(0)
