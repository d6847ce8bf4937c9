"""What a redaction does to a file, as rows, and their hand-over to a rewriter of the file's format.

Which boxes are painted and which hidden strings go is data: it can be counted, checked against leaks and joined before any file is touched. Rewriting itself
needs a library of the format, so it is a function of a file's bytes and its actions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ACTION = "struct<action: string, page_index: int, box: array<double>, target: string>"

#: From a file's bytes and its actions, in order, to the redacted file's bytes.
Rewrite = Callable[[bytes, list[dict]], bytes]


def redaction_plan(boxes: DataFrame, entities: DataFrame, surfaces: DataFrame) -> DataFrame:
    """(doc_id, action, page_index, box, target): ``paint`` for each box (doc_id, page_index, entity_id, box) of a finding that review hasn't rejected, and
    ``clear`` for each hidden string (doc_id, page_index, surface_id), whatever it holds. Equal boxes of a page are painted once, under the smallest finding's name."""
    wanted = entities.where(F.coalesce(F.col("review"), F.lit("pending")) != "rejected").select("doc_id", "entity_id").distinct()
    own = boxes.select("doc_id", F.col("page_index").cast("int").alias("page_index"), "entity_id", F.col("box").cast("array<double>").alias("box"))
    painted = own.join(wanted, ["doc_id", "entity_id"], "left_semi").groupBy("doc_id", "page_index", "box").agg(F.min("entity_id").alias("target"))
    cleared = surfaces.select("doc_id", F.lit("clear").alias("action"), F.col("page_index").cast("int").alias("page_index"), F.lit(None).cast("array<double>").alias("box"), F.col("surface_id").alias("target")).distinct()
    return painted.select("doc_id", F.lit("paint").alias("action"), "page_index", "box", "target").unionByName(cleared)


def unplanned(plan: DataFrame, boxes: DataFrame, entities: DataFrame) -> DataFrame:
    """(doc_id, entity_id): findings to redact that no box of the plan stands for, so that nobody takes a plan for whole that isn't."""
    wanted = entities.where((F.coalesce(F.col("review"), F.lit("pending")) != "rejected") & F.col("surface_id").isNull()).select("doc_id", "entity_id").distinct()
    own = boxes.select("doc_id", F.col("page_index").cast("int").alias("page_index"), "entity_id", F.col("box").cast("array<double>").alias("box"))
    there = own.join(plan.where("action = 'paint'").select("doc_id", "page_index", "box"), ["doc_id", "page_index", "box"], "left_semi").select("doc_id", "entity_id").distinct()
    return wanted.join(there, ["doc_id", "entity_id"], "left_anti")


def rewritten(files: DataFrame, plan: DataFrame, rewrite: Rewrite) -> DataFrame:
    """(doc_id, content): each file (doc_id, content) as ``rewrite`` makes it from its actions, by page, kind and target. A file without actions goes through it too, with none."""
    named = F.struct("action", "page_index", "box", "target").cast(ACTION)
    actions = plan.groupBy("doc_id").agg(F.collect_list(named).alias("actions"))
    ordered = F.array_sort("actions", lambda a, b: F.when(_key(a) < _key(b), -1).when(_key(a) > _key(b), 1).otherwise(0))
    joined = files.select("doc_id", "content").join(actions, "doc_id", "left").select("doc_id", "content", F.coalesce(ordered, F.array().cast(f"array<{ACTION}>")).alias("actions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):  # one file at a time, as files are large
                row = batch.slice(i, 1)
                content, own = row.column(1)[0].as_py(), row.column(2)[0].as_py()
                yield pa.RecordBatch.from_arrays([row.column(0), pa.array([rewrite(content or b"", own)], pa.binary())], names=["doc_id", "content"])

    return joined.mapInArrow(run, f"doc_id {dict(files.dtypes)['doc_id']}, content binary")


def _key(x):
    return F.concat_ws("|", F.lpad(F.coalesce(x["page_index"].cast("string"), F.lit("")), 10, "0"), x["action"], F.coalesce(x["target"], F.lit("")), F.coalesce(x["box"].cast("string"), F.lit("")))
