"""The catalogue of models and data: what is needed, what is stored, and whether it is what it should be."""

from __future__ import annotations

import json
import os
import tempfile
import tomllib
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ENTRY = "id string, version string, threshold double, requires array<string>, files array<struct<path: string, size: bigint, sha256: string>>"


def load_catalog(spark: SparkSession, path: str) -> DataFrame:
    """(id, version, threshold, requires, files): entries of a TOML or JSON file on the driver."""
    raw = Path(path).read_bytes()
    entries = tomllib.loads(raw.decode())["resource"] if path.endswith(".toml") else json.loads(raw)
    rows = [(e["id"], e.get("version"), e.get("threshold"), e.get("requires", []), [(f["path"], f.get("size"), f.get("sha256")) for f in e.get("files", [])]) for e in entries]
    return spark.createDataFrame(rows, ENTRY)


def with_requirements(catalog: DataFrame, resource: str, most_depth: int = 50) -> DataFrame:
    """(id, depth): a resource and all that it needs, the deepest last; deeper first is the order to load. A circle raises an error."""
    edges = catalog.select("id", F.explode("requires").alias("needs"))
    level = catalog.where(F.col("id") == resource).select("id", F.lit(0).alias("depth"))
    out = level
    for depth in range(1, most_depth + 1):
        level = level.select("id").join(edges, "id").select(F.col("needs").alias("id")).distinct().withColumn("depth", F.lit(depth))
        if level.isEmpty():
            return out.groupBy("id").agg(F.max("depth").alias("depth"))
        out = out.unionByName(level)
    raise ValueError("the catalogue's requirements go in a circle")


def missing_resources(needed: DataFrame, stored: DataFrame) -> DataFrame:
    return needed.join(stored.select("id"), "id", "left_anti")


def wrong_files(catalog: DataFrame, stored: DataFrame) -> DataFrame:
    """(id, path, reason): catalogue files that aren't stored, or whose size or checksum differs from stored files (path, content)."""
    wanted = catalog.select("id", F.explode("files").alias("f")).select("id", "f.path", "f.size", "f.sha256")
    there = stored.select("path", F.length("content").cast("bigint").alias("_size"), F.sha2("content", 256).alias("_sha"))
    joined = wanted.join(there, "path", "left")
    reason = F.when(F.col("_size").isNull(), "missing").when(F.col("size") != F.col("_size"), "size").when(F.col("sha256") != F.col("_sha"), "checksum")
    return joined.select("id", "path", reason.alias("reason")).where("reason IS NOT NULL")


def union_members(catalog: DataFrame, resource: str) -> DataFrame:
    """(id): members of a union model. Running it fails if a member is a union itself."""
    members = catalog.where(F.col("id") == resource).select(F.explode("requires").alias("id"))
    checked = members.join(catalog.select("id", F.size("requires").alias("_n"), F.col("id").startswith("union").alias("_u")), "id")
    return checked.select(F.when(F.col("_u"), F.raise_error("a union can't hold a union").cast("string")).otherwise(F.col("id")).alias("id"))


def read_settings(path: str) -> dict:
    try:
        return json.loads(Path(path).read_text(encoding="utf-8"))
    except FileNotFoundError:
        return {}


def write_setting(path: str, key: str, value: object) -> None:
    """Sets one key of a JSON file on the driver; the file is replaced as a whole or not at all."""
    whole = read_settings(path) | {key: value}
    folder = os.path.dirname(os.path.abspath(path))
    with tempfile.NamedTemporaryFile("w", dir=folder, delete=False, encoding="utf-8") as out:
        json.dump(whole, out)
    os.replace(out.name, path)


def ordered_runs(runs: DataFrame) -> DataFrame:
    """Runs (version, created) in the order of their versions' numbers."""
    from veilspan.operators.benchmark import version_key

    return runs.orderBy(version_key(F.col("version")), "created")
