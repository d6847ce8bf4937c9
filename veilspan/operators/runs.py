"""Run configurations: which systems run over which splits, checked before anything starts.

A configuration is TOML (or a mapping of the same shape). All that is wrong with it is gathered as rows and reported together; a right one becomes relations that
queries join: datasets, systems with a row for each seed, and comparisons.
"""

from __future__ import annotations

import tomllib
from collections.abc import Mapping
from typing import Any, NamedTuple

from pyspark.sql import DataFrame, SparkSession

# What a configuration may hold, and its stages.
KEYS = ["name", "description", "stage", "seed", "resamples", "datasets", "systems", "types", "compare"]
STAGES = ["dev", "final"]
DEFAULTS = {"description": "", "stage": "dev", "seed": 0, "resamples": 1000}
HELD_OUT_SPLIT = "test"


class Run(NamedTuple):
    """What a configuration says: its settings, and the relations (id, split), (system, base, seed, options) and (baseline, candidate)."""

    settings: dict[str, Any]
    datasets: DataFrame
    systems: DataFrame
    compare: DataFrame


def faults(raw: Mapping[str, Any], known_datasets: Mapping[str, list[str]], known_types: list[str]) -> list[str]:
    """Everything that is wrong with a configuration; none for a right one."""
    out = [f"unknown key {key!r}" for key in sorted(set(raw) - set(KEYS))]
    settings = DEFAULTS | raw
    if not raw.get("name"):
        out.append("no name")
    if settings["stage"] not in STAGES:
        out.append(f"stage {settings['stage']!r} is none of {STAGES}")
    if not isinstance(settings["resamples"], int) or settings["resamples"] < 1:
        out.append("resamples must be positive")
    for entry in raw.get("datasets", []):
        splits = known_datasets.get(entry.get("id"))
        if splits is None:
            out.append(f"unknown dataset {entry.get('id')!r}")
        elif entry.get("split") not in splits:
            out.append(f"dataset {entry['id']!r} has no split {entry.get('split')!r}")
        elif entry["split"] == HELD_OUT_SPLIT and settings["stage"] != "final":
            out.append(f"{HELD_OUT_SPLIT!r} of {entry['id']!r} is for the final stage")
    if not raw.get("datasets"):
        out.append("no datasets")
    if not raw.get("systems"):
        out.append("no systems")
    names = [name for name, *_ in _members(raw)]
    out += [f"system {name!r} is named twice" for name in sorted({x for x in names if names.count(x) > 1})]
    out += [f"comparison with {name!r}, which isn't configured" for pair in raw.get("compare", []) for name in pair if name not in names]
    out += [f"unknown type {kind!r}" for kind in raw.get("types") or [] if kind not in known_types]
    return out


def _members(raw: Mapping[str, Any]) -> list[tuple[str, str, int | None, dict[str, str]]]:
    """(system, base, seed, options): each system, and each of its seeds as a system of its own."""
    out = []
    for name, table in raw.get("systems", {}).items():
        options = {key: str(value) for key, value in table.items() if key != "seeds"}
        out.append((name, name, None, options))
        out += [(f"{name}-s{seed}", name, seed, options) for seed in table.get("seeds", [])]
    return out


def parse_run(spark: SparkSession, raw: str | Mapping[str, Any], known_datasets: Mapping[str, list[str]], known_types: list[str]) -> Run:
    """A configuration's settings and relations; a ``ValueError`` names all that is wrong with it."""
    raw = tomllib.loads(raw) if isinstance(raw, str) else raw
    if wrong := faults(raw, known_datasets, known_types):
        raise ValueError("; ".join(wrong))
    settings = DEFAULTS | {key: value for key, value in raw.items() if key not in ("datasets", "systems", "compare")}
    datasets = spark.createDataFrame([(x["id"], x["split"]) for x in raw["datasets"]], "id string, split string")
    systems = spark.createDataFrame(_members(raw), "system string, base string, seed int, options map<string, string>")
    return Run(settings, datasets, systems, spark.createDataFrame([tuple(x) for x in raw.get("compare", [])], "baseline string, candidate string"))
