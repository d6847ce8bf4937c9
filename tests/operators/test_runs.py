"""Run configurations."""

from __future__ import annotations

import pytest

from veilspan.operators.runs import faults, parse_run

TEXT = """
name = "first"
stage = "dev"
types = ["email"]
compare = [["rules", "model-s2"]]
[[datasets]]
id = "letters"
split = "dev"
[systems.rules]
kind = "rules"
[systems.model]
threshold = 0.5
seeds = [1, 2]
"""
KNOWN = {"letters": ["dev", "test"]}


def test_a_right_one(spark):
    run = parse_run(spark, TEXT, KNOWN, ["email"])
    assert run.settings["resamples"] == 1000 and run.settings["seed"] == 0 and run.settings["name"] == "first"
    assert [tuple(r) for r in run.datasets.collect()] == [("letters", "dev")]
    assert sorted((r.system, r.base, r.seed or 0) for r in run.systems.collect()) == [("model", "model", 0), ("model-s1", "model", 1), ("model-s2", "model", 2), ("rules", "rules", 0)]
    assert [tuple(r) for r in run.compare.collect()] == [("rules", "model-s2")]


def test_all_faults_are_named(spark):
    raw = {"nome": 1, "stage": "late", "resamples": 0, "datasets": [{"id": "x"}, {"id": "letters", "split": "test"}, {"id": "letters", "split": "y"}], "systems": {"a": {"seeds": [1]}, "a-s1": {}}, "compare": [["a", "b"]], "types": ["z"]}
    found = faults(raw, KNOWN, ["email"])
    for part in ("unknown key 'nome'", "no name", "stage 'late'", "resamples", "unknown dataset 'x'", "final stage", "no split 'y'", "'a-s1' is named twice", "with 'b'", "unknown type 'z'"):
        assert any(part in x for x in found), part
    assert len(found) == 10 and "no datasets" in faults({}, KNOWN, []) and "no systems" in faults({}, KNOWN, [])
    with pytest.raises(ValueError, match="no name; no datasets; no systems"):
        parse_run(spark, "", KNOWN, [])
