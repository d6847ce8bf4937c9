"""Redaction plans and their hand-over."""

from __future__ import annotations

from veilspan.operators.redact_plan import redaction_plan, rewritten, unplanned


def test_plan_and_rewriting(spark):
    boxes = spark.createDataFrame([(1, 0, "a", [0.0, 0.0, 5.0, 5.0]), (1, 0, "b", [0.0, 0.0, 5.0, 5.0]), (1, 1, "c", [1.0, 1.0, 2.0, 2.0]), (2, 0, "d", [9.0, 9.0, 9.5, 9.5])], "doc_id int, page_index int, entity_id string, box array<double>")
    entities = spark.createDataFrame([(1, "a", "pending", None), (1, "b", "confirmed", None), (1, "c", "rejected", None), (2, "d", None, None), (2, "e", "pending", None), (2, "f", "pending", "meta:x")], "doc_id int, entity_id string, review string, surface_id string")
    surfaces = spark.createDataFrame([(1, None, "meta:title"), (1, None, "meta:title"), (3, 2, "note:1")], "doc_id int, page_index int, surface_id string")
    plan = redaction_plan(boxes, entities, surfaces)
    assert sorted((r.doc_id, r.action, r.target) for r in plan.collect()) == [(1, "clear", "meta:title"), (1, "paint", "a"), (2, "paint", "d"), (3, "clear", "note:1")]
    assert [tuple(r) for r in unplanned(plan, boxes, entities).collect()] == [(2, "e")]
    files = spark.createDataFrame([(1, bytearray(b"one")), (3, bytearray(b"three")), (4, bytearray(b"four")), (5, None)], "doc_id int, content binary")
    found = rewritten(files, plan, lambda content, actions: content + b"".join(b" %s:%s" % (a["action"].encode(), a["target"].encode()) for a in actions))
    assert {r.doc_id: bytes(r.content) for r in found.collect()} == {1: b"one clear:meta:title paint:a", 3: b"three clear:note:1", 4: b"four", 5: b""}
