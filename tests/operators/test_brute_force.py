"""Set forms against plain loops on random spans."""

import random

import pytest
from pyspark.sql import functions as F

from veilspan.operators import intervals, merge, metrics, propagate, redact
from veilspan.operators.windows import nested_entities, word_windows
from veilspan.schema import PRIORITY

TYPES = ["url", "email", "person", "other", "strange"]
SPANS = "doc_id long, page_index int, surface_id string, ordinal long, type string, start int, end int, score double"


def made(seed, docs=60, most=9, reach=30):
    draw = random.Random(seed)
    rows = []
    for d in range(docs):
        for i in range(draw.randint(0, most)):
            a = draw.randrange(reach)
            rows.append((d, draw.choice([0, 1, None]), draw.choice([None, None, "link:doc:1"]), i, draw.choice(TYPES), a, a + draw.randint(1, 12), draw.choice([None, 0.1, 0.9])))
    return rows


def greedy(rows):
    rank = {t: i for i, t in enumerate(PRIORITY)}
    kept = []
    for r in sorted(rows, key=lambda r: (rank.get(r[4], len(rank)), r[5] - r[6], -(r[7] if r[7] is not None else 1.0), r[5], r[3])):
        if not any(k[:3] == r[:3] and k[5] <= r[5] and r[6] <= k[6] for k in kept):
            kept.append(r)
    return sorted((r[0], r[3]) for r in kept)


@pytest.mark.parametrize("cell", [512, 4])
def test_merge(spark, monkeypatch, cell):
    monkeypatch.setattr(merge, "CELL", cell)
    rows = made(1)
    found = merge.merge_entities(spark.createDataFrame(rows, SPANS))
    assert sorted((r.doc_id, r.ordinal) for r in found.collect()) == greedy(rows)


def test_merge_in_an_array(spark):
    rows = [(d, 0, None, i, t, a, b, None) for d, _, _, i, t, a, b, _ in made(2)]
    arrays = spark.createDataFrame(rows, SPANS).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("ordinal", "type", "start", "end"))).alias("s"))
    found = arrays.select("doc_id", F.explode(merge.merged_spans(F.col("s"))).alias("s")).select("doc_id", "s.ordinal")
    assert sorted((r.doc_id, r.ordinal) for r in found.collect()) == greedy(rows)


def test_regions_stay(spark):
    rows = [(1, 0, None, 0, "region", None, None, None), (1, 0, None, 1, "email", 0, 5, None)]
    assert merge.merge_entities(spark.createDataFrame(rows, SPANS)).count() == 2


def test_outermost(spark):
    rows = made(3)
    want = []
    for r in sorted(set((x[0], x[1], x[2], x[4], x[5], x[6]) for x in rows), key=lambda x: (x[4], -x[5])):
        if not any(k[:4] == r[:4] and k[4] <= r[4] and r[5] <= k[5] for k in want):
            want.append(r)
    found = merge.outermost(spark.createDataFrame(rows, SPANS))
    assert sorted(map(repr, ((r.doc_id, r.page_index, r.surface_id, r.type, r.start, r.end) for r in found.collect()))) == sorted(map(repr, want))


def test_union_and_intersection(spark):
    rows = [(d, a, b) for d, _, _, _, _, a, b, _ in made(4)]
    ranges = spark.createDataFrame(rows, "doc_id long, start int, end int")
    found = intervals.union_ranges(ranges, ["doc_id"])
    cells = {(d, c) for d, a, b in rows for c in range(a, b)}
    got = found.collect()
    assert {(r.doc_id, c) for r in got for c in range(r.start, r.end)} == cells
    assert all((r.doc_id, r.start - 1) not in cells and (r.doc_id, r.end) not in cells for r in got)
    in_array = ranges.groupBy("doc_id").agg(intervals.array_union(F.collect_list(F.struct("start", "end"))).alias("u")).select("doc_id", F.explode("u").alias("u")).select("doc_id", "u.*")
    assert sorted(map(tuple, in_array.collect())) == sorted(map(tuple, got))
    other = intervals.union_ranges(spark.createDataFrame([(d, a, b) for d, _, _, _, _, a, b, _ in made(5)], "doc_id long, start int, end int"), ["doc_id"])
    both = {(r.doc_id, c) for r in intervals.intersect_ranges(found, other, ["doc_id"]).collect() for c in range(r.start, r.end)}
    assert both == cells & {(r.doc_id, c) for r in other.collect() for c in range(r.start, r.end)}


def plain_propagation(pages, entities):
    import re

    types = {}
    for e in entities:
        if e["review"] != "rejected" and e["text"]:
            types.setdefault(e["text"], e["type"])
    out = []
    for page in pages:
        here = [e for e in entities if e["page_index"] == page["page_index"]]
        taken = [(e["start"], e["end"], e["review"] != "rejected") for e in here]
        for text in sorted(types, key=len, reverse=True):
            pattern = r"(?<!\w)" + r"\s+".join(map(re.escape, text.split())) + r"(?!\w)"
            for m in re.finditer(pattern, page["text"]):
                if any((a <= m.start() and m.end() <= b) or (not ok and m.start() < b and a < m.end()) for a, b, ok in taken):
                    continue
                taken.append((m.start(), m.end(), True))
                out.append((page["doc_id"], page["page_index"], types[text], m.start(), m.end(), m[0]))
    return out


def test_propagation(spark):
    draw = random.Random(7)
    pages, entities, want = [], [], []
    for d in range(60):
        own_pages, own = [], []
        for p in range(2):
            own_pages.append({"doc_id": d, "page_index": p, "text": "".join(draw.choice(["ab", "b", "ab b", "c"]) + draw.choice([" ", "\n", "  ", ", "]) for _ in range(12))})
        for i in range(draw.randint(1, 4)):
            page = draw.choice(own_pages)
            words = list(__import__("re").finditer(r"\w+(?:\s\w+)?", page["text"]))
            m = draw.choice(words)
            own.append({"doc_id": d, "page_index": page["page_index"], "ordinal": i, "type": draw.choice(TYPES), "start": m.start(), "end": m.end(), "text": m[0], "review": draw.choice(["pending", "confirmed", "rejected"])})
        pages += own_pages
        entities += own
        want += plain_propagation(own_pages, own)
    found = propagate.propagate_occurrences(
        spark.createDataFrame([tuple(p.values()) for p in pages], "doc_id long, page_index int, text string"),
        spark.createDataFrame([tuple(e.values()) for e in entities], "doc_id long, page_index int, ordinal long, type string, start int, end int, text string, review string"),
    )
    assert sorted((r.doc_id, r.page_index, r.type, r.start, r.end, r.text) for r in found.collect()) == sorted(want)


def test_redaction(spark):
    draw = random.Random(9)
    rows, spans, want = [], [], []
    for d in range(80):
        text = "".join(draw.choice("abc  \n") for _ in range(40))
        own = sorted({(a, min(40, a + draw.randint(1, 8)), draw.choice(TYPES)) for a in (draw.randrange(39) for _ in range(draw.randint(0, 5)))}, key=str)
        rows.append((d, 0, text))
        spans += [(d, 0, i, t, a, b, text[a:b], "pending") for i, (a, b, t) in enumerate(own)]
        words = [m.span() for m in __import__("re").finditer(r"\S+", text)]
        wide = []
        for a, b, t in own:
            hit = [w for w in words if w[0] < b and a < w[1]]
            wide.append((min([a, *(w[0] for w in hit)]), max([b, *(w[1] for w in hit)]), f"[{t.upper()}]"))
        merged = []
        for a, b, label in sorted(wide, key=lambda s: (s[0], -s[1], s[2])):
            if merged and a < merged[-1][1]:
                merged[-1] = (merged[-1][0], max(merged[-1][1], b), merged[-1][2])
            else:
                merged.append((a, b, label))
        out, at = "", 0
        for a, b, label in merged:
            out, at = out + text[at:a] + label, b
        want.append((d, out + text[at:]))
    pages = spark.createDataFrame(rows, "doc_id long, page_index int, text string")
    entities = spark.createDataFrame(spans, "doc_id long, page_index int, ordinal long, type string, start int, end int, text string, review string")
    assert sorted((r.doc_id, r.text) for r in redact.redact_text(pages, entities).collect()) == want


def test_percentiles_and_draws(spark):
    docs = spark.createDataFrame([(i * 3,) for i in range(17)], "doc_id long")
    drawn = metrics.draws(docs, 9, 4).collect()
    sums = {}
    for r in drawn:
        sums[r.draw] = sums.get(r.draw, 0) + r.weight
    assert sums == {i: 17 for i in range(9)}
    assert metrics.draws(docs.limit(0), 9, 4).collect() == []


def test_word_windows():
    assert word_windows([], 5) == []
    for seed in range(50):
        draw = random.Random(seed)
        sizes = [draw.randint(1, 7) for _ in range(draw.randint(1, 30))]
        ranges = word_windows(sizes, 10, 4)
        assert {i for a, b in ranges for i in range(a, b)} == set(range(len(sizes)))
        assert all(sum(sizes[a:b]) <= 10 or b == a + 1 for a, b in ranges)
        assert all(a2 > a1 and sum(sizes[a2:b1]) <= 4 for (a1, b1), (a2, _) in zip(ranges, ranges[1:], strict=False))


def test_nested_labels():
    labels = [[("B-P", 0.9), ("B-pf", 0.8)], [("I-P", 0.7), ("B-ps", 0.6)], [], [("I-A", 0.5)]]
    assert nested_entities(labels) == [("P", 0, 1, 0.7), ("pf", 0, 0, 0.8), ("ps", 1, 1, 0.6), ("A", 3, 3, 0.5)]
