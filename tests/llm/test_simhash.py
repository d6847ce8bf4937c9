import random

import numpy as np
import xxhash

from pyspark.sql import functions as F

from veilspan.llm import near_copies
from veilspan.llm import simhash as S


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(len(words) - 2, 1))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(fps):
    """Smallest id by brute force; fps: list of (id, fp)."""
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i][1] ^ fps[j][1]).bit_count() <= 2:
                parent[find(i)] = find(j)
    least = {}
    for i, (k, _) in enumerate(fps):
        least[find(i)] = min(least.get(find(i), k), k)
    return [least[find(i)] for i in range(len(fps))]


def test_fingerprints():
    draw = random.Random(2)
    texts = [" ".join(draw.choice(["A", "b", "Cé", "d.", "日"]) for _ in range(draw.randint(0, 60))) for _ in range(200)] + ["", "one", "ONE two", None, "\x0b\x1c"]
    assert [S.fingerprint(t) for t in texts] == [plain_fingerprint(t) for t in texts]


def test_pairs_within_the_radius_meet():
    tables = S.PivotTables()
    draw = random.Random(4)
    for _ in range(300):
        f = draw.getrandbits(64)
        g = f ^ (1 << draw.randrange(64)) ^ (1 << draw.randrange(64))
        keys = [k.tolist() for k in tables.table_keys(np.array([f, g], np.uint64))]
        assert any(a == b for a, b in keys)
        at = tables.coordinates(np.array([f, g], np.uint64))
        assert np.abs(at[0] - at[1]).max() <= S.RADIUS


def _linked(spark, split):
    draw = random.Random(6)
    fps = []
    for _ in range(30):
        f = draw.getrandbits(64)
        for _ in range(draw.randint(1, 12)):
            fps.append(f)
            f ^= (1 << draw.randrange(64)) | (1 << draw.randrange(64))
    hub = draw.getrandbits(64)
    fps += [hub ^ (1 << b) for b in range(64)] + [hub]
    rows = [(i, f if f < 1 << 63 else f - (1 << 64)) for i, f in enumerate(fps)]
    distinct = spark.createDataFrame(rows, "doc_id long, fp long").select("fp").distinct()
    roots = {r.node & (2**64 - 1): r.root for r in S.components(S.links(distinct, split)).collect()}
    want = plain_components(list(enumerate(fps)))
    groups = {}
    for f, w in zip(fps, want, strict=True):
        groups.setdefault(w, set()).add(roots.get(f, ("alone", f)))
    assert all(len(g) == 1 for g in groups.values())
    assert len({next(iter(g)) for g in groups.values()}) == len(groups)


def test_links_and_components(spark):
    _linked(spark, S.SPLIT)


def test_large_keys_are_cut(spark):
    _linked(spark, 2)


def test_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 500)], "a long, b long")
    found = S.components(edges).collect()
    assert {r.root for r in found} == {0} and len(found) == 201
    assert S.components(edges.limit(0)).collect() == []


def test_table(spark, awkward, extra, empty):
    rows = awkward.collect()
    found = S.near_duplicates(extra).collect()
    assert sorted((r.doc_id or 0, r.fp & (2**64 - 1)) for r in found) == sorted((r.doc_id or 0, plain_fingerprint(r.text)) for r in rows)
    want = dict(zip([r.doc_id for r in rows], plain_components([(r.doc_id if r.doc_id is not None else 10**9, plain_fingerprint(r.text)) for r in rows]), strict=True))
    assert all(r.component_id == (want[r.doc_id] if want[r.doc_id] < 10**9 else None) for r in found)
    assert S.near_duplicates(empty).collect() == []


def test_keep_one_of_repeated_ids(spark, awkward):
    """Ids that stand with several texts, copies of rows, copies without an id, clashing and repeated column names."""
    own = near_copies.near_copies
    rows = [(3, "B b"), (5, "A a"), (5, "B b"), (9, "A a"), (5, "A a"), (None, "A a"), (None, "C"), (None, "C"), (None, None), (7, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = S.keep_one(docs.select("doc_id", "text", F.lit(1).alias("key"), F.lit(2).alias("row"), F.lit(3).alias("Text"), F.lit(4).alias("key")), own)
    assert kept.columns == ["doc_id", "text", "key", "row", "Text", "key"]
    assert sorted((str(r[0]), r[1]) for r in kept.collect()) == [("3", "B b"), ("5", "A a"), ("7", ""), ("None", "C")]
    kept = S.keep_one(awkward, own)
    assert kept.columns == awkward.columns
    ids = [r.doc_id for r in kept.collect()]
    assert len(ids) == len(set(ids)) and None in ids and 1 in ids
