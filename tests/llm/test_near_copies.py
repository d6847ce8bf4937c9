import random

import numpy as np
import pyarrow as pa

import corpus_pipeline
from veilspan.llm import base
from veilspan.llm import near_copies as N


def plain_set(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(len(words) - 4, 1))} if words else set()


def plain_kept(rows):
    sets, root = [(i, plain_set(t)) for i, t in rows], {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if 5 * len(a & b) >= 4 * len(a | b):
                lo, hi = sorted((find(i), find(j)))
                root[hi] = lo
    return sorted(i for i in root if find(i) == i)


def texts():
    draw = random.Random(3)
    words = [f"w{k}" for k in range(3000)]
    passage = [draw.choice(words) for _ in range(30)]
    out = ["", None, "one", "one two", "ONE  two", "one two three four five"]
    for k in range(70):
        base = [draw.choice(words) for _ in range(draw.randint(6, 250))] + (passage if k % 2 else [])
        out.append(" ".join(base))
        for _ in range(draw.randint(0, 3)):
            other = list(base)
            for _ in range(draw.randint(0, max(1, len(base) // 20))):
                other[draw.randrange(len(other))] = draw.choice(words)
            out.append(" ".join(other))
    large = [draw.choice(words) for _ in range(150)]
    for _ in range(60):
        other = list(large)
        for _ in range(draw.randint(0, 6)):
            other[draw.randrange(len(other))] = draw.choice(words)
        out.append(" ".join(other))
    draw.shuffle(out)
    return list(enumerate(out))


def test_stage_against_brute_force(spark):
    rows = texts()
    docs = spark.createDataFrame([(i, t, "en", "a", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect())
    assert kept == plain_kept(rows)


def test_prefixes():
    for n in range(1, 200):
        # A similar set misses at most n - ceil(4 n / 5) of these, so one of so many and one more is shared.
        assert N.prefix(n) == n - (4 * n + 4) // 5 + 1


def test_sketches_discard_no_similar_pair():
    draw = np.random.default_rng(8)
    seen = [0, 0]
    for k in range(2000):
        shared = draw.integers(0, 1 << 63, int(draw.integers(1, 300)), dtype=np.uint64)
        a, b = (np.unique(np.append(shared, draw.integers(0, 1 << 63, int(draw.integers(0, 1 + (5 if k % 2 else 1) * len(shared) // (1 if k % 2 else 4))), dtype=np.uint64))) for _ in range(2))
        can = len(N.Sketches(np.array([len(a), len(b)]), [N.parity(a), N.parity(b)]).close(0, np.array([1]))) > 0
        assert can or not N.similar(a, b)
        seen[can] += 1
    assert min(seen) > 100


def test_keys_of_similar_sets_meet():
    """Sets just similar enough, with any share of common shingles, share a key."""
    draw = np.random.default_rng(9)
    for _ in range(500):
        n = int(draw.integers(1, 400))
        whole = np.unique(draw.integers(0, 1 << 63, n, dtype=np.uint64))
        cut = draw.permutation(len(whole))[: len(whole) // 5]
        part = np.delete(whole, cut)
        common = np.sort(draw.permutation(whole)[: int(draw.integers(0, len(whole) + 1))])
        assert N.similar(whole, part)
        assert {x for keys in N.keys_of(whole, common) for x in keys.tolist()} & {x for keys in N.keys_of(part, common) for x in keys.tolist()}


def test_common_shingles_against_brute_force(spark, monkeypatch):
    """Groups whose shingles are all common meet by broadcast and in cells of few rows."""
    for name, value in (("OFTEN", 5), ("CELL", 7), ("FIRST", 28)):
        monkeypatch.setattr(N, name, value)
    rows = texts()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = N.near_copies(docs).select("doc_id", "component_id").collect()
    assert sorted(r.doc_id for r in found if r.doc_id == r.component_id) == plain_kept(rows)


def test_steps_give_up_the_model_of_the_stage_before():
    """A worker serves one stage after the other; what the rules' tokenisers hold isn't kept beside the sets."""
    base._RESIDENT["model"] = object()
    found = list(N._sets(pa.RecordBatch.from_pydict({"doc_id": [1], "text": ["one two three four five six"], "row": ["x"]})))
    assert found[0].num_rows == 1 and not base._RESIDENT
