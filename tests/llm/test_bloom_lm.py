import math
import time
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

from veilspan.llm import base
from veilspan.llm import bloom_lm as B


def plain(rows):
    """Exact counts and base scores by hand: {index: (n_tokens, n_known, base)} and N."""
    words = [(r.text or "").encode().lower().split() + [b""] for r in rows]
    held = [zlib.crc32(b"" if r.doc_id is None else str(r.doc_id).encode()) % 5 == 1 for r in rows]
    counts = Counter(w for own, h in zip(words, held, strict=True) if not h for w in own)
    n, v = sum(counts.values()), len(counts)
    total = n + 0.5 * (v + 1)
    return n, [(h, len(own), sum(counts[w] > 0 for w in own), sum(math.log10((counts[w] + 0.5) / total) for w in own)) for own, h in zip(words, held, strict=True)]


def check(found, rows):
    n, want = plain(rows)
    assert all(r.train_tokens == n for r in found)
    key = lambda x: (x[0], x[1], x[2], round(x[3], 6))
    assert sorted(key((r.held_out, r.n_tokens, r.n_known, r.base_score)) for r in found) == sorted(map(key, want))
    assert all(math.isfinite(r.score) and r.score < 0 for r in found)


def test_awkward_rows(spark, awkward, extra, empty):
    check(B.score(extra).collect(), awkward.collect())
    assert B.score(empty).collect() == []


def test_words_beyond_the_broadcast(spark, monkeypatch):
    monkeypatch.setattr(B, "HEAVY", 3)
    draw = np.random.default_rng(1)
    rows = spark.createDataFrame([(i, " ".join(f"w{int(x)}" for x in draw.zipf(1.5, 60) % 400)) for i in range(120)], "doc_id long, text string")
    check(B.score(rows.repartition(5)).collect(), rows.collect())


def plain_scores(rows):
    """The model's scores by hand: every count of words and pairs, as its level's value; no filter."""
    words = [(r.text or "").encode().lower().split() + [b""] for r in rows]
    train = [w for w, r in zip(words, rows, strict=True) if zlib.crc32(b"" if r.doc_id is None else str(r.doc_id).encode()) % 5 != 1]
    quantised = lambda n: float(B.VALUES[sum(n >= b for b in B.BOUNDS.tolist())])
    count = Counter(w for own in train for w in own)
    pairs = Counter(p for own in train for p in zip([None, *own], own))
    total = sum(count.values()) + 0.5 * (len(count) + 1)
    mass = Counter()
    for (first, _), n in pairs.items():
        mass[first] += quantised(n) - B.DISCOUNT
    mass = {w: quantised(math.floor(x + 0.5)) for w, x in mass.items()}
    out = []
    for own in words:
        score = 0.0
        for first, w in zip([None, *own], own):
            m = mass.get(first, 0.0)
            below = max(len(train) if first is None else quantised(count[first]), m) + B.MU
            score += math.log10(max(quantised(pairs[first, w]) - B.DISCOUNT, 0.0) / below + (1 - m / below) * (quantised(count[w]) + 0.5) / total)
        out.append((len(own), score))
    return out


def zipf_rows(spark, n=160):
    draw = np.random.default_rng(4)
    texts = [" ".join(f"w{int(x)}" for x in draw.zipf(1.4, int(draw.integers(0, 120))) % 900) for _ in range(n)]
    texts += [texts[3], texts[4], texts[4], "", "L" * 500 + " end " + "L" * 500]
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)


def test_scores_against_brute_force(spark):
    """Pairs that are seen once count too. The filter invents an entry now and then, so some scores are a little higher."""
    rows = zipf_rows(spark)
    found = sorted((r.doc_id, r.score) for r in B.score(rows).collect())
    want = plain_scores(sorted(rows.collect()))
    off = np.array([a - b for (_, a), (_, b) in zip(found, want, strict=True)])
    assert (np.abs(off) < 1e-6).mean() > 0.5 and np.abs(off).max() < 0.03 * max(n for n, _ in want) and np.median(np.abs(off)) < 0.05


def test_a_filter_that_is_not_broadcast_gives_the_same(spark, monkeypatch, awkward):
    for rows in (zipf_rows(spark), awkward):
        want = sorted(B.score(rows).collect(), key=repr)
        monkeypatch.setattr(B, "MOST_BITS", 0)
        found = sorted(B.score(rows).collect(), key=repr)
        monkeypatch.undo()
        assert len(found) == len(want) and [x[:5] for x in found] == [x[:5] for x in want]
        assert np.allclose([x[5:] for x in found], [x[5:] for x in want], atol=1e-6)


def test_a_filter_that_is_not_broadcast_leaves_little_on_disk(spark, monkeypatch):
    """Beside the model, what stays in the shared folder is no copy of the texts' words and pairs; several blocks and chunks give what one gives."""
    draw = np.random.default_rng(6)
    texts = [" ".join(f"w{int(x)}" for x in draw.integers(0, 5000, 400)) for _ in range(200)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    want = sorted(B.score(rows).collect())
    kept, staged = {}, B.staged

    def noted(df, label, *more):
        out = staged(df, label, *more)
        kept[label] = kept.get(label, 0) + sum(Path(x.removeprefix("file:")).stat().st_size for x in out.inputFiles())
        return out

    monkeypatch.setattr(B, "staged", noted)
    monkeypatch.setattr(B, "MOST_BITS", 0)
    for tokens, blocks in ((1 << 20, 8), (30_000, 2)):
        monkeypatch.setattr(B, "ASKED_TOKENS", tokens, raising=False)
        monkeypatch.setattr(B, "BLOCKS", blocks, raising=False)
        kept.clear()
        found = sorted(B.score(rows).collect())
        assert [x[:5] for x in found] == [x[:5] for x in want] and np.allclose([x[5:] for x in found], [x[5:] for x in want], atol=1e-6)
        assert sum(n for label, n in kept.items() if label not in ("vocabulary", "pairs", "words", "rests")) < 0.2 * sum(map(len, texts))


def test_workers_share_the_filter_and_give_it_up(spark):
    """A worker maps the broadcast's file instead of holding a copy, and the next training's steps don't hold the last model."""
    draw = np.random.default_rng(7)
    rows = spark.createDataFrame([(i, " ".join(f"w{int(x)}" for x in draw.integers(0, 9000, 300))) for i in range(400)], "doc_id long, text string")
    trained = B.train(rows)
    shared, own = B.Shared(trained), B.broadcastable(trained)
    keys = np.concatenate([draw.integers(1, 1 << 63, 500).astype(np.uint64), np.array([B.word_hash(b"w%d" % i) for i in range(9000)], np.uint64)])

    def look(_):
        model = B.resident(("bloom", shared.name), shared.model)
        held = all(isinstance(x, np.memmap) for x in model.table.chunks)
        levels = model.table.levels(B.WORD, keys).tolist()
        B.release()
        yield held, levels, len(base._RESIDENT)

    held, levels, left = spark.sparkContext.parallelize([0], 1).mapPartitions(look).first()
    assert held and levels == own.table.levels(B.WORD, keys).tolist() and left == 0


def test_a_text_seen_twice_stands_out(spark):
    draw = np.random.default_rng(5)
    texts = [" ".join(f"w{int(x)}" for x in draw.integers(0, 400, 80)) for _ in range(200)]
    rows = spark.createDataFrame(list(enumerate(texts + texts[:20])), "doc_id long, text string")
    found = {r.doc_id: r for r in B.score(rows).collect()}
    twice = [found[i].score for i in range(20) if not found[i].held_out and not found[200 + i].held_out]
    once = [r.score for i, r in found.items() if 20 <= i < 200 and not r.held_out]
    assert min(twice) > np.quantile(once, 0.95)


def test_levels():
    counts = np.arange(1, 5000)
    levels = B.level(counts)
    assert (levels > 0).all() and (np.diff(levels) >= 0).all() and B.level(np.zeros(1, int))[0] == 0
    assert (np.abs(B.value(levels) / counts - 1) <= 0.13).all()


def test_filter_never_misses_and_seldom_invents():
    draw = np.random.default_rng(2)
    keys = draw.integers(0, 1 << 63, 20_000).astype(np.uint64)
    levels = draw.integers(1, 6, len(keys))
    own = B.segments(keys, 4)
    parts = [B.segment_words(B.PAIR, keys[own == s], levels[own == s]) for s in range(4)]
    starts = np.concatenate(([0], np.cumsum([len(x) // 8 for x in parts])))
    table = B.Filter(np.frombuffer(b"".join(parts), "<u8"), {B.PAIR: starts}, 0.0)
    found = table.levels(B.PAIR, keys)
    assert (found >= levels).all() and (found > levels).mean() < 0.02
    others = draw.integers(1 << 63, (1 << 64) - 1, 20_000, dtype=np.uint64)
    assert (table.levels(B.PAIR, others) > 0).mean() < 0.02


def test_probabilities_sum_to_one_and_beat_the_words(spark):
    draw = np.random.default_rng(3)
    names = [f"w{i}" for i in range(30)]
    texts = []
    for _ in range(300):
        i, out = 0, []
        for _ in range(80):
            i = (i * 7 + int(draw.integers(0, 3))) % 30
            out.append(names[i])
        texts.append(" ".join(out))
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = [r for r in B.score(rows).collect() if r.held_out]
    assert np.mean([r.score - r.base_score for r in found]) > 20
    model = B.broadcastable(B.train(rows))
    scorer = B.Scorer(model)
    known = [w.encode() for w in names]
    for first in known[:5]:
        after = scorer.logs([scorer.numbers(f"{first.decode()} {w.decode()}") for w in known] + [scorer.numbers(first.decode())])
        start = scorer.logs([scorer.numbers(first.decode())])[0]
        end = scorer.logs([scorer.numbers(f"{first.decode()} {w.decode()}") for w in known])
        assert len(after) == 31 and start < 0 and np.isfinite(end).all()
    # The pairs of one first word and the unknown word: their probabilities add up to about one.
    hashes = np.array([B.word_hash(w) for w in [*known, b"", b"never seen"]], np.uint64)
    first = np.full(len(hashes), B.word_hash(b"w3"), np.uint64)
    counts = B.value(model.table.levels(B.WORD, hashes))
    pairs = B.value(model.table.levels(B.PAIR, B.pair_keys(first, hashes)))
    c = B.value(model.table.levels(B.WORD, first[:1]))[0]
    mass = B.value(model.table.levels(B.REST, B.rest_keys(first[:1])))[0]
    below = max(c, mass) + B.MU
    p = np.maximum(pairs - B.DISCOUNT, 0) / below + (1 - mass / below) * (counts + 0.5) / model.total
    assert p.sum() == pytest.approx(1.0, abs=0.15)


def test_words_are_split_at_ascii_white_space_alone():
    """Only A to Z are lowered and only six characters split, at the start and the end of a text too."""
    odd = "".join(map(chr, [*range(256), 0x2028, 0x3000, 0x130, 0x212A, 0x1F600]))
    texts = [odd, None, "", " \n\t ", "  A b\x0bb\x0cB ", "x", "end\n", "É\xa0É é\x85", "L" * 70 + " l" + "L" * 69, "a\0 \0", odd[::-1]]
    for column in (pa.array(texts, pa.string()), pa.array(["cut off", *texts, "too"], pa.large_string())[1:-1], pa.array([None, ""], pa.string())):
        found = B.tokenised(column)
        tokens, cuts = [found.words[int(i)].as_py() for i in found.at], [*found.starts.tolist(), len(found.at)]
        assert [tokens[a:b] for a, b in zip(cuts, cuts[1:])] == [[*(x or "").encode().lower().split(), b""] for x in column.to_pylist()]
        assert B.hashed(found.words).tolist() == [B.word_hash(x) for x in found.words.to_pylist()]


class Steps:
    """Stands in for a DataFrame and keeps the function that goes to the workers."""

    def mapInArrow(self, run, schema):
        self.run = run
        return self

    def groupBy(self, *columns):
        return self

    agg = groupBy


def seconds(function):
    out = []
    for _ in range(3):
        began = time.process_time()
        function()
        out.append(time.process_time() - began)
    return min(out)


def test_counting_takes_no_python_step_for_each_token(spark):
    """Words and pairs are counted in less time than two plain counts of the words take."""
    draw = np.random.default_rng(8)
    texts = [" ".join(f"w{int(x)}" for x in draw.zipf(1.2, 500) % 100_000) for _ in range(2000)]
    batches = [pa.RecordBatch.from_arrays([pa.array(range(i, i + 500)), pa.array(texts[i : i + 500])], names=["doc_id", "text"]) for i in range(0, 2000, 500)]

    def plainly():
        count = Counter()
        for batch in batches:
            for text in batch.column(1).to_pylist():
                count.update(text.encode().lower().split())

    words, pairs = B.word_counts(Steps()).run, B.pair_blobs(Steps(), 8).run
    taken = seconds(lambda: list(words(iter(batches)))) + seconds(lambda: list(pairs(iter(batches))))
    assert taken < 2 * seconds(plainly)


def test_a_pair_that_repeats_is_probed_once(spark, monkeypatch):
    trained = B.train(spark.createDataFrame([(i, "a b " * 300) for i in range(30)], "doc_id long, text string"))
    model, asked, probed = B.broadcastable(trained), [], B.probed

    def noted(words, kind, keys, *more):
        asked.append((kind, len(keys)))
        return probed(words, kind, keys, *more)

    monkeypatch.setattr(B, "probed", noted)
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array(["a b " * 300, "a b c " * 200])], names=["doc_id", "text"])
    assert sum(x.num_rows for x in B.scored(batch, B.Scorer(model), B.count_from(0))) >= 2
    assert sum(n for kind, n in asked if kind == B.PAIR) <= 7  # of the start and a, b, c, the end


def test_no_filter_stays_in_the_driver(spark, monkeypatch):
    """Scoring again and again doesn't fill the driver's memory: the broadcasts go with the step that reads them, and the result can be read twice."""
    sent, broadcast = [], type(spark.sparkContext).broadcast
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", lambda self, value: sent.append(broadcast(self, value)) or sent[-1])
    found = B.score(zipf_rows(spark, 30))
    assert sent and not any(x._jbroadcast.isValid() for x in sent)
    assert sorted(found.collect()) == sorted(found.collect())
