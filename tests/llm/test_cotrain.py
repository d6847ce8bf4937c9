import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from veilspan.llm import cotrain as C


@pytest.fixture(scope="module")
def labelled(spark):
    draw = random.Random(4)
    words = "time people water under morning letter garden simple because through".split()
    rows, labels = [], []
    for i in range(500):
        good = i % 3 > 0
        own = [draw.choice(words) + draw.choice(["", "s", "ed"]) for _ in range(draw.randint(30, 90))]
        text = " ".join(own) + "." if good else " ".join(w + "###" for w in own)
        rows.append((i, text, "en", "fine" if good == (draw.random() < 0.9) else "odd", len(text)))
        if i % 2:
            labels.append((i, int(good), 0))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_all_documents_are_judged(labelled):
    docs, labels = labelled
    found = C.classify(docs, labels).collect()
    assert len(found) == 500
    assert np.mean([r.kept == (r.doc_id % 3 > 0) for r in found]) > 0.98


def test_rounds_teach_the_other_view():
    draw = np.random.default_rng(1)
    y = draw.integers(0, 2, 600)
    text = np.stack((y + draw.normal(0, 0.1, 600), draw.normal(0, 1, 600)), axis=1)
    meta = np.stack((2 * y + draw.normal(0, 0.4, 600), draw.normal(0, 1, 600)), axis=1)
    free, told = set(range(40, 600)), []

    def ask(views):
        out = {}
        for view, x in enumerate((text, meta)):
            p = C.sigmoid(views[view].raw(x))
            for label in (0, 1):
                sure = p if label else 1 - p
                own = sorted((i for i in free if sure[i] >= C.SURE), key=lambda i: -sure[i])[:20]
                told.extend((int(y[i]), label) for i in own)
                out[view, label] = text[own], meta[own]
        return out

    model = C.co_train(text[:40], meta[:40], y[:40], ask)
    assert len(told) > 100 and np.mean([a == b for a, b in told]) > 0.97
    assert ((model.probability(text, meta) > 0.5) == (y == 1)).mean() > 0.97


def test_each_round_takes_the_surest_of_all(spark, monkeypatch):
    """Against a plain search over all rows; what a view has told once isn't told again."""
    monkeypatch.setattr(C, "EACH_ROUND", 7)
    draw = np.random.default_rng(2)
    text, meta = draw.normal(0, 1, (300, C.N_TEXT)).astype(np.float32), draw.normal(0, 1, (300, C.N_META)).astype(np.float32)
    views = tuple(C.View(np.zeros(n), np.ones(n), np.append(draw.normal(0, 1, n), 0.1)) for n in (C.N_TEXT, C.N_META))
    frame = spark.createDataFrame([(f"{i:03d}", bytearray(np.hstack((text[i], meta[i])).tobytes())) for i in range(300)], "place string, x binary").repartition(4)
    taken: list[str] = []
    seen = {0: set(), 1: set()}
    for _ in range(2):
        found = C._surest(frame, views, taken)
        for view, x in enumerate((text, meta)):
            p = C.sigmoid(views[view].raw(x.astype(float)))
            for label in (0, 1):
                sure = p if label else 1 - p
                own = [i for i in sorted(range(300), key=lambda i: (-sure[i], i)) if sure[i] >= C.SURE and i not in seen[view]][:7]
                assert sorted(map(tuple, found[view, label][0])) == sorted(map(tuple, text[own].astype(float)))
                seen[view] |= set(own)


def test_the_views_are_not_shuffled(spark, labelled, monkeypatch):
    """Where the labels are too many to be broadcast, ids and probabilities meet them; the views of the texts stay where they are."""
    docs, labels = labelled
    monkeypatch.setattr(C, "EACH_ROUND", 5)
    more = docs.crossJoin(spark.range(6).select(F.col("id").alias("k"))).withColumn("doc_id", F.col("doc_id") + 1000 * F.col("k")).drop("k")
    written = lambda: time.sleep(1) or spark.sparkContext._jsc.sc().statusStore().executorList(False).apply(0).totalShuffleWrite()
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        start = written()
        C.train(more, labels)
        moved = written() - start
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert 0 < moved < 300 * more.count()


def test_awkward_rows(spark, labelled, awkward, extra, empty):
    docs, labels = labelled
    assert C.classify(extra, labels).count() == 10
    assert C.classify(empty, labels).collect() == []
    assert all(r.quality_score == 1.0 and r.kept for r in C.classify(awkward, labels.limit(0)).collect())
    one = spark.createDataFrame([(1, 0), (1, 1), (None, 1), (3, None)], "doc_id long, quality int")
    assert C.classify(awkward, one).count() == 10
    judged = C.classify(awkward, labels).collect()
    clashing = awkward.withColumns({c: F.lit("more") for c in ("_kept", "_t", "c0", "t", "TEXTS")})
    clashing = clashing.toDF(*clashing.columns[:-1], "TEXT")
    carried = C.classify(clashing, labels, carry=True)
    assert carried.columns == clashing.columns
    assert sorted(map(repr, carried.collect())) == sorted(repr(r) for r, j in zip(clashing.collect(), judged, strict=True) if j.kept)
