import random
from itertools import combinations

import numpy as np
import pytest

from veilspan.llm import toxicity as T


def plain_kernel(a, b):
    """All subsequences of three letters, by hand."""

    def weights(word):
        out = {}
        for i, j, k in combinations(range(len(word)), 3):
            if k - i <= 6:
                key = (word[i], word[j], word[k])
                out[key] = out.get(key, 0) + 0.6 ** (k - i + 1)
        return out

    u, v = weights(a), weights(b)
    dot = sum(w * v.get(k, 0) for k, w in u.items())
    norm = (sum(w * w for w in u.values()) * sum(w * w for w in v.values())) ** 0.5
    return dot / norm if norm else 0.0


def test_kernel():
    words = ["banana", "bandana", "cabbage", "abcabc", "xyzzy", "abacus", "quite"]
    found = T.kernel(words, words)
    assert np.allclose(found, [[plain_kernel(a, b) for b in words] for a in words])


def test_folded_weights_are_the_machine():
    trainer = T.Trainer([("badword", 50.0, 9), ("nastyish", 40.0, 7)], [("garden", 5), ("window", 4), ("simple", 9), ("letters", 2)])
    machine = trainer.fit()
    margins = machine.margins(["badword", "ba", "", "garden", "baddword"])
    assert margins[0] > 0.5 > margins[4] > margins[3] and margins[1] == margins[2] == -1.0
    assert T.Trainer([], []).fit().margins(["any"])[0] < 0


def test_letters():
    assert T.letters("st-upid.") == "stupid" and T.letters("b4d,") == "bad" and T.letters("***") == "" and T.letters("$$$") == ""


@pytest.fixture(scope="module")
def labelled(spark):
    draw = random.Random(8)
    syllables = ["ba", "co", "di", "fu", "ge", "li", "mo", "na", "pe", "ru", "sa", "to"]
    bad = ["grumvash", "grumvosh", "blixtorn", "blixtarn"]
    rows, labels = [], []
    for i in range(700):
        words = ["".join(draw.choice(syllables) for _ in range(draw.randint(1, 4))) for _ in range(60)]
        toxic = i % 5 == 0
        if toxic:
            for _ in range(3):
                w = draw.choice(bad)
                words.insert(draw.randrange(60), w[:3] + draw.choice(["", "-", "."]) + w[3:] + draw.choice(["", ",", "."]))
        rows.append((i, ". ".join(" ".join(words[k : k + 10]) for k in range(0, len(words), 10)), "en", "s", 1))
        labels.append((i, 1, int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out_accuracy(labelled):
    docs, labels = labelled
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    found = [r for r in T.score(docs, labels).collect() if r.held_out]
    assert np.mean([r.predicted == truth[r.doc_id] for r in found]) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in found)


def test_awkward_rows(spark, labelled, awkward, extra, empty):
    docs, labels = labelled
    odd = labels.limit(40).selectExpr("doc_id", "cast(null as int) as quality", "toxic").unionByName(spark.createDataFrame([(None, 1, 1), (1, None, None)], "doc_id long, quality int, toxic int"))
    assert T.score(extra, odd).count() == 10
    assert T.score(empty, labels).collect() == []
    none = T.score(awkward, labels.limit(0)).collect()
    assert len(none) == 10 and all(r.score == 0 and r.predicted == 0 for r in none)
