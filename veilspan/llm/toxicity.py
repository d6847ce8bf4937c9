"""Toxicity by a subsequence string kernel and a support vector machine with Nyström landmarks.

Two words are as similar as their shared subsequences of ``ORDER`` letters, each weighted by ``DECAY`` to the power of the
stretch that it spans (``GAP`` further letters at most), so gaps and inserted characters cost weight but don't break the match. The machine is trained on labelled
sentences by their witnesses: a sentence is as toxic as its most toxic word. At first a toxic sentence's witness is the word that speaks most for the label; then in each round it is the one
that the last machine finds most toxic, and so is a clean sentence's, the hardest example against. Landmarks are chosen
from the witnesses far from one another; kernel values against them, whitened, are the features of a linear machine with squared hinge
loss. As each landmark is a sum over subsequences, the machine folds into one weight for each subsequence, so a word is scored in a
single pass over its letters. A document's score is a function of its words' margins, calibrated on labelled documents that were set aside.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspan.llm.base import groups_by_size, hash_remainder, map_batches, pick, resident, staged

FOLDS, HELD_OUT = 3, 1
THRESHOLD = 0.7
ORDER = 3
DECAY = 0.6
GAP = 6
OFFSETS = [(a, b) for b in range(2, GAP + 1) for a in range(1, b)]  # of the second and third letter of a subsequence: up to two letters inserted after each
SYMBOLS = 64
#: Bounds of the training sample: labelled documents, words that may be witnesses, other words, landmarks.
MAX_TOXIC, MAX_CLEAN, MAX_WITNESSES, MAX_OTHERS, LANDMARKS = 4_000, 12_000, 600, 6_000, 200
LEAST_EVIDENCE = 15.0
ROUNDS = 3
ASIDE = 4  # each so many-th labelled document is left for calibration, where these are
LEAST_ASIDE = 10  # of either label; else all are used
CHUNK_CHARS = 1_000_000
REMEMBERED_WORDS = 400_000

_SPELT = re.compile(r"(?<!\S)\w(?:\s\W?\w){2,}(?!\S)")
_LOOKALIKE = str.maketrans("013457@$", "oieastas")
_SENTENCE = re.compile(r"[.!?\n]+")


def letters(word: str) -> str:
    """The letters of a word, without what stands around or between them; digits and signs inside that look like letters count as such."""
    first, last = 0, len(word)
    while first < last and not word[first].isalpha():
        first += 1
    while last > first and not word[last - 1].isalpha():
        last -= 1
    inner = word[first:last]
    return inner if inner.isalpha() else "".join(c for c in inner.translate(_LOOKALIKE) if c.isalpha())


@lru_cache(maxsize=1 << 16)
def _symbol(c: str) -> int:
    if "a" <= c <= "z":
        return ord(c) - 96
    base = unicodedata.normalize("NFD", c)[0]
    if "a" <= base <= "z" and len(unicodedata.normalize("NFD", c)) > 1:
        return 27 + (ord(base) - 97) % 20  # letters with a mark keep apart from the plain ones
    return 47 + ord(c) % (SYMBOLS - 47)


def subsequences(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, subsequence, weight), each subsequence of a word once; words shorter than a subsequence have none."""
    codes = np.fromiter((x for word in words for x in (*map(_symbol, word), *[0] * GAP)), np.int64)
    codes = np.concatenate((codes, np.zeros(GAP, np.int64)))
    owner = np.repeat(np.arange(len(words)), [len(word) + GAP for word in words])
    n = len(owner)
    found = []
    for a, b in OFFSETS:
        x, y, z = codes[:n], codes[a : n + a], codes[b : n + b]
        at = np.flatnonzero((x > 0) & (y > 0) & (z > 0))
        found.append((owner[at] * SYMBOLS**3 + (x[at] * SYMBOLS + y[at]) * SYMBOLS + z[at], np.full(len(at), DECAY ** (b + 1))))
    keys = np.concatenate([x for x, _ in found])
    unique, where = np.unique(keys, return_inverse=True)
    weights = np.bincount(where, np.concatenate([x for _, x in found]), len(unique)) if len(unique) else np.zeros(0)
    return unique // SYMBOLS**3, unique % SYMBOLS**3, weights


def normalised(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As ``subsequences``, with each word's weights of length one."""
    owner, key, weight = subsequences(words)
    norms = np.sqrt(np.bincount(owner, weight**2, len(words)))
    return owner, key, weight / norms[owner]


def kernel(words: list[str], landmarks: list[str]) -> np.ndarray:
    """Normalised kernel values, a row for each word and a column for each landmark."""
    owner, key, weight = normalised(words)
    mark, mark_key, mark_weight = normalised(landmarks)
    known, column = np.unique(mark_key, return_inverse=True)
    table = np.zeros((len(known) + 1, len(landmarks)))
    table[column, mark] = mark_weight
    at = np.searchsorted(known, key)
    at[(at == len(known)) | (known[np.minimum(at, len(known) - 1)] != key)] = len(known)
    out = np.zeros((len(words), len(landmarks)))
    for start in range(0, len(key), 1 << 16):
        part = slice(start, start + (1 << 16))
        np.add.at(out, owner[part], weight[part, None] * table[at[part]])
    return out


def squared_hinge(x: np.ndarray, y: np.ndarray, c: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights (the last one: the constant) that minimise ridge/2 |w|² + sum c max(0, 1 - y xw)², by Newton steps."""
    x = np.hstack((x, np.ones((len(x), 1))))
    w, penalty = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    penalty[-1] = 1e-3
    for _ in range(50):
        slack = 1 - y * (x @ w)
        active = slack > 0
        gradient = penalty * w - 2 * x[active].T @ (c * y * slack)[active]
        if np.abs(gradient).max() < 1e-6:
            break
        hessian = np.diag(penalty) + 2 * (x[active].T * c[active]) @ x[active]
        step = np.linalg.solve(hessian, gradient)
        loss = lambda v: 0.5 * (penalty * v * v).sum() + (c * np.maximum(0, 1 - y * (x @ v)) ** 2).sum()
        size = 1.0
        while size > 1e-4 and loss(w - size * step) > loss(w):
            size /= 2
        w = w - size * step
    return w


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, weights: np.ndarray | None = None) -> np.ndarray:
    """Logistic regression (the last weight: the constant) by Newton steps."""
    x = np.hstack((x, np.ones((len(x), 1))))
    w, c = np.zeros(x.shape[1]), np.ones(len(x)) if weights is None else weights
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-3
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(np.diag(penalty) + (x.T * (c * p * (1 - p) + 1e-9)) @ x, x.T @ (c * (p - y)) + penalty * w)
        w = w - step
        if np.abs(step).max() < 1e-7:
            break
    return w


class Machine:
    """One weight for each subsequence, a constant, and the calibration of a document's margins."""

    def __init__(self, weights: np.ndarray, constant: float) -> None:
        self.weights, self.constant = weights.astype(np.float32), float(constant)
        self.calibration: np.ndarray | None = None

    def margins(self, words: list[str]) -> np.ndarray:
        """Margin of each word; one without subsequences has -1."""
        owner, key, weight = subsequences(words)
        dot = np.bincount(owner, weight * self.weights[key], len(words))
        norm = np.sqrt(np.bincount(owner, weight**2, len(words)))
        return np.where(norm > 0, dot / np.maximum(norm, 1e-12) + self.constant, -1.0)


def far_apart(words: list[str], scores: np.ndarray, count: int) -> list[str]:
    """Up to ``count`` words, the best one first, then each time the one worth most times its distance from those chosen."""
    if len(words) <= count:
        return list(words)
    own = kernel(words, words)
    chosen = [int(np.argmax(scores))]
    nearest = own[:, chosen[0]].copy()
    while len(chosen) < count:
        i = int(np.argmax(scores * (1 - nearest) + np.where(nearest > 1 - 1e-9, -1.0, 0.0)))
        if nearest[i] > 1 - 1e-9:
            break
        chosen.append(i)
        np.maximum(nearest, own[:, i], out=nearest)
    return [words[i] for i in chosen]


class Trainer:
    """Fits machines to a growing set of witnesses and other words, over one set of landmarks."""

    def __init__(self, witnesses: list[tuple[str, float, int]], others: list[tuple[str, int]]) -> None:
        """From witnesses (word, evidence, sentences) and other words (word, sentences)."""
        witnesses = [x for x in witnesses if len(x[0]) >= ORDER]
        self.positive = {word: float(np.log1p(n)) for word, _, n in witnesses}
        self.negative = {word: float(np.log1p(n)) for word, n in others if len(word) >= ORDER and word not in self.positive}
        self.usable = bool(self.positive and self.negative)
        if not self.usable:
            return
        marks = far_apart([x[0] for x in witnesses], np.log1p([x[1] for x in witnesses]), LANDMARKS * 3 // 4)
        self.marks = list(dict.fromkeys([*marks, *list(self.negative)[: LANDMARKS // 4]]))
        values, vectors = np.linalg.eigh(kernel(self.marks, self.marks))
        self.whiten = vectors[:, values > 1e-8] / np.sqrt(values[values > 1e-8])

    def add(self, positive: list[str], negative: list[tuple[str, int]]) -> None:
        """Words that the last machine took for toxic: seen in toxic sentences alone, and seen in clean ones."""
        for word, n in negative:
            if word not in self.positive and len(word) >= ORDER:
                self.negative[word] = float(np.log1p(n))
        for word in positive:
            if word not in self.negative and len(word) >= ORDER:
                self.positive.setdefault(word, float(np.log1p(1)))

    def fit(self) -> Machine:
        if not self.usable:
            return Machine(np.zeros(SYMBOLS**3), -1.0)
        words = [*self.positive, *self.negative]
        y = np.repeat([1.0, -1.0], [len(self.positive), len(self.negative)])
        c = np.array([*self.positive.values(), *self.negative.values()])
        c[y > 0] *= len(self.negative) / (4.0 * len(self.positive))
        w = squared_hinge(kernel(words, self.marks) @ self.whiten, y, c)
        owner, key, weight = normalised(self.marks)
        return Machine(np.bincount(key, weight * (self.whiten @ w[:-1])[owner], SYMBOLS**3), w[-1])


def _tokens(text: str | None) -> list[str]:
    if not text:
        return []
    lowered = text.lower()
    words = lowered.split()
    for spelt in _SPELT.findall(lowered):
        words.append("".join(c for c in spelt if c.isalpha()))
    return words


def _sentences(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """(sentence, toxic): the sentences of documents, each with the label of its document, as lower-case words."""
    sentences, labels = [], []
    for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
        found = {" ".join(sentence.lower().split()) for sentence in _SENTENCE.split(text or "")}
        sentences += found
        labels += [toxic] * len(found)
    yield pa.RecordBatch.from_arrays([pa.array(sentences, pa.string()), pa.array(labels, pa.int32())], names=["sentence", "toxic"])


def _sentence_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, toxic, clean): in how many sentences of either label each word stands, within the task."""
    counts: dict[str, list[int]] = {}
    for batch in batches:
        for sentence, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            for word in {letters(x) for x in sentence.split()}:
                if word:
                    counts.setdefault(word, [0, 0])[1 - toxic] += 1
    yield pa.RecordBatch.from_arrays(
        [pa.array(list(counts), pa.string()), pa.array([x[0] for x in counts.values()], pa.int64()), pa.array([x[1] for x in counts.values()], pa.int64())], names=["word", "toxic", "clean"]
    )


FEATURES = 4


def features(margins: np.ndarray) -> list[float]:
    """A document's features from the margins of its words: the two highest, how many are positive, and their share."""
    if not len(margins):
        return [-2.0, -2.0, 0.0, 0.0]
    top = np.sort(margins[np.argpartition(margins, -2)[-2:]]) if len(margins) > 2 else np.sort(margins)
    n = int((margins > 0).sum())
    return [max(float(top[-1]), -2.0), max(float(top[-2]), -2.0) if len(top) > 1 else -2.0, float(np.log1p(n)), float(np.sqrt(n / len(margins)))]


class Scorer:
    """Margins of words, remembered within a bound."""

    def __init__(self, machine: Machine) -> None:
        self.machine, self.at = machine, {}

    def features(self, texts: list[str | None]) -> np.ndarray:
        cut = [_tokens(text) for text in texts]
        new = {word for words in cut for word in words if word not in self.at}
        if len(self.at) + len(new) > REMEMBERED_WORDS:
            self.at.clear()
            new = {word for words in cut for word in words}
        if new:
            asked = list(new)
            for start in range(0, len(asked), 20_000):
                part = asked[start : start + 20_000]
                self.at.update(zip(part, self.machine.margins([letters(word) for word in part]).tolist(), strict=True))
        return np.array([features(np.fromiter(map(self.at.__getitem__, words), np.float64, len(words))) for words in cut]).reshape(-1, FEATURES)


def _texts(batch: pa.RecordBatch, column: int) -> Iterator[tuple[pa.RecordBatch, list]]:
    sizes = [len(x.as_buffer()) if x.is_valid else 0 for x in batch.column(column).cast(pa.binary())]
    for start, end in groups_by_size(sizes, CHUNK_CHARS):
        part = batch.slice(start, end - start)
        yield part, part.column(column).to_pylist()


def _witnesses(machine: Machine):
    """(word, toxic, clean, margin): for each word the number of sentences of either label, within the task, whose most toxic word it is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        margins: dict[str, float] = {}
        counts: dict[str, list[int]] = {}
        for batch in batches:
            cut = [list({letters(x) for x in sentence.split()}) for sentence in batch.column(0).to_pylist()]
            if len(margins) > REMEMBERED_WORDS:
                margins = {}
            new = list({word for words in cut for word in words if word and word not in margins})
            margins[""] = -2.0
            for start in range(0, len(new), 10_000):
                part = new[start : start + 10_000]
                margins.update(zip(part, machine.margins(part).tolist(), strict=True))
            for words, toxic in zip(cut, batch.column(1).to_pylist(), strict=True):
                if words:
                    word = max(words, key=lambda x: (margins[x], x))
                    counts.setdefault(word, [0, 0, margins[word]])[1 - toxic] += 1
        words = [word for word in counts if word]
        columns = [pa.array(words, pa.string()), *(pa.array([counts[w][i] for w in words], kind) for i, kind in ((0, pa.int64()), (1, pa.int64()), (2, pa.float64())))]
        yield pa.RecordBatch.from_arrays(columns, names=["word", "toxic", "clean", "margin"])

    return run


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_id: str = "doc_id", label_col: str = "toxic", learn_all: bool = False) -> Machine:
    """The machine for ``docs``, from a bounded sample of the rows of ``labels`` that may be learned from.

    The sample: by a hash of the id, at most ``MAX_TOXIC`` and ``MAX_CLEAN`` documents, and of their words at most ``MAX_WITNESSES`` and, in each step, ``MAX_OTHERS``.
    In each of ``ROUNDS`` rounds the witnesses of all sentences join the training set: of clean ones, and of toxic ones where no clean sentence holds the word. Of several labels of one id
    the highest counts; null labels don't. Of several rows with one id the smallest text counts.
    """
    named = pick(labels, doc_id=label_id, toxic=label_col).where("doc_id IS NOT NULL AND toxic IS NOT NULL")
    if not learn_all:
        named = named.where(hash_remainder(F.col("doc_id"), FOLDS) != HELD_OUT)
    named = named.groupBy("doc_id").agg(F.when(F.max("toxic") > 0, 1).otherwise(0).alias("toxic"))
    order = F.md5(F.concat(F.lit("toxic "), F.col("doc_id").cast("string")).cast("binary"))
    sample = named.where("toxic = 1").orderBy(order).limit(MAX_TOXIC).unionByName(named.where("toxic = 0").orderBy(order).limit(MAX_CLEAN))
    rows = pick(docs, doc_id=id_col, text=text_col).join(F.broadcast(sample), "doc_id")  # at most MAX_TOXIC + MAX_CLEAN ids
    rows = staged(rows.groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).select("text", "toxic", (F.pmod(F.xxhash64("doc_id"), F.lit(ASIDE)) == 0).alias("aside")), "labelled")
    # A sentence that copies share counts once, as clean where both labels hold it.
    sentences = map_batches(rows.where("NOT aside").select("text", "toxic"), _sentences, "sentence string, toxic int").groupBy("sentence").agg(F.min("toxic").alias("toxic"))
    sentences = staged(sentences, "sentences")
    words = sentences.mapInArrow(_sentence_words, "word string, toxic long, clean long").groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    words = staged(words, "sentence-words")
    n_toxic, n_clean = (x or 0 for x in words.agg(F.sum("toxic"), F.sum("clean")).first())
    if not n_toxic or not n_clean:
        return Machine(np.zeros(SYMBOLS**3), -1.0)
    share = n_toxic / (n_toxic + n_clean)
    t, c, n = F.col("toxic"), F.col("clean"), F.col("toxic") + F.col("clean")
    part = lambda x, expected: F.when(x > 0, x * F.log(x / (n * expected))).otherwise(0.0)
    evidence = F.when(t / n > share, 2 * (part(t, share) + part(c, 1 - share))).otherwise(0.0)
    found = words.withColumn("evidence", evidence)
    tie = F.md5(F.col("word").cast("binary"))
    witnesses = found.where((F.col("evidence") >= LEAST_EVIDENCE) & (c <= 0.2 * t)).orderBy(F.desc("evidence"), tie).limit(MAX_WITNESSES).collect()
    frequent = found.where(c > 0.2 * t).orderBy(F.desc("clean"), tie).limit(MAX_OTHERS // 2).collect()
    spread = found.where(c > 0.2 * t).orderBy(tie).limit(MAX_OTHERS).collect()
    others = list({row.word: row.clean for row in [*spread, *frequent]}.items())
    trainer = Trainer([(row.word, row.evidence, row.toxic) for row in witnesses], others)
    machine = trainer.fit()
    for _ in range(ROUNDS if trainer.usable else 0):
        told = sentences.mapInArrow(_witnesses(machine), "word string, toxic long, clean long, margin double").groupBy("word")
        judged = told.agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"), F.max("margin").alias("margin")).join(words.select("word", F.col("clean").alias("seen")), "word")
        judged = staged(judged, "witnesses")
        high = judged.where("margin > 0.5 AND seen = 0").orderBy(F.desc("margin"), tie).limit(MAX_OTHERS).collect()
        wrong = judged.where("margin > -0.5 AND clean > 0").orderBy(F.desc("margin"), tie).limit(MAX_OTHERS).collect()
        trainer.add([row.word for row in high], [(row.word, row.clean) for row in wrong])
        machine = trainer.fit()

    def margins(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(machine)
        for part, texts in _texts(batch, 0):
            x = scorer.features(texts)
            yield pa.RecordBatch.from_arrays([part.column(1), part.column(2), *(pa.array(x[:, i]) for i in range(FEATURES))], names=["toxic", "aside", *(f"x{i}" for i in range(FEATURES))])

    kinds = "toxic int, aside boolean, " + ", ".join(f"x{i} double" for i in range(FEATURES))
    table = np.array(map_batches(rows, margins, kinds).collect(), float)  # at most MAX_TOXIC + MAX_CLEAN rows
    aside = table[table[:, 1] > 0] if len(table) else table
    if len(table):
        own = aside if min(aside[:, 0].sum(), (1 - aside[:, 0]).sum()) >= LEAST_ASIDE else table
        machine.calibration = logistic(own[:, 2:], own[:, 0])
    return machine


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_id: str = "doc_id", label_col: str = "toxic", threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of ``docs``.

    Null and empty texts have no words and get the score of a text without a toxic one. Without usable labels every score is 0.
    Repeated rows each give a row; a null id hashes as the empty text. An empty table gives no rows; further columns are ignored, whatever
    their names. Texts are taken whole.
    """
    machine = train(docs, labels, id_col, text_col, label_id, label_col)

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        scorer = _scorer(machine)
        for part, texts in _texts(batch, 1):
            if machine.calibration is None:
                p = np.zeros(part.num_rows)
            else:
                p = 1 / (1 + np.exp(-np.clip(scorer.features(texts) @ machine.calibration[:-1] + machine.calibration[-1], -30, 30)))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(p), pa.array((p >= threshold).astype(np.int32))], names=["doc_id", "score", "predicted"])

    chosen = pick(docs, doc_id=id_col, text=text_col)
    scored = map_batches(chosen, run, f"doc_id {dict(chosen.dtypes)['doc_id']}, score double, predicted int")
    return scored.select("doc_id", (hash_remainder(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "score", "predicted")


def _scorer(machine: Machine) -> Scorer:
    """One scorer in a worker for one machine."""
    import hashlib

    key = hashlib.sha256(machine.weights.tobytes() + str(machine.constant).encode()).digest()
    return resident(("toxicity", key), lambda: Scorer(machine))
