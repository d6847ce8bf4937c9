"""Quality rules from tokeniser fertility.

Public vocabularies measure a text: characters per token of a byte-level vocabulary, the share of tokens that fall back to
single bytes in a piece vocabulary, and the entropy of the byte-level tokens. Bands per language, or per script where a
language has none of its own, reject texts outside. Words (runs without ASCII white space) are encoded one by one, so a word's
figures are looked up again wherever it returns.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspan.llm.base import groups_by_size, map_batches, positional, resident
from veilspan.llm.token_store import LibraryEncoder

# The symbols that count, and the base limits.
SYMBOLS = b"#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
WINDOW = 3

CHUNK_CHARS = 1_000_000
REMEMBERED_WORDS = 600_000
LAID_WORDS = 2_000


@dataclass(frozen=True)
class Band:
    """Limits for a language or script: characters per token, share of bytes, and the least entropy of the tokens in bits.

    A longer text repeats its tokens more evenly, so the least entropy is ``entropy + ENTROPY_SLOPE * log2(tokens)``, up to ``entropy_cap``.
    """

    least_chars: float
    most_chars: float
    most_bytes: float
    entropy: float
    entropy_cap: float

    def least_entropy(self, tokens: int) -> float:
        return min(self.entropy + ENTROPY_SLOPE * math.log2(tokens), self.entropy_cap)


ENTROPY_SLOPE = 0.3

#: Prose stays inside whatever its register; signs beside each word, tables, capitals, codes or encoded data fall outside.
BANDS: Mapping[str, Band] = {
    "en": Band(1.6, 8.0, 0.10, 3.3, 6.3),
    "fr": Band(1.4, 8.0, 0.10, 3.2, 6.2),
    "de": Band(1.4, 8.0, 0.10, 3.2, 6.2),
    "es": Band(1.4, 8.0, 0.10, 3.15, 6.15),
    "Latin": Band(1.4, 8.0, 0.15, 3.1, 6.1),
    "Cyrillic": Band(0.5, 2.4, 0.10, 1.8, 4.8),
    "Greek": Band(0.5, 2.0, 0.10, 1.7, 4.7),
    "Arabic": Band(0.5, 2.2, 0.15, 2.0, 5.0),
    "Hebrew": Band(0.45, 1.8, 0.15, 1.3, 4.3),
    "Devanagari": Band(0.35, 1.4, 0.30, 0.8, 3.8),
    "Han": Band(0.3, 1.4, 0.40, 3.0, 6.0),
    "Kana": Band(0.4, 1.8, 0.40, 3.0, 6.0),
    "Hangul": Band(0.25, 1.0, 0.40, 2.0, 5.0),
    "Thai": Band(0.3, 1.3, 0.30, 0.6, 3.6),
    "Other": Band(0.2, 2.0, 0.95, 0.5, 3.5),
}

#: Ranges of code points (first, last) of scripts. Letters outside of them are of no named script.
SCRIPTS = {
    "Latin": [(0x41, 0x5A), (0x61, 0x7A), (0xC0, 0x24F), (0x1E00, 0x1EFF)],
    "Greek": [(0x370, 0x3FF), (0x1F00, 0x1FFF)],
    "Cyrillic": [(0x400, 0x52F), (0x1C80, 0x1C8F), (0x2DE0, 0x2DFF), (0xA640, 0xA69F)],
    "Hebrew": [(0x590, 0x5FF)],
    "Arabic": [(0x600, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFE)],
    "Devanagari": [(0x900, 0x97F)],
    "Thai": [(0xE00, 0xE7F)],
    "Kana": [(0x3040, 0x30FF), (0x31F0, 0x31FF)],
    "Han": [(0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x323AF)],
    "Hangul": [(0x1100, 0x11FF), (0x3130, 0x318F), (0xAC00, 0xD7AF)],
    "Other": [(0x250, 0x2AF), (0x530, 0x58F), (0x700, 0x74F), (0x780, 0x89F), (0x980, 0xDFF), (0xE80, 0x10FF), (0x1200, 0x1C7F), (0x2D00, 0x2DDF), (0xA000, 0xA63F), (0xA6A0, 0xABFF)],
}
_NAMES = list(SCRIPTS)
_RANGES = sorted((first, last, i) for i, name in enumerate(_NAMES) for first, last in SCRIPTS[name])
_STARTS, _ENDS, _OWNERS = (np.array(x) for x in zip(*_RANGES, strict=True))


def script(text: str) -> str:
    """The script of most letters, of equally frequent ones the one that ``SCRIPTS`` names first; ``Kana`` where a sixth of Kana and Han is Kana; ``Latin`` without letters."""
    counts = np.zeros(len(_NAMES), np.int64)
    for start in range(0, len(text), 1 << 16):
        points = np.frombuffer(text[start : start + (1 << 16)].encode("utf-32-le"), np.uint32).astype(np.int64)
        at = np.searchsorted(_STARTS, points, side="right") - 1
        inside = (at >= 0) & (points <= _ENDS[at])
        counts += np.bincount(_OWNERS[at[inside]], minlength=len(_NAMES))
    kana, han = _NAMES.index("Kana"), _NAMES.index("Han")
    if 6 * counts[kana] >= counts[kana] + counts[han]:
        counts[kana], counts[han] = counts[kana] + counts[han], 0
    return _NAMES[int(counts.argmax())]


class WordStore(dict):
    """Numbers of words, and by number the ids and counts of each word's tokens, laid end to end. A new word gets the next number at once; ``fresh`` holds those to learn."""

    def __init__(self, most: int) -> None:
        super().__init__()
        self.most = most
        self.fresh: list[bytes] = []
        self.flat = np.zeros(1 << 16, np.uint32)
        self.figures = np.zeros((1 << 14, 4), np.int64)  # where a word's ids begin, how many, its pieces, those of bytes
        self.used = 0

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self)
        self.fresh.append(word)
        return number

    def add(self, ids: np.ndarray, sizes: np.ndarray, pieces: np.ndarray) -> None:
        """Figures of the fresh words."""
        first, n = len(self) - len(self.fresh), len(self)
        for name, need in (("flat", self.used + len(ids)), ("figures", n)):
            old = getattr(self, name)
            if need > len(old):
                new = np.zeros((max(need, 2 * len(old)), *old.shape[1:]), old.dtype)
                new[: len(old)] = old
                setattr(self, name, new)
        self.flat[self.used : self.used + len(ids)] = ids
        self.figures[first:n, 0] = self.used + np.cumsum(sizes) - sizes
        self.figures[first:n, 1] = sizes
        self.figures[first:n, 2:] = pieces
        self.used += len(ids)
        self.fresh.clear()

    def shorten(self) -> None:
        """Forgets half of the words where there are too many: those that came last, as words that come often come early."""
        if len(self) > self.most:
            kept = list(islice(self.items(), self.most // 2))
            self.clear()
            self.update(kept)
            start, size = self.figures[len(kept) - 1, :2]
            self.used = int(start + size)


class Meter:
    """Counts of words and tokens of a text, by a byte-level tokenizer file and a piece model. Words' figures are remembered within a bound."""

    def __init__(self, tokenizer: str, pieces: str, remembered: int = REMEMBERED_WORDS) -> None:
        import sentencepiece

        self.encoder = LibraryEncoder(tokenizer, special_as_text=True)
        self.model = sentencepiece.SentencePieceProcessor(model_file=pieces)
        n = self.model.get_piece_size()
        self.is_byte = np.array([self.model.is_byte(i) for i in range(n)])
        self.begins = np.array([self.model.id_to_piece(i)[:1] == "\u2581" for i in range(n)])
        self.store = WordStore(remembered)

    def _piece_counts(self, words: list[str]) -> np.ndarray:
        """(pieces, bytes) of each word. Words are laid in a row; where the model finds other beginnings than theirs, halves are, down to one word."""
        laid = " ".join(words)
        ids = np.array(self.model.encode(laid, num_threads=1), np.int64)
        starts = np.flatnonzero(self.begins[ids])
        if len(starts) == len(words) and len(ids) and starts[0] == 0 and "\u2581" not in laid:
            return np.stack((np.diff(starts, append=len(ids)), np.add.reduceat(self.is_byte[ids].astype(np.int64), starts)), axis=1)
        if len(words) > 1:
            half = len(words) // 2
            return np.concatenate((self._piece_counts(words[:half]), self._piece_counts(words[half:])))
        return np.array([[len(ids), int(self.is_byte[ids].sum()) if len(ids) else 0]])

    def numbers(self, texts: list[bytes | None]) -> list[np.ndarray]:
        """The words of each text, by their numbers; new words are learned."""
        self.store.shorten()
        get = self.store.__getitem__
        out = []
        for text in texts:
            words = text.split() if text else []
            out.append(np.fromiter(map(get, words), np.int64, len(words)))
        if self.store.fresh:
            fresh = self.store.fresh
            words = b" ".join(fresh).decode().split(" ")
            pieces = [self._piece_counts(words[i : i + LAID_WORDS]) for i in range(0, len(words), LAID_WORDS)]
            ids, sizes = self.encoder.laid_ids([" " + word for word in words], np.fromiter(map(len, fresh), np.int64, len(fresh)) + 1)
            self.store.add(ids, sizes, np.concatenate(pieces))
        return out

    def measure(self, raw: bytes | None, points: int, which: np.ndarray) -> tuple[int, int, int, int, int, int, int, int, float]:
        """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_tokens, n_pieces, n_bytes and entropy of a text of so many code points and these words."""
        if not raw:
            return 0, 0, 0, 0, 0, 0, 0, 0, 0.0
        symbols = len(raw) - len(raw.translate(None, SYMBOLS))
        if not len(which):
            return 0, 0, symbols, 0, 0, 0, 0, 0, 0.0
        chars = points - (len(raw) - len(raw.translate(None, b" \t\n\v\f\r")))
        lines = [line for line in raw.split(b"\n") if line.strip()]
        figures = self.store.figures[which]
        sizes = figures[:, 1]
        ends = np.cumsum(sizes)
        n = int(ends[-1])
        ids = np.sort(self.store.flat[np.repeat(figures[:, 0] - ends + sizes, sizes) + np.arange(n)])
        counts = np.diff(np.flatnonzero(np.diff(ids, prepend=ids[:1] ^ 1, append=ids[-1:] ^ 1)))
        share = counts / max(n, 1)
        entropy = float(-(share * np.log2(share)).sum()) + 0.0
        n_pieces, n_bytes = figures[:, 2:].sum(0).tolist()
        return len(which), chars, symbols, len(lines) - len(set(lines)), repeated_words(which), n, n_pieces, n_bytes, entropy


def repeated_words(words: np.ndarray) -> int:
    """Words that stand in a window of ``WINDOW`` words found twice or more."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    most = int(words.max()) + 1
    if most**WINDOW >= 1 << 62:
        words = np.unique(words, return_inverse=True)[1]
        most = int(words.max()) + 1
    codes = words[:n].copy()
    for k in range(1, WINDOW):
        codes = codes * most + words[k : k + n]
    found = np.sort(codes)
    again = found[1:][found[1:] == found[:-1]]
    if not len(again):
        return 0
    starts = np.flatnonzero(np.isin(codes, again))
    inside = np.zeros(len(words), bool)
    for k in range(WINDOW):
        inside[starts + k] = True
    return int(inside.sum())


def meter(tokenizer: str, pieces: str) -> Meter:
    return resident(("meter", tokenizer, pieces), lambda: Meter(tokenizer, pieces))


def verdict(band: Band, chars: int, tokens: int, n_pieces: int, n_bytes: int, entropy: float) -> bool:
    """Whether a text's figures are inside a band; a text without tokens is."""
    if not tokens:
        return True
    return band.least_chars <= chars / tokens <= band.most_chars and n_bytes <= band.most_bytes * n_pieces and entropy >= band.least_entropy(tokens)


MEASURES = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, "
    "chars_per_token double, byte_share double, token_entropy double"
)


def apply_rules(docs: DataFrame, tokenizer: str, pieces: str, bands: Mapping[str, Band] | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str | None = "lang", carry: bool = False) -> DataFrame:
    """Measures and verdicts of each row: (doc_id, ``MEASURES``), or with ``carry`` the rows of ``docs`` that are kept, with their own columns.

    A null or empty text has no words, so its base fails. ``lang_col`` may be None or hold nulls: then the script decides. Repeated rows
    each give a row, null ids stay null, an empty table gives no rows. Further columns are ignored (or carried along), whatever
    their names. One pass, no shuffle; texts are taken whole.
    """
    bands = dict(BANDS if bands is None else bands)
    plain, at = positional(docs)
    told = [F.col(at[text_col]).alias("t"), (F.col(at[lang_col]) if lang_col else F.lit(None)).cast("string").alias("l")]
    chosen = plain.select("*", *told) if carry else plain.select(F.col(at[id_col]).alias("doc_id"), *told)
    n = len(chosen.columns)

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        own = meter(tokenizer, pieces)
        column = batch.column(n - 2)
        raw, points, langs = column.cast(pa.binary()).to_pylist(), pc.utf8_length(column).to_pylist(), batch.column(n - 1).to_pylist()
        for start, end in groups_by_size([len(text or b"") for text in raw], CHUNK_CHARS):
            part = batch.slice(start, end - start)
            rows = []
            for i, which in enumerate(own.numbers(raw[start:end]), start):
                text, lang = raw[i], langs[i]
                words, chars, symbols, lines, repeats, tokens, n_pieces, n_bytes, entropy = own.measure(text, points[i] or 0, which)
                failed = words < MIN_WORDS or 100 * repeats > MAX_REPEAT_PERCENT * words
                kept = not failed and verdict(bands.get(lang or "") or bands[script(text.decode())], chars, tokens, n_pieces, n_bytes, entropy)
                rows.append((words, chars, symbols, lines, repeats, failed, kept, chars / tokens if tokens else None, n_bytes / n_pieces if n_pieces else None, entropy))
            if carry:
                keep = pa.array([row[6] for row in rows], pa.bool_())
                yield part.select(range(n - 2)).filter(keep)
            else:
                kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64()] * 3
                arrays = [pa.array(values, kind) for values, kind in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), *arrays], names=["doc_id", *(x.split()[0] for x in MEASURES.split(", "))])

    if carry:
        return chosen.mapInArrow(lambda batches: (out for batch in batches for out in run(batch)), plain.schema).toDF(*docs.columns)
    return map_batches(chosen, run, f"doc_id {dict(chosen.dtypes)['doc_id']}, {MEASURES}")
