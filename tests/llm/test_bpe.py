import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken

from veilspan.llm import bpe

PATH = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(PATH), special_tokens={})


@pytest.fixture(scope="module")
def own():
    return bpe.Codec(PATH, P.PATTERN)


def ids(raw):
    return np.frombuffer(raw, "<u4").tolist()


ODD = ["", " ", "  ", "a  b", "a \n b", "a\n\n  b", " a", "\n", "\0 \0a b\0", "it's I'LL 're", "½² ١٢", "a\x1c\x1cb\x85\x85c", "　x　　y", "a" * 4000, "ab" * 900, " " * 300 + "x", "<|endoftext|>", "\U0001f600" * 9, "é" * 7]


def test_as_the_library(own, library):
    draw = random.Random(3)
    made = ["".join(draw.choice("abcdeth ing'sÉñü日 \n\t12½!#\xa0") for _ in range(draw.randint(0, 40))) for _ in range(3000)]
    texts = ODD + made
    for text, raw in zip(texts, own.encode(texts), strict=True):
        assert ids(raw) == library.encode_ordinary(text), text
        assert own.decode(raw) == text.encode()


def test_small_memory_forgets_but_stays_right(library):
    small = bpe.Codec(PATH, P.PATTERN, remembered=5)
    for text in ["one two three four", "five six seven eight nine", "one two three four"] * 3:
        assert ids(small.encode([text])[0]) == library.encode_ordinary(text)


def test_a_merge_that_makes_a_lower_rank():
    ranks = {bytes([b]): b + 10 for b in range(256)} | {b"ab": 5, b"bc": 400, b"abc": 3, b"aa": 300, b"aaaa": 300_0}
    model = bpe.MergeReplay(ranks)

    def plain(word):
        parts = [bytes([b]) for b in word]
        while True:
            found = [(ranks[x + y], i) for i, (x, y) in enumerate(zip(parts, parts[1:], strict=False)) if x + y in ranks]
            if not found:
                return [ranks[x] for x in parts]
            _, i = min(found)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    draw = random.Random(1)
    words = [bytes(draw.choice(b"abc") for _ in range(draw.randint(1, 12))) for _ in range(500)]
    assert [ids(x) for x in model.replay(words)] == [plain(w) for w in words]


def test_table(spark, awkward, extra, empty, own, library):
    found = bpe.round_trip(extra, PATH, P.PATTERN).collect()
    want = sorted((r.doc_id or 0, tuple(library.encode_ordinary(r.text or ""))) for r in awkward.collect())
    assert sorted((r.doc_id or 0, tuple(ids(r.ids))) for r in found) == want
    assert sorted(bytes(r.decoded) for r in found) == sorted((r.text or "").encode() for r in awkward.collect())
    assert bpe.round_trip(empty, PATH, P.PATTERN).collect() == []
    again = bpe.decode_ids(bpe.round_trip(awkward, PATH, P.PATTERN), PATH, P.PATTERN).collect()
    assert sorted(bytes(r.decoded) for r in again) == sorted(bytes(r.decoded) for r in found)
