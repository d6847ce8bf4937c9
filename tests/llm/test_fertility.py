import math
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
from tokenizers import Tokenizer

from pyspark.sql import functions as F

from veilspan.llm import fertility as Q

FILES = (P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model"))


def plain(text):
    text = text or ""
    words = [w for w in re.split("[\x20\x09-\x0d]+", text) if w]
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    inside = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search("[^\x20\x09-\x0d]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(inside)


@pytest.fixture(scope="module")
def meter():
    return Q.Meter(*FILES)


def measure(meter, text):
    raw = (text or "").encode()
    return meter.measure(raw, len(text or ""), meter.numbers([raw])[0])


def test_base_figures(meter):
    draw = random.Random(5)
    texts = ["".join(draw.choice(["a", "b ", "c\n", "é", " ", "#", "\x0b", "\x1c", "日 ", "|"]) for _ in range(draw.randint(0, 120))) for _ in range(400)]
    for text in [*texts, "", " \n", "a b c a b c", "x\nx\n\nx", "a b ▁ ▁x"]:
        assert measure(meter, text)[:5] == plain(text), repr(text)


def test_tokens_as_the_libraries(meter):
    library, model = Tokenizer.from_file(FILES[0]), sentencepiece.SentencePieceProcessor(model_file=FILES[1])
    library.encode_special_tokens = True
    for text in ["Plain words here", "日本語 ½ ▁x ▁ a\xa0b ​ q", "<|endoftext|> x", "\U0001f600 é"]:
        words = [w.decode() for w in text.encode().split()]
        ids = [i for w in words for i in library.encode(" " + w, add_special_tokens=False).ids]
        pieces = [i for w in words for i in model.encode(w)]
        found = measure(meter, text)
        assert found[5:8] == (len(ids), len(pieces), sum(map(model.is_byte, pieces)))
        share = np.array(list(Counter(ids).values())) / len(ids)
        assert found[8] == pytest.approx(-sum(s * math.log2(s) for s in share))


def test_small_memory(meter):
    small = Q.Meter(*FILES, remembered=4)
    for text in ["one two three four five six", "seven eight nine ten", "one two seven"] * 3:
        assert measure(small, text) == measure(meter, text)


def test_verdicts(meter):
    prose = " ".join(random.Random(1).choice("time people water under morning letter garden simple because through".split()) + "s" * (i % 3) for i in range(400))
    signs = " ".join(f"{w}###" for w in prose.split())
    coded = " ".join("".join(random.Random(i).choice("0123456789abcdef") for _ in range(32)) for i in range(80))
    verdict = lambda text: (lambda m: Q.verdict(Q.BANDS["en"], m[1], m[5], m[6], m[7], m[8]))(measure(meter, text))
    assert Q.verdict(Q.BANDS["en"], 0, 0, 0, 0, 0.0)
    assert not verdict("一" * 400 + " 丁丂" * 60) or not verdict(coded)
    assert measure(meter, signs)[8] < measure(meter, prose)[8] + 1


def test_script():
    assert Q.script("plain é") == "Latin" and Q.script("日本語 ab") == "Han" and Q.script("ひらがな漢字") == "Kana" and Q.script("ქართული") == "Other" and Q.script("") == "Latin" and Q.script("123 …") == "Latin"


def test_table(awkward, extra, empty):
    found = Q.apply_rules(extra, *FILES).collect()
    want = sorted((r.doc_id or 0, *plain(r.text)) for r in awkward.collect())
    assert sorted((r.doc_id or 0, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in found) == want
    assert all(r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and not (r.base_failed and r.kept) for r in found)
    assert Q.apply_rules(empty, *FILES).collect() == []
    carried = Q.apply_rules(awkward, *FILES, carry=True)
    assert carried.columns == awkward.columns
    clashing = awkward.withColumns({c: F.lit("more") for c in ("_text", "_lang", "_kept", "t", "doc_ids")})
    clashing = clashing.toDF(*clashing.columns[:-1], "DOC_ID")
    kept = [r.kept for r in Q.apply_rules(awkward, *FILES).collect()]
    carried = Q.apply_rules(clashing, *FILES, carry=True)
    assert carried.columns == clashing.columns and carried.collect() == [r for r, k in zip(clashing.collect(), kept, strict=True) if k]
    assert Q.apply_rules(awkward, *FILES, lang_col=None).count() == 10


PROSE = {
    "Cyrillic": "Все люди рождаются свободными и равными в своем достоинстве и правах. Они наделены разумом и совестью. ",
    "Greek": "Όλοι οι άνθρωποι γεννιούνται ελεύθεροι και ίσοι στην αξιοπρέπεια και τα δικαιώματα. ",
    "Arabic": "يولد جميع الناس أحرارا متساوين في الكرامة والحقوق. وقد وهبوا عقلا وضميرا. ",
    "Hebrew": "כל בני האדם נולדו בני חורין ושווים בערכם ובזכויותיהם. כולם חוננו בתבונה ובמצפון. ",
    "Devanagari": "सभी मनुष्यों को गौरव और अधिकारों के मामले में जन्मजात स्वतन्त्रता और समानता प्राप्त है। ",
    "Han": "人人生而自由，在尊严和权利上一律平等。他们赋有理性和良心，并应以兄弟关系的精神相对待。",
    "Kana": "すべての人間は、生まれながらにして自由であり、かつ、尊厳と権利とについて平等である。",
    "Hangul": "모든 인간은 태어날 때부터 자유로우며 그 존엄과 권리에 있어 동등하다. ",
    "Thai": "มนุษย์ทั้งหลายเกิดมามีอิสระและเสมอภาคกันในเกียรติศักดิ์และสิทธิ ",
    "Latin": "All human beings are born free and equal in dignity and rights. They are endowed with reason and conscience and should act towards one another in a spirit of brotherhood. ",
}


@pytest.mark.parametrize("name", PROSE)
def test_each_script_has_its_band(name):
    """Prose stays inside its script's band; the same bytes read in a wrong way, or one sign over and over, fall outside."""
    meter = Q.meter(*FILES)

    def inside(text):
        raw = text.encode()
        words, chars, *_, tokens, n_pieces, n_bytes, entropy = meter.measure(raw, len(text), meter.numbers([raw])[0])
        return Q.verdict(Q.BANDS[Q.script(text)], chars, tokens, n_pieces, n_bytes, entropy)

    assert Q.script(PROSE[name]) == name and inside(PROSE[name])
    assert not inside(PROSE[name][0] * 300)
    if name != "Latin":
        assert not inside(PROSE[name].encode().decode("latin-1"))
