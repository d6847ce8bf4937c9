"""Finders and checksums against literal cases and independent arithmetic."""

import datetime
import random
import re

import pytest
from pyspark.sql import functions as F

from veilspan.functions import checksums as C
from veilspan.functions.spans import matches
from veilspan.functions.text import compact, fold, leak_pattern, literal_pattern, normalize_text, text_key, words_pattern
from veilspan.operators import finders as X
from veilspan.operators.windows import model_tokens, token_windows

CASES = [
    (X.find_emails, "Write to a.b+c@mail.example.org, or x@y", ["a.b+c@mail.example.org"]),
    (X.find_emails, "@example.org and a(at)b.cz and .@-.cc", [".@-.cc"]),
    (X.find_emails, "\U0001f600 é a@b.cz.", ["a@b.cz"]),
    (X.find_ocr_emails, "tereza. nova@example. com Next", ["tereza. nova@example. com"]),
    (X.find_urls, "(see https://ex.org/a_(b)). www.x.cz! ex.org ex.org/p, mailto:a@b.cz", ["https://ex.org/a_(b)", "www.x.cz", "ex.org/p"]),
    (X.find_urls, "http:// 3/4 https://", []),
    (X.find_card_numbers, "4111 1111 1111 1111 12/26, 4111-1111-1111-1112, 378282246310005", ["4111 1111 1111 1111", "378282246310005"]),
    (X.find_card_numbers, "99 4111111111111111 and 1234567890123", ["4111111111111111"]),
    (X.find_nanp_phone_numbers, "(212) 555-0100, 1-800-555-0199, 2125550100, 1125550100, 212555010", ["(212) 555-0100", "1-800-555-0199", "2125550100"]),
    (X.find_company_ids, "IČO: 25596641, IC 25596641; 25596641; ičo.25596642", ["25596641", "25596641"]),
    (X.find_us_addresses, "12 Main Street, Springfield, IL 62704-1234 or Salem, XX 12345 or NY 10001", ["12 Main Street, Springfield, IL 62704-1234", "NY 10001"]),
    (X.find_english_birth_dates, "Born on 12th of June 1988; DOB: 2/30/1988; date of birth - 1/2/99; reborn 1/2/99", ["12th of June 1988", "1/2/99"]),
    (X.find_account_numbers, "19-2000145399/0800 a 2000145399/0800 b 12-2000145399/0800", ["19-2000145399/0800", "2000145399/0800"]),
]


def found(spark, array, text):
    return spark.createDataFrame([(text,)], "text string").select(array).first()[0]


@pytest.mark.parametrize("finder,text,want", CASES)
def test_cases(spark, finder, text, want):
    spans = found(spark, finder("text"), text)
    assert [s.text for s in spans] == want
    assert all(text[s.start : s.end] == s.text for s in spans)


def test_no_text(spark):
    rows = spark.createDataFrame([(None,), ("",)], "text string").select(X.find_all("text").alias("s")).collect()
    assert [r.s for r in rows] == [[], []]


def test_languages(spark):
    text = "212-555-0100 and 777 123 456 and a@b.cz"
    rows = spark.createDataFrame([(x,) for x in ("en", "cs-CZ", "xx", None)], "lang string").withColumn("text", F.lit(text))
    kinds = {r.lang: sorted(s.text for s in r.s) for r in rows.select("lang", X.find_all("text", F.col("lang")).alias("s")).collect()}
    both = sorted(["212-555-0100", "777 123 456", "a@b.cz"])
    assert kinds["en"] == ["212-555-0100", "a@b.cz"] and kinds["cs-CZ"] == ["777 123 456", "a@b.cz"] and kinds["xx"] == kinds[None] == both
    assert len(X.finders_for("en-US")) == 7 and len(X.finders_for(None)) == len(X.ALL)


def test_offsets_as_in_python(spark):
    draw = random.Random(11)
    texts = ["".join(draw.choice("ab1 é\n\U0001f600-") for _ in range(draw.randint(0, 200))) for _ in range(300)]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string").select("i", matches("text", r"(?U)(?<!-)\w+(?:-\w+)?").alias("s")).collect()
    for r in rows:
        assert [(s.start, s.end, s.text) for s in r.s] == [(m.start(), m.end(), m[0]) for m in re.finditer(r"(?<!-)\w+(?:-\w+)?", texts[r.i])]


def test_windows_reach_the_end(spark):
    rows = spark.createDataFrame([(n, " ".join("w" for _ in range(n))) for n in (0, 1, 149, 150, 151, 260, 261, 1000)], "n int, text string")
    for r in rows.select("n", token_windows(model_tokens("text")).alias("w")).collect():
        want, first = [], 0
        while first < r.n:
            want.append((first, min(first + 150, r.n)))
            if first + 150 >= r.n:
                break
            first += 110
        assert [(w.first, w.last) for w in r.w] == want


def luhn(d):
    return sum(sum(divmod(int(x) * (1 + i % 2), 10)) for i, x in enumerate(reversed(d))) % 10 == 0


def mod11(d, weights):
    return sum(int(x) * w for x, w in zip(d.rjust(len(weights), "0"), weights, strict=True)) % 11 == 0


def born(d):
    y, m, day = 1900 + int(d[:2]), int(d[2:4]), int(d[4:6])
    m -= 50 * (m > 50)
    m -= 20 * (m > 20)
    day -= 40 * (day > 40)
    y += 100 * (len(d) == 10 and y < 1954)
    try:
        return datetime.date(y, m, day)
    except ValueError:
        return None


def birth_number(d):
    date = born(d)
    if date is None:
        return False
    return date.year < 1954 if len(d) == 9 else int(d[:9]) % 11 % 10 == int(d[9])


def test_checksums(spark):
    draw = random.Random(13)
    digits = ["".join(draw.choice("0123456789") for _ in range(draw.choice([2, 6, 8, 9, 10, 16]))) for _ in range(3000)]
    for _ in range(1500):
        head = f"{draw.randrange(100):02d}{draw.choice([draw.randint(1, 12), draw.randint(51, 62), draw.randint(21, 32), draw.randint(71, 82)]):02d}{draw.choice([draw.randint(1, 31), draw.randint(41, 71)]):02d}{draw.randrange(1000):03d}"
        digits.append(head + str(int(head) % 11 % 10) if draw.random() < 0.7 else head)
    rows = spark.createDataFrame([(d,) for d in digits], "d string")
    d = F.col("d")
    for r in rows.select("d", C.valid_account_number(d).alias("a"), C.valid_company_id(d).alias("c"), C.valid_birth_number(d).alias("b"), C.valid_card(d).alias("k"), C.mod97(d).alias("m")).collect():
        assert r.a == (2 <= len(r.d) <= 10 and int(r.d) > 0 and mod11(r.d, C.BASE_WEIGHTS))
        rest = sum(int(x) * w for x, w in zip(r.d, range(8, 1, -1), strict=False)) % 11 if len(r.d) == 8 else None
        assert r.c == (len(r.d) == 8 and int(r.d[7]) == {0: 1, 1: 0}.get(rest, 11 - (rest or 0)))
        assert r.b == (len(r.d) in (9, 10) and birth_number(r.d))
        assert not r.k or luhn(r.d)
        assert r.m == int(r.d) % 97


def test_bad_values_are_just_invalid(spark):
    rows = spark.createDataFrame([(None,), ("",), ("abc",), ("12x",), ("9" * 60,)], "d string")
    d = F.col("d")
    for r in rows.select(C.valid_account_number(d), C.valid_company_id(d), C.valid_birth_number(d), C.valid_card(d), C.valid_iban(d)).collect():
        assert not any(r)


def test_text_helpers(spark):
    one = lambda column, text: spark.createDataFrame([(text,)], "t string").select(column).first()[0]
    t = F.col("t")
    assert one(normalize_text("t"), "é") == "é" and one(normalize_text("t"), "plain") == "plain" and one(normalize_text("t"), None) is None
    assert one(fold(t), "ČERVNA") == "cervna" and one(compact(t), " a b c\n") == "abc"
    assert one(text_key(t), " \n") is None and one(text_key(t), "é x") == one(text_key(t), "éx")
    for text, inside, outside in [("Jan Novák", "x Jan\n Novák y", "xJan Novák"), ("a.b(c", "a.b(c", "aab(c"), ("x\\Ey", "x\\Ey", "xEy")]:
        assert re.search(".", inside) and one(F.regexp_count(F.lit(inside), words_pattern(t)), text) == 1 and one(F.regexp_count(F.lit(outside), words_pattern(t)), text) == 0
    assert one(F.regexp_count(F.lit("No vák, Nováka, xNovák"), leak_pattern(t)), "Novák") == 2
    assert one(F.regexp_count(F.lit("Al. Alan"), leak_pattern(t)), "Al") == 1 and one(F.regexp_count(F.lit("1234 123 123.5 123."), leak_pattern(t)), "123") == 2
    assert one(F.regexp_count(F.lit("9.200012 (20001 12)"), literal_pattern(t)), "20001") == 1
