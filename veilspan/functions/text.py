"""Text helpers: normal form, folding, white space, patterns made from data."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: White space as Python's ``str.isspace`` sees it, for Java patterns.
SPACE = r"[\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
# Letters with marks of the languages at hand, and what they fold to.
MARKED = "áäàâãåąčćçďđéěëèêęíïìîĺľłñňńóôöòõőŕřśšșťțúůüùûűýÿžźż"
PLAIN = "aaaaaaacccddeeeeeeiiiilllnnnoooooorrsssttuuuuuuyyzzz"


def _nfc(text: pd.Series) -> pd.Series:
    return text.map(lambda x: unicodedata.normalize("NFC", x), na_action="ignore")


#: Ranges of characters that NFC never changes and that never join what stands before them; a test asks Python's tables.
NORMAL = [(0x0, 0x2FF), (0x400, 0x482), (0x48A, 0x52F), (0x2010, 0x2027), (0x2030, 0x205E), (0x20A0, 0x20C0), (0x3001, 0x3029), (0x3041, 0x3096), (0x30A1, 0x30FA), (0x4E00, 0x9FFF), (0xAC00, 0xD7A3)]
BATCH_ROWS = 500


def normalize_text(text: Column | str) -> Column:
    """Unicode NFC. A text of the ranges ``NORMAL`` has that form, so the workers get a null in its place and only other texts travel, at most ``BATCH_ROWS`` at once where the session has Spark's default."""
    text = F.col(text) if isinstance(text, str) else text
    session, key = SparkSession.getActiveSession(), "spark.sql.execution.arrow.maxRecordsPerBatch"
    if session is not None and session.conf.get(key, "10000") == "10000":
        session.conf.set(key, str(BATCH_ROWS))
    kept = "".join(rf"\x{{{first:x}}}-\x{{{last:x}}}" for first, last in NORMAL)
    return F.coalesce(F.pandas_udf(_nfc, "string")(F.when(~text.rlike(rf"\A[{kept}]*+\z"), text)), text)


def fold(text: Column) -> Column:
    """Lower case without marks."""
    return F.translate(F.lower(text), MARKED, PLAIN)


def compact(text: Column) -> Column:
    """Without any white space."""
    return F.regexp_replace(text, SPACE, "")


def visible_length(text: Column) -> Column:
    """Characters that aren't white space."""
    return F.length(compact(text))


def text_key(text: Column) -> Column:
    """SHA-256 of the text's NFC form without white space; null for none."""
    bare = compact(normalize_text(text))
    return F.when(bare != "", F.sha2(bare.cast("binary"), 256))


def quoted(text: Column) -> Column:
    r"""The text as a literal for a pattern."""
    return F.concat(F.lit("\\Q"), F.replace(text, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))


def words_pattern(text: Column, whole_words: bool = True) -> Column:
    """A pattern for the text's words with any white space between them, not inside longer words."""
    words = F.filter(F.split(text, SPACE + "+"), lambda w: w != "")
    body = F.array_join(F.transform(words, quoted), SPACE + "+")
    return F.concat(F.lit(r"(?U)(?<!\w)"), body, F.lit(r"(?!\w)")) if whole_words else body


def _apart(bare: Column) -> Column:
    return F.array_join(F.transform(F.filter(F.split(bare, ""), lambda c: c != ""), quoted), SPACE + "*")


def leak_pattern(text: Column) -> Column:
    """A pattern for a leaked text: from a word's start, white space anywhere inside, also run on into a longer word.

    A text that ends in a digit must not go on as a number. One or two characters must stand as a whole word, with white space only where the text has it.
    """
    bare = compact(text)
    short = F.length(bare) < 3
    words = F.filter(F.split(text, SPACE + "+"), lambda w: w != "")
    body = F.when(short, F.array_join(F.transform(words, quoted), SPACE + "*")).otherwise(_apart(bare))
    first = F.when(bare.rlike(r"(?U)^\w"), F.lit(r"(?<!\w)")).otherwise(F.lit(""))
    number = F.when(bare.rlike(r"(?U)\d\z"), F.lit(r"(?!\d)(?!\.\d)")).otherwise(F.lit(""))
    whole = F.when(short & bare.rlike(r"(?U)\w\z"), F.lit(r"(?!\w)")).otherwise(F.lit(""))
    return F.concat(F.lit("(?U)"), first, body, number, whole)


def literal_pattern(text: Column) -> Column:
    """A pattern for a text as files store it: white space anywhere, and no digit of a longer number at either end."""
    bare = compact(text)
    first = F.when(bare.rlike(r"(?U)^\d"), F.lit(r"(?<!\d)(?<!\d\.)")).otherwise(F.lit(""))
    last = F.when(bare.rlike(r"(?U)\d\z"), F.lit(r"(?!\d)(?!\.\d)")).otherwise(F.lit(""))
    return F.concat(F.lit("(?U)"), first, _apart(bare), last)
