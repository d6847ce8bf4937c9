"""Spans of text from regular expressions, without Python workers.

Matches and the pieces between them come from the same search, so their lengths add up to offsets in code points. Patterns are Java's and must
never match the empty string.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

EMPTY = "array<struct<type: string, start: int, end: int, text: string>>"


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def no_spans() -> Column:
    return F.array().cast(EMPTY)


def span(kind: str | Column, start: Column, end: Column, text: Column) -> Column:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    return F.struct(kind.alias("type"), start.cast("int").alias("start"), end.cast("int").alias("end"), text.alias("text"))


BLOCK = 64


def _running(sizes: Column, first: Column) -> Column:
    """For each size, ``first`` and the sizes before it."""
    zero = F.struct(first.cast("int").alias("total"), F.array().cast("array<int>").alias("starts"))
    step = lambda a, size: F.struct((a["total"] + size).cast("int").alias("total"), F.concat(a["starts"], F.array(a["total"])).alias("starts"))
    return F.aggregate(sizes, zero, step, lambda a: a["starts"])


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once. Functions over arrays aren't compiled, so what they name twice they compute twice."""
    return F.get(F.transform(F.array(value), body), 0)


def lengths_before(parts: Column) -> Column:
    """For each part, the length of all parts before it. Growing an array in a fold copies it, so blocks are summed first and then walked each by itself."""

    def laid(sizes: Column) -> Column:
        n = F.size(sizes)
        firsts = F.when(n == 0, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(1), n, F.lit(BLOCK)))
        blocks = F.transform(firsts, lambda i: F.slice(sizes, i, F.lit(BLOCK)))
        return let(blocks, over)

    def over(blocks: Column) -> Column:
        totals = F.transform(blocks, lambda block: F.aggregate(block, F.lit(0), lambda a, x: a + x))
        return F.flatten(F.zip_with(blocks, _running(totals, F.lit(0)), _running))

    return let(F.transform(parts, lambda p: F.length(p)), laid)


def matches(text: Column | str, pattern: str | Column, kind: str = "other", group: int = 0, before_group: int | None = None, needs: Column | None = None) -> Column:
    """Spans of every match, in order; null text has none.

    ``group`` is reported instead of the whole match; ``before_group`` must then hold all that the match has before it.
    ``needs`` is a cheap necessary condition: rows without it aren't searched.
    """
    text = _col(text)
    pattern = F.lit(pattern) if isinstance(pattern, str) else pattern
    all_of = lambda k: F.regexp_extract_all(text, pattern, F.lit(k))

    def found(x: Column) -> Column:
        # Gaps and matches in turn; a match's offset is the length of all before it.
        laid = F.flatten(F.zip_with(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(x["whole"])), x["whole"], lambda g, m: F.array(g, m)))
        starts = F.filter(lengths_before(laid), lambda _, i: i % 2 == 1)
        if group == 0:
            return F.zip_with(starts, x["whole"], lambda s, m: span(kind, s, s + F.length(m), m))
        if before_group is not None:
            starts = F.zip_with(starts, all_of(before_group), lambda s, b: s + F.length(b))
        return F.zip_with(starts, all_of(group), lambda s, v: span(kind, s, s + F.length(v), v))

    spans = let(F.struct(all_of(0).alias("whole")), lambda x: F.when(F.size(x["whole"]) > 0, found(x)).otherwise(no_spans()))
    some = text.isNotNull() if needs is None else F.coalesce(needs, F.lit(False)) & text.isNotNull()
    return F.when(some, spans).otherwise(no_spans())


def piece(text: Column, start: Column, end: Column) -> Column:
    """The text from one offset to another."""
    return F.substring(text, start + 1, end - start)


def overlap(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    return (a_start < b_end) & (b_start < a_end)


def contains(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """Whether the first span holds the second."""
    return (a_start <= b_start) & (b_end <= a_end)


def exploded(df, array: str | Column, keep: list[str]):
    """A row for each span of an array column: ``keep``, ordinal, type, start, end, text."""
    rows = df.select(*keep, F.posexplode(_col(array)).alias("ordinal", "span"))
    return rows.select(*keep, "ordinal", "span.type", "span.start", "span.end", "span.text")
