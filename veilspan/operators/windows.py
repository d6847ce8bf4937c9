"""Tokens and windows of texts for span models, and what comes back from such models."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilspan.functions.spans import _col, let, matches, piece

# A model's tokens, the size of its windows and by how much they overlap.
TOKEN = r"(?U)\w+(?:[-_]\w+)*|\S"
WINDOW_TOKENS, OVERLAP_TOKENS = 150, 40
EDGE = r""",;:!?()\[\]{}"'„“”«»"""
SPACE = r"(?U)\s"
NEAR = 256  # characters


def model_tokens(text: Column | str) -> Column:
    return matches(text, TOKEN, "token")


def token_count(text: Column | str) -> Column:
    """How many tokens a text has; null text has none."""
    return F.coalesce(F.size(F.regexp_extract_all(_col(text), F.lit(TOKEN), F.lit(0))), F.lit(0))


def window_bounds(count: Column, window: int = WINDOW_TOKENS, overlap: int = OVERLAP_TOKENS) -> Column:
    """(first, last) of each window over so many tokens; the last one reaches the end."""
    step = window - overlap
    firsts = F.when(count == 0, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(0), F.greatest(F.ceil((count - window) / step), F.lit(0)).cast("int") * step, F.lit(step)))
    return F.transform(firsts, lambda first: F.struct(first.cast("int").alias("first"), F.least(first + window, count).cast("int").alias("last")))


def token_windows(tokens: Column, window: int = WINDOW_TOKENS, overlap: int = OVERLAP_TOKENS) -> Column:
    """(first, last, start, end) of each window over an array of tokens; the last one reaches the end."""

    def cut(own: Column) -> Column:
        edges = lambda w: F.struct(w["first"].alias("first"), w["last"].alias("last"), F.get(own, w["first"])["start"].alias("start"), F.get(own, w["last"] - 1)["end"].alias("end"))
        return F.transform(window_bounds(F.size(own), window, overlap), edges)

    return let(tokens, cut)


def widen_to_words(text: Column | str, start: Column, end: Column) -> Column:
    """(start, end) of the whole words that a span touches, without edge signs and a sentence's full stop; null if nothing is left.

    Each step's value is bound once: written out, the steps name one another so often that a plan with this expression doesn't fit the driver.
    """
    text = _col(text)

    def reach(near: Column, whole: Column, pattern: str) -> Column:
        # A word seldom goes beyond what lies near; where it does, the whole text is asked.
        told = lambda x: let(F.length(F.regexp_extract(x, pattern, 0)), lambda n: F.when(n < F.length(x), n).otherwise(F.length(F.regexp_extract(whole, pattern, 0))))
        return let(near, told)

    left = start - reach(piece(text, F.greatest(start - NEAR, F.lit(0)), start), piece(text, F.lit(0), start), r"(?U)\S*\z")
    right = end + reach(F.substring(text, end + 1, F.lit(NEAR)), F.substring(text, end + 1, F.length(text)), r"(?U)^\S*")

    def cut(start: Column, end: Column) -> Column:
        inner = lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), piece(text, x["start"], x["end"]).alias("inner"))
        return let(F.struct(start.cast("int").alias("start"), end.cast("int").alias("end")), inner)

    def stripped(x: Column) -> Column:
        before = F.length(F.regexp_extract(x["inner"], rf"(?U)^[\s{EDGE}]*", 0))
        after = lambda n: F.when(n < F.length(x["inner"]), F.length(F.regexp_extract(x["inner"], rf"(?U)[\s{EDGE}]*\z", 0))).otherwise(0)
        return let(before, lambda n: cut(x["start"] + n, x["end"] - after(n)))

    def unstopped(x: Column) -> Column:
        word = F.regexp_extract(x["inner"], r"(?U)\S+\z", 0)
        stop = let(word, lambda w: w.endswith(".") & (F.length(F.regexp_replace(w, r"[^.]", "")) == 1) & (F.length(w) > 1))
        return F.struct(x["start"].alias("start"), (x["end"] - stop.cast("int")).cast("int").alias("end"))

    closed = lambda x: x["inner"].rlike(rf"[{EDGE}]\.\z")
    twice = let(let(cut(left, right), stripped), lambda x: F.when(closed(x), let(cut(x["start"], x["end"] - 1), stripped)).otherwise(x))
    return let(let(twice, unstopped), lambda x: F.when(x["end"] > x["start"], x))


def model_entities(pages: DataFrame, spans: DataFrame, labels: dict[str, str]) -> DataFrame:
    """Model spans (doc_id, page_index, start, end, label, score) as findings: known labels, whole words, two letters or digits, scores in [0, 1]."""
    kinds = F.create_map(*(F.lit(x) for pair in labels.items() for x in pair))
    known = spans.withColumn("type", F.try_element_at(kinds, "label")).where("type IS NOT NULL")
    wide = known.join(pages.select("doc_id", "page_index", F.col("text").alias("_page")), ["doc_id", "page_index"])
    whole = let(widen_to_words("_page", F.col("start"), F.col("end")), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), piece(F.col("_page"), x["start"], x["end"]).alias("text")))
    # Exploded and not filtered afterwards: a condition would be pushed below and widen again.
    said = F.filter(F.array(whole), lambda x: F.length(F.regexp_replace(x["text"], r"[^\p{L}\p{N}]", "")) >= 2)
    cut = wide.select("doc_id", "page_index", "type", F.least(F.greatest("score", F.lit(0.0)), F.lit(1.0)).alias("score"), F.explode(said).alias("_cut"))
    return cut.select("doc_id", "page_index", "type", F.col("_cut.start").alias("start"), F.col("_cut.end").alias("end"), "score", F.col("_cut.text").alias("text"))


def word_windows(sizes: list[int], body: int, overlap: int = 64) -> list[tuple[int, int]]:
    """Ranges of words whose pieces fit ``body``, each repeating at most ``overlap`` pieces of the one before; a longer word stands alone.

    Sums of sizes tell by bisection where a range ends and where the next one begins.
    """
    sums, n, at = [0, *accumulate(sizes)], len(sizes), 0
    out: list[tuple[int, int]] = []
    while at < n:
        stop = max(bisect_right(sums, sums[at] + body) - 1, at + 1)
        out.append((at, stop))
        at = n if stop == n else max(bisect_left(sums, sums[stop] - overlap), at + 1)
    return out


def most_context(predictions: DataFrame) -> DataFrame:
    """(doc_id, word, distribution): of each word's predictions (doc_id, window, size, offset, word, distribution), that with most context on its shorter side; the first of equals."""
    room = F.least(F.col("offset"), F.col("size") - 1 - F.col("offset"))
    best = F.max_by("distribution", F.struct(room.alias("room"), (-F.col("window")).alias("window")))
    return predictions.groupBy("doc_id", "word").agg(best.alias("distribution"))


def decode(words: DataFrame, labels: list[str]) -> DataFrame:
    """Spans (doc_id, first, last, type, score) of words (doc_id, word, distribution) by their likeliest BIO labels.

    An I- label after O or another type opens a span; the score is the mean probability of the type.
    """
    names = F.array(*(F.lit(x) for x in labels))
    best = F.element_at(names, F.array_position(F.col("distribution"), F.array_max("distribution")).cast("int"))
    kind = F.when(best == "O", None).otherwise(F.substring(best, 3, 100))
    pairs = F.zip_with(names, "distribution", lambda name, p: F.when(F.substring(name, 3, 100) == F.col("type"), p).otherwise(0.0))
    typed = words.withColumn("label", best).withColumn("type", kind)
    scored = typed.withColumn("p", F.aggregate(pairs, F.lit(0.0).cast("double"), lambda a, x: a + x))
    return spans_of_labels(scored, "p")


def spans_of_labels(words: DataFrame, score: str | None = None) -> DataFrame:
    """Gaps and islands over words (doc_id, word, label, type): a span goes on while an I- label of the same type follows at once."""
    order = Window.partitionBy("doc_id").orderBy("word")
    inside = words.withColumn("_type", F.lag("type").over(order))
    opens = F.col("type").isNotNull() & ~(F.col("label").startswith("I-") & F.col("type").eqNullSafe(F.col("_type")))
    numbered = inside.withColumn("_span", F.sum(opens.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))).where("type IS NOT NULL")
    out = numbered.groupBy("doc_id", "_span").agg(F.min("word").alias("first"), F.max("word").alias("last"), F.first("type").alias("type"), *([F.avg(score).alias("score")] if score else []))
    return out.drop("_span")


def bio_labels(types: list[str]) -> list[str]:
    return ["O", *(f"{mark}-{kind}" for kind in types for mark in "BI")]


def nested_entities(labels: list[list[tuple[str, float]]]) -> list[tuple[str, int, int, float]]:
    """(type, first, last, score) of a sentence's nested labels, outermost first for each token; the score is the least of the label's.

    Each depth is a question of islands: a token goes on with the one before it where both have a label at that depth, the label is an I- one of the same type, and all
    outer depths go on too. Of spans alike in type and place the outer one counts.
    """
    n = len(labels)
    found: dict[tuple[str, int, int], float] = {}
    goes_on = [i > 0 for i in range(n)]
    for depth in range(max(map(len, labels), default=0)):
        own = [x[depth] if len(x) > depth else None for x in labels]
        goes_on = [goes_on[i] and own[i] is not None and own[i - 1] is not None and own[i][0] == "I-" + own[i - 1][0][2:] for i in range(n)]
        for first in range(n):
            if own[first] is not None and not goes_on[first]:
                last = next((i for i in range(first, n - 1) if not goes_on[i + 1]), n - 1)
                found.setdefault((own[first][0][2:], first, last), min(p for _, p in own[first : last + 1]))
    return sorted(((kind, first, last, score) for (kind, first, last), score in found.items()), key=lambda x: (x[1], -x[2]))


def address_runs(parts: DataFrame, tokens: DataFrame, anchors: list[str]) -> DataFrame:
    """(doc_id, first, last, score): address parts (doc_id, label, first, last, score) joined where they overlap or only punctuation lies between.

    ``tokens`` (doc_id, token, text). Runs without a part of ``anchors`` are dropped; a run has its weakest part's score.
    """
    order = Window.partitionBy("doc_id").orderBy("first", "last")
    before = parts.withColumn("_last", F.max("last").over(order.rowsBetween(Window.unboundedPreceding, -1))).withColumn("_n", F.row_number().over(order))
    words = tokens.where(F.col("text").rlike(r"[\p{L}\p{N}]")).select(F.col("doc_id").alias("_d"), F.col("token").alias("_t"))
    between = before.join(words, (F.col("doc_id") == F.col("_d")) & (F.col("_t") > F.col("_last")) & (F.col("_t") < F.col("first")), "left_semi").select("doc_id", "_n", F.lit(True).alias("_cut"))
    flagged = before.join(between, ["doc_id", "_n"], "left").withColumn("_new", (F.col("_last").isNull() | F.coalesce("_cut", F.lit(False))).cast("int"))
    numbered = flagged.withColumn("_run", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    runs = numbered.groupBy("doc_id", "_run").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.min("score").alias("score"), F.bool_or(F.col("label").isin(*anchors)).alias("anchored"))
    return runs.where("anchored").select("doc_id", "first", "last", "score")
