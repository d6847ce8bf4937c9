"""Joining the findings of several detectors: merge, agreement, outermost spans.

All of these are joins on (doc_id, page_index, surface_id) with a condition on the offsets, so a hot document spreads no further than its own spans. Long pages
are cut into cells of ``CELL`` characters, which keeps a join from comparing spans that lie far apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspan.functions.spans import contains, let, overlap
from veilspan.schema import PRIORITY, REGION

PLACE = ["doc_id", "page_index", "surface_id"]
CELL = 512


def rank(kind: Column, priority: list[str] = PRIORITY) -> Column:
    """Place of a type in the order of strength; types that aren't listed come last."""
    table = F.create_map(*(F.lit(x) for i, name in enumerate(priority) for x in (name, i)))
    return F.coalesce(F.try_element_at(table, kind), F.lit(len(priority)))


def same_place(a: str, b: str) -> Column:
    """Null-safe equality of the places of two aliased relations."""
    out = F.col(f"{a}.doc_id") == F.col(f"{b}.doc_id")
    for name in PLACE[1:]:
        out = out & F.col(f"{a}.{name}").eqNullSafe(F.col(f"{b}.{name}"))
    return out


def with_places(df: DataFrame) -> DataFrame:
    """The relation with null ``page_index``, ``surface_id`` and ``score`` where it has none."""
    for name, kind in (("page_index", "int"), ("surface_id", "string"), ("score", "double")):
        if name not in df.columns:
            df = df.withColumn(name, F.lit(None).cast(kind))
    return df


def _cells(df: DataFrame) -> DataFrame:
    """A row for each cell that a span touches."""
    last = F.greatest(F.col("end") - 1, F.col("start"))
    return df.withColumn("cell", F.explode(F.sequence(F.floor(F.col("start") / CELL), F.floor(last / CELL))))


def order_columns(priority: list[str] = PRIORITY) -> Column:
    """Smaller means earlier: type, longer, higher score, earlier, first found."""
    return F.struct(
        rank(F.col("type"), priority).alias("rank"), (F.col("start") - F.col("end")).alias("size"), (-F.coalesce(F.col("score"), F.lit(1.0))).alias("score"), F.col("start").alias("start"), F.col("ordinal").alias("ordinal")
    )


def merge_entities(spans: DataFrame, priority: list[str] = PRIORITY) -> DataFrame:
    """Spans that no stronger or longer span of the same place holds. Partial overlaps stay, regions stay.

    A container that is dropped itself lies in one that stays, so one anti join decides all. Of spans alike in all but ``ordinal`` the first stays.
    """
    spans = with_places(spans)
    text = spans.where(F.col("type") != REGION).withColumn("_order", order_columns(priority))
    # A container touches the cell of the held span's start, so the held side needs that cell alone.
    inner = text.withColumn("cell", F.floor(F.col("start") / CELL)).alias("a")
    outer = _cells(text.select(*PLACE, "start", "end", "_order")).alias("b")
    held = same_place("a", "b") & (F.col("a.cell") == F.col("b.cell")) & contains(F.col("b.start"), F.col("b.end"), F.col("a.start"), F.col("a.end")) & (F.col("b._order") < F.col("a._order"))
    kept = inner.join(outer, held, "left_anti").drop("_order", "cell")
    return kept.unionByName(spans.where(F.col("type") == REGION))


def merged_spans(spans: Column, priority: list[str] = PRIORITY) -> Column:
    """The same for an array of spans of one place, in their order: nothing is shuffled, as a place's spans stand in one row already."""

    def kept(own: Column) -> Column:
        placed = F.transform(own, lambda s, i: F.struct(F.struct(rank(s["type"], priority).alias("rank"), (s["start"] - s["end"]).alias("size"), s["start"].alias("start"), i.alias("i")).alias("order"), s.alias("span")))
        return let(placed, outer)

    def outer(placed: Column) -> Column:
        def held(x: Column) -> Column:
            inside = lambda y: contains(y["span"]["start"], y["span"]["end"], x["span"]["start"], x["span"]["end"]) & (y["order"] < x["order"])
            return F.exists(placed, inside)

        return F.transform(F.filter(placed, lambda x: ~held(x)), lambda x: x["span"])

    return let(spans, lambda own: F.when(F.size(own) < 2, own).otherwise(kept(own)))


def outermost(spans: DataFrame) -> DataFrame:
    """Spans that lie in no other span of their type; repeated ones once."""
    unique = with_places(spans).dropDuplicates([*PLACE, "type", "start", "end"])
    a, b = unique.withColumn("cell", F.floor(F.col("start") / CELL)).alias("a"), _cells(unique.select(*PLACE, "type", "start", "end")).alias("b")
    longer = (F.col("b.end") - F.col("b.start")) > (F.col("a.end") - F.col("a.start"))
    inside = same_place("a", "b") & (F.col("a.type") == F.col("b.type")) & (F.col("a.cell") == F.col("b.cell")) & contains(F.col("b.start"), F.col("b.end"), F.col("a.start"), F.col("a.end")) & longer
    return a.join(b, inside, "left_anti").drop("cell")


def agreement(spans: DataFrame, detectors: int) -> DataFrame:
    """Spans (with a column ``detector``) that every other detector supports by an overlap of the same type, merged."""
    spans = with_places(spans)
    a = _cells(spans.withColumn("_id", F.struct("detector", "ordinal"))).alias("a")
    b = _cells(spans.select(*PLACE, "type", "start", "end", "detector")).alias("b")
    met = same_place("a", "b") & (F.col("a.cell") == F.col("b.cell")) & (F.col("a.type") == F.col("b.type")) & (F.col("a.detector") != F.col("b.detector"))
    met = met & overlap(F.col("a.start"), F.col("a.end"), F.col("b.start"), F.col("b.end"))
    keys = [f"a.{x}" for x in (*PLACE, "start", "end", "type", "_id")]
    agreed = a.join(b, met).groupBy(*keys).agg(F.count_distinct("b.detector").alias("n")).where(F.col("n") == detectors - 1)
    kept = spans.withColumn("_id", F.struct("detector", "ordinal")).alias("s")
    same = same_place("s", "g") & (F.col("s._id") == F.col("g._id")) & (F.col("s.start") == F.col("g.start")) & (F.col("s.end") == F.col("g.end"))
    return merge_entities(kept.join(agreed.alias("g"), same, "left_semi").drop("_id"))


def combine(*relations: DataFrame) -> DataFrame:
    """The findings of several detectors, merged; an earlier relation comes first among equals."""
    numbered = [with_places(x).withColumn("ordinal", F.lit(i) * F.lit(1 << 32) + F.col("ordinal")) for i, x in enumerate(relations)]
    out = numbered[0]
    for other in numbered[1:]:
        out = out.unionByName(other)
    return merge_entities(out)
