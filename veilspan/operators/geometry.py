"""Boxes: structs (x0, y0, x1, y1) with the origin at the top left."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def box(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """A box of two corners in any order."""
    return F.struct(F.least(x0, x1).cast("double").alias("x0"), F.least(y0, y1).cast("double").alias("y0"), F.greatest(x0, x1).cast("double").alias("x1"), F.greatest(y0, y1).cast("double").alias("y1"))


def union(a: Column, b: Column) -> Column:
    return F.struct(F.least(a["x0"], b["x0"]).alias("x0"), F.least(a["y0"], b["y0"]).alias("y0"), F.greatest(a["x1"], b["x1"]).alias("x1"), F.greatest(a["y1"], b["y1"]).alias("y1"))


def enclosing(boxes: Column) -> Column:
    """The smallest box around an array of boxes; null without any."""
    edge = lambda name: F.transform(boxes, lambda b: b[name])
    whole = F.struct(F.array_min(edge("x0")).alias("x0"), F.array_min(edge("y0")).alias("y0"), F.array_max(edge("x1")).alias("x1"), F.array_max(edge("y1")).alias("y1"))
    return F.when(F.size(boxes) > 0, whole)


def area(a: Column) -> Column:
    return F.greatest(a["x1"] - a["x0"], F.lit(0.0)) * F.greatest(a["y1"] - a["y0"], F.lit(0.0))


def shared_area(a: Column, b: Column) -> Column:
    width = F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"])
    height = F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"])
    return F.greatest(width, F.lit(0.0)) * F.greatest(height, F.lit(0.0))


def iou(a: Column, b: Column) -> Column:
    shared = shared_area(a, b)
    return F.coalesce(F.try_divide(shared, area(a) + area(b) - shared), F.lit(0.0))


def touches(a: Column, b: Column) -> Column:
    """Whether two boxes share any area."""
    return (a["x0"] < b["x1"]) & (b["x0"] < a["x1"]) & (a["y0"] < b["y1"]) & (b["y0"] < a["y1"])


def mostly_inside(word: Column, outer: Column, share: float = 0.5) -> Column:
    return (area(word) > 0) & (shared_area(word, outer) >= share * area(word))


def shrunk(a: Column, by: float = 1.0) -> Column:
    return F.struct((a["x0"] + by).alias("x0"), (a["y0"] + by).alias("y0"), (a["x1"] - by).alias("x1"), (a["y1"] - by).alias("y1"))


def overlaps_inside(word: Column, region: Column) -> Column:
    """Whether a word reaches more than a point into a region."""
    return touches(word, shrunk(region))


def same_line(a: Column, b: Column) -> Column:
    """Whether two boxes overlap by at least half the lower one's height."""
    shared = F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"])
    return shared >= 0.5 * F.least(a["y1"] - a["y0"], b["y1"] - b["y0"])


def merged_lines(words: DataFrame) -> DataFrame:
    """(entity_id, box): consecutive word boxes (entity_id, n, box) on one line as one box."""
    order = Window.partitionBy("entity_id").orderBy("n")
    flagged = words.withColumn("_new", (~F.coalesce(same_line(F.lag("box").over(order), F.col("box")), F.lit(False))).cast("int"))
    numbered = flagged.withColumn("_line", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy("entity_id", "_line").agg(enclosing(F.collect_list("box")).alias("box")).drop("_line")


def to_points(pixels: Column, dpi: Column, margin_share: float, width: Column, height: Column) -> Column:
    """A pixel box in points, grown by a share of its height and clipped to the page."""
    p = {name: pixels[name] * 72.0 / dpi for name in ("x0", "y0", "x1", "y1")}
    margin = (p["y1"] - p["y0"]) * margin_share
    clip = lambda x, most: F.least(F.greatest(x, F.lit(0.0)), most)
    return F.struct(clip(p["x0"] - margin, width).alias("x0"), clip(p["y0"] - margin, height).alias("y0"), clip(p["x1"] + margin, width).alias("x1"), clip(p["y1"] + margin, height).alias("y1"))


def rotated(a: Column, turn: Column, width: Column, height: Column, back: bool = False) -> Column:
    """A box of an unrotated page of a size on the page turned by 0, 90, 180 or 270 degrees; ``back`` is the way back."""
    turn = F.when(turn.isin(90, 270), 360 - turn).otherwise(turn) if back else turn
    w, h = (F.when(turn.isin(90, 270), height).otherwise(width), F.when(turn.isin(90, 270), width).otherwise(height)) if back else (width, height)
    return (
        F.when(turn == 90, box(h - a["y1"], a["x0"], h - a["y0"], a["x1"]))
        .when(turn == 180, box(w - a["x1"], h - a["y1"], w - a["x0"], h - a["y0"]))
        .when(turn == 270, box(a["y0"], w - a["x1"], a["y1"], w - a["x0"]))
        .otherwise(a)
    )


def skewed(x: Column, y: Column, degrees: Column, width: Column, height: Column) -> Column:
    """A point turned about the middle of a page."""
    turn = F.radians(degrees)
    dx, dy = x - width / 2, y - height / 2
    return F.struct((width / 2 + dx * F.cos(turn) - dy * F.sin(turn)).alias("x"), (height / 2 + dx * F.sin(turn) + dy * F.cos(turn)).alias("y"))


def covers(corners: Column, x: Column, y: Column) -> Column:
    """Whether a point is in a convex quadrilateral: an array of four points (x, y) in order."""
    sides = []
    for i in range(4):
        a, b = corners[i], corners[(i + 1) % 4]
        sides.append((b["x"] - a["x"]) * (y - a["y"]) - (b["y"] - a["y"]) * (x - a["x"]))
    values = F.array(*sides)
    return F.forall(values, lambda s: s >= 0) | F.forall(values, lambda s: s <= 0)


def off_page(word: Column, visible: Column) -> Column:
    """Whether a word lies wholly outside the visible area."""
    return ~touches(word, visible)


def resolution(x: Column, y: Column, default: float = 300.0) -> Column:
    """(x, y) dots per inch if both are plausible, else the default for both."""
    good = x.between(100, 1200) & y.between(100, 1200)
    return F.struct(F.when(good, x).otherwise(default).cast("double").alias("x"), F.when(good, y).otherwise(default).cast("double").alias("y"))


def words_in_span(words: Column, start: Column, end: Column) -> Column:
    return F.filter(words, lambda w: (w["start"] < end) & (start < w["end"]))


def boxes_for_span(words: Column, start: Column, end: Column) -> Column:
    return F.transform(words_in_span(words, start, end), lambda w: w["bbox"])


def beside_bars(ink: Column, solid: float = 0.9) -> Column:
    """(first, last) of the rows between bars with most ink: of an array of ink shares by row, the runs below ``solid``; null if every row is a bar."""
    runs = true_runs(F.transform(ink, lambda x: x < solid))
    scored = F.transform(runs, lambda r: F.struct(F.aggregate(F.slice(ink, r["start"] + 1, r["end"] - r["start"]), F.lit(0.0), lambda a, x: a + x).alias("ink"), (-r["start"]).alias("first"), r["start"].alias("start"), r["end"].alias("end")))
    best = F.array_max(scored)
    return F.when(F.size(runs) > 0, F.struct(best["start"].alias("start"), best["end"].alias("end")))


def true_runs(flags: Column) -> Column:
    """(start, end) of each run of true values of an array."""
    at = F.sequence(F.lit(0), F.size(flags))
    here = lambda i: F.coalesce(F.get(flags, i), F.lit(False))
    before = lambda i: F.when(i == 0, F.lit(False)).otherwise(F.coalesce(F.get(flags, i - 1), F.lit(False)))
    starts = F.filter(at, lambda i: here(i) & ~before(i))
    ends = F.filter(at, lambda i: ~here(i) & before(i))
    return F.zip_with(starts, ends, lambda a, b: F.struct(a.alias("start"), b.alias("end")))


def widened_boxes(words: DataFrame, most_share: float = 0.5) -> DataFrame:
    """Word boxes (line, n, box) grown sideways to the middle of the gaps beside them, by at most a share of their height."""
    order = Window.partitionBy("line").orderBy("n")
    limit = (F.col("box.y1") - F.col("box.y0")) * most_share
    left = F.least(F.greatest((F.col("box.x0") - F.lag("box.x1").over(order)) / 2, F.lit(0.0)), limit)
    right = F.least(F.greatest((F.lead("box.x0").over(order) - F.col("box.x1")) / 2, F.lit(0.0)), limit)
    new = F.struct((F.col("box.x0") - F.coalesce(left, limit)).alias("x0"), F.col("box.y0").alias("y0"), (F.col("box.x1") + F.coalesce(right, limit)).alias("x1"), F.col("box.y1").alias("y1"))
    return words.withColumn("box", new)
