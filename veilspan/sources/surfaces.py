"""Hidden strings of HTML pages as surfaces: titles, metadata, link targets, comments, scripts, alternative texts, form values.

Every carrier is an expression over the page, so a page is read once and no Python runs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspan.functions.text import normalize_text

# Where each kind of surface stands in a page; the first group is its value.
CARRIERS: dict[str, tuple[str, str]] = {
    "title": ("metadata", r"(?is)<title[^>]*>(.*?)</title>"),
    "meta": ("metadata", r"""(?is)<meta\b[^>]*\bcontent\s*=\s*["']([^"']*)["']"""),
    "href": ("link", r"""(?is)<a\b[^>]*\bhref\s*=\s*["']([^"']*)["']"""),
    "comment": ("annotation", r"(?s)<!--(.*?)-->"),
    "script": ("embedded_file", r"(?is)<script\b[^>]*>(.*?)</script>"),
    "style": ("embedded_file", r"(?is)<style\b[^>]*>(.*?)</style>"),
    "alt": ("structure", r"""(?is)<[^>]*\b(?:alt|aria-label)\s*=\s*["']([^"']*)["']"""),
    "value": ("form_field", r"""(?is)<input\b[^>]*\bvalue\s*=\s*["']([^"']*)["']"""),
    "textarea": ("form_field", r"(?is)<textarea\b[^>]*>(.*?)</textarea>"),
}


def decoded_target(target: Column) -> Column:
    """A link target with percent signs decoded; a plus sign stays one. What can't be decoded stays as it is."""
    return F.coalesce(F.try_url_decode(F.replace(target, F.lit("+"), F.lit("%2B"))), target)


def surface_id(kind: Column, page_index: Column, ref: Column) -> Column:
    return F.concat_ws(":", kind, F.coalesce(page_index.cast("string"), F.lit("doc")), ref)


def extract_surfaces(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(doc_id, surface_id, kind, value, ref, page_index): every hidden string that isn't blank, in normal form. Equal strings in different places stay apart; a null page has none."""
    arrays = []
    for name, (kind, pattern) in CARRIERS.items():
        found = F.regexp_extract_all(F.col(html_col), F.lit(pattern), F.lit(1))
        if name == "href":
            found = F.transform(found, decoded_target)
        arrays.append(_referred(found, name, kind))
    rows = pages.where(F.col(html_col).isNotNull()).select(F.col(id_col).alias("doc_id"), F.explode(F.concat(*arrays)).alias("s"))
    kept = rows.select("doc_id", "s.kind", "s.ref", normalize_text(F.col("s.value")).alias("value")).where(F.col("value").rlike(r"(?U)\S"))
    page_index = F.lit(None).cast("int")
    return kept.select("doc_id", surface_id(F.col("kind"), page_index, F.col("ref")).alias("surface_id"), "kind", "value", "ref", page_index.alias("page_index"))


def _referred(values: Column, name: str, kind: str) -> Column:
    """Values as (kind, ref, value), the reference telling the carrier and the place."""
    return F.transform(values, lambda v, i: F.struct(F.lit(kind).alias("kind"), F.concat(F.lit(f"{name}/"), i.cast("string")).alias("ref"), v.alias("value")))


def unlisted(attached: DataFrame, listed: DataFrame) -> DataFrame:
    """Attached objects (doc_id, object_id) that no list names."""
    return attached.join(listed.select("doc_id", "object_id").distinct(), ["doc_id", "object_id"], "left_anti")


def holding(objects: DataFrame, key: str) -> DataFrame:
    """Objects (doc_id, object_id, source) whose source has a key: a cheap test before any parsing."""
    return objects.where(F.col("source").contains(f"/{key}"))


def name_tree(nodes: DataFrame, roots: DataFrame, most_depth: int = 64) -> DataFrame:
    """(doc_id, node, depth): everything below the roots of trees of (doc_id, parent, node), each node once even where there are cycles."""
    reached = roots.select("doc_id", "node", F.lit(0).alias("depth"))
    edge, depth = reached, 0
    while depth < most_depth:
        depth += 1
        step = edge.select("doc_id", F.col("node").alias("parent")).join(nodes, ["doc_id", "parent"]).select("doc_id", "node").distinct()
        new = step.join(reached, ["doc_id", "node"], "left_anti").select("doc_id", "node", F.lit(depth).alias("depth"))
        if new.isEmpty():
            break
        reached, edge = reached.unionByName(new), new
    return reached
