"""Saved reviews: findings with the document's fingerprint and no page text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspan.operators.review import stale
from veilspan.schema import SCHEMA_VERSION

FORMAT = "review-session"
ENTITY_FIELDS = ["entity_id", "type", "page_index", "start", "end", "text", "surface_id", "source", "score", "review"]


def sessions(documents: DataFrame, entities: DataFrame) -> DataFrame:
    """(doc_id, format, schema_version, fingerprint, language, entities): a row for each document (doc_id, fingerprint, language). Running it fails without a fingerprint."""
    known = [c for c in ENTITY_FIELDS if c in entities.columns]
    gathered = entities.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(*known))).alias("entities"))
    joined = documents.join(gathered, "doc_id", "left")
    name = F.when(F.col("fingerprint").isNull(), F.raise_error("a document has no fingerprint")).otherwise(F.col("fingerprint"))
    language = F.col("language") if "language" in documents.columns else F.lit(None).cast("string")
    return joined.select("doc_id", F.lit(FORMAT).alias("format"), F.lit(SCHEMA_VERSION).alias("schema_version"), name.alias("fingerprint"), language.alias("language"), F.coalesce("entities", F.array()).alias("entities"))


def save(rows: DataFrame, path: str, form: str = "parquet") -> None:
    """Writes sessions as Parquet, or one JSON object a line."""
    rows.write.mode("error").format(form).save(path)


def refusals(saved: DataFrame, documents: DataFrame, pages: DataFrame) -> DataFrame:
    """(doc_id, reason): sessions that don't fit: unknown format or version, another fingerprint, a page that isn't there, or text that changed."""
    joined = saved.join(documents.select("doc_id", F.col("fingerprint").alias("_now")), "doc_id", "left")
    reason = (
        F.when(F.col("format") != FORMAT, "format")
        .when(F.col("schema_version") != SCHEMA_VERSION, "version")
        .when(~F.col("fingerprint").eqNullSafe(F.col("_now")), "fingerprint")
    )
    first = joined.select("doc_id", reason.alias("reason")).where("reason IS NOT NULL")
    rows = reopened(saved)
    gone = rows.where("page_index IS NOT NULL").join(pages.select("doc_id", "page_index"), ["doc_id", "page_index"], "left_anti").select("doc_id", F.lit("page").alias("reason"))
    changed = stale(rows, pages).join(pages.select("doc_id", "page_index"), ["doc_id", "page_index"], "left_semi").select("doc_id", F.lit("text").alias("reason"))
    return first.unionByName(gone).unionByName(changed).distinct()


def reopened(saved: DataFrame) -> DataFrame:
    """The findings of sessions as rows."""
    return saved.select("doc_id", F.explode("entities").alias("e")).select("doc_id", "e.*")


def engine_mismatch(saved: DataFrame, used: str | None) -> DataFrame:
    """Sessions (doc_id, ocr_engine) whose recorded reader isn't the one in use; none recorded and none in use are alike."""
    return saved.where(~F.col("ocr_engine").eqNullSafe(F.lit(used)))
