"""Scanned forms: questions, answers and their links; personal items derived from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = (
    "form array<struct<id: bigint, label: string, text: string, box: array<double>, linking: array<array<bigint>>, words: array<struct<text: string, box: array<double>>>>>"
)
# What a question asks for; the first pattern that fits counts, unless one of the last kind does.
QUESTIONS = [
    ("email", r"(?i)e-?mail"),
    ("phone", r"(?i)phone|telephone|\btel\b|fax|mobile"),
    ("address", r"(?i)address|street|city|zip|postal"),
    ("date", r"(?i)birth|\bdob\b"),
    ("person", r"(?i)\bname\b|signature|attention|contact|\bto\b|\bfrom\b|requested by|prepared by|submitted by"),
]
NOT_PERSONAL = r"(?i)brand|company|product|file|account|project|study|program|store"


def read_forms(spark: SparkSession, pattern: str) -> DataFrame:
    """(doc_id, form): annotations, one file for each form."""
    rows = spark.read.schema(SCHEMA).option("multiLine", True).json(pattern)
    return rows.select(F.xxhash64(F.to_json("form")).alias("doc_id"), "form")


def field_type(question: Column) -> Column:
    """The type that a question asks for, or null."""
    out = F.lit(None).cast("string")
    for kind, pattern in reversed(QUESTIONS):
        out = F.when(question.rlike(pattern), F.lit(kind)).otherwise(out)
    return F.when(~question.rlike(NOT_PERSONAL), out)


def form_items(forms: DataFrame) -> DataFrame:
    """(doc_id, answer, question, type, text): answers linked to a question that asks for something personal. A self-join of the exploded links."""
    blocks = forms.select("doc_id", F.explode("form").alias("b")).select("doc_id", "b.id", "b.label", "b.text", F.explode_outer("b.linking").alias("link"))
    pairs = blocks.where("label = 'answer' AND link IS NOT NULL").select("doc_id", F.col("id").alias("answer"), "text", F.explode("link").alias("question")).where("question <> answer").distinct()
    questions = blocks.where("label = 'question'").select("doc_id", F.col("id").alias("question"), F.col("text").alias("asked")).distinct()
    return pairs.join(questions, ["doc_id", "question"]).withColumn("type", field_type(F.col("asked"))).where("type IS NOT NULL AND trim(text) <> ''").select("doc_id", "answer", "question", "type", "text")


def form_words(forms: DataFrame) -> DataFrame:
    """(doc_id, box_no, text, box): every printed word of a form."""
    blocks = forms.select("doc_id", F.posexplode(F.flatten(F.transform("form", lambda b: b["words"]))).alias("box_no", "w"))
    box = F.struct(*(F.get("w.box", i).alias(name) for i, name in enumerate(("x0", "y0", "x1", "y1"))))
    return blocks.select("doc_id", F.col("box_no").cast("bigint").alias("box_no"), "w.text", box.alias("box")).where(F.trim("text") != "")
