"""Files: bytes, fingerprints and kinds; what can be read as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# How picture files begin.
PICTURES = {"jpeg": ["FFD8FF"], "png": ["89504E470D0A1A0A"], "tiff": ["49492A00", "4D4D002A", "49492B00", "4D4D002B"]}


class SourceError(ValueError):
    """A source can't be used. Messages name no path and no text."""


def read_sources(spark: SparkSession, pattern: str, recursive: bool = False) -> DataFrame:
    """(fingerprint, length, content) of every file; paths aren't kept. A missing path raises an error that doesn't name it."""
    try:
        rows = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(pattern)
    except Exception as error:
        raise SourceError("the source can't be read") from error
    return rows.select(fingerprint(F.col("content")).alias("fingerprint"), "length", "content")


def fingerprint(content: Column) -> Column:
    """SHA-256 of the bytes, which is a document's identity."""
    return F.sha2(content, 256)


def image_format(content: Column) -> Column:
    """``jpeg``, ``png``, ``tiff`` or null, by the first bytes."""
    head = F.hex(F.substring(content, 1, 8))
    out = F.lit(None).cast("string")
    for name, marks in PICTURES.items():
        for mark in marks:
            out = F.when(head.startswith(mark), F.lit(name)).otherwise(out)
    return out


def source_kind(content: Column) -> Column:
    """``image``, ``pdf`` (its header stands in the first 1,024 bytes) or null, which isn't supported."""
    header = F.contains(F.hex(F.substring(content, 1, 1024)), F.lit("255044462D"))
    return F.when(image_format(content).isNotNull(), "image").when(header, "pdf")


def verified(sources: DataFrame, documents: DataFrame) -> DataFrame:
    """Sources that belong to ``documents`` (doc_id, fingerprint). Running it fails if a document has no fingerprint or its source isn't there."""
    joined = documents.join(sources, "fingerprint", "left")
    message = F.when(F.col("fingerprint").isNull(), "a document has no fingerprint").otherwise("a source isn't the one that was reviewed")
    return joined.withColumn("content", F.when(F.col("content").isNull(), F.raise_error(message).cast("binary")).otherwise(F.col("content")))


def set_fingerprint(files: DataFrame) -> DataFrame:
    """(fingerprint): of a set of files (name, content), from each name, length and content in the order of names."""
    part = F.concat(F.col("name"), F.lit(":"), F.length("content"), F.lit(":"), F.sha2("content", 256))
    return files.agg(F.sha2(F.array_join(F.array_sort(F.collect_list(part)), "\n").cast("binary"), 256).alias("fingerprint"))


def texts_as_documents(spark: SparkSession, pattern: str) -> DataFrame:
    """(doc_id, page_index, text, fingerprint): text files as documents; form feeds part their pages."""
    rows = spark.read.text(pattern, wholetext=True).select(F.col("value"), F.sha2(F.col("value").cast("binary"), 256).alias("fingerprint"))
    return rows.select(F.xxhash64("fingerprint").alias("doc_id"), F.posexplode(F.split("value", "\f")).alias("page_index", "text"), "fingerprint")
