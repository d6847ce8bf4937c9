"""Types, relations and their Spark schemas.

Offsets are code points within one page (or surface) and half-open. A relation of spans has the columns of ``ENTITY``; a page or surface is
told apart by (doc_id, page_index, surface_id).
"""

from __future__ import annotations

from pyspark.sql import types as T

# The categories, in the order in which an overlap is decided, strongest first.
PRIORITY = ["url", "birth_number", "iban", "credit_card", "bank_account", "company_id", "email", "phone", "id_number", "person", "address", "date", "organization", "other"]
REGION = "region"
ENTITY_TYPES = [*PRIORITY, REGION]
SURFACE_KINDS = ["metadata", "xmp", "link", "annotation", "form_field", "bookmark", "embedded_file", "structure"]
SOURCES = ["rule", "model", "manual", "propagated"]
REVIEWS = ["pending", "confirmed", "rejected"]
SCHEMA_VERSION = 6

BBOX = T.StructType([T.StructField(name, T.DoubleType()) for name in ("x0", "y0", "x1", "y1")])
MATCH = T.StructType([T.StructField("type", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("text", T.StringType())])
WORD = "struct<text: string, start: int, end: int, bbox: struct<x0: double, y0: double, x1: double, y1: double>>"
PAGE = f"doc_id long, page_index int, width double, height double, text string, words array<{WORD}>, has_text_layer boolean, raster_dpi double"
SURFACE = "doc_id long, surface_id string, kind string, value string, ref string, page_index int, bbox struct<x0: double, y0: double, x1: double, y1: double>"
ENTITY = (
    "doc_id long, entity_id string, type string, page_index int, start int, end int, text string, surface_id string, "
    "bboxes array<struct<x0: double, y0: double, x1: double, y1: double>>, source string, score double, review string, replacement string"
)
