"""Registering queries, and inputs that Spark and DuckDB make alike."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a function as a query under its own name, with its SQL."""

    def register(function: Query) -> Query:
        QUERIES[function.__name__] = function
        if sql is not None:
            SQL[function.__name__] = sql
        return function

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def h(*parts: Column | str) -> Column:
    """32 bits of md5 of the parts joined by slashes."""
    text = F.concat_ws("/", *(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long")


def sql_h(*parts: str) -> str:
    return "CAST(('0x' || substr(md5(" + " || '/' || ".join(parts) + "), 1, 8)) AS BIGINT)"


TYPES = ["email", "phone", "person", "date"]


def made_spans(spark: SparkSession, sf_dir: str, salt: str, each: int = 6) -> DataFrame:
    """(doc_id, page_index, ordinal, type, start, end, score): ``each`` spans of up to 40 characters in every document that has text, from hashes. They crowd within 400 characters after a place anywhere in the text."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.length("text").alias("n")).where("n > 0")
    rows = docs.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(each - 1))))
    crowd = h(F.lit(salt), F.col("doc_id"), F.lit("crowd"))
    start = (crowd + h(F.lit(salt), F.col("doc_id"), F.col("i"), F.lit("s")) % 400) % F.col("n")
    size = 1 + h(F.lit(salt), F.col("doc_id"), F.col("i"), F.lit("e")) % 40
    kind = F.element_at(F.array(*(F.lit(t) for t in TYPES)), (1 + h(F.lit(salt), F.col("doc_id"), F.col("i"), F.lit("t")) % len(TYPES)).cast("int"))
    score = (h(F.lit(salt), F.col("doc_id"), F.col("i"), F.lit("p")) % 10) / 10.0
    return rows.select("doc_id", F.lit(0).alias("page_index"), F.col("i").cast("long").alias("ordinal"), kind.alias("type"), start.cast("int").alias("start"), F.least(start + size, F.col("n")).cast("int").alias("end"), score.alias("score"))


def sql_spans(salt: str, each: int = 6) -> str:
    part = lambda x: sql_h(f"'{salt}'", "CAST(doc_id AS VARCHAR)", "CAST(i AS VARCHAR)", f"'{x}'")
    crowd = sql_h(f"'{salt}'", "CAST(doc_id AS VARCHAR)", "'crowd'")
    kinds = ", ".join(f"'{t}'" for t in TYPES)
    return (
        f"(SELECT doc_id, 0 AS page_index, i AS ordinal, list_extract([{kinds}], CAST(1 + {part('t')} % {len(TYPES)} AS INTEGER)) AS type, s AS start, least(s + 1 + {part('e')} % 40, n) AS \"end\", "
        f"({part('p')} % 10) / 10.0 AS score FROM (SELECT doc_id, n, i, ({crowd} + {part('s')} % 400) % n AS s FROM (SELECT doc_id, length(text) AS n FROM documents WHERE length(text) > 0), (SELECT unnest(range(0, {each})) AS i)))"
    )


def rank_sql(column: str) -> str:
    from veilspan.schema import PRIORITY

    return "CASE " + column + " " + " ".join(f"WHEN '{name}' THEN {i}" for i, name in enumerate(PRIORITY)) + f" ELSE {len(PRIORITY)} END"


def fixture(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def sql_rows(rows: list[tuple], columns: str) -> str:
    """The expected rows of a curated case."""

    def literal(x: object) -> str:
        if x is None:
            return "NULL"
        if isinstance(x, bool):
            return "TRUE" if x else "FALSE"
        return str(x) if isinstance(x, int | float) else "'" + str(x).replace("'", "''") + "'"

    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(literal, row)) + ')' for row in rows)}) AS t({columns})"
