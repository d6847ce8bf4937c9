"""Publishing labelled text: written aside, read back, checked, and only then put in place."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspan.operators.leaks import missing_pages, text_leaks
from veilspan.operators.redact import PAGE_SEPARATOR, redact_text


@dataclass
class Export:
    """What was published, what was held back, and why."""

    published: DataFrame
    held_back: DataFrame
    leaks: DataFrame


def export_text(pages: DataFrame, entities: DataFrame, destination: str, check: bool = True, regions: DataFrame | None = None) -> Export:
    """Writes (doc_id, text) of documents without a leak to ``destination``.

    The labelled text is staged beside it, read back, and checked as read. Documents with a leak, or with other pages than before, go to ``<destination>-held``
    and aren't published. The staged copy is removed only when the destination is whole, so a broken run publishes nothing.
    """
    spark = pages.sparkSession
    staged = f"{destination.rstrip('/')}-staged-{uuid.uuid4().hex}"
    redact_text(pages, entities, regions).write.parquet(staged)
    written = spark.read.parquet(staged)
    parts = written.select("doc_id", F.posexplode(F.split("text", PAGE_SEPARATOR)).alias("n", "text"))
    from pyspark.sql import Window

    order = pages.select("doc_id", "page_index", (F.row_number().over(Window.partitionBy("doc_id").orderBy("page_index")) - 1).alias("n"))
    exported = parts.join(order, ["doc_id", "n"], "left").select("doc_id", F.coalesce("page_index", F.lit(-1) - F.col("n")).alias("page_index"), "text")
    leaks = text_leaks(exported, entities)
    wrong = leaks.select("doc_id").unionByName(missing_pages(exported, pages)).distinct() if check else leaks.select("doc_id").limit(0)
    leak_path, held_path = f"{staged}-leaks", f"{destination.rstrip('/')}-held"
    leaks.write.parquet(leak_path)
    wrong.write.mode("overwrite").parquet(held_path)
    held = spark.read.parquet(held_path)
    written.join(held, "doc_id", "left_anti").write.mode("error").parquet(destination)
    return Export(spark.read.parquet(destination), held, spark.read.parquet(leak_path))


def document_summary(entities: DataFrame) -> DataFrame:
    """(doc_id, summary): counts by type, most frequent first, as "type n, type n"."""
    counts = entities.groupBy("doc_id", "type").agg(F.count("*").alias("n"))
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "type")))
    return counts.groupBy("doc_id").agg(F.array_join(F.transform(ordered, lambda x: F.concat(x["type"], F.lit(" "), (-x["m"]).cast("string"))), ", ").alias("summary"))


def entity_table(entities: DataFrame) -> DataFrame:
    """(doc_id, line): a fixed-width line for each finding, in reading order."""
    line = F.concat(F.lpad(F.coalesce(F.col("page_index").cast("string"), F.lit("-")), 4, " "), F.lit("  "), F.rpad("type", 14, " "), F.lit("  "), F.lpad(F.coalesce(F.col("start").cast("string"), F.lit("-")), 7, " "), F.lit("-"), F.rpad(F.coalesce(F.col("end").cast("string"), F.lit("-")), 7, " "))
    return entities.orderBy("doc_id", "page_index", "start", "end").select("doc_id", line.alias("line"))


def markdown_table(rows: DataFrame, title: str) -> str:
    """A small aggregated relation as a Markdown table, on the driver."""
    head = f"## {title}\n\n| {' | '.join(rows.columns)} |\n| {' | '.join('-' for _ in rows.columns)} |\n"
    return head + "".join(f"| {' | '.join('—' if x is None else f'{x:.4f}' if isinstance(x, float) else str(x) for x in row)} |\n" for row in rows.collect())


# Signs that LaTeX reads as commands, and how they are written.
LATEX_SIGNS = {"\\": r"\textbackslash{}", "_": r"\_", "&": r"\&", "%": r"\%", "#": r"\#", "$": r"\$", "{": r"\{", "}": r"\}", "~": r"\textasciitilde{}", "^": r"\textasciicircum{}"}


def _latex_cell(x: object) -> str:
    if x is None:
        return "--"
    return f"{x:.4f}" if isinstance(x, float) else "".join(LATEX_SIGNS.get(c, c) for c in str(x))


def latex_table(rows: DataFrame, caption: str, label: str, bounds: tuple[str, str] | None = None) -> str:
    """A small aggregated relation as a LaTeX table, on the driver. ``bounds`` names the columns of an interval, which follow the column ``value`` in brackets."""
    names = [c for c in rows.columns if not bounds or c not in bounds]
    kinds = dict(rows.dtypes)
    align = "".join("l" if kinds[c] in ("string", "boolean", "date") else "r" for c in names)

    def cell(row, name: str) -> str:
        own = _latex_cell(row[name])
        return f"{own} {{\\scriptsize [{_latex_cell(row[bounds[0]])}, {_latex_cell(row[bounds[1]])}]}}" if bounds and name == "value" and row["value"] is not None else own

    body = [" & ".join(cell(row, name) for name in names) + r" \\" for row in rows.collect()]
    head = " & ".join(_latex_cell(c) for c in names) + r" \\"
    parts = [r"\begin{table}[htbp]", r"\centering", rf"\begin{{tabular}}{{{align}}}", r"\toprule", head, r"\midrule", *body, r"\bottomrule", r"\end{tabular}"]
    return "\n".join([*parts, rf"\caption{{{_latex_cell(caption)}}}", rf"\label{{tab:{label}}}", r"\end{table}", ""])


def write_report(tables: dict[str, DataFrame], folder: str) -> None:
    """Small aggregated relations below ``folder``: each as JSON lines in a folder of its name, and all as one Markdown text in ``report``."""
    text = ""
    for name, rows in tables.items():
        rows.coalesce(1).write.mode("overwrite").json(f"{folder.rstrip('/')}/{name}")
        text += markdown_table(rows, name) + "\n"
        spark = rows.sparkSession
    if tables:
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder.rstrip('/')}/report")


def html_report(pages: DataFrame, entities: DataFrame) -> DataFrame:
    """(doc_id, html): a report without scripts, each finding marked in its page."""
    shown = entities.where("start IS NOT NULL").groupBy("doc_id", "page_index").agg(F.array_sort(F.collect_list(F.struct("start", "end", "type"))).alias("_found"))
    joined = pages.select("doc_id", "page_index", "text").join(shown, ["doc_id", "page_index"], "left")
    safe = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    zero = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def step(a, s):
        from veilspan.functions.spans import piece

        first = F.greatest(s["start"], a["at"])
        mark = F.concat(F.lit('<mark class="'), s["type"], F.lit('">'), safe(piece(F.col("text"), first, s["end"])), F.lit("</mark>"))
        whole = F.concat(a["out"], safe(piece(F.col("text"), a["at"], first)), mark)
        return F.when(s["end"] > a["at"], F.struct(whole.alias("out"), s["end"].cast("int").alias("at"))).otherwise(F.struct(a["out"].alias("out"), a["at"].cast("int").alias("at")))

    empty = F.array().cast("array<struct<start: int, end: int, type: string>>")
    body = F.aggregate(F.coalesce("_found", empty), zero, step, lambda a: F.concat(a["out"], safe(F.substring("text", a["at"] + 1, F.length("text")))))
    page = F.concat(F.lit("<section><h2>"), F.col("page_index").cast("string"), F.lit("</h2><pre>"), body, F.lit("</pre></section>"))
    parts = joined.select("doc_id", "page_index", page.alias("part")).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page_index", "part"))).alias("p"))
    return parts.select("doc_id", F.concat(F.lit("<!DOCTYPE html><html><body>"), F.array_join(F.transform("p", lambda x: x["part"]), ""), F.lit("</body></html>")).alias("html"))
