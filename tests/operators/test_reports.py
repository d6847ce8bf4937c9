"""Reports and the leak layers of files."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from veilspan.operators.leaks import searchable, thumbnail_leaks
from veilspan.sources.export import latex_table, write_report


def plain_searchable(data: bytes) -> str:
    """By hand: objects one after the other, a body left out where its own dictionary says so."""
    out, rest = "", data.decode("latin-1")
    while "endstream" in rest:
        part, rest = rest.split("endstream", 1)
        for mark in ("stream\r\n", "stream\n"):
            head, found, body = part.partition(mark)
            if found and head.rstrip().endswith(">>"):
                own = head[head.rfind("obj") + 3 :] if "obj" in head else head
                body = "" if "/Filter" in own or "/Subtype /Image" in own else body
                part = head + found + body
                break
        out += part + "endstream"
    return out + rest


def test_bodies(spark):
    files = [
        b"1 0 obj << /Filter /F /D << /K 1 >> >>\nstream\r\nab\xffc\r\nendstream endobj 2 0 obj << /L 3 >> stream\nseen\nendstream endobj",
        b"3 0 obj << /Subtype /Image >> stream\nhidden endstream tail stream\nlate",
        b"no streams at all",
        b"",
        b"<< >> stream\nshown endstream << /Filter /A >> endobj 4 0 obj << >> stream\nshown too endstream",
    ]
    rows = spark.createDataFrame([(i, bytearray(x)) for i, x in enumerate(files)], "i int, content binary")
    found = [r.t for r in rows.select("i", searchable(F.col("content")).alias("t")).orderBy("i").collect()]
    assert found == [plain_searchable(x) for x in files]


def test_thumbnails(spark):
    rows = [(1, 0, "<< /Thumb 3 0 R >>"), (2, 0, "<< /Thumb null >>"), (3, 1, "<< /Thumb  null>>"), (4, 1, "<</Thumbs 1>>"), (5, 2, None), (6, 2, "<</Thumb<<>> >>")]
    found = thumbnail_leaks(spark.createDataFrame(rows, "doc_id int, page_index int, content string")).collect()
    assert sorted((r.doc_id, r.page_index, r.kind) for r in found) == [(1, 0, "leftover"), (6, 2, "leftover")]


def test_reports(spark, tmp_path):
    rows = spark.createDataFrame([("a_b & 5%", 0.5, 0.25, 0.75, 3), ("c", None, None, None, 0)], "name string, value double, low double, high double, n int")
    text = latex_table(rows, "Scores of {all}", "scores", ("low", "high"))
    assert r"a\_b \& 5\% & 0.5000 {\scriptsize [0.2500, 0.7500]} & 3 \\" in text and r"c & -- & 0 \\" in text and r"\begin{tabular}{lrr}" in text and r"\caption{Scores of \{all\}}" in text
    write_report({"scores": rows, "none": rows.limit(0)}, str(tmp_path / "out"))
    told = [json.loads(x.read_text().splitlines()[0]) for x in (tmp_path / "out/scores").glob("part-*") if x.read_text()]
    assert told[0]["name"] == "a_b & 5%" and "## scores" in "".join(x.read_text() for x in (tmp_path / "out/report").glob("part-*"))
