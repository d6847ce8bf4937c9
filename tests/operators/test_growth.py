"""Plans that stay small, and work that grows with its input."""

from __future__ import annotations

import os
import sys
import unicodedata

import pytest
from pyspark.sql import functions as F

from veilspan.functions import checksums, text
from veilspan.operators import detect, generators, metrics, training, windows
from veilspan.plans import scoring

SF = "/root/testdata/sf0.001"


def test_widening_has_a_small_plan(spark):
    rows = spark.createDataFrame([("x", 0, 1)], "text string, start int, end int").select(windows.widen_to_words("text", F.col("start"), F.col("end")).alias("c"))
    assert len(rows._jdf.queryExecution().analyzed().toString()) < 50_000


def test_widening_over_long_words(spark):
    word = "a" * 300
    rows = spark.createDataFrame([(f"x {word} y", 280, 285), (word * 2, 299, 301), (f"({word}.)", 270, 280)], "text string, start int, end int")
    found = rows.select(windows.widen_to_words("text", F.col("start"), F.col("end")).alias("c")).select("c.*").collect()
    assert [tuple(x) for x in found] == [(2, 302), (0, 600), (1, 301)]


def test_tokens_of_examples_are_never_rows(spark):
    pages = spark.createDataFrame([(1, 0, "a b\nc d e")], "doc_id long, page_index int, text string")
    gold = spark.createDataFrame([(1, 0, "person", 2, 5), (1, 0, "person", 2, 5), (1, 0, "date", 6, 7)], "doc_id long, page_index int, type string, start int, end int")
    examples, spans = training.page_examples(pages, gold, 4, 3)
    assert examples._jdf.queryExecution().optimizedPlan().toString().count("Generate posexplode") == 1
    assert [tuple(x) for x in examples.orderBy("example").select("first", "last", "tokens").collect()] == [(0, 4, ["a", "b", "c", "d"]), (4, 5, ["e"])]
    assert sorted(tuple(x) for x in spans.select("example", "type", "first", "last").collect()) == [(0, "date", 3, 3), (0, "person", 1, 2)]


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables aren't here")
def test_shapes_read_no_further_than_the_second_word(spark):
    plan = scoring.error_shapes(spark, SF)._jdf.queryExecution().analyzed().toString()
    assert "regexp_extract_all" not in plan and "split(text" not in plan


def test_languages_count_words_once(spark):
    rows = spark.createDataFrame([("x",)], "text string").select(detect.recognised_language(F.col("text")).alias("c"))
    assert rows._jdf.queryExecution().analyzed().toString().count("split(") == 1


def test_normal_ranges():
    joining = {chr(int(parts[1], 16)) for i in range(sys.maxunicode + 1) if len(parts := unicodedata.decomposition(chr(i)).split()) == 2 and not parts[0].startswith("<")} | set(map(chr, range(0x1160, 0x1200)))
    for first, last in text.NORMAL:
        for c in map(chr, range(first, last + 1)):
            assert unicodedata.normalize("NFC", c) == c and not unicodedata.combining(c) and c not in joining


def test_normal_texts_do_not_travel(spark, monkeypatch):
    monkeypatch.setattr(text, "_nfc", lambda x: x.map(lambda y: f"<{y}>", na_action="ignore"))
    rows = spark.createDataFrame([(1, "plain"), (2, "příliš – €"), (3, "ř"), (4, None), (5, "漢字 한글 Ж")], "id int, text string")
    assert [x[0] for x in rows.orderBy("id").select(text.normalize_text("text")).collect()] == ["plain", "příliš – €", "<ř>", None, "漢字 한글 Ж"]


def test_matches_deal_both_sides_once(spark):
    spans = spark.createDataFrame([(1, 0, "person", 0, 5), (1, 0, "date", 4, 6), (2, 0, "date", 1, 2)], "doc_id long, page_index int, type string, start int, end int")
    gold = spark.createDataFrame([(1, 0, "person", 4, 9), (1, 0, "date", 6, 8), (3, 0, "date", 1, 2)], spans.schema)
    counts = metrics.match_counts(spans, gold, ["person", "date"])
    assert counts._jdf.queryExecution().sparkPlan().toString().count("Join") == 0
    found = {tuple(x)[:1] + tuple(x)[2:] for x in counts.where("mode = 'partial'").collect()}
    assert found == {(1, "person", 1, 1, 1, 1), (1, "date", 1, 0, 1, 0), (1, "any", 2, 2, 2, 1), (2, "date", 1, 0, 0, 0), (2, "any", 1, 0, 0, 0), (3, "date", 0, 0, 1, 0), (3, "any", 0, 0, 1, 0)}


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables aren't here")
def test_decoys_are_looked_for_where_an_address_can_be(spark):
    plan = scoring.decoys_removed(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Contains(text") >= plan.count("Relation [") > 0


def test_seldom_candidates_are_seldom_asked(spark):
    made = spark.range(300).select(generators.account_part(1, "base", F.col("id"), 10).alias("x"), generators.account_part(1, "prefix", F.col("id"), 6).alias("y"))
    assert "coalesce(" in made._jdf.queryExecution().analyzed().toString().lower()
    good = checksums.valid_account_number(F.col("x"), F.col("y"))
    assert made.where(good & (F.length("x") == 10) & (F.length("y") == 6)).count() == 300
