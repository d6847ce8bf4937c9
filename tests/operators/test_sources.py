import json
import random

import pytest
from pyspark.sql import functions as F

from veilspan.operators import finders, models, resources, scans
from veilspan.operators.detect import detect, places_of
from veilspan.operators.training import cut, page_examples
from veilspan.sources import corpora, export, files, forms, layout, sessions, surfaces
from veilspan.streaming import ingest


def test_export_publishes_only_what_passed(spark, tmp_path):
    pages = spark.createDataFrame([(1, 0, "mail a.b@example.org now"), (1, 1, "also\fa.b@example.org"), (2, 0, "c@example.org and Jan")], "doc_id long, page_index int, text string")
    found = detect(pages, only=[finders.find_emails])
    # The second document's name isn't found on its page, so it leaks there.
    wrong = found.select("doc_id", "page_index", "surface_id", "ordinal", "type", "start", "end", "text", "review", "entity_id").unionByName(
        spark.createDataFrame([(2, None, "link:doc:1", 9, "person", None, None, "Jan", "pending", "x")], "doc_id long, page_index int, surface_id string, ordinal long, type string, start int, end int, text string, review string, entity_id string")
    )
    out = export.export_text(pages, wrong, str(tmp_path / "out"))
    assert [(r.doc_id, r.text) for r in out.published.collect()] == [(1, "mail [EMAIL] now\falso\n[EMAIL]")]
    assert [r.doc_id for r in out.held_back.collect()] == [2] and [r.text for r in out.leaks.collect()] == ["Jan"]
    with pytest.raises(Exception):
        export.export_text(pages, wrong, str(tmp_path / "out"))


def test_sessions(spark, tmp_path):
    pages = spark.createDataFrame([(1, 0, "see a@example.org"), (2, 0, "x")], "doc_id long, page_index int, text string")
    docs = spark.createDataFrame([(1, "f1", "en"), (2, "f2", None)], "doc_id long, fingerprint string, language string")
    saved = sessions.sessions(docs, detect(pages))
    sessions.save(saved, str(tmp_path / "s"))
    again = spark.read.parquet(str(tmp_path / "s"))
    assert sessions.refusals(again, docs, pages).collect() == [] and sessions.reopened(again).count() == 1
    changed = pages.withColumn("text", F.upper("text"))
    assert {(r.doc_id, r.reason) for r in sessions.refusals(again, docs.withColumn("fingerprint", F.when(F.col("doc_id") == 2, "other").otherwise(F.col("fingerprint"))), changed).collect()} == {(1, "text"), (2, "fingerprint")}
    with pytest.raises(Exception):
        sessions.sessions(docs.withColumn("fingerprint", F.lit(None).cast("string")), detect(pages)).collect()


def test_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\ftwo")
    rows = files.texts_as_documents(spark, str(tmp_path / "*.txt")).orderBy("page_index").collect()
    assert [(r.page_index, r.text) for r in rows] == [(0, "one"), (1, "two")]
    found = files.read_sources(spark, str(tmp_path / "*.txt"))
    assert found.columns == ["fingerprint", "length", "content"] and found.first().length == 7
    with pytest.raises(files.SourceError) as error:
        files.read_sources(spark, str(tmp_path / "none")).collect()
    assert "none" not in str(error.value)
    docs = spark.createDataFrame([(1, found.first().fingerprint), (2, "other")], "doc_id long, fingerprint string")
    assert files.verified(found, docs.where("doc_id = 1")).count() == 1
    with pytest.raises(Exception):
        files.verified(found, docs).collect()


def test_surfaces_are_scanned_with_pages(spark):
    page = "<title>T</title><a href='mailto:a%2Bb@example.org'>x</a><!-- c@example.org --><p>d@example.org</p>"
    hidden = surfaces.extract_surfaces(spark.createDataFrame([(1, page), (2, None)], "page_id long, html string"))
    pages = spark.createDataFrame([(1, 0, "d@example.org")], "doc_id long, page_index int, text string")
    found = detect(places_of(pages, hidden), only=[finders.find_emails])
    assert {(r.surface_id, r.text) for r in found.collect()} == {(None, "d@example.org"), ("link:doc:href/0", "a+b@example.org"), ("annotation:doc:comment/0", "c@example.org")}


def test_layout(spark):
    words = spark.createDataFrame([(1, 0, 0, 0, 0, "Ahoj"), (1, 0, 0, 0, 1, " "), (1, 0, 0, 0, 2, "světe"), (1, 0, 0, 1, 0, "nový"), (1, 0, 1, 0, 0, "é")], "doc_id long, page_index int, block int, line int, word_no int, text string")
    page = layout.assemble(words).first()
    assert page.text == "Ahoj světe\nnový\n\né" and [page.text[w.start : w.end] for w in page.words] == [w.text for w in page.words]
    made = layout.make_pages(spark.createDataFrame([(1, 0, "ab c\n d")], "doc_id long, page_index int, text string")).first()
    assert [(w.text, w.bbox.x0, w.bbox.y0) for w in made.words] == [("ab", 0.0, 0.0), ("c", 15.0, 0.0), ("d", 5.0, 14.0)]


def test_cut():
    for seed in range(60):
        draw = random.Random(seed)
        n = draw.randint(1, 60)
        spans = [(a, min(n - 1, a + draw.randint(0, 4))) for a in sorted(draw.sample(range(n), min(n, 5)))]
        ranges = cut([draw.random() < 0.1 for _ in range(n)], spans, 12)
        assert [a for a, _ in ranges] == [0, *(b for _, b in ranges[:-1])] and ranges[-1][1] == n and all(b - a <= 12 for a, b in ranges)


def test_examples(spark):
    pages = spark.createDataFrame([(1, 0, " ".join(f"w{i}" for i in range(30)))], "doc_id long, page_index int, text string")
    gold = spark.createDataFrame([(1, 0, "person", 24, 40)], "doc_id long, page_index int, type string, start int, end int")
    examples, spans = page_examples(pages, gold, 10, 8)
    ranges = [(r.first, r.last) for r in examples.orderBy("example").select("first", "last").collect()]
    (span,) = spans.collect()
    words = examples.where(f"example = {span.example}").first().tokens[span["first"] : span["last"] + 1]
    assert sum(b - a for a, b in ranges) == 30 and words == ["w8", "w9", "w10", "w11", "w12"]


def test_iob2_and_records(spark):
    text = "# newdoc\n1\tJan\tB-PER\n2\tNovák\tI-PER\n\n# newdoc\n1\tAlza\tI-ORG\n"
    lines = spark.createDataFrame([("f", i, x) for i, x in enumerate(text.split("\n"))], "doc_id string, line_no int, line string")
    sentences, spans = corpora.parse_iob2(lines)
    assert sorted(r.text for r in sentences.collect()) == ["Alza", "Jan Novák"]
    assert sorted((r.doc_id, r.type, r.start, r.end) for r in spans.collect()) == [("f/1", "person", 0, 9), ("f/2", "organization", 0, 4)]
    rows = spark.createDataFrame([(1, "call 123", [(5, 8, "123", "Telephone_Numbers_Work"), (0, 4, "xxxx", "Telephone_Numbers_Work"), (0, 4, "call", "Other")])], "doc_id int, text string, entities array<struct<start: int, end: int, entity_string: string, entity_type: string>>")
    assert sorted((r.label, r.type) for r in corpora.record_spans(rows).collect()) == [(corpora.SKIPPED, None), ("Other", None), ("Telephone_Numbers_Work", "phone")]
    placed = spark.createDataFrame([("Ahoj,  světe", ["Ahoj", ",", "světe"]), ("abc", ["a", "x"])], "text string, tokens array<string>")
    assert [r[0] for r in placed.select(corpora.placed_tokens(F.col("text"), F.col("tokens"))).collect()] == [[0, 4, 7], None]


def test_benchmark_documents(spark):
    toml = 'language = "cs"\nkind = "letter"\nlines = ["Dear [[person:Jan]], {{filler:3}}"]\ndecoys = ["x"]\n[[links]]\nanchor = "web"\ntarget = "mailto:[[email:a@b.cz]]"\n'
    rows = corpora.benchmark_documents(spark.createDataFrame([("d", bytearray(toml.encode()))], "name string, content binary"), ["lorem", "ipsum"]).orderBy("part").collect()
    assert [(r.carrier, r.text) for r in rows] == [("page", "Dear [[person:Jan]], lorem ipsum lorem"), ("page", "web"), ("link", "mailto:[[email:a@b.cz]]")]


def test_forms(spark, tmp_path):
    form = [{"id": 0, "label": "question", "text": "Phone:", "box": [0, 0, 1, 1], "linking": [[0, 1]], "words": [{"text": "Phone:", "box": [0, 0, 1, 1]}]}, {"id": 1, "label": "answer", "text": "555", "box": [2, 0, 3, 1], "linking": [[0, 1]], "words": []}]
    (tmp_path / "f.json").write_text(json.dumps({"form": form}))
    rows = forms.read_forms(spark, str(tmp_path / "*.json"))
    assert [(r.type, r.text) for r in forms.form_items(rows).collect()] == [("phone", "555")] and forms.form_words(rows).count() == 1


def test_models_and_cache(spark):
    pages = spark.createDataFrame([(1, 0, "pan Novák, a pan Novák."), (2, 0, "nic")], "doc_id long, page_index int, text string")
    load = lambda: models.DictionaryModel({"Novák": ("name", 0.6)})
    found = models.detect_with_model(pages, load, {"name": "person"}, 0.5)
    assert sorted((r.doc_id, r.text) for r in found.collect()) == [(1, "Novák"), (1, "Novák")]
    texts, cache = pages.select("text"), spark.createDataFrame([], f"key string, spans {models.SPANS}")
    answers, new = models.cached_predictions(texts, cache, load, "m", ["name"], 0.5)
    assert answers.count() == new.count() == 2
    again, more = models.cached_predictions(texts, new, load, "m", ["name"], 0.7)
    assert more.count() == 0 and sum(len(r.spans) for r in again.collect()) == 0
    assert models.threshold_for("m", None, 0.3) == 0.3 and models.cache_floor(0.05) == 0.02
    with pytest.raises(ValueError):
        models.cache_floor(0.01)


def test_resources(spark, tmp_path):
    path = str(tmp_path / "settings.json")
    resources.write_setting(path, "a", 1)
    resources.write_setting(path, "b", [2])
    assert resources.read_settings(path) == {"a": 1, "b": [2]}
    (tmp_path / "c.json").write_text(json.dumps([{"id": "m", "files": [{"path": "x", "size": 2, "sha256": "0"}]}, {"id": "u", "requires": ["m"]}]))
    catalog = resources.load_catalog(spark, str(tmp_path / "c.json"))
    stored = spark.createDataFrame([("x", bytearray(b"ab"))], "path string, content binary")
    assert [(r.id, r.reason) for r in resources.wrong_files(catalog, stored).collect()] == [("m", "checksum")]
    circle = spark.createDataFrame([("a", ["b"]), ("b", ["a"])], "id string, requires array<string>")
    with pytest.raises(ValueError):
        resources.with_requirements(circle, "a", 6)


def test_scans(spark):
    corners = [(0.0, 0.0), (10.0, 0.0), (10.0, 5.0), (0.0, 5.0)]
    truth = spark.createDataFrame([(1, 0, 0, "Jan", corners)], "doc_id long, page_index int, word_no int, text string, corners array<struct<x: double, y: double>>")
    read = spark.createDataFrame([(1, 0, 0, "Jan", 0, 3, (0.0, 0.0, 9.0, 5.0)), (1, 0, 1, "x", 4, 5, (0.0, 5.5, 9.0, 9.0))], "doc_id long, page_index int, line int, text string, start int, end int, box struct<x0: double, y0: double, x1: double, y1: double>")
    assert scans.box_scores(truth, read).first().boxed == 1
    pages = spark.createDataFrame([(1, 0, "Jan x")], "doc_id long, page_index int, text string")
    place = scans.item_locations(truth.withColumn("item", F.lit(0)), read, pages).first()
    assert (place.start, place.end) == (0, 3)
    assert scans.reach(read, 0.2).first().reaching == 2 and scans.reach(read, 0.0).first().reaching == 0


def test_streams(spark, tmp_path):
    folder, out = tmp_path / "in", tmp_path / "out"
    docs = spark.createDataFrame([(1, "a@example.org", "en", "s", 1), (2, "none", "en", "s", 1)], ingest.DOCUMENTS)
    docs.write.parquet(str(folder))
    stream = ingest.read_stream(spark, str(folder), ingest.DOCUMENTS)
    ingest.detect_stream(stream, str(out), str(tmp_path / "check")).awaitTermination()
    assert [r.text for r in spark.read.parquet(str(out)).collect()] == ["a@example.org"]
    ingest.detect_stream(ingest.read_stream(spark, str(folder), ingest.DOCUMENTS), str(out), str(tmp_path / "check")).awaitTermination()
    assert spark.read.parquet(str(out)).count() == 1
