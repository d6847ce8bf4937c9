"""Queries over sources, corpora, models, generators, resources and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspan.functions.text import text_key
from veilspan.operators import generators, geometry, models, overlap, resources, training
from veilspan.operators.detect import pages_of_documents
from veilspan.plans.base import fixture, made_spans, query, sql_rows, sql_spans, table
from veilspan.sources import corpora, export, files, surfaces
from veilspan.streaming import ingest

SQL_CARRIERS = {
    "title": ("metadata", r"(?is)<title[^>]*>(.*?)</title>"),
    "meta": ("metadata", r"""(?is)<meta\b[^>]*\bcontent\s*=\s*["'']([^"'']*)["'']"""),
    "href": ("link", r"""(?is)<a\b[^>]*\bhref\s*=\s*["'']([^"'']*)["'']"""),
    "comment": ("annotation", r"(?s)<!--(.*?)-->"),
    "script": ("embedded_file", r"(?is)<script\b[^>]*>(.*?)</script>"),
    "style": ("embedded_file", r"(?is)<style\b[^>]*>(.*?)</style>"),
    "alt": ("structure", r"""(?is)<[^>]*\b(?:alt|aria-label)\s*=\s*["'']([^"'']*)["'']"""),
    "value": ("form_field", r"""(?is)<input\b[^>]*\bvalue\s*=\s*["'']([^"'']*)["'']"""),
    "textarea": ("form_field", r"(?is)<textarea\b[^>]*>(.*?)</textarea>"),
}
SQL_SURFACES = " UNION ALL ".join(f"SELECT page_id AS doc_id, '{kind}' AS kind, '{name}' AS carrier, unnest(regexp_extract_all(html, '{pattern}', 1)) AS value FROM pages" for name, (kind, pattern) in SQL_CARRIERS.items())


@query(f"WITH s AS ({SQL_SURFACES}) SELECT doc_id, kind, count(*) AS n FROM s WHERE trim(value) <> '' GROUP BY doc_id, kind")
def surfaces_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surfaces.extract_surfaces(table(spark, sf_dir, "pages")).groupBy("doc_id", "kind").agg(F.count("*").alias("n"))


@query(f"WITH s AS ({SQL_SURFACES}) SELECT kind, carrier, count(*) AS n FROM s WHERE trim(value) <> '' GROUP BY GROUPING SETS ((kind, carrier), (kind), ())")
def surface_totals_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = surfaces.extract_surfaces(table(spark, sf_dir, "pages")).withColumn("carrier", F.substring_index("ref", "/", 1))
    return found.groupingSets([["kind", "carrier"], ["kind"], []], "kind", "carrier").agg(F.count("*").alias("n"))


@query("SELECT doc_id, sha256(CASE WHEN regexp_replace(text, '\\s', '', 'g') = '' THEN NULL ELSE regexp_replace(text, '\\s', '', 'g') END) AS key FROM documents")
def text_key_sha(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text_key(F.col("text")).alias("key"))


_KEY = "sha256(regexp_replace(text, '\\s', '', 'g'))"


@query(f"WITH held AS (SELECT DISTINCT {_KEY} AS key FROM documents WHERE lang <> 'en' OR source IN ('src1', 'src2')) SELECT doc_id FROM documents WHERE lang = 'en' AND source NOT IN ('src1', 'src2') AND {_KEY} NOT IN (SELECT key FROM held)")
def overlap_train_heldout(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    train = (F.col("lang") == "en") & ~F.col("source").isin("src1", "src2")
    held = overlap.held_texts(docs.where(~train).select(F.col("source").alias("split"), "text"))
    return overlap.without_held(docs.where(train), held).select("doc_id")


@query(f"WITH k AS (SELECT *, {_KEY} AS key FROM documents) SELECT h.source AS split, count(*) AS n FROM k t JOIN (SELECT DISTINCT source, key FROM k WHERE source IN ('src1', 'src2')) h USING (key) WHERE t.source NOT IN ('src1', 'src2') GROUP BY h.source")
def overlap_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = overlap.held_texts(docs.where(F.col("source").isin("src1", "src2")).select(F.col("source").alias("split"), "text"))
    return overlap.overlap_counts(docs.where(~F.col("source").isin("src1", "src2")), held)


@query("SELECT doc_id FROM documents ORDER BY md5('3|' || doc_id), doc_id LIMIT 20")
def seeded_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlap.seeded_sample(table(spark, sf_dir, "documents"), "doc_id", 20, 3).select("doc_id")


_MASKED = [
    (1, "cs", "Jan Novák, Lipová 5, 602 00 Brno a@b.cz", [("GIVENNAME", 0, 3, "Jan"), ("SURNAME", 4, 9, "Novák"), ("STREET", 11, 17, "Lipová"), ("BUILDINGNUM", 18, 19, "5"), ("ZIPCODE", 21, 27, "602 00"), ("CITY", 28, 32, "Brno"), ("EMAIL", 33, 39, "a@b.cz")]),
    (2, "cs", "Brno\nJan\nNovák", [("CITY", 0, 4, "Brno"), ("GIVENNAME", 5, 8, "Jan"), ("SURNAME", 9, 14, "Novák"), ("CITY", 0, 3, "Xxx")]),
]
_RUNS = [(1, "person", 0, 9), (1, "address", 11, 32), (1, "email", 33, 39), (2, None, 0, 4), (2, "person", 5, 8), (2, "person", 9, 14)]


@query(sql_rows(_RUNS, 'uid, type, start, "end"'))
def openpii_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fixture(spark, _MASKED, "uid long, language string, source_text string, privacy_mask array<struct<label: string, start: int, end: int, value: string>>")
    return corpora.openpii_spans(rows).select("uid", "type", "start", "end")


@query("SELECT o_orderkey, CASE WHEN CAST(('0x' || substr(sha256('openpii-1m:' || o_orderkey), 1, 2)) AS INTEGER) % 2 = 0 THEN 'dev' ELSE 'test' END AS half FROM orders")
def openpii_half(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", corpora.openpii_half(F.col("o_orderkey")).alias("half"))


_COLUMNS = "Jan B-PER\nNovák I-PER\nšel O\n\nBrno B-LOC\nFirma I-ORG\nEva B-PER\n"


@query(sql_rows([(0, "person", 0, 9), (1, None, 0, 4), (1, "organization", 5, 10), (1, "person", 11, 14)], 'sentence, type, start, "end"'))
def conll_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fixture(spark, [(1, i, line) for i, line in enumerate(_COLUMNS.split("\n"))], "doc_id int, line_no int, line string")
    _, spans = corpora.parse_columns(rows)
    return spans.select("sentence", "type", "start", "end")


_BRACKETS = [(0, "<P<pf Jan> <ps Novák>> z <A<gu Brna>>"), (1, "firma <if Alza> &amp; <at 123> <th ráno>")]


@query(sql_rows([(0, "Jan Novák z Brna", "person", 0, 9), (0, "Jan Novák z Brna", "address", 12, 16), (1, "firma Alza & 123 ráno", "organization", 6, 10), (1, "firma Alza & 123 ráno", "phone", 13, 16)], 'sentence, text, type, start, "end"'))
def cnec_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fixture(spark, [(1, i, line) for i, line in _BRACKETS], "doc_id int, sentence int, line string")
    return corpora.parse_cnec(rows).select("sentence", "text", F.explode("spans").alias("s")).select("sentence", "text", "s.type", "s.start", "s.end")


@query(sql_rows([("Jan bydlí v Brně", "person:Jan|address:Brně")], "text, items"))
def strip_markup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fixture(spark, [("[[person:Jan]] bydlí v [[address:Brně]]",)], "text string")
    text, items = corpora.strip_markup(F.col("text"))
    return rows.select(text.alias("text"), F.array_join(F.transform(items, lambda x: F.concat(x["type"], F.lit(":"), x["text"])), "|").alias("items"))


@query("SELECT count(DISTINCT text) FILTER (WHERE substr(sha256('stand-in' || chr(10) || 'name' || chr(10) || text), 1, 1) < '8') AS hits, count(DISTINCT text) FILTER (WHERE substr(sha256('stand-in' || chr(10) || 'name' || chr(10) || text), 1, 1) >= '8') AS misses FROM conversations")
def cache_hit_miss(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = table(spark, sf_dir, "conversations").where("text IS NOT NULL")
    cache = texts.select(models.cache_key("stand-in", ["name"], F.col("text")).alias("key")).where(F.substring("key", 1, 1) < "8").distinct()
    return models.hits_and_misses(texts, cache, "stand-in", ["name"])


def _stand_in() -> models.DictionaryModel:
    return models.DictionaryModel({"the": ("word", 0.9), "la": ("word", 0.4)})


@query(r"SELECT doc_id, CAST(len([x FOR x IN regexp_extract_all(text, '[\p{L}\p{M}\p{N}_]+') IF x = 'the']) AS BIGINT) AS n FROM documents WHERE list_contains(regexp_extract_all(text, '[\p{L}\p{M}\p{N}_]+'), 'the')")
def model_stand_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = pages_of_documents(table(spark, sf_dir, "documents"))
    return models.detect_with_model(pages, _stand_in, {"word": "other"}, 0.5).groupBy("doc_id").agg(F.count("*").alias("n"))


@query("SELECT page_id, sha256(html) AS fingerprint, CASE WHEN starts_with(hex(encode(html)), 'FFD8FF') THEN 'jpeg' END AS picture FROM pages")
def file_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    content = F.col("html").cast("binary")
    return table(spark, sf_dir, "pages").select("page_id", files.fingerprint(content).alias("fingerprint"), files.image_format(content).alias("picture"))


_HEADS = [("FFD8FFE0", "jpeg", "image"), ("89504E470D0A1A0A00", "png", "image"), ("49492A0000", "tiff", "image"), ("4D4D002B00", "tiff", "image"), ("255044462D312E37", None, "pdf"), ("0A0A255044462D31", None, "pdf"), ("00", None, None)]


@query(sql_rows(_HEADS, "head, picture, kind"))
def file_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fixture(spark, [(x,) for x, *_ in _HEADS], "head string").withColumn("content", F.unhex("head"))
    return rows.select("head", files.image_format(F.col("content")).alias("picture"), files.source_kind(F.col("content")).alias("kind"))


_DECLINED = [
    ("Novák", "hard", "voc", "cs", "Nováku"), ("Petr", "hard", "voc", "cs", "Petře"), ("Hájek", "mobile-e", "gen", "cs", "Hájka"), ("Lenka", "a-fem", "dat", "cs", "Lence"), ("Jana", "a-fem", "loc", "cs", "Janě"),
    ("Malý", "adj-masc", "ins", "cs", "Malým"), ("Svoboda", "a-masc", "acc", "sk", "Svobodu"), ("Mária", "ia-fem", "gen", "sk", "Márie"), ("Smith", "indeclinable", "dat", "cs", "Smith"), ("Novák", "hard", "voc", "sk", None),
]


@query(sql_rows(_DECLINED, "word, paradigm, c, language, form"))
def declension(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fixture(spark, [row[:4] for row in _DECLINED], "word string, paradigm string, c string, language string")
    return rows.withColumn("form", generators.decline(F.col("word"), F.col("paradigm"), F.col("c"), F.col("language")))


_OWNED = [("Novák", "hard", "f", "cs", "Novákova", "Nováková"), ("Lenka", "a-fem", "m", "cs", "Lenčin", None), ("Petra", "a-fem", "m_loc", "cs", "Petřině", None), ("Malý", "adj-masc", "m", "cs", None, "Malá"), ("Lenka", "a-fem", "m", "sk", None, None)]


@query(sql_rows(_OWNED, "word, paradigm, agreement, language, own, feminine"))
def possessives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fixture(spark, [row[:4] for row in _OWNED], "word string, paradigm string, agreement string, language string")
    own = generators.possessive(F.col("word"), F.col("paradigm"), F.col("agreement"), F.col("language"))
    return rows.withColumn("own", own).withColumn("feminine", generators.feminine_surname(F.col("word"), F.col("paradigm"))["word"])


@query(
    """SELECT c_custkey AS person, TRUE AS birth_number, TRUE AS account, TRUE AS iban FROM customer"""
)
def identities_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Made-up identifiers that pass their own checks, all of them."""
    from veilspan.functions import checksums as C

    people = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("person"), F.lit("cs").alias("language"))
    made = generators.identities(spark, people)
    prefix, base = F.regexp_extract("account", r"^(\d+)-", 1), F.regexp_extract("account", r"-(\d+)/", 1)
    return made.select("person", C.valid_birth_number(F.col("birth_number")).alias("birth_number"), C.valid_account_number(base, prefix).alias("account"), C.valid_iban(F.col("iban")).alias("iban"))


@query(sql_rows([("k", "Paní Jana Malá (tel. 123) píše.", "person:5:14|phone:21:24")], "key, text, spans"))
def rendered_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    templates = fixture(spark, [("k", "Paní {name} (tel. {phone}) píše.")], "key string, template string")
    values = fixture(spark, [("k", {"name": ("person", "Jana Malá"), "phone": ("phone", "123")})], "key string, values map<string, struct<type: string, text: string>>")
    return generators.render(templates, values).select("key", "text", F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["type"], s["start"].cast("string"), s["end"].cast("string"))), "|").alias("spans"))


@query(sql_rows([("a", 0), ("b", 1), ("c", 2), ("d", 3)], "id, depth"))
def catalog_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fixture(spark, [("a", ["b", "c"]), ("b", ["c"]), ("c", ["d"]), ("d", []), ("e", ["a"])], "id string, requires array<string>")
    return resources.with_requirements(rows, "a")


@query(
    """WITH b AS (SELECT l_orderkey, l_linenumber, CAST(l_quantity AS DOUBLE) AS x0, CAST(l_linenumber AS DOUBLE) AS y0, l_quantity + 10.0 AS x1, l_linenumber + 5.0 AS y1 FROM lineitem)
SELECT a.l_orderkey, a.l_linenumber AS first, c.l_linenumber AS second,
  round(greatest(least(a.x1, c.x1) - greatest(a.x0, c.x0), 0) * greatest(least(a.y1, c.y1) - greatest(a.y0, c.y0), 0) / (100.0 - greatest(least(a.x1, c.x1) - greatest(a.x0, c.x0), 0) * greatest(least(a.y1, c.y1) - greatest(a.y0, c.y0), 0)), 6) AS iou
FROM b a JOIN b c ON a.l_orderkey = c.l_orderkey AND a.l_linenumber < c.l_linenumber WHERE a.x0 < c.x1 AND c.x0 < a.x1 AND a.y0 < c.y1 AND c.y0 < a.y1"""
)
def box_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = F.col("l_quantity").cast("double"), F.col("l_linenumber").cast("double")
    boxes = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", geometry.box(x, y, x + 10, y + 5).alias("box"))
    a, b = boxes.alias("a"), boxes.alias("b")
    met = a.join(b, "l_orderkey").where((F.col("a.l_linenumber") < F.col("b.l_linenumber")) & geometry.touches(F.col("a.box"), F.col("b.box")))
    return met.select("l_orderkey", F.col("a.l_linenumber").alias("first"), F.col("b.l_linenumber").alias("second"), F.round(geometry.iou(F.col("a.box"), F.col("b.box")), 6).alias("iou"))


@query(f"""WITH s AS {sql_spans('table')} SELECT doc_id, string_agg(type || ' ' || n, ', ' ORDER BY n DESC, type) AS summary FROM (SELECT doc_id, type, count(*) AS n FROM s GROUP BY ALL) GROUP BY doc_id""")
def document_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return export.document_summary(made_spans(spark, sf_dir, "table"))


@query(r"SELECT CAST(sum(len(regexp_extract_all(text, '[\p{L}\p{M}\p{N}_]+(?:[-_][\p{L}\p{M}\p{N}_]+)*|\S'))) AS BIGINT) AS tokens FROM documents")
def training_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = pages_of_documents(table(spark, sf_dir, "documents"))
    examples, spans = training.page_examples(pages, made_spans(spark, sf_dir, "gold"), 100, 12)
    return training.conversion_counts(examples, spans).select("tokens")


@query(
    """SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR AS "end", event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL"""
)
def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.windowed_counts(table(spark, sf_dir, "events")).withColumn("total", F.round("total", 4))


@query(
    """WITH o AS (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS before FROM events), n AS (SELECT user_id, ts, sum(CASE WHEN before IS NULL OR ts >= before + INTERVAL 30 MINUTE THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM o)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS n FROM n GROUP BY user_id, s"""
)
def event_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.sessions(table(spark, sf_dir, "events"))
