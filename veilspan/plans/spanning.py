"""Queries over spans: merging, propagation, redaction, leaks, layout, windows, review."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspan.operators import finders, merge, propagate, redact, roles, windows
from veilspan.operators.detect import detect, pages_of_conversations, pages_of_documents, scan
from veilspan.operators.intervals import runs, union_ranges
from veilspan.operators.leaks import searchable, text_leaks, thumbnail_leaks
from veilspan.operators.review import review_counts, set_reviews
from veilspan.plans.base import fixture, h, made_spans, query, rank_sql, sql_h, sql_rows, sql_spans, table
from veilspan.plans.finding import SQL_EMAILS
from veilspan.sources.layout import assemble

SPAN_COLUMNS = ["doc_id", "ordinal", "type", "start", "end"]
ORDER_SQL = lambda x: f'({rank_sql(x + ".type")}, {x}.start - {x}."end", -{x}.score, {x}.start, {x}.ordinal)'


@query(
    f"""WITH s AS {sql_spans('merge')} SELECT a.doc_id, a.ordinal, a.type, a.start, a."end" FROM s a WHERE NOT EXISTS
  (SELECT 1 FROM s b WHERE b.doc_id = a.doc_id AND b.start <= a.start AND a."end" <= b."end" AND {ORDER_SQL('b')} < {ORDER_SQL('a')})"""
)
def merge_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.merge_entities(made_spans(spark, sf_dir, "merge")).select(*SPAN_COLUMNS)


@query(
    f"""WITH s AS (SELECT *, 'a' AS detector FROM {sql_spans('left')} UNION ALL SELECT *, 'b' AS detector FROM {sql_spans('right')}),
g AS (SELECT * FROM s x WHERE EXISTS (SELECT 1 FROM s y WHERE y.doc_id = x.doc_id AND y.detector <> x.detector AND y.type = x.type AND y.start < x."end" AND x.start < y."end"))
SELECT a.doc_id, a.detector, a.ordinal, a.type, a.start, a."end" FROM g a WHERE NOT EXISTS
  (SELECT 1 FROM g b WHERE b.doc_id = a.doc_id AND b.start <= a.start AND a."end" <= b."end" AND {ORDER_SQL('b')} < {ORDER_SQL('a')})"""
)
def agreement_two_detectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = made_spans(spark, sf_dir, "left").withColumn("detector", F.lit("a")).unionByName(made_spans(spark, sf_dir, "right").withColumn("detector", F.lit("b")))
    return merge.agreement(both, 2).select("detector", *SPAN_COLUMNS)


@query(
    f"""WITH s AS (SELECT DISTINCT doc_id, type, start, "end" FROM {sql_spans('outer', 10)}) SELECT a.* FROM s a WHERE NOT EXISTS
  (SELECT 1 FROM s b WHERE b.doc_id = a.doc_id AND b.type = a.type AND b.start <= a.start AND a."end" <= b."end" AND b."end" - b.start > a."end" - a.start)"""
)
def outermost_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.outermost(made_spans(spark, sf_dir, "outer", 10)).select("doc_id", "type", "start", "end")


@query(
    f"""WITH s AS {sql_spans('union', 8)}, o AS (SELECT *, max("end") OVER (PARTITION BY doc_id ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM s WHERE start < "end"),
n AS (SELECT *, sum(CASE WHEN r IS NULL OR start > r THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS i FROM o)
SELECT doc_id, min(start) AS start, max("end") AS "end" FROM n GROUP BY doc_id, i"""
)
def interval_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return union_ranges(made_spans(spark, sf_dir, "union", 8), ["doc_id"])


@query(
    """WITH f AS (SELECT o_custkey, o_orderkey, o_totalprice > 150000 AS high, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders),
r AS (SELECT o_custkey, n, n - row_number() OVER (PARTITION BY o_custkey ORDER BY n) AS g FROM f WHERE high)
SELECT o_custkey, min(n) AS start, max(n) + 1 AS "end" FROM r GROUP BY o_custkey, g"""
)
def runs_of_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    order = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    rows = table(spark, sf_dir, "orders").select("o_custkey", (F.col("o_totalprice") > 150000).alias("high"), F.row_number().over(order).cast("long").alias("n"))
    return runs(rows, ["o_custkey"], "n", "high")


_TOKENS = r"regexp_extract_all(text, '[\p{L}\p{M}\p{N}_]+')"


@query(
    f"""WITH t AS (SELECT doc_id, {_TOKENS} AS w FROM documents), m AS (SELECT doc_id, w, list_extract(w, 3) AS marked FROM t WHERE len(w) >= 3)
SELECT doc_id, marked, CAST(len([x FOR x IN w IF x = marked]) - 1 AS BIGINT) AS n FROM m WHERE len([x FOR x IN w IF x = marked]) > 1"""
)
def propagate_occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = pages_of_documents(table(spark, sf_dir, "documents"))
    head = r"^(?:[^\p{L}\p{M}\p{N}_]*+[\p{L}\p{M}\p{N}_]++){2}[^\p{L}\p{M}\p{N}_]++([\p{L}\p{M}\p{N}_]++)"
    told = pages.select("doc_id", "page_index", F.length(F.regexp_extract("text", head, 0)).alias("end"), F.regexp_extract("text", head, 1).alias("text")).where("text <> ''")
    marked = told.select("doc_id", "page_index", F.lit(0).cast("long").alias("ordinal"), F.lit("person").alias("type"), (F.col("end") - F.length("text")).alias("start"), "end", "text", F.lit("confirmed").alias("review"))
    return propagate.propagate_occurrences(pages, marked).groupBy("doc_id", F.col("text").alias("marked")).agg(F.count("*").alias("n"))


_TITLED = [
    (1, "Dobrý den, doc. Ing. Jan Novák, Ph.D. přišel", 21, 30, "doc. Ing. Jan Novák, Ph.D."),
    (2, "Jan Novák odešel", 0, 9, "Jan Novák"),
    (3, "Ing.\narch. Eva Malá", 11, 19, "Ing.\narch. Eva Malá"),
    (4, "Lng. Eva Malá MBA", 5, 13, "Eva Malá MBA"),
]


@query(sql_rows([(k, wide) for k, *_, wide in _TITLED], "doc_id, text"))
def titles_widen(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fixture(spark, [(k, t, a, b) for k, t, a, b, _ in _TITLED], "doc_id int, page string, start int, end int")
    pages = rows.select("doc_id", F.lit(0).alias("page_index"), F.col("page").alias("text"))
    people = rows.select("doc_id", F.lit(0).alias("page_index"), F.lit("person").alias("type"), "start", "end", F.substring("page", F.col("start") + 1, F.col("end") - F.col("start")).alias("text"))
    return propagate.extend_with_titles(pages, people).select("doc_id", "text")


_NAMES = [(1, "zaměstnanec Jan Novák,", "cs", "Jan Novák"), (2, "Kupující", "cs", None), (3, "pan Jan z Lobkovic", "cs", "Jan z Lobkovic"), (4, "the Tenant", "en", None), (5, "(Eva Malá)", "en", "Eva Malá"), (6, "dnes odešel", "cs", None)]


@query(sql_rows([(k, cut) for k, _, _, cut in _NAMES], "case_id, cut"))
def names_only_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fixture(spark, [(k, t, lang) for k, t, lang, _ in _NAMES], "case_id int, text string, lang string")
    cut = F.when(F.col("lang") == "cs", roles.cut_to_name("text", F.lit(0), F.length("text"), "cs")).otherwise(roles.cut_to_name("text", F.lit(0), F.length("text"), "en"))
    return rows.withColumn("_c", cut).select("case_id", F.when(F.col("_c").isNotNull(), F.substring("text", F.col("_c.start") + 1, F.col("_c.end") - F.col("_c.start"))).alias("cut"))


_FIELDS = [(1, "Post Code AB1 2CD", "AB1 2CD"), (2, "Telephone Number", None), (3, "Home Farm, Ely", "Home Farm, Ely"), (4, "Lipová 5 PSČ", "Lipová 5"), (5, "Adresa: Lipová 5,", "Lipová 5")]


@query(sql_rows([(k, cut) for k, _, cut in _FIELDS], "case_id, cut"))
def address_label_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fixture(spark, [(k, t) for k, t, _ in _FIELDS], "case_id int, text string").withColumn("_c", roles.cut_to_address("text", F.lit(0), F.length("text")))
    return rows.select("case_id", F.when(F.col("_c").isNotNull(), F.substring("text", F.col("_c.start") + 1, F.col("_c.end") - F.col("_c.start"))).alias("cut"))


_PARADIGMS = [(language, number, row) for language, own in roles.INFLECTED.items() for number, row in enumerate(own)]


@query(
    f"""WITH bases AS ({sql_rows([(x, i, base, row['cut']) for x, i, row in _PARADIGMS for base in row['bases']], 'language, paradigm, base, cut')}),
endings AS ({sql_rows([(x, i, ending) for x, i, row in _PARADIGMS for ending in row['endings']], 'language, paradigm, ending')})
SELECT DISTINCT language, left(base, length(base) - cut) || ending AS form, TRUE AS is_noun FROM bases JOIN endings USING (language, paradigm)"""
)
def role_word_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All forms of role nouns, and whether the pattern knows them."""
    forms = roles.inflected_forms(*roles.paradigms(spark))
    known = F.lit(False)
    for language in roles.INFLECTED:
        known = known | ((F.col("language") == language) & roles.role_noun(F.col("form"), language))
    return forms.withColumn("is_noun", known)


@query(
    r"""SELECT doc_id, regexp_replace(text, '(?:\S*[^A-Za-z0-9._%+\-\s])?[A-Za-z0-9._%+\-]+@[A-Za-z0-9\-]+(?:\.[A-Za-z0-9\-]+)*\.[A-Za-z]{2,}(?:[^A-Za-z0-9\-\s]\S*)?', '[EMAIL]', 'g') AS text FROM documents"""
)
def redact_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = pages_of_documents(table(spark, sf_dir, "documents"))
    return redact.redact_text(pages, detect(pages, only=[finders.find_emails]))


@query(f"SELECT doc_id, CAST(len(list_distinct(m)) AS BIGINT) AS n FROM (SELECT doc_id, {SQL_EMAILS} AS m FROM documents) WHERE len(m) > 0")
def leak_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = pages_of_documents(table(spark, sf_dir, "documents"))
    return text_leaks(pages, detect(pages, only=[finders.find_emails])).groupBy("doc_id").agg(F.count("*").alias("n"))


@query("SELECT CAST(0 AS BIGINT) AS leaks")
def leak_text_after_redaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = pages_of_documents(table(spark, sf_dir, "documents"))
    found = detect(pages, only=[finders.find_emails, finders.find_card_numbers])
    return text_leaks(redact.redacted_pages(pages, found), found).agg(F.count("*").alias("leaks"))


@query(
    r"""WITH w AS (SELECT conv_id, turn, [x FOR x IN regexp_split_to_array(text, '\s+') IF x <> ''] AS w FROM conversations)
SELECT conv_id AS doc_id, CAST(turn AS INTEGER) AS page_index, array_to_string(w, ' ') AS text, CAST(len(w) AS BIGINT) AS n_words, CAST(list_sum([length(x) FOR x IN w]) + len(w) - 1 AS BIGINT) AS last_end
FROM w WHERE len(w) > 0"""
)
def layout_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = pages_of_conversations(table(spark, sf_dir, "conversations"))
    words = turns.select("doc_id", "page_index", F.posexplode(F.filter(F.split("text", r"\s+"), lambda w: w != "")).alias("word_no", "text"), F.lit(0).alias("block"), F.lit(0).alias("line"))
    pages = assemble(words)
    return pages.select("doc_id", "page_index", "text", F.size("words").cast("long").alias("n_words"), F.element_at("words", -1)["end"].cast("long").alias("last_end"))


@query(
    r"""WITH t AS (SELECT doc_id, len(regexp_extract_all(text, '[\p{L}\p{M}\p{N}_]+(?:[-_][\p{L}\p{M}\p{N}_]+)*|\S')) AS n FROM documents)
SELECT doc_id, CAST(n AS BIGINT) AS n_tokens, CAST(CASE WHEN n = 0 THEN 0 WHEN n <= 150 THEN 1 ELSE 1 + ceil((n - 150) / 110.0) END AS BIGINT) AS n_windows FROM t"""
)
def token_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = table(spark, sf_dir, "documents").select("doc_id", windows.token_count("text").alias("n"))
    return tokens.select("doc_id", F.col("n").cast("long").alias("n_tokens"), F.size(windows.window_bounds(F.col("n"))).cast("long").alias("n_windows"))


@query(
    r"""WITH t AS (SELECT conv_id AS doc_id, turn, regexp_extract_all(text, '[\p{L}\p{M}\p{N}_]+(?:[-_][\p{L}\p{M}\p{N}_]+)*|\S') AS w FROM conversations), n AS (SELECT *, len(w) AS n FROM t),
k AS (SELECT *, unnest(CASE WHEN n = 0 THEN [] ELSE range(0, 1 + CAST(greatest(ceil((n - 8) / 6.0), 0) AS BIGINT)) END) * 6 AS f FROM n)
SELECT doc_id, CAST(turn AS INTEGER) AS page_index, CAST(f AS INTEGER) AS first, CAST(least(f + 8, n) AS INTEGER) AS last, w[f + 1] AS first_text, w[least(f + 8, n)] AS last_text FROM k"""
)
def token_window_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of eight tokens over turns, with the texts at their edges cut out by their offsets."""
    turns = pages_of_conversations(table(spark, sf_dir, "conversations")).withColumn("t", windows.model_tokens("text"))
    cut = turns.select("doc_id", "page_index", "text", "t", F.explode(windows.token_windows(F.col("t"), 8, 2)).alias("w"))
    first, last = F.get("t", F.col("w.first")), F.get("t", F.col("w.last") - 1)
    edge = lambda start, end: F.substring("text", start + 1, end - start)
    return cut.select("doc_id", "page_index", "w.first", "w.last", edge(F.col("w.start"), first["end"]).alias("first_text"), edge(last["start"], F.col("w.end")).alias("last_text"))


_WIDENED = [(1, "Viděl (J. Novák). Pak", 8, 9, "J"), (2, "pan Novák.", 5, 7, "Novák"), (3, "firma s.r.o. dnes", 6, 9, "s.r.o."), (4, "a ... b", 2, 4, "..."), (5, "„Praha“ je", 2, 4, "Praha")]


@query(sql_rows([(k, wide) for k, *_, wide in _WIDENED], "case_id, wide"))
def widen_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fixture(spark, [(k, t, a, b) for k, t, a, b, _ in _WIDENED], "case_id int, text string, start int, end int").withColumn("_c", windows.widen_to_words("text", F.col("start"), F.col("end")))
    return rows.select("case_id", F.when(F.col("_c").isNotNull(), F.substring("text", F.col("_c.start") + 1, F.col("_c.end") - F.col("_c.start"))).alias("wide"))


@query(
    f"""WITH s AS {sql_spans('review')}, r AS (SELECT *, CASE WHEN score < 0.3 THEN 'rejected' WHEN type = 'email' THEN 'confirmed' ELSE 'pending' END AS review FROM s)
SELECT doc_id, review, count(*) AS n FROM r GROUP BY doc_id, review"""
)
def review_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = made_spans(spark, sf_dir, "review").withColumn("entity_id", F.concat_ws("-", "doc_id", "ordinal")).withColumn("review", F.lit("pending"))
    once = set_reviews(spans, spans.where("type = 'email'"), "confirmed")
    return review_counts(set_reviews(once, spans.where("score < 0.3"), "rejected"))


@query(
    f"""WITH w AS (SELECT doc_id, i, list_extract(['O', 'B-PER', 'I-PER', 'B-ORG'], CAST(1 + {sql_h("'tag'", 'CAST(doc_id AS VARCHAR)', 'CAST(i AS VARCHAR)')} % 4 AS INTEGER)) AS label FROM documents, (SELECT unnest(range(0, 30)) AS i)),
l AS (SELECT *, CASE WHEN label = 'O' THEN NULL ELSE substr(label, 3) END AS type FROM w), p AS (SELECT *, lag(type) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM l),
n AS (SELECT *, sum(CASE WHEN type IS NOT NULL AND NOT (label LIKE 'I-%' AND type IS NOT DISTINCT FROM before) THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS g FROM p)
SELECT doc_id, type, min(i) AS first, max(i) AS last FROM n WHERE type IS NOT NULL GROUP BY doc_id, type, g"""
)
def iob2_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(29).cast("long"))).alias("word"))
    label = F.element_at(F.array(*(F.lit(x) for x in ("O", "B-PER", "I-PER", "B-ORG"))), (1 + h("tag", F.col("doc_id"), F.col("word")) % 4).cast("int"))
    tagged = rows.withColumn("label", label).withColumn("type", F.when(F.col("label") != "O", F.substring("label", 3, 10)))
    return windows.spans_of_labels(tagged).select("doc_id", "type", "first", "last")


@query(f"SELECT doc_id, count(*) AS n FROM (SELECT doc_id, unnest({SQL_EMAILS}) FROM documents) GROUP BY doc_id")
def scan_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(pages_of_documents(table(spark, sf_dir, "documents")), only=[finders.find_emails]).groupBy("doc_id").agg(F.count("*").alias("n"))


@query(
    """SELECT doc_id, '<< /Length 3' || CASE doc_id % 3 WHEN 0 THEN ' /Filter /X' WHEN 1 THEN ' /Subtype  /Image' ELSE '' END || CASE WHEN doc_id % 2 = 0 THEN ' /Sub << >>' ELSE '' END || ' >>' || chr(10) || 'stream' || chr(10)
  || CASE WHEN doc_id % 3 = 2 THEN 'body' || doc_id ELSE '' END || 'endstream end' AS content FROM documents"""
)
def file_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Streams of three kinds, half of them with a nested dictionary, as leak checks read them."""
    key = F.col("doc_id")
    kind = F.when(key % 3 == 0, " /Filter /X").when(key % 3 == 1, " /Subtype  /Image").otherwise("")
    nested = F.when(key % 2 == 0, " /Sub << >>").otherwise("")
    file = F.concat(F.lit("1 0 obj << /Filter /Y >> endobj 2 0 obj"), F.lit("<< /Length 3"), kind, nested, F.lit(" >>\nstream\nbody"), key.cast("string"), F.lit("endstream end"))
    rows = table(spark, sf_dir, "documents").select("doc_id", searchable(file.cast("binary")).alias("content"))
    return rows.select("doc_id", F.expr("substring(content, 1 + length('1 0 obj << /Filter /Y >> endobj 2 0 obj'))").alias("content"))


@query("SELECT c_custkey AS doc_id, CAST(0 AS INTEGER) AS page_index, 'page thumbnail' AS text FROM customer WHERE c_custkey % 4 = 0")
def leak_thumbnails(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    content = F.concat(F.lit("<< /Type /Page "), F.when(key % 4 == 0, "/Thumb 12 0 R").when(key % 4 == 1, "/Thumb null").when(key % 4 == 2, "/Thumbs 3").otherwise(""), F.lit(" >>"))
    pages = table(spark, sf_dir, "customer").select(key.alias("doc_id"), F.lit(0).alias("page_index"), content.alias("content"))
    return thumbnail_leaks(pages).select("doc_id", "page_index", "text")
