"""Queries over scores: matches, coverage, bootstrap, comparisons, benchmark totals, errors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspan.operators import benchmark, finders, metrics
from veilspan.operators.detect import detect, pages_of_documents
from veilspan.operators.errors import shape
from veilspan.operators.redact import redact_text
from veilspan.plans.base import TYPES, fixture, h, made_spans, query, sql_h, sql_rows, sql_spans, table

P, G = sql_spans("pred"), sql_spans("gold")
ALL_TYPES = ", ".join(f"'{t}'" for t in TYPES)


def sql_counts(predicted: str, name: str = "") -> str:
    """CTEs that end in ``counts<name>``: the tallies of made-up predictions against the gold spans."""
    p, g, pm, gm = (f"{x}{name}" for x in ("p", "g", "pm", "gm"))
    same = f"{g}.doc_id = {p}.doc_id AND {g}.type = {p}.type"
    strict, partial = f'{same} AND {g}.start = {p}.start AND {g}."end" = {p}."end"', f'{same} AND {g}.start < {p}."end" AND {p}.start < {g}."end"'
    side = lambda own, other: (
        f"SELECT {own}.doc_id, {own}.type, count(*) AS n, sum(CASE WHEN EXISTS (SELECT 1 FROM {other} WHERE {strict}) THEN 1 ELSE 0 END) AS s, "
        f"sum(CASE WHEN EXISTS (SELECT 1 FROM {other} WHERE {partial}) THEN 1 ELSE 0 END) AS o FROM {own} GROUP BY ALL"
    )
    return f"""{p} AS (SELECT DISTINCT doc_id, start, "end", type FROM {predicted} UNION SELECT DISTINCT doc_id, start, "end", 'any' FROM {predicted}),
{g} AS (SELECT DISTINCT doc_id, start, "end", type FROM {G} UNION SELECT DISTINCT doc_id, start, "end", 'any' FROM {G}),
{pm} AS ({side(p, g)}), {gm} AS ({side(g, p)}),
counts{name} AS (SELECT coalesce({pm}.doc_id, {gm}.doc_id) AS doc_id, m.mode, coalesce({pm}.type, {gm}.type) AS type, coalesce({pm}.n, 0) AS predicted,
  CAST(coalesce(CASE WHEN m.mode = 'strict' THEN {pm}.s ELSE {pm}.o END, 0) AS BIGINT) AS predicted_matched, coalesce({gm}.n, 0) AS gold,
  CAST(coalesce(CASE WHEN m.mode = 'strict' THEN {gm}.s ELSE {gm}.o END, 0) AS BIGINT) AS gold_matched
  FROM {pm} FULL JOIN {gm} ON {pm}.doc_id = {gm}.doc_id AND {pm}.type = {gm}.type, (VALUES ('strict'), ('partial')) AS m(mode))"""


MATCHED = sql_counts(P)


def _counts(spark: SparkSession, sf_dir: str, salt: str = "pred") -> DataFrame:
    return metrics.match_counts(made_spans(spark, sf_dir, salt), made_spans(spark, sf_dir, "gold"), TYPES)


@query(f"WITH {MATCHED} SELECT * FROM counts WHERE mode = 'strict'")
def match_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _counts(spark, sf_dir).where("mode = 'strict'")


@query(f"WITH {MATCHED} SELECT * FROM counts WHERE mode = 'partial'")
def match_partial(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _counts(spark, sf_dir).where("mode = 'partial'")


@query(
    f"""WITH {MATCHED}, t AS (SELECT mode, type, sum(predicted) AS p, sum(predicted_matched) AS pm, sum(gold) AS g, sum(gold_matched) AS gm FROM counts GROUP BY mode, type),
r AS (SELECT mode, type, pm / p AS precision, gm / g AS recall FROM t)
SELECT mode, type, round(precision, 9) AS precision, round(recall, 9) AS recall, round(2 * precision * recall / (precision + recall), 9) AS f1, round(5 * precision * recall / (4 * precision + recall), 9) AS f2 FROM r WHERE precision + recall > 0"""
)
def f_beta(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = metrics.total(_counts(spark, sf_dir), ["mode", "type"], metrics.COUNTS)
    return whole.select("mode", "type", *(F.round(value, 9).alias(name) for name, value in metrics.count_metrics().items())).where("precision + recall > 0")


CHARS = f"""d AS (SELECT doc_id, text FROM documents),
pc AS (SELECT DISTINCT s.doc_id, s.type, unnest(range(CAST(s.start AS BIGINT), CAST(s."end" AS BIGINT))) AS c FROM {P} s),
gc AS (SELECT DISTINCT s.doc_id, s.type, unnest(range(CAST(s.start AS BIGINT), CAST(s."end" AS BIGINT))) AS c FROM {G} s),
v AS (SELECT doc_id, c FROM (SELECT doc_id, c FROM pc UNION SELECT doc_id, c FROM gc) JOIN d USING (doc_id) WHERE NOT regexp_matches(substr(text, c + 1, 1), '^\\s$')),
pv AS (SELECT pc.* FROM pc JOIN v USING (doc_id, c)), gv AS (SELECT gc.* FROM gc JOIN v USING (doc_id, c)),
pa AS (SELECT doc_id, type, c FROM pv UNION SELECT doc_id, 'any', c FROM pv), ga AS (SELECT doc_id, type, c FROM gv UNION SELECT doc_id, 'any', c FROM gv)"""


@query(
    f"""WITH {CHARS.replace(chr(92) * 2, chr(92))},
gn AS (SELECT g.doc_id, g.type, count(*) AS gold_characters, count(*) - count(x.c) AS residual_characters FROM ga g LEFT JOIN (SELECT DISTINCT doc_id, c FROM pv) x ON x.doc_id = g.doc_id AND x.c = g.c GROUP BY ALL),
pn AS (SELECT p.doc_id, p.type, count(*) - count(x.c) AS over_characters FROM pa p LEFT JOIN (SELECT DISTINCT doc_id, c FROM gv) x ON x.doc_id = p.doc_id AND x.c = p.c GROUP BY ALL),
keys AS (SELECT doc_id, length(regexp_replace(text, '\\s', '', 'g')) AS text_characters, type FROM documents, (SELECT unnest([{ALL_TYPES}, 'any']) AS type))
SELECT doc_id, type, coalesce(gold_characters, 0) AS gold_characters, coalesce(residual_characters, 0) AS residual_characters, coalesce(over_characters, 0) AS over_characters, CAST(text_characters AS BIGINT) AS text_characters
FROM keys LEFT JOIN gn USING (doc_id, type) LEFT JOIN pn USING (doc_id, type)""".replace(chr(92) * 2, chr(92))
)
def coverage_residual(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _coverage(spark, sf_dir).drop("gold_items", "hidden_items")


def _coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = pages_of_documents(table(spark, sf_dir, "documents"))
    return metrics.coverage(made_spans(spark, sf_dir, "pred"), made_spans(spark, sf_dir, "gold"), TYPES, pages)


@query(
    f"""WITH d AS (SELECT doc_id, text FROM documents), g AS (SELECT DISTINCT doc_id, type, start, "end" FROM {G} UNION SELECT DISTINCT doc_id, 'any', start, "end" FROM {G}),
c AS (SELECT g.*, unnest(range(CAST(start AS BIGINT), CAST("end" AS BIGINT))) AS c FROM g), v AS (SELECT c.* FROM c JOIN d USING (doc_id) WHERE NOT regexp_matches(substr(text, c + 1, 1), '^\\s$')),
left_ AS (SELECT DISTINCT v.doc_id, v.type, v.start, v."end" FROM v WHERE NOT EXISTS (SELECT 1 FROM {P} p WHERE p.doc_id = v.doc_id AND p.start <= v.c AND v.c < p."end"))
SELECT g.doc_id, g.type, count(*) AS gold_items, count(*) - count(l.doc_id) AS hidden_items FROM g LEFT JOIN left_ l ON l.doc_id = g.doc_id AND l.type = g.type AND l.start = g.start AND l."end" = g."end" GROUP BY g.doc_id, g.type""".replace(
        chr(92) * 2, chr(92)
    )
)
def coverage_hidden(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _coverage(spark, sf_dir).where("gold_items > 0").select("doc_id", "type", "gold_items", "hidden_items")


DRAWS = 40
DRAWN = f"""n AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS n FROM (SELECT DISTINCT doc_id FROM documents)), size AS (SELECT count(*) AS size FROM n),
w AS (SELECT draw, CAST(('0x' || substr(md5('7/' || draw || '/' || place), 1, 8)) AS BIGINT) % size AS n, count(*) AS weight FROM (SELECT unnest(range(0, {DRAWS})) AS draw), (SELECT unnest(range(0, size)) AS place, size FROM size) GROUP BY ALL),
drawn AS (SELECT draw, doc_id, weight FROM w JOIN n USING (n))"""
F2 = "CASE WHEN g > 0 THEN coalesce(5.0 * (pm / nullif(p, 0)) * (gm / g) / nullif(4.0 * (pm / nullif(p, 0)) + gm / g, 0), 0.0) END"


def _drawn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.draws(table(spark, sf_dir, "documents"), DRAWS, 7)


@query(
    f"""WITH {MATCHED}, {DRAWN}, t AS (SELECT draw, mode, type, sum(weight * predicted) AS p, sum(weight * predicted_matched) AS pm, sum(weight * gold) AS g, sum(weight * gold_matched) AS gm FROM counts JOIN drawn USING (doc_id) GROUP BY ALL),
f AS (SELECT draw, mode, type, {F2} AS f2 FROM t)
SELECT mode, type, round(quantile_disc(f2, 0.025), 9) AS low, round(quantile_disc(f2, 0.975), 9) AS high FROM f WHERE mode = 'partial' AND f2 IS NOT NULL GROUP BY mode, type"""
)
def bootstrap_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    tallies = _counts(spark, sf_dir).where("mode = 'partial'")
    found = metrics.intervals(tallies, _drawn(spark, sf_dir), ["mode", "type"], metrics.COUNTS, {"f2": metrics.f_beta(2.0)})
    return found.select("mode", "type", F.round("low", 9).alias("low"), F.round("high", 9).alias("high"))


SUMS = "sum({w}predicted) AS p, sum({w}predicted_matched) AS pm, sum({w}gold) AS g, sum({w}gold_matched) AS gm"


@query(
    f"""WITH {sql_counts(P, '1')}, {sql_counts(sql_spans('other'), '2')}, {DRAWN},
d1 AS (SELECT draw, type, {F2} AS f FROM (SELECT draw, type, {SUMS.format(w='weight * ')} FROM counts1 JOIN drawn USING (doc_id) WHERE mode = 'partial' GROUP BY ALL)),
d2 AS (SELECT draw, type, {F2} AS f FROM (SELECT draw, type, {SUMS.format(w='weight * ')} FROM counts2 JOIN drawn USING (doc_id) WHERE mode = 'partial' GROUP BY ALL)),
w1 AS (SELECT type, {F2} AS f FROM (SELECT type, {SUMS.format(w='')} FROM counts1 WHERE mode = 'partial' GROUP BY ALL)), w2 AS (SELECT type, {F2} AS f FROM (SELECT type, {SUMS.format(w='')} FROM counts2 WHERE mode = 'partial' GROUP BY ALL)),
x AS (SELECT type, d2.f - d1.f AS d FROM d1 JOIN d2 USING (draw, type) WHERE d2.f - d1.f IS NOT NULL)
SELECT type, 'f2' AS metric, round(any_value(w2.f - w1.f), 9) AS delta, round(quantile_disc(d, 0.025), 9) AS low, round(quantile_disc(d, 0.975), 9) AS high,
  round(least(1.0, 2 * least(avg(CASE WHEN d <= 0 THEN 1.0 ELSE 0.0 END), avg(CASE WHEN d >= 0 THEN 1.0 ELSE 0.0 END))), 9) AS p_value
FROM x JOIN w1 USING (type) JOIN w2 USING (type) GROUP BY type"""
)
def paired_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = (_counts(spark, sf_dir, salt).where("mode = 'partial'").drop("mode") for salt in ("pred", "other"))
    return metrics.paired_differences(a, b, _drawn(spark, sf_dir), ["type"], metrics.COUNTS, {"f2": metrics.f_beta(2.0)}).select("type", "metric", *(F.round(c, 9).alias(c) for c in ("delta", "low", "high", "p_value")))


@query(f"WITH {DRAWN} SELECT draw, doc_id, weight FROM drawn")
def bootstrap_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _drawn(spark, sf_dir).select(F.col("draw").cast("long").alias("draw"), "doc_id", "weight")


@query(
    """SELECT l_returnflag AS system, count(x) AS n, round(avg(x), 6) AS mean, round(stddev_samp(x), 6) AS sd, min(x) AS lowest, max(x) AS highest
FROM (SELECT l_returnflag, l_linenumber, round(avg(l_quantity), 6) AS x FROM lineitem GROUP BY ALL) GROUP BY l_returnflag"""
)
def seed_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    seeds = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("system"), F.col("l_linenumber").alias("seed")).agg(F.round(F.avg("l_quantity"), 6).alias("value"))
    found = metrics.spread(seeds, ["system"])
    return found.select("system", "n", F.round("mean", 6).alias("mean"), F.round("sd", 6).alias("sd"), "lowest", "highest")


@query(
    """WITH x AS (SELECT l_returnflag AS f, l_linenumber AS seed, round(avg(l_quantity), 6) AS v FROM lineitem GROUP BY ALL)
SELECT a.seed, round(b.v - a.v, 6) AS value FROM x a JOIN x b ON a.seed = b.seed WHERE a.f = 'A' AND b.f = 'R'"""
)
def seed_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    seeds = table(spark, sf_dir, "lineitem").groupBy("l_returnflag", F.col("l_linenumber").alias("seed")).agg(F.round(F.avg("l_quantity"), 6).alias("value"), F.lit(1).alias("k"))
    found = metrics.seed_differences(seeds.where("l_returnflag = 'A'"), seeds.where("l_returnflag = 'R'"), ["k"])
    return found.select("seed", F.round("value", 6).alias("value"))


@query(
    f"""WITH {CHARS.replace(chr(92) * 2, chr(92))} SELECT doc_id, CAST(count(*) AS BIGINT) AS residual_characters FROM (SELECT DISTINCT doc_id, c FROM gv) g
WHERE NOT EXISTS (SELECT 1 FROM pv WHERE pv.doc_id = g.doc_id AND pv.c = g.c) GROUP BY doc_id ORDER BY residual_characters DESC, doc_id LIMIT 5"""
)
def topk_residual(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.largest_residuals(_coverage(spark, sf_dir).where("type = 'any'")).select("doc_id", "residual_characters")


_INTERVALS = [("a", 0.1, 0.2, -0.2, -0.1, "win"), ("b", -0.1, 0.2, -0.2, -0.1, "tie"), ("c", -0.3, -0.1, -0.2, 0.1, "loss"), ("d", 0.1, 0.2, 0.1, 0.2, "loss")]


@query(sql_rows([(row[0], row[-1]) for row in _INTERVALS], "corpus, outcome"))
def verdict_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fixture(spark, [row[:-1] for row in _INTERVALS], "corpus string, fl double, fh double, rl double, rh double")
    return rows.select("corpus", metrics.outcome(F.col("fl"), F.col("fh"), F.col("rl"), F.col("rh")).alias("outcome"))


@query(sql_rows([(1, 2, 1, "does not beat base; better on a, worse on c, d")], "wins, losses, ties, sentence"))
def verdict_sentence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.verdict_sentence(verdict_outcomes(spark, sf_dir), "base")


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    pick = lambda name, *values: F.element_at(F.array(*(F.lit(v) for v in values)), (1 + h(name, key) % len(values)).cast("int"))
    return table(spark, sf_dir, "customer").select(
        F.col("c_nationkey").alias("doc_id"), pick("type", "email", "phone", "person").alias("type"), pick("carrier", "page", "link", "metadata").alias("carrier"), F.col("c_mktsegment").alias("kind"),
        pick("outcome", "found", "partial", "missed").alias("outcome"), (h("readable", key) % 5 == 0).alias("readable"),
        F.when(h("fragments", key) % 4 == 0, F.array(F.lit("x"))).otherwise(F.array().cast("array<string>")).alias("fragments"), (h("left", key) % 3 == 0).alias("left"),
    )


def _sql_pick(name: str, *values: str) -> str:
    return f"list_extract([{', '.join(repr(v) for v in values)}], CAST(1 + {sql_h(repr(name), 'CAST(c_custkey AS VARCHAR)')} % {len(values)} AS INTEGER))"


_SQL_RESULTS = f"""r AS (SELECT c_nationkey AS doc_id, {_sql_pick('type', 'email', 'phone', 'person')} AS type, {_sql_pick('carrier', 'page', 'link', 'metadata')} AS carrier, c_mktsegment AS kind,
  {_sql_pick('outcome', 'found', 'partial', 'missed')} AS outcome, {sql_h("'readable'", 'CAST(c_custkey AS VARCHAR)')} % 5 = 0 AS readable, {sql_h("'fragments'", 'CAST(c_custkey AS VARCHAR)')} % 4 = 0 AS fragments, {sql_h("'left'", 'CAST(c_custkey AS VARCHAR)')} % 3 = 0 AS left_ FROM customer)"""
_SQL_COUNTS = "count(*) AS gold, count_if(outcome = 'found') AS found, count_if(outcome = 'partial') AS partial, count_if(outcome = 'missed') AS missed, count_if(readable) AS readable_after, count_if(fragments) AS with_fragments, count_if(left_) AS left_in_carrier"


@query(
    f"""WITH {_SQL_RESULTS} SELECT CASE grouping(type, carrier, kind) WHEN 7 THEN 'all' WHEN 3 THEN 'type' WHEN 5 THEN 'carrier' ELSE 'kind' END AS level, coalesce(type, carrier, kind) AS name,
{', '.join(f'CAST({x.split(" AS ")[0]} AS BIGINT) AS {x.split(" AS ")[1]}' for x in _SQL_COUNTS.split(', '))} FROM r GROUP BY GROUPING SETS ((), (type), (carrier), (kind))"""
)
def benchmark_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return benchmark.totals(_results(spark, sf_dir))


@query(f"WITH {_SQL_RESULTS} SELECT doc_id, NOT bool_or(readable OR fragments) AS safe FROM r GROUP BY doc_id")
def benchmark_safe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return benchmark.safe_documents(_results(spark, sf_dir))


_MAIL = r"(?:\S*[^A-Za-z0-9._%+\-\s])?[A-Za-z0-9._%+\-]+@[A-Za-z0-9\-]+(?:\.[A-Za-z0-9\-]+)*\.[A-Za-z]{2,}(?:[^A-Za-z0-9\-\s]\S*)?"


@query(
    rf"""WITH e AS (SELECT doc_id, text, regexp_extract(text, '{_MAIL}', 0) AS m FROM documents), r AS (SELECT doc_id, m, regexp_replace(text, '{_MAIL}', '[EMAIL]', 'g') AS after FROM e WHERE m <> '')
SELECT doc_id, m AS decoy FROM r WHERE NOT contains(regexp_replace(after, '\s', '', 'g'), m)"""
)
def decoys_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    # A decoy has an @, so a page without one has no row, and neither the search nor the redaction goes through it.
    pages = pages_of_documents(table(spark, sf_dir, "documents").where(F.contains("text", F.lit("@"))))
    after = redact_text(pages, detect(pages, only=[finders.find_emails]))
    decoys = pages.select("doc_id", F.regexp_extract("text", _MAIL, 0).alias("decoy")).where("decoy <> ''")
    return benchmark.decoys_removed(decoys, after)


@query()
def residue(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    pages = pages_of_documents(docs)
    found = detect(pages, only=[finders.find_emails])
    items = found.select("doc_id", F.col("start").alias("item"), "type", "text", F.lit("page").alias("carrier"))
    return benchmark.residue(items, benchmark.all_text(pages), redact_text(pages, found))


_PLANTED = [(1, 0, "Bartoš Roman", 0, 0, 12), (1, 1, "Roman", 0, 26, 31), (1, 2, "Nikdo", None, None, None)]


@query(sql_rows([(d, i, p, a, b) for d, i, _, p, a, b in _PLANTED if p is not None], '''doc_id, item, page_index, start, "end"'''))
def page_locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = fixture(spark, [(1, 0, "Bartoš Roman a pak i jiný Roman")], "doc_id int, page_index int, text string")
    items = fixture(spark, [(d, i, "person", t, "page") for d, i, t, *_ in _PLANTED], "doc_id int, item int, type string, text string, carrier string")
    return benchmark.page_locations(pages, items)


@query(
    r"""WITH d AS (SELECT doc_id, text, list_filter FROM (SELECT doc_id, text, [x FOR x IN regexp_split_to_array(text, '\s+') IF x <> ''] AS list_filter FROM documents)),
v AS (SELECT doc_id, array_to_string(list_filter[1:2], ' ') AS value, len(list_filter[1:2]) AS n FROM d WHERE len(list_filter) > 0)
SELECT doc_id, n >= 2 AND regexp_matches(value, '[-‐‑–''’ʼ]') OR regexp_matches(value, '[-‐‑–''’ʼ]') AS hyphen, regexp_matches(regexp_replace(value, '\P{L}', '', 'g'), '[^\x00-\x7f]') AS diacritics,
  length(regexp_replace(value, '\P{L}', '', 'g')) >= 2 AND NOT regexp_matches(regexp_replace(value, '\P{L}', '', 'g'), '\P{Lu}') AS all_caps, CAST(n AS INTEGER) AS n FROM v"""
)
def error_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    # A shape reads nothing behind its span, so the text goes up to the second word.
    head = F.regexp_extract("text", r"(?U)\A\s*+\S++(?:\s++\S++)?", 0)
    rows = table(spark, sf_dir, "documents").select("doc_id", head.alias("head")).where("head <> ''")
    lead = F.length(F.regexp_extract("head", r"(?U)\A\s*+", 0))
    several = F.col("head").rlike(r"(?U)\S\s")
    value = rows.select("doc_id", F.when(several, 2).otherwise(1).alias("n"), shape("head", lead, F.length("head")).alias("c"))
    has = lambda name: F.array_contains("c", name)
    return value.select("doc_id", has("hyphen_apostrophe").alias("hyphen"), has("diacritics").alias("diacritics"), has("all_caps").alias("all_caps"), "n")


_SHAPES = [
    (1, "pan Novak", 4, 9, "title,words=1"),
    (2, "Ing. J. Malá", 0, 12, "diacritics,initial,sentence_start,title,words=3+"),
    (3, "Jméno: ADAM", 7, 11, "after_label,all_caps,words=1"),
    (4, "Konec. Eva Malá-Nová", 7, 20, "diacritics,hyphen_apostrophe,sentence_start,words=2"),
]


@query(sql_rows([(k, c) for k, *_, c in _SHAPES], "case_id, categories"))
def error_shape_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fixture(spark, [row[:-1] for row in _SHAPES], "case_id int, text string, start int, end int")
    return rows.select("case_id", F.array_join(shape("text", F.col("start"), F.col("end")), ",").alias("categories"))


@query(
    f"""WITH a AS (SELECT type AS name, count(*) AS n FROM {P} GROUP BY type), b AS (SELECT type AS name, count(*) AS n FROM {G} WHERE type <> 'date' GROUP BY type)
SELECT coalesce(a.name, b.name) AS name, a.n AS n_before, b.n AS n_after FROM a FULL JOIN b ON a.name = b.name WHERE a.n IS DISTINCT FROM b.n"""
)
def compare_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = (made_spans(spark, sf_dir, salt).groupBy(F.col("type").alias("name")).agg(F.count("*").alias("n")) for salt in ("pred", "gold"))
    return benchmark.compare_runs(a, b.where("name <> 'date'"), ["n"])


@query()
def error_tallies(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veilspan.operators.errors import miss_tallies, misses

    pages = pages_of_documents(table(spark, sf_dir, "documents"))
    tallies = miss_tallies(misses(made_spans(spark, sf_dir, "pred"), made_spans(spark, sf_dir, "gold"), pages))
    return tallies.groupBy("type", "category").agg(*(F.sum(c).alias(c) for c in ("gold", "missed", "partly", "other_type")))


@query()
def error_alarms(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veilspan.operators.errors import alarm_tallies, alarms

    pages = pages_of_documents(table(spark, sf_dir, "documents"))
    return alarm_tallies(alarms(made_spans(spark, sf_dir, "pred"), made_spans(spark, sf_dir, "gold"), pages)).groupBy("type", "category").agg(F.sum("alarms").alias("alarms"))


_MET = 'a.doc_id = b.doc_id AND a.start < b."end" AND b.start < a."end"'


@query(
    f"""WITH p AS (SELECT DISTINCT doc_id, type, start, "end" FROM {P}), g AS (SELECT DISTINCT doc_id, type, start, "end" FROM {G}),
o AS (SELECT a.doc_id, a.type, a.start, a."end", count(b.type) AS n, coalesce(bool_or(b.type = a.type), FALSE) AS same FROM g a LEFT JOIN p b ON {_MET} GROUP BY ALL),
c AS (SELECT doc_id, type, start, "end", unnest(range(start, "end")) AS place FROM g),
v AS (SELECT c.*, EXISTS (SELECT 1 FROM p b WHERE b.doc_id = c.doc_id AND b.start <= c.place AND c.place < b."end") AS held FROM c JOIN documents USING (doc_id)
  WHERE NOT regexp_matches(substr(text, CAST(place + 1 AS INTEGER), 1), '[\\s\\x{{85}}\\p{{Z}}]')),
w AS (SELECT doc_id, type, start, "end", count(*) AS whole, count(*) FILTER (WHERE held) AS held FROM v GROUP BY ALL),
r AS (SELECT o.type, CASE WHEN n = 0 THEN 'missed' WHEN NOT same THEN 'other_type' WHEN coalesce(w.held, 0) < coalesce(w.whole, 0) THEN 'partly' ELSE 'found' END AS outcome
  FROM o LEFT JOIN w ON w.doc_id = o.doc_id AND w.type = o.type AND w.start = o.start AND w."end" = o."end")
SELECT type, outcome, count(*) AS n FROM r GROUP BY type, outcome"""
)
def error_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What became of every gold span, by type."""
    from veilspan.operators.errors import misses

    pages = pages_of_documents(table(spark, sf_dir, "documents"))
    told = misses(made_spans(spark, sf_dir, "pred"), made_spans(spark, sf_dir, "gold"), pages)
    return told.groupBy("type", "outcome").agg(F.count("*").alias("n"))


@query(
    f"""WITH p AS (SELECT DISTINCT doc_id, type, start, "end" FROM {P}), g AS (SELECT DISTINCT doc_id, type, start, "end" FROM {G})
SELECT type, count(*) AS alarms FROM p a WHERE NOT EXISTS (SELECT 1 FROM g b WHERE {_MET} AND a.type = b.type) GROUP BY type"""
)
def alarm_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veilspan.operators.errors import ALL, alarm_tallies, alarms

    pages = pages_of_documents(table(spark, sf_dir, "documents"))
    told = alarm_tallies(alarms(made_spans(spark, sf_dir, "pred"), made_spans(spark, sf_dir, "gold"), pages)).where(F.col("category") == ALL)
    return told.groupBy("type").agg(F.sum("alarms").alias("alarms"))


@query(
    rf"""WITH m AS (SELECT doc_id, text, regexp_extract_all(text, '{_MAIL}') AS found FROM documents), k AS (SELECT doc_id, len(found) AS items FROM m WHERE len(found) > 0)
SELECT doc_id, CAST(items AS BIGINT) AS items, CAST(0 AS BIGINT) AS readable FROM k"""
)
def residue_readable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items that are still readable after all of them were redacted, by document."""
    return residue(spark, sf_dir).groupBy("doc_id").agg(F.count("*").alias("items"), F.count_if("readable").alias("readable"))
