"""Queries over finders and checksums."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspan.functions import checksums as C
from veilspan.operators import finders
from veilspan.operators.detect import SMALL_WORDS, detect, pages_of_documents, recognised_language
from veilspan.plans.base import SQL, h, query, sql_h, table

# RE2 has no look-around: guards are consumed, and every white-space character is doubled so that neighbours don't share one.
SPACED = r"regexp_replace(text, '(\s)', '\1\1', 'g')"


def _listed(array, key: str = "doc_id"):
    return [key, F.size(array).cast("long").alias("n"), F.array_join(F.transform(array, lambda s: s["text"]), "|").alias("found")]


SQL_EMAILS = r"regexp_extract_all(" + SPACED + r", '(?:^|[^A-Za-z0-9._%+\-])([A-Za-z0-9._%+\-]+@[A-Za-z0-9\-]+(?:\.[A-Za-z0-9\-]+)*\.[A-Za-z]{2,})(?:[^A-Za-z0-9\-]|$)', 1)"


@query(f"SELECT doc_id, CAST(len(m) AS BIGINT) AS n, array_to_string(m, '|') AS found FROM (SELECT doc_id, {SQL_EMAILS} AS m FROM documents) WHERE len(m) > 0")
def finder_email(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").withColumn("m", finders.find_emails("text")).where(F.size("m") > 0)
    return rows.select(*_listed(F.col("m")))


SQL_LUHN = (
    "(list_sum([CASE WHEN (length(d) - k) % 2 = 1 THEN (CASE WHEN 2 * CAST(d[k] AS INTEGER) > 9 THEN 2 * CAST(d[k] AS INTEGER) - 9 ELSE 2 * CAST(d[k] AS INTEGER) END) "
    "ELSE CAST(d[k] AS INTEGER) END FOR k IN range(1, length(d) + 1)]) % 10 = 0)"
)
SQL_ISSUER = "(" + " OR ".join(f"(regexp_matches(d, '^(?:{p})') AND length(d) IN ({', '.join(map(str, n))}))" for p, n in C.ISSUERS) + ")"


@query(
    f"""WITH found AS (SELECT doc_id, unnest(regexp_extract_all({SPACED}, '(?:^|[^0-9-])([0-9](?:[ -]?[0-9]){{12,18}})(?:[^0-9-]|$)', 1)) AS m FROM documents),
digits AS (SELECT doc_id, m, regexp_replace(m, '[ -]', '', 'g') AS d FROM found)
SELECT doc_id, m AS card FROM digits WHERE {SQL_ISSUER} AND {SQL_LUHN}"""
)
def finder_card_luhn(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", F.explode(finders.find_card_numbers("text")).alias("s"))
    return rows.select("doc_id", F.col("s.text").alias("card"))


@query(
    rf"""WITH found AS (SELECT doc_id, unnest(regexp_extract_all(regexp_replace(text, '([^0-9+])', '\1\1', 'g'),
  '(?:^|[^0-9+])((?:\+?1(?:  |\.\.|--)?)?(?:\(\([0-9]{{3}}\)\)|[0-9]{{3}})(?:  |\.\.|--)?[0-9]{{3}}(?:  |\.\.|--)?[0-9]{{4}})(?:[^0-9]|$)', 1)) AS raw FROM documents),
phones AS (SELECT doc_id, regexp_replace(raw, '([^0-9+])[^0-9+]', '\1', 'g') AS m FROM found),
digits AS (SELECT doc_id, m, CASE WHEN length(d) = 11 AND d LIKE '1%' THEN substr(d, 2) ELSE d END AS d FROM (SELECT doc_id, m, regexp_replace(m, '[^0-9]', '', 'g') AS d FROM phones))
SELECT doc_id, m AS phone FROM digits WHERE length(d) = 10 AND (regexp_matches(m, '[ .()-]') OR (regexp_matches(d, '^[2-9][0-9][0-9][2-9]') AND substr(d, 2, 2) <> '11'))"""
)
def finder_phone_nanp(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", F.explode(finders.find_nanp_phone_numbers("text")).alias("s"))
    return rows.select("doc_id", F.col("s.text").alias("phone"))


@query("SELECT page_id, CAST(5 AS INTEGER) AS start, url AS found FROM pages WHERE url IS NOT NULL")
def finder_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").where("url IS NOT NULL")
    rows = pages.select("page_id", F.explode(finders.find_urls(F.concat(F.lit("See ("), F.col("url"), F.lit("), please.")))).alias("s"))
    return rows.select("page_id", F.col("s.start").alias("start"), F.col("s.text").alias("found"))


_BORN = {"d": "o_orderkey % 33", "m": "o_custkey % 14", "y": "1880 + o_orderkey % 250"}


@query(
    f"""WITH parts AS (SELECT o_orderkey, {_BORN['d']} AS d, {_BORN['m']} AS m, {_BORN['y']} AS y FROM orders)
SELECT o_orderkey, CAST(15 AS INTEGER) AS start, d || '/' || m || '/' || y AS born FROM parts
WHERE y BETWEEN 1900 AND 2099 AND m BETWEEN 1 AND 12 AND d >= 1 AND try_strptime(d || '/' || m || '/' || y, '%d/%m/%Y') IS NOT NULL"""
)
def finder_birth_date_en(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.concat_ws("/", F.expr(_BORN["d"]), F.expr(_BORN["m"]), F.expr(_BORN["y"]))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.explode(finders.find_english_birth_dates(F.concat(F.lit("Date of birth: "), day, F.lit(", city Rye")))).alias("s"))
    return rows.select("o_orderkey", F.col("s.start").alias("start"), F.col("s.text").alias("born"))


_STATES = ["IL", "XX", "TX", "ZZ", "NY"]


@query(
    f"""WITH parts AS (SELECT c_custkey, list_extract({_STATES}, CAST(1 + c_custkey % 5 AS INTEGER)) AS state, lpad(CAST(c_custkey % 100000 AS VARCHAR), 5, '0') AS zip FROM customer)
SELECT c_custkey, (1 + c_custkey % 900) || ' Oak Street, Salem, ' || state || ' ' || zip AS address FROM parts WHERE state IN ('IL', 'TX', 'NY')"""
)
def finder_us_address(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = F.element_at(F.array(*(F.lit(x) for x in _STATES)), (1 + F.col("c_custkey") % 5).cast("int"))
    text = F.concat(F.lit("ship to "), (1 + F.col("c_custkey") % 900).cast("string"), F.lit(" Oak Street, Salem, "), state, F.lit(" "), F.lpad((F.col("c_custkey") % 100000).cast("string"), 5, "0"), F.lit("; thanks"))
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.explode(finders.find_us_addresses(text)).alias("s"))
    return rows.select("c_custkey", F.col("s.text").alias("address"))


_TOWNS = ["Brno", "brno", "Nové Město nad Metují", "Praha 1", "Ústí"]


@query(
    f"""WITH parts AS (SELECT c_custkey, list_extract({_TOWNS}, CAST(1 + c_custkey % 5 AS INTEGER)) AS town, lpad(CAST(c_custkey % 100000 AS VARCHAR), 5, '0') AS zip FROM customer)
SELECT c_custkey, 'tř. Lipová ' || (1 + c_custkey % 900) || ', ' || substr(zip, 1, 3) || ' ' || substr(zip, 4) || ' ' || town AS address FROM parts WHERE town <> 'brno'"""
)
def finder_cs_address(spark: SparkSession, sf_dir: str) -> DataFrame:
    town, code = F.element_at(F.array(*(F.lit(x) for x in _TOWNS)), (1 + F.col("c_custkey") % 5).cast("int")), F.lpad((F.col("c_custkey") % 100000).cast("string"), 5, "0")
    text = F.concat(F.lit("bytem tř. Lipová "), (1 + F.col("c_custkey") % 900).cast("string"), F.lit(", "), F.substring(code, 1, 3), F.lit(" "), F.substring(code, 4, 2), F.lit(" "), town, F.lit(", dále"))
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.explode(finders.find_czech_slovak_addresses(text)).alias("s"))
    return rows.select("c_custkey", F.col("s.text").alias("address"))


@query()
def finder_all_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = detect(pages_of_documents(table(spark, sf_dir, "documents")), F.col("lang"), keep=["lang"])
    return found.groupBy("lang", "type").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("documents"))


@query(
    f"""WITH emails AS (SELECT doc_id, unnest({SQL_EMAILS}) AS m FROM documents), cards AS ({SQL['finder_card_luhn']}), phones AS ({SQL['finder_phone_nanp']}),
f AS (SELECT doc_id, 'email' AS type FROM emails UNION ALL SELECT doc_id, 'credit_card' FROM cards UNION ALL SELECT doc_id, 'phone' FROM phones)
SELECT lang, type, count(*) AS n, count(DISTINCT doc_id) AS documents FROM f JOIN documents USING (doc_id) GROUP BY lang, type"""
)
def pii_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = pages_of_documents(table(spark, sf_dir, "documents"))
    found = detect(pages, F.col("lang"), only=[finders.find_emails, finders.find_card_numbers, finders.find_nanp_phone_numbers], keep=["lang"])
    return found.groupBy("lang", "type").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("documents"))


@query(
    f"""WITH c AS (SELECT o_orderkey, '4' || lpad(CAST(o_orderkey AS VARCHAR), 15, '0') AS d FROM orders) SELECT o_orderkey, {SQL_LUHN} AS luhn, ({SQL_ISSUER} AND {SQL_LUHN}) AS card FROM c"""
)
def check_luhn_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    digits = F.concat(F.lit("4"), F.lpad(F.col("o_orderkey").cast("string"), 15, "0"))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.call_function("luhn_check", digits).alias("luhn"), C.valid_card(digits).alias("card"))


def _sql_weighted(text: str, weights: list[int]) -> str:
    return "(" + " + ".join(f"{w} * CAST(substr(lpad({text}, {len(weights)}, '0'), {i}, 1) AS INTEGER)" for i, w in enumerate(weights, 1)) + ")"


@query(
    f"""WITH c AS (SELECT c_custkey, lpad(CAST(c_custkey * 7919 % 100000000 AS VARCHAR), 8, '0') AS d FROM customer),
r AS (SELECT c_custkey, d, {_sql_weighted('substr(d, 1, 7)', C.COMPANY_WEIGHTS)} % 11 AS r FROM c)
SELECT c_custkey, d AS company_id FROM r WHERE CAST(substr(d, 8, 1) AS INTEGER) = CASE r WHEN 0 THEN 1 WHEN 1 THEN 0 ELSE 11 - r END"""
)
def check_company_id_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    digits = F.lpad((F.col("c_custkey") * 7919 % 100000000).cast("string"), 8, "0")
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.explode(finders.find_company_ids(F.concat(F.lit("Firma, IČO: "), digits, F.lit(", Brno")))).alias("s"))
    return rows.select("c_custkey", F.col("s.text").alias("company_id"))


@query(
    f"""SELECT o_orderkey, (length(CAST(o_orderkey AS VARCHAR)) >= 2 AND {_sql_weighted('CAST(o_orderkey AS VARCHAR)', C.BASE_WEIGHTS)} % 11 = 0) AS valid,
  (length(CAST(o_orderkey AS VARCHAR)) >= 2 AND {_sql_weighted('CAST(o_orderkey AS VARCHAR)', C.BASE_WEIGHTS)} % 11 = 0 AND {_sql_weighted('CAST(o_custkey AS VARCHAR)', C.PREFIX_WEIGHTS)} % 11 = 0) AS with_prefix FROM orders"""
)
def check_account_mod11(spark: SparkSession, sf_dir: str) -> DataFrame:
    base, prefix = F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string")
    return table(spark, sf_dir, "orders").select("o_orderkey", C.valid_account_number(base).alias("valid"), C.valid_account_number(base, prefix).alias("with_prefix"))


@query(
    """WITH b AS (SELECT o_orderkey, lpad(CAST(o_orderkey AS VARCHAR), 18, '0') AS bban FROM orders),
k AS (SELECT o_orderkey, bban, lpad(CAST(98 - CAST(bban || '131400' AS HUGEINT) % 97 AS VARCHAR), 2, '0') AS c, lpad(CAST(o_orderkey % 97 AS VARCHAR), 2, '0') AS other FROM b)
SELECT o_orderkey, 'DE' || c || bban AS iban, TRUE AS valid, CAST(bban || '1314' || other AS HUGEINT) % 97 = 1 AS other_valid FROM k"""
)
def check_iban_mod97(spark: SparkSession, sf_dir: str) -> DataFrame:
    bban = F.lpad(F.col("o_orderkey").cast("string"), 18, "0")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("DE"), C.iban_check_digits(F.lit("DE"), bban), bban).alias("iban"), F.concat(F.lit("DE"), F.lpad((F.col("o_orderkey") % 97).cast("string"), 2, "0"), bban).alias("_other"))
    return rows.select("o_orderkey", "iban", C.valid_iban(F.col("iban")).alias("valid"), C.valid_iban(F.col("_other")).alias("other_valid"))


@query(
    f"""WITH d AS (SELECT o_orderkey, lpad(CAST({sql_h("'born'", 'CAST(o_orderkey AS VARCHAR)')} % 100 AS VARCHAR), 2, '0') AS yy,
    {sql_h("'month'", 'CAST(o_orderkey AS VARCHAR)')} % 90 AS mm, {sql_h("'day'", 'CAST(o_orderkey AS VARCHAR)')} % 75 AS dd, lpad(CAST(o_custkey % 10000 AS VARCHAR), 4, '0') AS tail FROM orders),
p AS (SELECT *, yy || lpad(CAST(mm AS VARCHAR), 2, '0') || lpad(CAST(dd AS VARCHAR), 2, '0') || tail AS digits, CASE WHEN mm > 50 THEN mm - 50 ELSE mm END AS m1, CASE WHEN dd > 40 THEN dd - 40 ELSE dd END AS day FROM d),
q AS (SELECT *, CASE WHEN m1 > 20 THEN m1 - 20 ELSE m1 END AS month, CASE WHEN 1900 + CAST(yy AS INTEGER) < 1954 THEN 2000 + CAST(yy AS INTEGER) ELSE 1900 + CAST(yy AS INTEGER) END AS year FROM p)
SELECT o_orderkey, digits, (month BETWEEN 1 AND 12 AND day BETWEEN 1 AND 31 AND try_strptime(year || '-' || month || '-' || day, '%Y-%m-%d') IS NOT NULL
  AND CASE WHEN CAST(substr(digits, 1, 9) AS BIGINT) % 11 = 10 THEN 0 ELSE CAST(substr(digits, 1, 9) AS BIGINT) % 11 END = CAST(substr(digits, 10, 1) AS INTEGER)) AS valid FROM q"""
)
def check_birth_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    key = F.col("o_orderkey")
    digits = F.concat(two(h("born", key) % 100), two(h("month", key) % 90), two(h("day", key) % 75), F.lpad((F.col("o_custkey") % 10000).cast("string"), 4, "0"))
    return table(spark, sf_dir, "orders").select("o_orderkey", digits.alias("digits")).withColumn("valid", C.valid_birth_number(F.col("digits")))


@query(
    f"""WITH c AS ({SQL['check_birth_number']}), l AS (SELECT *, substr(digits, 1, 6) || '/' || substr(digits, 7, 4) AS written FROM c),
d AS (SELECT *, CAST(substr(digits, 3, 2) AS INTEGER) AS mm, CAST(substr(digits, 5, 2) AS INTEGER) AS dd, CAST(substr(digits, 1, 2) AS INTEGER) AS yy FROM l),
q AS (SELECT *, CASE WHEN mm > 50 THEN mm - 50 ELSE mm END AS m1, CASE WHEN dd > 40 THEN dd - 40 ELSE dd END AS day, CASE WHEN yy < 54 THEN 2000 ELSE 1900 END + yy AS year FROM d),
r AS (SELECT *, CASE WHEN m1 > 20 THEN m1 - 20 ELSE m1 END AS month FROM q)
SELECT o_orderkey, written AS found, valid FROM r WHERE valid OR (o_orderkey % 2 = 0 AND month BETWEEN 1 AND 12 AND day BETWEEN 1 AND 31 AND try_strptime(year || '-' || month || '-' || day, '%Y-%m-%d') IS NOT NULL)"""
)
def finder_birth_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Valid numbers, and behind a label also those whose check digit alone is wrong."""
    rows = check_birth_number(spark, sf_dir)
    label = F.when(F.col("o_orderkey") % 2 == 0, F.lit("Rodné číslo: ")).otherwise(F.lit("spis "))
    text = F.concat(F.lit("Osoba; "), label, F.substring("digits", 1, 6), F.lit("/"), F.substring("digits", 7, 4), F.lit(", Brno"))
    return rows.select("o_orderkey", "valid", F.explode(finders.find_birth_numbers(text)).alias("s")).select("o_orderkey", F.col("s.text").alias("found"), "valid")


@query(
    """WITH b AS (SELECT o_orderkey, lpad(CAST(o_orderkey AS VARCHAR), 18, '0') AS bban FROM orders),
k AS (SELECT o_orderkey, bban, CASE WHEN o_orderkey % 2 = 0 THEN lpad(CAST(98 - CAST(bban || '131400' AS HUGEINT) % 97 AS VARCHAR), 2, '0') ELSE lpad(CAST(o_orderkey % 97 AS VARCHAR), 2, '0') END AS c FROM b)
SELECT o_orderkey, 'DE' || c || ' ' || substr(bban, 1, 4) || ' ' || substr(bban, 5, 4) || ' ' || substr(bban, 9, 4) || ' ' || substr(bban, 13, 4) || ' ' || substr(bban, 17, 2) AS found
FROM k WHERE CAST(bban || '1314' || c AS HUGEINT) % 97 = 1"""
)
def finder_iban(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grouped numbers, half of them with the right check digits, run on into the next word."""
    bban = F.lpad(F.col("o_orderkey").cast("string"), 18, "0")
    check = F.when(F.col("o_orderkey") % 2 == 0, C.iban_check_digits(F.lit("DE"), bban)).otherwise(F.lpad((F.col("o_orderkey") % 97).cast("string"), 2, "0"))
    groups = [F.substring(bban, i, 4) for i in (1, 5, 9, 13, 17)]
    text = F.concat_ws(" ", F.lit("pay to"), F.concat(F.lit("DE"), check), *groups, F.lit("now, please"))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.explode(finders.find_ibans(text)).alias("s")).select("o_orderkey", F.col("s.text").alias("found"))


@query(f"""WITH c AS ({SQL['check_account_mod11']}) SELECT o_orderkey, o_custkey || ' - ' || o_orderkey || '/0800' AS found FROM c JOIN orders USING (o_orderkey) WHERE with_prefix""")
def finder_account(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("účet: "), F.col("o_custkey").cast("string"), F.lit(" - "), F.col("o_orderkey").cast("string"), F.lit("/0800, Brno"))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.explode(finders.find_account_numbers(text)).alias("s")).select("o_orderkey", F.col("s.text").alias("found"))


_PREFIXES = ["", "+420", "00421 ", "0", "9"]


@query(
    f"""WITH n AS (SELECT c_custkey, CAST(1 + c_custkey % 5 AS INTEGER) AS k, lpad(CAST(100000000 + c_custkey * 7919 % 800000000 AS VARCHAR), 9, '0') AS d FROM customer)
SELECT c_custkey, list_extract({_PREFIXES}, k) || CASE WHEN k = 5 THEN d ELSE substr(d, 1, 3) || ' ' || substr(d, 4, 3) || ' ' || substr(d, 7) END AS phone FROM n WHERE k <> 5"""
)
def finder_phone_cs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers with and without a country, and ten digits in a row, which are none."""
    k, digits = (1 + F.col("c_custkey") % 5).cast("int"), F.lpad((100000000 + F.col("c_custkey") * 7919 % 800000000).cast("string"), 9, "0")
    number = F.when(k == 5, digits).otherwise(F.concat_ws(" ", F.substring(digits, 1, 3), F.substring(digits, 4, 3), F.substring(digits, 7, 3)))
    text = F.concat(F.lit("tel.: "), F.element_at(F.array(*(F.lit(x) for x in _PREFIXES)), k), number, F.lit(", Brno"))
    return table(spark, sf_dir, "customer").select("c_custkey", F.explode(finders.find_czech_phone_numbers(text)).alias("s")).select("c_custkey", F.col("s.text").alias("phone"))


@query(
    f"""WITH parts AS (SELECT o_orderkey, {_BORN['d']} AS d, {_BORN['m']} AS m, {_BORN['y']} AS y FROM orders)
SELECT o_orderkey, CAST(12 AS INTEGER) AS start, d || '. ' || m || '. ' || y AS born FROM parts
WHERE y BETWEEN 1900 AND 2099 AND m BETWEEN 1 AND 12 AND d >= 1 AND try_strptime(d || '/' || m || '/' || y, '%d/%m/%Y') IS NOT NULL"""
)
def finder_birth_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.concat_ws(". ", F.expr(_BORN["d"]), F.expr(_BORN["m"]), F.expr(_BORN["y"]))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.explode(finders.find_czech_slovak_birth_dates(F.concat(F.lit("narozena dne "), day, F.lit(" v Brně")))).alias("s"))
    return rows.select("o_orderkey", (F.col("s.start") - 1).alias("start"), F.col("s.text").alias("born"))


@query(
    """SELECT c_custkey, 'email' AS type, 'c' || c_custkey || '. x@example. com' AS found FROM customer
UNION ALL SELECT c_custkey, 'url', 'www. example. com/' || c_custkey FROM customer"""
)
def finder_ocr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses with a space after their periods, as readers of scans write them; a capital letter after one begins a sentence."""
    number = F.col("c_custkey").cast("string")
    text = F.concat(F.lit("mail c"), number, F.lit(". x@example. com end. See www. example. com/"), number, F.lit(". Next"))
    both = F.concat(finders.find_ocr_emails(text), finders.find_ocr_urls(text))
    return table(spark, sf_dir, "customer").select("c_custkey", F.explode(both).alias("s")).select("c_custkey", F.col("s.type").alias("type"), F.col("s.text").alias("found"))


def _sql_among(tag: str) -> str:
    return f"len([x FOR x IN w IF x IN ({', '.join(repr(x) for x in SMALL_WORDS[tag])})])"


@query(
    r"""WITH t AS (SELECT lang, length(regexp_replace(substr(text, 1, 20000), '\P{L}', '', 'g')) AS letters, regexp_split_to_array(lower(substr(text, 1, 20000)), '[^\p{L}]+') AS w FROM documents),
"""
    + f"c AS (SELECT lang, letters, {', '.join(f'{_sql_among(tag)} AS {tag}_' for tag in SMALL_WORDS)} FROM t), s AS (SELECT *, {' + '.join(f'{tag}_' for tag in SMALL_WORDS)} AS total FROM c)"
    + """
SELECT lang, CASE WHEN letters >= 100 AND total > 0 THEN CASE WHEN cs_ >= 0.9 * total THEN 'cs' WHEN sk_ >= 0.9 * total THEN 'sk' WHEN en_ >= 0.9 * total THEN 'en' END END AS found, count(*) AS n FROM s GROUP BY ALL"""
)
def language_recognised(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("lang", recognised_language(F.col("text")).alias("found")).groupBy("lang", "found").agg(F.count("*").alias("n"))
