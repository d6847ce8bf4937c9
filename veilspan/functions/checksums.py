"""Checksums of identifiers, as expressions over strings. Nothing throws: what isn't well-formed isn't valid; a null is null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of public standards.
BASE_WEIGHTS = [6, 3, 7, 9, 10, 5, 8, 4, 2, 1]
PREFIX_WEIGHTS = [10, 5, 8, 4, 2, 1]
COMPANY_WEIGHTS = [8, 7, 6, 5, 4, 3, 2]
IBAN_LENGTHS = {"CZ": 24, "SK": 24, "AT": 20, "DE": 22, "PL": 28, "HU": 28}
#: Issuers of payment cards: prefixes and the lengths that go with them.
ISSUERS = [
    (r"4", [13, 16, 19]),
    (r"5[1-5]", [16]),
    (r"222[1-9]|22[3-9]\d|2[3-6]\d\d|27[01]\d|2720", [16]),
    (r"3[47]", [15]),
    (r"6011|65", [16, 19]),
    (r"64[4-9]", [16, 19]),
    (r"3[689]", [14, 16, 19]),
    (r"30[0-5]", [14, 16, 19]),
    (r"352[89]|35[3-8]\d", [16, 17, 18, 19]),
    (r"62", [16, 17, 18, 19]),
]


def digit(text: Column, place: int) -> Column:
    """The digit at a place, from 1."""
    return F.substring(text, place, 1).try_cast("int")


def weighted_sum(digits: Column, weights: list[int]) -> Column:
    """Sum of right-aligned digits by weight."""
    padded = F.lpad(digits, len(weights), "0")
    total = F.lit(0)
    for place, weight in enumerate(weights, 1):
        total = total + digit(padded, place) * weight
    return total


def valid_account_number(base: Column, prefix: Column | None = None) -> Column:
    """Both parts' weighted sums divide by 11; the base has 2 to 10 digits, not all zero. An empty or null prefix is none."""
    valid = base.rlike(r"^\d{2,10}\z") & ~base.rlike(r"^0+\z") & (weighted_sum(base, BASE_WEIGHTS) % 11 == 0)
    valid = F.coalesce(valid, F.lit(False))
    if prefix is not None:
        own = F.coalesce(prefix.rlike(r"^\d{1,6}\z") & (weighted_sum(prefix, PREFIX_WEIGHTS) % 11 == 0), F.lit(False))
        valid = valid & (prefix.isNull() | (prefix == "") | own)
    return valid


def valid_company_id(value: Column) -> Column:
    """Eight digits whose last one is 11 less the weighted sum's remainder (remainder 0: 1; 1: 0)."""
    digits = F.regexp_replace(value, r"\s", "")
    rest = weighted_sum(F.substring(digits, 1, 7), COMPANY_WEIGHTS) % 11
    expected = F.when(rest == 0, 1).when(rest == 1, 0).otherwise(11 - rest)
    return F.coalesce(digits.rlike(r"^\d{8}\z") & (digit(digits, 8) == expected), F.lit(False))


def mod97(text: Column) -> Column:
    """Remainder by 97 of a text of digits and capitals, letters counting from A = 10."""
    step = lambda rest, c: F.when(c.between("0", "9"), (rest * 10 + c.try_cast("int")) % 97).otherwise((rest * 100 + F.ascii(c) - 55) % 97)
    return F.aggregate(F.filter(F.split(text, ""), lambda c: c != ""), F.lit(0), lambda rest, c: step(rest, c).cast("int"))


def normal_iban(value: Column) -> Column:
    return F.upper(F.regexp_replace(value, r"(?U)\s", ""))


def valid_iban(value: Column) -> Column:
    """Shape, length (by country where known), mod 97, and for cs/sk the account number inside."""
    iban = normal_iban(value)
    country = F.substring(iban, 1, 2)
    lengths = F.create_map(*(F.lit(x) for pair in IBAN_LENGTHS.items() for x in pair))
    known = F.try_element_at(lengths, country)
    shape = iban.rlike(r"^[A-Z]{2}\d{2}[A-Z0-9]+\z") & F.length(iban).between(15, 34) & (known.isNull() | (F.length(iban) == known))
    rotated = F.concat(F.substring(iban, 5, 30), F.substring(iban, 1, 4))
    prefix, base = (F.regexp_replace(F.substring(iban, at, n), "^0+", "") for at, n in ((9, 6), (15, 34)))
    inner = ~country.isin("CZ", "SK") | valid_account_number(base, prefix)
    return F.coalesce(F.when(shape, (mod97(rotated) == 1) & inner), F.lit(False))


def matches_issuer(digits: Column) -> Column:
    found = F.lit(False)
    for prefixes, lengths in ISSUERS:
        found = found | (digits.rlike(f"^(?:{prefixes})") & F.length(digits).isin(lengths))
    return found


def valid_card(value: Column) -> Column:
    """An issuer's prefix and length, and Luhn."""
    digits = F.regexp_replace(value, "[ -]", "")
    return F.coalesce(F.when(digits.rlike(r"^\d+\z"), matches_issuer(digits) & F.call_function("luhn_check", digits)), F.lit(False))


def calendar_date(year: Column, month: Column, day: Column) -> Column:
    """The date of integer parts, or null if there is none."""
    return F.try_to_date(F.format_string("%04d-%02d-%02d", year.cast("int"), month.cast("int"), day.cast("int")), "yyyy-MM-dd")


def birth_number_date(digits: Column) -> Column:
    """The date in a birth number of 9 or 10 digits, or null: months may be raised by 50, 20 or 70, days by 40."""
    month, day, year = (F.substring(digits, at, 2).try_cast("int") for at in (3, 5, 1))
    month = F.when(month > 50, month - 50).otherwise(month)
    month = F.when(month > 20, month - 20).otherwise(month)
    day = F.when(day > 40, day - 40).otherwise(day)
    year = 1900 + year
    year = F.when((F.length(digits) == 10) & (year < 1954), year + 100).otherwise(year)
    return F.when(month.between(1, 12) & day.between(1, 31), calendar_date(year, month, day))


def valid_birth_number(value: Column) -> Column:
    """A real date, and for ten digits the check digit (remainder by 11, 10 counting as 0); nine digits were given before 1954."""
    digits = F.regexp_replace(value, r"[\s/-]", "")
    born = birth_number_date(digits)
    rest = F.substring(digits, 1, 9).try_cast("long") % 11
    checked = F.when(F.length(digits) == 9, F.year(born) < 1954).otherwise(F.when(rest == 10, 0).otherwise(rest) == digit(digits, 10))
    return F.coalesce(F.when(digits.rlike(r"^\d{9,10}\z") & born.isNotNull(), checked), F.lit(False))


def plausible_nanp(digits: Column) -> Column:
    """Area and exchange begin with 2 to 9, and the area isn't a service code."""
    return digits.rlike(r"^[2-9](?!11)\d\d[2-9]")


def iban_check_digits(country: Column, bban: Column) -> Column:
    """The two check digits of an account's number in a country."""
    return F.lpad((98 - mod97(F.concat(bban, country, F.lit("00")))).cast("string"), 2, "0")


def completed_account_part(digits: Column, weights: list[int]) -> Column:
    """Digits with a last one that makes the weighted sum divide by 11, or null if none does."""
    whole = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda d: F.concat(digits, d.cast("string")))
    return F.try_element_at(F.filter(whole, lambda x: weighted_sum(x, weights) % 11 == 0), F.lit(1))
