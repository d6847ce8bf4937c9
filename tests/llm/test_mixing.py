import hashlib
import math

import duckdb
import pytest

from pyspark.sql import functions as F

from veilspan.llm import mixing as M
from veilspan.llm.queries import SQL


def plain_count(doc_id, rate):
    u = int(hashlib.md5(f"{M.SEED}|{'' if doc_id is None else doc_id}".encode()).hexdigest()[: M.DIGITS], 16) / 16**M.DIGITS
    k, p, total = 0, math.exp(-rate), math.exp(-rate)
    while u >= total:
        k += 1
        p *= rate / k
        total += p
    return k


def test_counts_by_hand(spark):
    rows = spark.createDataFrame([(i, "x" * (i % 7), f"s{i % 3}") for i in range(600)], "doc_id long, text string, source string")
    weights = {"s0": 1.0, "s1": 3.0}
    rates = {r.source: r.rate for r in M.target_rates(rows, weights).collect()}
    sizes = {s: sum(i % 7 for i in range(600) if i % 3 == int(s[1])) for s in rates}
    assert rates["s2"] == 0.0 and rates["s1"] * sizes["s1"] == pytest.approx(3 * rates["s0"] * sizes["s0"])
    found = M.mix(rows, weights).collect()
    copies = {}
    for r in found:
        copies.setdefault(r.doc_id, []).append(r["copy"])
    for i in range(600):
        assert sorted(copies.get(i, [])) == list(range(plain_count(i, rates[f"s{i % 3}"])))
    keys = [r.mix_key for r in found]
    assert keys == sorted(keys) and len(set(keys)) == len(keys)


def test_many_sources_take_the_join(spark, monkeypatch):
    rows = spark.createDataFrame([(i, "abc", f"s{i % 40}" if i % 7 else None) for i in range(300)], "doc_id long, text string, source string")
    wanted = sorted((r.doc_id, r["copy"]) for r in M.mix(rows).collect())
    monkeypatch.setattr(M, "_small", lambda rates: False)
    assert sorted((r.doc_id, r["copy"]) for r in M.mix(rows).collect()) == wanted


def test_awkward_rows(awkward, extra, empty):
    found = M.mix(awkward)
    assert found.columns == [*awkward.columns, "copy", "mix_key"]
    found.collect()
    assert M.mix(extra).columns == [*(c for c in extra.columns if c != "copy"), "copy", "mix_key"]
    assert M.mix(empty).collect() == []
    with pytest.raises(ValueError):
        M.mix(awkward, epochs=1e7)


def test_against_sql(spark, tmp_path):
    rows = spark.createDataFrame([(i, "word " * (1 + i % 50), "en", f"s{i * i % 5}", 5) for i in range(400)], "doc_id long, text string, lang string, source string, n_chars long")
    rows.write.parquet(str(tmp_path / "documents"))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents/*.parquet'")
    want = sorted((r[0], r[5], r[6]) for r in con.execute(SQL["op10_mixing"]).fetchall())
    assert sorted((r.doc_id, r["copy"], r.mix_key) for r in M.mix(rows).collect()) == want


def test_clashing_names_and_many_sources(spark, awkward, monkeypatch):
    clashing = awkward.withColumns({c: F.lit("more") for c in ("_source", "_rate", "rate", "key", "salt", "copies", "sources")})
    clashing = clashing.toDF(*clashing.columns[:-2], "COPY", "SOURCE")
    want = sorted((repr(r.doc_id), repr(r.text)) for r in M.mix(awkward).collect())
    for most in (M.MOST_BROADCAST, 0):
        monkeypatch.setattr(M, "_small", lambda rates, most=most: rates.count() <= most)
        for added in (True, False):
            found = M.mix(clashing, added=added)
            assert found.columns == ([c for c in clashing.columns if c != "COPY"] + ["copy", "mix_key"] if added else clashing.columns)
            assert sorted((repr(r[0]), repr(r[1])) for r in found.collect()) == want
