import hashlib

import numpy as np
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from tests.llm.test_near_copies import plain_kept
from veilspan.llm import bpe, cotrain, fertility, mixing
from veilspan.llm import queries as Q
from veilspan.llm.queries import tokenizer_file, tokenizer_pattern

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """What each stage got and gave, written and read again as the stages themselves are."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / "out")
        stage(spark, docs, SF).write.parquet(path)
        given, docs = docs, spark.read.parquet(path)
        out.append((name, given, docs))
    return out


def test_stages_against_plain_versions(spark, stages):
    columns = stages[0][1].columns
    assert [x[0] for x in stages] == [name for name, _ in corpus_pipeline.STAGES] and all(after.columns == columns for _, _, after in stages[:-1])
    (_, a, b), (_, _, c), (_, _, d), (_, _, e), (_, _, f) = stages
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    good = {r.doc_id for r in cotrain.classify(a, labels).where("kept").collect()}
    assert {r.doc_id for r in b.collect()} == good and {r.doc_id for r in labels.where("quality = 1").collect()} & {r.doc_id for r in a.collect()} <= good
    rules = {r.doc_id for r in fertility.apply_rules(b, tokenizer_file("byte_bpe_50k.json"), tokenizer_file("piece_bpe_32k.model")).where("kept").collect()}
    assert {r.doc_id for r in c.collect()} == rules
    assert sorted(r.doc_id for r in d.collect()) == plain_kept(sorted((r.doc_id, r.text) for r in c.collect()))
    rates = {r.source: r.rate for r in mixing.target_rates(d).collect()}
    from tests.llm.test_mixing import plain_count

    want = sorted(r.doc_id for r in d.collect() for _ in range(plain_count(r.doc_id, rates[r.source])))
    assert sorted(r.doc_id for r in e.collect()) == want
    codec = bpe.Codec(tokenizer_file("byte_bpe_50k.tiktoken"), tokenizer_pattern())
    texts = {r.doc_id: r.text for r in e.collect()}
    found = f.collect()
    assert sorted(r.doc_id for r in found) == want
    for r in found:
        ids = codec.encode([texts[r.doc_id]])[0]
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(texts[r.doc_id].encode()).hexdigest())


def test_run(spark, stages):
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).collect())) == sorted(map(tuple, stages[-1][2].collect()))


def test_awkward_rows_through_all_stages(spark, awkward, empty):
    for rows in (awkward, empty):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            found = stage(spark, rows, SF)
            assert found.columns == rows.columns
            kept = found.collect()
            assert not set(map(repr, kept)) - set(map(repr, rows.collect()))
        assert corpus_pipeline.STAGES[-1][1](spark, rows, SF).count() == rows.count()


def test_registered():
    names = set(entry.queries())
    assert {f"op{n}_" for n in range(1, 11)} <= {name.split("_")[0] + "_" for name in names} and "pipeline" in names
    assert set(Q.oracle_sql()) <= names


def test_queries_have_their_columns(spark):
    wanted = {
        "op1_html_extraction": {"page_id", "url", "text", "n_chars"},
        "op3_byte_bpe": {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"},
        "op5_bloom_lm": {"doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"},
        "op6_fertility_rules": {"doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"},
        "op7_simhash": {"doc_id", "fingerprint", "component_id"},
        "op8_toxicity": {"doc_id", "held_out", "score", "predicted"},
        "op9_token_store": {"doc_id", "start", "n_tokens", "ids_crc32"},
    }
    for name, columns in wanted.items():
        found = Q.queries()[name](spark, SF)
        assert columns <= set(found.columns), name
        assert found.count() == spark.read.parquet(f"{SF}/{'pages' if name.startswith('op1_') else 'documents'}.parquet").count()


def test_scores_are_numbers(spark):
    rows = Q.queries()["op2_quality_classifier"](spark, SF).collect()
    assert all(0 <= r.quality_score <= 1 for r in rows) and np.mean([r.kept for r in rows]) > 0.5
