"""Nulls, empty and very long texts, ties, repeated rows, clashing columns and empty tables, for every operator."""

import hashlib

import pytest
from pyspark.sql import functions as F

from hourcast.llm import bpe, exact_dedup, language, lm, mixing, near_dedup, quality, rules, secrets, sharding, simhash

OPERATORS = {
    "op1": secrets.op1_secret_scan,
    "op2": language.op2_byte_cnn,
    "op3": bpe.op3_trie_bpe,
    "op4": near_dedup.op4_bottom_k,
    "op6": lm.op6_kneser_ney,
    "op7": exact_dedup.op7_exact_dedup,
    "op8": simhash.op8_simhash,
    "op9": mixing.op9_entropy_mix,
    "op10": sharding.op10_bounded_ring,
}
EMPTY = hashlib.sha256(b"").hexdigest()


def of(rows, doc_id):
    return [r for r in rows if r["doc_id"] == doc_id]


@pytest.fixture(scope="module")
def results(spark, odd):
    return {k: f(spark, odd).collect() for k, f in OPERATORS.items()}


@pytest.mark.parametrize("name", OPERATORS)
def test_a_row_for_each_row(results, odd, name):
    count = lambda rows: sorted(str(r["doc_id"]) for r in rows)
    assert count(results[name]) == count(odd.collect())


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, none, name):
    assert OPERATORS[name](spark, none).collect() == []


def test_classifier(spark, odd, none, labels):
    rows = quality.op5_random_indexing(spark, odd, labels).collect()
    assert len(rows) == 16 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in rows)
    assert quality.op5_random_indexing(spark, none, labels).collect() == []
    unlabelled = quality.op5_random_indexing(spark, odd, labels.limit(0)).collect()
    assert {r["score"] for r in unlabelled} == {0.5}
    one = quality.op5_random_indexing(spark, odd, labels.where("quality = 1")).collect()
    assert {r["score"] > 0.5 for r in one} == {True}


def test_rules(spark, odd, none, labels):
    rows = rules.op11_monotone_trees(spark, odd, labels).collect()
    assert len(rows) == 16 and rules.op11_monotone_trees(spark, none, labels).collect() == []
    assert {r["base_failed"] for r in rows if r["doc_id"] != 8} == {True} and {r["n_words"] for r in rows if r["doc_id"] in (4, 5, 6)} == {0}
    plain = rules.op11_monotone_trees(spark, odd, labels.where("quality = 1")).collect()
    assert all(r["score"] is None and r["kept"] == (not r["base_failed"]) for r in plain)
    assert [r["kept"] for r in plain if r["doc_id"] == 8] == [of(plain, 8)[0]["n_repeat_words"] * 100 <= 30 * 180_000]


def test_texts_without_content(results):
    for i in (4, 5):
        assert of(results["op1"], i)[0]["base_sha256"] == EMPTY and of(results["op1"], i)[0]["spans"] == ""
        assert of(results["op3"], i)[0]["n_tokens"] == 0 and of(results["op3"], i)[0]["ids_sha256"] == EMPTY
        assert of(results["op4"], i)[0]["n_shingles"] == 0 and of(results["op4"], i)[0]["kept"]
        assert of(results["op6"], i)[0]["n_tokens"] == 1
        assert of(results["op8"], i)[0]["fingerprint"] == "0" * 16
        assert of(results["op9"], i)[0]["size"] == of(results["op9"], i)[0]["taken"] == 0
        assert of(results["op10"], i)[0]["size"] == 1 and of(results["op10"], i)[0]["text_crc32"] == 0
        assert of(results["op7"], i)[0]["text_sha256"] == EMPTY
    assert {of(results["op2"], i)[0]["lang_pred"] for i in (4, 5, 6, 11)} == {"und"}


def test_white_space_texts_are_equal(results):
    # 4, 5, 6 and the null id: the longest original stays
    rows = [r for r in results["op7"] if r["text_sha256"] == EMPTY]
    assert len(rows) == 4 and {r["keep_id"] for r in rows} == {6} and [r["doc_id"] for r in rows if r["kept"]] == [6]
    assert of(results["op7"], 1)[0]["keep_id"] == 2 and of(results["op7"], 3)[0]["keep_id"] == 3


def test_one_of_repeated_rows_stays(results):
    rows = [r for r in results["op7"] if r["doc_id"] in (7, 10, -13)]
    assert {r["group_size"] for r in rows} == {4} and [r["doc_id"] for r in rows if r["kept"]] == [-13]


def test_near_groups(results):
    assert {r["component_id"] for r in results["op4"] if r["doc_id"] in (1, 2, 3)} == {1}
    assert {r["component_id"] for r in results["op4"] if r["doc_id"] in (7, 10, -13)} == {-13}
    assert of(results["op4"], 7)[0]["n_shingles"] == 1


def test_spans(results):
    r = of(results["op1"], 12)[0]
    assert (r["n_assign"], r["n_access"], r["n_hex"]) == (1, 1, 1) and r["spans"] == "assign:0:19,access:20:40,hex:41:73"


def test_very_long_text(results):
    assert of(results["op6"], 8)[0]["n_tokens"] == 180_001
    assert of(results["op9"], 8)[0]["size"] == 180_000
    assert of(results["op4"], 8)[0]["n_shingles"] > 100_000


def test_slots_have_no_gaps(results):
    for s in range(8):
        assert sorted(r["slot"] for r in results["op10"] if r["shard"] == s) == list(range(sum(r["shard"] == s for r in results["op10"])))


def test_stages_keep_columns(spark, odd, none, labels, tmp_path):
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    for stage in (quality.stage, exact_dedup.stage, near_dedup.stage, mixing.stage):
        out = stage(spark, odd, str(tmp_path))
        assert out.columns == odd.columns
        out.collect()
        assert stage(spark, none, str(tmp_path)).collect() == []
    assert len(exact_dedup.stage(spark, odd, "").where("doc_id = 7").collect()) == 0
    assert near_dedup.stage(spark, odd, "").where("doc_id in (7, 10, -13)").count() == 1


def test_quality_stage_without_a_classifier(spark, odd, labels, tmp_path):
    held = (quality.remainder(F.col("doc_id"), quality.FOLDS) == quality.HELD_OUT) & F.col("doc_id").isNotNull()
    for name, own in (("none", labels.limit(0)), ("held", labels.where(held)), ("one", labels.where("quality = 1")), ("null", labels.withColumn("quality", F.lit(None).cast("int")))):
        own.write.parquet(str(tmp_path / name / "labels.parquet"))
        out = quality.stage(spark, odd, str(tmp_path / name))
        assert out.columns == odd.columns and out.count() == odd.count()
