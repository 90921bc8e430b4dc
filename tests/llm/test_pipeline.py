import corpus_pipeline
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from hourcast.llm import bpe, exact_dedup, mixing, near_dedup, quality
from hourcast.llm.queries import QUERIES

from .test_copies import brute_components


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    sf, docs, out = "/root/testdata/sf0.01", spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), []
    for name, f in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp(name) / "out")
        f(spark, docs, sf).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append(docs)
    return out


def test_each_stage_on_its_input(spark, stages):
    sf = "/root/testdata/sf0.01"
    first = spark.read.parquet(f"{sf}/documents.parquet")
    judged, exact, near, mixed, tokens = stages
    assert all(d.columns == first.columns for d in stages[:4])
    scores = quality.op5_random_indexing(spark, first, spark.read.parquet(f"{sf}/labels.parquet"))
    assert {r[0] for r in judged.select("doc_id").collect()} == {r[0] for r in scores.where("predicted = 1").select("doc_id").collect()}
    kept = exact_dedup.op7_exact_dedup(spark, judged).where("kept")
    assert {r[0] for r in exact.select("doc_id").collect()} == {r[0] for r in kept.select("doc_id").collect()}
    want, _ = brute_components({r["doc_id"]: r["text"] for r in exact.collect()}, 5, 80)
    assert {r[0] for r in near.select("doc_id").collect()} == set(want.values())
    copies = {r["doc_id"]: r["copies"] for r in mixing.op9_entropy_mix(spark, near).collect() if r["copies"]}
    assert {r["doc_id"]: r["n"] for r in mixed.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).collect()} == copies
    library = Tokenizer.from_file(bpe.VOCABULARY)
    texts = {r["doc_id"]: r["text"] for r in mixed.collect()}
    rows = tokens.collect()
    assert len(rows) == mixed.count()
    assert all(r["ids"] == library.encode(texts[r["doc_id"]], add_special_tokens=False).ids for r in rows[:200])


def test_run_does_the_stages(spark, stages):
    rows = QUERIES["pipeline"](spark, "/root/testdata/sf0.01").collect()
    assert sorted((r["doc_id"], tuple(r["ids"])) for r in rows) == sorted((r["doc_id"], tuple(r["ids"])) for r in stages[-1].collect())


def test_stages_are_named():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "exact", "near", "mix", "tokens"] and near_dedup.K == 64
