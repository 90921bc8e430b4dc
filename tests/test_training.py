"""M1-M14 on a small synthetic master: split sizes, metrics, forest invariants."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from hourcast.config import OPERATIONS, QUOTE_CAT_FEATURES, TARGETS
from hourcast.operators import forest, rollup, scoring, training
from hourcast.sources import arrays


@pytest.fixture(scope="module")
def small_master(spark):
    rng = np.random.default_rng(7)
    rows = []
    for i in range(120):
        rc = float(rng.integers(0, 6))
        sc = float(rng.integers(1, 8))
        cat = ["A", "B", "C"][i % 3]
        hours = {t: float(10 + 4 * rc + 2 * sc + (5 if cat == "B" else 0) + rng.normal(0, 1)) for t in TARGETS}
        hours["pm200_actual_hours"] = float(i % 2) if i < 4 else 0.0  # only 2 positive rows -> skipped
        rows.append(
            dict(
                project_id=f"P{i}", upload_seq=0, row_idx=i, robot_count=rc, stations_count=sc,
                industry_segment=cat, system_category="S", automation_level="R", plc_family="p",
                hmi_family="h", has_controls=1, **hours,
            )
        )
    df = spark.createDataFrame(rows)
    return df.withColumn("vision_type", F.lit(None).cast("string")).withColumn(
        "log_quoted_materials_cost", F.when(F.col("row_idx") % 2 == 0, F.col("robot_count") + 0.5)
    )


def test_training_long_guard(spark, small_master):
    long = training.training_long(small_master)
    per = {r.target: r["count"] for r in long.groupBy("target").count().collect()}
    assert "pm200_actual_hours" not in per and per["me10_actual_hours"] == 120


def test_exact_split_sizes(spark, small_master):
    long = training.training_long(small_master)
    sp = training.exact_split(long)
    per = sp.groupBy("target").agg(F.sum(F.col("is_test").cast("int")).alias("t"), F.count("*").alias("n")).collect()
    for r in per:
        assert r.t == math.ceil(0.25 * r.n)
    a = sorted((r.target, r.project_id, r.is_test) for r in sp.collect())
    b = sorted((r.target, r.project_id, r.is_test) for r in training.exact_split(long.repartition(5)).collect())
    assert a == b


def test_split_of_five_rows(spark):
    df = spark.createDataFrame([(f"p{i}", i, "t", 1.0) for i in range(5)], "project_id string, row_idx long, target string, hours double")
    assert training.exact_split(df).filter("is_test").count() == 2


def test_regression_metrics_edge_cases(spark):
    df = spark.createDataFrame(
        [("a", 1.0, 1.0), ("a", 1.0, 1.0), ("b", 2.0, 3.0), ("b", 2.0, 1.0), ("c", 1.0, 2.0), ("c", 3.0, 2.0)],
        "g string, y double, p double",
    )
    out = {r.g: r for r in training.regression_metrics(df, "g", "y", "p").collect()}
    assert out["a"].r2 == 1.0 and out["b"].r2 == 0.0  # SST = 0
    assert out["c"].mae == 1.0 and out["c"].r2 == pytest.approx(0.0)


def test_impute_values_median_and_mode(spark, small_master):
    sp = training.exact_split(training.training_long(small_master))
    iv = training.impute_values(sp).filter("target = 'me10_actual_hours'").collect()
    d = {r.feature: r for r in iv}
    train = [r for r in sp.filter("target = 'me10_actual_hours' AND NOT is_test").collect()]
    assert d["robot_count"].num_value == pytest.approx(float(np.median([r.robot_count for r in train])))
    assert d["vision_type"].cat_value is None  # all-null -> dropped from the model
    counts = {}
    for r in train:
        counts[r.industry_segment] = counts.get(r.industry_segment, 0) + 1
    best = sorted(counts.items(), key=lambda kv: (-kv[1], kv[0]))[0][0]
    assert d["industry_segment"].cat_value == best


@pytest.fixture(scope="module")
def trained(spark, small_master, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("models"))
    metrics = training.train_all(small_master, d, trees=8, max_depth=4).collect()
    return d, metrics


def test_train_all_metrics(spark, trained):
    d, metrics = trained
    assert [m.target for m in metrics] == [t for t in TARGETS if t != "pm200_actual_hours"]
    for m in metrics:
        assert m.rows == 120 and m.mae >= 0 and m.r2 <= 1.0
    # the signal is learnable: better than the constant mean predictor
    assert sum(m.r2 for m in metrics) / len(metrics) > 0.3


def test_strict_load_lists_missing(spark, trained):
    d, _ = trained
    with pytest.raises(FileNotFoundError, match="pm200"):
        scoring.load_models(spark, d)
    assert len(scoring.load_models(spark, d, strict=False)) == 11
    reg = {r.target: r.exists for r in scoring.list_models(spark, d).collect()}
    assert reg["pm200_actual_hours"] is False and reg["me10_actual_hours"] is True


def test_statistics_are_those_of_the_single_trees(spark, trained, small_master):
    """Each tree of the stored forest walked node by node, for each row."""
    d, _ = trained
    m = scoring.load_models(spark, d, strict=False)[0]
    table = scoring.trees_table(spark, m.target, m.path).collect()
    assert sorted(r.tree for r in table) == list(range(8)) and max(r.levels for r in table) <= 4
    nodes = {f: arrays.get(m.forest.folder, f"{f}-0") for f in forest.FIELDS}

    def walk(x, at):
        while nodes["feature"][at] >= 0:
            at = nodes["left"][at] + (x[nodes["feature"][at]] > nodes["number"][at])
        return nodes["number"][at]

    own = {r.row_idx: r["__me10__features"].toArray() for r in m.model.transform(small_master).collect()}
    quotes = small_master.withColumnRenamed("row_idx", "quote_id")
    for r in scoring.score_wide(quotes, [m]).collect():
        trees = [walk(own[r.quote_id], root) for root in m.forest.roots[0]]
        assert r.me10_p50 == pytest.approx(np.mean(trees)) and r.me10_std == pytest.approx(np.std(trees))
        assert [r.me10_p10, r.me10_p90] == pytest.approx(np.percentile(trees, [10, 90]).tolist())
    checks = scoring.score_checks(quotes, [m]).first()
    assert tuple(checks) == ("me10", 120, 0, 0, 0)


def test_scoring_invariants(spark, trained, small_master):
    d, _ = trained
    models = scoring.load_models(spark, d, strict=False)
    quotes = small_master.withColumnRenamed("row_idx", "quote_id").withColumn(
        "industry_segment", F.when(F.col("quote_id") == 0, F.lit("UNSEEN")).otherwise(F.col("industry_segment"))
    )
    wide = scoring.score_wide(quotes, models)
    long = scoring.wide_to_long(wide)
    rows = long.collect()
    assert len(rows) == 120 * 11
    for r in rows:
        assert r.p10 <= r.p50 + 1e-9 <= r.p90 + 2e-9 and r.std >= 0
    w = wide.select("quote_id", "total_p50", *[f"{op}_p50" for op in OPERATIONS if op != "pm200"]).collect()
    for r in w:
        assert r.total_p50 == pytest.approx(sum(r[f"{op}_p50"] for op in OPERATIONS if op != "pm200"))
    b = rollup.rollup_buckets(long).groupBy("quote_id").agg(F.sum("p50").alias("s"))
    t = rollup.quote_totals(long)
    for r in b.join(t, "quote_id").collect():
        assert r.s == pytest.approx(r.total_p50)
    # partitioning does not change results
    again = {r.quote_id: r.me10_p50 for r in scoring.score_wide(quotes.repartition(3), models).collect()}
    assert all(again[r.quote_id] == pytest.approx(r.me10_p50) for r in w)


def test_drivers_importances(spark, trained):
    d, _ = trained
    models = scoring.load_models(spark, d, strict=False)
    every = [r for r in scoring.drivers(models, spark, n=1000).collect() if r.target == "me10_actual_hours"]
    assert sum(r.importance for r in every) == pytest.approx(1.0)
    assert [r["rank"] for r in every] == list(range(1, len(every) + 1))
    assert every[0].importance >= every[-1].importance
    names = {r.feature for r in every}
    assert "num__robot_count" in names
    assert any(n.startswith("cat__industry_segment_") for n in names)
    listed = scoring.drivers(models, spark).groupBy("target").count().collect()
    assert len(listed) == 11 and all(r["count"] <= 15 for r in listed)


def test_scoring_leaves_the_model_alone(spark, trained, small_master):
    d, _ = trained
    m = scoring.load_models(spark, d, strict=False)[0]
    scoring.score_wide(small_master.withColumnRenamed("row_idx", "quote_id"), [m]).count()
    assert "__me10__features" in m.model.transform(small_master).columns


def test_repeated_null_and_absent_ids(spark, trained, small_master):
    d, _ = trained
    models = scoring.load_models(spark, d, strict=False)[:2]
    quotes = small_master.withColumnRenamed("row_idx", "quote_id")
    want = {r.quote_id: r.me10_p50 for r in scoring.score_wide(quotes, models).collect()}
    # all rows carry one of two ids or none; the place in the file tells them apart
    odd = quotes.withColumn("at", F.col("quote_id")).withColumn("quote_id", F.when(F.col("at") % 3 == 0, F.lit(None)).otherwise(F.lit(7)))
    got = {r["at"]: r.me10_p50 for r in scoring.score_wide(odd, models).collect()}
    assert got == pytest.approx(want)
    bare = scoring.score_wide(quotes.drop("quote_id", "project_id"), models).collect()
    assert sorted(r.me10_p50 for r in bare) == pytest.approx(sorted(want.values()))


def test_old_models_keep_their_numbers_after_a_retrain(spark, small_master, tmp_path):
    d = str(tmp_path / "models")
    training.train_all(small_master, d, trees=4, max_depth=3).count()
    old = scoring.load_models(spark, d, strict=False)
    quotes = small_master.withColumnRenamed("row_idx", "quote_id")
    planned = scoring.score_wide(quotes, old)
    before = {r.quote_id: r.me10_p50 for r in scoring.score_wide(quotes, old).collect()}
    more = small_master.withColumns({t: F.col(t) * 100 for t in TARGETS})
    training.train_all(more, d, trees=6, max_depth=5).count()
    after = {r.quote_id: r.me10_p50 for r in scoring.score_wide(quotes, old).collect()}
    assert before == after == {r.quote_id: r.me10_p50 for r in planned.collect()}
    new = {r.quote_id: r.me10_p50 for r in scoring.score_wide(quotes, scoring.load_models(spark, d, strict=False)).collect()}
    assert sum(new.values()) > 50 * sum(before.values())


def test_skipped_targets_keep_their_model(spark, small_master, tmp_path):
    d = str(tmp_path / "models")
    training.train_all(small_master, d, trees=2, max_depth=2).count()
    first = scoring.published(spark, d)
    training.train_all(small_master.withColumn(TARGETS[0], F.lit(0.0)), d, trees=2, max_depth=2).count()
    second = scoring.published(spark, d)
    assert second[TARGETS[0]] == first[TARGETS[0]] and second[TARGETS[1]] != first[TARGETS[1]]


def test_fits_read_their_own_part(spark, small_master, tmp_path):
    path = str(tmp_path / "split")
    training.exact_split(training.training_long(small_master)).write.partitionBy("target").parquet(path)
    plan = spark.read.parquet(path).filter(F.col("target") == TARGETS[0])._jdf.queryExecution().executedPlan().toString()
    assert "target#" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_exact_medians(spark):
    rng = np.random.default_rng(3)
    groups = {
        "spread": rng.normal(0, 1e6, 1001),
        "even": rng.integers(-5, 5, 1000).astype(float),
        "powers": 2.0 ** rng.integers(-30, 30, 500),
        "one": np.array([7.5]),
        "two": np.array([-1.0, 4.0]),
        "hot": np.concatenate([np.full(700, 3.0), rng.uniform(2.999, 3.001, 600)]),
        "zero": np.array([0.0, 0.0, -0.5, 1e-9]),
        "endless": np.array([float("inf"), 1.0, 2.0, float("-inf"), float("inf")]),
    }
    rows = [(g, float(x)) for g, xs in groups.items() for x in xs] + [("spread", None)]
    df = spark.createDataFrame(rows, "g string, value double").repartition(7)
    got = {r.g: r["median"] for r in training.exact_medians(df, ["g"]).collect()}
    assert got == pytest.approx({g: float(np.median(xs)) for g, xs in groups.items()})


def test_no_statistic_keeps_values_in_a_buffer(spark, small_master):
    plan = training.impute_values(training.exact_split(training.training_long(small_master)))._jdf.queryExecution().executedPlan().toString()
    assert not any(f"{name}(" in plan for name in ("median", "percentile", "mode", "collect_set", "collect_list"))


def test_imputation_evaluates_the_split_once(spark, small_master, tmp_dir):
    import os

    path = os.path.join(tmp_dir, "split")
    training.exact_split(training.training_long(small_master)).write.parquet(path)
    split = spark.read.parquet(path)
    counted = training.value_counts(split)._jdf.queryExecution().executedPlan().toString()
    assert counted.count("FileScan parquet") == 1
    # everything after that reads the counts
    out = training.impute_values(split)
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    scans = [ln for ln in out._jdf.queryExecution().executedPlan().toString().splitlines() if "FileScan parquet" in ln]
    assert scans and all("value-counts-" in ln and path not in ln for ln in scans)
    # every feature of every target, also those without a value
    n_features = len([c for c in training.QUOTE_NUM_FEATURES + training.QUOTE_CAT_FEATURES if c in split.columns])
    assert out.count() == out.select("target").distinct().count() * n_features
    assert out.filter("feature = 'vision_type' and cat_value is not null").count() == 0


def test_split_sizes_are_exact_with_equal_keys_and_any_share(spark):
    """A third of the rows under a null key, all in one bin, among distinct ones; shares that cut inside and outside it."""
    rows = [("t", None if i % 3 == 0 else str(i), i) for i in range(300)] + [("one", "a", 0)]
    long = spark.createDataFrame(rows, "target string, project_id string, row_idx long").repartition(5)
    for share in (0.0, 0.01, 0.25, 0.5, 0.75, 1.0):
        got = training.exact_split(long, test_size=share).collect()
        assert sorted((r.target, r.row_idx) for r in got) == sorted((t, i) for t, _, i in rows)
        assert sum(r.is_test for r in got if r.target == "t") == math.ceil(300 * share)
        # the order by key, equal keys by row
        key = lambda r: (hashlib.md5(f"t|{r.project_id or '<null>'}|{training.SPLIT_SEED}".encode()).hexdigest(), r.row_idx)
        ordered = sorted((r for r in got if r.target == "t"), key=key)
        assert [r.is_test for r in ordered] == sorted((r.is_test for r in ordered), reverse=True)
