"""Plan-shape checks: pushdown, pruning, no Python on the hot path, no shuffle in scoring."""

import os

from pyspark.sql import functions as F

from hourcast.operators import explore, features, master
from hourcast.plans import catalog

SF = "/root/testdata/sf0.001"


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_explorer_filter_pushed_into_parquet_scan(spark, tmp_dir):
    path = os.path.join(tmp_dir, "master")
    catalog.master_table(spark, SF).write.parquet(path)
    m = spark.read.parquet(path)
    q = explore.similar_projects(m, industry="BUILDING", min_robots=1, max_robots=3).select("project_id")
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    plan = _plan(q)
    assert "EqualTo(industry_segment,BUILDING)" in plan.split("PushedFilters:")[1]
    assert "GreaterThanOrEqual(robot_count,1.0)" in plan
    # only the referenced columns are read
    scan = [ln for ln in plan.splitlines() if "FileScan parquet" in ln][0]
    assert "me10_actual_hours" not in scan and "ReadSchema: struct<project_id:string,industry_segment" in scan


def test_feature_projection_is_one_codegen_stage(spark):
    raw = catalog.raw_projects(spark, SF)
    eng = features.prepare_quotes(raw)
    plan = _plan(eng)
    assert "PythonUDF" not in plan and "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan


def test_dedup_keeps_a_row_per_task_and_key_before_the_shuffle(spark):
    plan = _plan(catalog.master_table(spark, SF))
    above, below = plan.split("Exchange hashpartitioning(project_id", 1)
    assert "WindowGroupLimit" in below.split("Exchange")[0]


def test_batch_scoring_has_no_exchange(spark, tmp_dir):
    from hourcast.operators import scoring

    models = scoring.load_models(spark, catalog.models_for(spark, SF))
    path = os.path.join(tmp_dir, "prepared")
    features.prepare_quotes(catalog._records(spark, SF)).write.parquet(path)
    wide = scoring.score_wide(spark.read.parquet(path), models, prepared=True, truncate=False)
    spark.conf.set("spark.sql.maxPlanStringLength", str(10**8))
    # the forests, their statistics and the nine buckets: one scan, row by row
    text = _plan(scoring.wide_to_buckets(wide))
    assert "Exchange" not in text and "Subquery" not in text
    assert "FileScan parquet" in text and "ArrowEvalPython" in text and "BatchEvalPython" not in text


def test_session_of_the_caller_stays_as_it_is(spark):
    from hourcast.session import tune_session

    other = spark.newSession()
    other.conf.set("spark.sql.constraintPropagation.enabled", "true")
    other.conf.set("spark.sql.shuffle.partitions", "3")
    own = tune_session(other)
    assert own.conf.get("spark.sql.constraintPropagation.enabled") == "false" and own.conf.get("spark.sql.shuffle.partitions") == "3"
    assert other.conf.get("spark.sql.constraintPropagation.enabled") == "true"


def test_changed_tables_are_read_anew(spark, tmp_dir):
    import shutil

    import pyarrow.parquet as pq

    sf = os.path.join(tmp_dir, "sf")
    os.makedirs(sf)
    for t in ("lineitem", "customer", "supplier"):
        shutil.copy(os.path.join(SF, f"{t}.parquet"), sf)
    orders = pq.read_table(os.path.join(SF, "orders.parquet"))
    pq.write_table(orders, os.path.join(sf, "orders.parquet"))
    first = catalog.stored_master(spark, sf).count()
    pq.write_table(orders.slice(0, len(orders) // 2), os.path.join(sf, "orders.parquet"))
    assert 0 < catalog.stored_master(spark, sf).count() < first
