"""C5-C14, F1, F2 on hand-made rows."""

import math

import pytest
from pyspark.sql import functions as F

from hourcast.config import QUOTE_CAT_FEATURES
from hourcast.operators import features


def _rows(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_log_cost_derived_when_absent(spark):
    df = _rows(spark, [("$1,000",), ("TBD",), (None,)], "quoted_materials_cost string")
    got = [r[0] for r in features.with_log_cost(df).select(features.LOG_COST).collect()]
    assert got[0] == pytest.approx(math.log1p(1000.0))
    assert got[1] == 0.0 and got[2] == 0.0


def test_log_cost_without_any_cost_column(spark):
    df = _rows(spark, [(1,), (2,)], "x int")
    assert [r[0] for r in features.with_log_cost(df).select(features.LOG_COST).collect()] == [0.0, 0.0]


def test_log_cost_all_null_is_derived_partial_null_kept(spark):
    df = _rows(
        spark,
        [(0, "$10", None), (0, "$20", None), (1, "$10", 5.0), (1, "$20", None)],
        "upload_seq long, quoted_materials_cost string, log_quoted_materials_cost double",
    )
    out = features.with_log_cost(df, by="upload_seq").orderBy("upload_seq", "quoted_materials_cost").collect()
    v = [r[features.LOG_COST] for r in out]
    assert v[0] == pytest.approx(math.log1p(10)) and v[1] == pytest.approx(math.log1p(20))
    assert v[2] == 5.0 and v[3] is None
    # whole-frame scope: the frame has one non-null value, so everything is kept
    whole = [r[features.LOG_COST] for r in features.with_log_cost(df).orderBy("upload_seq", "quoted_materials_cost").collect()]
    assert whole == [None, None, 5.0, None]


def test_indices_absent_inputs_and_overwrite(spark):
    df = _rows(spark, [("2", "3", None, 99.0)], "stations_count string, robot_count string, fixture_sets string, stations_robot_index double")
    out = features.with_indices(features.clean_numbers(df)).first()
    assert out["stations_robot_index"] == 5.0  # user value ignored, servo_axes absent -> 0
    assert out["mech_complexity_index"] == 0.0
    assert out["servo_axes"] == 0.0 and out["i_o_points_est"] == 0.0  # created
    assert out["fixture_sets"] is None  # base columns keep nulls


def test_controls_index_divides_io_points(spark):
    df = _rows(spark, [("1", "2", "150")], "servo_axes string, vision_systems_count string, i_o_points_est string")
    out = features.with_indices(features.clean_numbers(df)).first()
    assert out["controls_complexity_index"] == pytest.approx(1 + 2 + 150 / 75)


def test_training_filters_and_normalises(spark):
    rows = [
        ("a", " YES ", "Actuals "),
        ("b", "1.0", "actuals"),
        ("c", "true", "quote"),
        ("d", None, "actuals"),
        ("e", "1", "ACTUALS"),
    ]
    df = _rows(spark, rows, "project_id string, include_in_training string, dataset_role string")
    out = features.engineer_training(df).orderBy("project_id").collect()
    assert [r.project_id for r in out] == ["a", "e"]
    assert {r.include_in_training for r in out} == {"yes", "1"}
    assert {r.dataset_role for r in out} == {"actuals"}


def test_filters_skipped_when_columns_absent(spark):
    df = _rows(spark, [("a",), ("b",)], "project_id string")
    assert features.engineer_training(df).count() == 2


def test_conform_quotes_defaults_and_validation(spark):
    base = {c: "x" for c in QUOTE_CAT_FEATURES}
    df = spark.createDataFrame([dict(base, quote_id=1, stations_count="2")])
    out = features.conform_quotes(df).first()
    assert out["has_controls"] == 1 and out["has_robotics"] == 1
    assert out["complexity_score_1_5"] == 3.0 and out["stations_count"] == 2.0
    assert out["stations_robot_index"] == 2.0 and out["log_quoted_materials_cost"] == 0.0
    bad = spark.createDataFrame([dict(base, quote_id=1, industry_segment=None)], schema=df.schema)
    # whatever the consumer reads, the record is not accepted
    assert features.conform_quotes(bad).count() == 0 and features.conform_quotes(bad).select("stations_count").collect() == []
    assert [tuple(r) for r in features.rejected_quotes(bad).collect()] == [(1, "industry_segment is missing")]
    with pytest.raises(ValueError):
        features.conform_quotes(df.drop("vision_type"))


def test_quote_record_materials_cost(spark):
    base = {c: "x" for c in QUOTE_CAT_FEATURES}
    df = spark.createDataFrame([dict(base, quote_id=1, estimated_materials_cost=999.0)])
    out = features.conform_quotes(df).first()
    assert out["log_quoted_materials_cost"] == pytest.approx(math.log1p(999.0))


def test_record_flags_keep_their_meaning(spark):
    base = {c: "x" for c in QUOTE_CAT_FEATURES}
    given = ["no", "Yes", " TRUE", "false", "0", "1", "1.0", "2", None, "y", "0.5", "n/a"]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(given)], "quote_id int, has_controls string")
    df = df.withColumns({c: F.lit(v) for c, v in base.items()}).withColumn("duplicate", F.col("has_controls"))
    got = {r.quote_id: (r.has_controls, r.duplicate) for r in features.conform_quotes(df).collect()}
    assert got == {0: (0, 0), 1: (1, 1), 2: (1, 1), 3: (0, 0), 4: (0, 0), 5: (1, 1), 6: (1, 1), 7: (0, 0), 8: (1, 0)}
    reasons = {r.quote_id: r.reason for r in features.rejected_quotes(df).collect()}
    assert reasons.keys() == {9, 10, 11} and "has_controls is no flag" in reasons[9]


def test_unparsable_numbers_are_rejected(spark):
    base = {c: "x" for c in QUOTE_CAT_FEATURES}
    df = spark.createDataFrame([dict(base, quote_id=1, stations_count="many"), dict(base, quote_id=2, stations_count=" 3 ")])
    assert [r.quote_id for r in features.conform_quotes(df).collect()] == [2]
    assert features.rejected_quotes(df).first().reason == "stations_count is no number"


def test_category_without_values_does_not_filter(spark):
    from hourcast.operators import explore

    df = spark.createDataFrame([(1, None, "a"), (2, None, None), (3, None, "b")], "id int, industry_segment string, system_category string")
    assert {r.id for r in explore.explorer_filter(df).collect()} == {1, 3}
    assert {r.id for r in explore.explorer_filter(df, systems=[]).collect()} == {1, 2, 3}
    charts = df.withColumns({"project_id": F.col("id").cast("string"), "me10_actual_hours": F.lit(2.0), "ee20_actual_hours": F.lit(None).cast("double")})
    rows = explore.hours_by_project(explore.explorer_filter(charts)).collect()
    assert {tuple(r) for r in rows} == {("me10_actual_hours", "1", 2.0), ("me10_actual_hours", "3", 2.0)}
