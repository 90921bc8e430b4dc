"""Merge semantics and partition independence."""

from pyspark.sql import functions as F

from hourcast.operators import master


def test_any_hours_filter(spark):
    df = spark.createDataFrame(
        [("a", "5", None), ("b", "0", "-1"), ("c", "x", "2"), ("d", None, None)],
        "project_id string, me10_actual_hours string, ee20_actual_hours string",
    )
    assert sorted(r.project_id for r in master.with_any_hours(df).collect()) == ["a", "c"]


def test_dedup_keeps_last_and_one_null(spark):
    df = spark.createDataFrame(
        [("p1", 0, 1, "old"), ("p1", 1, 0, "new"), ("p2", 0, 5, "only"), (None, 0, 1, "n1"), (None, 0, 2, "n2")],
        "project_id string, upload_seq long, row_idx long, v string",
    )
    out = {r.project_id: r.v for r in master.dedup_last(df).collect()}
    assert out == {"p1": "new", "p2": "only", None: "n2"}


def test_dedup_is_partition_independent(spark):
    rows = [(f"p{i % 37}", i % 3, i, i) for i in range(500)]
    df = spark.createDataFrame(rows, "project_id string, upload_seq long, row_idx long, v long")
    a = sorted(master.dedup_last(df).collect())
    b = sorted(master.dedup_last(df.repartition(7, "v")).collect())
    c = sorted(master.dedup_last(master.dedup_last(df)).collect())
    assert a == b == c
    want = {}
    for p, s, i, v in sorted(rows, key=lambda r: (r[1], r[2])):
        want[p] = v
    assert {r.project_id: r.v for r in a} == want


def test_no_project_id_no_dedup(spark):
    df = spark.createDataFrame([(1,), (1,)], "x int")
    assert master.dedup_last(df).count() == 2


def test_union_different_columns(spark):
    a = spark.createDataFrame([("p1", 0, 0, 1.0)], "project_id string, upload_seq long, row_idx long, x double")
    b = spark.createDataFrame([("p2", 1, 0, "z")], "project_id string, upload_seq long, row_idx long, y string")
    out = master.merge_master(a, b).orderBy("project_id").collect()
    assert out[0].x == 1.0 and out[0].y is None and out[1].x is None and out[1].y == "z"


def test_upload_counts(spark):
    raw = spark.createDataFrame(
        [(0, "a"), (0, "b"), (0, "c"), (1, "a"), (1, "d"), (2, "x")], "upload_seq long, project_id string"
    )
    train = raw.filter(F.col("project_id") != "x")  # upload 2 has nothing trainable
    out = [tuple(r) for r in master.upload_counts(raw, train).orderBy("upload_seq").collect()]
    assert out == [(0, 3, 3, 3), (1, 2, 2, 4), (2, 1, 0, 4)]
