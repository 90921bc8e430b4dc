"""Readers, column checks, log tail, previews."""

import os

import pytest

from hourcast.config import ALL_FEATURES, REQUIRED_TRAINING_COLS
from hourcast.sources import tables


def test_require_columns_lists_all_missing(spark):
    df = spark.createDataFrame([("p", "yes")], "project_id string, include_in_training string")
    with pytest.raises(ValueError) as e:
        tables.require_training_columns(df)
    for c in REQUIRED_TRAINING_COLS[2:]:
        assert c in str(e.value)
    q = spark.createDataFrame([(1.0,)], "stations_count double")
    with pytest.raises(ValueError, match="vision_type"):
        tables.require_quote_columns(q)
    tables.require_columns(df, ["project_id"])  # no error, no job


def test_absent_tables(spark, tmp_dir):
    missing = os.path.join(tmp_dir, "nope")
    assert tables.read_master(spark, missing) is None
    assert tables.read_metrics(spark, missing).count() == 0
    assert tables.read_upload_log(spark, missing).columns == ["upload_seq", "rows_raw", "rows_train", "rows_master_total"]


def test_log_tail_and_preview(spark):
    log = spark.createDataFrame([(i, i, i, i) for i in range(25)], tables.UPLOAD_LOG_SCHEMA)
    tail = [r.upload_seq for r in tables.upload_log_tail(log).collect()]
    assert sorted(tail) == list(range(15, 25))
    rows = spark.createDataFrame([(s, i) for s in (1, 0) for i in (2, 1)], "upload_seq long, row_idx long")
    assert [tuple(r) for r in tables.preview(rows, 3).collect()] == [(0, 1), (0, 2), (1, 1)]


def test_csv_round_trip_all_text(spark, tmp_dir):
    src = os.path.join(tmp_dir, "quotes")
    df = spark.createDataFrame([tuple(f"{c}-v" for c in ALL_FEATURES)], ", ".join(f"`{c}` string" for c in ALL_FEATURES))
    tables.write_csv(df, src)
    back = tables.read_quotes(spark, src)
    assert set(back.columns) == set(ALL_FEATURES)
    assert all(t == "string" for _, t in back.dtypes)
    up = tables.read_projects(spark, src, upload_seq=3)
    r = up.first()
    assert r.upload_seq == 3 and r.row_idx is not None


def test_csv_dialect_against_pandas(spark, tmp_dir):
    import pandas as pd

    rows = [('x "q" y', "l1\nl2", "  pad "), ("a,b", "", '"'), ("back\\slash", "é", "'")]
    src = os.path.join(tmp_dir, "in.csv")
    pd.DataFrame(rows, columns=["a", "b", "c"]).to_csv(src, index=False)
    back = [tuple(r) for r in tables.read_quotes(spark, src).collect()]
    assert sorted(back, key=str) == sorted([(a, b or None, c) for a, b, c in rows], key=str)
    out = os.path.join(tmp_dir, "out")
    tables.write_csv(spark.createDataFrame(rows, "a string, b string, c string").coalesce(1), out)
    part = next(os.path.join(out, f) for f in os.listdir(out) if f.endswith(".csv"))
    got = pd.read_csv(part, dtype=str, keep_default_na=False)
    assert [tuple(r) for r in got.itertuples(index=False)] == rows


def test_rows_keep_file_order(spark, tmp_dir):
    import pandas as pd

    src = os.path.join(tmp_dir, "files")
    os.makedirs(src)
    # the second file is the larger one, which Spark reads first
    for k, n in enumerate((5, 5000)):
        pd.DataFrame({"project_id": [f"{k}-{i}" for i in range(n)]}).to_csv(os.path.join(src, f"part-{k}.csv"), index=False)
    got = [r.project_id for r in tables.read_projects(spark, src, 0).orderBy("row_idx").collect()]
    assert got == [f"0-{i}" for i in range(5)] + [f"1-{i}" for i in range(5000)]
    assert sorted(r.row_idx for r in tables.read_projects(spark, src, 0).collect()) == list(range(5005))


def test_metrics_are_read_back(spark, tmp_dir):
    rows = [("me10_actual_hours", "v1", 5, 1.5, 0.25, "/a b/c")]
    tables.write_csv(spark.createDataFrame(rows, tables.METRICS_SCHEMA), os.path.join(tmp_dir, "m"))
    assert [tuple(r) for r in tables.read_metrics(spark, os.path.join(tmp_dir, "m")).collect()] == rows


@pytest.fixture()
def small_splits(spark):
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_quoted_csv_is_cut_into_splits(spark, tmp_dir, small_splits):
    """Line breaks, doubled quotes, blanks and records longer than a split, against pandas and the reader of whole files."""
    import random

    import pandas as pd

    rng = random.Random(3)
    piece = ["a", '"', "\n", ",", " ", "\n\n", "é", "", "'", '""', "x" * 90, "\\"]
    cell = lambda: "".join(rng.choices(piece, k=rng.choice([0, 1, 3, 8, 60])))
    src, want = os.path.join(tmp_dir, "files"), []
    os.makedirs(src)
    for k, n in enumerate((1, 40, 7, 150)):
        rows = [(f"{k}-{i}", cell(), cell()) for i in range(n)]
        want += rows
        # LF, and CRLF after each record with blank lines in between
        end = "\n" if k != 2 else "\r\n\r\n"
        pd.DataFrame(rows, columns=["project_id", 'the "b"\nof it', "c"]).to_csv(os.path.join(src, f"part-{k}.csv"), index=False, lineterminator=end)
    got = tables.quoted_records(spark, src)
    assert spark.read.text(src).rdd.getNumPartitions() > 8
    wanted = sorted([tuple(x or None for x in r) for r in want], key=str)
    assert sorted(map(tuple, got.drop("_file", "_record").collect()), key=str) == wanted
    # the reader of whole files takes LF for the end of a line where a quoted header has it
    whole = tables._whole_files(spark, os.path.join(src, "part-[013].csv"))
    assert whole.columns == got.columns[2:]
    assert sorted(map(tuple, whole.collect()), key=str) == [r for r in wanted if not r[0].startswith("2-")]
    ordered = tables.read_projects(spark, src, 2).orderBy("row_idx").collect()
    assert [r.project_id for r in ordered] == [r[0] for r in want] and [r.row_idx for r in ordered] == list(range(len(want)))
    assert sorted(r.project_id for r in tables.read_quotes(spark, src).collect()) == sorted(r[0] for r in want)


def test_stray_quotes_are_an_error_where_a_file_is_split(spark, tmp_dir, small_splits):
    src = os.path.join(tmp_dir, "stray.csv")
    with open(src, "w") as f:
        f.write("a,b\n" + "".join(f'{i},pipe of 5" width\n' for i in range(100)))
    with pytest.raises(Exception, match="do not enclose a field"):
        tables.read_text(spark, src).collect()


def test_empty_and_header_only_files(spark, tmp_dir):
    src = os.path.join(tmp_dir, "h.csv")
    with open(src, "w") as f:
        f.write("a,b\n")
    assert tables.quoted_records(spark, src).count() == 0 and tables.quoted_records(spark, src).columns == ["_file", "_record", "a", "b"]


def test_project_rows_shuffle_line_items_once(spark, tmp_dir):
    """As the SQL says with null, repeated and unmatched keys, from one narrow shuffle of the line items."""
    import duckdb

    from hourcast.sources import fixtures

    lines = [(k, p, s, n, float(q), f) for k, p, s, n, q, f in [
        (1, 5, 7, 1, 3, "R"), (1, 5, None, 2, 4, "N"), (1, 6, 7, 3, 5, None), (1, None, 8, 4, 6, "R"),
        (2, None, None, 1, 9, "A"), (None, 1, 1, 1, 2, "R"), (9, 1, 1, 1, 2, "R"), (4, 3, 3, None, 1, "N"), (4, 3, 3, None, 1, "N"),
    ]]
    orders = [(k, c, s, "1-URGENT", 1234.5 + k) for k, c, s in [(1, 1, "F"), (2, 1, "O"), (3, 2, "P"), (4, 3, "F"), (4, 3, "F"), (5, None, "F"), (6, 99, "F")]]
    customers = [(1, "BUILDING"), (2, None), (3, "AUTO"), (3, "TOYS"), (None, "X")]
    for name, rows, kinds in (
        ("lineitem", lines, "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_returnflag string"),
        ("orders", orders, "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_orderpriority string, o_totalprice double"),
        ("customer", customers, "c_custkey bigint, c_mktsegment string"),
    ):
        spark.createDataFrame(rows, kinds).coalesce(1).write.parquet(os.path.join(tmp_dir, f"{name}.parquet"))
    got = fixtures.project_rows(spark, tmp_dir)
    con = duckdb.connect()
    text = fixtures.projects_sql().format(**{t: f"read_parquet('{tmp_dir}/{t}.parquet/*.parquet') AS {t}" for t in ("lineitem", "orders", "customer")})
    want = con.execute(text).fetchall()
    assert sorted(map(repr, (tuple(r) for r in got.collect()))) == sorted(map(repr, want))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Expand" not in plan and plan.count("RepartitionByExpression") == 1
