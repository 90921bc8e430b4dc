"""Bucketed merge and commits: untouched files, uploads at the same time, replays, counts."""

import os
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from hourcast.plans import upload
from hourcast.plans.upload import current_master, ingest_upload, latest, master_versions, read_log
from hourcast.sources import commits

COLUMNS = ["project_id", "include_in_training", "dataset_role", "robot_count", "quoted_materials_cost", "me10_actual_hours"]


@pytest.fixture(autouse=True)
def any_columns(monkeypatch):
    monkeypatch.setattr(upload, "require_training_columns", lambda raw: None)


def rows(spark, *items, **more):
    data = [(p, "yes", "actuals", "2", "100", str(hours), i) for i, (p, hours) in enumerate(items)]
    out = spark.createDataFrame(data, ", ".join(f"{c} string" for c in COLUMNS) + ", row_idx long")
    return out.withColumns({c: F.lit(v) for c, v in more.items()})


def master(spark, state):
    return {r.project_id: (r.me10_actual_hours, r.upload_seq) for r in current_master(spark, state).collect()}


def test_only_touched_buckets_are_rewritten(spark, tmp_dir):
    state = os.path.join(tmp_dir, "state")
    first = ingest_upload(spark, rows(spark, *[(f"P{i}", i + 1) for i in range(40)], ("P3", 99)), state, train=False, buckets=8)
    assert [first[c] for c in ("upload_seq", "rows_raw", "rows_train", "rows_master_total")] == [0, 41, 41, 40]
    before = latest(spark, state)
    second = ingest_upload(spark, rows(spark, ("P5", 500), ("P5", 501), (None, 7), (None, 8), note="x"), state, train=False)
    after = latest(spark, state)
    same = [b for b in before.buckets if after.buckets[b] == before.buckets[b]]
    assert len(same) >= len(before.buckets) - 2 and after.of == 8
    assert [second[c] for c in ("upload_seq", "rows_raw", "rows_train", "rows_master_total")] == [1, 4, 4, 41]
    got = master(spark, state)
    assert got["P3"] == (99.0, 0) and got["P5"] == (501.0, 1) and got[None] == (8.0, 1) and len(got) == 41
    # the older version still reads as it was, the new column is null in untouched files
    assert current_master(spark, state, before=1).count() == 40
    assert {r.note for r in current_master(spark, state).collect()} == {None, "x"}


def test_uploads_at_the_same_time(spark, tmp_dir):
    """Each gets its own number, and nothing of either is lost."""
    state = os.path.join(tmp_dir, "state")
    parts = [rows(spark, *[(f"P{k}-{i}", i + 1) for i in range(5)], ("shared", k + 1)) for k in range(3)]
    with ThreadPoolExecutor(3) as pool:
        done = list(pool.map(lambda r: ingest_upload(spark, r, state, train=False, buckets=4), parts))
    assert sorted(d["upload_seq"] for d in done) == [0, 1, 2] == master_versions(spark, state)
    log = read_log(spark, state).orderBy("upload_seq").collect()
    assert [r.rows_raw for r in log] == [6, 6, 6] and [r.rows_master_total for r in log] == [6, 11, 16]
    got = master(spark, state)
    last = next(k for k, d in enumerate(done) if d["upload_seq"] == 2)
    assert len(got) == 16 and got["shared"] == (last + 1.0, 2)


def test_a_lost_race_merges_again(spark, tmp_dir, monkeypatch):
    state = os.path.join(tmp_dir, "state")
    ingest_upload(spark, rows(spark, ("A", 1)), state, train=False, buckets=4)
    create, raced = commits.create, []

    def slow(session, folder, name, text):
        if not raced:
            raced.append(name)
            ingest_upload(spark, rows(spark, ("B", 2), ("A", 3)), state, train=False)
        return create(session, folder, name, text)

    monkeypatch.setattr(commits, "create", slow)
    late = ingest_upload(spark, rows(spark, ("C", 4)), state, train=False)
    assert late["upload_seq"] == 2 and raced == ["00000001.json"]
    assert master(spark, state) == {"A": (3.0, 1), "B": (2.0, 1), "C": (4.0, 2)}


def test_replays_and_empty_uploads(spark, tmp_dir):
    state = os.path.join(tmp_dir, "state")
    assert read_log(spark, state).count() == 0 and current_master(spark, state) is None
    none = ingest_upload(spark, rows(spark, ("A", 0)), state, train=False)
    assert (none["rows_raw"], none["rows_train"], none["rows_master_total"]) == (1, 0, 0) and current_master(spark, state) is None
    once = ingest_upload(spark, rows(spark, ("A", 5)), state, train=False, key="batch-1")
    again = ingest_upload(spark, rows(spark, ("A", 5)), state, train=False, key="batch-1")
    assert once == again and read_log(spark, state).count() == 2


def test_counts_with_a_given_log_cost(spark, tmp_dir):
    """The log-cost rule reads the rows a second time; they are counted once."""
    state = os.path.join(tmp_dir, "state")
    got = ingest_upload(spark, rows(spark, ("A", 5), ("B", 0), ("C", 2), log_quoted_materials_cost="3.5"), state, train=False)
    assert (got["rows_raw"], got["rows_train"], got["rows_master_total"]) == (3, 2, 2)


def test_files_are_created_once(spark, tmp_dir):
    with ThreadPoolExecutor(8) as pool:
        won = list(pool.map(lambda k: commits.create(spark, tmp_dir, "x.json", f'"{k}"'), range(16)))
    assert sum(won) == 1 and commits.names(spark, tmp_dir) == ["x.json"]
    assert commits.read(spark, tmp_dir, "x.json") == f'"{won.index(True)}"'
