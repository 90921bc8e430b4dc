"""Upload -> master -> models (path A).

State lives in one folder (shared storage on a cluster)::

    <state>/versions/<seq>.json   one commit for each upload: its log row (D4, S8),
                                  and the files of every bucket of the master (S7)
    <state>/master/<id>/bucket=*  parquet, the buckets that one upload rewrote
    <state>/models/runs/          models of each training run (S11)
    <state>/models/published/     pointers to the runs in use
    <state>/models/metrics_csv    per-target metrics, overwritten (S9)

The master is dealt to buckets by a hash of the project id, and all rows of a
project are in one bucket.  An upload reads and writes the buckets that its
projects fall into; the others keep their files.  It is committed by creating
the file of the next version, which one writer can do: whoever comes second
merges again, onto what the first one wrote.  Files never change, so readers of
an older version are not disturbed.
"""

from __future__ import annotations

import json
import os
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hourcast.operators.features import engineer_training
from hourcast.operators.master import merge_master, with_any_hours
from hourcast.operators.training import train_all
from hourcast.session import drop_path
from hourcast.sources import commits
from hourcast.sources.tables import UPLOAD_LOG_SCHEMA, require_training_columns, write_csv

#: Buckets of a new master.
BUCKETS = 64


@dataclass
class Version:
    """A committed upload: its log row and the master that it left (folder and rows of each bucket)."""

    upload_seq: int
    key: str
    rows_raw: int
    rows_train: int
    rows_master_total: int
    of: int
    columns: dict | None = None
    buckets: dict[str, list] = field(default_factory=dict)

    def master(self, spark: SparkSession, only: set[int] | None = None) -> DataFrame | None:
        """The master, or the rows of some of its buckets (with no rows where they are empty)."""
        if self.columns is None:
            return None
        schema = T.StructType.fromJson(self.columns)
        paths = [path for b, (path, _) in self.buckets.items() if only is None or int(b) in only]
        return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def _versions(state: str) -> str:
    return os.path.join(state, "versions")


def latest(spark: SparkSession, state: str, before: int | None = None) -> Version | None:
    """The last committed version (older than ``before``)."""
    names = [n for n in commits.names(spark, _versions(state)) if before is None or int(n.split(".")[0]) < before]
    return Version(**json.loads(commits.read(spark, _versions(state), names[-1]))) if names else None


def master_versions(spark: SparkSession, state: str) -> list[int]:
    """Upload sequence numbers that changed the master."""
    return [r["upload_seq"] for r in read_log(spark, state).where("rows_train > 0").orderBy("upload_seq").collect()]  # a row an upload


def current_master(spark: SparkSession, state: str, before: int | None = None) -> DataFrame | None:
    """The latest master (older than upload ``before``), ``None`` before the first accepted upload."""
    version = latest(spark, state, before)
    return version.master(spark) if version else None


def read_log(spark: SparkSession, state: str) -> DataFrame:
    """The log row of each committed upload."""
    if not commits.names(spark, _versions(state)):
        return spark.createDataFrame([], UPLOAD_LOG_SCHEMA)
    return spark.read.schema(UPLOAD_LOG_SCHEMA).json(os.path.join(_versions(state), "*.json"))


def _committed(spark: SparkSession, state: str, key: str) -> Version | None:
    """The version of the upload of this key, if it has one."""
    if not commits.names(spark, _versions(state)):
        return None
    keys = spark.read.schema("key string, upload_seq long").json(os.path.join(_versions(state), "*.json"))
    row = keys.where(F.col("key") == key).first()
    return Version(**json.loads(commits.read(spark, _versions(state), f"{row['upload_seq']:08d}.json"))) if row else None


def _bucket(rows: DataFrame, of: int) -> DataFrame:
    key = F.xxhash64(F.col("project_id").cast("string")) if "project_id" in rows.columns else F.monotonically_increasing_id()
    return rows.withColumn("bucket", F.pmod(key, F.lit(of)).cast("int"))


def _merged(spark: SparkSession, state: str, base: Version | None, staged: DataFrame, seq: int, of: int) -> tuple[dict, dict]:
    """Rewrites the buckets that the staged rows fall into; the new master's columns and buckets."""
    touched = {r["bucket"] for r in staged.select("bucket").distinct().collect()}  # at most ``of``
    old = base.master(spark, touched) if base else None
    upload = staged.drop("bucket").withColumn("upload_seq", F.lit(seq).cast("bigint"))
    merged = merge_master(old, upload)
    folder = os.path.join(state, "master", uuid.uuid4().hex)
    # equal ids have one bucket whichever upload they come from; large buckets get several files
    _bucket(merged, of).hint("rebalance", "bucket").write.partitionBy("bucket").parquet(folder)
    written = spark.read.parquet(folder).groupBy("bucket").count().collect()  # counts of the files' footers
    buckets = dict(base.buckets) if base else {}
    buckets |= {str(r["bucket"]): [os.path.join(folder, f"bucket={r['bucket']}"), r["count"]] for r in written}
    return merged.schema.jsonValue(), buckets


def ingest_upload(
    spark: SparkSession,
    raw: DataFrame,
    state: str,
    train: bool = True,
    key: str | None = None,
    buckets: int = BUCKETS,
    **forest,
) -> dict:
    """S5 -> C11 -> F3 -> (U1, U2, S7) -> S8 ->.

    ``raw`` is one upload (all-text columns; ``row_idx`` gives file order).
    An upload without trainable rows is logged and changes nothing else.
    ``key`` names the upload where it may be repeated (a replayed micro-batch):
    one that is committed already is not merged again, and its record returned.
    Returns the log record plus the metrics frame when models were trained.
    """
    require_training_columns(raw)
    version = _committed(spark, state, key) if key else None
    if version is None:
        version = _ingest(spark, raw, state, key or f"upload-{uuid.uuid4().hex}", buckets)
    result: dict = {**{c: getattr(version, c) for c in UPLOAD_LOG_SCHEMA.names}, "metrics": None}
    if version.rows_train and train:
        metrics = train_all(version.master(spark), os.path.join(state, "models"), **forest)
        if metrics.count() > 0:  # S9: only when at least one model trained
            write_csv(metrics.coalesce(1), os.path.join(state, "models", "metrics_csv"))
        result["metrics"] = metrics
    return result


def _ingest(spark: SparkSession, raw: DataFrame, state: str, key: str, buckets: int) -> Version:
    """Stages the trainable rows once, counting on the way, then merges and commits until nobody came in between."""
    if "row_idx" not in raw.columns:
        raw = raw.withColumn("row_idx", F.monotonically_increasing_id())
    base = latest(spark, state)
    of = base.of if base else buckets
    every, kept = Observation(), Observation()
    number = F.count(F.lit(1)).alias("n")
    # no exchange before the write, so a task that is run again is counted once;
    # the log-cost rule is evaluated on this upload alone
    trainable = with_any_hours(engineer_training(raw.drop("upload_seq").observe(every, number), by=None))
    folder = os.path.join(state, "staging", uuid.uuid4().hex)
    _bucket(trainable.observe(kept, number), of).write.parquet(folder)
    rows_raw, rows_train = (int(o.get.get("n") or 0) for o in (every, kept))
    staged = spark.read.parquet(folder)
    while True:
        seq = base.upload_seq + 1 if base else 0
        columns, held = (base.columns, base.buckets) if base else (None, {})
        if rows_train:
            if base and base.of != of:  # another first upload chose the buckets
                of, staged = base.of, _bucket(staged.drop("bucket"), base.of)
            columns, held = _merged(spark, state, base, staged, seq, of)
        version = Version(seq, key, rows_raw, rows_train, sum(n for _, n in held.values()), of, columns, held)
        if commits.create(spark, _versions(state), f"{seq:08d}.json", json.dumps(version.__dict__)):
            drop_path(spark, folder)
            return version
        base = latest(spark, state)
