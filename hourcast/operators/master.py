"""Upload -> master merge.

Plans at scale:

* F3 is a row-local filter.
* U2 (keep the last row per ``project_id``) is ``max_by`` over a struct keyed
  by ``project_id``: a partial aggregate runs before the shuffle, so a hot
  key (e.g. the null id, or one project resent a million times) is reduced
  to one row per map task before it moves; no window sorts a whole group.
* U3 counts come from one aggregate per upload plus a running sum over a
  table with one row per upload.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hourcast.config import TARGETS
from hourcast.functions.text import to_num

ORDER_COLS = ("upload_seq", "row_idx")


def any_hours(df: DataFrame):
    """Column: any present target column > 0 (coerced, missing -> 0)."""
    present = [t for t in TARGETS if t in df.columns]
    if not present:
        return None
    schema = {f.name: f.dataType for f in df.schema.fields}
    vals = [F.coalesce(to_num(F.col(t), schema[t]), F.lit(0.0)) for t in present]
    return (F.greatest(*vals) if len(vals) > 1 else vals[0]) > 0


def with_any_hours(df: DataFrame) -> DataFrame:
    """keep rows with at least one positive hours value (no-op without targets)."""
    cond = any_hours(df)
    return df if cond is None else df.filter(cond)


def align(df: DataFrame, columns: list[str], types: dict[str, str]) -> DataFrame:
    """Project ``df`` onto ``columns``: missing -> typed null, present -> cast."""
    have = set(df.columns)
    return df.select(
        [
            (F.col(c).cast(types[c]) if c in have else F.lit(None).cast(types[c])).alias(c)
            for c in columns
        ]
    )


def union_uploads(*frames: DataFrame) -> DataFrame:
    """Outer union by name; a column missing on one side is null there.

    Column types are reconciled first (the first frame that has a column
    fixes its type), since an un-cast type clash fails at run time.
    """
    columns: list[str] = []
    types: dict[str, str] = {}
    for df in frames:
        for name, dtype in df.dtypes:
            if name not in types:
                columns.append(name)
                types[name] = dtype
    out = None
    for df in frames:
        part = align(df, columns, types)
        out = part if out is None else out.unionByName(part)
    return out


def dedup_last(df: DataFrame, key: str = "project_id", order: tuple[str, ...] = ORDER_COLS) -> DataFrame:
    """One row per ``key``, the one with the greatest ``order`` tuple.

    Null keys form one group (one null-id row survives).  Without a key
    column the frame is returned unchanged.
    """
    if key not in df.columns:
        return df
    # Spark keeps the first row of each task's part of a key before the shuffle
    # (a window group limit), so a hot key is one row per task
    rn = F.row_number().over(Window.partitionBy(key).orderBy(*[F.col(c).desc() for c in order]))
    return df.withColumn("_rn", rn).filter("_rn = 1").drop("_rn")


def merge_master(master: DataFrame | None, *uploads: DataFrame) -> DataFrame:
    """U1 + U2: append trainable upload rows to the master, last row per project wins.

    ``uploads`` must already be engineered (C11) and filtered (F3): an upload
    row without hours never replaces a master row.
    """
    frames = ([master] if master is not None else []) + list(uploads)
    return dedup_last(union_uploads(*frames))


def upload_counts(raw: DataFrame, train: DataFrame, key: str = "project_id", seq: str = "upload_seq") -> DataFrame:
    """Per upload, ``rows_raw``, ``rows_train`` and ``rows_master_total``.

    ``raw`` holds every uploaded row, ``train`` the rows left after C11+F3;
    both carry ``upload_seq``.  Uploads are applied in ``upload_seq`` order;
    the master after upload *k* holds one row per distinct project id (null
    counting as one) seen in trainable rows of uploads <= *k*.  An upload with
    no trainable row leaves the total unchanged.
    """
    n_raw = raw.groupBy(seq).agg(F.count(F.lit(1)).alias("rows_raw"))
    n_train = train.groupBy(seq).agg(F.count(F.lit(1)).alias("rows_train"))
    # first upload in which each project becomes trainable (partial agg on key)
    if key in train.columns:
        first = train.groupBy(key).agg(F.min(seq).alias(seq))
        new = first.groupBy(seq).agg(F.count(F.lit(1)).alias("new_projects"))
    else:
        new = n_train.withColumnRenamed("rows_train", "new_projects")
    # these three frames have one row per upload: tiny, joined on the upload key
    out = n_raw.join(n_train, seq, "left").join(new, seq, "left")
    running = Window.orderBy(seq).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return out.select(
        F.col(seq).cast("bigint").alias(seq),
        F.col("rows_raw").cast("bigint").alias("rows_raw"),
        F.coalesce(F.col("rows_train"), F.lit(0)).cast("bigint").alias("rows_train"),
        F.sum(F.coalesce(F.col("new_projects"), F.lit(0))).over(running).cast("bigint").alias("rows_master_total"),
    )
