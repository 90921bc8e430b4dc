"""Readers and writers for the engine's tables."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hourcast.config import ALL_FEATURES, REQUIRED_TRAINING_COLS
from hourcast.session import path_exists

UPLOAD_LOG_SCHEMA = T.StructType(
    [
        T.StructField("upload_seq", T.LongType()),
        T.StructField("rows_raw", T.LongType()),
        T.StructField("rows_train", T.LongType()),
        T.StructField("rows_master_total", T.LongType()),
    ]
)

METRICS_SCHEMA = T.StructType(
    [
        T.StructField("target", T.StringType()),
        T.StructField("version", T.StringType()),
        T.StructField("rows", T.LongType()),
        T.StructField("mae", T.DoubleType()),
        T.StructField("r2", T.DoubleType()),
        T.StructField("model_path", T.StringType()),
    ]
)


#: Inputs up to this size may be spread over the cores after the scan.
SPREAD_BYTES = 64 << 20


def read_table(spark: SparkSession, sf_dir: str, name: str, balance: bool = True) -> DataFrame:
    """One parquet table of a test-data folder."""
    path = os.path.join(sf_dir, f"{name}.parquet")
    df = spark.read.parquet(path)
    return balanced(df, path) if balance else df


def balanced(df: DataFrame, path: str) -> DataFrame:
    """Spread the rows of a small input over the cores.

    A small file is often one row group, which no split size can divide, so
    the work above its scan would run in one task.  The bound is a number of
    bytes, whatever the cluster's size: never more than that is shuffled.
    """
    spark = df.sparkSession
    return df.repartition(spark.sparkContext.defaultParallelism) if _bytes(spark, path) <= SPREAD_BYTES else df


def require_columns(df: DataFrame, required: list[str], what: str = "input") -> None:
    """Raise ``ValueError`` listing every required column the frame lacks.

    A schema check only: no job runs.
    """
    present = set(df.columns)
    missing = [c for c in required if c not in present]
    if missing:
        raise ValueError(f"Missing required columns in {what}: {missing}")


def require_training_columns(df: DataFrame) -> None:
    require_columns(df, REQUIRED_TRAINING_COLS, "training upload")


def require_quote_columns(df: DataFrame) -> None:
    require_columns(df, ALL_FEATURES, "quote batch")


# The dialect of the source's files: quotes are doubled, text keeps its blanks.
CSV = {"header": True, "quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def read_text(spark: SparkSession, path: str, fmt: str = "csv", multi_line: bool = True) -> DataFrame:
    """All columns as text.  ``multi_line`` reads line breaks inside quotes; larger
    files are then cut by ``quoted_records``, so that many tasks read one file."""
    if fmt == "csv" and multi_line and _is_large(spark, path):
        return quoted_records(spark, path).drop("_file", "_record")
    return _whole_files(spark, path, fmt, multi_line)


def _whole_files(spark: SparkSession, path: str, fmt: str = "csv", multi_line: bool = True) -> DataFrame:
    reader = spark.read.options(**CSV, inferSchema=False, multiLine=multi_line) if fmt == "csv" else spark.read
    return reader.format(fmt).load(path)


def _bytes(spark: SparkSession, path: str) -> int:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(p).getLength()


def _is_large(spark: SparkSession, path: str) -> bool:
    """More than one input split, going by the size."""
    split = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get("spark.sql.files.maxPartitionBytes"))
    return _bytes(spark, path) > split


# A record whose quotes stand around whole fields and are doubled inside them.
_FIELD = r'(?:"[^"]*+(?:""[^"]*+)*+"|[^",]*+)'
_RECORD = rf"^{_FIELD}(?:,{_FIELD})*+$"


def quoted_records(spark: SparkSession, path: str) -> DataFrame:
    """CSV files with line breaks inside quotes, cut into splits: ``_file``, ``_record`` (from 0) and all columns as text.

    A line starts a record when an even number of quotes comes before it in its
    file (doubled quotes leave that as it is).  Each split is read twice: first
    its quotes and its lines after an even and an odd number of its own quotes
    are counted, a row a split; prefixes over these rows then tell each split
    whether it starts inside quotes and the number of its first record.  Lines
    meet in a record by its number, also across splits.  Every file has a
    header; blank lines are no records.  A quote inside a field that is not
    quoted would shift all records after it, so it is an error.
    """
    columns = _whole_files(spark, path).columns
    where = [F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block")]
    lines = spark.read.option("lineSep", "\n").text(path).select("value", *where).withColumn("_id", F.monotonically_increasing_id())
    lines = lines.withColumn("_quotes", F.length("value") - F.length(F.translate("value", '"', "")))
    inside = Window.partitionBy("_file", "_block").orderBy("_id")
    earlier = inside.rowsBetween(Window.unboundedPreceding, -1)
    lines = lines.withColumn("_odd", F.coalesce(F.sum("_quotes").over(earlier), F.lit(0)) % 2)
    filled = ~F.col("value").isin("", "\r")
    starts = lambda odd: filled & (F.col("_odd") == odd)
    splits = lines.groupBy("_file", "_block").agg(
        (F.sum("_quotes") % 2).alias("_turns"), F.count_if(starts(0)).alias("_even_starts"), F.count_if(starts(1)).alias("_odd_starts")
    )
    before = Window.partitionBy("_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.withColumn("_open", F.coalesce(F.sum("_turns").over(before), F.lit(0)) % 2)
    own = F.when(F.col("_open") == 0, F.col("_even_starts")).otherwise(F.col("_odd_starts"))
    splits = splits.withColumn("_first", F.coalesce(F.sum(own).over(before), F.lit(0))).select("_file", "_block", "_open", "_first")
    lines = lines.join(splits, ["_file", "_block"]).withColumn("_starts", F.col("_odd") == F.col("_open"))
    lines = lines.where(~F.col("_starts") | filled)
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    lines = lines.withColumn("_record", F.col("_first") + F.sum(F.col("_starts").cast("bigint")).over(upto) - 1)
    parts = F.array_sort(F.collect_list(F.struct("_block", "_id", "value")))
    records = lines.groupBy("_file", "_record").agg(F.array_join(F.transform(parts, lambda x: x["value"]), "\n").alias("_text"))
    text = F.regexp_replace("_text", "\r$", "")
    records = records.where("_record > 0").select("_file", F.col("_record") - 1, text)
    records = records.toDF("_file", "_record", "_text")
    checked = F.when(F.col("_text").rlike(_RECORD), F.col("_text")).otherwise(
        F.raise_error(F.concat(F.lit("quotes that do not enclose a field, in record "), F.col("_record").cast("string"), F.lit(" of "), F.col("_file")))
    )
    names = [f"c{i}" for i in range(len(columns))]
    options = {k: str(v).lower() if isinstance(v, bool) else v for k, v in CSV.items() if k != "header"} | {"multiLine": "true"}
    row = F.from_csv(checked, ", ".join(f"{n} string" for n in names), options)
    parsed = records.select("_file", "_record", row.alias("_row"))
    return parsed.select("_file", "_record", *[F.col(f"_row.{n}").alias(c) for n, c in zip(names, columns, strict=True)])


def by_file_and_record(df: DataFrame) -> DataFrame:
    """``df`` (``_file``, ``_record``) with ``row_idx``, the place of each row by file name and record; the joined table has a row a file."""
    files = df.groupBy("_file").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)
    files = files.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    return df.join(files, "_file").withColumn("row_idx", F.col("_before") + F.col("_record")).drop("_file", "_record", "_before")


def in_file_order(df: DataFrame, file: str = "_file", block: str = "_block") -> DataFrame:
    """``df`` with ``row_idx``: the place of each row, by file name and then inside the file.

    ``file`` and ``block`` hold where a row was read (they are dropped).  Spark
    reads large files first, so ids alone don't follow file order; inside a
    split they do.  The joined table has one row a split.
    """
    ided = df.withColumn("_id", F.monotonically_increasing_id())
    splits = ided.groupBy(file, block).agg(F.min("_id").alias("_lo"), F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy(file, block).rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    out = ided.join(F.broadcast(splits), [file, block])
    return out.withColumn("row_idx", F.col("_before") + F.col("_id") - F.col("_lo")).drop(file, block, "_id", "_lo", "_before")


def read_projects(spark: SparkSession, path: str, upload_seq: int, fmt: str = "csv", multi_line: bool = True) -> DataFrame:
    """A raw project-hours upload, every column as text.

    Adds ``upload_seq`` (given) and ``row_idx`` (the position by file name and
    inside the file), so that "last row wins" follows file order.
    """
    if fmt == "csv" and multi_line and _is_large(spark, path):
        ordered = by_file_and_record(quoted_records(spark, path))
    else:
        df = _whole_files(spark, path, fmt, multi_line)
        where = [F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block")]
        ordered = in_file_order(df.select([F.col(f"`{c}`").cast("string").alias(c) for c in df.columns] + where))
    return balanced(ordered.withColumn("upload_seq", F.lit(upload_seq).cast("bigint")), path)


def read_quotes(spark: SparkSession, path: str, fmt: str = "csv", multi_line: bool = True) -> DataFrame:
    """A batch of quotes, all columns as text (S4); coerced later by ``prepare_quotes``."""
    df = read_text(spark, path, fmt, multi_line)
    return balanced(df.select([F.col(f"`{c}`").cast("string").alias(c) for c in df.columns]), path)


def read_master(spark: SparkSession, path: str | None, schema: T.StructType | None = None) -> DataFrame | None:
    """The master table (S1); ``None`` when it does not exist yet."""
    if not path or not path_exists(spark, path):
        return None
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(path)


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """Per-target model metrics (S2); empty frame when absent."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], METRICS_SCHEMA)
    return spark.read.schema(METRICS_SCHEMA).options(**CSV).csv(path)


def read_upload_log(spark: SparkSession, path: str) -> DataFrame:
    """Append-only upload log (D4); empty frame when absent."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], UPLOAD_LOG_SCHEMA)
    return spark.read.schema(UPLOAD_LOG_SCHEMA).parquet(path)


def upload_log_tail(log: DataFrame, n: int = 10) -> DataFrame:
    """The last ``n`` uploads in file order (S3): a top-k on ``upload_seq``, oldest first."""
    return log.orderBy(F.col("upload_seq").desc()).limit(n).orderBy("upload_seq")


def preview(df: DataFrame, n: int = 5, order_by: tuple[str, ...] = ("upload_seq", "row_idx")) -> DataFrame:
    """First ``n`` rows in a defined order (S12); file order does not exist in Spark."""
    return df.orderBy(*order_by).limit(n)


def write_table(df: DataFrame, path: str, mode: str = "overwrite") -> str:
    """Write parquet (S7, S8).  Callers pass a fresh version folder when they
    replace a table they are also reading."""
    df.write.mode(mode).parquet(path)
    return path


def write_csv(df: DataFrame, path: str) -> str:
    """CSV export with header (S9, S10): quotes doubled, blanks kept."""
    df.write.mode("overwrite").options(**CSV).csv(path)
    return path
