"""Structured Streaming jobs: quotes -> scores, uploads -> master/models.

Uploads run through ``foreachBatch``, so that each micro-batch is an ordinary
DataFrame and the batch operators apply unchanged.  Scoring is a projection but
for the table-level log-cost rule (C5), which asks whether a batch holds any log
cost.  ``score_stream`` asks that of each micro-batch by one small job and then
scores it row by row, without writing it first.  Where it is known of all quotes
(the column is always, or never, filled), ``scored_stream`` is the plain
streaming projection, for any sink.  Progress lives in the streaming
checkpoint folder, so a restarted job resumes after the last committed
micro-batch; outputs are keyed by the stream and the batch id, so a replayed
batch overwrites its output, master version and log row.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from hourcast.operators import scoring
from hourcast.operators.features import log_cost_given, prepare_quotes
from hourcast.plans.upload import ingest_upload
from hourcast.sources.tables import CSV, in_file_order


def text_schema(columns: list[str]) -> T.StructType:
    """All-text schema for file sources (no inference on a stream)."""
    return T.StructType([T.StructField(c, T.StringType()) for c in columns])


def read_text_stream(spark: SparkSession, path: str, columns: list[str], fmt: str = "csv") -> DataFrame:
    """All columns as text, and where each row was read (``_file``, ``_block``)."""
    reader = spark.readStream.schema(text_schema(columns))
    if fmt == "csv":
        reader = reader.options(**CSV, multiLine=True)
    where = [F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block")]
    return reader.format(fmt).load(path).select(*columns, *where)


def scored_stream(quotes: DataFrame, models: list[scoring.OpModel], given: bool) -> DataFrame:
    """C12 + M12 as a projection of ``quotes``, a stream or a table: no aggregate, no exchange, nothing written.

    ``given`` says whether the log costs of the quotes are given; they are derived from the costs otherwise.
    """
    return scoring.score_wide(prepare_quotes(quotes, given), models, prepared=True, truncate=False)


def score_stream(
    spark: SparkSession,
    quotes: DataFrame,
    models_dir: str,
    out_dir: str,
    checkpoint: str,
    key: str = "quote_id",
    available_now: bool = True,
) -> StreamingQuery:
    """Score every new quote file with the twelve forests (M12 per micro-batch)."""
    models = scoring.load_models(spark, models_dir)

    def sink(batch: DataFrame, batch_id: int) -> None:
        quotes = batch.drop("_file", "_block")
        scored = scored_stream(quotes, models, log_cost_given(quotes))
        scored.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").parquet(
            os.path.join(out_dir, f"batch_id={batch_id}")
        )

    w = quotes.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start()


def upload_stream(
    spark: SparkSession,
    uploads: DataFrame,
    state: str,
    checkpoint: str,
    train: bool = True,
    available_now: bool = True,
    **forest,
) -> StreamingQuery:
    """Each micro-batch of project rows is one upload (path A per batch), known
    by the checkpoint folder's name and the batch id.  ``uploads`` comes from
    ``read_text_stream``, so rows keep their file order."""
    stream = os.path.basename(checkpoint.rstrip("/"))

    def sink(batch: DataFrame, batch_id: int) -> None:
        if batch.isEmpty():
            return
        ingest_upload(spark, in_file_order(batch), state, train=train, key=f"{stream}-{batch_id}", **forest)

    w = uploads.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    return w.start()
