"""A bounded, repeatable sample of labelled rows, for fitting.

Rows are drawn by a hash of their row id, never of ``doc_id``: one id may stand
on all rows, or none.  A label's sample has exactly ``most`` rows, or all where
it has fewer, for every label that occurs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def by_label(rows: DataFrame, label: str, most: int) -> tuple[DataFrame, dict]:
    """(row, label) of ``most`` rows for each value of ``label`` in (row, label), and the share taken of each.

    A null label is left out.  Only rows whose hash lies so low that about
    2 * most + 50 of a label do are ranked, so no task gets all rows of a label;
    that these are fewer than ``most`` has a chance below 1e-9 (then there are a
    few rows less).
    """
    rows = rows.where(F.col(label).isNotNull())
    counts = {r[0]: r[1] for r in rows.groupBy(label).count().collect()}  # a row a label
    if not counts:
        return rows.select("row", label).limit(0), {}
    below = F.create_map(*[F.lit(v) for x, n in counts.items() for v in (x, int(min(1.0, (2 * most + 50) / n) * (1 << 40)))])
    drawn = F.pmod(F.xxhash64("row", F.lit(17)), F.lit(1 << 40))
    low = rows.select("row", label, drawn.alias("drawn_")).where(F.col("drawn_") < F.element_at(below, F.col(label)))
    ranked = low.select("row", label, F.row_number().over(W.partitionBy(label).orderBy("drawn_", "row")).alias("rank_"))
    return ranked.where(F.col("rank_") <= most).drop("rank_"), {x: min(1.0, most / n) for x, n in counts.items()}


def one_label(labels: DataFrame, label: str) -> DataFrame:
    """(doc_id, label): the 0 or 1 that most rows of an id have; ids without a majority or with null are left out."""
    balance = F.sum(2 * F.col(label).cast("int") - 1)
    sums = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(balance.alias("b_"))
    return sums.where("b_ <> 0").select("doc_id", (F.col("b_") > 0).cast("int").alias(label))


def texts(docs: DataFrame, labels: DataFrame, label: str, most: int) -> tuple[DataFrame, dict]:
    """(row, doc_id, text, label) of a sample of the rows of ``docs`` (row, doc_id, text) whose id has a label.

    Of the labelled rows only row ids are shuffled; the drawn ones, ``most``
    for each of two labels, are sent to where the texts are.
    """
    chosen, share = by_label(docs.select("row", "doc_id").join(one_label(labels, label), "doc_id").select("row", label), label, most)
    return docs.join(F.broadcast(chosen), "row"), share
