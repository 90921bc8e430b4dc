"""Helpers shared by the operators: row ids, shared scratch tables, prefix offsets."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

import hourcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hourcast.session import scratch_path

#: White space of the word and normalisation rules: blank and U+0009 to U+000D.
BLANKS = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with underscores added until no column has it (case aside)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def narrow(docs: DataFrame, *extra: str) -> DataFrame:
    """(row, doc_id, text, ...): the columns an operator reads and a row id.

    The row id tells repeated rows and null ids apart.  It is stable over
    re-evaluation when ``docs`` is a stored table, which queries and pipeline
    stages read.
    """
    return docs.select(
        F.monotonically_increasing_id().alias("row"), F.col("doc_id"), F.col("text"), *[F.col(c) for c in extra]
    )


def remainder(doc_id: Column, n: int) -> Column:
    """crc32 of the id written as text, modulo ``n``; a null id counts as ''."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(n).cast("long"))


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the workers, once an application, where their search path lacks it."""
    package, app = Path(hourcast.__file__).parent, spark.sparkContext.applicationId
    if app in _SHIPPED or str(package.parent) in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    packed = Path(tempfile.mkdtemp(prefix="hourcast-")) / "hourcast.zip"
    with zipfile.ZipFile(packed, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    spark.sparkContext.addPyFile(str(packed))
    _SHIPPED.add(app)


class Scratch:
    """Tables written once to the shared folder, so that lineage is cut there.

    ``keep`` writes and rereads; the folder goes when the application ends, or
    earlier by ``drop`` where nothing reads it any more.
    """

    def __init__(self, spark: SparkSession, name: str):
        ship(spark)
        self.spark, self.root = spark, scratch_path(spark, f"llm-{name}-{uuid.uuid4().hex}")
        self._fs, self._path = self._open(self.root)
        self._fs.mkdirs(self._path(self.root))
        self._fs.deleteOnExit(self._path(self.root))

    def _open(self, root):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        return path(root).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def keep(self, df: DataFrame, name: str, *by: str) -> DataFrame:
        where = f"{self.root}/{name}"
        writer = df.write.mode("overwrite")
        (writer.partitionBy(*by) if by else writer).parquet(where)
        return self.spark.read.schema(df.schema).parquet(where) if not by else self.spark.read.parquet(where)

    def drop(self, *names: str) -> None:
        for name in names:
            self._fs.delete(self._path(f"{self.root}/{name}"), True)


def dealt(s: Scratch, rows: DataFrame, h: str, total: int, own: Column | int, bound: int) -> DataFrame:
    """``rows`` (row, ``h``, ...) with a ``bin``: the remainder of the hash ``h`` by ``own``, the number of bins.

    A value of ``h`` that more than ``bound`` rows have goes to bins of its own,
    of some ``bound`` rows each, by row id.  Such values are looked for only among
    the rows of crowded remainders by ``total``, which a count of few groups finds.
    Row ids thus decide nothing but among rows that share a value of ``h``.
    """
    slot = F.pmod(F.col(h), F.lit(total).cast("long"))
    crowded = s.keep(rows.groupBy(slot.alias("slot_")).agg(F.count(F.lit(1)).alias("n_")).where(F.col("n_") > bound).select("slot_"), "crowded")
    among = rows.select(h, slot.alias("slot_")).join(crowded, "slot_", "left_semi")
    often = s.keep(among.groupBy(h).agg(F.count(F.lit(1)).alias("n_")).where(F.col("n_") > bound), "often")
    plain = F.pmod(F.col(h), (F.lit(own) if isinstance(own, int) else own).cast("long"))
    if often.isEmpty():
        return rows.withColumn("bin", plain)
    part = F.pmod(F.xxhash64("row"), F.expr(f"n_ div {bound} + 1"))
    further = total + F.shiftrightunsigned(F.xxhash64(h, part), 2)
    return rows.join(often, h, "left").withColumn("bin", F.when(F.col("n_").isNull(), plain).otherwise(further)).drop("n_")


def offsets(cells: DataFrame, group: list[str], coarse: str, fine: str, value: str, out: str, whole: bool = True) -> DataFrame:
    """``cells`` with the sum of ``value`` over the cells before each, in the order coarse, fine, within ``group``.

    Summed in two steps, so that no task gets all cells of a group: within each
    coarse cell, and over the coarse cells (left out with ``whole`` false).
    """
    coarsely = [*group, coarse]
    before = lambda by, order: W.partitionBy(*by).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    within = cells.withColumn(out, F.coalesce(F.sum(value).over(before(coarsely, fine)), F.lit(0)))
    if not whole:
        return within
    total = cells.groupBy(*coarsely).agg(F.sum(value).alias("all_"))
    total = total.withColumn("start_", F.coalesce(F.sum("all_").over(before(group, coarse)), F.lit(0))).drop("all_")
    return within.join(total, coarsely).withColumn(out, F.col(out) + F.col("start_")).drop("start_")
