"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

A row's key is the hash of its text, so equal texts lie at one place of the
ring.  Every shard has ``vnodes`` virtual nodes; a key belongs to the first
node clockwise.  No shard takes more than ``load`` times the mean of all
bytes: what a full shard can't take continues clockwise to the next node whose
shard has room.  So sizes are near equal (law ``bytes``) whatever one text's
share, every shard holding between 1 - (n - 1)(load - 1) and ``load`` times the
mean, up to a row at each cut; a change of the shard count moves the keys of
the new nodes' arcs and what the bounds push on.

Rows are laid out along the ring as bytes: (arc, bin, place, doc_id).  The
driver sees the sum of each arc (n x vnodes numbers) and cuts arcs into
ranges of bytes; a row goes where its middle byte lies.  Bins deal the rows
of an arc, also those of one text or of one (doc_id, text), to many tasks.

One more shard takes the arcs before its own nodes, a share of 1 / (n + 1); the
tight bound pushes some further rows on between the old shards.

Null and empty text: size 1, key of the empty text.  Null ids come first.
Repeated rows each get a slot.  An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from hourcast.llm.common import Scratch, dealt, narrow, offsets

SHARDS, VNODES, LOAD = 8, 128, 1.002
#: Rows of a bin of an arc, were all rows in one arc.
ROWS_PER_BIN = 200_000
LEAST_BINS = 16


def ring(n: int, vnodes: int) -> tuple[list[int], list[int]]:
    """(places, shards) of the virtual nodes in ring order; places are signed 64-bit."""
    at = lambda s, v: int.from_bytes(hashlib.blake2b(f"{s}/{v}".encode(), digest_size=8).digest(), "big", signed=True)
    nodes = sorted((at(s, v), s) for s in range(n) for v in range(vnodes))
    return [p for p, _ in nodes], [s for _, s in nodes]


def arc_of(key: Column, places: list[int]) -> Column:
    """The index of the first place at or after the key, by halving; past the last place comes the first."""
    held = F.array(*[F.lit(p).cast("long") for p in places])
    halves = F.array(*[F.lit(1 << b) for b in reversed(range(len(places).bit_length()))])
    before = F.aggregate(halves, F.lit(0), lambda at, h: F.when((at + h <= len(places)) & (F.get(held, at + h - 1) < key), at + h).otherwise(at))
    return before % len(places)


def cut(loads: list[int], owners: list[int], n: int, load: float) -> list[tuple[int, int, int, int]]:
    """(arc, from, to, shard): the ranges of bytes of each arc that each shard takes."""
    room = [int(sum(loads) * load / n) + 1] * n
    out, over = [], []
    for arc, (size, s) in enumerate(zip(loads, owners, strict=True)):
        own = min(size, room[s])
        room[s] -= own
        if own:
            out.append((arc, 0, own, s))
        if own < size:
            over.append((arc, own, size))
    for arc, start, end in over:
        node = arc
        while start < end:
            node = (node + 1) % len(owners)
            if take := min(end - start, room[owners[node]]):
                out.append((arc, start, start + take, owners[node]))
                room[owners[node]] -= take
                start += take
    return out


def assign(spark: SparkSession, docs: DataFrame, n: int = SHARDS, vnodes: int = VNODES, load: float = LOAD) -> DataFrame:
    """(row, doc_id, size, text_crc32, shard, slot) of every row."""
    places, owners = ring(n, vnodes)

    s = Scratch(spark, "ring")
    text = F.coalesce("text", F.lit(""))
    d = narrow(docs).select("row", "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("place"))
    rows = s.keep(d.withColumn("arc", arc_of(F.col("place"), places)), "rows")
    bins = LEAST_BINS + rows.count() // ROWS_PER_BIN
    rows = dealt(s, rows.withColumn("h", F.xxhash64("doc_id", "place")), "h", bins, bins, ROWS_PER_BIN).drop("h")

    loads = [0] * len(places)
    for r in rows.groupBy("arc").agg(F.sum("size").alias("b")).collect():  # at most n x vnodes rows
        loads[r["arc"]] = r["b"]
    ranges = cut(loads, owners, n, load) if any(loads) else []
    cuts = spark.createDataFrame(ranges, "arc int, lo long, hi long, shard int")  # at most n x vnodes + 2n rows

    cells = offsets(rows.groupBy("arc", "bin").agg(F.sum("size").alias("b")), [], "arc", "bin", "b", "before", whole=False).drop("b")
    order = W.partitionBy("arc", "bin").orderBy("place", "doc_id", "row")
    placed = (
        rows.withColumn("upto", F.sum("size").over(order.rowsBetween(W.unboundedPreceding, 0)))
        .join(cells, ["arc", "bin"])
        .withColumn("mid", F.expr("before + upto - size + size div 2"))
        .join(F.broadcast(cuts.withColumnRenamed("arc", "cut_arc")), F.expr("arc = cut_arc and mid >= lo and mid < hi"))
        .select("row", "doc_id", "size", "text_crc32", "place", "arc", "bin", "shard")
    )
    placed = s.keep(placed, "placed")
    first = offsets(placed.groupBy("shard", "arc", "bin").agg(F.count(F.lit(1)).alias("n")), ["shard"], "arc", "bin", "n", "first").drop("n")
    in_cell = F.row_number().over(W.partitionBy("shard", "arc", "bin").orderBy("place", "doc_id", "row"))
    return (
        placed.withColumn("k", in_cell)
        .join(first, ["shard", "arc", "bin"])
        .select("row", "doc_id", "size", "text_crc32", "shard", (F.col("first") + F.col("k") - 1).cast("long").alias("slot"))
    )


def op10_bounded_ring(spark: SparkSession, docs: DataFrame) -> DataFrame:
    return assign(spark, docs).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )

