"""Exact dedup through a minimal perfect hash over historical digests.

Texts are equal when they are identical after every character of
``[\\x20\\x09-\\x0D]`` is deleted; null counts as empty.  Of equal texts the row
with the most code points in its original text stays, then the smallest
doc_id, then one of the repeated rows (a null doc_id comes last).

1. Every row becomes (row, doc_id, code points, SHA-256 of the normalised text).
2. ``history`` reduces rows to one winner per digest, with map-side partial
   aggregation, so a text held by a third of all rows is one row per task.
3. ``build_index`` deals the digests to shards and builds a minimal perfect
   hash for each shard: a slot per digest, holding the full digest and the
   winner's locator.  Shards are rows of a Parquet table: any store will do,
   and a lost task rebuilds one shard.
4. ``lookup`` brings rows and shards together, salted by the rows of each
   shard, so that no group grows with a hot text.  A slot counts only if its
   32 bytes equal the row's digest.
5. Rows that the index does not hold are grouped among themselves.

For the dedup of one table, the history is that table's digests that occur
more than once: no other digest can be a repeat.  An empty table gives an
empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hourcast.llm.common import BLANKS, Scratch, fresh, narrow

#: Rows looked up by one group of one task.
ROWS_PER_GROUP = 20_000
#: Bits a key in each level of the perfect hash.
GAMMA = 2.0
LEVELS = 40

INDEX_SCHEMA = "shard long, seeds binary, sizes binary, bits binary, digests binary, keep_row binary, keep_id binary, has_id binary, n binary"


def digests(docs: DataFrame) -> DataFrame:
    """(row, doc_id, n_cp, digest); the digest has 32 bytes."""
    text = F.coalesce("text", F.lit(""))
    d = narrow(docs)
    return d.select(
        "row",
        "doc_id",
        F.length(text).cast("long").alias("n_cp"),
        F.unhex(F.sha2(F.translate(text, BLANKS, "").cast("binary"), 256)).alias("digest"),
    )


def history(rows: DataFrame) -> DataFrame:
    """(digest, keep_row, keep_id, group_size): the winner of each digest."""
    # bitwise not turns the order round without overflow; a null loses against any value
    best = F.max(F.struct("n_cp", F.bitwise_not("doc_id").alias("id"), F.bitwise_not("row").alias("row")))
    return (
        rows.groupBy("digest")
        .agg(best.alias("b"), F.count(F.lit(1)).alias("group_size"))
        .select("digest", F.bitwise_not("b.row").alias("keep_row"), F.bitwise_not("b.id").alias("keep_id"), "group_size")
    )


# --- the perfect hash of one shard ------------------------------------------


def _mix(words: np.ndarray, seed: int) -> np.ndarray:
    """64 mixed bits of each digest under a seed."""
    x = words[:, 0] ^ (words[:, 1] * np.uint64(0x9E3779B97F4A7C15)) ^ np.uint64((seed * 0xD1B54A32D192ED03) & (2**64 - 1))
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


def _words(packed: bytes) -> np.ndarray:
    return np.frombuffer(packed, dtype="<u8").reshape(-1, 4)


def build_mph(packed: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(seeds, sizes, bits) for distinct 32-byte digests.

    At each level the remaining keys are hashed to GAMMA bits a key; a key
    alone on its bit takes it, the others go to the next level.  A key's slot
    is the number of set bits before its own, over all levels.
    """
    left, seeds, sizes, bits = _words(packed), [], [], []
    for seed in range(1, 10**6):
        if not len(left):
            break
        if len(seeds) == LEVELS:
            raise ValueError("equal digests in an index shard")
        m = max(64, int(GAMMA * len(left)))
        at = _mix(left, seed) % np.uint64(m)
        once = np.bincount(at.astype(np.int64), minlength=m) == 1
        seeds, sizes, bits = [*seeds, seed], [*sizes, m], [*bits, once]
        left = left[~once[at.astype(np.int64)]]
    return np.array(seeds, "<i8"), np.array(sizes, "<i8"), np.concatenate(bits) if bits else np.zeros(0, bool)


def slots(words: np.ndarray, seeds: np.ndarray, sizes: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """The slot of each key, -1 where no level takes it (never for a member)."""
    rank = np.concatenate([[0], np.cumsum(bits)])
    out, open_, start = np.full(len(words), -1, np.int64), np.arange(len(words)), 0
    for seed, m in zip(seeds.tolist(), sizes.tolist(), strict=True):
        at = start + (_mix(words[open_], seed) % np.uint64(m)).astype(np.int64)
        hit = bits[at]
        out[open_[hit]] = rank[at[hit]]
        open_, start = open_[~hit], start + m
    return out


def _build_shard(pdf: pd.DataFrame) -> pd.DataFrame:
    packed = b"".join(pdf["digest"])
    seeds, sizes, bits = build_mph(packed)
    at = slots(_words(packed), seeds, sizes, bits)
    order = np.empty(len(at), np.int64)
    order[at] = np.arange(len(at))
    has = pdf["keep_id"].notna().to_numpy()
    ids = pdf["keep_id"].fillna(0).to_numpy("<i8")
    return pd.DataFrame(
        {
            "shard": [int(pdf["shard"].iloc[0])],
            "seeds": [seeds.tobytes()],
            "sizes": [sizes.tobytes()],
            "bits": [np.packbits(bits).tobytes()],
            "digests": [_words(packed)[order].tobytes()],
            "keep_row": [pdf["keep_row"].to_numpy("<i8")[order].tobytes()],
            "keep_id": [ids[order].tobytes()],
            "has_id": [has[order].astype(np.uint8).tobytes()],
            "n": [pdf["group_size"].to_numpy("<i8")[order].tobytes()],
        }
    )


def _shard_of(n_shards: int):
    return F.pmod(F.xxhash64("digest"), F.lit(n_shards).cast("long"))


def build_index(hist: DataFrame, n_shards: int) -> DataFrame:
    """One row per shard that has digests: the hash's levels and its slots."""
    return hist.withColumn("shard", _shard_of(n_shards)).groupBy("shard").applyInPandas(_build_shard, INDEX_SCHEMA)


LOOKUP_SCHEMA = "row long, doc_id long, n_cp long, digest binary, member boolean, keep_row long, keep_id long, group_size long"


def _lookup_group(rows: pd.DataFrame, index: pd.DataFrame) -> pd.DataFrame:
    out = rows[["row", "doc_id", "n_cp", "digest"]].astype({"doc_id": "Int64"})
    member = np.zeros(len(rows), bool)
    keep_row, keep_id, has, n = (np.zeros(len(rows), np.int64) for _ in range(4))
    if len(rows) and len(index):
        x = index.iloc[0]
        sizes, words = np.frombuffer(x["sizes"], "<i8"), _words(b"".join(rows["digest"]))
        bits = np.unpackbits(np.frombuffer(x["bits"], np.uint8), count=int(sizes.sum())).astype(bool)
        at, held = slots(words, np.frombuffer(x["seeds"], "<i8"), sizes, bits), _words(x["digests"])
        member = (at >= 0) & (held[at] == words).all(axis=1)  # all 32 bytes
        for to, name, kind in ((keep_row, "keep_row", "<i8"), (keep_id, "keep_id", "<i8"), (has, "has_id", np.uint8), (n, "n", "<i8")):
            to[member] = np.frombuffer(x[name], kind)[at[member]]
    unset = lambda values, known: pd.Series(pd.arrays.IntegerArray(values, ~known), index=out.index)
    return out.assign(
        member=member,
        keep_row=unset(keep_row, member),
        keep_id=unset(keep_id, member & (has == 1)),
        group_size=unset(n, member),
    )


def lookup(rows: DataFrame, index: DataFrame, n_shards: int) -> DataFrame:
    """Each row with its index entry, or ``member`` false."""
    rows = rows.withColumn("shard", _shard_of(n_shards))
    # a row per shard, of 16 bytes: R / ROWS_PER_GROUP of them for R rows
    salts = rows.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / ROWS_PER_GROUP).cast("long").alias("salts"))
    dealt = rows.join(salts, "shard").withColumn("salt", F.pmod(F.xxhash64("row"), "salts")).drop("salts")
    spread = index.join(salts, "shard").withColumn("salt", F.explode(F.expr("sequence(0L, salts - 1)"))).drop("salts")
    return dealt.groupBy("shard", "salt").cogroup(spread.groupBy("shard", "salt")).applyInPandas(_lookup_group, LOOKUP_SCHEMA)


# --- the operator ------------------------------------------------------------


def dedup(spark: SparkSession, docs: DataFrame, seen: DataFrame | None = None) -> DataFrame:
    """(row, doc_id, keep_row, keep_id, group_size, kept, digest), one row per row of ``docs``.

    ``seen`` (digest, keep_row, keep_id, group_size): winners of earlier
    tables; rows equal to one of them are not kept.  Without it, the history
    is this table's own repeated digests.
    """
    s = Scratch(spark, "exact")
    rows = s.keep(digests(docs), "digests")
    own = seen is None
    hist = history(rows).where("group_size > 1") if own else seen
    n_shards = max(1, -(-rows.count() // ROWS_PER_GROUP))
    index = s.keep(build_index(hist, n_shards), "index")
    found = s.keep(lookup(rows, index, n_shards), "found")
    kept = F.col("row") == F.col("keep_row") if own else F.lit(False)
    members = found.where("member").withColumn("kept", kept)
    rest = found.where("not member").select("row", "doc_id", "n_cp", "digest")
    alone = rest.join(history(rest), "digest").withColumn("kept", F.col("row") == F.col("keep_row"))
    cols = ["row", "doc_id", "keep_row", "keep_id", "group_size", "kept", "digest"]
    return members.select(*cols).unionByName(alone.select(*cols))


def op7_exact_dedup(spark: SparkSession, docs: DataFrame) -> DataFrame:
    out = dedup(spark, docs)
    return out.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the repeats, all columns kept."""
    row = fresh(docs, "_row")
    kept = dedup(spark, docs).where("kept").select(F.col("row").alias(row))
    return docs.withColumn(row, F.monotonically_increasing_id()).join(kept, row, "left_semi").select(*docs.columns)


#: Where the digest is grouped by SQL.
ORACLE = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS t
  FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER (PARTITION BY t ORDER BY n DESC, doc_id) AS keep_id,
       count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = first_value(doc_id) OVER (PARTITION BY t ORDER BY n DESC, doc_id) AS kept,
       sha256(t) AS text_sha256
FROM d
"""
