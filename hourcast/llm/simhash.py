"""SimHash fingerprints (DataFrame operations only).

Terms are the words of the lower-cased text.  Each term's 64-bit hash votes on
the 64 bits, for a set bit or against it, with the term's length in code points
as its weight, once for each occurrence.  A bit is set when more than half of
the text's weight is for it; a text without words has fingerprint 0.  Likeness
is the share of equal bits.

Votes are summed two to a long (bit j low, bit j + 32 high), in 32 sums, so a
text needs one aggregated row whatever its length: 2^31 code points fit.

``edits`` brings each document together with the next one by (doc_id, hash of
the text, text): documents are dealt to ranges of doc_id, and each range also
gets a copy of the first row of the range after it (of the first range, for
the last).  An id that many rows have, or no id, is a range of its own, cut
into slices of the hash.  So one shuffle of the texts serves the edit, the
votes and the comparison with the next fingerprint.  Null ids come first.  Equal rows follow one another.
One document is its own next.  An empty table gives an empty result.

``links`` finds all pairs of distinct fingerprints within a Hamming radius r:
bits are cut into r + 3 blocks, and any r differing bits leave 3 blocks
untouched, so each choice of 3 blocks is a permuted table whose leading bits
are joined on, and the whole fingerprints are compared.  A (table, key) cell of
more than CELL fingerprints is split: each of its parts meets the whole cell.

The query writes its rows once, searches the distinct fingerprints of all of
them and gives each document the number of other fingerprints within RADIUS
and of other documents whose fingerprint is equal or within RADIUS.
"""

from __future__ import annotations

from collections import Counter
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from hourcast.llm.common import Scratch

BITS, RADIUS, SPARE_BLOCKS = 64, 3, 3
CELL = 1000
WORDS = r"[\x20\x09-\x0D]+"
LANES = [f"v{j}" for j in range(32)]


def ranges(spark: SparkSession, docs: DataFrame) -> tuple[list[int], list[int]]:
    """Bounds that deal the ids to ranges of like counts, and the slices of each range: of null ids, below the first bound, from each bound on."""
    n = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    ids = F.col("doc_id").cast("long")
    got, rows, with_id = docs.agg(F.percentile_approx(ids, [i / n for i in range(1, n)], 100 * n), F.count(F.lit(1)), F.count(ids)).first()
    found = Counter(got or [])
    often = {i: k for i, k in found.items() if k > 1}  # an id of more than a range's share
    bounds = sorted({*found, *[i + 1 for i in often if i < 2**63 - 1]})
    return bounds, [max(1, (rows - with_id) * n // max(rows, 1)), 1, *[often.get(b, 1) for b in bounds]]


def edits(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """(part, at, extra, doc_id, text, edited), text without null; extra rows stand for the next range's first."""
    bounds, slices = ranges(spark, docs)
    below = F.size(F.filter(F.array(*[F.lit(b).cast("long") for b in bounds]), lambda b: b <= F.col("doc_id"))) if bounds else F.lit(0)
    d = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    d = d.withColumn("range", F.when(F.col("doc_id").isNull(), 0).otherwise(below + 1))
    held = F.get(F.array(*[F.lit(k).cast("long") for k in slices]), F.col("range"))
    # the hash's upper 20 bits in ascending order, times the slices
    slice_ = F.shiftright((F.shiftright("h", 44) + (1 << 19)) * held, 20)
    d = d.withColumn("part", F.col("range") * (1 << 20) + slice_).drop("range")
    # one row for each range: the range before it and where it begins
    first = d.groupBy("part").agg(F.min(F.struct("doc_id", "h")).alias("first"))
    around = W.orderBy("part")
    first = first.select(F.coalesce(F.lag("part").over(around), F.max("part").over(W.partitionBy())).alias("to"), F.col("part").alias("of"), "first")
    heads = d.join(F.broadcast(first), (F.col("part") == F.col("of")) & F.struct("doc_id", "h").eqNullSafe(F.col("first")))
    heads = heads.groupBy("to").agg(F.min("text").alias("text"))
    heads = heads.select(F.lit(None).cast(docs.schema["doc_id"].dataType).alias("doc_id"), "text", F.lit(None).cast("long").alias("h"), F.col("to").alias("part"), F.lit(True).alias("extra"))
    order = W.partitionBy("part").orderBy("extra", F.col("doc_id").asc_nulls_first(), "h", "text")
    both = d.withColumn("extra", F.lit(False)).unionByName(heads)
    both = both.withColumn("at", F.row_number().over(order)).withColumn("next", F.lead("text").over(order)).drop("h")
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), F.length("text") - half), F.substring(F.col("next"), F.lit(1), half))
    return both.select("part", "at", "extra", "doc_id", "text", F.when(~F.col("extra"), edited).alias("edited"))


def fingerprints(texts: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """``keys`` and ``fp`` (long), a row for each distinct ``keys``."""
    words = texts.select(*keys, F.explode_outer(F.split(F.lower(text), WORDS)).alias("w"))
    words = words.select(*keys, F.xxhash64("w").alias("h"), F.length(F.coalesce("w", F.lit(""))).cast("long").alias("weight"))
    lane = lambda j: F.shiftright("h", j).bitwiseAND(F.lit(0x0000000100000001)) * F.col("weight")
    votes = words.groupBy(*keys).agg(F.sum("weight").alias("all"), *[F.sum(lane(j)).alias(v) for j, v in enumerate(LANES)])
    return votes.select(*keys, decided().alias("fp"))


def decided() -> Column:
    low = lambda v: F.col(v).bitwiseAND(F.lit(0xFFFFFFFF))
    high = lambda v: F.shiftrightunsigned(v, 32)
    bits = [(half(v), j + k) for j, v in enumerate(LANES) for half, k in ((low, 0), (high, 32))]
    signed = lambda b: (1 << b) - (1 << 64 if b == 63 else 0)
    out = F.lit(0).cast("long")
    for sum_, b in bits:
        out = out.bitwiseOR(F.when(sum_ * 2 > F.col("all"), F.lit(signed(b)).cast("long")).otherwise(F.lit(0).cast("long")))
    return out


def likeness(a: str, b: str) -> Column:
    return 1 - F.bit_count(F.col(a).bitwiseXOR(F.col(b))) / BITS


def shown(fp: str) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def op8_simhash(spark: SparkSession, docs: DataFrame) -> DataFrame:
    e = edits(spark, docs)
    versions = F.array(F.struct(F.lit(0).alias("kind"), F.col("text")), F.struct(F.lit(1).alias("kind"), F.col("edited").alias("text")))
    own = ["part", "at", "extra", "doc_id"]
    v = e.select(*own, F.length("text").cast("long").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), F.explode(versions).alias("v"))
    v = v.where("not extra or v.kind = 0").select(*own, "n_chars", "edited_sha256", "v.kind", "v.text")
    own += ["n_chars", "edited_sha256"]
    fps = fingerprints(v, [*own, "kind"])
    # both versions and all of a range lie in one partition: no more shuffles
    d = fps.groupBy(*own).agg(F.max(F.when(F.col("kind") == 0, F.col("fp"))).alias("fp"), F.max(F.when(F.col("kind") == 1, F.col("fp"))).alias("edited_fp"))
    d = d.withColumn("next_fp", F.lead("fp").over(W.partitionBy("part").orderBy("at"))).where("not extra")
    d = Scratch(spark, "simhash").keep(d.select("doc_id", "n_chars", "edited_sha256", "fp", "edited_fp", "next_fp"), "fingerprints")
    return d.join(neighbours(d), "fp", "left").select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        shown("fp").alias("fingerprint"),
        shown("edited_fp").alias("edited_fingerprint"),
        likeness("fp", "edited_fp").alias("near_edited"),
        likeness("fp", "next_fp").alias("near_next"),
        "near_fingerprints",
        "near_docs",
    )


def tables(radius: int, bits: int = BITS) -> list[int]:
    """The mask of each permuted table's leading blocks."""
    n = radius + SPARE_BLOCKS
    edges = [bits * i // n for i in range(n + 1)]
    block = [(1 << edges[i + 1]) - (1 << edges[i]) for i in range(n)]
    masks = [sum(chosen) for chosen in combinations(block, SPARE_BLOCKS)]
    return [m - (1 << 64) if m >= 1 << 63 else m for m in masks]


def pairs(one: DataFrame, radius: int) -> DataFrame:
    """(a, a_copies, b, b_copies, distance), a < b, of distinct fingerprints ``one`` (fp, copies), each pair from the first table it meets in."""
    if radius < 0 or radius > BITS - SPARE_BLOCKS:
        raise ValueError("the radius must lie between 0 and 61")
    masks = F.array(*[F.lit(m).cast("long") for m in tables(radius)])
    dealt = one.select("fp", "copies", F.posexplode(masks).alias("t", "mask")).select("t", F.col("fp").bitwiseAND(F.col("mask")).alias("key"), "fp", "copies")
    # counts are summed before the shuffle, so no task holds a cell whole
    cells = dealt.join(dealt.groupBy("t", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), ["t", "key"])
    parts = F.ceil(F.col("n") / CELL)
    a = cells.select("t", "key", F.pmod(F.xxhash64("fp"), parts).alias("part"), F.col("fp").alias("a"), F.col("copies").alias("a_copies"))
    b = cells.select("t", "key", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("part"), F.col("fp").alias("b"), F.col("copies").alias("b_copies"))
    differ = F.col("a").bitwiseXOR(F.col("b"))
    near = (F.col("a") < F.col("b")) & (F.bit_count(differ) <= radius)
    earlier = F.exists(F.slice(masks, F.lit(1), F.col("t")), lambda m: differ.bitwiseAND(m) == 0)
    return a.join(b, ["t", "key", "part"]).where(near & ~earlier).select("a", "a_copies", "b", "b_copies", F.bit_count(differ).alias("distance"))


def distinct(fps: DataFrame) -> DataFrame:
    return fps.where("fp is not null").groupBy("fp").agg(F.count(F.lit(1)).alias("copies"))


def links(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b, distance), a < b: all pairs of distinct fingerprints ``fp`` within the radius."""
    return pairs(distinct(fps), radius).select("a", "b", "distance")


def neighbours(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(fp, near_fingerprints, near_docs): how many other fingerprints and other rows of ``fps`` lie within the radius of each."""
    one = distinct(fps)
    ends = [F.struct(F.col(x).alias("fp"), F.lit(1).alias("fps"), F.col(f"{y}_copies").alias("docs")) for x, y in ("ab", "ba")]
    found = pairs(one, radius).select(F.explode(F.array(*ends)).alias("x")).select("x.*")
    found = found.unionByName(one.select("fp", F.lit(0).alias("fps"), (F.col("copies") - 1).alias("docs")))
    return found.groupBy("fp").agg(F.sum("fps").alias("near_fingerprints"), F.sum("docs").alias("near_docs"))
