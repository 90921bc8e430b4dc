"""Near-duplicate groups by bottom-k sketches of one hash function.

A document's set is its distinct ``width``-word shingles (lower-cased words; a
shorter text is one shingle; no words, no set).  Documents whose sets have a
Jaccard likeness of ``percent`` or more are linked.  A component is named by
the smallest doc_id in it.

1. Equal sets become one representative; what follows is about these.
2. A set's sketch is its K smallest hashes.  Of the K smallest hashes of a
   union, those in both sets are in both sketches; their number is that of a
   draw of K from the union.  ``shared(K, percent)`` is what it reaches but for
   one linked pair in 10^9, and all linked pairs up to K * percent / 100
   shingles, whose sketches are the sets.
3. Retained values make inverted lists, rarest values first.  Two sketches
   that share s of their values share one of the first K - s + 1; a document
   enters those lists only.  A document with more values of its own than that
   has no link at all.  So a passage that many documents share matters only
   to documents which consist of such passages.
4. Rounds over the lists link documents to a pivot of each list, the one whose
   shingles are the commonest and so the nearest to the middle of its group: a
   group of n near copies costs some n comparisons, not n * n.  Of lists of up
   to SMALL documents all pairs are compared.  The union-sketch estimate
   filters pairs, the full sets decide.  Lists within one component are done.
5. What is still open in longer lists is settled on full sets: two sets that
   are alike enough share one of their rarest shingles, so many of them that
   the rest could not make up the likeness.  A set's shingles that no other
   open set has bound what it can share with any set, so documents far from
   the middle meet no one.  All pairs that are left, lie in different
   components and weren't compared yet are: no link is lost.
6. Components come from hooking each onto its least neighbour and jumping.

Null ids come last when a group is named; repeated rows are copies, and just
one of them is kept by ``stage``.  Texts without words are kept.  An empty
table gives an empty result.  Sets are of 64-bit hashes of shingles.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hourcast.llm import words
from hourcast.llm.common import Scratch, fresh, narrow

K = 64
#: Rounds with one pivot a list; lists of which all pairs are compared at once.
PIVOT_ROUNDS, SMALL = 2, 8
#: A linked pair is missed with less than this chance.
MISS = 1e-9

SKETCHES = "row long, doc_id long, n long, digest binary, sketch array<long>"


def shared(k: int, percent: int) -> int:
    """The values that the sketches of a linked pair share at least, but for the chance MISS."""
    p, chance = percent / 100, 0.0
    for s in range(k + 1):
        chance += comb(k, s) * p**s * (1 - p) ** (k - s)
        if chance > MISS:
            return max(1, s)
    return k


def sketches(docs: DataFrame, width: int, k: int = K) -> DataFrame:
    """(row, doc_id, n, digest, sketch): the size of each set, its digest and its k least hashes; null without a set."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, bounds in words.runs(batch.column("text")):
                n, digest, sketch = [], [], []
                for own in words.shingles(*words.word_hashes(data, bounds), width):
                    n.append(len(own))
                    digest.append(hashlib.blake2b(own.tobytes(), digest_size=16).digest() if len(own) else None)
                    sketch.append(own[:k] if len(own) else None)
                keys = [batch.column(c).slice(first, end - first).cast(pa.int64()) for c in ("row", "doc_id")]
                columns = [pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(sketch, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([*keys, *columns], names=["row", "doc_id", "n", "digest", "sketch"])

    return narrow(docs).mapInArrow(each, SKETCHES)


def full_sets(docs: DataFrame, width: int) -> DataFrame:
    """(sid, whole): all hashes of each row's set; ``docs`` has sid and text."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, bounds in words.runs(batch.column("text")):
                sets = list(words.shingles(*words.word_hashes(data, bounds), width))
                yield pa.RecordBatch.from_arrays([batch.column("sid").slice(first, end - first), pa.array(sets, pa.list_(pa.int64()))], names=["sid", "whole"])

    return docs.select("sid", "text").mapInArrow(each, "sid long, whole array<long>")


def inverted(reps: DataFrame, s: Scratch, k: int, percent: int) -> DataFrame:
    """(v, sid): the lists that a linked pair meets in, one of them at least."""
    postings = reps.select("sid", "n", F.explode("sketch").alias("v"))
    counts = postings.groupBy("v").agg(F.count(F.lit(1)).alias("f")).where("f > 1")
    common = postings.join(counts, "v").groupBy("sid", "n").agg(F.array_sort(F.collect_list(F.struct("f", "v"))).alias("values"))
    held = F.least("n", F.lit(k))
    small = F.expr(f"(n * {percent} + 99) div 100")
    needed = F.when(F.col("n") * 100 <= k * percent, small).otherwise(F.lit(shared(k, percent)))
    # values that no one else has come first of all
    length = held - needed + 1 - (held - F.size("values"))
    lists = common.where(length > 0).select("sid", F.explode(F.slice("values", F.lit(1), length.cast("int"))).alias("x"))
    return s.keep(lists.select("x.v", "sid"), "lists")


def estimated(pairs: DataFrame, reps: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose union sketch does not rule a link out."""
    of = lambda c, n, x: reps.select(F.col("sid").alias(c), F.col("n").alias(n), F.col("sketch").alias(x))
    both = pairs.join(of("a", "na", "x"), "a").where("x is not null").join(of("b", "nb", "y"), "b")
    both = both.where((F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent))
    union = F.slice(F.array_sort(F.array_union("x", "y")), 1, k)
    both = both.withColumn("common", F.size(F.array_intersect(F.array_intersect("x", "y"), union))).withColumn("drawn", F.size(union))
    # where both sketches are the sets, and their union no longer than a sketch, this is the likeness itself
    least = F.when((F.col("drawn") < k), F.expr(f"(drawn * {percent} + 99) div 100")).otherwise(F.lit(shared(k, percent)))
    return both.where(F.col("common") >= least).select("a", "b")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets are alike enough."""
    both = pairs.join(sets.withColumnRenamed("sid", "b").withColumnRenamed("whole", "y"), "b")
    both = both.join(sets.withColumnRenamed("sid", "a").withColumnRenamed("whole", "x"), "a")
    both = both.withColumn("i", F.size(F.array_intersect("x", "y")))
    linked = both.where(F.col("i") * 100 >= percent * (F.size("x") + F.size("y") - F.col("i")))
    return linked.select("a", "b")


def ranked(sets: DataFrame) -> DataFrame:
    """(sid, rare, middle): each set's shingles with their frequencies among ``sets``, the rarest first, and the sum of those."""
    whole = sets.select("sid", F.explode("whole").alias("g"))
    df = whole.groupBy("g").agg(F.count(F.lit(1)).alias("df"))
    return whole.join(df, "g").groupBy("sid").agg(F.array_sort(F.collect_list(F.struct("df", "g"))).alias("rare"), F.sum("df").alias("middle"))


def rare_pairs(open_: DataFrame, rank: DataFrame, percent: int) -> DataFrame:
    """(a, b) of different components ``c`` that share a shingle rare enough, among the sets of ``open_`` (sid, c)."""
    each = open_.join(rank, "sid").select("sid", "c", "rare", F.size("rare").alias("n"), F.size(F.filter("rare", lambda x: x["df"] == 1)).alias("own"))
    # of a pair, the larger set shares percent of itself, the smaller 2 percent / (1 + percent)
    probe = F.col("n") - F.expr(f"(n * {percent} + 99) div 100") + 1
    index = F.col("n") - F.expr(f"(n * {2 * percent} + {99 + percent}) div {100 + percent}") + 1
    kept = each.withColumn("index", index).select("sid", "c", "n", "own", "index", F.posexplode(F.slice("rare", F.lit(1), probe.cast("int"))).alias("at", "x"))
    # where two sets meet in the first shingle that they share, they share what comes from there on at most
    kept = kept.where("at >= own").select("sid", "c", "n", (F.col("n") - F.col("at")).alias("most"), F.col("x.g").alias("g"), (F.col("at") < F.col("index")).alias("indexed"))
    of = lambda k: kept.select("g", "indexed", *[F.col(c).alias(f"{c}{k}") for c in ("sid", "c", "n", "most")])
    least = F.least("most1", "most2")
    could = (least * 100 >= percent * (F.col("n1") + F.col("n2") - least)) & (F.col("n1") * 100 >= percent * F.col("n2"))
    ordered = (F.col("n1") < F.col("n2")) | ((F.col("n1") == F.col("n2")) & (F.col("sid1") < F.col("sid2")))
    met = of(1).where("indexed").drop("indexed").join(of(2).drop("indexed"), "g").where(ordered & could & (F.col("c1") != F.col("c2")))
    return met.select(F.least("sid1", "sid2").alias("a"), F.greatest("sid1", "sid2").alias("b")).distinct()


def components(edges: DataFrame, s: Scratch, name: str) -> DataFrame:
    """(node, root): each node of ``edges`` (a, b) with the least node that it reaches."""
    edges = s.keep(edges, f"{name}-e0")
    roots = None
    for k in range(1, 100):
        ways = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooks = s.keep(ways.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("to")).withColumnRenamed("a", "node"), f"{name}-h{k}")
        for j in range(1, 100):  # jump until every hook points at a root
            nxt = hooks.alias("x").join(hooks.select(F.col("node").alias("to"), F.col("to").alias("far")), "to").select("node", F.col("far").alias("to"), (F.col("far") != F.col("to")).alias("moved"))
            nxt = s.keep(nxt, f"{name}-h{k}-{j}")
            hooks = nxt.drop("moved")
            if not nxt.where("moved").limit(1).count():
                break
        if roots is None:
            roots = hooks.withColumnRenamed("to", "root")
        else:
            roots = roots.join(hooks.select(F.col("node").alias("root"), "to"), "root", "left").select("node", F.coalesce("to", "root").alias("root"))
        roots = s.keep(roots, f"{name}-r{k}")
        of = lambda c: hooks.select(F.col("node").alias(c), F.col("to").alias(f"r{c}"))  # noqa: B023, E731
        edges = s.keep(edges.join(of("a"), "a").join(of("b"), "b").where("ra != rb").select(F.col("ra").alias("a"), F.col("rb").alias("b")).distinct(), f"{name}-e{k}")
        if not edges.limit(1).count():
            return roots
    raise RuntimeError("components did not settle")


def link_lists(spark: SparkSession, lists: DataFrame, reps: DataFrame, texts: DataFrame, width: int, percent: int, k: int, s: Scratch) -> DataFrame:
    """(sid, c): the component of every representative in the lists."""
    comp = s.keep(lists.select("sid").distinct().withColumn("c", F.col("sid")), "comp0")
    # dealt by sid once, so that later joins with pairs move the pairs alone
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sets = full_sets(texts.join(comp, "sid", "left_semi"), width).repartition(n, "sid").persist(StorageLevel.DISK_ONLY)
    # long lists: the middle of a group is where its commonest shingles are
    long_sids = lists.join(lists.groupBy("v").agg(F.count(F.lit(1)).alias("f")).where(F.col("f") > SMALL), "v").select("sid").distinct()
    rank = s.keep(ranked(sets.join(long_sids, "sid", "left_semi")), "ranked")
    lists = s.keep(lists.join(rank.select("sid", "middle"), "sid", "left"), "middles")
    tested = None
    for r in range(1, PIVOT_ROUNDS + 2):
        named = lists.join(comp, "sid")
        order = F.struct("middle", "sid", "c")
        open_ = named.groupBy("v").agg(F.max(order).alias("p"), F.count(F.lit(1)).alias("f"), F.min("c").alias("c0"), F.max("c").alias("c1")).where("c0 != c1")
        open_ = s.keep(named.join(open_.select("v", "f", F.col("p.c").alias("first_c")), "v"), f"open{r}")
        long_ = open_.where(F.col("f") > SMALL)
        if r <= PIVOT_ROUNDS:
            # after the first round the pivot is one that the first pivot didn't reach
            among = long_ if r == 1 else long_.where("c != first_c")
            pivots = among.groupBy("v").agg(F.max(order).alias("p")).select("v", F.col("p.sid").alias("pivot"), F.col("p.c").alias("pc"))
            star = long_.join(pivots, "v").where("c != pc")
            pairs = star.select(F.least("sid", "pivot").alias("a"), F.greatest("sid", "pivot").alias("b"))
        else:
            pairs = rare_pairs(long_.select("sid", "c").distinct(), rank, percent)
        if r == 1:
            of = lambda a: open_.where(F.col("f") <= SMALL).select("v", F.col("sid").alias(a))  # noqa: B023, E731
            pairs = pairs.unionByName(of("a").join(of("b"), "v").where("a < b").select("a", "b"))
        pairs = pairs.distinct()
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs = s.keep(pairs, f"pairs{r}")
        near = s.keep(estimated(pairs, reps, k, percent), f"near{r}")
        links = s.keep(confirmed(near, sets, percent), f"links{r}")
        # between components as they stand
        of = lambda c: comp.select(F.col("sid").alias(c), F.col("c").alias(f"c{c}"))  # noqa: B023, E731
        edges = s.keep(links.join(of("a"), "a").join(of("b"), "b").where("ca != cb").select(F.col("ca").alias("a"), F.col("cb").alias("b")).distinct(), f"edges{r}")
        if edges.limit(1).count():
            roots = components(edges, s, f"cc{r}")
            comp = s.keep(comp.join(roots.withColumnRenamed("node", "c"), "c", "left").select("sid", F.coalesce("root", "c").alias("c")), f"comp{r}")
        if not long_.limit(1).count():
            break
        tested = pairs if tested is None else s.keep(tested.unionByName(pairs), f"tested{r}")
    sets.unpersist()
    return comp


def groups(spark: SparkSession, docs: DataFrame, width: int = 5, percent: int = 80, k: int = K) -> DataFrame:
    """(row, doc_id, n_shingles, component_id, keep_row): the group of each row and the row that stands for it."""
    s = Scratch(spark, "near")
    rows = s.keep(sketches(docs, width, k), "sketches")
    name = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")
    reps = rows.where("digest is not null").groupBy("digest").agg(F.min(name).alias("name"), F.min("row").alias("sid"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    reps = s.keep(reps, "reps")
    lists = inverted(reps, s, k, percent)
    texts = narrow(docs).select(F.col("row").alias("sid"), "text")
    comp = link_lists(spark, lists, reps, texts, width, percent, k, s)
    named = reps.select("digest", "sid", "name").join(comp, "sid", "left").withColumn("c", F.coalesce("c", "sid"))
    best = named.groupBy("c").agg(F.min("name").alias("best"))
    named = s.keep(named.join(best, "c").select("digest", F.col("best.doc_id").alias("component_id"), F.col("best.row").alias("keep_row")), "named")
    out = rows.select("row", "doc_id", F.col("n").alias("n_shingles"), "digest").join(named, "digest", "left")
    alone = F.col("digest").isNull()
    return out.select("row", "doc_id", "n_shingles", F.when(alone, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), F.when(alone, F.col("row")).otherwise(F.col("keep_row")).alias("keep_row"))


def op4_bottom_k(spark: SparkSession, docs: DataFrame) -> DataFrame:
    out = groups(spark, docs, width=3, percent=85)
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group, all columns kept."""
    row = fresh(docs, "_row")
    kept = groups(spark, docs).where("row = keep_row").select(F.col("row").alias(row))
    return docs.withColumn(row, F.monotonically_increasing_id()).join(kept, row, "left_semi").select(*docs.columns)


#: All pairs by their common shingles, then everything that is reachable: for small tables.
ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS a
  FROM documents),
s AS (
  SELECT doc_id, unnest(list_distinct(CASE WHEN len(a) = 0 THEN [] WHEN len(a) < 3 THEN [array_to_string(a, ' ')]
                        ELSE [a[i] || ' ' || a[i + 1] || ' ' || a[i + 2] FOR i IN range(1, len(a) - 1)] END)) AS g
  FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2),
links AS (
  SELECT a, b FROM common JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b
  WHERE 100 * c >= 85 * (na.n + nb.n - c)),
reach(doc_id, other) AS (
  SELECT doc_id, doc_id FROM documents
  UNION
  SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.other),
named AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT doc_id, coalesce(n.n, 0) AS n_shingles, component_id, doc_id = component_id AS kept
FROM named LEFT JOIN n USING (doc_id)
"""
