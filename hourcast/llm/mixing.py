"""Mixing sources to target weights by entropy balancing (DataFrame operations only).

Rates w minimise the relative entropy to one copy of each document, under one
token constraint a source, sum(size * w) = target, and 0 <= w <= 3.  The convex
dual has one multiplier a source; at its optimum w = min(3, exp(m * size /
scale)), an exponential tilt.  ``balance`` solves it by guarded Newton steps,
each of them an aggregation over (source, size) counts, which hold all that
the dual needs to know of the documents; its sums are decimals, so reruns
agree to the last bit.

``rounded`` turns rates into whole copies, floor(w) or one more, by systematic
rounding along documents ordered by size: running sums of fractions decide, so
neighbours of like size make up for each other.  What is still missing of a
source's target goes to its smallest documents that can still be rounded the
other way.  Running sums come from (source, size class, bin) cells.  A source has
bins by its own number of rows, and repeats of one (source, doc_id, size) have
bins of their own, so either may hold a third of all rows.

Weights 5, 2, 1 repeat over the sources by code point, a null source last.
Targets share the total of all sizes by weight; none exceeds three times its
source's size, and the excess is shared again by weight.  A null or empty
text has size 0 and is never taken.  Null ids and repeated rows count as
rows of their own.  An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from hourcast.llm.common import WORD, Scratch, dealt, fresh, narrow, offsets

WEIGHTS, MOST = (5, 2, 1), 3
STEPS, CLOSE = 60, 1e-9
#: Parts that a rate's fraction is rounded to before it is summed.
PARTS = 1 << 20
ROWS_PER_BIN, LEAST_BINS = 100_000, 16


def sizes(docs: DataFrame) -> DataFrame:
    return narrow(docs, "source").select("row", "doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"))


def targets(rows: DataFrame) -> DataFrame:
    """(s, source, n, source_size, scale, target) of each source; s is its place by code point, n its rows."""
    per = rows.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("source_size"), F.sum(F.col("size").cast("decimal(38,0)") * F.col("size")).cast("double").alias("sq"))
    # windows over sources, not over documents
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    per = per.withColumn("s", F.row_number().over(by_name) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), (F.col("s") % len(WEIGHTS) + 1).cast("int"))
    per = per.withColumn("weight", weight).withColumn("total", F.sum("source_size").over(W.partitionBy()))
    # the sources that reach their bound are those of the least bound per weight
    by_bound = W.orderBy(F.col("source_size") / F.col("weight"), "s").rowsBetween(W.unboundedPreceding, -1)
    per = per.withColumn("bounded", F.coalesce(F.sum("source_size").over(by_bound), F.lit(0)) * MOST)
    per = per.withColumn("open", F.sum("weight").over(W.partitionBy()) - F.coalesce(F.sum("weight").over(by_bound), F.lit(0.0)))
    per = per.withColumn("level", (F.col("total") - F.col("bounded")) / F.col("open"))
    # the level rises while sources over their bound are set aside, and falls after that
    shared = F.max("level").over(W.partitionBy())
    bound = (F.col("source_size") * MOST).cast("double")
    return per.select(
        "s",
        "source",
        "n",
        "source_size",
        F.coalesce(F.col("sq") / F.nullif(F.col("source_size").cast("double"), F.lit(0.0)), F.lit(1.0)).alias("scale"),
        F.least(bound, shared * F.col("weight")).alias("target"),
    )


def rate(m: Column, size: Column, scale: Column) -> Column:
    return F.least(F.lit(float(MOST)), F.exp(F.least(m * size / scale, F.lit(2.0))))


def balance(spark: SparkSession, rows: DataFrame, per: DataFrame, s: Scratch) -> DataFrame:
    """``per`` with each source's multiplier ``m``; null where every rate is the bound."""
    counts = s.keep(rows.where("size > 0").groupBy("s", "size").agg(F.count(F.lit(1)).alias("n")), "counts")
    state = per.select(
        "s",
        "scale",
        "target",
        F.when((F.col("target") > 0) & (F.col("target") < MOST * F.col("source_size") * (1 - 1e-12)), F.log(F.col("target") / F.col("source_size"))).alias("m"),
        F.lit(-1e6).alias("lo"),
        F.lit(1e6).alias("hi"),
        F.lit(False).alias("done"),
    )
    state = s.keep(state.where("m is not null"), "state0")
    for k in range(1, STEPS + 1):
        if not state.where("not done").limit(1).count():
            break
        w = rate(F.col("m"), F.col("size"), F.col("scale"))
        words = F.col("n") * F.col("size") * w
        slope = F.when(w < MOST, words * F.col("size") / F.col("scale")).otherwise(0.0)
        exact = lambda x: F.sum(x.cast("decimal(38,6)")).cast("double")
        step = counts.join(state, "s").groupBy("s").agg(exact(words).alias("have"), exact(slope).alias("slope"))
        g = F.col("have") - F.col("target")
        nxt = state.join(step, "s").select(
            "s",
            "scale",
            "target",
            "m",
            F.when(g < 0, F.greatest("lo", "m")).otherwise(F.col("lo")).alias("lo"),
            F.when(g > 0, F.least("hi", "m")).otherwise(F.col("hi")).alias("hi"),
            (F.col("done") | (F.abs(g) <= CLOSE * F.col("target"))).alias("done"),
            F.when(F.col("slope") > 0, F.col("m") - g / F.col("slope")).alias("newton"),
        )
        inside = (F.col("newton") > F.col("lo")) & (F.col("newton") < F.col("hi"))
        # out of the bracket: halve it, or double the multiplier while it is open on that side
        halved = F.when(F.col("hi") >= 1e6, F.greatest(F.col("m") * 2, F.lit(1.0))).when(F.col("lo") <= -1e6, F.least(F.col("m") * 2, F.lit(-1.0))).otherwise((F.col("lo") + F.col("hi")) / 2)
        nxt = nxt.withColumn("m", F.when(F.col("done"), F.col("m")).when(inside, F.col("newton")).otherwise(halved)).drop("newton")
        state = s.keep(nxt, f"state{k}")
    return per.join(state.select("s", "m"), "s", "left")


def running(rows: DataFrame, value: str, out: str) -> DataFrame:
    """``rows`` with the sum of ``value`` over the rows before each in its source, in the order class, bin, size, hash."""
    cell = ["s", "klass", "bin"]
    cells = offsets(rows.groupBy(*cell).agg(F.sum(value).alias("v")), ["s"], "klass", "bin", "v", "before").drop("v")
    inside = W.partitionBy(*cell).orderBy("size", "h", "row").rowsBetween(W.unboundedPreceding, -1)
    return rows.withColumn("in_cell", F.coalesce(F.sum(value).over(inside), F.lit(0))).join(cells, cell).withColumn(out, F.col("before") + F.col("in_cell")).drop("before", "in_cell")


def spread(per: DataFrame, used: DataFrame) -> DataFrame:
    """A row of each source for each bin that it uses, so that joins deal a source's documents to as many tasks."""
    return per.join(used, "s")


def rounded(rows: DataFrame, solved: DataFrame, used: DataFrame, s: Scratch) -> DataFrame:
    """(row, doc_id, size, source_size, target, copies) of rows (row, doc_id, s, size, h, bin)."""
    # size classes: each size by itself up to 64, then 32 classes for each doubling
    klass = F.when(F.col("size") <= 64, F.col("size")).otherwise(F.floor(F.log2(F.col("size").cast("double")) * 32)).cast("long")
    w = F.when(F.col("m").isNull(), F.lit(float(MOST))).otherwise(rate(F.col("m"), F.col("size"), F.col("scale")))
    d = (
        rows.join(spread(solved.select("s", "source_size", "scale", "target", "m"), used), ["s", "bin"])
        .withColumn("klass", klass)
        .withColumn("parts", F.when(F.col("size") == 0, 0).otherwise(F.round(w * PARTS)).cast("long"))
        .drop("scale", "m")
        .withColumn("least", F.expr(f"parts div {PARTS}"))
        .withColumn("fraction", F.col("parts") % PARTS)
    )
    d = s.keep(d, "rates")
    d = running(d, "fraction", "upto")
    half = PARTS // 2
    d = d.withColumn("copies", F.col("least") + F.expr(f"(upto + fraction + {half}) div {PARTS} - (upto + {half}) div {PARTS}"))
    d = s.keep(d.drop("upto"), "copies")
    missing = d.groupBy("s").agg(F.round(F.max("target") - F.sum(F.col("copies") * F.col("size"))).cast("long").alias("missing"))
    d = d.join(spread(missing, used), ["s", "bin"])
    other_way = (F.col("size") > 0) & (F.col("fraction") > 0) & F.when(F.col("missing") > 0, F.col("copies") == F.col("least")).otherwise(F.col("copies") > F.col("least"))
    d = running(d.withColumn("spare", F.when(other_way, F.col("size")).otherwise(0)), "spare", "upto")
    turned = (F.col("spare") > 0) & (F.col("upto") + F.expr("spare div 2") < F.abs("missing"))
    return d.select("row", "doc_id", "size", "source_size", "target", (F.col("copies") + F.when(turned, F.signum("missing")).otherwise(0)).cast("long").alias("copies"))


def mix(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """(row, doc_id, size, source_size, target, copies) of every row."""
    s = Scratch(spark, "mix")
    named = s.keep(sizes(docs), "sizes")
    per = s.keep(targets(named), "targets")
    total = LEAST_BINS + named.count() // ROWS_PER_BIN
    # sources of more rows than a bin should hold have more bins: at most one such source for each ROWS_PER_BIN rows
    large = s.keep(per.where(F.col("n") > ROWS_PER_BIN).select(F.col("source").alias("of"), (LEAST_BINS + F.expr(f"n div {ROWS_PER_BIN}")).alias("bins")), "large")
    binned = named.withColumn("h", F.xxhash64("source", "doc_id", "size")).join(large, F.col("source").eqNullSafe(F.col("of")), "left").drop("of")
    binned = s.keep(dealt(s, binned, "h", total, F.coalesce("bins", F.lit(LEAST_BINS)), ROWS_PER_BIN).drop("bins"), "binned")
    used = s.keep(binned.select("source", "bin").distinct(), "used")
    of = per.select("s", F.col("source").alias("of")).join(used.withColumnRenamed("bin", "of_bin"), F.col("source").eqNullSafe(F.col("of"))).drop("source")
    rows = binned.join(of, F.col("source").eqNullSafe(F.col("of")) & (F.col("bin") == F.col("of_bin"))).drop("source", "of", "of_bin")
    rows = s.keep(rows, "rows")
    solved = s.keep(balance(spark, rows, per, s), "solved")
    return rounded(rows, solved, of.select("s", F.col("of_bin").alias("bin")), s)


def op9_entropy_mix(spark: SparkSession, docs: DataFrame) -> DataFrame:
    return mix(spark, docs).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as it has copies, all columns kept."""
    row, n = fresh(docs, "_row"), fresh(docs, "_copies")
    copies = mix(spark, docs).where("copies > 0").select(F.col("row").alias(row), F.col("copies").alias(n))
    out = docs.withColumn(row, F.monotonically_increasing_id()).join(copies, row)
    return out.withColumn(n, F.explode(F.sequence(F.lit(1).cast("long"), n))).select(*docs.columns)
