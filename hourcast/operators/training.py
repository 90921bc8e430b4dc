"""Training frame, split, imputation values and forest fitting.

The master is unpivoted once into a long frame ``(target, hours, features)``
so that every per-target statistic (coverage, row guard, split, medians,
modes, metrics) is one grouped job for all twelve targets instead of twelve
passes.  Each target has an MLlib pipeline that prepares its features; the trees
of all targets are grown by one job (``operators/forest.py``).
"""

from __future__ import annotations

import uuid
from concurrent.futures import ThreadPoolExecutor

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import OneHotEncoder, SQLTransformer, StringIndexer, VectorAssembler
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hourcast.config import (
    FOREST_SEED,
    FOREST_TREES,
    MIN_TRAIN_ROWS,
    MODEL_VERSION,
    QUOTE_CAT_FEATURES,
    QUOTE_NUM_FEATURES,
    SPLIT_SEED,
    TARGETS,
    TEST_SIZE,
    operation_of,
)
from hourcast.functions.text import to_num
from hourcast.operators import forest as forests
from hourcast.operators.scoring import TREES_TABLE, load_paths, new_run, publish, remember, score_one
from hourcast.session import drop_at_exit, drop_path, scratch_path, ship_package
from hourcast.sources.tables import METRICS_SCHEMA

KEY_COLS = ("project_id", "upload_seq", "row_idx")
# hash-prefix bins of the exact split: 16**3 bins keep every ranking window
# to ~1/4096 of a target's rows while the offsets table stays <= 12*4096 rows
SPLIT_BIN_CHARS = 3
# the source's trees grow without a limit; a full tree of n rows has some 2 log2(n) levels
MAX_DEPTH = 1000


def training_long(master: DataFrame, min_rows: int = MIN_TRAIN_ROWS) -> DataFrame:
    """M1 + F4 + A12: one row per (project, target) with positive hours.

    Targets with fewer than ``min_rows`` such rows are dropped (the source
    skips their model).  Columns: key columns present, ``target``, ``hours``
    and the quote-time features present.
    """
    targets = [t for t in TARGETS if t in master.columns]
    keys = [c for c in KEY_COLS if c in master.columns]
    feats = [c for c in QUOTE_NUM_FEATURES + QUOTE_CAT_FEATURES if c in master.columns]
    schema = {f.name: f.dataType for f in master.schema.fields}
    pairs = F.explode(
        F.array(*[F.struct(F.lit(t).alias("target"), to_num(F.col(t), schema[t]).alias("hours")) for t in targets])
    )
    long = master.select(*keys, *feats, pairs.alias("_t")).select(*keys, "_t.target", "_t.hours", *feats)
    long = long.filter(F.col("hours") > 0)
    # <= 12 rows (one per target): a bounded broadcast
    enough = long.groupBy("target").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_rows)
    return long.join(F.broadcast(enough.select("target")), "target", "left_semi")


def feature_coverage(long: DataFrame) -> DataFrame:
    """A5: per (target, feature) the number of non-null values and of rows.

    A feature with ``n_nonnull = 0`` is all-null for that target and is not
    used by its model (M1).  One pass, one aggregate per feature.
    """
    feats = [c for c in QUOTE_NUM_FEATURES + QUOTE_CAT_FEATURES if c in long.columns]
    agg = long.groupBy("target").agg(
        F.count(F.lit(1)).alias("n_rows"), *[F.count(F.col(c)).alias(f"_n{i}") for i, c in enumerate(feats)]
    )
    rows = F.explode(
        F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"_n{i}").alias("n_nonnull")) for i, c in enumerate(feats)])
    )
    return agg.select("target", "n_rows", rows.alias("_f")).select("target", "_f.feature", "_f.n_nonnull", "n_rows")


def split_hash(target: Column, key: Column, seed: int = SPLIT_SEED) -> Column:
    """Deterministic pseudo-random order key of a row within its target."""
    return F.md5(F.concat(target, F.lit("|"), F.coalesce(key.cast("string"), F.lit("<null>")), F.lit(f"|{seed}")))


def exact_split(
    long: DataFrame,
    test_size: float = TEST_SIZE,
    seed: int = SPLIT_SEED,
    key: str = "project_id",
    tiebreak: str = "row_idx",
) -> DataFrame:
    """M2: exact hold-out split per target, ``is_test`` for ceil(test_size*n) rows.

    Rows are ranked by an md5 order key; the test rows are the first
    ``ceil(test_size * n)`` of each target.  Instead of one window over a
    whole target (one task per target), rows are binned by the first hex
    digits of the key: a small table of per-(target, bin) counts gives the bin
    of each target that holds its last test row.  Rows of all other bins are
    decided where they are, without a shuffle; only those of that bin, some
    1/4096 of the target, are ranked.  Sizes are exact and independent of
    partitioning.
    """
    h = split_hash(F.col("target"), F.col(key), seed)
    df = long.withColumn("_h", h).withColumn("_bin", F.substring("_h", 1, SPLIT_BIN_CHARS))
    counts = df.groupBy("target", "_bin").agg(F.count(F.lit(1)).alias("_c"))
    before = Window.partitionBy("target").orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("target")
    offsets = counts.select(
        "target",
        "_bin",
        F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_before"),
        F.sum("_c").over(whole).alias("_n"),
        "_c",
    )
    # the bin of each target that holds its last test row: at most a row a target
    n_test = F.ceil(F.col("_n") * F.lit(test_size))
    cut = offsets.withColumn("_n_test", n_test).filter((F.col("_before") < F.col("_n_test")) & (F.col("_before") + F.col("_c") >= F.col("_n_test")))
    df = df.join(F.broadcast(cut.select("target", F.col("_bin").alias("_cut"), "_before", "_n_test")), "target", "left")
    settled = df.filter(~F.col("_bin").eqNullSafe(F.col("_cut"))).withColumn("is_test", F.coalesce(F.col("_bin") < F.col("_cut"), F.lit(False)))
    order = [F.col("_h")] + ([F.col(tiebreak)] if tiebreak in df.columns else [])
    rank = F.col("_before") + F.row_number().over(Window.partitionBy("target", "_bin").orderBy(*order))
    ranked = df.filter(F.col("_bin") == F.col("_cut")).withColumn("is_test", rank <= F.col("_n_test"))
    return settled.unionByName(ranked).drop("_h", "_bin", "_cut", "_before", "_n_test")


# Steps of the median's bins for each doubling of a value.
MEDIAN_STEPS = 4096


def _value_bin(v: Column) -> Column:
    """A bin of a number that never falls as the number grows."""
    size = F.abs(v)
    power = F.floor(F.log2(size))
    place = power * MEDIAN_STEPS + F.floor(size / F.pow(F.lit(2.0), power.cast("double")) * MEDIAN_STEPS) + (1 << 24)
    place = F.when(size == 0, F.lit(0)).when(size == float("inf"), F.lit(1 << 26)).otherwise(place)
    return F.when(v < 0, -place).otherwise(place).cast("bigint")


def exact_medians(values: DataFrame, by: list[str], value: str = "value") -> DataFrame:
    """``(*by, median)``: exact medians from counts, whatever the number of rows or distinct values.

    Equal values are counted first, with map-side partial aggregation, so a
    hot value costs a row a task.  Counts per bin of near values give the bins
    that hold the middle (at most two a group); only their values are ranked.
    """
    return counted_medians(values.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("_c")), by, value)


def counted_medians(counts: DataFrame, by: list[str], value: str = "value") -> DataFrame:
    """``exact_medians`` of values that are counted already: ``(*by, value, _c)``, each value once a group, none null."""
    v = F.col(value)
    counts = counts.withColumn("_bin", _value_bin(v))
    bins = counts.groupBy(*by, "_bin").agg(F.sum("_c").alias("_n"))
    order = Window.partitionBy(*by).orderBy("_bin")
    bins = bins.withColumn("_upto", F.sum("_n").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    bins = bins.withColumn("_all", F.sum("_n").over(Window.partitionBy(*by)))
    low, high = F.expr("(_all + 1) div 2"), F.expr("_all div 2 + 1")
    middle = bins.filter((F.col("_upto") >= low) & (F.col("_upto") - F.col("_n") < high))
    middle = middle.select(*by, "_bin", "_all", (F.col("_upto") - F.col("_n")).alias("_before"))
    inside = counts.join(middle, [*by, "_bin"])
    own = Window.partitionBy(*by, "_bin").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    inside = inside.withColumn("_to", F.col("_before") + F.sum("_c").over(own))
    holds = lambda rank: (F.col("_to") >= rank) & (F.col("_to") - F.col("_c") < rank)
    ends = inside.groupBy(*by).agg(F.max(F.when(holds(low), v)).alias("_lo"), F.max(F.when(holds(high), v)).alias("_hi"))
    return ends.select(*by, F.when(F.col("_lo") == F.col("_hi"), F.col("_lo")).otherwise((F.col("_lo") + F.col("_hi")) / 2).alias("median"))


def value_counts(split: DataFrame) -> DataFrame:
    """``(target, feature, num, cat, n)``: how many training rows of each target have each value of each feature, null included."""
    nums = [c for c in QUOTE_NUM_FEATURES if c in split.columns]
    cats = [c for c in QUOTE_CAT_FEATURES if c in split.columns]
    item = lambda c, num, cat: F.struct(F.lit(c).alias("feature"), num.cast("double").alias("num"), cat.cast("string").alias("cat"))
    none = F.lit(None)
    items = [item(c, F.col(c), none) for c in nums] + [item(c, none, F.col(c)) for c in cats]
    long = split.filter(~F.col("is_test")).select("target", F.explode(F.array(*items)).alias("_v")).select("target", "_v.*")
    return long.groupBy("target", "feature", "num", "cat").agg(F.count(F.lit(1)).alias("n"))


def impute_values(split: DataFrame) -> DataFrame:
    """A6 + A7: per target, on the training split only, the exact median of
    each numeric feature and the most frequent value of each categorical
    (ties -> smallest value).  Long form ``(target, feature, num_value,
    cat_value)``; a null value means the feature is all-null in training and
    is dropped from that model.  Both come from counts of equal values, so no
    task holds the values of a feature.

    The split is evaluated once: its counts are a table in the shared folder,
    which goes with the application, and all that follows reads those.
    """
    spark = split.sparkSession
    path = scratch_path(spark, f"value-counts-{uuid.uuid4().hex}")
    counted = value_counts(split)
    counted.write.parquet(path)
    drop_at_exit(spark, path)
    counts = spark.read.schema(counted.schema).parquet(path)
    every = counts.select("target", "feature").distinct()
    medians = counted_medians(counts.filter("num is not null").select("target", "feature", F.col("num").alias("value"), F.col("n").alias("_c")), ["target", "feature"])
    modes = counts.filter("cat is not null").groupBy("target", "feature").agg(F.min(F.struct((-F.col("n")).alias("_c"), "cat")).alias("_b"))
    out = every.join(medians, ["target", "feature"], "left").join(modes, ["target", "feature"], "left")
    return out.select("target", "feature", F.col("median").alias("num_value"), F.col("_b.cat").alias("cat_value"))


def regression_metrics(df: DataFrame, by: str, label: str, prediction: str) -> DataFrame:
    """A13 + A14: per group ``rows``, MAE and R^2 = 1 - SSE/SST.

    SST is ``n * var_pop(label)`` (a stable one-pass aggregate).  SST = 0
    gives 1.0 when SSE = 0, else 0.0 (the usual finite convention).
    """
    y, p = F.col(label).cast("double"), F.col(prediction).cast("double")
    agg = df.groupBy(by).agg(
        F.count(F.lit(1)).alias("rows"),
        F.avg(F.abs(y - p)).alias("mae"),
        F.sum((y - p) * (y - p)).alias("_sse"),
        (F.var_pop(y) * F.count(F.lit(1))).alias("_sst"),
    )
    r2 = (
        F.when(F.col("_sst") == 0, F.when(F.col("_sse") == 0, F.lit(1.0)).otherwise(F.lit(0.0)))
        .otherwise(F.lit(1.0) - F.col("_sse") / F.col("_sst"))
    )
    return agg.select(by, "rows", "mae", r2.alias("r2"))


def holdout_baseline(split: DataFrame) -> DataFrame:
    """A13/A14 with the training-split mean as predictor (per target)."""
    means = split.filter(~F.col("is_test")).groupBy("target").agg(F.avg("hours").alias("prediction"))
    test = split.filter(F.col("is_test")).join(F.broadcast(means), "target")  # <= 12 rows
    return regression_metrics(test, "target", "hours", "prediction")


# --- forest fitting -------------------------------------------------------------


def model_features(impute_rows: list, target: str) -> tuple[dict[str, float], dict[str, str]]:
    """Numeric and categorical imputation values of one target (features with
    a null value are dropped)."""
    num, cat = {}, {}
    for r in impute_rows:
        if r["target"] != target:
            continue
        if r["feature"] in QUOTE_CAT_FEATURES:
            if r["cat_value"] is not None:
                cat[r["feature"]] = r["cat_value"]
        elif r["num_value"] is not None:
            num[r["feature"]] = float(r["num_value"])
    return num, cat


def _sql_str(v: str) -> str:
    return "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'"


def feature_names(num: dict[str, float], cat: dict[str, str], labels: list[list[str]]) -> list[str]:
    """Names of the assembled vector's slots, in slot order."""
    return [f"num__{c}" for c in num] + [f"cat__{c}_{v}" for c, values in zip(cat, labels, strict=True) for v in values]


def build_pipeline(target: str, num: dict[str, float], cat: dict[str, str]) -> Pipeline:
    """M3 for one target, column names namespaced by the operation so the
    twelve fitted pipelines can run one after another on the same rows.

    Numerics are imputed with the exact train-split median and categoricals
    with the mode in one SQL projection; categoricals are indexed in
    alphabetical order and one-hot encoded as sparse vectors (an unseen value
    encodes as all zeros).
    """
    op = operation_of(target)
    exprs, cols = [], []
    for i, (c, v) in enumerate(num.items()):
        exprs.append(f"coalesce(CAST(`{c}` AS DOUBLE), CAST({v!r} AS DOUBLE)) AS `__{op}__n{i}`")
        cols.append(f"__{op}__n{i}")
    texts = [f"__{op}__c{i}" for i in range(len(cat))]
    exprs += [f"coalesce(CAST(`{c}` AS STRING), {_sql_str(mode)}) AS `{x}`" for x, (c, mode) in zip(texts, cat.items(), strict=True)]
    stages = [SQLTransformer(statement=f"SELECT *, {', '.join(exprs)} FROM __THIS__")]
    if cat:
        places, slots = [f"{x}_i" for x in texts], [f"{x}_v" for x in texts]
        stages += [
            StringIndexer(inputCols=texts, outputCols=places, stringOrderType="alphabetAsc", handleInvalid="keep"),
            # the last category is the one of unseen values
            OneHotEncoder(inputCols=places, outputCols=slots, dropLast=True),
        ]
        cols += slots
    stages.append(VectorAssembler(inputCols=cols, outputCol=f"__{op}__features", handleInvalid="keep"))
    return Pipeline(stages=stages)


def tree_rows(prepared: DataFrame, target: str, num: dict[str, float], cat: dict[str, str]) -> DataFrame:
    """(target, key, x, features, hours) of a target's training rows: ``x`` has the numbers, then the categories' places."""
    op = operation_of(target)
    keys = [F.col(c).cast("string") for c in KEY_COLS if c in prepared.columns]
    x = [F.col(f"__{op}__n{i}") for i in range(len(num))] + [F.col(f"__{op}__c{i}_i") for i in range(len(cat))]
    key = F.xxhash64(*keys) if keys else F.lit(0).cast("long")
    return prepared.select(F.lit(target).alias("target"), key.alias("key"), F.array(*x).alias("x"), F.col(f"__{op}__features").alias("features"), "hours")


def prepare_target(split: DataFrame, target: str, num: dict[str, float], cat: dict[str, str], path: str) -> tuple[PipelineModel, list[int]]:
    """M3 + S11: the fitted preparation of a target, saved into the run's folder, and the sizes of its categories."""
    model = build_pipeline(target, num, cat).fit(split.filter((F.col("target") == target) & ~F.col("is_test")))
    model.write().save(f"{path}/pipeline")
    labels = [list(x) for x in model.stages[1].labelsArray] if cat else []
    names = feature_names(num, cat, labels)
    split.sparkSession.createDataFrame(list(enumerate(names)), "idx int, feature string").coalesce(1).write.parquet(f"{path}/feature_names")
    return model, [len(x) for x in labels]


def train_all(
    master: DataFrame,
    models_dir: str,
    version: str = MODEL_VERSION,
    parallelism: int = 4,
    trees: int = FOREST_TREES,
    max_depth: int = MAX_DEPTH,
    seed: int = FOREST_SEED,
    local_rows: int = forests.READ_ROWS,
) -> DataFrame:
    """M4-M6 + U5: train every target that has enough rows; returns the metrics
    table (target order).  Skipped targets keep any older artefact.

    The split training frame is written once to the shared folder, a folder a
    target (so each preparation reads its own part; lineage cut, survives
    executor loss), and removed at the end.  One job grows the trees of all
    targets in the same way, whatever their rows: each on all training rows, of
    which a task reads ``local_rows`` at once.  The run is published when all
    models are there.
    """
    spark = master.sparkSession
    ship_package(spark)
    path = scratch_path(spark, f"training-split-{uuid.uuid4().hex}")
    exact_split(training_long(master)).write.partitionBy("target").parquet(path)
    split = spark.read.parquet(path)
    stats = impute_values(split).collect()  # <= 12 x 39 rows: the imputation table
    counts = split.groupBy("target").agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("is_test"), 0).otherwise(1)).alias("train")).collect()
    sizes = {r["target"]: (r["n"], r["train"]) for r in counts}  # <= 12 rows
    targets = [t for t in TARGETS if t in sizes]
    run = new_run(models_dir)
    paths = {t: f"{run}/{t}_{version}" for t in targets}
    values = {t: model_features(stats, t) for t in targets}

    def prepare(t: str) -> tuple[PipelineModel, list[int]]:
        return prepare_target(split, t, *values[t], paths[t])

    with ThreadPoolExecutor(max_workers=max(1, parallelism)) as pool:
        ready = dict(zip(targets, pool.map(prepare, targets), strict=True))
    shapes = {t: (f"{paths[t]}/forest", len(values[t][0]), ready[t][1]) for t in targets}
    rows = {t: tree_rows(ready[t][0].transform(split.filter((F.col("target") == t) & ~F.col("is_test"))), t, *values[t]) for t in targets}
    if targets:
        every = rows[targets[0]].drop("features")
        for t in targets[1:]:
            every = every.unionByName(rows[t].drop("features"))
        grown = forests.fit_local(every, shapes, trees, max_depth, seed, scratch=f"{path}-rows", read_rows=local_rows)
        grown.write.mode("append").partitionBy("target").parquet(f"{run}/{TREES_TABLE}")
        drop_path(spark, f"{path}-rows")
    for t in targets:
        remember(paths[t], ready[t][0])
    models = load_paths(spark, paths)

    def metrics(m) -> dict:
        test = split.filter((F.col("target") == m.target) & F.col("is_test"))
        scored = score_one(test, m).select("target", "hours", F.col(f"{m.op}_p50").alias("prediction"))
        found = regression_metrics(scored, "target", "hours", "prediction").first()
        return {
            "target": m.target,
            "version": version,
            "rows": int(sizes[m.target][0]),
            "mae": float(found["mae"]) if found else float("nan"),
            "r2": float(found["r2"]) if found else float("nan"),
            "model_path": m.path,
        }

    with ThreadPoolExecutor(max_workers=max(1, parallelism)) as pool:
        results = list(pool.map(metrics, models))
    publish(spark, models_dir, paths, version)
    drop_path(spark, path)
    return spark.createDataFrame(results, METRICS_SCHEMA)
