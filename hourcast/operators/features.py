"""Cleaning and feature derivation.

Everything here is a narrow projection/filter, so a whole chain compiles to
one whole-stage-codegen span; the only exception is the table-level log-cost
rule (C5), which needs one aggregate over the scope it is evaluated on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hourcast.config import (
    ACTUALS_ROLE,
    BOOL_COLS,
    INCLUDE_TOKENS,
    INDEX_INPUTS,
    INDEX_TERMS,
    QUOTE_CAT_FEATURES,
    QUOTE_DEFAULTS,
    QUOTE_NUM_FEATURES,
    TARGETS,
)
from hourcast.functions.text import money_to_num, norm_token, to_bool01, to_num

#: Words that are flags in a quote record, besides whole numbers.
FLAG_WORDS = ("yes", "no", "true", "false")
LOG_COST = "log_quoted_materials_cost"
RAW_COST = "quoted_materials_cost"


def _replace(df: DataFrame, exprs: dict[str, Column]) -> DataFrame:
    """Replace/append columns in one projection (keeps column order)."""
    if not exprs:
        return df
    return df.withColumns(exprs)


def clean_flags(df: DataFrame) -> DataFrame:
    """The seven yes/no flags present in ``df`` -> INT 0/1."""
    return _replace(df, {c: to_bool01(F.col(c)) for c in BOOL_COLS if c in df.columns})


def clean_numbers(df: DataFrame) -> DataFrame:
    """Numeric features (and index inputs) present in ``df`` -> DOUBLE.

    Flags already converted by ``clean_flags`` stay INT, like the source,
    whose numeric coercion leaves integer columns integer.
    """
    types = dict(df.dtypes)
    schema = {f.name: f.dataType for f in df.schema.fields}
    cols = [c for c in dict.fromkeys(QUOTE_NUM_FEATURES + INDEX_INPUTS) if c in df.columns]
    exprs = {}
    for c in cols:
        if c in BOOL_COLS and types[c] == "int":
            continue
        exprs[c] = to_num(F.col(c), schema[c])
    return _replace(df, exprs)


def clean_hours(df: DataFrame) -> DataFrame:
    """Target columns -> DOUBLE (unparsable text -> null)."""
    schema = {f.name: f.dataType for f in df.schema.fields}
    return _replace(df, {t: to_num(F.col(t), schema[t]) for t in TARGETS if t in df.columns})


def with_indices(df: DataFrame) -> DataFrame:
    """The four composite indices.

    Absent inputs are created as 0.0; the indices are always recomputed
    (user-given values are ignored); inputs keep their nulls, each term
    counts 0 when null.
    """
    missing = {c: F.lit(0.0) for c in INDEX_INPUTS if c not in df.columns}
    df = _replace(df, missing)
    exprs = {}
    for name, terms in INDEX_TERMS.items():
        total = None
        for c, div in terms:
            term = F.coalesce(F.col(c).cast("double"), F.lit(0.0))
            term = term / F.lit(div) if div != 1.0 else term
            total = term if total is None else total + term
        exprs[name] = total
    return _replace(df, exprs)


def _derived_log_cost(df: DataFrame) -> Column:
    if RAW_COST in df.columns:
        return F.log1p(money_to_num(F.col(RAW_COST)))
    return F.lit(0.0)


def log_cost_given(df: DataFrame) -> bool:
    """C5's question, asked by one small job: has the log column any number?"""
    if LOG_COST not in df.columns:
        return False
    given = to_num(F.col(LOG_COST), df.schema[LOG_COST].dataType)
    return not df.select(given.alias("given")).where("given is not null").isEmpty()


def with_log_cost(df: DataFrame, by: str | None = None, given: bool | None = None) -> DataFrame:
    """Table-level log-cost rule.

    If the log column is absent, or all-null within the scope, it is derived
    as ``log1p(money(quoted_materials_cost))`` (0.0 without a cost column);
    otherwise it is kept as is, partial nulls included.  The scope is the
    whole frame (``by=None``) or each value of ``by`` (one upload).  Where the
    answer is known (``given``), all is a projection, which a stream can have.

    Plans: whole-frame scope is a scalar subquery (one global aggregate,
    result inlined, no join); per-upload scope aggregates to one row per
    upload and broadcast-joins it back, so the upload key never becomes a
    shuffle key (one upload may be most of the rows).
    """
    derived = _derived_log_cost(df)
    if LOG_COST not in df.columns or given is False:
        return _replace(df, {LOG_COST: derived})
    number = to_num(F.col(LOG_COST), df.schema[LOG_COST].dataType)
    if given:
        return _replace(df, {LOG_COST: number})
    if by is None:
        all_null = df.select((F.count(number) == 0).alias("all_null")).scalar()
        return _replace(df, {LOG_COST: F.when(all_null, derived).otherwise(number)})
    # one small row per upload: bounded by the number of uploads, never by rows
    flags = df.groupBy(by).agg((F.count(number) == 0).alias("_log_all_null"))
    out = df.join(F.broadcast(flags), on=by, how="left")
    out = out.withColumn(LOG_COST, F.when(F.col("_log_all_null"), derived).otherwise(number))
    return out.select(*df.columns)


def keep_for_training(df: DataFrame) -> DataFrame:
    """F1 + F2 (+C3): keep include_in_training in {yes,1,true} and dataset_role
    'actuals', storing both columns normalised.  Each is skipped when absent."""
    if "include_in_training" in df.columns:
        df = df.withColumn("include_in_training", norm_token(F.col("include_in_training")))
        df = df.filter(F.col("include_in_training").isin(*INCLUDE_TOKENS))
    if "dataset_role" in df.columns:
        df = df.withColumn("dataset_role", norm_token(F.col("dataset_role")))
        df = df.filter(F.col("dataset_role") == F.lit(ACTUALS_ROLE))
    return df


def engineer_training(df: DataFrame, by: str | None = "upload_seq") -> DataFrame:
    """C11: F1 -> F2 -> C1 -> C2 -> C6-C10 -> C5, then hours -> DOUBLE.

    ``by`` is the scope of the log-cost rule; uploads are engineered one at a
    time in the source application, so the default is per ``upload_seq``
    (falls back to the whole frame when that column is absent).
    """
    if by is not None and by not in df.columns:
        by = None
    df = keep_for_training(df)
    df = clean_flags(df)
    df = clean_numbers(df)
    df = with_indices(df)
    df = with_log_cost(df, by=by)
    return clean_hours(df)


def prepare_quotes(df: DataFrame, log_cost_given: bool | None = None) -> DataFrame:
    """C1 -> C2 -> C6-C10 -> C5 for a quote batch (no row filter).

    With ``log_cost_given`` (whether the batch holds log costs) it is row-local,
    for a stream as for a table.
    """
    df = clean_flags(df)
    df = clean_numbers(df)
    df = with_indices(df)
    return with_log_cost(df, by=None, given=log_cost_given)


def _with_record_cost(df: DataFrame) -> DataFrame:
    """A plain ``estimated_materials_cost`` field stands for the log cost when none is given."""
    if "estimated_materials_cost" in df.columns and LOG_COST not in df.columns:
        cost = to_num(F.col("estimated_materials_cost"), df.schema["estimated_materials_cost"].dataType)
        return df.withColumn(LOG_COST, F.log1p(cost))
    return df


def quote_faults(df: DataFrame) -> Column:
    """C14: what a record validator refuses, as text; null for a valid record.

    A null in one of the six text fields, a text that is no number in a
    numeric field, and a flag that is neither yes/no, true/false nor a whole
    number.  (The source's form sends flags as integers; batch files also
    write them as words, which mean there what they mean in C1.)  A null
    numeric field is one that was not given and takes its default.
    """
    schema = {f.name: f.dataType for f in df.schema.fields}
    faults = []
    for c in QUOTE_CAT_FEATURES:
        if c not in df.columns:
            raise ValueError(f"quote record lacks required field {c!r}")
        faults.append(F.when(F.col(c).isNull(), F.lit(f"{c} is missing")))
    for c in QUOTE_NUM_FEATURES:
        if c in df.columns:
            value = to_num(F.col(c), schema[c])
            wrong = F.col(c).isNotNull() & value.isNull()
            if c in BOOL_COLS:
                wrong = (wrong | (value != F.floor(value))) & ~F.coalesce(norm_token(F.col(c)).isin(*FLAG_WORDS), F.lit(False))
                faults.append(F.when(wrong, F.lit(f"{c} is no flag")))
            else:
                faults.append(F.when(wrong, F.lit(f"{c} is no number")))
    text = F.concat_ws("; ", *faults)
    return F.when(text != "", text)


def rejected_quotes(df: DataFrame, id_col: str = "quote_id") -> DataFrame:
    """C14: ``(id, reason)`` of the records that ``conform_quotes`` does not accept."""
    return _with_record_cost(df).withColumn("reason", quote_faults(_with_record_cost(df))).filter(F.col("reason").isNotNull()).select(id_col, "reason")


def conform_quotes(df: DataFrame, id_col: str = "quote_id") -> DataFrame:
    """One typed row per valid quote restricted to the 39 features.

    Numeric fields that are not given take the quote-record defaults
    (``has_controls`` and ``has_robotics`` 1, ``complexity_score_1_5`` 3,
    others 0).  Records that a validator refuses are left out, whatever
    columns the consumer reads; ``rejected_quotes`` has them with the reason.
    ``i_o_points_est`` is not a quote field, so the controls index loses that
    term on this path, as in the source.
    """
    df = _with_record_cost(df)
    df = df.filter(quote_faults(df).isNull())
    exprs: list[Column] = [F.col(id_col)] if id_col in df.columns else []
    exprs += [F.col(c).cast("string").alias(c) for c in QUOTE_CAT_FEATURES]
    schema = {f.name: f.dataType for f in df.schema.fields}
    for c in QUOTE_NUM_FEATURES:
        default = F.lit(float(QUOTE_DEFAULTS.get(c, 0.0)))
        value = F.coalesce(to_num(F.col(c), schema[c]), default) if c in df.columns else default
        if c in BOOL_COLS:
            # a whole number is a flag as such: 1 stays "1" for the flag parser
            word = F.col(c).isNotNull() & to_num(F.col(c), schema[c]).isNull() if c in df.columns else F.lit(False)
            exprs.append(F.when(word, to_bool01(F.col(c)) if c in df.columns else F.lit(0)).otherwise(value.cast("int")).alias(c))
        else:
            exprs.append(value.cast("double").alias(c))
    # the record then goes through the quote projection (indices recomputed);
    # its log cost is never null, so C5 keeps it and needs no look at the table
    return with_indices(clean_numbers(clean_flags(df.select(*exprs))))
