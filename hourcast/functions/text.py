"""Text -> number / flag parsing as JVM-side Column expressions.

All functions are pure ``Column -> Column`` builders; they stay inside
whole-stage codegen (regexp, try_cast), no Python runs per row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, NumericType, StringType

from hourcast.config import TRUE_TOKENS

# Python's str.strip() removes Unicode whitespace and the \x1c-\x1f separators;
# Spark's trim() only removes blanks.  (?U) makes \s Unicode-aware in Java regex.
_WS_EDGES = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"
# Decimal / scientific numbers with optional sign and padding, or infinity.
_NUMBER = r"(?i)^\s*[+-]?(\d+\.?\d*|\.\d+)(e[+-]?\d+)?\s*$"
_INFINITY = r"(?i)^[+-]?inf(inity)?$"


def ws_trim(c: Column) -> Column:
    """Strip leading/trailing whitespace the way Python's ``str.strip`` does."""
    return F.regexp_replace(c, _WS_EDGES, "")


def norm_token(c: Column) -> Column:
    """Stringify, strip and lower-case (null stays null)."""
    return F.lower(ws_trim(c.cast("string")))


def to_bool01(c: Column) -> Column:
    """yes/true/1 -> 1; every other value, including null and "1.0", -> 0."""
    return F.when(norm_token(c).isin(*TRUE_TOKENS), F.lit(1)).otherwise(F.lit(0)).cast("int")


def str_to_num(c: Column) -> Column:
    """Parse text to DOUBLE; unparsable -> null.

    Only plain decimal/scientific text and infinity spellings parse, so
    "1,200", "1_000", "1d" and "nan" are null; a finite text that overflows
    (e.g. "1e400") is null as well.
    """
    s = c.cast("string")
    value = s.try_cast("double")
    finite_text = s.rlike(_NUMBER) & (F.abs(value) != F.lit(float("inf")))
    return F.when(finite_text | s.rlike(_INFINITY), value)


def nan_to_null(c: Column) -> Column:
    return F.when(~F.isnan(c), c)


def to_num(c: Column, dtype: DataType | None = None) -> Column:
    """Coerce a column to DOUBLE: numbers are cast, text is parsed, NaN -> null."""
    if dtype is not None and isinstance(dtype, NumericType):
        return nan_to_null(c.cast("double"))
    if dtype is not None and not isinstance(dtype, StringType):
        # booleans and other scalars go through their text form
        return str_to_num(c.cast("string"))
    return str_to_num(c)


def money_to_num(c: Column) -> Column:
    """Currency text -> number: drop '$' and ',', parse, missing -> 0."""
    return F.coalesce(str_to_num(F.regexp_replace(c.cast("string"), "[$,]", "")), F.lit(0.0))
