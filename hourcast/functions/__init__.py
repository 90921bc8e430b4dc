"""Column-expression helpers (JVM-side, no UDFs)."""

from hourcast.functions.intervals import (
    array_mean,
    array_percentile,
    array_std_pop,
    confidence,
    rel_width,
)
from hourcast.functions.text import money_to_num, nan_to_null, norm_token, str_to_num, to_bool01, to_num, ws_trim

__all__ = [
    "array_mean",
    "array_percentile",
    "array_std_pop",
    "confidence",
    "rel_width",
    "money_to_num",
    "nan_to_null",
    "norm_token",
    "str_to_num",
    "to_bool01",
    "to_num",
    "ws_trim",
]
