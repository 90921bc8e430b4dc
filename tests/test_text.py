"""C1-C4 parsing against small pandas expectations (the traps of SURVEY 2.12)."""

import math

import pytest
from pyspark.sql import functions as F

from hourcast.functions.text import money_to_num, norm_token, str_to_num, to_bool01, ws_trim

NUM_CASES = [
    (" 5 ", 5.0),
    ("1e3", 1000.0),
    ("+3", 3.0),
    (".5", 0.5),
    ("5.", 5.0),
    ("\t7\n", 7.0),
    ("-2.5E-1", -0.25),
    ("inf", math.inf),
    ("-Infinity", -math.inf),
    ("1,200", None),
    ("1_000", None),
    ("1d", None),
    ("1f", None),
    ("nan", None),
    ("1e400", None),
    ("n/a", None),
    ("", None),
    (None, None),
]


def test_str_to_num(spark):
    df = spark.createDataFrame([(s,) for s, _ in NUM_CASES], "s string")
    got = [r[0] for r in df.select(str_to_num(F.col("s"))).collect()]
    for (s, want), g in zip(NUM_CASES, got):
        if want is None:
            assert g is None, s
        else:
            assert g == want, s


BOOL_CASES = [
    ("Yes", 1), (" YES ", 1), ("TRUE", 1), ("true", 1), ("1", 1), ("\xa0yes\t", 1),
    ("1.0", 0), ("y", 0), ("no", 0), ("0", 0), ("false", 0), (None, 0), ("", 0),
]


def test_to_bool01(spark):
    df = spark.createDataFrame([(s,) for s, _ in BOOL_CASES], "s string")
    got = [r[0] for r in df.select(to_bool01(F.col("s"))).collect()]
    assert got == [w for _, w in BOOL_CASES]


def test_to_bool01_numeric_columns(spark):
    # a float flag 1.0 stringifies to "1.0" and counts as 0, an int 1 as 1
    df = spark.createDataFrame([(1.0, 1), (0.0, 0)], "f double, i int")
    got = df.select(to_bool01(F.col("f")).alias("f"), to_bool01(F.col("i")).alias("i")).collect()
    assert [(r.f, r.i) for r in got] == [(0, 1), (0, 0)]


def test_ws_trim_matches_python_strip(spark):
    tokens = [" a ", "\ta\n", "\xa0a\xa0", "\x1ca\x1f", " a", "a b", ""]
    df = spark.createDataFrame([(t,) for t in tokens], "s string")
    got = [r[0] for r in df.select(ws_trim(F.col("s"))).collect()]
    assert got == [t.strip() for t in tokens]
    lowered = [r[0] for r in df.select(norm_token(F.col("s"))).collect()]
    assert lowered == [t.strip().lower() for t in tokens]


@pytest.mark.parametrize(
    "text,want",
    [("$1,200.50", 1200.5), ("TBD", 0.0), ("(5)", 0.0), (None, 0.0), ("$0", 0.0), ("12", 12.0)],
)
def test_money_to_num(spark, text, want):
    df = spark.createDataFrame([(text,)], "s string")
    assert df.select(money_to_num(F.col("s"))).first()[0] == want
