from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from fieldlark.functions import scalars as s


def one(spark, expr, schema, *row):
    return spark.createDataFrame([row], schema).select(expr).first()[0]


@pytest.mark.parametrize(("text", "want"), [("1.5", 1.5), ("-2e3", -2000.0), (".5", 0.5), ("5.", 5.0), (" 1.5", None), ("1.5d", None), ("nan", None), ("inf", None), ("1_0", None), ("", None), (None, None)])
def test_strict_float(spark, text, want):
    assert one(spark, s.strict_float(F.col("t")), "t string", text) == want


@pytest.mark.parametrize(("day", "clock", "want"), [("2004-03-01", "01:02:03.4", "2004-03-01 01:02:03.400000"), ("2004-03-01", "01:02:03", "2004-03-01 01:02:03.000000"), ("2004-03-01", "01:02:03.1234567", "2004-03-01 01:02:03.123456"), ("2004-3-1", "01:02:03", None), ("2004-02-30", "01:02:03", None), ("2004-03-01", "25:00:00", None), ("x", "y", None)])
def test_strict_instant(spark, day, clock, want):
    got = one(spark, F.date_format(s.strict_instant(F.col("d"), F.col("c")), "yyyy-MM-dd HH:mm:ss.SSSSSS"), "d string, c string", day, clock)
    assert got == want


@pytest.mark.parametrize(("x", "n", "want"), [(1.005, 2, 1.0), (0.125, 2, 0.13), (-0.5, 0, 0.0), (2.5, 0, 3.0), (None, 2, None)])
def test_rounded(spark, x, n, want):
    assert one(spark, s.rounded(F.col("x"), n), "x double", x) == want


def test_clipped_keeps_null(spark):
    assert [r[0] for r in spark.createDataFrame([(None,), (-1.0,), (2.0,)], "x double").select(s.clipped(F.col("x"))).collect()] == [None, 0.0, 2.0]


def test_no_nan(spark):
    assert one(spark, s.no_nan(F.col("x")), "x double", math.nan) is None


def test_numbers(spark):
    assert sorted(one(spark, s.numbers(F.col("t")), "t string", "r2=0.77554 and -1.5e3, 3 or 0.775539")) == [-1500.0, 0.7755]


def test_digest(spark):
    import hashlib

    assert one(spark, s.short_digest(F.col("t")), "t string", "é") == hashlib.sha256("é".encode()).hexdigest()[:16]
