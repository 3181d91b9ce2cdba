"""Numbers of any size: tokens and comparison against the decimal module."""

import decimal
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from assayer.functions import cells as C

decimal.getcontext().prec = 6000
decimal.getcontext().Emax, decimal.getcontext().Emin = 10**17, -(10**17)

TEXTS = [
    "0", "-0.00", "1", "+1.50", "-12.340", "1e401", "10e400", "1E-401", "0.1e-400", "1e40", "1e41", "1e-40", "1e-41", "0." + "0" * 60 + "5",
    "1" + "0" * 500, "1e500", "1.25e3", "-1.0e-7", "0.1234567890123456781", "0.1234567890123456782", "10000000000000000000000000",
    "10000000000000000000000001", "123456789012345678901234567890.125", "9" * 60, "9" * 59 + "8", "1e999999999", "10e999999998", "2e999999999",
]


def value(text):
    return Decimal(text)


def tokens(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    out = df.select("i", C.cell_token(C.make_cell(F.lit("x"), F.lit("str"), F.col("t"))).alias("tok")).orderBy("i").collect()
    return [r.tok for r in out]


def test_equal_values_have_equal_tokens(spark):
    found = tokens(spark, TEXTS)
    for a, x in zip(TEXTS, found):
        for b, y in zip(TEXTS, found):
            if value(a) != 0:
                assert (x == y) == (value(a) == value(b)), (a, b, x, y)


def compared(spark, cases):
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, g string, p string, a double, r double")
    cell = lambda c, kind: C.make_cell(F.lit("x"), F.lit(kind), F.col(c))
    df = df.withColumn("v", C.prepare(F.array(cell("g", "num"), cell("p", "num"))))
    equal = C.cells_equal(F.col("v")[0], F.col("v")[1], F.col("a"), F.col("r"))
    return [r.e for r in df.select("i", equal.alias("e")).orderBy("i").collect()]


@pytest.mark.parametrize(("gold", "pred", "tol", "equal"), [
    ("1e401", "10e400", 0.0, True), ("1e401", "2e401", 0.0, False), ("1" + "0" * 60, "1e60", 0.0, True), ("9" * 60, "9" * 59 + "8", 0.0, False),
    ("0.1234567890123456781", "0.1234567890123456782", 0.0, False), ("0.1234567890123456781", "0.1234567890123456782", 1e-6, True),
    ("10000000000000000000000000", "10000000000000000000000001", 0.0, False), ("10000000000000000000000000", "10000000000000000000000001", 1.0, True),
    ("10000000000000000000000000", "10000000000000000000000001", 0.5, False), ("33.33", "33.3333333333333333333333333333", 0.0, False),
    ("33.33", "33.3333333333333333333333333333", 0.01, True), ("1e-30", "2e-30", 0.0, False), ("1e-30", "0", 1e-6, True), ("12.5", "12.50", 0.0, True),
    ("33.33", "33.333333", 0.0, True), ("2", "2.5", 0.0, True), ("3", "2.5", 0.0, False), ("-1e25", "1e25", 1.0, False),
])
def test_comparison(spark, gold, pred, tol, equal):
    assert compared(spark, [(gold, pred, tol, 0.0)]) == [equal]
