"""`hundredths` against Spark's own cast and against Python decimals."""

from __future__ import annotations

import math
import random
import struct
from decimal import ROUND_HALF_UP, Decimal

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from quartzline.functions import hundredths

LIMIT = 9_999_999_999_999_999.0  # below 1e16, the first double decimal(18,2) cannot hold
EDGES = [
    0.0, -0.0, 0.005, -0.005, 0.004999999999999999, 0.015, 1.005, 2.675, 0.285, 0.1 + 0.2, 0.29, 0.57, 1.15,
    5e-324, -5e-324, 1e-10, 1e12, 1e13, -1e13, 1e13 - 0.01, 1e13 + 0.01, 2.0**53, 2.0**53 / 100, 9999999999999998.0,
    -9999999999999998.0, 90071992547409.91, 90071992547409.92, 45035996273704.95, 104999.91,
]


def frame(spark, values):
    return spark.createDataFrame([(v,) for v in values], "x double")


def assert_equals_cast(spark, values):
    got = frame(spark, values).select(
        "x", F.expr(hundredths("x")).alias("fast"), F.expr("CAST(CAST(x AS DECIMAL(18,2)) * 100 AS BIGINT)").alias("cast")
    )
    assert got.where("NOT fast <=> cast").collect() == []


def test_edges(spark):
    assert_equals_cast(spark, [*EDGES, None])
    got = {r.x: r.h for r in frame(spark, EDGES).select("x", F.expr(hundredths("x")).alias("h")).collect()}
    for x, h in got.items():
        assert h == int(Decimal(repr(x)).quantize(Decimal("0.01"), ROUND_HALF_UP).scaleb(2)), x


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    st.lists(
        st.one_of(
            st.none(),
            st.floats(min_value=-LIMIT, max_value=LIMIT, exclude_min=True, exclude_max=True),
            st.integers(-(10**17), 10**17).map(lambda c: c / 100),
            st.integers(-(10**12), 10**12).map(lambda m: m / 1000),
        ),
        min_size=50,
        max_size=400,
    )
)
def test_any_double(spark, values):
    assert_equals_cast(spark, values)


def test_many_doubles(spark):
    rng = random.Random(7)
    values = [rng.randrange(-(10**k), 10**k) / 100 for k in range(1, 18) for _ in range(2000)]
    values += [rng.randrange(-(10**k), 10**k) / 1000 for k in range(1, 15) for _ in range(2000)]
    values += [math.nextafter(v, rng.choice([-1e300, 1e300])) for v in values]
    while len(values) < 150_000:  # any bit pattern
        v = struct.unpack("d", rng.randbytes(8))[0]
        if abs(v) < 9.99e15:
            values.append(v)
    assert_equals_cast(spark, [v for v in values if abs(v) < 9.99e15])


@pytest.mark.parametrize("ansi", ["true", "false"])
@pytest.mark.parametrize("value", [math.nan, math.inf, -math.inf, 1e16, -1e300])
def test_values_that_do_not_fit_fail(spark, conf, ansi, value):
    conf("spark.sql.ansi.enabled", ansi)
    with pytest.raises(PySparkException):
        frame(spark, [1.0, value, 2.0]).selectExpr(hundredths("x")).collect()


def test_same_without_ansi(spark, conf):
    conf("spark.sql.ansi.enabled", "false")
    assert_equals_cast(spark, [*EDGES, None])


def test_odd_column_name(spark):
    df = frame(spark, [1.25]).toDF("a `b`.c")
    assert df.selectExpr(hundredths("a `b`.c")).first()[0] == 125


@pytest.mark.parametrize("type_", ["float", "int", "bigint", "decimal(15,2)", "decimal(18,4)"])
def test_other_numeric_types(spark, type_):
    values = [0.0, 0.1, -0.1, 1.005, 123456.785, -99999.99, 7.0, None]
    amounts = frame(spark, values).selectExpr(f"CAST(x AS {type_}) AS x")
    pairs = amounts.selectExpr(f"{hundredths('x')} AS fast", "CAST(CAST(x AS DECIMAL(18,2)) * 100 AS BIGINT) AS cast")
    assert pairs.where("NOT fast <=> cast").collect() == []
