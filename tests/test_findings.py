"""Values that must fail whatever the ANSI setting, and names that clash."""

from __future__ import annotations

from datetime import datetime, timezone

import pytest
from pyspark.errors import PySparkException

from quartzline.functions.money import MOST_ROWS, within_rows
from quartzline.operators import exact_sums
from quartzline.plans import pricing_summary
from quartzline.sources import read_table
from tests.conftest import TESTDATA


@pytest.mark.parametrize("ansi", ["true", "false"])
@pytest.mark.parametrize("time", ["garbage", "2001-13-01", "2001-09-01 00:00:00+05:00", "2001-09-01T00:00:00Z", datetime(2001, 9, 1, tzinfo=timezone.utc)])
def test_bad_ship_times_fail(spark, conf, ansi, time):
    conf("spark.sql.ansi.enabled", ansi)
    with pytest.raises(ValueError):
        pricing_summary(read_table(spark, f"{TESTDATA}/sf0.001", "lineitem"), time)


def test_ship_time_as_datetime(spark):
    lineitem = read_table(spark, f"{TESTDATA}/sf0.001", "lineitem")
    assert sorted(pricing_summary(lineitem, datetime(2001, 9, 1)).collect()) == sorted(pricing_summary(lineitem).collect())


@pytest.mark.parametrize("ansi", ["true", "false"])
def test_too_many_rows_fail(spark, conf, ansi):
    conf("spark.sql.ansi.enabled", ansi)
    rows = spark.createDataFrame([(MOST_ROWS,)], "n long")
    assert rows.selectExpr(within_rows("7", "n")).first()[0] == 7
    with pytest.raises(PySparkException):
        rows.selectExpr(within_rows("7", "n + 1")).collect()


@pytest.mark.parametrize(("by", "sums", "count"), [(["k"], {"t": "x"}, "k"), (["k"], {"t": "x"}, "T"), (["k"], {"k": "x"}, "n")])
def test_clashing_names_fail(spark, by, sums, count):
    with pytest.raises(ValueError):
        exact_sums(spark.createDataFrame([("a", 1.0)], "k string, x double"), by, sums, count)
