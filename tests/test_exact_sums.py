"""`exact_sums` against brute force, and the plan it gives."""

from __future__ import annotations

import random
from collections import defaultdict
from decimal import ROUND_HALF_UP, Decimal

import pytest

from quartzline.operators import exact_sums
from quartzline.plans import pricing_summary
from quartzline.sources import read_table
from tests.conftest import TESTDATA


def brute_force(rows):
    groups = defaultdict(lambda: [None, 0])
    for key, amount in rows:
        group = groups[key]
        group[1] += 1
        if amount is not None:
            cents = Decimal(repr(amount)).quantize(Decimal("0.01"), ROUND_HALF_UP)
            group[0] = cents if group[0] is None else group[0] + cents
    return {key: tuple(group) for key, group in groups.items()}


def summed(df):
    return {r.k: (r.total, r.n) for r in exact_sums(df, ["k"], {"total": "x"}, count="n").collect()}


@pytest.mark.parametrize("partitions", [1, 3, 16])
def test_brute_force_with_a_hot_key(spark, partitions):
    rng = random.Random(partitions)
    rows = [
        (
            "hot" if rng.random() < 0.5 else rng.choice(["a", "b", None]),
            rng.choice([None, rng.randrange(-(10**9), 10**9) / 100, rng.uniform(-1e6, 1e6), rng.uniform(-1e15, 1e15)]),
        )
        for _ in range(6000)
    ]
    df = spark.createDataFrame(rows, "k string, x double").repartition(partitions)
    assert summed(df) == brute_force(rows)


def test_totals_beyond_bigint_and_decimal_18(spark):
    """A group may total more than 2**63 hundredths, or 1e16 units."""
    top = 9999999999999998.0
    rows = [("up", top)] * 5000 + [("down", -top)] * 5000 + [("both", top), ("both", -top), ("both", 0.01)]
    assert summed(spark.createDataFrame(rows, "k string, x double")) == {
        "up": (Decimal("9999999999999998.00") * 5000, 5000),
        "down": (Decimal("-9999999999999998.00") * 5000, 5000),
        "both": (Decimal("0.01"), 3),
    }


@pytest.mark.parametrize("cents", [2**20 - 1, 2**20, 2**40 - 1, 2**40, -1, -(2**20), -(2**20) - 1, -(2**40), -(2**40) - 1])
def test_part_boundaries(spark, cents):
    rows = [("a", cents / 100)] * 3
    assert summed(spark.createDataFrame(rows, "k string, x double")) == {"a": (Decimal(cents) * 3 / 100, 3)}


def test_all_rows_in_one_group(spark):
    lineitem = read_table(spark, f"{TESTDATA}/sf0.01", "lineitem")
    shipped_by = "2001-09-01 00:00:00"
    spread = pricing_summary(lineitem, shipped_by).collect()
    flat = lineitem.selectExpr("* EXCEPT (l_returnflag, l_linestatus)", "'A' AS l_returnflag", "'F' AS l_linestatus")
    (one,) = pricing_summary(flat, shipped_by).collect()
    assert (one.sum_qty, one.sum_price, one.n) == tuple(sum(r[c] for r in spread) for c in ("sum_qty", "sum_price", "n"))


def test_same_result_in_any_partitioning_and_time_zone(spark, conf):
    lineitem = read_table(spark, f"{TESTDATA}/sf0.01", "lineitem")
    expected = sorted(map(tuple, pricing_summary(lineitem).collect()))
    for partitions, zone in ((1, "UTC"), (5, "America/Los_Angeles"), (64, "Asia/Kolkata")):
        conf("spark.sql.session.timeZone", zone)
        assert sorted(map(tuple, pricing_summary(lineitem.repartition(partitions)).collect())) == expected


def test_plan(spark, conf):
    conf("spark.sql.adaptive.enabled", "false")  # shows the code generation stages
    query = pricing_summary(read_table(spark, f"{TESTDATA}/sf0.01", "lineitem"))
    plan = query._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
    assert plan.count("HashAggregate") == 2
    assert "*(1) HashAggregate" in plan and "*(2) HashAggregate" in plan
    assert "LessThanOrEqual(l_shipdate,2001-09-01T00:00)" in plan  # offered; Spark 4.1 skips no row groups on it
    scan = query._jdf.queryExecution().executedPlan().collectLeaves().head()
    read = scan.requiredSchema().fieldNames()
    assert sorted(read) == ["l_extendedprice", "l_linestatus", "l_quantity", "l_returnflag", "l_shipdate"]
    for slow in ("Python", "Sort", "Cartesian", "Broadcast", "Window"):
        assert slow not in plan


def test_shuffle_moves_one_row_per_group_and_split(spark, conf):
    conf("spark.sql.adaptive.enabled", "false")  # keeps the exchange visible in the plan
    lineitem = spark.read.parquet(*[f"{TESTDATA}/sf0.1/lineitem.parquet"] * 6)
    query = pricing_summary(lineitem)
    groups = len(query.collect())
    exchange = query._jdf.queryExecution().executedPlan().children().head()
    while "Exchange" not in exchange.nodeName():
        exchange = exchange.children().head()
    written = exchange.metrics().apply("shuffleRecordsWritten").value()
    assert groups == 6
    assert 0 < written <= groups * lineitem.rdd.getNumPartitions()


@pytest.mark.parametrize(
    ("key", "value"),
    [
        ("spark.sql.ansi.enabled", "false"),
        ("spark.sql.decimalOperations.allowPrecisionLoss", "false"),
        ("spark.sql.caseSensitive", "true"),
        ("spark.sql.ansi.doubleQuotedIdentifiers", "true"),
        ("spark.sql.codegen.wholeStage", "false"),
        ("spark.sql.parquet.enableVectorizedReader", "false"),
        ("spark.sql.timestampType", "TIMESTAMP_NTZ"),
        ("spark.sql.adaptive.enabled", "false"),
        ("spark.sql.shuffle.partitions", "1"),
    ],
)
def test_session_settings_do_not_change_the_result(spark, conf, key, value):
    def result():
        return sorted(map(tuple, pricing_summary(read_table(spark, f"{TESTDATA}/sf0.01", "lineitem")).collect()))

    expected = result()
    conf(key, value)
    assert result() == expected


def test_ship_month_folders_are_pruned(spark, conf, tmp_path):
    """The layout advised in the README for early ship times."""
    conf("spark.sql.adaptive.enabled", "false")  # keeps the scan visible in the plan
    lineitem = read_table(spark, f"{TESTDATA}/sf0.01", "lineitem")
    by_month = lineitem.selectExpr("*", "date_format(l_shipdate, 'yyyy-MM') AS ship_month").repartition("ship_month")
    by_month.write.partitionBy("ship_month").parquet(f"{tmp_path}/lineitem.parquet")

    cutoff = "1995-06-15 00:00:00"
    query = pricing_summary(read_table(spark, str(tmp_path), "lineitem").where("ship_month <= '1995-06'"), cutoff)
    rows = sorted(map(tuple, query.collect()))
    assert rows == sorted(map(tuple, pricing_summary(lineitem, cutoff).collect()))
    scan = query._jdf.queryExecution().executedPlan().collectLeaves().head()
    read = scan.metrics().apply("numOutputRows").value()
    assert sum(r[-1] for r in rows) <= read < lineitem.count() / 10
