"""The driver contract, and every registered query against its SQL in DuckDB."""

from __future__ import annotations

import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as contract
from tests.conftest import TESTDATA

SPARK_TYPE = {"VARCHAR": "string", "BIGINT": "bigint", "DECIMAL(38,2)": "decimal(38,2)"}


def oracle(sql, sf_dir, tables=("lineitem",)):
    with duckdb.connect() as con:
        for table in tables:
            con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{sf_dir}/{table}.parquet')")
        result = con.execute(sql)
        schema = [(column[0], SPARK_TYPE[str(column[1])]) for column in result.description]
        return schema, sorted(result.fetchall())


def test_entry(spark):
    result = contract.entry(spark)
    assert result.columns == ["l_returnflag", "l_linestatus", "sum_qty", "sum_price", "n"]
    assert result.count() == 6


@pytest.mark.parametrize("package", ["zstandard", "tokenizers", "quartzline.llm", "corpus_pipeline"])
def test_imports_without_corpus_packages(package):
    """A missing package, the subpackage or the pipeline takes only the corpus queries away."""
    code = f"import sys; sys.modules[{package!r}] = None; import __spark_entry__ as e; print(sorted(e.queries()), sorted(e.oracle_sql()))"
    run = subprocess.run([sys.executable, "-W", "ignore", "-c", code], cwd=Path(__file__).resolve().parent.parent, capture_output=True, text=True, check=True)
    assert "'pricing_summary'" in run.stdout
    if package in ("zstandard", "quartzline.llm", "corpus_pipeline"):
        assert run.stdout.strip() == "['pricing_summary'] ['pricing_summary']"


def test_oracle_names_are_registered_queries():
    assert set(contract.oracle_sql()) <= set(contract.queries())


@pytest.mark.parametrize("sf", ["0.001", "0.01", "0.1"])
@pytest.mark.parametrize("name", ["pricing_summary"])
def test_matches_oracle(spark, name, sf):
    sf_dir = f"{TESTDATA}/sf{sf}"
    result = contract.queries()[name](spark, sf_dir)
    schema, rows = oracle(contract.oracle_sql()[name], sf_dir)
    assert result.dtypes == schema
    assert sorted(map(tuple, result.collect())) == rows
    assert rows


def test_fixture_matches_oracle(spark, tmp_path):
    """Nulls in every column, ties at the cut-off, negative amounts, a group of nulls only."""
    rows = [
        ("A", "F", 1.0, 10.25, "2001-09-01 00:00:00"),
        ("A", "F", 2.0, -0.01, "2001-09-01 00:00:00.000001"),
        ("A", "F", -3.5, -10.26, "1995-01-02 00:00:00"),
        ("A", "F", None, 0.1, "1995-01-02 00:00:00"),
        ("A", "F", 0.2, None, "1995-01-02 00:00:00"),
        ("A", None, 0.1, 0.2, "1995-01-02 00:00:00"),
        (None, None, 0.1, 0.2, "1995-01-02 00:00:00"),
        ("N", "O", None, None, "1995-01-02 00:00:00"),
        ("N", "O", None, None, "1995-01-02 00:00:00"),
        ("R", "O", 5.0, 5.0, None),
        ("R", "F", 5.0, 5.0, "2001-09-02 00:00:00"),
        ("", "F", -0.0, 99999999999.99, "1900-01-01 00:00:00"),
        *(("H", "F", sign * 1.005, sign * (i + 0.285), "1995-01-02 00:00:00") for i in range(20) for sign in (1, -1, 1)),
    ]
    lineitem = spark.createDataFrame(
        rows, "l_returnflag string, l_linestatus string, l_quantity double, l_extendedprice double, l_shipdate string"
    ).selectExpr("* EXCEPT (l_shipdate)", "CAST(l_shipdate AS timestamp_ntz) AS l_shipdate")
    lineitem.coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")

    result = contract.queries()["pricing_summary"](spark, str(tmp_path))
    with duckdb.connect() as con:
        con.execute(f"CREATE VIEW lineitem AS SELECT * FROM read_parquet('{tmp_path}/lineitem.parquet/*.parquet')")
        expected = con.execute(contract.oracle_sql()["pricing_summary"]).fetchall()
    assert sorted(map(tuple, result.collect()), key=repr) == sorted(expected, key=repr)
    assert len(expected) == 6


def test_empty_table(spark, tmp_path):
    spark.read.parquet(f"{TESTDATA}/sf0.001/lineitem.parquet").where("false").write.parquet(f"{tmp_path}/lineitem.parquet")
    assert contract.queries()["pricing_summary"](spark, str(tmp_path)).collect() == []
