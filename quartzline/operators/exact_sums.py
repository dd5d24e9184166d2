from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quartzline.functions import exact_total, hundredths, quoted


def exact_sums(df: DataFrame, by: Sequence[str], sums: Mapping[str, str], count: str) -> DataFrame:
    """Per group of `by`: the exact sum of each double amount, and the number of rows.

    `sums` maps output names to amount columns; `count` names the row count. A sum equals
    `SUM(CAST(amount AS DECIMAL(18,2)))` as decimal(38,2), whatever the order of the rows.

    Keys are top-level columns, not nested fields. Keys, sums and the count need distinct names
    (compared as Spark compares them, without case); others raise ValueError.

    One shuffle. Rows are added up as bigints before it, inside generated code, so it moves
    one row per group and input split however many rows a group holds.
    """
    names = [name.lower() for name in (*by, *sums, count)]
    if clash := sorted({name for name in names if names.count(name) > 1}):
        raise ValueError(f"output names that occur twice: {', '.join(clash)}")
    keys = [quoted(key) for key in by]
    amounts = df.selectExpr(*keys, *(f"{hundredths(c)} AS {quoted(name)}" for name, c in sums.items()))
    totals = (F.expr(exact_total(name)).alias(name) for name in sums)
    return amounts.groupBy(*keys).agg(*totals, F.count("*").alias(count))
