from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """The Parquet table `name` in `directory`, a single file or a folder of part files.

    The schema comes from the Parquet footer: with a declared schema Spark would read a
    missing column as nulls instead of failing.
    """
    return spark.read.parquet(f"{directory.rstrip('/')}/{name}.parquet")
