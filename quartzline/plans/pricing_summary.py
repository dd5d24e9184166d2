from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quartzline.operators import exact_sums


def pricing_summary(lineitem: DataFrame, shipped_by: str | datetime = "2001-09-01 00:00:00") -> DataFrame:
    """Quantity, price and line count per return flag and line status, for lines shipped by a time.

    `shipped_by` is wall-clock time like `l_shipdate`, so the session time zone plays no part. It is
    a datetime or ISO text; a malformed one, or one with a zone, raises ValueError.
    """
    time = shipped_by if isinstance(shipped_by, datetime) else datetime.fromisoformat(shipped_by)
    if time.tzinfo is not None:
        raise ValueError(f"shipped_by has a time zone: {shipped_by}")
    shipped = lineitem.where(F.col("l_shipdate") <= F.lit(time.isoformat(" ")).cast("timestamp_ntz"))
    return exact_sums(
        shipped,
        by=["l_returnflag", "l_linestatus"],
        sums={"sum_qty": "l_quantity", "sum_price": "l_extendedprice"},
        count="n",
    )
