"""The daily roll-up over a stream of hourly readings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.covariates import DAILY


def daily_stream(hourly: DataFrame, late: str = "2 hours") -> DataFrame:
    """As covariates.daily, for days that the watermark has closed (append mode)."""
    v = lambda var: F.when(F.col("var") == var, F.col("value"))
    f = {"min": F.min, "max": F.max, "mean": F.avg, "sum": F.sum}
    known = [f[s](v(var)).alias(f"{var}_{s}") for var, stats in DAILY.items() for s in stats]
    hourly = hourly.withColumn("ts", F.col("ts").cast("timestamp"))  # in the session time zone where it has none
    windows = hourly.withWatermark("ts", late).groupBy("cell", F.window("ts", "1 day").alias("w"))
    return windows.agg(*known, F.avg(F.when(~F.col("var").isin(*DAILY), F.col("value"))).alias("other_mean")).withColumn("day", F.to_date("w.start")).drop("w")
