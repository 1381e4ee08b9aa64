"""The streaming roll-up gives what the batch gives, on the days that are closed."""

from pyspark.sql import functions as F

from wildgrid.operators.covariates import daily
from wildgrid.plans.fixtures import Views
from wildgrid.streaming.daily import daily_stream


def test_stream_equals_batch(spark, sf_dir, tmp_path):
    hourly = Views(spark, sf_dir).grid_hourly
    hourly.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(hourly.schema).parquet(str(tmp_path / "in"))
    q = daily_stream(stream).writeStream.format("memory").queryName("daily_out").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    got = {(r.cell, r.day): r["2m_temperature_max"] for r in spark.sql("select * from daily_out").collect()}
    last = hourly.agg(F.max("ts")).first()[0]
    want = {(r.cell, r.day): r["2m_temperature_max"] for r in daily(hourly).collect()}
    assert got and all(want[k] == v for k, v in got.items())
    assert {k for k in want if (last.date() - k[1]).days >= 2} <= set(got)
