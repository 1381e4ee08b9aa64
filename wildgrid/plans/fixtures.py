"""Views over the driver tables: orders play checklists, line items sightings, parts species.

The same text, in both dialects, builds the views here and the common table expressions of the SQL checks.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_DAY = {"spark": "date_add(DATE '2024-01-01', CAST(o_orderkey % 30 AS INT))", "duck": "DATE '2024-01-01' + CAST(o_orderkey % 30 AS INT)"}


def _texts(dialect: str) -> dict[str, str]:
    return {
        "sites": f"""SELECT o_orderkey AS site_id, CAST(o_orderdate AS DATE) AS time,
  CAST(7 AS DOUBLE) + CAST(o_orderkey * 7919 % 6500 AS DOUBLE) / 100 AS latitude, CAST(-170 AS DOUBLE) + CAST(o_orderkey * 104729 % 12000 AS DOUBLE) / 100 AS longitude,
  o_orderpriority AS protocol, n_name AS country, c_mktsegment AS province, {_DAY[dialect]} AS day24
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey""",
        "occurrences": """SELECT l_orderkey AS event_id, p_name AS species, CASE WHEN p_size % 10 = 0 THEN 'GENUS' ELSE 'SPECIES' END AS taxon_rank
  FROM lineitem JOIN part ON l_partkey = p_partkey""",
        "scored": """SELECT p_name AS species, l_linestatus AS model, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y,
  l_quantity / CAST(50 AS DOUBLE) AS p, l_orderkey AS site_id, l_linenumber - 1 AS pass FROM lineitem JOIN part ON l_partkey = p_partkey""",
        "grid_hourly": """SELECT user_id % 312 AS cell, ts, CASE event_type WHEN 'view' THEN '2m_temperature' WHEN 'click' THEN 'total_precipitation'
  WHEN 'error' THEN '2m_dewpoint_temperature' ELSE 'other' END AS var, value FROM events""",
        "raster_static": """SELECT 'dem' AS var, c_custkey % 312 AS cell, max(c_acctbal) AS value FROM customer WHERE c_custkey % 312 % 7 <> 0 GROUP BY c_custkey % 312""",
        "site_cells": """SELECT site_id, CAST(floor((latitude - 7) / 5) AS BIGINT) * 24 + CAST(floor((longitude + 170) / 5) AS BIGINT) AS cell FROM sites""",
        "stations": """SELECT s_suppkey + 10000000 AS site_id, CAST(24 AS DOUBLE) + CAST(s_suppkey * 7919 % 2600 AS DOUBLE) / 100 AS latitude,
  CAST(-125 AS DOUBLE) + CAST(s_suppkey * 104729 % 5900 AS DOUBLE) / 100 AS longitude, CAST(s_suppkey * 31 % 365 AS DOUBLE) AS t_days FROM supplier""",
        "pool": """SELECT c_custkey AS site_id, CAST(24 AS DOUBLE) + CAST(c_custkey * 6151 % 2600 AS DOUBLE) / 100 AS latitude,
  CAST(-125 AS DOUBLE) + CAST(c_custkey * 49157 % 5900 AS DOUBLE) / 100 AS longitude, CAST(c_custkey * 17 % 365 AS DOUBLE) AS t_days FROM customer""",
        "pool_presence": """SELECT DISTINCT o_custkey AS site_id, p_name AS species FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN part ON l_partkey = p_partkey""",
        "epoch_log": f"""SELECT concat('Epoch ', CAST(p_partkey AS {'STRING' if dialect == 'spark' else 'VARCHAR'}), ', val AUC: 0.',
  lpad(CAST(p_size * 10000 + p_partkey % 1000 AS {'STRING' if dialect == 'spark' else 'VARCHAR'}), 6, '0')) AS line FROM part""",
    }


TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
CTE = "WITH " + ",\n".join(f"{name} AS ({text})" for name, text in _texts("duck").items())


class Views:
    """The driver tables and the views over them, read when asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir, self.texts = spark, sf_dir, _texts("spark")

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            return self.spark.read.parquet(f"{self.dir}/{name}.parquet")
        if name not in self.texts:
            raise AttributeError(name)
        text, used = self.texts[name], {}
        for t in (*TABLES, *self.texts):
            for before in ("FROM ", "JOIN "):
                if f"{before}{t}" in text and t != name:
                    text = text.replace(f"{before}{t}", f"{before}{{{t}}}")
                    used[t] = getattr(self, t)
        return self.spark.sql(text, **used)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared checkpoint folder that the session names; without one, in a temporary folder in local mode, and an error on a cluster.

    What is written there is deleted when the driver ends.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-"))
    path = f"{sc.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path
