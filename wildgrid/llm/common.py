"""Small helpers that several text operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A document without an id sorts after every document that has one.
NO_ID = 2**63 - 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the session names; without one, a temporary folder in local mode and an error on a cluster."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-"))
    return sc.getCheckpointDir()


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared checkpoint folder and read it back, so that lost executors cost no recomputation.

    The table is deleted when the driver ends.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path)


def fresh(name: str, *frames: DataFrame) -> str:
    """name, with underscores in front until no frame has a column of that name."""
    taken = {c.lower() for f in frames for c in f.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ids_and_texts(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id as a long, text without nulls, and other columns as asked for."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"), *more)


def chunks(batches: Iterator[pa.RecordBatch], text: str = "text", size: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """Cut batches so that the texts of a piece hold about `size` bytes (a longer text comes alone)."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        lengths = pc.binary_length(column).fill_null(0).to_numpy(zero_copy_only=False)
        start, held = 0, 0
        for i, n in enumerate(lengths.tolist()):
            if held and held + n > size:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n + 1
        if start < batch.num_rows:
            yield batch.slice(start)


def text_bytes(column: pa.Array) -> list[bytes]:
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()
