"""Writers, and the checks that go with them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Species that one whole number of a site tells.
BITS = 63


def wide_table(sites: DataFrame, env: DataFrame, presence: DataFrame, species: Sequence[str], env_order: Sequence[str] = ()) -> DataFrame:
    """Meta columns, covariates (the known order first, others behind), then a 0/1 column per species.  For export only.

    Until the columns are written, a site's species are bits of a few whole numbers, so that tasks hold and sort narrow rows.
    """
    known = [c for c in env_order if c in env.columns] + sorted(c for c in env.columns if c not in env_order and c != "site_id")
    where = F.create_map(*(F.lit(x) for i, s in enumerate(species) for x in (s, i))) if species else F.lit(None).cast("map<string,int>")
    at = presence.select("site_id", where[F.col("species")].alias("_at"))
    words = range(0, len(species), BITS)
    bits = at.groupBy("site_id").agg(*(F.bit_or(F.when((F.col("_at") >= k) & (F.col("_at") < k + BITS), F.call_function("shiftleft", F.lit(1).cast("long"), F.col("_at") - k))).alias(f"_bits{k}") for k in words)) if species else at.select("site_id").distinct()
    bit = lambda i: F.coalesce(F.call_function("bit_get", F.col(f"_bits{i - i % BITS}"), F.lit(i % BITS)).cast("int"), F.lit(0))
    out = sites.join(env, "site_id").join(bits, "site_id", "left")
    return out.select(*sites.columns, *known, *(bit(i).alias(s) for i, s in enumerate(species)))


def write_site_table(wide: DataFrame, path: str, kind: str = "parquet") -> None:
    wide.write.csv(path, header=True) if kind == "csv" else wide.write.parquet(path)


def save_splits(splits: DataFrame, path: str) -> None:
    splits.write.partitionBy("split").parquet(path)


def load_splits(spark: SparkSession, path: str, sites: DataFrame) -> DataFrame:
    """The saved split, or an error if the sites are not those it was made for."""
    from ..operators.splits import checked_against

    splits = spark.read.parquet(path)
    r = checked_against(splits, sites).first()
    if r.n_unsplit or r.n_gone:
        raise ValueError(f"the split has {r.n_split} sites, the data {r.n_sites}: {r.n_unsplit} new, {r.n_gone} gone")
    return splits


def export_bundle(path: str, sites: DataFrame, env: DataFrame, presence: DataFrame, splits: DataFrame, static: Sequence[str]) -> None:
    """What a trainer outside of Spark reads: dynamic and static covariates, species, presences and the split."""
    parts = {
        "dynamic": sites.join(env.drop(*static), "site_id"), "static": env.select("site_id", *(c for c in env.columns if c in static)),
        "species": presence.select("species").distinct(), "presence": presence, "splits": splits,
    }
    for name, df in parts.items():
        df.write.parquet(f"{path}/{name}")


def check_bundle(spark: SparkSession, path: str) -> DataFrame:
    """(check, passed, n): row counts agree, presences and splits point to sites and species that are there."""
    t = {n: spark.read.parquet(f"{path}/{n}") for n in ("dynamic", "static", "species", "presence", "splits")}
    count = lambda name, df: df.agg(F.lit(name).alias("check"), F.count("*").alias("n"))
    lost = {
        "static rows without dynamic": t["static"].join(t["dynamic"], "site_id", "left_anti"), "dynamic rows without static": t["dynamic"].join(t["static"], "site_id", "left_anti"),
        "presences without a site": t["presence"].join(t["dynamic"], "site_id", "left_anti"), "presences without a species": t["presence"].join(t["species"], "species", "left_anti"),
        "splits without a site": t["splits"].join(t["dynamic"], "site_id", "left_anti"), "sites without a split": t["dynamic"].join(t["splits"], "site_id", "left_anti"),
    }
    out = None
    for name, df in lost.items():
        out = count(name, df) if out is None else out.union(count(name, df))
    return out.withColumn("passed", F.col("n") == 0)


def write_metrics(metrics: DataFrame, path: str, by: Sequence[str] = ()) -> None:
    writer = metrics.write.mode("overwrite")
    (writer.partitionBy(*by) if by else writer).parquet(path)


def write_run(path: str, parameters: dict[str, object], **tables: DataFrame) -> None:
    """The record of a run: each table (epochs, summary, convergence, test results, ...) and the parameters as names and values."""
    spark = next(iter(tables.values())).sparkSession
    spark.createDataFrame([(k, str(v)) for k, v in sorted(parameters.items())], "name string, value string").write.mode("overwrite").parquet(f"{path}/parameters")
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p))


def needs_refresh(spark: SparkSession, path: str, given: DataFrame, key: str) -> DataFrame:
    """(key, n_in, n_out) of the keys whose rows at path are missing or are not as many as those given."""
    want = given.groupBy(key).agg(F.count("*").alias("n_in"))
    have = spark.read.parquet(path).groupBy(key).agg(F.count("*").alias("n_out")) if exists(spark, path) else want.select(key, F.lit(0).cast("long").alias("n_out")).limit(0)
    return want.join(have, key, "left").withColumn("n_out", F.coalesce("n_out", F.lit(0))).where("n_in <> n_out")
