"""Readers of the formats that the data come in."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

COORDINATES = ("time", "latitude", "longitude")
EVENTS = T.StructType([T.StructField(n, t) for n, t in (("id", T.StringType()), ("eventDate", T.StringType()), ("year", T.IntegerType()), ("country", T.StringType()), ("stateProvince", T.StringType()), ("decimalLatitude", T.DoubleType()), ("decimalLongitude", T.DoubleType()), ("samplingProtocol", T.StringType()))])
OCCURRENCES = T.StructType([T.StructField(n, T.StringType()) for n in ("eventID", "scientificName", "taxonRank")])
PLOTS = T.StructType([T.StructField(n, t) for n, t in (("PlotObservationID", T.LongType()), ("Date_of_recording", T.StringType()), ("Continent", T.StringType()), ("Country", T.StringType()), ("Latitude", T.DoubleType()), ("Longitude", T.DoubleType()), ("Resample_1_consensus", T.BooleanType()))])
PLOT_SPECIES = T.StructType([T.StructField("PlotObservationID", T.LongType()), T.StructField("Species", T.StringType())])


@dataclass(frozen=True)
class ColumnRoles:
    """Which columns are coordinates, covariates and species."""

    coordinates: tuple[str, ...]
    env: tuple[str, ...]
    species: tuple[str, ...]

    @classmethod
    def of(cls, columns: Sequence[str], env: Sequence[str] | None = None, ids: Sequence[str] = ("site_id",)) -> ColumnRoles:
        rest = [c for c in columns if c not in COORDINATES and c not in ids]
        covariates = list(env) if env is not None else [c for c in rest if c.startswith("env_")]
        if gone := [c for c in covariates if c not in columns]:
            raise ValueError(f"no such columns: {', '.join(gone)}")
        return cls(tuple(c for c in COORDINATES if c in columns), tuple(covariates), tuple(c for c in rest if c not in covariates))


def site_table(spark: SparkSession, path: str, env: Sequence[str] | None = None, no_time: bool = False) -> tuple[DataFrame, DataFrame, DataFrame, ColumnRoles]:
    """A wide table of sites -> sites, env, presence (long, present only) and the roles.  A column site_id is the key."""
    wide = spark.read.csv(path, header=True)
    roles = ColumnRoles.of(wide.columns, env)
    time = F.to_date("time") if "time" in roles.coordinates and not no_time else F.lit(None).cast("date")
    key = F.col("site_id").cast("long").alias("site_id")
    sites = wide.select(key, time.alias("time"), *(F.col(c).cast("double").alias(c) for c in ("latitude", "longitude")))
    covariates = wide.select(key, *(F.col(f"`{c}`").cast("double").alias(c) for c in roles.env))
    long = wide.select(key, *(F.col(f"`{c}`").cast("double").alias(c) for c in roles.species)).unpivot("site_id", list(roles.species), "species", "present") if roles.species else None
    presence = long.where("present = 1").select("site_id", "species") if long is not None else sites.select("site_id", F.lit("").alias("species")).limit(0)
    return sites, covariates, presence, roles


def _tsv(spark: SparkSession, path: str, schema: T.StructType, encoding: str = "UTF-8") -> DataFrame:
    return spark.read.csv(path, sep="\t", header=True, schema=schema, encoding=encoding, quote="")


def events(spark: SparkSession, path: str) -> DataFrame:
    names = {"id": "site_id", "eventDate": "date", "stateProvince": "province", "decimalLatitude": "latitude", "decimalLongitude": "longitude", "samplingProtocol": "protocol"}
    return _tsv(spark, path, EVENTS).withColumnsRenamed(names)


def occurrences(spark: SparkSession, path: str) -> DataFrame:
    return _tsv(spark, path, OCCURRENCES).withColumnsRenamed({"eventID": "event_id", "scientificName": "species", "taxonRank": "taxon_rank"})


def plots(spark: SparkSession, path: str) -> DataFrame:
    names = {"PlotObservationID": "site_id", "Date_of_recording": "date", "Continent": "continent", "Country": "country", "Latitude": "latitude", "Longitude": "longitude", "Resample_1_consensus": "consensus"}
    return _tsv(spark, path, PLOTS, "ISO-8859-1").withColumnsRenamed(names)


def plot_species(spark: SparkSession, path: str, wanted: DataFrame | None = None) -> DataFrame:
    """Records of the wanted plots only (site_id), if given."""
    rows = _tsv(spark, path, PLOT_SPECIES, "ISO-8859-1").withColumnsRenamed({"PlotObservationID": "event_id", "Species": "species"})
    return rows if wanted is None else rows.join(wanted, rows.event_id == wanted.site_id, "left_semi")


def tile_index(files: DataFrame, name: str = "name") -> DataFrame:
    """(year, doy, h, v, name) of the composite files in a listing; other names are left out."""
    pattern = r"MOD13Q1\.A(\d{4})(\d{3})\.h(\d{2})v(\d{2})"
    part = lambda i: F.regexp_extract(name, pattern, i).cast("int")
    return files.where(F.col(name).rlike(pattern)).select(*(part(i).alias(n) for i, n in enumerate(("year", "doy", "h", "v"), 1)), name)


def epoch_log(lines: DataFrame, line: str = "line", strict: bool = False) -> DataFrame:
    """(epoch, auc) from lines of a training log; strict: an error if there are none."""
    pattern = r"Epoch (\d+), val AUC: ([\d.]+)"
    out = lines.where(F.col(line).rlike(pattern)).select(F.regexp_extract(line, pattern, 1).cast("int").alias("epoch"), F.regexp_extract(line, pattern, 2).cast("double").alias("auc"))
    if strict and not out.limit(1).count():
        raise ValueError("no epoch found in the log")
    return out


def predictions(spark: SparkSession, path: str, cov_set: str = "full") -> DataFrame:
    """All prediction files under a glob, one table; a missing cov_set is filled in."""
    rows = spark.read.csv(path, header=True, schema="site_id long, species string, cov_set string, split string, predicted double, actual int")
    return rows.withColumn("cov_set", F.coalesce("cov_set", F.lit(cov_set)))
