"""Named queries over the driver tables and the SQL that checks them.

of fixtures; the SQL starts from the same views as common table expressions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expr import composite_start, fourier, lapse_corrected, logit, number, sanitised, sigmoid, space_time, uniform, wrap_longitude
from ..operators import covariates as cov
from ..operators import geo, masking, metrics, models, neighbours, prepare, splits
from ..sources import readers, sinks
from .fixtures import CTE, Views, scratch

QUERIES: dict[str, Callable] = {}
ORACLE_SQL: dict[str, str] = {}
COUNTRIES = ("NATION_1", "NATION_2", "NATION_3", "NATION_17", "NATION_24")
WITHOUT = ("MACHINERY", "FURNITURE")
WEAK = ("5-LOW", "4-NOT SPECIFIED")

PRES = "pres AS (SELECT DISTINCT event_id AS site_id, species FROM occurrences WHERE taxon_rank = 'SPECIES' AND species IS NOT NULL)"
KEPT = f"kept AS (SELECT * FROM sites WHERE (protocol IS NULL OR protocol NOT IN {WEAK}) AND latitude BETWEEN 7 AND 50 AND longitude BETWEEN -170 AND -50)"
CELLS = "cells AS (SELECT *, CAST(floor((latitude + 90) / 5) AS BIGINT) * 72 + CAST(floor((longitude + 180) / 5) AS BIGINT) AS cell FROM sites)"


def _u(*parts: str) -> str:
    return f"(CAST(('0x' || substr(md5(concat_ws('|', {', '.join(parts)})), 1, 8)) AS BIGINT) / CAST(4294967296 AS DOUBLE))"


def _draw(*parts: str) -> str:
    return f"((CAST(('0x' || substr(md5(concat_ws('|', {', '.join(parts)})), 1, 8)) AS BIGINT) + 1) / CAST(4294967297 AS DOUBLE))"


def _km(a: str, b: str, c: str, d: str) -> str:
    return f"(2 * 6371.0 * asin(least(CAST(1 AS DOUBLE), sqrt(pow(sin(radians({c} - {a}) / 2), 2) + cos(radians({a})) * cos(radians({c})) * pow(sin(radians({d} - {b}) / 2), 2)))))"


def query(name: str, sql: str | None = None, more: str = ""):
    """Register a function of the views; more: further common table expressions of its SQL."""

    def add(f):
        QUERIES[name] = lambda spark, sf_dir: f(Views(spark, sf_dir))
        if sql is not None:
            ORACLE_SQL[name] = f"{CTE}{', ' + more if more else ''} {sql}"
        return f

    return add


def _presence(v: Views) -> DataFrame:
    return prepare.presences(prepare.of_rank(v.occurrences))


def _kept(v: Views) -> DataFrame:
    return prepare.in_region(prepare.structured(v.sites, WEAK), lat=(7.0, 50.0), lon=(-170.0, -50.0))


def _cells(v: Views) -> DataFrame:
    return splits.degree_cells(v.sites, 5.0)


def _env(v: Views) -> DataFrame:
    return cov.raster_values(v.sites.join(v.site_cells, "site_id").select("site_id", "cell"), v.raster_static, ["dem"]).select("site_id", "env_dem", (F.col("cell") % 24).cast("double").alias("env_col"))


ENV = "env AS (SELECT c.site_id, r.value AS env_dem, CAST(c.cell % 24 AS DOUBLE) AS env_col FROM site_cells c LEFT JOIN raster_static r ON c.cell = r.cell)"


# --- sources and sinks ---------------------------------------------------------------------------


def _wide(v: Views) -> tuple[DataFrame, list[str]]:
    species = [r.p_name for r in v.part.select("p_name").distinct().orderBy("p_name").collect()]
    return sinks.wide_table(v.sites.select("site_id", "time", "latitude", "longitude"), _env(v).where("env_dem is not null"), _presence(v), species, ["env_dem"]), species


@query("a01_read_site_table", "SELECT species, count(*) AS n_pres, CAST(sum(CAST(round(env_dem * 100) AS BIGINT)) AS BIGINT) AS dem_cents FROM pres JOIN env USING (site_id) WHERE env_dem IS NOT NULL GROUP BY species", f"{PRES}, {ENV}")
def _(v):
    path = scratch(v.spark, "site_table")
    sinks.write_site_table(_wide(v)[0], path, "csv")
    sites, env, presence, roles = readers.site_table(v.spark, path)
    return presence.join(env, "site_id").groupBy("species").agg(F.count("*").alias("n_pres"), F.sum(F.round(F.col("env_dem") * 100).cast("long")).alias("dem_cents"))


@query("a02_read_events", "SELECT CAST(site_id AS VARCHAR) AS site_id, CAST(time AS VARCHAR) AS date, country, latitude, longitude, protocol FROM sites")
def _(v):
    path = scratch(v.spark, "events")
    out = v.sites.select(F.col("site_id").cast("string").alias("id"), F.col("time").cast("string").alias("eventDate"), F.year("time").alias("year"), "country", F.col("province").alias("stateProvince"), F.col("latitude").alias("decimalLatitude"), F.col("longitude").alias("decimalLongitude"), F.col("protocol").alias("samplingProtocol"))
    out.write.csv(path, sep="\t", header=True)
    return readers.events(v.spark, path).select("site_id", "date", "country", "latitude", "longitude", "protocol")


@query("a03_read_plots", "SELECT site_id, upper(province) AS continent, country, latitude, longitude, site_id % 3 = 0 AS consensus FROM sites")
def _(v):
    path = scratch(v.spark, "plots")
    out = v.sites.select(F.col("site_id").alias("PlotObservationID"), F.col("time").cast("string").alias("Date_of_recording"), F.upper("province").alias("Continent"), F.col("country").alias("Country"), F.col("latitude").alias("Latitude"), F.col("longitude").alias("Longitude"), (F.col("site_id") % 3 == 0).alias("Resample_1_consensus"))
    out.write.csv(path, sep="\t", header=True, encoding="ISO-8859-1")
    return readers.plots(v.spark, path).drop("date")


@query("a04_wanted_plots", "SELECT event_id, species FROM occurrences WHERE event_id IN (SELECT site_id FROM sites WHERE site_id % 3 = 0)")
def _(v):
    path = scratch(v.spark, "plot_species")
    v.occurrences.select(F.col("event_id").alias("PlotObservationID"), F.col("species").alias("Species")).write.csv(path, sep="\t", header=True)
    return readers.plot_species(v.spark, path, v.sites.where("site_id % 3 = 0"))


@query("a05_wide_table", "SELECT site_id, latitude, round(env_dem, 4) AS env_dem, (SELECT count(*) FROM pres p WHERE p.site_id = s.site_id) AS n_present FROM sites s JOIN env USING (site_id) WHERE env_dem IS NOT NULL", f"{PRES}, {ENV}")
def _(v):
    wide, species = _wide(v)
    return wide.select("site_id", "latitude", F.round("env_dem", 4).alias("env_dem"), sum((F.col(f"`{s}`") for s in species), F.lit(0)).cast("long").alias("n_present"))


DAILY_SQL = """SELECT cell, CAST(ts AS DATE) AS day, {0} FROM grid_hourly GROUP BY cell, CAST(ts AS DATE)""".format(
    ", ".join(f"round({f}(CASE WHEN var = '{var}' THEN value END), 6) + 0.0 AS {name}" for var, f, name in (("2m_temperature", "min", "t_min"), ("2m_temperature", "max", "t_max"), ("2m_temperature", "avg", "t_mean"), ("total_precipitation", "sum", "tp_sum"), ("2m_dewpoint_temperature", "avg", "d_mean"), ("other", "avg", "other_mean")))
)


def _daily(df: DataFrame) -> DataFrame:
    names = {"2m_temperature_min": "t_min", "2m_temperature_max": "t_max", "2m_temperature_mean": "t_mean", "total_precipitation_sum": "tp_sum", "2m_dewpoint_temperature_mean": "d_mean", "other_mean": "other_mean"}
    return df.select("cell", "day", *(number(F.col(a)).alias(b) for a, b in names.items()))


@query("a06_parquet_covariates", DAILY_SQL)
def _(v):
    path = scratch(v.spark, "daily")
    cov.daily(v.grid_hourly).write.parquet(path)
    return _daily(v.spark.read.parquet(path))


BLOCKS = """ranked AS (SELECT cell, row_number() OVER (ORDER BY md5(concat_ws('|', '42', CAST(cell AS VARCHAR))), cell) AS k FROM (SELECT DISTINCT cell FROM cells) c),
total AS (SELECT count(*) AS n FROM ranked),
blocks AS (SELECT cell, CASE WHEN k <= greatest(round_even(n * 0.1, 0), 1) THEN 'test' WHEN k <= greatest(round_even(n * 0.1, 0), 1) + greatest(round_even(n * (1 - CAST(0.8 AS DOUBLE) - CAST(0.1 AS DOUBLE)), 0), 1) THEN 'val' ELSE 'train' END AS split FROM ranked, total),
split AS (SELECT site_id, cell, split FROM cells JOIN blocks USING (cell))"""


def _split(v: Views) -> DataFrame:
    return splits.block_split(_cells(v))


@query("a07_saved_splits", "SELECT site_id, cell, split FROM split", f"{CELLS}, {BLOCKS}")
def _(v):
    path = scratch(v.spark, "splits")
    sinks.save_splits(_split(v), path)
    return sinks.load_splits(v.spark, path, v.sites).select("site_id", "cell", "split")


@query("a08_tile_index", "SELECT year(time) AS year, dayofyear(time) AS doy, CAST(site_id % 36 AS INT) AS h, CAST(site_id % 18 AS INT) AS v, count(*) AS n FROM sites WHERE site_id % 5 <> 0 GROUP BY ALL")
def _(v):
    name = F.when(F.col("site_id") % 5 == 0, "notes.txt").otherwise(F.format_string("MOD13Q1.A%04d%03d.h%02dv%02d.061.hdf", F.year("time"), F.dayofyear("time"), F.col("site_id") % 36, F.col("site_id") % 18))
    return readers.tile_index(v.sites.select(name.alias("name"))).groupBy("year", "doy", "h", "v").agg(F.count("*").alias("n"))


@query("a09_epoch_log", "SELECT CAST(regexp_extract(line, 'Epoch (\\d+)', 1) AS INT) AS epoch, CAST(regexp_extract(line, 'AUC: ([\\d.]+)', 1) AS DOUBLE) AS auc FROM epoch_log")
def _(v):
    return readers.epoch_log(v.epoch_log, strict=True)


@query("a10_combined_predictions", "SELECT species, model AS split, 'full' AS cov_set, count(*) AS n, round(sum(p), 4) AS sum_p, sum(y) AS n_pres FROM scored GROUP BY species, model")
def _(v):
    path = scratch(v.spark, "predictions")
    rows = v.scored.select("site_id", "species", F.lit(None).cast("string").alias("cov_set"), F.col("model").alias("split"), F.col("p").alias("predicted"), F.col("y").alias("actual"))
    rows.withColumn("part", F.col("split")).write.partitionBy("part").csv(path, header=True)
    return readers.predictions(v.spark, f"{path}/*").groupBy("species", "split", "cov_set").agg(F.count("*").alias("n"), F.round(F.sum("predicted"), 4).alias("sum_p"), F.sum("actual").alias("n_pres"))


def _bundle(v: Views) -> str:
    path = scratch(v.spark, "bundle")
    sinks.export_bundle(path, v.sites.select("site_id", "time", "latitude", "longitude"), _env(v), _presence(v), _split(v), ["env_dem"])
    return path


@query(
    "a11_export_bundle",
    "SELECT 'presence' AS part, CAST(site_id AS VARCHAR) AS key, species AS value FROM pres UNION ALL SELECT 'dynamic', CAST(site_id AS VARCHAR), CAST(round(latitude, 2) AS VARCHAR) FROM sites UNION ALL SELECT 'static', CAST(site_id AS VARCHAR), CAST(round(env_dem, 2) AS VARCHAR) FROM env UNION ALL SELECT 'splits', CAST(site_id AS VARCHAR), split FROM split UNION ALL SELECT DISTINCT 'species', species, NULL FROM pres",
    f"{PRES}, {ENV}, {CELLS}, {BLOCKS}",
)
def _(v):
    path, out = _bundle(v), None
    for part, key, value in (("presence", "site_id", F.col("species")), ("dynamic", "site_id", F.round("latitude", 2)), ("static", "site_id", F.round("env_dem", 2)), ("splits", "site_id", F.col("split")), ("species", "species", F.lit(None))):
        one = v.spark.read.parquet(f"{path}/{part}").select(F.lit(part).alias("part"), F.col(key).cast("string").alias("key"), value.cast("string").alias("value"))
        out = one if out is None else out.union(one)
    return out


BROKEN = """late AS (SELECT site_id FROM sites WHERE year(time) >= 1997), common AS (SELECT species FROM pres GROUP BY species HAVING count(*) >= 900),
lost AS (SELECT 'static rows without dynamic' AS "check", (SELECT count(*) FROM late) AS n UNION ALL SELECT 'dynamic rows without static', 0 UNION ALL SELECT 'presences without a site', (SELECT count(*) FROM pres WHERE site_id IN (SELECT site_id FROM late))
  UNION ALL SELECT 'presences without a species', (SELECT count(*) FROM pres WHERE species NOT IN (SELECT species FROM common)) UNION ALL SELECT 'splits without a site', (SELECT count(*) FROM split WHERE split <> 'val' AND site_id IN (SELECT site_id FROM late))
  UNION ALL SELECT 'sites without a split', (SELECT count(*) FROM split WHERE split = 'val' AND site_id NOT IN (SELECT site_id FROM late)))"""


@query("a12_check_bundle", 'SELECT "check", n, n = 0 AS passed FROM lost', f"{PRES}, {CELLS}, {BLOCKS}, {BROKEN}")
def _(v):
    """Of a bundle that lacks late sites, rare species and the split of the validation blocks."""
    path = scratch(v.spark, "broken")
    presence = _presence(v)
    sites = v.sites.where("year(time) < 1997").select("site_id", "time", "latitude", "longitude")
    common = presence.groupBy("species").count().where("count >= 900").select("species")
    sinks.export_bundle(path, sites, _env(v), presence, _split(v).where("split <> 'val'"), ["env_dem"])
    _env(v).select("site_id", "env_dem").write.mode("overwrite").parquet(f"{path}/static")
    common.write.mode("overwrite").parquet(f"{path}/species")
    return sinks.check_bundle(v.spark, path)


@query("a14_needs_refresh", "SELECT month(time) AS month, count(*) AS n_in, CASE WHEN month(time) = 3 THEN 0 ELSE count(*) FILTER (site_id % 100 <> 7) END AS n_out FROM sites GROUP BY month(time) HAVING count(*) <> CASE WHEN month(time) = 3 THEN 0 ELSE count(*) FILTER (site_id % 100 <> 7) END")
def _(v):
    path, given = scratch(v.spark, "done"), v.sites.select("site_id", F.month("time").alias("month"))
    given.where("month <> 3 and (site_id % 100 <> 7)").write.parquet(path)
    return sinks.needs_refresh(v.spark, path, given, "month")


# --- preparation ---------------------------------------------------------------------------------


@query("b01_structured", f"SELECT site_id, protocol FROM sites WHERE protocol IS NULL OR protocol NOT IN {WEAK}")
def _(v):
    return prepare.structured(v.sites, WEAK).select("site_id", "protocol")


@query("b02_region", f"SELECT site_id, country, province FROM sites WHERE country IN {COUNTRIES} AND (province IS NULL OR province NOT IN {WITHOUT}) AND longitude BETWEEN -170 AND -50 AND latitude BETWEEN 7 AND 84")
def _(v):
    return prepare.in_region(v.sites, COUNTRIES, WITHOUT, **prepare.NORTH_AMERICA).select("site_id", "country", "province")


@query("b03_region_us", f"SELECT site_id FROM sites WHERE country IN ('NATION_1') AND (province IS NULL OR province NOT IN {WITHOUT}) AND longitude BETWEEN -125 AND -66 AND latitude BETWEEN 24 AND 50")
def _(v):
    return prepare.in_region(v.sites, ("NATION_1",), WITHOUT, prepare.CONTERMINOUS["lon"], prepare.CONTERMINOUS["lat"]).select("site_id")


@query("b04_plot_regions", "SELECT 'us' AS region, site_id FROM sites WHERE longitude BETWEEN -125 AND -66 AND latitude BETWEEN 24 AND 50 UNION ALL SELECT 'europe', site_id FROM sites WHERE province = 'BUILDING' AND country <> 'NATION_7' AND latitude <= 72 UNION ALL SELECT 'australia', site_id FROM sites WHERE country = 'NATION_5' UNION ALL SELECT 'global', site_id FROM sites")
def _(v):
    plots, out = v.sites.withColumn("continent", F.when(F.col("province") == "BUILDING", "EUROPE")).withColumn("country", F.when(F.col("country") == "NATION_5", "AUSTRALIA").otherwise(F.col("country"))), None
    for r in ("us", "europe", "australia", "global"):
        one = prepare.plot_region(plots, r, ("NATION_7",)).select(F.lit(r).alias("region"), "site_id")
        out = one if out is None else out.union(one)
    return out


@query("b05_consensus", "SELECT site_id FROM sites WHERE site_id % 3 = 0 AND latitude IS NOT NULL AND longitude IS NOT NULL AND site_id % 7 <> 0")
def _(v):
    plots = v.sites.withColumn("consensus", F.col("site_id") % 3 == 0).withColumn("date", F.when(F.col("site_id") % 7 != 0, F.col("time")))
    return prepare.consensus(plots).select("site_id")


@query("b06_valid_dates", "SELECT site_id, time FROM sites WHERE site_id % 11 <> 0 AND year(time) BETWEEN 1994 AND 1997")
def _(v):
    raw = v.sites.withColumn("date", F.when(F.col("site_id") % 11 == 0, "not a date").otherwise(F.col("time").cast("string")))
    return prepare.valid_place_and_date(raw, years=(1994, 1997)).select("site_id", "time")


@query("b07_species_rank", "SELECT event_id, species FROM occurrences WHERE taxon_rank = 'SPECIES'")
def _(v):
    return prepare.of_rank(v.occurrences).select("event_id", "species")


@query("b08_missing_columns", 'SELECT \'env_dem\' AS "column", sum(CASE WHEN env_dem IS NULL THEN 1 ELSE 0 END) AS n_missing FROM env UNION ALL SELECT \'env_col\', 0', ENV)
def _(v):
    return prepare.missing_columns(_env(v), ["env_dem", "env_col"])


@query("b09_days", "SELECT site_id, CAST(date_diff('day', (SELECT min(time) FROM sites), time) AS DOUBLE) AS t_days FROM sites")
def _(v):
    return prepare.with_days(v.sites).select("site_id", "t_days")


@query("b11_no_covariates", "SELECT site_id, CAST(0 AS DOUBLE) AS env_none FROM sites")
def _(v):
    return prepare.with_some_covariate(v.sites.select("site_id"), [])


@query("b14_seeded_sample", "SELECT site_id FROM sites ORDER BY md5(concat_ws('|', '7', CAST(site_id AS VARCHAR))), site_id LIMIT 500")
def _(v):
    return prepare.seeded_sample(v.sites.select("site_id"), 500, "7", "site_id")


def _features(v: Views) -> DataFrame:
    return v.embeddings.select("vec_id", F.posexplode("embedding").alias("feature", "value")).withColumn("value", F.col("value").cast("double"))


LONG = "long AS (SELECT vec_id, unnest(range(0, 64)) AS feature, CAST(unnest(embedding) AS DOUBLE) AS value FROM embeddings)"


@query("b15_varying_features", "SELECT feature, round(var_samp(value), 6) AS variance FROM long WHERE vec_id % 5 <> 0 GROUP BY feature HAVING var_samp(value) > 0", LONG)
def _(v):
    return prepare.varying_features(_features(v).where("vec_id % 5 <> 0")).select("feature", F.round("variance", 6).alias("variance"))


@query("b16_standardised", "SELECT feature, count(*) AS n, round(avg(abs((value - m) / (s + 1e-4))), 6) AS mean_abs_z FROM long JOIN (SELECT feature, avg(value) AS m, stddev_pop(value) AS s FROM long WHERE vec_id % 5 <> 0 GROUP BY feature) t USING (feature) GROUP BY feature", LONG)
def _(v):
    return prepare.standardised(_features(v), F.col("vec_id") % 5 != 0).groupBy("feature").agg(F.count("*").alias("n"), F.round(F.avg(F.abs("z")), 6).alias("mean_abs_z"))


@query("b17_in_all_splits", "SELECT species FROM pres JOIN split USING (site_id) GROUP BY species HAVING count(DISTINCT split) = 3", f"{PRES}, {CELLS}, {BLOCKS}")
def _(v):
    return prepare.in_all_splits(_presence(v), _split(v))


@query("b18_grid_at_sites", "SELECT CAST(7 + i * 0.5 AS DOUBLE) AS latitude, CAST(-170 + j * 0.5 AS DOUBLE) AS longitude, count(*) AS n FROM (SELECT CAST(floor((latitude - 7) / 0.5) AS BIGINT) AS i, CAST(floor((longitude + 170) / 0.5) AS BIGINT) AS j FROM sites) s GROUP BY i, j")
def _(v):
    grid = geo.grid(v.spark, (7.0, 72.0), (-170.0, -50.0), 0.5)
    at = v.sites.select((F.floor((F.col("latitude") - 7) / 0.5) * 0.5 + 7).alias("latitude"), (F.floor((F.col("longitude") + 170) / 0.5) * 0.5 - 170).alias("longitude"))
    return at.groupBy("latitude", "longitude").agg(F.count("*").alias("n")).join(grid, ["latitude", "longitude"])


@query("b19_outside_box", "SELECT site_id FROM sites WHERE NOT (latitude BETWEEN 18 AND 23 AND longitude BETWEEN -161 AND -154)")
def _(v):
    return geo.outside_box(v.sites).select("site_id")


@query("b21_sanitised", "SELECT DISTINCT species, regexp_replace(species, '[^A-Za-z0-9]', '_', 'g') AS safe FROM occurrences")
def _(v):
    return v.occurrences.select("species", sanitised(F.col("species")).alias("safe")).distinct()


@query("c01_semi_join", f"SELECT event_id, species FROM occurrences WHERE event_id IN (SELECT site_id FROM kept)", KEPT)
def _(v):
    return prepare.semi(v.occurrences, _kept(v)).select("event_id", "species")


@query("c02_drop_unmatched", "SELECT site_id FROM sites WHERE site_id IN (SELECT event_id FROM occurrences WHERE taxon_rank = 'SPECIES')")
def _(v):
    return prepare.aligned_sites(v.sites, prepare.of_rank(v.occurrences), "drop_unmatched").select("site_id")


@query("c02_zero_fill", "SELECT site_id, (SELECT count(*) FROM pres p WHERE p.site_id = s.site_id) AS n_present FROM sites s", PRES)
def _(v):
    sites = prepare.aligned_sites(v.sites, v.occurrences, "zero_fill").select("site_id")
    return sites.join(_presence(v).groupBy("site_id").agg(F.count("*").alias("n")), "site_id", "left").select("site_id", F.coalesce("n", F.lit(0)).alias("n_present"))


@query("d01_presence", "SELECT site_id, species FROM pres", PRES)
def _(v):
    return _presence(v)


@query("d02_dedup", "SELECT event_id AS site_id, species, count(*) AS n_records FROM occurrences WHERE species IS NOT NULL GROUP BY event_id, species")
def _(v):
    records = v.occurrences.groupBy(F.col("event_id").alias("site_id"), "species").agg(F.count("*").alias("n_records"))
    return prepare.presences(v.occurrences).select("site_id", "species").join(records, ["site_id", "species"])


FREQ = "period AS (SELECT site_id FROM sites WHERE year(time) BETWEEN 1993 AND 1996), freq AS (SELECT * FROM pres WHERE species IN (SELECT species FROM pres GROUP BY species HAVING count(*) >= 200)), inside AS (SELECT * FROM freq WHERE site_id IN (SELECT site_id FROM period))"


@query("d03_min_presences", "SELECT species, count(*) AS n FROM inside GROUP BY species HAVING count(*) >= 200", f"{PRES}, {FREQ}")
def _(v):
    return prepare.frequent_in_period(_presence(v), v.sites, 200, (1993, 1996)).groupBy("species").agg(F.count("*").alias("n"))


@query("d04_species_after_drop", "SELECT species, count(*) AS n FROM pres WHERE site_id IN (SELECT site_id FROM env WHERE env_dem IS NOT NULL) GROUP BY species HAVING count(*) >= 100", f"{PRES}, {ENV}")
def _(v):
    whole = prepare.complete_sites(_env(v), ["env_dem", "env_col"])
    return prepare.frequent_species(_presence(v).join(whole, "site_id", "left_semi"), 100).groupBy("species").agg(F.count("*").alias("n"))


@query("d05_dropped_share", "SELECT count(*) AS n_before, count(env_dem) AS n_after, round(1 - count(env_dem) / CAST(count(*) AS DOUBLE), 6) AS share_dropped FROM env", ENV)
def _(v):
    env = _env(v)
    return prepare.dropped_share(env, prepare.complete_sites(env, ["env_dem", "env_col"])).withColumn("share_dropped", F.round("share_dropped", 6))


@query("d06_decades", "SELECT CAST(floor(year(time) / 10) * 10 AS INT) AS decade, count(*) AS n FROM sites GROUP BY ALL")
def _(v):
    return prepare.by_decade(v.sites)


@query("d06_top_countries", "SELECT country, count(*) AS n FROM sites GROUP BY country ORDER BY n DESC, country LIMIT 10")
def _(v):
    return prepare.top_countries(v.sites)


@query("d07_prevalence", "SELECT species, n_pres, n_sites, round(n_pres / CAST(n_sites AS DOUBLE), 6) AS prevalence FROM (SELECT species, count(*) AS n_pres FROM pres WHERE site_id IN (SELECT site_id FROM kept) GROUP BY species HAVING count(*) >= 20) p, (SELECT count(*) AS n_sites FROM kept) k", f"{PRES}, {KEPT}")
def _(v):
    kept = _kept(v)
    presence = prepare.frequent_species(prepare.presences(prepare.semi(prepare.of_rank(v.occurrences), kept)), 20)
    return prepare.prevalence(presence, kept).withColumn("prevalence", F.round("prevalence", 6))


@query("d08_extent", "SELECT min(latitude) AS lat_min, max(latitude) AS lat_max, min(longitude) AS lon_min, max(longitude) AS lon_max, min(time) AS first, max(time) AS last, count(*) AS n_sites, (SELECT count(DISTINCT species) FROM pres) AS n_species FROM sites", PRES)
def _(v):
    return prepare.extent(v.sites, _presence(v))


@query("d09_daily", DAILY_SQL)
def _(v):
    return _daily(cov.daily(v.grid_hourly))


@query("d10_coverage", 'SELECT \'env_dem\' AS "column", count(env_dem) AS n, round(avg(env_dem), 4) AS mean, min(env_dem) AS min, max(env_dem) AS max, sum(CASE WHEN env_dem IS NULL THEN 1 ELSE 0 END) AS n_incomplete FROM env UNION ALL SELECT \'env_col\', count(env_col), round(avg(env_col), 4), min(env_col), max(env_col), sum(CASE WHEN env_dem IS NULL THEN 1 ELSE 0 END) FROM env', ENV)
def _(v):
    return prepare.coverage(_env(v), ["env_dem", "env_col"]).withColumn("mean", F.round("mean", 4))


@query("d11_imputed", "SELECT site_id, round(coalesce(nullif(env_col, 0), (SELECT avg(nullif(env_col, 0)) FROM env)), 6) AS env_col FROM env", ENV)
def _(v):
    return prepare.imputed(_env(v), "env_col").select("site_id", F.round("env_col", 6).alias("env_col"))


COUNTS = "counts AS (SELECT species, count(*) AS n FROM pres GROUP BY species)"


def _counts(v: Views) -> DataFrame:
    return _presence(v).groupBy("species").agg(F.count("*").alias("n"))


@query("d14_effective_weights", "SELECT species, round(r / avg(r) OVER (), 6) AS weight FROM (SELECT species, (1 - CAST(0.99 AS DOUBLE)) / (1 - pow(CAST(0.99 AS DOUBLE), greatest(n, 1))) AS r FROM counts) c", f"{PRES}, {COUNTS}")
def _(v):
    return prepare.effective_number_weights(_counts(v), 0.99).select("species", F.round("weight", 6).alias("weight"))


@query("d15_inverse_weights", "SELECT species, round((SELECT count(*) FROM sites) / (n + CAST(1e-5 AS DOUBLE)), 6) AS weight FROM counts", f"{PRES}, {COUNTS}")
def _(v):
    total = v.sites.agg(F.count("*").alias("total"))
    return prepare.inverse_prevalence_weights(_counts(v).crossJoin(F.broadcast(total)), F.col("total")).select("species", F.round("weight", 6).alias("weight"))


@query("w03_numbered", "SELECT site_id, country, row_number() OVER (ORDER BY country, time, site_id) - 1 AS row_index FROM sites")
def _(v):
    return prepare.numbered(v.sites.select("site_id", "country", "time"), "country", "time", "site_id").select("site_id", "country", "row_index")


@query("d16_cooccurrence", "SELECT species_a, species_b, n_ab, round(n_ab / CAST(a.n AS DOUBLE), 6) AS b_given_a, round(n_ab * t / (CAST(a.n AS DOUBLE) * b.n), 6) AS lift, round((t * n_ab - CAST(a.n AS DOUBLE) * b.n) / sqrt(CAST(a.n AS DOUBLE) * b.n * (t - a.n) * (t - b.n)), 6) + 0.0 AS phi FROM (SELECT x.species AS species_a, y.species AS species_b, count(*) AS n_ab FROM pres x JOIN pres y USING (site_id) WHERE x.species < y.species GROUP BY ALL) j JOIN counts a ON species_a = a.species JOIN counts b ON species_b = b.species, (SELECT CAST(count(*) AS DOUBLE) AS t FROM sites) s", f"{PRES}, {COUNTS}")
def _(v):
    return prepare.cooccurrence(_presence(v), v.sites).select("species_a", "species_b", "n_ab", *(number(F.col(c)).alias(c) for c in ("b_given_a", "lift", "phi")))


@query("d17_split_summary", "SELECT split, count(*) AS n, count(DISTINCT cell) AS n_cells FROM split GROUP BY split", f"{CELLS}, {BLOCKS}")
def _(v):
    return prepare.split_summary(_split(v))


@query("f17_rate_draws", f"SELECT site_id, round(0.2 + 0.6 * {_u(chr(39) + '9' + chr(39), 'CAST(site_id AS VARCHAR)')}, 9) AS unif, round(list_sort([{', '.join(_u(chr(39) + '9' + chr(39), 'CAST(site_id AS VARCHAR)', chr(39) + str(i) + chr(39)) for i in range(4))}])[2], 9) AS beta FROM sites")
def _(v):
    return v.sites.select("site_id", F.round(prepare.rate_draw("unif:0.2,0.8", "9", F.col("site_id")), 9).alias("unif"), F.round(prepare.rate_draw("beta:2,3", "9", F.col("site_id")), 9).alias("beta"))


from . import evaluation, lookups  # noqa: E402,F401
