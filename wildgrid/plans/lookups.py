"""Queries of joins, lookups, covariates, splits and masks."""

from __future__ import annotations

from pyspark.sql import functions as F

from .registry import BLOCKS, CELLS, ENV, PRES, Views, _cells, _env, _km, _presence, _split, _u, composite_start, cov, fourier, geo, lapse_corrected, masking, neighbours, number, query, splits, wrap_longitude

DOY = "CAST(least(greatest(ceil((doy - 1) / CAST(16 AS DOUBLE) - 0.5), 0), 22) AS INT) * 16 + 1"
DAYS = "daily AS (SELECT cell, CAST(ts AS DATE) AS day, avg(CASE WHEN var = '2m_temperature' THEN value END) AS t_mean FROM grid_hourly GROUP BY cell, CAST(ts AS DATE))"


@query("c03_cell_and_day", f"SELECT s.site_id, s.day24, round(t_mean, 6) + 0.0 AS t_mean FROM sites s JOIN site_cells c USING (site_id) LEFT JOIN daily d ON c.cell = d.cell AND s.day24 = d.day", DAYS)
def _(v: Views):
    daily = cov.daily(v.grid_hourly).select("cell", "day", F.col("2m_temperature_mean").alias("t_mean"))
    sites = v.sites.join(v.site_cells, "site_id").select("site_id", "cell", "day24")
    return cov.at_cell_and_day(sites, daily).select("site_id", "day24", number(F.col("t_mean")).alias("t_mean"))


@query("c03_nearest_cell", "SELECT site_id, CAST(least(greatest(floor((latitude - 9.5) / 5 + 0.5), 0), 12) AS BIGINT) * 24 + CAST(least(greatest(floor((longitude + 167.5) / 5 + 0.5), 0), 23) AS BIGINT) AS cell FROM sites")
def _(v):
    return v.sites.select("site_id", cov.nearest_cell(F.col("latitude"), F.col("longitude"), 9.5, -167.5, 5.0, 13, 24).alias("cell"))


@query("c04_composite_start", f"SELECT site_id, doy, {DOY} AS start FROM (SELECT site_id, dayofyear(time) AS doy FROM sites) s")
def _(v):
    return v.sites.select("site_id", F.dayofyear("time").alias("doy"), composite_start(F.dayofyear("time")).alias("start"))


KEYS = f"keys AS (SELECT site_id, year, {DOY} AS doy, h, v FROM (SELECT site_id, year(time) AS year, dayofyear(time) AS doy, CAST(floor(6371007.181 * radians(longitude) * cos(radians(latitude)) / 1111950.519667 + 18) AS INT) AS h, CAST(floor(9 - 6371007.181 * radians(latitude) / 1111950.519667) AS INT) AS v FROM sites) s)"
TILES = "tiles AS (SELECT DISTINCT year, doy, h, v FROM keys WHERE (year + doy + h + v) % 3 <> 0)"


def _tiles(keys):
    return keys.select("year", "doy", "h", "v").distinct().where("(year + doy + h + v) % 3 <> 0")


@query("c05_composite_values", "SELECT k.site_id, CASE WHEN t.h IS NOT NULL AND k.site_id % 10 <> 0 THEN round((k.h * 100 + k.v) / CAST(10000 AS DOUBLE), 6) END AS env_ndvi FROM keys k LEFT JOIN tiles t ON k.year = t.year AND k.doy = t.doy AND k.h = t.h AND k.v = t.v", f"{KEYS}, {TILES}")
def _(v):
    keys = cov.composite_keys(v.sites)
    fill = F.when(F.col("site_id") % 10 == 0, -3000).otherwise(F.col("h") * 100 + F.col("v"))
    pixels = keys.join(_tiles(keys), ["year", "doy", "h", "v"]).groupBy("year", "doy", "h", "v", "row", "col").agg(F.max(fill).alias("ndvi"))
    return cov.composite_values(keys, pixels.withColumn("evi", F.lit(0))).select("site_id", number(F.col("env_ndvi")).alias("env_ndvi"))


@query("c06_missing_tiles", "SELECT DISTINCT year, doy, h, v FROM keys EXCEPT SELECT * FROM tiles", f"{KEYS}, {TILES}")
def _(v):
    keys = cov.composite_keys(v.sites)
    return cov.missing_tiles(keys, _tiles(keys))


@query("c07_raster_values", "SELECT site_id, env_dem FROM env", ENV)
def _(v):
    return _env(v).select("site_id", "env_dem")


NS = "'Copernicus_DSM_10_' || CASE WHEN floor(latitude) >= 0 THEN 'N' ELSE 'S' END || lpad(CAST(CAST(abs(floor(latitude)) AS BIGINT) AS VARCHAR), 2, '0') || '_00_' || CASE WHEN floor(longitude) >= 0 THEN 'E' ELSE 'W' END || lpad(CAST(CAST(abs(floor(longitude)) AS BIGINT) AS VARCHAR), 3, '0') || '_00_DEM.tif'"


@query("c08_elevation", "SELECT site_id, tile, CASE WHEN substr(tile, 20, 1) IN ('1', '3') THEN CAST(length(tile) AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS env_dem FROM named", f"named AS (SELECT site_id, {NS} AS tile FROM sites)")
def _(v):
    tiles = v.sites.select(cov.elevation_tile(F.col("latitude"), F.col("longitude")).alias("tile")).distinct()
    there = tiles.where(F.substring("tile", 20, 1).isin("1", "3")).withColumn("value", F.length("tile").cast("double"))
    return cov.elevation(v.sites, there)


@query("c09_looked_up_once", "SELECT site_id, round(sqrt(latitude * latitude + longitude * longitude), 6) AS r FROM sites")
def _(v):
    looked = cov.looked_up_once(v.sites.select("site_id", "latitude", "longitude"), lambda p: p.withColumn("r", F.sqrt(F.col("latitude") * F.col("latitude") + F.col("longitude") * F.col("longitude"))))
    return looked.select("site_id", F.round("r", 6).alias("r"))


@query("c10_grid_elevation", "SELECT site_id, round(z / 9.80665, 6) AS grid_elevation FROM (SELECT site_id, CAST(least(greatest(floor((latitude + 90) / 5 + 0.5), 0), 36) AS BIGINT) * 72 + CAST(least(greatest(floor((CASE WHEN longitude < 0 THEN longitude + 360 ELSE longitude END) / 5 + 0.5), 0), 71) AS BIGINT) AS cell FROM sites) s LEFT JOIN (SELECT DISTINCT cell * 5 AS cell, CAST(cell * 10 AS DOUBLE) AS z FROM raster_static) g USING (cell)")
def _(v):
    z = v.raster_static.select((F.col("cell") * 5).alias("cell"), (F.col("cell") * 10).cast("double").alias("z")).distinct()
    return cov.grid_elevation(v.sites, z, -90.0, 5.0, 37, 72).select("site_id", F.round("grid_elevation", 6).alias("grid_elevation"))


@query("c11_nearest_fill", "SELECT site_id, v AS value FROM (SELECT t.site_id, p.v, row_number() OVER (PARTITION BY t.site_id ORDER BY round(sqrt(pow(t.latitude - p.latitude, 2) + pow(t.longitude - p.longitude, 2)), 9), p.v) AS k FROM stations t JOIN (SELECT latitude, longitude, CAST(site_id % 100 AS DOUBLE) AS v FROM pool) p ON true) x WHERE k = 1")
def _(v):
    return geo.nearest_fill(v.stations, v.pool.withColumn("value", (F.col("site_id") % 100).cast("double")), "site_id", "value")


#: Four districts as polygons: a square, a concave shape, a triangle and one with a corner on a grid line.
POLYGONS = {
    "square": ((-150.0, 20.0), (-130.0, 20.0), (-130.0, 40.0), (-150.0, 40.0)),
    "concave": ((-120.0, 30.0), (-90.0, 30.0), (-90.0, 60.0), (-100.0, 60.0), (-100.0, 40.0), (-120.0, 40.0)),
    "triangle": ((-80.0, 10.0), (-55.0, 10.0), (-67.5, 35.5)),
    "corner": ((-100.0, 15.0), (-95.0, 20.0), (-100.0, 25.0), (-105.0, 20.0)),
}
EDGES = [(n, *p[i], *p[(i + 1) % len(p)]) for n, p in POLYGONS.items() for i in range(len(p))]
EDGES_SQL = "edges AS (SELECT * FROM (VALUES " + ", ".join(f"('{n}', CAST({a} AS DOUBLE), CAST({b} AS DOUBLE), CAST({c} AS DOUBLE), CAST({d} AS DOUBLE))" for n, a, b, c, d in EDGES) + ") e(poly, x1, y1, x2, y2))"
INSIDE = "inside AS (SELECT site_id, poly FROM sites JOIN edges ON least(y1, y2) <= latitude AND latitude < greatest(y1, y2) AND x1 + (latitude - y1) / (y2 - y1) * (x2 - x1) > longitude GROUP BY site_id, poly HAVING count(*) % 2 = 1)"


def _edges(v: Views):
    return v.spark.createDataFrame(EDGES, "poly string, x1 double, y1 double, x2 double, y2 double")


@query("c12_inside", "SELECT site_id, poly FROM inside", f"{EDGES_SQL}, {INSIDE}")
def _(v):
    return geo.inside(v.sites, _edges(v), "site_id")


@query("c12_outside", "SELECT site_id FROM sites WHERE site_id NOT IN (SELECT site_id FROM inside)", f"{EDGES_SQL}, {INSIDE}")
def _(v):
    return geo.outside(v.sites, _edges(v), "site_id").select("site_id")


@query("c13_country_names", "SELECT n_name AS country, wanted FROM nation, (VALUES ('nation_1'), ('the NATION_2 and more'), ('zz')) w(wanted) WHERE contains(lower(n_name), lower(wanted)) OR contains(lower(wanted), lower(n_name))")
def _(v):
    wanted = v.spark.createDataFrame([("nation_1",), ("the NATION_2 and more",), ("zz",)], "wanted string")
    return geo.countries_named(v.nation.select(F.col("n_name").alias("country")), wanted)


@query("c14_distances", f"SELECT site_id, round({_km('CAST(45 AS DOUBLE)', 'CAST(-100 AS DOUBLE)', 'latitude', 'longitude')}, 6) AS distance, abs(t_days - 100) AS gap FROM pool")
def _(v):
    return geo.distances_from(v.pool, 45.0, -100.0, 100.0).select("site_id", F.round("distance", 6).alias("distance"), "gap")


@query("c15_longest_distance", f"SELECT round(max({_km('a.latitude', 'a.longitude', 'b.latitude', 'b.longitude')}), 6) AS d_max, (SELECT max(t_days) - min(t_days) FROM stations) AS t_max FROM stations a JOIN stations b ON a.site_id < b.site_id")
def _(v):
    return geo.longest_distance(v.stations).select(F.round("d_max", 6).alias("d_max")).crossJoin(geo.time_span(v.stations))  # of one row each


@query("c18_block_members", "SELECT site_id, cell FROM split WHERE split = 'test'", f"{CELLS}, {BLOCKS}")
def _(v):
    return splits.members(_split(v), "test").select("site_id", "cell")


@query("c19_with_grid", "SELECT 'obs' AS kind, site_id, round(latitude, 4) AS latitude, round(longitude, 4) AS longitude, country FROM sites UNION ALL SELECT 'grid', site_id, round(latitude, 4), round(longitude, 4), NULL FROM stations")
def _(v):
    both = neighbours.with_grid(v.sites.select("site_id", "latitude", "longitude", "country"), v.stations.select("site_id", "latitude", "longitude"))
    return both.select("kind", "site_id", F.round("latitude", 4).alias("latitude"), F.round("longitude", 4).alias("longitude"), "country")


@query("c20_merged", "SELECT site_id, country, env_dem, cell FROM sites LEFT JOIN env USING (site_id) LEFT JOIN cells2 USING (site_id)", f"{ENV}, cells2 AS (SELECT site_id, cell FROM site_cells)")
def _(v):
    return cov.merged(v.sites.select("site_id", "country"), _env(v).select("site_id", "env_dem"), v.site_cells)


TEMPS = "temps AS (SELECT site_id, latitude / 3 AS t_mean, latitude / 4 AS t_min, longitude * 2 + 1000 AS grid_elevation, coalesce(env_dem, 0) AS site_elevation FROM sites JOIN env USING (site_id))"


def _temps(v: Views):
    return v.sites.join(_env(v), "site_id").select("site_id", (F.col("latitude") / 3).alias("t_mean"), (F.col("latitude") / 4).alias("t_min"), (F.col("longitude") * 2 + 1000).alias("grid_elevation"), F.coalesce("env_dem", F.lit(0.0)).alias("site_elevation"))


@query("f09_lapse_corrected", "SELECT site_id, round(t_mean + (grid_elevation - site_elevation) * 0.0065, 6) + 0.0 AS t_mean FROM temps", f"{ENV}, {TEMPS}")
def _(v):
    return cov.corrected_temperatures(_temps(v), ["t_mean", "t_min"]).select("site_id", number(F.col("t_mean")).alias("t_mean"))


@query("c21_raw_against_corrected", "SELECT site_id, round((grid_elevation - site_elevation) * 0.0065, 6) + 0.0 AS moved FROM temps", f"{ENV}, {TEMPS}")
def _(v):
    raw = _temps(v)
    both = cov.raw_against_corrected(raw, cov.corrected_temperatures(raw, ["t_mean"]).select("site_id", "t_mean"))
    return both.select("site_id", number(F.col("t_mean_fixed") - F.col("t_mean")).alias("moved"))


@query("c22_work_units", "SELECT year(time) AS year, month(time) AS month, count(*) AS n FROM sites GROUP BY ALL")
def _(v):
    return cov.work_units(v.sites)


LAPSED = """fixed AS (SELECT t_mean, t_min, (grid_elevation - site_elevation) * 0.0065 AS due, t_mean + (grid_elevation - site_elevation) * 0.0065 AS mean_fixed, t_min + grid_elevation * 0.0065 AS min_fixed FROM temps),
residuals AS (SELECT 't_mean' AS "column", max(abs(mean_fixed - t_mean - due)) AS residual FROM fixed UNION ALL SELECT 't_min', max(abs(min_fixed - t_min - due)) FROM fixed)"""


@query("d12_lapse_check", 'SELECT "column", round(residual, 6) AS residual, residual < 1e-3 AS passed FROM residuals', f"{ENV}, {TEMPS}, {LAPSED}")
def _(v):
    """Of one column that follows the rule and one that was moved to sea level instead."""
    raw = _temps(v)
    fixed = cov.corrected_temperatures(raw, ["t_mean"]).withColumn("t_min", F.col("t_min") + F.col("grid_elevation") * 0.0065)
    return cov.lapse_check(raw, fixed, ["t_mean", "t_min"]).select("column", number(F.col("residual")).alias("residual"), "passed")


@query("d13_elevation_slope", 'SELECT \'t_mean\' AS "column", round(regr_slope(t_mean, site_elevation) * 1000, 6) AS slope_km FROM temps UNION ALL SELECT \'t_min\', round(regr_slope(t_min, site_elevation) * 1000, 6) FROM temps', f"{ENV}, {TEMPS}")
def _(v):
    return cov.elevation_slope(_temps(v), ["t_mean", "t_min"]).select("column", F.round("slope_km", 6).alias("slope_km"))


@query("f05_tile_pixel", "SELECT site_id, h, v FROM keys", KEYS)
def _(v):
    return cov.composite_keys(v.sites).select("site_id", "h", "v")


@query("f07_wrapped", "SELECT site_id, CASE WHEN longitude < 0 THEN longitude + 360 ELSE longitude END AS lon FROM sites")
def _(v):
    return v.sites.select("site_id", wrap_longitude(F.col("longitude")).alias("lon"))


@query("f12_fourier", "SELECT site_id, " + ", ".join(f"round({f}(2 * pi() * dayofyear(time) / {p}), 6) + 0.0 AS {f}_{p}" for p in (365, 182, 122, 91) for f in ("sin", "cos")) + ", round(latitude * longitude, 6) AS lat_lon FROM sites")
def _(v):
    return v.sites.select("site_id", *(number(c).alias(n) for n, c in fourier(F.dayofyear("time")).items()), F.round(F.col("latitude") * F.col("longitude"), 6).alias("lat_lon"))


# --- splits --------------------------------------------------------------------------------------


@query("p01_block_split", "SELECT site_id, cell, split FROM split", f"{CELLS}, {BLOCKS}")
def _(v):
    return _split(v)


PLANAR = "plane AS (SELECT vec_id AS site_id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y FROM embeddings), cells AS (SELECT site_id, CAST(least(greatest(floor((x - x0) / (x1 - x0 + 1e-9) * 20), 0), 19) AS BIGINT) * 20 + CAST(least(greatest(floor((y - y0) / (y1 - y0 + 1e-9) * 20), 0), 19) AS BIGINT) AS cell FROM plane, (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM plane) e)"


@query("p02_planar_split", "SELECT site_id, cell, split FROM split", f"{PLANAR}, {BLOCKS}")
def _(v):
    plane = v.embeddings.select(F.col("vec_id").alias("site_id"), F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"))
    return splits.block_split(splits.planar_cells(plane, "x", "y"))


@query("p03_random_split", "SELECT site_id, CASE WHEN k <= floor(n * CAST(0.8 AS DOUBLE)) THEN 'train' WHEN k > n - floor(n * CAST(0.1 AS DOUBLE)) THEN 'test' ELSE 'val' END AS split FROM (SELECT site_id, row_number() OVER (ORDER BY md5(concat_ws('|', '42', CAST(site_id AS VARCHAR))), site_id) AS k, count(*) OVER () AS n FROM sites) s")
def _(v):
    return splits.random_split(v.sites)


@query("p04_train_first_split", "SELECT site_id, cell, CASE WHEN k <= round_even(n * CAST(0.8 AS DOUBLE), 0) THEN 'train' WHEN k <= n - round_even(n * CAST(0.1 AS DOUBLE), 0) THEN 'val' ELSE 'test' END AS split FROM cells JOIN ranked USING (cell), total", f"{CELLS}, {BLOCKS}")
def _(v):
    return splits.block_split(_cells(v), rule="train_first")


@query("p05_split_check", "SELECT (SELECT count(*) FROM sites WHERE year(time) >= 1993) AS n_sites, count(*) AS n_split, (SELECT count(*) FROM split JOIN sites USING (site_id) WHERE split = 'val' AND year(time) >= 1993) AS n_unsplit, count(*) FILTER (year(time) < 1993) AS n_gone FROM split JOIN sites USING (site_id) WHERE split <> 'val'", f"{CELLS}, {BLOCKS}")
def _(v):
    """Of a split without its validation blocks against the sites of later years."""
    return splits.checked_against(_split(v).where("split <> 'val'"), v.sites.where("year(time) >= 1993"))


@query("p05_source_pool", "SELECT site_id FROM split WHERE split = 'train'", f"{CELLS}, {BLOCKS}")
def _(v):
    return splits.source_pool(v.sites, _split(v)).select("site_id")


# --- masks ---------------------------------------------------------------------------------------

ROWS = f"rows AS (SELECT s.site_id, x.species, CASE WHEN p.species IS NULL THEN 0 ELSE 1 END AS present FROM sites s CROSS JOIN (SELECT DISTINCT species FROM pres) x LEFT JOIN pres p ON p.site_id = s.site_id AND p.species = x.species)"


def _mask(rate: str, seed: str, absences: bool) -> str:
    u = _u(f"'{seed}'", "CAST(site_id AS VARCHAR)", "species")
    hit = f"u < {rate}" + (" OR present = 0" if absences else "")
    return f"drawn AS (SELECT *, {u} AS u FROM rows), hits AS (SELECT *, {hit} AS hit FROM drawn), masks AS (SELECT *, hit OR (NOT bool_or(hit) OVER (PARTITION BY site_id) AND row_number() OVER (PARTITION BY site_id ORDER BY u, species) = 1) AS masked FROM hits)"


MASK_OUT = "SELECT species, count(*) AS n, sum(CASE WHEN masked THEN 1 ELSE 0 END) AS n_masked, sum(CASE WHEN masked THEN present END) AS n_pos FROM masks GROUP BY species"


def _mask_counts(df):
    return df.groupBy("species").agg(F.count("*").alias("n"), F.sum(F.col("masked").cast("int")).alias("n_masked"), F.sum("label").alias("n_pos"))


@query("k01_uniform_mask", MASK_OUT, f"{PRES}, {ROWS}, {_mask('0.25', 'k1', False)}")
def _(v):
    return _mask_counts(masking.masked(masking.states(v.sites, _presence(v)), 0.25, "k1"))


@query("k02_at_least_one", "SELECT site_id, count(*) AS n_masked FROM masks WHERE masked GROUP BY site_id", f"{PRES}, {ROWS}, {_mask('0.01', 'k2', False)}")
def _(v):
    out = masking.masked(masking.states(v.sites, _presence(v)), 0.01, "k2")
    return out.where("masked").groupBy("site_id").agg(F.count("*").alias("n_masked"))


@query("k03_token_share", f"SELECT species, sum(CASE WHEN masked AND {_u(chr(39) + 'k3#token' + chr(39), 'CAST(site_id AS VARCHAR)', 'species')} < 0.8 THEN 1 ELSE 0 END) AS n_token FROM masks GROUP BY species", f"{PRES}, {ROWS}, {_mask('0.5', 'k3', False)}")
def _(v):
    out = masking.masked(masking.states(v.sites, _presence(v)), 0.5, "k3", token_share=0.8)
    return out.groupBy("species").agg(F.sum((F.col("state") == 2).cast("int")).alias("n_token"))


@query("k04_evaluation_mask", MASK_OUT, f"{PRES}, {ROWS}, {_mask('0.75', 'eval#0.75', False)}")
def _(v):
    return _mask_counts(masking.masked(masking.states(v.sites, _presence(v)), 0.75, "eval#0.75"))


@query("k05_absence_mask", MASK_OUT, f"{PRES}, {ROWS}, {_mask('0.5', 'k5', True)}")
def _(v):
    return _mask_counts(masking.masked(masking.states(v.sites, _presence(v)), 0.5, "k5", absences=True))


@query("k06_mask_set", f"SELECT rate, species, sum(CASE WHEN masked THEN 1 ELSE 0 END) AS n_masked FROM masks GROUP BY rate, species", f"{PRES}, {ROWS}, drawn AS (SELECT *, {_u(chr(39) + 'k6' + chr(39), 'rate_name', 'CAST(site_id AS VARCHAR)', 'species')} AS u FROM rows, (VALUES (CAST(0.25 AS DOUBLE), '0.25'), (CAST(0.5 AS DOUBLE), '0.5'), (CAST(1 AS DOUBLE), '1.0')) r(rate, rate_name)), masks AS (SELECT *, u < rate OR (NOT bool_or(u < rate) OVER (PARTITION BY rate, site_id) AND row_number() OVER (PARTITION BY rate, site_id ORDER BY u, species) = 1) AS masked FROM drawn)")
def _(v):
    return masking.mask_set(masking.states(v.sites, _presence(v)), (0.25, 0.5, 1.0), "k6").groupBy("rate", "species").agg(F.sum(F.col("masked").cast("int")).alias("n_masked"))
