"""Environmental covariates at sites: grids, composites and rasters held as tables, looked up by equi-joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import cell_index, composite_start, geopotential_metres, lapse_corrected, tile_pixel, vegetation_index, wrap_longitude

#: How hourly variables become daily ones; any other is averaged.
DAILY = {"2m_temperature": ("min", "max", "mean"), "2m_dewpoint_temperature": ("mean",), "total_precipitation": ("sum",), "surface_solar_radiation_downwards": ("sum",)}


def daily(hourly: DataFrame) -> DataFrame:
    """(cell, var, ts, value) -> (cell, day, <var>_<stat>...), one pass of conditional aggregates."""
    v = lambda var: F.when(F.col("var") == var, F.col("value"))
    f = {"min": F.min, "max": F.max, "mean": F.avg, "sum": F.sum}
    known = [f[s](v(var)).alias(f"{var}_{s}") for var, stats in DAILY.items() for s in stats]
    return hourly.groupBy("cell", F.to_date("ts").alias("day")).agg(*known, F.avg(F.when(~F.col("var").isin(*DAILY), F.col("value"))).alias("other_mean"))


def nearest_cell(latitude: Column, longitude: Column, lat0: float, lon0: float, step: float, rows: int, cols: int) -> Column:
    """Number of the nearest point of a regular grid, half up, clamped to its border."""
    return cell_index(latitude, lat0, step, rows) * cols + cell_index(longitude, lon0, step, cols)


def at_cell_and_day(sites: DataFrame, daily_values: DataFrame, day: str = "day24") -> DataFrame:
    """sites(site_id, cell, day) with the values of their cell and day; null where there are none."""
    values = daily_values.withColumnRenamed("day", "_day")
    return sites.join(values, (sites.cell == values.cell) & (sites[day] == values._day), "left").drop(values.cell).drop("_day")


def composite_keys(sites: DataFrame, date: str = "time") -> DataFrame:
    """Year, start day, tile and pixel of the composite that a site reads; start days stay in the calendar year."""
    return sites.select("site_id", F.year(date).alias("year"), composite_start(F.dayofyear(date)).alias("doy"), *(c.alias(n) for n, c in tile_pixel(F.col("latitude"), F.col("longitude")).items()))


def composite_values(keys: DataFrame, composite: DataFrame) -> DataFrame:
    """Scaled indices at each site's pixel; null where the tile is missing or holds a fill value."""
    on = ["year", "doy", "h", "v", "row", "col"]
    return keys.join(composite, on, "left").select("site_id", vegetation_index(F.col("ndvi")).alias("env_ndvi"), vegetation_index(F.col("evi")).alias("env_evi"))


def missing_tiles(keys: DataFrame, index: DataFrame) -> DataFrame:
    """Tiles that are needed and not there."""
    on = ["year", "doy", "h", "v"]
    return keys.select(*on).distinct().join(index, on, "left_anti")


def raster_values(sites: DataFrame, raster: DataFrame, variables: Sequence[str], key: str = "cell") -> DataFrame:
    """sites(site_id, cell) with a column env_<var> of each variable; null where the raster has none."""
    wide = raster.groupBy(key).agg(*(F.max(F.when(F.col("var") == v, F.col("value"))).alias(f"env_{v}") for v in variables))
    return sites.join(wide, key, "left")


def elevation_tile(latitude: Column, longitude: Column) -> Column:
    """Name of the one-degree elevation tile."""
    i, j = F.floor(latitude), F.floor(longitude)
    ns = F.concat(F.when(i >= 0, "N").otherwise("S"), F.lpad(F.abs(i).cast("string"), 2, "0"))
    ew = F.concat(F.when(j >= 0, "E").otherwise("W"), F.lpad(F.abs(j).cast("string"), 3, "0"))
    return F.concat(F.lit("Copernicus_DSM_10_"), ns, F.lit("_00_"), ew, F.lit("_00_DEM.tif"))


def elevation(sites: DataFrame, tiles: DataFrame) -> DataFrame:
    """tiles(tile, value): the elevation of the site's tile; 0 where there is no tile."""
    return sites.withColumn("tile", elevation_tile(F.col("latitude"), F.col("longitude"))).join(tiles, "tile", "left").select("site_id", "tile", F.coalesce("value", F.lit(0.0)).alias("env_dem"))


def looked_up_once(sites: DataFrame, lookup, digits: int = 6) -> DataFrame:
    """lookup(points) on the distinct rounded coordinates only, joined back to every site; worth it for costly lookups."""
    rounded = sites.withColumn("_lat", F.round("latitude", digits)).withColumn("_lon", F.round("longitude", digits))
    points = rounded.select(F.col("_lat").alias("latitude"), F.col("_lon").alias("longitude")).distinct()
    found = lookup(points).withColumnsRenamed({"latitude": "_lat", "longitude": "_lon"})
    return rounded.join(found, ["_lat", "_lon"]).drop("_lat", "_lon")


def grid_elevation(points: DataFrame, geopotential: DataFrame, lat0: float, step: float, rows: int, cols: int) -> DataFrame:
    """Metres at the nearest point of a grid whose longitudes run from 0 to 360."""
    at = points.withColumn("cell", nearest_cell(F.col("latitude"), wrap_longitude(F.col("longitude")), lat0, 0.0, step, rows, cols))
    return at.join(geopotential, "cell", "left").withColumn("grid_elevation", geopotential_metres(F.col("z"))).drop("z")


def corrected_temperatures(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """columns moved from grid_elevation to site_elevation by the lapse rate."""
    return rows.withColumns({c: lapse_corrected(F.col(c), F.col("grid_elevation"), F.col("site_elevation")) for c in columns})


def lapse_check(raw: DataFrame, corrected: DataFrame, columns: Sequence[str], tolerance: float = 1e-3) -> DataFrame:
    """Largest residual of each corrected column against the rule, and whether it is within tolerance."""
    both = raw.join(corrected.select("site_id", *(F.col(c).alias(f"{c}_fixed") for c in columns)), "site_id")
    due = lapse_corrected(F.lit(0.0), F.col("grid_elevation"), F.col("site_elevation"))
    wide = both.agg(*(F.max(F.abs(F.col(f"{c}_fixed") - F.col(c) - due)).alias(c) for c in columns))
    rows = wide.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).alias("residual")) for c in columns))).alias("x")).select("x.*")
    return rows.withColumn("passed", F.col("residual") < tolerance)


def elevation_slope(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Degrees per kilometre of elevation, by least squares."""
    wide = rows.agg(*(F.regr_slope(c, "site_elevation").alias(c) for c in columns))
    return wide.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), (F.col(c) * 1000).alias("slope_km")) for c in columns))).alias("x")).select("x.*")


def merged(sites: DataFrame, *blocks: DataFrame) -> DataFrame:
    """Blocks of covariates side by side, by site and never by position."""
    for b in blocks:
        sites = sites.join(b, "site_id", "left")
    return sites


def raw_against_corrected(raw: DataFrame, corrected: DataFrame) -> DataFrame:
    return raw.join(corrected.select("site_id", *(F.col(c).alias(f"{c}_fixed") for c in corrected.columns if c != "site_id")), "site_id")


def work_units(sites: DataFrame, date: str = "time") -> DataFrame:
    """Months that have observations, and how many."""
    return sites.groupBy(F.year(date).alias("year"), F.month(date).alias("month")).agg(F.count("*").alias("n"))
