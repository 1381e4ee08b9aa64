"""Column expressions that the operators share.  No user-defined functions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values.
EARTH_KM, SINUSOIDAL_M, TILE_M, TILE_PIXELS = 6371.0, 6371007.181, 1111950.519667, 4800
GRAVITY, LAPSE_K_PER_M = 9.80665, 0.0065
COMPOSITE_DAYS, COMPOSITES = 16, 23


def missing(value: Column) -> Column:
    return value.isNull() | F.isnan(value.cast("double"))


def fresh(name: str, taken) -> str:
    """name, with underscores in front until no column has it."""
    taken = {c.lower() for c in taken}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def clamped(x: Column, low, high) -> Column:
    """x, but no less than low and no more than high.  Null stays null and NaN NaN, where least and greatest would give a bound."""
    return F.when(missing(x), x).when(x < low, low).when(x > high, high).otherwise(x)


def index_of(x: Column, cells: int) -> Column:
    """The whole part of x as one of 0 to cells - 1; null if x is missing."""
    return F.when(~missing(x), clamped(F.floor(x), F.lit(0), F.lit(cells - 1)))


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_KM * F.asin(clamped(F.sqrt(a), F.lit(0.0), F.lit(1.0)))


def euclidean(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    return F.sqrt(F.pow(lat2 - lat1, 2) + F.pow(lon2 - lon1, 2))


def space_time(d: Column, t: Column, d_scale: Column | float, t_scale: Column | float) -> Column:
    return F.sqrt(F.pow(d / d_scale, 2) + F.pow(t / t_scale, 2))


def sinusoidal(lat: Column, lon: Column) -> tuple[Column, Column]:
    """x, y in metres on the sphere of the 16-day composites."""
    return SINUSOIDAL_M * F.radians(lon) * F.cos(F.radians(lat)), SINUSOIDAL_M * F.radians(lat)


def tile_pixel(lat: Column, lon: Column) -> dict[str, Column]:
    """Tile h, v and pixel row, col (clipped to the tile)."""
    x, y = sinusoidal(lat, lon)
    h = F.floor(x / TILE_M + 18).cast("int")
    v = F.floor(9 - y / TILE_M).cast("int")
    at = lambda part: index_of(part * TILE_PIXELS, TILE_PIXELS).cast("int")
    return {"h": h, "v": v, "row": at(9 - y / TILE_M - v), "col": at(x / TILE_M + 18 - h)}


def composite_start(doy: Column) -> Column:
    """Nearest of the days 1, 17, ..., 353; of two as near the earlier; never of another year."""
    return clamped(F.ceil((doy - 1) / COMPOSITE_DAYS - 0.5), F.lit(0), F.lit(COMPOSITES - 1)).cast("int") * COMPOSITE_DAYS + 1


def wrap_longitude(lon: Column) -> Column:
    return F.when(lon < 0, lon + 360).otherwise(lon)


def geopotential_metres(z: Column) -> Column:
    return z / GRAVITY


def lapse_corrected(t: Column, grid_elevation: Column, site_elevation: Column) -> Column:
    return t + (grid_elevation - site_elevation) * LAPSE_K_PER_M


def vegetation_index(raw: Column) -> Column:
    """Scaled by 1/10000; fill values (below -0.2) are missing."""
    value = raw / 10000.0
    return F.when(value >= -0.2, value)


def without_nodata(value: Column, low: float = -32000.0, high: float = 1e6) -> Column:
    return F.when((value >= low) & (value <= high), value)


def fourier(doy: Column, periods=(365, 182, 122, 91)) -> dict[str, Column]:
    out = {}
    for p in periods:
        out[f"sin_{p}"] = F.sin(2 * math.pi * doy / p)
        out[f"cos_{p}"] = F.cos(2 * math.pi * doy / p)
    return out


def sigmoid(z: Column, temperature: Column | float = 1.0) -> Column:
    return 1 / (1 + F.exp(-z / temperature))


def logit(p: Column, eps: float = 1e-7) -> Column:
    q = clamped(p, F.lit(eps), F.lit(1 - eps))
    return F.log(q / (1 - q))


def uniform(*key: Column | str) -> Column:
    """A number in [0, 1) from the md5 of the key's parts; the same in every engine and on every partitioning."""
    parts = [F.lit(k) if isinstance(k, str) else k.cast("string") for k in key]
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 8), 16, 10).cast("double") / 4294967296.0


def cell_index(x: Column, low: Column | float, step: float, cells: int) -> Column:
    """Nearest of `cells` regular grid points (half up), clamped to the grid."""
    return index_of((x - low) / step + 0.5, cells).cast("long")


def sanitised(name: Column) -> Column:
    return F.regexp_replace(name, "[^A-Za-z0-9]", "_")


def number(x: Column, digits: int = 6) -> Column:
    """Rounded for reports; without a negative zero."""
    return F.round(x, digits) + F.lit(0.0)
