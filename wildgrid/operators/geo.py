"""Distances, grids, polygons and nearest neighbours in the plane of longitude and latitude."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import euclidean, haversine_km, index_of, missing
from . import tree


def grid(spark, lat: tuple[float, float], lon: tuple[float, float], step: float) -> DataFrame:
    """Points of a regular grid, both ends included: low + i * step, never added up."""
    rows, cols = (int((b - a) / step + 1e-9) + 1 for a, b in (lat, lon))
    return spark.range(rows * cols).select((F.lit(lat[0]) + F.floor(F.col("id") / cols) * step).alias("latitude"), (F.lit(lon[0]) + (F.col("id") % cols) * step).alias("longitude"))


def outside_box(points: DataFrame, lat=(18.0, 23.0), lon=(-161.0, -154.0)) -> DataFrame:
    return points.where(~(F.col("latitude").between(*lat) & F.col("longitude").between(*lon)))


def distances_from(sites: DataFrame, latitude: float, longitude: float, day: float, great_circle: bool = True) -> DataFrame:
    """From one site to all: kilometres on the sphere (or the plain distance of coordinates) and days apart."""
    f = haversine_km if great_circle else euclidean
    return sites.select("site_id", f(F.lit(latitude), F.lit(longitude), F.col("latitude"), F.col("longitude")).alias("distance"), F.abs(F.col("t_days") - day).alias("gap"))


def time_span(sites: DataFrame) -> DataFrame:
    """The largest time between two sites, 1 if they are all of one day."""
    span = F.max("t_days") - F.min("t_days")
    return sites.agg(F.when(span > 0, span).otherwise(1.0).alias("t_max"))


def longest_distance(sites: DataFrame) -> DataFrame:
    """(d_max, compared): the largest great-circle distance between two sites, 1 if all are at one place; and how many pairs were looked at.

    A search over pairs of nodes of one tree.  Two balls hold a pair no further apart than their middles and both radii together, and any two
    of their members are at least as far apart as the middles less both radii.  Level by level, pairs of nodes that cannot reach the best of
    these lower bounds go.  Places count once; those without a latitude or longitude do not count.
    """
    known = sites.where(~missing(F.col("latitude")) & ~missing(F.col("longitude")))
    places = known.select(F.col("latitude").cast("double").alias("latitude"), F.col("longitude").cast("double").alias("longitude")).distinct()
    at = lambda c, low, span, k: index_of((F.col(c) - low) / span * 4**k, 4**k)
    path = F.concat(*(tree.digit(at("latitude", -90.0, 180.0, k) % 4 * 4 + at("longitude", -180.0, 360.0, k) % 4) for k in range(1, LEVELS + 1)))
    places = tree._written(places.withColumn("path", path), "places")
    size = places.count()
    if size < 2:
        return sites.agg(F.lit(1.0).alias("d_max"), F.lit(0).cast("long").alias("compared"))
    balls = tree.Levels(places, size, LEVELS, LEAF, tree.ends("latitude", "longitude"), tree.balls)
    left = balls.spark.createDataFrame([("", "")], "a string, b string")
    floor = 0.0
    for level in range(1, balls.depth + 1):
        one, two = (balls.level(level).select(*(F.col(c).alias(f"{c}_{s}") for c in ("parent", "id", "y", "x", "radius"))) for s in "ab")
        met = left.join(one, F.col("a") == F.col("parent_a")).join(two, (F.col("b") == F.col("parent_b")) & (F.col("id_a") <= F.col("id_b")))
        d, both = haversine_km(F.col("y_a"), F.col("x_a"), F.col("y_b"), F.col("x_b")), F.col("radius_a") + F.col("radius_b")
        met = tree._written(met.select(F.col("id_a").alias("a"), F.col("id_b").alias("b"), (d - both).alias("low"), (d + both).alias("high")), "pairs")
        floor = max(floor, met.agg(F.max("low")).first()[0] or 0.0)
        left = met.where(F.col("high") >= floor).select("a", "b")
    one, two = (balls.members.select(*(F.col(c).alias(f"{c}_{s}") for c in ("home", "latitude", "longitude"))) for s in "ab")
    exact = left.join(one, F.col("a") == F.col("home_a")).join(two, F.col("b") == F.col("home_b"))
    d = F.max(haversine_km(F.col("latitude_a"), F.col("longitude_a"), F.col("latitude_b"), F.col("longitude_b")))
    return exact.agg(F.when(d > 0, d).otherwise(1.0).alias("d_max"), F.count("*").alias("compared"))


#: Sizes of inner cells: each twice as wide and high as the one before.
CELL_LEVELS = 4


def _cover(edges: DataFrame, band: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The cells of polygons: (inner, border, pieces).

    In each row of cells the stretches of longitude that edges touch are merged; between two of them nothing changes along the whole
    height of the row, so the crossings to the right are even or odd for all of a gap.  inner(level, row, col, poly): cells in an odd gap, four
    of them as one where they fill a larger cell.  border(row, col, poly, stretch, right): cells touched by a stretch, right the crossings beyond the last
    stretch of the cell (0 at the others).  pieces: the edges of each stretch.
    """
    if band <= 0 or math.frexp(band)[0] != 0.5:
        raise ValueError("band must be a power of two, so that rows have exact ends")
    edges = edges.select("poly", *(F.col(c).cast("double").alias(c) for c in ("x1", "y1", "x2", "y2"))).where(~F.exists(F.array("x1", "y1", "x2", "y2"), missing))
    low, high = F.least("y1", "y2"), F.greatest("y1", "y2")
    rows = edges.withColumn("row", F.explode(F.sequence(F.floor(low / band).cast("long"), F.floor(high / band).cast("long"))))
    at = lambda y: F.when(F.col("y1") == F.col("y2"), F.col("x1")).otherwise(F.col("x1") + (y - F.col("y1")) / (F.col("y2") - F.col("y1")) * (F.col("x2") - F.col("x1")))
    ends = at(F.greatest(low, F.col("row") * band)), F.when(F.col("y1") == F.col("y2"), F.col("x2")).otherwise(at(F.least(high, (F.col("row") + 1) * band)))
    rows = rows.withColumns({"left": F.least(*ends) - 1e-7, "end": F.greatest(*ends) + 1e-7, "base": ((low <= F.col("row") * band) & (F.col("row") * band < high)).cast("long")})
    along = Window.partitionBy("poly", "row").orderBy("left", "end", "x1", "y1", "x2", "y2")
    before = F.max("end").over(along.rowsBetween(Window.unboundedPreceding, -1))
    pieces = rows.withColumn("starts", F.coalesce((F.col("left") > before).cast("long"), F.lit(1))).withColumn("stretch", F.sum("starts").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    stretches = pieces.groupBy("poly", "row", "stretch").agg(F.min("left").alias("left"), F.max("end").alias("end"), F.sum("base").alias("base"))
    order = Window.partitionBy("poly", "row").orderBy("stretch")
    beyond = F.coalesce(F.sum("base").over(order.rowsBetween(1, Window.unboundedFollowing)), F.lit(0)) % 2
    stretches = stretches.withColumns({"right": beyond, "next": F.lead("left").over(order)}).withColumns({"first": F.floor(F.col("left") / band), "last": F.floor(F.col("end") / band), "until": F.floor(F.col("next") / band) - 1})
    border = stretches.select("poly", "row", F.explode(F.sequence("first", "last")).alias("col"), "stretch", "right")
    final = F.col("stretch") == F.max("stretch").over(Window.partitionBy("poly", "row", "col"))
    border = border.withColumn("right", F.when(final, F.col("right")).otherwise(0))
    cells = stretches.where("right = 1 and last < until").select("poly", "row", F.explode(F.sequence(F.col("last") + 1, "until")).alias("col"))
    inner = None
    for level in range(CELL_LEVELS):
        up = [F.floor(F.col(c) / 2).alias(f"{c}_up") for c in ("row", "col")]
        full = cells.groupBy("poly", *up).agg(F.count("*").alias("n")).where("n = 4").drop("n")
        rest = cells if level == CELL_LEVELS - 1 else cells.select("*", *up).join(full, ["poly", "row_up", "col_up"], "left_anti")
        part = rest.select(F.lit(level).alias("level"), "row", "col", "poly")
        inner = part if inner is None else inner.union(part)
        cells = full.select("poly", F.col("row_up").alias("row"), F.col("col_up").alias("col"))
    pieces = pieces.where("y1 <> y2 or starts = 1").select("poly", "row", "stretch", "x1", "y1", "x2", "y2", "starts")
    return inner, border, pieces


def _judged(points: DataFrame, edges: DataFrame, key: str, band: float) -> DataFrame:
    """(key, poly, n, tested): crossings to the right of a point (even or odd), for polygons whose cells hold it; tested: edges looked at."""
    inner, border, pieces = _cover(edges, band)
    here = points.where(~missing(F.col("latitude")) & ~missing(F.col("longitude")))
    here = here.select(F.col(key).alias("key"), F.col("latitude").cast("double").alias("y"), F.col("longitude").cast("double").alias("x"))
    cell = lambda c, level: F.floor(F.col(c) / (band * 2**level))
    sizes = F.array(*(F.struct(F.lit(k).alias("level"), cell("y", k).alias("row"), cell("x", k).alias("col")) for k in range(CELL_LEVELS)))
    sure = here.select("key", F.inline(sizes)).join(inner, ["level", "row", "col"]).select("key", "poly", F.lit(1).cast("long").alias("n"), F.lit(0).cast("long").alias("tested"))
    met = here.withColumns({"row": cell("y", 0), "col": cell("x", 0)}).join(border, ["row", "col"]).join(pieces, ["poly", "row", "stretch"])
    spans = (F.least("y1", "y2") <= F.col("y")) & (F.col("y") < F.greatest("y1", "y2"))
    crossing = F.col("x1") + (F.col("y") - F.col("y1")) / (F.col("y2") - F.col("y1")) * (F.col("x2") - F.col("x1"))
    n = F.when(spans & (crossing > F.col("x")), 1).otherwise(0) + F.col("right") * F.col("starts")  # the right of a stretch counts once
    return sure.union(met.groupBy("key", "poly").agg(F.sum(n).alias("n"), F.count("*").alias("tested"))).withColumnRenamed("key", key)


def inside(points: DataFrame, edges: DataFrame, key: str, band: float = 1.0) -> DataFrame:
    """(key, poly) of the points that lie in a polygon, by the even-odd rule.

    edges(poly, x1, y1, x2, y2) are those of closed rings, horizontal ones too; key tells the points apart.  Polygons are covered by cells (rows of
    the height band, a power of two): a point of an inner cell is decided without edges, one of a border cell meets the edges of the stretches that
    touch this cell.  Half-open: a point on a lower or left border is inside, on an upper or right one outside.  A point without a
    latitude or longitude lies in none; an edge with a null or NaN is none.
    """
    return _judged(points, edges, key, band).where("n % 2 = 1").select(key, "poly")


def edges_tested(points: DataFrame, edges: DataFrame, key: str, band: float = 1.0) -> DataFrame:
    """(points, tested): how many edges all points meet in `inside`."""
    return points.agg(F.count("*").alias("points")).crossJoin(_judged(points, edges, key, band).agg(F.coalesce(F.sum("tested"), F.lit(0)).alias("tested")))


def outside(points: DataFrame, edges: DataFrame, key: str, band: float = 1.0) -> DataFrame:
    return points.join(inside(points, edges, key, band), key, "left_anti")


def name_matches(name: Column, wanted: Column) -> Column:
    """Either name contains the other, whatever the case."""
    a, b = F.lower(name), F.lower(wanted)
    return F.contains(a, b) | F.contains(b, a)


def countries_named(countries: DataFrame, wanted: DataFrame) -> DataFrame:
    """Pairs (country, wanted) that match; both are short lists, the wanted one of at most some hundred names."""
    if wanted.limit(1001).count() > 1000:
        raise ValueError("too many names: this matches short lists")
    return countries.select("country").distinct().join(F.broadcast(wanted), name_matches(F.col("country"), F.col("wanted")))


#: Points of a box that is not split further, and levels of boxes, each sixteen times as many.
LEAF, LEVELS = 8, 12


def nearest_fill(targets: DataFrame, known: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value): of each target, the value at the nearest known point by longitude and latitude, of equals the smallest value.

    Branch and bound over a tree of boxes that lie close around the points.  A point of a box is no nearer than the box, and one of them no
    further than the nearest of its sides' far ends.  Level by level, a target keeps the boxes that are not further than the least such
    bound.  So its cost does not depend on how far away the points are.  Null for a target without a place, or if no value
    is known; a point without a place or value (null or NaN) is none.
    """
    points = known.where(~missing(F.col(value)) & ~missing(F.col("latitude")) & ~missing(F.col("longitude")))
    points = points.groupBy(F.col("latitude").cast("double").alias("py"), F.col("longitude").cast("double").alias("px")).agg(F.min(value).alias("v"))
    y0, y1, x0, x1, size = points.agg(F.min("py"), F.max("py"), F.min("px"), F.max("px"), F.count("*")).first()
    if not size:
        return targets.select(key, F.lit(None).cast(points.schema["v"].dataType).alias(value))
    span = max(y1 - y0, x1 - x0) or 1.0
    at = lambda c, low, k: index_of((F.col(c) - low) / span * 4**k, 4**k)
    path = F.concat(*(tree.digit(at("py", y0, k) % 4 * 4 + at("px", x0, k) % 4) for k in range(1, LEVELS + 1)))
    boxes = tree.Levels(tree._written(points.withColumn("path", path), "points"), size, LEVELS, LEAF, tree.ends("py", "px"), lambda b: b)
    here = targets.where(~missing(F.col("latitude")) & ~missing(F.col("longitude"))).select(F.col(key).alias("key"), F.col("latitude").cast("double").alias("y"), F.col("longitude").cast("double").alias("x"))
    front = here.repartition(int(boxes.spark.conf.get("spark.sql.shuffle.partitions")), "key").withColumn("at", F.lit(""))
    outside_ = lambda t, c: F.greatest(F.lit(0.0), F.col(f"{c}_low") - F.col(t), F.col(t) - F.col(f"{c}_high"))
    near_side = lambda t, c: F.least(F.abs(F.col(t) - F.col(f"{c}_low")), F.abs(F.col(t) - F.col(f"{c}_high")))
    far_side = lambda t, c: F.greatest(F.abs(F.col(t) - F.col(f"{c}_low")), F.abs(F.col(t) - F.col(f"{c}_high")))
    length = lambda a, b: F.sqrt(F.pow(a, 2) + F.pow(b, 2))
    low = length(outside_("y", "py"), outside_("x", "px"))
    high = F.least(length(near_side("y", "py"), far_side("x", "px")), length(far_side("y", "py"), near_side("x", "px")))
    best = F.min("high").over(Window.partitionBy("key", "y", "x"))
    for level in range(1, boxes.depth + 1):
        met = front.join(boxes.level(level), F.col("at") == F.col("parent")).select("key", "y", "x", F.col("id").alias("at"), low.alias("low"), high.alias("high"))
        front = met.withColumn("best", best).where(F.col("low") <= F.col("best") + 1e-8).select("key", "y", "x", "at")  # distances count to nine digits
    d = F.round(euclidean(F.col("y"), F.col("x"), F.col("py"), F.col("px")), 9)
    found = front.join(boxes.members, F.col("at") == F.col("home")).groupBy("key").agg(F.min(F.struct(d.alias("d"), F.col("v"))).alias("best"))
    return targets.join(found, F.col(key) == F.col("key"), "left").select(targets[key], F.col("best.v").alias(value))
