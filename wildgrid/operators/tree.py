"""Weighted sampling of sources over a tree of the pool, by exponential keys that are drawn from the top down.

Sources of the n smallest keys e / w are a sample without replacement by weights w, if each e is an exponential of rate one.  The least e of
a node of m sites is an exponential of rate m.  It is drawn first, and passed on: the site that has it lies in a child with a chance of
the child's share, and by the want of memory the least e of every other child of k sites exceeds it by an exponential of rate k.  Draws
depend on seed, target and node alone, so each site's key is fixed, whether or not it is looked at.

A node is a ball around its box.  No key below it is less than e over the largest weight that the ball allows, and one is no more than e over
the smallest.  Level by level, a target drops the nodes that cannot hold one of its n smallest keys; it never looks at all pairs.
Tasks do this for many targets at once: the upper levels, a bounded number of nodes, are with every task, and those below are joined to the
nodes that are still open, the children of a node together.

Nodes are split by place, then by time, then by a hash of the id, sixteen ways, until they hold few sites.  So a third of the pool at one
place is a tree as well.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.digests import pair_heads
from ..functions.expr import EARTH_KM, haversine_km, missing
from ..plans.fixtures import scratch

EPS = 1e-6
#: Sites of a node that is not split further; levels by place, time and id; levels that are built at once beyond the expected ones.
LEAF, PLACE, TIME, ID, MORE = 8, 8, 4, 8, 4
#: Nodes of the upper levels that every task has; the levels below are joined.  Targets, nodes below, and children that are worked on at a time.
TOP, TARGETS, NODES, AT_ONCE = 1 << 16, 256, 1 << 12, 1 << 18
BOX = ("id", "n", "before", "y", "x", "radius", "t", "t_radius")


def draw(*key: Column | str) -> Column:
    """In (0, 1): never zero, so that its logarithm is finite."""
    parts = [F.lit(k) if isinstance(k, str) else k.cast("string") for k in key]
    return (F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 8), 16, 10).cast("double") + 1) / 4294967297.0


def _written(df: DataFrame, name: str) -> DataFrame:
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def digit(d: Column) -> Column:
    return F.substring(F.lit("0123456789abcdef"), (d + 1).cast("int"), F.lit(1))


def _path(low: float, span: float) -> Column:
    """The way of a site down the tree: a digit for each level."""
    at = lambda x, cells: F.greatest(F.least(F.floor(x * cells), F.lit(cells - 1)), F.lit(0))
    y, x, t = (F.col("latitude") + 90.0) / 180.0, (F.col("longitude") + 180.0) / 360.0, (F.col("t_days") - low) / span
    place = [digit(at(y, 4**k) % 4 * 4 + at(x, 4**k) % 4) for k in range(1, PLACE + 1)]
    time = [digit(at(t, 16**k) % 16) for k in range(1, TIME + 1)]
    return F.concat(*place, *time, F.substring(F.md5(F.col("site_id").cast("string")), 1, ID))


class Levels:
    """A tree over rows with a column path, a digit for each level: levels of nodes, and members with the leaf that they are in.

    Nodes of up to `leaf` members, and those of the last level, are not split.  A node that is not split stands for itself at the levels below,
    so that what descends is always at nodes of one level.  boxes: aggregates of a node, finished by a function into its columns.
    """

    def __init__(self, rows: DataFrame, size: int, last: int, leaf: int, boxes: list[Column], finished):
        self.spark, self.size = rows.sparkSession, size
        upto = min(last, 2 + math.ceil(math.log(max(size / leaf, 1), 16)))
        nodes, done, rest = None, 0, rows
        while True:
            at = rest.withColumn("level", F.explode(F.sequence(F.lit(done + 1), F.lit(upto)))).withColumn("id", F.substring(F.col("path"), F.lit(1), F.col("level")))
            new = at.groupBy("level", "id").agg(F.count("*").alias("n"), *boxes).withColumn("parent", F.substring(F.col("id"), F.lit(1), F.col("level") - 1))
            new = _written(finished(new), "nodes")
            nodes = new if nodes is None else nodes.union(new)
            over = new.where((F.col("level") == upto) & (F.col("n") > leaf)).select(F.col("id").alias("_over"))
            if upto == last or not over.limit(1).count():
                break
            rest = rest.join(over, F.substring("path", 1, upto) == F.col("_over"), "left_semi")
            done, upto = upto, min(last, upto + MORE)
        self.depth = upto
        inner = nodes.where(F.col("n") > leaf).select(F.col("id").alias("parent"))
        first = nodes.where("level = 1").select("parent", *(c for c in nodes.columns if c != "parent"))
        nodes = nodes.join(inner, "parent", "left_semi").union(first)
        before = F.sum("n").over(Window.partitionBy("parent").orderBy("id").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
        whole = (F.col("n") <= leaf) | (F.col("level") == last)
        nodes = nodes.withColumn("before", before).withColumn("first", F.col("level")).withColumn("level", F.explode(F.when(whole, F.sequence("level", F.lit(self.depth))).otherwise(F.array("level"))))
        again = F.col("level") > F.col("first")
        nodes = nodes.withColumn("home", ((F.col("n") <= leaf) | (F.col("first") == last)) & ~again)
        nodes = nodes.withColumn("parent", F.when(again, F.col("id")).otherwise(F.col("parent"))).withColumn("before", F.when(again, 0).otherwise(F.col("before"))).drop("first")
        self.path, self.schema = scratch(self.spark, "tree"), nodes.drop("level").schema
        nodes.repartition("level", F.pmod(F.xxhash64("parent"), F.lit(16))).write.partitionBy("level").parquet(self.path)
        homes = self.spark.read.parquet(self.path).where("home").select(F.col("id").alias("home")) if size else nodes.select(F.col("id").alias("home"))
        ways = rows.withColumn("home", F.explode(F.transform(F.sequence(F.lit(1), F.lit(self.depth)), lambda k: F.substring(F.col("path"), F.lit(1), k)))).drop("path")
        self.members = _written(ways.join(homes, "home"), "members")

    def level(self, k: int) -> DataFrame:
        """Nodes of a level: a table of its own, so that small levels are known to be small and are broadcast."""
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/level={k}").drop("home")


def ends(*columns: str) -> list[Column]:
    return [f(c).alias(f"{c}_{s}") for c in columns for f, s in ((F.min, "low"), (F.max, "high"))]


def balls(boxes: DataFrame) -> DataFrame:
    """Middle and radius of boxes (columns of ends()), and of their time if they have one."""
    middle, half = (lambda c: (F.col(f"{c}_low") + F.col(f"{c}_high")) / 2), (lambda c: (F.col(f"{c}_high") - F.col(f"{c}_low")) / 2)
    widest = F.when((F.col("latitude_low") <= 0) & (F.col("latitude_high") >= 0), 1.0).otherwise(F.cos(F.radians(F.least(F.abs("latitude_low"), F.abs("latitude_high")))))
    # Along a straight line in degrees, no member is further from the middle; a little more for rounding.
    radius = EARTH_KM * F.sqrt(F.pow(F.radians(half("latitude")), 2) + F.pow(widest * F.radians(half("longitude")), 2)) * (1 + 1e-9) + 1e-6
    time = [middle("t_days").alias("t"), (half("t_days") * (1 + 1e-9) + 1e-9).alias("t_radius")] if "t_days_low" in boxes.columns else []
    return boxes.select("parent", "level", "id", "n", middle("latitude").alias("y"), middle("longitude").alias("x"), radius.alias("radius"), *time)


class Tree(Levels):
    """Levels of nodes(parent, id, n, before, y, x, radius, t, t_radius) and members(home, rank, site_id, latitude, longitude, t_days).

    Sites without a place or time are left out; of rows of one id the least counts.
    """

    def __init__(self, pool: DataFrame):
        known = pool.where(~missing(F.col("latitude")) & ~missing(F.col("longitude")) & ~missing(F.col("t_days")))
        low, high = known.agg(F.min("t_days"), F.max("t_days")).first()
        span = float(high - low) if low is not None and high > low else 1.0
        sites = known.groupBy("site_id").agg(F.min(F.struct(*(F.col(c).cast("double").alias(c) for c in ("latitude", "longitude", "t_days")))).alias("at")).select("site_id", "at.*")
        sites = _written(sites.withColumn("path", _path(float(low or 0.0), span)), "sites")
        super().__init__(sites, sites.count(), PLACE + TIME + ID, LEAF, ends("latitude", "longitude", "t_days"), balls)
        self.members = self.members.withColumn("rank", F.row_number().over(Window.partitionBy("home").orderBy("site_id")) - 1)
        self._top, self._children = None, {}

    def top(self):
        """The upper levels, TOP nodes at most, as arrays that every task has: their number and the broadcast."""
        if self._top is None:
            upto, sizes, every = 0, dict.fromkeys(range(1, self.depth + 1), 0), self.spark.read.parquet(self.path)
            sizes.update((r.level, r["count"]) for r in every.groupBy("level").count().collect())
            while upto < self.depth and (not upto or sum(sizes[k] for k in range(1, upto + 2)) <= TOP):
                upto += 1
            rows = every.where(F.col("level") <= upto).select("level", "parent", *BOX).toArrow()
            levels, above = [], np.array([b""])
            for k in range(1, upto + 1):
                part = rows.filter(pa.compute.equal(rows["level"], k))
                parents = _texts(part["parent"])
                order = np.argsort(parents, kind="stable")
                box = {c: part[c].to_numpy()[order] for c in BOX[1:]} | {"id": _texts(part["id"])[order]}
                box |= dict(zip(("ux", "uy", "uz"), _unit(box.pop("y"), box.pop("x"))))
                levels.append((*(np.searchsorted(parents[order], above, side) for side in ("left", "right")), box))
                above = box["id"]
            self._top = upto, self.spark.sparkContext.broadcast(levels)
        return self._top

    def children(self, k: int) -> DataFrame:
        """Nodes of a level below the top, a row for each parent."""
        if k not in self._children:
            self._children[k] = _written(self.level(k).groupBy("parent").agg(F.collect_list(F.struct(*BOX)).alias("children")), "children")
        return self._children[k]


def _texts(column) -> np.ndarray:
    """Bytes of strings; one byte wide at least."""
    return np.array([x.encode() for x in column.to_pylist()] or [b""], "S")[: len(column)]


def _opened(seed: str, n: int, with_time: bool, site: dict, row: np.ndarray, at: np.ndarray, m: np.ndarray, e: np.ndarray, up: np.ndarray, box: dict, limit: np.ndarray):
    """Of children (box, a parent each in up; parents: row of the target in site, id, size, least e) those that may hold one of the n smallest keys.

    The least e of a child, and its place among the children, for those that stay; limit, that of a row of site, is lowered: no key beyond it is among the n
    smallest.  Whatever children are seen together, n + 1 of them hold that many keys up to the largest of their upper bounds (one more
    than n, as the target itself may be a site).
    """
    draws = lambda what, ids, i, j: (pair_heads(f"{seed}#{what}".encode(), site["key"], ids, i, j) + 1.0) / 4294967296.0
    split = np.flatnonzero(np.bincount(up, at[up] != box["id"], len(at)))  # a node that is not split stands for itself
    x = np.zeros(len(at))
    x[split] = draws("c", at, row[split], split) * m[split]
    x, least, owner = x[up], e[up], row[up]
    rest = np.flatnonzero((x < box["before"]) | (x >= box["before"] + box["n"]))
    least[rest] -= np.log(draws("e", box["id"], owner[rest], rest)) / box["n"][rest]
    chord = sum((one[owner] - other) ** 2 for one, other in zip(_unit(site["t_lat"], site["t_lon"]), (box[c] for c in ("ux", "uy", "uz")) if "ux" in box else _unit(box["y"], box["x"])))
    d, gap = 2 * EARTH_KM * np.arcsin(np.minimum(np.sqrt(chord) / 2, 1)), np.abs(site["t_t"][owner] - box["t"])
    ds, ts = 1 / site["d_scale"][owner], 1 / site["t_scale"][owner]
    scaled = lambda d, gap: np.sqrt((d * ds) ** 2 + (gap * ts) ** 2) if with_time else d * ds
    # A little less and more for rounding.
    low = least * (scaled(np.maximum(d - box["radius"], 0), np.maximum(gap - box["t_radius"], 0)) + EPS) * (1 - 1e-8)
    high = least * (scaled(d + box["radius"], gap + box["t_radius"]) + EPS) * (1 + 1e-8)
    within = np.flatnonzero(high <= limit[owner])
    of = owner[within]
    order = np.lexsort((high[within], of))
    first, full = np.searchsorted(of[order], np.arange(len(limit))), np.flatnonzero(np.bincount(of, minlength=len(limit)) > n)
    limit[full] = high[within][order[first[full] + n]]
    keep = np.flatnonzero(~(low > limit[owner]))
    return least[keep], keep


def _unit(latitude: np.ndarray, longitude: np.ndarray) -> list[np.ndarray]:
    """Places as points of a sphere of radius one: the straight line between two gives their distance along it."""
    y, x = np.radians(latitude), np.radians(longitude)
    return [np.cos(y) * np.cos(x), np.cos(y) * np.sin(x), np.sin(y)]


def _span(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ..., size[0] of them, then those of the next."""
    return np.arange(size.sum()) + np.repeat(first - np.cumsum(size) + size, size)


def _site(batch: pa.RecordBatch) -> dict:
    return {c: batch[c].to_numpy(zero_copy_only=False) for c in ("t_lat", "t_lon", "t_t", "d_scale", "t_scale")} | {"key": _texts(batch["key"])}


def _front(batch: pa.RecordBatch, row: np.ndarray, at: np.ndarray, m: np.ndarray, e: np.ndarray, limit: np.ndarray) -> pa.RecordBatch:
    new = [pa.array([x.decode() for x in at.tolist()], pa.string()), pa.array(m, pa.int64()), pa.array(e, pa.float64()), pa.array(limit, pa.float64())]
    return pa.RecordBatch.from_arrays([*batch.take(pa.array(row)).columns, *new], [*batch.schema.names, "at", "m", "e", "limit"])


def _upper(seed: str, n: int, with_time: bool, size: int, top) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Targets -> their open nodes at the last of the upper levels."""

    def down(site, levels, row, node, at, m, e, limit, k):
        """Yields rows, ids, sizes, least e and limits; halves the targets while they have too many nodes."""
        while k < len(levels):
            left, right, box = levels[k]
            count = right[node] - left[node]
            if count.sum() > AT_ONCE and row[0] != row[-1]:
                half = (row[0] + row[-1] + 1) // 2
                for part in (row < half, row >= half):
                    yield from down(site, levels, row[part], node[part], at[part], m[part], e[part], limit, k)
                return
            up, child = np.repeat(np.arange(len(row)), count), _span(left[node], count)
            e, keep = _opened(seed, n, with_time, site, row, at, m, e, up, {c: v[child] for c, v in box.items()}, limit)
            row, node, k = row[up[keep]], child[keep], k + 1
            at, m = box["id"][node], box["n"][node]
        yield row, at, m, e, limit[row]

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, TARGETS):
                part = batch.slice(start, TARGETS)
                site, rows = _site(part), np.arange(part.num_rows)
                none = np.array([b""])
                e = -np.log((pair_heads(f"{seed}#e".encode(), site["key"], none, rows, 0 * rows) + 1.0) / 4294967296.0) / size
                for found in down(site, top.value, rows, 0 * rows, none[0 * rows], np.full(len(rows), size), e, np.full(len(rows), np.inf), 0):
                    yield _front(part, *found)

    return run


def _lower(seed: str, n: int, with_time: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Open nodes of targets with their children -> their open children, by the limits so far and what is seen together."""

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, NODES):
                part = batch.slice(start, NODES)
                if not part.num_rows:
                    continue
                lists, given = part["children"], part.select([c for c in part.schema.names if c not in ("at", "m", "e", "limit", "parent", "children")])
                every, rows = _site(given), np.arange(part.num_rows)
                new = np.any([v[rows] != v[rows - 1] for v in every.values()], axis=0) | (rows == 0)
                one, row = np.flatnonzero(new), np.cumsum(new) - 1
                site, limit = {c: v[one] for c, v in every.items()}, np.full(len(one), np.inf)
                np.fmin.at(limit, row, part["limit"].to_numpy())
                flat, up = lists.flatten(), np.repeat(np.arange(part.num_rows), lists.value_lengths().to_numpy())
                box = {c: flat.field(c).to_numpy(zero_copy_only=False) for c in BOX[1:]} | {"id": _texts(flat.field("id"))}
                e, keep = _opened(seed, n, with_time, site, row, _texts(part["at"]), part["m"].to_numpy(), part["e"].to_numpy(), up, box, limit)
                yield _front(given, up[keep], box["id"][keep], box["n"][keep], e, limit[row[up[keep]]])

    return run


def _scaled(d: Column, gap: Column, with_time: bool) -> Column:
    return F.sqrt(F.pow(d / F.col("d_scale"), 2) + F.pow(gap / F.col("t_scale"), 2)) if with_time else d / F.col("d_scale")


def sampled(tree: Tree, targets: DataFrame, n: int, seed: str, with_time: bool) -> DataFrame:
    """targets(key, target_id, t_lat, t_lon, t_t, d_scale, t_scale) -> (key, target_id, slot, source_id, d, gap, weight).

    The n sources of the smallest keys for each row of targets, fewer if the tree has fewer.  Draws depend on seed and key.  A target is no
    source of itself; one without a place or time has none.
    """
    site = ["key", "target_id", "t_lat", "t_lon", "t_t", "d_scale", "t_scale"]
    given = targets.where(~missing(F.col("t_lat")) & ~missing(F.col("t_lon")) & ~missing(F.col("t_t")) & F.col("key").isNotNull() & F.col("target_id").isNotNull()).select(*site)
    if not tree.size:
        nothing = (F.lit(0.0).alias(c) for c in ("d", "gap", "weight"))
        return given.where(F.lit(False)).select("key", "target_id", F.lit(0).alias("slot"), F.col("target_id").alias("source_id"), *nothing)
    # A stated number of partitions: targets are few and small, their descent is what takes time.
    given = given.repartition(int(tree.spark.conf.get("spark.sql.shuffle.partitions")), "key")
    upto, top = tree.top()
    schema = ", ".join((*(f"`{f.name}` {f.dataType.simpleString()}" for f in given.schema), "`at` string, m bigint, e double, `limit` double"))
    front = given.mapInArrow(_upper(seed, n, with_time, tree.size, top), schema)
    for level in range(upto + 1, tree.depth + 1):
        front = front.join(tree.children(level), F.col("at") == F.col("parent")).mapInArrow(_lower(seed, n, with_time), schema)
    # Drawn before the join, once for a leaf.
    met = front.withColumn("pick", F.floor(draw(f"{seed}#c", F.col("key"), F.col("at")) * F.col("m"))).join(tree.members, F.col("at") == F.col("home"))
    met = met.where(F.col("site_id") != F.col("target_id")).withColumn("d", haversine_km(F.col("t_lat"), F.col("t_lon"), F.col("latitude"), F.col("longitude"))).withColumn("gap", F.abs(F.col("t_t") - F.col("t_days")))
    met = met.where(F.col("e") * (_scaled(F.col("d"), F.col("gap"), with_time) + EPS) <= F.col("limit"))
    met = met.withColumn("e", F.col("e") + F.when(F.col("pick") == F.col("rank"), 0.0).otherwise(-F.log(draw(f"{seed}#m", F.col("key"), F.col("site_id")))))
    met = met.select("key", "target_id", F.col("site_id").alias("source_id"), "d", "gap", (_scaled(F.col("d"), F.col("gap"), with_time) + EPS).alias("away"), "e")
    slot = F.row_number().over(Window.partitionBy("key").orderBy(F.col("e") * F.col("away"), "source_id"))
    return met.withColumn("slot", slot).where(F.col("slot") <= n).select("key", "target_id", "slot", "source_id", "d", "gap", (1 / F.col("away")).alias("weight"))
