"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint_dir


#: Tasks that the edges of one node are dealt to.
SALTS = 8
#: Edges up to which one task solves the whole table: some 16 MB, where rounds of joins would be all overhead.
ALONE = 1 << 19


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """Link the larger (large) or smaller neighbours of each node to the smallest node around it."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    near = both if large else both.where("v < u")
    least = near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    linked = near.where("v > u") if large else near
    # The smallest node of a third of all edges would meet them in one task: its edges are dealt by their other end.
    dealt = linked.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALTS)))
    salted = least.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    out = dealt.join(salted, ["u", "salt"]).select(F.col("v").alias("u"), F.col("m").alias("v"))
    if not large:
        out = out.union(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def _alone(batches):
    """(node, component) of edges (u, v), all of them: the smaller of two roots becomes the root of both."""
    root: dict[int, int] = {}

    def find(x):
        while (up := root.setdefault(x, x)) != x:
            root[x] = root[up]
            x = root[x]
        return x

    for b in batches:
        for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            u, v = find(u), find(v)
            if u != v:
                root[max(u, v)] = min(u, v)
    nodes = list(root)
    for k in range(0, len(nodes), 1 << 16):
        part = nodes[k : k + (1 << 16)]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array([find(x) for x in part], pa.int64())], names=["node", "component"])


def connected_components(edges: DataFrame, rounds: int = 60, alone: int = ALONE) -> DataFrame:
    """edges(u, v) -> (node, component): component is the smallest node reachable.

    Nodes without an edge do not appear; null ends and loops are ignored.  A table of up to `alone` edges is solved in one task, with the
    same result.  Else each round is cut by a
    reliable checkpoint; the number of rounds grows with the logarithm of the longest path.
    """
    checkpoint_dir(edges.sparkSession)
    now = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct().checkpoint()
    if now.count() <= alone:
        return now.select(F.col("u").cast("long"), F.col("v").cast("long")).repartition(1).mapInArrow(_alone, "node long, component long").checkpoint()
    mark = None
    for _ in range(rounds):
        now = _stars(_stars(now, True), False).checkpoint()
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == mark:
            break
        mark = seen
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select(F.col("v"), F.col("v")).distinct())
