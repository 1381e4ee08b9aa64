"""Sampling of neighbouring sites and the predictor built on it.

Draws follow weights 1 / (distance + 1e-6) without replacement: the n smallest of the keys e / weight, e an exponential of seed, target and
source.  At every size they are found over a tree of the pool (see tree); no target looks at all sites.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tree


def _targets(targets: DataFrame) -> DataFrame:
    """Without scales: distances count in kilometres and days."""
    at = [F.col(c).cast("double").alias(name) for c, name in (("latitude", "t_lat"), ("longitude", "t_lon"), ("t_days", "t_t"))]
    return targets.select(F.col("site_id").cast("string").alias("key"), F.col("site_id").alias("target_id"), *at, F.lit(1.0).alias("d_scale"), F.lit(1.0).alias("t_scale"))


def scales(targets: DataFrame, pool: DataFrame | tree.Tree, n: int, seed: str) -> DataFrame:
    """First stage: n sources near in space; the medians of their distances and gaps (and 1e-6) are the target's scales."""
    over = pool if isinstance(pool, tree.Tree) else tree.Tree(pool)
    first = tree.sampled(over, _targets(targets), n, f"{seed}#1", False)
    return first.groupBy("target_id").agg((F.percentile("d", F.lit(0.5)) + tree.EPS).alias("d_scale"), (F.percentile("gap", F.lit(0.5)) + tree.EPS).alias("t_scale"))


def sources(targets: DataFrame, pool: DataFrame | tree.Tree, n: int, seed: str, with_time: bool = True, replacement: bool | None = None) -> DataFrame:
    """(target_id, slot, source_id, d, gap, weight): n sources of each target, near in space and time on the target's scales.

    replacement: draw each slot by itself, so that a source may come again; by default only if the pool has fewer than n other sites.
    A target or site without a place or time has no sources and is none; ids are taken once.
    """
    over = pool if isinstance(pool, tree.Tree) else tree.Tree(pool)
    at = _targets(targets).drop("d_scale", "t_scale").join(scales(targets, over, n, seed), "target_id")
    if over.size - 1 < n if replacement is None else replacement:
        return with_replacement(over, at, n, seed, with_time)
    return tree.sampled(over, at, n, f"{seed}#2", with_time).drop("key")


def with_replacement(over: tree.Tree, targets: DataFrame, n: int, seed: str, with_time: bool = True) -> DataFrame:
    """n draws of each target, each by keys of its own: the smallest is that of a source by its share of all weights."""
    slots = targets.withColumn("slot", F.explode(F.sequence(F.lit(1), F.lit(n)))).withColumn("key", F.concat_ws("|", "key", "slot"))
    drawn = tree.sampled(over, slots, 1, f"{seed}#r", with_time)
    return drawn.select("target_id", F.substring_index("key", "|", -1).cast("int").alias("slot"), "source_id", "d", "gap", "weight")


def tree_sources(targets: DataFrame, pool: DataFrame, n: int, seed: str, with_time: bool = True) -> DataFrame:
    """sources() without replacement, whatever the size of the pool."""
    return sources(targets, pool, n, seed, with_time, False)


def gathered(drawn: DataFrame, presence: DataFrame) -> DataFrame:
    """(target_id, sources): the states of each target's sources in order of their slots."""
    states = presence.groupBy(F.col("site_id").alias("source_id")).agg(F.array_sort(F.collect_set("species")).alias("species"))
    rows = drawn.join(states, "source_id", "left").select("target_id", F.struct("slot", "source_id", F.coalesce("species", F.array().cast("array<string>")).alias("species")).alias("x"))
    return rows.groupBy("target_id").agg(F.array_sort(F.collect_list("x")).alias("sources"))


def neighbour_prediction(drawn: DataFrame, presence: DataFrame, species: DataFrame) -> DataFrame:
    """(target_id, species, p): weighted share of the sources with the species.  A baseline, not a trained model."""
    drawn = tree._written(drawn, "drawn")  # used twice
    total = drawn.groupBy("target_id").agg(F.sum("weight").alias("total"))
    there = drawn.join(presence, drawn.source_id == presence.site_id).groupBy("target_id", "species").agg(F.sum("weight").alias("w"))
    every = total.crossJoin(species.select("species").distinct())
    return every.join(there, ["target_id", "species"], "left").select("target_id", "species", (F.coalesce("w", F.lit(0.0)) / F.col("total")).alias("p"))


def training_rows(drawn: DataFrame, masks: DataFrame, presence: DataFrame, env: DataFrame) -> DataFrame:
    """(target_id, env, states, sources): what a trainer reads, a row for each target.

    masks: site_id, species, state and label of the targets; env: site_id and env of targets and sources.  states are
    (species, state, label) by species, sources (slot, source_id, env, d, gap, species) by slot.
    """
    there = presence.groupBy(F.col("site_id").alias("source_id")).agg(F.array_sort(F.collect_set("species")).alias("species"))
    rows = drawn.join(there, "source_id", "left").join(env.withColumnRenamed("site_id", "source_id"), "source_id", "left")
    one = F.struct("slot", "source_id", "env", "d", "gap", F.coalesce("species", F.array().cast("array<string>")).alias("species"))
    sources = rows.groupBy("target_id").agg(F.array_sort(F.collect_list(one)).alias("sources"))
    states = masks.groupBy(F.col("site_id").alias("target_id")).agg(F.array_sort(F.collect_list(F.struct("species", "state", "label"))).alias("states"))
    return sources.join(states, "target_id").join(env.withColumnRenamed("site_id", "target_id"), "target_id", "left").select("target_id", "env", "states", "sources")


def with_grid(observations: DataFrame, grid: DataFrame) -> DataFrame:
    """Observations and prediction points together; kind tells them apart, and only obs may be sources."""
    return observations.withColumn("kind", F.lit("obs")).unionByName(grid.withColumn("kind", F.lit("grid")), allowMissingColumns=True)
