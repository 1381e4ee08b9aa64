"""Training, validation and test splits of sites."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import index_of


def degree_cells(sites: DataFrame, degrees: float = 5.0) -> DataFrame:
    """cell: the number of the degree cell that holds the site."""
    return sites.withColumn("cell", F.floor((F.col("latitude") + 90) / degrees).cast("long") * F.lit(int(360 / degrees)) + F.floor((F.col("longitude") + 180) / degrees).cast("long"))


def planar_cells(sites: DataFrame, x: str, y: str, n_cells: int = 20) -> DataFrame:
    """cell of a regular grid over the extent: xi * n + yi."""
    lo = sites.agg(F.min(x).alias("_x0"), F.max(x).alias("_x1"), F.min(y).alias("_y0"), F.max(y).alias("_y1"))
    at = lambda v, a, b: index_of((F.col(v) - F.col(a)) / (F.col(b) - F.col(a) + 1e-9) * n_cells, n_cells).cast("long")
    return sites.crossJoin(F.broadcast(lo)).withColumn("cell", at(x, "_x0", "_x1") * n_cells + at(y, "_y0", "_y1")).drop("_x0", "_x1", "_y0", "_y1")


def _checked(train: float, test: float) -> None:
    if not (0 < train < 1 and 0 <= test < 1 and train + test <= 1):
        raise ValueError("fractions must be positive and not above one together")


def block_split(sites: DataFrame, train: float = 0.8, test: float = 0.1, seed: str = "42", rule: str = "test_first") -> DataFrame:
    """(site_id, cell, split): whole cells, permuted by a seed, go to a split.

    test_first: test and validation get a rounded share, at least one cell each, the rest trains.
    train_first: training gets a rounded share, then validation and test what is left.
    Only the distinct cells are ordered; their number is that of the grid, not of the sites.
    """
    _checked(train, test)
    w = Window.orderBy(F.md5(F.concat_ws("|", F.lit(seed), F.col("cell").cast("string"))), "cell")
    cells = sites.select("cell").distinct()
    ranked = cells.withColumn("k", F.row_number().over(w)).crossJoin(F.broadcast(cells.agg(F.count("*").alias("n"))))
    if rule == "test_first":
        n_test = F.greatest(F.rint(F.col("n") * test), F.lit(1))
        n_val = F.greatest(F.rint(F.col("n") * (1 - train - test)), F.lit(1))
        split = F.when(F.col("k") <= n_test, "test").when(F.col("k") <= n_test + n_val, "val").otherwise("train")
    elif rule == "train_first":
        n_train = F.rint(F.col("n") * train)
        n_test = F.rint(F.col("n") * test)
        split = F.when(F.col("k") <= n_train, "train").when(F.col("k") <= F.col("n") - n_test, "val").otherwise("test")
    else:
        raise ValueError(f"unknown rule {rule}")
    return sites.join(ranked.select("cell", split.alias("split")), "cell").select("site_id", "cell", "split")


def random_split(sites: DataFrame, train: float = 0.8, test: float = 0.1, seed: str = "42", shards: int = 64) -> DataFrame:
    """(site_id, split): the first int(n * train) sites of a seeded order train, the last int(n * test) test.

    The order is ranked in two steps, by shards of the hash and inside each, so no task sorts all sites.
    """
    _checked(train, test)
    h = F.md5(F.concat_ws("|", F.lit(seed), F.col("site_id").cast("string")))
    rows = sites.select("site_id", h.alias("h")).withColumn("shard", F.floor(F.conv(F.substring("h", 1, 4), 16, 10).cast("long") * shards / 65536).cast("int"))
    sizes = rows.groupBy("shard").agg(F.count("*").alias("size"))
    before = sizes.select("shard", (F.sum("size").over(Window.orderBy("shard")) - F.col("size")).alias("before"), F.sum("size").over(Window.partitionBy()).alias("n"))
    k = F.row_number().over(Window.partitionBy("shard").orderBy("h", "site_id")) + F.col("before")
    ranked = rows.join(F.broadcast(before), "shard").withColumn("k", k)
    split = F.when(F.col("k") <= F.floor(F.col("n") * train), "train").when(F.col("k") > F.col("n") - F.floor(F.col("n") * test), "test").otherwise("val")
    return ranked.select("site_id", split.alias("split"))


def members(splits: DataFrame, split: str) -> DataFrame:
    return splits.where(F.col("split") == split)


def source_pool(sites: DataFrame, splits: DataFrame, train_only: bool = True) -> DataFrame:
    """Sites that may serve as sources."""
    return sites.join(members(splits, "train"), "site_id", "left_semi") if train_only else sites


def checked_against(splits: DataFrame, sites: DataFrame) -> DataFrame:
    """One row: sites without a split, splits without a site, and both counts (all equal: the split still fits)."""
    a = sites.select("site_id").distinct()
    b = splits.select("site_id").distinct()
    gone, new = b.join(a, "site_id", "left_anti"), a.join(b, "site_id", "left_anti")
    count = lambda df, name: df.agg(F.count("*").alias(name))
    return count(a, "n_sites").crossJoin(count(b, "n_split")).crossJoin(count(new, "n_unsplit")).crossJoin(count(gone, "n_gone"))

