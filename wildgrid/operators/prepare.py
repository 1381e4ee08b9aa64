"""From raw checklists and plots to a table of sites and presences."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import missing, uniform
from . import tree

#: What the region filters keep.
UNSTRUCTURED = ("Incidental Observation(s)", "Historical")
NORTH_AMERICA = {"lon": (-170.0, -50.0), "lat": (7.0, 84.0)}
CONTERMINOUS = {"lon": (-125.0, -66.0), "lat": (24.0, 50.0), "without": ("Hawaii", "Alaska")}
FIRST_YEAR, LAST_YEAR, PERIOD = 1950, 2026, (2011, 2025)


def structured(events: DataFrame, dropped: Sequence[str] = UNSTRUCTURED) -> DataFrame:
    """Checklists of a structured protocol; those without a protocol stay."""
    return events.where(~F.coalesce(F.col("protocol").isin(*dropped), F.lit(False)))


def in_box(lon: tuple[float, float], lat: tuple[float, float]) -> Column:
    return F.col("longitude").between(*lon) & F.col("latitude").between(*lat)


def in_region(events: DataFrame, countries: Sequence[str] | None = None, without: Sequence[str] = (), lon=(-180.0, 180.0), lat=(-90.0, 90.0)) -> DataFrame:
    """Countries, excluded provinces (a missing province stays) and an inclusive box."""
    keep = in_box(lon, lat) & ~F.coalesce(F.col("province").isin(*without), F.lit(False))
    return events.where(keep & F.col("country").isin(*countries) if countries is not None else keep)


def plot_region(plots: DataFrame, region: str, europe_without: Sequence[str] = (), continent: str = "continent") -> DataFrame:
    """us, europe, australia or global."""
    if region == "global":
        return plots
    if region == "us":
        return plots.where(in_box(CONTERMINOUS["lon"], CONTERMINOUS["lat"]))
    if region == "europe":
        return plots.where((F.col(continent) == "EUROPE") & ~F.coalesce(F.col("country").isin(*europe_without), F.lit(False)) & (F.col("latitude") <= 72))
    if region == "australia":
        return plots.where(F.col("country") == "AUSTRALIA")
    raise ValueError(f"unknown region {region}")


def consensus(plots: DataFrame, all_records: bool = False) -> DataFrame:
    """Plots of the resampled consensus with coordinates and a date; all_records asks for coordinates only."""
    placed = plots.where(F.col("latitude").isNotNull() & F.col("longitude").isNotNull())
    return placed if all_records else placed.where(F.coalesce(F.col("consensus"), F.lit(False)) & F.col("date").isNotNull())


def valid_place_and_date(events: DataFrame, date: str = "date", years=(FIRST_YEAR, LAST_YEAR)) -> DataFrame:
    """Coordinates are there, and the date can be read (else it counts as missing) and lies in the years."""
    day = F.col(date) if dict(events.dtypes)[date] == "date" else F.try_to_timestamp(F.col(date)).cast("date")
    return events.withColumn("time", day).where(F.col("latitude").isNotNull() & F.col("longitude").isNotNull() & F.year("time").between(*years))


def of_rank(occurrences: DataFrame, rank: str = "SPECIES") -> DataFrame:
    return occurrences.where(F.col("taxon_rank") == rank)


def missing_columns(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column, n_missing) of every column, in one pass."""
    columns = list(columns or df.columns)
    kinds = dict(df.dtypes)
    lacks = [F.sum((missing(F.col(c)) if kinds[c] in ("double", "float") else F.col(c).isNull()).cast("long")).alias(c) for c in columns]
    counts = df.agg(*lacks)
    return counts.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.coalesce(F.col(c), F.lit(0)).alias("n_missing")) for c in columns))).alias("x")).select("x.*")


def refuse_missing(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """df itself, or an error that names the columns with missing values."""
    bad = [r["column"] for r in missing_columns(df, columns).where("n_missing > 0").collect()]
    if bad:
        raise ValueError(f"missing values in {', '.join(bad)}")
    return df


def with_days(df: DataFrame, time: str | None = "time") -> DataFrame:
    """t_days: whole days since the first date; a number as it is; 0 without a time."""
    if time is None or time not in df.columns:
        return df.withColumn("t_days", F.lit(0.0))
    if dict(df.dtypes)[time] in ("double", "float", "int", "bigint"):
        return df.withColumn("t_days", F.col(time).cast("double"))
    first = df.agg(F.min(F.to_date(time)).alias("_first"))
    return df.crossJoin(F.broadcast(first)).withColumn("t_days", F.datediff(F.to_date(time), "_first").cast("double")).drop("_first")


def with_some_covariate(df: DataFrame, env: Sequence[str]) -> DataFrame:
    """A table without covariates gets one that is zero."""
    return df if env else df.withColumn("env_none", F.lit(0.0))


def seeded_sample(df: DataFrame, n: int, seed: str, key: str) -> DataFrame:
    """n rows, the same ones for a seed on any partitioning."""
    return df.orderBy(F.md5(F.concat_ws("|", F.lit(seed), F.col(key).cast("string"))), key).limit(n)


def varying_features(long: DataFrame) -> DataFrame:
    """long(feature, value) -> features whose sample variance is above zero."""
    return long.groupBy("feature").agg(F.var_samp("value").alias("variance")).where("variance > 0")


def standardised(long: DataFrame, train: Column, eps: float = 1e-4) -> DataFrame:
    """long(row, feature, value) -> z: by mean and population deviation of the training rows, missing values ignored."""
    stats = long.where(train & ~missing(F.col("value"))).groupBy("feature").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("dev"))
    return long.join(stats, "feature").withColumn("z", (F.col("value") - F.col("mean")) / (F.col("dev") + eps))


def in_all_splits(presence: DataFrame, splits: DataFrame) -> DataFrame:
    """Species present in each of the three splits."""
    return presence.join(splits, "site_id").groupBy("species").agg(F.countDistinct("split").alias("n")).where("n = 3").select("species")


def semi(occurrences: DataFrame, events: DataFrame) -> DataFrame:
    return occurrences.join(events, occurrences.event_id == events.site_id, "left_semi")


def aligned_sites(sites: DataFrame, occurrences: DataFrame, mode: str) -> DataFrame:
    """drop_unmatched: only sites with an occurrence; zero_fill: all of them."""
    if mode == "zero_fill":
        return sites
    if mode == "drop_unmatched":
        return sites.join(occurrences.select(F.col("event_id").alias("site_id")).distinct(), "site_id", "left_semi")
    raise ValueError(f"unknown mode {mode}")


def presences(occurrences: DataFrame) -> DataFrame:
    """(site_id, species), once each; records without a species go.  Absences are implied."""
    return occurrences.where(F.col("species").isNotNull()).select(F.col("event_id").alias("site_id"), "species").distinct()


def frequent_species(presence: DataFrame, least: int) -> DataFrame:
    """Presences of the species that have at least so many of them."""
    kept = presence.groupBy("species").count().where(F.col("count") >= least).select("species")
    return presence.join(kept, "species", "left_semi")


def frequent_in_period(presence: DataFrame, sites: DataFrame, least: int, period=PERIOD) -> DataFrame:
    """The threshold counts before the cut to a period and once more after it."""
    inside = sites.where(F.year("time").between(*period)).select("site_id")
    return frequent_species(frequent_species(presence, least).join(inside, "site_id", "left_semi"), least)


def complete_sites(sites: DataFrame, env: Sequence[str]) -> DataFrame:
    keep = ~missing(F.col(env[0]))
    for c in env[1:]:
        keep = keep & ~missing(F.col(c))
    return sites.where(keep)


def dropped_share(before: DataFrame, after: DataFrame) -> DataFrame:
    a, b = before.agg(F.count("*").alias("n_before")), after.agg(F.count("*").alias("n_after"))
    return a.crossJoin(b).withColumn("share_dropped", 1 - F.col("n_after") / F.col("n_before"))


def prevalence(presence: DataFrame, sites: DataFrame) -> DataFrame:
    """Presences over all sites, per species; the zeros are implied."""
    total = sites.agg(F.count("*").alias("n_sites"))
    return presence.groupBy("species").agg(F.count("*").alias("n_pres")).crossJoin(F.broadcast(total)).withColumn("prevalence", F.col("n_pres") / F.col("n_sites"))


def by_decade(sites: DataFrame) -> DataFrame:
    return sites.groupBy((F.floor(F.year("time") / 10) * 10).cast("int").alias("decade")).agg(F.count("*").alias("n"))


def top_countries(sites: DataFrame, n: int = 10) -> DataFrame:
    return sites.groupBy("country").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "country").limit(n)


def extent(sites: DataFrame, presence: DataFrame) -> DataFrame:
    a = sites.agg(F.min("latitude").alias("lat_min"), F.max("latitude").alias("lat_max"), F.min("longitude").alias("lon_min"), F.max("longitude").alias("lon_max"), F.min("time").alias("first"), F.max("time").alias("last"), F.count("*").alias("n_sites"))
    return a.crossJoin(presence.agg(F.countDistinct("species").alias("n_species")))


def imputed(df: DataFrame, column: str) -> DataFrame:
    """Zero and NaN count as missing, and what is missing becomes the mean of the rest."""
    there = F.when(~missing(F.col(column)) & (F.col(column) != 0), F.col(column))
    mean = df.agg(F.avg(there).alias("_mean"))
    return df.crossJoin(F.broadcast(mean)).withColumn(column, F.coalesce(there, "_mean")).drop("_mean")


def effective_number_weights(counts: DataFrame, beta: float) -> DataFrame:
    """counts(species, n) -> weight (1 - beta) / (1 - beta^n), with a mean of one."""
    if not 0 < beta < 1:
        raise ValueError("beta must lie between 0 and 1")
    raw = counts.withColumn("raw", (1 - beta) / (1 - F.pow(F.lit(beta), F.greatest("n", F.lit(1)))))
    return raw.crossJoin(F.broadcast(raw.agg(F.avg("raw").alias("_mean")))).withColumn("weight", F.col("raw") / F.col("_mean")).drop("_mean", "raw")


def inverse_prevalence_weights(counts: DataFrame, n_sites: Column) -> DataFrame:
    return counts.withColumn("weight", n_sites / (F.col("n") + 1e-5))


#: Sites whose presences of a species are one bitmap: 64 words of 64 bits.
CHUNK, WORD = 4096, 64


def bitmaps(presence: DataFrame) -> DataFrame:
    """(species, chunk, words): the sites of each species as bits, in chunks of 4,096 sites that have any species."""
    sites = numbered(presence.select("site_id").where("site_id is not null").distinct(), "site_id")
    at = presence.join(sites, "site_id").select("species", "row_index")
    words = at.groupBy("species", F.floor(F.col("row_index") / CHUNK).alias("chunk"), F.floor(F.col("row_index") % CHUNK / WORD).cast("int").alias("word"))
    words = words.agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("row_index") % WORD).cast("int"))).alias("bits"))
    held = words.groupBy("species", "chunk").agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("held"))
    every = F.transform(F.sequence(F.lit(0), F.lit(CHUNK // WORD - 1)), lambda k: F.coalesce(F.try_element_at("held", k), F.lit(0).cast("long")))
    return held.select("species", "chunk", every.alias("words"))


def cooccurrence(presence: DataFrame, sites: DataFrame) -> DataFrame:
    """Pairs of species: joint presences, conditional probability, lift and phi.

    Joint presences are the common bits of bitmaps, chunk by chunk: a row for a pair of species and 4,096 sites, none for a pair and a site.
    """
    one = tree._written(bitmaps(presence), "bitmaps")
    a, b = (one.select("chunk", F.col("species").alias(f"species_{s}"), F.col("words").alias(f"words_{s}")) for s in "ab")
    common = F.aggregate(F.zip_with("words_a", "words_b", lambda x, y: F.bit_count(x.bitwiseAND(y))), F.lit(0).cast("long"), lambda s, x: s + x)
    joint = a.join(b, "chunk").where("species_a < species_b").groupBy("species_a", "species_b").agg(F.sum(common).alias("n_ab")).where("n_ab > 0")
    n = presence.groupBy("species").agg(F.count("*").alias("n"))
    out = joint.join(n.withColumnsRenamed({"species": "species_a", "n": "n_a"}), "species_a").join(n.withColumnsRenamed({"species": "species_b", "n": "n_b"}), "species_b")
    out = out.crossJoin(F.broadcast(sites.agg(F.count("*").cast("double").alias("total"))))
    phi = (F.col("total") * F.col("n_ab") - F.col("n_a") * F.col("n_b")) / F.sqrt(F.col("n_a") * F.col("n_b") * (F.col("total") - F.col("n_a")) * (F.col("total") - F.col("n_b")))
    return out.select("species_a", "species_b", "n_ab", (F.col("n_ab") / F.col("n_a")).alias("b_given_a"), (F.col("n_ab") * F.col("total") / (F.col("n_a") * F.col("n_b"))).alias("lift"), phi.alias("phi"))


def split_summary(splits: DataFrame) -> DataFrame:
    return splits.groupBy("split").agg(F.count("*").alias("n"), F.countDistinct("cell").alias("n_cells"))


def coverage(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Per column: valid values, mean, least and largest; and in how many rows any is missing."""
    kept = {c: F.when(~missing(F.col(c)), F.col(c)) for c in columns}
    anything = F.lit(False)
    for c in columns:
        anything = anything | missing(F.col(c))
    wide = df.agg(F.sum(anything.cast("long")).alias("n_incomplete"), *(f(v).alias(f"{n}|{c}") for c, v in kept.items() for n, f in (("n", F.count), ("mean", F.avg), ("min", F.min), ("max", F.max))))
    rows = F.array(*(F.struct(F.lit(c).alias("column"), *(F.col(f"`{n}|{c}`").alias(n) for n in ("n", "mean", "min", "max"))) for c in columns))
    return wide.select("n_incomplete", F.explode(rows).alias("x")).select("x.*", "n_incomplete")


def numbered(df: DataFrame, *order: str) -> DataFrame:
    """An explicit 0-based row number over a stated order, for imports that know rows only by position.

    Rows are dealt to partitions by ranges of the order and sorted there; a row's number is its place in its partition and the rows of the
    partitions before, so no task sees all rows.  Of rows equal in the order, also of many, any may come first.
    """
    spark, mark = df.sparkSession, "_" + "_".join(df.columns)
    parts, tie = int(spark.conf.get("spark.sql.shuffle.partitions")), F.xxhash64(F.monotonically_increasing_id())
    dealt = df.withColumn(mark, tie).repartitionByRange(parts, *order, mark).sortWithinPartitions(*order, mark).withColumn(mark, F.monotonically_increasing_id())
    rows = tree._written(dealt, "ranges")
    part, place, own, upto = F.shiftright(mark, 33), F.col(mark).bitwiseAND(F.lit((1 << 33) - 1)), f"{mark}_part", f"{mark}_before"
    sizes = rows.groupBy(part.alias(own)).count()  # a row for each partition
    before = F.sum("count").over(Window.orderBy(own).rowsBetween(Window.unboundedPreceding, 0)) - F.col("count")
    offsets = sizes.select(own, before.alias(upto))
    return rows.join(F.broadcast(offsets), part == F.col(own)).select(*df.columns, (F.col(upto) + place).alias("row_index"))


def random_species(presence: DataFrame, n: int, seed: str) -> DataFrame:
    return seeded_sample(presence.select("species").distinct(), n, seed, "species")


def rate_draw(spec: str | float, seed: str, key: Column) -> Column:
    """A row's mask rate: a number in [0, 1], unif, unif:lo,hi, or beta:a,b with whole a and b.

    Beta is the a-th smallest of a + b - 1 uniform numbers.
    """
    text = str(spec)
    if text.startswith("beta:"):
        a, b = (float(x) for x in text[5:].split(","))
        if a <= 0 or b <= 0 or a != int(a) or b != int(b):
            raise ValueError("beta needs positive whole parameters here")
        draws = F.array_sort(F.array(*(uniform(seed, key, str(i)) for i in range(int(a + b) - 1))))
        return F.element_at(draws, int(a))
    if text.startswith("unif"):
        lo, hi = (float(x) for x in text[5:].split(",")) if text.startswith("unif:") else (0.0, 1.0)
        if not 0 <= lo <= hi <= 1:
            raise ValueError("unif needs 0 <= lo <= hi <= 1")
        return lo + (hi - lo) * uniform(seed, key)
    rate = float(text)
    if not 0 <= rate <= 1:
        raise ValueError("a rate lies between 0 and 1")
    return F.lit(rate)
