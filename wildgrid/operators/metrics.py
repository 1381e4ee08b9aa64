"""Scores of predictions per group: ranking, precision, calibration and the continuous Boyce index.

Input: scored(keys..., y in {0, 1}, p).  A group with one class only is skipped; a prediction that is NaN or
missing makes the group's metrics NaN.  Ranking metrics first collapse rows to distinct predictions,
so a group's sort grows with its distinct values and not with its rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import clamped, fresh, index_of, missing

BINS = 15
#: Boyce index: centres 0, 0.01, ..., 1; half the window; least background in a window; least windows.
CENTRES, HALF, BACKGROUND, WINDOWS = 101, 0.05, 10, 3
METRICS = ("auroc", "auprc", "cbi", "brier", "ece")
NAN = float("nan")


def _collapsed(scored: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, p, pos, neg): how often each distinct prediction occurs with each class; missing ones, NaN too, as null."""
    p = F.when(~missing(F.col("p")), F.col("p").cast("double")).alias("p")
    return scored.groupBy(*keys, p).agg(F.sum("y").cast("double").alias("pos"), F.sum(1 - F.col("y")).cast("double").alias("neg"))


def ranking(scored: DataFrame, keys: Sequence[str]) -> DataFrame:
    """auroc (ties count a half) and auprc (average precision over distinct thresholds)."""
    return _ranking(_collapsed(scored, keys), keys)


def _range_of(p: Column) -> Column:
    """One of some five thousand ranges in order of p, even where predictions crowd near 0 or 1."""
    steep = F.floor(clamped(F.log(p / (1 - p)) * 64, F.lit(-2560.0), F.lit(2560.0)))
    return F.when(p <= 0, -2561).when(p >= 1, 2561).otherwise(steep).cast("int")


def _ranking(collapsed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Running sums on two levels: over the ranges of a group, of which there are some thousand, and within each range.

    So a group with many distinct predictions is no single task's window.
    """
    part = fresh("range", collapsed.columns)
    rows = collapsed.where("p is not null").withColumn(part, _range_of(F.col("p")))
    own, over = Window.partitionBy(*keys, part), Window.partitionBy(*keys).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy(*keys, part).agg(F.sum("pos").alias("range_pos"), F.sum("neg").alias("range_neg"))
    before = lambda c: F.coalesce(F.sum(c).over(over), F.lit(0.0))
    every = Window.partitionBy(*keys)
    after = lambda c: F.sum(c).over(every) - before(c) - F.col(c)
    sums = sums.select(*keys, part, before("range_neg").alias("neg_below"), after("range_pos").alias("pos_above"), after("range_neg").alias("neg_above"))
    up, down = own.orderBy("p").rowsBetween(Window.unboundedPreceding, -1), own.orderBy(F.desc("p")).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.select(*keys, part, "pos", "neg", F.coalesce(F.sum("neg").over(up), F.lit(0.0)).alias("below"), F.sum("pos").over(down).alias("tp"), F.sum("neg").over(down).alias("fp"))
    same = [F.col(f"r.{c}").eqNullSafe(F.col(f"s.{c}")) for c in (*keys, part)]
    rows = rows.alias("r").join(sums.alias("s"), reduce(and_, same)).select("r.*", "neg_below", "pos_above", "neg_above")
    below, tp, fp = F.col("below") + F.col("neg_below"), F.col("tp") + F.col("pos_above"), F.col("fp") + F.col("neg_above")
    out = rows.groupBy(*keys).agg(F.sum(F.col("pos") * (below + F.col("neg") / 2)).alias("u"), F.sum("pos").alias("np"), F.sum("neg").alias("nn"), F.sum(F.col("pos") * tp / (tp + fp)).alias("ap"))
    return out.where("np > 0 and nn > 0").select(*keys, (F.col("u") / (F.col("np") * F.col("nn"))).alias("auroc"), (F.col("ap") / F.col("np")).alias("auprc"))


def brier(scored: DataFrame, keys: Sequence[str]) -> DataFrame:
    return scored.groupBy(*keys).agg(F.avg(F.pow(F.col("p") - F.col("y"), 2)).alias("brier"))


def bin_of(p: Column) -> Column:
    return index_of(p * BINS, BINS)


def ece(scored: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Expected calibration error over 15 equal bins; a prediction of 1 falls into the last, a missing one does not count."""
    bins = scored.where(~missing(F.col("p"))).groupBy(*keys, bin_of(F.col("p")).alias("bin")).agg(F.count("*").alias("n"), F.avg("p").alias("conf"), F.avg(F.col("y").cast("double")).alias("freq"))
    return bins.groupBy(*keys).agg((F.sum(F.col("n") * F.abs(F.col("conf") - F.col("freq"))) / F.sum("n")).alias("ece"))


def pooled_ece(scored: DataFrame) -> DataFrame:
    """One group, half-open bins: a prediction of exactly 1 is in none, but counts in the denominator."""
    total = scored.where(~missing(F.col("p"))).agg(F.count("*").alias("total"))
    bins = scored.where("p < 1").groupBy(F.floor(F.col("p") * BINS).alias("bin")).agg(F.count("*").alias("n"), F.avg("p").alias("conf"), F.avg(F.col("y").cast("double")).alias("freq"))
    return bins.agg(F.sum(F.col("n") * F.abs(F.col("conf") - F.col("freq"))).alias("s")).crossJoin(total).select((F.col("s") / F.col("total")).alias("ece"))


def boyce(scored: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rank correlation of window centre and predicted-to-expected ratio over windows that are closed on both sides.

    Each distinct prediction is sent to the few centres that can hold it and checked exactly there.
    """
    return _boyce(_collapsed(scored, keys), keys)


def _boyce(collapsed: DataFrame, keys: Sequence[str]) -> DataFrame:
    rows = collapsed.where("p is not null")
    totals = rows.groupBy(*keys).agg(F.sum("pos").alias("np"), F.sum("neg").alias("nn")).where("np > 0 and nn > 0")
    low = F.greatest(F.floor((F.col("p") - HALF) * 100) - 1, F.lit(0)).cast("int")
    high = F.least(F.ceil((F.col("p") + HALF) * 100) + 1, F.lit(CENTRES - 1)).cast("int")
    at = rows.where("p between -0.05 and 1.05").withColumn("c", F.explode(F.sequence(low, high))).withColumn("centre", F.col("c") / F.lit(100.0))
    inside = at.where((F.col("p") >= F.col("centre") - HALF) & (F.col("p") <= F.col("centre") + HALF))
    windows = inside.groupBy(*keys, "centre").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")).where(F.col("neg") >= BACKGROUND).join(totals, list(keys))
    windows = windows.withColumn("ratio", (F.col("pos") / F.col("np")) / (F.col("neg") / F.col("nn")))
    w = Window.partitionBy(*keys)
    rank = lambda c: F.rank().over(w.orderBy(c)) + (F.count("*").over(w.partitionBy(*keys, c)) - 1) / 2
    uneven = F.max("ratio").over(w) > F.min("ratio").over(w)  # else there is no correlation
    ranked = windows.withColumn("r1", F.when(uneven, rank("centre"))).withColumn("r2", F.when(uneven, rank("ratio")))
    out = ranked.groupBy(*keys).agg(F.count("*").alias("w"), F.countDistinct("ratio").alias("d"), F.corr("r1", "r2").alias("cbi"))
    return totals.select(*keys).join(out, list(keys), "left").select(*keys, F.when((F.col("w") >= WINDOWS) & (F.col("d") >= 2), F.col("cbi")).otherwise(F.lit(NAN)).alias("cbi"))


def _calibration(collapsed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """n, n_pres, ece and bad (a prediction is missing) of the groups that are scored: both classes occur."""
    n, p = F.col("pos") + F.col("neg"), F.col("p")
    bins = collapsed.groupBy(*keys, bin_of(p).alias("bin")).agg(F.sum(n).alias("n"), F.sum("pos").alias("pos"), F.sum(p * n).alias("sum_p"), F.max(p.isNull().cast("int")).alias("bad"))
    out = bins.groupBy(*keys).agg(
        F.sum("n").cast("long").alias("n"), F.sum("pos").cast("long").alias("n_pres"), (F.sum(F.abs(F.col("sum_p") - F.col("pos"))) / F.sum("n")).alias("ece"), F.max("bad").alias("bad")
    )
    return out.where("n_pres > 0 and n_pres < n")


def per_group(scored: DataFrame, keys: Sequence[str] = ("species",)) -> DataFrame:
    """All metrics, n, n_pres and prevalence of every group with both classes: Brier scores from the rows, the rest from one collapse of them."""
    keys = list(keys)
    rows = _collapsed(scored, keys)
    base = _calibration(rows, keys)
    for part in (_ranking(rows, keys), _boyce(rows, keys), brier(scored, keys)):
        base = base.join(part, keys, "left")
    ok = F.col("bad") == 0
    return base.select(*keys, "n", "n_pres", (F.col("n_pres") / F.col("n")).alias("prevalence"), *(F.when(ok, F.col(m)).otherwise(F.lit(NAN)).alias(m) for m in METRICS))


def swept(scored: DataFrame, full: str | float) -> DataFrame:
    """Metrics of each species, rate and scheme (uniform or absence) of a sweep, all in one job.

    At the rate `full` every entry is masked under both schemes: absence is not scored there but takes the metrics of uniform.
    """
    keys = ["species", "rate", "scheme"]
    whole = F.col("rate") == full
    out = per_group(scored.where(~(whole & (F.col("scheme") == "absence"))), keys)
    schemes = F.when(whole & (F.col("scheme") == "uniform"), F.array(F.lit("uniform"), F.lit("absence"))).otherwise(F.array("scheme"))
    return out.withColumn("scheme", F.explode(schemes))


def summary(metrics: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Means over finite values, quartiles of auroc, and how many species have which."""
    finite = lambda m: F.when(~missing(F.col(m)), F.col(m))
    quartile = lambda q, n: F.percentile(finite("auroc"), F.lit(q)).alias(n)
    count = lambda m, n: F.sum(missing(F.col(m)).cast("long")).alias(n)
    return metrics.groupBy(*keys).agg(*(F.avg(finite(m)).alias(f"mean_{m}") for m in METRICS), quartile(0.25, "auroc_q25"), quartile(0.5, "auroc_q50"), quartile(0.75, "auroc_q75"), F.count(finite("auroc")).alias("n_species"), count("auroc", "n_na_auc"), count("cbi", "n_na_cbi"))


def accuracy(scored: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return scored.groupBy(*keys).agg(F.avg(((F.col("p") > 0.5).cast("int") == F.col("y")).cast("double")).alias("accuracy"))


def _bce(z: Column, y: Column) -> Column:
    return F.greatest(z, F.lit(0.0)) - z * y + F.log1p(F.exp(-F.abs(z)))


def bce(rows: DataFrame, keys: Sequence[str] = (), weight: Column | None = None) -> DataFrame:
    """Mean binary cross-entropy of logits z; weighted: by the sum of weights."""
    w = F.lit(1.0) if weight is None else weight
    return rows.groupBy(*keys).agg((F.sum(w * _bce(F.col("z"), F.col("y"))) / F.sum(w)).alias("bce"))


def focal_loss(rows: DataFrame, keys: Sequence[str] = (), alpha: float = 0.25, gamma: float = 2.0, weight: Column | None = None) -> DataFrame:
    """Sigmoid focal loss; an alpha outside [0, 1] switches the class weight off."""
    z, y = F.col("z"), F.col("y")
    p = 1 / (1 + F.exp(-z))
    pt = p * y + (1 - p) * (1 - y)
    loss = _bce(z, y) * F.pow(1 - pt, gamma)
    if 0 <= alpha <= 1:
        loss = loss * (alpha * y + (1 - alpha) * (1 - y))
    w = F.lit(1.0) if weight is None else weight
    return rows.groupBy(*keys).agg((F.sum(w * loss) / F.sum(w)).alias("focal"))


def bagged(scored: DataFrame, keys: Sequence[str] = ("species", "site_id")) -> DataFrame:
    """Mean prediction over the passes of each key, and that of the first pass alone (p_single)."""
    return scored.groupBy(*keys).agg(F.avg("p").alias("p"), F.max(F.when(F.col("pass") == 0, F.col("p"))).alias("p_single"), F.max("y").alias("y"), F.count("*").alias("n_passes"))


def macro(metrics: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Means over mask rates: of auroc and auprc one NaN spoils the mean, of cbi it is left out."""
    return metrics.groupBy(*keys).agg(F.avg("auroc").alias("auroc"), F.avg("auprc").alias("auprc"), F.avg(F.when(~missing(F.col("cbi")), F.col("cbi"))).alias("cbi"))


def best_epoch(log: DataFrame, metric: str) -> DataFrame:
    """The epoch of the largest finite metric, the first of equals."""
    ranked = log.where(~missing(F.col(metric)))
    return ranked.agg(F.max_by("epoch", F.struct(F.col(metric), -F.col("epoch"))).alias("epoch"), F.max(metric).alias(metric))


def regularisation_summary(rows: DataFrame) -> DataFrame:
    """rows(reg, species, auroc_val, cbi_val, auroc_train) -> per reg means and gap, the chosen ones and whether it is at the grid's edge.

    Of equally good ones the smallest is chosen.
    """
    finite = lambda c: F.when(~missing(F.col(c)), F.col(c))
    by = rows.groupBy("reg").agg(F.avg(finite("auroc_val")).alias("auroc"), F.avg(finite("cbi_val")).alias("cbi"), F.avg(F.abs(finite("auroc_val") - finite("auroc_train"))).alias("gap"))
    known = lambda c, tie: F.when(F.col(c).isNotNull(), F.struct(F.col(c), tie))
    pick = by.agg(F.max_by("reg", known("auroc", -F.col("reg"))).alias("best_auroc"), F.max_by("reg", known("cbi", -F.col("reg"))).alias("best_cbi"), F.min_by("reg", known("gap", F.col("reg"))).alias("best_gap"), F.min("reg").alias("lo"), F.max("reg").alias("hi"))
    return by.crossJoin(F.broadcast(pick)).withColumn("at_edge", F.col("best_auroc").isin(F.col("lo"), F.col("hi"))).drop("lo", "hi")


def convergence(rows: DataFrame) -> DataFrame:
    """rows(cov_set, converged) -> how many fits of each set did and did not converge."""
    return rows.groupBy("cov_set").pivot("converged", [False, True]).count().select("cov_set", F.coalesce("false", F.lit(0)).alias("n_failed"), F.coalesce("true", F.lit(0)).alias("n_converged"))


def masked_per_species(masks: DataFrame) -> DataFrame:
    return masks.where("masked").groupBy("species").count().agg(F.avg("count").alias("mean_masked"), F.count("*").alias("n_species"))


def wide_report(metrics: DataFrame, rates: Sequence[str], value: str = "auroc") -> DataFrame:
    """A row per species, a column per mask rate, and the mean of the finite ones."""
    wide = metrics.groupBy("species").pivot("rate", list(rates)).agg(F.first(value))
    cols = [F.col(f"`{r}`") for r in rates]
    n = sum((F.when(~missing(c), 1).otherwise(0) for c in cols), F.lit(0))
    total = sum((F.when(~missing(c), c).otherwise(0.0) for c in cols), F.lit(0.0))
    return wide.select("species", *(c.alias(f"auc_p{r}") for c, r in zip(cols, rates, strict=True)), F.when(n > 0, total / n).alias("auc_mean")).orderBy("species")
