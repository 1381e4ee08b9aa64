"""Metrics against brute force, with ties, one-class groups, missing predictions and bin edges."""

import math
import random

import pytest

from wildgrid.operators import metrics


def brute(rows):
    pos, neg = [p for y, p in rows if y], [p for y, p in rows if not y]
    auroc = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))
    ap = 0.0
    for t in sorted(set(pos), reverse=True):
        tp, k = sum(p >= t for p in pos), sum(p >= t for _, p in rows)
        ap += sum(p == t for p in pos) * tp / k
    bins = {}
    for y, p in rows:
        bins.setdefault(max(0, min(14, math.floor(p * 15))), []).append((y, p))
    ece = sum(abs(sum(y for y, _ in b) - sum(p for _, p in b)) for b in bins.values()) / len(rows)
    return auroc, ap / len(pos), ece, sum((p - y) ** 2 for y, p in rows) / len(rows)


def boyce(rows):
    pos, neg = [p for y, p in rows if y], [p for y, p in rows if not y]
    out = []
    for k in range(101):
        c = k / 100.0
        a, b = (sum(c - 0.05 <= p <= c + 0.05 for p in x) for x in (pos, neg))
        if b >= 10:
            out.append((c, (a / len(pos)) / (b / len(neg))))
    if len(out) < 3 or len({r for _, r in out}) < 2:
        return float("nan")
    rank = lambda v, all_: sum(x < v for x in all_) + (sum(x == v for x in all_) + 1) / 2
    x, y = ([rank(o[i], [q[i] for q in out]) for o in out] for i in (0, 1))
    mx, my = sum(x) / len(x), sum(y) / len(y)
    return sum((a - mx) * (b - my) for a, b in zip(x, y)) / math.sqrt(sum((a - mx) ** 2 for a in x) * sum((b - my) ** 2 for b in y))


@pytest.fixture(scope="module")
def groups():
    rnd = random.Random(3)
    out = {"ties": [(rnd.random() < p, p) for p in (rnd.randint(0, 10) / 10 for _ in range(150))], "fine": [(rnd.random() < p, p) for p in (rnd.random() for _ in range(300))]}
    out["edges"] = [(i % 3 == 0, i / 15) for i in range(16)] * 4
    return {k: [(int(y), p) for y, p in v] for k, v in out.items()}


def test_against_brute_force(spark, groups):
    rows = [(g, y, p) for g, v in groups.items() for y, p in v] + [("one class", 1, 0.3)] * 5 + [("bad", 1, float("nan")), ("bad", 0, 0.2)]
    out = {r.species: r for r in metrics.per_group(spark.createDataFrame(rows, "species string, y int, p double")).collect()}
    assert set(out) == {*groups, "bad"}
    assert math.isnan(out["bad"].auroc) and math.isnan(out["bad"].brier)
    for g, v in groups.items():
        auroc, ap, ece, brier = brute(v)
        assert out[g].auroc == pytest.approx(auroc) and out[g].auprc == pytest.approx(ap)
        assert out[g].ece == pytest.approx(ece) and out[g].brier == pytest.approx(brier)
        want = boyce(v)
        assert (math.isnan(want) and math.isnan(out[g].cbi)) or out[g].cbi == pytest.approx(want)


def test_properties(spark, groups):
    df = spark.createDataFrame([("fine", y, p) for y, p in groups["fine"]], "species string, y int, p double")
    a = metrics.ranking(df, ["species"]).first().auroc
    squeezed = metrics.ranking(df.withColumn("p", df.p * df.p / 2), ["species"]).first().auroc
    turned = metrics.ranking(df.withColumn("p", 1 - df.p), ["species"]).first().auroc
    assert squeezed == pytest.approx(a) and turned == pytest.approx(1 - a)
    one = df.selectExpr("species", "1 as site_id", "y", "p", "0 as pass").withColumn("site_id", df.p)
    assert metrics.bagged(one).where("abs(p - p_single) > 1e-12").count() == 0


def test_best_epoch_takes_the_first_of_equals(spark):
    log = spark.createDataFrame([(1, 0.5), (2, 0.7), (3, 0.7), (4, float("nan"))], "epoch int, auc double")
    assert metrics.best_epoch(log, "auc").first().epoch == 2


def test_one_group_with_many_distinct_predictions(spark):
    """Crowded near 0 and beyond 0 and 1; the ranges keep the order, and few of them hold much."""
    import numpy as np
    from pyspark.sql import functions as F

    rnd = np.random.default_rng(5)
    p = np.concatenate([rnd.beta(0.05, 5, 15_000), rnd.random(5_000), [0.0, 1.0, -0.5, 1.5] * 5])
    y = (rnd.random(len(p)) < np.clip(p, 0.01, 1)).astype(int)
    df = spark.createDataFrame([("a", int(b), float(a)) for a, b in zip(p, y)], "species string, y int, p double")
    row = metrics.ranking(df, ["species"]).first()
    order = np.argsort(-p, kind="stable")
    tp, k = np.cumsum(y[order]), np.arange(1, len(p) + 1)
    last = np.concatenate([p[order][1:] != p[order][:-1], [True]])  # ties count up to their end
    at = np.searchsorted(np.flatnonzero(last), np.arange(len(p)))
    ends = np.flatnonzero(last)[at]
    assert row.auprc == pytest.approx((y[order] * tp[ends] / k[ends]).sum() / y.sum())
    neg, pos = np.sort(p[y == 0]), p[y == 1]
    assert row.auroc == pytest.approx((np.searchsorted(neg, pos, "left") + np.searchsorted(neg, pos, "right")).sum() / 2 / len(neg) / len(pos))
    sizes = df.select(metrics._range_of(F.col("p")).alias("r")).groupBy("r").count().agg(F.max("count"), F.count("*")).first()
    assert sizes[0] < 0.3 * len(p) and sizes[1] > 500
