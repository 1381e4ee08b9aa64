"""Places, splits, masks and sampling against brute force and their invariants."""

import math
import random

import pytest
from pyspark.sql import functions as F

from wildgrid.functions.expr import composite_start
from wildgrid.operators import geo, masking, models, neighbours, splits
from wildgrid.operators.prepare import imputed, rate_draw, refuse_missing
from wildgrid.plans.fixtures import scratch
from wildgrid.sources import sinks
from wildgrid.sources.readers import ColumnRoles


def km(a, b):
    p, q = map(math.radians, (a[0], b[0]))
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 2 * 6371.0 * math.asin(min(1.0, math.sqrt(h)))


@pytest.fixture(scope="module")
def places():
    rnd = random.Random(5)
    return [(i, rnd.uniform(20, 60), rnd.uniform(-140, -60), float(rnd.randint(0, 300))) for i in range(120)]


@pytest.fixture(scope="module")
def sites(spark, places):
    return spark.createDataFrame(places, "site_id long, latitude double, longitude double, t_days double")


def test_composite_start(spark):
    for r in spark.range(1, 367).select("id", composite_start(F.col("id")).alias("s")).collect():
        assert r.s == min(range(1, 354, 16), key=lambda d: (abs(d - r.id), d))


def test_longest_distance(sites, places):
    want = max(km(a[1:3], b[1:3]) for a in places for b in places)
    assert geo.longest_distance(sites).first().d_max == pytest.approx(want)


def test_longest_distance_looks_at_few_pairs(spark):
    import numpy as np

    rnd = np.random.default_rng(9)
    for low, high in (((-60, -170), (60, 170)), ((30, -120), (50, -80))):
        at = rnd.uniform(low, high, (1500, 2))
        rows = [(float(y), float(x)) for y, x in at] + [(None, 1.0), (1.0, float("nan"))]
        got = geo.longest_distance(spark.createDataFrame(rows, "latitude double, longitude double")).first()
        y, x = np.radians(at[:, 0]), np.radians(at[:, 1])
        h = np.sin((y[:, None] - y[None]) / 2) ** 2 + np.cos(y[:, None]) * np.cos(y[None]) * np.sin((x[:, None] - x[None]) / 2) ** 2
        assert got.d_max == pytest.approx(2 * 6371 * np.arcsin(np.sqrt(h.max()))) and got.compared < 0.01 * 1500**2
    one = spark.createDataFrame([(1.0, 2.0)] * 3, "latitude double, longitude double")
    assert geo.longest_distance(one).first().d_max == 1.0 and geo.longest_distance(one.limit(0)).first().d_max == 1.0


def test_nearest_fill(spark, sites, places):
    targets = spark.createDataFrame([(i, 15.0 + i * 2.3, -150.0 + i * 4.1) for i in range(20)], "id long, latitude double, longitude double")
    out = {r.id: r.v for r in geo.nearest_fill(targets, sites.withColumn("v", F.col("t_days")), "id", "v").collect()}
    for i in range(20):
        y, x = 15.0 + i * 2.3, -150.0 + i * 4.1
        assert out[i] == min((round(math.hypot(p[1] - y, p[2] - x), 9), p[3]) for p in places)[1]


def test_nearest_fill_at_the_edge_of_a_cell_and_far_away(spark):
    points = [(0.0, 2.05, 1.0), (1.55, 0.0, 2.0), (90.0, 90.0, 3.0)]
    known = spark.createDataFrame(points, "latitude double, longitude double, v double")
    targets = spark.createDataFrame([(1, 0.0, 0.0), (2, -80.0, -170.0), (3, 89.0, 90.0)], "id long, latitude double, longitude double")
    got = {r.id: r.v for r in geo.nearest_fill(targets, known, "id", "v").collect()}
    assert got == {1: 2.0, 2: 2.0, 3: 3.0}
    assert {r.v for r in geo.nearest_fill(targets, known.limit(0), "id", "v").collect()} == {None}


def test_nearest_fill_far_from_a_dense_set(spark):
    """Targets a continent away from all points, points at one place, and rows that are missing something."""
    import numpy as np

    rnd = np.random.default_rng(2)
    points = np.vstack([rnd.uniform(0, 8, (4000, 2)), np.repeat([[5.0, 5.0]], 300, axis=0), np.round(rnd.uniform(0, 8, (500, 2)))])
    values = rnd.integers(0, 50, len(points)).astype(float)
    far = np.vstack([rnd.uniform(-60, -50, (300, 2)), rnd.uniform(0, 8, (100, 2)), [[4.5, 4.5], [5.0, 5.0]]])
    rows = [(float(y), float(x), float(v)) for (y, x), v in zip(points, values)] + [(-60.0, -60.0, None), (-60.0, -60.0, float("nan")), (None, 1.0, 1.0), (1.0, float("nan"), 1.0)]
    known = spark.createDataFrame(rows, "latitude double, longitude double, v double")
    targets = spark.createDataFrame([(i, float(y), float(x)) for i, (y, x) in enumerate(far)] + [(9001, None, 0.0), (9002, 0.0, float("nan"))], "id long, latitude double, longitude double")
    got = {r.id: r.v for r in geo.nearest_fill(targets, known, "id", "v").collect()}
    d = np.round(np.hypot(far[:, None, 0] - points[None, :, 0], far[:, None, 1] - points[None, :, 1]), 9)
    want = {i: min(values[row == row.min()]) for i, row in enumerate(d)}
    assert got == {**want, 9001: None, 9002: None}


def test_numbered_is_the_stated_order(spark):
    from wildgrid.operators.prepare import numbered

    rnd = random.Random(12)
    rows = [(rnd.choice([None, 1, 1, 1, 2, 5]), rnd.randint(0, 50), i) for i in range(500)] + [(1, 7, 7)] * 400
    out = sorted(numbered(spark.createDataFrame(rows, "part int, before int, count int").repartition(7), "part", "before").collect(), key=lambda r: r.row_index)
    assert [r.row_index for r in out] == list(range(900))
    key = lambda r: (r[0] is not None, r[0] or 0, r[1])
    assert [key(r) for r in out] == sorted(map(key, rows)) and sorted(map(str, [tuple(r)[:3] for r in out])) == sorted(map(str, rows))
    assert numbered(spark.createDataFrame([], "a int"), "a").count() == 0


def test_cooccurrence_over_several_chunks(spark, monkeypatch):
    from wildgrid.operators import prepare

    monkeypatch.setattr(prepare, "CHUNK", 128)
    rnd = random.Random(13)
    rows = sorted({(rnd.randrange(900), f"s{int(rnd.random() ** 2 * 9)}") for _ in range(3000)})
    presence = spark.createDataFrame(rows, "site_id long, species string")
    got = {(r.species_a, r.species_b): r.n_ab for r in prepare.cooccurrence(presence, presence.select("site_id").distinct()).collect()}
    by = {}
    for site, species in rows:
        by.setdefault(species, set()).add(site)
    assert got == {(a, b): len(by[a] & by[b]) for a in by for b in by if a < b and by[a] & by[b]}


def test_imputed_takes_nan_as_missing(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (0.0,), (None,), (3.0,)], "x double")
    assert sorted(r.x for r in imputed(df, "x").collect()) == [1.0, 2.0, 2.0, 2.0, 3.0]


def test_polygons(spark):
    square = [("s", 0.0, 0.0, 2.0, 0.0), ("s", 2.0, 0.0, 2.0, 2.0), ("s", 2.0, 2.0, 0.0, 2.0), ("s", 0.0, 2.0, 0.0, 0.0)]
    edges = spark.createDataFrame(square, "poly string, x1 double, y1 double, x2 double, y2 double")
    points = [(1, 1.0, 1.0), (2, 3.0, 1.0), (3, 0.0, 0.0), (4, 2.0, 2.0), (5, 1.0, 2.0)]
    got = {r.id for r in geo.inside(spark.createDataFrame(points, "id long, latitude double, longitude double"), edges, "id").collect()}
    assert got == {1, 3}


@pytest.mark.parametrize("band", [1.0, 0.25])
def test_polygons_equal_the_rule_by_brute_force(spark, band):
    rnd = random.Random(12)
    rings = {"stairs": [(0, 0), (6, 0), (6, 2), (4, 2), (4, 5), (9, 5), (9, 9), (0, 9)], "crossed": [(-5, -5), (5, 5), (5, -5), (-5, 5)]}
    rings["many"] = [((8 + 2 * (i % 2)) * math.cos(i / 100 * math.pi), (8 + 2 * (i % 2)) * math.sin(i / 100 * math.pi)) for i in range(200)]
    for k in range(4):
        rings[f"random{k}"] = [(rnd.choice((rnd.uniform(-9, 9), float(rnd.randrange(-9, 9)))), rnd.choice((rnd.uniform(-9, 9), float(rnd.randrange(-9, 9))))) for _ in range(12)]
    edges = [(n, *map(float, r[i]), *map(float, r[(i + 1) % len(r)])) for n, r in rings.items() for i in range(len(r))]
    at = [(rnd.uniform(-11, 11), rnd.uniform(-11, 11)) for _ in range(600)] + [(rnd.randrange(-44, 44) / 4, rnd.randrange(-44, 44) / 4) for _ in range(600)]
    at += [(float(y), float(x)) for r in rings.values() for x, y in r]
    want = set()
    for i, (y, x) in enumerate(at):
        for n in rings:
            if sum(min(b, d) <= y < max(b, d) and a + (y - b) / (d - b) * (c - a) > x for p, a, b, c, d in edges if p == n and b != d) % 2:
                want.add((i, n))
    points = spark.createDataFrame([*((i, *p) for i, p in enumerate(at)), (-1, None, 1.0), (-2, float("nan"), 1.0)], "id long, latitude double, longitude double")
    edges = spark.createDataFrame([*edges, ("stairs", None, 0.0, 1.0, 1.0)], "poly string, x1 double, y1 double, x2 double, y2 double")
    assert {(r.id, r.poly) for r in geo.inside(points, edges, "id", band).collect()} == want
    assert not geo.inside(points.limit(0), edges, "id", band).count() and not geo.inside(points, edges.limit(0), "id", band).count()


def test_inner_cells_meet_no_edge(spark):
    ring = [(40 * math.cos(i / 500 * math.pi), 40 * math.sin(i / 500 * math.pi)) for i in range(1000)]
    edges = spark.createDataFrame([("round", *ring[i], *ring[(i + 1) % 1000]) for i in range(1000)], "poly string, x1 double, y1 double, x2 double, y2 double")
    points = spark.range(4000).select("id", (F.rand(1) * 100 - 50).alias("latitude"), (F.rand(2) * 100 - 50).alias("longitude"))
    got = geo.edges_tested(points, edges, "id").first()
    assert got.points == 4000 and got.tested < 4000 * 2  # by rows alone a point meets some 20 edges, by the polygon 1,000
    with pytest.raises(ValueError):
        geo.inside(points, edges, "id", 0.3)


def test_grid_has_both_ends(spark):
    rows = geo.grid(spark, (0.0, 1.0), (10.0, 10.3), 0.1).collect()
    assert len(rows) == 11 * 4 and max(r.latitude for r in rows) == pytest.approx(1.0)


@pytest.mark.parametrize("rule", ["test_first", "train_first"])
def test_block_split(sites, rule):
    out = splits.block_split(splits.degree_cells(sites), rule=rule).collect()
    assert len(out) == 120 and len({(r.cell, r.split) for r in out}) == len({r.cell for r in out})
    assert {r.split for r in out} == {"train", "val", "test"}


def test_random_split_sizes(sites):
    n = {r.split: r["count"] for r in splits.random_split(sites, 0.7, 0.2).groupBy("split").count().collect()}
    assert n == {"train": 84, "test": 24, "val": 12}
    with pytest.raises(ValueError):
        splits.random_split(sites, 0.9, 0.3)


def test_masks_do_not_depend_on_partitions(spark, sites):
    presence = sites.select("site_id", F.explode(F.array(F.lit("a"), F.lit("b"))).alias("species")).where("site_id % 3 = 0 or species = 'a'")
    rows = masking.entries(sites, presence)
    a = sorted(map(tuple, masking.masked(rows, 0.05, "x").collect()))
    b = sorted(map(tuple, masking.masked(rows.repartition(7), 0.05, "x").collect()))
    assert a == b
    assert {r[0] for r in a if r[3]} == set(range(120))
    assert all((r[4] == 2) == r[3] and (r[5] is None) != r[3] for r in a)


def test_draws_of_many_texts_are_md5(spark):
    """Whatever the lengths of prefix and name, over one block or several."""
    import hashlib

    from wildgrid.functions.digests import heads

    prefixes = [b"", b"k1|7|", b"k1|1234567|", b"k1|7654321|", b"p" * 50 + b"|", b"q" * 119, "h\u00f6he|".encode()]
    names = [b"", b"a", b"blue anvil", "Gr\u00fcner".encode(), b"x" * 44, b"x" * 45, b"y" * 130]
    got = heads(prefixes, names)
    assert [[f"{u:08x}" for u in r] for r in got.tolist()] == [[hashlib.md5(p + n).hexdigest()[:8] for n in names] for p in prefixes]


def test_masks_follow_their_rule_in_lists_of_any_kind(spark):
    """Sites with lists of their own, rates by site, absences and ties of nothing masked, against the rule entry by entry; a rate of 1 needs no draw."""
    import hashlib

    rnd = random.Random(4)
    rows = [(s, sp, rnd.randint(0, 1)) for s in range(60) for sp in ("b", "a", "\u00e9", "c c", "d")[: 1 + s % 5]]
    df, draw = spark.createDataFrame(rows, "site_id long, species string, present int"), lambda *k: int(hashlib.md5("|".join(k).encode()).hexdigest()[:8], 16) / 2**32

    def want(rate, *salt, absences=False):
        out = {}
        for s in range(60):
            u = {sp: (draw(*salt, str(s), sp), p) for t, sp, p in rows if t == s}
            hit = {sp for sp, (x, p) in u.items() if x < rate(s) or (absences and p == 0)} or {min(u, key=lambda sp: (u[sp][0], sp))}
            out |= {(s, sp): sp in hit for sp in u}
        return out

    for absences in (False, True):
        by_site = masking.masked(df.repartition(3), F.when(F.col("site_id") % 2 == 0, 0.3).otherwise(0.0), "z", absences=absences)
        assert {(r.site_id, r.species): r.masked for r in by_site.collect()} == want(lambda s: 0.3 if s % 2 == 0 else 0.0, "z", absences=absences)
    many = masking.mask_set(df, (0.1, 1.0), "z").collect()
    for rate in (0.1, 1.0):
        assert {(r.site_id, r.species): r.masked for r in many if r.rate == rate} == want(lambda s: rate, "z", str(rate))
    assert len(many) == 2 * len(rows)
    plan = masking.mask_set(masking.states(df, df.where("present = 1")), (0.1, 0.2, 0.3, 1.0), "z")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "md5" not in plan  # one pass for all rates, and no draw entry by entry


def test_sources(sites):
    out = neighbours.sources(sites, sites, 6, "s").collect()
    by = {}
    for r in out:
        assert r.target_id != r.source_id
        by.setdefault(r.target_id, []).append(r.source_id)
    assert all(len(v) == 6 == len(set(v)) for v in by.values()) and len(by) == 120
    few = neighbours.sources(sites, sites.where("site_id < 4"), 6, "s").collect()
    assert all(r.source_id < 4 for r in few) and len(few) == 6 * 120


SITE = "site_id long, latitude double, longitude double, t_days double"


def test_nearer_sites_are_drawn_more_often(spark):
    pool = spark.createDataFrame([(1, 0.0, 1.0, 0.0), (2, 0.0, 4.0, 0.0)], SITE)
    here = spark.range(100, 1100).select(F.col("id").alias("site_id"), F.lit(0.0).alias("latitude"), F.lit(0.0).alias("longitude"), F.lit(0.0).alias("t_days"))
    drawn = neighbours.tree.sampled(neighbours.tree.Tree(pool), neighbours._targets(here), 1, "s", False)
    assert 750 <= drawn.where("source_id = 1").count() <= 850  # four times as likely


def spots_and_weights(rnd, with_time):
    """Sites at, near and far from (40, -100) on day 100, and many at one place; their weights for scales of 200 km and 30 days."""
    import numpy as np

    spots = [(40.0 + rnd.normal() * s, -100.0 + rnd.normal() * s, float(rnd.integers(0, 200))) for s in (0.05, 1.0, 20.0) for _ in range(25)]
    spots += [(40.0, -100.0, 100.0)] * 2 + [(41.0, -101.0, 50.0)] * 40
    d = np.array([km((40.0, -100.0), s[:2]) for s in spots]) / 200
    return spots, 1 / ((np.hypot(d, [abs(s[2] - 100) / 30 for s in spots]) if with_time else d) + 1e-6)


def same_place(spark, n):
    scaled = (F.lit(40.0).alias("t_lat"), F.lit(-100.0).alias("t_lon"), F.lit(100.0).alias("t_t"), F.lit(200.0).alias("d_scale"), F.lit(30.0).alias("t_scale"))
    return spark.range(1000, 1000 + n).select(F.col("id").cast("string").alias("key"), F.col("id").alias("target_id"), *scaled)


@pytest.mark.parametrize("with_time", [False, True])
def test_sources_follow_the_law(spark, with_time):
    import numpy as np

    rnd, n, targets = np.random.default_rng(3), 4, 1500
    spots, w = spots_and_weights(rnd, with_time)
    pool = spark.createDataFrame([(i, float(y), float(x), t) for i, (y, x, t) in enumerate(spots)], SITE)
    rows = neighbours.tree.sampled(neighbours.tree.Tree(pool), same_place(spark, targets), n, "s", with_time).collect()
    assert len(rows) == n * targets and len({(r.target_id, r.source_id) for r in rows}) == n * targets and {r.slot for r in rows} == {1, 2, 3, 4}
    keys = -np.log(rnd.random((20_000, len(w)))) / w
    share = np.bincount(np.argsort(keys, axis=1)[:, :n].ravel(), minlength=len(w)) / 20_000
    got = np.bincount([r.source_id for r in rows], minlength=len(w)) / targets
    assert np.abs(got - share).max() < 5 * np.sqrt(0.25 / targets) and (((got - share) ** 2) / (share * (1 - share) * (1 / targets + 1 / 20_000) + 1e-9))[(share > 0.002) & (share < 0.999)].mean() < 1.5
    assert all(r.weight == pytest.approx(w[r.source_id]) for r in rows[:50])


def test_draws_with_replacement_follow_the_law(spark):
    import numpy as np

    rnd, n, targets = np.random.default_rng(4), 5, 600
    spots, w = spots_and_weights(rnd, True)
    pool = spark.createDataFrame([(i, float(y), float(x), t) for i, (y, x, t) in enumerate(spots)], SITE)
    rows = neighbours.with_replacement(neighbours.tree.Tree(pool), same_place(spark, targets), n, "r").collect()
    assert sorted((r.target_id, r.slot) for r in rows) == [(1000 + i, k) for i in range(targets) for k in range(1, n + 1)]
    share, got = w / w.sum(), np.bincount([r.source_id for r in rows], minlength=len(w)) / (n * targets)
    assert np.abs(got - share).max() < 5 * np.sqrt(0.25 / (n * targets)) and (((got - share) ** 2) / (share * (1 - share) / (n * targets) + 1e-12)).mean() < 1.8


def test_a_deep_tree_gives_what_all_pairs_give(spark):
    """Sites at one place and day, an id that repeats and sites that are missing something: keys found by pruning are those of a full look."""
    rnd = random.Random(6)
    rows = [(i, 10.0, 20.0, 5.0) for i in range(60)] + [(100 + i, rnd.uniform(-80, 80), rnd.choice([-179.9, 179.9, 0.0]), float(i)) for i in range(60)]
    rows += [(7, 10.0, 20.0, 5.0)] * 30 + [(900, None, 0.0, 0.0), (901, float("nan"), 0.0, 0.0), (902, 0.0, None, 0.0), (903, 0.0, 0.0, None)]
    pool = spark.createDataFrame(rows, SITE)
    over = neighbours.tree.Tree(pool)
    assert over.size == 120
    here = neighbours._targets(pool.dropDuplicates())
    some, every = ({(r.target_id, r.slot, r.source_id) for r in neighbours.tree.sampled(over, here, n, "s", True).collect()} for n in (5, 1000))
    assert some == {x for x in every if x[1] <= 5} and len(every) == 120 * 119 and len(some) == 120 * 5


def test_passes_share_a_tree(sites):
    over = neighbours.tree.Tree(sites)
    one, other = (sorted(map(tuple, neighbours.sources(sites, pool, 6, "s").select("target_id", "slot", "source_id").collect())) for pool in (sites, over))
    assert one == other and len(one) == 6 * 120


def test_draws_of_pairs_are_heads_of_md5():
    import hashlib

    import numpy as np

    from wildgrid.functions.digests import pair_heads

    lefts, rights = np.array([b"7", b"a longer key|3", "\u00e9".encode(), b"x" * 70]), np.array([b"", b"0a", b"f" * 20])
    i, j = (x.ravel() for x in np.meshgrid(np.arange(4), np.arange(3)))
    want = [int(hashlib.md5(b"s#1#e|" + lefts[a] + b"|" + rights[b]).hexdigest()[:8], 16) for a, b in zip(i, j)]
    assert pair_heads(b"s#1#e", lefts, rights, i, j).tolist() == want


@pytest.mark.parametrize("with_time", [False, True])
def test_levels_below_the_top_give_the_same_sources(spark, monkeypatch, with_time):
    """Nodes are looked at in the tasks, without a sort of them for each level, whether every task has them or they are joined."""
    rnd = random.Random(8)
    pool = spark.createDataFrame([(i, rnd.uniform(24, 50), rnd.uniform(-125, -66), float(i % 365)) for i in range(2000)] + [(3000 + i, 40.0, -100.0, 5.0) for i in range(300)], SITE)
    here = neighbours._targets(pool.where("site_id % 20 = 0 or site_id > 3290"))
    got = {}
    for top in (1, 200, 1 << 16):
        monkeypatch.setattr(neighbours.tree, "TOP", top)
        over = neighbours.tree.Tree(pool)
        drawn = neighbours.tree.sampled(over, here, 6, "s", with_time)
        plan = drawn._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Window [") == 2 and plan.count("md5") <= 2 and plan.count("MapInArrow") == 1 + over.depth - over.top()[0]
        got[top] = sorted(map(tuple, drawn.select("key", "slot", "source_id").collect()))
        assert top > 1 or over.top()[0] == 1
    assert got[1] == got[200] == got[1 << 16] and len(got[1]) == 6 * here.count()


def test_sources_of_an_empty_pool(spark, sites):
    assert neighbours.sources(sites, sites.limit(0), 3, "s").count() == 0 and neighbours.sources(sites.limit(0), sites, 3, "s").count() == 0


def test_missing_stays_missing(spark):
    from wildgrid.functions.expr import cell_index, haversine_km, logit, tile_pixel
    from wildgrid.operators.metrics import bin_of, ece

    nan = float("nan")
    df = spark.createDataFrame([(0.0, 0.0, 0.5), (None, 0.0, None), (nan, 0.0, nan), (0.0, 180.0, 1.0)], "y double, x double, p double")
    zero = F.lit(0.0)
    out = [[None if v is None or v != v else v for v in r] for r in df.select(haversine_km(F.col("y"), F.col("x"), zero, zero), logit(F.col("p")), bin_of(F.col("p")), cell_index(F.col("y"), -90.0, 5.0, 37), *tile_pixel(F.col("y"), F.col("x")).values()).collect()]
    assert out[0][:4] == [0.0, 0.0, 7, 18] and out[3][0] == pytest.approx(math.pi * 6371) and out[3][2] == 14
    assert out[1][:4] == out[2][:4] == [None] * 4 and out[1][6:] == [None, None]
    scored = spark.createDataFrame([("a", 1.0, 1), ("a", None, 1), ("a", nan, 0)], "g string, p double, y int")
    assert [r.ece for r in ece(scored, ["g"]).collect()] == [0.0]


def test_logistic_fit(spark):
    import numpy as np

    rnd = np.random.default_rng(1)
    x = rnd.normal(size=(400, 2))
    y = (rnd.random(400) < 1 / (1 + np.exp(-(0.3 + x @ [1.0, -0.5])))).astype(int)
    rows = [("a", int(t), *map(float, v)) for t, v in zip(y, x)] + [("const", 1, 0.0, 0.0)] * 3
    fit = models.logistic_fits(spark.createDataFrame(rows, "g string, y int, u double, v double"), ["g"], ["u", "v"]).collect()
    assert [f.g for f in fit] == ["a"] and fit[0].converged
    z = fit[0].b0 + x @ [fit[0].b_u, fit[0].b_v]
    residual = y - 1 / (1 + np.exp(-z))
    assert abs(residual.sum()) < 1e-3 and np.abs(residual @ x).max() < 1e-3


def newton(x, y, ridge, steps=60):
    import numpy as np

    x = np.hstack([np.ones((len(x), 1)), x])
    penalty, b = np.r_[0.0, np.full(x.shape[1] - 1, ridge)], np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-x @ b))
        b = b + np.linalg.solve((x.T * (p * (1 - p))) @ x + np.diag(penalty), x.T @ (y - p) - penalty * b)
    return b


def test_many_fits_equal_direct_ones(spark):
    import numpy as np

    rnd, rows, names = np.random.default_rng(7), [], [f"f{i}" for i in range(5)]
    for g in range(6):
        x = rnd.normal(size=(300, 5))
        y = (rnd.random(300) < 1 / (1 + np.exp(-x @ rnd.normal(size=5)))).astype(int)
        rows += [(g, int(t), *map(float, v)) for t, v in zip(y, x)]
    more = [(0, 1, float("nan"), 0.0, 0.0, 0.0, 0.0), (1, 0, None, 0.0, 0.0, 0.0, 0.0), (9, 0, 0.0, 0.0, 0.0, 0.0, 0.0)]
    df = spark.createDataFrame(rows + more, "g int, y int, " + ", ".join(f"{n} double" for n in names)).repartition(5)
    fits = models.logistic_fits(df, ["g"], names, ridge=[0.5, 8.0]).collect()
    assert {(f.reg, f.g) for f in fits} == {(r, g) for r in (0.5, 8.0) for g in range(6)} and all(f.converged for f in fits)
    for f in fits:
        part = np.array([r for r in rows if r[0] == f.g])
        assert np.allclose([f.b0, *(f[f"b_{n}"] for n in names)], newton(part[:, 2:], part[:, 1], f.reg), atol=1e-6)


def test_smooth_designs_are_made_in_the_tasks(spark):
    """The same features and fits as columns would give, and what is written does not grow with the number of features."""
    import os

    import numpy as np

    rnd, centres = np.random.default_rng(11), [(float(a), float(b)) for a in range(10, 60, 5) for b in range(-150, -60, 10)]
    rows = [(int(g), int(rnd.random() < 0.3 + 0.1 * g), int(d), float(y), float(x)) for g, d, y, x in zip(rnd.integers(0, 3, 3000), rnd.integers(1, 366, 3000), rnd.uniform(8, 60, 3000), rnd.uniform(-160, -60, 3000))]
    rows += [(0, 1, None, 20.0, -100.0), (1, 0, 5, None, -100.0), (2, None, 5, 20.0, -100.0)]
    df = spark.createDataFrame(rows, "g int, y int, doy int, latitude double, longitude double")
    wide, seasons = models.seasonal_basis(df, "doy")
    wide, space = models.spatial_basis(wide, centres, 9.0)
    names, made = models.smooth_design(12, centres, 9.0)
    assert names == [*seasons, *space]
    want = np.array(wide.where("latitude is not null").select(*names).collect())
    given = np.array([[np.nan if v is None else v for v in r[2:]] for r in rows if r[3] is not None], dtype=float)
    assert np.allclose(made(given), want, atol=1e-12)
    scratch(spark, "none")  # the folder is named
    folder = spark.sparkContext.getCheckpointDir().removeprefix("file:")
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    a = {f.g: f for f in models.logistic_fits(df, ["g"], names, ridge=0.1, design=(["doy", "latitude", "longitude"], made)).collect()}
    new = [x for x in os.listdir(folder) if x not in before and x.startswith("pieces")]
    assert 0 < sum(os.path.getsize(os.path.join(folder, x, f)) for x in new for f in os.listdir(os.path.join(folder, x))) < 3003 * 60
    b = {f.g: f for f in models.logistic_fits(wide, ["g"], names, ridge=0.1).collect()}
    assert set(a) == set(b) == {0, 1, 2} and all(np.allclose([*a[g]][3:], [*b[g]][3:], atol=1e-6) for g in a)


def test_sets_of_features_share_the_passes(spark):
    """Each set leaves out the rows that lack one of its own features, and gives what a fit of its own gives."""
    import numpy as np

    rnd = np.random.default_rng(13)
    rows = [("ab"[i % 2], int(rnd.random() < 0.4), float(u), None if i % 3 == 0 else float(v)) for i, (u, v) in enumerate(rnd.normal(size=(600, 2)))]
    df, sets = spark.createDataFrame(rows + [("c", 1, 0.1, None), ("c", 0, 0.2, 0.3)], "g string, y int, u double, v double"), {"one": ["u"], "both": ["v", "u"]}
    for name, fits in models.logistic_sets(df, ["g"], sets, ridge=0.1).items():
        own = {f.g: f for f in models.logistic_fits(df, ["g"], sets[name], ridge=0.1).collect()}
        got = {f.g: f for f in fits.collect()}
        assert set(got) == set(own) == ({"a", "b", "c"} if name == "one" else {"a", "b"})
        assert fits.columns == ["g", "converged", "rounds", "b0", *(f"b_{f}" for f in sets[name])]
        assert all(np.allclose([*got[g]][3:], [*own[g]][3:]) and got[g].rounds == own[g].rounds for g in own)


def test_systems_without_a_solution_are_not_converged(spark):
    rows = [(g, i % 2, float(i % 2) * 50 if g == 0 else float(i % 5)) for g in (0, 1) for i in range(40)]
    fits = {f.g: f for f in models.logistic_fits(spark.createDataFrame(rows, "g int, y int, u double"), ["g"], ["u"], ridge=0.0, rounds=12).collect()}
    assert fits[1].converged and len(fits) == 2


def test_the_ridge_is_chosen_on_validation_rows(spark):
    import numpy as np

    rnd = np.random.default_rng(8)
    make = lambda n: [(s, int(rnd.random() < 1 / (1 + np.exp(-a))), float(a), float(b)) for s in "ab" for a, b in rnd.normal(size=(n, 2))]
    schema = "species string, y int, u double, v double"
    train, val = (spark.createDataFrame(make(n), schema) for n in (80, 200))
    df, names = models.quadratic(train, ["u", "v"])
    fits = models.chosen(df, models.quadratic(val, ["u", "v"])[0], spark.createDataFrame([("a",)], "species string"), names, grid=(1, 32)).collect()
    assert sorted(f.species for f in fits) == ["a", "b"] and len({f.reg for f in fits}) == 1 and fits[0].reg in (1.0, 32.0)


def test_temperature_of_calibrated_scores_is_one(spark):
    rows = [(p / 10, y) for p in range(1, 10) for y in [1] * p + [0] * (10 - p)]
    assert models.temperature(spark.createDataFrame(rows, "p double, y int")).first().temperature == pytest.approx(1.0)


def test_rate_specs(sites):
    for bad in ("beta:0,1", "unif:0.5,0.2", "1.5"):
        with pytest.raises(ValueError):
            rate_draw(bad, "s", F.col("site_id"))
    r = sites.select(rate_draw("unif:0.2,0.4", "s", F.col("site_id")).alias("u"), rate_draw("beta:2,2", "s", F.col("site_id")).alias("b")).collect()
    assert all(0.2 <= x.u < 0.4 and 0 <= x.b < 1 for x in r)


def test_wide_table_holds_species_as_bits(spark):
    """More species than a whole number has bits, records of others and sites without any; nothing is as wide as the species before the end."""
    species = [f"s'{i:03d}" for i in range(130)]
    rnd = random.Random(6)
    there = {(s, sp) for s in range(40) if s % 4 for sp in rnd.sample(species, 1 + s)} | {(1, species[0]), (1, species[62]), (1, species[63]), (1, species[125]), (1, species[126]), (1, species[129])}
    presence = spark.createDataFrame([*there, (2, "other"), (4, "other")], "site_id long, species string")
    sites = spark.range(40).select(F.col("id").alias("site_id"), F.lit(1.0).alias("latitude"))
    wide = sinks.wide_table(sites, sites.select("site_id", F.lit(2.0).alias("env_b"), F.lit(3.0).alias("env_a")), presence, species, ["env_b"])
    assert wide.columns == ["site_id", "latitude", "env_b", "env_a", *species]
    assert {(r.site_id, sp) for r in wide.collect() for sp in species if r[sp] == 1} == there
    assert "pivot" not in wide._jdf.queryExecution().optimizedPlan().toString().lower()
    assert sinks.wide_table(sites, sites.select("site_id"), presence, []).count() == 40


def test_refusals_and_roles(spark):
    with pytest.raises(ValueError, match="b"):
        refuse_missing(spark.createDataFrame([(1, float("nan"))], "a int, b double"))
    roles = ColumnRoles.of(["time", "latitude", "longitude", "env_x", "Danaus", "Papilio"])
    assert roles.env == ("env_x",) and roles.species == ("Danaus", "Papilio")
