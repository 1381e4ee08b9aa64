"""Queries of metrics, neighbour sampling and models."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ..operators import tree
from .lookups import _mask
from .registry import BLOCKS, CELLS, ENV, Views, _draw, _env, _km, _split, fourier, logit, masking, metrics, models, neighbours, number, prepare, query, scratch, sinks

HIST = "hist AS (SELECT species, model, p, CAST(sum(y) AS DOUBLE) AS pos, CAST(sum(1 - y) AS DOUBLE) AS neg FROM scored GROUP BY species, model, p), tot AS (SELECT species, model, sum(pos) AS np, sum(neg) AS nn FROM hist GROUP BY species, model HAVING sum(pos) > 0 AND sum(neg) > 0)"
RANK = """cum AS (SELECT h.*, np, nn, coalesce(sum(neg) OVER (PARTITION BY h.species, h.model ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below,
  sum(pos) OVER (PARTITION BY h.species, h.model ORDER BY p DESC) AS tp, sum(pos + neg) OVER (PARTITION BY h.species, h.model ORDER BY p DESC) AS k FROM hist h JOIN tot t ON h.species = t.species AND h.model = t.model),
ranked AS (SELECT species, model, sum(pos * (below + neg / 2)) / (any_value(np) * any_value(nn)) AS auroc, sum(pos * tp / k) / any_value(np) AS auprc FROM cum GROUP BY species, model)"""
CBI = """wins AS (SELECT species, model, c, sum(pos) AS pos, sum(neg) AS neg FROM hist, (SELECT CAST(unnest(range(0, 101)) AS DOUBLE) / 100 AS c) cs WHERE p >= c - CAST(0.05 AS DOUBLE) AND p <= c + CAST(0.05 AS DOUBLE) GROUP BY species, model, c HAVING sum(neg) >= 10),
ratios AS (SELECT w.species, w.model, c, (pos / np) / (neg / nn) AS ratio FROM wins w JOIN tot t ON w.species = t.species AND w.model = t.model),
ranks AS (SELECT *, rank() OVER (PARTITION BY species, model ORDER BY c) AS r1, rank() OVER (PARTITION BY species, model ORDER BY ratio) + (count(*) OVER (PARTITION BY species, model, ratio) - 1) / CAST(2 AS DOUBLE) AS r2 FROM ratios),
boyce AS (SELECT t.species, t.model, CASE WHEN n >= 3 AND d >= 2 THEN r ELSE CAST('nan' AS DOUBLE) END AS cbi FROM tot t LEFT JOIN (SELECT species, model, count(*) AS n, count(DISTINCT ratio) AS d, CASE WHEN count(*) >= 3 AND count(DISTINCT ratio) >= 2 THEN corr(r1, r2) END AS r FROM ranks GROUP BY species, model) b ON t.species = b.species AND t.model = b.model)"""
CAL = """bins AS (SELECT species, model, greatest(least(floor(p * 15), 14), 0) AS bin, count(*) AS n, avg(p) AS conf, avg(y) AS freq FROM scored GROUP BY ALL), ece AS (SELECT species, model, sum(n * abs(conf - freq)) / sum(n) AS ece FROM bins GROUP BY species, model),
brier AS (SELECT species, model, avg(pow(p - y, 2)) AS brier, count(*) AS n, sum(y) AS n_pres FROM scored GROUP BY species, model)"""
ALL = f"{HIST}, {RANK}, {CBI}, {CAL}, metrics AS (SELECT species, model, n, CAST(n_pres AS BIGINT) AS n_pres, n_pres / CAST(n AS DOUBLE) AS prevalence, auroc, auprc, cbi, brier, ece FROM ranked JOIN boyce USING (species, model) JOIN brier USING (species, model) JOIN ece USING (species, model))"
R = lambda *names: ", ".join(f"round({n}, 6) + 0.0 AS {n}" for n in names)
KEYS = ["species", "model"]


def _n(df, *names):
    return [number(F.col(n)).alias(n) for n in names]


@query("s01_auroc_auprc", f"SELECT species, model, {R('auroc', 'auprc')} FROM ranked", f"{HIST}, {RANK}")
def _(v: Views):
    out = metrics.ranking(v.scored, KEYS)
    return out.select(*KEYS, *_n(out, "auroc", "auprc"))


@query("s03_brier", f"SELECT species, model, {R('brier')} FROM brier", CAL)
def _(v):
    out = metrics.brier(v.scored, KEYS)
    return out.select(*KEYS, *_n(out, "brier"))


@query("s04_ece", f"SELECT species, model, {R('ece')} FROM ece", CAL)
def _(v):
    out = metrics.ece(v.scored, KEYS)
    return out.select(*KEYS, *_n(out, "ece"))


@query("s05_pooled_ece", "SELECT round(sum(n * abs(conf - freq)) / (SELECT count(*) FROM scored), 6) AS ece FROM (SELECT floor(p * 15) AS bin, count(*) AS n, avg(p) AS conf, avg(y) AS freq FROM scored WHERE p < 1 GROUP BY 1) b")
def _(v):
    return metrics.pooled_ece(v.scored).select(F.round("ece", 6).alias("ece"))


@query("s06_boyce", f"SELECT species, model, {R('cbi')} FROM boyce", f"{HIST}, {CBI}")
def _(v):
    return metrics.boyce(v.scored, KEYS).select(*KEYS, number(F.col("cbi")).alias("cbi"))


@query("s07_per_species", f"SELECT species, model, n, n_pres, {R('prevalence', 'auroc', 'auprc', 'cbi', 'brier', 'ece')} FROM metrics", ALL)
def _(v):
    return metrics.per_group(v.scored, KEYS).select(*KEYS, "n", "n_pres", *(number(F.col(c)).alias(c) for c in ("prevalence", *metrics.METRICS)))


@query("a13_metric_sink", f"SELECT species, model, n, n_pres, {R('auroc', 'auprc')} FROM metrics", ALL)
def _(v):
    path = scratch(v.spark, "metrics")
    sinks.write_metrics(metrics.per_group(v.scored, KEYS), path, ["model"])
    return v.spark.read.parquet(path).select(*KEYS, "n", "n_pres", *(number(F.col(c)).alias(c) for c in ("auroc", "auprc")))


SUMMARY = ", ".join(f"round(avg(CASE WHEN NOT isnan({m}) THEN {m} END), 6) + 0.0 AS mean_{m}" for m in ("auroc", "auprc", "cbi", "brier", "ece")) + ", " + ", ".join(f"round(quantile_cont(auroc, 0.{q}), 6) AS auroc_q{q}" for q in ("25", "50", "75")).replace("q50", "q50") + ", count(auroc) AS n_species, 0 AS n_na_auc, CAST(sum(CASE WHEN cbi IS NULL OR isnan(cbi) THEN 1 ELSE 0 END) AS BIGINT) AS n_na_cbi"


def _summary(df):
    floats = [c for c, t in df.dtypes if t == "double"]
    return df.select(*(number(F.col(c)).alias(c) if c in floats else c for c in df.columns))


@query("s08_summary", f"SELECT model, {SUMMARY} FROM metrics GROUP BY model", ALL)
def _(v):
    return _summary(metrics.summary(metrics.per_group(v.scored, KEYS), ["model"]))


RUN = "epochs AS (SELECT CAST(regexp_extract(line, 'Epoch (\\d+)', 1) AS INT) AS epoch, CAST(regexp_extract(line, 'AUC: ([\\d.]+)', 1) AS DOUBLE) AS auc FROM epoch_log)"


@query(
    "a13_run_sinks",
    "SELECT 'parameters' AS part, 'seed' AS key, '7' AS value UNION ALL SELECT 'parameters', 'rate', '0.5' UNION ALL SELECT 'epochs', CAST(epoch AS VARCHAR), CAST(CAST(round(auc * 1000000) AS BIGINT) AS VARCHAR) FROM epochs UNION ALL SELECT 'convergence', model, CAST(count(*) FILTER (p > 0.9) AS VARCHAR) FROM scored GROUP BY model UNION ALL SELECT 'summary', model, CAST(round(avg(auroc), 4) AS VARCHAR) FROM metrics GROUP BY model",
    f"{ALL}, {RUN}",
)
def _(v):
    from ..sources.readers import epoch_log

    path = scratch(v.spark, "run")
    fits = v.scored.select(F.col("model").alias("cov_set"), (F.col("p") > 0.9).alias("converged"))
    sinks.write_run(path, {"seed": 7, "rate": 0.5}, epochs=epoch_log(v.epoch_log), summary=metrics.summary(metrics.per_group(v.scored, KEYS), ["model"]), convergence=metrics.convergence(fits))
    read = lambda part, key, value: v.spark.read.parquet(f"{path}/{part}").select(F.lit(part).alias("part"), F.col(key).cast("string").alias("key"), value.cast("string").alias("value"))
    out = read("parameters", "name", F.col("value")).union(read("epochs", "epoch", F.round(F.col("auc") * 1000000).cast("long")))
    return out.union(read("convergence", "cov_set", F.col("n_converged"))).union(read("summary", "model", F.round("mean_auroc", 4)))


@query("s09_accuracy", "SELECT model, round(avg(CASE WHEN (p > 0.5) = (y = 1) THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM scored GROUP BY model")
def _(v):
    return metrics.accuracy(v.scored, ["model"]).select("model", F.round("accuracy", 6).alias("accuracy"))


LOGITS = "logits AS (SELECT species, model, y, ln(q / (1 - q)) AS z, q FROM (SELECT *, least(greatest(p, 1e-7), 1 - CAST(1e-7 AS DOUBLE)) AS q FROM scored) s)"
LOSS = "(greatest(z, 0) - z * y + ln(1 + exp(-abs(z))))"


@query("s10_bce", f"SELECT species, round(avg({LOSS}), 6) AS bce, round(sum((1 + y) * {LOSS}) / sum(1 + y), 6) AS weighted FROM logits GROUP BY species", LOGITS)
def _(v):
    rows = v.scored.withColumn("z", logit(F.col("p")))
    plain, heavy = metrics.bce(rows, ["species"]), metrics.bce(rows, ["species"], 1 + F.col("y")).withColumnRenamed("bce", "weighted")
    return plain.join(heavy, "species").select("species", F.round("bce", 6).alias("bce"), F.round("weighted", 6).alias("weighted"))


@query("s11_focal", f"SELECT species, round(avg({LOSS} * pow(1 - (q * y + (1 - q) * (1 - y)), 2) * (0.25 * y + 0.75 * (1 - y))), 6) AS focal FROM logits GROUP BY species", LOGITS)
def _(v):
    return metrics.focal_loss(v.scored.withColumn("z", logit(F.col("p"))), ["species"]).select("species", F.round("focal", 6).alias("focal"))


@query("s12_bagged", "SELECT species, site_id, round(avg(p), 6) AS p, round(max(CASE WHEN pass = 0 THEN p END), 6) AS p_single, max(y) AS y, count(*) AS n_passes FROM scored GROUP BY species, site_id")
def _(v):
    return metrics.bagged(v.scored).select("species", "site_id", F.round("p", 6).alias("p"), F.round("p_single", 6).alias("p_single"), "y", "n_passes")


SWEEP = ALL.replace("FROM scored", "FROM swept").replace("species, model", "species, rate, scheme").replace("h.model = t.model", "h.rate = t.rate AND h.scheme = t.scheme").replace("w.model = t.model", "w.rate = t.rate AND w.scheme = t.scheme").replace("t.model = b.model", "t.rate = b.rate AND t.scheme = b.scheme").replace("h.model", "h.rate, h.scheme").replace("w.species, w.model", "w.species, w.rate, w.scheme").replace("t.species, t.model", "t.species, t.rate, t.scheme").replace("h.species, rate, scheme", "h.species, h.rate, h.scheme").replace("w.species, rate, scheme", "w.species, w.rate, w.scheme").replace("t.species, rate, scheme", "t.species, t.rate, t.scheme").replace("w.rate, scheme", "w.rate, w.scheme").replace("t.rate, scheme", "t.rate, t.scheme")
SWEPT = "swept AS (SELECT species, y, p, CASE WHEN pass % 2 = 0 THEN '0.5' ELSE '1.0' END AS rate, CASE WHEN model = 'O' THEN 'uniform' ELSE 'absence' END AS scheme FROM scored)"


def _swept(v: Views):
    return v.scored.select("species", "y", "p", F.when(F.col("pass") % 2 == 0, "0.5").otherwise("1.0").alias("rate"), F.when(F.col("model") == "O", "uniform").otherwise("absence").alias("scheme"))


#: With every entry masked the schemes are the same, so absence takes the metrics of uniform there.
REUSED = "every AS (SELECT * FROM metrics WHERE NOT (rate = '1.0' AND scheme = 'absence') UNION ALL SELECT * REPLACE ('absence' AS scheme) FROM metrics WHERE rate = '1.0' AND scheme = 'uniform')"


@query("s13_sweep", f"SELECT rate, scheme, {SUMMARY} FROM every GROUP BY rate, scheme", f"{SWEPT}, {SWEEP}, {REUSED}")
def _(v):
    return _summary(metrics.summary(metrics.swept(_swept(v), "1.0"), ["rate", "scheme"]))


@query("s19_by_split", f"SELECT species, rate, scheme, n, n_pres, {R('auroc', 'auprc', 'cbi', 'brier', 'ece')} FROM metrics", f"{SWEPT}, {SWEEP}")
def _(v):
    return metrics.per_group(_swept(v), ["species", "rate", "scheme"]).select("species", "rate", "scheme", "n", "n_pres", *(number(F.col(c)).alias(c) for c in metrics.METRICS))


@query("s14_macro", f"SELECT scheme, round(avg(auroc), 6) AS auroc, round(avg(auprc), 6) AS auprc, round(avg(CASE WHEN NOT isnan(cbi) THEN cbi END), 6) + 0.0 AS cbi FROM metrics GROUP BY scheme", f"{SWEPT}, {SWEEP}")
def _(v):
    return _summary(metrics.macro(metrics.per_group(_swept(v), ["species", "rate", "scheme"]), ["scheme"]))


@query("s15_best_epoch", "SELECT epoch, auc FROM (SELECT CAST(regexp_extract(line, 'Epoch (\\d+)', 1) AS INT) AS epoch, CAST(regexp_extract(line, 'AUC: ([\\d.]+)', 1) AS DOUBLE) AS auc FROM epoch_log) l ORDER BY auc DESC, epoch LIMIT 1")
def _(v):
    from ..sources.readers import epoch_log

    return metrics.best_epoch(epoch_log(v.epoch_log), "auc")


REG = "reg AS (SELECT CAST(1 + site_id % 3 AS DOUBLE) AS reg, species, avg(p) AS a, CASE WHEN count(*) % 7 = 0 THEN CAST('nan' AS DOUBLE) ELSE avg(p * y) END AS c, avg(p * (1 - y)) AS t FROM scored GROUP BY 1, 2), byreg AS (SELECT reg, avg(a) AS auroc, avg(CASE WHEN NOT isnan(c) THEN c END) AS cbi, avg(abs(a - t)) AS gap FROM reg GROUP BY reg)"


@query("s16_regularisation", "SELECT reg, round(auroc, 6) AS auroc, round(cbi, 6) AS cbi, round(gap, 6) AS gap, (SELECT max_by(reg, auroc) FROM byreg) AS best_auroc, (SELECT max_by(reg, cbi) FROM byreg) AS best_cbi, (SELECT min_by(reg, gap) FROM byreg) AS best_gap, (SELECT max_by(reg, auroc) FROM byreg) IN (SELECT unnest([min(reg), max(reg)]) FROM byreg) AS at_edge FROM byreg", REG)
def _(v):
    p, y = F.col("p"), F.col("y")
    rows = v.scored.groupBy((1 + F.col("site_id") % 3).cast("double").alias("reg"), "species").agg(F.avg(p).alias("auroc_val"), F.when(F.count("*") % 7 == 0, F.lit(float("nan"))).otherwise(F.avg(p * y)).alias("cbi_val"), F.avg(p * (1 - y)).alias("auroc_train"))
    out = metrics.regularisation_summary(rows)
    return out.select("reg", *(F.round(c, 6).alias(c) for c in ("auroc", "cbi", "gap")), "best_auroc", "best_cbi", "best_gap", "at_edge")


@query("s17_convergence", "SELECT model AS cov_set, count(*) FILTER (p <= 0.9) AS n_failed, count(*) FILTER (p > 0.9) AS n_converged FROM scored GROUP BY model")
def _(v):
    return metrics.convergence(v.scored.select(F.col("model").alias("cov_set"), (F.col("p") > 0.9).alias("converged")))


@query("s18_masked_rows", "SELECT round(avg(n), 6) AS mean_masked, count(*) AS n_species FROM (SELECT species, count(*) AS n FROM scored WHERE pass = 1 GROUP BY species) s")
def _(v):
    return metrics.masked_per_species(v.scored.withColumn("masked", F.col("pass") == 1)).withColumn("mean_masked", F.round("mean_masked", 6))


@query("s20_masked_only", f"SELECT species, model, {R('auroc', 'auprc')} FROM ranked", f"{HIST}, {RANK}".replace("FROM scored", "FROM scored WHERE pass <> 2"))
def _(v):
    masked = v.scored.withColumn("known", F.when(F.col("pass") == 2, F.col("y")).otherwise(-1)).where("known = -1")
    out = metrics.ranking(masked, KEYS)
    return out.select(*KEYS, *_n(out, "auroc", "auprc"))


@query("s21_wide_report", 'SELECT species, round(max(CASE WHEN model = \'F\' THEN auroc END), 6) AS "auc_pF", round(max(CASE WHEN model = \'O\' THEN auroc END), 6) AS "auc_pO", round(avg(auroc), 6) AS auc_mean FROM ranked GROUP BY species', f"{HIST}, {RANK}")
def _(v):
    out = metrics.wide_report(metrics.ranking(v.scored, KEYS).withColumnRenamed("model", "rate"), ["F", "O"])
    return out.select("species", *(F.round(c, 6).alias(c) for c in out.columns[1:]))


# --- neighbours ----------------------------------------------------------------------------------

N = 8


_STEPS = tree.PLACE + tree.TIME + tree.ID
_HEX = lambda d: f"substr('0123456789abcdef', CAST({d} AS INT) + 1, 1)"
_AT = lambda x, cells: f"greatest(least(floor({x} * {cells}), {cells - 1}), 0)"
_Y, _X, _T = "((latitude + CAST(90 AS DOUBLE)) / CAST(180 AS DOUBLE))", "((longitude + CAST(180 AS DOUBLE)) / CAST(360 AS DOUBLE))", "((t_days - low) / span)"
_WAY = " || ".join([*(_HEX(f"{_AT(_Y, 4**k)} % 4 * 4 + {_AT(_X, 4**k)} % 4") for k in range(1, tree.PLACE + 1)), *(_HEX(f"{_AT(_T, 16**k)} % 16") for k in range(1, tree.TIME + 1)), f"substr(md5(CAST(site_id AS VARCHAR)), 1, {tree.ID})"])


def _tree_sql(pool: str) -> str:
    """The tree of a pool: its sites with their ways, its nodes, and the nodes above each site."""
    return f"""sites_of AS (SELECT site_id, latitude, longitude, t_days, {_WAY} AS way FROM {pool}, (SELECT min(t_days) AS low, CASE WHEN max(t_days) > min(t_days) THEN max(t_days) - min(t_days) ELSE 1 END AS span FROM {pool}) r),
counted AS (SELECT substr(way, 1, k) AS id, k, count(*) AS n FROM sites_of, (SELECT unnest(range(1, {_STEPS + 1})) AS k) ks GROUP BY ALL),
nodes AS (SELECT c.id, c.k, c.n, substr(c.id, 1, c.k - 1) AS parent, coalesce(p.n, (SELECT count(*) FROM sites_of)) AS m, c.n <= {tree.LEAF} OR c.k = {_STEPS} AS leaf,
  sum(c.n) OVER (PARTITION BY substr(c.id, 1, c.k - 1) ORDER BY c.id ROWS UNBOUNDED PRECEDING) - c.n AS before FROM counted c LEFT JOIN counted p ON p.id = substr(c.id, 1, c.k - 1) WHERE c.k = 1 OR p.n > {tree.LEAF}),
above AS (SELECT site_id, id, leaf, n FROM sites_of JOIN nodes ON starts_with(way, id)),
homes AS (SELECT site_id, id, n, row_number() OVER (PARTITION BY id ORDER BY site_id) - 1 AS rank FROM above WHERE leaf)"""


def _keys_sql(name: str, keys: str, seed: str) -> str:
    """name(key, site_id, e): every exponential of every pair of a table of keys and the sites, as they are passed down the tree."""
    u = lambda what, part: _draw(f"'{seed}#{what}'", "key", part)
    return f"""{name}_steps AS (SELECT key, id, CASE WHEN x >= before AND x < before + n THEN CAST(0 AS DOUBLE) ELSE -ln({u('e', 'id')}) / n END AS step FROM (SELECT *, {u('c', 'parent')} * m AS x FROM {keys}, nodes) q),
{name}_sums AS (SELECT key, site_id, sum(step) AS e FROM {name}_steps JOIN above USING (id) GROUP BY key, site_id),
{name} AS (SELECT key, h.site_id, e + -ln({u('e', "''")}) / (SELECT count(*) FROM sites_of) + CASE WHEN floor({u('c', 'h.id')} * n) = rank THEN 0 ELSE -ln({u('m', 'CAST(h.site_id AS VARCHAR)')}) END AS e FROM {name}_sums s JOIN homes h USING (site_id))"""


def _pairs_sql(seed: str, time: bool = True, targets: str = "stations", pool: str = "pool") -> str:
    """sources(target_id, slot, source_id, d, gap, weight) by looking at every pair."""
    return f"{_tree_sql(pool)}, keys AS (SELECT CAST(site_id AS VARCHAR) AS key FROM {targets}), {_stages_sql(seed, time, targets)}"


def _stages_sql(seed: str, time: bool, targets: str) -> str:
    weight = "1 / (sqrt(pow(d / ds, 2) + pow(gap / ts, 2)) + 1e-6)" if time else "1 / (d / ds + 1e-6)"
    return f"""pairs AS (SELECT CAST(t.site_id AS VARCHAR) AS key, t.site_id AS target_id, s.site_id AS source_id, {_km('t.latitude', 't.longitude', 's.latitude', 's.longitude')} AS d, abs(t.t_days - s.t_days) AS gap FROM {targets} t JOIN sites_of s ON t.site_id <> s.site_id),
{_keys_sql('k1', 'keys', f'{seed}#1')}, {_keys_sql('k2', 'keys', f'{seed}#2')},
first AS (SELECT p.*, row_number() OVER (PARTITION BY target_id ORDER BY e * (d + 1e-6), source_id) AS k FROM pairs p JOIN k1 ON p.key = k1.key AND source_id = k1.site_id),
scales AS (SELECT target_id, quantile_cont(d, 0.5) + 1e-6 AS ds, quantile_cont(gap, 0.5) + 1e-6 AS ts FROM first WHERE k <= {N} GROUP BY target_id),
weighted AS (SELECT p.*, {weight} AS weight FROM pairs p JOIN scales USING (target_id)),
second AS (SELECT w.*, row_number() OVER (PARTITION BY target_id ORDER BY e / weight, source_id) AS slot FROM weighted w JOIN k2 ON w.key = k2.key AND source_id = k2.site_id),
sources AS (SELECT * FROM second WHERE slot <= {N})"""


@query("e01_scales", "SELECT target_id, round(ds, 6) AS d_scale, round(ts, 6) AS t_scale FROM scales", _pairs_sql("e"))
def _(v):
    return neighbours.scales(v.stations, v.pool, N, "e").select("target_id", F.round("d_scale", 6).alias("d_scale"), F.round("t_scale", 6).alias("t_scale"))


@query("e02_sources", "SELECT target_id, slot, source_id, round(d, 6) AS d, round(weight, 6) AS weight FROM sources", _pairs_sql("e"))
def _(v):
    return neighbours.sources(v.stations, v.pool, N, "e").select("target_id", "slot", "source_id", F.round("d", 6).alias("d"), F.round("weight", 6).alias("weight"))


@query("e02_sources_space_only", "SELECT target_id, slot, source_id FROM sources", _pairs_sql("s", False))
def _(v):
    return neighbours.sources(v.stations, v.pool, N, "s", with_time=False).select("target_id", "slot", "source_id")


_SLOTS = "slot_keys AS (SELECT key || '|' || slot AS key, key AS target, slot FROM keys, (SELECT unnest(range(1, 9)) AS slot) s)"


@query("e03_with_replacement", "SELECT target_id, slot, source_id FROM (SELECT target_id, s.slot, source_id, row_number() OVER (PARTITION BY target_id, s.slot ORDER BY e / weight, source_id) AS k FROM slot_keys s JOIN weighted w ON w.key = s.target JOIN k3 ON k3.key = s.key AND k3.site_id = source_id) q WHERE k = 1", f"{_pairs_sql('e')}, {_SLOTS}, {_keys_sql('k3', 'slot_keys', 'e#r')}")
def _(v):
    return neighbours.sources(v.stations, v.pool, N, "e", replacement=True).select("target_id", "slot", "source_id")


@query("e04_tree_sources", "SELECT target_id, slot, source_id, round(d, 6) AS d, round(gap, 6) AS gap, round(weight, 6) AS weight FROM sources", _pairs_sql("c"))
def _(v):
    out = neighbours.tree_sources(v.stations, v.pool, N, "c")
    return out.select("target_id", "slot", "source_id", *(F.round(c, 6).alias(c) for c in ("d", "gap", "weight")))


@query("e04_train_sources", "SELECT target_id, slot, source_id FROM sources", "train_pool AS (SELECT * FROM pool WHERE site_id % 5 <> 0), " + _pairs_sql("t", pool="train_pool"))
def _(v):
    return neighbours.sources(v.stations, v.pool.where("site_id % 5 <> 0"), N, "t").select("target_id", "slot", "source_id")


@query("c17_gathered", "SELECT target_id, slot, source_id, (SELECT string_agg(species, ',' ORDER BY species) FROM pool_presence p WHERE p.site_id = source_id) AS species FROM sources", _pairs_sql("e"))
def _(v):
    out = neighbours.gathered(neighbours.sources(v.stations, v.pool, N, "e"), v.pool_presence)
    return out.select("target_id", F.explode("sources").alias("x")).select("target_id", "x.slot", "x.source_id", F.nullif(F.array_join("x.species", ","), F.lit("")).alias("species"))


PRED = "pred AS (SELECT t.target_id, x.species, coalesce(w, 0) / total AS p FROM (SELECT target_id, sum(weight) AS total FROM sources GROUP BY target_id) t CROSS JOIN (SELECT DISTINCT species FROM pool_presence) x LEFT JOIN (SELECT target_id, species, sum(weight) AS w FROM sources JOIN pool_presence ON source_id = site_id GROUP BY target_id, species) h ON h.target_id = t.target_id AND h.species = x.species)"


@query("g05_neighbour_prediction", "SELECT target_id, species, round(p, 6) AS p FROM pred", f"{_pairs_sql('e')}, {PRED}")
def _(v):
    drawn, there = neighbours.sources(v.stations, v.pool, N, "e"), tree._written(v.pool_presence, "presence")
    return neighbours.neighbour_prediction(drawn, there, there).select("target_id", "species", F.round("p", 6).alias("p"))


_SECOND = ("k1_steps", "k1_sums", "k1", "k2_steps", "k2_sums", "k2", "pairs", "first", "scales", "weighted", "second", "sources", "pred")


def _two(one: str, other: str, targets: str = "stations") -> str:
    """Predictions pred and pred1 of two passes for a table of targets, over one tree."""
    again = re.sub(rf"\b({'|'.join(_SECOND)})\b", r"\1_b", f"{_stages_sql(other, True, targets)}, {PRED}")
    return f"{_pairs_sql(one, targets=targets)}, {PRED}, {again}"


@query("g06_bagged_prediction", "SELECT target_id, species, round((a.p + b.p) / 2, 6) AS p, round(a.p, 6) AS p_single FROM pred a JOIN pred_b b USING (target_id, species)", _two("b0", "b1"))
def _(v):
    over, there, out = tree.Tree(v.pool), tree._written(v.pool_presence, "presence"), None
    for k in range(2):
        one = neighbours.neighbour_prediction(neighbours.sources(v.stations, over, N, f"b{k}"), there, there).withColumn("pass", F.lit(k)).withColumn("y", F.lit(0))
        out = one if out is None else out.unionByName(one)
    bag = metrics.bagged(out, ["target_id", "species"])
    return bag.select("target_id", "species", F.round("p", 6).alias("p"), F.round("p_single", 6).alias("p_single"))


DATED = "dated AS (SELECT site_id * 10 + k AS site_id, latitude, longitude, CAST(100 * k AS DOUBLE) AS t_days FROM stations, (SELECT unnest([1, 2]) AS k) ks)"


@query("g07_suitability", "SELECT a.target_id // 10 AS cell_id, a.target_id % 10 * 100 AS day, round((a.p + b.p) / 2, 6) AS p FROM pred a JOIN pred_b b USING (target_id, species) WHERE species = (SELECT min(species) FROM pool_presence)", f"{DATED}, {_two('m0', 'm1', 'dated')}")
def _(v):
    """A row for each cell and date: the mean of two passes, nothing known of the cell, sources from observations alone."""
    dated = v.stations.withColumn("k", F.explode(F.array(F.lit(1), F.lit(2)))).select((F.col("site_id") * 10 + F.col("k")).alias("site_id"), "latitude", "longitude", (100.0 * F.col("k")).alias("t_days"))
    both = neighbours.with_grid(v.pool, dated)
    there = tree._written(v.pool_presence, "presence")
    one = there.agg(F.min("species").alias("species"))
    over, there, out = tree.Tree(both.where("kind = 'obs'")), there.join(F.broadcast(one), "species", "left_semi"), None
    for k in range(2):
        drawn = neighbours.sources(both.where("kind = 'grid'"), over, N, f"m{k}")
        part = neighbours.neighbour_prediction(drawn, there, one).withColumn("pass", F.lit(k)).withColumn("y", F.lit(0))
        out = part if out is None else out.unionByName(part)
    bag = metrics.bagged(out, ["target_id", "species"])
    return bag.select(F.floor(F.col("target_id") / 10).alias("cell_id"), (F.col("target_id") % 10 * 100).alias("day"), F.round("p", 6).alias("p"))


ENV_AT = "CAST(floor((latitude - 7) / 5) AS BIGINT) * 24 + CAST(floor((longitude + 170) / 5) AS BIGINT)"
TRAINING = f"""place AS (SELECT site_id, {ENV_AT} AS cell FROM (SELECT site_id, latitude, longitude FROM stations UNION ALL SELECT site_id, latitude, longitude FROM pool) p),
place_env AS (SELECT site_id, value AS env FROM place LEFT JOIN raster_static USING (cell)),
seen AS (SELECT site_id + 10000000 AS site_id, species FROM pool_presence),
rows AS (SELECT s.site_id, x.species, CASE WHEN q.species IS NULL THEN 0 ELSE 1 END AS present FROM stations s CROSS JOIN (SELECT DISTINCT species FROM seen) x LEFT JOIN seen q ON q.site_id = s.site_id AND q.species = x.species),
{_mask('0.5', 'g9', False)},
states AS (SELECT site_id, string_agg(species || ':' || CAST(CASE WHEN masked THEN 2 ELSE present END AS VARCHAR), ',' ORDER BY species) AS states,
  string_agg(CASE WHEN masked THEN species || ':' || CAST(present AS VARCHAR) END, ',' ORDER BY species) AS labels FROM masks GROUP BY site_id),
near AS (SELECT target_id, string_agg(CAST(slot AS VARCHAR) || ':' || CAST(source_id AS VARCHAR) || ':' || CAST(round(coalesce(env, -1), 2) AS VARCHAR), ';' ORDER BY slot) AS sources FROM sources JOIN place_env ON source_id = site_id GROUP BY target_id)"""


@query("g09_training_rows", "SELECT target_id, states, labels, sources, round(env, 2) AS env FROM near JOIN states ON target_id = states.site_id JOIN place_env ON target_id = place_env.site_id", f"{_pairs_sql('e')}, {TRAINING}")
def _(v):
    at = F.expr(ENV_AT).alias("cell")
    place = v.stations.select("site_id", at).union(v.pool.select("site_id", at))
    env = place.join(v.raster_static.select("cell", F.col("value").alias("env")), "cell", "left").select("site_id", "env")
    seen = v.pool_presence.select((F.col("site_id") + 10000000).alias("site_id"), "species")
    masks = masking.masked(masking.states(v.stations, seen), 0.5, "g9")
    out = neighbours.training_rows(neighbours.sources(v.stations, v.pool, N, "e"), masks, v.pool_presence, env)
    path = scratch(v.spark, "training")
    out.write.parquet(path)
    rows = v.spark.read.parquet(path)
    pairs = lambda c, value: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["species"], x[value])), ",")
    near = F.array_join(F.transform("sources", lambda x: F.concat_ws(":", x["slot"], x["source_id"], F.round(F.coalesce(x["env"], F.lit(-1.0)), 2))), ";")
    return rows.select("target_id", pairs("states", "state").alias("states"), F.nullif(pairs(F.filter("states", lambda x: x["label"].isNotNull()), "label"), F.lit("")).alias("labels"), near.alias("sources"), F.round("env", 2).alias("env"))


# --- models --------------------------------------------------------------------------------------


def _rows(v: Views):
    """scored with two standardised features of the site."""
    x = v.sites.select("site_id", ((F.col("latitude") - 39.5) / 18.8).alias("f_lat"), ((F.col("longitude") + 110) / 34.6).alias("f_lon"), F.dayofyear("time").alias("doy"), "latitude", "longitude")
    return v.scored.join(x, "site_id")


def _newton_sql(steps: int = 8) -> str:
    """Newton steps of the regression on two features as common table expressions fit0, fit1, ..., by Cramer's rule."""
    out = ["design AS (SELECT species, y, site_id, pass, (latitude - 39.5) / 18.8 AS x1, (longitude + 110) / 34.6 AS x2 FROM scored JOIN sites USING (site_id))", "fit0 AS (SELECT species, CAST(0 AS DOUBLE) AS b0, CAST(0 AS DOUBLE) AS b1, CAST(0 AS DOUBLE) AS b2, CAST(0 AS DOUBLE) AS s FROM design GROUP BY species HAVING min(y) < max(y))"]
    det = "(a * (d * f - e * e) - b * (b * f - c * e) + c * (b * e - c * d))"
    move = (f"((d * f - e * e) * g0 + (c * e - b * f) * g1 + (b * e - c * d) * g2) / {det}", f"((c * e - b * f) * g0 + (a * f - c * c) * g1 + (b * c - a * e) * g2) / {det}", f"((b * e - c * d) * g0 + (b * c - a * e) * g1 + (a * d - b * b) * g2) / {det}")
    for k in range(1, steps + 1):
        out.append(f"""fit{k} AS (SELECT species, b0 + {move[0]} AS b0, b1 + {move[1]} AS b1, b2 + {move[2]} AS b2, greatest(abs({move[0]}), abs({move[1]}), abs({move[2]})) AS s FROM
  (SELECT species, any_value(b0) AS b0, any_value(b1) AS b1, any_value(b2) AS b2, sum(w) + 1e-12 AS a, sum(w * x1) AS b, sum(w * x2) AS c, sum(w * x1 * x1) + 1.000001e-6 AS d, sum(w * x1 * x2) AS e, sum(w * x2 * x2) + 1.000001e-6 AS f,
    sum(y - p) AS g0, sum((y - p) * x1) - 1e-6 * any_value(b1) AS g1, sum((y - p) * x2) - 1e-6 * any_value(b2) AS g2 FROM
    (SELECT *, p * (1 - p) AS w FROM (SELECT r.*, b0, b1, b2, 1 / (1 + exp(-(b0 + b1 * x1 + b2 * x2))) AS p FROM design r JOIN fit{k - 1} USING (species)) z) u GROUP BY species) t)""")
    return ", ".join(out)


FITS = _newton_sql()


@query("g01_logistic_fits", "SELECT species, s < 1e-8 AS converged, round(b0, 5) AS b0, round(b1, 5) AS b_f_lat, round(b2, 5) AS b_f_lon FROM fit8", FITS)
def _(v: Views):
    fits = models.logistic_fits(_rows(v), ["species"], ["f_lat", "f_lon"])
    return fits.select("species", "converged", *(F.round(c, 5).alias(c) for c in ("b0", "b_f_lat", "b_f_lon")))


def _systems_sql(name: str, rows: str, features: list[str], ridge: str, steps: int, keys: str = "species") -> str:
    """Newton steps of a regression on any number of features, as common table expressions name0, name1, ...: (keys, b, move, best, done).

    rows has the keys, y and the features.  Each step solves the systems of all groups by Gauss-Jordan elimination, one projection a pivot, over
    lists of lists (a system of the squares and products, its right side in the last column).  A move that lowers the penalised likelihood is halved; b are the coefficients,
    done tells that the last move is below 1e-8, and then they stay.
    """
    d = len(features) + 1
    x = ["1", *features]
    known = " AND ".join(f"{f} IS NOT NULL" for f in features)
    out = [f"{name}_rows AS MATERIALIZED (SELECT {keys}, CAST(y AS DOUBLE) AS y, {', '.join(features)} FROM {rows} WHERE {known})"]
    out.append(f"{name}0 AS (SELECT {keys}, [{', '.join(['CAST(0 AS DOUBLE)'] * d)}] AS b, [{', '.join(['CAST(0 AS DOUBLE)'] * d)}] AS move, CAST('-inf' AS DOUBLE) AS best, false AS done FROM {name}_rows GROUP BY {keys} HAVING min(y) < max(y))")
    z = " + ".join(f"b[{i}] * {f}" for i, f in enumerate(x, 1))
    sums = ", ".join(f"sum(w * {x[i]} * {x[j]}) AS h{i}_{j}" for i in range(d) for j in range(i + 1)) + ", " + ", ".join(f"sum((y - p) * {x[i]}) AS g{i}" for i in range(d)) + ", sum(y * z - greatest(z, 0) - ln(1 + exp(-abs(z)))) AS fit"
    cell = lambda i, j: f"h{max(i, j)}_{min(i, j)}" + ((" + 1e-12" + (f" + {ridge}" if i else "")) if i == j else "")
    matrix = "[" + ", ".join("[" + ", ".join(cell(i, j) for j in range(d)) + f", g{i}" + (f" - {ridge} * b[{i + 1}]" if i else "") + "]" for i in range(d)) + "]"
    state, squares = "b, move, best, done", " + ".join(f"b[{i}] * b[{i}]" for i in range(2, d + 1))
    for k in range(1, steps + 1):
        at = f"SELECT *, p * (1 - p) AS w FROM (SELECT *, 1 / (1 + exp(-z)) AS p FROM (SELECT r.*, {state}, greatest(least({z}, 30), -30) AS z FROM {name}_rows r JOIN {name}{k - 1} f USING ({keys})) a) q"
        solved = f"(SELECT {keys}, {state}, {matrix} AS m, fit - {ridge} / 2 * ({squares}) AS fit FROM (SELECT {keys}, {state}, {sums} FROM ({at}) u GROUP BY {keys}, {state}) h)"
        for i in range(1, d + 1):
            solved = f"(SELECT {keys}, {state}, fit, list_transform(m, lambda r, i: CASE WHEN i = {i} THEN list_transform(r, lambda v: v / r[{i}]) ELSE list_transform(r, lambda v, j: v - r[{i}] * m[{i}][j] / m[{i}][{i}]) END) AS m FROM {solved} t{i})"
        moved = f"SELECT {keys}, b, best, done, fit, fit < best - 1e-9 AS worse, CASE WHEN fit < best - 1e-9 THEN list_transform(move, lambda v: v / 2) ELSE list_transform(m, lambda r: r[{d + 1}]) END AS move FROM {solved} e"
        out.append(f"{name}{k} AS MATERIALIZED (SELECT {keys}, CASE WHEN done THEN b WHEN worse THEN list_transform(b, lambda v, i: v - move[i]) ELSE list_transform(b, lambda v, i: v + move[i]) END AS b, move, CASE WHEN done OR worse THEN best ELSE fit END AS best, done OR (NOT worse AND list_max(list_transform(move, lambda v: abs(v))) < 1e-8) AS done FROM ({moved}) v)")
    return ", ".join(out)


STEPS = 25
SEASON = [f"{f}_{p}" for p in (365, 182, 122, 91) for f in ("sin", "cos")]
SETS = {"env": ["e_dem", "e_col"], "spatiotemporal": ["f_lat", "f_lon", *SEASON], "full": ["e_dem", "e_col", "f_lat", "f_lon", *SEASON]}
SET_ROWS = "set_rows AS MATERIALIZED (SELECT species, y, (latitude - 39.5) / 18.8 AS f_lat, (longitude + 110) / 34.6 AS f_lon, (env_dem - 4500) / 3200 AS e_dem, (env_col - 11.5) / 6.9 AS e_col, " + ", ".join(f"{f.split('_')[0]}(2 * pi() * dayofyear(time) / {f.split('_')[1]}) AS {f}" for f in SEASON) + " FROM scored JOIN sites USING (site_id) JOIN env USING (site_id))"
SET_FITS = ", ".join([ENV, SET_ROWS, *(_systems_sql(f"{n}_fit", "set_rows", f, "1e-6", STEPS) for n, f in SETS.items())])
SET_SQL = " UNION ALL ".join(f"SELECT '{n}' AS cov_set, species, done AS converged, unnest([{', '.join(repr('b_' + x if x != 'b0' else x) for x in ['b0', *f])}]) AS name, round(unnest(b), 4) + 0.0 AS value FROM {n}_fit{STEPS}" for n, f in SETS.items())


def _sets(v: Views):
    """Rows with all covariates, and which of them belong to each set."""
    env = _env(v).select("site_id", ((F.col("env_dem") - 4500) / 3200).alias("e_dem"), ((F.col("env_col") - 11.5) / 6.9).alias("e_col"))
    season = fourier(F.col("doy"))
    rows = _rows(v).join(env, "site_id").withColumns(season)
    where = ["f_lat", "f_lon", *season]
    return rows, {"env": ["e_dem", "e_col"], "spatiotemporal": where, "full": ["e_dem", "e_col", *where]}


@query("g01_covariate_sets", SET_SQL, SET_FITS)
def _(v):
    rows, sets = _sets(v)
    out = None
    for name, fits in models.logistic_sets(rows, ["species"], sets).items():
        part = fits.select(F.lit(name).alias("cov_set"), "species", "converged", F.map_from_arrays(F.array(*map(F.lit, fits.columns[3:])), F.array(*(F.round(c, 4) for c in fits.columns[3:]))).alias("coefficients"))
        out = part if out is None else out.union(part)
    return out.select("cov_set", "species", "converged", F.explode("coefficients").alias("name", "value")).withColumn("value", F.col("value") + 0.0)


@query("g02_predictions", "SELECT species, site_id, pass, round(1 / (1 + exp(-(b0 + b1 * x1 + b2 * x2))), 5) AS predicted FROM design JOIN fit8 USING (species)", FITS)
def _(v):
    rows = _rows(v)
    fits = models.logistic_fits(rows, ["species"], ["f_lat", "f_lon"])
    return models.predicted(rows, fits, ["species"], ["f_lat", "f_lon"]).select("species", "site_id", "pass", F.round("predicted", 5).alias("predicted"))


@query("g03_smooth_fits")
def _(v):
    centres = [(10.25 + 6.5 * i, -158.0 + 24.0 * j) for i in range(10) for j in range(5)]
    names, made = models.smooth_design(12, centres, 12.0)
    fits = models.logistic_fits(_rows(v), ["species"], names, ridge=0.1, design=(["doy", "latitude", "longitude"], made))
    return fits.select("species", "converged", *(F.round(c, 3).alias(c) for c in fits.columns if c.startswith("b")))


QUAD = ["f_lat", "f_lon", "f_lat_2", "f_lon_2"]
SWEEP_Z = " + ".join(["b[1]", *(f"b[{i}] * {f}" for i, f in enumerate(QUAD, 2))])
SWEEP = f"""quads AS MATERIALIZED (SELECT species, y, split, f_lat, f_lon, pow(f_lat, 2) AS f_lat_2, pow(f_lon, 2) AS f_lon_2 FROM (SELECT species, y, split, (latitude - 39.5) / 18.8 AS f_lat, (longitude + 110) / 34.6 AS f_lon FROM scored JOIN sites USING (site_id) JOIN split USING (site_id)) q),
few AS (SELECT species FROM (SELECT DISTINCT species FROM scored) a ORDER BY md5(concat_ws('|', 'g4', species)), species LIMIT 16), ridges AS (SELECT CAST(unnest([1, 2, 4, 8, 16, 32]) AS DOUBLE) AS reg),
few_rows AS (SELECT quads.*, reg FROM quads JOIN few USING (species), ridges WHERE split = 'train'), {_systems_sql("few_fit", "few_rows", QUAD, "reg", STEPS, "species, reg")},
few_val AS (SELECT species, reg, CAST(y AS DOUBLE) AS y, 1 / (1 + exp(-({SWEEP_Z}))) AS q FROM quads JOIN few_fit{STEPS} USING (species) WHERE split = 'val'),
few_hist AS (SELECT species, reg, q, sum(y) AS pos, sum(1 - y) AS neg FROM few_val GROUP BY species, reg, q),
few_cum AS (SELECT *, coalesce(sum(neg) OVER (PARTITION BY species, reg ORDER BY q ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM few_hist),
few_auc AS (SELECT species, reg, sum(pos * (below + neg / 2)) / (sum(pos) * sum(neg)) AS auroc FROM few_cum GROUP BY species, reg HAVING sum(pos) > 0 AND sum(neg) > 0),
best AS (SELECT reg FROM few_auc GROUP BY reg ORDER BY round(avg(auroc), 12) DESC, reg LIMIT 1),
best_rows AS (SELECT quads.*, coalesce((SELECT reg FROM best), 1) AS reg FROM quads WHERE split = 'train'), {_systems_sql("best_fit", "best_rows", QUAD, "reg", STEPS, "species, reg")}"""
SWEEP_SQL = "SELECT reg, species, done AS converged, " + ", ".join(f"round(b[{i}], 4) + 0.0 AS {n}" for i, n in enumerate(["b0", *(f"b_{f}" for f in QUAD)], 1)) + f" FROM best_fit{STEPS}"


@query("g04_regularisation_sweep", SWEEP_SQL, f"{CELLS}, {BLOCKS}, {SWEEP}")
def _(v):
    rows, names = models.quadratic(_rows(v), ["f_lat", "f_lon"])
    parts = rows.join(_split(v).select("site_id", "split"), "site_id")
    sample = prepare.random_species(v.scored.select("species"), 16, "g4")
    fits = models.chosen(parts.where("split = 'train'"), parts.where("split = 'val'"), sample, names)
    return fits.select("reg", "species", "converged", *((F.round(c, 4) + 0.0).alias(c) for c in fits.columns if c.startswith("b")))


GRID_T = "ts AS (SELECT exp(-2.0 + 4.0 * CAST(unnest(range(0, 81)) AS DOUBLE) / 80) AS t), small AS (SELECT p, y, count(*) AS n, ln(least(greatest(p, 1e-7), 1 - CAST(1e-7 AS DOUBLE)) / (1 - least(greatest(p, 1e-7), 1 - CAST(1e-7 AS DOUBLE)))) AS lz FROM scored GROUP BY p, y), losses AS (SELECT t, sum(n * (greatest(lz / t, 0) - lz / t * y + ln(1 + exp(-abs(lz / t))))) / sum(n) AS loss FROM small, ts GROUP BY t)"


@query("g08_temperature", "SELECT round(t, 6) AS temperature FROM losses ORDER BY round(loss, 12), t LIMIT 1", GRID_T)
def _(v):
    return models.temperature(v.scored).select(F.round("temperature", 6).alias("temperature"))


VAL_T = GRID_T.replace("FROM scored", "FROM scored JOIN split USING (site_id) WHERE split = 'val'")
TEST = f"""chosen AS (SELECT t FROM losses ORDER BY round(loss, 12), t LIMIT 1), test AS (SELECT y, p, least(greatest(p, 1e-7), 1 - CAST(1e-7 AS DOUBLE)) AS q FROM scored JOIN split USING (site_id) WHERE split = 'test'),
twice AS (SELECT 'before' AS k, y, p FROM test UNION ALL SELECT 'after' AS k, y, 1 / (1 + exp(-ln(q / (1 - q)) / t)) AS p FROM test, chosen),
eces AS (SELECT k, sum(n * abs(conf - freq)) / (SELECT count(*) FROM test) AS ece FROM (SELECT k, floor(p * 15) AS bin, count(*) AS n, avg(p) AS conf, avg(y) AS freq FROM twice WHERE p < 1 GROUP BY 1, 2) b GROUP BY k)"""


@query("g08_ece_before_after", "SELECT round(max(CASE WHEN k = 'before' THEN ece END), 6) AS ece_before, round(max(CASE WHEN k = 'after' THEN ece END), 6) AS ece_after FROM eces", f"{CELLS}, {BLOCKS}, {VAL_T}, {TEST}")
def _(v):
    parts = v.scored.join(_split(v).select("site_id", "split"), "site_id")
    t = models.temperature(parts.where("split = 'val'"))
    test = parts.where("split = 'test'")
    before, after = metrics.pooled_ece(test), metrics.pooled_ece(models.calibrated(test, t))
    return before.select(F.round("ece", 6).alias("ece_before")).crossJoin(after.select(F.round("ece", 6).alias("ece_after")))
