"""Many small models as grouped aggregates, and temperature calibration."""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expr import logit, missing, sigmoid
from ..plans.fixtures import scratch
from .metrics import ranking

#: Bytes that a task holds before it passes them on, and rows of a packed piece of a group.
HELD, PIECE = 1 << 26, 1024

#: Features of a fit as a function of the inputs (rows times inputs), worked out anew in each pass.
Design = Callable[[np.ndarray], np.ndarray]


def _matrix(rows: np.ndarray, design: Design) -> tuple[np.ndarray, np.ndarray]:
    """y and the features with a leading one, of a piece (y, then the inputs, a row each); rows with a missing feature are left out."""
    f = design(rows[1:].T)
    x = np.empty((len(f), f.shape[1] + 1))
    x[:, 0], x[:, 1:] = 1, f
    known = ~np.isnan(f).any(axis=1)
    return (rows[0], x) if known.all() else (rows[0][known], x[known])


def _packed(width: int, designs: Sequence[Design]):
    """Rows (group, y, inputs, keys) -> (group, keys, data, n, n1): pieces of the rows of a group, and of each design its rows and the sum of their y."""

    def packed(batches):
        held: dict[int, list[np.ndarray]] = {}
        size: dict[int, int] = {}
        names: dict[int, pa.RecordBatch] = {}

        def out(groups):
            parts = [np.concatenate(held.pop(g), axis=1) for g in groups]
            counts = [[(len(y), float(y.sum())) for y, _ in (_matrix(part, d) for d in designs)] for part in parts]
            keys = pa.Table.from_batches([names[g] for g in groups]).combine_chunks()
            columns = [pa.array(groups, pa.int64()), *(c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in keys.columns), pa.array([part.tobytes() for part in parts], pa.binary())]
            columns += [pa.array([[c[i] for c in count] for count in counts], pa.list_(kind)) for i, kind in ((0, pa.int64()), (1, pa.float64()))]
            for g in groups:
                del size[g], names[g]
            return pa.RecordBatch.from_arrays(columns, names=["group", *keys.column_names, "data", "n", "n1"])

        for batch in batches:
            group = batch.column(0).to_numpy()
            rows = np.stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns[1 : width + 2]])
            at = np.flatnonzero(~np.isnan(rows[0]))
            at = at[np.argsort(group[at], kind="stable")]
            for part in np.split(at, np.flatnonzero(np.diff(group[at])) + 1):
                if not len(part):
                    continue
                g = int(group[part[0]])
                if g not in names:
                    held[g], size[g], names[g] = [], 0, batch.slice(int(part[0]), 1).select(range(width + 2, batch.num_columns))
                held[g].append(rows[:, part])
                size[g] += len(part)
            full = [g for g, n in size.items() if n >= PIECE]
            if sum(size.values()) * (width + 1) * 8 > HELD:
                full = list(size)
            if full:
                yield out(full)
        if size:
            yield out(list(size))

    return packed


def _sums(width: int, designs: Sequence[Design]):
    """Rows (data, units of (unit, design, b)) -> (unit, sums): of each unit of a task the cross products, the gradient and the log-likelihood."""

    def sums(batches):
        held: dict[int, np.ndarray] = {}

        def out():
            made = pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.int64()), pa.array(list(held.values()), pa.list_(pa.float64()))], names=["unit", "sums"])
            held.clear()
            return made

        for batch in batches:
            for data, units in zip(batch.column(0), batch.column(1)):
                rows, made = np.frombuffer(data.as_buffer()).reshape(width + 1, -1), {}
                for unit in units.as_py():
                    if unit["design"] not in made:
                        made[unit["design"]] = _matrix(rows, designs[unit["design"]])
                    y, x = made[unit["design"]]
                    z = np.clip(x @ np.array(unit["b"]), -30, 30)
                    p = 1 / (1 + np.exp(-z))
                    like = y * z - np.maximum(z, 0) - np.log1p(np.exp(-np.abs(z)))
                    part = np.r_[((x.T * (p * (1 - p))) @ x).ravel(), x.T @ (y - p), like.sum()]
                    u = unit["unit"]
                    held[u] = held[u] + part if u in held else part
            if sum(len(v) for v in held.values()) * 8 > HELD:
                yield out()
        if held:
            yield out()

    return sums


def _newton(tolerance: float):
    """The next state of a unit from its state and the sums of all tasks."""

    def newton(state, sums):
        import pandas as pd

        if not len(state):
            return pd.DataFrame()
        s = state.iloc[0].to_dict()
        total, d = np.sum(np.stack(sums.sums.to_numpy()), axis=0), len(s["b"])
        h, g, like = total[: d * d].reshape(d, d), total[d * d : -1], total[-1]
        b, step, penalty = np.array(s["b"]), np.array(s["step"]), s["ridge"] * np.r_[0.0, np.ones(d - 1)]
        like -= (penalty * b * b).sum() / 2
        s["rounds"] += 1
        if like < s["best"] - 1e-9:
            step = step / 2
            b = b - step
        else:
            s["best"] = like
            try:
                step = np.linalg.solve(h + np.diag(penalty + 1e-12), g - penalty * b)
            except np.linalg.LinAlgError:
                step = np.full(d, np.nan)
            if np.isfinite(step).all():
                s["converged"] = bool(np.abs(step).max() < tolerance)
                s["settled"] = s["converged"]
                b = b + step
            else:  # no fit: it stays as it was, and is not converged
                s["settled"], step = True, np.zeros(d)
        return pd.DataFrame([{**s, "b": b.tolist(), "step": step.tolist()}])

    return newton


def logistic_fits(rows: DataFrame, keys: Sequence[str], features: Sequence[str], ridge: float | Sequence[float] = 1e-6, rounds: int = 25, tolerance: float = 1e-8, design: tuple[Sequence[str], Design] | None = None) -> DataFrame:
    """rows(keys, y, features) -> (keys, converged, rounds, b0, b_<feature>...): one logistic regression per group.

    Groups of one class are skipped, rows with a missing y or feature left out; a system without a solution leaves its group not converged.
    ridge: a number, or several, and then a column reg tells the fits apart, all of which share each pass.  A step is halved while it
    lowers the likelihood.  design: the columns of rows that the features are made of, and the function that makes them; without it features are columns.
    """
    inputs, made = design or (features, _columns(range(len(features))))
    fits = Fits(rows, keys, inputs, {"": (list(features), made)}, rounds, tolerance).of(ridge)[""]
    return fits.drop("reg") if isinstance(ridge, (int, float)) else fits


def logistic_sets(rows: DataFrame, keys: Sequence[str], sets: Mapping[str, Sequence[str]], ridge: float = 1e-6, rounds: int = 25, tolerance: float = 1e-8) -> dict[str, DataFrame]:
    """logistic_fits() of several sets of features of the same rows, by name; all share each pass."""
    inputs = list(dict.fromkeys(f for features in sets.values() for f in features))
    designs = {name: (list(features), _columns([inputs.index(f) for f in features])) for name, features in sets.items()}
    return {name: fits.drop("reg") for name, fits in Fits(rows, keys, inputs, designs, rounds, tolerance).of(ridge).items()}


def _columns(at: Sequence[int]) -> Design:
    at = list(at)
    return lambda x: x[:, at]


class Fits:
    """Logistic regressions of every group of rows(keys, y, inputs), by named designs (features, function of the inputs).

    The inputs are written once, as pieces of a group's rows that the tasks pack from what they hold, without a sort; features are worked out in each pass.  A
    pass adds up cross products piece by piece, so a large group is the work of many tasks; the small systems are solved group by group, and coefficients are a written table.
    """

    def __init__(self, rows: DataFrame, keys: Sequence[str], inputs: Sequence[str], designs: Mapping[str, tuple[Sequence[str], Design]], rounds: int = 25, tolerance: float = 1e-8):
        self.keys, self.designs, self.rounds, self.tolerance, self.width = list(keys), dict(designs), rounds, tolerance, len(inputs)
        self.made = [made for _, made in self.designs.values()]
        given = rows.select(F.xxhash64(*keys).alias("group"), F.col("y").cast("double").alias("y"), *(F.col(f).cast("double").alias(f"_x{i}") for i, f in enumerate(inputs)), *keys)
        kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in given.select(*keys).schema)
        schema = f"group long, {kinds}, data binary, n array<long>, n1 array<double>"
        self.pieces = _written(given.mapInArrow(_packed(self.width, self.made), schema), "pieces")

    def of(self, ridge: float | Sequence[float], only: DataFrame | None = None) -> dict[str, DataFrame]:
        """Of each design the fits (reg, keys, converged, rounds, b0, b_<feature>...) with every ridge; only: of the groups with these keys."""
        ridges = [float(r) for r in ([ridge] if isinstance(ridge, (int, float)) else ridge)]
        pieces = self.pieces if only is None else self.pieces.join(F.broadcast(only), self.keys, "left_semi")
        counts = pieces.select("group", *self.keys, F.posexplode(F.arrays_zip("n", "n1")).alias("design", "c"))
        groups = counts.groupBy("group", *self.keys, "design").agg(F.sum("c.n1").alias("_n1"), F.sum("c.n").alias("_n")).where("_n1 > 0 and _n1 < _n").drop("_n1", "_n")
        sizes = F.array(*(F.lit(len(features) + 1) for features, _ in self.designs.values()))
        zeros = F.array_repeat(F.lit(0.0), F.get(sizes, F.col("design")))
        state = groups.withColumn("ridge", F.explode(F.array(*map(F.lit, ridges)))).select(
            F.xxhash64("group", "design", "ridge").alias("unit"), "group", *self.keys, "design", "ridge", zeros.alias("b"), zeros.alias("step"), F.lit(-math.inf).alias("best"), F.lit(0).alias("rounds"), F.lit(False).alias("converged"), F.lit(False).alias("settled")
        )
        state, done = _written(state, "state"), None
        for _ in range(self.rounds):
            units = state.groupBy("group").agg(F.collect_list(F.struct("unit", "design", "b")).alias("units"))
            part = self.pieces.select("group", "data").join(units, "group").select("data", "units").mapInArrow(_sums(self.width, self.made), "unit long, sums array<double>")
            state = _written(state.groupBy("unit").cogroup(part.groupBy("unit")).applyInPandas(_newton(self.tolerance), state.schema), "state")
            over = state.where("settled")
            done = over if done is None else done.union(over)
            state = state.where("not settled")
            if not state.limit(1).count():
                break
        out = state if done is None else done.union(state)
        return {
            name: out.where(F.col("design") == i).select(F.col("ridge").alias("reg"), *self.keys, "converged", "rounds", *(F.get("b", k).alias(n) for k, n in enumerate(["b0", *(f"b_{f}" for f in features)])))
            for i, (name, (features, _)) in enumerate(self.designs.items())
        }


def _written(df: DataFrame, name: str) -> DataFrame:
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def predicted(rows: DataFrame, fits: DataFrame, keys: Sequence[str], features: Sequence[str], more: Sequence[str] = ()) -> DataFrame:
    """rows with the prediction of their group's model; more: columns of fits to keep (a row for each of several models of a group)."""
    z = F.col("b0") + sum((F.col(f"b_{f}") * F.col(f) for f in features), F.lit(0.0))
    return rows.join(fits, list(keys)).withColumn("predicted", sigmoid(z)).select(*rows.columns, *more, "predicted")


def seasonal_basis(df: DataFrame, doy: str, knots: int = 12, period: float = 365.25) -> tuple[DataFrame, list[str]]:
    """Cyclic bumps of the day of the year (raised cosines on equidistant knots), one column each but the last."""
    names = [f"doy_{k}" for k in range(knots - 1)]
    width = period / knots * 2
    gap = lambda k: F.abs(F.pmod(F.col(doy) - k * period / knots + period / 2, F.lit(period)) - period / 2)
    return df.withColumns({n: F.when(gap(k) < width, (1 + F.cos(math.pi * gap(k) / width)) / 2).otherwise(0.0) for k, n in enumerate(names)}), names


def spatial_basis(df: DataFrame, centres: Sequence[tuple[float, float]], width: float) -> tuple[DataFrame, list[str]]:
    """Gaussian bumps of latitude and longitude around given centres."""
    names = [f"space_{k}" for k in range(len(centres))]
    d2 = lambda c: F.pow(F.col("latitude") - c[0], 2) + F.pow(F.col("longitude") - c[1], 2)
    return df.withColumns({n: F.exp(-d2(c) / (2 * width * width)) for n, c in zip(names, centres, strict=True)}), names


def smooth_design(knots: int, centres: Sequence[tuple[float, float]], width: float, period: float = 365.25) -> tuple[list[str], Design]:
    """The names of seasonal_basis and spatial_basis, and a function that makes them of (day of the year, latitude, longitude)."""
    names = [*(f"doy_{k}" for k in range(knots - 1)), *(f"space_{k}" for k in range(len(centres)))]
    at, y, x = (np.array(v, dtype=float) for v in ([k * period / knots for k in range(knots - 1)], [c[0] for c in centres], [c[1] for c in centres]))
    near = period / knots * 2

    def made(inputs: np.ndarray) -> np.ndarray:
        gap = np.abs(np.mod(inputs[:, :1] - at + period / 2, period) - period / 2)
        season = np.where(gap < near, (1 + np.cos(math.pi * gap / near)) / 2, 0.0)
        return np.hstack([season, np.exp(-((inputs[:, 1:2] - y) ** 2 + (inputs[:, 2:] - x) ** 2) / (2 * width * width))])

    return names, made


def quadratic(df: DataFrame, features: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """The features and their squares, as columns."""
    squares = {f"{f}_2": F.pow(F.col(f), 2) for f in features}
    return df.withColumns(squares), [*features, *squares]


def sweep(rows: DataFrame, keys: Sequence[str], features: Sequence[str], grid: Sequence[float] = (1, 2, 4, 8, 16, 32), rounds: int = 25) -> DataFrame:
    """Fits of every group for every ridge of the grid (column reg); all share one pass over the rows at a time."""
    return logistic_fits(rows, keys, features, ridge=[float(g) for g in grid], rounds=rounds)


def chosen(train: DataFrame, validation: DataFrame, species: DataFrame, features: Sequence[str], grid: Sequence[float] = (1, 2, 4, 8, 16, 32)) -> DataFrame:
    """Fits of all species with the ridge that serves a sample of them best: (species, reg, converged, rounds, b0, ...).

    train and validation have species, y and the features, species the sample.  The ridge is that of the largest mean auroc on
    the validation rows, of equal ones the smallest.
    """
    fits = Fits(train, ["species"], features, {"": (list(features), _columns(range(len(features))))})
    few = fits.of(list(grid), species)[""]
    asked = validation.select("species", "y", *features).join(F.broadcast(species), "species", "left_semi")
    scored = predicted(asked, few, ["species"], features, more=["reg"]).withColumnRenamed("predicted", "p")
    by = ranking(scored, ["reg", "species"]).groupBy("reg").agg(F.avg("auroc").alias("auroc"))
    best = by.orderBy(F.desc(F.round("auroc", 12)), "reg").first()  # a row a ridge of the grid
    reg = best.reg if best else float(min(grid))
    return fits.of([reg])[""]


def temperature(scored: DataFrame, low: float = -2.0, high: float = 2.0, steps: int = 80) -> DataFrame:
    """One row: the temperature of a logarithmic grid that minimises the cross-entropy of logit(p) / T, in one scan."""
    grid = F.array(*(F.lit(math.exp(low + (high - low) * i / steps)) for i in range(steps + 1)))
    z = logit(F.col("p")) / F.col("t")
    loss = F.greatest(z, F.lit(0.0)) - z * F.col("y") + F.log1p(F.exp(-F.abs(z)))
    small = scored.groupBy("p", "y").agg(F.count("*").alias("n"))
    by = small.withColumn("t", F.explode(grid)).groupBy("t").agg((F.sum(loss * F.col("n")) / F.sum("n")).alias("loss"))
    return by.agg(F.min_by("t", F.struct(F.round("loss", 12), F.col("t"))).alias("temperature"))


def calibrated(scored: DataFrame, temperature_row: DataFrame) -> DataFrame:
    return scored.crossJoin(F.broadcast(temperature_row)).withColumn("p", sigmoid(logit(F.col("p")), F.col("temperature"))).drop("temperature")
