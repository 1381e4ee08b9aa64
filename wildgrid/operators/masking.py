"""Masks of species states: which entries of the site-by-species table are hidden and scored.

Every draw is keyed by seed, site and species, so a mask does not depend on batches or partitions.
State: 0 absent, 1 present, 2 masked.  Labels of entries that are not scored are null.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.digests import heads
from ..functions.expr import uniform

#: Entries that a task works on at once.
HELD = 1 << 18


def states(sites: DataFrame, presence: DataFrame) -> DataFrame:
    """(site_id, states): of each site an array of (species, present) over the species in presence, absences included.

    Presences are gathered by site; the list of species, one row, is broadcast.  Nothing of the size sites times species is shuffled.
    """
    species = presence.agg(F.array_sort(F.collect_set("species")).alias("all"))
    here = presence.groupBy("site_id").agg(F.collect_set("species").alias("here"))
    every = sites.select("site_id").join(here, "site_id", "left").crossJoin(F.broadcast(species))
    there = lambda x: F.coalesce(F.array_contains("here", x), F.lit(False)).cast("int")
    return every.select("site_id", F.transform("all", lambda x: F.struct(x.alias("species"), there(x).alias("present"))).alias("states"))


def entries(sites: DataFrame, presence: DataFrame) -> DataFrame:
    """(site_id, species, present) with the absences, of sites and the species in presence."""
    return states(sites, presence).select("site_id", F.inline("states"))


def _marked(absences: bool):
    """Rows (site_id, states by species, rates, prefixes) -> (rate, site_id, species, present, masked): an entry is masked if its draw is below the rate."""

    def entries_of(batch):
        site, states, rates, prefixes = batch.columns
        ends = states.offsets.to_numpy()
        flat, ends = states.flatten(), ends - ends[0]
        codes = flat.field(0).dictionary_encode()
        index, names, present = codes.indices.to_numpy(), codes.dictionary.to_pylist(), flat.field(1).to_numpy()
        many = rates.flatten().to_numpy().reshape(len(batch), -1)
        keys = np.array(prefixes.flatten().to_pylist(), dtype=object).reshape(many.shape)
        lists: dict[bytes, list[int]] = {}
        for i in range(len(batch)):  # sites of one list of species together: most often all of them
            lists.setdefault(index[ends[i] : ends[i + 1]].tobytes(), []).append(i)
        for key, at in lists.items():
            all_, at = np.frombuffer(key, index.dtype), np.array(at)
            if not len(all_):
                continue
            here = present[ends[at][:, None] + np.arange(len(all_))]
            for k in range(many.shape[1]):
                top = np.ceil(many[at, k] * 2.0**32)
                hit = np.ones(here.shape, bool)
                if (top < 2.0**32).any():  # else all are masked, whatever is drawn
                    u = heads([x.encode() for x in keys[at, k]], [names[c].encode() for c in all_])
                    hit = (u < top[:, None]) | ((here == 0) if absences else False)
                    none = np.flatnonzero(~hit.any(axis=1))
                    hit[none, u[none].argmin(axis=1)] = True  # of equal draws that of the first species
                columns = [pa.array(np.repeat(many[at, k], len(all_))), site.take(pa.array(np.repeat(at, len(all_)))), codes.dictionary.take(pa.array(np.tile(all_, len(at)))), pa.array(here.ravel()), pa.array(hit.ravel())]
                yield pa.RecordBatch.from_arrays(columns, names=["rate", "site_id", "species", "present", "masked"])

    def marked(batches):
        for batch in batches:
            if batch.num_rows:
                step = max(1, HELD // max(1, pc.max(pc.list_value_length(batch.column(1))).as_py()))
                for i in range(0, batch.num_rows, step):
                    yield from entries_of(batch.slice(i, step))

    return marked


def _hidden(rows: DataFrame, seed: str, rates: Sequence[Column], salted: bool, absences: bool) -> DataFrame:
    """(rate, site_id, species, present, masked) of rows(site_id, states): draws and the rule of at least one are worked out within a site, for each rate."""
    prefix = lambda r: F.concat_ws("|", F.lit(seed), *([r.cast("string")] if salted else []), F.col("site_id").cast("string"), F.lit(""))
    given = rows.select("site_id", "states", F.array(*rates).alias("rates"), F.array(*map(prefix, rates)).alias("prefixes"))
    return given.mapInArrow(_marked(absences), f"rate double, site_id {rows.schema['site_id'].dataType.simpleString()}, species string, present int, masked boolean")


def _by_site(rows: DataFrame) -> DataFrame:
    """rows with states by species, gathered by site if they come as entries."""
    return rows if "states" in rows.columns else rows.groupBy("site_id").agg(F.array_sort(F.collect_list(F.struct("species", F.col("present").cast("int").alias("present")))).alias("states"))


def masked(rows: DataFrame, rate: Column | float, seed: str, absences: bool = False, token_share: float = 1.0) -> DataFrame:
    """states, or entries (site_id, species, present), with masked, state and label.

    An entry is masked if its draw is below the rate (a number, or an expression of site_id); absences: all absent ones are masked too.  A
    site with nothing masked gets its species of the least draw masked.  token_share: what part of the masked entries
    shows the mask, the rest shows its state.
    """
    rate = F.lit(float(rate)) if isinstance(rate, (int, float)) else rate.cast("double")
    out = _hidden(_by_site(rows), seed, [rate], False, absences)
    shown = F.lit(True) if token_share >= 1 else uniform(f"{seed}#token", F.col("site_id"), F.col("species")) < token_share
    return out.select("site_id", "species", "present", "masked", F.when(F.col("masked") & shown, 2).otherwise(F.col("present")).alias("state"), F.when(F.col("masked"), F.col("present")).alias("label"))


def mask_set(rows: DataFrame, rates: Sequence[float], seed: str, absences: bool = False) -> DataFrame:
    """masked() for each of several rates, with a salt of its own, in one job: a column rate tells them apart."""
    return _hidden(_by_site(rows), seed, [F.lit(float(r)) for r in rates], True, absences)
