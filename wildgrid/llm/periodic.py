"""Runs: maximal stretches of a word sequence that repeat with a period, and texts with the repeats collapsed.

An enhanced suffix array answers it without a tree.  A branching tandem repeat is a square at i with period d whose two halves part right
behind it: suffixes i and i + d have exactly d words in common.  So for each value d of the LCP array, the suffixes on the
smaller side of it (within the stretch of the suffix array where no value is less) look up whether i + d or i - d stands on the other
side.  Each such square is the last one of its run: rotated to the left as far as words agree, it gives the run.

Squares need repeated words, so only stretches of a text covered by repeated shingles of six words go into the suffix array: of a run
of twelve words or more every word is covered.  The stretches of a batch share one suffix array, kept apart by their numbers.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, ids_and_texts, text_bytes

#: Words of the shortest run, and of the shingles that cover it: half as many.
LEAST = 12
#: Positions of the suffix array that are looked at together.
AT_ONCE = 1 << 20


class _Numbers(dict):
    """A number for each word, in order of their coming."""

    def __missing__(self, word):
        self[word] = n = len(self)
        return n


def covered(words: np.ndarray, texts: np.ndarray, width: int) -> np.ndarray:
    """Which words lie in a shingle of `width` words that stands twice or more in its text (or seems so, by its hash).

    words, texts: the number of each word and of its text; texts stand one after the other.
    """
    n = len(words) - width + 1
    out = np.zeros(len(words), bool)
    if n < 2:
        return out
    h = texts[:n].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for j in range(width):
        h = (h ^ words[j : j + n].astype(np.uint64)) * np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
    whole = np.flatnonzero(texts[:n] == texts[width - 1 :])
    order = whole[np.argsort(h[whole], kind="stable")]
    same = h[order[1:]] == h[order[:-1]]
    hit = np.zeros(len(order), bool)
    hit[1:] |= same
    hit[:-1] |= same
    edges = np.zeros(len(words) + 1, np.int64)
    starts = order[hit]
    edges[starts] += 1  # each start comes once
    edges[starts + width] -= 1
    return np.cumsum(edges[:-1]) > 0


def suffix_array(words: np.ndarray, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Suffix array and its inverse over texts kept apart, and the ranks of all starts by 1, 2, 4, ... words.

    A suffix ends with its text.  Ranks are numbers of groups by their first place; only groups of several are split further.
    """
    n = len(words)
    _, key = np.unique(texts.astype(np.int64) * (int(words.max()) + 1) + words, return_inverse=True)
    sa = np.argsort(key, kind="stable")
    sorted_ = key[sa]
    head = np.flatnonzero(np.concatenate([[True], sorted_[1:] != sorted_[:-1]]))
    rank = np.empty(n, np.int32)
    rank[sa] = np.repeat(head, np.diff([*head, n])).astype(np.int32)
    levels, k = [rank], 1
    end = np.searchsorted(texts, texts, side="right")  # where the text of each word ends
    while True:
        sizes = np.bincount(rank, minlength=n)
        open_ = np.flatnonzero(sizes[rank[sa]] > 1)  # places of the suffix array whose group has several
        if not len(open_):
            break
        at = sa[open_]
        ahead = at + k
        second = np.where(ahead < end[at], rank[np.minimum(ahead, n - 1)], -1).astype(np.int64)
        first = rank[at].astype(np.int64)
        both = first * (n + 1) + second + 1
        order = np.argsort(both, kind="stable")
        at, both, first = at[order], both[order], first[order]
        sa[open_] = at  # groups keep their places: open places are in order of their group
        new = np.concatenate([[True], both[1:] != both[:-1]])
        place = np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))
        rank = rank.copy()
        rank[at] = open_[place]
        levels.append(rank)
        k *= 2
    inverse = np.empty(n, np.int64)
    inverse[sa] = np.arange(n)
    return sa, inverse, levels


def common(a: np.ndarray, b: np.ndarray, levels: list[np.ndarray], end: np.ndarray) -> np.ndarray:
    """Words that the suffixes at a and b have in common."""
    a, b, out = a.copy(), b.copy(), np.zeros(len(a), np.int64)
    n = len(end)
    for k in range(len(levels) - 1, -1, -1):
        ok = np.flatnonzero((a < n) & (b < n))
        i, j = a[ok], b[ok]
        ok = ok[(i + 2**k <= end[i]) & (j + 2**k <= end[j]) & (levels[k][i] == levels[k][j])]
        a[ok] += 2**k
        b[ok] += 2**k
        out[ok] += 2**k
    return out


def smaller_around(lcp: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """For each k: the last place before it with a smaller value, and the first after it with one as small or smaller."""
    before, after, stack = [-1] * len(lcp), [len(lcp)] * len(lcp), []
    for k, v in enumerate(lcp):
        while stack and lcp[stack[-1]] >= v:
            after[stack.pop()] = k
        if stack:
            before[k] = stack[-1]
        stack.append(k)
    return np.array(before, np.int64), np.array(after, np.int64)


def branching_squares(sa: np.ndarray, inverse: np.ndarray, lcp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, period) of all squares whose halves are followed by different words or an end.  lcp[k] is that of sa[k - 1] and sa[k]."""
    n = len(sa)
    before, after = smaller_around(lcp.tolist())
    k = np.flatnonzero(lcp > 0)
    low, high, depth = before[k], after[k], lcp[k]  # left side: places low .. k - 1, right side: k .. high - 1
    left = k - low <= high - k
    first, size = np.where(left, low, k), np.where(left, k - low, high - k)
    other_first, other_end = np.where(left, k, low), np.where(left, high, k)
    starts, periods = [], []
    upto = np.cumsum(size)
    done = 0
    while done < len(k):
        till = max(done + 1, int(np.searchsorted(upto, (upto[done - 1] if done else 0) + AT_ONCE, side="right")))
        part = slice(done, till)
        of = np.repeat(np.arange(done, till), size[part])
        offset = np.arange(len(of)) - np.repeat(np.cumsum(size[part]) - size[part], size[part])
        i, d = sa[first[of] + offset], depth[of]
        for other, start in ((i + d, i), (i - d, i - d)):
            fits = np.flatnonzero((other >= 0) & (other < n))
            place = inverse[other[fits]]
            hit = fits[(place >= other_first[of[fits]]) & (place < other_end[of[fits]])]
            starts.append(start[hit])
            periods.append(d[hit])
        done = till
    return np.concatenate(starts or [np.empty(0, np.int64)]), np.concatenate(periods or [np.empty(0, np.int64)])


def _rotated(words: np.ndarray, low: int, start: int, period: int) -> int:
    """The start of the run of a square: rotated to the left while words agree, down to low."""
    width = 16
    while start > low:
        step = min(width, start - low)
        differ = np.flatnonzero(words[start - step : start] != words[start - step + period : start + period])
        if len(differ):
            return start - step + int(differ[-1]) + 1
        start -= step
        width *= 2
    return start


def runs_of(words: np.ndarray, texts: np.ndarray, least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of `least` words or more within each text, sorted.

    words, texts: numbers of words and of their texts, which stand one after the other; starts count from the first word of all.
    """
    kept = covered(words, texts, least // 2)
    if not kept.any():
        return []
    for _ in range(2):  # a shingle must repeat within its stretch
        at = np.flatnonzero(kept)
        new = np.concatenate([[True], (np.diff(at) > 1) | (texts[at[1:]] != texts[at[:-1]])])
        part = np.cumsum(new) - 1
        inside = covered(words[at], part, least // 2)
        kept = np.zeros(len(words), bool)
        kept[at[inside]] = True
    at = np.flatnonzero(kept)
    if len(at) < least:
        return []
    part = np.cumsum(np.concatenate([[True], (np.diff(at) > 1) | (texts[at[1:]] != texts[at[:-1]])])) - 1
    long_ = np.bincount(part)[part] >= least
    at, part = at[long_], part[long_]
    if not len(at):
        return []
    part = np.cumsum(np.concatenate([[True], part[1:] != part[:-1]])) - 1
    own = np.unique(words[at], return_inverse=True)[1].astype(np.int64)
    sa, inverse, levels = suffix_array(own, part)
    first, end = np.searchsorted(part, part, side="left"), np.searchsorted(part, part, side="right")
    lcp = np.concatenate([[0], common(sa[:-1], sa[1:], levels, end)])
    start, period = branching_squares(sa, inverse, lcp)
    stop = start + 2 * period
    out, last, held = [], -1, []
    for k in np.lexsort((period, stop)).tolist():
        s, d, e = int(start[k]), int(period[k]), int(stop[k])
        if e != last:
            last, held = e, []
        if any(d % q == 0 and begun <= s for q, begun in held):
            continue  # a power of a shorter period
        begun = _rotated(own, int(first[s]), s, d)
        held.append((d, begun))
        if e - begun >= least:
            out.append((int(at[begun]), e - begun, d))
    return sorted(set(out))


def period_fixture(doc_id: int | None, n: int) -> tuple[int, int] | None:
    """(a, p): from word a on the words of this document repeat with period p; None: the text stays."""
    if doc_id is None or not n:
        return None
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return None
    g = h // 10
    return (a := g % n), 1 + (n - a) // (3 + g % 8)


def collapse(batches: Iterable[pa.RecordBatch], fixture: bool):
    """Batches (doc_id, text) -> batches (doc_id, runs, collapsed, n_words)."""
    numbers = _Numbers()
    for b in chunks(batches):
        if len(numbers) > 1 << 20:
            numbers.clear()
        texts, lengths, ids = [], [], b.column(0).to_pylist()
        for doc_id, text in zip(ids, text_bytes(b.column(1)), strict=True):
            words = text.split()
            if fixture and (change := period_fixture(doc_id, len(words))):
                a, p = change
                words[a:] = (words[a : a + p] * (len(words) // p + 1))[: len(words) - a]
            texts.append(words)
            lengths.append(len(words))
        flat = np.fromiter(map(numbers.__getitem__, chain.from_iterable(texts)), np.int64, sum(lengths))
        first = np.concatenate([[0], np.cumsum(lengths)])
        found = [[] for _ in texts]
        for s, length, period in runs_of(flat, np.repeat(np.arange(len(texts)), lengths)):
            d = int(np.searchsorted(first, s, side="right")) - 1
            found[d].append((s - int(first[d]), length, period))
        out = []
        for words, runs in zip(texts, found, strict=True):
            if runs:
                keep = np.ones(len(words), bool)
                for s, length, period in runs:
                    keep[s + period : s + length] = False
                words = [words[i] for i in np.flatnonzero(keep).tolist()]
            out.append(b" ".join(words))
        rows = pa.array([[{"start": s, "length": n, "period": q} for s, n, q in runs] for runs in found], pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])))
        yield pa.RecordBatch.from_arrays([b.column(0), rows, pa.array(out, pa.binary()).cast(pa.string()), pa.array(lengths, pa.int64())], names=["doc_id", "runs", "collapsed", "n_words"])


def periodic_runs(docs: DataFrame, fixture: bool = False) -> DataFrame:
    """documents -> (doc_id, runs array<struct<start, length, period>>, collapsed, n_words), a row for each row.

    Runs are sorted by start and period; of each run only its first period stays in the collapsed text, whose words are joined by one space.
    A null or blank text has no words and no runs.  fixture: texts of a tenth of the ids first get a periodic end (see period_fixture);
    rows without an id keep their text.
    """
    return ids_and_texts(docs).mapInArrow(lambda batches: collapse(batches, fixture), "doc_id long, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string, n_words long")


def op12_query(spark, sf_dir: str) -> DataFrame:
    from .common import table

    out = periodic_runs(table(spark, sf_dir, "documents"), fixture=True)
    longest = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("negative"), r["start"].alias("start"), r["period"].alias("period"))))
    best = F.struct(F.col("longest.start"), (-F.col("longest.negative")).alias("length"), F.col("longest.period"))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string"))), "\n")
    listed = F.concat(lines, F.when(F.size("runs") > 0, "\n").otherwise(""))
    return out.withColumn("longest", longest).withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), F.col("best.length").alias("length"), F.col("best.period").alias("period"),
        F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"), F.sha2(listed.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
