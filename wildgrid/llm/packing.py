"""Variable-capacity best-fit packing of documents into training sequences.

The permitted sequence lengths are optimised jointly.  Pieces come in descending order and go to the open bin
that they leave fullest.  If none has room, a bin is opened: each permitted length that holds the piece is filled on trial
with the largest remaining pieces that still fit, and the length of the least cost for each token so placed is opened.  At the end each
bin is downsized to the smallest permitted length that holds its contents.  As a trial looks at one bin only, the same is done with one length
preferred throughout, for each of them, and the cheapest of these results stays.

Pieces are packed in groups of about `group`, so memory is bounded.  Groups are shards of a hash of id and size, and their
number follows from the number of documents, so the bins depend on the documents alone, not on partitions.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise

LENGTHS = (512, 1024, 2048, 4096)
#: Pieces packed together; a group loses at most one partly filled bin of each size.
GROUP = 20_000
#: Rows of one id and size that come to the same group.
COPIES = 1000
SCHEMA = "bin_id long, capacity int, used int, doc_ids array<long>, starts array<int>, sizes array<int>"


def default_cost(capacity: int) -> float:
    """A charge for each sequence, one for each of its tokens, and attention, which grows with the square."""
    return 16.0 + capacity + capacity * capacity / 32768


def downsized(used: int, lengths: Sequence[int], cost: Callable[[int], float]) -> int:
    """The permitted length of least cost that holds so many tokens."""
    return min((c for c in lengths if c >= used), key=lambda c: (cost(c), c))


def _best_fit(sizes: Sequence[int], opened: Callable[[int, Counter, int], int]) -> list[list[int]]:
    """Indices of sizes (descending) by bin; opened(size, left, there) is the bin size to open.

    left: how many pieces of each size are yet to come; there: bit n is set while some of size n are.
    """
    bins: list[list[int]] = []
    by_room: dict[int, list[int]] = {}
    rooms = there = 0  # bit r of rooms is set while a bin with room r is open
    left = Counter(sizes)
    for n in left:
        there |= 1 << n
    for i, n in enumerate(sizes):
        left[n] -= 1
        if not left[n]:
            there &= ~(1 << n)
        fit = rooms >> n
        if fit:
            room = n + (fit & -fit).bit_length() - 1
            held = by_room[room]
            b = held.pop()
            if not held:
                rooms &= ~(1 << room)
        else:
            b, room = len(bins), opened(n, left, there)
            bins.append([])
        bins[b].append(i)
        by_room.setdefault(room - n, []).append(b)
        rooms |= 1 << (room - n)
    return bins


def _trial(room: int, left: Counter, there: int) -> int:
    """Tokens of the largest remaining pieces that fit into room one after the other."""
    placed, taken = 0, Counter()
    there &= ~1  # empty pieces fill nothing
    while fit := there & ((1 << (room + 1)) - 1):
        n = fit.bit_length() - 1
        k = min(left[n] - taken[n], room // n)
        placed, room = placed + k * n, room - k * n
        taken[n] += k
        there &= ~(1 << n)
    return placed


def pack(sizes: Sequence[int], lengths: Sequence[int] = LENGTHS, cost: Callable[[int], float] = default_cost) -> list[tuple[int, list[int]]]:
    """(capacity, indices) of each bin for pieces of 0..max(lengths) tokens."""
    lengths = sorted(lengths)
    order = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))
    ranked = [sizes[i] for i in order]
    if not ranked:
        return []
    if ranked[0] > lengths[-1]:
        raise ValueError("a piece is longer than the largest permitted length")

    def least_cost(n: int, left: Counter, there: int) -> int:
        best = None
        for c in lengths:
            if c >= n:
                used = n + _trial(c - n, left, there)
                worth = cost(downsized(used, lengths, cost)) / max(used, 1), -c
                if best is None or worth < best[0]:
                    best = worth, c
        return best[1]

    def preferring(length: int) -> Callable[[int, Counter, int], int]:
        return lambda n, left, there: next(c for c in lengths if c >= max(n, length))

    results = []
    for opened in (least_cost, *map(preferring, lengths)):
        bins = []
        for b in _best_fit(ranked, opened):
            bins.append((downsized(sum(ranked[i] for i in b), lengths, cost), [order[i] for i in b]))
        results.append((sum(cost(c) for c, _ in bins), bins))
    return min(results, key=lambda x: x[0])[1]


def word_count(text: str = "text") -> Column:
    """Words of a text plus one for the separator; one for an empty or null text."""
    words = F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit("[^\\x20\\x09-\\x0D]+"))
    return words + 1


def best_fit_packing(docs: DataFrame, tokens: Column | None = None, lengths: Sequence[int] = LENGTHS, cost: Callable[[int], float] = default_cost, group: int = GROUP) -> DataFrame:
    """documents -> one row for each bin: bin_id, capacity, used, and doc_ids, starts and sizes of its pieces.

    tokens: tokens of each document (default: words plus a separator).  A document of more than the
    largest permitted length is cut into pieces of that length and a rest; starts are the pieces'
    first tokens.  Every row of docs is placed once: null ids stay null in doc_ids, repeated rows
    are packed as often as they come, a null or negative count is taken as 0 and needs no room.  An empty table has no bins;
    other columns of docs are not looked at.
    """
    lengths = sorted({int(c) for c in lengths})
    if not lengths or lengths[0] < 1:
        raise ValueError("permitted lengths must be positive")
    top = lengths[-1]
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.greatest(F.coalesce((word_count() if tokens is None else tokens).cast("long"), F.lit(0)), F.lit(0)).alias("n"))
    # Rows that agree are counted first, so that one id with a third of all rows is not one task's work.
    rows = materialise(sized.groupBy("doc_id", "n").agg(F.count("*").alias("k")), "sizes")
    shards = int(rows.agg(F.sum("k")).first()[0] or 0) // group + 1
    dealt = rows.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("k") - 1) / COPIES)))).select(
        F.pmod(F.xxhash64("doc_id", "n", "part"), F.lit(shards)).alias("shard"), "doc_id", "n", F.least(F.col("k") - F.col("part") * COPIES, F.lit(COPIES)).alias("k")
    )

    def packed(batches):
        shard, number = None, 0
        pieces: list[tuple[int | None, int, int]] = []

        def out():
            nonlocal pieces, number
            bins = pack([p[2] for p in pieces], lengths, cost)
            rows = [[pieces[i] for i in b] for _, b in bins]
            first = (shard << 32) + number
            pieces, number = [], number + len(bins)
            return pa.RecordBatch.from_arrays(
                [pa.array(range(first, first + len(bins)), pa.int64()), pa.array([c for c, _ in bins], pa.int32()), pa.array([sum(p[2] for p in r) for r in rows], pa.int32())]
                + [pa.array([[p[k] for p in r] for r in rows], pa.list_(t)) for k, t in ((0, pa.int64()), (1, pa.int32()), (2, pa.int32()))],
                names=["bin_id", "capacity", "used", "doc_ids", "starts", "sizes"],
            )

        for b in batches:
            for s, doc, n, k in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if s != shard:
                    if pieces:
                        yield out()
                    shard, number = s, 0
                for _ in range(k):
                    for start in range(0, max(n, 1), top):
                        pieces.append((doc, start, min(top, n - start)))
                        if len(pieces) == group:
                            yield out()
        if pieces:
            yield out()

    return dealt.repartition("shard").sortWithinPartitions("shard", "doc_id", "n", "k").mapInArrow(packed, SCHEMA)


def op1_query(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return best_fit_packing(table(spark, sf_dir, "documents").select("doc_id", "text"))
