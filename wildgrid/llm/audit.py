"""What quality filters remove, alone and in every order.

Identity of texts is settled by a counting-Bloom prepass: each task counts its texts' digests in a sketch, sketches are merged block by
block, and a text with a counter below two is the only one of its kind.  Only texts that may repeat are shuffled, whole, for the least
id of each.  All else is additive: documents are counted by part and mask of failed filters, and the figures of all orders
follow from those few counts.
"""

from __future__ import annotations

from itertools import permutations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import NO_ID, chunks, materialise, table, text_bytes

FILTERS = "ABCDE"
#: Counters of a text, counters for each text (at least), and counters of a block of the sketch.
HASHES, PER_TEXT, SLOTS = 4, 12, 1 << 14
#: Largest sketch: its bits are broadcast, 256 MB at most.  Beyond some 500 million texts fewer are cleared, and more are shuffled.
MOST = 1 << 31
#: Texts that a task counts before it passes its sketch on.
FLUSH = 1 << 20
_UPPER, _SIGNS = bytes(range(65, 91)), b"#$%&*|"


def failed(text: bytes, points: int) -> int:
    """Bits of the filters A to D that a text of so many code points fails."""
    words = text.split()
    few, repetitive = len(words) < 200, 100 * len(set(words)) < 50 * len(words)
    shouting, signs = 100 * (len(text) - len(text.translate(None, _UPPER))) > 3 * points, len(text.translate(None, _SIGNS)) < len(text)
    return few | repetitive << 1 | shouting << 2 | signs << 3


def counters_for(texts: int, most: int = MOST) -> int:
    """Counters of a sketch of so many texts: a power of two, a block at least."""
    return min(most, max(SLOTS, 1 << (PER_TEXT * texts - 1).bit_length() if texts else SLOTS))


def places(digests: list[bytes], counters: int) -> np.ndarray:
    """The counters of each digest, all different: a row of HASHES each."""
    h = np.frombuffer(b"".join(digests), "<u8").reshape(-1, 2)
    step = h[:, 1] | np.uint64(1)
    return (h[:, 0, None] + step[:, None] * np.arange(HASHES, dtype=np.uint64)[None, :]) & np.uint64(counters - 1)


def sketch(docs: DataFrame, counters: int) -> DataFrame:
    """(block, bits): the counters of two and more of each block that has any.  docs(text); a null text counts as empty."""
    names = ["block", "once", "more"]

    def packed(digests):
        at, n = np.unique(places(digests, counters), return_counts=True)
        block, slot = (at // SLOTS).astype(np.int64), (at % SLOTS).astype("<u2")
        blocks, first = np.unique(block, return_index=True)
        parts = [(slot[i:j], n[i:j] > 1) for i, j in zip(first, [*first[1:], len(at)], strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(blocks), pa.array([s[~m].tobytes() for s, m in parts], pa.binary()), pa.array([s[m].tobytes() for s, m in parts], pa.binary())], names=names)

    def counted(batches):
        held = []
        for b in batches:
            held += map(xxhash.xxh3_128_digest, text_bytes(b.column(0)))
            if len(held) >= FLUSH:
                yield packed(held)
                held = []
        if held:
            yield packed(held)

    def merged(batches):
        """Rows come sorted by block."""
        now, counts = None, np.zeros(SLOTS, np.uint8)

        def done():
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([np.packbits(counts > 1, bitorder="little").tobytes()], pa.binary())], names=["block", "bits"])

        for b in batches:
            for block, once, more in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if block != now:
                    if (counts > 1).any():
                        yield done()
                    now, counts[:] = block, 0
                counts[np.frombuffer(more, "<u2")] = 2
                once = np.frombuffer(once, "<u2")
                counts[once] = np.minimum(counts[once] + 1, 2)
        if (counts > 1).any():
            yield done()

    texts = docs.select(F.coalesce(docs["text"], F.lit("")).alias("text"))
    return texts.mapInArrow(counted, "block long, once binary, more binary").repartition("block").sortWithinPartitions("block").mapInArrow(merged, "block long, bits binary")


def flagged(docs: DataFrame, most: int = MOST) -> DataFrame:
    """(doc_id, part, mask): a row for each row of docs, with the bits of the filters that it fails; E is the fifth.

    A null text counts as empty and a null lang as the empty string.  A row without a doc_id fails E if any row with an id has its text;
    rows of the same id and text do not count against each other.
    """
    counters = counters_for(docs.count(), most)
    bits = bytearray(counters // 8)
    for r in sketch(docs, counters).collect():
        bits[r.block * SLOTS // 8 : (r.block + 1) * SLOTS // 8] = r.bits
    shared = docs.sparkSession.sparkContext.broadcast(bytes(bits))

    def judged(batches):
        repeated = np.frombuffer(shared.value, np.uint8)
        for b in chunks(batches):
            texts = text_bytes(b.column(1))
            points = pc.utf8_length(b.column(1)).to_pylist()
            digests = [xxhash.xxh3_128_digest(t) for t in texts]
            at = places(digests, counters)
            may = ((repeated[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1).all(axis=1)
            mask = pa.array([failed(t, n) for t, n in zip(texts, points, strict=True)], pa.int32())
            keep = [pa.array([x if m else None for x, m in zip(xs, may.tolist(), strict=True)], pa.binary()) for xs in (digests, texts)]
            keep[1] = keep[1].cast(pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), mask, *keep], names=["doc_id", "part", "mask", "digest", "text"])

    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"))
    rows = materialise(given.mapInArrow(judged, "doc_id long, part string, mask int, digest binary, text string"), "judged")
    id_ = F.coalesce("doc_id", F.lit(NO_ID))
    may = rows.where("digest is not null").withColumn("id", id_)
    first = may.groupBy("digest", "text").agg(F.min("id").alias("id")).select("id", "digest", F.lit(0).alias("repeat"))
    again = may.drop("text").join(first, ["id", "digest"], "left").withColumn("mask", F.col("mask").bitwiseOR(F.coalesce("repeat", F.lit(16))))
    return rows.where("digest is null").select("doc_id", "part", "mask").union(again.select("doc_id", "part", "mask"))


def mask_counts(docs: DataFrame, labels: DataFrame, most: int = MOST) -> DataFrame:
    """(part, mask, n, good, toxic): documents by part and failed filters, and how many of them are labelled good or toxic.

    Of several labels of an id any one counts; a document without an id or label is neither.
    """
    known = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max((F.col("quality") == 1).cast("long")).alias("good"), F.max((F.col("toxic") == 1).cast("long")).alias("toxic"))
    rows = flagged(docs, most).join(materialise(known, "labels"), "doc_id", "left")
    return rows.groupBy("part", "mask").agg(F.count("*").alias("n"), *(F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in ("good", "toxic")))


def interactions(counts: DataFrame) -> DataFrame:
    """What each filter removes at each step of each order, from (part, mask, n, good, toxic).

    (part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley).  A part has 32 counts at most.
    """
    orders = F.array(*(F.lit("".join(p)) for p in permutations(FILTERS)))
    cells = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))
    rows = cells.select("part", "cells", F.explode(orders).alias("filter_order")).select("*", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))).alias("step"))
    bit = lambda j: F.element_at(F.array(*(F.lit(1 << i) for i in range(len(FILTERS)))), F.ascii(F.substring("filter_order", j, 1)) - ord("A") + 1)
    upto = sum((F.when(F.col("step") >= j, bit(j)).otherwise(0) for j in range(1, len(FILTERS) + 1)), F.lit(0))
    own = F.coalesce(*(F.when(F.col("step") == j, bit(j)) for j in range(1, len(FILTERS) + 1)))
    rows = rows.withColumn("upto", upto).withColumn("own", own)

    def total(what: str, when) -> Column:
        return F.aggregate("cells", F.lit(0).cast("long"), lambda a, x: a + F.when(when(x["mask"]), x[what]).otherwise(F.lit(0)))

    def here(what: str) -> Column:
        before = F.col("upto") - F.col("own")
        return total(what, lambda m: (m.bitwiseAND(before) == 0) & (m.bitwiseAND(F.col("own")) != 0))

    share = F.aggregate("cells", F.lit(0).cast("long"), lambda a, x: a + F.when(x["mask"].bitwiseAND(F.col("own")) != 0, x["n"] * (120 / F.bit_count(x["mask"])).cast("long")).otherwise(F.lit(0)))
    out = rows.select("*", here("n").alias("removed"))
    return out.select(
        "part", "filter_order", "step", total("n", lambda m: m.bitwiseAND(F.col("upto")) == 0).alias("kept"), "removed",
        (total("n", lambda m: m.bitwiseAND(F.col("own")) != 0) - F.col("removed")).alias("redundant"), total("n", lambda m: m == F.col("own")).alias("unique_fails"),
        here("good").alias("good_lost"), here("toxic").alias("toxic_lost"), share.alias("shapley"),
    )


def op11_query(spark, sf_dir: str) -> DataFrame:
    return interactions(mask_counts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


OP11_SQL = r"""
WITH words AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
flags AS (
  SELECT doc_id, part, CAST(len(w) < 200 AS INT) + 2 * CAST(100 * len(list_distinct(w)) < 50 * len(w) AS INT)
    + 4 * CAST(100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text) AS INT) + 8 * CAST(regexp_matches(text, '[#$%&*|]') AS INT)
    + 16 * CAST(doc_id > min(doc_id) OVER (PARTITION BY text) AS INT) AS mask
  FROM words),
known AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
counts AS (SELECT part, mask, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(toxic), 0) AS toxic FROM flags LEFT JOIN known USING (doc_id) GROUP BY part, mask),
letters AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) x(c, b)),
orders AS (
  SELECT a.c || b.c || c.c || d.c || e.c AS filter_order, [a.b, b.b, c.b, d.b, e.b] AS bits
  FROM letters a, letters b, letters c, letters d, letters e WHERE a.b + b.b + c.b + d.b + e.b = 31 AND len(list_distinct([a.b, b.b, c.b, d.b, e.b])) = 5),
steps AS (SELECT filter_order, step, bits[step] AS own, list_sum(bits[1:step]) AS upto FROM orders, range(1, 6) s(step)),
sums AS (
  SELECT part, filter_order, step, own, sum(CASE WHEN mask & CAST(upto AS INT) = 0 THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN mask & CAST(upto - own AS INT) = 0 AND mask & own <> 0 THEN n ELSE 0 END) AS removed, sum(CASE WHEN mask & own <> 0 THEN n ELSE 0 END) AS fails,
    sum(CASE WHEN mask = own THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN mask & CAST(upto - own AS INT) = 0 AND mask & own <> 0 THEN good ELSE 0 END) AS good_lost,
    sum(CASE WHEN mask & CAST(upto - own AS INT) = 0 AND mask & own <> 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM counts, steps GROUP BY part, filter_order, step, own)
SELECT part, filter_order, CAST(step AS INT) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(fails - removed AS BIGINT) AS redundant,
  CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley
FROM sums
"""
