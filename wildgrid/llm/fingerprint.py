"""Document fingerprints: a quartile bucket digest.

Byte triplets are hashed into 256 buckets by three fixed tables; of each bucket's count only its
quartile is kept (two bits), with the length on a logarithmic scale in front.  Digests are compared
by a score between 0 (unlike) and 1 (alike).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NO_ID, chunks, ids_and_texts, partitions, text_bytes

BUCKETS = 256
#: A difference of so much, or more, is a likeness of zero: about what two unrelated digests have.
BOUND = 420
#: Lengths are told apart in steps of this factor; a step counts as so much difference.
STEP, STEP_COST = 1.1, 4


def _tables() -> np.ndarray:
    """Three tables of 256 bytes from a fixed rule: bits of splitmix64 of the position."""
    x = np.arange(1, 769, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (x >> np.uint64(56)).astype(np.uint8).reshape(3, 256)


TABLES = _tables()


def digest(text: bytes) -> str:
    """520 bits in hex: the length's step (8 bits), then the quartile of each bucket (2 bits)."""
    if len(text) > 2:
        b = np.frombuffer(text, np.uint8)
        counts = np.bincount(TABLES[0][b[:-2]] ^ TABLES[1][b[1:-1]] ^ TABLES[2][b[2:]], minlength=BUCKETS)
        q = np.partition(counts, (63, 127, 191))[[63, 127, 191]]
        code = (counts > q[0]).astype(np.uint8) + (counts > q[1]) + (counts > q[2])
    else:
        code = np.zeros(BUCKETS, np.uint8)
    step = min(255, int(np.log(len(text)) / np.log(STEP))) if text else 0
    packed = code.reshape(-1, 4) @ np.array([64, 16, 4, 1], np.uint8)
    return f"{step:02x}{packed.astype(np.uint8).tobytes().hex()}"


def _codes(digests: list[str]) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(bytes.fromhex("".join(digests)), np.uint8).reshape(len(digests), 1 + BUCKETS // 4)
    return raw[:, 0].astype(np.int32), np.stack([raw[:, 1:] >> s & 3 for s in (6, 4, 2, 0)], axis=2).reshape(len(digests), -1).astype(np.int8)


def difference(left: list[str], right: list[str]) -> np.ndarray:
    """Steps between quartiles (the whole way counts double), and between lengths."""
    if not left:
        return np.zeros(0, np.int64)
    (a, x), (b, y) = _codes(left), _codes(right)
    gap = np.abs(x - y)
    return np.where(gap == 3, 6, gap).sum(axis=1) + STEP_COST * np.abs(a - b)


def likeness(left: list[str], right: list[str]) -> np.ndarray:
    return 1.0 - np.minimum(difference(left, right), BOUND) / BOUND


def fingerprints(docs: DataFrame) -> DataFrame:
    """documents -> (doc_id, fingerprint), a row for each row; null texts count as empty."""

    def made(batches):
        for b in chunks(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([digest(t) for t in text_bytes(b.column(1))], pa.string())], names=["doc_id", "fingerprint"])

    return ids_and_texts(docs).mapInArrow(made, "doc_id long, fingerprint string")


def with_successors(docs: DataFrame, slices: int | None = None) -> DataFrame:
    """(part, ghost, doc_id, text), dealt and sorted so that each text is followed by the next document's.

    The ids are cut at quantiles into slices (a few for each shuffle partition); the first row of a slice
    comes once more as the ghost at the end of the slice before, and the first of all at the end of the last.
    Missing ids come last; rows that share an id are in order of a hash of their text, and an id with more rows than a slice
    holds is cut by that hash.
    """
    spark = docs.sparkSession
    slices = slices or 8 * partitions(spark)
    given = ids_and_texts(docs).withColumn("order", F.coalesce("doc_id", F.lit(NO_ID))).withColumn("tie", F.xxhash64("text"))
    quantiles = [min(int(x), NO_ID) for x in given.approxQuantile("order", [i / slices for i in range(1, slices)], 1 / (4 * slices))] if slices > 1 else []
    cuts = sorted(set(quantiles))
    parts = [1, *(quantiles.count(c) + 1 for c in cuts)]  # of each stretch of ids: as many for its first id as that is a quantile, and one for the rest
    first = [sum(parts[:i]) for i in range(len(parts))]

    def part_of(order: np.ndarray, tie: np.ndarray) -> np.ndarray:
        at = np.searchsorted(np.array(cuts, np.int64), order, side="right")
        same = (at > 0) & (order == np.array([0, *cuts], np.int64)[at])
        many = np.array(parts, np.int64)[at] - 1
        share = (tie.astype(np.float64) / 2.0**64 + 0.5) * many
        return (np.array(first, np.int64)[at] + np.where(same, np.clip(share.astype(np.int64), 0, np.maximum(many - 1, 0)), many)).astype(np.int32)

    def numbered(batches):
        """The first row of each slice in a batch."""
        for b in batches:
            order, tie = b.column(0).to_numpy(), b.column(1).to_numpy()
            part = part_of(order, tie)
            at = np.lexsort((tie, order, part))
            at = at[np.r_[True, part[at][1:] != part[at][:-1]]] if len(at) else at
            yield pa.RecordBatch.from_arrays([pa.array(x[at]) for x in (part, order, tie)], names=["part", "order", "tie"])

    lowest = given.select("order", "tie").mapInArrow(numbered, "part int, order long, tie long").groupBy("part").agg(F.min(F.struct("order", "tie")).alias("head")).orderBy("part")
    heads = [(r.part, tuple(r["head"])) for r in lowest.collect()]  # one row a slice
    before = {head: heads[i - 1][0] for i, (_, head) in enumerate(heads)}
    schema = "part int, ghost boolean, doc_id long, order long, tie long, text string"

    def dealt(batches):
        for b in chunks(batches):
            order, tie = b.column(2).to_numpy(), b.column(3).to_numpy()
            own = part_of(order, tie)
            again = [(i, before[k]) for i, k in enumerate(zip(order.tolist(), tie.tolist(), strict=True)) if k in before]
            at = pa.array([*range(b.num_rows), *(i for i, _ in again)], pa.int64())
            slots = pa.array(np.r_[own, np.array([p for _, p in again], np.int32)])
            yield pa.RecordBatch.from_arrays([slots, pa.array([False] * b.num_rows + [True] * len(again)), *(b.column(i).take(at) for i in (0, 2, 3, 1))], names=["part", "ghost", "doc_id", "order", "tie", "text"])

    return given.select("doc_id", "text", "order", "tie").mapInArrow(dealt, schema).repartition("part").sortWithinPartitions("part", "ghost", "order", "tie", "text").drop("order", "tie")


def edited_fingerprints(docs: DataFrame, slices: int | None = None) -> DataFrame:
    """documents -> (doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next).

    The edited text has the last quarter of the code points replaced by as many from the start of the next
    document (all of it if it has fewer).  Null texts count as empty; a sole document follows itself; of rows
    that share an id, the next is the next row by a hash of the text.  Other columns of documents are not looked at.
    """
    import hashlib

    def made(batches):
        part, held = None, None
        for b in chunks(batches):
            rows: list[tuple] = []
            for p, ghost, doc, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if p == part and held is not None:
                    rows.append((*held, text))
                part, held = p, None if ghost else (doc, text)
            if rows:
                edited = [t[: len(t) - len(t) // 4] + n[: len(t) // 4] for _, t, n in rows]
                own, changed, after = ([digest(t.encode()) for t in x] for x in ([r[1] for r in rows], edited, [r[2] for r in rows]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[0] for r in rows], pa.int64()), pa.array([len(r[1]) for r in rows], pa.int64()), pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited])]
                    + [pa.array(own), pa.array(changed), pa.array(likeness(own, changed)), pa.array(likeness(own, after))],
                    names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
                )

    return with_successors(docs, slices).mapInArrow(made, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def op2_query(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return edited_fingerprints(table(spark, sf_dir, "documents"))
