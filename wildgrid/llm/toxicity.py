"""Toxicity by compression distance.

There are two zstandard dictionaries, one of toxic and one of ordinary text.  Each window of a text (a word with its borders) is
compressed with both; a window that the toxic dictionary shortens more is evidence.  A primer
that both dictionaries hold stands before and after each window: so the input is coded with matches anyway and the
lengths show the window's own cost, and the compressor, which seeks no match in the last bytes, sees all of it.  How many windows differ by how much is calibrated to a
probability by a logistic fit on the labelled documents.

The content of each dictionary is what its class's labelled documents have more often than the other's: dictionaries that the library's trainer, or
raw text, gives from each class alone hold mostly what the classes share, and tell them apart poorly (README has the figures, also of
windows of several words).

Fitting uses a bounded sample of labelled rows (`per_class` of each label, chosen by a hash of the
id); scoring is one pass over all whole texts without a shuffle.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import chunks, ids_and_texts, materialise, text_bytes

#: Labelled documents of each class that the fit may look at.
PER_CLASS = 1500
#: Bytes of the toxic and the ordinary dictionary.
TOXIC_BYTES, ORDINARY_BYTES = 1000, 3000
#: A score from here on is a prediction of toxic.
THRESHOLD = 0.3
#: A piece must tell the classes apart by so much (the sample's size times difference and log ratio of the shares), else it is chance.
EVIDENCE = 12.0
PRIMER = bytes(range(200, 216))
#: Lengths of the pieces that dictionaries are made of.
PIECES = range(4, 11)
STEPS = range(1, 9)
_MEMORY = 300_000


def windows(text: bytes) -> list[bytes]:
    return [b" " + w + b" " for w in text.lower().split()]


def dictionary(pieces: list[bytes], size: int) -> bytes:
    """Pieces in order of their worth, the best last (nearest to the window), each once; then the primer."""
    out = b""
    for piece in pieces:
        if piece not in out:
            out = piece + out
            if len(out) > size:
                break
    return out + PRIMER


@lru_cache(maxsize=8)
def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    params = zstandard.ZstdCompressionParameters.from_level(19, window_log=15, write_content_size=False, write_checksum=False, write_dict_id=False)
    trained = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    trained.precompute_compress(compression_params=params)
    return zstandard.ZstdCompressor(dict_data=trained, compression_params=params)


@dataclass
class Model:
    toxic: bytes = PRIMER
    ordinary: bytes = PRIMER
    mean: np.ndarray = field(default_factory=lambda: np.zeros(FEATURES))
    scale: np.ndarray = field(default_factory=lambda: np.ones(FEATURES))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(FEATURES + 1))

    def features(self, texts: list[bytes], known: dict[bytes, int]) -> np.ndarray:
        """Of each text: how many windows, and what part, the toxic dictionary shortens by so many bytes more; and the largest differences."""
        toxic, ordinary = _compressor(self.toxic).compress, _compressor(self.ordinary).compress
        out = np.zeros((len(texts), FEATURES))
        for i, t in enumerate(texts):
            found = windows(t)
            for w in set(found).difference(known):
                known[w] = len(ordinary(PRIMER + w + PRIMER)) - len(toxic(PRIMER + w + PRIMER))
            if found:
                gain = np.sort(np.array([known[w] for w in found]))
                counts = len(gain) - np.searchsorted(gain, STEPS)
                out[i] = [*np.log1p(counts), *np.sqrt(counts / len(gain)), gain.mean(), gain[-1], gain[-3:].mean(), gain[-8:].mean()]
            if len(known) > _MEMORY:
                known.clear()
        return out

    def score(self, texts: list[bytes], known: dict[bytes, int]) -> np.ndarray:
        x = (self.features(texts, known) - self.mean) / self.scale
        return 1 / (1 + np.exp(-np.clip(x @ self.weights[1:] + self.weights[0], -30, 30)))


FEATURES = 2 * len(STEPS) + 4


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> np.ndarray:
    x = np.hstack([np.ones((len(x), 1)), x])
    w = np.zeros(x.shape[1])
    penalty = ridge * np.eye(len(w))
    penalty[0, 0] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x.T * (weight * p * (1 - p))) @ x + penalty, x.T @ (weight * (y - p)) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def held_out(doc_id: str | Column = "doc_id") -> Column:
    """Whether a document's label may not be used: crc32 of the id's digits leaves 2 modulo 4."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _pieces(batches):
    """(piece, k, n): in how many texts of class and half k = 2 * toxic + half each piece occurs, added up by chunk."""
    for b in chunks(batches, size=1 << 19):
        counts: Counter = Counter()
        for text, k in zip(text_bytes(b.column(0)), b.column(1).to_pylist(), strict=True):
            counts.update((k, p) for p in {w[i : i + n] for w in set(windows(text)) for n in PIECES for i in range(len(w) - n + 1)})
        yield pa.RecordBatch.from_arrays([pa.array([p for _, p in counts], pa.binary()), pa.array([k for k, _ in counts], pa.int32()), pa.array(counts.values(), pa.int64())], names=["piece", "k", "n"])


def _dictionary(pieces: DataFrame, own: Column, n_own: int, other: Column, n_other: int, size: int) -> bytes:
    """The pieces that are more frequent in own than in other texts, ranked by the difference and ratio of shares."""
    p, q = (own + 0.5) / (n_own + 1), (other + 0.5) / (n_other + 1)
    worth = (p - q) * F.log(p / q)
    ranked = pieces.where(own >= 3).where(p > q).where(n_own * worth >= EVIDENCE).select("piece", F.round(worth, 9).alias("r")).orderBy(F.desc("r"), "piece").limit(2 * size)
    return dictionary([bytes(r.piece) for r in ranked.collect()], size)


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model:
    """Train on at most per_class documents of each label, none of them held out.

    The sample is halved by a hash of the id: dictionaries of one half are tried on the other, which gives the features
    of the calibration, and those of both halves go into the model.  Counting pieces and compressing is done by
    tasks; the driver sees the best pieces and a row of features for each document of the sample.  Labels other than 0 and 1, labels of
    documents that are not there, and repeated ones (the largest counts) do no harm; with fewer than four
    documents in a class, every score is the share of toxic labels, or 0 without any.
    """
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).where(~held_out()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    share = {r.toxic: r["count"] for r in known.groupBy("toxic").count().collect()}
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = known.where("toxic = 1").orderBy(*order).limit(per_class).union(known.where("toxic = 0").orderBy(*order).limit(per_class))
    # At most 2 * per_class ids, so the broadcast is bounded.
    rows = ids_and_texts(docs).join(F.broadcast(chosen.withColumnRenamed("doc_id", "_id")), F.col("doc_id") == F.col("_id"))
    sample = materialise(rows.select("text", (2 * F.col("toxic") + F.pmod(F.xxhash64("doc_id", F.lit("half")), F.lit(2))).cast("int").alias("k")), "sample")
    sizes = [0, 0, 0, 0]
    for r in sample.groupBy("k").count().collect():
        sizes[r.k] = r["count"]
    n_ordinary, n_toxic = share.get(0, 0), share.get(1, 0)
    if min(sizes[0] + sizes[1], sizes[2] + sizes[3]) < 4 or not all(sizes):
        p = min(max(n_toxic / max(1, n_toxic + n_ordinary), 1e-9), 1 - 1e-9)
        model = Model()
        model.weights[0] = math.log(p / (1 - p))
        return model
    counts = sample.mapInArrow(_pieces, "piece binary, k int, n long").groupBy("piece").agg(*(F.coalesce(F.sum(F.when(F.col("k") == k, F.col("n"))), F.lit(0)).alias(f"c{k}") for k in range(4)))
    counts = materialise(counts.where("c0 + c1 >= 3 or c2 + c3 >= 3"), "pieces")

    def model_of(halves: list[int]) -> Model:
        ordinary, toxic = (sum((F.col(f"c{2 * c + h}") for h in halves), F.lit(0)) for c in (0, 1))
        n0, n1 = (sum(sizes[2 * c + h] for h in halves) for c in (0, 1))
        return Model(_dictionary(counts, toxic, n1, ordinary, n0, TOXIC_BYTES), _dictionary(counts, ordinary, n0, toxic, n1, ORDINARY_BYTES))

    trial = {h: model_of([1 - h]) for h in (0, 1)}

    def features(batches):
        known: dict[int, dict[bytes, int]] = {0: {}, 1: {}}
        for b in chunks(batches):
            ks = b.column(1).to_pylist()
            x = [trial[k % 2].features([t], known[k % 2])[0].tolist() for t, k in zip(text_bytes(b.column(0)), ks, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(ks, pa.int32()), pa.array(x, pa.list_(pa.float64()))], names=["k", "x"])

    found = sorted((r.k, r.x) for r in sample.mapInArrow(features, "k int, x array<double>").collect())
    x, y = np.array([x for _, x in found]), np.array([k // 2 for k, _ in found], float)
    model = model_of([0, 1])
    model.mean, model.scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    weight = np.where(y == 1, n_toxic / y.sum(), n_ordinary / (1 - y).sum())
    model.weights = _logistic((x - model.mean) / model.scale, y, weight * len(y) / weight.sum())
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of every row; a null text counts as empty."""

    def run(batches):
        known: dict[bytes, int] = {}
        for b in chunks(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.score(text_bytes(b.column(1)), known))], names=["doc_id", "score"])

    return ids_and_texts(docs).mapInArrow(run, "doc_id long, score double")


def accepted(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that score below threshold, with all their columns."""
    from .secrets import ddl

    at = docs.columns.index("text")

    def run(batches):
        known: dict[bytes, int] = {}
        for b in chunks(batches):
            texts = [t or b"" for t in text_bytes(b.column(at))]
            yield b.filter(pa.array(model.score(texts, known) < threshold))

    return docs.mapInArrow(run, ddl(docs))


def op10_query(spark, sf_dir: str) -> DataFrame:
    from .common import table

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
