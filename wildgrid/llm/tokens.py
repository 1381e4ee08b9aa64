"""Byte-level BPE by ranks, encoded and decoded as a reduction over a tree.

Encodings form a monoid: halves of a piece are encoded by themselves, recursively, and neighbours are joined.  To join, the last tokens of
the left and the first of the right are encoded anew as one window, which grows on a side until the tokens outside it provably stay.

When they stay: merges take the lowest rank, leftmost first.  Look at the first merge that crosses the border of two tokens of
a row.  Until then the bytes of the two have gone through the very steps, in the same order, that they go through as a pair by
themselves, so that pair would see the same merge.  Hence, if each two neighbours of a row encode to themselves as a pair, the whole row
is the encoding of its bytes.  Pairs outside the window and within it hold already; only those at its two edges are tried.

Each match of the splitting pattern is such a piece, and pieces are concatenated.  Decoding concatenates bytes up the tree.
"""

from __future__ import annotations

import base64
import heapq
import re
import struct
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import LATER, Memory
from .common import chunks, ids_and_texts

#: Bytes that are encoded at once, bytes up to which that is remembered, tokens of a window on either side at first, and tokens decoded at once.
LEAF, SHORT, WINDOW, DECODED = 8, 8, 1, 4096
#: Pairs of tokens that a worker remembers.
PAIRS = 1_000_000
_LATER = re.compile(f"[{LATER}]")
#: A space in front of something that is not white space always begins a piece.
_BORDER = re.compile(r" (?=\S)")
_WIDE = re.compile(r" (?:\s|\Z)")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


class RankBPE:
    """Encoder and decoder of a file of ranks: a base64 token and its id in each line."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}
        self.bytes_of = {r: t for t, r in self.ranks.items()}
        # The class of white space is that of Unicode, as the library has it.
        self.split = regex.compile(pattern.replace(r"\S", r"\P{White_Space}").replace(r"\s", r"\p{White_Space}"))
        self.known = Memory()
        self.held: dict[tuple[int, int], bool] = {}
        self.short: dict[bytes, list[int]] = {}

    def merge(self, piece: bytes) -> list[int]:
        """Exact encoding of some bytes, not to be changed; those of a few bytes are remembered."""
        if len(piece) > SHORT:
            return self._merge(piece)
        if (out := self.short.get(piece)) is None:
            if len(self.short) > PAIRS:
                self.short.clear()
            out = self.short[piece] = self._merge(piece)
        return out

    def _merge(self, piece: bytes) -> list[int]:
        """Always the pair of lowest rank, leftmost first."""
        ranks, parts = self.ranks.get, [piece[i : i + 1] for i in range(len(piece))]
        if len(parts) > 64:
            return self._merge_long(parts)
        never = len(self.ranks) + 256
        due = [ranks(a + b, never) for a, b in zip(parts, parts[1:], strict=False)]
        while due and (low := min(due)) < never:
            i = due.index(low)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del due[i]
            if i:
                due[i - 1] = ranks(parts[i - 1] + parts[i], never)
            if i < len(due):
                due[i] = ranks(parts[i] + parts[i + 1], never)
        return [self.ranks[p] for p in parts]

    def _merge_long(self, parts: list[bytes]) -> list[int]:
        ranks, n = self.ranks.get, len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := ranks(parts[i] + parts[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if j >= n or parts[i] != a or parts[j] != b:
                continue
            parts[i], parts[j] = a + b, b""
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := ranks(parts[i] + parts[k])) is not None:
                    heapq.heappush(heap, (r, i, parts[i], parts[k]))
            if (h := before[i]) >= 0 and (r := ranks(parts[h] + parts[i])) is not None:
                heapq.heappush(heap, (r, h, parts[h], parts[i]))
        return [self.ranks[p] for p in parts if p]

    def holds(self, left: int, right: int) -> bool:
        """Whether two tokens encode to themselves as a pair."""
        pair = (left, right)
        if (out := self.held.get(pair)) is None:
            if len(self.held) > PAIRS:
                self.held.clear()
            out = self.held[pair] = self.merge(self.bytes_of[left] + self.bytes_of[right]) == [left, right]
        return out

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of the bytes of two encodings, one after the other."""
        if not left or not right or self.holds(left[-1], right[0]):
            return left + right
        a, b = min(WINDOW, len(left)), min(WINDOW, len(right))
        while True:
            window = self.merge(b"".join([self.bytes_of[t] for t in (*left[len(left) - a :], *right[:b])]))
            firm_left = a == len(left) or self.holds(left[-a - 1], window[0])
            firm_right = b == len(right) or self.holds(window[-1], right[b])
            if firm_left and firm_right:
                return left[: len(left) - a] + window + right[b:]
            a = a if firm_left else min(2 * a, len(left))
            b = b if firm_right else min(2 * b, len(right))

    def reduce(self, piece: bytes) -> list[int]:
        if len(piece) <= LEAF:
            return self.merge(piece)
        half = len(piece) // 2
        return self.join(self.reduce(piece[:half]), self.reduce(piece[half:]))

    def piece(self, piece: bytes) -> list[int]:
        """A piece that is a token stays whole, whether or not merges would lead to it."""
        return [whole] if (whole := self.ranks.get(piece)) is not None else self.reduce(piece)

    def pieces(self, text: str) -> list[str]:
        """Matches of the pattern, by the library's version of Unicode."""
        if text.isascii() or not _LATER.search(text):
            return self.split.findall(text)
        return [text[m.start() : m.end()] for m in self.split.finditer(_LATER.sub("!", text))]

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian 32-bit integers.

        Texts are cut in front of spaces that begin a piece; what stands between two cuts is encoded once for a batch.
        """
        self.known.forget_if_full()
        parts = [_BORDER.split(t) if _WIDE.search(t) else t.split(" ") for t in texts]
        new = {p[0] for p in parts}  # at the beginning of a text there is no space before it
        cut = {f" {x}" for p in parts for x in p[1:]}
        known = self.known
        found, pack = {}, struct.pack
        for x in (new | cut) - known.keys():
            word = x.isascii() and (x[1:] if x[:1] == " " else x).isalpha()
            ids = [i for piece in ([x] if word else self.pieces(x)) for i in self.piece(piece.encode())]
            found[x] = pack(f"<{len(ids)}I", *ids)
        known.add(found)
        return [b"".join([known[p[0]], *[known[f" {x}"] for x in p[1:]]]) for p in parts]

    def decode(self, ids: np.ndarray) -> bytes:
        """Bytes of the ids, unknown ones nothing: leaves of some thousand ids are decoded, and concatenated two by two."""
        get = self.bytes_of.get
        level = [b"".join([get(i, b"") for i in ids[k : k + DECODED].tolist()]) for k in range(0, len(ids), DECODED)] or [b""]
        while len(level) > 1:
            level = [b"".join(level[k : k + 2]) for k in range(0, len(level), 2)]
        return level[0]


@lru_cache(maxsize=4)
def load(path: str, pattern: str) -> RankBPE:
    return RankBPE(path, pattern)


def encode(docs: DataFrame, vocabulary: str | None = None, pattern: str | None = None) -> DataFrame:
    """documents -> (doc_id, ids array<int>), a row for each row; null and empty texts have no ids."""
    path, pattern = vocabulary or default_vocabulary(), pattern or default_pattern()

    def run(batches):
        bpe = load(path, pattern)
        for b in chunks(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([np.frombuffer(x, np.int32) for x in bpe.encode_batch(b.column(1).to_pylist())], pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return ids_and_texts(docs).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, vocabulary: str | None = None, pattern: str | None = None) -> DataFrame:
    """(doc_id, ids) -> (doc_id, decoded binary); null ids give no bytes."""
    path, pattern = vocabulary or default_vocabulary(), pattern or default_pattern()

    def run(batches):
        bpe = load(path, pattern)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([bpe.decode(np.array(x or [], np.int64)) for x in b.column(1).to_pylist()], pa.binary())], names=["doc_id", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, decoded binary")


def round_trip(docs: DataFrame, vocabulary: str | None = None, pattern: str | None = None) -> DataFrame:
    """documents -> (doc_id, n_tokens, ids_bytes, decoded binary): ids as little-endian 32-bit integers, and the bytes decoded from them.

    A row for each row; null and empty texts have no ids.
    """
    path, pattern = vocabulary or default_vocabulary(), pattern or default_pattern()

    def run(batches):
        bpe = load(path, pattern)
        for b in chunks(batches):
            ids = bpe.encode_batch(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary()), pa.array([bpe.decode(np.frombuffer(x, "<u4")) for x in ids], pa.binary())], names=["doc_id", "n_tokens", "ids_bytes", "decoded"]
            )

    return ids_and_texts(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_bytes binary, decoded binary")


def op13_query(spark, sf_dir: str) -> DataFrame:
    from .common import table

    out = round_trip(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_tokens", F.sha2("ids_bytes", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
