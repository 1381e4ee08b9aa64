"""Byte-level BPE encoding and decoding by speculate and verify.

Greedy longest match proposes tokens for every new word of a batch.  A proposal is right exactly when
no merge would ever cross the border between two neighbouring tokens, which one check of each
adjacent pair decides; the pairs of all words of a batch are checked together, as arrays.  Only
words with a failing pair undergo exact merging.

Why pairs suffice: merges happen in order of rank.  While a token is being built, the pieces that
touch its right edge are a fixed sequence, each there from the rank that made it to the rank that
merges it further (likewise at a left edge).  A merge crosses a border only if a piece at the left
token's right edge and a piece at the right token's left edge are there at the same time and form a
merge of the rank that is then due.
"""

from __future__ import annotations

import heapq
import json
import re
import struct
from functools import lru_cache
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import chunks, ids_and_texts

#: Fixed value: how byte-level BPE vocabularies of this kind split text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
#: Code points that are letters or numbers only since Unicode 17; the vocabulary's library follows Unicode 16.
LATER = (
    "\u0558\u058B-\u058C\u088F\u0C5C\u0CDC\u208F\u209D-\u209F\uA7CE-\uA7CF\uA7D2\uA7D4\uA7DD\uA7E2\uA7F1\uAB6C-\uAB6D"
    "\U000107BB-\U000107BF\U00010940-\U00010959\U00010EC5-\U00010EC7\U00010ED9-\U00010EEE\U00011B0A\U00011DB0-\U00011DDB"
    "\U00011DE0-\U00011DE9\U00011DF1\U0001246F\U00012475-\U0001247F\U00012550-\U00012686\U00016EA0-\U00016EB8\U00016EBB-\U00016ED3"
    "\U00016FF2-\U00016FF6\U000187F8-\U000187FF\U00018CD6-\U00018CDA\U00018D09-\U00018D20\U00018D80-\U00018DF2\U00018E00-\U00019191"
    "\U000191A0-\U000191D2\U0001B123-\U0001B128\U0001B168\U0001D6A6\U0001DF1F-\U0001DF24\U0001DF2B-\U0001DF81\U0001DF90-\U0001DF96"
    "\U0001DFCD-\U0001DFFF\U0001E6C0-\U0001E6DE\U0001E6E0-\U0001E6E2\U0001E6E4-\U0001E6E5\U0001E6E7-\U0001E6ED\U0001E6F0-\U0001E6F4"
    "\U0001E6FE-\U0001E6FF\U0002B73A-\U0002B73F\U0002B81E\U0002CEA2-\U0002CEAD\U000323B0-\U00033479\U0003D000-\U0003FC3F"
)
_LATER = re.compile(f"[{LATER}]")
#: Bytes of words, and of pieces between spaces, whose tokens a worker remembers; beyond, it starts afresh.
MEMORY = 1 << 25
#: Entries that a worker remembers.
ENTRIES = 500_000
#: A space before white space or at the end: such a text is not cut at its spaces.
_WIDE = re.compile(r" (?:\s|\Z)")


def _byte_alphabet() -> dict[str, int]:
    """The printable characters that stand for bytes in the vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Memory(dict):
    """What a worker remembers, forgotten as a whole once it is large."""

    held = 0

    def add(self, new: dict) -> None:
        self.update(new)
        self.held += sum(map(len, new))

    def forget_if_full(self) -> None:
        if len(self) > ENTRIES or self.held > MEMORY:
            self.clear()
            self.held = 0


class ByteBPE:
    """Encoder and decoder of a tokenizers file with a byte-level BPE model."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = _byte_alphabet()
        model = spec["model"]
        self.bytes_of = {i: bytes(letters[c] for c in t) for t, i in model["vocab"].items()}
        self.id_of = {b: i for i, b in self.bytes_of.items()}
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        vocab = model["vocab"]
        pairs = [(vocab[a], vocab[b], vocab[a + b]) for a, b in merges]
        self.rank = {(a, b): r for r, (a, b, _) in enumerate(pairs)}
        self.made = {(a, b): c for a, b, c in pairs}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        for text, i in self.special.items():
            self.bytes_of[i] = text.encode()
        self.split_special = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.split = regex.compile(PATTERN)
        self.longest = max(map(len, self.id_of))
        self.starts = {b[:n]: -1 for b in self.id_of for n in range(1, len(b) + 1)} | self.id_of
        self._tables(pairs)
        self.known, self.pieces = Memory(), Memory()

    def _tables(self, pairs: list[tuple[int, int, int]]) -> None:
        """Of each token: the parts that its own merges join last, and their rank; the merges as a sorted array."""
        n = max(self.bytes_of) + 1
        never = len(pairs)
        self.never = never
        self.left, self.right, self.born = np.full(n, -1), np.full(n, -1), np.full(n, -1)
        for r, (a, b, c) in enumerate(pairs):
            if self.born[c] < 0:
                self.left[c], self.right[c], self.born[c] = a, b, r
        keys = np.array([a * n + b for a, b, _ in pairs], np.int64)
        order = np.argsort(keys)
        self.width, self.keys, self.ranks = n, keys[order], order

    def _merge_rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a.astype(np.int64) * self.width + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], self.never)

    def compatible(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether no merge ever crosses the border of each pair of tokens."""
        ok = np.ones(len(left), bool)
        live = np.arange(len(left))
        a, b = left.copy(), right.copy()
        a_until, b_until = np.full(len(left), self.never), np.full(len(left), self.never)  # the rank that merges the piece further
        while len(live):
            # a is there for ranks in (born[a], a_until), b likewise: a crossing merge must be due before either goes.
            rank = self._merge_rank(a, b)
            from_ = np.maximum(self.born[a], self.born[b])
            until = np.minimum(a_until, b_until)
            # In the same round the leftmost of equal ranks goes first: the left token's own merge precedes the
            # crossing one, and the crossing one precedes the right token's own.
            crosses = (rank < self.never) & (rank > from_) & ((rank < until) | ((rank == b_until) & (rank < a_until)))
            ok[live[crosses]] = False
            go = ~crosses
            live, a, b, a_until, b_until = live[go], a[go], b[go], a_until[go], b_until[go]
            # Step back in time at the side whose piece was made last.
            back_a = self.born[a] >= self.born[b]
            done = np.where(back_a, self.born[a], self.born[b]) < 0
            a_next = np.where(back_a, self.right[a], a)
            b_next = np.where(back_a, b, self.left[b])
            a_until = np.where(back_a, self.born[a], a_until)
            b_until = np.where(back_a, b_until, self.born[b])
            keep = ~done
            live, a, b, a_until, b_until = live[keep], a_next[keep], b_next[keep], a_until[keep], b_until[keep]
        return ok

    def greedy(self, word: bytes) -> list[int]:
        out, i, n, get = [], 0, len(word), self.starts.get
        while i < n:
            j, end, best = i + 1, i + 1, -1
            while j <= n and (t := get(word[i:j])) is not None:
                if t >= 0:
                    end, best = j, t
                j += 1
            out.append(best)
            i = end
        return out

    def merge(self, word: bytes) -> list[int]:
        """Exact: always the pair of lowest rank, leftmost first."""
        ids = [self.id_of[word[i : i + 1]] for i in range(len(word))]
        rank = self.rank
        if len(ids) <= 48:
            ranks = [rank.get(p, self.never) for p in zip(ids, ids[1:], strict=False)]
            while ranks and (low := min(ranks)) < self.never:
                i = ranks.index(low)
                ids[i : i + 2] = [self.made[ids[i], ids[i + 1]]]
                del ranks[i]
                if i:
                    ranks[i - 1] = rank.get((ids[i - 1], ids[i]), self.never)
                if i < len(ranks):
                    ranks[i] = rank.get((ids[i], ids[i + 1]), self.never)
            return ids
        after, before = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
        heap = [(rank[p], i, p) for i, p in enumerate(zip(ids, ids[1:], strict=False)) if p in rank]
        heapq.heapify(heap)
        gone = [False] * len(ids)
        while heap:
            _, i, pair = heapq.heappop(heap)
            j = after[i]
            if gone[i] or j >= len(ids) or (ids[i], ids[j]) != pair:
                continue
            ids[i] = self.made[pair]
            gone[j] = True
            after[i] = k = after[j]
            if k < len(ids):
                before[k] = i
                if (p := (ids[i], ids[k])) in rank:
                    heapq.heappush(heap, (rank[p], i, p))
            h = before[i]
            if h >= 0 and (p := (ids[h], ids[i])) in rank:
                heapq.heappush(heap, (rank[p], h, p))
        return [t for t, g in zip(ids, gone, strict=True) if not g]

    def learn(self, words: set[str]) -> None:
        """Tokens of new words, as little-endian bytes: propose, verify all at once, merge what fails."""
        pack, names = struct.pack, list(words)
        if not names:
            return
        proposed = [self.greedy(w.encode()) for w in names]
        sizes = np.fromiter(map(len, proposed), np.int64, len(proposed))
        flat = np.fromiter(chain.from_iterable(proposed), np.int64, int(sizes.sum()))
        owner = np.repeat(np.arange(len(proposed)), sizes)
        inner = np.flatnonzero(owner[1:] == owner[:-1])
        pairs, back = np.unique(flat[inner] * self.width + flat[inner + 1], return_inverse=True)
        good = np.ones(len(proposed), bool)
        good[owner[inner[~self.compatible(pairs // self.width, pairs % self.width)[back]]]] = False
        good[owner[~self.own[flat]]] = False
        found = {}
        for w, p, ok in zip(names, proposed, good.tolist(), strict=True):
            if not ok:
                p = self.merge(w.encode())
            found[w] = pack(f"<{len(p)}I", *p)
        self.known.add(found)

    @property
    def own(self) -> np.ndarray:
        """Whether merging a token's bytes gives the token itself (a token made by no merge order does not)."""
        if not hasattr(self, "_own"):
            self._own = np.zeros(self.width, bool)
            for i, b in self.bytes_of.items():
                self._own[i] = self.id_of.get(b) == i and self.merge(b) == [i]
        return self._own

    def words(self, text: str) -> list[str]:
        """The words of a text without special tokens: by the library's Unicode version, whatever that of the splitter."""
        if text.isascii() or not _LATER.search(text):
            return self.split.findall(text)
        return [text[m.start() : m.end()] for m in self.split.finditer(_LATER.sub("!", text))]

    def _cut(self, text: str) -> list[str | bytes]:
        """Words of a text; special tokens as bytes of their id."""
        if self.split_special and any(s in text for s in self.special):
            return [x for part in self.split_special.split(text) if part for x in ([struct.pack("<I", self.special[part])] if part in self.special else self.words(part))]
        return self.words(text)

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian 32-bit integers.

        A space that stands before something else than white space always begins a word, so a text without
        other spaces is cut there, and each piece (with the space before it) has its own tokens.
        """
        self.known.forget_if_full()
        self.pieces.forget_if_full()
        parts = [[t] if _WIDE.search(t) or (self.special and any(s in t for s in self.special)) else t.split(" ") for t in texts]
        first = {p[0] for p in parts}
        new = {p for p in set(chain.from_iterable(islice(p, 1, None) for p in parts)) if p not in self.pieces}
        cut_new = {p: self.words(f" {p}") for p in new}
        cut_first = {t: self._cut(t) for t in first}
        words = {w for c in (cut_new, cut_first) for ws in c.values() for w in ws if isinstance(w, str)}
        self.learn({w for w in words if w not in self.known})
        known, pieces = self.known, self.pieces
        pieces.add({p: b"".join([known[w] for w in ws]) for p, ws in cut_new.items()})
        heads = {t: b"".join([w if isinstance(w, bytes) else known[w] for w in ws]) for t, ws in cut_first.items()}
        get = pieces.__getitem__
        return [heads[p[0]] + b"".join(map(get, islice(p, 1, None))) for p in parts]

    def decode(self, ids: np.ndarray) -> str:
        """The bytes of the tokens as text; bytes that are not UTF-8 become U+FFFD, unknown ids nothing."""
        get = self.bytes_of.get
        return b"".join([get(i, b"") for i in ids.tolist()]).decode("utf-8", "replace")


@lru_cache(maxsize=4)
def load(path: str) -> ByteBPE:
    return ByteBPE(path)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encode(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """documents -> (doc_id, ids array<int>), a row for each row; null and empty texts have no ids."""
    path = vocabulary or default_vocabulary()

    def run(batches):
        bpe = load(path)
        for b in chunks(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([np.frombuffer(x, np.int32) for x in bpe.encode_batch(b.column(1).to_pylist())], pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return ids_and_texts(docs).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, ids) -> (doc_id, text); null ids give an empty text."""
    path = vocabulary or default_vocabulary()

    def run(batches):
        bpe = load(path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([bpe.decode(np.array(x or [], np.int64)) for x in b.column(1).to_pylist()], pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """documents -> (doc_id, n_tokens, ids_bytes, decoded): ids as little-endian 32-bit integers, and the text decoded from them."""
    path = vocabulary or default_vocabulary()

    def run(batches):
        bpe = load(path)
        for b in chunks(batches):
            ids = bpe.encode_batch(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary()), pa.array([bpe.decode(np.frombuffer(x, '<u4')) for x in ids], pa.string())], names=["doc_id", "n_tokens", "ids_bytes", "decoded"]
            )

    return ids_and_texts(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_bytes binary, decoded string")


def op4_query(spark, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from .common import table

    out = round_trip(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_tokens", F.sha2("ids_bytes", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
