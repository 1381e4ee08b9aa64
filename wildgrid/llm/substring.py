"""Removal of repeated passages by seed and extend.

Seeds are winnowed anchors: of the word k-grams inside every window of `length` words the one with
the smallest hash is the window's anchor, so equal windows have equal anchors wherever they stand.
Documents are joined on their anchors, and each seed comes extended to both sides as far as its anchor rules:
a run is the words of all neighbouring windows with that anchor.

* Equal runs are settled as wholes: all of a run's windows stand in the smallest document that has the run.
* If an anchor has different runs, its matches end inside of them.  Of each such run the smallest document's is opened: its
  words are fetched, and its windows are compared one by one.

Spans of both kinds merge into maximal repeats, which are cut from the texts.  Runs are told apart by 160 bits (anchor 64,
run 96), windows by 128, made from 128-bit hashes of the words; so no two that differ are ever taken for one.

Equal runs and windows that meet in one chunk of input are settled there and only the smallest document's goes on, so a
passage that a third of all documents hold puts a row per chunk, not per document, into its task.  Anchors that a sample
of the documents shows to be frequent are dealt by their runs, and all of these are opened.
"""

from __future__ import annotations

import hashlib
from array import array
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import NO_ID, chunks, fresh, materialise, partitions, text_bytes
from .simhash import xxmix

#: Words of an anchor; the window length less this is the winnowing window less one.
ANCHOR = 6
#: Of so many documents one is looked at for frequent anchors; a frequent one has this part of a shuffle partition, and so many rows in the sample.
SAMPLE, SHARE, RARE = 64, 0.125, 64
#: Words that a task remembers the hashes of, and their bytes.
WORDS, WORD_BYTES = 300_000, 1 << 24
SEED = "key long, run long, more int, doc long, twin long, place long"
SPAN = "doc long, twin long, begin int, end int, open boolean"
#: Bits of a seed's place: first word, number of windows, kind.
SIZE_BITS, KIND_BITS = 16, 2
#: Kinds of seeds: of an anchor dealt as one, of a frequent one, and of a run that a smaller document of the chunk has.
PLAIN, FREQUENT, SETTLED = 0, 1, 2


class _Words(dict):
    """Place of each word in the tables lo and hi of the halves of its hash."""

    def __init__(self):
        super().__init__()
        self.lo, self.hi, self.held = array("Q"), array("Q"), 0

    def __missing__(self, word: bytes) -> int:
        x = xxhash.xxh3_128_intdigest(word)
        self.lo.append(x & 0xFFFFFFFFFFFFFFFF)
        self.hi.append(x >> 64)
        self.held += len(word)
        self[word] = n = len(self)
        return n


class Windows:
    """Word, anchor and window hashes of many texts at once."""

    def __init__(self, length: int, anchor: int = ANCHOR):
        if not 1 <= anchor <= length < 1 << SIZE_BITS:
            raise ValueError(f"an anchor has between 1 and `length` words, and a window fewer than {1 << SIZE_BITS}")
        self.length, self.anchor, self.known = length, anchor, _Words()
        #: Odd numbers of which each but one is even once only.
        self.coef = (xxmix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(3)).reshape(4, 64)

    def words(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Both halves of the hash of each word, and its text's number."""
        if len(self.known) > WORDS or self.known.held > WORD_BYTES:
            self.known = _Words()
        split = [t.split() for t in texts]
        counts = np.fromiter(map(len, split), np.int64, len(split))
        at = np.fromiter(map(self.known.__getitem__, chain.from_iterable(split)), np.int64, int(counts.sum()))
        lo, hi = (np.array(x, np.uint64)[at] for x in (self.known.lo, self.known.hi))
        return lo, hi, np.repeat(np.arange(len(texts)), counts)

    def rolled(self, words: np.ndarray, *sizes: int) -> list[np.ndarray]:
        """Hashes of all k-grams of words for each k of sizes; sums over 1, 2, 4, ... words are shared."""
        sums = [words]
        while 2 << (len(sums) - 1) <= max(sizes):
            half, w = sums[-1], 1 << (len(sums) - 1)
            sums.append(half[: max(0, len(half) - w)] + half[w:] * self.coef[0, len(sums)])
        out = []
        for k in sizes:
            n, at, total = max(0, len(words) - k + 1), 0, np.uint64(0)
            for j in range(k.bit_length() - 1, -1, -1):
                if k >> j & 1:
                    total = sums[j][at : at + n] * self.coef[1, j] + total
                    at += 1 << j
            out.append(xxmix(total))
        return out

    def identities(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """128 bits of each window."""
        return self.rolled(lo, self.length)[0], self.rolled(hi, self.length)[0]

    def runs(self, texts: list[bytes]) -> dict[str, np.ndarray]:
        """key, run, more (identity), owner (text number), start (first word) and size (windows) of each run of windows with one anchor."""
        lo, hi, owner = self.words(texts)
        if len(lo) < self.length:
            return {c: np.zeros(0, np.int64) for c in ("key", "run", "more", "owner", "start", "size")}
        least, one = self.rolled(lo, self.anchor, self.length)
        two = self.rolled(hi, self.length)[0]
        at = np.arange(len(least))
        done, want = 1, self.length - self.anchor + 1  # k-grams that the minimum spans
        while done < want:
            step = min(done, want - done)
            left, right = least[:-step], least[step:]
            take = left <= right
            at, least = np.where(take, at[:-step], at[step:]), np.where(take, left, right)
            done += step
        n = len(lo) - self.length + 1
        valid = owner[:n] == owner[self.length - 1 :]
        turn = (at[1:] != at[:-1]) | (owner[1:n] != owner[: n - 1])
        first = np.flatnonzero(valid & np.r_[True, turn | ~valid[:-1]])
        size = np.flatnonzero(valid & np.r_[turn | ~valid[1:], True]) + 1 - first
        if not len(first):
            return self.runs([])
        nth = np.arange(n) - np.repeat(np.r_[0, first], np.diff(np.r_[0, first, n]))  # number of a window within its run
        weight = np.where(valid & (nth < size.max()), xxmix((nth + 1).astype(np.uint64)) | np.uint64(1), np.uint64(0))
        total = [np.add.reduceat(h * weight, first) for h in (one, two)]
        run, more = (xxmix(t + size.astype(np.uint64)) for t in total)
        word0 = np.searchsorted(owner, np.arange(len(texts)))
        return {"key": least[first].view(np.int64), "run": run.view(np.int64), "more": (more >> np.uint64(32)).astype(np.uint32).view(np.int32), "owner": owner[first], "start": first - word0[owner[first]], "size": size}


def _groups(*columns: np.ndarray) -> np.ndarray:
    """Where a new group begins in sorted columns."""
    n = len(columns[0])
    new = np.zeros(n, bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return new


def _lows(new: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Of rows sorted by group and document: the smallest document of each row's group."""
    return doc[np.flatnonzero(new)][np.cumsum(new) - 1]


def _place(doc: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Where a settled row goes: anywhere."""
    return xxmix((doc * 31 + word).view(np.uint64)).view(np.int64)


def _seeds(length: int, frequent: np.ndarray):
    """Runs as rows of SEED, by document; a settled one keeps only its place, one of a frequent anchor is dealt by its run."""

    def seeds(batches):
        make = Windows(length)
        for b in chunks(batches):
            ids, twins = b.column(0).to_numpy(), b.column(1).to_numpy()
            x = make.runs(text_bytes(b.column(2)))
            key, run, more, owner = (x[c] for c in ("key", "run", "more", "owner"))
            doc = ids[owner]
            order = np.lexsort((doc, more, run, key))
            kind = np.where(np.isin(key, frequent), FREQUENT, PLAIN)
            if len(order):
                kind[order[doc[order] > _lows(_groups(key[order], run[order], more[order]), doc[order])]] = SETTLED
            gone, dealt = kind == SETTLED, kind == FREQUENT
            key = np.where(gone, _place(doc, x["start"]), np.where(dealt, xxmix((key ^ run).view(np.uint64)).view(np.int64), key))
            place = (x["start"] << (SIZE_BITS + KIND_BITS)) | (x["size"] << KIND_BITS) | kind
            columns = [key, np.where(gone, 0, run), np.where(gone, 0, more).astype(np.int32), doc, twins[owner], place]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["key", "run", "more", "doc", "twin", "place"])

    return seeds


def _extend(length: int):
    """Rows of SEED sorted by key, run, more and doc -> rows of SPAN: settled runs, and those to be opened (of anchors with different runs).

    Only the rows of one document with one run are held between batches.
    """

    def extend(batches):
        held = None  # rows of the last key so far that may still have to be opened, and whether it has different runs
        several = False
        for b in batches:
            if not b.num_rows:
                continue
            key, run, more, doc, twin, place = (c.to_numpy() for c in b.columns)
            start, size, kind = place >> (SIZE_BITS + KIND_BITS), place >> KIND_BITS & ((1 << SIZE_BITS) - 1), place & ((1 << KIND_BITS) - 1)
            gone = kind == SETTLED
            out = [(doc[gone], twin[gone], start[gone], size[gone], np.zeros(int(gone.sum()), bool))]
            rows = [c[~gone] for c in (key, run, more, doc, twin, start, size, kind)]
            n = 0
            if held is not None and len(rows[0]):
                n = len(held[0])
                rows = [np.r_[h, c] for h, c in zip(held, rows, strict=True)]
            key, run, more, doc, twin, start, size, kind = rows
            if len(key):
                new_run, new_key = _groups(key, run, more), _groups(key)
                low = _lows(new_run, doc)
                after = np.flatnonzero(doc > low)
                number = np.cumsum(new_key) - 1
                differ = np.bincount(number, new_run) > 1
                if n and several:
                    differ[0] = True
                first = doc == low
                sent = np.zeros(len(key), bool)
                if several:
                    sent[:n] = True  # held only to be compared with
                opened = first & ~sent & (differ[number] | (kind == FREQUENT))
                out += [(doc[after], twin[after], start[after], size[after], np.zeros(len(after), bool)), (doc[opened], twin[opened], start[opened], size[opened], np.ones(int(opened.sum()), bool))]
                several = bool(differ[-1]) or kind[-1] == FREQUENT
                last = np.flatnonzero((number == number[-1]) & first & (np.cumsum(new_run) == new_run.sum()))
                held = [c[last] for c in rows]
            doc, twin, start, size, opens = (np.concatenate(c) for c in zip(*out, strict=True))
            if len(doc):
                end = (start + size - 1 + length).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(doc), pa.array(twin), pa.array(start.astype(np.int32)), pa.array(end), pa.array(opens)], names=["doc", "twin", "begin", "end", "open"])

    return extend


def _opened(length: int, text: str, at: tuple[int, int, int, int]):
    """Rows with a text and its opened runs -> (one, two, doc, twin, begin, settled), a row a window of these runs.

    at: places of the document, its twin hash, the text and the runs among the columns.
    """

    def opened(batches):
        make = Windows(length)
        for b in chunks(batches, text):
            ids, twins = (b.column(at[i]).to_numpy() for i in (0, 1))
            runs = b.column(at[3])
            lo, hi, owner = make.words(text_bytes(b.column(at[2])))
            one, two = make.identities(lo, hi)
            word0 = np.searchsorted(owner, np.arange(b.num_rows))
            of = np.repeat(np.arange(b.num_rows), runs.value_lengths().to_numpy())
            bounds = runs.flatten()
            start, end = (bounds.field(c).to_numpy().astype(np.int64) for c in ("begin", "end"))
            count = end - start - length + 1
            row = np.repeat(of, count)
            begin = np.repeat(start, count) + np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            place = word0[row] + begin
            one, two, doc = one[place].view(np.int64), two[place].view(np.int64), ids[row]
            order = np.lexsort((doc, two, one))
            settled = np.zeros(len(doc), bool)
            if len(doc):
                settled[order] = doc[order] > _lows(_groups(one[order], two[order]), doc[order])
            columns = [np.where(settled, _place(doc, begin), one), np.where(settled, 0, two), doc, twins[row], begin.astype(np.int32), settled]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["one", "two", "doc", "twin", "begin", "settled"])

    return opened


def _compared(length: int):
    """Windows sorted by identity and doc -> rows of SPAN, of those that a smaller document has."""

    def compared(batches):
        held = None  # identity and smallest document of the last window
        for b in batches:
            if not b.num_rows:
                continue
            one, two, doc, twin, begin, settled = (c.to_numpy(zero_copy_only=False) for c in b.columns)
            hit = settled.copy()
            open_ = np.flatnonzero(~settled)
            if len(open_):
                x, y, d = one[open_], two[open_], doc[open_]
                if held is not None:
                    x, y, d = (np.r_[h, c] for h, c in zip(held, (x, y, d), strict=True))
                low = _lows(_groups(x, y), d)
                hit[open_] = (d > low)[len(d) - len(open_) :]
                held = x[-1], y[-1], low[-1]
            begin = begin[hit]
            if len(begin):
                yield pa.RecordBatch.from_arrays([pa.array(doc[hit]), pa.array(twin[hit]), pa.array(begin), pa.array((begin + length).astype(np.int32)), pa.array(np.zeros(len(begin), bool))], names=["doc", "twin", "begin", "end", "open"])

    return compared


def _frequent(texts: DataFrame, length: int, sample: int, rare: int) -> np.ndarray:
    """Anchors that many rows of a sample have; at most a few for each shuffle partition.  They only say how rows are dealt."""

    def keys(batches):
        make = Windows(length)
        for b in chunks(batches):
            yield pa.RecordBatch.from_arrays([pa.array(make.runs(text_bytes(b.column(0)))["key"])], names=["key"])

    n = int(partitions(texts.sparkSession) / SHARE)
    counts = texts.where(F.pmod(F.xxhash64("twin", F.lit("sample")), F.lit(sample)) == 0).select("text").mapInArrow(keys, "key long").groupBy("key").count()
    return np.array([r.key for r in counts.where(F.col("count") >= rare).orderBy(F.desc("count"), "key").limit(n).collect()], np.int64)


def _with_spans(docs: DataFrame, length: int, sample: int, rare: int) -> tuple[DataFrame, str, str, str]:
    """docs with the spans to cut, and the names of the columns doc, twin and spans in it.

    doc is doc_id, or a number larger than any other where it is missing; rows that share it are told apart by twin, a hash
    of the text, and never cover each other.
    """
    doc, twin, runs = (fresh(c, docs) for c in ("doc", "twin", "spans"))
    text = F.coalesce(F.col("text"), F.lit(""))
    given = docs.withColumns({doc: F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)), twin: F.xxhash64(text)})
    texts = given.select(F.col(doc).alias("doc"), F.col(twin).alias("twin"), text.alias("text"))
    frequent = _frequent(texts, length, sample, rare)
    seeds = texts.mapInArrow(_seeds(length, frequent), SEED).repartition("key").sortWithinPartitions("key", "run", "more", "doc")
    found = materialise(seeds.mapInArrow(_extend(length), SPAN), "runs")

    def by_text(spans: DataFrame) -> DataFrame:
        return spans.groupBy("doc", "twin").agg(F.collect_list(F.struct("begin", "end")).alias(runs)).withColumnsRenamed({"doc": doc, "twin": twin})

    # Both joins take the same columns of docs, so that the texts are shuffled once.
    opened = given.join(by_text(found.where("open")), [doc, twin]).select(*given.columns, runs)
    at = tuple(opened.columns.index(c) for c in (doc, twin, "text", runs))
    windows = opened.mapInArrow(_opened(length, "text", at), "one long, two long, doc long, twin long, begin int, settled boolean")
    inner = windows.repartition("one").sortWithinPartitions("one", "two", "doc").mapInArrow(_compared(length), SPAN)
    return given.join(by_text(found.where("not open").union(inner)), [doc, twin], "left").select(*given.columns, runs), doc, twin, runs


def _cut(docs: DataFrame, length: int, sample: int, rare: int) -> tuple[DataFrame, str]:
    """docs with a column (its name comes second) of struct(n_words, n_removed, kept_words)."""
    joined, doc, twin, spans = _with_spans(docs, length, sample, rare)
    out = fresh("cut", joined)
    at = joined.columns.index("text")
    kind = pa.struct([("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_words", pa.string())])

    def cut(batches):
        for b in chunks(batches):
            n, gone, kept = [], [], []
            for t, pairs in zip(b.column(at).to_pylist(), b.column(b.num_columns - 1).to_pylist(), strict=True):
                words = (t or "").encode().split()
                n.append(len(words))
                if pairs:
                    keep = np.ones(len(words), bool)
                    for p in pairs:
                        keep[p["begin"] : p["end"]] = False
                    words = [w for w, k in zip(words, keep.tolist(), strict=True) if k]
                gone.append(n[-1] - len(words))
                kept.append(b" ".join(words).decode())
            made = pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())], fields=list(kind))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], made], names=[*b.schema.names[:-1], out])

    schema = joined.drop(spans).schema.add(out, StructType().add("n_words", "long").add("n_removed", "long").add("kept_words", "string"))
    return joined.mapInArrow(cut, schema).drop(doc, twin), out


def without_repeats(docs: DataFrame, length: int = 13, sample: int = SAMPLE, rare: int = RARE) -> DataFrame:
    """docs with three more columns: n_words, n_removed and kept_words (the words left, joined by one space).

    A word goes if a window of `length` words covers it that a document with a smaller doc_id also has.  Empty, null and
    wordless texts have no words and lose none.  A missing doc_id counts as larger than any other; rows that share an id,
    equal or not, keep their words from each other.  Every row and column of docs stays; its own n_words, n_removed or
    kept_words is replaced.
    """
    made, out = _cut(docs, length, sample, rare)
    new = ("n_words", "n_removed", "kept_words")
    return made.select(*(c for c in docs.columns if c not in new), *(F.col(f"{out}.{c}").alias(c) for c in new))


def cut_texts(docs: DataFrame, length: int = 13, sample: int = SAMPLE, rare: int = RARE) -> DataFrame:
    """docs with the repeated words cut from text, as in without_repeats; a text that loses none stays as it is.  All other columns stay."""
    made, out = _cut(docs, length, sample, rare)
    text = F.when(F.col(f"{out}.n_removed") > 0, F.col(f"{out}.kept_words")).otherwise(F.col("text"))
    return made.select(*(text.alias(c) if c == "text" else F.col(f"`{c}`") for c in docs.columns))


def op5_query(spark, sf_dir: str) -> DataFrame:
    from .common import table

    out = without_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_words"), 256).alias("kept_sha256"))


def substring_brute(rows: list[tuple[int, str]], length: int = 13) -> list[tuple[int, int, int, str]]:
    """The same by looking at every window of every text (for tests)."""
    least: dict[tuple[bytes, ...], int] = {}
    split = [(i, (t or "").encode().split()) for i, t in rows]
    for i, w in split:
        for s in range(len(w) - length + 1):
            k = tuple(w[s : s + length])
            least[k] = min(i, least.get(k, i))
    out = []
    for i, w in split:
        gone = {j for s in range(len(w) - length + 1) if least[tuple(w[s : s + length])] < i for j in range(s, s + length)}
        out.append((i, len(w), len(gone), hashlib.sha256(b" ".join(x for j, x in enumerate(w) if j not in gone)).hexdigest()))
    return out


OP5_SQL = """
WITH texts AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
windows AS (SELECT doc_id, i, array_to_string(list_slice(w, i, i + 12), ' ') AS t FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM texts) x),
hits AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY t) AS least FROM windows) x WHERE least < doc_id),
gone AS (SELECT DISTINCT doc_id, i + k AS j FROM hits, (SELECT unnest(range(0, 13)) AS k) ks),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY j) AS line FROM (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS j FROM texts) x ANTI JOIN gone USING (doc_id, j) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, (SELECT count(*) FROM gone g WHERE g.doc_id = texts.doc_id) AS n_removed, sha256(coalesce(line, '')) AS kept_sha256
FROM texts LEFT JOIN kept USING (doc_id)
"""
