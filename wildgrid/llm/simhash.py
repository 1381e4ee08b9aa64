"""SimHash near-duplicates with pivot distance tables.

Fingerprints are made in one pass.  Distinct fingerprints meet in buckets: the bits are cut into b
blocks and any two fingerprints within `radius` bits agree on at least b - radius of them, so every
choice of that many blocks is a key.  b follows from the number of distinct fingerprints, so that a
bucket of unrelated ones holds a few.  Within a bucket, each fingerprint has a row of Hamming
distances to fixed reference fingerprints; a pair is discarded when any coordinate differs by more
than `radius`, which the triangle inequality allows, and the survivors are compared bit by bit.  Of the links
of a bucket only a spanning forest leaves the task, never all pairs.

For the similarity of whole texts (similar_documents) fingerprints are wider and buckets come from shingles.

Pivot tables alone would have to look at all pairs of documents (a distance to a random reference
has a spread of four bits, no more than the radius), hence the buckets in front of them.
"""

from __future__ import annotations

import math
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bloom import possible
from .common import chunks, fresh, ids_and_texts, materialise, partitions, text_bytes
from .components import connected_components

SEED = 42
#: Members of one bucket that one task compares at once; a larger bucket is cut into blocks of these.
BLOCK = 2048


def simhash(text: bytes, words_per_shingle: int) -> int:
    """The fingerprint of a text given as UTF-8 bytes; zero for a text without words."""
    words = text.lower().split()
    if not words:
        return 0
    k = min(words_per_shingle, len(words))
    line = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    digest = xxhash.xxh64_intdigest
    n = len(words) - k + 1
    hashes = np.fromiter((digest(line[s:e], SEED) for s, e in zip(starts[:n].tolist(), ends[k - 1 :].tolist(), strict=True)), "<u8", n)
    ones = np.zeros(64, np.int64)
    for i in range(0, n, 16384):
        ones += np.unpackbits(hashes[i : i + 16384].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words_per_shingle: int = 4) -> DataFrame:
    """(doc_id, fp): fp is the 64-bit fingerprint as a signed long.  A null text counts as empty."""

    def made(batches):
        for b in chunks(batches):
            fps = np.array([simhash(t, words_per_shingle) for t in text_bytes(b.column(1))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps)], names=["doc_id", "fp"])

    return ids_and_texts(docs).mapInArrow(made, "doc_id long, fp long")


def references(n: int) -> np.ndarray:
    """n reference fingerprints from a fixed rule (the output of splitmix64 on 1..n)."""
    x = (np.arange(1, n + 1, dtype=np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def distance_table(fps: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Hamming distances of fingerprints (a row of 64-bit words each) to the pivots (likewise)."""
    return np.bitwise_count(fps[:, None, :] ^ pivots[None, :, :]).sum(axis=2, dtype=np.int16)


def near(left: np.ndarray, right: np.ndarray, pivots: np.ndarray, radius: int) -> np.ndarray:
    """Which of left (rows) are within radius of which of right (columns): pivots first, then the bits."""
    a, b = distance_table(left, pivots), distance_table(right, pivots)
    maybe = np.ones((len(left), len(right)), bool)
    for k in range(len(pivots)):
        maybe &= np.abs(a[:, k, None] - b[None, :, k]) <= radius
    i, j = np.nonzero(maybe)
    maybe[i, j] = sum(np.bitwise_count(left[i, w] ^ right[j, w]).astype(np.int16) for w in range(left.shape[1])) <= radius
    return maybe


def forest(linked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (root, member) of the components of a symmetric link matrix."""
    n = len(linked)
    free, roots, members = np.ones(n, bool), [], []
    for r in range(n):
        if not free[r]:
            continue
        free[r] = False
        front = np.array([r])
        while len(front):
            front = np.nonzero(linked[front].any(axis=0) & free)[0]
            free[front] = False
            roots += [r] * len(front)
            members += front.tolist()
    return np.array(roots, np.int64), np.array(members, np.int64)


def _blocks(distinct: int, radius: int) -> list[tuple[int, int]]:
    """(low bit, bits) of each block: few enough that keys stay cheap, many enough that buckets stay small."""
    for b in range(radius + 2, 4 * radius + 1):
        edges = [64 * i // b for i in range(b + 1)]
        if distinct <= 8 * 2 ** sum(sorted(y - x for x, y in zip(edges, edges[1:], strict=False))[: b - radius]):
            break
    return [(x, y - x) for x, y in zip(edges, edges[1:], strict=False)]


def links(distinct: DataFrame, radius: int = 4, pivots: int = 16, block: int = BLOCK) -> DataFrame:
    """distinct(fp, rep) -> edges(u, v) over rep whose components are those of all links within radius."""
    if not 0 < radius < 32:
        raise ValueError("radius must be between 1 and 31")
    blocks = _blocks(distinct.count(), radius)
    chosen = list(combinations(blocks, len(blocks) - radius))

    def keyed(batches):
        for b in batches:
            fps = b.column(0).to_numpy().view(np.uint64)
            raw = b.column(0).cast(pa.int64()).to_numpy().astype("<i8").tobytes()
            packed = pa.array([raw[i : i + 8] for i in range(0, len(raw), 8)], pa.binary())
            for i, parts in enumerate(chosen):
                bits = np.uint64(sum(((1 << n) - 1) << low for low, n in parts))
                key = xxmix((fps & bits) + np.uint64(i * 0x9E3779B97F4A7C15 % 2**64))
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), packed, b.column(1)], names=["key", "fp", "rep"])

    rows = distinct.mapInArrow(keyed, "key long, fp binary, rep long")
    return bucket_links(rows, radius, references(pivots).reshape(-1, 1), block)


def bucket_links(rows: DataFrame, radius: int, marks: np.ndarray, block: int, loose: bool = False) -> DataFrame:
    """rows(key, fp, rep) -> edges(u, v) over rep that connect what links within radius in each bucket (key).

    fp: the fingerprint's 64-bit words as bytes; marks: the pivots, as many words each.  loose: an edge may connect members of a large
    bucket within twice the radius, which spares most of its pairs.
    """

    def words(fps: list[bytes]) -> np.ndarray:
        return np.frombuffer(b"".join(fps), "<u8").reshape(len(fps), -1)

    pivots = [int.from_bytes(p.astype("<u8").tobytes(), "little") for p in marks]

    def linked(batches):
        """Rows come sorted by key: a bucket of up to `block` is solved here, a larger one is passed on."""
        key, fps, reps, over = None, [], [], False

        def solved():
            if len(fps) < 2:
                return [], []
            if len(fps) == 2:  # the table of two: the same test without arrays
                a, b = (int.from_bytes(f, "little") for f in fps)
                far = any(abs((a ^ p).bit_count() - (b ^ p).bit_count()) > radius for p in pivots)
                return ([reps[0]], [reps[1]]) if not far and (a ^ b).bit_count() <= radius else ([], [])
            x, r = words(fps), np.array(reps, np.int64)
            i, j = forest(near(x, x, marks, radius))
            return (r[i].tolist(), r[j].tolist()) if len(i) else ([], [])

        for b in batches:
            u, v, hot = [], [], ([], [], [])
            for k, f, r in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if k != key:
                    if not over:
                        i, j = solved()
                        u += i
                        v += j
                    key, fps, reps, over = k, [], [], False
                fps.append(f)
                reps.append(r)
                if len(fps) > block:
                    over = True
                if over:
                    hot[0].extend([k] * len(fps))
                    hot[1].extend(fps)
                    hot[2].extend(reps)
                    fps, reps = [], []
            if u or hot[0]:
                yield _edges(u, v, hot)
        if not over:
            u, v = solved()
            if u:
                yield _edges(u, v, ([], [], []))

    found = materialise(rows.repartition("key").sortWithinPartitions("key", "fp").mapInArrow(linked, "u long, v long, key long, fp binary"), "links")
    edges = found.where("key is null").select("u", "v")
    hot = found.where("key is not null").select("key", "fp", F.col("u").alias("rep"))
    if hot.limit(1).count():
        if loose:
            more, hot = _hub_links(hot, radius)
            edges = edges.union(more)
        edges = edges.union(_hot_links(hot, radius, marks, block))
    return edges


def _hub_links(hot: DataFrame, radius: int) -> tuple[DataFrame, DataFrame]:
    """Large buckets, by hubs: (edges, the rest).

    Each hub is compared with all that is left of its bucket: what lies within the radius goes, what lies within twice the radius is linked.
    Two members within the radius of each other are then linked if either of them went, as the other is within twice the radius of
    that hub.  So a bucket of near copies, whatever its size, takes a few looks at each member.  A bucket of which few go, as its texts share a
    passage and no more, is left as it was.
    """
    edges, rest = None, None
    for hubs in HUBS:
        chosen = hot.groupBy("key", F.pmod(F.xxhash64("rep", F.lit(2)), F.lit(hubs)).alias("part")).agg(F.min(F.struct("rep", "fp")).alias("hub"))
        chosen = chosen.groupBy("key").agg(F.collect_list("hub.rep").alias("reps"), F.collect_list("hub.fp").alias("fps"))

        def met(batches):
            for b in batches:
                near, gone = [], []
                for fp, reps, fps in zip(*(c.to_pylist() for c in b.columns[2:]), strict=True):
                    own = int.from_bytes(fp, "little")
                    far = [(own ^ int.from_bytes(f, "little")).bit_count() for f in fps]
                    near.append([r for r, d in zip(reps, far, strict=True) if d <= 2 * radius])
                    gone.append(min(far) <= radius)
                yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(near, pa.list_(pa.int64())), pa.array(gone, pa.bool_())], names=["key", "rep", "fp", "near", "gone"])

        seen = hot.join(chosen, "key").select("key", "rep", "fp", "reps", "fps").mapInArrow(met, "key long, rep long, fp binary, near array<long>, gone boolean")
        seen = materialise(seen, "hubs")
        loose = seen.groupBy("key").agg(F.avg(F.col("gone").cast("double")).alias("share")).where(F.col("share") < SHARE).select("key")
        unlike, seen = seen.join(loose, "key", "left_semi").select("key", "fp", "rep"), seen.join(loose, "key", "left_anti")
        rest = unlike if rest is None else rest.union(unlike)
        new = seen.select(F.explode("near").alias("u"), F.col("rep").alias("v")).where("u <> v")
        edges = new if edges is None else edges.union(new)
        hot = seen.where("not gone").select("key", "fp", "rep")
        if not hot.limit(1).count():
            break
    return edges, rest.union(hot)


def _hot_links(hot: DataFrame, radius: int, marks: np.ndarray, block: int) -> DataFrame:
    """Large buckets: cut into blocks, each pair of blocks in a task of its own."""
    counts = hot.groupBy("key").agg(F.ceil(F.count("*") / F.lit(block)).cast("long").alias("n"))
    own = F.pmod(F.xxhash64("fp", F.lit(1)), F.col("n"))
    dealt = (
        hot.join(counts, "key").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
        .select("key", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "fp", "rep", F.col("own"))
    )

    def solved(pdf):
        import pandas as pd

        x, r = np.frombuffer(b"".join(map(bytes, pdf.fp)), "<u8").reshape(len(pdf), -1), pdf.rep.to_numpy(np.int64)
        lab = np.arange(len(x))
        for i in range(0, len(x), 256):  # rows of the link matrix, a strip at a time
            strip = near(x[i : i + 256], x, marks, radius)
            for row in range(len(strip)):
                met = np.unique(lab[strip[row]])
                if len(met) > 1:
                    lab[np.isin(lab, met)] = met[0]
        other = lab != np.arange(len(x))
        return pd.DataFrame({"u": r[lab[other]], "v": r[other]})

    # A stated number of partitions: the rows are few and small, their comparison is what takes time.
    dealt = dealt.repartition(partitions(hot.sparkSession), "key", "a", "b")
    return dealt.groupBy("key", "a", "b").applyInPandas(solved, "u long, v long")


def xxmix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _edges(u, v, hot) -> pa.RecordBatch:
    none = [None] * len(u)
    return pa.RecordBatch.from_arrays([pa.array([*u, *hot[2]], pa.int64()), pa.array([*v, *[None] * len(hot[0])], pa.int64()), pa.array([*none, *hot[0]], pa.int64()), pa.array([*none, *hot[1]], pa.binary())], names=["u", "v", "key", "fp"])


def near_duplicates(docs: DataFrame, words_per_shingle: int = 4, radius: int = 4, pivots: int = 16, block: int = BLOCK) -> DataFrame:
    """documents -> (doc_id, fp, component_id), one row for each row of docs.

    Null or wordless texts have fingerprint zero and link like any other.  Rows without a doc_id
    keep their fingerprint and, where nothing with an id links to them, a null component; repeated
    rows and ids each give their row.  component_id is the smallest doc_id reachable.
    """
    fps = materialise(fingerprints(docs, words_per_shingle), "fingerprints")
    distinct = materialise(fps.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("rep")), "distinct")
    parts = connected_components(links(distinct, radius, pivots, block))
    home = distinct.join(parts, distinct.rep == parts.node, "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    return fps.join(home, "fp", "left").select("doc_id", "fp", "component_id")


#: Of a wide fingerprint (for similarity): words, smallest shingle hashes taken as keys, and members of a bucket compared at once.
WIDE, KEYS, WIDE_BLOCK = 4, 12, 1024
#: Members and shingles of one block of a group whose pairs are checked exactly.
SET_BLOCK, SET_SHINGLES = 512, 1 << 21
#: Hubs that all members of a large bucket or group are compared with, round by round; the share of a bucket that must go in a round.
HUBS, SHARE = (4, 8, 8, 8), 0.3


def _differ(shared: int, left: int, right: int) -> float:
    """Chance that a bit differs between sets with this many shared shingles and so many that only one of them has."""
    half = lambda n: np.array([math.comb(n, x) / 2**n for x in range(n + 1)])
    x = np.arange(shared + 1)

    def above(own):
        at_least = np.append(np.cumsum(half(own)[::-1])[::-1], 0.0)
        return at_least[np.clip((shared + own) // 2 + 1 - x, 0, own + 1)]

    p, q = above(left), above(right)
    return float((half(shared) * (p + q - 2 * p * q)).sum())


@cache
def wide_radius(similarity: float, bits: int = 64 * WIDE, missed: float = 1e-6) -> int:
    """Differing bits that two texts whose shingle sets have this Jaccard similarity or more exceed with a chance of `missed` at most.

    The chance that a bit differs is that of the worst sizes: it is exact up to 64 shingles, and falls beyond.
    """
    worst = 0.0
    for shared in range(1, 65):
        more = int(shared / similarity + 1e-9) - shared
        worst = max([worst, *(_differ(shared, left, right) for left in range(more // 2 + 1) for right in range(left, more - left + 1))])
    tail = np.cumsum([math.comb(bits, k) * worst**k * (1 - worst) ** (bits - k) for k in range(bits, -1, -1)])[::-1]
    return next(r for r in range(bits + 1) if r == bits or tail[r + 1] <= missed)


def shingle_hashes(text: bytes, words_per_shingle: int) -> tuple[int, np.ndarray]:
    """A hash of the whole word sequence, and the distinct shingle hashes in order (none for a text without words)."""
    words = text.lower().split()
    line = b" ".join(words)
    whole = xxhash.xxh64_intdigest(line, SEED) - 2**63
    if not words:
        return whole, np.empty(0, np.uint64)
    k = min(words_per_shingle, len(words))
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    digest = xxhash.xxh64_intdigest
    n = len(words) - k + 1
    return whole, np.unique(np.fromiter((digest(line[s:e], SEED) for s, e in zip(starts[:n].tolist(), ends[k - 1 :].tolist(), strict=True)), np.uint64, n))


def wide_simhash(text: bytes, words_per_shingle: int) -> tuple[bytes, int, list[int], int]:
    """Fingerprint of several words, a hash of the whole word sequence, the smallest distinct shingle hashes and the number of all."""
    whole, hashes = shingle_hashes(text, words_per_shingle)
    ones = np.zeros(64 * WIDE, np.int64)
    for i in range(0, len(hashes), 4096):
        part = np.stack([xxmix(hashes[i : i + 4096] + np.uint64((w * 0x9E3779B97F4A7C15) % 2**64)) for w in range(1, WIDE + 1)], axis=1).astype("<u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(len(part), -1), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > len(hashes), bitorder="little").tobytes(), whole, hashes[:KEYS].view(np.int64).tolist(), len(hashes)


def alike(sets: list[np.ndarray], right: int, similarity: float, labels: list[int] | None = None) -> list[tuple[int, int]]:
    """Pairs (i, j) that connect what has the Jaccard similarity or more: i of all, j after i and from `right` on.

    Every such pair is checked but those already connected; equal labels: connected before.
    """
    sizes = np.array([len(s) for s in sets])
    starts = np.concatenate([[0], np.cumsum(sizes)])
    names, codes = np.unique(np.concatenate(sets), return_inverse=True)
    mark, out = np.zeros(len(names), bool), []
    lab = np.arange(len(sets)) if labels is None else np.unique(labels, return_inverse=True)[1]
    for i in range(min(right, len(sets)) if right else len(sets)):
        first = max(i + 1, right)
        if first >= len(sets) or not (lab[first:] != lab[i]).any():
            continue
        own = codes[starts[i] : starts[i + 1]]
        mark[own] = True
        both = np.add.reduceat(mark[codes[starts[first] :]], starts[first:-1] - starts[first], dtype=np.int64)
        mark[own] = False
        for j in (first + np.nonzero(both / (sizes[i] + sizes[first:] - both) >= similarity)[0]).tolist():
            if lab[j] != lab[i]:
                out.append((i, j))
                lab[lab == lab[j]] = lab[i]
    return out


def exact_links(docs: DataFrame, groups: DataFrame, words_per_shingle: int, similarity: float, block: int = SET_BLOCK) -> DataFrame:
    """groups(component, whole, rep, size) -> edges(u, v) over whole that connect the members of each component that are alike.

    The shingles of the members' texts (of the document rep) are made again; a Bloom filter of the members keeps other texts out of the
    shuffle.  A component of one block is solved in one task; for larger ones see _large_links.
    """
    blocks = F.ceil(F.greatest(F.count("*") / F.lit(block), F.sum("size") / F.lit(SET_SHINGLES))).cast("long")
    placed = materialise(groups.join(groups.groupBy("component").agg(blocks.alias("n")), "component").select("component", "n", "whole", "rep"), "placed")
    texts = ids_and_texts(docs)
    maybe = fresh("maybe", texts)

    def made(batches):
        for b in chunks(batches):
            rows = [shingle_hashes(t, words_per_shingle) for t in text_bytes(b.column(0))]
            mine = pa.array([r[0] == w for r, w in zip(rows, b.column(3).to_pylist(), strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array([r[1].view(np.int64) for r in rows], pa.list_(pa.int64()))], names=["component", "n", "whole", "shingles"]).filter(mine)

    def sets(members):
        near = possible(texts, members.select(F.col("rep").alias("doc_id")), ["doc_id"], maybe).where(maybe)
        found = near.join(members, F.col("doc_id") == F.col("rep")).select("text", "component", "n", "whole")
        return found.mapInArrow(made, "component long, n long, whole long, shingles array<long>")

    small = sets(placed.where("n = 1")).select("component", F.lit(0).alias("a"), F.lit(0).alias("b"), F.lit(0).alias("own"), "whole", F.col("whole").alias("label"), "shingles")
    edges = _checked(small, similarity)
    large = placed.where("n > 1")
    return edges.union(_large_links(materialise(sets(large), "sets"), similarity, block)) if large.limit(1).count() else edges


def _large_links(sets: DataFrame, similarity: float, block: int) -> DataFrame:
    """Links of large components, sets(component, n, whole, shingles): by hubs first, then what they leave.

    Hubs are compared with all members of their component; what links to a hub is no hub itself.  As a rule that connects nearly all.
    Then members that are not of the largest part of their component are compared with all members of other parts, block by block.
    """
    edges, left = None, sets.select("component", "whole").distinct()
    for hubs in HUBS:
        chosen = left.groupBy("component", F.pmod(F.xxhash64("whole", F.lit(2)), F.lit(hubs)).alias("part")).agg(F.min("whole").alias("whole"))
        hub = chosen.join(sets, ["component", "whole"]).groupBy("component", "whole").agg(F.first("shingles").alias("shingles"))
        hub = hub.groupBy("component").agg(F.collect_list(F.struct("whole", "shingles")).alias("hubs"))
        both = lambda x: F.size(F.array_intersect("shingles", x["shingles"]))
        near = F.transform(F.filter("hubs", lambda x: both(x) >= F.lit(similarity) * (F.size("shingles") + F.size(x["shingles"]) - both(x))), lambda x: x["whole"])
        met = materialise(sets.join(hub, "component").select("component", "whole", near.alias("near")), "hubs")
        new = met.select(F.explode("near").alias("u"), F.col("whole").alias("v")).where("u <> v")
        edges = new if edges is None else edges.union(new)
        was = left.count()
        left = left.join(met.where(F.size("near") > 0).select("component", "whole").distinct(), ["component", "whole"], "left_anti")
        left = materialise(left, "left")
        now = left.count()
        if not now or 10 * now > 9 * was:
            break
    parts = connected_components(edges).withColumnRenamed("component", "label")
    at = sets.select("component", "whole").distinct().join(parts, F.col("whole") == F.col("node"), "left").select("component", "whole", F.coalesce("label", "whole").alias("label"))
    at = materialise(at, "parts")
    main = at.groupBy("component", "label").count().groupBy("component").agg(F.max_by("label", F.struct("count", "label")).alias("main"))
    rest = at.join(main, "component").where("label <> main").select("component", "whole", F.lit(True).alias("rest"))
    if not rest.limit(1).count():
        return edges
    share = rest.groupBy("component").agg(F.ceil(F.count("*") / F.lit(block)).cast("long").alias("m"))
    rows = sets.join(at, ["component", "whole"]).join(share, "component").join(rest, ["component", "whole"], "left")
    part = lambda n: F.pmod(F.xxhash64("whole", F.lit(1)), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    first = rows.where("rest").select("component", part("m").alias("a"), every("n").alias("b"), F.lit(0).alias("own"), "whole", "label", "shingles")
    second = rows.select("component", every("m").alias("a"), part("n").alias("b"), F.lit(1).alias("own"), "whole", "label", "shingles")
    return edges.union(_checked(first.union(second), similarity))


def _checked(rows: DataFrame, similarity: float) -> DataFrame:
    """rows(component, a, b, own, whole, label, shingles) -> edges(u, v): what links within each (component, a, b), each in one task.

    Rows whose own is 0 are compared with those whose own is 1, or with each other if there are none.
    """

    def solved(nodes, own, labels, held):
        right = own.count(0)
        if len(nodes) < 2 or not right:
            return []
        right = 0 if right == len(own) else right
        return [(nodes[i], nodes[j]) for i, j in alike(held, right, similarity, labels)]

    def checked(batches):
        """Rows come sorted: one pair of blocks after the other, the first block's members first."""
        key, now = None, ([], [], [], [])
        for b in batches:
            out = []
            for c, x, y, o, w, label, s in zip(*(c.to_pylist() if k < 6 else c for k, c in enumerate(b.columns)), strict=True):
                if (c, x, y) != key:
                    out += solved(*now)
                    key, now = (c, x, y), ([], [], [], [])
                if not now[0] or (now[0][-1], now[1][-1]) != (w, o):  # rows of one id that repeat
                    for part, v in zip(now, (w, o, label, s.values.to_numpy().view(np.uint64)), strict=True):
                        part.append(v)
            if out:
                yield _links(out)
        out = solved(*now)
        if out:
            yield _links(out)

    return rows.repartition("component", "a", "b").sortWithinPartitions("component", "a", "b", "own", "whole").mapInArrow(checked, "u long, v long")


def _links(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())], names=["u", "v"])


def text_hash(docs: DataFrame) -> Column:
    return F.xxhash64(F.coalesce(docs["text"], F.lit(""))).alias("text_hash")


def similar_documents(docs: DataFrame, words_per_shingle: int = 5, similarity: float = 0.8, pivots: int = 16, block: int = WIDE_BLOCK, set_block: int = SET_BLOCK) -> DataFrame:
    """documents -> (doc_id, text_hash, component_id, first), one row for each row of docs with an id: groups of texts whose shingle sets are alike by the given similarity or more.

    At a similarity of 0.8 fingerprints differ in about a seventh of their bits, too many for buckets
    of equal bits.  So texts meet that share one of their twelve smallest shingle hashes, which all such pairs of up to 59 shingles do and
    fails for 0.2^12 of longer ones at most, and are compared by fingerprints of 256 bits, with pivots as before and a radius that
    a millionth of such pairs exceed at most.  This is a filter: within each component of its links
    the shingle sets of all pairs are compared, and only pairs alike by the similarity link.  Equal word sequences are one.
    Texts without words form one group; rows without a doc_id are left out.  first: the row has the smallest doc_id of its group, and
    of the texts of that id the one with the smallest text_hash (of the text as it stands).
    """

    def made(batches):
        for b in chunks(batches):
            rows = [wide_simhash(t, words_per_shingle) for t in text_bytes(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.list_(pa.int64())), pa.array([r[3] for r in rows], pa.int64())], names=["doc_id", "text_hash", "fp", "whole", "keys", "size"])

    given = materialise(ids_and_texts(docs, text_hash(docs)).where("doc_id is not null").mapInArrow(made, "doc_id long, text_hash long, fp binary, whole long, keys array<long>, size long"), "wide")
    distinct = materialise(given.groupBy("whole").agg(F.min(F.struct("doc_id", "text_hash")).alias("least"), F.min("doc_id").alias("rep"), F.first("fp").alias("fp"), F.first("keys").alias("keys"), F.first("size").alias("size")), "distinct")
    loose = bucket_links(distinct.select(F.explode("keys").alias("key"), "fp", F.col("whole").alias("rep")), wide_radius(similarity), references(pivots * WIDE).reshape(-1, WIDE), block, True)
    groups = connected_components(loose).join(distinct, F.col("node") == F.col("whole")).select("component", "whole", "rep", "size")
    edges = materialise(exact_links(docs, materialise(groups, "groups"), words_per_shingle, similarity, set_block), "alike")
    parts = distinct.join(connected_components(edges), F.col("node") == F.col("whole"), "left").select("whole", "least", F.coalesce("component", "whole").alias("component"))
    home = parts.drop("least").join(parts.groupBy("component").agg(F.min("least").alias("least")), "component").select("whole", "least")
    return given.join(home, "whole").select("doc_id", "text_hash", F.col("least.doc_id").alias("component_id"), (F.struct("doc_id", "text_hash") == F.col("least")).alias("first"))


def op6_query(spark, sf_dir: str) -> DataFrame:
    from .common import table

    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
