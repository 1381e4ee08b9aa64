"""Runs of repeated words against brute force, and on awkward tables."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from wildgrid.llm import periodic

DOCS = "doc_id long, text string, runs int, collapsed int, n_words int"


def brute(words, least=12):
    """All maximal stretches with their smallest period, by trying every period."""
    found = {}
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i + q < len(words):
            s = i
            while i + q < len(words) and words[i] == words[i + q]:
                i += 1
            if i + q - s >= max(least, 2 * q):
                found.setdefault((s, i + q), q)
            i += 1
    return sorted((s, e - s, q) for (s, e), q in found.items())


def random_words(rnd):
    n, k = rnd.choice([0, 1, 5, 12, 13, 30, 60, 120]), rnd.choice([1, 2, 2, 3, 4, 30])
    words = [rnd.randrange(k) for _ in range(n)]
    for _ in range(rnd.randint(0, 3) if n > 4 else 0):
        a = rnd.randrange(n)
        p, length = rnd.randint(1, max(1, (n - a) // 2)), rnd.randint(1, n - a)
        for i in range(a, a + length):
            words[i] = words[a + (i - a) % p]
    return words


@pytest.mark.parametrize("least", [2, 4, 6, 12])
def test_runs_equal_brute_force(least, monkeypatch):
    monkeypatch.setattr(periodic, "AT_ONCE", 50)
    rnd = random.Random(least)
    for _ in range(300):
        texts = [random_words(rnd) for _ in range(rnd.randint(1, 4))]
        flat, ids, want, first = np.array([w for t in texts for w in t], np.int64), np.repeat(np.arange(len(texts)), [len(t) for t in texts]), [], 0
        for t in texts:
            want += [(s + first, n, q) for s, n, q in brute(t, least)]
            first += len(t)
        assert periodic.runs_of(flat, ids, least) == sorted(want)


def test_long_texts_of_few_words():
    for words in ([0] * 30_000, [0, 1] * 15_000, [i % 137 for i in range(30_000)]):
        assert [(s, n) for s, n, _ in periodic.runs_of(np.array(words), np.zeros(len(words), np.int64))] == [(0, 30_000)]
    once = list(range(5_000))
    assert periodic.runs_of(np.array(once * 2), np.zeros(10_000, np.int64)) == [(0, 10_000, 5_000)]


def plain_row(doc_id, text):
    words = [w for w in "".join(" " if c in " \t\n\v\f\r" else c for c in text or "").split(" ") if w]
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute(words)
    dropped = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    listed = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    return (doc_id, len(runs), *best, None if best[0] is None else 1000 * best[1] // best[2], sha(listed), sha(" ".join(w for i, w in enumerate(words) if i not in dropped)))


def test_query_equals_a_plain_version(spark, tmp_path):
    rnd = random.Random(7)
    rows = [(None, "a b " * 20), (None, None), (3, None), (4, ""), (5, " \n\t"), (6, "x\x1cy z\x85 " * 9), (7, "é ß 日本 " * 12), (7, "é ß 日本 " * 12), (7, "other text"), (8, "a " * 3000)]
    rows += [(i, " ".join(f"w{w}" for w in random_words(rnd))) for i in range(100, 500)]
    spark.createDataFrame([(i, t, 0, 0, 0) for i, t in rows], DOCS).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = periodic.op12_query(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got), key=str) == sorted((plain_row(i, t) for i, t in rows), key=str)
    assert sum(r.n_runs > 0 for r in got) > 100


def test_collapsed_text_keeps_one_period(spark):
    docs = spark.createDataFrame([(1, "start  one two three one two three\none two three one two three end")], "doc_id long, text string")
    row = periodic.periodic_runs(docs).first()
    assert row.collapsed == "start one two three end" and [tuple(r) for r in row.runs] == [(1, 12, 3)]


def test_empty_table(spark):
    assert periodic.periodic_runs(spark.createDataFrame([], DOCS)).count() == 0
