"""The filter audit against a plain version, and on awkward tables."""

import random
from itertools import permutations

import pytest

from wildgrid.llm import audit

DOCS = "doc_id long, text string, lang string, mask int, digest string, id long"


def plain_mask(rows, k):
    """Failed filters of row k, straight from the definitions."""
    doc_id, text, _ = rows[k]
    text = text or ""
    words = [w for w in "".join(" " if c in " \t\n\v\f\r" else c for c in text).split(" ") if w]
    a, b = len(words) < 200, 100 * len(set(words)) < 50 * len(words)
    c, d = 100 * sum("A" <= x <= "Z" for x in text) > 3 * len(text), any(x in "#$%&*|" for x in text)
    ids = [r[0] for r in rows if (r[1] or "") == text and r[0] is not None]
    return a | b << 1 | c << 2 | d << 3 | (bool(ids) and (doc_id is None or min(ids) < doc_id)) << 4


def plain(rows, labels):
    good, toxic = ({d for d, q, t in labels if d is not None and (q, t)[i] == 1} for i in (0, 1))
    out = []
    for part in sorted({r[2] or "" for r in rows}):
        own = [(plain_mask(rows, k), rows[k][0]) for k in range(len(rows)) if (rows[k][2] or "") == part]
        shapley, lines = dict.fromkeys("ABCDE", 0), []
        for order in map("".join, permutations("ABCDE")):
            left = own
            for step, f in enumerate(order, 1):
                bit = 1 << "ABCDE".index(f)
                gone = [x for x in left if x[0] & bit]
                left = [x for x in left if not x[0] & bit]
                shapley[f] += len(gone)
                lines.append([part, order, step, len(left), len(gone), sum(bool(m & bit) for m, _ in own) - len(gone), sum(m == bit for m, _ in own), sum(d in good for _, d in gone), sum(d in toxic for _, d in gone)])
        out += [(*x, shapley[x[1][x[2] - 1]]) for x in lines]
    return sorted(out)


def texts(rnd):
    pool = ["", None, "a", "A B C", "word " * 250, " ".join(f"w{i}" for i in range(220)), "É ß # 日本", " \t\n", " ".join(f"w{i}" for i in range(199)), "x" * 97 + "ABC", "x" * 96 + "ABCD", "a\x1cb | c\x85d"]
    pool += [" ".join(rnd.choice("abcdefgh") + str(rnd.randint(0, 90)) for _ in range(rnd.randint(150, 300))) for _ in range(30)]
    return pool


@pytest.mark.parametrize("most", [audit.MOST, audit.SLOTS])
def test_audit_equals_the_definition(spark, most, monkeypatch):
    monkeypatch.setattr(audit, "FLUSH", 7)
    rnd = random.Random(11)
    pool = texts(rnd)
    rows = [(rnd.choice([None, *range(150)]), rnd.choice(pool), rnd.choice(["en", "de", "", None])) for _ in range(260)]
    rows += [(1000 + i, "one text of very many rows", "en") for i in range(400)]
    labels = [(i, rnd.randint(0, 1), rnd.randint(0, 1)) for i in range(0, 1400, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1), (6, None, None)]
    docs = spark.createDataFrame([(i, t, lang, 0, "x", 9) for i, t, lang in rows], DOCS).repartition(5)
    got = audit.interactions(audit.mask_counts(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), most)).collect()
    assert sorted(map(tuple, got)) == plain(rows, labels)


def test_audit_clears_texts_that_stand_once(spark):
    rows = [(i, f"text {i}", "en") for i in range(3000)] + [(9000 + i, f"text {i}", "en") for i in range(0, 3000, 10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    counters = audit.counters_for(len(rows))
    bits = {r.block: r.bits for r in audit.sketch(docs, counters).collect()}
    may = 0
    for i in range(3000):
        at = audit.places([audit.xxhash.xxh3_128_digest(f"text {i}".encode())], counters)[0].tolist()
        hit = all(p // audit.SLOTS in bits and bits[p // audit.SLOTS][p % audit.SLOTS // 8] >> p % 8 & 1 for p in at)
        assert hit or i % 10
        may += hit
    assert may < 300 + 60
    assert sum(r.mask >> 4 for r in audit.flagged(docs).collect()) == 300


def test_audit_of_an_empty_table(spark):
    none = spark.createDataFrame([], DOCS)
    assert audit.interactions(audit.mask_counts(none, spark.createDataFrame([], "doc_id long, quality int, toxic int"))).count() == 0


def test_audit_of_a_very_long_text(spark):
    docs = spark.createDataFrame([(1, "Long " * 300_000, "en"), (2, "Long " * 300_000, "en")], "doc_id long, text string, lang string")
    assert sorted((r.doc_id, r.mask) for r in audit.flagged(docs).collect()) == [(1, 6), (2, 22)]
