"""Byte-level BPE by ranks against the library, and on awkward tables."""

import base64
import hashlib
import random

import numpy as np
import pytest

from wildgrid.llm import tokens

tiktoken = pytest.importorskip("tiktoken")


@pytest.fixture(scope="module")
def library():
    with open(tokens.default_vocabulary(), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=tokens.default_pattern(), mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def bpe():
    return tokens.load(tokens.default_vocabulary(), tokens.default_pattern())


def encoded(bpe, texts):
    return [np.frombuffer(x, "<u4").tolist() for x in bpe.encode_batch(texts)]


def test_every_code_point(bpe, library):
    """Two planes whole; beyond, each whose kind changed with Unicode 17 and every 61st."""
    points = [c for c in range(0x20000) if not 0xD800 <= c < 0xE000] + list(range(0x20000, 0x110000, 61)) + list(range(0x3347A - 64, 0x3347A + 8))
    for k in range(0, len(points), 8192):
        texts = [f"a{chr(c)}1{chr(c)} {chr(c)}!" for c in points[k : k + 8192]]
        assert encoded(bpe, texts) == library.encode_ordinary_batch(texts)


def strange(rnd, vocabulary):
    kind, join = rnd.randrange(7), "".join
    if kind == 0:
        return join(rnd.choice("ab") for _ in range(rnd.randint(0, 600)))
    if kind == 1:
        return join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rnd.randint(0, 2000)))
    if kind == 2:
        return join(rnd.choice(["  ", " ", "\n", "\t", " \n", "x", "1", "!", "é", "日本", "😀", "'s", "'ll", "<|endoftext|>", "\x1c", "\x85", "　"]) for _ in range(rnd.randint(0, 150)))
    if kind == 3:
        return "a" * rnd.randint(0, 3000)
    if kind == 4:
        return join(chr(rnd.choice([rnd.randint(32, 126), rnd.randint(160, 0x2FFF), rnd.randint(0x10000, 0x1FFFF)])) for _ in range(rnd.randint(0, 200)))
    some = [rnd.choice(vocabulary) for _ in range(rnd.randint(0, 200))]
    return b"".join(t for t in some if kind == 5 or t.isalpha()).decode("utf-8", "replace")


@pytest.mark.parametrize("leaf, window", [(8, 1), (1, 1), (3, 2)])
def test_random_texts(bpe, library, monkeypatch, leaf, window):
    monkeypatch.setattr(tokens, "LEAF", leaf)
    monkeypatch.setattr(tokens, "WINDOW", window)
    monkeypatch.setattr(tokens, "DECODED", 3)
    own = tokens.RankBPE(tokens.default_vocabulary(), tokens.default_pattern())
    rnd = random.Random(leaf)
    texts = [strange(rnd, list(bpe.ranks)) for _ in range(120)]
    got = encoded(own, texts)
    assert got == library.encode_ordinary_batch(texts)
    assert [own.decode(np.array(x, np.int64)) for x in got] == [t.encode() for t in texts]


def test_joining_is_associative_and_exact(bpe):
    rnd = random.Random(5)
    for _ in range(300):
        a, b, c = (bytes(rnd.choice(b"abcde nt") for _ in range(rnd.randint(0, 40))) for _ in range(3))
        x, y, z = map(bpe.reduce, (a, b, c))
        assert bpe.join(bpe.join(x, y), z) == bpe.join(x, bpe.join(y, z)) == bpe._merge(a + b + c)


def test_small_memory(bpe, library, monkeypatch):
    monkeypatch.setattr(tokens, "PAIRS", 5)
    own = tokens.RankBPE(tokens.default_vocabulary(), tokens.default_pattern())
    texts = ["several words of some length, " * 5, "internationalisation incomprehensibilities"]
    assert encoded(own, texts) == library.encode_ordinary_batch(texts)


def test_query_over_awkward_rows(spark, library, tmp_path):
    rows = [(None, "no id"), (None, None), (1, None), (2, ""), (3, "  two  spaces \n"), (4, "same"), (4, "same"), (4, "other"), (5, "word " * 60_000), (6, "x" * 100_000), (7, "é日本😀\x85 ﬁ")]
    spark.createDataFrame([(i, t, 1, "x", "y") for i, t in rows], "doc_id long, text string, n_tokens int, ids string, decoded string").write.parquet(str(tmp_path / "documents.parquet"))
    want = []
    for i, t in rows:
        ids = library.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted(map(tuple, tokens.op13_query(spark, str(tmp_path)).collect()), key=str) == sorted(want, key=str)


def test_encode_then_decode(spark):
    docs = spark.createDataFrame([(1, "A text."), (2, None)], "doc_id long, text string")
    assert {r.doc_id: bytes(r.decoded) for r in tokens.decode(tokens.encode(docs)).collect()} == {1: b"A text.", 2: b""}
    assert tokens.encode(docs.limit(0)).count() == 0
    assert bytes(tokens.decode(spark.createDataFrame([(1, [999_999, 64]), (2, None)], "doc_id long, ids array<int>")).orderBy("doc_id").first().decoded) == b"a"
