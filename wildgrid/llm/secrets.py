"""Secret scans: patterns for known kinds, and a token-efficiency test for the rest.

A random string breaks into many short tokens under a BPE vocabulary made from ordinary text, so few
characters for each token mark a candidate as a secret.  Known digests (hexadecimal of a digest's
length, UUIDs) and identifiers (words joined by - _ . / or case, plain numbers, web addresses) are
excluded before the test.  Runs of letters alone, or joined by - _ / = +, look like identifiers whether they are words
or not, so they are tested too, with a stricter ratio that words of the four languages keep.
"""

from __future__ import annotations

import base64
import hashlib
import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, ids_and_texts

#: The base kinds, in order.
ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
KINDS = ("assign", "access", "hex", "random")
#: Shortest value of an assignment, access key and hexadecimal string.
LEAST = {"assign": 6, "access": 20, "hex": 24}

#: A run of these characters of at least this length is put to the test.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
#: Fewer characters for each token than this is random; of letters alone, and of letters joined by signs, than that.
RATIO, LETTERS = 2.0, 1.7
#: Characters that are tokenized at once; a longer candidate is cut, so that its cost grows with its length only.
PIECE = 1 << 16
_DIGEST = re.compile(r"(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{48}|[0-9a-f]{56}|[0-9a-f]{64}|[0-9a-f]{96}|[0-9a-f]{128}|[0-9A-F]{32}|[0-9A-F]{40}|[0-9A-F]{64})\Z")
_UUID = re.compile(r"[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}\Z")
_NUMBER = re.compile(r"[0-9]*\Z|[0-9]{1,4}(?:[-_/=+][0-9]{1,4})*\Z|[-_=+/]+\Z")
#: Parts that can begin in one way only, taken whole: no string is looked at twice.
_PART = "(?:[A-Z]?[a-z]++|[A-Z]++|[0-9]{1,4}+)"
_IDENTIFIER = re.compile(rf"{_PART}(?:[-_/=+]{_PART})*+\Z|[a-z]++(?:[A-Z][a-z]{{2,}}+)++\Z")


@lru_cache(maxsize=4)
def load(path: str):
    import tiktoken
    from public_tokenizers import PATTERN

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Leftmost non-overlapping matches of each base kind, too short ones dropped; ends exclusive, in code points."""
    out = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST["assign"]]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]]
    # A run of hexadecimal digits is matched whole, so asking for the length in the pattern finds the same spans.
    out += [("hex", m.start(), m.end()) for m in re.finditer(r"[0-9a-f]{%d,}" % LEAST["hex"], text)]
    return out


def is_random(word: str, encode, ratio: float = RATIO, letters: float = LETTERS) -> bool:
    """Whether few characters a token expose a string; digests, UUIDs and numbers never are."""
    if _DIGEST.match(word) or _UUID.match(word) or _NUMBER.match(word):
        return False
    limit = letters if _IDENTIFIER.match(word) else ratio
    return len(word) < limit * sum(len(encode(word[i : i + PIECE])) for i in range(0, len(word), PIECE))


def random_spans(text: str, encode, ratio: float = RATIO, letters: float = LETTERS) -> list[tuple[str, int, int]]:
    out = []
    for m in CANDIDATE.finditer(text):
        word = m[0].strip("-_=+/")
        if len(word) >= 16 and is_random(word, encode, ratio, letters):
            out.append(("random", m.start(), m.end()))
    return out


def listed(spans) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (x[1], KINDS.index(x[0]), x[2])))


def scan(docs: DataFrame, vocabulary: str | None = None, ratio: float = RATIO) -> DataFrame:
    """docs with a column `spans`: array of (kind, start, end) in code points, by start.

    Null and empty texts have none.  All columns of docs are kept; one named spans is replaced.
    """
    path = vocabulary or default_vocabulary()
    given = docs.drop("spans")
    at = given.columns.index("text")

    def run(batches):
        encode = load(path).encode_ordinary
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        for b in chunks(batches):
            found = []
            for t in b.column(at).to_pylist():
                spans = base_spans(t) + random_spans(t, encode, ratio) if t else []
                found.append([{"kind": k, "start": s, "end": e} for k, s, e in sorted(spans, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, kind)], names=[*b.schema.names, "spans"])

    return given.mapInArrow(run, f"{ddl(given)}, spans array<struct<kind:string,start:int,end:int>>")


def ddl(df: DataFrame) -> str:
    return ", ".join(f"`{c}` {t}" for c, t in df.dtypes)


def redact(docs: DataFrame, mask: str = "[SECRET]", vocabulary: str | None = None, ratio: float = RATIO) -> DataFrame:
    """docs with the secrets of every text replaced by mask: overlapping spans as one; of an assignment only the value goes.

    Texts without secrets, and null ones, stay as they are; every row and column stays.
    """
    path = vocabulary or default_vocabulary()
    at = docs.columns.index("text")

    def clean(t: str | None, encode) -> str | None:
        if not t:
            return t
        spans = [(m.start(2), m.end(2)) for m in ASSIGN.finditer(t) if m.end(2) - m.start(2) >= LEAST["assign"]]
        spans += [(s, e) for k, s, e in base_spans(t) + random_spans(t, encode, ratio) if k != "assign"]
        out, done = [], 0
        for s, e in sorted(spans):
            if s >= done:
                out += [t[done:s], mask]
            done = max(done, e)
        return "".join([*out, t[done:]]) if spans else t

    def run(batches):
        encode = load(path).encode_ordinary
        for b in chunks(batches):
            columns = list(b.columns)
            columns[at] = pa.array([clean(t, encode) for t in b.column(at).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=b.schema.names)

    return docs.mapInArrow(run, ddl(docs))


def op9_query(spark, sf_dir: str) -> DataFrame:
    from .common import table

    found = scan(ids_and_texts(table(spark, sf_dir, "documents")))
    line = lambda spans: F.concat_ws(",", F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])))
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda x: x["kind"] != "random")
    return found.select("doc_id", *map(count, KINDS[:3]), F.sha2(line(base), 256).alias("base_sha256"), line(F.col("spans")).alias("spans"))


def base_digest(text: str) -> str:
    return hashlib.sha256(listed(base_spans(text)).encode()).hexdigest()
