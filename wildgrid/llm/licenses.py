"""License scans by template-markup matching.

A template is a text with markup: <<beginOptional>> ... <<endOptional>> encloses wording that may be
left out, and <<var;name=...;max=N>> stands for up to N words of any kind.  It is compiled to a token
automaton whose states are positions in the template; a text is accepted where some run of its
words takes the automaton from start to end, that is, where all mandatory wording stands exactly.
Templates are whole licenses, and the notices by which texts name one.  Besides, fixed phrases give the base labels.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, ids_and_texts, text_bytes
from .license_texts import TEMPLATES

#: Phrases and their labels.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
_MARKUP = re.compile(r"<<(\w+)(?:;([^>]*))?>>|([^\s<]+)")


def words_of(text: bytes) -> list[bytes]:
    """Runs of ASCII letters and digits and of any byte beyond ASCII, A-Z lower-cased."""
    return text.translate(_FOLD).split()


@dataclass(frozen=True)
class Automaton:
    """States 0..n; step[s] is the word that leads on, or None for a replaceable word; free[s]: states reached without a word."""

    step: tuple[bytes | None, ...]
    free: tuple[tuple[int, ...], ...]
    heads: frozenset[bytes]
    mandatory: tuple[bytes, ...]

    def closure(self, states: set[int]) -> set[int]:
        out, todo = set(states), list(states)
        while todo:
            for t in self.free[todo.pop()]:
                if t not in out:
                    out.add(t)
                    todo.append(t)
        return out

    def match(self, words: list[bytes], start: int) -> int | None:
        """The end of the longest accepted run of words from start."""
        n, end = len(self.step), None
        states = self.closure({0})
        for i in range(start, len(words) + 1):
            if n in states:
                end = i
            if i == len(words):
                break
            w = words[i]
            states = self.closure({s + 1 for s in states if s < n and (self.step[s] is None or self.step[s] == w)})
            if not states:
                break
        return end


def compile_template(markup: str) -> Automaton:
    step: list[bytes | None] = []
    free: list[list[int]] = [[]]
    open_: list[int] = []
    mandatory: list[bytes] = []
    for m in _MARKUP.finditer(markup):
        tag, options, word = m.groups()
        if word or tag == "var":
            count = 1 if word else int(dict(x.split("=", 1) for x in (options or "").split(";") if "=" in x).get("max", 1))
            for piece in words_of(word.encode()) if word else [None] * count:
                step.append(piece)
                free.append([])
                if piece is None:
                    free[-2].append(len(step))
                if piece is not None and not open_:
                    mandatory.append(piece)
        elif tag == "beginOptional":
            open_.append(len(step))
        elif tag == "endOptional":
            if not open_:
                raise ValueError("endOptional without beginOptional")
            free[open_.pop()].append(len(step))
        else:
            raise ValueError(f"unknown markup {tag}")
    if open_:
        raise ValueError("beginOptional without endOptional")
    made = Automaton(tuple(step), tuple(map(tuple, free)), frozenset(), tuple(mandatory))
    start = made.closure({0})
    if not made.mandatory:
        raise ValueError("a template needs mandatory wording")
    if any(s < len(step) and step[s] is None for s in start):
        raise ValueError("a template must begin with wording")
    return Automaton(made.step, made.free, frozenset(step[s] for s in start if s < len(step)), made.mandatory)


@lru_cache(maxsize=1)
def compiled() -> tuple[tuple[str, Automaton, frozenset[bytes]], ...]:
    """Label, automaton and mandatory words of each template."""
    made = ((label, compile_template(markup)) for label, markups in TEMPLATES.items() for markup in markups)
    return tuple((label, a, frozenset(a.mandatory)) for label, a in made)


_PHRASES = [(tuple(p.encode().split()), label) for p, label in PHRASES.items()]


def scan_words(words: list[bytes]) -> tuple[list[tuple[int, str]], list[tuple[int, int, str, float]]]:
    """Places of the phrases (start, label), and accepted template runs (start, end, label, share of mandatory words in the run), leftmost of each template."""
    base, runs = [], []
    there = set(words)
    phrases = [(p, label) for p, label in _PHRASES if there.issuperset(p)]
    templates = [[label, a, 0] for label, a, needed in compiled() if there.issuperset(needed)]
    if phrases or templates:
        for i, w in enumerate(words):
            for p, label in phrases:
                if w == p[0] and tuple(words[i : i + len(p)]) == p:
                    base.append((i, label))
            for t in templates:
                label, a, done = t
                if i >= done and w in a.heads and (end := a.match(words, i)) is not None:
                    runs.append((i, end, label, min(1.0, len(a.mandatory) / (end - i))))
                    t[2] = end
    return base, runs


def scan(docs: DataFrame) -> DataFrame:
    """documents -> (doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans), a row for each row.

    spans are the accepted template runs (start and end word, label).  score is 0 without a finding, at
    least 0.5 with a phrase, and up to 1 the more of an accepted run is mandatory wording.  Null, empty
    and wordless texts have no words and no labels (empty strings).  Repeated rows each give their row; other columns of
    documents are not looked at, so their names cannot clash.
    """
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("label", pa.string())]))

    def run(batches):
        for b in chunks(batches):
            rows = []
            for t in text_bytes(b.column(1)):
                words = words_of(t)
                base, runs = scan_words(words)
                at = [i for i, _ in base]
                found = sorted({label for _, label in base})
                every = sorted({*found, *(r[2] for r in runs)})
                best = max([0.5 * bool(base), *(0.5 + 0.5 * r[3] for r in runs)])
                rows.append((len(words), len(base), min(at, default=None), max(at, default=None), ",".join(found), ",".join(every), best, [{"start": s, "end": e, "label": label} for s, e, label, _ in runs]))
            columns = list(zip(*rows, strict=True))
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), span]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"])

    return ids_and_texts(docs).mapInArrow(
        run, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<start:int,end:int,label:string>>"
    )


def op7_query(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return scan(table(spark, sf_dir, "documents")).withColumn("n_templates", F.size("spans").cast("long")).drop("spans")
