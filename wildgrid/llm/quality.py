"""Quality rules with adaptive thresholds.

Fixed rules come first.  What passes is measured (symbols, repeated lines and words, word length) and
the measures of each language and source are summed up in a mergeable quantile sketch: counts
of logarithmic buckets, exact below 64 and within 1/32 above.  Quartiles from the sketch give fences (Tukey's
rule with a margin), and documents outside their group's fences are rejected.  Groups of fewer
than `least` documents take the fences of their language's merged sketch, and rare languages those of all.

All of it is DataFrame and SQL expressions; the words of a text never leave its row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, materialise

#: Documents that a group needs for fences of its own.
LEAST = 30
#: Interquartile ranges beyond the quartiles, and the margins (symbols, lines and words in thousandths, word length in hundredths).
REACH, MARGIN = 3, {"symbols": 100, "lines": 300, "repeats": 300, "length": 150}
#: Groups up to which the fences are broadcast: about 2 MB.
MAX_GROUPS = 20_000
_BLANK = "[\\x20\\x09-\\x0D]"


def measures(docs: DataFrame) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words (long); other columns but text stay.

    A null text counts as empty.  Repeated windows are found by 64-bit hashes within a text.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    words = F.filter(F.split(text, f"{_BLANK}+"), lambda w: w != "")
    lines = F.filter(F.split(text, "\n", -1), lambda line: line.rlike("[^\\x20\\x09-\\x0D]"))

    def let(value: Column, body) -> Column:
        """body(value), the value worked out once."""
        return F.element_at(F.transform(F.array(value), body), 1)

    def covered(windows: Column) -> Column:
        """Words that some window found twice or more covers."""
        ranked = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def places(s: Column) -> Column:
            same = F.filter(s, lambda x, k: ((k > 0) & (F.get(s, k - 1)["h"] == x["h"])) | F.coalesce(F.get(s, k + 1)["h"] == x["h"], F.lit(False)))
            return F.size(F.array_distinct(F.flatten(F.transform(same, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))))

        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), 0).otherwise(let(ranked, places))

    def repeated(w: Column) -> Column:
        windows = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
        return F.when(F.size(w) >= 4, let(windows, covered)).otherwise(0)

    of_words = let(words, lambda w: F.struct(F.size(w).alias("n"), repeated(w).alias("r")))
    of_lines = let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))
    both = fresh("both", docs)
    kept = [c for c in docs.columns if c not in ("text", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    return docs.select(
        *kept, of_words.alias(both), (F.length(text) - F.regexp_count(text, F.lit(_BLANK))).cast("long").alias("word_chars"), F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"), of_lines.cast("long").alias("n_dup_lines")
    ).select(*kept, F.col(f"{both}.n").cast("long").alias("n_words"), "word_chars", "n_symbols", "n_dup_lines", F.col(f"{both}.r").cast("long").alias("n_repeat_words"))


#: From measured(doc_id, lang, source, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) to verdicts, in the SQL common to Spark and DuckDB.
_BUCKET = "CASE WHEN v < 64 THEN v ELSE CAST(floor(v / pow(2, length(bin(v)) - 6)) AS BIGINT) + 32 * (length(bin(v)) - 6) END"
_VALUE = "CASE WHEN b < 64 THEN b ELSE (b - 32 * CAST(floor((b - 32) / CAST(32 AS DOUBLE)) AS BIGINT)) * CAST(pow(2, floor((b - 32) / CAST(32 AS DOUBLE))) AS BIGINT) END"
_METRICS = {
    "symbols": "1000 * n_symbols / CAST(greatest(word_chars, 1) AS DOUBLE)",
    "lines": "1000 * n_dup_lines / CAST(greatest(n_words, 1) AS DOUBLE) * 10",
    "repeats": "1000 * n_repeat_words / CAST(greatest(n_words, 1) AS DOUBLE)",
    "length": "100 * word_chars / CAST(greatest(n_words, 1) AS DOUBLE)",
}
_ROWS = " UNION ALL ".join(f"SELECT lang, source, '{m}' AS metric, v_{m} AS v FROM judged WHERE NOT base_failed" for m in _METRICS)
_LEVELS = " UNION ALL ".join(f"SELECT {lang} AS lang, {source} AS source, metric, b, sum(n) AS n FROM sketch GROUP BY {', '.join(x for x in (lang, source, 'metric', 'b') if x[0] != chr(39))}" for lang, source in (("lang", "source"), ("lang", "'*'"), ("'*'", "'*'")))
_OUT = " OR ".join(f"coalesce(v_{m} > o.hi_{m} OR v_{m} < o.lo_{m}, false)" for m in _METRICS)
_FENCES = ", ".join(f"max(CASE WHEN metric = '{m}' THEN q3 + {REACH} * (q3 - q1) + {MARGIN[m]} END) AS hi_{m}, max(CASE WHEN metric = '{m}' THEN q1 - {REACH} * (q3 - q1) - {MARGIN[m]} END) AS lo_{m}" for m in _METRICS)
_CHOSEN = ", ".join(f"coalesce(a.{s}_{m}, l.{s}_{m}, g.{s}_{m}) AS {s}_{m}" for m in _METRICS for s in ("hi", "lo"))
JUDGED = f"SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, {', '.join(f'CAST(floor({e}) AS BIGINT) AS v_{m}' for m, e in _METRICS.items())} FROM measured"
SKETCH = f"""
bucketed AS (SELECT lang, source, metric, {_BUCKET} AS b FROM ({_ROWS}) r),
sketch AS (SELECT lang, source, metric, b, count(*) AS n FROM bucketed GROUP BY lang, source, metric, b)
"""
OWN = f"""
levels AS ({_LEVELS}),
run AS (SELECT lang, source, metric, b, sum(n) OVER (PARTITION BY lang, source, metric ORDER BY b) AS upto, sum(n) OVER (PARTITION BY lang, source, metric) AS total FROM levels),
quartiles AS (SELECT lang, source, metric, min(CASE WHEN 4 * upto >= total THEN {_VALUE} END) AS q1, min(CASE WHEN 4 * upto >= 3 * total THEN {_VALUE} END) AS q3, max(total) AS total
  FROM run GROUP BY lang, source, metric),
fences AS (SELECT lang, source, {_FENCES} FROM quartiles WHERE total >= {LEAST} GROUP BY lang, source),
own AS (SELECT k.lang AS lang, k.source AS source, {_CHOSEN} FROM (SELECT DISTINCT lang, source FROM sketch) k
  LEFT JOIN fences a ON k.lang = a.lang AND k.source = a.source LEFT JOIN fences l ON k.lang = l.lang AND l.source = '*' LEFT JOIN fences g ON g.lang = '*' AND g.source = '*')
"""
FENCES = f"{SKETCH}, {OWN}"
VERDICT = f"""SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT ({_OUT}) AS kept
FROM judged j LEFT JOIN own o ON j.lang = o.lang AND j.source = o.source"""


def judge(docs: DataFrame) -> DataFrame:
    """documents -> doc_id, the measures, base_failed and kept; a row for each row.

    A missing lang or source is a group of its own (the empty name).  The texts are measured once; the
    measures, small rows, are written to the shared folder, as sketches and filter both read them.
    """
    spark = docs.sparkSession
    named = docs.select("doc_id", "text", *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")))
    measured = materialise(measures(named), "measures")
    judged = spark.sql(JUDGED.replace("FROM measured", "FROM {measured}"), measured=measured)
    # The sketches, a row a bucket, are written once: three levels of groups are merged from them.
    sketch = materialise(spark.sql(f"WITH {SKETCH} SELECT * FROM sketch".replace("FROM judged", "FROM {judged}"), judged=judged), "sketch")
    own = materialise(spark.sql(f"WITH {OWN} SELECT * FROM own".replace("FROM sketch", "FROM {sketch}"), sketch=sketch), "fences")
    if own.count() <= MAX_GROUPS:  # a row a group; else the join is by language and source, and skew is left to adaptive execution
        own = F.broadcast(own)
    return spark.sql(VERDICT.replace("judged j", "{judged} j").replace("own o", "{own} o"), judged=judged, own=own)


def op8_query(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return judge(table(spark, sf_dir, "documents"))


OP8_SQL = f"""
WITH texts AS (SELECT row_number() OVER () AS r, doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
worded AS (SELECT *, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS w FROM texts),
windows AS (SELECT r, i, list_slice(w, i, i + 2) AS t FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM worded) x),
again AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, t) AS n FROM windows) x WHERE n > 1),
covered AS (SELECT r, count(DISTINCT i + k) AS n FROM again, (SELECT unnest([0, 1, 2]) AS k) ks GROUP BY r),
lines AS (SELECT r, count(*) - count(DISTINCT line) AS n FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM texts) x WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY r),
measured AS (SELECT doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(length(array_to_string(w, '')), 0) AS BIGINT) AS word_chars,
  CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(coalesce(l.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words
  FROM worded LEFT JOIN lines l USING (r) LEFT JOIN covered c USING (r)),
judged AS ({JUDGED}),
{FENCES}
{VERDICT}
"""
