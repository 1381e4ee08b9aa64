"""A corpus pipeline of five operators: toxicity, near-duplicates, repeated passages, secrets, packing.

Every stage takes (spark, docs, sf_dir) and works on all that the one before kept; its result is written
as Parquet and read again.  All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wildgrid.llm.bloom import possible
from wildgrid.llm.common import fresh, materialise, table
from wildgrid.llm.packing import best_fit_packing
from wildgrid.llm.secrets import redact
from wildgrid.llm.simhash import similar_documents, text_hash
from wildgrid.llm.substring import cut_texts
from wildgrid.llm.toxicity import accepted, fit


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as toxic go.

    A null text is scored as an empty one; equal texts have equal scores, so repeated rows go or stay together; ids do not count.
    """
    return accepted(docs, fit(docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five words, similarity 0.8) one row stays, of the smallest id; rows without an id stay.

    Rows are known by id and text, so that of an id with several texts each is judged by itself.  Rows that a Bloom filter of
    those to be dropped does not pass stay without a join, so that their texts are not shuffled.
    """
    rows = materialise(similar_documents(docs), "similar").withColumnRenamed("text_hash", mark := fresh("text_hash", docs))
    key, gone = ["doc_id", mark], rows.where("not first")
    again = rows.where("first").groupBy(key).count().where("count > 1").drop("count")  # whole rows that repeat
    again = materialise(again, "again") if again.limit(1).count() else None
    listed = gone.select(key) if again is None else gone.select(key).union(again)
    given = docs.withColumn(mark, text_hash(docs))
    given = possible(given, listed, key, maybe := fresh("maybe", given))
    left = given.where(maybe).join(gone.select(key).distinct(), key, "left_anti")
    if again is not None:
        left = left.join(again, key, "left_anti").unionByName(left.join(again, key, "left_semi").dropDuplicates(key))
    return given.where(~F.col(maybe)).unionByName(left).select(docs.columns)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 13 or more words that a document with a smaller id has are cut out; other texts, null ones too, stay as they are.

    A missing id counts as the largest; rows that share an id keep their words from each other.
    """
    return _measured(cut_texts(docs))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; every row stays, and a text without any, or null, as it is."""
    return _measured(redact(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Training sequences: the bins with the ids, first words and sizes of their pieces; every row is placed, null ids and texts too."""
    return best_fit_packing(docs)


def _measured(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_duplicates),
    ("substring_dedup", cut_repeats),
    ("secret_scan", redact_secrets),
    ("best_fit_packing", pack),
]

#: SQL can express neither the classifier nor the packing; tests/llm/test_pipeline.py compares run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return docs
