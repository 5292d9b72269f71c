"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before
kept; all but the last return the columns of ``documents``.  ``run`` writes every
stage's result as Parquet in the shared folder and reads it again for the next,
so a lost executor costs a part of one stage at most.

Every stage takes nulls in any column, empty and very long texts, ties, repeated rows, tables without rows and
columns beyond those of ``documents``, which it keeps whatever their names; what it makes of them is told below.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cotejo.llm import mixing, packing, quality_model, secret_scan, simhash
from cotejo.llm.common import new_folder, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts.

    Null and empty texts are scored like others, equal texts alike; the text alone decides.
    """
    return quality_model.accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group, that with the smallest doc_id.

    Shingle length and distance are op7's.  A missing doc_id is the smallest; null and empty texts are one
    group; of rows equal in doc_id and text one stays, the first by a hash of all columns.
    """
    return simhash.one_of_each(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets redacted; n_chars follows the text.  Null texts stay null, repeated rows stay."""
    found = secret_scan.redacted(docs, secret_scan.Ledger(spark, new_folder(spark, "ledger")))
    return found.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else found


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times (none, once or twice) as its source's target takes it.

    A null source is one, texts without words have size 0 and go with their hash, repeated rows are dealt one by one.
    """
    return mixing.repeated(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per piece of each document: the sequence that holds it, and where.

    Texts without words have a row without a sequence; repeated rows never share one.
    """
    return packing.pack(docs)


STAGES = [
    ("quality classifier", quality),
    ("simhash near-dedup", near_duplicates),
    ("secret scans", secrets),
    ("mixing to target weights", mixture),
    ("best-fit packing", packed),
]
#: A trained model and XXH64 have no SQL; the tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed sequences of ``documents`` in ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES[:-1]):
        docs = written(stage(spark, docs, sf_dir), f"stage{i}")
    return STAGES[-1][1](spark, docs, sf_dir)
