"""The corpus pipeline: quality, exact and near duplicates, personal data, packing.

Every stage takes (spark, docs, sf_dir) and returns a frame; all but the last keep the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from perigee.llm.exact_dedup import drop_exact
from perigee.llm.near_copies import drop_near_copies
from perigee.llm.packing import pack
from perigee.llm.pii import redact
from perigee.llm.quality import drop_poor
from perigee.llm.runtime import remove, settle, work_dir


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go.

    A null text counts as empty; null sources and languages are groups; equal rows are judged alike; very long texts are
    described whole; without labels of both classes, or without rows, nothing goes.
    """
    return drop_poor(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest identifier stays.

    A null text equals an empty one; a null identifier is below every other; of equal rows the last one stays; very long
    texts are compared whole; an empty table stays empty.
    """
    return drop_exact(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents alike in five-word shingles to 0.8, or linked by fingerprints, the one with the least identifier stays.

    Texts without words, null ones too, are alike; a null identifier is above every other; of equal rows the first one stays;
    very long texts are shingled whole; an empty table stays empty.
    """
    return drop_near_copies(docs)


def privacy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind.

    A null text stays null; equal rows stay and are changed alike; very long texts are searched whole; an empty table stays empty.
    """
    return redact(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences with the place of every piece of a document.

    A null text is the end token alone; null identifiers and equal rows are packed like any other; a very long text is cut at
    the capacity; an empty table gives no pieces.
    """
    return pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("exact", exact),
    ("near", near),
    ("privacy", privacy),
    ("packing", packing),
]

#: Classifier, fingerprints and tokens aren't expressible in SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again by the next."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        path = work_dir(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            remove(spark, before)
        before = path
    out = settle(STAGES[-1][1](spark, docs, sf_dir))
    remove(spark, before)
    return out
