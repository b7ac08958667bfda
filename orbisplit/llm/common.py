"""Pieces the training-data operators share: word rules, table reading, and work tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orbisplit.sources.tables import materialise, shared_root, work_dir

__all__ = ["BREAK", "bounded_batches", "free_name", "materialise", "shared_root", "table", "words", "work_dir"]

#: What separates words: the space and the ASCII controls from tab to carriage return.
BREAK = r"[\x20\x09-\x0D]+"
#: Arrow batches that reach Python stay below this size, whatever the length of the texts.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """Array of the words of a text, without empty strings; a null text has none."""
    parts = F.split(F.coalesce(text, F.lit("")), BREAK)
    return F.filter(parts, lambda w: w != "")


def bounded_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small in rows and bytes: texts have no upper length. This holds for the session from here on, since batches are
    made when a result is, not when a plan is."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def free_name(columns: Sequence[str], wanted: str) -> str:
    """A column name that clashes with none of the given ones, letter case aside."""
    taken = {c.lower() for c in columns}
    while wanted.lower() in taken:
        wanted = "_" + wanted
    return wanted
