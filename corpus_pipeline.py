"""From raw documents to a training mix: five stages, each of which calls one operator over all that the stage before kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of ``documents``. The last
one adds a row's domain, its tokens, and how many epochs it is taken for.

Defined cases: a null or blank text fails the quality rules and goes; a row without a doc_id is judged by its text in quality and
secrets, is never a duplicate of a row with one, is never found to leak, and is mixed like any other; rows of one doc_id with
different texts are judged each by its own text, except that all rows of a doc_id go if a benchmark item is found in one of
them; rows alike in doc_id and words leave one; of linked documents the smallest doc_id stays; texts of any length are read
whole; an empty table gives an empty one; further columns, whatever their names, are carried through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from orbisplit.llm import decontaminate, mixing, ngram_join, quality_rules, secret_scan
from orbisplit.llm.common import materialise, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the production policy rejects go."""
    return quality_rules.keep(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest doc_id stays."""
    return ngram_join.first_of_groups(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which an item of the benchmark is found go."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced within texts; every document stays."""
    return secret_scan.redact(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix, with the epochs each is taken for."""
    return mixing.mix(docs)


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secrets", secrets),
    ("mixture", mixture),
]
#: SQL cannot express the templates of decontamination; tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
