"""A corpus from documents to token ids: five stages, each over all the one before kept.

A stage takes (spark, docs, sf_dir) and returns rows with the columns of
``documents``; the last returns the digest of the store it wrote.  Between stages
rows are written as Parquet and read again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quadrat.llm.common import keep, new_path, table
from quadrat.llm.decontaminate import without_items
from quadrat.llm.mixing import mixed
from quadrat.llm.queries import vocabulary
from quadrat.llm.similar import one_of_each
from quadrat.llm.token_store import TokenStore
from quadrat.llm.toxicity import accepted


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorization machine scores below one half.

    Null and empty texts score low and stay; repeated rows are judged alike; texts are
    read whole.  An empty table gives an empty one.
    """
    return accepted(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts whose five-word shingles are similar to 0.8: that of least id.

    Null, empty and blank texts are one group; repeated rows leave one, and a null id
    stays only where its group has no other.  An empty table gives an empty one.
    """
    return one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item.

    Null and empty texts hold none; an empty benchmark or table changes nothing.
    """
    return without_items(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix by source: documents left out, taken once or taken twice.

    A null source is one of its own.  Of equal ranks the smaller id comes first.
    Texts without words are taken as often as all of their source is.  An empty table gives an empty one.
    """
    return mixed(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digest of the token store, read back from its files: a row per document taken.

    Null and empty texts are the end id alone, repeated rows are documents of their own,
    null ids come first.  An empty table gives no rows.
    """
    store = TokenStore(spark, new_path(spark, "corpus"))
    return store.write(docs, vocabulary("byte_bpe_50k.json")).digests()


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("token_ids", token_ids),
]

#: SQL cannot express the learned first stage; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
