"""The driver's queries of the operators, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quadrat.llm.common import table


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quadrat.llm.common import new_path
    from quadrat.llm.token_store import TokenStore

    store = TokenStore(spark, new_path(spark, "tokens"))
    return store.write(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json")).digests()


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quadrat.llm.decontaminate import contaminated

    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quadrat.llm.toxicity import toxicity

    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quadrat.llm.mixing import mix

    return mix(table(spark, sf_dir, "documents"))


def op5_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quadrat.llm.passages import repeated_passages

    return repeated_passages(table(spark, sf_dir, "documents"))


def op6_additive(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quadrat.llm.additive import search

    return search(table(spark, sf_dir, "embeddings"))


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quadrat.llm.html_text import extract

    return extract(table(spark, sf_dir, "pages"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quadrat.llm.token_counts import token_counts

    return token_counts(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quadrat.llm.simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quadrat.llm.pii import report

    return report(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    from quadrat.llm.mixing import MIX_SQL

    return {"op4_mixing": MIX_SQL}
