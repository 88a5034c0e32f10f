"""A corpus from raw documents to piece ids, stage by stage.

Every stage is a function of (spark, docs, sf_dir) that returns a DataFrame; it is
written as Parquet and read again as the next stage's ``docs``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from terrace.llm import credentials, mixing, pieces, quality, token_groups
from terrace.llm.common import shared_path
from terrace.llm.queries import DROPOUT, SEED, piece_model

#: A mild mix: shares move a little towards equal ones, most tokens stay.
POWERS, BUDGET = {"source": 0.9, "lang": 0.9, "topic": 0.95}, 0.9


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the adaptive quality rules keep."""
    return quality.accepted(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that shares five-word shingles to a similarity of 0.8."""
    return token_groups.keep_one_per_group(docs, 5, 80)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their credentials replaced by a mark."""
    return credentials.redacted(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample whose expected tokens meet the tempered margins as far as the tokens held allow; ``mixing.margin_report`` shows how far."""
    return mixing.sampled(docs, POWERS, BUDGET, SEED)


def piece_coding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with the piece ids of their text."""
    return pieces.encode(docs, piece_model(), DROPOUT, SEED)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("secret_scan", secret_scan),
    ("source_mix", source_mix),
    ("piece_coding", piece_coding),
]

#: Piece coding and the similarity join can't be written in SQL; tests hold the rows against a plain version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each returns is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        out = stage(spark, docs, sf_dir)
        path = shared_path(spark, f"pipeline-{name}")
        out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
    return docs
