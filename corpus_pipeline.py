"""A corpus pipeline: each stage applies one operator to what the stage before has kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from guichet.llm import minhash_join, mixing, pii, quality_forest, segment_sampling
from guichet.llm.common import table
from guichet.llm.queries import PIECE_MODEL
from guichet.operators.settle import stage

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    return quality_forest.keep_good(docs, quality_forest.fit_forest(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    return minhash_join.keep_one_of_each(docs)


def surrogates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data gives way to surrogates; ``n_chars`` follows the new text."""
    return pii.replace(docs, length_col="n_chars")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources come to their target weights; a document taken twice is there twice."""
    return mixing.Mix(docs).rows()


def segmentations(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sampled segmentations of every text; a document taken twice gives its samples twice."""
    return segment_sampling.sample_segmentations(docs, PIECE_MODEL)


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("surrogates", surrogates),
    ("mix_sources", mix),
    ("sample_segmentations", segmentations),
]

# Signatures, keyed hashes and sampled segmentations cannot be stated in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written as Parquet to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, apply in STAGES[:-1]:
        docs = stage(apply(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
