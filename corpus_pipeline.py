"""A training corpus from raw documents, stage by stage.

Each stage works on all that its predecessor kept; all but the last return the columns of ``documents``, with ``n_chars`` of the text
as it then is. Rows with nulls, repeated rows, empty tables and extra columns are handled as each operator's docstring says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.llm import line_dedup, ngram_join, packing, substring_dedup, toxicity
from fleetlens.llm.common import table
from fleetlens.session import materialize, ship_package


def counted(docs: DataFrame) -> DataFrame:
    """``n_chars`` of the text, where there is one."""
    return docs.withColumn("n_chars", F.coalesce(F.char_length("text").cast("long"), F.col("n_chars"))) if "n_chars" in docs.columns else docs


def clean_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text isn't judged toxic, by a model that learns from the labelled ones among them."""
    ship_package(spark)
    return toxicity.passing(docs, toxicity.fitted(spark, docs, table(spark, sf_dir, "labels")))


def first_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier line is equal or near to are dropped, and documents of which no line is left."""
    return counted(line_dedup.without_repeated_lines(docs))


def first_of_class(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies."""
    ship_package(spark)
    return ngram_join.representatives(docs)


def first_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Runs of words that an earlier document has are cut, and documents of which nothing is left go."""
    ship_package(spark)
    return counted(substring_dedup.without_repeats(docs))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Best-fit packing of what is left: a row per piece."""
    ship_package(spark)
    return packing.pack_documents(docs)


STAGES = [("toxicity", clean_language), ("line_dedup", first_lines), ("ngram_jaccard_join", first_of_class), ("substring_dedup", first_passages), ("best_fit_packing", packed)]

#: trained scores and similarity classes can't be stated in SQL; tests compare each stage with a brute-force version
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
