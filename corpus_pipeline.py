"""The corpus pipeline: toxicity, line dedup, near-duplicate join, mixing to target weights, packing."""

from __future__ import annotations

import functools
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tremorgrid.llm import jaccard_join, line_dedup, mixing, packing, toxicity
from tremorgrid.llm.common import free_name
from tremorgrid.llm.queries import vocabulary
from tremorgrid.session import cut, discard, own_dir, ship_package, tables

_LEFT: dict[str, list[str]] = {}


def stage(function):
    """A stage begins by deleting the intermediate tables of the stage before it, whose rows have been written.

    A stage's own tables stay until then, so its result can be read and, if an executor is lost, read again.
    """
    @functools.wraps(function)
    def begin(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        ship_package(spark)
        application = spark.sparkContext.applicationId
        discard(spark, _LEFT.pop(application, []))
        before = set(tables(spark))
        result = function(spark, docs, sf_dir)
        _LEFT[application] = [path for path in tables(spark) if path not in before]
        return result

    return begin


@stage
def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows scored 0.5 or more go; the classifier learns from the labelled rows of ``documents``."""
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"),
                               spark.read.parquet(f"{sf_dir}/documents.parquet"))


@stage
def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated line runs go; every row stays, if need be with an empty text."""
    return line_dedup.dedup_lines(docs)


@stage
def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near duplicates stays; texts without words are one class."""
    return jaccard_join.drop_near_duplicates(docs)


@stage
def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it."""
    tag = free_name(docs, "row_tag")
    rows = cut(docs.withColumn(tag, F.monotonically_increasing_id()))
    copies = mixing.mix_sources(rows, tag=tag).filter("copies > 0 and size > 0").select(
        F.col("row_tag").alias(tag), F.col("copies").alias(tag + "_copies"))
    times = F.explode(F.sequence(F.lit(1).cast("long"), F.col(tag + "_copies")))
    return rows.join(copies.hint("merge"), tag).withColumn(tag, times).select(*docs.columns)


@stage
def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of 4096-token sequences along the curve."""
    return packing.pack_documents(docs, vocabulary("word_bpe_49k.json"))


STAGES = [
    ("toxicity", without_toxic),
    ("line dedup", without_repeated_lines),
    ("near duplicates", without_near_duplicates),
    ("mixing", mixed_sources),
    ("packing", packed),
]

#: Compression, banding, balanced sampling and tokenizing have no SQL; tests hold each stage against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each one's rows written to the shared folder and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = f"{own_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for number, (_, function) in enumerate(STAGES):
        function(spark, docs, sf_dir).write.parquet(f"{base}/{number}")
        docs = spark.read.parquet(f"{base}/{number}")
    return docs
