"""Corpus pipeline: quality classifier, exact dedup, n-gram Jaccard join, mixing, packing.

Each stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept, and returns a DataFrame that is written
as Parquet and read again as the next stage's docs. All but the last return the columns of documents.

Null texts count as empty in every stage. Empty documents are scored by the classifier's bias alone; of those it keeps one is
left by exact dedup. Documents without words are linked with nothing and repeated with each whole pass of the mix; an empty
one is packed as id 0. Rows repeated in full are copies like any other. Without documents every stage gives an empty table with its
columns; without labels of both classes the classifier keeps all or none.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from mapgauge.llm import exact_dedup, mixing, ngram_join, packing, quality
from mapgauge.llm.common import shared_dir, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the classifier rejects."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each text."""
    return exact_dedup.drop_exact(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates."""
    return ngram_join.keep_one(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats and samples documents to the sources' target weights."""
    return mixing.sample_mix(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the mix into sequences; a row a piece."""
    return packing.pack(docs, **packing.public_files())


STAGES = [("quality", quality_stage), ("exact_dedup", exact_stage), ("ngram_join", near_stage), ("mixing", mixing_stage), ("packing", packing_stage)]

#: The classifier, the join's components and the tokens can't be had in SQL; tests hold the pipeline against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    at = f"{shared_dir(spark)}/corpus-{uuid.uuid4().hex}"
    for n, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{at}/{n}-{name}")
        docs = spark.read.parquet(f"{at}/{n}-{name}")
    return docs
