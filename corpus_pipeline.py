"""Corpus pipeline: documents to the rates of a training mix, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; every stage is written as Parquet and read again
before the next.  All but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webharvest.llm._tables import delete, settle
from webharvest.llm.decontaminate import decontaminate
from webharvest.llm.jaccard_join import jaccard_join
from webharvest.llm.mixing import mix_sources
from webharvest.llm.pii import redact
from webharvest.llm.quality import fit_classifier


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Low-quality and toxic documents go, null and wordless texts among them; rows without an id are judged like others."""
    return fit_classifier(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).keep(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked near copies the document of the least doc_id stays.

    Null and wordless texts are copies of each other.  Rows without an id stay; repeated rows of one id are one
    document, which stays or goes as a whole.
    """
    others = jaccard_join(docs).where("doc_id <> class_id").select("doc_id")
    return docs.join(others, "doc_id", "left_anti").select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, copied or edited, go; null texts and rows without an id stay."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in texts is replaced by its kind; n_chars follows where there is such a column.  Null texts stay null."""
    clean = redact(docs)
    if "n_chars" not in docs.columns:
        return clean
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words that the mix takes of each document; null texts have none, null sources are one source."""
    return mix_sources(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("mixing", mixing),
]
#: Training, sampled paths and Newton steps have no SQL; tests/llm/test_pipeline.py compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows.  Each stage's table, and what it needed on the way, is deleted once the next one is written."""
    docs, path = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES[:-1]:
        docs, new = settle(spark, partial(stage, spark, docs, sf_dir))
        if path:
            delete(spark, path)
        path = new
    return STAGES[-1][1](spark, docs, sf_dir)
