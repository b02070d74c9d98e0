"""Tables in the cluster's shared folder that cut lineage, and connected components."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import new_path

#: Rounds after which components() gives up; two alternations halve the longest path, so 2^30 nodes in a row would pass.
MAX_ROUNDS = 60
#: Spark deletes the shuffle files of a query at its end under this setting.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: The tables cut inside each open scratch() block, innermost last.
_OPEN: list[list[str]] = []


def _write(df: DataFrame) -> str:
    """Path of a new table that holds `df`; the shuffle files behind it go as soon as it is written."""
    spark = df.sparkSession
    path = new_path(spark)
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return path


def delete(spark: SparkSession, path: str) -> None:
    """Removes a table that nothing will read again."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def cut(df: DataFrame) -> DataFrame:
    """`df` written as a table in the shared folder and read again: lost executors cost no recomputation behind it.

    The table stays until the end of the innermost scratch() block, for good outside of one.
    """
    path = _write(df)
    if _OPEN:
        _OPEN[-1].append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def settle(spark: SparkSession, build: Callable[[], DataFrame]) -> tuple[DataFrame, str]:
    """What `build` returns as a table, and its path; every table cut on the way is deleted."""
    with scratch(spark):
        df = build()
        path = _write(df)
    return spark.read.schema(df.schema).parquet(path), path


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes the tables cut inside the block at its end; nothing that reads them may be used after it."""
    _OPEN.append([])
    try:
        yield
    finally:
        for path in _OPEN.pop():
            delete(spark, path)


def components(edges: DataFrame) -> DataFrame:
    """(node, class_id) of every node of `edges` (long columns a, b); class_id is the least node of the component.

    Alternating large-star and small-star steps: neighbour lists are never gathered, each step is a minimum
    by key and a join on the same key, and the edges stay as many as the nodes.  The table of a step is deleted
    once the next one is written.
    """
    spark, schema = edges.sparkSession, "a long, b long"
    path = _write(
        edges.where("a <> b").select(F.greatest("a", "b").cast("long").alias("a"), F.least("a", "b").cast("long").alias("b")).distinct()
    )
    before = None
    for _ in range(MAX_ROUNDS):
        now = spark.read.schema(schema).parquet(path)
        both = now.select("a", "b").union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        small = large.groupBy("a").agg(F.min("b").alias("m"))
        step = large.join(small, "a")
        old, path = path, _write(
            step.where("b <> m").select(
                F.col("b").alias("a"), F.col("m").alias("b")
            ).union(step.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        )
        delete(spark, old)
        state = spark.read.schema(schema).parquet(path).agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError("components did not settle")
    if _OPEN:
        _OPEN[-1].append(path)
    now = spark.read.schema(schema).parquet(path)
    return now.select(
        F.col("a").alias("node"), F.col("b").alias("class_id")
    ).union(now.select(F.col("b").alias("node"), F.col("b").alias("class_id"))).groupBy("node").agg(F.min("class_id").alias("class_id"))
