"""Reading and writing document tables; partitioned by month, mode or key digit where the table is large."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.articles import upsert
from .schemas import TABLES

#: table -> (partition column, expression)
PARTITIONS = {
    "articles": ("ym", "date_format(timestamp_seconds(ctime), 'yyyyMM')"),
    "crawl_log": ("ym", "date_format(timestamp_seconds(ctime), 'yyyyMM')"),
    "error_log": ("ym", "date_format(timestamp_seconds(create_at), 'yyyyMM')"),
    "spider_task": ("mode", "mode"),
    "unique": ("digit", "substring(unid, 1, 1)"),
}


def conform(df: DataFrame, table: str) -> DataFrame:
    """The columns of a table's schema in its order, missing ones NULL."""
    schema = df.sparkSession.createDataFrame([], TABLES[table]).schema
    return df.select(*[(F.col(f"`{f.name}`") if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])


def write_table(df: DataFrame, path: str, table: str | None = None, mode: str = "append", fmt: str = "parquet") -> None:
    """Write a table; large ones partitioned, rows of a partition gathered before so that files stay few."""
    name, expression = PARTITIONS.get(table or "", (None, None))
    if name:
        df = df.withColumn(name, F.expr(expression)).hint("rebalance", name)
        df.write.mode(mode).format(fmt).partitionBy(name).save(path)
    else:
        df.write.mode(mode).format(fmt).save(path)


def read_table(spark: SparkSession, path: str, table: str | None = None, fmt: str = "parquet") -> DataFrame:
    """Read a table with its explicit schema (and partition column)."""
    reader = spark.read.format(fmt)
    if table:
        name = PARTITIONS.get(table, (None,))[0]
        extra = f", {name} string" if name and name not in ("mode",) else ""
        reader = reader.schema(TABLES[table] + extra)
    return reader.load(path)


def read_months(spark: SparkSession, path: str, table: str, first: int, last: int) -> DataFrame:
    """Rows with first <= time < last (epoch seconds); only the months between are read."""
    column = "create_at" if table == "error_log" else "ctime"

    def ym(t: int):
        return F.date_format(F.timestamp_seconds(F.lit(t)), "yyyyMM")

    rows = read_table(spark, path, table)
    return rows.where((F.col("ym") >= ym(first)) & (F.col("ym") <= ym(last))).where((F.col(column) >= first) & (F.col(column) < last))


def read_modes(spark: SparkSession, path: str, *modes: str) -> DataFrame:
    return read_table(spark, path, "spider_task").where(F.col("mode").isin(*modes))


def seen_of(spark: SparkSession, path: str, keys: DataFrame) -> DataFrame:
    """Rows of the seen set for the given unids; the join on the digit too prunes its folders."""
    wanted = keys.select("unid").distinct().withColumn("digit", F.substring("unid", 1, 1))
    return read_table(spark, path, "unique").join(wanted, ["digit", "unid"], "left_semi").select("unid", "ctime")


def fan_out(results: DataFrame, queues: list[str]) -> DataFrame:
    """(topic, value): each result id (mode, rid) as a JSON message for every named queue."""
    return results.select(F.explode(F.array(*[F.lit(q) for q in queues])).alias("topic"), F.to_json(F.struct("mode", "rid")).alias("value"))


def upsert_months(spark: SparkSession, path: str, incoming: DataFrame, table: str = "articles", key: str = "acid", newest: str = "utime") -> list[str]:
    """Upserts rows into a table written by month (see articles.upsert) and returns the months that were rewritten.

    Stored rows keep their ctime, and so their month; new ones go to the month of theirs.  Only the keys of the table are
    read to find the months in question, and only those months are joined and overwritten; the files of others stay as
    they are.  A failed run leaves the table as it was, a repeated one changes nothing more.
    """
    name, expression = PARTITIONS[table]
    stored = read_table(spark, path, table)
    keys = incoming.select(key).distinct()
    held = stored.select(key, name).join(keys, key, "left_semi")
    last = conform(incoming, table)
    fresh = last.groupBy(key).agg(F.max_by("ctime", newest).alias("ctime")).join(held.select(key), key, "left_anti")
    months = sorted(
        r[0] for r in held.select(name).union(fresh.select(F.expr(expression).alias(name))).where(F.col(name).isNotNull()).distinct().collect()
    )
    if months:
        merged = upsert(stored.where(F.col(name).isin(months)).drop(name), last, key, newest)
        dated = merged.withColumn(name, F.expr(expression)).hint("rebalance", name)
        dated.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(name).parquet(path)
        spark.catalog.refreshByPath(path)
    return months
