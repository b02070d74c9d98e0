"""Structured Streaming forms of the queue workers."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.dedupe import insert_if_absent
from ..operators.frontier import RUNS_KEPT
from ..sources.schemas import MESSAGE
from ..sources.scratch import new_path

# Error classes that are retried, and those that end a task quietly.
RETRIED = ("ProxyError", "ConnectionError", "Timeout", "NoResponse", "Forbidden")
IGNORED = ("NoNextPage", "MoreThanMaximum", "NoExists", "NoSource", "ReturnBroken", "DebugBroken")
RETRIES = 5


def read_messages(spark: SparkSession, fmt: str = "json", path: str | None = None, schema: str = MESSAGE, **options) -> DataFrame:
    """A stream of messages: `kafka` (value parsed as JSON; bad ones have a NULL mode and their text in `raw`), or files of JSON lines."""
    reader = spark.readStream.format("text" if fmt == "json" else fmt).options(**options)
    raw = (reader.load(path) if path else reader.load()).select(F.col("value").cast("string").alias("raw"))
    return parse_messages(raw, schema)


def parse_messages(raw: DataFrame, schema: str = MESSAGE) -> DataFrame:
    return raw.withColumn("m", F.from_json("raw", schema)).select("m.*", "raw")


def write_messages(
    df: DataFrame, checkpoint: str, fmt: str = "json", path: str | None = None, trigger: dict | None = None, **options
) -> StreamingQuery:
    """Write messages (topic, value) to a sink: `kafka`, or files of JSON lines in a folder for each topic, which read_messages reads."""
    writer = df.select("topic", "value").writeStream.option("checkpointLocation", checkpoint).options(**options).outputMode("append")
    writer = writer.format("text").partitionBy("topic") if fmt == "json" else writer.format(fmt)
    writer = writer.trigger(**trigger) if trigger else writer
    return writer.start(path) if path else writer.start()


def run_available(df: DataFrame, mode: str = "append") -> DataFrame:
    """Runs a stream over all that its source holds now; the rows of its batches, with their `epoch`.

    A batch is written to a folder of its own, so one that is repeated after a failure replaces itself.
    """
    spark, folder = df.sparkSession, new_path(df.sparkSession)

    def save(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/rows/epoch={epoch}")

    query = df.writeStream.foreachBatch(save).outputMode(mode).option(
        "checkpointLocation", f"{folder}/state"
    ).trigger(availableNow=True).start()
    query.awaitTermination()
    schema = df.schema.add("epoch", "long")
    return spark.read.schema(schema).parquet(f"{folder}/rows") if query.lastProgress else spark.createDataFrame([], schema)


def dispatch(messages: DataFrame, modes: Sequence[str], default: str | None = None) -> dict[str, DataFrame]:
    """Messages by mode; the default handler takes those without a mode, which are rejected if there is none; unreadable ones are rejected."""
    mode = F.coalesce("mode", F.lit(default)) if default else F.col("mode")
    known = messages.withColumn("mode", mode)
    good = F.coalesce(F.col("mode").isin(*modes), F.lit(False))
    return {m: known.where(F.col("mode") == m) for m in modes} | {"rejected": known.where(~good)}


def first_seen(stream: DataFrame, event_time: str | None = None, bound: str = "7 days") -> DataFrame:
    """First row of each unid; with an event time the state is bounded and history is left to `first_seen_batch`."""
    if event_time:
        return stream.withWatermark(event_time, bound).dropDuplicatesWithinWatermark(["unid"])
    return stream.dropDuplicates(["unid"])


def first_seen_batch(
    read_seen: Callable[[DataFrame], DataFrame], sink: Callable[[DataFrame, int], None], order: tuple[str, ...] = ("ctime",)
) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: exact first-seen against the whole history; new rows go to the sink."""
    def run(batch: DataFrame, epoch: int) -> None:
        marked = insert_if_absent(batch, read_seen(batch), order)
        sink(marked.where("inserted").drop("inserted", "seen_ctime"), epoch)

    return run


def run_history(runs: DataFrame, kept: int = RUNS_KEPT) -> DataFrame:
    """(uuid, runs): the last run ids of each task, kept as state; an updated row whenever a task has new runs."""
    def update(key, batches, state):
        have = list(state.get[0]) if state.exists else []
        for pdf in batches:
            have += pdf["run"].tolist()
        have = sorted(set(have))[-kept:]
        state.update((have,))
        yield pd.DataFrame({"uuid": [key[0]], "runs": [have]})

    return runs.groupBy("uuid").applyInPandasWithState(update, "uuid long, runs array<long>", "runs array<long>", "update", "NoTimeout")


def retry_action(
    error_class: Column, attempt: Column, retries: int = RETRIES, retried: Sequence[str] = RETRIED, ignored: Sequence[str] = IGNORED
) -> Column:
    """retry, ignore or log."""
    return F.when(error_class.isin(*ignored), "ignore").when(error_class.isin(*retried) & (attempt <= retries), "retry").otherwise("log")


def with_attempts(errors: DataFrame) -> DataFrame:
    """A stream of errors (task, class, seq) with the attempt number of each, by seq inside a batch, kept as state by task and class."""

    def count(key, batches, state):
        n = state.get[0] if state.exists else 0
        seqs = sorted(x for pdf in batches for x in pdf["seq"].tolist())
        state.update((n + len(seqs),))
        yield pd.DataFrame({"task": key[0], "class": key[1], "seq": seqs, "attempt": range(n + 1, n + 1 + len(seqs))})

    return errors.select("task", "class", "seq").groupBy("task", "class").applyInPandasWithState(
        count, f"task {errors.schema['task'].dataType.simpleString()}, class string, seq long, attempt long", "n long", "append", "NoTimeout"
    )


def apply_messages(change: Callable[[DataFrame], None], order: str = "seq") -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that hands the readable messages of a batch to a table change."""
    def run(batch: DataFrame, epoch: int) -> None:
        change(batch.where("mode is not null or status is not null").drop("raw"))

    return run


def detail_work(messages: DataFrame, stored: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(work items, errors) of result messages: rid, or a list of rids, joined to the articles; missing articles are errors."""
    one = F.when(F.startswith(F.ltrim("rid"), F.lit("[")), F.from_json("rid", "array<string>")).otherwise(F.array("rid"))
    each = messages.select("mode", F.explode(one).alias("rid"))
    joined = each.join(stored.select("rid", "url", F.lit(True).alias("_has")), "rid", "left")
    return joined.where("_has").select("mode", "rid", "url"), joined.where("_has is null").select(
        "mode", "rid", F.lit("article missing").alias("error")
    )


def daily_articles(stream: DataFrame, event_time: str, late: str = "2 days") -> DataFrame:
    """(day, articles) with late rows up to the bound."""
    return stream.withWatermark(event_time, late).groupBy(F.window(event_time, "1 day")).agg(F.count("*").alias("articles")).select(
        F.to_date("window.start").alias("day"), "articles"
    )
