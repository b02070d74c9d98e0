"""First-seen items and repeated pages."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLOOM_BITS = 1 << 30
BLOOM_SEEDS = 6
#: Bits of a row of the bitmap's table (128 KB), and the most that a bitmap sent to tasks can have (256 MB).
CHUNK_BITS, MOST_BITS = 20, 1 << 31


def insert_if_absent(
    batch: DataFrame, seen: DataFrame | None, order: tuple[str, ...] = ("ctime",), salts: int = 16, buckets: int | None = None
) -> DataFrame:
    """batch (unid, ctime, ...) with (inserted, seen_ctime): whether a row is the first of its unid, and the stored ctime.

    seen: (unid, ctime), a row for each unid.  Ties go by `order`, which should tell rows apart.  The rows of a unid
    are dealt by a hash of their values into `salts` parts, each with its own first row; only those firsts meet
    each other and the seen set, so neither a hot unid nor the whole batch is sorted by unid in one task.  buckets: of a
    seen set in a table of so many buckets of unid (sources.seen), to which the firsts are dealt.
    """
    plain = [f.name for f in batch.schema if not isinstance(f.dataType, (T.MapType, T.ArrayType, T.StructType, T.VariantType))]
    salted = batch.withColumn("_salt", F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in plain]), F.lit(salts)).cast("int"))
    ranked = salted.withColumn("_k", F.row_number().over(Window.partitionBy("unid", "_salt").orderBy(*order)))
    by_order = Window.partitionBy("unid").orderBy("_o", "_salt")
    firsts = ranked.where("_k = 1").select("unid", "_salt", F.struct(*order).alias("_o"), F.col("ctime").alias("_ctime"))
    if buckets:
        firsts = firsts.repartition(buckets, "unid")
    firsts = firsts.withColumn(
        "_win", F.row_number().over(by_order) == 1
    ).withColumn("_first", F.first("_ctime").over(by_order)).drop("_o", "_ctime")
    stored = F.lit(None).cast(batch.schema["ctime"].dataType)
    if seen is not None:
        firsts = firsts.join(seen.select("unid", F.col("ctime").alias("_stored")), "unid", "left")
        stored = F.col("_stored")
    firsts = firsts.select(
        "unid", "_salt", (F.col("_win") & stored.isNull()).alias("_win"), F.coalesce(stored, "_first").alias("seen_ctime")
    )
    marked = ranked.join(
        firsts.withColumnRenamed("unid", "_unid"), F.col("unid").eqNullSafe(F.col("_unid")) & (ranked["_salt"] == firsts["_salt"])
    )
    return marked.select(*[ranked[f"`{c}`"] for c in batch.columns], (F.col("_win") & (F.col("_k") == 1)).alias("inserted"), "seen_ctime")


def bloom_offsets(key: Column, bits: int = BLOOM_BITS, hashes: int = BLOOM_SEEDS) -> Column:
    """The bit positions of a key: h = h * (1 + seed) + code point over its characters, modulo the number of bits."""
    chars = F.filter(F.split(key, ""), lambda c: c != "")
    return F.array(*(_fold(chars, seed, bits) for seed in range(hashes)))


def _fold(chars: Column, seed: int, bits: int) -> Column:
    def step(h: Column, c: Column) -> Column:
        return F.pmod(h * (1 + seed) + F.ascii(c), F.lit(bits)).cast("long")

    return F.aggregate(chars, F.lit(0).cast("long"), step)


def _bit_numbers(keys: Column, bits: int, hashes: int) -> Column:
    return F.array_distinct(bloom_offsets(keys, bits, hashes))


def bloom_bits(keys: DataFrame, column: str = "unid", bits: int = BLOOM_BITS, hashes: int = BLOOM_SEEDS) -> DataFrame:
    """The bitmap as a table (chunk, bits) of 2^CHUNK_BITS bits a row, chunks without a set bit left out.

    A task sends its set bits as one row for each chunk that they fall into, not one for each bit.
    """

    def spots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.unique(batch.column(0).flatten().to_numpy())
            chunk = at >> CHUNK_BITS
            cuts = np.flatnonzero(np.diff(chunk, prepend=-1))
            packed = [x.tobytes() for x in np.split((at & ((1 << CHUNK_BITS) - 1)).astype(np.uint32), cuts[1:])] if len(at) else []
            yield pa.RecordBatch.from_arrays([pa.array(chunk[cuts], pa.int64()), pa.array(packed, pa.binary())], names=["chunk", "spots"])

    def joined(table: pa.Table) -> pa.Table:
        flags = np.zeros(1 << CHUNK_BITS, np.uint8)
        for x in table.column("spots").to_pylist():
            flags[np.frombuffer(x, np.uint32)] = 1
        return pa.table({"chunk": table.column("chunk").slice(0, 1), "bits": [np.packbits(flags).tobytes()]})

    numbers = keys.where(F.col(column).isNotNull()).select(_bit_numbers(F.col(column), bits, hashes).alias("at"))
    return numbers.mapInArrow(spots, "chunk long, spots binary").groupBy("chunk").applyInArrow(joined, "chunk long, bits binary")


def bloom_check(keys: DataFrame, table: DataFrame, column: str = "unid", bits: int = BLOOM_BITS, hashes: int = BLOOM_SEEDS) -> DataFrame:
    """Distinct keys with is_new: True if any of their bits is not set.

    The bitmap has a fixed size (of `bits` bits, 128 MB by default), whatever the number of keys; it is sent to the tasks
    whole, so a key is probed where it is and moves once, to be made distinct.
    """
    if bits > MOST_BITS:
        raise ValueError(f"a bitmap of over {MOST_BITS} bits is not sent to the tasks")
    bitmap = np.zeros(-(-bits // (1 << CHUNK_BITS)) << (CHUNK_BITS - 3), np.uint8)
    width = 1 << (CHUNK_BITS - 3)
    for r in table.toLocalIterator():
        bitmap[r.chunk * width : (r.chunk + 1) * width] = np.frombuffer(r.bits, np.uint8)
    sent = keys.sparkSession.sparkContext.broadcast(bitmap)

    @F.arrow_udf("boolean")
    def missing(numbers: pa.Array) -> pa.Array:
        flat = numbers.flatten().to_numpy()
        unset = sent.value[flat >> 3] >> (7 - (flat & 7)).astype(np.uint8) & 1 == 0
        total = np.concatenate([[0], np.cumsum(unset)])
        ends = numbers.offsets.to_numpy() - numbers.offsets[0].as_py()
        return pa.array(total[ends[1:]] > total[ends[:-1]])

    distinct = keys.select(column).where(F.col(column).isNotNull()).distinct()
    return distinct.select(column, missing(_bit_numbers(F.col(column), bits, hashes)).alias("is_new"))


def before_repeat(
    pages: DataFrame, run: str = "run", page: str = "page", content: str = "content_md5", url: str = "url", parsed: str = "parsed_md5"
) -> DataFrame:
    """Pages of each run before the first one that repeats the page before it (content, url or parsed rows)."""
    order = Window.partitionBy(run).orderBy(page)
    same = F.lit(False)
    for c in (content, url, parsed):
        if c in pages.columns:
            same = same | F.coalesce(F.col(c) == F.lag(c).over(order), F.lit(False))
    return pages.withColumn("_same", same.cast("int")).withColumn(
        "_stop", F.max("_same").over(order.rowsBetween(Window.unboundedPreceding, 0))
    ).where("_stop = 0").drop("_same", "_stop")


def until_nothing_new(pages: DataFrame, run: str = "run", page: str = "page", new: str = "new_count", allowed: int = 1) -> DataFrame:
    """Pages of each run up to and with the `allowed`-th one that brought nothing new."""
    order = Window.partitionBy(run).orderBy(page).rowsBetween(Window.unboundedPreceding, -1)
    empty = F.sum(F.when(F.col(new) == 0, 1).otherwise(0)).over(order)
    return pages.withColumn("_empty", F.coalesce(empty, F.lit(0))).where(F.col("_empty") < allowed).drop("_empty")
