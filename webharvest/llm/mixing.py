"""Mixing sources to target weights by entropy balancing.

Every document gets a rate, the mean number of its copies in the mix: of all rates from 0 to `cap` that give
each source its target words, those closest to one in relative entropy, which are exponentially tilted:
rate = min(cap, exp(tilt * size)).  Newton steps solve the convex dual for the tilts, each step one
distributed sum by source.  Rates are then rounded into whole copies, size by size from the largest down, the
rounding error of a size carried on to the next, so a source's words come within about its smallest text of
the target.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.query import assign_ids
from ._tables import cut

#: Rows of one source and size that are ranked together, about; a hot size is spread over as many buckets as it needs.
BUCKET_ROWS = 10_000
WORD = r"[^\x20\x09-\x0D]+"


def text_size(text: Column) -> Column:
    """Number of words of a text, null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _key(source: str | Column = "source") -> Column:
    """Sources as join keys: null is a key of its own, apart from every text."""
    source = F.col(source) if isinstance(source, str) else source
    return F.coalesce(F.concat(F.lit("s"), source), F.lit("n"))


def source_targets(sources: DataFrame, cap: float = 3.0) -> DataFrame:
    """(source, source_size, target) of `sources` (source, source_size; a row each).

    Weights 1, 2, 3, repeating, by source in code point order, null last.  The targets share all words by
    weight; no target is over `cap` times its source's size, what is cut off is shared by the rest: the level per
    weight rises, a distributed sum each round, until no further source is cut.
    """
    named = assign_ids(sources.where("source is not null"), ["source"], column="place")
    last = named.agg(F.count("*")).first()[0] + 1
    places = named.unionByName(sources.where("source is null").withColumn("place", F.lit(last).cast("long")))
    most = F.col("source_size") * F.lit(float(cap))
    rows = cut(
        places.select(
            "source", "source_size", (F.pmod(F.col("place") - 1, F.lit(3)) + 1).cast("double").alias("weight"), most.alias("most")
        )
    )
    total = rows.agg(F.sum("source_size")).first()[0]
    level, full = -1.0, -1
    while True:
        cut_off = F.col("most") <= F.col("weight") * F.lit(level)
        got = rows.agg(
            F.sum(F.when(cut_off, F.col("most")).otherwise(0.0)), F.sum(F.when(cut_off, 0.0).otherwise(F.col("weight"))),
            F.count_if(cut_off)
        ).first()
        if got[2] == full or not got[1]:
            break
        full, level = got[2], (float(total or 0) - got[0]) / got[1]
    return rows.select("source", "source_size", F.least("most", F.col("weight") * F.lit(level)).alias("target"))


def tilts(histogram: DataFrame, targets: DataFrame, cap: float = 3.0, rounds: int = 60) -> DataFrame:
    """(source, tilt, scale) solving sum(n * size * min(cap, exp(tilt * size / scale))) = target for every source.

    histogram: (source, size, n).  Newton steps on the dual, damped to keep the tilts in range; each round is a
    sum by source over the histogram and a join back, and stops when all sources are within 1e-6 of the target.
    Sources that are still further off after `rounds` raise.
    """
    rows = cut(histogram.where("size > 0").select(_key().alias("key"), "size", "n"))
    base = rows.groupBy("key").agg((F.sum(F.col("size") * F.col("n")) / F.sum("n")).alias("scale"))
    guess = F.log(F.greatest(F.col("target") / F.col("source_size"), F.lit(1e-9)))
    start = targets.withColumn("key", _key()).join(base, "key")
    state = cut(
        start.select(
            "key", "source", "target", "scale", guess.alias("tilt"), F.lit(-1e3).alias("low"), F.lit(1e3).alias("high"),
            F.lit(1.0).alias("error")
        )
    )
    for _ in range(rounds):
        z = F.col("size") / F.col("scale")
        raw = F.exp(F.least(F.lit(50.0), F.col("tilt") * z))
        words = (F.col("n") * F.col("size")).cast("double")
        sums = rows.join(state, "key").groupBy("key", "source", "target", "scale", "tilt", "low", "high").agg(
            F.sum(words * F.least(F.lit(float(cap)), raw)).alias("got"), F.sum(F.when(raw < cap, words * raw * z).otherwise(0.0)).alias("slope")
        )
        off = F.col("target") - F.col("got")
        low, high = F.when(off > 0, F.col("tilt")).otherwise(F.col("low")), F.when(off < 0, F.col("tilt")).otherwise(F.col("high"))
        # a step out of the bracket, or from where nothing moves, halves a bracket instead
        newton = F.col("tilt") + F.try_divide(off, F.col("slope"))
        near_low, near_high = F.greatest("low", F.col("tilt") - 8), F.least("high", F.col("tilt") + 8)
        bisect = F.when(off > 0, (F.col("tilt") + near_high) / 2).otherwise((F.col("tilt") + near_low) / 2)
        step = sums.withColumn(
            "error", F.abs(off) / F.greatest(F.col("target"), F.lit(1.0))
        ).withColumn("low2", low).withColumn("high2", high)
        stepped = F.when((newton > F.col("low2")) & (newton < F.col("high2")), newton).otherwise(bisect)
        tilt = F.when(F.col("error") < 1e-6, F.col("tilt")).otherwise(stepped)
        state = cut(
            step.select(
                "key", "source", "target", "scale", tilt.alias("tilt"), F.col("low2").alias("low"), F.col("high2").alias("high"), "error"
            )
        )
        worst = state.agg(F.max("error")).first()[0]
        if worst is None or worst < 1e-6:
            return state.select("source", "tilt", "scale")
    raise RuntimeError(f"the tilts did not settle in {rounds} rounds; the worst source is {worst:.1e} of its target off")


def _copies(histogram: DataFrame, solved: DataFrame, cap: float) -> DataFrame:
    """(key, size, n, base, extra): each row of this source and size is taken `base` times, `extra` of them once more.

    The rows of a source, one for each size, pass in order of size with the rounding error alone carried along.
    """
    rate = F.least(F.lit(float(cap)), F.exp(F.least(F.lit(50.0), F.col("tilt") * F.col("size") / F.col("scale"))))
    joined = histogram.where("size > 0").withColumn("key", _key()).join(solved.select(_key().alias("key"), "tilt", "scale"), "key")
    wanted = joined.select("key", "size", "n", (F.col("n") * rate * F.col("size")).alias("words"))

    def carry(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, left = None, 0.0
        for batch in batches:
            out = []
            for name, size, n, words in zip(*(batch.column(k).to_pylist() for k in range(4))):
                if name != key:
                    key, left = name, 0.0
                copies = min(n * int(cap), max(0, math.floor((left + words) / size + 0.5)))
                left += words - copies * size
                out.append(copies)
            copies = pa.array(out, pa.int64())
            base = pa.compute.divide(copies, batch.column(2))
            extra = pa.compute.subtract(copies, pa.compute.multiply(base, batch.column(2)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], base, extra], names=["key", "size", "n", "base", "extra"])

    ordered = wanted.repartition("key").sortWithinPartitions("key", F.desc("size"))
    return ordered.mapInArrow(carry, "key string, size long, n long, base long, extra long")


def mix_sources(
    docs: DataFrame, *, cap: float = 3.0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source"
) -> DataFrame:
    """(doc_id, size, source_size, target, taken, copies), a row for every row of `docs`.

    taken: words the mix takes from the row, copies times its size, at most `cap` sizes.  Rows of equal source
    and size are told apart by a hash of the id and text, so reruns agree.  Null and empty texts have size 0 and are
    taken with nothing; a source of such texts only has target 0.  Null sources form one source.
    """
    text = F.col(text_col)
    draw = F.xxhash64(F.col(id_col), F.coalesce(text, F.lit("")))
    rows = cut(
        docs.select(
            F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), text_size(text).alias("size"),
            draw.alias("draw")
        )
    )
    histogram = cut(rows.groupBy("source", "size").agg(F.count("*").alias("n")))
    targets = cut(source_targets(histogram.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), cap))
    copies = cut(_copies(histogram, tilts(histogram, targets.where("target > 0"), cap), cap))
    # rank among the rows of a source and size: buckets of the draw first, then inside the bucket
    placed = rows.withColumn("key", _key()).join(copies, ["key", "size"], "left")
    bucket = F.pmod("draw", F.coalesce(F.ceil(F.col("n") / BUCKET_ROWS), F.lit(1)))
    placed = placed.withColumn("bucket", bucket.cast("long"))
    # only sources and sizes that are taken once more in part are ranked
    drawn = placed.where("extra > 0")
    counts = drawn.groupBy("key", "size", "bucket").agg(F.count("*").alias("rows"))
    earlier = F.sum("rows").over(Window.partitionBy("key", "size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    before = counts.select("key", "size", "bucket", F.coalesce(earlier, F.lit(0)).alias("before"))
    rank = F.row_number().over(Window.partitionBy("key", "size", "bucket").orderBy("draw", "doc_id"))
    ranked = drawn.withColumn("rank", rank).join(before, ["key", "size", "bucket"], "left")
    even = placed.where("extra IS NULL OR extra = 0").withColumns({"rank": F.lit(1), "before": F.lit(0).cast("long")})
    joined = ranked.unionByName(even)
    joined = joined.join(targets.select(_key().alias("key"), "source_size", "target"), "key")
    once_more = F.when(F.col("before") + F.col("rank") <= F.coalesce("extra", F.lit(0)), 1).otherwise(0)
    taken = (F.coalesce("base", F.lit(0)) + once_more).cast("long")
    return joined.select(
        "doc_id", "size", F.col("source_size").cast("long").alias("source_size"), "target", (taken * F.col("size")).alias("taken"),
        taken.alias("copies")
    )
