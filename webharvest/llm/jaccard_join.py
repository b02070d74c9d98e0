"""N-gram Jaccard self-join by chosen paths.

Every text becomes the set of its word shingles and a row of min-hash tokens.  A tree of buckets is then
grown level by level: a bucket samples two token positions from its own key, and its members that share the
token at a sampled position go on together to a child bucket.  Buckets of one row end, small buckets are
compared by brute force, large ones split again.  Two texts of the threshold similarity meet with a known
probability per run; independent runs are repeated until the target recall is reached, the loss of the leaves'
estimates counted in.

The buckets yield candidate clusters.  Each cluster is then verified once, exactly, on the whole shingle
sets: pairs are counted where they are found, so no list of all pairs exists anywhere.

Texts with equal shingle multisets are one class from the start, however many copies there are.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._tables import components, cut
from ._words import Words, mix, steps

SETS = "doc_id long, k1 long, k2 long, n_shingles long, sketch array<int>"
#: Rows of a matrix of pairs that are worked on at a time, and shingles that are.
ROWS, WIDTH = 128, 512


def run_recall(threshold: float, depth: int, branches: int) -> float:
    """Least probability that two sets of the threshold similarity share a leaf in one run."""
    p = 1.0
    for _ in range(depth):
        p = 1 - (1 - threshold * p) ** branches
    return p


def estimate_recall(threshold: float, tokens: int, slack: float) -> float:
    """Probability that at least a share threshold - slack of the tokens of two sets of the threshold similarity agree."""
    least = math.ceil((threshold - slack) * tokens - 1e-9)
    return sum(math.comb(tokens, k) * threshold**k * (1 - threshold) ** (tokens - k) for k in range(least, tokens + 1))


def runs_for(threshold: float, depth: int, branches: int, target: float, kept: float = 1.0) -> int:
    """Runs needed to reach the target recall, of which a share `kept` at most passes the estimate in the leaves."""
    if target >= kept:
        raise ValueError(f"recall {target} is out of reach: the leaves keep {kept:.4f}; take more tokens or slack")
    return max(1, math.ceil(math.log(1 - target / kept) / math.log(1 - run_recall(threshold, depth, branches)) - 1e-9))


def shingle_sets(docs: DataFrame, *, n: int = 5, tokens: int = 128, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, k1, k2, n_shingles, sketch): a 128-bit key of the shingle multiset and the min-hash tokens.

    Null and wordless texts have no shingles: key (0, 0) and an empty sketch.
    """

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        odd = mix(np.arange(1, tokens + 1, dtype=np.uint64)) | np.uint64(1)
        for batch in batches:
            for lo, hi in steps(batch.column(1)):
                part = batch.slice(lo, hi - lo)
                g, row, _ = Words(part.column(1)).shingles(n)
                count = np.bincount(row, minlength=hi - lo)
                at = np.flatnonzero(count)
                cuts = np.concatenate([[0], np.cumsum(count)])[at]
                keys = np.zeros((2, hi - lo), np.uint64)
                sketch = np.zeros((len(at), tokens), np.uint32)
                if len(at):
                    keys[0, at] = np.add.reduceat(mix(g ^ np.uint64(0xA5A5A5A5)), cuts)
                    keys[1, at] = np.add.reduceat(mix(g + np.uint64(0x1234567)), cuts)
                    for k in range(tokens):
                        sketch[:, k] = np.minimum.reduceat(g * odd[k], cuts) >> np.uint64(16)
                sizes = np.zeros(hi - lo + 1, np.int32)
                sizes[1:] = np.cumsum(np.where(count > 0, tokens, 0))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0), pa.array(keys[0].view(np.int64)), pa.array(keys[1].view(np.int64)),
                        pa.array(count.astype(np.int64)), pa.ListArray.from_arrays(pa.array(sizes), pa.array(sketch.view(np.int32).ravel()))
                    ],
                    names=["doc_id", "k1", "k2", "n_shingles", "sketch"],
                )

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(make, SETS)


def _spread(groups: DataFrame) -> DataFrame:
    """Groups over as many tasks as the session has shuffle partitions: they are small, but dear, so they are not joined by bytes."""
    return groups.repartition(int(groups.sparkSession.conf.get("spark.sql.shuffle.partitions")), "group_id")


def _star(adjacent: np.ndarray) -> np.ndarray:
    """The least member index of each row's component."""
    label = np.arange(len(adjacent))
    while True:
        least = np.concatenate([np.where(adjacent[k : k + ROWS], label[None, :], len(label)).min(1) for k in range(0, len(label), ROWS)])
        new = np.minimum(label, least)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def candidate_edges(
    reps: DataFrame, sketches: DataFrame, *, threshold: float, slack: float, leaf: int, block: int, depth: int, branches: int, runs: int
) -> DataFrame:
    """(a, b): edges that span the candidate clusters of `reps`; `sketches`, the table to look tokens up in, holds their rows."""
    tokens = F.size("sketch")

    def children(members: DataFrame, width: int) -> DataFrame:
        """members: node, doc_id, sketch -> (node, doc_id) of the next level; branch j of a node reads a position drawn from (node, j)."""
        branch = F.explode(F.sequence(F.lit(0), F.lit(width - 1)))
        drawn = members.select("node", "doc_id", "sketch", branch.alias("j")).withColumn(
            "at", F.pmod(F.xxhash64("node", "j"), tokens).cast("int")
        )
        return drawn.select(F.xxhash64("node", "j", F.get("sketch", F.col("at"))).alias("node"), "doc_id")

    roots = reps.where(tokens > 0).select(
        F.explode(F.array(*[F.lit(r).cast("long") for r in range(1, runs + 1)])).alias("node"), "doc_id", "sketch"
    )
    leaves = None
    level = children(roots, branches)
    for d in range(1, depth + 1):
        level = cut(level)
        sizes = level.groupBy("node").agg(F.count("*").alias("size")).where("size > 1")
        sized = level.join(sizes, "node")
        done = sized if d == depth else sized.where(F.col("size") <= leaf)
        leaves = done if leaves is None else leaves.union(done)
        if d < depth:
            level = children(sized.where(F.col("size") > leaf).join(sketches, "doc_id").select("node", "doc_id", "sketch"), branches)
    # an unsplittable bucket is dealt into blocks, every pair of blocks is a group of its own
    blocks = F.ceil(F.col("size") / block).cast("int")
    own = F.pmod(F.xxhash64("doc_id"), blocks).cast("int")
    dealt = leaves.withColumn("blocks", blocks).withColumn("own", own).withColumn(
        "other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    )
    groups = dealt.select(F.xxhash64("node", F.least("own", "other"), F.greatest("own", "other")).alias("group_id"), "doc_id").distinct()

    def match(pdf: pd.DataFrame) -> pd.DataFrame:
        ids = pdf["doc_id"].to_numpy()
        sk = np.stack(pdf["sketch"].to_numpy()).astype(np.int32)
        order = np.argsort(ids)
        ids, sk = ids[order], sk[order]
        equal = np.zeros((len(ids), len(ids)), np.int16)
        for k in range(sk.shape[1]):
            equal += sk[:, k, None] == sk[None, :, k]
        label = _star(equal >= (threshold - slack) * sk.shape[1])
        far = np.flatnonzero(label != np.arange(len(ids)))
        return pd.DataFrame({"a": ids[far], "b": ids[label[far]]})

    return _spread(groups.join(sketches, "doc_id")).groupBy("group_id").applyInPandas(match, "a long, b long").distinct()


def verified(
    clusters: DataFrame, docs: DataFrame, *, threshold: float, n: int, block: int, block_shingles: int, id_col: str, text_col: str
) -> tuple[DataFrame, DataFrame]:
    """Exact check inside clusters (doc_id, cluster, copies, n_shingles): (edges a, b), (doc_id, links).

    A cluster is dealt into blocks of about `block` rows and `block_shingles` shingles at most; every pair of blocks
    is a group of its own, so a group holds two blocks whatever the size of the cluster and of its texts.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    weight = F.greatest(F.ceil(F.count("*") / block), F.ceil(F.sum("n_shingles") / block_shingles)).cast("int")
    members = clusters.groupBy("cluster").agg(weight.alias("blocks"))
    chosen = clusters.drop("n_shingles").hint("shuffle_hash").join(texts, "doc_id").select("doc_id", "cluster", "copies", "text")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in steps(batch.column(3)):
                part = batch.slice(lo, hi - lo)
                g, row, _ = Words(part.column(3)).shingles(n)
                ends = np.searchsorted(row, np.arange(hi - lo + 1))
                packed = [np.unique(g[a:b]).tobytes() for a, b in zip(ends, ends[1:])]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:3], pa.array(packed, pa.binary())], names=["doc_id", "cluster", "copies", "packed"]
                )

    sized = chosen.mapInArrow(sets, "doc_id long, cluster long, copies long, packed binary").join(members, "cluster")
    dealt = sized.withColumn("own", F.pmod(F.xxhash64("doc_id"), "blocks").cast("int")).withColumn(
        "other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    )
    groups = dealt.select(
        F.xxhash64("cluster", F.least("own", "other"), F.greatest("own", "other")).alias("group_id"), "own",
        (F.col("own") == F.col("other")).alias("within"), "doc_id", "copies", "packed"
    )

    def verify(pdf: pd.DataFrame) -> pd.DataFrame:
        # a group of two blocks counts pairs between them; a group of one block, pairs inside
        pdf = pdf.sort_values("doc_id").reset_index(drop=True)
        ids, own, copies = pdf["doc_id"].to_numpy(), pdf["own"].to_numpy(), pdf["copies"].to_numpy()
        sets_ = [np.frombuffer(x, np.uint64) for x in pdf["packed"]]
        size = np.array([len(x) for x in sets_], np.float32)
        where = np.repeat(np.arange(len(ids), dtype=np.int32), size.astype(np.int64))
        values = np.concatenate(sets_)
        order = np.argsort(values)
        where, values = where[order], values[order]
        new, last = np.ones((2, len(values)), bool)
        new[1:] = values[1:] != values[:-1]
        last[:-1] = new[1:]
        keep = ~(new & last)  # shingles of one row alone link nothing
        where, column = where[keep], np.cumsum(new[keep], dtype=np.int32) - 1
        del values, order
        common = np.zeros((len(ids), len(ids)), np.float32)
        for lo in range(0, int(column[-1]) + 1 if len(column) else 0, WIDTH):
            a, b = np.searchsorted(column, [lo, lo + WIDTH])
            part = np.zeros((len(ids), WIDTH), np.float32)
            part[where[a:b], column[a:b] - lo] = 1
            common += part @ part.T
        near = np.zeros(common.shape, bool)
        for k in range(0, len(ids), ROWS):
            both = common[k : k + ROWS]
            near[k : k + ROWS] = both >= np.float32(threshold) * (size[k : k + ROWS, None] + size[None, :] - both) - np.float32(1e-3)
        np.fill_diagonal(near, False)
        if pdf["within"].iloc[0]:
            counted = near
        else:
            counted = near & (own[:, None] != own[None, :])
        links = np.concatenate([(counted[k : k + ROWS] * copies[None, :]).sum(1) for k in range(0, len(ids), ROWS)])
        label = _star(counted)
        return pd.DataFrame({"doc_id": ids, "least": ids[label], "links": links})

    found = cut(_spread(groups).groupBy("group_id").applyInPandas(verify, "doc_id long, least long, links long"))
    return found.where("doc_id <> least").select(
        F.col("doc_id").alias("a"), F.col("least").alias("b")
    ), found.groupBy("doc_id").agg(F.sum("links").alias("links"))


def jaccard_join(
    docs: DataFrame, *, threshold: float = 0.8, n: int = 5, target_recall: float = 0.99, tokens: int = 128, slack: float = 0.1,
    leaf: int = 256, block: int = 1024, block_shingles: int = 1 << 20, depth: int = 4, branches: int = 2, id_col: str = "doc_id",
    text_col: str = "text"
) -> DataFrame:
    """(doc_id, class_id, copy_of, n_links, n_shingles), a row for every different id of `docs`.

    class_id: the least doc_id of the group linked by pairs of Jaccard similarity `threshold` or more;
    copy_of: the least doc_id with the same shingle multiset; n_links: the other rows whose similarity to this
    one reaches the threshold.  Null and wordless texts have empty sets, which equal each other and nothing
    else.  Rows without an id are left out; of rows of one id the one of the least text counts, a null before
    others; other columns of `docs` are ignored.  A pair at the threshold is found with probability `target_recall`
    at least: the leaves' estimates and the paths of all runs together; more alike pairs more surely.
    """
    runs = runs_for(threshold, depth, branches, target_recall, estimate_recall(threshold, tokens, slack))
    docs = docs.where(F.col(id_col).isNotNull())
    sets = cut(shingle_sets(docs, n=n, tokens=tokens, id_col=id_col, text_col=text_col))
    repeated = sets.groupBy("doc_id").agg(F.count("*").alias("rows")).where("rows > 1")
    if repeated.limit(1).count():
        # one row for each repeated id, by its text; texts of other ids stay where they are
        chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
        least = chosen.join(
            repeated.select("doc_id"), "doc_id", "left_semi"
        ).groupBy("doc_id").agg(F.min(F.struct("text")).alias("t")).select("doc_id", "t.text")
        docs = cut(chosen.join(repeated.select("doc_id"), "doc_id", "left_anti").unionByName(least))
        id_col, text_col = "doc_id", "text"
        sets = cut(shingle_sets(docs, n=n, tokens=tokens))
    owners = cut(
        sets.groupBy("k1", "k2").agg(
            F.min("doc_id").alias("copy_of"), F.count("*").alias("copies"), F.first("n_shingles").alias("n_shingles")
        )
    )
    reps = sets.join(owners.select(F.col("copy_of").alias("doc_id")), "doc_id", "left_semi")
    edges = candidate_edges(
        reps, sets.select("doc_id", "sketch"), threshold=threshold, slack=slack, leaf=leaf, block=block, depth=depth, branches=branches,
        runs=runs
    )
    clusters = components(edges).select(F.col("node").alias("doc_id"), F.col("class_id").alias("cluster"))
    clusters = cut(clusters.join(owners.select(F.col("copy_of").alias("doc_id"), "copies", "n_shingles"), "doc_id"))
    found, links = verified(
        clusters, docs, threshold=threshold, n=n, block=block, block_shingles=block_shingles, id_col=id_col, text_col=text_col
    )
    classes = components(found)
    summary = owners.drop("n_shingles").join(
        links.withColumnRenamed("doc_id", "copy_of"), "copy_of", "left"
    ).join(classes.withColumnRenamed("node", "copy_of"), "copy_of", "left")
    n_links = (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).cast("long")
    summary = summary.select("k1", "k2", "copy_of", F.coalesce("class_id", "copy_of").alias("class_id"), n_links.alias("n_links"))
    return sets.select("doc_id", "k1", "k2", "n_shingles").join(summary, ["k1", "k2"]).select(
        "doc_id", "class_id", "copy_of", "n_links", "n_shingles"
    )
