"""Near duplicates among embeddings by product quantisation.

Vectors of one label are dealt into inverted lists by coarse centroids (of two levels where one would not be enough)
and stored as codes of their residuals, four components a code.  A vector is compared with the lists that it probes:
as many of its nearest ones as hold a neighbour at the threshold with the target probability, found out on the
training sample.  Within a list the distances to the codes are sums of looked-up table entries; as each code's own
error is kept with it, no pair at the threshold is lost to the codes.  What passes is reranked by its exact cosine.

Centroids and codes are fitted on a bounded sample (SAMPLE vectors of each of the DIMS most frequent lengths); every
vector is indexed.  Equal vectors of a label are one entry, however many copies there are.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._tables import components, cut

SAMPLE, DIMS = 8192, 4
#: Centroids of a level; components of a code, values of a code.
WIDTH, PART, VALUES = 1024, 4, 256
PLACED = "id long, label string, dim int, lists int, list int, copies long, vec binary, codes binary, error float, probes array<int>"


def _units(raw: np.ndarray) -> np.ndarray:
    """Rows of length 1, in doubles; scaled first, so that no square overflows or vanishes."""
    x = raw.astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (x * x).sum(1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(1)[None, :]


def _means(x: np.ndarray, k: int, random: np.random.Generator, rounds: int = 8) -> np.ndarray:
    """k centres of the rows of x by Lloyd's rounds; centres that lose all rows stay where they are."""
    centres = x[random.choice(len(x), k, replace=len(x) < k)].copy()
    for _ in range(rounds if k > 1 else 1):
        own = _distances(x, centres).argmin(1) if k > 1 else np.zeros(len(x), np.int64)
        count = np.bincount(own, minlength=k)
        total = np.stack([np.bincount(own, x[:, j], k) for j in range(x.shape[1])], 1)
        centres[count > 0] = total[count > 0] / count[count > 0, None]
    return centres


class Quantiser:
    """Coarse centroids of one or two levels, residual codes, and the probes that a vector needs."""

    def __init__(self, x: np.ndarray, lists: int, threshold: float, recall: float, seed: int = 7):
        random = np.random.default_rng(seed)
        self.dim, n = x.shape[1], min(lists, WIDTH)
        self.first = _means(x, n, random)
        rest = x - self.first[_distances(x, self.first).argmin(1)]
        n = max(1, lists // WIDTH)
        self.second = _means(rest, n, random) if n > 1 else np.zeros((1, self.dim))
        rest = self._padded(x - self.centre(self.own(x)))
        self.values = np.stack([_means(rest[:, j : j + PART], min(VALUES, len(rest)), random) for j in range(0, rest.shape[1], PART)])
        self.n_probes = lists
        if lists > 1:
            self.n_probes = self._needed(x[random.permutation(len(x))[:2048]], threshold, recall, random)

    def _padded(self, x: np.ndarray) -> np.ndarray:
        return np.pad(x, ((0, 0), (0, -x.shape[1] % PART)))

    def _needed(self, x: np.ndarray, threshold: float, recall: float, random: np.random.Generator) -> int:
        """Nearest lists among which a vector at the threshold, off in the direction of a difference of two of the sample, has its own."""
        other = x[random.permutation(len(x))] - x[random.permutation(len(x))]
        off = other - (other * x).sum(1, keepdims=True) * x
        size = np.sqrt((off * off).sum(1, keepdims=True))
        x, off = x[size[:, 0] > 1e-9], off[size[:, 0] > 1e-9]
        if not len(x):
            return self.n_probes
        edge = threshold * x + np.sqrt(1 - threshold**2) * off / np.sqrt((off * off).sum(1, keepdims=True))
        lists = self.n_probes
        own, width = self.own(edge), min(16, lists)
        while width < lists:
            hit = (self.probes(x, width) == own[:, None]).cumsum(1).mean(0)
            if hit[-1] >= recall:
                return int(np.argmax(hit >= recall)) + 1
            width = min(4 * width, lists)
        return lists

    def own(self, x: np.ndarray) -> np.ndarray:
        """Number of the list that each vector belongs to."""
        one = _distances(x, self.first).argmin(1)
        if len(self.second) == 1:
            return one
        return one * len(self.second) + _distances(x - self.first[one], self.second).argmin(1)

    def centre(self, lists: np.ndarray) -> np.ndarray:
        return self.first[lists // len(self.second)] + self.second[lists % len(self.second)]

    def probes(self, x: np.ndarray, width: int | None = None) -> np.ndarray:
        """The lists that each vector is compared with, the nearest first."""
        width, n2 = width or self.n_probes, len(self.second)
        one = _distances(x, self.first)
        if n2 == 1:
            return np.argsort(one, 1, kind="stable")[:, :width]
        near = np.argsort(one, 1, kind="stable")[:, : max(8, width // 8)]
        out = np.empty((len(x), min(width, near.shape[1] * n2)), np.int64)
        for k in range(len(x)):
            far = _distances(x[k] - self.first[near[k]], self.second)
            order = np.argsort(far, None, kind="stable")[: out.shape[1]]
            out[k] = near[k][order // n2] * n2 + order % n2
        return out

    def encode(self, x: np.ndarray, lists: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(codes, error): codes of the residuals, and how far each vector is from what its code stands for, rounded up."""
        rest = self._padded(x - self.centre(lists))
        codes = np.empty((len(x), len(self.values)), np.uint8)
        left = np.zeros(len(x))
        for j, values in enumerate(self.values):
            part = rest[:, j * PART : (j + 1) * PART]
            codes[:, j] = _distances(part, values).argmin(1)
            left += ((part - values[codes[:, j]]) ** 2).sum(1)
        return codes, np.sqrt(left)

    def table_distances(self, queries: np.ndarray, which: int, codes: np.ndarray) -> np.ndarray:
        """Squared distances of the queries to the coded vectors of a list, by table look-up."""
        centre = self.centre(np.array([which]))[0]
        rest = self._padded(queries - centre).astype(np.float32)
        norm = np.zeros(len(codes), np.float32)
        inner = np.zeros((len(queries), len(codes)), np.float32)
        for j, values in enumerate(self.values.astype(np.float32)):
            inner += np.take(rest[:, j * PART : (j + 1) * PART] @ values.T, codes[:, j], axis=1)
            norm += (values * values).sum(1)[codes[:, j]]
        return (rest * rest).sum(1)[:, None] - 2 * inner + norm[None, :]


def _least(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least index of each node's component under the links a-b."""
    label = np.arange(n)
    while True:
        new = label.copy()
        least = np.minimum(label[a], label[b])
        np.minimum.at(new, a, least)
        np.minimum.at(new, b, least)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def lists_for(rows: int, leaf: int) -> int:
    """Lists of a label of so many vectors: a power of 4, of about `leaf` vectors or fewer each."""
    k = 1
    while k * leaf < rows and k < WIDTH * WIDTH:
        k *= 4
    return k


def vector_groups(
    vectors: DataFrame, *, threshold: float = 0.93, recall: float = 0.99, leaf: int = 1024, block: int = 1024, id_col: str = "vec_id",
    vector_col: str = "embedding", label_col: str = "label"
) -> DataFrame:
    """(vec_id, n_links, component_id, kept): a row for every different id of `vectors`.

    Two vectors of equal labels are linked if their cosine, in doubles, is `threshold` or more; n_links counts the
    others linked directly, component_id is the least id reachable by links, kept marks it.  Vectors that are null,
    empty or zero or hold null, NaN or infinite components, and those of a null label, are linked with nothing, nor are vectors of
    different lengths.  Rows without an id are left out; of rows of one id the least (label, vector) counts; other
    columns are ignored.  A pair at the threshold is met with probability `recall` at least from either side, by the
    training sample; no pair below it is linked.
    """
    spark = vectors.sparkSession
    element = vectors.schema[vector_col].dataType.elementType.typeName()
    kind = np.float32 if element == "float" else np.float64
    rows = vectors.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"),
        F.col(vector_col).cast("array<float>" if kind is np.float32 else "array<double>").alias("vec")
    )
    sound = F.forall("vec", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("vec", lambda v: v != 0)
    rows = rows.withColumn("sound", F.coalesce(F.col("label").isNotNull() & sound, F.lit(False)))
    repeated = rows.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id")
    if repeated.limit(1).count():
        least = rows.join(repeated, "id", "left_semi").groupBy("id").agg(F.min(F.struct("label", "vec", "sound")).alias("r"))
        rows = cut(rows.join(repeated, "id", "left_anti").unionByName(least.select("id", "r.label", "r.vec", "r.sound")))
    keys = [F.xxhash64("label", "vec").alias("k1"), F.xxhash64(F.lit("second"), "vec", "label").alias("k2")]
    keyed = rows.select("id", "sound", *keys)
    owners = cut(keyed.where("sound").groupBy("k1", "k2").agg(F.min("id").alias("rep"), F.count("*").alias("copies")))
    reps = cut(
        rows.join(owners.select(F.col("rep").alias("id"), "copies"), "id").select("id", "label", F.size("vec").alias("dim"), "copies", "vec")
    )
    found = cut(_compare(spark, reps, threshold, recall, leaf, block, kind))
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    classes = components(found.where("id <> least").select(F.col("id").alias("a"), F.col("least").alias("b")))
    summary = owners.join(links.withColumnRenamed("id", "rep"), "rep", "left").join(
        classes.withColumnRenamed("node", "rep"), "rep", "left"
    ).select("k1", "k2", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n"), F.coalesce("class_id", "rep").alias("class_id"))
    linked = keyed.where("sound").join(summary, ["k1", "k2"]).select("id", "n", "class_id")
    alone = keyed.where("NOT sound").select("id", F.lit(0).cast("long").alias("n"), F.col("id").alias("class_id"))
    return linked.unionByName(alone).select(
        F.col("id").alias(id_col), F.col("n").alias("n_links"), F.col("class_id").alias("component_id"),
        (F.col("id") == F.col("class_id")).alias("kept")
    )


def _fit(spark, reps: DataFrame, wanted: dict[int, list[int]], threshold: float, recall: float) -> dict[tuple[int, int], Quantiser]:
    """A quantiser for each vector length and number of lists asked for, fitted by a task for each length."""
    order = Window.partitionBy("dim").orderBy(F.xxhash64("vec"), "id")
    sample = reps.where(F.col("dim").isin(list(wanted))).select("dim", "vec", F.row_number().over(order).alias("at")).where(F.col("at") <= SAMPLE)

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        dim = int(pdf["dim"].iloc[0])
        x = _units(np.stack(pdf.sort_values("at")["vec"].to_numpy()))
        made = [pickle.dumps(Quantiser(x, lists, threshold, recall)) for lists in wanted[dim]]
        return pd.DataFrame({"dim": dim, "lists": wanted[dim], "model": made})

    models = sample.groupBy("dim").applyInPandas(fit, "dim int, lists int, model binary").collect()
    return {(r.dim, r.lists): pickle.loads(r.model) for r in models}


def _compare(spark, reps: DataFrame, threshold: float, recall: float, leaf: int, block: int, kind) -> DataFrame:
    """(id, least, links): for each group of compared vectors, those with links in it, the least id linked there, and the links."""
    sizes = reps.groupBy("label", "dim").agg(F.count("*").alias("rows"))
    level = F.lit(1)
    for k in range(1, 11):
        level = F.when(F.col("rows") > leaf * 4 ** (k - 1), 4**k).otherwise(level)
    common = [r.dim for r in sizes.groupBy("dim").agg(F.sum("rows").alias("n")).orderBy(F.desc("n"), "dim").limit(DIMS).collect()]
    sized = sizes.withColumn("lists", F.when(F.col("dim").isin(common), level).otherwise(1).cast("int"))
    wanted: dict[int, list[int]] = {}
    for r in sized.where(F.col("dim").isin(common)).select("dim", "lists").distinct().collect():
        wanted.setdefault(r.dim, []).append(r.lists)
    models = spark.sparkContext.broadcast(_fit(spark, reps, wanted, threshold, recall))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, lists = (batch.column(k).to_numpy() for k in (2, 3))
            both = dims.astype(np.int64) << 32 | lists
            for key in np.unique(both):
                part = batch.take(pa.array(np.flatnonzero(both == key)))
                dim, n = int(key >> 32), int(key & 0xFFFFFFFF)
                raw = part.column(5).flatten().to_numpy().reshape(-1, dim).astype(kind)
                x, model = _units(raw), models.value.get((dim, n))
                if model is None:  # a rare length: one list, without codes
                    own, probes = np.zeros(len(x), np.int64), np.zeros((len(x), 1), np.int64)
                    codes, error = np.empty((len(x), 0), np.uint8), np.ones(len(x))
                else:
                    own = model.own(x)
                    probes, (codes, error) = model.probes(x), model.encode(x, own)
                    # a list of its own is always probed
                    missed = ~(probes == own[:, None]).any(1)
                    probes[missed, -1] = own[missed]
                ends = np.arange(len(x) + 1, dtype=np.int32) * probes.shape[1]
                listed = own.astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        *part.columns[:4], pa.array(listed), part.column(4),
                        pa.array([v.tobytes() for v in raw], pa.binary()), pa.array([c.tobytes() for c in codes], pa.binary()),
                        pa.array(error.astype(np.float32)), pa.ListArray.from_arrays(pa.array(ends), pa.array(probes.astype(np.int32).ravel()))
                    ],
                    names=["id", "label", "dim", "lists", "list", "copies", "vec", "codes", "error", "probes"]
                )

    placed = cut(reps.join(sized.drop("rows"), ["label", "dim"]).select("id", "label", "dim", "lists", "copies", "vec").mapInArrow(place, PLACED))
    at = ["label", "dim", "list"]
    held = placed.groupBy(*at).agg(F.ceil(F.count("*") / block).cast("int").alias("held"))
    asked = placed.select("label", "dim", F.explode("probes").alias("list")).groupBy(*at).agg(F.ceil(F.count("*") / block).cast("int").alias("asked"))
    blocks = cut(held.join(asked, at))
    sides = []
    for query, rows, own, other in ((False, placed, "held", "asked"), (True, placed.withColumn("at", F.explode("probes")), "asked", "held")):
        where = F.col("at") if query else F.col("list")
        dealt = rows.withColumn("at", where).join(blocks.withColumnRenamed("list", "at"), ["label", "dim", "at"]).withColumn(
            "mine", F.pmod(F.xxhash64("id"), own).cast("int")
        ).withColumn("theirs", F.explode(F.sequence(F.lit(0), F.col(other) - 1)))
        pair = ("theirs", "mine") if query else ("mine", "theirs")
        sides.append(
            dealt.select(
                F.xxhash64("label", "dim", "at", *pair).alias("group_id"), F.lit(query).alias("query"), "id", "dim", "lists", "at", "list", "copies", "vec",
                (F.lit(None).cast("binary") if query else F.col("codes")).alias("codes"), "error",
                (F.lit(None).cast("array<int>") if query else F.col("probes")).alias("probes")
            )
        )
    reach = float(np.sqrt(2 - 2 * threshold))

    def match(table: pa.Table) -> pa.Table:
        query = table.column("query").to_numpy()
        dim, which = table.column("dim")[0].as_py(), table.column("at")[0].as_py()
        ids, copies = table.column("id").to_numpy(), table.column("copies").to_numpy()
        x = _units(np.frombuffer(b"".join(table.column("vec").to_pylist()), kind).reshape(-1, dim))
        q, m = np.flatnonzero(query), np.flatnonzero(~query)
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        if len(q) and len(m):
            asked, stored = table.filter(pa.array(query)), table.filter(pa.array(~query))
            codes = np.frombuffer(b"".join(stored.column("codes").to_pylist()), np.uint8).reshape(len(m), -1)
            lists = stored.column("lists")[0].as_py()
            error = stored.column("error").to_numpy()
            if codes.shape[1]:
                far = models.value[dim, lists].table_distances(x[q], which, codes)
                i, j = np.nonzero(far <= (np.float32(reach) + error[None, :]) ** 2 + np.float32(1e-3))
            else:
                i, j = np.nonzero(np.ones((len(q), len(m)), bool))
            probes = stored.column("probes").combine_chunks()
            probes = probes.flatten().to_numpy().reshape(len(m), -1)
            home = asked.column("list").to_numpy()
            for lo in range(0, len(i), 1 << 17):
                u, v = i[lo : lo + (1 << 17)], j[lo : lo + (1 << 17)]
                near = (x[q[u]] * x[m[v]]).sum(1) >= threshold
                u, v = u[near], v[near]
                # a pair that the other side meets too counts for the lesser id alone
                mutual = (probes[v] == home[u][:, None]).any(1)
                once = (ids[q[u]] != ids[m[v]]) & (~mutual | (ids[q[u]] < ids[m[v]]))
                a.append(q[u[once]])
                b.append(m[v[once]])
        # rows of one vector on both sides are one node
        nodes, node = np.unique(ids, return_inverse=True)
        of = np.zeros(len(nodes), np.int64)
        of[node] = copies
        a, b = node[np.concatenate(a)], node[np.concatenate(b)]
        links = np.bincount(a, of[b], len(nodes)) + np.bincount(b, of[a], len(nodes))
        least, some = nodes[_least(len(nodes), a, b)], np.flatnonzero(links)
        return pa.table({"id": nodes[some], "least": least[some], "links": links[some].astype(np.int64)})

    groups = sides[0].unionByName(sides[1])
    groups = groups.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "group_id")
    return groups.groupBy("group_id").applyInArrow(match, "id long, least long, links long")


#: All pairs of a label compared; for tables small enough for that.
ORACLE = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS MATERIALIZED (
  SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93
), reach AS (
  SELECT x, y FROM links UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x
)
SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(lowest, vec_id)) AS component_id, vec_id <= coalesce(lowest, vec_id) AS kept
FROM embeddings LEFT JOIN (SELECT x AS vec_id, count(*) AS n FROM links GROUP BY x) USING (vec_id)
LEFT JOIN (SELECT x AS vec_id, min(y) AS lowest FROM reach GROUP BY x) USING (vec_id)
"""
