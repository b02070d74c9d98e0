"""Ranked lexical search over K2-treaps of the term-document grid.

The documents are cut into ranges; of each range's grid, terms as rows and documents in the order of their ids as
columns, a quadtree is kept without pointers: a mask of the four quadrants of each cell that holds anything, and the
greatest impact in it, down to single entries.  A search starts at the root of a range and goes down the row paths of
all terms of an item at once: a stretch of documents is bounded by the sum of its cells' impacts, and the stretches
of the highest bounds are halved first, until none left can enter the best.

`lexical_index` makes the table of ranges, `search` ranks its documents for a table of items.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._tables import cut
from ._words import Words, count_terms, steps

INDEX = "docs array<long>, terms array<long>, dfs array<int>, masks binary, maxima binary"
#: Documents and entries of a range at most (a longer text is a range of its own), stretches halved at once, items of a block.
RANGE_DOCS, RANGE_ENTRIES, WAVE, ITEMS = 8192, 1 << 19, 128, 1024
_NO_ID = np.iinfo(np.int64).max
_COUNT = np.array([bin(k).count("1") for k in range(16)], np.int64)


def _spread_bits(x: np.ndarray) -> np.ndarray:
    """The low 32 bits of each value moved to the even places."""
    x = x.astype(np.uint64)
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        x = (x | (x << np.uint64(shift))) & np.uint64(mask)
    return x


class K2Treap:
    """A grid of impacts as quadrant masks and maxima of its cells, level by level from the root, each level in Morton order."""

    def __init__(self, masks: np.ndarray, maxima: np.ndarray, height: int):
        self.masks, self.maxima, self.height = masks, maxima, height
        self.child = np.ones(len(maxima), np.int32)  # of each cell, its first child
        self.child[1 : len(masks)] = 1 + np.cumsum(_COUNT[masks])[:-1]
        self.mask = np.zeros(len(maxima), np.uint8)
        self.mask[: len(masks)] = masks

    @classmethod
    def build(cls, rows: np.ndarray, columns: np.ndarray, impacts: np.ndarray) -> K2Treap:
        height = max(1, int(max(rows.max(), columns.max())).bit_length())
        code = _spread_bits(rows) << np.uint64(1) | _spread_bits(columns)
        order = np.argsort(code)
        code, top = code[order], impacts[order]
        maxima, masks = [top], []
        for _ in range(height):
            upper = code >> np.uint64(2)
            first = np.flatnonzero(np.concatenate([[True], upper[1:] != upper[:-1]]))
            masks.append(np.bitwise_or.reduceat(np.uint8(1) << (code & np.uint64(3)).astype(np.uint8), first))
            top = np.maximum.reduceat(top, first)
            maxima.append(top)
            code = upper[first]
        return cls(np.concatenate(masks[::-1]), np.concatenate(maxima[::-1]), height)

    def enter(self, rows: np.ndarray, columns: int) -> tuple[np.ndarray, int]:
        """(cells, level): of each row that has entries, the cell of its path at the deepest level where one cell spans all columns."""
        level = self.height - max(0, columns - 1).bit_length()
        cells = np.zeros(len(rows), np.int64)
        for at in range(level):
            quadrant = (rows >> (self.height - 1 - at) & 1) * 2
            cells = self.child[cells] + _COUNT[self.mask[cells] & ((1 << quadrant) - 1)]
        return cells, level

    def best(
        self, rows: np.ndarray, cells: np.ndarray, level: int, weights: np.ndarray, ids: np.ndarray, best: list[tuple[int, int]], k: int
    ) -> list[tuple[int, int]]:
        """`best`, pairs (-score, id) in order, k at most, with what this grid adds below the given cells; ids: of the columns, ascending."""
        h, cells = self.height, cells[None, :]
        bound = self.maxima[cells] @ weights
        level, prefix = np.array([level]), np.zeros(1, np.int64)
        while len(bound):
            begin = prefix << (h - level)
            if len(best) == k:  # what lies below the last of the best, or is equal and has later ids only, can't enter
                score, last = -best[-1][0], best[-1][1]
                open_ = np.flatnonzero((bound > score) | ((bound == score) & (ids[np.minimum(begin, len(ids) - 1)] < last)))
                if not len(open_):
                    break
                cells, level, prefix, bound, begin = cells[open_], level[open_], prefix[open_], bound[open_], begin[open_]
            take = np.lexsort((begin, -bound))
            take, rest = take[:WAVE], take[WAVE:]
            now, at, where = cells[take], level[take], prefix[take]
            if at.min() == h:  # single documents
                best = sorted(best + list(zip((-bound[take]).tolist(), ids[where].tolist())))[:k]
                cells, level, prefix, bound = cells[rest], level[rest], prefix[rest], bound[rest]
                continue
            leaf = at == h
            if leaf.any():
                best = sorted(best + list(zip((-bound[take][leaf]).tolist(), ids[where[leaf]].tolist())))[:k]
                now, at, where = now[~leaf], at[~leaf], where[~leaf]
            mask = np.where(now >= 0, self.mask[now], 0)
            first, down = self.child[now], (rows[None, :] >> (h - 1 - at)[:, None] & 1) * 2
            made = []
            for side in (0, 1):
                bit = 1 << (down + side)
                hit = (mask & bit) > 0
                below = np.where(hit, first + _COUNT[mask & (bit - 1)], -1)
                made.append((below, where * 2 + side, np.where(hit, self.maxima[below], 0) @ weights))
            below, place, sums = (np.concatenate(x) for x in zip(*made))
            go = np.flatnonzero(sums > 0)
            cells = np.concatenate([cells[rest], below[go]])
            level, prefix = np.concatenate([level[rest], np.tile(at + 1, 2)[go]]), np.concatenate([prefix[rest], place[go]])
            bound = np.concatenate([bound[rest], sums[go]])
        return best


def impact(tf: np.ndarray, length: np.ndarray, documents: int, words: int) -> np.ndarray:
    """Impact of a term that stands tf times in a document of so many terms: a saturating share of a million."""
    length = length if 25 * documents * int(length.max(initial=0)) < 1 << 62 else length.astype(object)
    m = (75 + 25 * length * documents // words).astype(np.int64)
    return (1_000_000_000 * tf) // (1000 * tf + 12 * m)


def collection_size(docs: DataFrame, text_col: str = "text") -> tuple[int, int]:
    """(documents with at least one term, all their terms)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        documents, words = 0, 0
        for batch in batches:
            for lo, hi in steps(batch.column(0)):
                n = count_terms(batch.column(0).slice(lo, hi - lo))
                documents, words = documents + int((n > 0).sum()), words + int(n.sum())
        yield pa.RecordBatch.from_arrays([pa.array([documents]), pa.array([words])], names=["documents", "words"])

    size = docs.select(F.col(text_col).cast("string")).mapInArrow(count, "documents long, words long").agg(F.sum("documents"), F.sum("words")).first()
    return size[0] or 0, size[1] or 0


def _entries(part: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    """(ids, lengths) of the documents with a term, (document, term, tf) of the entries of the grid."""
    w = Words(part.column(1), terms=True)
    some = np.flatnonzero(w.counts)
    number = np.zeros(len(w.counts), np.int64)
    number[some] = np.arange(len(some))
    terms, term = np.unique(w.hash, return_inverse=True)
    entry, tf = np.unique(term * max(1, len(some)) + number[w.row], return_counts=True)
    ids = pc.fill_null(part.column(0), _NO_ID).to_numpy()[some]
    return ids, w.counts[some], entry % max(1, len(some)), terms[entry // max(1, len(some))], tf


def _range(held: list[tuple[np.ndarray, ...]], documents: int, words: int) -> pa.RecordBatch:
    """A row of the index: the grid of some documents, in the order of their ids."""
    base = np.cumsum([0] + [len(x[0]) for x in held])
    ids, length, _, hashes, tf = (np.concatenate([x[k] for x in held]) for k in range(5))
    document = np.concatenate([x[2] + b for x, b in zip(held, base)])
    order = np.argsort(ids, kind="stable")
    column = np.empty(len(ids), np.int64)
    column[order] = np.arange(len(ids))
    terms, term, df = np.unique(hashes, return_inverse=True, return_counts=True)
    frequent = np.argsort(-df, kind="stable")  # rows: frequent terms together
    row = np.empty(len(terms), np.int64)
    row[frequent] = np.arange(len(terms))
    tree = K2Treap.build(row[term], column[document], impact(tf, length[document], documents, words))
    return pa.RecordBatch.from_arrays(
        [
            pa.array([ids[order]], pa.list_(pa.int64())), pa.array([terms[frequent].view(np.int64)], pa.list_(pa.int64())),
            pa.array([df[frequent].astype(np.int32)], pa.list_(pa.int32())), pa.array([tree.masks.tobytes()], pa.binary()),
            pa.array([tree.maxima.astype(np.int32).tobytes()], pa.binary())
        ],
        names=["docs", "terms", "dfs", "masks", "maxima"]
    )


def lexical_index(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, int]:
    """(the table of ranges, the number of documents with a term): every document and term, whatever will be searched."""
    documents, words = collection_size(docs, text_col)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        for batch in batches:
            for lo, hi in steps(batch.column(1)):
                for at in range(lo, hi, RANGE_DOCS):
                    entries = _entries(batch.slice(at, min(RANGE_DOCS, hi - at)))
                    if held and (
                        sum(len(x[0]) for x in held) + len(entries[0]) > RANGE_DOCS
                        or sum(len(x[2]) for x in held) + len(entries[2]) > RANGE_ENTRIES
                    ):
                        yield _range(held, documents, words)
                        held = []
                    if len(entries[0]):
                        held.append(entries)
        if held:
            yield _range(held, documents, words)

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(make, INDEX), documents


def _item_terms(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(item_id, term, n) of the items; of rows of one id the least text counts, null ids are left out."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            w = Words(batch.column(1), terms=True)
            ids = batch.column(0).to_numpy()[w.row]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(w.hash.view(np.int64))], names=["item_id", "term"])

    one = items.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("item_id")).agg(
        F.min(F.col(text_col).cast("string")).alias("text")
    )
    return one.mapInArrow(make, "item_id long, term long").groupBy("item_id", "term").agg(F.count("*").alias("n"))


def weight(documents: int, df: Column) -> Column:
    """Weight of a term that so many documents hold."""
    return F.floor(1000 * F.log((2.0 * documents + 2) / (2 * df + 1)))


@contextmanager
def _single_rows(spark: SparkSession) -> Iterator[None]:
    """Queries that run inside read and send rows one at a time: a range is some megabytes, a batch of them would be a task's memory."""
    settings = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1", "spark.sql.parquet.columnarReaderBatchSize": "1"}
    before = {key: spark.conf.get(key, None) for key in settings}
    try:
        for key, value in settings.items():
            spark.conf.set(key, value)
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value) if value is not None else spark.conf.unset(key)


def search(
    index: DataFrame, documents: int, items: DataFrame, *, top: int = 20, item_id_col: str = "item_id", item_text_col: str = "text"
) -> DataFrame:
    """(item_id, rank, doc_id, score): the `top` documents of an index of so many documents for each item."""
    wanted = _item_terms(items, item_id_col, item_text_col)
    grid = index.select(F.explode(F.arrays_zip("terms", "dfs")).alias("t")).select("t.terms", "t.dfs")
    frequency = grid.join(wanted.select(F.col("term").alias("terms")).distinct(), "terms", "left_semi").groupBy("terms").agg(F.sum("dfs").alias("df"))
    weighed = cut(
        wanted.join(frequency.withColumnRenamed("terms", "term"), "term").select(
            "item_id", "term", (weight(documents, F.col("df")) * F.col("n")).alias("weight")
        ).where("weight > 0")
    )
    count = weighed.select("item_id").distinct().count()
    each = weighed.groupBy("item_id").agg(F.collect_list("term").alias("terms"), F.collect_list("weight").alias("weights"))
    block = F.pmod(F.xxhash64("item_id"), F.lit(max(1, math.ceil(count / ITEMS)))).alias("block")
    blocks = each.groupBy(block).agg(F.collect_list(F.struct("item_id", "terms", "weights")).alias("items"))

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, list] = {}
        known: dict[int, list] = {}
        for batch in batches:
            for r in range(batch.num_rows):
                ids, terms = (batch.column(k)[r].values.to_numpy() for k in (0, 1))
                masks = np.frombuffer(batch.column(2)[r].as_buffer(), np.uint8)
                maxima = np.frombuffer(batch.column(3)[r].as_buffer(), np.int32)
                tree = K2Treap(masks, maxima, max(1, (max(len(ids), len(terms)) - 1).bit_length()))
                order = np.argsort(terms)
                number = batch.column(4)[r].as_py()
                if number not in known:
                    known[number] = [
                        (x["item_id"].as_py(), x["terms"].values.to_numpy(), x["weights"].values.to_numpy()) for x in batch.column(5)[r]
                    ]
                items = known[number]
                asked = np.concatenate([x[1] for x in items])
                rows = order[np.minimum(np.searchsorted(terms, asked, sorter=order), len(terms) - 1)]
                have = terms[rows] == asked
                cells, level = tree.enter(rows, len(ids))
                at = 0
                for item, own, weights in items:
                    here = slice(at, at := at + len(own))
                    if (good := have[here]).any():
                        best[item] = tree.best(rows[here][good], cells[here][good], level, weights[good], ids, best.get(item, []), top)
        flat = [(item, None if d == _NO_ID else d, -s) for item, found in best.items() for s, d in found]
        columns = list(zip(*flat)) or [[]] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["item_id", "doc_id", "score"])

    ranges = index.select("docs", "terms", "masks", "maxima")
    met = ranges.crossJoin(blocks).select(*ranges.columns, "block", "items").mapInArrow(rank, "item_id long, doc_id long, score long")
    with _single_rows(index.sparkSession):
        found = cut(met)
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("item_id", "rank", "doc_id", "score")


def ranked_search(
    docs: DataFrame, items: DataFrame, *, top: int = 20, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id",
    item_text_col: str = "text"
) -> DataFrame:
    """(item_id, rank, doc_id, score): for each item its `top` documents with a score above 0, the highest first, equal ones by ascending id.

    A term is a maximal run of ASCII letters and digits and non-ASCII characters, lower-cased in A-Z only; terms of one
    64-bit hash count as one.  A document's score is the sum over the item's terms, repeats included, of weight times
    impact, in integers.  Null and wordless texts are no documents, and items without terms find none; every row is a
    document, repeated ids too; documents without an id come last among equals; of rows of one item id the least text
    counts, items without an id are left out; other columns are ignored.
    """
    index, documents = lexical_index(docs, id_col=id_col, text_col=text_col)
    return search(cut(index), documents, items, top=top, item_id_col=item_id_col, item_text_col=item_text_col)


ORACLE = r"""
WITH words AS (
  SELECT doc_id, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents
), counts AS MATERIALIZED (
  SELECT doc_id, term, count(*) AS tf FROM words GROUP BY ALL
), sizes AS MATERIALIZED (
  SELECT doc_id, sum(tf)::BIGINT AS n FROM counts GROUP BY doc_id
), total AS MATERIALIZED (
  SELECT count(*) AS docs, sum(n)::BIGINT AS words FROM sizes
), asked AS (
  SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark)
  GROUP BY ALL
), weights AS MATERIALIZED (
  SELECT term, CAST(floor(1000 * ln((2.0::DOUBLE * docs + 2) / (2 * df + 1))) AS BIGINT) AS w
  FROM (SELECT term, count(*) AS df FROM counts WHERE term IN (SELECT term FROM asked) GROUP BY term), total
), scores AS (
  SELECT item_id, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // words)))) AS BIGINT) AS score
  FROM asked JOIN weights USING (term) JOIN counts USING (term) JOIN sizes USING (doc_id), total GROUP BY ALL
)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM scores WHERE score > 0 QUALIFY rank <= 20
"""
