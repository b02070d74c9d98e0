"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

Word n-grams of the test items are the seeds: of three words, of two or one for items so short that an edited copy need
not keep three in a row.  One pass over the training texts keeps the passages around seed hits.  Passages then meet the items in packs and blocks, where they stand: rare seeds, those that few items share
and few passages hold, are joined to their items there; with a common seed, the words that a passage shares with each item
bound what it can score.  So no seed is dropped, no table of the pairs of a common seed exists, and passages are not
moved.  What remains is scored by local alignment of words, which tolerates substituted, inserted and deleted words.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._tables import cut
from ._words import Words, steps

MATCH, MISMATCH, GAP = 2.0, -1.0, -1.0
#: The seed filter sent to the tasks is a table of this fixed number of bytes (4 MB), whatever the number of seeds.
FILTER_BITS = 22
#: Items by their words: up to 16, 64, 256 ... words; a passage is as long as the items of its class need.
CLASSES = tuple(4**k for k in range(2, 9))
#: Items of a block, passages of a pack; places of words in items that a pack's passages are counted at a time.
ITEMS, PACK, SPOTS = 512, 256, 1 << 18
PASSAGES = "doc_id long, first long, class int, seeds array<long>, words binary"


def seed_words(n_words: int, n: int = 3) -> int:
    """Words of an item's seeds: a copy that scores 0.6 with words substituted or left out keeps so many in a row."""
    return min(n, 1 if n_words == 1 else 2 if n_words <= 8 else 3)


def item_class(n_words: int) -> int:
    return int(np.searchsorted(CLASSES, n_words))


def item_seeds(items: DataFrame, n: int, id_col: str, text_col: str) -> DataFrame:
    """(item_id, words, n_words, class, size, seeds) of the test items, seeds of `size` words; null and wordless items have none."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in steps(batch.column(1)):
                part = batch.slice(lo, hi - lo)
                w = Words(part.column(1))
                size = [seed_words(int(k), n) for k in w.counts]
                seeds: list[np.ndarray] = [np.zeros(0, np.int64)] * len(size)
                for k in sorted(set(size)):
                    g, row, _ = w.shingles(k)
                    ends = np.searchsorted(row, np.arange(hi - lo + 1))
                    for i in np.flatnonzero((np.array(size) == k) & (w.counts > 0)):
                        seeds[i] = np.unique(g[ends[i] : ends[i + 1]]).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0), pa.array([w.hash[a:b].tobytes() for a, b in zip(w.first, w.first[1:])], pa.binary()),
                        pa.array(w.counts.astype(np.int64)), pa.array([item_class(int(k)) for k in w.counts], pa.int32()),
                        pa.array(size, pa.int32()), pa.array(seeds, pa.list_(pa.int64()))
                    ],
                    names=["item_id", "words", "n_words", "class", "size", "seeds"],
                )

    rows = items.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("item_id"), F.col(text_col).cast("string").alias("text")
    )
    return rows.mapInArrow(make, "item_id long, words binary, n_words long, class int, size int, seeds array<long>").where("n_words > 0")


def seed_filter(seeds: DataFrame) -> np.ndarray:
    """The classes of items that have a seed at each place, a bit each: a fixed 2^FILTER_BITS bytes."""
    rows = seeds.selectExpr(
        f"cast(shiftrightunsigned(seed, {64 - FILTER_BITS}) as int) place", "shiftleft(1, class) bit"
    ).groupBy("place").agg(F.bit_or("bit").alias("bits"))
    found, table = rows.toPandas(), np.zeros(1 << FILTER_BITS, np.uint8)
    table[found["place"].to_numpy(np.int64)] = found["bits"].to_numpy(np.int64)
    return table


def passages(docs: DataFrame, table, sizes: list[int], reaches: dict[int, int], id_col: str, text_col: str) -> DataFrame:
    """The stretches of the texts around the seed hits of each class: its reach of words on either side, adjoining stretches
    merged up to 8 times that; the words of runs of `sizes` words are tried at every place."""

    def stretches(w: Words, ids: np.ndarray, kind: int, reach: int, hits: list, out: tuple[list, ...]) -> None:
        row, pos, seed, size = (np.concatenate(x) for x in zip(*hits))
        order = np.lexsort((pos, row))
        r, p, seed, size = row[order], pos[order], seed[order].view(np.int64), size[order]
        new = np.ones(len(r), bool)
        new[1:] = (r[1:] != r[:-1]) | (p[1:] - p[:-1] > reach)
        starts = np.flatnonzero(new)
        for a, b in zip(starts, np.append(starts[1:], len(r))):
            while a < b:  # a long stretch goes on in the next one, which overlaps it by `reach` words on its left
                c = a + max(1, int(np.searchsorted(p[a:b], p[a] + 6 * reach)))
                base, count = w.first[r[a]], w.counts[r[a]]
                s, e = max(0, p[a] - reach), min(count, int((p[a:c] + size[a:c]).max()) + reach)
                for column, value in zip(
                    out, (ids[r[a]], int(s), kind, np.unique(seed[a:c]), w.hash[base + s : base + e].tobytes()), strict=True
                ):
                    column.append(value)
                a = c

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = table.value
        for batch in batches:
            for lo, hi in steps(batch.column(1)):
                part = batch.slice(lo, hi - lo)
                ids = part.column(0).to_numpy(zero_copy_only=False)
                w = Words(part.column(1))
                hits: dict[int, list] = {}
                for size in sizes:
                    g, row, pos = w.shingles(size)
                    mask = bits[(g >> np.uint64(64 - FILTER_BITS)).astype(np.int64)]
                    for kind in reaches:
                        at = np.flatnonzero(mask >> kind & 1)
                        if len(at):
                            hits.setdefault(kind, []).append((row[at], pos[at], g[at], np.full(len(at), size)))
                out: tuple[list, ...] = ([], [], [], [], [])
                for kind, found in hits.items():
                    stretches(w, ids, kind, reaches[kind], found, out)
                if out[0]:
                    types = (pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.binary())
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, t in zip(out, types)], names=["doc_id", "first", "class", "seeds", "words"]
                    )

    rows = docs.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")
    )
    return rows.mapInArrow(make, PASSAGES)


def align(item: np.ndarray, passage: np.ndarray) -> tuple[float, int, int]:
    """Best local alignment: (score, first word, end word of the passage)."""
    m = len(passage)
    ramp = -GAP * np.arange(1, m + 1, dtype=np.float32)
    last, begun = np.zeros(m + 1, np.float32), np.arange(m + 1)
    best = (0.0, 0, 0)
    for word in item:
        score = np.where(passage == word, np.float32(MATCH), np.float32(MISMATCH))
        diagonal, above = last[:-1] + score, last[1:] + np.float32(GAP)
        open_ = np.maximum(np.maximum(diagonal, above), 0)
        origin = np.where(diagonal >= above, begun[:-1], begun[1:])
        origin = np.where(open_ > 0, origin, np.arange(1, m + 1))
        # a gap along the passage: the best earlier cell less its distance
        lifted = open_ + ramp
        peak = np.maximum.accumulate(lifted)
        source = np.maximum.accumulate(np.where(lifted == peak, np.arange(m), 0))
        row = np.empty(m + 1, np.float32)
        row[0], row[1:] = 0, peak - ramp
        start = np.empty(m + 1, np.int64)
        start[0], start[1:] = 0, origin[source]
        k = int(row.argmax())
        if row[k] > best[0]:
            best = (float(row[k]), int(start[k]), k)
        last, begun = row, start
    return best


class _Block:
    """A block of items: which of its words each item has how often, and the items of each rare seed."""

    def __init__(self, rows: list[dict]):
        self.ids, self.kinds = np.array([r["item_id"] for r in rows]), np.array([r["class"] for r in rows])
        self.items = [np.frombuffer(r["words"], np.uint64) for r in rows]
        self.sizes = np.array([len(x) for x in self.items])
        words = np.concatenate(self.items)
        self.words, word = np.unique(words, return_inverse=True)
        size = len(self.items)
        pair, self.times = np.unique(word * size + np.repeat(np.arange(size), self.sizes), return_counts=True)
        self.item = pair % size
        self.first = np.searchsorted(pair // size, np.arange(len(self.words) + 1))
        seeds = np.array([s for r in rows for s in r["rare"]], np.int64)
        order = np.argsort(seeds, kind="stable")
        self.seeds, self.owner = seeds[order], np.repeat(np.arange(size), [len(r["rare"]) for r in rows])[order]

    def joined(self, seeds: list[np.ndarray], common: list[bool]) -> np.ndarray:
        """Which items each passage (rows) can hold: all with a common seed, else those of its rare seeds."""
        out = np.repeat(np.array(common)[:, None], len(self.items), 1)
        row = np.repeat(np.arange(len(seeds)), [len(x) for x in seeds])
        flat = np.concatenate(seeds)
        lo, hi = np.searchsorted(self.seeds, flat), np.searchsorted(self.seeds, flat, "right")
        n = hi - lo
        out[np.repeat(row, n), self.owner[np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())]] = True
        return out

    def reachable(self, passages: list[np.ndarray]) -> np.ndarray:
        """The most that local alignments of each passage (rows) with each item can score: a match for each item word that the passage has."""
        words = np.concatenate(passages)
        row = np.repeat(np.arange(len(passages)), [len(p) for p in passages])
        at = np.minimum(np.searchsorted(self.words, words), len(self.words) - 1)
        have = self.words[at] == words
        key = np.unique(row[have] * len(self.words) + at[have])
        row, at = key // len(self.words), key % len(self.words)
        counts = self.first[at + 1] - self.first[at]
        size, out = len(self.items), np.zeros((len(passages), len(self.items)))
        before = np.concatenate([[0], np.cumsum(counts)])
        ends = np.searchsorted(row, np.arange(len(passages) + 1))  # of the passages' different words
        lo = 0
        while lo < len(passages):
            hi = max(lo + 1, int(np.searchsorted(before[ends], before[ends[lo]] + SPOTS, "right")) - 1)
            a, b = ends[lo], ends[hi]
            n = counts[a:b]
            spots = np.repeat(self.first[at[a:b]] - np.cumsum(n) + n, n) + np.arange(n.sum())
            keys = np.repeat(row[a:b] - lo, n) * size + self.item[spots]
            out[lo:hi] = np.bincount(keys, self.times[spots], (hi - lo) * size).reshape(-1, size)
            lo = hi
        return MATCH * out


SCORED = "doc_id long, item_id long, cost double, first_word long, end_word long"


def _scores(found: DataFrame, known: DataFrame, common: DataFrame, min_score: float) -> DataFrame:
    """Scores of passages against the items of their class, in packs of passages and blocks of items."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.binary())
        for batch in batches:
            for lo in range(0, batch.num_rows, PACK):
                part = batch.slice(lo, PACK)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part.column(k).to_pylist()], pa.list_(t)) for k, t in enumerate(kinds)], names=["ids", "firsts", "kinds", "seeds", "words"]
                )

    packs = found.select("doc_id", "first", "class", "seeds", "words").mapInArrow(
        pack, "ids array<long>, firsts array<long>, kinds array<int>, seeds array<array<long>>, words array<binary>"
    )
    shared = common.select("seed", F.lit(True).alias("common"))
    rare = known.select("item_id", "words", F.explode("seeds").alias("seed")).join(shared, "seed", "left").groupBy("item_id", "words").agg(
        F.collect_list(F.when(F.col("common").isNull(), F.col("seed"))).alias("rare"),
        F.collect_list(F.when(F.col("common"), F.col("seed"))).alias("often")
    )
    number = F.pmod(F.xxhash64("item_id", "words"), F.lit(max(1, math.ceil(known.count() / ITEMS)))).alias("block")
    blocks = known.select("item_id", "class", "words").join(rare, ["item_id", "words"]).groupBy(number).agg(
        F.collect_list(F.struct("item_id", "class", "words", "rare")).alias("items"), F.array_distinct(F.flatten(F.collect_list("often"))).alias("often")
    )

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[int, tuple[_Block, np.ndarray]] = {}
        for batch in batches:
            for r in range(batch.num_rows):
                number = batch.column(5)[r].as_py()
                if number not in made:
                    made[number] = _Block(batch.column(6)[r].as_py()), np.array(batch.column(7)[r].as_py(), np.int64)
                (block, often), rows = made[number], []
                ids, firsts, kinds, seeds, words = (batch.column(k)[r].as_py() for k in range(5))
                # equal passages of a pack are scored once
                different: dict[tuple, int] = {}
                same = [different.setdefault((kinds[k], words[k], tuple(seeds[k])), len(different)) for k in range(len(ids))]
                passages = [np.frombuffer(x[1], np.uint64) for x in different]
                hits = [np.array(x[2], np.int64) for x in different]
                able = block.joined(hits, [bool(np.isin(x, often).any()) for x in hits])
                able &= np.array([x[0] for x in different])[:, None] == block.kinds[None, :]
                least = min_score * MATCH * block.sizes
                able &= block.reachable(passages) >= least
                scored: dict[int, list[tuple]] = {}
                for p, i in zip(*np.nonzero(able)):
                    got, start, end = align(block.items[i], passages[p])
                    if got >= least[i]:
                        scored.setdefault(p, []).append((int(block.ids[i]), -got / (MATCH * int(block.sizes[i])), start, end))
                for doc, first, p in zip(ids, firsts, same):
                    rows += [(doc, item, cost, first + start, first + end) for item, cost, start, end in scored.get(p, ())]
                columns = list(zip(*rows)) or [[]] * 5
                types = (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(columns, types)], names=["doc_id", "item_id", "cost", "first_word", "end_word"]
                )

    return packs.crossJoin(blocks).select(*packs.columns, "block", "items", "often").mapInArrow(score, SCORED)


def contaminated(
    docs: DataFrame, items: DataFrame, *, n: int = 3, min_score: float = 0.6, rare_items: int = 4, rare_share: float = 0.0005,
    id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text"
) -> DataFrame:
    """(doc_id, item_id, score, first_word, end_word): texts that hold a test item, copied or edited.

    score: alignment score over that of a perfect copy of the item, from min_score to 1; the best stretch of the
    text counts, ties by the earlier one.  A seed
    is rare if at most `rare_items` items share it and at most a share `rare_share` of the passages (1000 at least)
    hold it.  A passage with rare seeds alone is held against their items, one with a common seed against all of its length
    class; it is aligned with those whose words it holds often enough to reach the score.  Seeds have up to `n` words, so
    that at the default score a text that changes or drops an item's words keeps one; what inserts more words than
    every second one may keep none.  Ids are integers (others are an error).  Null and wordless texts and items match
    nothing; repeated rows of an id count once; other columns are ignored.
    """
    spark = docs.sparkSession
    known = cut(item_seeds(items, n, item_id_col, item_text_col))
    shapes = known.groupBy("class", "size").agg(F.max("n_words").alias("longest")).collect()
    if not shapes:
        return spark.createDataFrame([], "doc_id long, item_id long, score double, first_word long, end_word long")
    # an alignment spans the item and the words inserted into it, at most so many as the score can bear
    reaches: dict[int, int] = {}
    for r in shapes:
        reaches[r["class"]] = max(reaches.get(r["class"], 0), math.ceil(r.longest * (1 + max(0.0, MATCH - MATCH * min_score))))
    seeds = known.select("item_id", "class", F.explode("seeds").alias("seed"))
    table = spark.sparkContext.broadcast(seed_filter(seeds))
    found = cut(passages(docs, table, sorted({r["size"] for r in shapes}), reaches, id_col, text_col))
    spread = seeds.groupBy("seed").agg(F.count_distinct("item_id").alias("items"))
    hits = found.select(F.explode("seeds").alias("seed")).groupBy("seed").agg(F.count("*").alias("hits"))
    limit = F.greatest(F.lit(1000.0), F.lit(rare_share * found.count()))
    common = cut(
        spread.join(hits, "seed", "left").where((F.col("items") > rare_items) | (F.coalesce("hits", F.lit(0)) > limit)).select("seed")
    )
    best = F.min(F.struct("cost", "first_word", "end_word"))
    top = _scores(found, known, common, min_score).groupBy("doc_id", "item_id").agg(best.alias("best"))
    return top.select("doc_id", "item_id", (-F.col("best.cost")).alias("score"), "best.first_word", "best.end_word")


def decontaminate(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """The rows of `docs` that hold no test item; columns and rows without an id stay as they are."""
    id_col = options.get("id_col", "doc_id")
    bad = contaminated(docs, items, **options).select(F.col("doc_id").alias(id_col)).distinct()
    return docs.join(bad, id_col, "left_anti").select(*docs.columns)
