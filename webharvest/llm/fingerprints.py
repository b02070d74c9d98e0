"""Document fingerprints by randomised edit embedding.

All texts walk over their characters with the same random bits: at step j the walk writes the character it
stands on and moves on if bit (j, character) is set.  Texts at a small edit distance fall into step again soon
after each edit, so their walks agree at most steps: edit distance becomes Hamming distance.  A fingerprint is
a fixed sample of the steps, 64 positions from each doubling of the step number, one hex digit each, so short
and long texts share positions and the sample covers the whole text.

Likeness is the share of agreeing steps, each sample weighted by the steps it stands for, corrected for chance
agreement.  Bit-sampled bands of the fingerprint, drawn over all the steps that two like texts must both have,
find like pairs; a verification by likeness follows.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._tables import components, cut
from ._words import mix, steps, text_buffers

#: Samples in each interval [2^k, 2^(k+1)) of steps; below 64 steps every step is sampled.
PER_OCTAVE = 64
#: Digits that a band samples.
WIDTH = 8
_U = np.uint64
_CHANCE = 1 / 16


def sample_positions(limit: int) -> np.ndarray:
    """The sampled steps below `limit`, ascending; the same for every text."""
    out = [np.arange(min(limit, PER_OCTAVE))]
    lo = PER_OCTAVE
    while lo < limit:
        cell = lo // PER_OCTAVE
        at = lo + np.arange(PER_OCTAVE) * cell + (mix(np.arange(PER_OCTAVE, dtype=_U) + _U(lo)) % _U(cell)).astype(np.int64)
        out.append(at[at < limit])
        lo *= 2
    return np.concatenate(out)


def _code_points(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(one byte per code point, offsets): the low byte of a code point, mixed with its upper bytes; never 0."""
    raw, offs = text_buffers(texts)
    lead = (raw & 0xC0) != 0x80
    count = np.concatenate([[0], np.cumsum(lead)])
    at = np.flatnonzero(lead)
    first = raw[at]
    value = first.astype(np.uint32)
    width = 1 + (first >= 0xC0) + (first >= 0xE0) + (first >= 0xF0)
    for k in (1, 2, 3):
        more = width > k
        value[more] = value[more] * 64 + raw[at[more] + k]
    byte = np.where(first < 0x80, first, 128 + (mix(value.astype(_U)) >> _U(57)).astype(np.uint8)).astype(np.uint8)
    return np.where(byte == 0, 1, byte).astype(np.uint8), count[offs]


def _moves(lo: int, hi: int) -> np.ndarray:
    """The shared random bits of steps lo..hi-1, one row of 256 a step; code 0, past a text's end, never moves."""
    bits = mix(np.arange(lo * 4, hi * 4, dtype=_U) + _U(0x5EED)).view(np.uint8)
    table = np.unpackbits(bits).reshape(hi - lo, 256)
    table[:, 0] = 0
    return table.astype(np.int64)


def fingerprints(texts: pa.Array) -> list[str]:
    """The fingerprint of each text; a null is an empty text, whose fingerprint is empty."""
    codes, offs = _code_points(texts)
    sizes = np.diff(offs)
    order = np.argsort(-sizes, kind="stable")
    padded = np.zeros(len(codes) + len(sizes), np.uint8)  # a zero after each text
    starts = offs[:-1] + np.arange(len(sizes))
    padded[np.repeat(np.arange(len(sizes)), sizes) + np.arange(len(codes))] = codes
    at = starts[order].copy()
    active = int((sizes > 0).sum())
    digits = np.full((len(sizes), 64), 255, np.uint8)
    limit = int(3 * sizes.max(initial=0)) + 1
    marks = sample_positions(limit)
    column, step, block = 0, 0, 256
    while active:
        if step + block > limit:  # a walk may need any number of steps, whatever other texts are in the batch
            limit = 2 * (step + block)
            marks = sample_positions(limit)
        table = _moves(step, step + block)
        here = set(marks[(marks >= step) & (marks < step + block)].tolist())
        pos = at[:active]
        for k in range(block):
            char = padded[pos]
            if step + k in here:
                if column == digits.shape[1]:
                    digits = np.concatenate([digits, np.full_like(digits, 255)], axis=1)
                hashed = (mix(char.astype(_U) * _U(0x9E3779B97F4A7C15) + _U(step + k)) >> _U(60)).astype(np.uint8)
                digits[:active, column] = np.where(char > 0, hashed, 255)
                column += 1
            pos += table[k][char]
        step += block
        while active and padded[at[active - 1]] == 0:
            active -= 1
        if step % 4096 == 0 and active:  # drop finished texts from the middle too
            alive = padded[at[:active]] > 0
            if alive.sum() < active // 2:
                move = np.concatenate([np.flatnonzero(alive), np.flatnonzero(~alive)])
                order[:active], at[:active], digits[:active] = order[:active][move], at[:active][move], digits[:active][move]
                active = int(alive.sum())
    out = [""] * len(sizes)
    hexes = np.frombuffer(b"0123456789abcdef", np.uint8)
    for k, row in enumerate(digits[:, :column]):
        used = int((row != 255).sum())
        out[order[k]] = hexes[row[:used]].tobytes().decode()
    return out


def _weights(n: int) -> np.ndarray:
    """Steps that each of the first n samples stands for."""
    k = np.arange(n)
    return np.where(k < PER_OCTAVE, 1, 2.0 ** (k // PER_OCTAVE - 1))


def likeness(a: str | None, b: str | None) -> float:
    """Likeness of two fingerprints, 0 to 1; samples that only the longer one has count as different; two empty ones are alike."""
    x, y = np.frombuffer((a or "").encode(), np.uint8), np.frombuffer((b or "").encode(), np.uint8)
    n, m = min(len(x), len(y)), max(len(x), len(y))
    if m == 0:
        return 1.0
    weight = _weights(m)
    share = float(weight[:n] @ (x[:n] == y[:n])) / float(weight.sum())
    return max(0.0, (share - _CHANCE) / (1 - _CHANCE))


def fingerprint_table(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint) of every row."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in steps(batch.column(1), 8 << 20):
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(fingerprints(part.column(1)), pa.string())], names=["doc_id", "fingerprint"]
                )

    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")
    ).mapInArrow(make, "doc_id long, fingerprint string")


def _unlike_links(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """Links (a, b) between classes, from rows (bucket, i, j, block, class_id, fingerprint) sorted by cell (bucket, i, j).

    A row is compared with the rows of the cell's other block, in a cell of one block with all its rows, unless
    their classes are linked already; a fingerprint too short or long to be like it by length alone is passed over.
    """

    def links(block: np.ndarray, classes: np.ndarray, texts: list[str]) -> list[tuple[int, int]]:
        size = np.array([len(x) for x in texts])
        order = np.argsort(size, kind="stable")
        block, classes, size = block[order], classes[order], size[order]
        digits = np.zeros((len(size), size[-1]), np.uint8)
        for k, row in enumerate(order):
            digits[k, : size[k]] = np.frombuffer(texts[row].encode(), np.uint8)
        weight = _weights(int(size[-1]))
        steps_of = np.concatenate([[0.0], np.cumsum(weight)])[size]
        root, out, one = classes.copy(), [], bool((block == block[0]).all())
        for k in range(1, len(size)):
            from_row = int(np.searchsorted(steps_of, steps_of[k] * (threshold * (1 - _CHANCE) + _CHANCE) * (1 - 1e-9)))
            while True:  # until no row of another class is like row k
                at = from_row + np.flatnonzero((root[from_row:k] != root[k]) & (one | (block[from_row:k] != block[k])))
                share = ((digits[at, : size[k]] == digits[k, : size[k]]) @ weight[: size[k]]) / steps_of[k]
                like = at[np.maximum(0.0, (share - _CHANCE) / (1 - _CHANCE)) >= threshold]
                if not len(like):
                    break
                out.append((int(root[k]), int(root[like[0]])))
                root[root == root[like[0]]] = root[k]
        return out

    held: list[tuple] = []

    def finish() -> pa.RecordBatch:
        found = links(np.array([r[1] for r in held]), np.array([r[2] for r in held], np.int64), [r[3] for r in held])
        return pa.RecordBatch.from_arrays(
            [pa.array([x for x, _ in found], pa.int64()), pa.array([x for _, x in found], pa.int64())], names=["a", "b"]
        )

    for batch in batches:
        for row in zip(zip(*(batch.column(k).to_pylist() for k in range(3))), *(batch.column(k).to_pylist() for k in range(3, 6))):
            if held and held[0][0] != row[0]:
                yield finish()
                held = []
            held.append(row)
    if held:
        yield finish()


def _scheme_sizes(threshold: float, digits: int) -> np.ndarray:
    """Digits that each scheme covers: scheme s covers the first ratio^s steps, up to texts of `digits` digits.

    ratio: that of the steps of the longest and the shortest text that can be alike at the threshold, and a
    fiftieth more for the step from one sample to the next.
    """
    ratio = 1.02 / (threshold * (1 - _CHANCE) + _CHANCE)
    ends = np.cumsum(_weights(digits))
    schemes = int(np.floor(np.log(ends[-1]) / np.log(ratio) + 1e-9)) + 1
    return np.searchsorted(ends, ratio ** np.arange(schemes) * (1 + 1e-9), side="right")


def band_keys(prints: pa.Array, threshold: float, bands: int) -> tuple[np.ndarray, np.ndarray]:
    """(key, row) of the bit-sampled bands of fingerprints.

    Each band of a scheme samples WIDTH digits, a digit as often as the steps it stands for.  A text takes part in
    the longest scheme that it covers and in the one before it; two texts that can be alike have one in common.
    """
    texts = prints.to_pylist()
    size = np.array([len(x) for x in texts], np.int64)
    covers = _scheme_sizes(threshold, max(int(size.max(initial=0)), 1))
    top = np.searchsorted(covers, size, side="right") - 1
    keys, rows = [], []
    for s in np.unique(top[size > 0]):
        own = np.flatnonzero((top == s) & (size > 0))
        digits = np.array([np.frombuffer(texts[k][: covers[s]].encode(), np.uint8) for k in own])
        digits = np.where(digits > 57, digits - 87, digits - 48).astype(_U)
        for scheme in {int(s), max(int(s) - 1, 0)}:
            draws = mix(np.arange(bands * WIDTH, dtype=_U) + _U(1 + scheme * 100003)) >> _U(11)
            ends = np.cumsum(_weights(int(covers[scheme])))
            at = np.searchsorted(ends, draws / 2.0**53 * ends[-1], side="right").reshape(bands, WIDTH)
            packed = np.zeros((len(own), bands), _U)
            for k in range(WIDTH):
                packed = packed * _U(16) + digits[:, at[:, k]]
            keys.append(mix(packed + (_U(scheme * bands) + np.arange(bands, dtype=_U) << _U(4 * WIDTH))).ravel())
            rows.append(np.repeat(own, bands))
    return (np.concatenate(keys), np.concatenate(rows)) if keys else (np.zeros(0, _U), np.zeros(0, np.int64))


def near_classes(prints: DataFrame, *, threshold: float = 0.8, bands: int = 24, block: int = 1024) -> DataFrame:
    """(doc_id, class_id) of `prints` (doc_id, fingerprint): groups linked by likeness, class_id the least doc_id.

    Rows of equal fingerprints are one from the start; in a bucket every row is first verified against the bucket's
    first row.  Rows of a bucket that are in different classes after that are compared in pairs, so that no pair of
    a bucket is left that could link two classes.  A bucket of n rows costs n comparisons if all are of one class;
    otherwise its rows outside its largest class are compared with all others, in cells of two blocks of `block` rows.
    Null fingerprints count as empty ones, which are alike; rows without an id are left out.
    """
    prints = prints.where("doc_id is not null").select("doc_id", F.coalesce("fingerprint", F.lit("")).alias("fingerprint"))
    keys = [F.xxhash64("fingerprint").alias("k1"), F.xxhash64(F.lit("second"), "fingerprint").alias("k2")]
    owners = cut(prints.groupBy(*keys).agg(F.min("doc_id").alias("doc_id")))
    own = prints.join(owners.select("doc_id"), "doc_id", "left_semi").select("doc_id", "fingerprint")

    def cast(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 2048):
                part = batch.slice(lo, 2048)
                key, row = band_keys(part.column(1), threshold, bands)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key.view(np.int64)), part.column(0).take(pa.array(row))], names=["bucket", "doc_id"]
                )

    spread = own.where("fingerprint <> ''").mapInArrow(cast, "bucket long, doc_id long").repartition("bucket")  # dealt once, for the heads and for their join
    heads = spread.groupBy("bucket").agg(F.min("doc_id").alias("head"), F.count("*").alias("rows")).where("rows > 1")
    shared = cut(spread.join(heads.hint("shuffle_hash"), "bucket").select("bucket", "doc_id", "head"))  # rows of buckets of more than one row
    pairs = cut(shared.where("doc_id <> head").select("doc_id", "head").distinct())
    near = cut(own.join(pairs.select("doc_id").union(pairs.select("head")).distinct(), "doc_id", "left_semi"))
    sides = pairs.join(near, "doc_id").join(near.select(F.col("doc_id").alias("head"), F.col("fingerprint").alias("other")), "head")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = [likeness(a, b) >= threshold for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    linked = sides.select(F.col("doc_id").alias("a"), F.col("head").alias("b"), "fingerprint", "other").mapInArrow(verify, "a long, b long")
    first = cut(components(linked))
    second = components(_links_between_classes(shared, first, near, threshold, block))
    renamed = second.select(F.col("node").alias("class_id"), F.col("class_id").alias("joined"))
    classes = first.join(renamed, "class_id", "full").select(
        F.coalesce("node", "class_id").alias("node"), F.coalesce("joined", "class_id").alias("class_id")
    )
    top = owners.join(classes.withColumnRenamed("node", "doc_id"), "doc_id", "left").select(
        "k1", "k2", F.coalesce("class_id", "doc_id").alias("class_id")
    )
    return prints.select("doc_id", *keys).join(top, ["k1", "k2"]).groupBy("doc_id").agg(F.min("class_id").alias("class_id"))


def _links_between_classes(shared: DataFrame, classes: DataFrame, near: DataFrame, threshold: float, block: int) -> DataFrame:
    """(a, b): links between the classes of each bucket's rows that the comparison with bucket heads has left apart."""
    members = cut(
        shared.join(classes.withColumnRenamed("node", "doc_id"), "doc_id", "left").select(
            "bucket", "doc_id", F.coalesce("class_id", "doc_id").alias("class_id")
        )
    )
    sizes = members.groupBy("bucket", "class_id").agg(
        F.count("*").alias("n"), F.sum(F.xxhash64("doc_id").cast("decimal(20,0)")).alias("s"), F.expr("bit_xor(xxhash64(7, doc_id))").alias("x")
    )
    mixed = sizes.groupBy("bucket").agg(
        F.max(F.struct("n", "class_id")).alias("top"), F.sum("n").alias("n"), F.count("*").alias("classes"), F.sum("s").alias("s"), F.expr("bit_xor(x)").alias("x")
    )
    mixed = mixed.where("classes > 1 and n > 2").groupBy("n", "s", "x").agg(F.min(F.struct("bucket", "top")).alias("b"))  # buckets of the same rows are one
    core_rows = F.col("b.top.n")
    mixed = mixed.select(
        "b.bucket", F.col("b.top.class_id").alias("core"),
        F.ceil((F.col("n") - core_rows) / block).cast("int").alias("rest_blocks"), F.ceil(core_rows / block).cast("int").alias("core_blocks"),
    )
    rest = F.col("class_id") != F.col("core")
    mine = F.when(
        rest, F.pmod(F.xxhash64("doc_id"), "rest_blocks")
    ).otherwise(F.col("rest_blocks") + F.pmod(F.xxhash64("doc_id"), "core_blocks")).cast("int")
    others = F.sequence(F.lit(0), F.when(rest, F.col("rest_blocks") + F.col("core_blocks") - 1).otherwise(F.col("rest_blocks") - 1))
    cells = members.join(mixed, "bucket").select("bucket", "doc_id", "class_id", mine.alias("block"), F.explode(others).alias("other"))
    cells = cells.select(
        "bucket", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "class_id", "doc_id"
    ).join(near, "doc_id")
    cells = cells.select(
        "bucket", "i", "j", "block", "class_id", "fingerprint"
    ).repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
    return cells.mapInArrow(lambda batches: _unlike_links(batches, threshold), "a long, b long")


EDITED = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _ranges(rows: DataFrame, range_bytes: int) -> list[int]:
    """Inner bounds of doc_id ranges of about `range_bytes` of text: quantiles of the ids, four to a range, joined by their bytes."""
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    cells = 4 * math.ceil(total / range_bytes)
    if cells <= 4:
        return []
    fine = np.unique(np.array(rows.approxQuantile("doc_id", [k / cells for k in range(1, cells)], 0.25 / cells), np.int64))
    cell = F.pandas_udf(lambda ids: pd.Series(np.searchsorted(fine, ids.to_numpy(), side="right")), "int")
    weight = dict(rows.groupBy(cell("doc_id").alias("cell")).agg(F.sum(F.octet_length("text")).alias("bytes")).collect())  # a row a cell
    bounds, held = [], 0
    for k in range(len(fine)):
        held += weight.get(k, 0)
        if held >= range_bytes * 3 // 4:
            bounds.append(int(fine[k]))
            held = 0
    return bounds


def edited_with_next(docs: DataFrame, *, range_bytes: int = 32 << 20) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next).

    The edited text is the text with its last floor(n_chars / 2) code points replaced by the first as many of the
    next text by ascending doc_id (all of it if shorter; after the last, the first).  The texts are dealt in ranges
    of doc_id of about `range_bytes`, a partition each, and sorted; the first text of each range is dealt to the
    range before it as well.
    Null texts count as empty; rows without an id are left out; of repeated ids the least text stays.
    """
    rows = docs.where("doc_id is not null").select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    )
    bounds = np.array(_ranges(rows, range_bytes), np.int64)
    range_of = F.pandas_udf(lambda ids: pd.Series(np.searchsorted(bounds, ids.to_numpy(), side="right")), "int")
    heads = rows.select("doc_id").withColumn("part", range_of("doc_id")).groupBy("part").agg(F.min("doc_id").alias("doc_id")).toPandas().sort_values("part")  # a row a range
    if not len(heads):
        return docs.sparkSession.createDataFrame([], EDITED)
    ids, before = heads["doc_id"].to_numpy(np.int64), np.roll(heads["part"].to_numpy(np.int64), 1)

    @F.pandas_udf("array<int>")
    def places(column: pd.Series) -> pd.Series:
        """The range of an id and, for a range's first id, the range before it, which needs its text as the last "next"."""
        values = column.to_numpy(np.int64)
        own = np.searchsorted(bounds, values, side="right")
        at = np.minimum(np.searchsorted(ids, values), len(ids) - 1)
        return pd.Series([[a, b] if head else [a] for a, b, head in zip(own.tolist(), before[at].tolist(), (ids[at] == values).tolist())])

    copies = rows.select(F.posexplode(places("doc_id")).alias("extra", "part"), "doc_id", "text")
    placed = copies.repartitionById(len(bounds) + 1, F.col("part")).sortWithinPartitions("part", "extra", "doc_id", "text").select("part", "extra", "doc_id", "text")

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None  # the last row of the batch before, whose next text is yet to come

        def finish(ids, texts, nexts):
            lo = 0
            while lo < len(ids):
                hi, total = lo, 0
                while hi < len(ids) and (hi == lo or total < 4 << 20):
                    total += len(texts[hi]) + len(nexts[hi])
                    hi += 1
                part_ids, a, b = ids[lo:hi], texts[lo:hi], nexts[lo:hi]
                edited = [x[: len(x) - len(x) // 2] + y[: len(x) // 2] for x, y in zip(a, b)]
                p = fingerprints(pa.array(a, pa.large_string()))
                q = fingerprints(pa.array(edited, pa.large_string()))
                r = p[1:] + fingerprints(pa.array(b[-1:], pa.large_string()))
                columns = [
                    pa.array(part_ids, pa.int64()), pa.array([len(x) for x in a], pa.int64()), pa.array(
                        [hashlib.sha256(x.encode()).hexdigest() for x in edited], pa.string()
                    ),
                    pa.array(p, pa.string()), pa.array(q, pa.string()), pa.array(
                        [likeness(x, y) for x, y in zip(p, q)], pa.float64()
                    ), pa.array([likeness(x, y) for x, y in zip(p, r)], pa.float64()),
                ]
                yield pa.RecordBatch.from_arrays(
                    columns, names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
                )
                lo = hi

        for batch in batches:
            ids, texts, nexts = [], [], []
            for key, extra, doc, text in zip(*(batch.column(k).to_pylist() for k in range(4))):
                if held is not None and held[0] == key:
                    if not extra and held[1] == doc:
                        continue  # a repeated id
                    ids.append(held[1])
                    texts.append(held[2])
                    nexts.append(text)
                held = None if extra else (key, doc, text)
            yield from finish(ids, texts, nexts)

    return placed.mapInArrow(make, EDITED)
