"""Phrase collocations by sorted count streams.

Counts of one- to three-word phrases are kept as two streams, one in prefix order (first word first) and one in
suffix order (last word first).  In prefix order every phrase stands right behind the phrases that it extends, so a
single scan in step with the stream reads off the counts of its left parts; in suffix order, of its right parts.
The streams are cut into ranges of any length, also within a word, and no phrase is looked up by hash: only the rows
at the head of a range, whose parts ended the range before, take them from a table of a row or two for each range.

Trigrams are counted only where both of their bigrams are frequent enough, which every frequent trigram's are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._tables import cut
from ._words import hash_strings, mix, steps, text_buffers

#: The filter of frequent bigrams sent to the tasks is a bit table of this fixed size (16 MB), whatever their number;
#: a bigram that it passes by chance costs a row, none is lost.
FILTER_BITS, PIECE_BITS = 27, 20
#: Bytes of text counted at once in a task; beside the filter, half as many.
STEP_BYTES = 1 << 20
GRAMS = "lang string, phrase string, f long"
_SPACE, _BREAK = np.zeros(256, bool), np.zeros(256, bool)
_SPACE[[9, 32]] = True
_BREAK[[*b".,;:!?", *range(10, 14)]] = True


class _Pieces:
    """The words of texts: `word`, an index into the strings `words`; `more`, whether the next word goes on in the same piece."""

    def __init__(self, texts: pa.Array):
        raw, offs = text_buffers(texts)
        raw = np.where((raw >= 65) & (raw <= 90), raw + 32, raw).astype(np.uint8)
        broken, n = _BREAK[raw], len(raw)
        w = ~(broken | _SPACE[raw])
        first, last = w.copy(), w.copy()
        if n:
            first[1:] &= ~w[:-1]
            last[:-1] &= ~w[1:]
            inner = offs[(offs > 0) & (offs < n)]
            first[inner] = w[inner]
            last[inner - 1] = w[inner - 1]
        start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.row = np.searchsorted(offs, start, "right") - 1
        breaks = np.cumsum(broken)[start] if n else start
        self.more = np.zeros(len(start), bool)
        self.more[:-1] = (self.row[1:] == self.row[:-1]) & (breaks[1:] == breaks[:-1])
        ends = np.zeros(len(start) + 1, np.int64)
        np.cumsum(end - start, out=ends[1:])
        spelled = pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(raw[w])))
        coded = spelled.dictionary_encode()
        self.words, self.word = coded.dictionary, coded.indices.to_numpy().astype(np.int64)


def _bigram_hash(lang: np.ndarray, first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Place of a bigram in the filter, from the hashes of its language and words."""
    return mix(lang + first * np.uint64(3) + mix(second + np.uint64(1))) >> np.uint64(64 - FILTER_BITS)


def _count(docs: DataFrame, lang_col: str, text_col: str, table=None) -> DataFrame:
    """(lang, phrase, f), summed within parts of a task: words, bigrams and, as an empty phrase, all words; with a filter, trigrams."""

    def batch(part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        p = _Pieces(part.column(1))
        if not len(p.word):
            return
        langs = pc.fill_null(part.column(0), "und").cast(pa.large_string()).dictionary_encode()
        lang = langs.indices.to_numpy().astype(np.int64)[p.row]
        size = np.int64(len(p.words))
        at = np.flatnonzero(p.more)
        one, which, f1 = np.unique(lang * size + p.word, return_inverse=True, return_counts=True)
        two, pair, f2 = np.unique(which[at] * size + p.word[at + 1], return_inverse=True, return_counts=True)
        if table is None:
            total = np.bincount(lang, minlength=len(langs.dictionary))
            some = np.flatnonzero(total)
            yield from rows(langs, some, [], total[some])
            yield from rows(langs, one // size, [p.words.take(pa.array(one % size))], f1)
            left, right = one[two // size], two % size
            yield from rows(langs, left // size, [p.words.take(pa.array(left % size)), p.words.take(pa.array(right))], f2)
            return
        spelled, tongue = hash_strings(p.words), hash_strings(langs.dictionary)
        left, right = one[two // size], two % size
        place = _bigram_hash(tongue[left // size], spelled[left % size], spelled[right]).astype(np.int64)
        frequent = (table.value[place >> 3] >> (place & 7).astype(np.uint8) & 1).astype(bool)
        good = np.zeros(len(p.word), bool)
        good[at] = frequent[pair]
        number = np.zeros(len(p.word), np.int64)
        number[at] = pair
        begin = np.flatnonzero(good[:-1] & good[1:])
        three, f3 = np.unique(number[begin] * size + p.word[begin + 2], return_counts=True)
        left = two[three // size]
        head = one[left // size]
        words = [p.words.take(pa.array(x)) for x in (head % size, left % size, three % size)]
        yield from rows(langs, head // size, words, f3)

    def rows(langs, lang: np.ndarray, words: list, f: np.ndarray) -> Iterator[pa.RecordBatch]:
        spelled = langs.dictionary.take(pa.array(lang))
        phrase = pc.binary_join_element_wise(*words, pa.scalar(" ", pa.large_string())) if words else pc.if_else(True, "", spelled)
        every = pa.RecordBatch.from_arrays(
            [spelled.cast(pa.string()), phrase.cast(pa.string()), pa.array(f.astype(np.int64))], names=["lang", "phrase", "f"]
        )
        for lo in range(0, len(f), 1 << 17):
            yield every.slice(lo, 1 << 17)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi in steps(b.column(1), STEP_BYTES if table is None else STEP_BYTES // 2):
                yield from batch(b.slice(lo, hi - lo))

    texts = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    return texts.mapInArrow(make, GRAMS).groupBy("lang", "phrase").agg(F.sum("f").alias("f"))


def _bigram_filter(bigrams: DataFrame) -> np.ndarray:
    """The bit table of (lang, w1, w2): a fixed 2^FILTER_BITS bits, made in pieces of 2^PIECE_BITS by a task each."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = _bigram_hash(*(hash_strings(b.column(k)) for k in range(3))).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(at)], names=["at"])

    def piece(table: pa.Table) -> pa.Table:
        word, bits = table.column("word").to_numpy(), table.column("bits").to_numpy()
        made = np.zeros(1 << (PIECE_BITS - 6), np.int64)
        made[word & (len(made) - 1)] = bits
        return pa.table({"piece": [int(word[0]) >> (PIECE_BITS - 6)], "bits": [made.tobytes()]}, pa.schema([("piece", pa.int64()), ("bits", pa.binary())]))

    bits = bigrams.select("lang", "w1", "w2").mapInArrow(place, "at long")
    packed = bits.selectExpr("at >> 6 AS word", "shiftleft(1L, cast(at & 63 AS int)) AS bit").groupBy("word").agg(F.bit_or("bit").alias("bits"))
    pieces = packed.groupBy((F.col("word") / (1 << (PIECE_BITS - 6))).cast("long").alias("piece")).applyInArrow(piece, "piece long, bits binary")
    table = np.zeros(1 << (FILTER_BITS - 3), np.uint8)
    for r in pieces.toLocalIterator():
        table[r.piece << (PIECE_BITS - 3) : r.piece + 1 << (PIECE_BITS - 3)] = np.frombuffer(r.bits, np.uint8)
    return table


def parts_of(stream: DataFrame, words: list[str]) -> DataFrame:
    """`stream` (lang, words..., f), in the order of the given word columns, with f1 and f2: the counts of its first and first two words.

    Every phrase's shorter beginnings must be in the stream.  A scan over each range carries the last phrase of one
    and of two words; a range's head, whose parts stand in an earlier range, is completed from the few phrases that
    heads miss, one of each length at most for a range.
    """
    one, two, three = words
    order = ["lang", one, two, three]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last1, last2 = -1, -1  # -1: not met in this range yet
        for b in batches:
            f = b.column("f").to_numpy()
            size = np.where(b.column(two).is_valid(), np.where(b.column(three).is_valid(), 3, 2), 1)
            columns = []
            for level, last in ((1, last1), (2, last2)):
                here = np.maximum.accumulate(np.where(size == level, np.arange(1, len(f) + 1), 0))
                columns.append(np.where(here > 0, f[np.maximum(here - 1, 0)], last))
            last1, last2 = (int(c[-1]) if len(c) else x for c, x in zip(columns, (last1, last2)))
            columns[1] = np.where(size == 1, 0, columns[1])
            arrays = [b.column(k) for k in range(b.num_columns)] + [pa.array(c.astype(np.int64)) for c in columns]
            yield pa.RecordBatch.from_arrays(arrays, names=[*b.schema.names, "f1", "f2"])

    schema = "lang string, w1 string, w2 string, w3 string, z1 string, z2 string, z3 string, f long, f1 long, f2 long"
    lined = stream.repartitionByRange(*order).sortWithinPartitions(*order)
    scanned = cut(lined.mapInArrow(scan, schema))
    for level, keys in ((1, ["lang", one]), (2, ["lang", one, two])):
        missing = scanned.where(F.col(f"f{level}") < 0).select(*keys).distinct()  # one for each range at most
        whole = stream.where(F.col(words[level]).isNull() & F.col(words[level - 1]).isNotNull())
        known = whole.join(F.broadcast(missing), keys, "left_semi").select(*keys, F.col("f").alias("_f"))
        scanned = scanned.join(F.broadcast(known), keys, "left").withColumn(
            f"f{level}", F.when(F.col(f"f{level}") < 0, F.col("_f")).otherwise(F.col(f"f{level}"))
        ).drop("_f")
    return scanned


def _score(a: Column, left: Column, right: Column) -> Column:
    """floor(10^6 a^2 / (l r)) exactly: products of up to 38 digits."""
    big = lambda c: c.cast("decimal(16,0)")
    return F.call_function("div", F.lit(1_000_000).cast("decimal(7,0)") * (big(a) * big(a)).cast("decimal(31,0)"), (big(left) * big(right)).cast("decimal(32,0)"))


def collocations(
    docs: DataFrame, *, least: int = 10, top: int = 2000, covered: int = 50, lang_col: str = "lang", text_col: str = "text"
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the `top` phrases of two and three words of each language by score.

    Texts are lower-cased in A-Z and split at . , ; : ! ? and line ends into pieces, these at spaces and tabs into
    words.  a, l, r: occurrences within pieces of the phrase, of its first and of its last part at the lowest-scoring
    cut (of equal ones the first); n: all words of the language; score: floor(10^6 a^2 / (l r)), exact.  Phrases need
    `least` occurrences; one that lies in a longer such phrase with at least `covered` percent of its occurrences is
    left out.  Ties in score go by a, then by the bytes of the phrase.  Null texts count as empty, a null lang as
    `und`; repeated rows count as often as they stand; other columns are ignored; an empty table has no rows.
    """
    spark = docs.sparkSession
    counted = cut(_count(docs, lang_col, text_col).where((F.col("f") >= least) | (F.col("phrase") == "")))
    words = F.split("phrase", " ")

    def spread(df: DataFrame) -> DataFrame:
        w = [F.get(words, k) for k in range(3)]
        size = F.size(words)
        z = [F.get(words, size - 1 - k) for k in range(3)]
        return df.select("lang", *[c.alias(f"w{k + 1}") for k, c in enumerate(w)], *[c.alias(f"z{k + 1}") for k, c in enumerate(z)], "f")

    short = spread(counted.where("phrase <> ''"))
    table = spark.sparkContext.broadcast(_bigram_filter(short.where("w2 IS NOT NULL")))
    long = spread(_count(docs, lang_col, text_col, table).where(F.col("f") >= least))
    stream = cut(short.unionByName(long))
    ahead = parts_of(stream, ["w1", "w2", "w3"]).where("w2 IS NOT NULL")
    behind = parts_of(stream, ["z1", "z2", "z3"]).where("w2 IS NOT NULL")
    full = ["lang", "w1", "w2", F.coalesce("w3", F.lit("")).alias("w3"), "f"]
    both = ahead.select(*full, F.col("f1").alias("l1"), F.col("f2").alias("l2")).hint("merge").join(
        behind.select(*full, F.col("f1").alias("r1"), F.col("f2").alias("r2")), ["lang", "w1", "w2", "w3", "f"]
    )
    pair = F.col("w3") == ""
    early = F.struct(F.col("l1").alias("l"), F.when(pair, F.col("r1")).otherwise(F.col("r2")).alias("r"))
    late = F.struct(F.col("l2").alias("l"), F.col("r1").alias("r"))
    scored = both.select(
        "*", _score(F.col("f"), early["l"], early["r"]).alias("s1"),
        F.when(~pair, _score(F.col("f"), late["l"], late["r"])).alias("s2")
    )
    cuts = cut(scored.withColumn("c", F.when(F.col("s2") < F.col("s1"), late).otherwise(early)))
    # a trigram knows the counts of both its bigrams, so it names those that it covers
    three = cuts.where("w3 <> ''")
    inside = three.where(F.col("f") * 100 >= F.col("l2") * covered).select("lang", "w1", "w2").unionByName(
        three.where(F.col("f") * 100 >= F.col("r2") * covered).select("lang", F.col("w2").alias("w1"), F.col("w3").alias("w2"))
    ).distinct().withColumn("w3", F.lit(""))
    kept = cuts.hint("merge").join(inside, ["lang", "w1", "w2", "w3"], "left_anti")
    phrase = F.concat_ws(" ", "w1", "w2", F.nullif("w3", F.lit("")))
    rows = kept.select(
        "lang", phrase.alias("phrase"), F.col("f").alias("a"), F.col("c.l").alias("l"), F.col("c.r").alias("r"),
        F.least("s1", "s2").cast("long").alias("score")
    )
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    best = rows.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top)
    totals = counted.where("phrase = ''").select("lang", F.col("f").alias("n"))
    return best.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


ORACLE = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), split AS (
  SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM pieces
), grams AS (
  SELECT lang, 1 AS size, unnest(ws) AS phrase FROM split
  UNION ALL SELECT lang, 2, unnest(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) FROM split
  UNION ALL SELECT lang, 3, unnest(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) FROM split
), counts AS MATERIALIZED (
  SELECT lang, size, phrase, count(*) AS f FROM grams GROUP BY ALL
), halves AS MATERIALIZED (
  SELECT lang, phrase, f AS a, k, array_to_string(w[1:k], ' ') AS head, array_to_string(w[k + 1:], ' ') AS rest
  FROM (SELECT *, string_split(phrase, ' ') AS w, unnest(range(1, size)) AS k FROM counts WHERE size > 1 AND f >= 10)
), cuts AS (
  SELECT h.lang, h.phrase, a, k, l.f AS l, r.f AS r, CAST((1000000::HUGEINT * a * a) // (l.f::HUGEINT * r.f) AS BIGINT) AS score
  FROM halves h JOIN counts l ON l.lang = h.lang AND l.phrase = head JOIN counts r ON r.lang = h.lang AND r.phrase = rest
), lowest AS (
  SELECT lang, phrase, a, l, r, score FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), covering AS MATERIALIZED (
  SELECT lang, phrase, max(f) AS longer FROM (
    SELECT lang, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS phrase, f
    FROM (SELECT lang, f, string_split(phrase, ' ') AS w FROM counts WHERE size = 3 AND f >= 10)) GROUP BY ALL
), kept AS (
  SELECT lowest.* FROM lowest LEFT JOIN covering USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 50 * a
)
SELECT t.lang, row_number() OVER (PARTITION BY t.lang ORDER BY score DESC, a DESC, encode(t.phrase)) AS rank, t.phrase, a, l, r, n, score
FROM kept t JOIN (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM counts WHERE size = 1 GROUP BY lang) USING (lang)
QUALIFY rank <= 2000
"""
