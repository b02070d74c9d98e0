"""Quality classifier from weak labels.

Overlapping heuristic labellers vote on every text: on its form (symbols, shouting, tables, repeats and so on)
and on abusive words, whose lexicon is mined from labelled rows.  Expectation maximisation over the counted
vote patterns estimates how often each labeller is right, without any true label, and gives every pattern a
posterior.  The posteriors of a bounded sample train two hashed linear scorers, one of form over a whole text
and one of words over segments of it, and the scorers alone judge every text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._tables import cut
from ._words import Words, mix, steps

FORM = ("symbols", "shouting", "exclamations", "tables", "repeats", "runs", "letters", "length", "sentences", "odd")
ABUSE = ("words", "stems", "density")
#: Dimensions of the two hashed scorers; weight vectors are of this fixed size.
FORM_DIMS, WORD_BITS = 1 << 12, 21
WORD_DIMS = 1 << WORD_BITS
SEGMENT = 64
SHARDS = 2
_U = np.uint64

_CLASS = np.zeros((7, 256), np.int32)
_CLASS[0, [ord(c) for c in "#$%&*^~=<>{}[]\\@_`"]] = 1  # symbols
_CLASS[1, [ord("!")]] = 1
_CLASS[2, [ord("|")]] = 1
_CLASS[3, [*range(65, 91)]] = 1  # upper case
_CLASS[4, [*range(97, 123)]] = 1  # lower case
_CLASS[5, [ord(c) for c in ".?!,;:"]] = 1
_CLASS[6] = np.maximum.reduce(_CLASS[:3])  # any odd character


def _forms(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per token of the texts: row and hashed form feature; per text: votes of the form labellers and number of tokens."""
    w = Words(texts, spaced=True)
    raw, n = w.raw, len(w.start)
    two = np.zeros(len(raw), bool)
    two[:-1] = raw[:-1] == 0xC3  # two-byte Latin letters: C3 80-9E are capitals, C3 9F-BF small
    counts = np.zeros((7, n), np.int32)
    for k in range(7):
        marks = _CLASS[k][raw]
        if k in (3, 4) and two.any():
            after = np.append(raw[1:], 0)
            marks = marks + (two & ((after < 0x9F) if k == 3 else (after >= 0x9F)))
        sums = np.concatenate([[0], np.cumsum(marks)])
        counts[k] = sums[w.end] - sums[w.start]
    sym, exc, pipe, up, low, _, odd = counts
    length = w.end - w.start
    ends = _CLASS[5][raw[w.end - 1]] > 0 if n else np.zeros(0, bool)
    same = np.zeros(n, bool)
    same[1:] = (w.hash[1:] == w.hash[:-1]) & (w.row[1:] == w.row[:-1])
    run = np.zeros(n, bool)
    run[4:] = same[4:] & same[3:-1] & same[2:-2] & same[1:-3]
    shout = (up >= 2) & (low == 0)
    letters = up + low > 0
    feature = np.minimum(sym, 3) | np.minimum(exc, 3) << 2 | np.minimum(pipe, 1) << 4 | shout.astype(np.int32) << 5 | same.astype(np.int32) << 6 | letters.astype(np.int32) << 7 | ends.astype(np.int32) << 8 | np.minimum(length // 8, 7) << 9
    index = (mix(feature.astype(_U) + _U(77)) >> _U(64 - 12)).astype(np.int64)
    total = np.maximum(w.counts, 1)

    def share(flag: np.ndarray) -> np.ndarray:
        return np.bincount(w.row, flag, w.rows) / total

    def vote(bad: np.ndarray, good: np.ndarray | None = None) -> np.ndarray:
        return np.where(bad, -1, np.where(good, 1, 0) if good is not None else 0)

    enough = w.counts >= 5
    s_sym, s_shout, s_exc, s_pipe, s_same, s_run, s_let, s_len, s_end, s_odd = (
        share(x) for x in (sym >= 2, shout, exc >= 2, pipe >= 1, same, run, letters, length, ends, odd >= 1)
    )
    votes = np.stack([
        vote(s_sym > 0.1, s_sym == 0), vote(
            enough & (s_shout > 0.3), s_shout < 0.1
        ), vote(s_exc > 0.1), vote(s_pipe > 0.1), vote(enough & (s_same > 0.2), s_same < 0.05),
        vote(s_run > 0.05), vote(
            (s_let < 0.5) & (w.row.size > 0) | (w.counts == 0), s_let > 0.8
        ), vote(s_len > 40, s_len < 20), vote(np.zeros(w.rows, bool), enough & (s_end > 0.01) & (s_end < 0.6)), vote(s_odd > 0.3, s_odd < 0.01),
    ]).T.astype(np.int8)
    return w.row, index, votes, w.counts


def _word_features(w: Words) -> np.ndarray:
    """Three hashes per word: the word, and its first four and five bytes where it is longer."""
    out = np.zeros((3, len(w.start)), _U)
    out[0] = w.hash
    for k, size in ((1, 4), (2, 5)):
        longer = w.end - w.start > size
        out[k, longer] = mix(w.span(w.start[longer], w.start[longer] + size) + _U(k))
    return out


def _lookup(keys: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(keys.shape, bool)
    at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
    return known[at] == keys


def _abuse(w: Words, feats: np.ndarray, lexicon: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Per word: whether the lexicon has it; per text: votes of the abuse labellers."""
    word = _lookup(feats[0], lexicon[0])
    stem = _lookup(feats[1], lexicon[1]) | _lookup(feats[2], lexicon[1])
    a, b = (np.bincount(w.row, x, w.rows) for x in (word, stem))
    both = np.bincount(w.row, word | stem, w.rows)
    share = both / np.maximum(w.counts, 1)
    votes = np.stack(
        [
            np.where(a >= 2, -1, np.where(a == 0, 1, 0)), np.where(b >= 2, -1, np.where(b == 0, 1, 0)),
            np.where(share > 0.004, np.where(both >= 2, -1, 0), 1)
        ]
    ).T
    return word | stem, votes.astype(np.int8)


def mine_lexicon(
    docs: DataFrame, labels: DataFrame, *, labelled_rows: int = 8000, support: int = 3, purity: float = 0.95
) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of words and of word stems that tell toxic labelled texts from others.

    From a sample of at most `labelled_rows` labelled rows, near copies counted once; so the entries are as bounded.
    """
    known = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(labelled_rows)
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")
    ).join(F.broadcast(chosen), "doc_id").select("doc_id", (F.col("toxic") > 0).alias("toxic"), "text")

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in steps(batch.column(2)):
                part = batch.slice(lo, hi - lo)
                g, row, _ = Words(part.column(2)).shingles(5)
                least = np.full(hi - lo, np.iinfo(np.uint64).max, _U)
                np.minimum.at(least, row, g)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(least.view(np.int64))], names=["doc_id", "toxic", "text", "family"]
                )

    sample = cut(rows.mapInArrow(sketch, "doc_id long, toxic boolean, text string, family long"))
    heads = sample.groupBy("family", "toxic").agg(F.min("doc_id").alias("doc_id"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in steps(batch.column(1)):
                part = batch.slice(lo, hi - lo)
                toxic = part.column(0).to_numpy(zero_copy_only=False)
                w = Words(part.column(1))
                for k, feats in enumerate(_word_features(w)):
                    kind = min(k, 1)
                    pairs = np.unique(np.stack([feats, w.row.astype(_U)]), axis=1) if len(feats) else np.zeros((2, 0), _U)
                    pairs = pairs[:, pairs[0] != 0]
                    keys, at = np.unique(pairs[0], return_inverse=True)
                    bad = np.bincount(at, toxic[pairs[1].astype(np.int64)], len(keys)).astype(np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.full(len(keys), kind, np.int32)), pa.array(keys.view(np.int64)), pa.array(bad),
                            pa.array(np.bincount(at, minlength=len(keys)).astype(np.int64))
                        ],
                        names=["kind", "feature", "bad", "texts"]
                    )

    counted = sample.join(F.broadcast(heads), ["family", "toxic", "doc_id"]).select("toxic", "text").mapInArrow(
        count, "kind int, feature long, bad long, texts long"
    )
    strong = counted.groupBy("kind", "feature").agg(
        F.sum("bad").alias("bad"), F.sum("texts").alias("texts")
    ).where((F.col("bad") >= support) & (F.col("bad") >= purity * F.col("texts")))
    out = []
    for kind in (0, 1):
        found = strong.where(F.col("kind") == kind).select("feature").toPandas()["feature"]
        out.append(np.sort(found.to_numpy(np.int64).view(_U)))
    return out[0], out[1]


def votes(docs: DataFrame, lexicon: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(doc_id, form, abuse): each text's votes as base-3 numbers; 0 stands for bad, 1 for no vote, 2 for good."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in steps(batch.column(1)):
                part = batch.slice(lo, hi - lo)
                _, _, form, _ = _forms(part.column(1))
                w = Words(part.column(1))
                _, abuse = _abuse(w, _word_features(w), lexicon)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *(pa.array(((v + 1).astype(np.int64) * 3 ** np.arange(v.shape[1])).sum(1)) for v in (form, abuse))],
                    names=["doc_id", "form", "abuse"]
                )

    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")
    ).mapInArrow(make, "doc_id long, form long, abuse long")


def _logistic(odds: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(odds, -30, 30)))


def vote_odds(vote: np.ndarray, prior: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Log odds of "bad" for rows of votes 0, 1, 2, under the label model (prior of the classes, table [class, labeller, vote])."""
    each = np.arange(vote.shape[1])
    like = [np.log(prior[c]) + np.log(table[c][each, vote]).sum(1) for c in (0, 1)]
    return np.clip(like[0] - like[1], -30, 30)


def label_model(patterns: np.ndarray, counts: np.ndarray, labellers: int, rounds: int = 100) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Expectation maximisation over vote patterns: (posterior of "bad" per pattern, prior of the classes, table [class, labeller, vote]).

    patterns: base-3 numbers; the classes are 0 bad and 1 good.
    """
    vote = patterns[:, None] // 3 ** np.arange(labellers) % 3
    bad = np.where((vote == 0).any(1), 0.9, 0.05)
    table = np.full((2, labellers, 3), 1 / 3)
    prior = np.array([0.5, 0.5])
    for _ in range(rounds):
        weight = np.stack([bad, 1 - bad]) * counts
        for v in range(3):
            table[:, :, v] = (weight @ (vote == v) + 0.5) / (weight.sum(1)[:, None] + 1.5)
        prior = (weight.sum(1) + 1) / (weight.sum() + 2)
        new = _logistic(vote_odds(vote, prior, table))
        settled = np.abs(new - bad).max(initial=0) < 1e-6
        bad = new
        if settled:
            break
    return bad, prior, table


def _fit(
    features: np.ndarray, counts: np.ndarray, target: np.ndarray, dims: int, mean: bool, epochs: int, rate: float, width: int = 64
) -> np.ndarray:
    """Logistic regression by Adagrad over small batches; features: indices of all examples, one after the other, `counts` of them
    each; the last weight is the bias."""
    first = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])
    weights, seen = np.zeros(dims + 1), np.full(dims + 1, 1e-2)
    share = np.clip(target.mean(), 1e-3, 1 - 1e-3) if len(target) else 0.5
    importance = 1 + target * (min(10.0, 0.5 / share) - 1)
    epochs = int(np.clip(200_000 // max(len(counts), 1), epochs, 8 * epochs))
    order = np.random.default_rng(7).permutation(len(counts))
    for _ in range(epochs):
        for lo in range(0, len(order), width):
            part = order[lo : lo + width]
            sizes = first[part + 1] - first[part]
            index = np.concatenate([features[first[k] : first[k + 1]] for k in part])
            of = np.repeat(np.arange(len(part)), sizes)
            scale = 1 / np.maximum(sizes, 1) if mean else np.ones(len(part))
            score = np.bincount(of, weights[index], len(part)) * scale + weights[-1]
            error = (_logistic(score) - target[part]) * importance[part]
            at, which = np.unique(np.append(index, dims), return_inverse=True)
            g = np.bincount(which, np.append((error * scale)[of], error.sum())) / len(part) + 1e-6 * weights[at]
            seen[at] += g * g
            weights[at] -= rate * g / np.sqrt(seen[at])
    return weights


def train(docs: DataFrame, posteriors: DataFrame, lexicon: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Weights of the form scorer and of the word scorer, the mean of SHARDS fits; posteriors: (doc_id, p_low, p_toxic), a bounded sample."""

    def fit(pdf):
        import pandas as pd

        pdf = pdf.sort_values("doc_id")
        forms, words, form_counts, word_counts, word_target = [], [], [], [], []
        for lo, hi in steps(pa.array(pdf["text"], pa.string())):
            texts = pa.array(pdf["text"].iloc[lo:hi], pa.string())
            row, index, _, _ = _forms(texts)
            forms.append(index.astype(np.int16))
            form_counts.append(np.bincount(row, minlength=hi - lo))
            w = Words(texts)
            feats = _word_features(w)
            hit, _ = _abuse(w, feats, lexicon)
            segment = (np.arange(len(w.row)) - w.first[:-1][w.row]) // SEGMENT
            begin = np.flatnonzero(
                np.append(True, (w.row[1:] != w.row[:-1]) | (segment[1:] != segment[:-1]))
            ) if len(w.row) else np.zeros(0, int)
            p = pdf["p_toxic"].to_numpy()[lo:hi]
            some = []
            for a, b in zip(begin, np.append(begin[1:], len(w.row))):
                f = feats[:, a:b].ravel()
                some.append((np.unique(f[f != 0]) >> _U(64 - WORD_BITS)).astype(np.int32))
                word_target.append(p[w.row[a]] if hit[a:b].any() else 0.0)
            word_counts += [len(x) for x in some]
            words.append(np.concatenate([np.zeros(0, np.int32), *some]))
        form = _fit(
            np.concatenate([np.zeros(0, np.int16), *forms]), np.concatenate([np.zeros(0, np.int64), *form_counts]), pdf["p_low"].to_numpy(),
            FORM_DIMS, True, 4, 0.5
        )
        forms.clear()
        word = _fit(np.concatenate([np.zeros(0, np.int32), *words]), np.array(word_counts, np.int64), np.array(word_target), WORD_DIMS, False, 3, 0.3)
        return pd.DataFrame(
            {
                "form": [form.astype(np.float32).tobytes()], "at": [np.flatnonzero(word).astype(np.int32).tobytes()],
                "word": [word[word != 0].astype(np.float32).tobytes()], "rows": [len(pdf)]
            }
        )

    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")
    ).where("text is not null").join(F.broadcast(posteriors), "doc_id")
    fits = rows.withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.lit(SHARDS))).groupBy("shard").applyInPandas(
        fit, "form binary, at binary, word binary, rows long"
    ).toPandas()
    form, word = np.zeros(FORM_DIMS + 1, np.float32), np.zeros(WORD_DIMS + 1, np.float32)
    for row in fits.sort_values("rows").itertuples():
        share = row.rows / fits["rows"].sum()
        form += np.frombuffer(row.form, np.float32) * share
        word[np.frombuffer(row.at, np.int32)] += np.frombuffer(row.word, np.float32) * share
    return form, word


class Classifier:
    """A trained classifier; `score` and `keep` apply it to any documents."""

    def __init__(
        self, form: np.ndarray, word: np.ndarray, lexicon: tuple[np.ndarray, np.ndarray], models: dict[str, tuple[np.ndarray, np.ndarray]]
    ):
        self.form, self.word, self.lexicon, self.models = form, word, lexicon, models
        self.toxic = bool(len(lexicon[0]) or len(lexicon[1]))

    def accuracies(self) -> dict[str, tuple[float, float]]:
        """Labeller -> estimated share of (bad, good) texts that it condemns."""
        return {
            f"{kind}.{name}": (float(t[0, k, 0]), float(t[1, k, 0])) for kind, names in (("form", FORM), ("abuse", ABUSE)) for k,
            name in enumerate(names) for t in (self.models[kind][1],)
        }

    def judge(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(p_low, p_toxic) of each text; a text without words is of low quality and not toxic."""
        row, index, _, tokens = _forms(texts)
        score = np.bincount(row, self.form[index], len(texts)) / np.maximum(tokens, 1) + self.form[-1]
        score *= tokens / (tokens + 20)  # a few tokens are little evidence
        low = np.where(tokens > 0, _logistic(score), 1.0)
        if not self.toxic:
            return low, np.zeros(len(texts))
        w = Words(texts)
        value = np.zeros(len(w.row), np.float32)
        for f in _word_features(w):
            value += np.where(f != 0, self.word[(f >> _U(64 - WORD_BITS)).astype(np.int64)], 0)
        best = np.full(len(texts), -30.0)
        if len(w.row):
            segment = (np.arange(len(w.row)) - w.first[:-1][w.row]) // SEGMENT
            begin = np.flatnonzero(np.append(True, (w.row[1:] != w.row[:-1]) | (segment[1:] != segment[:-1])))
            np.maximum.at(best, w.row[begin], np.add.reduceat(value, begin) + self.word[-1])
        return low, _logistic(best)

    def score(self, docs: DataFrame, threshold: float = 0.5) -> DataFrame:
        """(doc_id, p_low, p_toxic, keep) of every row of `docs`."""
        judge = self.judge

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for lo, hi in steps(batch.column(1)):
                    part = batch.slice(lo, hi - lo)
                    low, toxic = judge(part.column(1))
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0), pa.array(low), pa.array(toxic), pa.array((low <= threshold) & (toxic <= threshold))],
                        names=["doc_id", "p_low", "p_toxic", "keep"]
                    )

        return docs.select(
            F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")
        ).mapInArrow(run, "doc_id long, p_low double, p_toxic double, keep boolean")

    def keep(self, docs: DataFrame, threshold: float = 0.5) -> DataFrame:
        """The rows of `docs` that are neither of low quality nor toxic, with all their columns."""
        judge, at = self.judge, docs.columns.index("text")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for lo, hi in steps(batch.column(at)):
                    part = batch.slice(lo, hi - lo)
                    low, toxic = judge(part.column(at))
                    yield part.filter(pa.array((low <= threshold) & (toxic <= threshold)))

        return docs.mapInArrow(run, docs.schema)


def fit_classifier(docs: DataFrame, labels: DataFrame, *, train_rows: int = 8000, labelled_rows: int = 8000) -> Classifier:
    """Train on `docs` (doc_id, text) with the toxic labels of `labels` (doc_id, toxic).

    The vote patterns of all rows set the label model; at most `train_rows` rows train the scorers and at most
    `labelled_rows` labelled rows the lexicon, both in the order of a hash of doc_id.  Nulls count as empty
    texts, which every labeller of form rejects; without toxic labels nothing is judged toxic; rows without an
    id, or with an id that occurs again, vote like others.
    """
    lexicon = mine_lexicon(docs, labels, labelled_rows=labelled_rows)
    cast = cut(votes(docs, lexicon))
    models, posterior = {}, {}
    for kind, names in (("form", FORM), ("abuse", ABUSE)):
        seen = cast.groupBy(kind).count().toPandas().sort_values(kind)  # at most 3^10 vote patterns
        bad, *models[kind] = label_model(seen[kind].to_numpy(), seen["count"].to_numpy(), len(names))
        posterior[kind] = cast.sparkSession.createDataFrame([(int(a), float(b)) for a, b in zip(seen[kind], bad)], f"{kind} long, p double")
    sample = cast.where("doc_id is not null").orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows).dropDuplicates(["doc_id"])
    sample = sample.join(F.broadcast(posterior["form"].withColumnRenamed("p", "p_low")), "form").join(
        F.broadcast(posterior["abuse"].withColumnRenamed("p", "p_toxic")), "abuse"
    ).select("doc_id", "p_low", "p_toxic")
    form, word = train(docs, cut(sample), lexicon)
    return Classifier(form, word, lexicon, models)
