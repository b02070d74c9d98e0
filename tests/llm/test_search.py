"""Collocations, embedding groups and ranked search against plain versions."""

import math
import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from webharvest.llm import lexical_search as lexical
from webharvest.llm import vector_groups as vectors
from webharvest.llm.collocations import collocations
from webharvest.llm.lexical_search import ranked_search
from webharvest.llm.vector_groups import vector_groups

EDGES = [
    (1, None, "en"), (2, "", None), (3, " \t\n.;", "en"), (4, "One", ""), (5, "a b\vc d", None), (5, "a b\vc d", None), (6, "x" * 5000, "en"),
    (7, "é 😀 é 😀, É b 😀 é", "fr"), (8, "a a a a a a. a a b b a a", "en"), (8, "a a a a a a. a a b b a a", "en")
]


def plain_collocations(rows, least, top):
    counts, words = Counter(), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        lowered = "".join(c.lower() if c.isascii() else c for c in text or "")
        for piece in re.split("[.,;:!?\n\v\f\r]", lowered):
            w = [x for x in re.split("[ \t]+", piece) if x]
            words[lang] += len(w)
            for size in (1, 2, 3):
                counts.update((lang, *w[k : k + size]) for k in range(len(w) - size + 1))
    found = {g: a for g, a in counts.items() if len(g) > 2 and a >= least}
    out = []
    for (lang, *w), a in found.items():
        if any(lang == o[0] and len(o) > len(w) + 1 and tuple(w) in (o[1:3], o[2:4]) and 100 * b >= 50 * a for o, b in found.items()):
            continue
        cuts = []
        for k in range(1, len(w)):
            left, right = counts[(lang, *w[:k])], counts[(lang, *w[k:])]
            cuts.append((10**6 * a * a // (left * right), k, left, right))
        score, _, left, right = min(cuts)
        out.append((lang, -score, -a, " ".join(w).encode(), left, right))
    out.sort()
    ranks, result = Counter(), set()
    for lang, score, a, phrase, left, right in out:
        ranks[lang] += 1
        if ranks[lang] <= top:
            result.add((lang, ranks[lang], phrase.decode(), -a, left, right, words[lang], -score))
    return result


def test_collocations_brute_force(spark):
    r = random.Random(3)
    stock = ["w%d" % k for k in range(30)] + ["Ünd", "the", "THE"]
    rows = EDGES + [
        (
            k, "".join(
                r.choice(stock[: r.choice([4, 33])]) + r.choice([" ", " ", "  ", "\t", ". ", "! "]) for _ in range(r.randrange(80))
            ), r.choice(["en", "de", None])
        ) for k in range(20, 200)
    ] + [(300, "hot pair tail " * 300 + " ".join(f"hot pair end{k}" for k in range(900)), "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("phrase", F.lit(1)).repartition(7)
    for least, top in ((2, 2000), (10, 40), (4, 3)):
        got = {tuple(x) for x in collocations(docs, least=least, top=top).collect()}
        assert got == plain_collocations(rows, least, top)
    assert collocations(docs.limit(0)).count() == 0


def plain_groups(rows, threshold=0.93):
    """n_links and component of each id, and the links, by comparing all pairs."""
    units = {}
    for i, v, label in rows:
        if label is not None and v and all(c is not None and math.isfinite(c) for c in v) and any(v):
            x = np.array(v, np.float32).astype(np.float64)
            units[i] = (label, x / np.linalg.norm(x))
    links = {i: set() for i, _, _ in rows}
    for i, (la, a) in units.items():
        for j, (lb, b) in units.items():
            if i < j and la == lb and len(a) == len(b) and a @ b >= threshold:
                links[i].add(j)
                links[j].add(i)
    least = {}
    for i in sorted(links):
        todo = [] if i in least else [i]
        while todo:
            k = todo.pop()
            if k not in least:
                least[k] = i
                todo += links[k]
    return links, least


def near(r, v, cosine):
    """A vector at the given cosine of v."""
    u, w = np.array(v) / np.linalg.norm(v), np.array([r.gauss(0, 1) for _ in v])
    w -= (w @ u) * u
    return [float(x) for x in cosine * u + math.sqrt(1 - cosine**2) * w / np.linalg.norm(w)]


VECTORS = "vec_id long, embedding array<float>, label int"


def test_vector_groups_brute_force(spark):
    """Odd vectors, ties, copies, chains and a hot group in one list; equal to all pairs compared."""
    r = random.Random(5)
    some = [[r.gauss(0, 1) for _ in range(10)] for _ in range(60)]
    rows = [(k, v, k % 3) for k, v in enumerate(some)]
    rows += [(100 + k, near(r, some[k % 20], 0.9 + 0.001 * k), k % 20 % 3) for k in range(100)]
    rows += [(300 + k, some[7], 1) for k in range(90)] + [(400 + k, near(r, some[8], 0.985), 2) for k in range(70)]
    nan, inf = float("nan"), float("inf")
    rows += [
        (500 + k, v, label) for k, (v, label) in enumerate(
            [
                (None, 1), ([], 1), ([0.0] * 10, 1), ([nan] * 10, 1), ([inf] + some[0][1:], 1), ([None] + some[0][1:], 1), (some[7], None),
                (some[7], 9), (some[7][:9], 1), ([x * 1e-30 for x in some[7]], 1), ([x * 1e30 for x in some[7]], 1), ([-x for x in some[7]], 1)
            ]
        )
    ]
    df = spark.createDataFrame(rows + rows[:5] + [(None, some[7], 1)], VECTORS).withColumn("id", F.lit("x")).repartition(5)
    links, least = plain_groups(rows)
    for options in ({}, {"block": 16}):
        got = {x.vec_id: (x.n_links, x.component_id, x.kept) for x in vector_groups(df, **options).collect()}
        assert got == {i: (len(links[i]), least[i], least[i] == i) for i in links}
    assert vector_groups(df.limit(0)).count() == 0


def test_vector_groups_recall(spark):
    """Many lists and probes: nothing below the threshold is linked, and of the pairs at it and a little over nearly all are met."""
    r = random.Random(6)
    some = [[r.gauss(0, 1) for _ in range(32)] for _ in range(1200)]
    rows = [(k, v, 0) for k, v in enumerate(some)] + [(2000 + k, near(r, some[k], r.uniform(0.931, 0.95)), 0) for k in range(1200)]
    links, _ = plain_groups(rows)
    got = {x.vec_id: x.n_links for x in vector_groups(spark.createDataFrame(rows, VECTORS), leaf=64, block=50).collect()}
    assert all(got[i] <= len(links[i]) for i in links) and sum(map(len, links.values())) >= 2400
    assert sum(got.values()) >= 0.97 * sum(map(len, links.values()))


def test_quantiser_of_two_levels(monkeypatch):
    """Lists of two levels hold every vector, and look-up distances are those of the coded vectors, off by the error kept at most."""
    monkeypatch.setattr(vectors, "WIDTH", 4)
    x = vectors._units(np.random.default_rng(1).normal(size=(500, 10)))
    q = vectors.Quantiser(x, 16, 0.93, 0.99)
    own = q.own(x)
    assert len(np.unique(own)) > 8 and own.max() < 16 and (q.probes(x, 16)[:, 0] == own).mean() > 0.5
    codes, error = q.encode(x, own)
    for which in np.unique(own):
        at = own == which
        far = q.table_distances(x[:50], int(which), codes[at])
        true = np.sqrt(((x[:50, None] - x[None, at]) ** 2).sum(-1))
        assert (np.abs(np.sqrt(np.maximum(far, 0)) - true) <= error[at][None, :] + 1e-3).all()


def plain_search(rows, items, top):
    def terms(text):
        return re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", "".join(c.lower() if c.isascii() else c for c in text or ""))

    docs = [(i, Counter(w)) for i, w in ((i, terms(t)) for i, t in rows) if w]
    size, words = len(docs), sum(sum(c.values()) for _, c in docs)
    df = Counter(t for _, c in docs for t in c)
    out = set()
    for item, text in items:
        found = []
        for i, c in docs:
            m, score = 75 + 25 * sum(c.values()) * size // words, 0
            for t in terms(text):
                if c[t]:
                    score += math.floor(1000 * math.log((2 * size + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 12 * m))
            if score > 0:
                found.append((-score, i is None, i or 0, i))
        out |= {(item, k + 1, x[3], -x[0]) for k, x in enumerate(sorted(found)[:top])}
    return out


def test_ranked_search_brute_force(spark, monkeypatch):
    """Odd texts, ties, repeated and missing ids, in one range and in many; equal to scoring every document."""
    r = random.Random(9)
    stock = [f"w{k}" for k in range(60)] + ["Über", "über", "x_y", "THE"]
    rows = [(k, " ".join(r.choice(stock[: r.choice([5, 20, 64])]) for _ in range(r.randrange(1, 60)))) for k in range(600)]
    rows += [(1000 + k, "w1 w2 w3 tied") for k in range(80)] + [(1000, "w1 w2 w3 tied"), (None, "w1 w2 w3 tied"), (2000, "tied w9 " * 20000)]
    rows += [(3000, None), (3001, ""), (3002, " _!"), (3003, "é😀 é"), (7, rows[7][1])]
    items = [(k, " ".join(r.choice(stock) for _ in range(r.randrange(1, 12)))) for k in range(30)]
    items += [(50, "tied"), (51, "tied w1 W1"), (52, None), (53, ""), (54, "absent"), (55, "é😀 w3"), (56, " ".join(t for _, t in rows[:20]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit(1)).repartition(3)
    asked = spark.createDataFrame(items + [(None, "w1"), (50, "tied w5")], "item_id long, text string").withColumn("rank", F.lit("x"))
    for size in (4096, 37):
        monkeypatch.setattr(lexical, "RANGE_DOCS", size)
        got = {(x.item_id, x["rank"], x.doc_id, x.score) for x in ranked_search(docs, asked).collect()}
        assert got == plain_search(rows, items, 20)
    assert ranked_search(docs, asked.limit(0)).count() == 0 and ranked_search(docs.limit(0), asked).count() == 0


def test_k2_treap_holds_every_entry():
    random_ = np.random.default_rng(2)
    entry = np.unique(random_.integers(0, 90 * 300, 900))
    rows, columns, impacts = entry // 300, entry % 300, random_.integers(1, 10**6, len(entry))
    tree = lexical.K2Treap.build(rows, columns, impacts)
    assert tree.height == 9 and tree.maxima[0] == impacts.max() and len(tree.maxima) == 1 + lexical._COUNT[tree.masks].sum()
    ids = np.arange(300) * 2
    for row in (0, 17, rows[5], 89):
        own = sorted((-int(i), int(c) * 2) for r, c, i in zip(rows, columns, impacts) if r == row)
        if own:
            at = np.array([row]), *tree.enter(np.array([row]), 300)
            assert tree.best(*at, np.array([1]), ids, [], 1000) == own
            assert tree.best(*at, np.array([3]), ids, [], 2) == [(3 * s, i) for s, i in own[:2]]
