"""Corpus operators: edge rows, brute force, round trips, held-out accuracy."""

import hashlib
import random
import re
from collections import Counter as Count
from pathlib import Path

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from webharvest.llm import pii
from webharvest.llm.chat_format import format_chats, loss_spans, read_back
from webharvest.llm.decontaminate import align, contaminated, decontaminate
from webharvest.llm.fingerprints import PER_OCTAVE, edited_with_next, fingerprints, likeness, near_classes
from webharvest.llm.jaccard_join import estimate_recall, jaccard_join, run_recall, runs_for
from webharvest.llm.licenses import TEXTS, scan_licenses
from webharvest.llm.mixing import mix_sources
from webharvest.llm.quality import fit_classifier, label_model
from webharvest.llm.token_counts import RANKS, Counter, TokenTree, token_counts
from webharvest.llm.url_filters import domain_of, host_reputation, judge_urls, noisy_page, suffix_of

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, seed string, size long"
WORDS = [a + b for a in "ba ce di fo gu ha je ki lo mu".split() for b in "n r s t l m d k".split()]


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + r.choice(WORDS) for _ in range(n))


def documents(spark, texts):
    return spark.createDataFrame([(i, t, "en", f"s{(i or 0) % 3}" if (i or 0) % 5 else None, None, "x", 7) for i, t in texts], SCHEMA)


EDGES = [
    (1, None), (2, ""), (3, " \n\t"), (4, "one"), (5, "one two three"), (5, "one two three"), (6, "x" * 5000), (7, "é" * 300 + " 😀 ok")
]


def test_jaccard_join_brute_force(spark):
    base = [(k, prose(120, k)) for k in range(20, 40)]
    copies = []
    for k in range(40, 90):
        words = base[k % 20][1].split()
        for _ in range(k % 4):
            words[random.Random(k).randrange(len(words))] = "changed"
        copies.append((k, " ".join(words)))
    rows = EDGES + base + copies
    got = {r.doc_id: r for r in jaccard_join(documents(spark, rows), leaf=4, block=4).collect()}
    assert len(got) == len({i for i, _ in rows})
    sets = {}
    for i, t in rows:
        w = re.findall(r"[a-z0-9_\u0080-\U0010ffff]+", (t or "").lower())
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    for a in sets:
        links = sum(1 for b in sets if b != a and (sets[a] == sets[b] or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])))
        assert got[a].n_links == links, a
    assert got[1].class_id == got[2].class_id == got[3].class_id == 1
    assert runs_for(0.8, 4, 2, 0.99) == 2 and run_recall(0.8, 4, 2) > 0.9
    assert runs_for(0.8, 4, 2, 0.99, estimate_recall(0.8, 128, 0.1)) == 2 and 0.99 < estimate_recall(0.8, 128, 0.1) < 1
    with pytest.raises(ValueError):
        runs_for(0.8, 4, 2, 0.999, estimate_recall(0.8, 128, 0.1))
    assert jaccard_join(documents(spark, [])).count() == 0


def test_jaccard_join_of_repeated_and_missing_ids(spark):
    text, other = prose(60, 1), prose(60, 2)
    rows = [(1, text), (2, other), (2, text), (3, other), (4, None), (4, text), (None, text), (5, "")]
    for _ in range(2):
        got = {r.doc_id: r.class_id for r in jaccard_join(documents(spark, rows)).collect()}
        twin = min(text, other)
        assert got == {1: 1, 2: 1 if twin == text else 2, 3: 3 if twin == text else 2, 4: 4, 5: 4}
        rows.reverse()


def test_jaccard_join_recall(spark):
    """Pairs of 0.8 to 0.9 among unlike texts, long texts among them: at least 0.99 of those at or over the threshold are linked, no other is."""
    r, rows, sets = random.Random(4), [], {}
    for k in range(400):
        words = prose(r.randrange(60, 400) if k else 9000, 5000 + k).split()
        copy = list(words)
        for _ in range(max(1, int(len(words) * r.uniform(0.008, 0.025)))):
            copy[r.randrange(len(words))] = prose(1, r.random())
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(copy))]
    for i, t in rows:
        w = t.split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
    like = {k: len(sets[2 * k] & sets[2 * k + 1]) / len(sets[2 * k] | sets[2 * k + 1]) for k in range(400)}
    got = {x.doc_id: x.class_id for x in jaccard_join(documents(spark, rows), block_shingles=5000).collect()}
    linked = {k for k in like if got[2 * k] == got[2 * k + 1]}
    over, near = {k for k in like if like[k] >= 0.8}, sum(0.8 <= x < 0.85 for x in like.values())
    assert linked <= over and len(over) > 150 and near > 50
    assert len(linked) >= 0.99 * len(over)




def test_decontamination(spark):
    item = prose(40, 5)
    edited = item.split()
    edited[10], edited[25] = "other", "words"
    rows = EDGES + [
        (20, prose(200, 6) + " " + item.upper() + "! " + prose(50, 7)), (21, prose(30, 8) + " " + " ".join(edited)), (22, prose(300, 9))
    ]
    items = spark.createDataFrame([(1, item), (2, None), (3, ""), (4, prose(20, 10))], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.score for r in contaminated(documents(spark, rows), items).collect()}
    assert set(got) == {(20, 1), (21, 1)} and got[20, 1] == 1.0 and 0.7 < got[21, 1] < 1
    assert {r.doc_id for r in decontaminate(documents(spark, rows), items).select("doc_id").collect()} == {i for i, _ in rows} - {20, 21}
    assert contaminated(documents(spark, rows), items.limit(0)).count() == 0


def test_decontamination_brute_force(spark):
    """Every text with a run of four words of an item, aligned with it whole: the same pairs and scores, with rare and with common seeds."""
    import numpy as np

    r = random.Random(11)
    stock = prose(60, 1).split()  # few words, so that runs of them are common
    items = [" ".join(r.choice(stock[:12] if k % 2 else stock) for _ in range(r.randrange(8, 30))) for k in range(25)]
    shared = " ".join(items[0].split()[: len(items[0].split()) // 2])
    texts = []
    for k in range(120):
        words = [r.choice(stock) for _ in range(r.randrange(0, 120))]
        if k % 3:
            copy = r.choice(items).split()
            for _ in range(r.randrange(0, len(copy) // 3 + 1)):
                copy[r.randrange(len(copy))] = r.choice(stock)
            if k % 5 == 0:
                del copy[r.randrange(len(copy))]
            words[len(words) // 2 : len(words) // 2] = copy
        texts.append(" ".join(words + (shared.split() if k % 4 == 0 else [])))
    texts += [texts[5]] * 40
    docs, known = documents(spark, list(enumerate(texts))), spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    code = {w: np.uint64(k) for k, w in enumerate(sorted({w for t in texts + items for w in t.split()}))}
    want = {}
    for i, item in enumerate(items):
        a = item.split()
        grams = {tuple(a[k : k + 4]) for k in range(len(a) - 3)}
        for d, text in enumerate(texts):
            b = text.split()
            if any(tuple(b[k : k + 4]) in grams for k in range(len(b) - 3)):
                got = align(np.array([code[w] for w in a]), np.array([code[w] for w in b]))[0] / (2 * len(a))
                if got >= 0.6:
                    want[d, i] = round(got, 9)
    assert len(want) > 60
    for options in ({}, {"rare_items": 0}):
        got = {(x.doc_id, x.item_id): round(x.score, 9) for x in contaminated(docs, known, **options).collect()}
        assert set(want) <= set(got) and all(got[k] == want[k] for k in want), options
    assert contaminated(documents(spark, []), known).count() == 0


def test_alignment_brute_force():
    import numpy as np

    r = random.Random(1)
    for _ in range(50):
        a, b = [np.array([r.randrange(4) for _ in range(r.randrange(1, 12))], np.uint64) for _ in range(2)]
        h = [[0.0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a)):
            for j in range(len(b)):
                h[i + 1][j + 1] = max(0, h[i][j] + (2 if a[i] == b[j] else -1), h[i][j + 1] - 1, h[i + 1][j] - 1)
        assert align(a, b)[0] == max(map(max, h))


def test_quality_held_out(spark):
    folder = Path("/root/testdata/sf0.01")
    if not folder.exists():
        pytest.skip("no tables")
    docs, labels = (spark.read.parquet(str(folder / f"{t}.parquet")) for t in ("documents", "labels"))
    held = labels.where("doc_id % 3 = 0")
    judged = fit_classifier(docs, labels.where("doc_id % 3 <> 0")).score(docs).join(held, "doc_id").toPandas()
    assert ((judged.p_low > 0.5) == (judged.quality == 0)).mean() > 0.98
    clean = judged[(judged.quality == 1) & (judged.toxic == 0)]
    assert clean.keep.mean() > 0.97


def test_quality_edges(spark):
    docs = documents(spark, EDGES + [(k, prose(60, k)) for k in range(20, 60)])
    model = fit_classifier(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert model.score(docs).count() == len(EDGES) + 40
    kept = model.keep(docs)
    assert kept.columns == docs.columns and kept.where("text is null or trim(text) = ''").count() == 0
    empty = documents(spark, [])
    nothing = fit_classifier(empty, spark.createDataFrame([], "doc_id long, toxic int"))
    assert nothing.score(empty).count() == 0 and nothing.keep(empty).count() == 0 and nothing.score(docs).count() == len(EDGES) + 40
    clash = docs.withColumnsRenamed({"seed": "p_low", "lang": "keep"})
    assert model.keep(clash).columns == clash.columns


def test_label_model_against_plain_em():
    """The same model, fitted row by row in plain Python, and the accuracies that made the votes."""
    import numpy as np

    r = random.Random(3)
    truth = [r.random() < 0.3 for _ in range(4000)]
    condemns = [(0.8, 0.02), (0.6, 0.05), (0.7, 0.01), (0.5, 0.03)]
    rows = [tuple(0 if r.random() < (hit if bad else false) else r.choice((1, 2)) for hit, false in condemns) for bad in truth]
    counted = Count(rows)
    patterns = sorted(counted, key=lambda v: sum(x * 3**k for k, x in enumerate(v)))
    bad, prior, table = label_model(
        np.array([sum(x * 3**k for k, x in enumerate(v)) for v in patterns]), np.array([counted[v] for v in patterns]), 4
    )
    p = [0.9 if 0 in row else 0.05 for row in rows]
    for _ in range(100):
        total = [sum(p), len(p) - sum(p)]
        like = [[[0.5] * 3 for _ in range(4)] for _ in range(2)]
        for q, row in zip(p, rows):
            for k, v in enumerate(row):
                like[0][k][v] += q
                like[1][k][v] += 1 - q
        like = [[[x / (total[c] + 1.5) for x in like[c][k]] for k in range(4)] for c in range(2)]
        share = [(t + 1) / (len(rows) + 2) for t in total]
        p = []
        for row in rows:
            a, b = share
            for k, v in enumerate(row):
                a, b = a * like[0][k][v], b * like[1][k][v]
            p.append(a / (a + b))
    want = dict(zip(rows, p))
    assert max(abs(bad[k] - want[v]) for k, v in enumerate(patterns)) < 1e-3
    assert abs(prior[0] - 0.3) < 0.05 and all(
        abs(table[0, k, 0] - hit) < 0.1 and abs(table[1, k, 0] - false) < 0.05 for k, (hit, false) in enumerate(condemns)
    )


def test_fingerprints(spark):
    t = prose(400, 1)
    near = t[:800] + "x" + t[800:1500] + t[1503:]
    a, b, c, d, e = fingerprints(pa.array([t, near, prose(400, 2), "", None]))
    assert likeness(a, b) > 0.8 > 0.4 > likeness(a, c) and d == e == "" and likeness(d, e) == 1.0
    rows = EDGES + [(20, t), (21, near), (22, t)]
    texts = {i: (x or "") for i, x in rows}
    ids = sorted(texts)
    got = {r.doc_id: r for r in edited_with_next(documents(spark, rows), range_bytes=1500).collect()}
    assert sorted(got) == ids
    for k, i in enumerate(ids):
        n, after = len(texts[i]), texts[ids[(k + 1) % len(ids)]]
        assert got[i].n_chars == n and got[i].edited_sha256 == hashlib.sha256((texts[i][: n - n // 2] + after[: n // 2]).encode()).hexdigest()
    classes = {
        r.doc_id: r.class_id for r in near_classes(
            spark.createDataFrame([(i, r.fingerprint) for i, r in got.items()], "doc_id long, fingerprint string")
        ).collect()
    }
    assert classes[20] == classes[22] == classes[21] == 20
    assert edited_with_next(documents(spark, [])).count() == 0


def test_fingerprints_do_not_depend_on_the_batch():
    r = random.Random(4)
    texts = ["".join(r.choice("abcdefgh é") for _ in range(n)) for n in range(1, 12) for _ in range(100)] + ["o", "one", "aaa", "xyz"]
    assert [fingerprints(pa.array([t]))[0] for t in texts] == fingerprints(pa.array([*texts, "long " * 900]))[:-1]


def test_likeness_and_classes_of_few_texts_brute_force(spark):
    """Likeness written out plainly; classes are those of all pairs."""
    r, texts = random.Random(8), []
    for k in range(30):
        words = prose(r.randrange(20, 120), k).split()
        texts.append(" ".join(words))
        for _ in range(3):
            words[r.randrange(len(words))] = "changed"
            texts.append(" ".join(words))
    marks = fingerprints(pa.array(texts))
    weight = [1 if k < PER_OCTAVE else 2 ** (k // PER_OCTAVE - 1) for k in range(4000)]

    def alike(a, b):
        n, m = min(len(a), len(b)), max(len(a), len(b))
        share = sum(w for w, x, y in zip(weight, a, b) if x == y) / sum(weight[:m])
        return max(0.0, (share - 1 / 16) / (15 / 16))

    near = {(i, j) for i in range(len(texts)) for j in range(i) if alike(marks[i], marks[j]) >= 0.8}
    assert all((likeness(marks[i], marks[j]) >= 0.8) == ((i, j) in near) for i in range(len(texts)) for j in range(i)) and len(near) > 40
    want = list(range(len(texts)))
    for _ in texts:
        for i, j in near:
            want[i] = want[j] = min(want[i], want[j])
    rows = list(enumerate(marks)) + [(None, "abc"), (200, None), (201, "")]
    got = {x.doc_id: x.class_id for x in near_classes(spark.createDataFrame(rows, "doc_id long, fingerprint string")).collect()}
    assert got == dict(enumerate(want)) | {200: 200, 201: 200}


def test_walk_and_likeness_columns_brute_force(spark):
    """A walk over characters, one text at a time in plain Python, gives the same fingerprints; and so the same near_ columns."""
    full = (1 << 64) - 1

    def mixed(x):
        x ^= x >> 30
        x = x * 0xBF58476D1CE4E5B9 & full
        x ^= x >> 27
        x = x * 0x94D049BB133111EB & full
        return x ^ x >> 31

    def code(char):
        value = 0
        for byte in char.encode():
            value = value * 64 + byte
        return (value if len(char.encode()) == 1 else 128 + (mixed(value) >> 57)) or 1

    def sampled(step):
        if step < PER_OCTAVE:
            return True
        lo = PER_OCTAVE
        while lo * 2 <= step:
            lo *= 2
        cell = lo // PER_OCTAVE
        return step == lo + (step - lo) // cell * cell + mixed((step - lo) // cell + lo) % cell

    def walk(text):
        codes, at, step, out = [code(c) for c in text or ""], 0, 0, ""
        while at < len(codes):
            char = codes[at]
            if sampled(step):
                out += "0123456789abcdef"[mixed((char * 0x9E3779B97F4A7C15 + step) & full) >> 60]
            word = mixed((step * 4 + char // 64 + 0x5EED) & full)
            byte = word >> 8 * (char % 64 // 8) & 255
            at += byte >> (7 - char % 8) & 1
            step += 1
        return out

    texts = [prose(n, n) for n in (1, 3, 30, 200)] + ["é😀ñ 中文 " * 40, "", None, "x", "a\0b" * 20, prose(30, 30) + "!"]
    assert fingerprints(pa.array(texts)) == [walk(t) for t in texts]
    got = {r.doc_id: r for r in edited_with_next(documents(spark, list(enumerate(texts)))).collect()}
    for k, text in enumerate(texts):
        text, other = text or "", texts[(k + 1) % len(texts)] or ""
        cut = len(text) // 2
        edited = text[: len(text) - cut] + other[:cut] if cut else text
        assert got[k].fingerprint == walk(text) and got[k].edited_fingerprint == walk(edited), k
        assert abs(got[k].near_edited - likeness(walk(text), walk(edited))) < 1e-9 and abs(got[k].near_next - likeness(walk(text), walk(other))) < 1e-9
        assert got[k].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()


def test_near_copies_behind_a_shared_header(spark):
    header = prose(190, 1)[:1100]
    texts = [header + prose(100, 2)[:550]]
    for k in range(3, 9):
        tail = prose(100, k)[:550]
        texts += [header + tail, header + tail[:480] + "edited" + tail[486:], header + tail[:520] + "other" + tail[525:]]
    marks = fingerprints(pa.array(texts))
    assert all(likeness(marks[0], x) < 0.8 for x in marks[1:]) and likeness(marks[1], marks[2]) > 0.9
    for block in (1024, 4):
        got = {
            r.doc_id: r.class_id for r in near_classes(
                spark.createDataFrame(list(enumerate(marks)), "doc_id long, fingerprint string"), block=block
            ).collect()
        }
        assert got == {0: 0} | {k: k - (k - 1) % 3 for k in range(1, len(texts))}


def test_near_classes_recall(spark):
    """Every pair at or over the threshold is joined: edited copies, and copies on two sides of an octave border."""
    r, pairs = random.Random(9), []
    for k in range(400):
        words = prose(r.randrange(100, 400), 1000 + k).split()
        edited = list(words)
        for _ in range(max(1, int(len(words) * r.uniform(0.02, 0.06)))):
            edited[r.randrange(len(words))] = prose(1, r.random())
        pairs.append((" ".join(words), " ".join(edited)))
    for k in range(60):
        text = prose(200, 2000 + k)
        at = next(
            c for c,
            x in zip(
                range(900, 1200, 4), fingerprints(pa.array([text[:c] for c in range(900, 1200, 4)]))
            ) if len(x) > (12 - PER_OCTAVE.bit_length() + 1) * PER_OCTAVE
        )
        longer, shorter = text[: at + 10], text[: at - 10]
        spot = r.randrange(600, 800)
        pairs.append((longer, shorter[:spot] + "edited" + shorter[spot:]))
    a, b = (fingerprints(pa.array(side)) for side in zip(*pairs))
    border = sum((len(x) - 1) // PER_OCTAVE != (len(y) - 1) // PER_OCTAVE for x, y in zip(a, b))
    like = [k for k in range(len(pairs)) if likeness(a[k], b[k]) >= 0.8]
    assert border > 20 and len(like) > 200
    rows = [(2 * k, a[k]) for k in range(len(a))] + [(2 * k + 1, b[k]) for k in range(len(b))]
    got = {x.doc_id: x.class_id for x in near_classes(spark.createDataFrame(rows, "doc_id long, fingerprint string")).collect()}
    assert [k for k in like if got[2 * k] != got[2 * k + 1]] == []


def test_chat_round_trip(spark):
    odd = ["", None, "\\### Assistant: </turn> ok", "<turn role=\"user\" esc=\"0\">", "\\l\\b<\\", "a\nb", "</turn", "😀"]
    rows = [
        (k % 3, n, r, t) for n, t in enumerate(odd) for k, r in enumerate(["user", "assistant", None, 'x">\\q'])
    ] + [(9, 0, "user", "hi"), (9, 0, "user", "hi"), (None, None, "assistant", "z")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    formatted = format_chats(df)
    got = {r.conv_id: r for r in read_back(formatted).collect()}
    for conv in {r[0] for r in rows}:
        turns = sorted([(-1 if n is None else n, r or "", t or "") for c, n, r, t in rows if c == conv])
        assert got[conv].round_trip and got[conv].n_turns == len(turns)
        assert got[conv].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for _, r, t in turns).encode()).hexdigest()
        loss = "".join(t for _, r, t in turns if r == "assistant")
        assert got[conv].loss_chars == len(loss) and got[conv].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    assert {r.conv_id: r.escape_level for r in formatted.collect()}[9] == 0
    assert loss_spans(formatted).count() == sum(r[2] == "assistant" for r in rows)
    assert format_chats(df.limit(0)).count() == 0


def test_token_counts(spark):
    if not Path(RANKS).exists():
        pytest.skip("no vocabulary")
    counter, r = Counter(), random.Random(3)
    alphabet = "ab cd  \n\t'sédx1 9.,!  "
    for _ in range(300):
        tree = TokenTree("".join(r.choice(alphabet) for _ in range(r.choice([0, 1, 5, 40, 400, 900]))), counter)
        for _ in range(3):
            at = r.randrange(len(tree.text) + 1)
            tree.edit(at, at + r.choice([0, 1, 3, 30, 200]), "".join(r.choice(alphabet) for _ in range(r.choice([0, 1, 4, 30]))))
        assert tree.total == len(counter.encoding.encode_ordinary(tree.text)) and tree.chars[1] == len(tree.text)
    tree = TokenTree(prose(500, 1), counter)
    for start, stop, new in (
        (900, 910, prose(20_000, 2)), (60_000, 60_000, "in the middle"), (1000, 90_000, "short"), (0, 0, prose(3000, 3)), (5, 10**7, "")
    ):
        before, size = tree.encoded_chars, len(tree.text)
        tree.edit(start, stop, new)
        assert tree.total == len(counter.encoding.encode_ordinary(tree.text)) and tree.chars[1] == len(tree.text)
        assert tree.encoded_chars - before <= len(new) + 3000 and max(tree.chars[tree.leaves :]) < 2000
    docs = documents(spark, EDGES).withColumn(
        "edits", F.array(F.struct(F.lit(1).alias("start"), F.lit(2).alias("stop"), F.lit(None).cast("string").alias("text")))
    )
    got = token_counts(docs).collect()
    assert len(got) == len(EDGES) and all(x.n_tokens == x.edited_tokens for x in got)
    assert token_counts(docs.limit(0)).count() == 0


PATTERNS = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")
)


def plain_spans(text):
    def good(kind, v):
        d = re.sub("[^0-9]", "", v)
        if kind == "ip":
            return all(int(p) <= 255 for p in v.split("."))
        if kind == "card":
            return 12 <= len(d) <= 19 and sum(
                int(c) if i % 2 == 0 else (2 * int(c) - 9 if int(c) > 4 else 2 * int(c)) for i, c in enumerate(d[::-1])
            ) % 10 == 0
        return kind != "phone" or 9 <= len(d) <= 15

    return sorted((m.start(), n, m.end(), k) for n, (k, p) in enumerate(PATTERNS) for m in re.finditer(p, text or "") if good(k, m.group()))


def test_pii(spark):
    tricky = [
        "a@b.c_x@d.e", "1.2.3.4.5.6.7.8 256.1.1.1 001.002.003.004", "+1 (555) 555-1234 4111 1111 1111 1111 4111-1111-1111-1111-",
        "é@x.y +49.30/12", "1 2 3 4 5 6 7 8 9", "9" * 9000, "+" * 50, "a@b a@b.c."
    ]
    found = [f"please contact: user{k}@mail{k}.example.com now" for k in range(12)] + [
        "please contact: ZX99-1234-Q today", "the year 12345678 alone"
    ]
    rows = EDGES + [(20 + k, t) for k, t in enumerate(tricky + found)]
    got = {r.doc_id: r for r in pii.find_pii(documents(spark, rows)).collect()}
    for i, t in rows:
        want = ",".join(f"{k}:{a}:{b}" for a, _, b, k in plain_spans(t))
        assert got[i].base_sha256 == hashlib.sha256(want.encode()).hexdigest(), t
    hit = next(i for i, t in rows if t and "ZX99" in t)
    assert got[hit].spans == "id:16:27" and got[hit + 1].n_found == 0
    clean = {r.doc_id: r.text for r in pii.redact(documents(spark, rows)).collect()}
    assert clean[hit] == "please contact: [ID] today" and clean[1] is None and clean[28].startswith("please contact: [EMAIL]")


def test_pii_discovery_brute_force(spark):
    """The graph of contexts and values, scored in plain Python: the same patterns and the same spans beside the base ones."""
    r, texts = random.Random(2), []
    words = ["call", "mail", "id", "code", "my", "the", "is", "at", "no", "x" * 90]
    for k in range(300):
        parts = []
        for _ in range(r.randrange(1, 5)):
            parts += [r.choice(words) for _ in range(r.randrange(0, 4))]
            kind = r.randrange(5)
            parts.append(
                [
                    f"u{k}@host{r.randrange(9)}.test", f"+49 30 12345{r.randrange(100, 999)}", f"AB-{r.randrange(1000, 9999)}",
                    f"{r.randrange(10**6, 10**7)}.", "word"
                ][kind]
            )
        texts.append(r.choice([" ", "  ", "\n"]).join(parts))
    got = {x.doc_id: x.spans for x in pii.find_pii(documents(spark, list(enumerate(texts)))).collect()}

    def around(text, a, b):
        before, after = text[:a].split(), text[b:]
        left, second = (before[-1].lower() if before else ""), (before[-2].lower() if len(before) > 1 else "")
        right = (re.match(r"\s*(\S*)", after)[1]).lower()
        return ([f"{left} _"] + ([f"{second} {left} _"] if second else []) + ([f"{left} _ {right}"] if right else [])) if left else []

    edges, candidates = {}, []
    for k, text in enumerate(texts):
        base = plain_spans(text)
        for n, (kind, p) in enumerate(PATTERNS):
            for m in re.finditer(p, text):
                if (m.start(), n, m.end(), kind) in base:
                    for c in around(text, m.start(), m.end()):
                        edges[c, m.group().lower()] = 1.0
        for m in re.finditer(r"\S*[0-9]\S*", text):
            value = re.sub(r"[.,;:!?)\]}'\"]+$", "", m.group())
            a, b = m.start(), m.start() + len(value)
            if len(value) >= 6 and len(re.sub("[^0-9]", "", value)) >= 3 and not any(s < b and a < e for s, _, e, _ in base):
                mine = around(text, m.start(), m.end())
                candidates.append((k, a, b, mine))
                for c in mine:
                    edges.setdefault((c, value.lower()), 0.0)
    score = dict(edges)
    for _ in range(3):
        by_pattern = {}
        for (c, v), x in score.items():
            by_pattern.setdefault(c, []).append((x, edges[c, v]))
        conf = {c: (sum(x for x, _ in xs) / (len(xs) + 1), sum(s for _, s in xs)) for c, xs in by_pattern.items()}
        by_value = {}
        for (c, v), s in edges.items():
            if s == 0:
                by_value.setdefault(v, []).append(conf[c][0])
        score = {(c, v): max(s, sum(by_value[v]) / len(by_value[v]) if v in by_value else 0.0) for (c, v), s in edges.items()}
    found = {(k, a, b) for k, a, b, mine in candidates if any(conf[c][0] >= 0.6 and conf[c][1] >= 3 for c in mine)}
    assert len(found) > 10 and len(found) < len(candidates)
    for k, text in enumerate(texts):
        want = sorted([(a, n, b, kind) for a, n, b, kind in plain_spans(text)] + [(a, 4, b, "id") for d, a, b in found if d == k])
        assert got[k] == ",".join(f"{kind}:{a}:{b}" for a, _, b, kind in want), text


def test_pii_edges(spark):
    assert pii.find_pii(documents(spark, [])).count() == 0 and pii.redact(documents(spark, [])).count() == 0
    docs = spark.createDataFrame(
        [(1, "mail a@b.cc", 5, "x")] * 2 + [(None, None, 5, "y")], "doc_id long, text string, pii_key int, pii_spans string"
    )
    out = pii.redact(docs)
    assert out.columns == docs.columns
    assert [tuple(r) for r in out.orderBy("doc_id").collect()] == [
        (None, None, 5, "y"), (1, "mail [EMAIL]", 5, "x"), (1, "mail [EMAIL]", 5, "x")
    ]


def test_mixing(spark):
    rows = EDGES + [(20 + k, prose(10 + k % 40, k)) for k in range(200)]
    got = mix_sources(documents(spark, rows)).collect()
    assert len(got) == len(rows) and sorted(map(tuple, got)) == sorted(map(tuple, mix_sources(documents(spark, rows)).collect()))
    sources = {i: (f"s{i % 3}" if i % 5 else None) for i, _ in rows}
    size, taken, target = Count(), Count(), {}
    for r in got:
        s = sources[r.doc_id]
        size[s] += r["size"]
        taken[s] += r.taken
        target[s] = r.target
        assert r.taken <= 3 * r["size"] and r.taken == r.copies * r["size"]
    assert abs(sum(target.values()) - sum(size.values())) < 1e-6
    for s in size:
        assert abs(taken[s] - target[s]) <= 0.05 * target[s] and target[s] <= 3 * size[s] + 1e-6
    assert mix_sources(documents(spark, [])).count() == 0


def test_mixing_against_a_plain_solution(spark):
    """Targets by plain sharing, tilts by bisection, rounding with a carried error: the same words of every source."""
    import math

    r = random.Random(5)
    names = ["a", "b", "z", "\u00e9", None, "c", "d"]
    rows = [
        (
            k, prose(r.randrange(1, 60) if k % 7 else 150, k), "en", names[k if k < 14 and k % 7 == k else r.randrange(2) if k % 3 else 4],
            None, "x", 7
        ) for k in range(300)
    ]
    got = {x.doc_id: x for x in mix_sources(spark.createDataFrame(rows, SCHEMA)).collect()}
    sizes = {}
    for k, text, _, source, *_ in rows:
        sizes.setdefault(source, []).append(len(text.split()))
    order = sorted((s for s in sizes if s is not None)) + [None]
    weight, total, capped = {s: k % 3 + 1 for k, s in enumerate(order)}, sum(map(sum, sizes.values())), {}
    while True:
        level = (total - sum(capped.values())) / sum(w for s, w in weight.items() if s not in capped)
        over = {s: 3 * sum(sizes[s]) for s in order if s not in capped and level * weight[s] > 3 * sum(sizes[s])}
        if not over:
            break
        capped |= over
    target = {s: capped.get(s, level * weight[s]) for s in order}
    assert capped and len(capped) < len(order)
    for s in order:
        low, high = -50.0, 50.0
        for _ in range(200):
            t = (low + high) / 2
            low, high = (t, high) if sum(n * min(3, math.exp(min(50, t * n / 30))) for n in sizes[s]) < target[s] else (low, t)
        rate = {n: min(3, math.exp(min(50, low * n / 30))) for n in sizes[s]}
        left, copies = 0.0, {}
        for n in sorted(rate, reverse=True):
            count = sizes[s].count(n)
            left += count * rate[n] * n
            copies[n] = min(3 * count, max(0, math.floor(left / n + 0.5)))
            left -= copies[n] * n
        mine = [x for x in rows if x[3] == s]
        assert all(abs(got[k].target - target[s]) < 1e-3 * target[s] + 1e-6 and got[k].source_size == sum(sizes[s]) for k, *_ in mine)
        taken = Count()
        for k, text, *_ in mine:
            taken[len(text.split())] += got[k].copies
        assert sum(abs(taken[n] - copies[n]) for n in copies) <= 2 and abs(sum(got[k].taken for k, *_ in mine) - target[s]) <= max(copies)


def test_licenses(spark):
    rows = EDGES + [
        (20, "Copyright (c) 2020 A. B.\nreleased UNDER the mit  licence"), (21, "text\nReleased under the MIT License.\nmore"),
        (22, "Released under the MIT License. Not only")
    ]
    got = {r.doc_id: (r.license, r.notices) for r in scan_licenses(documents(spark, rows)).collect()}
    assert got[20] == ("MIT", "MIT") and got[21] == (None, "MIT") and got[22] == (None, "") and got[1] == (None, "")
    assert scan_licenses(documents(spark, [])).count() == 0
    own = spark.createDataFrame([("X-1", "The X licence.\nTwo lines"), ("X-1", None), ("X-2", "")], "license string, text string")
    mine = {
        r.doc_id: (r.license, r.notices) for r in scan_licenses(documents(spark, [*rows, (23, "the x LICENSE two: lines")]), own).collect()
    }
    assert mine[23] == ("X-1", "X-1") and mine[20] == (None, "") and mine[2] == (None, "")


def test_license_collection(spark):
    gpl, bsd = ((TEXTS / f"{x}.txt").read_text() for x in ("GPL-3.0", "BSD-3-Clause"))
    texts = [
        gpl, "Copyright (c) 2020 A. B.\n\n" + bsd.replace(" HOLDERS", "\nHOLDERS"), "a\nSPDX-License-Identifier: MPL-2.0\nb",
        "a\nThis software is released under the GNU General Public License v2\nb\nLicensed under CC BY-SA 4.0", "a\nsee the license\nb"
    ]
    got = {r.doc_id: (r.license, r.notices) for r in scan_licenses(documents(spark, list(enumerate(texts)))).collect()}
    assert got[0][0] == "GPL-3.0" and got[1][0] == "BSD-3-Clause" and got[2] == (None, "MPL-2.0") and got[3] == (None, "CC-BY-SA-4.0,GPL-2.0") and got[4] == (None, "")


def test_url_filters(spark):
    rows = [
        (1, "http://A.Example.COM/en/7?x", "ok"), (2, "x://net/de/", "ok"), (3, None, None), (4, "nothing", "ok"),
        (5, "http://b.example.org#f", "ok")
    ] + [(k, "http://bad.zone/p", "!! " * 50) for k in range(10, 40)]
    got = {r.page_id: r for r in judge_urls(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert (got[1].host, got[1].path, got[1].rule, got[1].verdict) == ("a.example.com", "/en/7", "example.com/en/7", "allow")
    assert got[2].rule == "net/de/" and got[2].verdict == "block" and (got[3].host, got[3].path) == ("", "") and got[5].host == "b.example.org"
    assert got[10].verdict == "block" and got[10].rule is None and got[5].verdict == "allow"
    assert judge_urls(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    marked = [
        (1, "http://10.0.0.1/a", "!! " * 50), (2, "http://172.16.0.1/a", "ok"), (3, "http://a.gov.uk/", "ok"),
        (4, "http://b.gov.uk/", '<i class="!! !! !! !! !!">plain text of a page</i>')
    ]
    hosts = {
        r.host: r for r in host_reputation(
            judge_urls(spark.createDataFrame(marked, "page_id long, url string, html string")).select("host", F.lit(1).alias("bad"))
        ).collect()
    }
    assert set(hosts) == {"10.0.0.1", "172.16.0.1", "a.gov.uk", "b.gov.uk"}
    names = spark.createDataFrame([(h,) for h in [*hosts, "x.co.nz", "localhost"]], "h string").select(
        "h", domain_of(F.col("h")).alias("d"), suffix_of(domain_of(F.col("h"))).alias("s")
    )
    assert {r.h: (r.d, r.s) for r in names.collect()} == {
        "10.0.0.1": ("10.0.0.1", ""), "172.16.0.1": ("172.16.0.1", ""), "a.gov.uk": ("a.gov.uk", "gov.uk"),
        "b.gov.uk": ("b.gov.uk", "gov.uk"), "x.co.nz": ("x.co.nz", "co.nz"), "localhost": ("localhost", "")
    }
    noise = spark.createDataFrame(marked, "page_id long, url string, html string").select("page_id", noisy_page(F.col("html")).alias("bad"))
    assert {r.page_id: r.bad for r in noise.collect()} == {1: 1, 2: 0, 3: 0, 4: 0}


def test_url_rules_of_the_contract(spark, tmp_path):
    """Every rule of op10's contract on its host and a subdomain, in the query and in its SQL."""
    duckdb = pytest.importorskip("duckdb")
    from webharvest.llm import queries as Q

    want = {
        1: ("com/en/", "block"), 2: ("example.com/en/7", "allow"), 3: ("net/de/", "allow"), 4: ("example.net/de/8", "block"),
        5: ("org/es/", "block")
    }
    rows = [
        (k + 10 * deep, f"http://{'a.' * deep}{rule}x", "ok") for k, (rule, _) in want.items() for deep in (0, 1)
    ]
    # a bad host's page under an allow rule stays allowed
    rows += [(100 + k, "http://bad.net/p", "!! " * 50) for k in range(30)] + [(93, "http://bad.net/de/1", "!! " * 50)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = {r.page_id: (r.rule, r.verdict) for r in Q.op10_url_filters(spark, str(tmp_path)).collect()}
    db = duckdb.connect()
    db.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    said = {r[0]: (r[3] or None, r[4]) for r in db.execute(Q.oracle_sql()["op10_url_filters"]).fetchall()}
    for k, x in want.items():
        assert got[k] == got[k + 10] == said[k] == said[k + 10] == x
    assert got[93] == said[93] == ("net/de/", "allow") and got[100] == said[100] == (None, "block")


def test_decontamination_recall_against_all_pairs(spark):
    """Every text aligned whole with every item: substitutions, deletions and insertions, items of one word to sixty."""
    import numpy as np

    r = random.Random(23)
    stock = [prose(1, k) for k in range(400)]
    items = [" ".join(r.choice(stock) for _ in range(k)) for k in (1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 12, 15, 18, 25, 40, 60)]
    texts = []
    for k in range(480):
        copy, kind = items[k % len(items)].split(), k // len(items) % 3
        for _ in range(r.randrange(0, max(1, round(0.3 * len(copy))) + 1)):
            at = r.randrange(len(copy))
            if kind == 0:
                copy[at] = r.choice(stock)
            elif kind == 1 and len(copy) > 1:
                del copy[at]
            else:
                copy[at:at] = [r.choice(stock)]
        texts.append(" ".join([r.choice(stock) for _ in range(30)] + copy + [r.choice(stock) for _ in range(30)]))
    code = {w: np.uint64(k) for k, w in enumerate(sorted({w for t in texts + items for w in t.split()}))}
    coded = [[np.array([code[w] for w in t.split()]) for t in x] for x in (texts, items)]
    want = {}
    for i, a in enumerate(coded[1]):
        for d, b in enumerate(coded[0]):
            score = align(a, b)[0] / (2 * len(a))
            if score >= 0.6:
                want[d, i] = round(score, 9)
    docs, known = documents(spark, list(enumerate(texts))), spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    for options in ({}, {"rare_items": 0}):
        got = {(x.doc_id, x.item_id): round(x.score, 9) for x in contaminated(docs, known, **options).collect()}
        assert all(want.get(k) == v for k, v in got.items()), options
        missed = set(want) - set(got)
        assert len(want) > 450 and len(missed) <= 0.01 * len(want), (len(want), missed)


def test_decontamination_of_a_seed_in_every_text(spark):
    """Rows joined follow the passages, not passages times items of a common seed; short items are found inside texts; a long one lengthens no passage of others."""
    items = [(k, f"all share this start {prose(12, 700 + k)}") for k in range(60)] + [(900, "alpha beta gamma"), (901, prose(3000, 5))]
    texts = [(k, f"{prose(20, k)} all share this start {prose(20, 9000 + k)}") for k in range(300)]
    texts += [(1000 + k, f"{prose(5, k)} {items[k][1]} {prose(5, k + 50)}") for k in range(0, 60, 7)]
    texts += [(2000, f"we saw alpha beta gamma in {prose(20, 1)}"), (2001, prose(3000, 5)), (2002, "alpha beta gamma")]
    docs, known = documents(spark, texts), spark.createDataFrame(items, "item_id long, text string")
    got = {(x.doc_id, x.item_id) for x in contaminated(docs, known).collect()}
    assert got == {(1000 + k, k) for k in range(0, 60, 7)} | {(2000, 900), (2001, 901), (2002, 900)}


def test_mixing_ranks_no_empty_texts(spark):
    """Sources of null and empty texts alone meet no ranking window."""
    rows = [(k, None if k % 2 else "", "en", "empty", 0, "x", 7) for k in range(50)] + [(100 + k, prose(k % 9 + 1, k), "en", "full", 0, "x", 7) for k in range(50)]
    got = mix_sources(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == 100 and sum(x.taken for x in got if x.doc_id < 100) == 0


def test_url_domains_in_sql(spark):
    """Hosts under wildcard, exception, private and other rules, and hosts that are none, as in the SQL of the query."""
    duckdb = pytest.importorskip("duckdb")
    from webharvest.llm.url_filters import host_of, oracle

    hosts = (
        "a.shop.co.il b.shop.co.il:80 co.il a.b.github.io github.io x.www.ck www.ck a.b.ck b.ck ck a.city.kobe.jp city.kobe.jp q.c.kobe.jp com 1.2.3.4 [::1] a..com a.com. .com x.y.公司.cn w.xn--55qx5d.cn"
    ).split()
    rows = [(k, f"http://{h}/p", "noise *** " * (k % 3) + "text " * 50) for k, h in enumerate(hosts * 6)] + [(900, None, "x"), (901, "nothing", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = sorted(tuple(map(str, r)) for r in judge_urls(pages).select("page_id", "host", "path", "rule", "verdict").collect())
    con = duckdb.connect()
    frame = pages.toPandas()
    con.register("pages", frame)
    assert got == sorted(tuple(map(str, r)) for r in con.execute(oracle()).fetchall())
    assert {r.h: r.d for r in pages.select(host_of(F.col("url")).alias("h"), domain_of(host_of(F.col("url"))).alias("d")).collect()}["a.shop.co.il"] == "shop.co.il"
