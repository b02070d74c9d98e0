"""The pipeline's stages on a small table, each against brute force, with the rows that break things."""

import importlib.util
import random
import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

if importlib.util.find_spec("corpus_pipeline") is None:
    pytest.skip("no pipeline", allow_module_level=True)

import corpus_pipeline as P

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, class_id int, k1 string, taken string, pii_key int"
ENDINGS = ("tion", "ing", "ly", "ment", "er", "s", "ed", "ness")
ROOTS = [a + b for a in "br cl dr fl gr pl st tr".split() for b in "an el in on ust orm ick ane".split()]
ITEM = "which of the named rivers joins the western sea after crossing three old border towns near the mill"
STAGES = dict(P.STAGES)


def prose(n, seed):
    r = random.Random(seed)
    out = []
    for k in range(n):
        word = r.choice(ROOTS) + r.choice(ENDINGS)
        out.append((word.capitalize() if k % 9 == 0 else word) + ("." if k % 9 == 8 else ""))
    return " ".join(out)


def rows():
    texts = {k: prose(80 + k, k) for k in range(10, 60)}
    texts |= {k: prose(80 + k - 50, k - 50) for k in range(60, 66)}  # copies of 10 to 15
    for k in range(66, 72):  # near copies of 16 to 21
        words = texts[k - 50].split()
        words[len(words) // 2] = "changed"
        texts[k] = " ".join(words)
    texts[72] = prose(60, 72) + " " + ITEM + ". " + prose(20, 720)
    texts[73] = prose(60, 73) + " " + ITEM.replace("western", "eastern").replace("old", "small") + " " + prose(20, 730)
    texts[74] = prose(40, 74) + " write to jane.roe@mail.example.org or 10.1.2.3 soon. " + prose(20, 740)
    texts[75] = prose(12_000, 75)
    texts |= {k: "$$$ @@ ### !!! " * 20 + "BUY NOW!!! " * 20 for k in range(76, 84)}
    texts |= {84: None, 85: "", 86: " \n ", 87: None}
    out = [(k, t, "en", None if k % 7 == 0 else f"s{k % 3}", len(t or ""), 1, "k", "t", 2) for k, t in texts.items()]
    return out + [out[0], (None, prose(90, 900), "en", "s1", 5, 1, "k", "t", 2), (None, None, "en", None, None, 1, "k", "t", 2)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    where = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(rows(), SCHEMA).write.parquet(str(where / "documents.parquet"))
    spark.createDataFrame([(1, ITEM), (2, None)], "item_id long, text string").write.parquet(str(where / "benchmark.parquet"))
    spark.createDataFrame(
        [(k, 0 if 76 <= k < 84 else 1, 0) for k in range(10, 84)], "doc_id long, quality int, toxic int"
    ).write.parquet(str(where / "labels.parquet"))
    return str(where)


def stage(spark, folder, name, docs=None):
    docs = spark.read.parquet(f"{folder}/documents.parquet") if docs is None else docs
    out = STAGES[name](spark, docs, folder)
    assert name == "mixing" or out.columns == docs.columns
    return docs, out


def ids(df):
    return sorted((r.doc_id is None, r.doc_id or 0) for r in df.select("doc_id").collect())


def expected(keep):
    return sorted((r[0] is None, r[0] or 0) for r in rows() if keep(r))


def test_quality(spark, folder):
    _, out = stage(spark, folder, "quality")
    assert ids(out) == expected(lambda r: r[1] is not None and r[1].strip() and "$$$" not in r[1])


def test_near_duplicates(spark, folder):
    _, out = stage(spark, folder, "near_duplicates")
    sets = {}
    for r in rows():
        w = re.findall(r"[a-z0-9_]+", (r[1] or "").lower())
        sets[r[0]] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    known = sorted(k for k in sets if k is not None)
    root = {k: k for k in known}
    for _ in known:
        for a in known:
            for b in known:
                if a < b and (sets[a] == sets[b] or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])):
                    root[b] = root[a] = min(root[a], root[b])
    gone = {k for k in known if root[k] != k}
    assert set(range(60, 72)) | {85, 86, 87} <= gone
    assert ids(out) == expected(lambda r: r[0] not in gone)


def test_decontamination(spark, folder):
    _, out = stage(spark, folder, "decontamination")
    assert ids(out) == expected(lambda r: r[0] not in (72, 73))


def test_personal_data(spark, folder):
    docs, out = stage(spark, folder, "personal_data")
    marks = (("jane.roe@mail.example.org", "[EMAIL]"), ("10.1.2.3", "[IP]"))
    want = []
    for r in rows():
        text = r[1]
        for old, new in marks:
            text = text and text.replace(old, new)
        want.append((*r[:1], text, *r[2:4], None if text is None else len(text), *r[5:]))
    assert sorted(map(str, (tuple(x) for x in out.collect()))) == sorted(map(str, want))
    assert STAGES["personal_data"](spark, docs.drop("n_chars"), folder).columns == docs.drop("n_chars").columns


def test_mixing(spark, folder):
    _, out = stage(spark, folder, "mixing")
    got = out.collect()
    size, taken, target = {}, {}, {}
    sources = {r[0]: r[3] for r in rows() if r[0] is not None}
    assert len(got) == len(rows())
    words = sorted(len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")) for r in rows())
    assert sorted(r["size"] for r in got) == words and sum({(r.source_size, r.target): r.target for r in got}.values()) == pytest.approx(sum(words))
    for r in got:
        if r.doc_id is not None:
            s = sources[r.doc_id]
            size.setdefault(s, r.source_size), target.setdefault(s, r.target)
            taken[s] = taken.get(s, 0) + r.taken
            assert r.taken <= 3 * r["size"] and (r.source_size, r.target) == (size[s], target[s])
    none = [r for r in got if r.doc_id is None]
    taken["s1"] += sum(r.taken for r in none)
    assert all(abs(taken[s] - target[s]) <= 0.02 * target[s] + 100 for s in target)


def test_every_stage_takes_an_empty_table(spark, folder):
    none = spark.createDataFrame([], SCHEMA)
    for name in STAGES:
        assert stage(spark, folder, name, none)[1].count() == 0


def test_run_and_what_it_leaves(spark, folder):
    def tables():
        return {p.name for p in Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://")).glob("*")}

    before = tables()
    out = P.run(spark, folder)
    assert {r.doc_id for r in out.collect()} == {None} | (set(range(10, 60)) | {74, 75}) - set()
    assert len(tables() - before) < 75  # the last table and those of the last stage
    assert [name for name, _ in P.STAGES] == ["quality", "near_duplicates", "decontamination", "personal_data", "mixing"]
