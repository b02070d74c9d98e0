"""Scratch memory of the Python functions that run in tasks: it follows neither a batch nor a group of copies."""

import tracemalloc

import numpy as np
import pyarrow as pa

from webharvest.llm import decontaminate, jaccard_join
from webharvest.llm._words import Words, steps

MB = 1 << 20


def peak(run):
    tracemalloc.start()
    try:
        return run(), tracemalloc.get_traced_memory()[1] / MB
    finally:
        tracemalloc.stop()


def test_steps_of_texts():
    texts = pa.array([" ".join(f"word{k * j % 9973}" for j in range(800)) for k in range(600)])

    def run(limit):
        return np.concatenate([Words(texts.slice(a, b - a)).shingles(5)[0] for a, b in limit])

    whole = run([(0, len(texts))])
    out, most = peak(lambda: run(steps(texts)))
    assert (out == whole).all()
    assert most < 15  # 23 with steps of a megabyte


def test_words_that_all_items_share():
    rng = np.random.default_rng(3)
    shared = np.arange(1, 41, dtype=np.uint64)
    items = [np.concatenate([shared, shared[: k % 5], rng.integers(100, 1 << 40, 5).astype(np.uint64)]) for k in range(512)]
    block = decontaminate._Block(
        [{"item_id": k, "class": 4, "words": x.tobytes(), "rare": [k]} for k, x in enumerate(items)]
    )
    passages = [np.concatenate([rng.permutation(shared)[: k % 41], items[k][-2:], shared[:1]]) for k in range(256)]
    out, most = peak(lambda: block.reachable(passages))
    for p, x in enumerate(passages):
        for i in range(0, 512, 37):
            assert out[p, i] == decontaminate.MATCH * np.isin(items[i], x).sum()
    assert most < 30  # 81 with all pairs at once


def test_components_of_two_full_blocks():
    rng = np.random.default_rng(4)
    adjacent = rng.random((2048, 2048)) < 0.0004
    adjacent |= adjacent.T
    label, most = peak(lambda: jaccard_join._star(adjacent))
    assert most < 10  # a matrix of 2048 x 2048 labels takes 32
    near = [np.flatnonzero(adjacent[k]) for k in range(2048)]
    for start in np.unique(label):
        seen, todo = {start}, [start]
        while todo:
            for x in near[todo.pop()]:
                if x not in seen:
                    seen.add(x)
                    todo.append(x)
        assert seen == set(np.flatnonzero(label == start))
