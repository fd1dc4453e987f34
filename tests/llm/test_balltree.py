import math
import re
from collections import Counter

import numpy as np
import pytest

from clickgap.llm import balltree as B

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return TERM.findall(low)


def brute(docs, items, k=10):
    """Every document scored for every item by the rule."""
    bags = [(i, Counter(terms(t))) for i, t in docs]
    n_docs = sum(1 for _, b in bags if b)
    total = sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in items:
        found = []
        for i, bag in bags:
            m = 100 - 75 + (75 * sum(bag.values()) * n_docs) // total if total else 0
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    * ((10 ** 9 * bag[t]) // (1000 * bag[t] + 8 * m)) for t in terms(text) if t in bag)
            if s > 0:
                found.append((-s, i is None, i or 0))
        out += [(item, rank, None if none else i, -s) for rank, (s, none, i) in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=str)


def spark_rows(spark, docs, items, **kw):
    d = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, terms string, size int")
    q = spark.createDataFrame(items, "item_id long, text string")
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in B.rank(d, q, **kw).collect()), key=str)


def corpus(rng, n, words=400):
    vocab = [f"w{i}" for i in range(words)]
    weight = 1 / np.arange(1, words + 1)
    return [" ".join(rng.choice(vocab, size=rng.integers(0, 60), p=weight / weight.sum())) for _ in range(n)]


def test_equals_brute_force(spark):
    rng = np.random.default_rng(8)
    texts = corpus(rng, 500)
    docs = [(i, t) for i, t in enumerate(texts)] + [(1000 + i, texts[7]) for i in range(40)]
    items = [(i, t) for i, t in enumerate(corpus(rng, 25))] + [(90, texts[7]), (91, texts[7] + " unknownword")]
    assert spark_rows(spark, docs, items) == brute(docs, items)


def test_small_blocks_and_trees_give_the_same(spark, monkeypatch):
    rng = np.random.default_rng(9)
    docs = [(i, t) for i, t in enumerate(corpus(rng, 200))]
    items = [(i, t) for i, t in enumerate(corpus(rng, 12))]
    monkeypatch.setattr(B, "BLOCK_TERMS", 100)
    assert spark_rows(spark, docs, items, k=3) == brute(docs, items, k=3)


def test_odd_rows(spark):
    long = " ".join(f"w{i % 3000}" for i in range(30_000)) + " " + "x" * 5000
    docs = [(1, "one two three"), (2, None), (3, ""), (4, " \t- "), (None, "one four"), (5, long), (7, "same one"),
            (7, "same one"), (8, "ÉÉ één One_two"), (None, None)]
    items = [(1, "One one"), (2, None), (3, ""), (4, "x" * 5000), (5, "nowhere"), (6, "Één ÉÉ"), (None, "same"),
             (1, "one"), (9, "w7 w9 w7 three")]
    assert spark_rows(spark, docs, items) == brute(docs, items)
    assert spark_rows(spark, [], items) == [] and spark_rows(spark, docs, []) == []
    assert spark_rows(spark, [(1, None)], items) == []


def random_tree(rng, n, v):
    rows = [np.unique(rng.integers(0, v, rng.integers(1, 12))) for _ in range(n)]
    ptr = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
    col = np.concatenate(rows)
    return ptr, col, rng.integers(1, 10 ** 6, len(col))


def test_no_document_scores_above_its_balls():
    rng = np.random.default_rng(10)
    ptr, col, val = random_tree(rng, 900, 60)
    tree = B.Tree(ptr, col, val)
    place = {int(r): i for i, r in enumerate(tree.order)}
    dense = np.zeros((900, 60))
    for i in range(900):
        dense[place[i], col[ptr[i]:ptr[i + 1]]] = val[ptr[i]:ptr[i + 1]]
    assert sorted(tree.order) == list(range(900))
    todo, leaves = [tree.root], 0
    while todo:
        ball = todo.pop()
        if not ball.below:
            leaves += ball.hi - ball.lo
            assert ball.hi - ball.lo <= B.LEAF
        for j, b in enumerate(ball.below):
            centre = np.zeros(60)
            centre[ball.cols] = ball.centre[:, j]
            away = np.sqrt(((dense[b.lo:b.hi] - centre) ** 2).sum(axis=1))
            assert (away <= b.radius).all() and np.allclose(centre, dense[b.lo:b.hi].mean(axis=0))
        todo += ball.below
    assert leaves == 900


def test_search_skips_balls_and_loses_nothing():
    rng = np.random.default_rng(11)
    parts = [random_tree(rng, 400, 50) for _ in range(4)]       # four groups over terms of their own
    ptr, col, val = parts[0]
    for g, (p, c, x) in enumerate(parts[1:], 1):
        ptr, col, val = np.concatenate([ptr, p[1:] + ptr[-1]]), np.concatenate([col, c + 50 * g]), np.concatenate([val, x])
    tree = B.Tree(ptr, col, val)
    for g in range(4):
        cols = np.unique(rng.integers(50 * g, 50 * g + 50, 8))
        query, top = B.Query(cols, rng.integers(1, 9000, len(cols)), 200), B.Top(10, 1)
        top.ids = list(range(1600))
        scored = tree.search(query, top)
        want = np.add.reduceat(query.exact[col] * val, ptr[:-1])
        order = sorted((-int(s), False, i) for i, s in enumerate(want) if s > 0)[:10]
        assert top.found == order and scored < 800


@pytest.mark.parametrize("at", [1, 2, 5])
def test_runs_keep_every_document(monkeypatch, at):
    import pyarrow as pa
    monkeypatch.setattr(B, "TREE_ROWS", at)
    monkeypatch.setattr(B, "TREE_TERMS", 4)
    rows = [(i, i + 1, list(range(i % 6 + 1)), [1] * (i % 6 + 1)) for i in range(23)]
    batches = [pa.RecordBatch.from_arrays(
        [pa.array([r[j] for r in rows[lo:lo + 7]], type=t) for j, t in
         enumerate((pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32())))],
        names=["id", "size", "terms", "tfs"]) for lo in range(0, 23, 7)]
    got = []
    for ids, size, ptr, col, tf in B.runs(batches):
        assert len(ids) <= at and (ptr[-1] <= 4 or len(ids) == 1) and ptr[-1] == len(col) == len(tf)
        got += [(i, s, col[a:b].tolist()) for i, s, a, b in zip(ids, size, ptr[:-1], ptr[1:])]
    assert got == [(r[0], r[1], r[2]) for r in rows]
