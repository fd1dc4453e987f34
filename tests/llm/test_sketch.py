import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from clickgap.llm import sketch


def brute(rows, size=2, t=(80, 100)):
    sets = [sketch.shingle_set(x, size) for _, x in rows]
    par = list(range(len(rows)))

    def find(x):
        while par[x] != x:
            x = par[x]
        return x
    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            both = len(a & b)
            if rows[i][0] is None or rows[j][0] is None:
                continue
            if rows[i][0] == rows[j][0] or (both and t[1] * both >= t[0] * (len(a) + len(b) - both)):
                par[find(i)] = find(j)
    comp = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            comp[find(i)] = min(comp.get(find(i), d), d)
    return [(d, len(sets[i]), None if d is None else comp[find(i)], d is None or comp[find(i)] == d)
            for i, (d, _) in enumerate(rows)]


def check(docs):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = [tuple(r) for r in sketch.groups(docs).collect()]
    assert sorted(map(str, got)) == sorted(map(str, brute(rows)))
    left = sketch.representatives(docs)
    assert left.columns == docs.columns
    ids = [r.doc_id for r in left.collect() if r.doc_id is not None]
    assert sorted(ids) == sorted({d for d, _, _, k in brute(rows) if k and d is not None})


def test_tables(sf001_docs):
    check(sf001_docs)


def test_odd_rows(odd_docs, no_docs):
    check(odd_docs)
    assert sketch.groups(no_docs).count() == 0


def test_groups_of_near_copies_with_a_bad_leader(spark):
    """The smallest id is an edited copy that few others reach; links run
    through other members."""
    rng = random.Random(5)
    base = [f"w{rng.randrange(400)}" for _ in range(150)]

    def copy(share):
        w = list(base)
        for i in rng.sample(range(150), int(150 * share)):
            w[i] = f"x{rng.randrange(10 ** 6)}"
        return " ".join(w)
    rows = [(0, copy(0.08))] + [(i, copy(rng.choice([0.0, 0.02, 0.03, 0.05, 0.06, 0.08]))) for i in range(1, 120)]
    rows += [(500 + i, " ".join(base[:60]) + " " + " ".join(f"y{rng.randrange(10 ** 6)}" for _ in range(60)))
             for i in range(40)]
    check(spark.createDataFrame(rows, "doc_id long, text string"))


def test_sketch_fills_every_coordinate_and_agrees_like_jaccard():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 1 << 52, 400).astype(np.uint64)
    for share in (1.0, 0.9, 0.5):
        keep = int(400 * share)
        b = np.concatenate([a[:keep], rng.integers(0, 1 << 52, 400 - keep).astype(np.uint64)])
        both = sketch.sketch_matrix(np.concatenate([a, b]), np.repeat([0, 1], 400), 2, 2000)
        assert (both != np.uint64(0xFFFFFFFFFFFFFFFF)).all()
        jaccard = keep / (800 - keep)
        assert abs((both[0] == both[1]).mean() - jaccard) < 0.05
    one = sketch.sketch_matrix(np.array([7], dtype=np.uint64), np.array([0]), 1, 64)
    assert (one != np.uint64(0xFFFFFFFFFFFFFFFF)).all()


@settings(max_examples=300, deadline=None)
@given(st.data())
def test_pairs_that_link_meet_in_their_prefixes(data):
    """The prefix rule of step 3 loses no link, whatever the leader."""
    element = st.integers(0, 25).map(lambda i: (b"%d" % i,))
    lead, m, x = (data.draw(st.sets(element, min_size=1, max_size=24)) for _ in range(3))
    t = (80, 100)
    if sketch._agrees(m, lead, t) or not sketch._agrees(m, x, t):
        return
    fm, _ = sketch.difference_prefix(m, lead, False, t, {})
    fx, n = sketch.difference_prefix(x, lead, sketch._agrees(x, lead, t), t, {})
    assert set(fm) & set(fx[:n])


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 100 + i) for i in range(1, 50)] + [(200, 199)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r.node: r.label for r in sketch.components(df).collect()}
    assert all(got[i] == 0 for i in range(41)) and all(got[100 + i] == 100 for i in range(50)) and got[200] == 199
    assert sketch.components(df.limit(0)).count() == 0


def test_copies_of_one_label_do_not_meet_again(spark, monkeypatch):
    """A leader whose bucket holds m near copies linked to each other but not
    to it: what the completing join makes grows with m, not with its square."""
    sizes = []
    real = sketch.confirmed

    def made(m):
        base = [f"c{i}" for i in range(60)]
        lead = base[:30] + [f"d{i}" for i in range(30)]
        rows = [(0, " ".join(lead))] + [(i + 1, " ".join(base + [f"e{i}"])) for i in range(m)]
        df = spark.createDataFrame(rows, "doc_id long, text string")
        monkeypatch.setattr(sketch, "confirmed", lambda rest, *a: sizes.append(rest.count()) or real(rest, *a))
        got = {r.doc_id: r.component_id for r in sketch.groups(df).collect()}
        assert got[0] == 0 and {got[i] for i in range(1, m + 1)} == {1}
    made(40)
    made(160)
    assert len(sizes) < 2 or sizes[-1] <= 5 * max(sizes[0], 1)
