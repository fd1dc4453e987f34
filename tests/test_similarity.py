import numpy as np
import pytest

from clickgap.operators import similarity as S


def unit_rows(rng, n, terms, strata=("x", "y")):
    """(segment, id, term, w, df) of random unit vectors; terms follow a
    Zipf law, so some are in most vectors."""
    p = 1 / np.arange(1, terms + 1)
    out, df = [], {}
    for i in range(n):
        s = strata[i % len(strata)]
        got = np.unique(rng.choice(terms, size=rng.integers(1, 14), p=p / p.sum()))
        w = rng.random(len(got)) + 0.05
        w /= np.sqrt((w * w).sum())
        for t, x in zip(got, w):
            df[s, t] = df.get((s, t), 0) + 1
            out.append([s, i, f"t{t}", float(x), (s, t)])
    return [(s, i, t, w, df[k]) for s, i, t, w, k in out]


def brute(rows, cut):
    vec = {}
    for s, i, t, w, _ in rows:
        vec.setdefault((s, i), {})[t] = w
    out = {}
    keys = sorted(vec, key=lambda k: k[1])
    for x, a in enumerate(keys):
        for b in keys[x + 1:]:
            if a[0] == b[0]:
                d = sum(w * vec[b].get(t, 0.0) for t, w in vec[a].items())
                if d > cut:
                    out[a[0], a[1], b[1]] = round(d, 9)
    return out


@pytest.mark.parametrize("cut,block", [(0.25, 1024), (0.25, 3), (0.6, 5), (0.05, 1024), (0.9, 2)])
def test_pairs_equal_all_pairs(spark, cut, block):
    rows = unit_rows(np.random.default_rng(int(cut * 100) + block), 160, 60)
    w = spark.createDataFrame(rows, "segment string, id long, term string, w double, df long")
    got = S.similarity_pairs(w, ["segment"], "id", cut, block=block).collect()
    assert {(r.segment, r.a, r.b): round(r.sim, 9) for r in got} == brute(rows, cut)
    assert len({(r.a, r.b) for r in got}) == len(got)


def test_long_lists_are_cut_into_blocks(spark):
    """A term in every vector: no join key holds more than two blocks."""
    n, block = 600, 50
    rows = [("x", i, "every", 0.8, n) for i in range(n)] + [("x", i, f"own{i}", 0.6, 1) for i in range(n)]
    w = spark.createDataFrame(rows, "segment string, id long, term string, w double, df long")
    lv = S.term_levels(w, ["segment"], "id")
    post = S.postings(lv, S.vector_levels(lv, "id"), "id", 0.125)
    left, right = S.block_pairs(post, "id", 0.125, block)
    for side in (left, right):
        assert max(r["count"] for r in side.groupBy("jk").count().collect()) <= 1.6 * block
    assert S.similarity_pairs(w, ["segment"], "id", 0.25, block=block).count() == n * (n - 1) // 2


def test_frequent_terms_do_not_make_candidates(spark):
    """Vectors that share only a light frequent term never meet."""
    rows = [("x", i, "the", 0.2, 300) for i in range(300)] + \
           [("x", i, f"rare{i // 2}", (1 - 0.04) ** 0.5, 2) for i in range(300)]
    w = spark.createDataFrame(rows, "segment string, id long, term string, w double, df long")
    lv = S.term_levels(w, ["segment"], "id")
    post = S.postings(lv, S.vector_levels(lv, "id"), "id", 0.125)
    assert S.candidates(post, "id", 0.25).count() == 150 == S.similarity_pairs(w, ["segment"], "id", 0.25).count()


def test_no_vectors(spark):
    w = spark.createDataFrame([], "segment string, id long, term string, w double, df long")
    assert S.similarity_pairs(w, ["segment"], "id", 0.25).isEmpty()
