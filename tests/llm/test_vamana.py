import math

import numpy as np

from pyspark.sql import functions as F

from clickgap.llm import vamana


def brute(rows, asked, k):
    out = {}
    x = np.array([v for _, v in rows], dtype=np.float64)
    ids = np.array([i for i, _ in rows])
    for i, v in rows:
        if not asked(i):
            continue
        d = np.sqrt(((x - np.asarray(v, dtype=np.float64)) ** 2).sum(axis=1))
        out[i] = [(ids[j], d[j]) for j in np.lexsort((ids, d)) if ids[j] != i][:k]
    return out


def recall(got, want):
    hit = sum(len({r.vec_id for r in got if r.query_id == q} & {i for i, _ in w}) for q, w in want.items())
    return hit / sum(len(w) for w in want.values())


def test_recall_scores_and_ranks(spark):
    vectors = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    got = vamana.neighbours(vectors, F.col("vec_id") % 100 == 0, shard_rows=1500).collect()
    rows = [(r.vec_id, r.embedding) for r in vectors.collect()]
    want = brute(rows, lambda i: i % 100 == 0, 10)
    assert recall(got, want) >= 0.95
    by = dict(rows)
    for q in want:
        mine = sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == list(range(1, 11))
        assert [(r.score, r.vec_id) for r in mine] == sorted((r.score, r.vec_id) for r in mine)
        for r in mine:
            d = math.dist([float(c) for c in by[q]], [float(c) for c in by[r.vec_id]])
            assert abs(d - r.score) < 1e-9


def test_odd_vectors_and_few_candidates(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0]), (100, [2.0, 0.0]), (3, None), (4, [0.0, 0.0]),
            (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (8, [1.0, 2.0, 3.0]), (None, [1.0, 1.0]), (9, []),
            (2, [0.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("shard", F.lit("x"))
    got = vamana.neighbours(df, F.col("vec_id") % 100 == 0).collect()
    assert {(r.query_id, r["rank"], r.vec_id) for r in got} == {
        (0, 1, 1), (0, 2, 100), (0, 3, 2), (100, 1, 0), (100, 2, 1), (100, 3, 2)}
    assert vamana.neighbours(df.limit(0), F.col("vec_id") == 0).count() == 0
    assert vamana.neighbours(df, F.lit(False)).count() == 0


def test_very_common_vector(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [0.5] * 8) for i in range(0, 700)] + [(i, [float(c) for c in rng.normal(size=8)]) for i in range(700, 1500)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = vamana.neighbours(df, F.col("vec_id") % 50 == 0, shard_rows=400).collect()
    want = brute(rows, lambda i: i % 50 == 0, 10)
    assert recall(got, want) >= 0.95
    for q in range(0, 700, 50):
        assert [r.vec_id for r in sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])] == \
            [i for i in range(11) if i != q][:10]


def test_vectors_of_several_lengths_meet_their_own(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(c) for c in rng.normal(size=8 if i % 3 else 5)]) for i in range(400)] + [(400, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = vamana.neighbours(df, F.col("vec_id") % 50 == 0, shard_rows=150).collect()
    size = {i: len(v) for i, v in rows}
    want = {}
    for n in (5, 8):
        want.update(brute([r for r in rows if len(r[1]) == n], lambda i: i % 50 == 0, 10))
    assert all(size[r.query_id] == size[r.vec_id] for r in got)
    assert recall(got, want) >= 0.95 and {r.query_id for r in got} == set(range(0, 400, 50))
