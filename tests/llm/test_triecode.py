import hashlib
import math

import numpy as np
import pytest

from clickgap.llm import triecode as C


def nearest(part, book):
    d = [sum((a - b) ** 2 for a, b in zip(part, e)) for e in book]
    return d.index(min(d)), min(d)


def brute(rows):
    """Codes by the rule, one vector at a time. rows: (id, label, vector)."""
    kept = [(i, lab, [math.floor(1024 * x) if abs(x) < 2 ** 53 else int(x) * 1024 for x in v]) for i, lab, v in rows
            if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = {}
    for n in {len(v) for _, _, v in kept}:
        mine = sorted((r for r in kept if len(r[2]) == n), key=lambda r: (r[0] is None, r[0] or 0, r[2]))
        cut = C.cuts(n)
        parts = [[r[2][cut[p]:cut[p + 1]] for r in mine] for p in range(4)]
        books = [[list(x) for x in parts[p][:256]] for p in range(4)]
        for _ in range(4):
            for p in range(4):
                of = {}
                for x in parts[p]:
                    of.setdefault(nearest(x, books[p])[0], []).append(x)
                for e, xs in of.items():
                    books[p][e] = [sum(c) // len(xs) for c in zip(*xs)]
        sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
        for k, r in enumerate(mine):
            got = [nearest(parts[p][k], books[p]) for p in range(4)]
            out.setdefault((r[0], r[1]), []).append(("".join(f"{e:02x}" for e, _ in got), sum(d for _, d in got), sha))
    errors = {}
    for (_, lab), found in out.items():
        errors[lab] = errors.get(lab, 0) + sum(f[1] for f in found)
    return sorted(((i, lab, *f, errors[lab]) for (i, lab), found in out.items() for f in found), key=str)


def spark_rows(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    return sorted(((r.vec_id, r.label, r.code, r.error, r.codebooks_sha256, r.label_error)
                   for r in C.compress(df)[0].collect()), key=str)


def compare(spark, rows):
    want = [(i, lab, code, err, sha, total) for i, lab, code, err, sha, total in brute(rows)]
    got = spark_rows(spark, rows)
    assert [(g[0], g[1], g[2], None if g[3] is None else int(g[3]), g[4]) for g in got] == \
        [w[:5] for w in want]
    assert all(g[5] is None or int(g[5]) == w[5] for g, w in zip(got, want))


@pytest.mark.parametrize("dtype", [np.float64, object])
def test_walk_finds_the_nearest_entry(dtype):
    rng = np.random.default_rng(5)
    for d in (0, 1, 3, 7):
        rows = np.unique(rng.integers(-3, 4, (3000, d)), axis=0) if d else np.zeros((1, 0), dtype=np.int64)
        book = rng.integers(-3, 4, (40, d))
        where, dist = C.walk(rows.astype(object) if dtype is object else rows, book, dtype)
        for i in range(0, len(rows), 7):
            assert (where[i], dist[i]) == nearest(rows[i].tolist(), book.tolist())


def test_shared_prefixes_are_added_once(monkeypatch):
    """Leaves with a common prefix: each level adds to its nodes only."""
    rows = np.array([[a, b, c] for a in range(3) for b in range(4) for c in range(5)])
    seen = []
    real = np.cumsum
    monkeypatch.setattr(C.np, "cumsum", lambda x, *a, **k: seen.append(int(np.asarray(x).sum())) or real(x, *a, **k))
    C.walk(rows, rows[:7], np.float64)
    assert seen == [3, 12, 60]


def test_codes_equal_brute_force(spark):
    rng = np.random.default_rng(6)
    v = np.round(rng.normal(0, 1, (420, 8)), 1)
    rows = [(int(i), None if i % 5 == 0 else int(i % 3), [float(x) for x in v[i]]) for i in rng.permutation(420)]
    compare(spark, rows)


def test_odd_rows(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(1, 0, [0.5] * 8), (2, 0, None), (3, 0, [1.0, None] + [0.0] * 6), (4, 1, [nan] * 8), (5, 1, [inf] * 8),
            (6, None, [-0.0001] * 8), (None, 2, [0.25] * 8), (7, 2, [1.0, 2.0, 3.0]), (7, 2, [1.0, 2.0, 3.0]), (8, 3, []),
            (9, None, [-0.5, 0.5] * 4), (1, 0, [0.5] * 8), (1, 0, [0.4] * 8)]
    compare(spark, rows)


def test_huge_numbers(spark):
    rows = [(i, 0, [float(i), 1e13 * i, -3e9, 0.5, 7e4, -7e4, 1e15, 1.0]) for i in range(300)]
    compare(spark, rows)
    far = C.compress(spark.createDataFrame([(1, 0, [1e300] * 4), (2, 0, [0.0] * 4)],
                                           "vec_id long, label int, embedding array<double>"))[0]
    assert far.count() == 2


def test_empty_table_and_other_columns(spark):
    df = spark.createDataFrame([(1, 0, [0.5] * 8, "x", 2)],
                               "vec_id long, label int, embedding array<double>, v string, n int")
    assert C.compress(df)[0].count() == 1 and C.compress(df.limit(0))[0].count() == 0
