"""Approximate nearest neighbours on robust-pruned directed graphs.

Rows are dealt by a hash of their id into shards of about SHARD_ROWS. In
each shard a graph is built: every point searches greedily from the medoid
for neighbours, keeps a diverse set of at most DEGREE by robust pruning (a
candidate goes when a kept neighbour is ALPHA times closer to it than the
point itself), and offers itself to those neighbours. Queries run a beam
search of width BEAM over every shard's graph; the best of each shard are
merged. Scores are Euclidean distances of the original vectors in double
precision.

Points of a batch search together, so the inner work is array arithmetic.
Equal vectors of a shard are one point that lists its ids, so a very common
vector neither breaks the graph nor hides its neighbours.

Scale: shard count follows the row count, so a task's memory does not;
queries (a stated subset) go to every shard in blocks of QUERY_BLOCK.

Defined cases: vectors that are null, zero or hold null or non-finite
components take no part; vectors of one length are compared, each length
with shards of its own; a query is no neighbour of itself, rows that share its id neither; ties go to the
smaller id; fewer candidates than k give them all; empty tables give no
rows; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import prepare, stage

SHARD_ROWS = 4096
DEGREE = 32
BUILD_BEAM = 48
BEAM = 96
ALPHA = 1.2
QUERY_BLOCK = 4096
SEED = 11


def distances(x: np.ndarray, norms: np.ndarray, q: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Squared distances (rows of q to their candidates ids), for search."""
    d = norms[ids] - 2 * np.einsum("brd,bd->br", x[ids], q)
    return d + np.einsum("bd,bd->b", q, q)[:, None]


def beam_search(x, norms, graph, entry: int, q, width: int, rounds: int | None = None):
    """Greedy beam search of many queries at once over a graph (n x degree,
    -1 for no edge). Returns (ids, squared distances) of each query's beam
    and the visited points in order (b x steps, -1 where a query had
    finished)."""
    b = len(q)
    ids = np.full((b, width), -1, dtype=np.int64)
    dist = np.full((b, width), np.inf, dtype=np.float32)
    done = np.zeros((b, width), dtype=bool)
    ids[:, 0] = entry
    dist[:, 0] = distances(x, norms, q, ids[:, :1])[:, 0]
    visited = []
    rows = np.arange(b)
    for _ in range(rounds or 10 * width):
        open_ = np.where(done | (ids < 0), np.inf, dist)
        pick = open_.argmin(axis=1)
        live = np.isfinite(open_[rows, pick])
        if not live.any():
            break
        at = rows[live]
        here = np.full(b, -1, dtype=np.int64)
        here[live] = ids[at, pick[live]]
        visited.append(here)
        done[at, pick[live]] = True
        near = graph[here[live]]
        fresh = near >= 0
        fresh &= ~(near[:, :, None] == ids[at][:, None, :]).any(axis=2)
        safe = np.where(fresh, near, 0)
        d = np.where(fresh, distances(x, norms, q[at], safe), np.inf).astype(np.float32)
        all_ids = np.concatenate([ids[at], np.where(fresh, near, -1)], axis=1)
        all_d = np.concatenate([dist[at], d], axis=1)
        all_done = np.concatenate([done[at], np.zeros_like(fresh)], axis=1)
        best = np.argpartition(all_d, width - 1, axis=1)[:, :width]
        ids[at] = np.take_along_axis(all_ids, best, 1)
        dist[at] = np.take_along_axis(all_d, best, 1)
        done[at] = np.take_along_axis(all_done, best, 1)
    order = np.argsort(dist, axis=1, kind="stable")
    seen = np.stack(visited, axis=1) if visited else np.zeros((b, 0), np.int64)
    return np.take_along_axis(ids, order, 1), np.take_along_axis(dist, order, 1), seen


def robust_prune(x, point: int, pool: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """At most ``degree`` of the pool, nearest first, each no closer to an
    already kept one (times alpha) than to the point."""
    pool = np.unique(pool)
    pool = pool[(pool >= 0) & (pool != point)]
    if not len(pool):
        return pool
    v = x[pool]
    d = ((v - x[point]) ** 2).sum(axis=1)
    order = np.lexsort((pool, d))
    pool, v, d = pool[order], v[order], d[order]
    sq = (v * v).sum(axis=1)
    between = sq[:, None] + sq[None, :] - 2 * (v @ v.T)
    alive = np.ones(len(pool), dtype=bool)
    kept = []
    for i in range(len(pool)):
        if not alive[i]:
            continue
        kept.append(i)
        if len(kept) == degree:
            break
        alive &= (alpha * alpha) * between[i] > d
    return pool[kept]


def build(x: np.ndarray, degree: int = DEGREE, beam: int = BUILD_BEAM, alpha: float = ALPHA,
          batch: int = 256, seed: int = SEED):
    """(graph, entry point) over the distinct vectors x (float32)."""
    n = len(x)
    norms = np.einsum("nd,nd->n", x, x)
    entry = int(((x - x.mean(axis=0)) ** 2).sum(axis=1).argmin())
    rng = np.random.default_rng(seed)
    slack = degree + degree // 2            # room before a list is pruned again
    graph = np.full((n, slack), -1, dtype=np.int64)
    fill = np.zeros(n, dtype=np.int64)
    start = min(degree // 2, n - 1)
    if start > 0:
        rand = rng.integers(0, n - 1, size=(n, start))
        rand += rand >= np.arange(n)[:, None]
        graph[:, :start] = rand
        fill[:] = start
    for strict in (1.0, alpha):
        order = rng.permutation(n)
        for lo in range(0, n, batch):
            points = order[lo:lo + batch]
            ids, _, seen = beam_search(x, norms, graph, entry, x[points], beam)
            for j, p in enumerate(points):
                pool = np.concatenate([ids[j], seen[j], graph[p, :fill[p]]])
                kept = robust_prune(x, p, pool, degree, strict)
                graph[p] = -1
                graph[p, :len(kept)] = kept
                fill[p] = len(kept)
                for o in kept:
                    if (graph[o, :fill[o]] == p).any():
                        continue
                    if fill[o] == slack:
                        again = robust_prune(x, o, np.append(graph[o], p), degree, strict)
                        graph[o] = -1
                        graph[o, :len(again)] = again
                        fill[o] = len(again)
                    else:
                        graph[o, fill[o]] = p
                        fill[o] += 1
    return graph, entry


def exact_scores(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Euclidean distance in double precision of one query to rows of x."""
    d = x.astype(np.float64) - q.astype(np.float64)
    return np.sqrt((d * d).sum(axis=1))


def _build_shard(rows, degree: int, beam: int, alpha: float):
    """One row per distinct vector of a shard: its ids, edges, and whether
    searches start there."""
    import pandas as pd

    full = np.stack(rows["v"].to_numpy())
    ids = rows["id"].to_numpy().astype(np.int64)
    uniq, member = np.unique(full, axis=0, return_inverse=True)
    by = np.lexsort((ids, member.ravel()))
    cut = np.searchsorted(member.ravel()[by], np.arange(len(uniq) + 1))
    graph, entry = build(uniq.astype(np.float32), degree, beam, alpha)
    return pd.DataFrame({
        "shard": np.full(len(uniq), rows["shard"].iloc[0]), "node": np.arange(len(uniq), dtype=np.int32),
        "v": list(uniq), "ids": [ids[by[cut[i]:cut[i + 1]]] for i in range(len(uniq))],
        "edges": [g[g >= 0].astype(np.int32) for g in graph], "start": np.arange(len(uniq)) == entry})


def _search_shard(points, queries, k: int, beam: int):
    """The k best of one shard for one block of queries."""
    import pandas as pd

    none = pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"),
                         "score": pd.Series(dtype="float64")})
    if not len(points) or not len(queries):
        return none
    points = points.sort_values("node")
    exact = np.stack(points["v"].to_numpy())
    x = exact.astype(np.float32)
    norms = np.einsum("nd,nd->n", x, x)
    graph = np.full((len(x), max(1, points["edges"].map(len).max())), -1, dtype=np.int64)
    for i, e in enumerate(points["edges"]):
        graph[i, :len(e)] = e
    entry = int(np.flatnonzero(points["start"].to_numpy())[0])
    members = points["ids"].to_numpy()
    q = np.stack(queries["v"].to_numpy())
    qid = queries["id"].to_numpy().astype(np.int64)
    out = []
    for lo in range(0, len(q), 512):
        found, _, _ = beam_search(x, norms, graph, entry, q[lo:lo + 512].astype(np.float32), beam)
        for j in range(len(found)):
            near = found[j][found[j] >= 0]
            score = exact_scores(exact[near], q[lo + j])
            lists = [members[p][:k + 1] for p in near]      # ascending; one may be the query's own
            s, r = np.repeat(score, [len(m) for m in lists]), np.concatenate(lists).astype(np.int64)
            other = r != qid[lo + j]
            s, r = s[other], r[other]
            top = np.lexsort((r, s))[:k]
            out.append((np.full(len(top), qid[lo + j]), r[top], s[top]))
    return pd.DataFrame({"query_id": np.concatenate([o[0] for o in out]),
                         "vec_id": np.concatenate([o[1] for o in out]),
                         "score": np.concatenate([o[2] for o in out])})


def usable(v: Column) -> Column:
    """Not null, no null or non-finite component, not zero."""
    fine = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    return v.isNotNull() & (F.size(v) > 0) & fine & F.exists(v, lambda c: c != 0)


def neighbours(vectors: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id",
               vec_col: str = "embedding", shard_rows: int = SHARD_ROWS, degree: int = DEGREE,
               build_beam: int = BUILD_BEAM, beam: int = BEAM, alpha: float = ALPHA) -> DataFrame:
    """The k nearest found of each query row (``is_query`` over
    ``vectors``) among all rows but its own: ``query_id``, ``rank``,
    ``vec_id``, ``score``."""
    spark = vectors.sparkSession
    prepare(spark)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"),
                          F.coalesce(is_query, F.lit(False)).alias("asked")) \
        .where(F.col("id").isNotNull() & usable(F.col("v")))
    rows = rows.withColumn("size", F.size("v"))
    sizes = sorted(rows.groupBy("size").agg(F.count("*"), F.count_if("asked")).collect())
    # vectors of one length are neighbours: each length has shards of its own
    n_asked, first, shards = sum(a for _, _, a in sizes), F.lit(0).cast("long"), F.lit(1).cast("long")
    used = 0
    for size, n, _ in sizes:
        count = max(1, -(-n // shard_rows))
        first = F.when(F.col("size") == size, F.lit(used).cast("long")).otherwise(first)
        shards = F.when(F.col("size") == size, F.lit(count).cast("long")).otherwise(shards)
        used += count
    points = rows.select("id", "v", (first + F.pmod(F.xxhash64("id", F.lit(3)), shards)).alias("shard"))
    index = stage(points.groupBy("shard").applyInPandas(
        lambda a: _build_shard(a, degree, build_beam, alpha),
        "shard long, node int, v array<double>, ids array<long>, edges array<int>, start boolean"))
    blocks = max(1, -(-n_asked // QUERY_BLOCK))

    def every(count: int):
        return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(count - 1).cast("long")))
    asked = rows.where("asked").select("id", "v", F.pmod(F.xxhash64("id", F.lit(4)), F.lit(blocks)).alias("block"),
                                       F.explode(F.sequence(first, first + shards - 1)).alias("shard"))
    found = index.withColumn("block", every(blocks)).groupBy("shard", "block") \
        .cogroup(asked.groupBy("shard", "block")).applyInPandas(
            lambda a, b: _search_shard(a, b, k, beam), "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.distinct().withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k) \
        .select("query_id", "rank", "vec_id", "score")
