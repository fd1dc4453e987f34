"""Exact quantiles without funnelling a group through one task.

``percentile``/``median`` keep a value->count map per group and merge all
of it in one task; with one group holding a third of 100 TB that task
would hold billions of entries. Instead each wanted order statistic is
found by range narrowing:

1. per (group, target rank) keep an interval (lo, hi] known to contain it
   and the count of values at or below ``lo``;
2. one pass computes count/min/max and a ``percentile_approx`` grid of the
   rows inside each interval (mergeable sketches, partial aggregation);
3. a second pass counts rows per grid bucket; the bucket holding the rank
   becomes the new interval;
4. an interval with one distinct value is solved; one with at most
   ``small`` rows is solved exactly by ``row_number`` inside it.

Every pass is an ordinary aggregation; only per-target scalars (a few
dozen numbers) reach the driver. Ties are exact because intervals are
closed on the right and counts are exact.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

_MAX_GROUPS = 100_000


def _lerp(a: float, b: float, t: float) -> float:
    # linear interpolation as numpy does it (stable for t >= 0.5)
    d = b - a
    return b - d * (1.0 - t) if t >= 0.5 else a + d * t


def _inside(lo: float | None, hi: float | None):
    """Whether ``_v`` is in (lo, hi]; None is open."""
    ok = F.lit(True)
    if lo is not None:
        ok = ok & (F.col("_v") > F.lit(float(lo)))
    if hi is not None:
        ok = ok & (F.col("_v") <= F.lit(float(hi)))
    return ok


def order_statistics(df: DataFrame, keys: list[str], value: str,
                     ranks: dict[tuple, list[int]], small: int = 50_000,
                     grid: int = 64, accuracy: int = 20_000,
                     max_rounds: int = 12,
                     counts: dict[tuple, int] | None = None) -> dict[tuple, dict[int, float]]:
    """k-th smallest non-null ``value`` (0-based k) for each group in ``ranks``.
    With ``counts`` known, groups of at most ``small`` values skip straight
    to the exact step."""
    spark = df.sparkSession
    base = df.select(*[F.col(k) for k in keys], F.col(value).cast("double").alias("_v")) \
             .filter(F.col("_v").isNotNull())
    targets = []  # [tid, group, k, lo, hi, below]
    for g, ks in ranks.items():
        for k in sorted(set(ks)):
            targets.append([len(targets), g, k, None, None, 0])
    result: dict[tuple, dict[int, float]] = {g: {} for g in ranks}
    active = list(targets)
    key_schema = ", ".join(f"`{k}` {base.schema[k].dataType.simpleString()}" for k in keys)
    schema = "tid int" + (", " + key_schema if keys else "") + ", lo double, hi double"
    probs = [(i + 1) / (grid + 1) for i in range(grid)]

    for rnd in range(max_rounds):
        if not active:
            break
        if keys:
            tdf = spark.createDataFrame([(t[0], *t[1], t[3], t[4]) for t in active], schema)
            cond = [base[k].eqNullSafe(tdf[k]) for k in keys]
            cond.append(tdf["lo"].isNull() | (base["_v"] > tdf["lo"]))
            cond.append(tdf["hi"].isNull() | (base["_v"] <= tdf["hi"]))
            inside = base.join(F.broadcast(tdf), cond).select("tid", base["_v"])
        else:       # one group, a handful of targets: tested on the row, no join
            inside = base.select(F.explode(F.array_compact(F.array(
                *[F.when(_inside(t[3], t[4]), F.lit(t[0])) for t in active]))).alias("tid"), "_v")
        if rnd == 0 and counts is not None and all(counts[t[1]] <= small for t in active):
            exact, refine = list(active), []
        else:
            stats = {r["tid"]: r for r in inside.groupBy("tid").agg(
                F.count("*").alias("n"), F.min("_v").alias("mn"), F.max("_v").alias("mx"),
                F.percentile_approx("_v", probs, accuracy).alias("g")).collect()}
            exact, refine = [], []
            for t in active:
                s = stats[t[0]]
                if s["mn"] == s["mx"]:
                    result[t[1]][t[2]] = s["mn"]
                elif s["n"] <= small:
                    exact.append(t)
                else:
                    refine.append((t, sorted(set(s["g"]))))
        if exact:
            ids = [t[0] for t in exact]
            local = {t[0]: t[2] - t[5] for t in exact}
            lk = spark.createDataFrame(list(local.items()), "tid int, r int")
            w = Window.partitionBy("tid").orderBy("_v")
            picked = (inside.filter(F.col("tid").isin(ids))
                      .withColumn("rn", F.row_number().over(w) - 1)
                      .join(F.broadcast(lk), "tid").filter(F.col("rn") == F.col("r"))
                      .select("tid", "_v").collect())
            by_id = {t[0]: t for t in exact}
            for r in picked:
                t = by_id[r["tid"]]
                result[t[1]][t[2]] = r["_v"]
        if not refine:
            active = []
            break
        gdf = spark.createDataFrame([(t[0], g) for t, g in refine], "tid int, g array<double>")
        bucket_rows = (inside.join(F.broadcast(gdf), "tid")
                  .withColumn("b", F.size(F.filter("g", lambda x: x < F.col("_v"))))
                  .groupBy("tid", "b").count().collect())
        per = {}
        for r in bucket_rows:
            per.setdefault(r["tid"], {})[r["b"]] = r["count"]
        nxt = []
        for t, g in refine:
            need = t[2] - t[5]
            cum = 0
            for b in range(len(g) + 1):
                c = per.get(t[0], {}).get(b, 0)
                if cum + c > need:
                    lo = t[3] if b == 0 else g[b - 1]
                    hi = t[4] if b == len(g) else g[b]
                    nxt.append([t[0], t[1], t[2], lo, hi, t[5] + cum])
                    break
                cum += c
        active = nxt
    if active:
        raise RuntimeError("order statistics did not converge")
    return result


def quantiles(df: DataFrame, keys: list[str], value: str,
              probs: tuple[float, ...]) -> dict[tuple, list[float | None]]:
    """Linear-interpolated quantiles (numpy's default) per group; nulls skipped.
    A group with no non-null value gets ``None``."""
    counts = {tuple(r[k] for k in keys): r["n"] for r in
              df.groupBy(*keys).agg(F.count(value).alias("n")).collect()}
    if len(counts) > _MAX_GROUPS:
        raise ValueError("too many groups for per-group quantiles")
    ranks, plan = {}, {}
    for g, n in counts.items():
        if n == 0:
            continue
        for p in probs:
            pos = (n - 1) * p
            lo = int(math.floor(pos))
            hi = min(lo + 1, n - 1)
            plan[(g, p)] = (lo, hi, pos - lo)
            ranks.setdefault(g, []).extend([lo, hi])
    stats = order_statistics(df, keys, value, ranks, counts=counts) if ranks else {}
    out = {}
    for g, n in counts.items():
        vals = []
        for p in probs:
            if n == 0:
                vals.append(None)
                continue
            lo, hi, t = plan[(g, p)]
            vals.append(_lerp(stats[g][lo], stats[g][hi], t))
        out[g] = vals
    return out


def medians(df: DataFrame, keys: list[str], value: str) -> dict[tuple, float | None]:
    """Median per group as the mean of the two middle values (nulls skipped)."""
    counts = {tuple(r[k] for k in keys): r["n"] for r in
              df.groupBy(*keys).agg(F.count(value).alias("n")).collect()}
    ranks = {g: [(n - 1) // 2, n // 2] for g, n in counts.items() if n > 0}
    stats = order_statistics(df, keys, value, ranks, counts=counts) if ranks else {}
    out = {}
    for g, n in counts.items():
        if n == 0:
            out[g] = None
        elif n % 2:
            out[g] = stats[g][n // 2]
        else:
            out[g] = (stats[g][n // 2 - 1] + stats[g][n // 2]) / 2.0
    return out
