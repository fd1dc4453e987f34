"""Missed-click scoring: position bucket, expected CTR, opportunity, priority.

The bucket medians and the score quantiles are a handful of scalars
computed with the exact distributed selection of ``quantiles``; they go
back into the plan as literals (a 6-entry map), so scoring each row is a
narrow projection with no join and no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clickgap.config import (CTR_FLOOR, DEFAULT_EXPECTED_CTR, PRIORITY_QUANTILES,
                             SCORE_WEIGHTS)
from clickgap.functions.numeric import pos_bucket
from clickgap.operators.quantiles import medians, quantiles
from clickgap.session import materialize


def bucket_expectations(q: DataFrame) -> dict[str, float]:
    """Expected CTR per bucket: max(median CTR of the bucket, floor); a
    bucket without a median uses the overall median, then 0.01."""
    b = q.select(pos_bucket(F.col("position")).alias("pos_bucket"), "ctr")
    # the overall median rides along as the group with a null bucket
    both = b.unionByName(b.withColumn("pos_bucket", F.lit(None).cast("string")))
    meds = medians(both, ["pos_bucket"], "ctr")
    per_bucket = {k: v for k, v in meds.items() if k != (None,)}
    overall = meds.get((None,))
    out = {}
    for bucket, floor in CTR_FLOOR.items():
        med = per_bucket.get((bucket,))
        if med is None:
            med = overall if overall is not None else DEFAULT_EXPECTED_CTR
        out[bucket] = max(med, floor)
    return out


def _lookup(mapping: dict[str, float], key: Column) -> Column:
    m = F.create_map(*[x for k, v in mapping.items() for x in (F.lit(k), F.lit(float(v)))])
    return F.coalesce(m[key], F.lit(DEFAULT_EXPECTED_CTR))


def priority_score(clicks: Column, opportunity: Column, impressions: Column) -> Column:
    wc, wo, wi = SCORE_WEIGHTS
    return (F.log1p(clicks) * F.lit(wc) + F.log1p(opportunity) * F.lit(wo)
            + F.log1p(impressions) * F.lit(wi))


def band(score: Column, q70: float | None, q90: float | None) -> Column:
    if q70 is None or q90 is None:
        return F.lit("P3")
    return (F.when(score >= F.lit(q90), "P1").when(score >= F.lit(q70), "P2").otherwise("P3"))


def score_quantiles(df: DataFrame, col: str) -> tuple[float | None, float | None]:
    q70, q90 = quantiles(df, [], col, PRIORITY_QUANTILES).get((), [None, None])
    return q70, q90


def opportunity(q: DataFrame, expectations: dict[str, float] | None = None) -> DataFrame:
    """Adds pos_bucket, expected_ctr, opportunity_clicks, priority_score (lazy)."""
    exp = expectations if expectations is not None else bucket_expectations(q)
    return (q.withColumn("pos_bucket", pos_bucket(F.col("position")))
             .withColumn("expected_ctr", _lookup(exp, F.col("pos_bucket")))
             .withColumn("opportunity_clicks", F.coalesce(
                 F.col("impressions") * F.greatest(F.lit(0.0), F.col("expected_ctr") - F.col("ctr")),
                 F.lit(0.0)))
             .withColumn("priority_score", priority_score(
                 F.col("clicks"), F.col("opportunity_clicks"), F.col("impressions"))))


def priority_bands(q: DataFrame) -> DataFrame:
    """Adds priority_band from the 0.70 / 0.90 quantiles of priority_score."""
    q70, q90 = score_quantiles(q, "priority_score")
    return q.withColumn("priority_band", band(F.col("priority_score"), q70, q90))


def score_queries(q: DataFrame) -> DataFrame:
    """opportunity + bands. The input is written once; the median and
    quantile passes then re-read it through a narrow projection."""
    return priority_bands(opportunity(materialize(q)))
