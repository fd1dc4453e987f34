"""Cannibalisation risk pairs.

Only flagged clusters take part. Pairs on one page: two flagged clusters
with the same primary page, the earlier row (cluster-table order) first;
their difference is |match_a - match_b|. Pairs via the runner-up: a
flagged cluster whose runner-up page (present, not its own page) is the
primary page of another flagged cluster; the difference is the row's own
|match - runner_up|. Both are equi-joins on the page; the union keeps
duplicates.

The same-page self-join emits every pair of flagged clusters sharing a
page; that pair list *is* the result, so its size is the output size.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from clickgap.config import RISK_HIGH, RISK_MEDIUM
from clickgap.operators.aggregate import CLUSTER_KEYS

RISK_COLS = ["primary_cluster_id", "primary_topic", "primary_intent",
             "competing_cluster_id", "competing_topic", "competing_intent",
             "shared_page", "primary_match_score", "runner_up_match_score",
             "score_difference", "risk_level"]


def risk_level(diff):
    return F.when(diff < RISK_HIGH, "High").when(diff < RISK_MEDIUM, "Medium").otherwise("Low")


def risk_pairs(cluster: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(same-page pairs, runner-up pairs), both with RISK_COLS + ordering keys."""
    flagged = (cluster.filter(F.col("cannibalisation_risk"))
               .select(*CLUSTER_KEYS, "primary_page", "match_score", "runner_up_page", "runner_up_score")
               .withColumn("ord", F.struct(*CLUSTER_KEYS)))
    a, b = flagged.alias("a"), flagged.alias("b")
    same = a.join(b, (F.col("a.primary_page") == F.col("b.primary_page")) & (F.col("a.ord") < F.col("b.ord")))
    diff = F.abs(F.col("a.match_score") - F.col("b.match_score"))
    same = same.select(
        F.col("a.cluster_id").alias("primary_cluster_id"), F.col("a.topic_label").alias("primary_topic"),
        F.col("a.intent").alias("primary_intent"), F.col("b.cluster_id").alias("competing_cluster_id"),
        F.col("b.topic_label").alias("competing_topic"), F.col("b.intent").alias("competing_intent"),
        F.col("a.primary_page").alias("shared_page"), F.col("a.match_score").alias("primary_match_score"),
        F.col("b.match_score").alias("runner_up_match_score"), diff.alias("score_difference"),
        risk_level(diff).alias("risk_level"), F.col("a.ord").alias("ord_a"), F.col("b.ord").alias("ord_b"))
    runner = a.filter(F.col("a.runner_up_page").isNotNull() &
                      (F.col("a.runner_up_page") != F.col("a.primary_page"))) \
              .join(b, F.col("a.runner_up_page") == F.col("b.primary_page"))
    rdiff = F.abs(F.col("a.match_score") - F.col("a.runner_up_score"))
    runner = runner.select(
        F.col("a.cluster_id").alias("primary_cluster_id"), F.col("a.topic_label").alias("primary_topic"),
        F.col("a.intent").alias("primary_intent"), F.col("b.cluster_id").alias("competing_cluster_id"),
        F.col("b.topic_label").alias("competing_topic"), F.col("b.intent").alias("competing_intent"),
        F.col("a.runner_up_page").alias("shared_page"), F.col("a.match_score").alias("primary_match_score"),
        F.col("a.runner_up_score").alias("runner_up_match_score"), rdiff.alias("score_difference"),
        risk_level(rdiff).alias("risk_level"), F.col("a.ord").alias("ord_a"), F.col("b.ord").alias("ord_b"))
    return same, runner


def analyze_risks(cluster: DataFrame) -> DataFrame:
    """All risk pairs, smallest score difference first."""
    same, runner = risk_pairs(cluster)
    return (same.unionByName(runner)
                .orderBy("score_difference", "ord_a", "ord_b", "shared_page")
                .select(*RISK_COLS))


def risk_summary(risks: DataFrame) -> DataFrame:
    return risks.agg(F.count("*").alias("total_risks"),
                     F.count_if(F.col("risk_level") == "High").alias("high_risks"),
                     F.count_if(F.col("risk_level") == "Medium").alias("medium_risks"))


def risk_counts(cluster: DataFrame) -> DataFrame:
    """A17 without making the pairs: one row of total, high and medium
    counts, equal to ``risk_summary(analyze_risks(cluster))`` (a difference
    within floating-point rounding of a level's bound may fall on its other
    side).

    On one page, the pairs within a score difference are half of what each
    flagged cluster sees in a range around its score; through the
    runner-up, a cluster counts once for every flagged cluster of that page.
    """
    flagged = cluster.filter(F.col("cannibalisation_risk")) \
        .select("primary_page", "match_score", "runner_up_page", "runner_up_score")

    def within(bound: float):       # strictly closer than the bound
        less = f"{math.nextafter(bound, 0.0)!r}D"
        return F.expr(f"count(*) OVER (PARTITION BY primary_page ORDER BY match_score "
                      f"RANGE BETWEEN {less} PRECEDING AND {less} FOLLOWING) - 1")
    own = flagged.where(F.col("primary_page").isNotNull()).select(
        "primary_page", within(RISK_HIGH).alias("near"), within(RISK_MEDIUM).alias("mid"),
        (F.count("*").over(Window.partitionBy("primary_page")) - 1).alias("all"))
    same = own.select(F.col("all").alias("t"), F.col("near").alias("h"), (F.col("mid") - F.col("near")).alias("m"),
                      F.lit(2).alias("by"))
    per = flagged.groupBy(F.col("primary_page").alias("runner_up_page")).agg(F.count("*").alias("n"))
    level = risk_level(F.abs(F.col("match_score") - F.col("runner_up_score")))
    runner = flagged.where(F.col("runner_up_page") != F.col("primary_page")).join(per, "runner_up_page").select(
        F.col("n").alias("t"), F.when(level == "High", F.col("n")).otherwise(0).alias("h"),
        F.when(level == "Medium", F.col("n")).otherwise(0).alias("m"), F.lit(1).alias("by"))
    both = same.union(runner)

    def total(c: str):
        return F.coalesce(F.sum(F.col(c) * (F.lit(2) / F.col("by"))) / 2, F.lit(0)).cast("long")
    return both.agg(total("t").alias("total_risks"), total("h").alias("high_risks"), total("m").alias("medium_risks"))
