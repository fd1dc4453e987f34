"""Cluster table.

One row per (cluster_id, topic_label, segment, brand_label, intent); after
a plural merge one cluster_id can carry several rows. Top-5 queries per
cluster use ``row_number <= 5`` (WindowGroupLimit: each partition keeps
its local top 5 per cluster before the shuffle, so a hot cluster costs
five rows per partition, not its whole size).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from clickgap.config import TOP_QUERIES_PER_CLUSTER
from clickgap.operators import score
from clickgap.session import materialize

CLUSTER_KEYS = ["cluster_id", "topic_label", "segment", "brand_label", "intent"]


def top_rows(q: DataFrame, cols: list[str], n: int = TOP_QUERIES_PER_CLUSTER) -> DataFrame:
    """(cluster_id, cols..., rank): the n highest-impression rows (input
    order on ties) of each cluster."""
    w = Window.partitionBy("cluster_id").orderBy(F.col("impressions").desc(), F.col("row_id").asc())
    names = list(dict.fromkeys(["cluster_id", *cols]))
    return (q.select(*dict.fromkeys([*names, "impressions", "row_id"]))
             .withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= n)
             .select(*names, "rank"))


def top_queries(q: DataFrame, text_col: str, sep: str, out: str,
                n: int = TOP_QUERIES_PER_CLUSTER) -> DataFrame:
    """(cluster_id, out): ``text_col`` of the cluster's ``top_rows``, joined
    by ``sep`` in rank order."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit("nan"))
    return (top_rows(q, [text_col], n).groupBy("cluster_id")
               .agg(F.sort_array(F.collect_list(F.struct("rank", text.alias("_t")))).alias("_l"))
               .select("cluster_id", F.array_join(F.col("_l._t"), sep).alias(out)))


def cluster_metrics(q: DataFrame) -> DataFrame:
    """A5: per cluster key: queries, clicks, impressions, avg_position,
    opportunity_clicks, priority_score (mean)."""
    keyed = q
    for k in CLUSTER_KEYS:
        keyed = keyed.filter(F.col(k).isNotNull())
    return keyed.groupBy(*CLUSTER_KEYS).agg(
        F.count("query").alias("queries"),
        F.sum("clicks").alias("clicks"),
        F.sum("impressions").alias("impressions"),
        F.avg("position").alias("avg_position"),
        F.sum("opportunity_clicks").alias("opportunity_clicks"),
        F.avg("priority_score").alias("priority_score"))


def aggregate_clusters(q: DataFrame) -> DataFrame:
    """Cluster table with example_queries, priority_band, dominant_intent."""
    cl = materialize(cluster_metrics(q).join(top_queries(q, "query", " | ", "example_queries"),
                                             "cluster_id", "left"))
    q70, q90 = score.score_quantiles(cl, "priority_score")
    return (cl.withColumn("priority_band", score.band(F.col("priority_score"), q70, q90))
              .withColumn("dominant_intent", F.col("intent")))
