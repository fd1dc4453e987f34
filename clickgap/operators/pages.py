"""Cluster-to-page matching and page opportunity tables (J4-J7, J11, W4,
A6, A7, P31-P34, U1).

Match: one TF-IDF (1-3-grams, no pruning) over cluster texts and page
texts together; scores come from an inverted-index join on shared terms,
so only positive pairs exist, in rounds from rare to frequent terms that
stop by a bound (``match_scores``). The best page on all-zero scores is the
first page, so the first two pages by ``page_ord`` join every cluster
with score 0 (two literal page ids); then ``row_number`` by (score desc,
page_ord) picks primary (1) and runner-up (2). Two fillers suffice: either
two pages score above 0, or a zero-scored page of lowest order is among
them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from clickgap.config import (ACTION_CONTENT_REFRESH, ACTION_CTR_SNIPPET, ACTION_FIX_CANNIBAL,
                             ACTION_LANDING_PAGE, CANNIBAL_GAP, CANNIBAL_MIN_MATCH)
from clickgap.operators.aggregate import CLUSTER_KEYS, top_queries
from clickgap.operators.similarity import dot_products
from clickgap.operators.tfidf import tfidf
from clickgap.session import materialize


def cluster_text(cluster: DataFrame, q: DataFrame) -> DataFrame:
    """lower(topic + ' ' + intent + ' ' + top-5 query_norm), with a doc key."""
    rep = top_queries(q, "query_norm", " ", "rep")
    return (cluster.join(rep, "cluster_id", "left")
            .withColumn("cluster_text", F.lower(F.concat_ws(" ", F.col("topic_label"),
                                                            F.col("dominant_intent"),
                                                            F.coalesce(F.col("rep"), F.lit("")))))
            .withColumn("ckey", F.to_json(F.struct(*CLUSTER_KEYS)))
            .drop("rep"))


def match_scores(cl: DataFrame, pages: DataFrame, rare_df: int = 1000) -> DataFrame:
    """(ckey, page_ord, score) holding every pair that can reach a cluster's
    top two, with exact scores.

    Rounds over the term lists, rare ones first. Round 0 joins the terms of
    at most ``rare_df`` pages, so each cluster term meets a bounded number
    of pages. The lists of the other terms are cut by impact: list part j
    holds the pages where the term's weight is in [2^-(j+1), 2^-j). Round
    j + 1 takes part j of all of them. A page that a cluster has not met
    after that weighs less than 2^-(j+1) in each of these terms, so its score
    is below sum(w_c * min(largest weight, 2^-(j+1))); a cluster whose
    second-best score is above this bound stops. A page once met gets its
    exact score by lookup (in round 0 only if it can still be second).
    """
    docs = (cl.select(F.lit("c").alias("side"), F.col("ckey").alias("doc"), F.col("cluster_text").alias("text"))
              .unionByName(pages.select(F.lit("p").alias("side"), F.col("page_ord").cast("string").alias("doc"),
                                        F.col("page_text").alias("text"))))
    docs = docs.withColumn("doc", F.concat_ws(":", "side", "doc"))
    w, _ = tfidf(docs, "doc", "text", [], max_df=None)
    w = materialize(w)
    cw = w.filter(F.col("doc").startswith("c:")).select(F.expr("substring(doc, 3)").alias("ckey"), "term", "w")
    pw = w.filter(F.col("doc").startswith("p:")).select(F.expr("substring(doc, 3)").cast("long").alias("page_ord"),
                                                        "term", "w")
    frequent = materialize(pw.groupBy("term").agg(F.count("*").alias("pdf"), F.max("w").alias("maxw"))
                             .where(F.col("pdf") > rare_df).select("term", "maxw"))
    if frequent.isEmpty():
        return dot_products(cw, pw, "ckey", "page_ord")
    partial = materialize(dot_products(cw.join(frequent, "term", "left_anti"), pw.join(frequent, "term", "left_anti"),
                                       "ckey", "page_ord"))
    lists = materialize(pw.join(frequent.select("term"), "term").withColumn("part", F.floor(-F.log2("w")).cast("int")))
    terms = materialize(cw.join(frequent, "term"))

    def bound(top: float) -> DataFrame:
        """Per cluster: what unmet pages can score with weights up to ``top``."""
        return terms.groupBy("ckey").agg(F.sum(F.col("w") * F.least("maxw", F.lit(top))).alias("rest"))

    def running(met: DataFrame, top: float) -> DataFrame:
        """Clusters whose bound is not below their second-best score; equal
        scores (to 12 places) go by page order, so those go on."""
        second = _second(met)
        return bound(top).join(second, "ckey", "left") \
            .where(F.col("rest") >= F.coalesce("second", F.lit(0.0)) - 1e-9).select("ckey")

    hopeful = partial.join(bound(1.0), "ckey", "left").join(_second(partial), "ckey", "left") \
        .where(F.col("score") + F.coalesce("rest", F.lit(0.0)) >= F.coalesce("second", F.lit(0.0)) - 1e-9)
    more = (hopeful.select("ckey", "page_ord").join(terms.select("ckey", "term", F.col("w").alias("wc")), "ckey")
                   .join(lists.select("page_ord", "term", "w"), ["page_ord", "term"])
                   .groupBy("ckey", "page_ord").agg(F.sum(F.col("wc") * F.col("w")).alias("more")))
    met = materialize(hopeful.join(more, ["ckey", "page_ord"], "left")
                             .select("ckey", "page_ord", (F.col("score") + F.coalesce("more", F.lit(0.0))).alias("score")))
    parts = sorted(r["part"] for r in lists.select("part").distinct().collect())    # one a power of two
    top = 1.0
    for part in parts:
        active = materialize(running(met, top))
        if active.isEmpty():
            break
        new = (terms.join(active, "ckey", "left_semi").select("ckey", "term")
                    .join(lists.where(F.col("part") == part).select("term", "page_ord"), "term")
                    .select("ckey", "page_ord").distinct().join(met, ["ckey", "page_ord"], "left_anti"))
        exact = (new.join(cw.select("ckey", "term", F.col("w").alias("wc")), "ckey").join(pw, ["page_ord", "term"])
                    .groupBy("ckey", "page_ord").agg(F.sum(F.col("wc") * F.col("w")).alias("score")))
        met = met.unionByName(materialize(exact))
        top = 2.0 ** -(part + 1)
    return met


def _second(scores: DataFrame) -> DataFrame:
    """(ckey, second): second-best score of each cluster that has two."""
    rank = Window.partitionBy("ckey").orderBy(F.col("score").desc())
    return scores.withColumn("_r", F.row_number().over(rank)).where("_r = 2").select("ckey", F.col("score").alias("second"))


def best_two(cl: DataFrame, pages: DataFrame, scores: DataFrame) -> DataFrame:
    """(ckey, primary_page, match_score, runner_up_page, runner_up_score)."""
    first2 = [r[0] for r in pages.select("page_ord").orderBy("page_ord").limit(2).collect()]
    if not first2:
        raise ValueError("no pages to match clusters against")
    zero = None
    for po in first2:   # two scalars: every cluster also scores 0 on the first two pages
        z = cl.select("ckey", F.lit(po).cast("long").alias("page_ord"), F.lit(0.0).alias("score"))
        zero = z if zero is None else zero.unionByName(z)
    cand = (scores.unionByName(zero).groupBy("ckey", "page_ord").agg(F.max("score").alias("score")))
    # scores equal to 12 places are ties (summation order moves the last bits)
    w = Window.partitionBy("ckey").orderBy(F.bround("score", 12).desc(), F.col("page_ord").asc())
    top = cand.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= 2) \
              .join(pages.select("page_ord", "page"), "page_ord")
    return top.groupBy("ckey").agg(
        F.max(F.when(F.col("_r") == 1, F.col("page"))).alias("primary_page"),
        F.max(F.when(F.col("_r") == 1, F.col("score"))).alias("match_score"),
        F.max(F.when(F.col("_r") == 2, F.col("page"))).alias("runner_up_page"),
        F.coalesce(F.max(F.when(F.col("_r") == 2, F.col("score"))), F.lit(0.0)).alias("runner_up_score"))


def recommended_action(flag, intent, pos):
    return (F.when(flag, ACTION_FIX_CANNIBAL)
             .when((intent == "transactional") & (pos > 10), ACTION_LANDING_PAGE)
             .when(pos <= 10, ACTION_CTR_SNIPPET)
             .otherwise(ACTION_CONTENT_REFRESH))


def map_clusters_to_pages(q: DataFrame, cluster: DataFrame, pages: DataFrame,
                          rare_df: int = 1000) -> tuple[DataFrame, DataFrame]:
    """Returns (q + primary_page, cluster + text, match, runner-up, flag, action)."""
    cl = materialize(cluster_text(cluster, q))
    scores = match_scores(cl, pages, rare_df)
    top = best_two(cl, pages, scores)
    flag = ((F.col("match_score") - F.col("runner_up_score") < F.lit(CANNIBAL_GAP))
            & (F.col("match_score") > F.lit(CANNIBAL_MIN_MATCH)))
    out = materialize(cl.join(top, "ckey", "left")
                      .withColumn("cannibalisation_risk", flag)
                      .withColumn("recommended_action", recommended_action(
                          F.col("cannibalisation_risk"), F.col("dominant_intent"), F.col("avg_position")))
                      .drop("ckey"))
    # duplicate cluster ids: the last row in key order wins
    page_of = out.groupBy("cluster_id").agg(
        F.max_by("primary_page", F.struct("topic_label", "segment", "brand_label", "intent")).alias("primary_page"))
    return q.join(page_of, "cluster_id", "left"), out


PAGE_COLS_ALL = ["page", "slug", "page_impressions", "page_clicks", "page_ctr", "page_position"]


def page_opportunity_all(cluster: DataFrame, pages: DataFrame) -> DataFrame:
    """A6 + J4: per primary page over clusters, page metrics joined (left)."""
    agg = cluster.groupBy(F.col("primary_page").alias("page")).agg(
        F.count("cluster_id").alias("clusters"),
        F.sum("impressions").alias("impressions"),
        F.sum("clicks").alias("actual_clicks"),
        F.sum("opportunity_clicks").alias("opportunity_clicks"),
        F.avg("avg_position").alias("avg_position")).filter(F.col("page").isNotNull())
    return (agg.join(pages.select(*PAGE_COLS_ALL), "page", "left")
               .withColumn("ctr", F.try_divide(F.col("actual_clicks"), F.col("impressions"))))


def page_opportunity_segment(q: DataFrame, pages: DataFrame) -> DataFrame:
    """A7 + J5: per (page, segment, brand, intent) over queries."""
    keys = [F.col("primary_page").alias("page"), "segment", "brand_label", "intent"]
    agg = q.filter(F.col("primary_page").isNotNull()).groupBy(*keys).agg(
        F.sum("impressions").alias("impressions"),
        F.sum("clicks").alias("actual_clicks"),
        F.sum("opportunity_clicks").alias("opportunity_clicks"),
        F.avg("position").alias("avg_position"))
    return (agg.withColumn("ctr", F.try_divide(F.col("actual_clicks"), F.col("impressions")))
               .join(pages.select("page", "slug", "page_clicks", "page_impressions", "page_ctr",
                                  "page_position"), "page", "left"))
