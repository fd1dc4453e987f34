"""Cluster topic labels (M8) and singular/plural cluster merging (M9).

Labels: count every trigram and bigram occurrence of the cluster's
queries; among the 50 most common (count desc, then first occurrence in
input order - trigrams before bigrams within a query), keep those seen at
least max(2, int(0.3 * size)) times and take the highest count x words,
the earlier one on ties; otherwise the cluster's first query. All
group-by + ``row_number <= 50`` (planned as WindowGroupLimit, which trims
each cluster's candidates before the shuffle).

Plural merge: two clusters of the same intent merge when any word of one
topic is a singular/plural form of a word of the other. Instead of
testing all cluster pairs, each word is expanded to its plural forms and
matched by an equi-join on (intent, word) against the two smallest cluster
ids holding each word or form (no pair list). Each cluster moves to its
smallest matching lower id, one hop, and keeps its topic label.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from clickgap.config import (IRREGULAR_PLURALS, LABEL_MIN_COUNT, LABEL_SHARE,
                             LABEL_TOP_GRAMS)
from clickgap.functions.text import ngrams_indexed, split_words
from clickgap.session import materialize


def topic_labels(q: DataFrame) -> DataFrame:
    """(cluster_id, topic_label) from q (cluster_id, row_id, query_norm)."""
    toks = split_words(F.col("query_norm"))
    grams = q.select("cluster_id", "row_id", F.explode(F.concat(
        ngrams_indexed(toks, 3), ngrams_indexed(toks, 2))).alias("g"))
    counted = grams.groupBy("cluster_id", F.col("g.gram").alias("gram")).agg(
        F.count("*").alias("cnt"),
        F.min(F.struct(F.col("row_id"), (-F.col("g.n")).alias("nn"), F.col("g.pos"))).alias("first"),
        F.first(F.col("g.n")).alias("n"))
    top = Window.partitionBy("cluster_id").orderBy(F.col("cnt").desc(), F.col("first").asc())
    ranked = counted.withColumn("rank", F.row_number().over(top)).filter(F.col("rank") <= LABEL_TOP_GRAMS)
    sizes = q.groupBy("cluster_id").agg(
        F.count("*").alias("size"),
        F.min_by("query_norm", "row_id").alias("fallback"))
    thr = F.greatest(F.lit(LABEL_MIN_COUNT), F.floor(F.lit(LABEL_SHARE) * F.col("size")))
    best = (ranked.join(sizes.select("cluster_id", "size"), "cluster_id")
            .filter(F.col("cnt") >= thr)
            .groupBy("cluster_id")
            .agg(F.max_by("gram", F.struct((F.col("cnt") * F.col("n")).alias("score"),
                                           (-F.col("rank")).alias("r"))).alias("best")))
    return (sizes.join(best, "cluster_id", "left")
            .select("cluster_id", F.coalesce("best", "fallback").alias("topic_label")))


def label_clusters(q: DataFrame) -> DataFrame:
    return q.join(topic_labels(q.select("cluster_id", "row_id", "query_norm")), "cluster_id")


def _y_to_ies(word):
    return F.concat(F.regexp_replace(word, "y$", ""), F.lit("ies"))


def _two_smallest(t: DataFrame) -> DataFrame:
    """(intent, key, m1, m2): the two smallest cluster ids holding ``key``
    (bounded aggregation: no per-key list is ever collected)."""
    m1 = t.groupBy("intent", "key").agg(F.min("cluster_id").alias("m1"))
    m2 = (t.join(m1, ["intent", "key"]).filter(F.col("cluster_id") > F.col("m1"))
           .groupBy("intent", "key").agg(F.min("cluster_id").alias("m2")))
    return m1.join(m2, ["intent", "key"], "left")


def merge_plural_clusters(q: DataFrame) -> DataFrame:
    """q (cluster_id, intent, topic_label, ...) -> q with merged cluster_id.

    Side W holds (cluster, word of its topic), side P (cluster, plural form
    of a word). Clusters match when a P key equals a W key. The smallest
    partner of cluster c through key k is the smallest id on the other
    side, or the second smallest when that is c itself; so the smallest
    lower partner needs only the two smallest ids per key - no pair list,
    even when one word occurs in a third of all topics.
    """
    topics = q.groupBy("intent", "cluster_id").agg(F.first("topic_label", ignorenulls=True).alias("t"))
    words = topics.select("intent", "cluster_id", F.explode(F.array_distinct(
        F.filter(F.split(F.lower(F.col("t")), r"\s+"), lambda w: w != ""))).alias("key"))
    irregular = F.create_map(*[F.lit(x) for k, v in IRREGULAR_PLURALS.items() for x in (k, v, v, k)])
    w = F.col("key")
    forms = words.select("intent", "cluster_id", F.explode(F.array_distinct(F.filter(F.array(
        F.concat(w, F.lit("s")), F.concat(w, F.lit("es")),
        F.when(w.endswith("y"), _y_to_ies(w)), irregular[w]), lambda x: x.isNotNull()))).alias("key"))
    words, forms = materialize(words), materialize(forms)
    best_w, best_p = _two_smallest(words), _two_smallest(forms)

    def partner(side: DataFrame, other: DataFrame) -> DataFrame:
        return side.join(other, ["intent", "key"]).select(
            "cluster_id", F.when(F.col("m1") == F.col("cluster_id"), F.col("m2"))
                           .otherwise(F.col("m1")).alias("p"))

    cand = partner(forms, best_w).unionByName(partner(words, best_p))
    moves = (cand.filter(F.col("p").isNotNull() & (F.col("p") < F.col("cluster_id")))
                 .groupBy("cluster_id").agg(F.min("p").alias("new_id")))
    return (q.join(moves, "cluster_id", "left")
             .withColumn("cluster_id", F.coalesce("new_id", "cluster_id")).drop("new_id"))
