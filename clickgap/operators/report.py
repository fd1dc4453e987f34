"""Report and view tables over the stored results (J8, J9, P36-P41,
A14-A21, T1-T7, S9, S10).

All are lazy DataFrames over the persisted pipeline outputs, so Catalyst
pushes the view filters below the joins. Top-k reports use
``orderBy(...).limit(k)`` (TakeOrderedAndProject: a per-partition top-k,
only k rows per partition move).
"""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from clickgap.config import (ACTION_EFFORT_ORDER, BRIEF_TOP_N, CHART_TOP_N, EFFORT_LABELS,
                             MD_MAX_CELL, UNKNOWN_EFFORT_LABEL, UNKNOWN_EFFORT_LEVEL)

KEYWORD_COLS = ["query", "cluster_id", "topic_label", "segment", "intent", "brand_label",
                "has_competitor", "has_local", "has_product_brand", "has_product_name",
                "clicks", "impressions", "ctr", "position",
                "opportunity_clicks", "priority_score", "priority_band", "primary_page"]
SORTABLE = ("clicks", "impressions", "opportunity_clicks", "position", "priority_score")


def _map(d: dict):
    return F.create_map(*[F.lit(x) for k, v in d.items() for x in (k, v)])


def keyword_table(q: DataFrame, cluster: DataFrame) -> DataFrame:
    """J8 + J9: every query with its cluster's intent / brand (query's own as
    fallback) and the topic of the cluster id's last row; fans out when a
    cluster id has several rows."""
    c = cluster.select("cluster_id", F.col("intent").alias("intent_cluster"),
                       F.col("brand_label").alias("brand_label_cluster"))
    topic = cluster.groupBy("cluster_id").agg(F.max_by(
        "topic_label", F.struct("topic_label", "segment", "brand_label", "intent")).alias("_topic"))
    out = (q.drop("topic_label").join(c, "cluster_id", "left").join(topic, "cluster_id", "left")
            .withColumn("intent", F.coalesce("intent_cluster", "intent"))
            .withColumn("brand_label", F.coalesce("brand_label_cluster", "brand_label"))
            .withColumn("topic_label", F.col("_topic")))
    return out.select(*[c for c in KEYWORD_COLS if c in out.columns])


def filter_in(df: DataFrame, col: str, values) -> DataFrame:
    """Multi-choice filter; an empty choice means no filter."""
    return df.filter(F.col(col).isin(list(values))) if values else df


def filter_eq(df: DataFrame, col: str, value: str | None) -> DataFrame:
    """Single choice; "All" means no filter."""
    return df if value in (None, "All") else df.filter(F.col(col) == value)


def sort_keywords(df: DataFrame, by: str = "opportunity_clicks", ascending: bool = False) -> DataFrame:
    """Sort by a metric, nulls last."""
    if by not in SORTABLE:
        raise ValueError(f"sort column must be one of {SORTABLE}")
    c = F.col(by)
    return df.orderBy(c.asc_nulls_last() if ascending else c.desc_nulls_last())


def option_lists(df: DataFrame, brands=(), topics=()) -> DataFrame:
    """Cascading option lists (option, value): brands; topics given the
    chosen brands; intents given brands and topics. Sorted, nulls dropped."""
    b = df.select(F.lit("brand").alias("option"), F.col("brand_label").alias("value"))
    t_src = filter_in(df, "brand_label", brands)
    t = t_src.select(F.lit("topic").alias("option"), F.col("topic_label").alias("value"))
    i = filter_in(t_src, "topic_label", topics).select(F.lit("intent").alias("option"), F.col("intent").alias("value"))
    return b.unionByName(t).unionByName(i).dropna().distinct().orderBy("option", "value")


def intent_opportunity(cluster: DataFrame, brand: str | None = "All") -> DataFrame:
    """Opportunity clicks per intent on the brand-filtered clusters."""
    return (filter_eq(cluster, "brand_label", brand).groupBy("intent")
            .agg(F.sum("opportunity_clicks").alias("opportunity_clicks"))
            .orderBy(F.col("opportunity_clicks").desc()))


def top_clusters(cluster: DataFrame, brand="All", intent="All", n: int = CHART_TOP_N) -> DataFrame:
    """T3 + P37 + P41: top clusters by opportunity with total potential, and
    the bubble size reference 2 * max(total_potential) / 80^2 of the set."""
    viz = filter_eq(filter_eq(cluster, "brand_label", brand), "intent", intent)
    top = viz.orderBy(F.col("opportunity_clicks").desc(), "cluster_id", "topic_label", "segment").limit(n)
    top = top.withColumn("total_potential", F.col("clicks") + F.col("opportunity_clicks"))
    # the window spans the <= n rows left after the limit
    return top.withColumn("size_ref", F.lit(2.0) * F.max("total_potential").over(Window.partitionBy())
                          / F.lit(80.0 ** 2))


def top_pages(page_all: DataFrame, n: int = BRIEF_TOP_N) -> DataFrame:
    """Pages by opportunity (page as tie-break)."""
    return page_all.orderBy(F.col("opportunity_clicks").desc(), "page").limit(n)


def effort_table(cluster: DataFrame) -> DataFrame:
    """P36 + T6: effort level / label per cluster, low effort first, then
    opportunity desc."""
    lvl = F.coalesce(_map(ACTION_EFFORT_ORDER)[F.col("recommended_action")], F.lit(UNKNOWN_EFFORT_LEVEL))
    lab = F.coalesce(_map(EFFORT_LABELS)[F.col("effort_level")], F.lit(UNKNOWN_EFFORT_LABEL))
    return (cluster.withColumn("effort_level", lvl).withColumn("effort_label", lab)
            .orderBy(F.col("effort_level").asc(), F.col("opportunity_clicks").desc(), "cluster_id"))


RISK_DISPLAY_COLS = ["primary_topic", "primary_intent", "competing_topic", "competing_intent",
                     "shared_page", "primary_match_score", "runner_up_match_score",
                     "score_difference", "risk_level"]
EFFORT_DISPLAY_COLS = ["effort_label", "recommended_action", "topic_label", "intent",
                       "opportunity_clicks", "priority_band", "primary_page", "avg_position"]


def display(df: DataFrame, cols: list[str]) -> DataFrame:
    """Project the display columns that exist, in display order."""
    return df.select(*[c for c in cols if c in df.columns])


def filtered_totals(cluster: DataFrame, keywords: DataFrame, brand="All", intent="All",
                    brands=(), topics=(), intents=()) -> DataFrame:
    """A15 + A16: opportunity clicks of the filtered clusters and the number
    of keywords left by the keyword filters, as one row."""
    c = filter_eq(filter_eq(cluster, "brand_label", brand), "intent", intent)
    k = filter_in(filter_in(filter_in(keywords, "brand_label", brands), "topic_label", topics), "intent", intents)
    # both totals in one aggregation over the union of the two filtered sets
    both = (c.select(F.col("opportunity_clicks").alias("_o"), F.lit(None).cast("long").alias("_k"))
             .unionByName(k.select(F.lit(None).cast("double").alias("_o"), F.lit(1).cast("long").alias("_k"))))
    return both.agg(F.sum("_o").alias("filtered_opportunity_clicks"), F.count("_k").alias("filtered_keywords"))


def effort_counts(effort: DataFrame) -> DataFrame:
    """Clusters per effort level (sorted by level) with its label."""
    return effort.groupBy("effort_level", "effort_label").agg(F.count("*").alias("clusters")) \
                 .orderBy("effort_level")


_NULLS = {"ignoreNullFields": "false"}
MD_DIGITS = 9       # places kept of a sum or mean before it is printed


def brief_json(cluster: DataFrame, page_all: DataFrame, client: str, brand_terms,
               generated: datetime | None = None) -> DataFrame:
    """One row, one JSON document: meta + top 20 pages + top 20 clusters
    (40 records folded in one aggregation). ``generated``: the time it
    states, in UTC (now, unless given)."""
    stamp = (generated or datetime.now(timezone.utc)).astimezone(timezone.utc).isoformat(timespec="microseconds")
    pages = top_pages(page_all).select(
        F.lit(0).alias("kind"), (-F.col("opportunity_clicks")).alias("k"), F.col("page").alias("t1"),
        F.lit("").alias("t2"), F.to_json(F.struct("slug", "opportunity_clicks", "avg_position"), _NULLS).alias("j"))
    clusters = (cluster.orderBy(F.col("opportunity_clicks").desc(), "cluster_id", "topic_label").limit(BRIEF_TOP_N)
                .select(F.lit(1).alias("kind"), (-F.col("opportunity_clicks")).alias("k"),
                        F.col("cluster_id").cast("string").alias("t1"), F.col("topic_label").alias("t2"),
                        F.to_json(F.struct("topic_label", "segment", "opportunity_clicks", "recommended_action",
                                           "example_queries"), _NULLS).alias("j")))
    meta = F.to_json(F.struct(
        F.lit(client).alias("client"),
        F.lit(stamp).alias("generated"),
        F.array(*[F.lit(t) for t in brand_terms]).cast("array<string>").alias("brand_terms")))
    items = pages.unionByName(clusters).agg(F.sort_array(F.collect_list(F.struct("kind", "k", "t1", "t2", "j"))).alias("l"))

    def part(kind: int):
        return F.array_join(F.transform(F.filter("l", lambda x: x["kind"] == kind), lambda x: x["j"]), ",")
    return items.select(F.concat(F.lit('{"meta":'), meta, F.lit(',"top_pages":['), part(0),
                                 F.lit('],"top_clusters":['), part(1), F.lit("]}")).alias("brief"))


def _cell(c):
    s = c.cast("string")
    return F.when(F.length(s) <= MD_MAX_CELL, s).otherwise(F.concat(F.left(s, F.lit(MD_MAX_CELL - 1)), F.lit("…")))


def _fixed(col: str, digits: int):
    """Fixed-point text as Python's ``f"{x:.{digits}f}"``: ``format_number``
    rounds the exact binary value half-to-even (``bround`` would round the
    shortest decimal form, so 3.45 -> 3.4 where Python prints 3.5); the
    grouping commas it adds are removed. A missing value prints "nan"."""
    return F.coalesce(F.regexp_replace(F.format_number(F.col(col), digits), ",", ""), F.lit("nan"))


def brief_markdown(page_all: DataFrame, client: str) -> DataFrame:
    """Markdown brief: title, heading, table of the top 20 pages
    (slug, opportunity '.0f', position '.1f', rounded as Python formats).
    Sums and means are first rounded to MD_DIGITS places: their last bits
    depend on the order of summation, and a mean of tenths often lies on the
    edge between two printed tenths."""
    shown = {f"_{c}": F.round(c, MD_DIGITS) for c in ("opportunity_clicks", "avg_position")}
    rows = top_pages(page_all).withColumns(shown).select(
        F.col("opportunity_clicks").alias("o"), "page",
        F.concat(F.lit("| "), F.concat_ws(" | ", _cell(F.col("slug")),
                                          _cell(_fixed("_opportunity_clicks", 0)),
                                          _cell(_fixed("_avg_position", 1))),
                 F.lit(" |")).alias("line"))
    body = rows.agg(F.sort_array(F.collect_list(F.struct((-F.col("o")).alias("k"), "page", "line"))).alias("l"))
    head = f"# SEO Brief: {client}\n\n## Top Opportunities\n| Page | Opp Clicks | Pos |\n| --- | --- | --- |\n"
    return body.select(F.concat(F.lit(head), F.array_join(F.col("l.line"), "\n")).alias("markdown"))
