"""Registered queries: one per operator family, each with a DuckDB oracle
where SQL can state it.

Every query reads the driver's tables (or the fixture views derived from
them) in full and runs the library's operators on them. Doubles are
rounded to 6 places on output, as the oracles do.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clickgap.config import CTR_FLOOR
from clickgap.operators import enrich, score
from clickgap.plans import oracle_sql as O
from clickgap.session import materialize
from clickgap.sources import fixtures as X

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return deco


def r6(c: str | Column) -> Column:
    col = F.col(c) if isinstance(c, str) else c
    return F.round(col, 6)


# --- shared inputs (lazy; cached per session + sf within one call chain) ---

def enriched(spark: SparkSession, sf: str) -> DataFrame:
    return enrich.preprocess_queries(X.search_queries(spark, sf), X.FIXTURE_CONFIG)


def scored(spark: SparkSession, sf: str) -> DataFrame:
    q = enriched(spark, sf)
    return score.score_queries(q)


def W(ctes: str, body: str) -> str:
    return O.with_ctes(ctes, body)


# ---------------------------------------------------------------------------
# 1. minimum slice: missed clicks per segment
# ---------------------------------------------------------------------------

@register("missed_clicks_by_segment", W(O.SCORED_CTES, """
SELECT segment, count(*) AS queries, sum(clicks) AS clicks, sum(impressions) AS impressions,
       round(sum(opportunity_clicks), 6) AS opportunity_clicks
FROM scored GROUP BY segment"""))
def missed_clicks_by_segment(spark, sf):
    q = score.opportunity(enriched(spark, sf))
    return q.groupBy("segment").agg(
        F.count("*").alias("queries"), F.sum("clicks").alias("clicks"),
        F.sum("impressions").alias("impressions"),
        r6(F.sum("opportunity_clicks")).alias("opportunity_clicks"))


# ---------------------------------------------------------------------------
# 2. per-row layer
# ---------------------------------------------------------------------------

@register("ctr_parse_backfill", W(O.ENRICHED_CTES, """
SELECT row_id, ctr_raw, clicks, impressions,
       round(CASE WHEN ctr0 IS NULL AND impressions > 0 THEN clicks / impressions ELSE ctr0 END, 6) AS ctr
FROM parsed"""))
def ctr_parse_backfill(spark, sf):
    q = enrich.parse_query_metrics(X.search_queries(spark, sf))
    return q.select("row_id", "ctr_raw", "clicks", "impressions", r6("ctr").alias("ctr"))


@register("query_normalize", """
SELECT doc_id, line_no, """ + O.NORMALIZE.format(c="line") + """ AS query_norm
FROM (SELECT doc_id, generate_subscripts(parts, 1) - 1 AS line_no, unnest(parts) AS line
      FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents))""")
def query_normalize(spark, sf):
    from clickgap.functions.text import normalize_query
    docs = X.table(spark, sf, "documents").select(
        "doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return docs.select("doc_id", F.col("line_no").cast("long").alias("line_no"),
                       normalize_query(F.col("line")).alias("query_norm"))


@register("exclusion_filter", W(O.ENRICHED_CTES, """
SELECT row_id, query_norm FROM kept"""))
def exclusion_filter(spark, sf):
    q = enrich.parse_query_metrics(X.search_queries(spark, sf))
    return enrich.exclude_terms(q, X.FIXTURE_CONFIG).select("row_id", "query_norm")


@register("brand_and_term_flags", W(O.ENRICHED_CTES, """
SELECT row_id, is_branded, brand_label, has_competitor, has_local, has_product_brand, has_product_name,
       CASE WHEN has_competitor THEN 'Competitor' ELSE '' END AS competitor_label,
       CASE WHEN has_product_brand THEN 'ProductBrand' ELSE '' END AS product_brand_label,
       CASE WHEN has_product_name THEN 'ProductName' ELSE '' END AS product_name_label
FROM enriched"""))
def brand_and_term_flags(spark, sf):
    return enriched(spark, sf).select(
        "row_id", "is_branded", "brand_label", "has_competitor", "has_local", "has_product_brand",
        "has_product_name", "competitor_label", "product_brand_label", "product_name_label")


@register("intent_classify", W(O.ENRICHED_CTES, """
SELECT row_id, intent,
       list_filter([CASE WHEN m_nav THEN 'navigational' END, CASE WHEN m_tra THEN 'transactional' END,
                    CASE WHEN m_com THEN 'commercial' END, CASE WHEN m_inf THEN 'informational' END],
                   lambda x: x IS NOT NULL) AS matched_intents
FROM enriched"""))
def intent_classify(spark, sf):
    return enriched(spark, sf).select("row_id", "intent", "matched_intents")


@register("intent_confidence", W(O.ENRICHED_CTES, """
SELECT row_id, round(intent_confidence, 6) AS intent_confidence FROM enriched"""))
def intent_confidence(spark, sf):
    return enriched(spark, sf).select("row_id", r6("intent_confidence").alias("intent_confidence"))


@register("segment_key", W(O.ENRICHED_CTES, """
SELECT row_id, segment FROM seg"""))
def segment_key(spark, sf):
    return enriched(spark, sf).select("row_id", "segment")


@register("position_bucket", W(O.SCORED_CTES, """
SELECT row_id, round(position, 6) AS position, pos_bucket FROM b"""))
def position_bucket(spark, sf):
    from clickgap.functions.numeric import pos_bucket
    q = enriched(spark, sf)
    return q.select("row_id", r6("position").alias("position"),
                    pos_bucket(F.col("position")).alias("pos_bucket"))


@register("bucket_median_ctr", W(O.SCORED_CTES, """
SELECT f.pos_bucket, round(med.m, 6) AS median_ctr, round(e.expected_ctr, 6) AS expected_ctr
FROM floors f LEFT JOIN med ON med.pos_bucket = f.pos_bucket JOIN expct e ON e.pos_bucket = f.pos_bucket"""))
def bucket_median_ctr(spark, sf):
    from clickgap.functions.numeric import pos_bucket
    from clickgap.operators.quantiles import medians
    q = enriched(spark, sf).select("position", "ctr").persist()
    med = medians(q.select(pos_bucket(F.col("position")).alias("pos_bucket"), "ctr"), ["pos_bucket"], "ctr")
    exp = score.bucket_expectations(q)
    rows = [(b, med.get((b,)), exp[b]) for b in CTR_FLOOR]
    q.unpersist()
    out = spark.createDataFrame(rows, "pos_bucket string, median_ctr double, expected_ctr double")
    return out.select("pos_bucket", r6("median_ctr").alias("median_ctr"), r6("expected_ctr").alias("expected_ctr"))


@register("expected_ctr", W(O.SCORED_CTES, """
SELECT row_id, pos_bucket, round(expected_ctr, 6) AS expected_ctr FROM scored"""))
def expected_ctr(spark, sf):
    q = score.opportunity(enriched(spark, sf))
    return q.select("row_id", "pos_bucket", r6("expected_ctr").alias("expected_ctr"))


@register("opportunity_clicks", W(O.SCORED_CTES, """
SELECT row_id, round(opportunity_clicks, 6) AS opportunity_clicks FROM scored"""))
def opportunity_clicks(spark, sf):
    q = score.opportunity(enriched(spark, sf))
    return q.select("row_id", r6("opportunity_clicks").alias("opportunity_clicks"))


@register("priority_score", W(O.SCORED_CTES, """
SELECT row_id, round(priority_score, 6) AS priority_score FROM scored2"""))
def priority_score(spark, sf):
    q = score.opportunity(enriched(spark, sf))
    return q.select("row_id", r6("priority_score").alias("priority_score"))


@register("priority_band", W(O.SCORED_CTES, """
SELECT row_id, priority_band FROM banded"""))
def priority_band(spark, sf):
    return score.score_queries(enriched(spark, sf)).select("row_id", "priority_band")


_URL_PATH_SQL = (r"regexp_replace(regexp_replace(regexp_extract(regexp_replace(regexp_replace(url, '[\t\r\n]', '', 'g'), "
                 r"'^[\x00-\x20]+', ''), '^(?:[a-zA-Z][a-zA-Z0-9+.\-]*:)?(?://[^/?#]*)?([^?#]*)', 1), "
                 r"';[^/]*$', ''), '^/+|/+$', '', 'g')")


@register("url_slug", f"""
SELECT page_id, url, CASE WHEN p = '' THEN 'home' ELSE p END AS slug
FROM (SELECT page_id, url, {_URL_PATH_SQL} AS p FROM pages)""")
def url_slug(spark, sf):
    from clickgap.functions.text import url_slug as slug
    pages = X.table(spark, sf, "pages").select("page_id", "url")
    return pages.select("page_id", "url", slug(F.col("url")).alias("slug"))


@register("url_tokens", f"""
SELECT page_id, toks AS page_tokens, array_to_string(toks, ' ') AS page_text
FROM (SELECT page_id, CASE WHEN p = '' THEN ['home'] ELSE
        list_filter(list_transform(regexp_split_to_array(p, '[/\\-_]+'),
                                   lambda t: regexp_replace(lower(t), '[^a-z0-9]', '', 'g')),
                    lambda t: t <> '' AND t NOT IN ('amp', 'utm', 'http', 'https', 'www', 'com')) END AS toks
      FROM (SELECT page_id, {_URL_PATH_SQL} AS p FROM pages))""")
def url_tokens(spark, sf):
    from clickgap.functions.text import url_tokens as toks
    pages = X.table(spark, sf, "pages").select("page_id", "url")
    return pages.select("page_id", toks(F.col("url")).alias("page_tokens")) \
                .withColumn("page_text", F.array_join("page_tokens", " "))


# ---------------------------------------------------------------------------
# 3. TF-IDF, similarity pairs, components, clusters
# ---------------------------------------------------------------------------

def _texts(spark, sf):
    from clickgap.operators import cluster
    return cluster.text_table(enriched(spark, sf).select("segment", "row_id", "query_norm"))


@register("tfidf_segment", W(O.TFIDF_CTES, """
SELECT segment, query_norm, term, tf, df, round(w, 6) AS w FROM tw"""))
def tfidf_segment(spark, sf):
    from clickgap.operators import cluster
    texts = _texts(spark, sf)
    w, _ = cluster.segment_vectors(texts)
    return (w.join(texts.select("segment", "rep", "query_norm"), ["segment", "rep"])
             .select("segment", "query_norm", "term", "tf", "df", r6("w").alias("w")))


@register("tfidf_doc_freq", W(O.TFIDF_CTES, """
SELECT segment, term, df, n_docs, round(idf, 6) AS idf, kept FROM tterms"""))
def tfidf_doc_freq(spark, sf):
    from clickgap.operators import cluster
    from clickgap.operators.tfidf import term_table
    _, terms = term_table(_texts(spark, sf), "rep", "query_norm", ["segment"], cluster.MAX_DF, "mult")
    return terms.select("segment", "term", "df", "n_docs", r6("idf").alias("idf"), "kept")


@register("query_similarity_pairs", W(O.TFIDF_CTES + O.PAIRS_CTES, """
SELECT segment, a, b, round(sim, 6) AS sim FROM pairs"""))
def query_similarity_pairs(spark, sf):
    from clickgap.operators import cluster
    w, _ = cluster.segment_vectors(_texts(spark, sf))
    return cluster.text_pairs(materialize(w), X.FIXTURE_CONFIG.threshold).select(
        "segment", "a", "b", r6("sim").alias("sim"))


@register("similarity_components", W(O.TFIDF_CTES + O.PAIRS_CTES + O.COMPONENT_CTES, """
SELECT rep, component FROM comp"""))
def similarity_components(spark, sf):
    from clickgap.operators import cluster
    from clickgap.operators.components import connected_components
    w, _ = cluster.segment_vectors(_texts(spark, sf))
    w = materialize(w)
    edges = cluster.text_pairs(w, X.FIXTURE_CONFIG.threshold)
    comp = connected_components(edges, "a", "b")
    nodes = w.select("rep").distinct()
    return (nodes.join(comp.withColumnRenamed("id", "rep"), "rep", "left")
                 .select("rep", F.coalesce("component", "rep").alias("component")))


@register("segment_clusters", W(O.LINK_CTES, """
SELECT row_id, segment, cluster_id FROM clustered"""))
def segment_clusters(spark, sf):
    """Exact stratified average linkage."""
    from clickgap.operators import cluster
    return cluster.cluster_queries(enriched(spark, sf), X.FIXTURE_CONFIG).select(
        "row_id", "segment", "cluster_id")


@register("kmeans_clusters")
def kmeans_clusters(spark, sf):
    """k-means path forced on every segment (the > 10,000-row branch)."""
    from dataclasses import replace

    from clickgap.operators import cluster
    cfg = replace(X.FIXTURE_CONFIG, method="kmeans")
    return cluster.cluster_queries(enriched(spark, sf), cfg).select("row_id", "segment", "cluster_id")


@register("embedding_clusters", W(O.EMBEDDING_LINK_CTES, """
SELECT e.vec_id, e.label, coalesce(l.c, e.vec_id) AS cluster_id
FROM embeddings e LEFT JOIN linked l ON l.rep = e.vec_id"""))
def embedding_clusters(spark, sf):
    """Semantic path on the embeddings table, label as the segment."""
    from clickgap.operators import cluster
    emb = X.table(spark, sf, "embeddings")
    return cluster.cluster_embeddings(emb, "label", "vec_id", "embedding", X.FIXTURE_CONFIG) \
                  .join(emb.select("vec_id", "label"), "vec_id")


# ---------------------------------------------------------------------------
# 4. labels, merge, cluster table (on a surrogate cluster id SQL can state:
#    min row_id per segment and last word; the operators are the library's)
# ---------------------------------------------------------------------------

def surrogate(spark, sf) -> DataFrame:
    """Enriched + scored queries with the surrogate cluster id and labels."""
    from clickgap.operators import label
    q = X.surrogate_clusters(enriched(spark, sf))
    return materialize(score.score_queries(label.label_clusters(q)))


def surrogate_clusters_table(spark, sf):
    from clickgap.operators import aggregate
    q = surrogate(spark, sf)
    return q, aggregate.aggregate_clusters(q)


def surrogate_mapped(spark, sf):
    from clickgap.operators import pages
    q, cl = surrogate_clusters_table(spark, sf)
    p = materialize(enrich.preprocess_pages(X.search_pages(spark, sf)))
    qf, cf = pages.map_clusters_to_pages(q, cl, p)
    return materialize(qf), cf, p


@register("topic_labels", W(O.LABEL_CTES, """
SELECT cluster_id, topic_label FROM topics"""))
def topic_labels(spark, sf):
    from clickgap.operators import label
    q = X.surrogate_clusters(enriched(spark, sf))
    return label.topic_labels(q.select("cluster_id", "row_id", "query_norm"))


@register("plural_merge", W(O.LABEL_CTES + O.MERGE_CTES, """
SELECT row_id, cluster_id FROM merged"""))
def plural_merge(spark, sf):
    from clickgap.operators import label
    q = label.label_clusters(X.surrogate_clusters(enriched(spark, sf)))
    return label.merge_plural_clusters(q).select("row_id", "cluster_id")


@register("cluster_metrics", W(O.CLUSTER_CTES, """
SELECT cluster_id, topic_label, segment, brand_label, intent, queries, clicks, impressions,
       round(avg_position, 6) AS avg_position, round(opportunity_clicks, 6) AS opportunity_clicks,
       round(priority_score, 6) AS priority_score FROM cm"""))
def cluster_metrics(spark, sf):
    from clickgap.operators import aggregate
    m = aggregate.cluster_metrics(surrogate(spark, sf))
    return m.select(*aggregate.CLUSTER_KEYS, "queries", "clicks", "impressions",
                    r6("avg_position").alias("avg_position"), r6("opportunity_clicks").alias("opportunity_clicks"),
                    r6("priority_score").alias("priority_score"))


@register("cluster_band", W(O.CLUSTER_CTES, """
SELECT cluster_id, topic_label, priority_band, dominant_intent FROM ct"""))
def cluster_band(spark, sf):
    _, cl = surrogate_clusters_table(spark, sf)
    return cl.select("cluster_id", "topic_label", "priority_band", "dominant_intent")


@register("top5_queries_per_cluster", W(O.CLUSTER_CTES, """
SELECT cluster_id, row_id, rn AS rank FROM ranked5 WHERE rn <= 5"""))
def top5_queries_per_cluster(spark, sf):
    from clickgap.operators import aggregate
    return aggregate.top_rows(surrogate(spark, sf), ["row_id"])


@register("example_queries", W(O.CLUSTER_CTES, """
SELECT cluster_id, example_queries FROM ex"""))
def example_queries(spark, sf):
    from clickgap.operators import aggregate
    return aggregate.top_queries(surrogate(spark, sf), "query", " | ", "example_queries")


# ---------------------------------------------------------------------------
# 5. page match, actions, page tables
# ---------------------------------------------------------------------------

@register("cluster_page_match", W(O.MATCH_CTES, """
SELECT cluster_id, topic_label, segment, primary_page, round(match_score, 6) AS match_score,
       runner_up_page, round(runner_up_score, 6) AS runner_up_score FROM cf"""))
def cluster_page_match(spark, sf):
    _, cf, _ = surrogate_mapped(spark, sf)
    return cf.select("cluster_id", "topic_label", "segment", "primary_page", r6("match_score").alias("match_score"),
                     "runner_up_page", r6("runner_up_score").alias("runner_up_score"))


@register("cannibalisation_flag", W(O.MATCH_CTES, """
SELECT cluster_id, topic_label, cannibalisation_risk FROM cf"""))
def cannibalisation_flag(spark, sf):
    _, cf, _ = surrogate_mapped(spark, sf)
    return cf.select("cluster_id", "topic_label", "cannibalisation_risk")


@register("recommended_action", W(O.MATCH_CTES, """
SELECT cluster_id, topic_label, recommended_action FROM cf"""))
def recommended_action(spark, sf):
    _, cf, _ = surrogate_mapped(spark, sf)
    return cf.select("cluster_id", "topic_label", "recommended_action")


@register("page_totals", W(O.MATCH_CTES + O.PAGE_TABLE_CTES, """
SELECT page, clusters, impressions, actual_clicks, round(opportunity_clicks, 6) AS opportunity_clicks,
       round(avg_position, 6) AS avg_position, slug, page_impressions, page_clicks,
       round(page_ctr, 6) AS page_ctr, round(page_position, 6) AS page_position, round(ctr, 6) AS ctr
FROM pall"""))
def page_totals(spark, sf):
    from clickgap.operators import pages
    _, cf, p = surrogate_mapped(spark, sf)
    t = pages.page_opportunity_all(cf, p)
    return t.select("page", "clusters", "impressions", "actual_clicks", r6("opportunity_clicks").alias("opportunity_clicks"),
                    r6("avg_position").alias("avg_position"), "slug", "page_impressions", "page_clicks",
                    r6("page_ctr").alias("page_ctr"), r6("page_position").alias("page_position"), r6("ctr").alias("ctr"))


@register("page_segment_totals", W(O.MATCH_CTES + O.PAGE_TABLE_CTES, """
SELECT page, segment, brand_label, intent, impressions, actual_clicks,
       round(opportunity_clicks, 6) AS opportunity_clicks, round(avg_position, 6) AS avg_position,
       round(ctr, 6) AS ctr, slug, page_clicks, page_impressions, round(page_ctr, 6) AS page_ctr,
       round(page_position, 6) AS page_position
FROM pseg"""))
def page_segment_totals(spark, sf):
    from clickgap.operators import pages
    qf, _, p = surrogate_mapped(spark, sf)
    t = pages.page_opportunity_segment(qf, p)
    return t.select("page", "segment", "brand_label", "intent", "impressions", "actual_clicks",
                    r6("opportunity_clicks").alias("opportunity_clicks"), r6("avg_position").alias("avg_position"),
                    r6("ctr").alias("ctr"), "slug", "page_clicks", "page_impressions",
                    r6("page_ctr").alias("page_ctr"), r6("page_position").alias("page_position"))


# ---------------------------------------------------------------------------
# 6. risk, effort, keyword views, reports
# ---------------------------------------------------------------------------

_RISK_OUT = ["primary_cluster_id", "primary_topic", "primary_intent", "competing_cluster_id",
             "competing_topic", "competing_intent", "shared_page"]


def _risk_select(df):
    return df.select(*_RISK_OUT, r6("primary_match_score").alias("primary_match_score"),
                     r6("runner_up_match_score").alias("runner_up_match_score"),
                     r6("score_difference").alias("score_difference"), "risk_level")


@register("risk_pairs_same_page", W(O.MATCH_CTES + O.RISK_CTES, """
SELECT * FROM risk_same"""))
def risk_pairs_same_page(spark, sf):
    from clickgap.operators import risk
    _, cf, _ = surrogate_mapped(spark, sf)
    same, _ = risk.risk_pairs(cf)
    return _risk_select(same)


@register("risk_pairs_runner_up", W(O.MATCH_CTES + O.RISK_CTES, """
SELECT * FROM risk_runner"""))
def risk_pairs_runner_up(spark, sf):
    from clickgap.operators import risk
    _, cf, _ = surrogate_mapped(spark, sf)
    _, runner = risk.risk_pairs(cf)
    return _risk_select(runner)


@register("risk_summary", W(O.MATCH_CTES + O.RISK_CTES, """
SELECT count(*) AS total_risks, CAST(count_if(risk_level = 'High') AS BIGINT) AS high_risks,
       CAST(count_if(risk_level = 'Medium') AS BIGINT) AS medium_risks
FROM (SELECT * FROM risk_same UNION ALL SELECT * FROM risk_runner)"""))
def risk_summary(spark, sf):
    from clickgap.operators import risk
    _, cf, _ = surrogate_mapped(spark, sf)
    return risk.risk_counts(cf)


@register("risk_order", W(O.MATCH_CTES + O.RISK_CTES, """
SELECT row_number() OVER (ORDER BY score_difference, primary_cluster_id, primary_topic, competing_cluster_id,
                                   competing_topic, shared_page, kind) AS place,
       primary_topic, primary_intent, competing_topic, competing_intent, shared_page, primary_match_score,
       runner_up_match_score, score_difference, risk_level
FROM (SELECT *, 0 AS kind FROM risk_same UNION ALL SELECT *, 1 FROM risk_runner)"""))
def risk_order(spark, sf):
    """The risk table as displayed: its columns, smallest score difference
    first (to 6 places), with each row's place."""
    from clickgap.operators import ranking, report, risk
    _, cf, _ = surrogate_mapped(spark, sf)
    same, runner = risk.risk_pairs(cf)
    both = _risk_select(same).withColumn("kind", F.lit(0)).unionByName(_risk_select(runner).withColumn("kind", F.lit(1)))
    order = ("score_difference", "primary_cluster_id", "primary_topic", "competing_cluster_id", "competing_topic",
             "shared_page", "kind")
    return report.display(ranking.number_rows(both, *[F.col(c) for c in order]), ["place", *report.RISK_DISPLAY_COLS])


@register("effort_order", W(O.MATCH_CTES + O.EFFORT_CTES, """
SELECT row_number() OVER (ORDER BY effort_level, round(opportunity_clicks, 6) DESC, cluster_id, topic_label) AS place,
       effort_label, recommended_action, topic_label, intent, round(opportunity_clicks, 6) AS opportunity_clicks,
       priority_band, primary_page, round(avg_position, 6) AS avg_position FROM effort"""))
def effort_order(spark, sf):
    """The effort table as displayed: low effort first, then opportunity."""
    from clickgap.operators import ranking, report
    _, cf, _ = surrogate_mapped(spark, sf)
    e = report.effort_table(cf).withColumns({c: r6(c) for c in ("opportunity_clicks", "avg_position")})
    rows = ranking.number_rows(e, F.col("effort_level"), F.col("opportunity_clicks").desc(), F.col("cluster_id"),
                               F.col("topic_label"))
    return report.display(rows, ["place", *report.EFFORT_DISPLAY_COLS])


@register("keyword_order", W(O.MATCH_CTES + O.KEYWORD_CTES, """
SELECT row_number() OVER (ORDER BY round(opportunity_clicks, 6) DESC NULLS LAST, query, cluster_id) AS place,
       query, cluster_id, topic_label, round(opportunity_clicks, 6) AS opportunity_clicks FROM kw"""))
def keyword_order(spark, sf):
    """The keyword table sorted by missed clicks, with each row's place."""
    from clickgap.operators import ranking, report
    qf, cf, _ = surrogate_mapped(spark, sf)
    kw = report.keyword_table(qf, cf).withColumn("opportunity_clicks", r6("opportunity_clicks"))
    return ranking.number_rows(kw, F.col("opportunity_clicks").desc_nulls_last(), F.col("query"), F.col("cluster_id")) \
        .select("place", "query", "cluster_id", "topic_label", "opportunity_clicks")


@register("effort_ranking", W(O.MATCH_CTES + O.EFFORT_CTES, """
SELECT cluster_id, topic_label, effort_level, effort_label, recommended_action,
       round(opportunity_clicks, 6) AS opportunity_clicks FROM effort"""))
def effort_ranking(spark, sf):
    from clickgap.operators import report
    _, cf, _ = surrogate_mapped(spark, sf)
    e = report.effort_table(cf)
    return e.select("cluster_id", "topic_label", "effort_level", "effort_label", "recommended_action",
                    r6("opportunity_clicks").alias("opportunity_clicks"))


@register("effort_counts", W(O.MATCH_CTES + O.EFFORT_CTES, """
SELECT effort_level, effort_label, count(*) AS clusters FROM effort GROUP BY effort_level, effort_label"""))
def effort_counts(spark, sf):
    from clickgap.operators import report
    _, cf, _ = surrogate_mapped(spark, sf)
    return report.effort_counts(report.effort_table(cf))


@register("keyword_table", W(O.MATCH_CTES + O.KEYWORD_CTES, """
SELECT query, cluster_id, topic_label, segment, intent, brand_label, has_competitor, has_local,
       has_product_brand, has_product_name, clicks, impressions, round(ctr, 6) AS ctr,
       round(position, 6) AS position, round(opportunity_clicks, 6) AS opportunity_clicks,
       round(priority_score, 6) AS priority_score, priority_band, primary_page FROM kw"""))
def keyword_table(spark, sf):
    from clickgap.operators import report
    qf, cf, _ = surrogate_mapped(spark, sf)
    kw = report.keyword_table(qf, cf)
    return kw.withColumns({c: r6(c) for c in ("ctr", "position", "opportunity_clicks", "priority_score")})


@register("keyword_filtered", W(O.MATCH_CTES + O.KEYWORD_CTES, """
SELECT query, cluster_id, round(opportunity_clicks, 6) AS opportunity_clicks FROM kw
WHERE brand_label IN ('Non-Branded') AND intent IN ('transactional', 'commercial')"""))
def keyword_filtered(spark, sf):
    from clickgap.operators import report
    qf, cf, _ = surrogate_mapped(spark, sf)
    kw = report.filter_in(report.filter_in(report.keyword_table(qf, cf), "brand_label", ["Non-Branded"]),
                          "intent", ["transactional", "commercial"])
    return report.sort_keywords(kw).select("query", "cluster_id", r6("opportunity_clicks").alias("opportunity_clicks"))


@register("option_lists", W(O.MATCH_CTES + O.KEYWORD_CTES, """
SELECT DISTINCT option, value FROM (
  SELECT 'brand' AS option, brand_label AS value FROM kw
  UNION ALL SELECT 'topic', topic_label FROM kw WHERE brand_label IN ('Non-Branded')
  UNION ALL SELECT 'intent', intent FROM kw WHERE brand_label IN ('Non-Branded')
) WHERE value IS NOT NULL"""))
def option_lists(spark, sf):
    from clickgap.operators import report
    qf, cf, _ = surrogate_mapped(spark, sf)
    return report.option_lists(report.keyword_table(qf, cf), brands=["Non-Branded"])


@register("intent_opportunity_totals", W(O.MATCH_CTES, """
SELECT 'All' AS brand_filter, intent, round(sum(opportunity_clicks), 6) AS opportunity_clicks FROM cf GROUP BY intent
UNION ALL
SELECT 'Non-Branded', intent, round(sum(opportunity_clicks), 6) FROM cf WHERE brand_label = 'Non-Branded' GROUP BY intent"""))
def intent_opportunity_totals(spark, sf):
    from clickgap.operators import report
    _, cf, _ = surrogate_mapped(spark, sf)
    parts = [report.intent_opportunity(cf, b).select(F.lit(b).alias("brand_filter"), "intent",
                                                      r6("opportunity_clicks").alias("opportunity_clicks"))
             for b in ("All", "Non-Branded")]
    return parts[0].unionByName(parts[1])


@register("top15_clusters", W(O.MATCH_CTES, """
SELECT cluster_id, topic_label, priority_band, round(opportunity_clicks, 6) AS opportunity_clicks,
       round(total_potential, 6) AS total_potential, round(size_ref, 6) AS size_ref
FROM (SELECT *, 2.0 * max(total_potential) OVER () / CAST(6400 AS DOUBLE) AS size_ref FROM (
  SELECT *, clicks + opportunity_clicks AS total_potential FROM cf
  ORDER BY opportunity_clicks DESC, cluster_id, topic_label, segment LIMIT 15))"""))
def top15_clusters(spark, sf):
    from clickgap.operators import report
    _, cf, _ = surrogate_mapped(spark, sf)
    t = report.top_clusters(cf)
    return t.select("cluster_id", "topic_label", "priority_band", r6("opportunity_clicks").alias("opportunity_clicks"),
                    r6("total_potential").alias("total_potential"), r6("size_ref").alias("size_ref"))


@register("top20_pages", W(O.MATCH_CTES + O.PAGE_TABLE_CTES, """
SELECT slug, round(opportunity_clicks, 6) AS opportunity_clicks, round(avg_position, 6) AS avg_position
FROM pall ORDER BY opportunity_clicks DESC, page LIMIT 20"""))
def top20_pages(spark, sf):
    from clickgap.operators import pages, report
    _, cf, p = surrogate_mapped(spark, sf)
    t = report.top_pages(pages.page_opportunity_all(cf, p))
    return t.select("slug", r6("opportunity_clicks").alias("opportunity_clicks"), r6("avg_position").alias("avg_position"))


@register("leaderboard", W(O.MATCH_CTES + O.PAGE_TABLE_CTES, """
SELECT slug, actual_clicks, round(opportunity_clicks, 6) AS opportunity_clicks
FROM pall ORDER BY opportunity_clicks DESC, page LIMIT 20"""))
def leaderboard(spark, sf):
    from clickgap.operators import pages, report
    _, cf, p = surrogate_mapped(spark, sf)
    t = report.top_pages(pages.page_opportunity_all(cf, p), 20)
    return t.select("slug", "actual_clicks", r6("opportunity_clicks").alias("opportunity_clicks"))


@register("brief_json", W(O.MATCH_CTES + O.PAGE_TABLE_CTES, """
SELECT '{"meta":{"client":"Client","generated":"2026-01-02T03:04:05.000006+00:00","brand_terms":["acme"]},"top_pages":['
       || (SELECT string_agg(CAST(to_json({'slug': slug, 'opportunity_clicks': round(opportunity_clicks, 6),
                                           'avg_position': round(avg_position, 6)}) AS VARCHAR), ','
                             ORDER BY opportunity_clicks DESC, page)
           FROM (SELECT * FROM pall ORDER BY opportunity_clicks DESC, page LIMIT 20))
       || '],"top_clusters":['
       || (SELECT string_agg(CAST(to_json({'topic_label': topic_label, 'segment': segment,
                                           'opportunity_clicks': round(opportunity_clicks, 6),
                                           'recommended_action': recommended_action,
                                           'example_queries': example_queries}) AS VARCHAR), ','
                             ORDER BY opportunity_clicks DESC, cluster_id, topic_label)
           FROM (SELECT * FROM cf ORDER BY opportunity_clicks DESC, cluster_id, topic_label LIMIT 20))
       || ']}' AS brief"""))
def brief_json(spark, sf):
    """JSON brief at a fixed time, amounts to 6 places."""
    from datetime import datetime, timezone

    from clickgap.operators import pages, report
    _, cf, p = surrogate_mapped(spark, sf)
    cfg = X.FIXTURE_CONFIG
    pall = pages.page_opportunity_all(cf, p)
    six = {c: r6(c) for c in ("opportunity_clicks", "avg_position")}
    return report.brief_json(cf.withColumns(six), pall.withColumns(six), cfg.client_name, list(cfg.brand_terms),
                             datetime(2026, 1, 2, 3, 4, 5, 6, timezone.utc))


@register("brief_markdown", W(O.MATCH_CTES + O.PAGE_TABLE_CTES, """
SELECT '# SEO Brief: Client' || chr(10) || chr(10) || '## Top Opportunities' || chr(10)
       || '| Page | Opp Clicks | Pos |' || chr(10) || '| --- | --- | --- |' || chr(10)
       || string_agg('| ' || CASE WHEN length(slug) <= 80 THEN slug ELSE left(slug, 79) || '…' END || ' | '
                     || coalesce(format('{:.0f}', round(opportunity_clicks, 9)), 'nan') || ' | '
                     || coalesce(format('{:.1f}', round(avg_position, 9)), 'nan') || ' |', chr(10)
                     ORDER BY opportunity_clicks DESC, page) AS markdown
FROM (SELECT * FROM pall ORDER BY opportunity_clicks DESC, page LIMIT 20)"""))
def brief_markdown(spark, sf):
    from clickgap.operators import pages, report
    _, cf, p = surrogate_mapped(spark, sf)
    return report.brief_markdown(pages.page_opportunity_all(cf, p), X.FIXTURE_CONFIG.client_name)


@register("end_to_end_clusters", W(O.RUN_CTES, """
SELECT cluster_id, topic_label, segment, queries, clicks, impressions,
       round(opportunity_clicks, 6) AS opportunity_clicks, priority_band, primary_page,
       round(match_score, 6) AS match_score, recommended_action FROM cf"""))
def end_to_end_clusters(spark, sf):
    """Full run (real clustering, labels, plural merge, page match)."""
    from dataclasses import replace

    from clickgap.plans.runner import run
    out = run(X.search_queries(spark, sf), X.search_pages(spark, sf),
              replace(X.FIXTURE_CONFIG, merge_plurals=True))
    return out["cluster"].select("cluster_id", "topic_label", "segment", "queries", "clicks", "impressions",
                                 r6("opportunity_clicks").alias("opportunity_clicks"), "priority_band",
                                 "primary_page", r6("match_score").alias("match_score"), "recommended_action")


# ---------------------------------------------------------------------------
# 7. remaining per-row and view operators
# ---------------------------------------------------------------------------

@register("exclusion_count", W(O.ENRICHED_CTES, """
SELECT CAST(count_if(NOT regexp_matches(query_norm, '""" + O.RX_EXCLUDE + """')) AS BIGINT) AS kept,
       CAST(count_if(regexp_matches(query_norm, '""" + O.RX_EXCLUDE + """')) AS BIGINT) AS excluded
FROM parsed"""))
def exclusion_count(spark, sf):
    q = enrich.parse_query_metrics(X.search_queries(spark, sf))
    return enrich.exclusion_counts(q, X.FIXTURE_CONFIG)


@register("query_tokens", W(O.ENRICHED_CTES, """
SELECT row_id, list_filter(string_split(query_norm, ' '), lambda x: x <> '') AS tokens FROM seg"""))
def query_tokens(spark, sf):
    return enrich.query_tokens(enriched(spark, sf)).select("row_id", "tokens")


@register("filtered_totals", W(O.MATCH_CTES + O.KEYWORD_CTES, """
SELECT (SELECT round(sum(opportunity_clicks), 6) FROM cf
        WHERE brand_label = 'Non-Branded' AND intent = 'transactional') AS filtered_opportunity_clicks,
       (SELECT count(*) FROM kw WHERE brand_label IN ('Non-Branded')
          AND intent IN ('transactional', 'commercial')) AS filtered_keywords"""))
def filtered_totals(spark, sf):
    from clickgap.operators import report
    qf, cf, _ = surrogate_mapped(spark, sf)
    t = report.filtered_totals(cf, report.keyword_table(qf, cf), brand="Non-Branded", intent="transactional",
                               brands=["Non-Branded"], intents=["transactional", "commercial"])
    return t.select(r6("filtered_opportunity_clicks").alias("filtered_opportunity_clicks"), "filtered_keywords")


@register("document_line_tfidf", W(O.DOC_TFIDF_CTES, """
SELECT segment, query_norm, term, tf, df, round(w, 6) AS w FROM tw"""))
def document_line_tfidf(spark, sf):
    """Per-segment TF-IDF over every document line taken as a query
    (normalisation of non-ASCII text, intents, segments, 1-3-grams)."""
    from clickgap.operators import cluster
    from clickgap.operators.tfidf import gram_vectors
    q = enrich.preprocess_queries(X.document_lines(spark, sf), X.FIXTURE_CONFIG)
    texts = materialize(cluster.text_table(q.select("segment", "row_id", "query_norm")))
    w = gram_vectors(texts, "rep", "query_norm", ["segment"], cluster.MAX_DF, "mult", carry=["query_norm"])
    return w.where("rep IS NOT NULL").select("segment", "query_norm", F.inline("grams")) \
            .select("segment", "query_norm", "term", "tf", "df", r6("w").alias("w"))


@register("document_line_pairs", W(O.DOC_TFIDF_CTES + O.PAIRS_CTES, """
SELECT segment, a, b, round(sim, 6) AS sim FROM pairs"""))
def document_line_pairs(spark, sf):
    """Every pair of different document lines of a segment with cosine above
    the linkage cut (long texts: about 90 n-grams each)."""
    from clickgap.operators import cluster
    from clickgap.operators.similarity import vector_pairs
    q = enrich.preprocess_queries(X.document_lines(spark, sf), X.FIXTURE_CONFIG)
    texts = materialize(cluster.text_table(q.select("segment", "row_id", "query_norm")))
    return vector_pairs(cluster.packed_vectors(texts), ["segment"], "rep", 1.0 - X.FIXTURE_CONFIG.threshold).select(
        "segment", "a", "b", r6("sim").alias("sim"))


@register("document_line_clusters", W(O.DOC_LINK_CTES, """
SELECT row_id, segment, cluster_id FROM clustered"""))
def document_line_clusters(spark, sf):
    """Exact average linkage over every document line taken as a query: more
    rows than a UI export, long texts, components of thousands of lines."""
    from clickgap.operators import cluster
    q = enrich.preprocess_queries(X.document_lines(spark, sf), X.FIXTURE_CONFIG)
    return cluster.cluster_queries(materialize(q.select("segment", "row_id", "query_norm")), X.FIXTURE_CONFIG).select(
        "row_id", "segment", "cluster_id")


# ---------------------------------------------------------------------------
# 8. sources and sinks: written below the shared folder, read back
# ---------------------------------------------------------------------------

def _folder(spark) -> str:
    import uuid

    from clickgap.session import checkpoint_dir
    return f"{checkpoint_dir(spark).rstrip('/')}/files-{uuid.uuid4().hex}"


@register("export_queries", f"""
SELECT query, CAST(clicks AS VARCHAR) AS clicks, CAST(impressions AS VARCHAR) AS impressions, ctr_raw,
       round(position, 6) AS position, row_id % 3 AS extra
FROM ({X.SEARCH_QUERIES_SQL})""")
def export_queries(spark, sf):
    """The query table as CSV exports under two header
    languages with one more column, read back by the header rule."""
    from clickgap.sources import exports, sinks
    q = X.search_queries(spark, sf).withColumn("Extra column", F.col("row_id") % 3)
    home = _folder(spark)
    heads = {"en": ["Top queries", "Clicks", "Impressions", "CTR", "Position"],
             "nl": ["Zoekopdracht", "Klikken", "Weergaven", "CTR", "Positie"]}
    for i, (lang, names) in enumerate(heads.items()):
        part = q.where(F.col("row_id") % 2 == i).select(
            "Extra column", *[F.col(c).alias(n) for c, n in zip(
                ["query", "clicks", "impressions", "ctr_raw", "position"], names)])
        sinks.write_csv(part, f"{home}/{lang}")
    got = exports.read_exports(spark, [f"{home}/{lang}" for lang in heads])
    return got.select("query", "clicks", "impressions", "ctr_raw", r6(F.col("position").cast("double")).alias("position"),
                      F.col("Extra column").cast("long").alias("extra"))


@register("export_pages", f"""
SELECT page, CAST(clicks AS VARCHAR) AS page_clicks, CAST(impressions AS VARCHAR) AS page_impressions,
       round(position, 6) AS page_position FROM ({X.SEARCH_PAGES_SQL})""")
def export_pages(spark, sf):
    """The page table as a CSV export, with a header that only a
    manual mapping resolves."""
    from clickgap.sources import exports, sinks
    p = X.search_pages(spark, sf).select(
        F.col("page").alias("Adres"), F.col("page_clicks").alias("Klikken"), F.col("page_impressions").alias("Weergaven"),
        F.col("page_ctr_raw").alias("CTR"), F.col("page_position").alias("Positie"))
    home = _folder(spark)
    sinks.write_csv(p, home)
    got = exports.read_exports(spark, home, "pages", mapping={"page": "Adres"})
    return got.select("page", "page_clicks", "page_impressions",
                      r6(F.col("page_position").cast("double")).alias("page_position"))


@register("clusters_sink", W(O.CLUSTER_CTES, """
SELECT cluster_id, topic_label, segment, queries, round(opportunity_clicks, 6) AS opportunity_clicks,
       priority_band FROM ct"""))
def clusters_sink(spark, sf):
    """The cluster table written as CSV and read back."""
    from clickgap.sources import sinks
    _, cl = surrogate_clusters_table(spark, sf)
    home = _folder(spark)
    sinks.write_csv(cl, home)
    got = spark.read.options(header=True, escape='"', inferSchema=False).csv(home)
    return got.select(F.col("cluster_id").cast("long").alias("cluster_id"), "topic_label", "segment",
                      F.col("queries").cast("long").alias("queries"),
                      r6(F.col("opportunity_clicks").cast("double")).alias("opportunity_clicks"), "priority_band")


@register("pages_per_segment_sink", W(O.MATCH_CTES + O.PAGE_TABLE_CTES, """
SELECT page, segment, brand_label, intent, round(impressions, 6) AS impressions,
       round(opportunity_clicks, 6) AS opportunity_clicks FROM pseg"""))
def pages_per_segment_sink(spark, sf):
    """The page x segment table, one folder per segment, read back."""
    from clickgap.operators import pages
    from clickgap.sources import sinks
    qf, _, p = surrogate_mapped(spark, sf)
    home = _folder(spark)
    sinks.write_csv(pages.page_opportunity_segment(qf, p), home, partition_by="segment")
    got = spark.read.options(header=True, escape='"', inferSchema=False).csv(home)
    return got.select("page", F.col("segment").cast("string").alias("segment"), "brand_label", "intent",
                      r6(F.col("impressions").cast("double")).alias("impressions"),
                      r6(F.col("opportunity_clicks").cast("double")).alias("opportunity_clicks"))


@register("saved_results", W(O.CLUSTER_CTES, """
SELECT cluster_id, topic_label, priority_band FROM ct"""))
def saved_results(spark, sf):
    """Result tables kept in the catalog and read from it."""
    import uuid

    from clickgap.sources import sinks
    _, cl = surrogate_clusters_table(spark, sf)
    prefix = f"run_{uuid.uuid4().hex}"
    sinks.save_results({"cluster": cl}, prefix)
    return spark.table(f"{prefix}_cluster").select("cluster_id", "topic_label", "priority_band")


@register("keyword_config_counts", W(O.ENRICHED_CTES, """
SELECT intent, count(*) AS keywords FROM (SELECT DISTINCT intent, split_part(query_norm, ' ', 1) AS word FROM enriched)
WHERE word <> '' GROUP BY intent"""))
def keyword_config_counts(spark, sf):
    """The first words of each intent's queries as keyword
    text, parsed, written as the JSON configuration, read back and counted."""
    from clickgap.sources import keywords as K
    words = enriched(spark, sf).select("intent", F.split("query_norm", " ")[0].alias("w")).where("w <> ''").distinct()
    # four intents, one keyword text each: what a user would type
    texts = {r["intent"]: r["t"] for r in words.groupBy("intent").agg(
        F.array_join(F.array_sort(F.collect_set("w")), ", ").alias("t")).collect()}
    home = _folder(spark)
    K.write_keyword_config(spark, K.keyword_lists_from_text(texts), home)
    got = K.keyword_counts(K.read_keyword_config(spark, home))
    return got.select("intent", F.col("keywords").cast("long").alias("keywords"))


@register("semantic_clusters", W(O.SEMANTIC_CTES, """
SELECT s.row_id, s.segment, CASE
  WHEN d.dense THEN coalesce(l.c, s.row_id)
  ELSE t.cluster_id END AS cluster_id
FROM seg s JOIN dense d ON d.segment = s.segment
LEFT JOIN (SELECT rep, c FROM linked) l ON l.rep = s.row_id
LEFT JOIN clustered t ON t.row_id = s.row_id"""))
def semantic_clusters(spark, sf):
    """M10 in a run: every unbranded query has a vector (the embeddings,
    dealt by row_id) and clusters by it; branded segments have none and
    cluster by their texts."""
    from clickgap.operators import cluster
    vec = X.table(spark, sf, "embeddings").select(F.col("vec_id"), "embedding")
    n = vec.count()
    emb = enriched(spark, sf).where("NOT is_branded").select("row_id", (F.col("row_id") % n).alias("vec_id")) \
        .join(vec, "vec_id").select("row_id", "embedding")
    q = cluster.cluster_queries(enriched(spark, sf), X.FIXTURE_CONFIG, vectors=emb)
    return q.select("row_id", "segment", "cluster_id")
