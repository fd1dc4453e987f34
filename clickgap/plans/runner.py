"""End-to-end run (M13): preprocess -> cluster -> label -> (merge) ->
score -> aggregate -> match pages -> page tables.

Stages are DataFrames; the jobs that run while the plan is built are the
scalar passes (quantiles, component rounds) and the writes at stage
boundaries (``materialize``: enriched queries, clustered queries, scored
queries, cluster table, match result). Each write goes to the session's
checkpoint directory, so later stages never recompute an earlier stage
after an executor loss.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from clickgap.config import Config
from clickgap.operators import aggregate, cluster, enrich, label, pages, score
from clickgap.session import materialize


def run(queries: DataFrame, page_rows: DataFrame, cfg: Config,
        vectors: DataFrame | None = None) -> dict[str, DataFrame]:
    """queries: query, clicks, impressions, ctr_raw, position, row_id (+ extra)
    page_rows: page, page_clicks, page_impressions, page_ctr_raw, page_position, page_ord
    vectors (semantic clustering): row_id, embedding, from any encoder
    Returns q, cluster, page_all, page_segment, pages."""
    q = materialize(enrich.preprocess_queries(queries, cfg))
    if cfg.exclusion_terms and q.isEmpty():
        raise ValueError("All queries were filtered out by exclusion terms. "
                         "Please adjust your exclusion terms.")
    p = materialize(enrich.preprocess_pages(page_rows))
    q = materialize(cluster.cluster_queries(q, cfg, vectors=vectors))
    q = label.label_clusters(q)
    if cfg.merge_plurals:
        q = label.merge_plural_clusters(q)
    q = materialize(score.score_queries(q))
    cl = aggregate.aggregate_clusters(q)
    q_final, cl_final = pages.map_clusters_to_pages(q, cl, p)
    q_final = materialize(q_final)
    return {
        "q": q_final,
        "cluster": cl_final,
        "page_all": pages.page_opportunity_all(cl_final, p),
        "page_segment": pages.page_opportunity_segment(q_final, p),
        "pages": p,
    }
