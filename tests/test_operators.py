"""Edge cases of the per-row layer, labels, merge and page match."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from clickgap.config import Config
from clickgap.functions import rules as R
from clickgap.functions.numeric import pos_bucket
from clickgap.functions.text import normalize_query, url_slug, url_tokens
from clickgap.operators import enrich, label, pages, score


def _q(spark, rows, cols=("query", "clicks", "impressions", "ctr_raw", "position", "row_id")):
    schema = "query string, clicks string, impressions string, ctr_raw string, position string, row_id long"
    return spark.createDataFrame(pd.DataFrame(rows, columns=list(cols)), schema)


def test_ctr_parse_and_backfill(spark):
    rows = [("a", "5", "100", "5%", "1", 1), ("b", "5", "100", "0.05", "1", 2),
            ("c", "7", "100", "5,3%", "1", 3), ("d", "7", "100", "abc", "1", 4),
            ("e", "7", "100", None, "1", 5), ("f", "7", "0", None, "1", 6)]
    out = {r["row_id"]: r["ctr"] for r in enrich.parse_query_metrics(_q(spark, rows)).collect()}
    assert out[1] == pytest.approx(0.05) and out[2] == pytest.approx(0.05)
    assert out[3] == out[4] == out[5] == pytest.approx(0.07)
    assert out[6] is None
    opp = score.opportunity(enrich.parse_query_metrics(_q(spark, rows)), {b: 0.5 for b in
                            ("1-3", "4-6", "7-10", "11-20", "21+", "unknown")})
    assert {r["row_id"]: r["opportunity_clicks"] for r in opp.collect()}[6] == 0.0


def test_number_text(spark):
    rows = [("a", "1,234", "10", None, "3,4", 1)]
    r = enrich.parse_query_metrics(_q(spark, rows)).select(
        "clicks", "position", pos_bucket(F.col("position")).alias("b")).first()
    assert r["clicks"] == 0.0 and r["position"] is None and r["b"] == "unknown"


def test_bucket_edges(spark):
    vals = [3.0, 3.01, 6.0, 10.0, 20.0, 20.01, None]
    df = spark.createDataFrame([(v,) for v in vals], "p double")
    got = [r[0] for r in df.select(pos_bucket(F.col("p"))).collect()]
    assert got == ["1-3", "4-6", "4-6", "7-10", "11-20", "21+", "unknown"]


def test_normalisation(spark):
    df = spark.createDataFrame([("  What’s  NEW? ",), ("café-bar",), (None,)], "q string")
    assert [r[0] for r in df.select(normalize_query(F.col("q"))).collect()] == ["whats new", "caf -bar", "nan"]


def test_intents_and_confidence(spark):
    rows = [("best price guide", "1", "1", None, "1", 1), ("acme login", "1", "1", None, "1", 2)]
    cfg = Config(brand_terms=("acme",))
    out = {r["row_id"]: r for r in enrich.preprocess_queries(_q(spark, rows), cfg).collect()}
    assert out[1]["intent"] == "transactional" and out[1]["intent_confidence"] == pytest.approx(0.95)
    assert out[2]["intent"] == "navigational" and out[2]["is_branded"]
    assert out[2]["segment"] == "Branded - navigational"


def test_empty_keyword_list_keeps_defaults_with_brand():
    rules = R.build_intent_rules(["Acme"], {"navigational": [], "commercial": ["deal"]})
    assert rules["navigational"][0] == r"\bacme\b"
    assert rules["commercial"] == [r"\bdeal\b"]
    # a given list replaces the defaults, brand regexes included
    rules = R.build_intent_rules(["Acme"], {"navigational": ["portal"]})
    assert rules["navigational"] == [r"\bportal\b"]


def test_term_flags_and_segment_suffixes(spark):
    rows = [("promo widget red bolt", "1", "1", None, "1", 1)]
    cfg = Config(competitor_terms=("promo",), product_brand_terms=("widget",),
                 product_name_terms=("red bolt",))
    r = enrich.preprocess_queries(_q(spark, rows), cfg).first()
    assert r["segment"] == "Non-Branded - informational - Competitor - ProductBrand - ProductName"
    assert r["competitor_label"] == "Competitor" and "local_label" not in r.asDict()


def test_exclusion(spark):
    rows = [("standard bolt", "1", "1", None, "1", 1), ("bolt", "1", "1", None, "1", 2)]
    out = enrich.preprocess_queries(_q(spark, rows), Config(exclusion_terms=("standard",)))
    assert [r["row_id"] for r in out.collect()] == [2]


def test_urls(spark):
    urls = ["https://e.com/", "https://e.com/a-b/c_d.html?x=1#y", "https://e.com/WWW/Shoes"]
    df = spark.createDataFrame([(u,) for u in urls], "u string")
    got = df.select(url_slug(F.col("u")).alias("s"), url_tokens(F.col("u")).alias("t")).collect()
    assert got[0]["s"] == "home" and got[0]["t"] == ["home"]
    assert got[1]["s"] == "a-b/c_d.html" and got[1]["t"] == ["a", "b", "c", "dhtml"]
    assert got[2]["t"] == ["shoes"]


def _topics(spark, rows):
    return spark.createDataFrame(pd.DataFrame(rows, columns=["row_id", "cluster_id", "intent", "topic_label"]))


def test_plural_chain(spark):
    q = _topics(spark, [(1, 1, "i", "red box"), (2, 2, "i", "blue boxes"), (3, 3, "i", "red bag"),
                        (4, 4, "i", "new bags")])
    out = {r["row_id"]: r["cluster_id"] for r in label.merge_plural_clusters(q).collect()}
    assert out == {1: 1, 2: 1, 3: 3, 4: 3}


def test_plural_no_closure(spark):
    q = _topics(spark, [(1, 1, "i", "cat"), (2, 2, "i", "cats dog"), (3, 3, "i", "dogs")])
    out = {r["row_id"]: r["cluster_id"] for r in label.merge_plural_clusters(q).collect()}
    assert out == {1: 1, 2: 1, 3: 2}


def test_plural_needs_same_intent_and_irregular(spark):
    q = _topics(spark, [(1, 1, "a", "child seat"), (2, 2, "a", "children"), (3, 3, "b", "seats"),
                        (4, 4, "a", "city"), (5, 5, "a", "cities")])
    out = {r["row_id"]: r["cluster_id"] for r in label.merge_plural_clusters(q).collect()}
    assert out == {1: 1, 2: 1, 3: 3, 4: 4, 5: 4}


def test_topic_label_rules(spark):
    rows = [(1, 7, "red shoes sale"), (2, 7, "red shoes"), (3, 7, "blue hat"), (4, 9, "lonely query")]
    q = spark.createDataFrame(pd.DataFrame(rows, columns=["row_id", "cluster_id", "query_norm"]))
    out = {r["cluster_id"]: r["topic_label"] for r in label.topic_labels(q).collect()}
    assert out == {7: "red shoes", 9: "lonely query"}


def _cluster_rows(spark, texts):
    rows = [(i, f"t{i}", "s", "Non-Branded", "commercial", 1, 1.0, 1.0, 5.0, 1.0, 1.0, "x", "P3", "commercial")
            for i in range(len(texts))]
    cols = ["cluster_id", "topic_label", "segment", "brand_label", "intent", "queries", "clicks", "impressions",
            "avg_position", "opportunity_clicks", "priority_score", "example_queries", "priority_band",
            "dominant_intent"]
    cl = spark.createDataFrame(pd.DataFrame(rows, columns=cols))
    q = spark.createDataFrame(pd.DataFrame([(i, i, t, 1.0) for i, t in enumerate(texts)],
                                           columns=["row_id", "cluster_id", "query_norm", "impressions"]))
    return q, cl


def _pages(spark, urls):
    df = spark.createDataFrame(pd.DataFrame(
        [(u, i + 1, "1", "10", None, "1") for i, u in enumerate(urls)],
        columns=["page", "page_ord", "page_clicks", "page_impressions", "page_ctr_raw", "page_position"]),
        "page string, page_ord long, page_clicks string, page_impressions string, page_ctr_raw string, "
        "page_position string")
    return enrich.preprocess_pages(df)


def test_one_page_only(spark):
    q, cl = _cluster_rows(spark, ["red shoes"])
    _, out = pages.map_clusters_to_pages(q, cl, _pages(spark, ["https://e.com/red-shoes"]))
    r = out.first()
    assert r["primary_page"] == "https://e.com/red-shoes" and r["runner_up_page"] is None
    assert r["runner_up_score"] == 0.0


def test_no_common_terms_first_page_zero(spark):
    q, cl = _cluster_rows(spark, ["zzz qqq"])
    _, out = pages.map_clusters_to_pages(q, cl, _pages(spark, ["https://e.com/alpha", "https://e.com/beta"]))
    r = out.first()
    assert r["primary_page"] == "https://e.com/alpha" and r["match_score"] == 0.0
    assert not r["cannibalisation_risk"]


def test_page_match_pruning_is_exact(spark):
    """Frequent-term pruning gives the same primary / runner-up as scoring
    every shared-term pair."""
    from clickgap.operators import aggregate
    from clickgap.plans.catalog import surrogate
    from clickgap.sources import fixtures as X
    from conftest import SF001
    q = surrogate(spark, SF001)
    cl = aggregate.aggregate_clusters(q)
    p = enrich.preprocess_pages(X.search_pages(spark, SF001))

    def run(rare_df):
        _, out = pages.map_clusters_to_pages(q, cl, p, rare_df)
        return {(r["cluster_id"], r["topic_label"]): (r["primary_page"], round(r["match_score"], 9),
                                                     r["runner_up_page"], round(r["runner_up_score"], 9))
                for r in out.collect()}
    full = run(10 ** 9)
    for rare_df in (1, 3, 12):
        assert run(rare_df) == full


def test_builtin_rules_variant_brand_is_navigational(spark):
    """Without keyword lists the built-in regex rules apply, brand terms first
    in navigational; 'in <city>' counts as transactional there."""
    rows = [("acme shoes", "1", "1", None, "1", 1), ("shoes in paris", "1", "1", None, "1", 2),
            ("signin help", "1", "1", None, "1", 3)]
    cfg = Config(brand_terms=("Acme",), intent_keywords=None, threshold=0.85)
    out = {r["row_id"]: r["intent"] for r in enrich.preprocess_queries(_q(spark, rows), cfg).collect()}
    assert out == {1: "navigational", 2: "transactional", 3: "navigational"}


def test_brief_number_format_matches_python(spark):
    from clickgap.operators.report import _fixed
    vals = [0.15, 3.45, 2.5, 3.5, 2.675, 7.05, 1234567.25]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    for d in (0, 1):
        assert [r[0] for r in df.select(_fixed("x", d)).collect()] == [f"{v:.{d}f}" for v in vals]


def test_brief_prints_an_edge_the_same_whatever_the_order_of_summation(spark):
    from clickgap.operators.report import brief_markdown
    rows = [("p1", "a", 9.0, 15.75), ("p2", "b", 8.0, 15.749999999999998), ("p3", "c", 2.5000000000000004, 0.1)]
    df = spark.createDataFrame(rows, "page string, slug string, opportunity_clicks double, avg_position double")
    text = brief_markdown(df, "c").first()[0]
    assert text.splitlines()[-3:] == ["| a | 9 | 15.8 |", "| b | 8 | 15.8 |", "| c | 2 | 0.1 |"]


def test_unparsable_and_missing_urls(spark):
    from clickgap.functions.text import url_slug, url_tokens
    urls = ["http://[bad/path-one", None, "https://[::1]/a-b", "http://x.org/" + "y" * 80]
    df = spark.createDataFrame([(u,) for u in urls], "u string")
    got = df.select(url_slug(F.col("u")).alias("s"), url_tokens(F.col("u")).alias("t")).collect()
    assert got[0].s == "http://[bad/path-one" and got[0].t == ["bad", "path", "one"]
    assert got[1].s == "nan" and got[1].t == ["nan"]
    assert got[2].s == "a-b" and got[2].t == ["a", "b"]
    assert got[3].s == "y" * 80


def test_risk_counts_equal_the_pairs(spark):
    import random

    from clickgap.operators import risk
    from clickgap.operators.aggregate import CLUSTER_KEYS
    rng = random.Random(4)
    rows = []
    for i in range(150):
        page = rng.choice(["a", "b", "c"])
        score = rng.choice([0.2, 0.2043, 0.2157, 0.2211, 0.2 + rng.random() / 20])
        rows.append((i, f"t{i}", "s", "b", "i", rng.random() < 0.8, page, score, rng.choice(["a", "b", "c", None]),
                     score - rng.choice([0.005, 0.0123, 0.015, 0.03])))
    cols = ("cluster_id long, topic_label string, segment string, brand_label string, intent string, "
            "cannibalisation_risk boolean, primary_page string, match_score double, runner_up_page string, "
            "runner_up_score double")
    df = spark.createDataFrame(rows, cols)
    assert set(CLUSTER_KEYS) <= set(df.columns)
    assert risk.risk_counts(df).first() == risk.risk_summary(risk.analyze_risks(df)).first()
    assert tuple(risk.risk_counts(df.limit(0)).first()) == (0, 0, 0)
