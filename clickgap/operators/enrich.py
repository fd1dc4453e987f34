"""Per-row enrichment of queries and pages: one narrow projection each.

Everything here is a column expression, so the whole step stays inside one
whole-stage-codegen span after the scan; no shuffle, no Python.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickgap.config import (INTENT_CONF_BASE, INTENT_CONF_CAP, INTENT_CONF_STEP,
                             INTENT_ORDER, Config)
from clickgap.functions import numeric as N
from clickgap.functions import rules as R
from clickgap.functions import text as T

QUERY_FIELDS = ("query", "clicks", "impressions", "ctr_raw", "position")
PAGE_FIELDS = ("page", "page_clicks", "page_impressions", "page_ctr_raw", "page_position")

# term category -> (config attribute, flag column, label column, label text)
TERM_CATEGORIES = (
    ("competitor_terms", "has_competitor", "competitor_label", "Competitor"),
    ("local_terms", "has_local", "local_label", "Local"),
    ("product_brand_terms", "has_product_brand", "product_brand_label", "ProductBrand"),
    ("product_name_terms", "has_product_name", "product_name_label", "ProductName"),
)


def _require(df: DataFrame, fields, what: str) -> None:
    missing = [f for f in fields if f not in df.columns]
    if missing:
        raise ValueError(f"Missing columns in {what}: {missing}")


def parse_query_metrics(df: DataFrame) -> DataFrame:
    """clicks/impressions (missing -> 0), CTR parse + backfill,
    position (missing kept), normalised query text."""
    _require(df, QUERY_FIELDS, "queries")
    clicks = N.number_or_zero(F.col("clicks"), N.is_string_col(df, "clicks"))
    imps = N.number_or_zero(F.col("impressions"), N.is_string_col(df, "impressions"))
    ctr = N.parse_ctr(F.col("ctr_raw"), N.is_string_col(df, "ctr_raw"))
    pos = N.number_or_null(F.col("position"), N.is_string_col(df, "position"))
    return (df.withColumns({"clicks": clicks, "impressions": imps, "position": pos})
              .withColumn("ctr", N.backfill_ctr(ctr, F.col("clicks"), F.col("impressions")))
              .withColumn("query_norm", T.normalize_query(F.col("query"))))


def exclude_terms(df: DataFrame, cfg: Config) -> DataFrame:
    """Drop rows whose normalised query contains an exclusion term."""
    pats = R.term_patterns(cfg.exclusion_terms)
    if not pats:
        return df
    # exploded, so that the filter reads the normalised text instead of making it a second time
    once = df.select(*[F.explode(F.array(c)).alias(c) if c == "query_norm" else F.col(c) for c in df.columns])
    return once.filter(~R.matches_any(F.col("query_norm"), pats))


def exclusion_counts(parsed: DataFrame, cfg: Config) -> DataFrame:
    """One row (kept, excluded) - one aggregation over the parsed rows."""
    hit = R.matches_any(F.col("query_norm"), R.term_patterns(cfg.exclusion_terms))
    return parsed.agg(F.count_if(~hit).alias("kept"), F.count_if(hit).alias("excluded"))


def classify(df: DataFrame, cfg: Config) -> DataFrame:
    """Intent, confidence, matched intents, brand, term flags, segment."""
    qn = F.col("query_norm")
    rules = R.build_intent_rules(cfg.brand_terms, cfg.intent_keywords)
    hit = {k: R.matches_any(qn, rules[k]) for k in INTENT_ORDER}

    intent = F.when(hit["navigational"], "navigational")
    for k in INTENT_ORDER[1:-1]:
        intent = intent.when(hit[k], k)
    intent = intent.otherwise(INTENT_ORDER[-1])
    k_matched = sum((hit[k].cast("int") for k in INTENT_ORDER), F.lit(0))
    conf = F.least(F.lit(INTENT_CONF_BASE) + F.lit(INTENT_CONF_STEP) * k_matched,
                   F.lit(INTENT_CONF_CAP))
    matched = F.filter(F.array(*[F.when(hit[k], F.lit(k)) for k in INTENT_ORDER]),
                       lambda x: x.isNotNull())

    branded = R.matches_any(qn, R.term_patterns(cfg.brand_terms))
    cols = {
        "intent": intent,
        "intent_confidence": conf,
        "matched_intents": matched,
        "is_branded": branded,
        "brand_label": F.when(branded, "Branded").otherwise("Non-Branded"),
    }
    labels, suffixes = {}, []
    for attr, flag, label_col, label in TERM_CATEGORIES:
        pats = R.term_patterns(getattr(cfg, attr))
        cols[flag] = R.matches_any(qn, pats)
        if pats:
            labels[label_col] = F.when(F.col(flag), F.lit(label)).otherwise(F.lit(""))
            suffixes.append(F.when(F.col(flag), F.lit(label)))
    out = df.withColumns(cols).withColumns(labels)
    # concat_ws skips nulls, so unmatched categories add nothing
    return out.withColumn("segment", F.concat_ws(" - ", F.col("brand_label"), F.col("intent"), *suffixes))


def preprocess_queries(df: DataFrame, cfg: Config) -> DataFrame:
    """Raw query rows (query, clicks, impressions, ctr_raw, position, row_id, ...)
    -> enriched rows. Extra input columns pass through."""
    return classify(exclude_terms(parse_query_metrics(df), cfg), cfg)


def preprocess_pages(df: DataFrame) -> DataFrame:
    """P21-P23 + metric parsing for pages
    (page, page_clicks, page_impressions, page_ctr_raw, page_position, page_ord)."""
    _require(df, PAGE_FIELDS, "pages")
    clicks = N.number_or_zero(F.col("page_clicks"), N.is_string_col(df, "page_clicks"))
    imps = N.number_or_zero(F.col("page_impressions"), N.is_string_col(df, "page_impressions"))
    ctr = N.parse_ctr(F.col("page_ctr_raw"), N.is_string_col(df, "page_ctr_raw"))
    pos = N.number_or_null(F.col("page_position"), N.is_string_col(df, "page_position"))
    return (df.withColumns({"page_clicks": clicks, "page_impressions": imps, "page_position": pos})
              .withColumn("page_ctr", N.backfill_ctr(ctr, F.col("page_clicks"), F.col("page_impressions")))
              .withColumn("slug", T.url_slug(F.col("page")))
              .withColumn("page_tokens", T.url_tokens(F.col("page")))
              .withColumn("page_text", F.array_join(F.col("page_tokens"), " ")))


def query_tokens(df: DataFrame) -> DataFrame:
    """Whitespace tokens of query_norm."""
    return df.withColumn("tokens", T.split_words(F.col("query_norm")))
