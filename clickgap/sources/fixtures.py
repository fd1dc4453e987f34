"""Stand-in inputs derived from the driver's test tables.

The reference reads two search-console exports; the test tables have no
such data, so two views are derived from ``part`` and ``lineitem``. The
SQL text is shared verbatim by Spark and the DuckDB oracles, so both
engines start from identical rows. These views only produce rows in the
expected schema; all of the job's work happens in the operators.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clickgap.config import Config

SEARCH_QUERIES_SQL = """
SELECT query, clicks, impressions,
  CASE WHEN k % 7 = 0 THEN NULL
       WHEN k % 2 = 0 THEN concat(cast(pct AS varchar(20)), '%')
       ELSE cast(cast(pct AS double) / cast(100 AS double) AS varchar(20)) END AS ctr_raw,
  position, k AS row_id
FROM (
  SELECT *, cast(round(100.0 * clicks / impressions) AS int) AS pct FROM (
    SELECT concat(CASE p_size % 6 WHEN 0 THEN 'buy ' WHEN 1 THEN 'best ' WHEN 2 THEN 'how to use '
                                  WHEN 3 THEN 'login ' WHEN 4 THEN 'Acme ' ELSE '' END,
                  p_name, CASE WHEN p_partkey % 3 = 0 THEN 's ' ELSE ' ' END, lower(p_type)) AS query,
      min(p_partkey) AS k,
      cast(sum(CASE WHEN l_returnflag = 'R' AND l_discount >= 0.08 THEN cast(l_quantity AS bigint) ELSE 0 END) AS bigint) AS clicks,
      cast(sum(cast(l_quantity AS bigint)) AS bigint) AS impressions,
      cast(min(p_size) AS double) * cast(0.7 AS double) AS position
    FROM part JOIN lineitem ON l_partkey = p_partkey GROUP BY 1) g) t
"""

SEARCH_PAGES_SQL = """
SELECT concat('https://shop.example.com/', lower(p_type), '/', replace(p_name, ' ', '-'),
              CASE WHEN min(p_partkey) % 4 = 0 THEN '?utm_source=feed' ELSE '' END) AS page,
  min(p_partkey) AS page_ord,
  cast(sum(CASE WHEN l_returnflag = 'R' AND l_discount >= 0.08 THEN cast(l_quantity AS bigint) ELSE 0 END) AS bigint) AS clicks,
  cast(sum(cast(l_quantity AS bigint)) AS bigint) AS impressions,
  cast(NULL AS varchar(20)) AS ctr_raw,
  cast(min(p_size) AS double) * cast(0.7 AS double) AS position
FROM part JOIN lineitem ON l_partkey = p_partkey GROUP BY p_type, p_name
"""

# Parameters used with the derived views.
FIXTURE_CONFIG = Config(
    brand_terms=("acme",),
    competitor_terms=("promo",),
    local_terms=(),
    product_brand_terms=("widget", "widgets"),
    product_name_terms=("red bolt", "blue gear"),
    exclusion_terms=("standard",),
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _view(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """Run a fixture view against this sf's part/lineitem.

    Temp-view names are made unique per directory so two scale factors
    can coexist in one session.
    """
    tag = "".join(ch if ch.isalnum() else "_" for ch in sf_dir.rstrip("/").split("/")[-1])
    for name in ("part", "lineitem"):
        table(spark, sf_dir, name).createOrReplaceTempView(f"cg_{name}_{tag}")
    text = (sql.replace("FROM part JOIN lineitem", f"FROM cg_part_{tag} JOIN cg_lineitem_{tag}"))
    return spark.sql(text)


def search_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Derived query export: query, clicks, impressions, ctr_raw, position, row_id."""
    return _view(spark, sf_dir, SEARCH_QUERIES_SQL)


def search_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Derived page export renamed to the page schema (page, page_clicks, ...)."""
    return _view(spark, sf_dir, SEARCH_PAGES_SQL).select(
        "page", "page_ord",
        F.col("clicks").alias("page_clicks"), F.col("impressions").alias("page_impressions"),
        F.col("ctr_raw").alias("page_ctr_raw"), F.col("position").alias("page_position"))


def document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A larger query set: every line of every document (whole texts, empty
    lines included) as one query row; the metric fields are empty."""
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", F.posexplode(F.split(F.col("text"), "\n")).alias("line_no", "query"))
    return docs.select(
        "query",
        F.lit(None).cast("bigint").alias("clicks"),
        F.lit(None).cast("bigint").alias("impressions"),
        F.lit(None).cast("string").alias("ctr_raw"),
        F.lit(None).cast("double").alias("position"),
        (F.col("doc_id") * (1 << 31) + F.col("line_no")).alias("row_id"))


def surrogate_clusters(q: DataFrame) -> DataFrame:
    """Stand-in cluster ids SQL can state: the smallest row_id per
    (segment, last word of query_norm). Used to test the operators that
    follow clustering against SQL oracles."""
    last = F.element_at(F.split(F.col("query_norm"), " "), -1)
    keyed = q.withColumn("_lw", last)
    ids = keyed.groupBy("segment", "_lw").agg(F.min("row_id").alias("cluster_id"))
    return keyed.join(ids, ["segment", "_lw"]).drop("_lw")
