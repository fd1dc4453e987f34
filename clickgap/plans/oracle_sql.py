"""DuckDB oracle SQL, written independently of the Spark operators.

Each oracle restates the behaviour in plain SQL over the driver's tables
(the same derived views as the Spark side). Regexes are RE2 (``\\b`` and
``(?i)`` work); double literals are cast, since a bare 0.3 is a decimal.
Computed doubles are rounded to 6 places on both sides.
"""

from __future__ import annotations

import re

from clickgap.sources.fixtures import SEARCH_PAGES_SQL, SEARCH_QUERIES_SQL

D = "CAST({} AS DOUBLE)".format


def r6(expr: str) -> str:
    return f"round({expr}, 6)"


NORMALIZE = (r"trim(regexp_replace(regexp_replace(regexp_replace(lower(trim(coalesce({c}, 'nan'))), "
             r"'[’'']', '', 'g'), '[^a-z0-9\s\-]', ' ', 'g'), '\s+', ' ', 'g'))")

# Intent keyword defaults and fixture term lists, as RE2 alternations.
RX_NAV = r"(?i)\b(login|sign in|sign up|contact|customer service|phone number)\b"
RX_TRA = (r"(?i)\b(buy|order|pricing|price|cost|quote|book|booking|appointment|request|demo|hire|"
          r"agency|service|services|consultant|company|near me)\b")
RX_COM = r"(?i)\b(best|top|review|reviews|vs|compare|comparison|alternative|alternatives|rating|ratings)\b"
RX_INF = r"(?i)\b(how|what|why|guide|tutorial|definition|meaning|example|examples|tips)\b"
RX_BRAND = r"(?i)\bacme\b"
RX_COMPETITOR = r"(?i)\bpromo\b"
RX_PRODUCT_BRAND = r"(?i)\b(widget|widgets)\b"
RX_PRODUCT_NAME = r"(?i)\b(red bolt|blue gear)\b"
RX_EXCLUDE = r"(?i)\bstandard\b"

CTR_PARSE = (
    "CASE WHEN right(trim({c}), 1) = '%' "
    "THEN TRY_CAST(trim(left(trim({c}), length(trim({c})) - 1)) AS DOUBLE) / CAST(100 AS DOUBLE) "
    "ELSE TRY_CAST(trim({c}) AS DOUBLE) END")

BUCKET = ("CASE WHEN {c} IS NULL THEN 'unknown' WHEN {c} <= 3 THEN '1-3' WHEN {c} <= 6 THEN '4-6' "
          "WHEN {c} <= 10 THEN '7-10' WHEN {c} <= 20 THEN '11-20' ELSE '21+' END")

# CTE chain: sq -> parsed -> kept -> flags -> enriched -> seg (enriched queries)
ENRICHED_CTES = f"""
sq AS ({SEARCH_QUERIES_SQL}),
parsed AS (
  SELECT query, row_id, ctr_raw,
         CAST(clicks AS DOUBLE) AS clicks, CAST(impressions AS DOUBLE) AS impressions,
         CAST(position AS DOUBLE) AS position,
         {CTR_PARSE.format(c='ctr_raw')} AS ctr0,
         {NORMALIZE.format(c='query')} AS query_norm
  FROM sq),
kept AS (SELECT * FROM parsed WHERE NOT regexp_matches(query_norm, '{RX_EXCLUDE}')),
flags AS (
  SELECT *,
         CASE WHEN ctr0 IS NULL AND impressions > 0 THEN clicks / impressions ELSE ctr0 END AS ctr,
         regexp_matches(query_norm, '{RX_NAV}') AS m_nav,
         regexp_matches(query_norm, '{RX_TRA}') AS m_tra,
         regexp_matches(query_norm, '{RX_COM}') AS m_com,
         regexp_matches(query_norm, '{RX_INF}') AS m_inf,
         regexp_matches(query_norm, '{RX_BRAND}') AS is_branded,
         regexp_matches(query_norm, '{RX_COMPETITOR}') AS has_competitor,
         false AS has_local,
         regexp_matches(query_norm, '{RX_PRODUCT_BRAND}') AS has_product_brand,
         regexp_matches(query_norm, '{RX_PRODUCT_NAME}') AS has_product_name
  FROM kept),
enriched AS (
  SELECT *,
         CASE WHEN m_nav THEN 'navigational' WHEN m_tra THEN 'transactional'
              WHEN m_com THEN 'commercial' ELSE 'informational' END AS intent,
         least({D('0.55')} + {D('0.15')} * (m_nav::INT + m_tra::INT + m_com::INT + m_inf::INT),
               {D('0.95')}) AS intent_confidence,
         CASE WHEN is_branded THEN 'Branded' ELSE 'Non-Branded' END AS brand_label
  FROM flags),
seg AS (
  SELECT *, brand_label || ' - ' || intent
            || CASE WHEN has_competitor THEN ' - Competitor' ELSE '' END
            || CASE WHEN has_product_brand THEN ' - ProductBrand' ELSE '' END
            || CASE WHEN has_product_name THEN ' - ProductName' ELSE '' END AS segment
  FROM enriched)"""

# seg -> b -> med/overall -> expct -> scored -> banded (scored queries)
SCORED_CTES = ENRICHED_CTES + f""",
b AS (SELECT *, {BUCKET.format(c='position')} AS pos_bucket FROM seg),
med AS (SELECT pos_bucket, median(ctr) AS m FROM b GROUP BY pos_bucket),
overall AS (SELECT median(ctr) AS om FROM b),
floors AS (SELECT pos_bucket, CAST(fl AS DOUBLE) AS fl FROM (VALUES
   ('1-3', 0.15), ('4-6', 0.08), ('7-10', 0.04), ('11-20', 0.015), ('21+', 0.005), ('unknown', 0.01))
   t(pos_bucket, fl)),
expct AS (SELECT f.pos_bucket, greatest(coalesce(med.m, overall.om, {D('0.01')}), f.fl) AS expected_ctr
          FROM floors f LEFT JOIN med ON med.pos_bucket = f.pos_bucket CROSS JOIN overall),
scored AS (
  SELECT b.*, e.expected_ctr,
         coalesce(b.impressions * greatest({D('0')}, e.expected_ctr - b.ctr), {D('0')}) AS opportunity_clicks
  FROM b JOIN expct e ON e.pos_bucket = b.pos_bucket),
scored2 AS (
  SELECT *, ln(1 + clicks) * {D('1.0')} + ln(1 + opportunity_clicks) * {D('1.2')}
            + ln(1 + impressions) * {D('0.4')} AS priority_score
  FROM scored),
qt AS (SELECT quantile_cont(priority_score, 0.7) AS q70, quantile_cont(priority_score, 0.9) AS q90 FROM scored2),
banded AS (
  SELECT s.*, CASE WHEN priority_score >= q90 THEN 'P1' WHEN priority_score >= q70 THEN 'P2'
                   ELSE 'P3' END AS priority_band
  FROM scored2 s CROSS JOIN qt)"""

# pages: sp -> pp (parsed pages with slug / tokens)
PAGES_CTES = f"""
sp AS ({SEARCH_PAGES_SQL}),
pp AS (
  SELECT page, page_ord, CAST(clicks AS DOUBLE) AS page_clicks,
         CAST(impressions AS DOUBLE) AS page_impressions, CAST(position AS DOUBLE) AS page_position,
         CASE WHEN TRY_CAST(ctr_raw AS DOUBLE) IS NULL AND impressions > 0
              THEN CAST(clicks AS DOUBLE) / impressions ELSE TRY_CAST(ctr_raw AS DOUBLE) END AS page_ctr
  FROM sp)"""


_GRAMS = ("CROSS JOIN (VALUES {ns}) v(n) "
          "CROSS JOIN LATERAL (SELECT unnest(range(0, len(t) - n + 1)) AS i) r")

# TF-IDF per segment over distinct texts (weighted by their row counts)
TFIDF_CTES = ENRICHED_CTES + rf""",
texts AS (SELECT segment, query_norm, min(row_id) AS rep, count(*) AS mult FROM seg GROUP BY segment, query_norm),
ttok AS (SELECT segment, rep, query_norm, mult, regexp_extract_all(query_norm, '\b\w\w+\b') AS t FROM texts),
tgram AS (SELECT segment, rep, query_norm, mult, array_to_string(t[i + 1:i + n], ' ') AS term
          FROM ttok {_GRAMS.format(ns='(1), (2), (3)')}),
ttf AS (SELECT segment, rep, query_norm, mult, term, count(*) AS tf FROM tgram
        GROUP BY segment, rep, query_norm, mult, term),
tn AS (SELECT segment, CAST(sum(mult) AS BIGINT) AS n_docs FROM texts GROUP BY segment),
tterms AS (SELECT ttf.segment, term, CAST(sum(mult) AS BIGINT) AS df, tn.n_docs,
                  ln(CAST(tn.n_docs + 1 AS DOUBLE) / CAST(sum(mult) + 1 AS DOUBLE)) + 1 AS idf,
                  sum(mult) <= {D('0.95')} * tn.n_docs AS kept
           FROM ttf JOIN tn ON tn.segment = ttf.segment GROUP BY ttf.segment, term, tn.n_docs),
traw AS (SELECT f.segment, f.rep, f.query_norm, f.term, f.tf, t.df, f.tf * t.idf AS raw
         FROM ttf f JOIN tterms t ON t.segment = f.segment AND t.term = f.term WHERE t.kept),
tw AS (SELECT *, raw / sqrt(sum(raw * raw) OVER (PARTITION BY segment, rep)) AS w FROM traw)"""

PAIRS_CTES = f""",
pairs AS (SELECT x.segment, x.rep AS a, y.rep AS b, sum(x.w * y.w) AS sim
          FROM tw x JOIN tw y ON x.segment = y.segment AND x.term = y.term AND x.rep < y.rep
          GROUP BY x.segment, x.rep, y.rep HAVING sum(x.w * y.w) > {D('0.25')})"""

COMPONENT_CTES = """,
nodes AS (SELECT DISTINCT rep FROM tw),
edges AS (SELECT a AS x, b AS y FROM pairs UNION ALL SELECT b, a FROM pairs),
reach(src, dst) AS (SELECT rep, rep FROM nodes
                    UNION SELECT r.src, e.y FROM reach r JOIN edges e ON e.x = r.dst),
comp AS (SELECT src AS rep, min(dst) AS component FROM reach GROUP BY src)"""

# surrogate cluster id + topic labels over the scored queries
LABEL_CTES = SCORED_CTES + rf""",
sur AS (SELECT banded.*, min(row_id) OVER (PARTITION BY segment, regexp_extract(query_norm, '[^ ]*$')) AS cluster_id
        FROM banded),
ltok AS (SELECT cluster_id, row_id, list_filter(string_split(query_norm, ' '), lambda x: x <> '') AS t FROM sur),
lgram AS (SELECT cluster_id, row_id, n, i AS pos, array_to_string(t[i + 1:i + n], ' ') AS gram
          FROM ltok {_GRAMS.format(ns='(3), (2)')}),
lcnt AS (SELECT cluster_id, gram, count(*) AS cnt, min(n) AS n,
                min(row_id * 1000000 + (3 - n) * 100000 + pos) AS first
         FROM lgram GROUP BY cluster_id, gram),
lrank AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY cnt DESC, first) AS rnk FROM lcnt),
lsize AS (SELECT cluster_id, count(*) AS size, arg_min(query_norm, row_id) AS fallback FROM sur GROUP BY cluster_id),
lbest AS (SELECT r.cluster_id, arg_max(r.gram, r.cnt * r.n * 1000 - r.rnk) AS best
          FROM lrank r JOIN lsize s ON s.cluster_id = r.cluster_id
          WHERE r.rnk <= 50 AND r.cnt >= greatest(2, floor({D('0.3')} * s.size)) GROUP BY r.cluster_id),
topics AS (SELECT s.cluster_id, coalesce(b.best, s.fallback) AS topic_label
           FROM lsize s LEFT JOIN lbest b ON b.cluster_id = s.cluster_id),
lq AS (SELECT sur.*, topics.topic_label FROM sur JOIN topics ON topics.cluster_id = sur.cluster_id)"""

MERGE_CTES = r""",
ctopic AS (SELECT DISTINCT intent, cluster_id, topic_label FROM lq),
cword AS (SELECT DISTINCT * FROM (SELECT intent, cluster_id,
            unnest(list_filter(string_split_regex(lower(topic_label), '\s+'), lambda w: w <> '')) AS word
          FROM ctopic)),
irr AS (SELECT * FROM (VALUES ('child', 'children'), ('children', 'child'), ('person', 'people'),
          ('people', 'person'), ('mouse', 'mice'), ('mice', 'mouse'), ('foot', 'feet'), ('feet', 'foot'),
          ('tooth', 'teeth'), ('teeth', 'tooth'), ('goose', 'geese'), ('geese', 'goose')) t(w, f)),
cform AS (SELECT intent, cluster_id, word || 's' AS f FROM cword
          UNION ALL SELECT intent, cluster_id, word || 'es' FROM cword
          UNION ALL SELECT intent, cluster_id, left(word, length(word) - 1) || 'ies' FROM cword WHERE word LIKE '%y'
          UNION ALL SELECT c.intent, c.cluster_id, irr.f FROM cword c JOIN irr ON irr.w = c.word),
mpairs AS (SELECT DISTINCT a.cluster_id AS x, b.cluster_id AS y FROM cform a
           JOIN cword b ON a.intent = b.intent AND a.f = b.word WHERE a.cluster_id <> b.cluster_id),
moves AS (SELECT greatest(x, y) AS cid, min(least(x, y)) AS new_id FROM mpairs GROUP BY greatest(x, y)),
merged AS (SELECT lq.row_id, coalesce(moves.new_id, lq.cluster_id) AS cluster_id
           FROM lq LEFT JOIN moves ON moves.cid = lq.cluster_id)"""

CLUSTER_CTES = LABEL_CTES + """,
cm AS (SELECT cluster_id, topic_label, segment, brand_label, intent, count(query) AS queries,
              sum(clicks) AS clicks, sum(impressions) AS impressions, avg(position) AS avg_position,
              sum(opportunity_clicks) AS opportunity_clicks, avg(priority_score) AS priority_score
       FROM lq GROUP BY cluster_id, topic_label, segment, brand_label, intent),
ranked5 AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY impressions DESC, row_id) AS rn FROM lq),
ex AS (SELECT cluster_id, string_agg(coalesce(query, 'nan'), ' | ' ORDER BY rn) AS example_queries
       FROM ranked5 WHERE rn <= 5 GROUP BY cluster_id),
rep AS (SELECT cluster_id, string_agg(query_norm, ' ' ORDER BY rn) AS rep FROM ranked5 WHERE rn <= 5 GROUP BY cluster_id),
cq AS (SELECT quantile_cont(priority_score, 0.7) AS q70, quantile_cont(priority_score, 0.9) AS q90 FROM cm),
ct AS (SELECT cm.*, ex.example_queries,
              CASE WHEN cm.priority_score >= cq.q90 THEN 'P1' WHEN cm.priority_score >= cq.q70 THEN 'P2'
                   ELSE 'P3' END AS priority_band, cm.intent AS dominant_intent
       FROM cm LEFT JOIN ex ON ex.cluster_id = cm.cluster_id CROSS JOIN cq)"""

_PATH = (r"regexp_replace(regexp_replace(regexp_extract(regexp_replace(regexp_replace({c}, '[\t\r\n]', '', 'g'), "
         r"'^[\x00-\x20]+', ''), '^(?:[a-zA-Z][a-zA-Z0-9+.\-]*:)?(?://[^/?#]*)?([^?#]*)', 1), "
         r"';[^/]*$', ''), '^/+|/+$', '', 'g')")

MATCH_CTES = CLUSTER_CTES + f""",
sp AS ({SEARCH_PAGES_SQL}),
pp AS (SELECT page, page_ord, CAST(clicks AS DOUBLE) AS page_clicks, CAST(impressions AS DOUBLE) AS page_impressions,
              CAST(position AS DOUBLE) AS page_position,
              CASE WHEN TRY_CAST(ctr_raw AS DOUBLE) IS NULL AND impressions > 0
                   THEN CAST(clicks AS DOUBLE) / impressions ELSE TRY_CAST(ctr_raw AS DOUBLE) END AS page_ctr,
              {_PATH.format(c='page')} AS ppath
       FROM sp),
ppt AS (SELECT *, CASE WHEN ppath = '' THEN 'home' ELSE ppath END AS slug,
               CASE WHEN ppath = '' THEN ['home'] ELSE
                 list_filter(list_transform(regexp_split_to_array(ppath, '[/\\-_]+'),
                                            lambda t: regexp_replace(lower(t), '[^a-z0-9]', '', 'g')),
                             lambda t: t <> '' AND t NOT IN ('amp', 'utm', 'http', 'https', 'www', 'com')) END AS page_tokens
        FROM pp),
docs AS (SELECT 'c' AS side, CAST(ct.cluster_id AS VARCHAR) || '|' || ct.topic_label || '|' || ct.segment AS doc,
                lower(ct.topic_label || ' ' || ct.dominant_intent || ' ' || coalesce(rep.rep, '')) AS text
         FROM ct LEFT JOIN rep ON rep.cluster_id = ct.cluster_id
         UNION ALL SELECT 'p', CAST(page_ord AS VARCHAR), array_to_string(page_tokens, ' ') FROM ppt),
dtok AS (SELECT side, doc, regexp_extract_all(lower(text), '\\b\\w\\w+\\b') AS t FROM docs),
dgram AS (SELECT side, doc, array_to_string(t[i + 1:i + n], ' ') AS term FROM dtok {_GRAMS.format(ns='(1), (2), (3)')}),
dtf AS (SELECT side, doc, term, count(*) AS tf FROM dgram GROUP BY side, doc, term),
dn AS (SELECT count(*) AS n FROM docs),
ddf AS (SELECT term, count(*) AS df FROM dtf GROUP BY term),
dw0 AS (SELECT dtf.side, dtf.doc, dtf.term,
               dtf.tf * (ln(CAST(dn.n + 1 AS DOUBLE) / CAST(ddf.df + 1 AS DOUBLE)) + 1) AS raw
        FROM dtf JOIN ddf ON ddf.term = dtf.term CROSS JOIN dn),
dw AS (SELECT *, raw / sqrt(sum(raw * raw) OVER (PARTITION BY side, doc)) AS w FROM dw0),
sc AS (SELECT c.doc AS ckey, CAST(p.doc AS BIGINT) AS page_ord, sum(c.w * p.w) AS score
       FROM dw c JOIN dw p ON c.term = p.term WHERE c.side = 'c' AND p.side = 'p' GROUP BY c.doc, p.doc),
first2 AS (SELECT page_ord FROM ppt ORDER BY page_ord LIMIT 2),
ckeys AS (SELECT doc AS ckey FROM docs WHERE side = 'c'),
cand AS (SELECT ckey, page_ord, max(score) AS score FROM (
           SELECT * FROM sc UNION ALL SELECT ckey, page_ord, {D('0')} FROM ckeys CROSS JOIN first2)
         GROUP BY ckey, page_ord),
rk AS (SELECT cand.*, ppt.page,
              row_number() OVER (PARTITION BY ckey ORDER BY round(score, 12) DESC, cand.page_ord) AS r
       FROM cand JOIN ppt ON ppt.page_ord = cand.page_ord),
top2 AS (SELECT ckey, max(CASE WHEN r = 1 THEN page END) AS primary_page,
                max(CASE WHEN r = 1 THEN score END) AS match_score,
                max(CASE WHEN r = 2 THEN page END) AS runner_up_page,
                coalesce(max(CASE WHEN r = 2 THEN score END), {D('0')}) AS runner_up_score
         FROM rk WHERE r <= 2 GROUP BY ckey),
cf0 AS (SELECT ct.*, top2.primary_page, top2.match_score, top2.runner_up_page, top2.runner_up_score,
               (top2.match_score - top2.runner_up_score < {D('0.03')}) AND (top2.match_score > {D('0.12')})
                 AS cannibalisation_risk
        FROM ct JOIN top2 ON top2.ckey = CAST(ct.cluster_id AS VARCHAR) || '|' || ct.topic_label || '|' || ct.segment),
cf AS (SELECT *, CASE WHEN cannibalisation_risk THEN 'Fix cannibalisation'
                      WHEN dominant_intent = 'transactional' AND avg_position > 10 THEN 'Build/upgrade landing page'
                      WHEN avg_position <= 10 THEN 'CTR/snippet + internal links'
                      ELSE 'Content refresh + topical authority' END AS recommended_action
       FROM cf0),
qf AS (SELECT lq.*, m.primary_page FROM lq LEFT JOIN (SELECT DISTINCT cluster_id, primary_page FROM cf) m
       ON m.cluster_id = lq.cluster_id)"""

PAGE_TABLE_CTES = """,
pall AS (SELECT a.*, ppt.slug, ppt.page_impressions, ppt.page_clicks, ppt.page_ctr, ppt.page_position,
                CASE WHEN a.impressions = 0 THEN NULL ELSE a.actual_clicks / a.impressions END AS ctr
         FROM (SELECT primary_page AS page, count(cluster_id) AS clusters, sum(impressions) AS impressions,
                      sum(clicks) AS actual_clicks, sum(opportunity_clicks) AS opportunity_clicks,
                      avg(avg_position) AS avg_position
               FROM cf WHERE primary_page IS NOT NULL GROUP BY primary_page) a
         LEFT JOIN ppt ON ppt.page = a.page),
pseg AS (SELECT a.*, CASE WHEN a.impressions = 0 THEN NULL ELSE a.actual_clicks / a.impressions END AS ctr,
                ppt.slug, ppt.page_clicks, ppt.page_impressions, ppt.page_ctr, ppt.page_position
         FROM (SELECT primary_page AS page, segment, brand_label, intent, sum(impressions) AS impressions,
                      sum(clicks) AS actual_clicks, sum(opportunity_clicks) AS opportunity_clicks,
                      avg(position) AS avg_position
               FROM qf WHERE primary_page IS NOT NULL GROUP BY primary_page, segment, brand_label, intent) a
         LEFT JOIN ppt ON ppt.page = a.page)"""

_RISK_LEVEL = (f"CASE WHEN {{d}} < {D('0.01')} THEN 'High' WHEN {{d}} < {D('0.02')} THEN 'Medium' ELSE 'Low' END")

RISK_CTES = f""",
flagged AS (SELECT * FROM cf WHERE cannibalisation_risk),
risk_same AS (
  SELECT a.cluster_id AS primary_cluster_id, a.topic_label AS primary_topic, a.intent AS primary_intent,
         b.cluster_id AS competing_cluster_id, b.topic_label AS competing_topic, b.intent AS competing_intent,
         a.primary_page AS shared_page, round(a.match_score, 6) AS primary_match_score,
         round(b.match_score, 6) AS runner_up_match_score,
         round(abs(a.match_score - b.match_score), 6) AS score_difference,
         {_RISK_LEVEL.format(d='abs(a.match_score - b.match_score)')} AS risk_level
  FROM flagged a JOIN flagged b ON a.primary_page = b.primary_page AND a.cluster_id < b.cluster_id),
risk_runner AS (
  SELECT a.cluster_id AS primary_cluster_id, a.topic_label AS primary_topic, a.intent AS primary_intent,
         b.cluster_id AS competing_cluster_id, b.topic_label AS competing_topic, b.intent AS competing_intent,
         a.runner_up_page AS shared_page, round(a.match_score, 6) AS primary_match_score,
         round(a.runner_up_score, 6) AS runner_up_match_score,
         round(abs(a.match_score - a.runner_up_score), 6) AS score_difference,
         {_RISK_LEVEL.format(d='abs(a.match_score - a.runner_up_score)')} AS risk_level
  FROM flagged a JOIN flagged b ON b.primary_page = a.runner_up_page
  WHERE a.runner_up_page IS NOT NULL AND a.runner_up_page <> a.primary_page)"""

EFFORT_CTES = """,
effort AS (SELECT cf.*, CASE recommended_action WHEN 'CTR/snippet + internal links' THEN 1
                          WHEN 'Content refresh + topical authority' THEN 2 WHEN 'Fix cannibalisation' THEN 3
                          WHEN 'Build/upgrade landing page' THEN 4 ELSE 99 END AS effort_level,
                  CASE recommended_action WHEN 'CTR/snippet + internal links' THEN 'Low Effort'
                          WHEN 'Content refresh + topical authority' THEN 'Medium Effort'
                          WHEN 'Fix cannibalisation' THEN 'Medium-High Effort'
                          WHEN 'Build/upgrade landing page' THEN 'High Effort' ELSE 'Unknown' END AS effort_label
           FROM cf)"""

KEYWORD_CTES = """,
ctopic_last AS (SELECT cluster_id, max(topic_label) AS topic_label FROM cf GROUP BY cluster_id),
kw AS (SELECT qf.query, qf.cluster_id, tl.topic_label, qf.segment,
              coalesce(c.intent, qf.intent) AS intent, coalesce(c.brand_label, qf.brand_label) AS brand_label,
              qf.has_competitor, qf.has_local, qf.has_product_brand, qf.has_product_name,
              qf.clicks, qf.impressions, qf.ctr, qf.position, qf.opportunity_clicks, qf.priority_score,
              qf.priority_band, qf.primary_page
       FROM qf LEFT JOIN cf c ON c.cluster_id = qf.cluster_id
       LEFT JOIN ctopic_last tl ON tl.cluster_id = qf.cluster_id)"""


DOC_LINES_SQL = """
SELECT line AS query, CAST(NULL AS BIGINT) AS clicks, CAST(NULL AS BIGINT) AS impressions,
       CAST(NULL AS VARCHAR) AS ctr_raw, CAST(NULL AS DOUBLE) AS position,
       doc_id * 2147483648 + line_no AS row_id
FROM (SELECT doc_id, generate_subscripts(parts, 1) - 1 AS line_no, unnest(parts) AS line
      FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents))"""

# the same enrichment and TF-IDF chain over document lines
DOC_TFIDF_CTES = (ENRICHED_CTES.replace(f"sq AS ({SEARCH_QUERIES_SQL})", f"sq AS ({DOC_LINES_SQL})", 1)
                  + TFIDF_CTES[len(ENRICHED_CTES):])


def with_ctes(ctes: str, body: str) -> str:
    head = "WITH RECURSIVE " if "reach(src, dst)" in ctes or "link(it, rep, c)" in ctes else "WITH "
    return head + ctes.strip() + "\n" + body

# average linkage as merge rounds: each step of the recursion holds every
# text with its cluster; the closest pairs that choose each other merge
_LINK_ROUNDS = """
link(it, rep, c) AS (
  SELECT 0, rep, rep FROM linksize
  UNION ALL
  (WITH cur AS (SELECT * FROM link),
        sz AS (SELECT cur.c, sum(linksize.m) AS n FROM cur JOIN linksize ON linksize.rep = cur.rep GROUP BY cur.c),
        pr AS (SELECT least(x.c, y.c) AS a, greatest(x.c, y.c) AS b, sum(ldot.d) AS dot
               FROM ldot JOIN cur x ON x.rep = ldot.a JOIN cur y ON y.rep = ldot.b
               WHERE x.c <> y.c GROUP BY 1, 2),
        sim AS (SELECT pr.a, pr.b, round(pr.dot / (p.n * q.n), 12) AS s
                FROM pr JOIN sz p ON p.c = pr.a JOIN sz q ON q.c = pr.b
                WHERE round(pr.dot / (p.n * q.n), 12) > {cut}),
        ends AS (SELECT a AS c, a, b, s FROM sim UNION ALL SELECT b, a, b, s FROM sim),
        best AS (SELECT c, a, b FROM ends QUALIFY row_number() OVER (PARTITION BY c ORDER BY s DESC, a, b) = 1),
        mg AS (SELECT a AS kept, b AS gone FROM best GROUP BY a, b HAVING count(*) = 2)
   SELECT cur.it + 1, cur.rep, coalesce(mg.kept, cur.c) FROM cur LEFT JOIN mg ON mg.gone = cur.c
   WHERE EXISTS (SELECT 1 FROM mg))),
linked AS (SELECT rep, c FROM link WHERE it = (SELECT max(it) FROM link))"""

LINK_CTES = TFIDF_CTES + """,
linksize AS MATERIALIZED (SELECT rep, CAST(mult AS DOUBLE) AS m FROM texts WHERE rep IN (SELECT rep FROM tw)),
ldot AS MATERIALIZED (
  SELECT x.rep AS a, y.rep AS b, sum(x.w * y.w) * any_value(p.m) * any_value(q.m) AS d
  FROM tw x JOIN tw y ON x.segment = y.segment AND x.term = y.term AND x.rep < y.rep
  JOIN linksize p ON p.rep = x.rep JOIN linksize q ON q.rep = y.rep
  GROUP BY x.rep, y.rep),""" + _LINK_ROUNDS.format(cut=D("0.25")) + """,
clustered AS (
  SELECT s.row_id, s.segment, CASE
    WHEN s.segment NOT IN (SELECT segment FROM tw) THEN min(s.row_id) OVER (PARTITION BY s.segment)
    ELSE coalesce(l.c, s.row_id) END AS cluster_id
  FROM seg s JOIN texts t ON t.segment = s.segment AND t.query_norm = s.query_norm
  LEFT JOIN linked l ON l.rep = t.rep)"""

# document lines: dot products inside components only (no merge crosses one)
DOC_LINK_CTES = DOC_TFIDF_CTES + PAIRS_CTES + COMPONENT_CTES + """,
linksize AS MATERIALIZED (SELECT rep, CAST(mult AS DOUBLE) AS m FROM texts WHERE rep IN (SELECT rep FROM tw)),
ldot AS MATERIALIZED (
  SELECT x.rep AS a, y.rep AS b, sum(x.w * y.w) * any_value(p.m) * any_value(q.m) AS d
  FROM comp g JOIN comp h ON g.component = h.component AND g.rep < h.rep
  JOIN tw x ON x.rep = g.rep JOIN tw y ON y.rep = h.rep AND y.term = x.term
  JOIN linksize p ON p.rep = x.rep JOIN linksize q ON q.rep = y.rep
  GROUP BY x.rep, y.rep),""" + _LINK_ROUNDS.format(cut=D("0.25")) + LINK_CTES[LINK_CTES.index(",\nclustered AS"):]

EMBEDDING_LINK_CTES = """
unit AS MATERIALIZED (
  SELECT vec_id AS rep, label, list_transform(CAST(embedding AS DOUBLE[]),
           lambda x: x / sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])))) AS v
  FROM embeddings WHERE list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])) > 0),
linksize AS MATERIALIZED (SELECT rep, CAST(1 AS DOUBLE) AS m FROM unit),
ldot AS MATERIALIZED (SELECT x.rep AS a, y.rep AS b, list_dot_product(x.v, y.v) AS d
                      FROM unit x JOIN unit y ON x.label = y.label AND x.rep < y.rep),""" + \
    _LINK_ROUNDS.format(cut=D("0.25"))

def _after(ctes: str, head: str) -> str:
    assert ctes.startswith(head)
    return ctes[len(head):]


# the full run: real clusters, labels, plural merge, then scoring's clusters
# and pages as for the surrogate clusters
_LABELLED = _after(LABEL_CTES, SCORED_CTES)
_SUR = _LABELLED[:_LABELLED.index(",\nltok AS")]
RUN_CTES = (
    SCORED_CTES + _after(LINK_CTES, ENRICHED_CTES)
    + """,
sur AS (SELECT banded.*, clustered.cluster_id FROM banded JOIN clustered ON clustered.row_id = banded.row_id)"""
    + re.sub(r"\blq\b", "lq0", _LABELLED[len(_SUR):] + MERGE_CTES)
    + """,
lq AS (SELECT lq0.* REPLACE (merged.cluster_id AS cluster_id) FROM lq0 JOIN merged ON merged.row_id = lq0.row_id)"""
    + _after(CLUSTER_CTES, LABEL_CTES) + _after(MATCH_CTES, CLUSTER_CTES))

# semantic clusters: segments whose rows all have a vector by the vectors,
# the others by their texts
_TEXT_LINK = _after(LINK_CTES, ENRICHED_CTES)
for _name in ("linksize", "ldot", "link", "linked"):
    _TEXT_LINK = re.sub(rf"\b{_name}\b", f"t{_name}", _TEXT_LINK)
SEMANTIC_CTES = ENRICHED_CTES + _TEXT_LINK + """,
dense AS (SELECT s.segment, bool_and(e.vec_id IS NOT NULL) AS dense
          FROM seg s LEFT JOIN embeddings e ON NOT s.is_branded AND e.vec_id = s.row_id % (SELECT count(*) FROM embeddings)
          GROUP BY s.segment),
unit AS MATERIALIZED (
  SELECT s.row_id AS rep, s.segment AS label, list_transform(CAST(embedding AS DOUBLE[]),
           lambda x: x / sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])))) AS v
  FROM seg s JOIN dense d ON d.segment = s.segment AND d.dense
  JOIN embeddings e ON e.vec_id = s.row_id % (SELECT count(*) FROM embeddings)
  WHERE list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])) > 0)""" + \
    EMBEDDING_LINK_CTES[EMBEDDING_LINK_CTES.index(",\nlinksize AS"):]
