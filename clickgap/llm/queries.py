"""The registered queries of this subpackage: thin digests over the
operators, each over its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (balltree, contextual, hilbert, ordinal, poisson, rlz, sketch, toolcalls, toxconv, triecode, vamana,
               winnow, wrapper)
from .common import table


def rating_grade():
    """Grade 0 to 2 of a rated document: good quality and not toxic count
    one each; a null rating has no grade."""
    return F.col("quality") + (1 - F.col("toxic"))


def quality_model(docs: DataFrame, labels: DataFrame) -> ordinal.Model | None:
    return ordinal.fit(docs, labels, rating_grade(), grades=3)


def op1_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected grade, probability of the top grade and the decision for
    every document."""
    docs = table(spark, sf_dir, "documents")
    return ordinal.score(docs, quality_model(docs, table(spark, sf_dir, "labels")))


def op2_wrapper_induction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    out = wrapper.extract(table(spark, sf_dir, "pages"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op3_pruned_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """10 nearest of every embedding whose vec_id is divisible by 100."""
    return vamana.neighbours(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op4_relative_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without repeated passages of 20 words."""
    return rlz.parse(table(spark, sf_dir, "documents"), with_text=False).drop("factors")


def op5_hilbert_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 shards of the Hilbert curve over lang, source
    and n_chars; counts at most one apart."""
    s = hilbert.document_shards(table(spark, sf_dir, "documents"))
    return s.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                    F.lit(None).cast("int").alias("grown_shard"), "curve")


def op6_similarity_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all documents."""
    return sketch.groups(table(spark, sf_dir, "documents"))


def op7_poisson_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents repeated to source shares of n^0.7, in shuffled order."""
    m = poisson.mix(table(spark, sf_dir, "documents"))
    return m.select("doc_id", "source", "copies", "replica", "shuffle_key")


OP7_SQL = """
WITH RECURSIVE counts AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
goal AS (SELECT sum(n) AS n, sum(pow(n::DOUBLE, 0.7)) AS w FROM counts),
rates AS (SELECT source, pow(c.n::DOUBLE, 0.7) * goal.n::DOUBLE / goal.w / c.n AS rate FROM counts c, goal),
pieces AS (SELECT source, greatest(ceil(rate / 500.0), 1)::INT AS pieces,
                  rate / greatest(ceil(rate / 500.0), 1) AS rate FROM rates),
cdf AS (
  SELECT source, 0 AS k, rate, exp(-rate) AS term, exp(-rate) AS cum FROM pieces
  UNION ALL
  SELECT source, k + 1, rate, term * rate / (k + 1), cum + term * rate / (k + 1) FROM cdf
  WHERE k < ceil(rate + 12 * sqrt(rate) + 40)),
who AS (
  SELECT doc_id, source, coalesce(CAST(doc_id AS VARCHAR), '?') || ':' || md5(coalesce(text, '')) AS who,
         row_number() OVER () AS r
  FROM documents),
draw AS (
  SELECT w.r, w.doc_id, w.source, w.who,
         CAST('0x' || substr(md5('17:' || j || ':' || who), 1, 13) AS BIGINT) / 4503599627370496.0 AS u
  FROM (SELECT who.*, p.pieces, unnest(range(1, p.pieces + 1)) AS j
        FROM who JOIN pieces p ON who.source IS NOT DISTINCT FROM p.source) w),
drawn AS (
  SELECT d.r, d.doc_id, d.source, d.who, count(c.k) AS copies
  FROM draw d LEFT JOIN cdf c ON d.source IS NOT DISTINCT FROM c.source AND c.cum <= d.u
  GROUP BY ALL)
SELECT doc_id, source, CAST(copies AS INT) AS copies, CAST(i AS INT) AS replica,
       md5('order 17:' || who || ':' || i) AS shuffle_key
FROM (SELECT *, unnest(range(1, copies + 1)) AS i FROM drawn)
"""


def op8_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark decontamination of every document."""
    r = winnow.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return r.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                    F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated")


OP8_SQL = r"""
WITH fold AS (
  SELECT doc_id, row_number() OVER () AS r,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
           'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
item AS (
  SELECT CAST(item_id AS VARCHAR) AS item,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
           'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
item_win AS (
  SELECT DISTINCT item, n, array_to_string(w[i:i + n - 1], ' ') AS win
  FROM (SELECT item, w, least(13, len(w)) AS n,
               unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i
        FROM item WHERE len(w) > 0)),
doc_win AS (
  SELECT r, i, n, array_to_string(w[i:i + n - 1], ' ') AS win
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i
        FROM fold, (SELECT DISTINCT n FROM item_win) WHERE len(w) >= n)),
hit AS (SELECT d.r, d.i, d.n, b.item FROM doc_win d JOIN item_win b ON d.n = b.n AND d.win = b.win),
word AS (SELECT r, count(DISTINCT p) AS n_hit
         FROM (SELECT r, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT r, i, n FROM hit)) GROUP BY r),
items AS (SELECT r, count(DISTINCT item) AS n_items,
                 string_agg(item, ',' ORDER BY item) AS ids
          FROM (SELECT DISTINCT r, item FROM hit) GROUP BY r)
SELECT f.doc_id, CAST(len(f.w) AS BIGINT) AS n_words,
       CAST(coalesce(word.n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(items.n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items.ids, '')) AS items_sha256,
       coalesce(word.n_hit, 0) > 0 AND 20 * coalesce(word.n_hit, 0) >= len(f.w) AS contaminated
FROM fold f LEFT JOIN word ON word.r = f.r LEFT JOIN items ON items.r = f.r
"""

#: tools of the stand-in conversations (fixed values)
TOOLS = [
    ("convert", "unit", "string", True),
    ("convert", "value", "number", True),
    ("lookup", "key", "string", True),
    ("lookup", "strict", "boolean", False),
    ("search", "limit", "integer", False),
    ("search", "query", "string", True),
]


def tool_conversations(conversations: DataFrame) -> DataFrame:
    """Stand-in messages: each assistant turn makes one or two calls whose
    string argument is its whole text (some against the schema, the second
    using the first), and each later user turn is taken for the result of an
    earlier call. Only the input schema of the operator; nothing is linked,
    ordered or checked here."""
    t = F.coalesce("text", F.lit(""))
    me = F.concat(F.lit("c"), F.col("turn").cast("string"))
    size = F.length(t)
    args = F.when(size % 3 == 0, F.to_json(F.struct(t.alias("query"), (size % 20).alias("limit")))) \
        .when(size % 3 == 1, F.to_json(F.struct((size / 8).alias("value"), t.alias("unit")))) \
        .otherwise(F.to_json(F.struct((size % 5 > 1).alias("strict"), F.when(size % 7 > 0, t).alias("key"),
                                      F.when(size % 7 == 0, t).alias("word"))))   # against the schema: no key
    name = F.element_at(F.array(F.lit("search"), F.lit("convert"), F.lit("lookup")), (size % 3 + 1).cast("int"))
    first = F.struct(me.alias("id"), name.alias("name"), args.alias("arguments"))
    second = F.struct(F.concat(me, F.lit("b")).alias("id"), F.lit("search").alias("name"),
                      F.to_json(F.struct(F.concat(F.lit("$"), me).alias("query"))).alias("arguments"))
    calls = F.when((F.col("role") == "assistant") & (size % 2 == 0), F.array(first, second)) \
        .when(F.col("role") == "assistant", F.array(first))
    answer = (F.col("role") == "user") & (F.col("turn") > 0)
    return conversations.select(
        "conv_id", "turn", F.when(answer, F.lit("tool")).otherwise(F.col("role")).alias("role"), "text",
        calls.alias("calls"), F.when(answer, F.concat(F.lit("c"), (F.col("turn") - 1).cast("string"),
                                                      F.when(size % 4 == 0, "b").otherwise(""))).alias("result_of"))


def op9_tool_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls and results of all conversations, linked, ordered, checked and
    serialised."""
    schemas = spark.createDataFrame(TOOLS, "tool string, field string, type string, required boolean")
    out = toolcalls.link(tool_conversations(table(spark, sf_dir, "conversations")), schemas)
    return out.withColumn("errors", F.array_join("errors", "; "))


def op10_contextual_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document: base spans, and those that
    bootstrapped contexts add."""
    found = contextual.extract(table(spark, sf_dir, "documents"))
    counts = [F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
              for k in contextual.KINDS]
    return found.select("doc_id", *counts, F.sha2(contextual.span_text(F.col("base")), 256).alias("base_sha256"),
                        contextual.span_text(F.col("spans")).alias("spans"))


def op11_trie_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Product codes of all embeddings after four rounds, with the errors."""
    codes, _ = triecode.compress(table(spark, sf_dir, "embeddings"))
    return codes.drop("label")


def op11_sql(rounds: int = triecode.ROUNDS) -> str:
    """The rounds one after the other, every part against every entry."""
    ctes = ["""
kept AS (
  SELECT vec_id, label, len(embedding) // 4 AS d, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""", """
part AS MATERIALIZED (
  SELECT vec_id, p, i - p * d AS j, v[i + 1] AS x
  FROM (SELECT vec_id, d, v, unnest(range(0, len(v))) AS i, unnest(range(0, len(v))) // d AS p FROM kept))""", """
book0 AS MATERIALIZED (
  SELECT p, r AS e, j, x FROM part JOIN
    (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS r FROM kept) USING (vec_id) WHERE r < 256)"""]
    for k in range(rounds + 1):
        ctes.append(f"""
near{k} AS MATERIALIZED (
  SELECT vec_id, p, arg_min(e, (dist, e)) AS e, min(dist) AS dist
  FROM (SELECT a.vec_id, a.p, b.e, CAST(sum((a.x - b.x) * (a.x - b.x)) AS BIGINT) AS dist
        FROM part a JOIN book{k} b ON a.p = b.p AND a.j = b.j GROUP BY ALL) GROUP BY ALL)""")
        if k < rounds:
            ctes.append(f"""
book{k + 1} AS MATERIALIZED (
  SELECT p, e, j, coalesce(m.x, b.x) AS x FROM book{k} b LEFT JOIN
    (SELECT n.p, n.e, a.j, CAST(sum(a.x) AS BIGINT) // count(*)
            - CASE WHEN CAST(sum(a.x) AS BIGINT) % count(*) < 0 THEN 1 ELSE 0 END AS x
     FROM near{k} n JOIN part a USING (vec_id, p) GROUP BY ALL) m USING (p, e, j))""")
    return "WITH " + ",".join(ctes) + f""",
coded AS (
  SELECT k.vec_id, k.label, string_agg(printf('%02x', n.e), '' ORDER BY n.p) AS code, CAST(sum(n.dist) AS BIGINT) AS error
  FROM kept k JOIN near{rounds} n USING (vec_id) GROUP BY ALL)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
       (SELECT sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY p, e, j)) FROM book{rounds}) AS codebooks_sha256
FROM coded
"""


def op12_ball_tree_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 best documents of every benchmark item."""
    return balltree.rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP12_SQL = r"""
WITH doc AS (
  SELECT doc_id, row_number() OVER () AS r, len(t) AS n, t
  FROM (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
          'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents)),
item AS (
  SELECT item_id, row_number() OVER () AS i, unnest(t) AS term
  FROM (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
          'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM benchmark)),
total AS (SELECT CAST(count(*) AS BIGINT) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM doc WHERE n > 0),
tf AS (
  SELECT r, n, term, CAST(count(*) AS BIGINT) AS tf FROM (SELECT r, n, unnest(t) AS term FROM doc)
  WHERE term IN (SELECT term FROM item) GROUP BY ALL),
weight AS (
  SELECT term, CAST(floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1))) AS BIGINT) AS w
  FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), total),
score AS (
  SELECT i.item_id, i.i, t.r, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * docs) // terms)))) AS BIGINT) AS score
  FROM item i JOIN weight USING (term) JOIN tf t USING (term), total GROUP BY ALL)
SELECT item_id, CAST(rank AS INT) AS rank, doc_id, score
FROM (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST) AS rank
      FROM score JOIN doc USING (r) WHERE score > 0)
WHERE rank <= 10
"""


def op13_convolutional_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document; a quarter of the labels, by the checksum
    of the id, is held out of the fit."""
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    model = toxconv.fit(docs, table(spark, sf_dir, "labels").where(~held_out))
    return toxconv.score(docs, model).select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"),
        "threshold", "toxic")


QUERIES = {
    "op1_ordinal_quality": op1_ordinal_quality,
    "op2_wrapper_induction": op2_wrapper_induction,
    "op3_pruned_graph": op3_pruned_graph,
    "op4_relative_parse": op4_relative_parse,
    "op5_hilbert_sharding": op5_hilbert_sharding,
    "op6_similarity_sketch": op6_similarity_sketch,
    "op7_poisson_mix": op7_poisson_mix,
    "op8_winnowing": op8_winnowing,
    "op9_tool_links": op9_tool_links,
    "op10_contextual_pii": op10_contextual_pii,
    "op11_trie_codes": op11_trie_codes,
    "op12_ball_tree_search": op12_ball_tree_search,
    "op13_convolutional_toxicity": op13_convolutional_toxicity,
}

ORACLES = {
    "op7_poisson_mix": OP7_SQL,
    "op8_winnowing": OP8_SQL,
    "op11_trie_codes": op11_sql(),
    "op12_ball_tree_search": OP12_SQL,
}
