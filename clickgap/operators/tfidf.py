"""TF-IDF as a long table (stratum, doc, term, weight) or a row a document.

Vectoriser semantics being matched: tokens of two or more word characters
from the lower-cased text, word 1-3-grams (every occurrence counted), raw
term frequency, smooth idf ``ln((1 + n) / (1 + df)) + 1``, optional
pruning of terms with ``df > max_df * n``, then L2 normalisation per doc.

Documents can be weighted (``mult``): identical texts are vectorised once
and counted ``mult`` times in n and df, which gives exactly the weights of
vectorising every copy, without exploding duplicate rows.

``term_table`` counts terms by DataFrame operations. The weights come from
blocks of texts (``grams``): a block asks for the frequencies of its distinct
grams by hash and gets them back in the same order, so no row a gram is
shuffled or joined; rows a term are only made of the finished vectors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickgap.functions.text import ngrams, word_tokens
from clickgap.operators import grams as G
from clickgap.session import materialize, ship_package

BROADCAST_STRATA = 100_000      # strata whose counts are broadcast
BLOCK_BYTES = 4 << 20           # text that a task turns into grams at once
LEAST_BYTES = 1 << 18           # text that is not cut for parallel work
PARALLEL = 24


def doc_terms(docs: DataFrame, key: str, text: str, keep: list[str]) -> DataFrame:
    """(keep..., key, term, tf): every 1-, 2- and 3-gram occurrence counted."""
    toks = docs.select(*keep, key, word_tokens(F.col(text)).alias("_t"))
    grams = toks.select(*keep, key, F.explode(F.concat(
        ngrams(F.col("_t"), 1), ngrams(F.col("_t"), 2), ngrams(F.col("_t"), 3))).alias("term"))
    return grams.groupBy(*keep, key, "term").agg(F.count("*").alias("tf"))


def term_table(docs: DataFrame, key: str, text: str, strata: list[str],
               max_df: float | None = None, mult: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(tf, terms): tf = strata + key + term + tf + _m;
    terms = strata + term + df + n_docs + idf + kept (df <= max_df * n)."""
    m = F.col(mult) if mult else F.lit(1)
    # dealt by document once: the counts by document need no shuffle of terms then
    base = docs.select(*strata, key, text, m.cast("long").alias("_m")).repartition(*strata, key)
    tf = doc_terms(base, key, text, strata + ["_m"])
    n_docs = base.groupBy(*strata).agg(F.sum("_m").alias("n_docs"))
    dfc = tf.groupBy(*strata, "term").agg(F.sum("_m").alias("df"))
    if strata:      # one row per stratum; a hot stratum is not a join key then
        terms = dfc.join(F.broadcast(n_docs) if n_docs.count() <= BROADCAST_STRATA else n_docs, strata)
    else:   # one stratum: n_docs is a single scalar row
        n_total = n_docs.first()["n_docs"] or 0
        terms = dfc.withColumn("n_docs", F.lit(n_total).cast("long"))
    n = F.col("n_docs").cast("double")
    terms = terms.withColumn("idf", F.log((n + 1.0) / (F.col("df").cast("double") + 1.0)) + 1.0)
    kept = F.lit(True) if max_df is None else (F.col("df") <= F.lit(float(max_df)) * n)
    return tf, terms.withColumn("kept", kept)


def gram_vectors(docs: DataFrame, key: str, text: str, strata: list[str], max_df: float | None = None,
                 mult: str | None = None, words: bool = True, carry: list[str] | None = None) -> DataFrame:
    """One row a document: strata + key + kept + grams, an array of (term, tf,
    df, idf, w) of its kept terms; without ``words`` tk and w instead, hashes
    and weights of the terms of df above 1 as bytes (``grams``).

    ``carry``: columns of ``docs`` to add, as a join on strata and key would."""
    spark = docs.sparkSession
    ship_package(spark)
    m = (F.col(mult) if mult else F.lit(1)).cast("long")
    s = F.xxhash64(*strata) if strata else F.lit(0).cast("long")
    # word tokens are runs of ASCII word characters; other letters can only join such runs
    ascii_ = F.octet_length(text) == F.length(text)
    tokens = F.when(ascii_, F.lower(text)).otherwise(F.array_join(word_tokens(F.col(text)), " "))
    extra = [c for c in carry or [] if c not in (*strata, key)]
    base = docs.select(*strata, key, *extra, s.alias("_s"), F.xxhash64(key).alias("_doc"), m.alias("_m"), tokens.alias("_text"))
    for c in strata:        # a text of no stratum has no weights
        base = base.where(F.col(c).isNotNull())
    sizes = materialize(base.groupBy(*strata).agg(F.sum("_m").alias("_n"), F.sum(F.octet_length("_text")).alias("_bytes")))
    n_strata, total = sizes.agg(F.count("*"), F.sum("_bytes")).first()
    blocks = _blocks(total or 0, BLOCK_BYTES)
    buckets = _blocks(total or 0, 4 * BLOCK_BYTES)
    block = F.pmod(F.xxhash64("_s", "_doc"), F.lit(blocks)).alias("_block")
    counted = base.select(block, "_s", "_doc", "_m", "_text").repartition(blocks, "_block").groupBy("_block") \
        .applyInArrow(G.count_kernel(buckets), "bucket int, block long, keys binary, counts binary")
    found = counted.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(G.df_kernel, "block long, bucket int, df binary")
    if strata:      # one row per stratum; a hot stratum is not a join key then
        n_docs = sizes.select(*strata, "_n")
        asked = base.join(F.broadcast(n_docs) if n_strata <= BROADCAST_STRATA else n_docs, strata)
    else:
        asked = base.crossJoin(F.broadcast(sizes.select("_n")))
    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in (*strata, key, *extra))
    shape = "grams array<struct<term:string,tf:bigint,df:bigint,idf:double,w:double>>" if words else "tk binary, w binary"
    return asked.select(*strata, key, *extra, "_s", "_doc", "_m", "_n", block, "_text").repartition(blocks, "_block") \
        .groupBy("_block").cogroup(found.repartition(blocks, "block").groupBy("block")) \
        .applyInArrow(G.weight_kernel(max_df, words, carry is not None), f"{kinds}, kept bigint, {shape}")


def _blocks(total: int, most: int) -> int:
    """Blocks of about ``most`` bytes, and some for parallel work."""
    return max(1, -(-total // most), min(PARALLEL, -(-total // LEAST_BYTES)))


def tfidf(docs: DataFrame, key: str, text: str, strata: list[str],
          max_df: float | None = None, mult: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Returns (weights, stats).

    weights: strata + key + term + tf + df + idf + w (L2-normalised, kept terms only)
    stats:   strata + n_docs + kept_terms (a stratum with kept_terms = 0 is a
             vectoriser failure: empty vocabulary after pruning, or n = 1)
    """
    weights = gram_vectors(docs, key, text, strata, max_df, mult).select(*strata, key, F.inline("grams"))
    n_docs = docs.select(*strata, (F.col(mult) if mult else F.lit(1)).cast("long").alias("_m")) \
                 .groupBy(*strata).agg(F.sum("_m").alias("n_docs"))
    if strata:
        stats = n_docs.join(weights.groupBy(*strata).agg(F.countDistinct("term").alias("kept_terms")), strata, "left")
    else:   # single stratum (no pruning in that use): report the doc count only
        stats = n_docs.withColumn("kept_terms", F.lit(None).cast("long"))
    return weights, stats.withColumn("kept_terms", F.coalesce("kept_terms", F.lit(0)))
