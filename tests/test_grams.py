import collections
import math
import re

import pytest
from pyspark.sql import functions as F

from clickgap.functions import rules as R
from clickgap.functions.text import normalize_query
from clickgap.operators import tfidf as T
from clickgap.operators.enrich import exclude_terms
from clickgap.config import Config

DOCS = [("x", 1, "blue gear blue gear red", 2), ("x", 2, "Blue GEAR a b red_bolt", 1), ("x", 3, "", 1), ("x", 4, None, 1),
        ("y", 5, "blue-gear x1 x1 x1", 3), ("y", 6, "a b c", 1), ("y", 7, "éab café bar gear bar", 1),
        ("z", 8, "alone here", 1), ("x", 9, "gear red blue", 1), ("y", 9, "x1 gear", 1), ("x", 1, "red blue", 2),
        (None, 10, "gear gear", 1)]
SCHEMA = "segment string, id long, text string, mult long"


def counted(docs, max_df):
    """{(segment, id, term): (tf, df, w)} by counting."""
    tf, n, df = collections.Counter(), collections.Counter(), collections.Counter()
    mult = {}
    for s, i, text, m in docs:
        if s is None:
            continue
        n[s] += m
        mult[s, i] = m
        # a letter that is no ASCII word character takes its neighbours' word boundary
        words = re.findall(r"\b[a-z0-9_]{2,}\b", (text or "").lower())
        for k in (1, 2, 3):
            tf.update((s, i, " ".join(words[at:at + k])) for at in range(len(words) - k + 1))
    for s, i, t in tf:
        df[s, t] += mult[s, i]
    raw = {(s, i, t): c * (math.log((n[s] + 1) / (df[s, t] + 1)) + 1) for (s, i, t), c in tf.items()
           if max_df is None or df[s, t] <= max_df * n[s]}
    norm = collections.Counter()
    for (s, i, _), v in raw.items():
        norm[s, i] += v * v
    return {(s, i, t): (tf[s, i, t], df[s, t], round(v / math.sqrt(norm[s, i]), 9)) for (s, i, t), v in raw.items()}


@pytest.mark.parametrize("size,max_df", [(4 << 20, 0.95), (40, 0.6), (7, None)])
def test_weights_equal_counting(spark, monkeypatch, size, max_df):
    monkeypatch.setattr(T, "BLOCK_BYTES", size)
    docs = spark.createDataFrame(DOCS, SCHEMA)
    w, stats = T.tfidf(docs, "id", "text", ["segment"], max_df, "mult")
    got = {(r.segment, r.id, r.term): (r.tf, r.df, round(r.w, 9)) for r in w.collect()}
    want = counted(DOCS, max_df)
    assert got == want and w.count() == len(want)
    assert {r.segment: r.kept_terms for r in stats.collect() if r.segment} == {
        s: len({t for x, _, t in want if x == s}) for s in "xyz"}


def test_packed_vectors_hold_the_same_weights(spark):
    import numpy as np
    docs = spark.createDataFrame(DOCS, SCHEMA)
    got = T.gram_vectors(docs, "id", "text", ["segment"], 0.95, "mult", words=False).collect()
    want = collections.defaultdict(list)
    kept = collections.Counter()
    for (s, i, _), (_, df, w) in counted(DOCS, 0.95).items():
        kept[s, i] += 1
        if df > 1:
            want[s, i].append(w)
    for r in got:
        assert r.kept == kept[r.segment, r.id] and len(r.tk) == len(r.w)
        assert sorted(np.frombuffer(r.w).round(9).tolist()) == sorted(want[r.segment, r.id])


def test_no_row_a_gram_between_tasks(spark):
    """Grams go through no exchange, join or aggregate of rows."""
    docs = spark.createDataFrame(DOCS, SCHEMA)
    w, _ = T.tfidf(docs, "id", "text", ["segment"], 0.95, "mult")
    plan = w._jdf.queryExecution().executedPlan().toString()
    last = max(plan.rfind("FlatMapCoGroupsInArrow"), 0)
    assert "Generate inline" in plan and "FlatMapCoGroupsInArrow" in plan
    assert not re.search(r"(Exchange|Join|Aggregate)[^\n]*\bterm", plan) and last


def test_rules_equal_the_plain_alternation(spark):
    texts = ["Buy now", "rebuy", "buy-in", "near  me", "near me!", "a\nNEAR ME\nb", "bookıng", "booKing", "ſervice",
             "cafébuy", "buyé", "", None, "_buy", "BOOKING", "x order y"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for words in (["buy", "near me", "booking", "service", "order"], ["c++", "buy"], [], ["é", "buy"]):
        pats = R.term_patterns(words)
        rx = R.any_of(pats)
        want = F.lit(False) if rx is None else F.coalesce(F.col("t").rlike(rx), F.lit(False))
        for r in df.select("t", R.matches_any(F.col("t"), pats).alias("got"), want.alias("want")).collect():
            assert r.got == r.want, (words, r.t)


def test_text_is_normalised_once_for_the_filter(spark):
    df = spark.createDataFrame([("Standard  X",), ("It's\tü a -  b",)], "query string")
    kept = exclude_terms(df.withColumn("query_norm", normalize_query(F.col("query"))), Config(exclusion_terms=("standard",)))
    assert [r.query_norm for r in kept.collect()] == ["its a - b"]
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert plan.count("regexp_replace(lower") <= 2 and not re.search(r"Filter[^\n]*regexp_replace", plan)
