import math

from pyspark.sql import functions as F

from clickgap.llm import poisson


def test_table_is_the_distribution(spark):
    for rate in (0.0, 0.3, 1.0, 37.5, 500.0):
        cdf = spark.range(1).select(poisson.poisson_table(F.lit(rate)).alias("c")).first().c
        want, total = [], 0.0
        for k in range(len(cdf)):
            total += math.exp(k * math.log(rate) - rate - math.lgamma(k + 1)) if rate else float(k == 0)
            want.append(total)
        assert max(abs(a - b) for a, b in zip(cdf, want)) < 1e-9 and abs(cdf[-1] - 1) < 1e-9


def test_mean_and_variance(spark):
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"),
                                      F.when(F.col("id") % 4 == 0, "a").otherwise("b").alias("source"))
    for goal in ({"a": 3.0, "b": 1.0}, {"a": 1.0}):
        got = poisson.mix(docs, weights=goal, keep_order=False)
        per = {r.source: r for r in got.where("replica = 1").groupBy("source").agg(
            F.sum("copies").alias("s"), F.sum(F.col("copies") * F.col("copies")).alias("q")).collect()}
        n = {"a": 5000, "b": 15_000}
        for s in n:
            rate = 20_000 * goal.get(s, 0) / sum(goal.values()) / n[s]
            if not rate:
                assert s not in per
                continue
            mean = per[s].s / n[s]
            assert abs(mean - rate) < 5 * math.sqrt(rate / n[s])
            assert abs(per[s].q / n[s] - mean * mean - rate) < 0.1 * rate + 0.05


def test_high_rates_split_into_pieces(spark):
    docs = spark.range(40).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"), F.lit("a").alias("source"))
    got = poisson.mix(docs, total=40 * 1700, keep_order=False).groupBy("doc_id").count().collect()
    assert len(got) == 40 and abs(sum(r["count"] for r in got) / 40 - 1700) < 5 * math.sqrt(1700 / 40)


def test_order_replicas_and_repeatability(sf001_docs):
    a, b = (poisson.mix(sf001_docs).collect() for _ in range(2))
    assert a == b and [r.shuffle_key for r in a] == sorted(r.shuffle_key for r in a)
    assert all(1 <= r.replica <= r.copies for r in a)
    other = poisson.mix(sf001_docs, seed=18).collect()
    assert {r.doc_id: r.copies for r in a} != {r.doc_id: r.copies for r in other}


def test_odd_rows(odd_docs, no_docs):
    rows = poisson.mix(odd_docs).collect()
    assert poisson.mix(odd_docs).columns[:len(odd_docs.columns)] == odd_docs.columns
    per = {}
    for r in rows:
        per.setdefault((r.doc_id, r.text), []).append((r.copies, r.replica))
    for (i, t), got in per.items():     # repeated rows have equal counts each
        times = 2 if i == 7 else 1
        assert sorted(got) == sorted([(got[0][0], k) for k in range(1, got[0][0] + 1)] * times)
    assert poisson.mix(no_docs).count() == 0
