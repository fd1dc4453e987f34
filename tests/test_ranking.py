import random

from pyspark.sql import functions as F

from clickgap.operators.ranking import number_rows


def test_places_follow_the_whole_order(spark):
    r = random.Random(4)
    rows = [(i, r.choice([None, 1.5, 2.5, r.random() * 10])) for i in range(3000)]
    df = spark.createDataFrame(rows, "k long, x double").repartition(7)
    got = number_rows(df, F.col("x").desc_nulls_last(), F.col("k")).collect()
    want = sorted(rows, key=lambda t: (t[1] is None, -(t[1] or 0), t[0]))
    assert [(g.k, g.x) for g in sorted(got, key=lambda g: g.place)] == want
    assert sorted(g.place for g in got) == list(range(1, 3001))


def test_empty_and_equal_rows(spark):
    df = spark.createDataFrame([(1, 1.0)] * 5, "k long, x double")
    assert sorted(r.place for r in number_rows(df, F.col("x"), F.col("k")).collect()) == [1, 2, 3, 4, 5]
    assert number_rows(df.limit(0), F.col("x")).isEmpty()
