import numpy as np

from pyspark.sql import functions as F

from clickgap.llm import ordinal, queries


def test_gradient_fits_ordered_thresholds():
    """Grades drawn from known weights come back in order and separate."""
    rng = np.random.default_rng(3)
    n = 3000
    held = rng.random((n, 6)) < 0.4
    score = held @ np.array([2.0, -2.0, 1.0, 0, 0, 0]) + rng.logistic(size=n)
    grade = (score[:, None] > np.array([-1.0, 0.5, 2.0])).sum(axis=1)
    text, place = np.nonzero(held)
    w, s, theta = ordinal.fit_arrays(text, place.astype(np.int64), np.zeros((n, ordinal.SHAPES)), grade, 4)
    assert (np.diff(theta) > 0).all()
    assert abs(w[0] - 2) < 0.4 and abs(w[1] + 2) < 0.4 and abs(w[2] - 1) < 0.4 and abs(w[3]) < 0.3
    assert np.allclose(theta, [-1.0, 0.5, 2.0], atol=0.4)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    model = ordinal.fit(docs, labels.where("doc_id % 4 <> 0"), queries.rating_grade(), 3)
    test = docs.join(labels.where("doc_id % 4 = 0"), "doc_id")
    got = ordinal.score(test.select("doc_id", "text"), model).join(labels, "doc_id").groupBy("quality", "toxic") \
        .agg(F.avg(F.col("kept").cast("int")).alias("kept"), F.avg("expected_grade").alias("g")).collect()
    by = {(r.quality, r.toxic): r for r in got}
    assert by[1, 0].kept > 0.97 and by[0, 0].kept < 0.25 and by[1, 1].kept < 0.35
    assert by[1, 0].g > max(by[0, 0].g, by[1, 1].g)


def test_odd_rows(spark, odd_docs, no_docs):
    rated = spark.createDataFrame([(1, 1, 0), (5, 0, 0), (None, 1, 1), (7, 1, 0), (7, 0, 1), (99, 1, 1), (3, None, 0)],
                                  "doc_id long, quality int, toxic int")
    model = ordinal.fit(odd_docs, rated, queries.rating_grade(), 3)
    got = ordinal.score(odd_docs, model).collect()
    assert len(got) == odd_docs.count() and all(0 <= r.p_tail <= 1 and 0 <= r.expected_grade <= 2 for r in got)
    same = [tuple(r) for r in got if r.doc_id == 7]
    assert same[0] == same[1]
    left = ordinal.select(odd_docs, model)
    assert left.schema.simpleString() == odd_docs.schema.simpleString()
    assert left.count() == sum(r.kept for r in got)
    assert ordinal.score(no_docs, model).count() == 0 and ordinal.select(no_docs, model).count() == 0


def test_without_ratings_nothing_is_rejected(spark, odd_docs, no_docs):
    one = spark.createDataFrame([(1, 1, 0), (5, 1, 0)], "doc_id long, quality int, toxic int")
    for docs, rated in ((odd_docs, one), (odd_docs, one.limit(0)), (no_docs, one)):
        model = ordinal.fit(docs, rated, queries.rating_grade(), 3)
        assert model is None and ordinal.select(docs, model).count() == docs.count()
        assert all(r.kept and r.p_tail is None for r in ordinal.score(docs, model).collect())
