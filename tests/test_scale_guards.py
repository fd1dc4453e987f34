from clickgap.session import checkpoint_dir, materialize


def test_materialize_uses_the_session_checkpoint_dir(spark):
    d = checkpoint_dir(spark)
    assert d and d == spark.sparkContext.getCheckpointDir()
    df = materialize(spark.range(10))
    assert df.count() == 10
    # the written copy is a scan, not the original lineage
    assert "Range" not in df._jdf.queryExecution().optimizedPlan().toString()
