import numpy as np
import pandas as pd
import pytest

from clickgap.operators import quantiles as Q


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_order_statistics_refinement_matches_numpy(spark, seed):
    rng = np.random.default_rng(seed)
    # a hot group (most rows), heavy ties, a small group, nulls
    hot = rng.integers(0, 40, 3000).astype(float)
    cold = rng.normal(size=37)
    pdf = pd.DataFrame({"g": ["hot"] * len(hot) + ["cold"] * len(cold) + ["hot"] * 5,
                        "v": list(hot) + list(cold) + [None] * 5})
    df = spark.createDataFrame(pdf, "g string, v double")
    ranks = {("hot",): [0, 1, 1500, 2999], ("cold",): [0, 18, 36]}
    # small=50 forces the approximate-grid rounds for the hot group
    got = Q.order_statistics(df, ["g"], "v", ranks, small=50, grid=8, accuracy=200)
    hs, cs = np.sort(hot), np.sort(cold)
    for k in ranks[("hot",)]:
        assert got[("hot",)][k] == hs[k]
    for k in ranks[("cold",)]:
        assert got[("cold",)][k] == pytest.approx(cs[k])


def test_quantiles_and_medians_match_numpy(spark):
    rng = np.random.default_rng(5)
    vals = np.round(rng.exponential(size=501), 3)
    df = spark.createDataFrame(pd.DataFrame({"v": vals}), "v double")
    q70, q90 = Q.quantiles(df, [], "v", (0.7, 0.9))[()]
    assert q70 == pytest.approx(np.quantile(vals, 0.7), abs=1e-12)
    assert q90 == pytest.approx(np.quantile(vals, 0.9), abs=1e-12)
    even = vals[:500]
    df2 = spark.createDataFrame(pd.DataFrame({"v": even, "g": ["a"] * 500}), "v double, g string")
    assert Q.medians(df2, ["g"], "v")[("a",)] == pytest.approx(np.median(even), abs=1e-12)


def test_all_equal_values(spark):
    df = spark.createDataFrame(pd.DataFrame({"v": [2.5] * 400}), "v double")
    got = Q.order_statistics(df, [], "v", {(): [0, 399]}, small=10, grid=4, accuracy=100)
    assert got[()] == {0: 2.5, 399: 2.5}
