"""Order statistics of all columns in a fixed number of jobs."""

import numpy as np
import pandas as pd
import pytest

from parityframe.operators import quantile as qu


def test_against_numpy(spark):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"a": rng.normal(size=3000) * 1e3, "b": rng.integers(-3, 4, 3000).astype(float),
                        "c": np.exp(rng.normal(size=3000) * 20), "d": np.nan, "e": [None] * 2999 + [2.5]})
    pdf.loc[3, "b"] = -0.0
    probs = [0, 0.1, 0.25, 0.5, 0.75, 0.999, 1]
    for parts in (1, 7):
        got = qu.all_quantiles(spark.createDataFrame(pdf).repartition(parts), list("abcde"), probs)
        for c, line in zip("abc", got):
            assert line == pytest.approx(np.quantile(pdf[c], probs).tolist(), rel=1e-15)
        assert got[3] == [None] * 7 and got[4] == [2.5] * 7


def test_infinities_and_order(spark):
    x = np.array([np.inf, -np.inf, 0.0, -0.0, 5e-324, -5e-324, 1.5, -1.5, 1.7e308])
    bits = qu.ordered_bits(x)
    assert np.argsort(bits, kind="stable").tolist() == np.argsort(x, kind="stable").tolist()
    assert [qu.from_bits(int(b)) for b in bits] == (x + 0.0).tolist()
    df = spark.createDataFrame([(float(v),) for v in x], "v double")
    assert qu.all_quantiles(df, ["v"], [0, 0.5, 1]) == [[-np.inf, 0.0, np.inf]]
    assert qu.all_quantiles(df.limit(0), ["v"], [0.5]) == [[None]] and qu.all_quantiles(df, [], [0.5]) == []


def test_jobs_do_not_grow_with_columns(spark):
    df = spark.range(500).selectExpr(*[f"cast(id * {i + 1} % 97 as double) AS c{i}" for i in range(12)])
    from parityframe.operators import clean
    from parityframe.operators.metrics import quantiles

    def jobs(work):
        spark.sparkContext.setJobGroup("counted", "")
        tracker = spark.sparkContext.statusTracker()
        before = len(tracker.getJobIdsForGroup("counted"))
        work()
        after = len(tracker.getJobIdsForGroup("counted"))
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return after - before
    for work in (lambda n: quantiles(df, [f"c{i}" for i in range(n)]), lambda n: clean.iqr_one_shot(df, [f"c{i}" for i in range(n)])):
        assert jobs(lambda: work(2)) == jobs(lambda: work(12)) > 0
