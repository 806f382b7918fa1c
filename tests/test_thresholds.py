"""Thresholds, ranks and evaluation."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rollscan.operators import calibrate, evaluate, ranks


def scores(spark, n, seed=0):
    x = np.random.default_rng(seed).normal(5, 1, n)
    return spark.createDataFrame([("a", float(v)) for v in x], "sku string, score double"), np.sort(x)


@pytest.mark.parametrize("budget", [0.5, 1.0, 5.0])
def test_order_statistic(spark, budget):
    df, x = scores(spark, 5000)
    r = calibrate.conformal_threshold(df, ["sku"], budget, 0.5).first()
    alpha = budget * 0.5 / 100
    k = int(np.ceil(5001 * (1 - alpha)))
    assert (r.status, r.threshold) == ("ok", x[k - 1])
    assert r.threshold >= np.quantile(x, 1 - alpha)
    assert r.abstain_low == x[int(np.ceil(5001 * (1 - 5 * alpha))) - 1]


def test_refusals(spark):
    assert calibrate.conformal_threshold(scores(spark, 20)[0], ["sku"], 0.1, 0.5).first().status == "sample_too_small"
    df, x = scores(spark, 2500)
    assert calibrate.conformal_threshold(df, ["sku"], 1.0, 0.0512).first().status == "unstable_tail"
    assert calibrate.conformal_threshold(df, ["sku"], 10.0, 0.0512).first().status == "ok"
    assert calibrate.conformal_threshold(df, ["sku"], 1.0, 0.0512, margin=0).first().threshold == x[-1]
    with pytest.raises(Exception, match="does not support"):
        calibrate.conformal_threshold(df, ["sku"], 1.0, 0.0512, strict=True).collect()
    with pytest.raises(Exception, match="not positive"):
        calibrate.conformal_threshold(df, ["sku"], 0.0, 0.5).collect()


def test_missing_calibration_is_refused(spark):
    df, _ = scores(spark, 100)
    none = calibrate.hand_set(spark.createDataFrame([("b",)], "sku string"), 3.0)
    with pytest.raises(Exception, match="no calibration"):
        calibrate.classified(df, none, ["sku"]).collect()


def test_auroc_matches_the_library_evaluator(spark):
    from pyspark.ml.evaluation import BinaryClassificationEvaluator

    rng = np.random.default_rng(1)
    rows = [("g", float(rng.integers(0, 40)), float(rng.integers(0, 2))) for _ in range(3000)]
    df = spark.createDataFrame(rows, "g string, s double, y double")
    ours = ranks.auroc(df, ["g"], "s", F.col("y") == 1).first().auroc
    theirs = BinaryClassificationEvaluator(rawPredictionCol="s", labelCol="y", numBins=0).evaluate(df)
    assert ours == pytest.approx(theirs, abs=1e-12)
    assert ranks.auroc(df.filter("y = 1"), ["g"], "s", F.col("y") == 1).first().auroc is None


def test_overlapping_samples_are_refused(spark):
    df = spark.createDataFrame([(1,), (2,)], "i int")
    with pytest.raises(Exception, match="share rows"):
        evaluate.disjoint(df, df.filter("i = 1"), ["i"]).collect()
    assert evaluate.disjoint(df.filter("i = 1"), df.filter("i = 2"), ["i"]).count() == 1
