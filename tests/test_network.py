"""The network's trainer next to Spark's own, and the work of the proxy benchmark."""

import numpy as np
import pytest
from pyspark.ml import classification as spark_ml
from pyspark.ml.linalg import Vectors

from fraudloom.operators import external as K
from fraudloom.operators import models as M
from fraudloom.operators import network as N


def table(spark, parts=3, n=700):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(n, 4))
    rows = [(Vectors.dense(r), int(r[0] + r[1] * r[2] > 0)) for r in x]
    return spark.createDataFrame(rows, ["x", "label"]).repartition(parts).cache()


def test_the_models_use_this_trainer():
    assert M.MultilayerPerceptronClassifier is N.MultilayerPerceptronClassifier


@pytest.mark.parametrize("rounds", [0, 1, 12])
def test_fit_equals_sparks_fit(spark, rounds):
    """Partitions that do not end with a whole block too."""
    rows, options = table(spark), {"featuresCol": "x", "labelCol": "label", "layers": [4, 6, 5, 2], "maxIter": rounds, "seed": 3, "tol": 1e-9}
    mine, theirs = N.MultilayerPerceptronClassifier(**options).fit(rows), spark_ml.MultilayerPerceptronClassifier(**options).fit(rows)
    assert mine.weights.toArray() == pytest.approx(theirs.weights.toArray(), abs=1e-7)
    assert mine.getMaxIter() == rounds and mine.transform(rows).select("probability").first()[0].size == 2


def test_fit_stops_when_the_loss_settles(spark, monkeypatch):
    rounds, step = [], N.strong_wolfe
    monkeypatch.setattr(N, "strong_wolfe", lambda *a, **k: rounds.append(1) or step(*a, **k))
    N.MultilayerPerceptronClassifier(featuresCol="x", labelCol="label", layers=[4, 6, 2], maxIter=500, tol=0.05, seed=3).fit(table(spark))
    theirs = spark_ml.MultilayerPerceptronClassifier(featuresCol="x", labelCol="label", layers=[4, 6, 2], maxIter=500, tol=0.05, seed=3).fit(table(spark))
    assert len(rounds) == len(theirs.summary().objectiveHistory) - 1 < 100


def test_gradient_is_the_slope_of_the_loss():
    rng = np.random.default_rng(1)
    sizes, x, label, share = [3, 4, 2], rng.normal(size=(20, 3)), rng.integers(0, 2, 20), np.full(20, 0.05)
    w = rng.normal(size=3 * 4 + 4 + 4 * 2 + 2)
    gradient = np.zeros(len(w))
    N.loss_and_gradient(x, label, share, w, sizes, gradient)
    for i in range(len(w)):
        step = np.eye(len(w))[i] * 1e-6
        loss = lambda v: N.loss_and_gradient(x, label, share, v, sizes, np.zeros(len(w)))
        assert gradient[i] == pytest.approx((loss(w + step) - loss(w - step)) / 2e-6, abs=1e-6)


def test_external_features_read_the_log_a_few_times(spark):
    """Steps on steps read it dozens of times; each is written once."""
    rows = [(i, i % 3, i % 2, 0, 0, i % 4, i * 10_000_000, 0) for i in range(30)]
    log = spark.createDataFrame(rows, "event_id bigint, ip bigint, app int, device int, os int, channel int, click_us bigint, is_attributed int")
    reads = lambda df: df._jdf.queryExecution().optimizedPlan().collectLeaves().size()
    assert reads(K.group_counts(log)) == 1 + len(K.GROUPS) and reads(K.featurize(log)) <= 4


def test_a_click_without_a_key_is_not_counted_by_later_groups(spark):
    rows = [(1, 1, 1, 1, 1, 1), (2, 1, None, 1, 1, 1), (3, 1, 1, 1, None, 1), (4, None, 1, 1, 1, 1)]
    log = spark.createDataFrame(rows, "event_id bigint, ip bigint, app int, device int, os int, channel int")
    out = K.group_counts(log).collect()
    assert [(r["event_id"], r["ip_count"], r["ip_app_count"], r["ip_dev_os_count"], r["ip_channel_count"]) for r in out] == [(1, 3, 2, 1, 1)]
