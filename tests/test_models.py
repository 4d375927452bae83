"""Invariants of the model layers, drift and evaluation."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fraudloom.config import FEATURES
from fraudloom.operators import drift as D
from fraudloom.operators import evaluate as E
from fraudloom.operators import external as K
from fraudloom.operators import models as M


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(4)
    label = rng.integers(0, 2, 400)
    x = rng.exponential(1.0, (400, len(FEATURES))) + label[:, None] * (np.arange(len(FEATURES)) < 4) * 5
    rows = [(f"e{i:04d}", int(y), *map(float, r)) for i, (y, r) in enumerate(zip(label, x))]
    return spark.createDataFrame(rows, "event_id string, label int, " + ", ".join(f"{f} double" for f in FEATURES)).cache()


@pytest.fixture(scope="module")
def models(table):
    return M.train(table, members=("logreg", "gbt"), gbt_iter=5)


def test_models_separate_and_shapley_adds_up(spark, table, models):
    scored = models.score(table, ("gbt",))
    quality = E.ranking_metrics(E.long_scores(scored.withColumn("attack_type", F.lit("x")), {"ml": "score_ml"})).first()
    assert quality["roc_auc"] > 0.9
    rows = table.limit(2)
    base = {f: 1.0 for f in FEATURES}
    parts = M.shapley(models, rows, base, permutations=3)
    total = {r["event_id"]: r["t"] for r in parts.groupBy("event_id").agg(F.sum("contribution").alias("t")).collect()}
    start = spark.createDataFrame([("b", *[1.0] * len(FEATURES))], "event_id string, " + ", ".join(f"{f} double" for f in FEATURES))
    p0 = models.score(start).first()["score_ml"]
    for r in models.score(rows).collect():
        assert total[r["event_id"]] == pytest.approx(r["score_ml"] - p0, abs=1e-9)
    assert M.top_factors(parts).count() == 10


def test_shapley_deals_rows_before_they_multiply(table, models, monkeypatch):
    """Rows that lie in one partition are scored in as many tasks as their prefixes need."""
    scored, score = [], M.Models.score
    monkeypatch.setattr(M.Models, "score", lambda self, rows, *rest: scored.append(rows.rdd.getNumPartitions()) or score(self, rows, *rest))
    M.shapley(models, table.limit(400).coalesce(1), {f: 1.0 for f in FEATURES}, permutations=120)
    assert scored == [400 * 120 * 24 // 200_000 + 1]


def test_members_are_fitted_at_the_same_time(table, monkeypatch):
    """Each fit waits for the other two to begin."""
    import threading
    begun = threading.Barrier(3, timeout=60)
    for kind in (M.LogisticRegression, M.MultilayerPerceptronClassifier, M.GBTClassifier):
        monkeypatch.setattr(kind, "fit", lambda self, rows: begun.wait() >= 0 and type(self).__name__)
    found = M.train(table).members
    assert found == {"logreg": "LogisticRegression", "mlp": "MultilayerPerceptronClassifier", "gbt": "GBTClassifier"}


def test_isolation_scores_outliers_higher(spark, table):
    legit = table.filter("label = 0")
    forest = M.fit_isolation_forest(legit, trees=30, sample=64)
    odd = spark.createDataFrame([("odd", *[50.0] * len(FEATURES))], "event_id string, " + ", ".join(f"{f} double" for f in FEATURES))
    usual = M.score_isolation(legit.select("event_id", *FEATURES), forest).agg(F.avg("isolation"), F.min("isolation"), F.max("isolation")).first()
    high = M.score_isolation(odd, forest).first()["isolation"]
    assert 0 < usual[1] <= usual[2] < 1 and high > usual[0]


def test_online_learner_learns(table):
    ready = M.standardized(table, table).withColumn("label", F.col("label"))
    learner = M.OnlineLearner()
    for _ in range(3):
        learner.learn(ready)
    out = learner.score(ready).groupBy("label").agg(F.avg("score_online").alias("p")).collect()
    p = {r["label"]: r["p"] for r in out}
    assert learner.learned == 1200 and p[1] > p[0] + 0.2


def test_page_hinkley_finds_the_shift(spark):
    rng = random.Random(0)
    rows = [("k", i * 1_000_000, f"e{i:04d}", rng.random() * 0.1 + (0.8 if i >= 300 else 0.0)) for i in range(400)]
    df = spark.createDataFrame(rows, "campaign_id string, ts_us bigint, event_id string, risk double")
    n = mean = cum = low = 0
    want = []
    for _, ts, event, x in rows:
        n += 1
        mean += (x - mean) / n
        cum += x - mean - 0.01
        low = min(low, cum)
        if cum - low > 5:
            want.append(event)
            n = mean = cum = low = 0
    assert [r["event_id"] for r in D.page_hinkley(df, "campaign_id", "risk", threshold=5.0).collect()] == want[:1]
    assert sorted(r["event_id"] for r in D.page_hinkley_resets(df, "campaign_id", "risk", threshold=5.0).collect()) == want


def test_psi_of_equal_tables_is_zero(table):
    edges = D.decile_edges(table)
    shares = D.bin_shares(table, edges)
    assert all(r["psi"] == pytest.approx(0.0, abs=1e-12) and r["status"] == "stable" for r in D.psi(shares, shares).collect())
    assert all(r["psi"] >= 0 for r in D.psi(shares, D.bin_shares(table.filter("label = 1"), edges)).collect())


def test_staged_label_waits_and_feedback_wins(spark):
    staged = spark.createDataFrame([("e1", 100_000_000, 1), ("e2", 100_000_000, 1)], "event_id string, staged_us bigint, staged_label int")
    feedback = spark.createDataFrame([("e2", 0)], "event_id string, label int")
    soon = D.committed_labels(staged, feedback, F.lit(110_000_000)).collect()
    assert [(r["event_id"], r["label"]) for r in soon] == [("e2", 0)]
    later = {r["event_id"]: (r["label"], r["origin"]) for r in D.committed_labels(staged, feedback, F.lit(200_000_000)).collect()}
    assert later == {"e1": (1, "staged"), "e2": (0, "analyst")}


def test_external_features_are_causal(spark):
    rows = [(i, i % 3, i % 2, 0, 0, i % 4, i * 10_000_000, 0) for i in range(30)]
    df = spark.createDataFrame(rows, "event_id bigint, ip bigint, app int, device int, os int, channel int, click_us bigint, is_attributed int")
    out = {r["event_id"]: r for r in K.featurize(df).collect()}
    assert out[0]["prev_gap_ip"] == 3600.0 and out[3]["prev_gap_ip"] == 30.0 and out[29]["ip_clicks_prior"] == 9 and out[29]["ip_count"] == 10
    assert out[0]["ip_unique_channels_prior"] == 1 and out[29]["ip_unique_channels_prior"] == 4
    parts = K.temporal_split(K.featurize(df))
    assert parts.filter("part = 'train'").count() == 21
    with pytest.raises(ValueError):
        K.require_positives(parts)
