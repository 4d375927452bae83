"""Versions of the streamed learner against a replay in numpy."""

import uuid

import numpy as np
import pytest

from fraudloom.config import FEATURES
from fraudloom.session import shared_folder
from fraudloom.streaming.learner import Z, LearnerLog

SHAPE = "event_id string, ts_us long, level string, score_rules double, score_ml double, feedback int, " + ", ".join(f"{z} double" for z in Z)


def test_weights_equal_a_replay(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(40, len(FEATURES)))

    def row(i, ts, feedback=None, fraud=False, benign=False):
        scores = (0.95, 0.97) if fraud else (0.0, 0.01) if benign else (0.5, 0.5)
        return (f"e{i}", ts * 1_000_000, "CRITICAL" if fraud else "LOW" if benign else "MEDIUM", *scores, feedback, *map(float, x[i]))

    batches = [[row(0, 10, fraud=True), row(1, 11), row(2, 12, benign=True), row(3, 13, feedback=1)],
               [row(4, 40, feedback=0), row(0, 41, feedback=0), row(5, 42, fraud=True)],  # an analyst overrides e0 while it waits
               [row(6, 80), row(7, 81, benign=True)],
               [row(8, 150, feedback=1), row(8, 151, feedback=1)]]
    steps = [[(3, 1)], [(4, 0), (0, 0)], [(2, 0)], [(8, 1), (5, 1), (7, 0)]]
    log = LearnerLog(f"{shared_folder(spark)}/learner-{uuid.uuid4().hex}", delay_s=60, sample=1)
    for i, rows in enumerate(batches):
        log(spark.createDataFrame(rows, SHAPE), i)
        if i == 2:
            log(spark.createDataFrame(rows, SHAPE), i)  # repeated after a failure
    w, b, learned = np.zeros(len(FEATURES)), 0.0, 0
    got = {r["batch"]: r for r in log.versions(spark).collect()}
    for i, ready in enumerate(steps):
        at, y = [k for k, _ in ready], np.array([v for _, v in ready])
        error = 1 / (1 + np.exp(-(x[at] @ w + b))) - y
        w, b, learned = w - 0.5 * (error @ x[at] / len(at) + 1e-4 * w), b - 0.5 * error.mean(), learned + len(at)
        assert got[i]["learned"] == learned and got[i]["bias"] == pytest.approx(b, abs=1e-12)
        assert np.allclose(got[i]["weights"], w, atol=1e-12)
    assert len(got) == 4 and log.learner(spark).learned == learned
