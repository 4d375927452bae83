"""Ordered computations against brute force, with one key that holds most rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fraudloom.operators import prefix as P

S = 1_000_000


@pytest.fixture(scope="module")
def events(spark):
    rng = random.Random(3)
    rows = [(f"e{i:04d}", "hot" if rng.random() < 0.6 else f"k{rng.randrange(5)}", rng.randrange(0, 4000) * S // 2, rng.randrange(4))
            for i in range(600)]
    return rows, spark.createDataFrame(rows, "id string, k string, ts bigint, v int").cache()


def test_sliding_count_matches_brute_force(events):
    rows, df = events
    got = {r["id"]: r["n"] for r in P.sliding_count(df, ["k"], "ts", 60, "n", bucket_s=30).collect()}
    want = {i: sum(1 for _, k2, t2, _ in rows if k2 == k and t - 60 * S <= t2 <= t) for i, k, t, _ in rows}
    assert got == want


def test_running_rows_and_previous_time(events):
    rows, df = events
    order = sorted(rows, key=lambda r: (r[2], r[0]))
    want, last, seen, low = {}, {}, {}, {}
    for i, k, t, v in order:
        seen[k], low[k] = seen.get(k, 0) + v, min(low.get(k, v), v)
        want[i] = (seen[k], low[k], last.get(k))
        last[k] = t
    out = P.running_rows(df, ["k"], "ts", ["id"], {"s": F.col("v")}, {"m": F.col("v")}, bucket_s=50)
    out = P.previous_time(out, ["k"], "ts", ["id"], "prev", bucket_s=50)
    assert {r["id"]: (r["s"], r["m"], r["prev"]) for r in out.collect()} == want


def test_islands_split_at_pauses(spark):
    df = spark.createDataFrame([("a", t * S) for t in (0, 100, 399, 700, 1001, 5000)], "k string, ts bigint")
    out = P.with_island(df, ["k"], "ts", 300, "start").orderBy("ts").collect()
    assert [r["start"] // S for r in out] == [0, 0, 0, 700, 1001, 5000]


def test_quantiles_match_numpy(spark):
    rng = np.random.default_rng(1)
    values = {"a": rng.exponential(50, 301).tolist(), "b": [float(x) for x in rng.integers(0, 5, 200)]}
    df = spark.createDataFrame([(k, v) for k, vs in values.items() for v in vs], "k string, v double")
    got = {(r["k"], r["prob"]): r["q"] for r in P.quantiles(df, ["k"], "v", [0.0, 0.1, 0.5, 0.9, 1.0]).collect()}
    assert len(got) == 10
    for (k, p), q in got.items():
        assert q == pytest.approx(np.quantile(values[k], p), abs=1e-9)


def test_count_below(spark):
    ref = spark.createDataFrame([(float(x),) for x in (1, 2, 2, 5)], "v double")
    probes = spark.createDataFrame([(float(x),) for x in (0, 2, 3, 9)], "v double")
    assert {r["v"]: r["n"] for r in P.count_below(probes, ref, "v", "n").collect()} == {0.0: 0, 2.0: 1, 3.0: 3, 9.0: 4}


@pytest.mark.parametrize("seed", [1, 2])
def test_throttle_is_greedy(spark, seed):
    rng = random.Random(seed)
    rows = [("hot" if rng.random() < 0.7 else "cold", rng.randrange(0, 9000 * 10) * S // 10) for _ in range(400)]
    rows += [("dense", t * 20 * S) for t in range(150)]
    want = []
    for k in ("hot", "cold", "dense"):
        last = None
        for t in sorted({t for k2, t in rows if k2 == k}):
            if last is None or t - last >= 300 * S:
                want.append((k, t))
                last = t
    got = P.throttle(spark.createDataFrame(rows, "k string, ts bigint"), ["k"], "ts", 300 * S).collect()
    assert sorted((r["k"], r["ts"]) for r in got) == sorted(want)


def narrow_scores(n=20_000):
    """90 % of the scores lie within 0.001 of each other, a tenth of all on one value."""
    rng = np.random.default_rng(7)
    return np.concatenate([0.5 + rng.random(n * 8 // 10) / 1000, np.full(n // 10, 0.5004), rng.random(n // 10)])


def test_pieces_are_cut_from_the_data(spark):
    scores = narrow_scores()
    df = spark.createDataFrame([(k, float(v)) for k in ("rules", "ml") for v in scores], "layer string, score double")
    points = df.distinct()
    sizes = [r["count"] for r in P.in_pieces(points, points, ["layer"], "score", 16).groupBy("layer", "_b").count().collect()]
    assert len(sizes) == 32 and max(sizes) <= 2 * sorted(sizes)[16]


def test_piece_of_is_the_number_of_cuts_below(spark):
    cuts = sorted([1.0, 2.0, 2.0, 2.0, 7.5] + [float(i) for i in range(10, 200)])
    rows = [(cuts[:n], v) for n in (0, 1, 5, 100, len(cuts)) for v in (None, -1.0, 1.0, 1.5, 2.0, 3.0, 7.5, 150.0, 1e9)] + [(None, 2.0)]
    got = spark.createDataFrame(rows, "c array<double>, v double").select("c", "v", P.piece_of("c", "v").alias("b")).collect()
    assert all(r["b"] == (0 if r["c"] is None or r["v"] is None else sum(c < r["v"] for c in r["c"])) for r in got)


@pytest.mark.parametrize("few", [64, 0])
def test_running_totals_over_cut_pieces(spark, monkeypatch, few):
    monkeypatch.setattr(P, "FEW_KEYS", few)
    scores = narrow_scores(3000)
    df = spark.createDataFrame([("rules", float(v), 1) for v in scores] + [(None, 0.25, 1), ("rules", None, 5)], "layer string, score double, n long")
    for down in (False, True):
        got = {(r["layer"], r["score"]): (r["n_step"], r["n"]) for r in P.running_totals(df, ["layer"], "score", ["n"], descending=down).collect()}
        assert got[("", 0.25)] == (1, 1)
        for v in np.unique(scores)[::97]:
            reached = int((scores >= v).sum()) if down else int((scores <= v).sum()) + 5  # a null stands first
            assert got[("rules", float(v))] == (int((scores == v).sum()), reached)


def test_range_pieces_part_ties(spark):
    df = spark.createDataFrame([(5 if i < 900 else i, f"e{i:04d}") for i in range(1000)], "ts long, id string")
    sizes = [r["count"] for r in P.range_pieces(df, ["ts", "id"], 8).groupBy("_b").count().collect()]
    assert len(sizes) == 8 and max(sizes) <= 2 * sorted(sizes)[4]


def test_the_next_point_is_found_in_one_pass(spark):
    rng = random.Random(4)
    rows = sorted({("hot" if rng.random() < 0.8 else "k", rng.randrange(0, 900 * S)) for _ in range(400)} | {("k", 900 * S), ("hot", 0)})
    out = P._first_after(spark.createDataFrame(rows, "k string, ts bigint"), ["k"], "ts", 120 * S)
    want = {(k, t): min((u for q, u in rows if q == k and u >= t + 120 * S), default=None) for k, t in rows}
    assert {(r["k"], r["ts"]): r["next"] for r in out.collect()} == {at: u for at, u in want.items() if u is not None}
    # A frame up to the end of the piece is computed anew for every row: quadratic in the piece.
    assert "unboundedfollowing" not in out._jdf.queryExecution().analyzed().toString().lower()


def test_dealt_rows_give_the_same_sums(events, monkeypatch):
    """Tasks of a sweep follow the number of its rows, not the session's partitions, and the carried sums read the same shuffle."""
    rows, df = events
    spark = df.sparkSession
    monkeypatch.setattr(P, "TASK_ROWS", 50)
    parts = P.parts_for(spark, len(rows))
    assert parts == 13 and P.parts_for(spark, 1) == int(spark.conf.get("spark.sql.shuffle.partitions"))
    steps = df.select("k", "ts", F.when(F.col("v") > 0, F.col("id")).alias("id"), F.col("v").cast("long").alias("n"))
    steps = P.materialize(steps.unionByName(spark.createDataFrame([("k0", None, "late", 2), (None, 7 * S, "lost", 3)], "k string, ts bigint, id string, n bigint")))
    run = lambda parts: P.running_steps(steps, ["k"], "ts", ["n"], P.time_bucket("ts", 30), keep=F.col("id").isNotNull(), parts=parts)
    of = lambda out: sorted((r["id"], r["n"]) for r in out.collect())
    dealt = run(parts)
    assert of(dealt) == of(run(None))
    plan = dealt._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert "ReusedExchange" in plan
    want = {i: sum(v2 for _, k2, t2, v2 in rows if k2 == k and t2 <= t) for i, k, t, v in rows if v > 0 and k == "hot"}
    assert {i: n for i, n in of(dealt) if i in want} == want
    totals = lambda parts: P.running_totals(df.select("k", "ts", F.col("v").alias("n")), ["k"], "ts", ["n"], P.time_bucket("ts", 30), parts=parts)
    assert sorted(totals(parts).collect()) == sorted(totals(None).collect())
