"""Literal cases and a brute-force check of all features."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from fraudloom.config import FEATURES, INTERVAL_EDGES, EngineConfig
from fraudloom.operators import features as FE


def rows_of(df):
    return {r["event_id"]: r for r in df.collect()}


def test_burst_then_silence(clicks_of):
    rows = [{"ts": 1000 + i * 0.1} for i in range(12)] + [{"ts": 5000.0}]
    out = rows_of(FE.compute_features(clicks_of(rows)))
    last = out["e00011"]
    assert last["clicks_10s"] == 12 and last["clicks_1m"] == 12 and last["min_interval"] == pytest.approx(0.1, abs=1e-9)
    assert out["e00012"]["clicks_1h"] == 1 and out["e00012"]["avg_interval"] == 300.0 and out["e00012"]["interval_std"] == 50.0
    assert set(FEATURES) <= set(out["e00012"].asDict())


def test_shared_device_and_countries(clicks_of):
    rows = [{"ts": 1000 + i, "user_id": f"U{i}", "device_id": "DX", "ip_address": "9.9.9.9"} for i in range(5)]
    rows.append({"ts": 1010, "user_id": "U0", "device_id": "DX", "ip_address": "9.9.9.9", "country": "VN"})
    rows.append({"ts": 1005, "user_id": "U0"})
    rows.append({"ts": 1006, "user_id": "U9", "user_agent": "python-requests/2.0"})
    out = rows_of(FE.compute_features(clicks_of(rows)))
    assert out["e00004"]["unique_users_per_device"] == 5 and out["e00004"]["unique_users_per_ip"] == 5
    assert out["e00005"]["geo_user_countries"] == 2
    assert out["e00007"]["ua_bot_flag"] == 1.0


def brute(rows):
    """All features by scanning the whole log per click."""
    out = {}
    for e in rows:
        now = e["ts"]
        seen = lambda key, w: [r for r in rows if r[key] == e[key] and now - w - 1e-9 <= r["ts"] <= now + 1e-9]  # noqa: E731,B023
        mine = sorted((r["ts"], r["event_id"]) for r in rows if r["user_id"] == e["user_id"] and (r["ts"], r["event_id"]) <= (now, e["event_id"]))
        times = [t for t, _ in mine[-21:] if t >= now - 3600 - 1e-9]
        gap = [round(b - a, 6) for a, b in zip(times, times[1:])]
        avg = sum(gap) / len(gap) if gap else 300.0
        std = math.sqrt(sum((g - avg) ** 2 for g in gap) / len(gap)) if gap else 50.0
        bins = Counter(sum(x < g for x in INTERVAL_EDGES) for g in gap)
        u1h, d1h, i1h, u5 = seen("user_id", 3600), seen("device_id", 3600), seen("ip_address", 3600), seen("user_id", 300)
        everyone = [r for r in rows if now - 300 - 1e-9 <= r["ts"] <= now + 1e-9]
        c10 = len(seen("user_id", 10))
        out[e["event_id"]] = {
            "clicks_10s": c10, "clicks_1m": len(seen("user_id", 60)), "clicks_5m": len(u5), "clicks_1h": len(u1h), "avg_interval": avg,
            "min_interval": min(gap, default=300.0), "interval_std": std, "interval_cv": std / avg if avg > 0 and len(gap) >= 3 else 1.0,
            "timing_entropy": -sum(n / len(gap) * math.log2(n / len(gap)) for n in bins.values()) if len(gap) >= 4 else 2.5,
            "burst_score": c10 / (1 + len(u5) / 30), "unique_ads_1h": len({r["ad_id"] for r in u1h}),
            "repeat_ad_ratio": max(Counter(r["ad_id"] for r in u5).values()) / len(u5) if len(u5) >= 3 else 0.0,
            "device_clicks_1m": len(seen("device_id", 60)), "unique_users_per_device": len({r["user_id"] for r in d1h}),
            "unique_ips_per_device": len({r["ip_address"] for r in d1h}), "ip_clicks_1m": len(seen("ip_address", 60)),
            "unique_devices_per_ip": len({r["device_id"] for r in i1h}), "unique_users_per_ip": len({r["user_id"] for r in i1h}),
            "campaign_click_share_5m": len(seen("campaign_id", 300)) / len(everyone),
            "geo_user_countries": len({r["country"] for r in u1h}), "geo_ip_countries": len({r["country"] for r in i1h})}
    return out


@pytest.mark.parametrize("bucket_s", [7, 300])
def test_all_features_match_brute_force(clicks_of, bucket_s):
    rng = random.Random(11)
    rows = []
    for i in range(220):
        user = "HOT" if rng.random() < 0.5 else f"U{rng.randrange(6)}"
        rows.append({"event_id": f"e{i:05d}", "ts": 1000 + rng.randrange(0, 9000 if i % 3 else 60) / 2, "user_id": user, "ad_id": f"A{rng.randrange(3)}",
                     "device_id": f"D{rng.randrange(4)}", "ip_address": f"1.1.{rng.randrange(3)}.9", "campaign_id": f"C{rng.randrange(2)}",
                     "country": rng.choice(["IN", "VN"])})
    out = rows_of(FE.compute_features(clicks_of(rows), EngineConfig(bucket_s=bucket_s)))
    want = brute(rows)
    assert len(out) == len(rows)
    for event, expected in want.items():
        for name, value in expected.items():
            assert out[event][name] == pytest.approx(value, abs=1e-6), (event, name)


def test_input_order_does_not_matter(clicks_of):
    rows = [{"event_id": f"e{i:05d}", "ts": 1000 + (i * 37 % 50), "user_id": f"U{i % 3}"} for i in range(60)]
    a = FE.compute_features(clicks_of(rows)).orderBy("event_id").collect()
    b = FE.compute_features(clicks_of(rows[::-1]).repartition(5)).orderBy("event_id").collect()
    assert a == b


def test_active_users_and_history(clicks_of, spark):
    rows = clicks_of([{"ts": 1000, "user_id": "A"}, {"ts": 1050, "user_id": "B"}, {"ts": 1070, "user_id": "B"}])
    assert FE.active_users(rows, F.lit(1_075_000_000), 60).first()["active_users"] == 1
    assert FE.click_history(rows, "user_id", 1).count() == 2


def test_entropy_fills_its_histogram_in_one_pass(spark):
    edges = [float(e) for e in INTERVAL_EDGES]
    rng = random.Random(5)
    gaps = [[rng.choice([*edges, 0.05, 45.0, 1700.0, 3500.0, 4000.0, 9000.0]) for _ in range(n)] for n in [*range(21)] * 4]
    times = [[sum(round(x * 1e6) for x in g[:i]) for i in range(len(g) + 1)] for g in gaps]
    out = FE.timing_features(spark.createDataFrame([(f"e{i}", t) for i, t in enumerate(times)], "event_id string, recent array<bigint>"))
    got = {r["event_id"]: r["timing_entropy"] for r in out.collect()}
    for i, g in enumerate(gaps):
        counts = [n for n in (sum(1 for x in g if lo < x <= hi) for lo, hi in zip([-1, *edges], [*edges, math.inf])) if n]
        want = 2.5 if len(g) < 4 else -sum(n / len(g) * math.log2(n / len(g)) for n in counts)
        assert abs(got[f"e{i}"] - want) < 1e-9
    # One filter at most: a filter for each bin walks the gaps as often as there are bins.
    assert out._jdf.queryExecution().optimizedPlan().toString().count("filter(gap") <= 1
