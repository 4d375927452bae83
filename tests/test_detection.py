"""Rules, fusion, graph, patterns and reasons on literal rows."""

import random

import pytest
from pyspark.sql import functions as F

from fraudloom.config import EngineConfig
from fraudloom.operators import features as FE
from fraudloom.operators import fusion as Z
from fraudloom.operators import graph as G
from fraudloom.operators import patterns as P
from fraudloom.operators import reasons as X
from fraudloom.operators.rules import evaluate_rules
from fraudloom.plans.tables import score

SCORES = "id string, score_rules double, score_ml double, score_online double, score_anomaly double, score_graph double, rule_hard boolean"


def test_fusion_cases(spark):
    rows = [("calm", 0.0, 0.0, 0.0, 0.0, 0.0, False), ("all", 1.0, 1.0, 1.0, 1.0, 0.0, False), ("rules", 0.9, None, None, None, None, False),
            ("graph", 0.0, 0.0, None, None, 0.9, False), ("hard", 0.0, 0.0, None, None, None, True), ("none", None, None, None, None, None, False)]
    out = {r["id"]: r for r in Z.fuse(spark.createDataFrame(rows, SCORES)).collect()}
    assert (out["calm"]["level"], out["calm"]["action"]) == ("LOW", "ALLOW")
    assert (out["all"]["level"], out["all"]["action"], out["all"]["confidence"]) == ("CRITICAL", "BLOCK", "HIGH")
    assert out["rules"]["risk_raw"] == pytest.approx(0.9) and out["rules"]["confidence"] == "LOW" and out["rules"]["level"] == "CRITICAL"
    assert out["graph"]["risk_raw"] > 0.3 and out["hard"]["risk_raw"] >= 0.75 and out["none"]["level"] == "LOW"


def test_strong_layer_is_not_diluted(spark):
    rows = [("a", 1.0, 0.0, 0.0, 0.0, None, False), ("b", 0.5, 0.0, 0.0, 0.0, None, False)]
    out = {r["id"]: r["risk_raw"] for r in Z.fuse(spark.createDataFrame(rows, SCORES)).collect()}
    assert out["a"] == pytest.approx(0.5 * 0.3 + 0.5) and out["b"] == pytest.approx(0.15)


def test_rules_and_blocklist(clicks_of):
    table = FE.compute_features(clicks_of([{"ts": 1000 + i * 0.1} for i in range(40)] + [{"ts": 9000.0, "user_id": "calm", "ip_address": "8.8.8.8", "device_id": "D2"}]))
    out = {r["event_id"]: r for r in evaluate_rules(table).collect()}
    assert {"high_click_velocity", "tiny_interval"} <= set(out["e00039"]["rules_fired"]) and not out["e00039"]["rule_hard"]
    assert out["e00040"]["rules_fired"] == [] and out["e00040"]["rule_score"] == 0.0
    blocked = evaluate_rules(table, EngineConfig(blocked_ips=("1.2.3.4",)))
    assert blocked.filter("event_id = 'e00039'").first()["rule_hard"] is True


def test_ring_scores_high_and_loner_zero(clicks_of):
    rows = [{"ts": 1000 + i, "user_id": f"U{i}", "device_id": f"D{i}", "ip_address": f"45.9.9.{i + 2}"} for i in range(30)]
    rows.append({"ts": 1050, "user_id": "L", "device_id": "DL", "ip_address": "77.1.1.1"})
    scores = {r["device_id"]: r for r in G.snapshot_scores(clicks_of(rows), EngineConfig(graph_ttl_s=9000)).collect()}
    assert scores["D3"]["score_graph"] > 0.9 and scores["D3"]["graph_users"] == 30 and scores["D3"]["graph_subnets"] == 1
    assert scores["DL"]["score_graph"] == 0.0


@pytest.mark.parametrize("seed,edges", [(1, 60), (2, 140)])
def test_components_match_union_find(spark, seed, edges):
    rng = random.Random(seed)
    pairs = [(f"n{rng.randrange(100):03d}", f"n{rng.randrange(100):03d}") for _ in range(edges)] + [(f"p{i:03d}", f"p{i + 1:03d}") for i in range(40)]
    pairs = [(a, b) for a, b in pairs if a != b]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x
    for a, b in pairs:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    got = {r["node"]: r["component"] for r in G.connected_components(spark.createDataFrame(pairs, "src string, dst string")).collect()}
    assert got == {n: find(n) for n in list(parent)}


def test_hops_and_ego(spark):
    edges = spark.createDataFrame([("U:a", "D:1", 1), ("D:1", "I:x", 1), ("U:b", "D:1", 1), ("U:c", "D:2", 1)], "src string, dst string, last_us bigint")
    start = spark.createDataFrame([("U:a",)], "origin string")
    assert {(r["node"], r["hop"]) for r in G.reached_within(edges, start, 2).collect()} == {("D:1", 1), ("I:x", 2), ("U:b", 2)}
    nodes, inside = G.ego_subgraph(edges, G.connected_components(edges), "U:a")
    assert nodes.count() == 4 and inside.count() == 3


def test_classification_needs_two_conditions(clicks_of):
    rows = [{"ts": 1000 + i * 0.05} for i in range(40)] + [{"ts": 5000, "user_id": "calm", "device_id": "D9", "ip_address": "3.3.3.3"}]
    out = {r["event_id"]: r for r in score(FE.compute_features(clicks_of(rows)), None).collect()}
    assert out["e00039"]["classification"].startswith("very high click rate, machine-like timing")
    assert out["e00040"]["classification"] == "unclassified"
    assert out["e00039"]["reason"].startswith("This account clicked 40 times in the last minute, well above the normal rate of 30 a minute")
    assert "{" not in out["e00039"]["reason"] and "_" not in out["e00039"]["reason"]
    assert out["e00040"]["reason"]


def test_signature_operators_and_missing_fields(clicks_of, spark):
    table = FE.compute_features(clicks_of([{"ts": 1000 + i} for i in range(6)]))
    lib = spark.createDataFrame([(1, "both", None, True, [("clicks_1m", ">=", 6.0), ("clicks_1h", "<", 7.0)]),
                                 (2, "gone", 2, True, [("clicks_1m", ">=", 6.0), ("nothing", ">", 0.0)]),
                                 (3, "single", 1, True, [("clicks_1m", "==", 6.0)])], P.CONDITION_SCHEMA)
    out = {r["event_id"]: r["pattern_names"] for r in P.match_signatures(table, lib).collect()}
    assert out["e00005"] == ["both"] and out["e00004"] == []


def test_model_only_reason_names_the_layer(spark):
    none = "array<struct<feature:string,label:string,value:double,typical:double,contribution:double>>"
    row = spark.sql(f"""select 'x' event_id, cast(null as double) score_rules, 0.91D score_ml, cast(null as double) score_graph, cast(null as double) score_anomaly,
      cast(null as double) score_online, cast(array() as array<string>) rules_fired, cast(array() as {none}) factors, cast(null as string) reason, cast(null as string) reason_title""")
    out = X.backfill_reasons(row).first()
    assert out["reason"] == "The fraud model gave this click a score of 0.91" and out["reason_title"] == "Suspicious to the fraud model"


def test_backfill_drops_values_it_does_not_have(spark):
    none = "array<struct<feature:string,label:string,value:double,typical:double,contribution:double>>"
    row = spark.sql(f"""select 'old' event_id, 0.9D score_rules, cast(null as double) score_ml, cast(null as double) score_graph, cast(null as double) score_anomaly,
      cast(null as double) score_online, array('high_click_velocity') rules_fired, cast(array() as {none}) factors, cast(null as string) reason, cast(null as string) reason_title""")
    out = X.backfill_reasons(row).first()
    assert out["reason_title"] == "Rapid repeat clicks" and "{" not in out["reason"] and out["reason"]
    assert X.explanation_text(F.array()) is not None
