"""Correlation cases, and the ordered replay against a plain loop."""


import pytest
from pyspark.sql import functions as F

from fraudloom.config import SECOND, EngineConfig
from fraudloom.operators import actions as A
from fraudloom.operators import incidents as I

CONFIG = EngineConfig()
SCHEMA = ("event_id string, ts_us bigint, user_id string, device_id string, ip_address string, ip_mask string, campaign_id string, attack_type string, "
          "risk double, level string, reason_title string, rules_fired array<string>")


def burst(name, user, device, ip, ts, campaign="C10", attack=None, n=25):
    mask = ".".join(ip.split(".")[:2]) + ".x.x"
    return [(f"{name}{i:02d}", round((ts + i * 0.05) * SECOND), user, device, ip, mask, campaign, attack, 0.9, "CRITICAL", "Rapid repeat clicks", ["tiny_interval"])
            for i in range(n)]


CASES = {
    "same user": (burst("a", "U1", "D1", "9.1.1.1", 1000) + burst("b", "U1", "D1", "9.1.1.1", 1010), 1),
    "shared device": (burst("a", "U1", "DS", "9.1.1.1", 1000) + burst("b", "U2", "DS", "8.2.2.2", 1005), 1),
    "shared address": (burst("a", "U3", "DA", "9.3.3.3", 1000) + burst("b", "U4", "DB", "9.3.3.3", 1005), 1),
    "masked address": (burst("a", "U5", "DC", "9.4.1.1", 1000) + burst("b", "U6", "DD", "9.4.2.2", 1005), 1),
    "unrelated": (burst("a", "U7", "DX", "1.1.1.1", 1000) + burst("b", "U8", "DY", "2.2.2.2", 1005), 2),
    "campaign inside": (burst("a", "U9", "DZ", "3.3.3.3", 2000, "CM", "farm") + burst("b", "U10", "DW", "4.4.4.4", 2060, "CM", "farm"), 1),
    "campaign outside": (burst("a", "U11", "DV", "5.5.5.5", 3000, "CO", "farm") + burst("b", "U12", "DU", "6.6.6.6", 3400, "CO", "farm"), 2),
    "idle": (burst("a", "U13", "DT", "7.7.7.7", 1000) + burst("b", "U13", "DT", "7.7.7.7", 1400), 2),
}


@pytest.mark.parametrize("case", CASES)
def test_merge_cases(spark, case):
    rows, want = CASES[case]
    keyed = I.incident_keys(spark.createDataFrame(rows, SCHEMA), graph_key=None)
    assert I.correlate(keyed, CONFIG).select("incident").distinct().count() == want


def test_rollup_and_status(spark):
    rows = spark.createDataFrame([("i", 100 * SECOND, 0.8, "U1", "D1", "10.0.x.x", "C2"), ("i", 160 * SECOND, 0.95, "U1", "D1", "10.0.x.x", "C1")],
                                 "incident string, ts_us bigint, risk double, user_id string, device_id string, ip_mask string, campaign_id string")
    blocks = spark.createDataFrame([("user", "U1")], "entity_type string, entity_id string")
    users = I.entity_rollup(rows, blocks).filter("entity_type = 'user'").first()
    assert (users["events"], users["flagged"], users["blocked"], users["peak_risk"]) == (2, 2, 2, 0.95)
    counts = I.incident_counters(I.entity_rollup(rows, blocks))
    row = counts.first()
    assert (row["users_n"], row["devices_n"], row["ips_n"], row["entity_events_n"], row["events_n"]) == (1, 1, 1, 6, 2)
    assert I.with_live_status(counts, F.lit(200 * SECOND)).first()["status"] == "open"
    closed = I.with_live_status(counts, F.lit(561 * SECOND)).first()
    assert closed["status"] == "closed" and closed["idle_s"] == 401.0
    assert I.incident_campaigns(rows).first()["campaigns"] == ["C1", "C2"]


def test_block_state_and_linked_unblock(spark):
    changes = spark.createDataFrame([("user", "U1", 10, True), ("user", "U1", 20, False), ("user", "U2", 5, False), ("user", "U2", 9, True)],
                                    "entity_type string, entity_id string, ts_us bigint, active boolean")
    assert {r["entity_id"]: r["active"] for r in A.blocklist_state(changes).collect()} == {"U1": False, "U2": True}
    blocks = spark.createDataFrame([("U1", 10, "D1"), ("U2", 30, "D2")], "user_id string, block_us bigint, device_id string")
    unblocks = spark.createDataFrame([("U1", 20), ("U2", 20)], "user_id string, ts_us bigint")
    assert [r["entity_id"] for r in A.linked_unblocks(unblocks, blocks).collect()] == ["D1"]


def test_mute_window_of_cluster_alert(spark):
    rows = [("U1", "C1", "HIGH", t * SECOND) for t in (100, 130, 219, 220, 400, 521)]
    d = spark.createDataFrame(rows, "user_id string, campaign_id string, level string, ts_us bigint")
    clusters = spark.createDataFrame([("C1", 100 * SECOND)], "campaign_id string, ts_us bigint")
    got = sorted(r["ts_us"] // SECOND for r in A.user_alerts(d, clusters, CONFIG).collect())
    assert got == [220, 521]


def test_stream_of_incidents_equals_the_batch_form(spark):
    """Incidents that start apart and merge later, idle out, and a repeated batch."""
    import uuid

    from fraudloom.session import shared_folder
    from fraudloom.streaming.incidents import IncidentLog
    S = 1_000_000
    rows = [("a", 0, ["user:1", "ip:x"]), ("b", 50, ["user:2", "ip:y"]), ("c", 120, ["user:3", "campaign_attack:C|burst"]),
            ("d", 200, ["user:1", "device:9"]), ("e", 230, ["user:2", "campaign_attack:C|burst"]), ("f", 260, ["device:9", "user:3"]),
            ("g", 900, ["user:1"]), ("h", 910, ["user:2", "user:1"]), ("i", 1500, ["ip:x"])]
    frame = lambda part: spark.createDataFrame([(i, t * S, k) for i, t, k in part], "event_id string, ts_us long, keys array<string>")
    log = IncidentLog(f"{shared_folder(spark)}/incidents-{uuid.uuid4().hex}", EngineConfig())
    for n, part in enumerate((rows[:3], rows[3:4], rows[4:6], rows[6:7], rows[7:])):
        log(frame(part), n)
        if n == 2:
            log(frame(part), n)
    got = {r["event_id"]: r["incident"] for r in log.assigned(spark).collect()}
    want = {r["event_id"]: r["incident"] for r in I.correlate(frame(rows), EngineConfig()).collect()}
    assert got == want and len(set(got.values())) == 3
