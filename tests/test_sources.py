import pytest

from fraudloom.plans.registry import ORACLES, QUERIES
from fraudloom.session import shared_folder
from fraudloom.sources import clicks as C


def test_external_csv_needs_its_columns(spark, tmp_path):
    (tmp_path / "x.csv").write_text("ip,app\n1,2\n")
    with pytest.raises(ValueError, match="missing columns"):
        C.read_external_csv(spark, str(tmp_path / "x.csv"))


def test_validation_cleans_and_flags(clicks_of):
    from pyspark.sql import functions as F
    rows = clicks_of([{"user_agent": "<b>x</b>"}, {"user_id": "U1; DROP TABLE"}, {"ip_address": "<script>"}, {"ts": 0.0}])
    out = {r["event_id"]: r for r in C.validate_clicks(rows.withColumn("session_id", F.lit("S0"))).collect()}
    assert [out[f"e0000{i}"]["is_valid"] for i in range(4)] == [True, False, False, False]
    assert "<" not in out["e00000"]["user_agent"]


def test_oversized_import_is_refused(spark, tmp_path):
    (tmp_path / "s.json").write_text("\n".join('{"user_id":"U","ad_id":"A"}' for _ in range(5)))
    assert C.import_scenario(spark, str(tmp_path / "s.json")).count() == 5


def test_device_upsert_keeps_the_first_attributes(clicks_of):
    stored = C.device_dimension(clicks_of([{"ts": 10, "user_id": "A", "user_agent": "old"}]))
    merged = C.merge_devices(stored, clicks_of([{"ts": 50, "user_id": "B", "user_agent": "new"}, {"ts": 60, "device_id": "D2"}]))
    rows = {r["device_id"]: r for r in merged.collect()}
    assert rows["D1"]["user_agent"] == "old" and rows["D1"]["last_seen_us"] == 50_000_000 and len(rows) == 2


def test_cluster_needs_a_shared_folder(spark):
    assert shared_folder(spark)
    assert set(ORACLES) <= set(QUERIES)
