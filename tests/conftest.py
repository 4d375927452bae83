import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    session = (SparkSession.builder.master("local[*]").appName("tests").config("spark.sql.shuffle.partitions", "4")
               .config("spark.ui.enabled", "false").config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC")
               .config("spark.ui.showConsoleProgress", "false")
               .config("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
               .getOrCreate())
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


COLUMNS = ("event_id string, ts_us bigint, event_type string, user_id string, ad_id string, campaign_id string, publisher_id string, "
           "device_id string, ip_address string, user_agent string, country string, account_age_days double, label int, attack_type string, "
           "source string, run_id string, latency_ms double")


@pytest.fixture(scope="session")
def clicks_of(spark):
    """Click table from short dicts; missing fields get the defaults of the literal cases."""
    def build(rows):
        out = []
        for i, r in enumerate(rows):
            d = {"event_id": f"e{i:05d}", "ts": 1000.0, "event_type": "ad_click", "user_id": "U1", "ad_id": "AD100", "campaign_id": "C10",
                 "publisher_id": "P0", "device_id": "D1", "ip_address": "1.2.3.4", "user_agent": "Mozilla/5.0 Chrome", "country": "IN",
                 "account_age_days": 180.0, "label": None, "attack_type": None, "source": "live", "run_id": None, "latency_ms": 1.0, **r}
            d["ts_us"] = round(d.pop("ts") * 1e6)
            out.append(tuple(d[c.split()[0]] for c in COLUMNS.split(", ")))
        return spark.createDataFrame(out, COLUMNS)
    return build
