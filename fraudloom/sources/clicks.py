"""Click sources, sinks, validation, and the click view of the ``events`` table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fraudloom.config import EngineConfig
from fraudloom.functions.scalars import ID_PATTERN, IP_PATTERN, hash_ip, mask_ip
from fraudloom.operators.prefix import parts_for

ID_COLUMNS = ["event_id", "user_id", "ad_id", "campaign_id", "publisher_id", "device_id", "session_id"]
TEXT_COLUMNS = ["user_agent", "referrer", "page_id", "click_position"]

CLICK_SCHEMA = T.StructType([
    T.StructField("event_id", T.StringType()), T.StructField("timestamp", T.DoubleType()),
    T.StructField("event_type", T.StringType()), T.StructField("user_id", T.StringType()),
    T.StructField("ad_id", T.StringType()), T.StructField("campaign_id", T.StringType()),
    T.StructField("publisher_id", T.StringType()), T.StructField("session_id", T.StringType()),
    T.StructField("ip_address", T.StringType()), T.StructField("device_id", T.StringType()),
    T.StructField("user_agent", T.StringType()), T.StructField("country", T.StringType()),
    T.StructField("latitude", T.DoubleType()), T.StructField("longitude", T.DoubleType()),
    T.StructField("referrer", T.StringType()), T.StructField("click_position", T.StringType()),
    T.StructField("page_id", T.StringType()), T.StructField("account_age_days", T.DoubleType()),
    T.StructField("label", T.IntegerType()), T.StructField("attack_type", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("run_id", T.StringType()),
])

# --- fixed values: what a click gets when a field is missing ------------------
CLICK_DEFAULTS = {
    "event_type": "ad_click", "publisher_id": "PUB0", "session_id": "S0", "ip_address": "0.0.0.0", "user_agent": "",
    "country": "IN", "latitude": 0.0, "longitude": 0.0, "referrer": "", "click_position": "", "page_id": "",
    "account_age_days": 180.0, "source": "live",
}
EXTERNAL_COLUMNS = ["ip", "app", "device", "os", "channel", "click_time", "is_attributed"]
IMPORT_TEXT = ["user_id", "ad_id", "campaign_id", "device_id", "ip_address", "user_agent"]
# --- end of fixed values ----------------------------------------------------

EXTERNAL_SCHEMA = T.StructType([
    T.StructField("ip", T.LongType()), T.StructField("app", T.IntegerType()), T.StructField("device", T.IntegerType()),
    T.StructField("os", T.IntegerType()), T.StructField("channel", T.IntegerType()),
    T.StructField("click_time", T.StringType()), T.StructField("attributed_time", T.StringType()),
    T.StructField("is_attributed", T.IntegerType()),
])

PROJECTION = """
with r as (
  select event_id, user_id, event_type, user_id % 10 as arch,
         timestampdiff(microsecond, timestamp_ntz '2024-01-01 00:00:00', ts) as us0,
         cast(get_json_object(props, '$.k') as int) as k
  from {events})
select 'evt_' || event_id as event_id,
  case arch when 0 then (user_id * 37 % 60) * 60000000 + (us0 div 60000)
            when 5 then (user_id * 37 % 60) * 60000000 + (us0 div 3000)
            else us0 div 600 end as ts_us,
  event_type,
  'U' || user_id as user_id,
  'AD' || (100 + case when arch in (0, 1, 5) then user_id % 12 else k % 12 end) as ad_id,
  'C' || (10 + (case when arch in (0, 1, 5) then user_id % 12 else k % 12 end) % 6) as campaign_id,
  'PUB' || (user_id % 6) as publisher_id,
  case arch when 2 then 'DS' || (user_id div 50) else 'D' || user_id end as device_id,
  case arch when 3 then '185.' || k || '.' || (event_id % 256) || '.' || (2 + user_id % 240)
            when 4 then '45.9.' || (user_id div 100) || '.7'
            else '11.' || (user_id div 250) || '.' || (user_id % 250) || '.9' end as ip_address,
  case arch when 1 then 'curl/8.4.0'
            when 6 then 'Mozilla/5.0 (iPhone; CPU iPhone OS 17_4)'
            else 'Mozilla/5.0 (Windows NT 10.0; Win64; x64)' end as user_agent,
  case when arch = 3 then case k % 3 when 0 then 'IN' when 1 then 'VN' else 'RU' end else 'IN' end as country,
  (user_id * 7919 % 3000) / 10.0D as account_age_days,
  case when arch <= 5 then 1 else 0 end as label,
  case arch when 0 then 'burst' when 1 then 'bot' when 2 then 'mimicry' when 3 then 'ip_rotation'
            when 4 then 'device_farm' when 5 then 'low_and_slow' else 'normal' end as attack_type,
  'live' as source,
  'run_' || (user_id % 2) as run_id,
  (event_id % 97) / 4.0D as latency_ms
from r
"""


def events_table(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/events.parquet")


def project_clicks(events: DataFrame) -> DataFrame:
    """Click log derived from the generic events table (FIXTURES.md, part B)."""
    return events.sparkSession.sql(PROJECTION, events=events)


def load_clicks(spark: SparkSession, folder: str) -> DataFrame:
    return project_clicks(events_table(spark, folder))


# ---------------------------------------------------------------- readers
def with_defaults(raw: DataFrame) -> DataFrame:
    """Fill the optional fields and add the microsecond event time."""
    filled = raw.withColumns({c: F.coalesce(c, F.lit(v)) for c, v in CLICK_DEFAULTS.items()})
    return filled.withColumn("ts_us", F.round(F.col("timestamp") * 1e6).cast("long"))


def read_json_clicks(spark: SparkSession, path: str) -> DataFrame:
    return with_defaults(spark.read.schema(CLICK_SCHEMA).json(path))


def stream_json_clicks(spark: SparkSession, path: str) -> DataFrame:
    return with_defaults(spark.readStream.schema(CLICK_SCHEMA).json(path))


def decode_click_messages(messages: DataFrame) -> DataFrame:
    """Clicks from the ``value`` column of a message source."""
    return with_defaults(messages.select(F.from_json(F.col("value").cast("string"), CLICK_SCHEMA).alias("c")).select("c.*"))


def stream_kafka_clicks(spark: SparkSession, servers: str, topic: str = "ad-click-events") -> DataFrame:
    """Click stream from Kafka, from the earliest offset. Needs the Kafka connector on the class path."""
    messages = (spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers)
                .option("subscribe", topic).option("startingOffsets", "earliest").load())
    return decode_click_messages(messages)


def write_kafka_features(features: DataFrame, servers: str, checkpoint: str, topic: str = "click-features"):
    """Feature stream to Kafka, keyed by user."""
    return (feature_messages(features).writeStream.format("kafka").option("kafka.bootstrap.servers", servers)
            .option("topic", topic).option("checkpointLocation", checkpoint).start())


def feature_messages(features: DataFrame) -> DataFrame:
    return features.select(F.col("user_id").alias("key"), F.to_json(F.struct(*features.columns)).alias("value"))


def read_csv_clicks(spark: SparkSession, path: str) -> DataFrame:
    """Recorded clicks from CSV: ground truth dropped, empty text becomes null. Readers that need the order of time sort by ``ts_us, event_id``."""
    header = spark.read.option("header", True).csv(path).columns  # header line only
    types = {f.name: f.dataType for f in CLICK_SCHEMA}
    schema = T.StructType([T.StructField(c, types.get(c, T.StringType())) for c in header])
    raw = spark.read.schema(schema).option("header", True).option("emptyValue", None).csv(path)
    raw = raw.select(*[c for c in header if c not in ("label", "attack_type")])
    for name in CLICK_SCHEMA.names:
        if name not in raw.columns:
            raw = raw.withColumn(name, F.lit(None).cast(types[name]))
    return with_defaults(raw.select(*CLICK_SCHEMA.names))


def read_external_csv(spark: SparkSession, path: str) -> DataFrame:
    """Public ad-click log; refuses files without the required columns."""
    header = spark.read.option("header", True).csv(path).columns
    missing = [c for c in EXTERNAL_COLUMNS if c not in header]
    if missing:
        raise ValueError(f"missing columns {missing}; expected {EXTERNAL_COLUMNS}")
    types = {f.name: f.dataType for f in EXTERNAL_SCHEMA}
    schema = T.StructType([T.StructField(c, types.get(c, T.StringType())) for c in header])
    raw = spark.read.schema(schema).option("header", True).csv(path)
    return raw.select(*EXTERNAL_COLUMNS).withColumn("click_time", F.to_timestamp("click_time"))


def external_from_events(events: DataFrame) -> DataFrame:
    """External-log shape of the events table (FIXTURES.md, part B)."""
    return events.selectExpr(
        "event_id", "user_id as ip", "cast(get_json_object(props, '$.k') as int) % 30 as app",
        "cast(user_id % 5 as int) as device", "cast(get_json_object(props, '$.k') as int) % 40 as os",
        "cast(event_id % 300 as int) as channel", "timestampdiff(microsecond, timestamp_ntz '1970-01-01 00:00:00', ts) as click_us",
        "case when event_type = 'purchase' then 1 else 0 end as is_attributed")


# ---------------------------------------------------------------- validation
def valid_click() -> Column:
    ok = F.col("ip_address").rlike(IP_PATTERN) & (F.col("ts_us") > 0)
    for c in ID_COLUMNS:
        ok = ok & F.col(c).rlike(ID_PATTERN)
    return F.coalesce(ok, F.lit(False))


def validate_clicks(clicks: DataFrame) -> DataFrame:
    """Add ``is_valid`` and clean the free-text fields; invalid rows stay, for the quarantine."""
    clean = {c: F.substring(F.regexp_replace(c, "[<>]", ""), 1, 256) for c in TEXT_COLUMNS if c in clicks.columns}
    source = F.substring("source", 1, 24)
    clean["source"] = F.when(source == "", "live").otherwise(source)
    return clicks.withColumn("is_valid", valid_click()).withColumns(clean)


def split_valid(clicks: DataFrame) -> tuple[DataFrame, DataFrame]:
    checked = validate_clicks(clicks)
    return checked.filter("is_valid").drop("is_valid"), checked.filter("not is_valid").drop("is_valid")


def strip_provenance(clicks: DataFrame) -> DataFrame:
    """What an untrusted caller may submit: no ground truth, no provenance."""
    return clicks.withColumns({"label": F.lit(None).cast("int"), "attack_type": F.lit(None).cast("string"),
                               "source": F.lit("live"), "run_id": F.lit(None).cast("string")})


def blocked_by(clicks: DataFrame, blocklist: DataFrame, out: str = "is_blocked") -> DataFrame:
    """Mark clicks whose user, device or address is on the active blocklist (entity_type, entity_id).

    Shuffle or broadcast joins, as the size of the list at run time decides; the list is unique per entity.
    """
    names = blocklist.select("entity_type", "entity_id").distinct()
    for kind, column in (("user", "user_id"), ("device", "device_id"), ("ip", "ip_address")):
        side = names.filter(F.col("entity_type") == kind).select(F.col("entity_id").alias(column), F.lit(True).alias(f"_{kind}"))
        clicks = clicks.join(side, column, "left")
    hit = F.coalesce("_user", "_device", "_ip", F.lit(False))
    return clicks.withColumn(out, hit).drop("_user", "_device", "_ip")


def acknowledge(clicks: DataFrame, blocklist: DataFrame) -> DataFrame:
    """Ingest answer per click: accepted, or rejected because blocked."""
    marked = blocked_by(clicks, blocklist)
    return marked.select("event_id", F.when(F.col("is_blocked"), "rejected").otherwise("accepted").alias("status"),
                         F.when(F.col("is_blocked"), "blocked").alias("reason"))


def deduplicate(clicks: DataFrame, order: str = "ts_us") -> DataFrame:
    """First click per event id; at one time the one with the smaller payload hash. Whole clicks are sorted by id, so they are dealt by their number first."""
    rest = [c for c in clicks.columns if c != "event_id"]
    dealt = clicks.repartition(parts_for(clicks.sparkSession, 4 * clicks.count()), "event_id")
    return (dealt.groupBy("event_id").agg(F.min_by(F.struct(*rest), F.struct(order, F.xxhash64(*rest))).alias("r"))
            .select("event_id", *[F.col("r")[c].alias(c) for c in rest]).select(*clicks.columns))


def rebase_times(clicks: DataFrame, start_us: int, suffix: str) -> DataFrame:
    """Move a recorded run to ``start_us`` with its spacing kept, under fresh identities."""
    first = clicks.agg(F.min("ts_us")).scalar()
    return clicks.withColumns({
        "ts_us": F.lit(start_us).cast("long") + (F.col("ts_us") - first),
        "event_id": F.concat("event_id", F.lit(suffix)), "user_id": F.concat("user_id", F.lit(suffix)),
        "device_id": F.concat("device_id", F.lit(suffix))})


# ---------------------------------------------------------------- stored tables
def new_rows(batch: DataFrame, stored: DataFrame) -> DataFrame:
    """Rows of ``batch`` to append so that each event id is kept once."""
    return deduplicate(batch).join(stored.select("event_id"), "event_id", "left_anti")


def dimension_first_seen(clicks: DataFrame, key: str, keep: list[str]) -> DataFrame:
    """First sighting of each key, with the attributes it had then."""
    order = F.struct("ts_us", "event_id")
    return clicks.groupBy(key).agg(F.min("ts_us").alias("first_seen_us"),
                                   *[F.min_by(c, order).alias(c) for c in keep])


def device_dimension(clicks: DataFrame) -> DataFrame:
    order = F.struct("ts_us", "event_id")
    return clicks.groupBy("device_id").agg(
        F.min_by("user_id", order).alias("user_id"), F.substring(F.min_by("user_agent", order), 1, 120).alias("user_agent"),
        F.min_by("country", order).alias("country"), F.min("ts_us").alias("first_seen_us"), F.max("ts_us").alias("last_seen_us"))


def merge_devices(stored: DataFrame, batch: DataFrame) -> DataFrame:
    """Upsert: a stored device keeps its attributes and only moves ``last_seen_us``."""
    old, new = stored.alias("o"), device_dimension(batch).alias("n")
    keep = ["user_id", "user_agent", "country", "first_seen_us"]
    return old.join(new, F.col("o.device_id") == F.col("n.device_id"), "full").select(
        F.coalesce("o.device_id", "n.device_id").alias("device_id"),
        *[F.when(F.col("o.device_id").isNotNull(), F.col(f"o.{c}")).otherwise(F.col(f"n.{c}")).alias(c) for c in keep],
        F.greatest("o.last_seen_us", "n.last_seen_us").alias("last_seen_us"))


def stored_clicks(clicks: DataFrame, config: EngineConfig) -> DataFrame:
    """Click columns as kept on file: address hashed and masked, no user agent."""
    return clicks.select("event_id", "ts_us", "user_id", "ad_id", "campaign_id", "publisher_id", "device_id",
                         hash_ip(F.col("ip_address"), config.ip_salt).alias("ip_hash"),
                         mask_ip(F.col("ip_address")).alias("ip_mask"), "country", "label", "attack_type",
                         F.coalesce("source", F.lit("live")).alias("source"), "run_id")


# ---------------------------------------------------------------- scenario files
def export_scenario(clicks: DataFrame, path: str) -> None:
    clicks.write.mode("overwrite").json(path)


def sanitize_import(raw: DataFrame) -> DataFrame:
    """Rebuild imported events from the known fields only; provenance is always ``import``."""
    text = [F.substring(F.nullif(F.col(c).cast("string"), F.lit("")), 1, 120).alias(c) for c in IMPORT_TEXT]
    label = F.coalesce(F.nullif(F.col("label").cast("string"), F.lit("")), F.lit("fraud"))
    clean = raw.select(*text, F.col("ts").cast("double").alias("ts"), label.alias("label"), F.lit("import").alias("source"))
    return clean.filter("user_id is not null and ad_id is not null")


def import_scenario(spark: SparkSession, path: str) -> DataFrame:
    """Read an exported scenario of any size."""
    schema = ", ".join(f"{c} string" for c in IMPORT_TEXT) + ", ts double, label string"
    raw = spark.read.schema(schema).json(path)
    return sanitize_import(raw)


def with_rank_limit(df: DataFrame, keys: list[str], order: list, n: int) -> DataFrame:
    """The first ``n`` rows of each key; limited per input partition before the shuffle."""
    return (df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
            .filter(F.col("_rank") <= n).drop("_rank"))
