"""Queries over sources, sinks, row functions and behaviour features."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from fraudloom.config import BOT_TOKENS, FEATURES, SECOND
from fraudloom.functions import scalars as X
from fraudloom.operators import features as FE
from fraudloom.operators.analytics import filter_events, newest, rows_n, search_everything
from fraudloom.plans import tables as T
from fraudloom.plans.oracle import BOT_FLAG, FLAGGED, mask, sql
from fraudloom.plans.registry import query, r6, r6_sql
from fraudloom.session import materialize, shared_folder
from fraudloom.sources import clicks as C


def _scratch(spark, name: str) -> str:
    return f"{shared_folder(spark)}/fraudloom/{name}-{uuid.uuid4().hex}"


def _messages(clicks):
    """Clicks in their exchange form: float seconds instead of microseconds."""
    return clicks.withColumn("timestamp", F.col("ts_us") / F.lit(1e6)).drop("ts_us", "latency_ms")


# ---------------------------------------------------------------- sources and sinks
@query("s1_batch_ingest", sql("""
select event_id, ts_us, case when hit then 'rejected' else 'accepted' end as status, case when hit then 'blocked' end as reason
from (select event_id, ts_us, user_id = 'U0' or device_id = 'D1' or ip_address = '45.9.0.7' as hit from clicks where ts_us > 0)"""))
def batch_ingest(spark, folder):
    path = _scratch(spark, "ingest")
    _messages(T.clicks(spark, folder)).write.json(path)
    good, _ = C.split_valid(C.read_json_clicks(spark, path))
    return C.acknowledge(good, T.blocklist(spark)).join(good.select("event_id", "ts_us"), "event_id").select(
        "event_id", "ts_us", "status", "reason")


@query("s2_message_decode", sql("select event_id, ts_us, user_id, country, 'S0' as session_id, account_age_days from clicks"))
def message_decode(spark, folder):
    raw = _messages(T.clicks(spark, folder)).select(F.to_json(F.struct("*")).cast("binary").alias("value"))
    return C.decode_click_messages(raw).select("event_id", "ts_us", "user_id", "country", "session_id", "account_age_days")


@query("s3_click_csv", sql("select event_id, ts_us, user_id, ad_id, account_age_days, null::varchar as attack_type from clicks"))
def click_csv(spark, folder):
    path = _scratch(spark, "csv")
    _messages(T.clicks(spark, folder)).write.option("header", True).csv(path)
    return C.read_csv_clicks(spark, path).select("event_id", "ts_us", "user_id", "ad_id", "account_age_days", "attack_type")


EXTERNAL = """
external as (select event_id, user_id as ip, cast(json_extract_string(props, '$.k') as int) % 30 as app,
  (user_id % 5)::int as device, cast(json_extract_string(props, '$.k') as int) % 40 as os, (event_id % 300)::int as channel,
  epoch_us(ts) as click_us, case when event_type = 'purchase' then 1 else 0 end as is_attributed from events)"""


@query("s4_external_csv", f"""with {EXTERNAL}
select ip, app, device, os, channel, is_attributed, click_us from external""")
def external_csv(spark, folder):
    path = _scratch(spark, "external")
    rows = C.external_from_events(C.events_table(spark, folder))
    (rows.withColumn("click_time", F.timestamp_micros("click_us")).drop("click_us", "event_id")
     .write.option("header", True).option("timestampFormat", "yyyy-MM-dd HH:mm:ss.SSSSSS").csv(path))
    return C.read_external_csv(spark, path).select("ip", "app", "device", "os", "channel", "is_attributed",
                                                   F.unix_micros("click_time").alias("click_us"))


TIMING = ["avg_interval", "min_interval", "interval_std", "interval_cv", "timing_entropy", "burst_score"]


@query("s5_jsonl_features", sql(f"select event_id, user_id, clicks_10s, clicks_1m, clicks_5m, clicks_1h, {r6_sql(*TIMING)} from feat", "feat"))
def jsonl_features(spark, folder):
    lines, out = _scratch(spark, "lines"), _scratch(spark, "out")
    _messages(T.clicks(spark, folder)).select("event_id", "user_id", "timestamp").write.json(lines)
    rows = (spark.read.schema("event_id string, user_id string, timestamp double").json(lines)
            .withColumn("ts_us", F.round(F.col("timestamp") * 1e6).cast("long")))
    FE.user_timing_features(materialize(rows, "lines")).write.json(out)
    names = ["clicks_10s", "clicks_1m", "clicks_5m", "clicks_1h", *TIMING]
    back = spark.read.schema("event_id string, user_id string, " + ", ".join(f"{n} double" for n in names)).json(out)
    return back.select("event_id", "user_id", *names[:4], *[r6(n) for n in TIMING])


@query("s6_feature_messages", sql("select user_id as key, event_id, clicks_1m, clicks_1h from feat", "feat"))
def feature_message_rows(spark, folder):
    out = C.feature_messages(T.features(spark, folder).select("user_id", "event_id", "clicks_1m", "clicks_1h"))
    return out.select("key", F.get_json_object("value", "$.event_id").alias("event_id"),
                      F.get_json_object("value", "$.clicks_1m").cast("double").alias("clicks_1m"),
                      F.get_json_object("value", "$.clicks_1h").cast("double").alias("clicks_1h"))


@query("s8_idempotent_append", sql("select event_id, ts_us, user_id from clicks where event_type <> 'click'"))
def idempotent_append(spark, folder):
    rows = T.clicks(spark, folder)
    stored = rows.filter("event_type = 'click'")
    return C.new_rows(rows.unionByName(rows), stored).select("event_id", "ts_us", "user_id")


@query("s9_first_seen", sql("""
select 'campaign' as kind, campaign_id as id, campaign_id, min(ts_us) as first_seen_us from clicks group by campaign_id
union all select 'ad', ad_id, min_by(campaign_id, (ts_us, event_id)), min(ts_us) from clicks group by ad_id"""))
def first_seen(spark, folder):
    rows = T.clicks(spark, folder)
    campaigns = C.dimension_first_seen(rows, "campaign_id", []).select(
        F.lit("campaign").alias("kind"), F.col("campaign_id").alias("id"), "campaign_id", "first_seen_us")
    ads = C.dimension_first_seen(rows, "ad_id", ["campaign_id"]).select(
        F.lit("ad").alias("kind"), F.col("ad_id").alias("id"), "campaign_id", "first_seen_us")
    return campaigns.unionByName(ads)


@query("s10_device_upsert", sql("""
, old as (select device_id, min_by(user_id, (ts_us, event_id)) as user_id, min_by(user_agent, (ts_us, event_id)) as user_agent,
  min_by(country, (ts_us, event_id)) as country, min(ts_us) as f, max(ts_us) as l from clicks where event_type = 'view' group by 1),
new as (select device_id, min_by(user_id, (ts_us, event_id)) as user_id, min_by(user_agent, (ts_us, event_id)) as user_agent,
  min_by(country, (ts_us, event_id)) as country, min(ts_us) as f, max(ts_us) as l from clicks where event_type <> 'view' group by 1)
select coalesce(o.device_id, n.device_id) as device_id, coalesce(o.user_id, n.user_id) as user_id,
  substr(coalesce(o.user_agent, n.user_agent), 1, 120) as user_agent, coalesce(o.country, n.country) as country,
  coalesce(o.f, n.f) as first_seen_us, greatest(coalesce(o.l, n.l), coalesce(n.l, o.l)) as last_seen_us
from old o full join new n on o.device_id = n.device_id""").replace("\n, old", ",\nold"))
def device_upsert(spark, folder):
    rows = T.clicks(spark, folder)
    stored = C.device_dimension(rows.filter("event_type = 'view'"))
    return C.merge_devices(stored, rows.filter("event_type <> 'view'"))


@query("s11_decode_nested", sql(f"""select event_id, {r6_sql('rules')}, round(graph, 4) as graph, len(rules_fired) as n_rules, rules_fired[1] as first_rule
from (select *, round(score_rules, 4) as rules, score_graph as graph from decisions)""", "decisions"))
def decode_nested(spark, folder):
    rows = T.decisions(spark, folder)
    from fraudloom.operators.fusion import assemble_decisions
    stored = assemble_decisions(rows).select("event_id", F.to_json("scores").alias("scores"), F.to_json("rules_fired").alias("rules"))
    decoded = stored.select("event_id", F.from_json("scores", "map<string,double>").alias("s"),
                            F.from_json("rules", "array<string>").alias("r"))
    return decoded.select("event_id", r6(F.col("s")["rules"], "rules"), F.round(F.col("s")["graph"], 4).alias("graph"),
                          F.size("r").cast("long").alias("n_rules"), F.try_element_at("r", F.lit(1)).alias("first_rule"))


@query("s12_scenario_import", sql("""
select user_id, ad_id, campaign_id, device_id, ip_address, user_agent, ts_us / 1e6 as ts,
  case when event_type = 'error' then 'fraud' else event_type end as label, 'import' as source from clicks where event_type <> 'signup'"""))
def scenario_import(spark, folder):
    path = _scratch(spark, "scenario")
    rows = T.clicks(spark, folder).select(
        F.when(F.col("event_type") != "signup", F.col("user_id")).alias("user_id"), "ad_id", "campaign_id", "device_id",
        "ip_address", "user_agent", (F.col("ts_us") / F.lit(1e6)).alias("ts"),
        F.when(F.col("event_type") != "error", F.col("event_type")).alias("label"), F.lit("spoofed").alias("source"))
    C.export_scenario(rows, path)
    return C.import_scenario(spark, path)


@query("s13_cached_frame", sql("""select count(*) as rows_n, sum(clicks_1h)::bigint as clicks_1h, sum(unique_users_per_ip)::bigint as users_per_ip,
  count(*) filter (attack_type in ('burst', 'bot', 'click_farm', 'device_farm', 'campaign_hopping'))::bigint as seen_rows from feat""", "feat"))
def cached_frame(spark, folder):
    from fraudloom.config import SEEN_ATTACKS
    return T.features(spark, folder).agg(rows_n().alias("rows_n"), F.sum("clicks_1h").cast("long").alias("clicks_1h"),
                                         F.sum("unique_users_per_ip").cast("long").alias("users_per_ip"),
                                         F.count(F.when(F.col("attack_type").isin(SEEN_ATTACKS), 1)).alias("seen_rows"))


# ---------------------------------------------------------------- row functions


@query("p1_validate", sql("""select event_id, event_type_ok and ts_us > 0 as is_valid, replace(replace('<b>' || user_agent, '<', ''), '>', '') as user_agent,
  'live' as source from (select *, event_type not in ('error', 'signup') as event_type_ok from clicks)"""))
def validate(spark, folder):
    c = F.col("event_type")
    dirty = T.clicks(spark, folder).withColumns({
        "user_id": F.when(c == "error", F.concat("user_id", F.lit(";drop"))).otherwise(F.col("user_id")),
        "ip_address": F.when(c == "signup", "<script>").otherwise(F.col("ip_address")),
        "user_agent": F.concat(F.lit("<b>"), "user_agent"), "session_id": F.lit("S0"),
        "source": F.when(c == "view", "").otherwise(F.col("source"))})
    return C.validate_clicks(dirty).select("event_id", "is_valid", "user_agent", "source")


@query("p2_strip_provenance", sql("select event_id, null::int as label, null::varchar as attack_type, 'live' as source, null::varchar as run_id from clicks"))
def strip_provenance(spark, folder):
    return C.strip_provenance(T.clicks(spark, folder)).select("event_id", "label", "attack_type", "source", "run_id")


@query("p3_mask_ip", sql(f"select event_id, {mask()} as ip_mask from clicks"))
def mask_ip(spark, folder):
    return T.clicks(spark, folder).select("event_id", X.mask_ip(F.col("ip_address")).alias("ip_mask"))


@query("p4_hash_ip", sql("select event_id, substr(sha256('fraudloom' || ip_address), 1, 16) as ip_hash from clicks"))
def hash_ip(spark, folder):
    return C.stored_clicks(T.clicks(spark, folder), T.CONFIG).select("event_id", "ip_hash")


@query("p5_subnet", sql("select event_id, regexp_extract(ip_address, '^(.*)[.][^.]*$', 1) as subnet from clicks"))
def subnet(spark, folder):
    return T.clicks(spark, folder).select("event_id", X.subnet24(F.col("ip_address")).alias("subnet"))


@query("p6_bot_flag", sql(f"select event_id, {BOT_FLAG}::double as ua_bot_flag from clicks"))
def bot_flag(spark, folder):
    return T.clicks(spark, folder).select("event_id", X.is_bot_agent(F.col("user_agent"), BOT_TOKENS).cast("double").alias("ua_bot_flag"))


@query("p7_device_type", sql("""select event_id, case when regexp_matches(lower(user_agent), 'curl|python|headless|scrapy|wget|bot') then 'Bot/script'
  when regexp_matches(lower(user_agent), 'iphone|android|mobile') then 'Mobile'
  when regexp_matches(lower(user_agent), 'windows|macintosh|x11') then 'Desktop' else 'Unknown' end as device_type from clicks"""))
def device_type(spark, folder):
    return T.clicks(spark, folder).select("event_id", X.device_type(F.col("user_agent")).alias("device_type"))


@query("p8_log1p", sql("select event_id, floor(ln(1 + greatest(avg_interval, 0)) * 1e6 + 0.5) / 1e6 as log_avg_interval, floor(ln(1 + clicks_1h) * 1e6 + 0.5) / 1e6 as log_clicks_1h from feat", "feat"))
def log1p(spark, folder):
    return T.features(spark, folder).select("event_id", r6(X.log1p_clipped(F.col("avg_interval")), "log_avg_interval"),
                                            r6(X.log1p_clipped(F.col("clicks_1h")), "log_clicks_1h"))


@query("p9_event_log", sql("""select event_id, ts_us, user_id, campaign_id, level, risk, reason_title from decisions
where level = 'HIGH' and ts_us >= 600000000 and source = 'live'
  and (contains(ad_id, 'U1') or contains(device_id, 'U1') or contains(reason_title, 'U1') or contains(user_id, 'U1'))
order by ts_us desc, event_id desc limit 100""", "decisions"))
def event_log(spark, folder):
    hits = filter_events(T.decisions(spark, folder), level="HIGH", source="live", since_us=600 * SECOND, q="U1")
    return newest(hits, 100).select("event_id", "ts_us", "user_id", "campaign_id", "level", "risk", "reason_title")


@query("p10_min_risk", sql("select event_id, ts_us, user_id, risk, level from decisions where risk >= 0.5 order by ts_us desc, event_id desc limit 100", "decisions"))
def min_risk(spark, folder):
    return newest(filter_events(T.decisions(spark, folder), min_risk=0.5), 100).select("event_id", "ts_us", "user_id", "risk", "level")


SEARCH = """
select * from (select 'user' as kind, user_id as id, count(*) as n, max(ts_us) as last_us, max(country) as detail from decisions
  where contains(user_id, '1') group by 2 order by n desc, id limit 20)
union all select * from (select 'campaign', campaign_id as id, count(*) as n, max(ts_us), null from decisions where contains(campaign_id, '1') group by 2 order by n desc, id limit 20)
union all select * from (select 'ad', ad_id as id, count(*) as n, max(ts_us), null from decisions where contains(ad_id, '1') group by 2 order by n desc, id limit 20)
union all select * from (select 'device', device_id as id, count(*) as n, max(ts_us), count(distinct user_id)::varchar from decisions
  where contains(device_id, '1') group by 2 order by n desc, id limit 20)"""


@query("p11_search", sql(SEARCH, "decisions"))
def search(spark, folder):
    return search_everything(T.decisions(spark, folder), "1", 20)


@query("p12_clean_text", """
select 'doc_' || doc_id as id, substr(regexp_replace(replace(regexp_replace(text, '<[^>]+>|(?:javascript|data):', '', 'gi'), chr(0), ''), '^\\s+|\\s+$', '', 'g'), 1, 400) as clean,
  substr(trim(regexp_replace(source || ' <x>', '[^A-Za-z0-9 _\\-]', '', 'g')), 1, 60) as name from documents
union all select 'page_' || page_id, substr(regexp_replace(replace(regexp_replace(html, '<[^>]+>|(?:javascript|data):', '', 'gi'), chr(0), ''), '^\\s+|\\s+$', '', 'g'), 1, 400),
  substr(trim(regexp_replace(url || ' <x>', '[^A-Za-z0-9 _\\-]', '', 'g')), 1, 60) from pages""")
def clean_text(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").select(
        F.concat(F.lit("doc_"), "doc_id").alias("id"), F.col("text").alias("body"), F.col("source").alias("title"))
    pages = spark.read.parquet(f"{folder}/pages.parquet").select(
        F.concat(F.lit("page_"), "page_id").alias("id"), F.col("html").alias("body"), F.col("url").alias("title"))
    return docs.unionByName(pages).select("id", X.clean_text(F.col("body")).alias("clean"),
                                          X.clean_name(F.concat("title", F.lit(" <x>"))).alias("name"))


@query("p12_clean_tags", sql("""select event_id, attack_type || ',' || event_type || ',x' as tags from clicks"""))
def clean_tags(spark, folder):
    raw = F.concat("attack_type", F.lit(",<"), "event_type", F.lit(">,!!, ,x"))
    return T.clicks(spark, folder).select("event_id", X.clean_tags(raw).alias("tags"))


@query("p13_rebase", sql("""select event_id || 'r7' as event_id, user_id || 'r7' as user_id, device_id || 'r7' as device_id,
  1800000000000000 + ts_us - min(ts_us) over () as ts_us from clicks"""))
def rebase(spark, folder):
    return C.rebase_times(T.clicks(spark, folder), 1_800_000_000 * SECOND, "r7").select("event_id", "user_id", "device_id", "ts_us")


@query("p14_level_threshold", sql("select event_id, level from decisions where level in ('HIGH', 'CRITICAL')", "decisions"))
def level_threshold(spark, folder):
    return filter_events(T.decisions(spark, folder), min_level="HIGH").select("event_id", "level")


@query("p15_time_bucket", sql(f"select ts_us // 900000000 * 900 as bucket_s, count(*) as n, {FLAGGED} as flagged from decisions group by 1", "decisions"))
def time_buckets(spark, folder):
    from fraudloom.operators.prefix import bucket_start
    return T.decisions(spark, folder).groupBy(bucket_start("ts_us", 900).alias("bucket_s")).agg(
        rows_n().alias("n"), X.flagged_sum(F.col("action")).alias("flagged"))


# ---------------------------------------------------------------- behaviour features
FEATURE_GROUPS = {
    "f1_click_counts": ["clicks_10s", "clicks_1m", "clicks_5m", "clicks_1h"],
    "f2_intervals": ["avg_interval", "min_interval", "interval_std"], "f3_interval_cv": ["interval_cv"],
    "f4_timing_entropy": ["timing_entropy"], "f5_burst_score": ["burst_score"], "f6_unique_ads": ["unique_ads_1h"],
    "f7_repeat_ad_ratio": ["repeat_ad_ratio"], "f8_device_ip_counts": ["device_clicks_1m", "ip_clicks_1m"],
    "f9_sharing": ["unique_users_per_device", "unique_ips_per_device", "unique_devices_per_ip", "unique_users_per_ip"],
    "f10_campaign_share": ["campaign_click_share_5m"], "f11_countries": ["geo_user_countries", "geo_ip_countries"],
    "f12_pass_through": ["ua_bot_flag", "account_age_days"], "f14_feature_row": FEATURES,
}


def _feature_query(name, columns):
    @query(name, sql(f"select event_id, {r6_sql(*columns)} from feat", "feat"))
    def run(spark, folder):
        return T.features(spark, folder).select("event_id", *[r6(c) for c in columns])


for _name, _columns in FEATURE_GROUPS.items():
    _feature_query(_name, _columns)


@query("f14_vector", sql(f"select event_id, round({' + '.join(FEATURES)}, 4) as total from feat", "feat"))
def feature_vector(spark, folder):
    from pyspark.ml.functions import vector_to_array
    table = FE.vectorize(T.features(spark, folder))
    total = F.aggregate(vector_to_array("vector"), F.lit(0.0), lambda a, x: a + x)
    return table.select("event_id", F.round(total, 4).alias("total"))


@query("f15_user_history", sql("""select user_id, rank, event_id, ts_us, ad_id, device_id, country from (select *, row_number() over
  (partition by user_id order by ts_us desc, event_id desc) as rank from clicks) where rank <= 30"""))
def user_history(spark, folder):
    return FE.click_history(T.clicks(spark, folder), "user_id", 30).withColumn("rank", F.col("rank").cast("long"))


@query("f16_latest_per_user", sql("""select user_id, event_id, ts_us, clicks_1h, level, risk from decisions
qualify row_number() over (partition by user_id order by ts_us desc, event_id desc) = 1""", "decisions"))
def latest_per_user(spark, folder):
    return FE.latest_per_user(T.decisions(spark, folder), ["user_id", "event_id", "ts_us", "clicks_1h", "level", "risk"])


@query("f17_active_users", sql("""select count(distinct user_id) as active_users from clicks where ts_us >= (select max(ts_us) from clicks) - 60000000"""))
def active_users(spark, folder):
    rows = T.clicks(spark, folder)
    return FE.active_users(rows, rows.agg(F.max("ts_us")).scalar(), 60)


@query("f17_clicks_per_window", sql("select user_id, ts_us // 60000000 * 60 as window_s, count(*) as clicks from clicks group by 1, 2"))
def clicks_per_window(spark, folder):
    return FE.clicks_per_window(T.clicks(spark, folder), 60)
