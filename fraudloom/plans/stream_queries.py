"""Streaming queries, run to completion over the click log as a file stream."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from fraudloom.operators import models as M
from fraudloom.plans import tables as T
from fraudloom.plans.analyst_queries import BLOCKS, INCIDENTS, _keyed
from fraudloom.plans.oracle import FLAGGED, sql
from fraudloom.plans.quality_queries import RESETS
from fraudloom.plans.registry import query, r6, r6_of, r6_sql
from fraudloom.session import shared_folder, source_state
from fraudloom.sources.clicks import feature_messages
from fraudloom.streaming import incidents as N
from fraudloom.streaming import learner as L
from fraudloom.streaming import scoring as S
from fraudloom.streaming import stateful as W

TIMING = ["avg_interval", "min_interval", "interval_std", "interval_cv", "timing_entropy", "burst_score"]
COUNTS = ["clicks_10s", "clicks_1m", "clicks_5m", "clicks_1h"]
_SOURCES: dict[tuple, str] = {}
#: Files of a slice.
_FILES: dict[tuple, int] = {}
#: The watermark after the last batch, ten minutes behind the newest click; it counts in milliseconds.
CLOSED = "(select max(ts_us) // 1000 * 1000 - 600000000 from clicks)"


def _folder(spark, name):
    return f"{shared_folder(spark)}/fraudloom/{name}-{uuid.uuid4().hex}"


def _stream(spark, name, folder, table, parts=3, arrives=None):
    """File stream of a table, one slice a micro-batch, by time or by ``arrives`` (microseconds).

    A trigger takes a number of files, so every slice is written in equally many: files without rows fill it up, and a slice without
    rows is left out.
    """
    key = (spark.sparkContext.applicationId, name, source_state(spark, folder))
    if key not in _SOURCES:
        path = _folder(spark, name)
        at = "ts_us" if arrives is None else "_arrives"
        table = table if arrives is None else table.withColumn(at, arrives)
        cuts = table.approxQuantile(at, [i / parts for i in range(1, parts)], 0.01)
        bounds = [None, *cuts, None]
        most, slices = max(table.rdd.getNumPartitions(), 1), []
        for low, high in zip(bounds, bounds[1:]):
            part = table if low is None else table.filter(F.col(at) >= low)
            part = part if high is None else part.filter(F.col(at) < high)
            if not part.isEmpty():
                slices.append(part.drop("_arrives"))
        for i, part in enumerate(slices or [table.drop("_arrives")], 1):
            part.coalesce(most).write.mode("append").parquet(path)
            for _ in range(i * most - len(spark.read.schema(part.schema).parquet(path).inputFiles())):
                spark.createDataFrame([], part.schema).coalesce(1).write.mode("append").parquet(path)
        _SOURCES[key], _FILES[key] = path, most
    schema = table.drop("_arrives").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", _FILES[key]).parquet(_SOURCES[key])


def _clicks(spark, folder):
    return _stream(spark, "clicks", folder, T.clicks(spark, folder))


def _features(spark, folder):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", W.ROCKSDB)
    return W.stream_user_features(_clicks(spark, folder))


@query("t1_stateful_features", sql(f"select event_id, user_id, ts_us, {', '.join(COUNTS)}, {r6_sql(*TIMING)} from feat", "feat"))
def stateful_features(spark, folder):
    out = W.run_to_table(_features(spark, folder), _folder(spark, "t1"))
    return out.select("event_id", "user_id", "ts_us", *COUNTS, *[r6(c) for c in TIMING])


@query("t1_ordered_features", sql(f"select event_id, user_id, ts_us, {', '.join(COUNTS)}, {r6_sql(*TIMING)} from feat where (ts_us // 300000000 + 1) * 300000000 <= {CLOSED}", "feat"))
def ordered_features(spark, folder):
    """Clicks that arrive up to 500 seconds late and in ten rows an Arrow batch, described behind the watermark as a batch job would."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", W.ROCKSDB)
    rows = T.clicks(spark, folder)
    late = F.col("ts_us") + F.pmod(F.xxhash64("event_id"), F.lit(500)) * 1_000_000
    stream = _stream(spark, "late-clicks", folder, rows, 4, late)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 10)
    try:
        out = W.run_to_table(W.stream_user_features(stream, "10 minutes", ordered=True), _folder(spark, "t1-ordered"))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    return out.select("event_id", "user_id", "ts_us", *COUNTS, *[r6(c) for c in TIMING])


@query("t5_state_expiry", sql(f"select distinct user_id, ts_us // 300000000 as bucket from clicks where (ts_us // 300000000 + 1) * 300000000 + 600000000 > {CLOSED}"))
def state_expiry(spark, folder):
    """Buckets of click times that a ten-minute horizon leaves in the state behind the last watermark."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", W.ROCKSDB)
    out = _folder(spark, "t5")
    W.run_to_table(W.stream_user_features(_clicks(spark, folder), "10 minutes", horizon_s=600), out)
    state = spark.read.format("statestore").option("stateVarName", "times").load(f"{out}/checkpoint")
    return state.select(F.col("key.user_id").alias("user_id"), F.col("user_map_key.bucket").alias("bucket"))


@query("t2_watermark_counts", sql("""select ts_us // 300000000 * 300 as bucket_s, user_id, count(*) as clicks from clicks
where ts_us // 300000000 * 300000000 + 300000000 + 600000000 <= (select max(ts_us) from clicks) // 1000 * 1000 group by 1, 2"""))
def watermark_counts(spark, folder):
    """Counts of the windows that the watermark, ten minutes behind, has closed."""
    rows = W.with_watermark(_clicks(spark, folder), "10 minutes")
    out = rows.groupBy(F.window("event_time", "300 seconds").alias("w"), "user_id").agg(F.count(F.lit(1)).alias("clicks"))
    return W.run_to_table(out.select(F.unix_seconds("w.start").alias("bucket_s"), "user_id", "clicks"), _folder(spark, "t2"))


@query("t3_late_clicks", sql("""select event_id, ts_us from clicks where event_type = 'error'
and ts_us < (select max(ts_us) from clicks where event_type <> 'error') - 600000000"""))
def late_clicks(spark, folder):
    """Error clicks delivered after all others: those over ten minutes behind the newest click go to the side table."""
    path, rows = _folder(spark, "t3-source"), T.clicks(spark, folder)
    for part in (rows.filter("event_type <> 'error'"), rows.filter("event_type = 'error'")):
        part.coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)
    return W.late_clicks(stream, _folder(spark, "t3"), 600).select("event_id", "ts_us")


@query("t4_stream_deduplicate", sql("select event_id, user_id, ts_us from clicks"))
def stream_deduplicate(spark, folder):
    rows = _clicks(spark, folder)
    both = W.stream_deduplicate(rows.unionByName(rows), "30 days").select("event_id", "user_id", "ts_us")
    return W.run_to_table(both, _folder(spark, "t4"))


def _aligned(spark, folder):
    """Clicks in slices that end with a graph window, so that a batch sees whole windows as the batch job does."""
    rows = T.clicks(spark, folder)
    return _stream(spark, "window-clicks", folder, rows, 3, F.call_function("div", F.col("ts_us"), F.lit(900_000_000)) * 900_000_000)


def _watched(spark, folder):
    """The log scored in three batches, blocks announced but not enforced; once per source."""
    key = (spark.sparkContext.applicationId, "watched", source_state(spark, folder))
    if key not in _SOURCES:
        out = _folder(spark, "t6")
        S.score_stream(_aligned(spark, folder), out, T.score, T.CONFIG, enforce=False, drift_threshold=10.0).awaitTermination()
        _SOURCES[key] = out
    return _SOURCES[key]


@query("t6_micro_batch_scoring", sql(f"select event_id, user_id, ts_us, {r6_of('risk_raw')} as risk, level, action, reason, classification, {r6_of('score_graph')} as graph from decisions", "decisions"))
def micro_batch_scoring(spark, folder):
    """Decisions of a stream of three batches, with rules, graph, reasons and classification."""
    out = spark.read.parquet(f"{_watched(spark, folder)}/decisions")
    return out.select("event_id", "user_id", "ts_us", r6("risk_raw", "risk"), "level", "action", "reason", "classification", r6("score_graph", "graph"))


@query("t6_enforced_stream")
def enforced_stream(spark, folder):
    """The same stream with blocks enforced from the batch after the one that made them; tests check what it rejects."""
    out = _folder(spark, "t6")
    S.score_stream(_aligned(spark, folder), out, T.score, T.CONFIG).awaitTermination()
    columns = ["event_id", "user_id", "ts_us", "risk", "level", "action", "reason_title"]
    return spark.read.parquet(f"{out}/decisions").select(*columns).unionByName(spark.read.parquet(f"{out}/rejected").select(*columns))


STREAM_ALERTS = BLOCKS + """,
scount as (select campaign_id, block_us as ts_us, count(*) over (partition by campaign_id order by block_us range between 120000000 preceding and current row) as blocks from blocks),
schain(campaign_id, ts_us) as (select campaign_id, min(ts_us) from scount where blocks >= 5 group by 1
  union all select c.campaign_id, min(c.ts_us) from schain r join scount c on c.campaign_id = r.campaign_id and c.blocks >= 5 and c.ts_us > r.ts_us + 120000000 group by c.campaign_id),
scand as (select d.user_id, d.ts_us from decisions d where level in ('HIGH', 'CRITICAL') and not exists (
  select 1 from schain r where r.campaign_id = d.campaign_id and r.ts_us <= d.ts_us and d.ts_us < r.ts_us + 120000000)),
uchain(user_id, ts_us) as (select user_id, min(ts_us) from scand group by 1
  union all select c.user_id, min(c.ts_us) from uchain r join scand c on c.user_id = r.user_id and c.ts_us >= r.ts_us + 300000000 group by c.user_id),
personal as (select d.* from uchain a join decisions d on d.user_id = a.user_id and d.ts_us = a.ts_us and d.level in ('HIGH', 'CRITICAL')
  qualify row_number() over (partition by a.user_id, a.ts_us order by d.risk desc, d.event_id desc) = 1)"""


@query("s7_fan_out", sql(f"""select 'fraud-predictions' as topic, user_id as key, event_id as ref, level as what, ts_us from decisions
union all select 'fraud-alerts', user_id, event_id, level, ts_us from personal
union all select 'fraud-alerts', campaign_id, null, 'CRITICAL', ts_us from (select distinct * from schain)
union all select 'user-block-events', e.id, b.user_id, e.kind, block_us from blocks b, (values ('user', b.user_id), ('device', b.device_id)) e(kind, id)
union all select 'model-updates', campaign_id, event_id, 'DRIFT_DETECTED', ts_us from ({'select s.campaign_id, s.event_id, s.ts_us from ph join seq s using (campaign_id, i) where hit'})
union all select 'agent-events', user_id, event_id, case when risk >= 0.9 then 'block' when risk >= 0.5 then 'monitor' else 'allow' end, null from personal""",
                         "decisions", STREAM_ALERTS.strip() + ",\n" + RESETS.strip()))
def fan_out(spark, folder):
    """Messages of all five topics."""
    out, rows = _watched(spark, folder), None
    ref = {"user-block-events": "linked_user"}
    what = {"fraud-predictions": "level", "fraud-alerts": "severity", "user-block-events": "entity_type", "model-updates": "type", "agent-events": "recommendation"}
    for topic in S.TOPICS:
        field = lambda name: F.get_json_object("value", f"$.{name}")
        part = spark.read.parquet(f"{out}/topics/{topic}").select(
            F.lit(topic).alias("topic"), "key", field(ref.get(topic, "event_id")).alias("ref"), field(what[topic]).alias("what"), field("ts_us").cast("long").alias("ts_us"))
        rows = part if rows is None else rows.unionByName(part)
    return rows


@query("t7_stream_sliding", sql("""select start_s, user_id, count(*) as clicks from (select user_id, unnest([ts_us // 10000000 * 10 - 10 * i for i in range(0, 6)]) as start_s from clicks)
where (start_s + 60) * 1000000 <= """ + CLOSED + """ group by 1, 2"""))
def stream_sliding(spark, folder):
    return W.run_to_table(W.stream_sliding(_clicks(spark, folder), delay="10 minutes"), _folder(spark, "t7"))


@query("t8_stream_tumbling", sql(f"select ts_us // 60000000 * 60 as bucket_s, campaign_id, count(*) as n, {FLAGGED} as flagged from decisions where (ts_us // 60000000 * 60 + 60) * 1000000 <= {CLOSED} group by 1, 2", "decisions"))
def stream_tumbling(spark, folder):
    rows = T.decisions(spark, folder).select("event_id", "ts_us", "campaign_id", "action")
    stream = _stream(spark, "decisions", folder, rows)
    return W.run_to_table(W.stream_tumbling(stream, delay="10 minutes"), _folder(spark, "t8"))


@query("t9_stream_sessions", sql("""select user_id, min(ts_us) as start_us, max(ts_us) as last_us, count(*) as clicks from (
  select user_id, ts_us, sum(fresh) over (partition by user_id order by ts_us, event_id) as s from (select *,
    case when ts_us - lag(ts_us) over (partition by user_id order by ts_us, event_id) < 300000000 then 0 else 1 end as fresh from clicks))
group by user_id, s having max(ts_us) + 300000000 <= """ + CLOSED))
def stream_sessions(spark, folder):
    return W.run_to_table(W.stream_sessions(_clicks(spark, folder), delay="10 minutes"), _folder(spark, "t9"))


@query("t10_replay_from_start", sql("select 1::int as run, count(*) as n, max(ts_us) as last_us from clicks union all select 2, count(*), max(ts_us) from clicks"))
def replay_from_start(spark, folder):
    """Two independent readers of the same stream: a new checkpoint starts at the beginning."""
    rows = _clicks(spark, folder).select("event_id", "ts_us")
    runs = [W.run_to_table(rows, _folder(spark, "t10")).agg(F.lit(i).alias("run"), F.count(F.lit(1)).alias("n"), F.max("ts_us").alias("last_us"))
            for i in (1, 2)]
    return runs[0].unionByName(runs[1])


@query("s6_stream_messages", sql("select user_id as key, event_id, clicks_1h from feat", "feat"))
def stream_messages(spark, folder):
    out = W.run_to_table(feature_messages(_features(spark, folder)), _folder(spark, "s6"))
    return out.select("key", F.get_json_object("value", "$.event_id").alias("event_id"),
                      F.get_json_object("value", "$.clicks_1h").cast("double").alias("clicks_1h"))


@query("m13_learner_stream")
def learner_stream(spark, folder):
    """Versions of the weights after each batch of decisions; error and purchase clicks stand for an analyst's verdicts."""
    ready = M.standardized(T.decisions(spark, folder), T.decisions(spark, folder))
    said = F.when(F.col("event_type") == "error", 1).when(F.col("event_type") == "purchase", 0)
    rows = ready.withColumns({"score_ml": F.col("score_rules"), "feedback": said}).select(
        "event_id", "ts_us", "level", "score_rules", "score_ml", "feedback", *L.Z)
    log = L.learn_stream(_stream(spark, "labels", folder, rows, 6), _folder(spark, "m13"))
    return log.versions(spark).select("batch", "now_us", "learned", r6("bias"), F.transform("weights", lambda w: r6(w, "w")).alias("weights"))


@query("i2b_incident_stream", sql("select event_id, incident from assigned", "decisions", INCIDENTS))
def incident_stream(spark, folder):
    """Incidents grown over five batches of suspicious clicks."""
    rows = _keyed(spark, folder).select("event_id", "ts_us", "keys")
    log = N.correlate_stream(_stream(spark, "suspicious", folder, rows, 5), _folder(spark, "i2b"), T.CONFIG)
    return log.assigned(spark)
