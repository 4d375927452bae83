"""Queries over decisions: analyst views, blocks and alerts, incidents, retention."""

from __future__ import annotations

from pyspark.sql import functions as F

from fraudloom.config import SECOND
from fraudloom.operators import actions as A
from fraudloom.operators import analytics as Q
from fraudloom.operators import features as FE
from fraudloom.operators import incidents as I
from fraudloom.operators import reasons as X
from fraudloom.operators.graph import node_type
from fraudloom.functions.scalars import flagged_sum, mask_ip
from fraudloom.operators.prefix import islands, time_bucket
from fraudloom.plans import tables as T
from fraudloom.plans.click_queries import SEARCH
from fraudloom.plans.detection_queries import INVESTIGATED, LATEST_COLUMNS
from fraudloom.plans.oracle import FLAGGED, sql
from fraudloom.plans.registry import joined, query, r6, r6_of
from fraudloom.session import staged
from fraudloom.sources import clicks as C

MEAN_RISK = "sum(round(risk * 10000)::bigint)::double / count(*) / 10000.0::double"
THREE_MEAN = f"floor(({MEAN_RISK}) * 1000 + 0.5) / 1000"
THREE_MAX = "floor(max(risk) * 1000 + 0.5) / 1000"
CRIT = "count(*) filter (level = 'CRITICAL')"


# ---------------------------------------------------------------- views
@query("q1_top_risk_users", sql(f"""select user_id, max(risk) as max_risk, {r6_of(MEAN_RISK)} as avg_risk, count(*) as clicks, {FLAGGED} as flagged
from decisions group by 1 order by max_risk desc, flagged desc, user_id limit 10""", "decisions"))
def top_risk_users(spark, folder):
    return Q.top_risk_users(T.decisions(spark, folder), 10).select("user_id", "max_risk", r6("avg_risk"), "clicks", "flagged")


TIMELINE_COLUMNS = "event_id, ts_us, risk, level, action, reason, reason_title, ad_id, campaign_id, country, ip_mask, device_id"


@query("q2_user_timeline", sql(f"select {TIMELINE_COLUMNS} from decisions where user_id = 'U10' order by ts_us desc, event_id desc limit 100", "decisions"))
def user_timeline(spark, folder):
    return Q.newest(Q.filter_events(T.decisions(spark, folder), user_id="U10"), 100).select(*TIMELINE_COLUMNS.split(", "))


@query("q3_decision_detail", sql(f"""select event_id, risk, level, action, {r6_of('score_rules')} as rules_score, array_to_string(rules_fired, ',') as rules_fired,
  ad_id, campaign_id, device_id, ip_mask, country, label, attack_type from decisions where event_id = 'evt_7'""", "decisions"))
def decision_detail(spark, folder):
    return T.decisions(spark, folder).filter("event_id = 'evt_7'").select(
        "event_id", "risk", "level", "action", r6("score_rules", "rules_score"), joined("rules_fired"), "ad_id", "campaign_id",
        "device_id", "ip_mask", "country", "label", "attack_type")


@query("q4_totals", sql(f"select count(*) as n, coalesce({FLAGGED}, 0) as flagged, {r6_of('avg(latency_ms)')} as latency_ms from decisions where ts_us >= 600000000 and country = 'IN' and level in ('MEDIUM', 'HIGH', 'CRITICAL')", "decisions"))
def totals(spark, folder):
    rows = Q.filter_events(T.decisions(spark, folder), since_us=600 * SECOND, country="IN", min_level="MEDIUM")
    return Q.totals(rows).select("n", "flagged", r6("latency_ms"))


FLAGGED_BY = {"q5_by_campaign": "campaign_id", "q6_by_country": "country", "q10_top_ips": "ip_mask", "q11_top_devices": "device_id"}


def _flagged_query(name, column, limit):
    tail = f" order by flagged desc, k limit {limit}" if limit else ""

    @query(name, sql(f"select {column} as k, count(*) as n, {FLAGGED} as flagged from decisions group by 1{tail}", "decisions"))
    def run(spark, folder):
        return Q.flagged_by(T.decisions(spark, folder), column, limit)


for _name, _column in FLAGGED_BY.items():
    _flagged_query(_name, _column, 10 if "top" in _name else None)


@query("q7_by_level", sql("select level as k, count(*) as n from decisions group by 1", "decisions"))
def by_level(spark, folder):
    return Q.flagged_by(T.decisions(spark, folder), "level").select("k", "n")


@query("q8_by_hour", sql(f"select ts_us // 3600000000 * 3600 as k, count(*) as n, {FLAGGED} as flagged from decisions group by 1", "decisions"))
def by_hour(spark, folder):
    return Q.flagged_by(T.decisions(spark, folder), time_bucket("ts_us", 3600) * F.lit(3600))


@query("q9_by_attack", sql(f"select coalesce(nullif(attack_type, 'normal'), 'unknown') as k, count(*) as n, {FLAGGED} as flagged from decisions group by 1", "decisions"))
def by_attack(spark, folder):
    rows = T.decisions(spark, folder).withColumn("attack_type", F.nullif(F.col("attack_type"), F.lit("normal")))
    return Q.flagged_by(rows, F.coalesce("attack_type", F.lit("unknown")))


@query("q12_timeline", sql(f"""select ts_us // 60000000 * 60 as bucket_s, count(*) as n, {FLAGGED} as flagged, count(*) filter (action = 'BLOCK') as blocked,
  {r6_of(MEAN_RISK)} as avg_risk, max(risk) as max_risk from decisions where ts_us >= (select max(ts_us) from decisions) - 3600000000 group by 1""", "decisions"))
def timeline(spark, folder):
    rows = T.decisions(spark, folder)
    out = Q.timeline(rows, "1h", rows.agg(F.max("ts_us")).scalar())
    return out.select("bucket_s", "n", "flagged", "blocked", r6("avg_risk"), "max_risk")


@query("q13_device_types", sql(f"""select case when regexp_matches(lower(d.ua), 'curl|python|headless|scrapy|wget|bot') then 'Bot/script'
  when regexp_matches(lower(d.ua), 'iphone|android|mobile') then 'Mobile' when regexp_matches(lower(d.ua), 'windows|macintosh|x11') then 'Desktop'
  else 'Unknown' end as k, count(*) as n, {FLAGGED} as flagged from decisions
join (select device_id, min_by(user_agent, (ts_us, event_id)) as ua from clicks group by 1) d using (device_id) group by 1""", "decisions"))
def device_types(spark, folder):
    return Q.device_types(T.decisions(spark, folder), C.device_dimension(T.clicks(spark, folder)))


@query("q14_campaign_stats", sql(f"""select campaign_id, clicks, suspicious, users, cpc, clicks - suspicious as valid, round(clicks * cpc, 2) as spend,
  round(suspicious * cpc, 2) as wasted, {r6_of('suspicious / greatest(clicks, 1)')} as fraud_rate
from (select campaign_id, count(*) as clicks, {FLAGGED} as suspicious, count(distinct user_id) as users,
  case campaign_id when 'C10' then 12.0::double when 'C11' then 8.5 when 'C12' then 15.0 when 'C13' then 7.0 when 'C14' then 10.5 else 9.0 end as cpc from decisions group by 1)""", "decisions"))
def campaign_stats(spark, folder):
    return Q.campaign_stats(T.decisions(spark, folder), T.CONFIG).withColumn("fraud_rate", r6("fraud_rate"))


def _drill_query(name, column, limit):
    tail = f" order by flagged desc, n desc, k limit {limit}" if limit else ""

    @query(name, sql(f"select {column} as k, count(*) as n, {FLAGGED} as flagged from decisions where campaign_id = 'C12' group by 1{tail}", "decisions"))
    def run(spark, folder):
        return Q.flagged_by(Q.filter_events(T.decisions(spark, folder), campaign_id="C12"), column, limit, then_n=True)


for _name, _column, _limit in (("q15_campaign_users", "user_id", 8), ("q16_campaign_ips", "ip_mask", 8), ("q17_campaign_countries", "country", None)):
    _drill_query(_name, _column, _limit)


@query("q18_clusters", sql(f"""select coalesce(nullif(campaign_id, ''), nullif(ad_id, ''), nullif(device_id, ''), 'unattributed') as k, count(*) as events,
  count(distinct user_id) as users, count(distinct device_id) as devices, count(distinct ip_mask) as ips, {THREE_MAX} as peak_risk,
  {THREE_MEAN} as avg_risk, {CRIT} as criticals from decisions where risk >= 0.3 group by 1 having count(*) >= 2 order by peak_risk desc, events desc, k limit 40""", "decisions"))
def clusters(spark, folder):
    return Q.combined_clusters(T.decisions(spark, folder), 0.3, 40)


@query("q20_combined_totals", sql(f"select count(*) as decisions, count(distinct user_id) as users, {THREE_MAX} as peak_risk, {THREE_MEAN} as avg_risk from decisions where risk >= 0.3", "decisions"))
def combined_totals(spark, folder):
    return Q.combined_totals(T.decisions(spark, folder), 0.3)


@query("q21_combined_timeline", sql(f"select ts_us // 300000000 * 300 as bucket_s, count(*) as n, {THREE_MAX} as peak_risk from decisions where risk >= 0.3 group by 1", "decisions"))
def combined_timeline(spark, folder):
    return Q.combined_timeline(T.decisions(spark, folder), 0.3)


TARGETED = f"""
tcamp as (select campaign_id, count(*) as clicks, count(distinct user_id) as users, {THREE_MAX} as peak_risk, {CRIT} as criticals
  from decisions group by 1 order by criticals desc, clicks desc, campaign_id limit 40),
tvict as (select user_id, max(country) as country, count(*) as clicks, {THREE_MAX} as peak_risk, count(distinct campaign_id) as campaigns,
  count(distinct device_id) as devices from decisions where risk >= 0.4 group by 1 order by peak_risk desc, clicks desc, user_id limit 40)"""


@query("q22_targeted_campaigns", sql("select * from tcamp", "decisions", TARGETED))
def targeted_campaigns(spark, folder):
    return Q.targeted_campaigns(T.decisions(spark, folder))


@query("q23_targeted_victims", sql("select * from tvict", "decisions", TARGETED))
def targeted_victims(spark, folder):
    return Q.targeted_victims(T.decisions(spark, folder))


@query("q24_clean_campaigns", sql("select campaign_id, count(*) as clicks, count(distinct user_id) as users from decisions where risk < 0.4 group by 1 order by clicks desc, campaign_id limit 40", "decisions"))
def clean_campaigns(spark, folder):
    return Q.clean_campaigns(T.decisions(spark, folder))


@query("q25_targeted_waste", sql(f"""select coalesce(sum(clicks), 0)::bigint as wasted_clicks, (select count(distinct user_id) from decisions where risk >= 0.4) as at_risk_users
from (select count(*) as clicks, {CRIT} as criticals from decisions group by campaign_id) where criticals > 0""", "decisions"))
def targeted_waste(spark, folder):
    return Q.targeted_waste(T.decisions(spark, folder))


@query("q26_compare_runs", sql(f"""select run_id, count(*) filter (level = 'LOW') as low, count(*) filter (level = 'MEDIUM') as medium, count(*) filter (level = 'HIGH') as high,
  {CRIT} as critical, max(risk) as peak_risk, count(*) as decisions, count(distinct user_id) as users from decisions group by 1""", "decisions"))
def compare_runs(spark, folder):
    return Q.compare_runs(T.decisions(spark, folder), T.clicks(spark, folder).select("run_id", "event_id"))


@query("q27_rolling_quality", sql(f"""select bucket_s, window_tp, window_fp, window_fn, window_tn, tp, fp, fn, tn,
  {r6_of('case when tp + fp > 0 then tp / (tp + fp) end')} as "precision", {r6_of('case when tp + fn > 0 then tp / (tp + fn) end')} as recall,
  {r6_of('case when window_tp + window_fp > 0 then window_tp / (window_tp + window_fp) end')} as window_precision,
  {r6_of('case when window_tp + window_fn > 0 then window_tp / (window_tp + window_fn) end')} as window_recall
from (select bucket_s, window_tp, window_fp, window_fn, window_tn, (sum(window_tp) over w)::bigint as tp, (sum(window_fp) over w)::bigint as fp,
    (sum(window_fn) over w)::bigint as fn, (sum(window_tn) over w)::bigint as tn
  from (select ts_us // 10000000 * 10 as bucket_s, count(*) filter (det and label = 1) as window_tp, count(*) filter (det and label = 0) as window_fp,
      count(*) filter (not det and label = 1) as window_fn, count(*) filter (not det and label = 0) as window_tn
    from (select *, action in ('FLAG', 'BLOCK', 'REJECTED') as det from enforced) group by 1) window w as (order by bucket_s))""", "enforced"))
def rolling_quality(spark, folder):
    out = Q.rolling_quality(T.enforced(spark, folder))
    rates = ["precision", "recall", "window_precision", "window_recall"]
    return out.select(*[c for c in out.columns if c not in rates], *[r6(c) for c in rates])


SNAPSHOT = f"""
snap as (select count(*) filter (not hit) as total_events, {FLAGGED} as flagged, count(*) filter (hit) as rejected,
  count(*) filter (not hit and level = 'LOW') as low, count(*) filter (not hit and level = 'MEDIUM') as medium, count(*) filter (not hit and level = 'HIGH') as high,
  count(*) filter (not hit and level = 'CRITICAL') as critical,
  count(distinct user_id) filter (ts_us >= (select max(ts_us) from enforced) - 60000000) as active_users, count(distinct campaign_id) as active_campaigns,
  avg(latency_ms) filter (not hit) as latency_avg, count(*) filter (ts_us >= (select max(ts_us) from enforced) - 10000000) / 10.0::double as events_per_s from enforced),
lats as (select latency_ms, row_number() over (order by latency_ms) as rn, count(*) over () as n from enforced where not hit)"""


@query("q28_snapshot", sql(f"""select total_events, flagged, rejected, low, medium, high, critical, active_users, active_campaigns, {r6_of('latency_avg')} as latency_avg,
  {r6_of('events_per_s')} as events_per_s, {r6_of('flagged / total_events')} as fraud_rate,
  (select latency_ms from lats where rn = floor(0.5 * n) + 1) as latency_p50, (select latency_ms from lats where rn = floor(0.95 * n) + 1) as latency_p95 from snap""", "enforced", SNAPSHOT))
def snapshot(spark, folder):
    out = Q.snapshot(T.enforced(spark, folder))
    return out.select(*[r6(c) if c in ("latency_avg", "events_per_s", "fraud_rate") else c for c in out.columns])


@query("q30_retention", sql("""select event_id, ts_us from decisions where ts_us > coalesce((select ts_us from decisions order by ts_us desc limit 1 offset 4000), -1)
  and ts_us >= (select max(ts_us) from decisions) - 7 * 86400000000""", "decisions"))
def retention(spark, folder):
    rows = T.decisions(spark, folder)
    return Q.prune(rows, rows.agg(F.max("ts_us")).scalar(), 7, 4000).select("event_id", "ts_us")


@query("q30_keep_newest_runs", sql("select event_id, run_id from decisions where run_id in (select distinct run_id from decisions order by run_id desc limit 1)", "decisions"))
def keep_newest_runs(spark, folder):
    return Q.keep_newest(T.decisions(spark, folder), "run_id", 1).select("event_id", "run_id")


# ---------------------------------------------------------------- blocks and alerts
BLOCKS = """
hits as (select *, count(*) over (partition by user_id order by ts_us range between 300000000 preceding and current row) as n from decisions where level = 'CRITICAL'),
blocks as (select user_id, ts_us as block_us, event_id, device_id, campaign_id, risk from hits where n >= 2
  qualify row_number() over (partition by user_id order by ts_us, event_id) = 1)"""


def _blocks(spark, folder):
    return staged(spark, "blocks", (folder,), lambda: A.auto_blocks(T.decisions(spark, folder), T.CONFIG))


@query("a1_auto_blocks", sql("select * from blocks", "decisions", BLOCKS))
def auto_blocks(spark, folder):
    return _blocks(spark, folder)


@query("a1_block_records", sql("""select e.entity_type, e.entity_id, block_us as ts_us, printf('auto: risk %.2f (%s)', d.risk,
    case when len(rules_fired) > 0 then array_to_string(rules_fired, ', ') else 'ml/graph/anomaly' end) as reason, d.event_id as detail_event, d.level as detail_level, d.reason as detail_reason
  from blocks b join decisions d using (event_id), (values ('user', b.user_id), ('device', b.device_id)) e(entity_type, entity_id)""", "decisions", BLOCKS))
def block_records(spark, folder):
    out = A.block_records(_blocks(spark, folder), T.decisions(spark, folder))
    return out.select("entity_type", "entity_id", "ts_us", "reason", F.col("reason_detail.event_id").alias("detail_event"),
                      F.col("reason_detail.level").alias("detail_level"), F.col("reason_detail.reason").alias("detail_reason"))


# The spread-out example data never has five blocks of a campaign in two minutes; every CRITICAL click stands for a block here.
CLUSTERS = """
ccount as (select campaign_id, ts_us, count(*) over (partition by campaign_id order by ts_us range between 120000000 preceding and current row) as blocks
  from decisions where level = 'CRITICAL'),
cchain(campaign_id, ts_us) as (select campaign_id, min(ts_us) from ccount where blocks >= 5 group by 1
  union all select c.campaign_id, min(c.ts_us) from cchain r join ccount c on c.campaign_id = r.campaign_id and c.blocks >= 5 and c.ts_us > r.ts_us + 120000000
  group by c.campaign_id)"""


def _clusters(spark, folder):
    def build():
        hits = T.decisions(spark, folder).filter("level = 'CRITICAL'").select("campaign_id", F.col("ts_us").alias("block_us"))
        return A.cluster_alerts(hits, T.CONFIG)
    return staged(spark, "clusters", (folder,), build)


@query("a2_cluster_alerts", sql("select r.campaign_id, r.ts_us, max(c.blocks) as blocks from cchain r join ccount c using (campaign_id, ts_us) group by 1, 2", "decisions", CLUSTERS))
def cluster_alerts(spark, folder):
    return _clusters(spark, folder)


ALERTS = CLUSTERS + """,
acand as (select d.user_id, d.ts_us from decisions d where level in ('HIGH', 'CRITICAL') and not exists (
  select 1 from cchain r where r.campaign_id = d.campaign_id and r.ts_us <= d.ts_us and d.ts_us < r.ts_us + 120000000)),
achain(user_id, ts_us) as (select user_id, min(ts_us) from acand group by 1
  union all select c.user_id, min(c.ts_us) from achain r join acand c on c.user_id = r.user_id and c.ts_us >= r.ts_us + 300000000 group by c.user_id),
alerts as (select a.user_id, a.ts_us, d.event_id, d.campaign_id, d.level as severity, d.risk, d.reason_title,
    case when d.event_type = 'signup' then 'resolved' else 'open' end as status, d.reason
  from achain a join decisions d on d.user_id = a.user_id and d.ts_us = a.ts_us and d.level in ('HIGH', 'CRITICAL')
  qualify row_number() over (partition by a.user_id, a.ts_us order by d.risk desc, d.event_id desc) = 1)"""


def _alerts(spark, folder):
    def build():
        rows = T.decisions(spark, folder)
        return A.alert_rows(A.user_alerts(rows, _clusters(spark, folder), T.CONFIG), rows)
    return staged(spark, "alerts", (folder,), build)


@query("a3_user_alerts", sql("select user_id, ts_us, event_id, campaign_id, severity, risk, reason_title, status, reason as detail_reason, event_id as detail_event from alerts", "decisions", ALERTS))
def user_alerts(spark, folder):
    return _alerts(spark, folder).select("user_id", "ts_us", "event_id", "campaign_id", "severity", "risk", "reason_title", "status",
                                         F.col("reason_detail.reason").alias("detail_reason"), F.col("reason_detail.event_id").alias("detail_event"))


LINKED = BLOCKS + """,
linked as (select b.device_id, b.user_id, min(c.ts_us) as ts_us from blocks b
  join clicks c on c.user_id = b.user_id and c.event_type = 'purchase' and b.block_us <= c.ts_us group by b.device_id, b.user_id, b.block_us)"""

CHANGES = LINKED + """,
changes as (select 'user' as entity_type, user_id as entity_id, block_us as ts_us, true as active from blocks
  union all select 'device', device_id, block_us, true from blocks
  union all select 'user', user_id, ts_us, false from clicks where event_type = 'purchase'
  union all select 'device', device_id, ts_us, false from linked),
state as (select entity_type, entity_id, arg_max(active, (ts_us, not active)) as active, max(ts_us) as changed_us from changes group by 1, 2)"""


def _changes(spark, folder):
    """Auto-blocks, an unblock of the user at each of its purchases, and the devices that the first of these releases."""
    bought = T.clicks(spark, folder).filter("event_type = 'purchase'")
    releases = bought.select(F.lit("user").alias("entity_type"), F.col("user_id").alias("entity_id"), "ts_us", F.lit(False).alias("active"))
    return A.block_events(_blocks(spark, folder)).drop("linked_user").unionByName(releases).unionByName(linked_unblocks(spark, folder).drop("linked_user"))


@query("a4_blocklist_state", sql("select * from state", "decisions", CHANGES))
def blocklist_state(spark, folder):
    return A.blocklist_state(_changes(spark, folder))


@query("a5_linked_unblocks", sql("select 'device' as entity_type, device_id as entity_id, ts_us, false as active, user_id as linked_user from linked", "decisions", LINKED))
def linked_unblocks(spark, folder):
    unblocks = T.clicks(spark, folder).filter("event_type = 'purchase'").select("user_id", "ts_us")
    return A.linked_unblocks(unblocks, _blocks(spark, folder))


@query("a6_enforced_blocks", sql("""select d.event_id, case when late then 'REJECTED' else action end as action, case when late then 1.0 else risk end as risk
from (select d.*, coalesce(d.ts_us > least(u.b, v.b), false) as late from decisions d
  left join (select user_id, min(block_us) as b from blocks group by 1) u on u.user_id = d.user_id
  left join (select device_id, min(block_us) as b from blocks group by 1) v on v.device_id = d.device_id) d""", "decisions", BLOCKS))
def enforced_blocks(spark, folder):
    from fraudloom.operators.fusion import reject_blocked
    marked = A.enforce_blocks(T.decisions(spark, folder).drop("is_blocked"), _blocks(spark, folder))
    return reject_blocked(marked).select("event_id", "action", "risk")


@query("a8_approved_blocks", sql("""select 'user' as entity_type, user_id as entity_id, 'approved recommendation: ' || kind as reason, floor(risk * 1000 + 0.5) / 1000 as confidence
from latest where risk >= 0.9 and event_type <> 'purchase'""", "decisions", INVESTIGATED))
def approved_blocks(spark, folder):
    last = FE.latest_per_user(T.decisions(spark, folder), [*LATEST_COLUMNS, "event_type"])
    verdicts = last.select("user_id", F.when(F.col("event_type") == "purchase", "reject").otherwise("approve").alias("verdict"))
    return A.approved_blocks(X.recommend(last), verdicts)


@query("a9_alert_counts", sql("select status, severity, count(*) as n, max(ts_us) as newest_us from alerts group by 1, 2", "decisions", ALERTS))
def alert_counts(spark, folder):
    return _alerts(spark, folder).groupBy("status", "severity").agg(Q.rows_n().alias("n"), F.max("ts_us").alias("newest_us"))


# ---------------------------------------------------------------- incidents
KEYS = """
gkey as (select component, min(substr(node, instr(node, '|') + 3)) as graph_key from gnodes where node like '%|D:%' group by 1),
hot as (select d.*, k.graph_key from decisions d left join gnodes n on n.node = (d.ts_us // 900000000) || '|D:' || d.device_id
  left join gkey k using (component) where level in ('HIGH', 'CRITICAL')),
ikeys as (select event_id, ts_us, unnest(['user:' || user_id, 'device:' || device_id, 'ip:' || ip_mask,
  'subnet:' || regexp_extract(ip_address, '^(.*)[.][^.]*$', 1) || '.0/24', 'campaign_attack:' || campaign_id || '|' || attack_type, 'graph:' || graph_key]) as key from hot)"""
INCIDENTS = KEYS + """,
iruns as (select event_id, key || '@' || max(case when fresh then ts_us end) over (partition by key order by ts_us, event_id) as node
  from (select *, coalesce(ts_us - lag(ts_us) over (partition by key order by ts_us, event_id) > case when key like 'campaign_attack:%' then 120000000 else 300000000 end, true) as fresh from ikeys)),
ilinks as (select distinct min(node) over (partition by event_id) as a, node as b from iruns),
iboth as (select a, b from ilinks union select b, a from ilinks),
ireach(node, other) as (select a, a from iboth union select r.node, l.b from ireach r join iboth l on r.other = l.a),
icomp as (select node, min(other) as incident from ireach group by 1),
assigned as (select h.*, c.incident from hot h join (select event_id, min(node) as node from iruns group by 1) r using (event_id) join icomp c using (node)),
ents as (select incident, entity_type, entity_id, min(ts_us) as first_us, max(ts_us) as last_us, count(*) as events, count(*) as flagged, max(risk) as peak_risk,
    count(*) filter ((entity_type = 'user' and entity_id = 'U0') or (entity_type = 'device' and entity_id = 'D1') or (entity_type = 'ip' and entity_id = '45.9.x.x')) as blocked
  from (select incident, ts_us, risk, unnest([{'entity_type': 'user', 'entity_id': user_id}, {'entity_type': 'device', 'entity_id': device_id},
    {'entity_type': 'ip', 'entity_id': ip_mask}], recursive := true) from assigned) group by 1, 2, 3),
icount as (select incident, count(*) filter (entity_type = 'user') as users_n, count(*) filter (entity_type = 'device') as devices_n,
    count(*) filter (entity_type = 'ip') as ips_n, sum(events)::bigint as entity_events_n, sum(flagged)::bigint as flagged_n, sum(blocked)::bigint as blocked_n,
    max(peak_risk) as peak_risk, (sum(events) filter (entity_type = 'user'))::bigint as events_n, min(first_us) as first_us, max(last_us) as last_us from ents group by 1),
icamp as (select incident, list_sort(list(distinct campaign_id)) as campaigns from assigned group by 1)"""


def _keyed(spark, folder):
    def build():
        nodes = T.graph_nodes(spark, folder).filter(node_type(F.col("node")) == "D")
        named = nodes.withColumn("device_id", F.expr("substring(node, instr(node, '|') + 3)"))
        lowest = named.groupBy("component").agg(F.min("device_id").alias("graph_key"))
        keys = named.join(lowest, "component").select("device_id", F.split_part("node", F.lit("|"), F.lit(1)).cast("long").alias("_w"), "graph_key")
        rows = T.decisions(spark, folder).filter(F.col("level").isin("HIGH", "CRITICAL")).withColumn("_w", time_bucket("ts_us", T.CONFIG.graph_ttl_s))
        return I.incident_keys(rows.join(keys, ["device_id", "_w"], "left").drop("_w")).select(*I.KEPT, "keys")
    return staged(spark, "keyed", (folder,), build)


def _assigned(spark, folder):
    return staged(spark, "assigned", (folder,), lambda: I.correlate(_keyed(spark, folder), T.CONFIG).select(*I.KEPT, "incident"))


def _masked_blocklist(spark):
    rows = T.blocklist(spark)
    return rows.withColumn("entity_id", F.when(F.col("entity_type") == "ip", mask_ip(F.col("entity_id"))).otherwise(F.col("entity_id")))


def _entities(spark, folder):
    return I.entity_rollup(_assigned(spark, folder), _masked_blocklist(spark))


def _incidents(spark, folder):
    return staged(spark, "incidents", (folder,), lambda: I.build_incidents(_assigned(spark, folder), T.CONFIG, _masked_blocklist(spark)))


@query("i1_incident_keys", sql("select event_id, key from ikeys where key is not null", "decisions", KEYS))
def incident_keys(spark, folder):
    return _keyed(spark, folder).select("event_id", F.explode("keys").alias("key"))


@query("i2b_correlation", sql("select event_id, incident from assigned", "decisions", INCIDENTS))
def correlation(spark, folder):
    return _assigned(spark, folder).select("event_id", "incident")


@query("i3_entity_rollup", sql("select incident, entity_type, entity_id, first_us, last_us, events, flagged, peak_risk, blocked from ents", "decisions", INCIDENTS))
def entity_rollup(spark, folder):
    return _entities(spark, folder)


@query("i4_counters", sql("select * from icount", "decisions", INCIDENTS))
def counters(spark, folder):
    return I.incident_counters(_entities(spark, folder))


@query("i5_campaigns", sql("select incident, array_to_string(campaigns, ',') as campaigns from icamp", "decisions", INCIDENTS))
def campaigns(spark, folder):
    return I.incident_campaigns(_assigned(spark, folder)).select("incident", joined("campaigns"))


STATUS_SQL = """select incident, case when idle > 300 then 'closed' else 'open' end as status, case when idle > 300 then round(idle, 1) end as idle_s
from (select incident, ((select max(ts_us) from decisions) - last_us) / 1e6 as idle from icount)"""


@query("i6_live_status", sql(STATUS_SQL, "decisions", INCIDENTS))
def live_status(spark, folder):
    end = T.decisions(spark, folder).agg(F.max("ts_us")).scalar()
    return I.with_live_status(_incidents(spark, folder), end).select("incident", "status", "idle_s")


SUMMARY_SQL = """select incident, entity_events_n || ' suspicious clicks from ' || users_n || ' account(s) across ' || devices_n || ' device(s) on '
  || array_to_string(campaigns, ', ') || '; peak risk ' || format('{:.2f}', peak_risk) as summary, h.reason_title || ' on ' || h.campaign_id as classification,
  round(w, 2) as wasted_spend
from icount join icamp using (incident) join (select incident, reason_title, campaign_id from assigned
  qualify row_number() over (partition by incident order by ts_us, event_id) = 1) h using (incident)
join (select incident, sum(case campaign_id when 'C10' then 12.0::double when 'C11' then 8.5 when 'C12' then 15.0 when 'C13' then 7.0 when 'C14' then 10.5 else 9.0 end) as w
  from assigned group by 1) using (incident)"""


@query("i7_summary", sql(SUMMARY_SQL, "decisions", INCIDENTS))
def summary(spark, folder):
    return _incidents(spark, folder).select("incident", "summary", "classification", "wasted_spend")


@query("i8_incident_detail", sql("""
select incident, 'level' as kind, level as name, count(*) as n from assigned group by 1, 3
union all (select incident, 'reason', reason_title, count(*) as n from assigned group by 1, 3 qualify row_number() over (partition by incident order by n desc, reason_title) <= 5)
union all (select incident, 'rule', rule, count(*) as n from (select incident, unnest(rules_fired) as rule from assigned) group by 1, 3
  qualify row_number() over (partition by incident order by n desc, rule) <= 8)""", "decisions", INCIDENTS))
def incident_detail(spark, folder):
    rows = _assigned(spark, folder)
    levels = I.level_counts(rows).select("incident", F.lit("level").alias("kind"), F.col("level").alias("name"), "n")
    return levels.unionByName(I.top_parts(rows))


@query("i9_newest", sql("select incident, last_us from icount", "decisions", INCIDENTS))
def newest_incidents(spark, folder):
    return I.newest_incidents(_incidents(spark, folder)).select("incident", "last_us")


@query("i10_entity_preview", sql("""select incident, array_to_string(list(name order by r), ',') as entities from (select incident, entity_type || ':' || entity_id as name,
  row_number() over (partition by incident order by flagged desc, events desc, entity_type, entity_id) as r from ents) where r <= 6 group by 1""", "decisions", INCIDENTS))
def entity_preview(spark, folder):
    return I.entity_preview(_entities(spark, folder)).select("incident", joined("entities"))


@query("a7_incident_blocks", sql("""select entity_type, entity_id, incident, 'incident ' || incident as reason, peak_risk from ents where blocked = 0""", "decisions", INCIDENTS))
def incident_blocks(spark, folder):
    return A.incident_blocks(_entities(spark, folder), _masked_blocklist(spark))


@query("q19_combined_kinds", sql(f"""select 'incidents' as kind, status as k, count(*) as n from ({STATUS_SQL}) group by 2
union all select 'alerts', severity, count(*) from alerts where status = 'open' group by 2
union all select 'blocked', entity_type, count(*) from state where active group by 2
union all select 'classifications', classification, count(*) from decisions where risk >= 0.3 group by 2""", "decisions",
                                 INCIDENTS.strip() + ",\n" + ALERTS.strip() + ",\n" + CHANGES.strip()))
def combined_kinds(spark, folder):
    rows = T.decisions(spark, folder)
    live = I.with_live_status(_incidents(spark, folder), rows.agg(F.max("ts_us")).scalar())
    return Q.combined_kinds(rows, live, _alerts(spark, folder), A.blocklist_state(_changes(spark, folder)), 0.3)


@query("a9_alert_incidents", sql("select a.user_id, a.ts_us, a.event_id, s.incident as incident_id from alerts a left join assigned s on s.event_id = a.event_id", "decisions",
                                 INCIDENTS.strip() + ",\n" + ALERTS.strip()))
def alert_incidents(spark, folder):
    return A.with_incident(_alerts(spark, folder), _assigned(spark, folder)).select("user_id", "ts_us", "event_id", "incident_id")


@query("p11_search_all", sql(SEARCH + """
union all select * from (select 'incident', incident as id, entity_events_n::bigint, last_us, null from icount where contains(incident, '1') order by last_us desc, id limit 20)
union all select * from (select 'alert', event_id as id, 1::bigint, ts_us, severity from alerts where contains('Suspicious activity: ' || user_id, '1') order by ts_us desc, id limit 20)""",
                             "decisions", INCIDENTS.strip() + ",\n" + ALERTS.strip()))
def search_all(spark, folder):
    return Q.search_everything(T.decisions(spark, folder), "1", 20, _incidents(spark, folder), _alerts(spark, folder))


@query("q30_open_work", sql("""select 'alert' as kind, user_id as id, ts_us from alerts where ts_us >= (select max(ts_us) from decisions) - 1200000000 or status = 'open'
union all select 'incident', incident, last_us from (select incident, last_us, (select max(ts_us) from decisions) as e from icount)
  where last_us >= e - 1200000000 or (e - last_us) / 1e6 <= 300""", "decisions", INCIDENTS.strip() + ",\n" + ALERTS.strip()))
def open_work(spark, folder):
    end = T.decisions(spark, folder).agg(F.max("ts_us")).scalar()
    alerts = Q.keep_unfinished(_alerts(spark, folder), "ts_us", end - 1200 * SECOND, "open")
    incs = Q.keep_unfinished(I.with_live_status(_incidents(spark, folder), end), "last_us", end - 1200 * SECOND, "open")
    return alerts.select(F.lit("alert").alias("kind"), F.col("user_id").alias("id"), "ts_us").unionByName(
        incs.select(F.lit("incident").alias("kind"), F.col("incident").alias("id"), F.col("last_us").alias("ts_us")))


@query("t9_user_sessions", sql("""select user_id, min(ts_us) as start_us, max(ts_us) as last_us, count(*) as clicks from (
  select user_id, ts_us, sum(fresh) over (partition by user_id order by ts_us, event_id) as s from (select *,
    case when ts_us - lag(ts_us) over (partition by user_id order by ts_us, event_id) <= 300000000 then 0 else 1 end as fresh from clicks)) group by user_id, s"""))
def user_sessions(spark, folder):
    rows = T.clicks(spark, folder).withColumn("n", F.lit(1))
    runs = islands(rows, ["user_id"], "ts_us", 300)
    sizes = rows.groupBy("user_id", time_bucket("ts_us", 300).alias("bucket")).agg(Q.rows_n().alias("n"))
    return (runs.join(sizes, ["user_id", "bucket"]).groupBy("user_id", F.col("start").alias("start_us"))
            .agg(F.max("last").alias("last_us"), F.sum("n").alias("clicks")))


@query("t8_tumbling_counts", sql(f"select ts_us // 10000000 * 10 as bucket_s, campaign_id, count(*) as n, {FLAGGED} as flagged from decisions group by 1, 2", "decisions"))
def tumbling_counts(spark, folder):
    return T.decisions(spark, folder).groupBy((time_bucket("ts_us", 10) * 10).alias("bucket_s"), "campaign_id").agg(
        Q.rows_n().alias("n"), flagged_sum(F.col("action")).alias("flagged"))


@query("t4_deduplicate", sql("select event_id, ts_us, user_id from clicks"))
def deduplicated(spark, folder):
    rows = T.clicks(spark, folder)
    return C.deduplicate(rows.unionByName(rows)).select("event_id", "ts_us", "user_id")
