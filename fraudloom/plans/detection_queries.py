"""Queries over rules, fusion, graph, patterns and reasons."""

from __future__ import annotations

from pyspark.sql import functions as F

from fraudloom.config import RULE_TEXT, RULE_WEIGHTS, SECOND
from fraudloom.operators import features as FE
from fraudloom.operators import fusion as Z
from fraudloom.operators import graph as G
from fraudloom.operators import patterns as P
from fraudloom.operators import reasons as X
from fraudloom.operators import rules as R
from fraudloom.operators.analytics import rows_n
from fraudloom.operators.prefix import sliding_count
from fraudloom.plans import tables as T
from fraudloom.plans.oracle import RULE_SQL, fuse_sql, graph_sql, rule_columns, sql
from fraudloom.plans.registry import joined, query, r6, r6_of

# ---------------------------------------------------------------- rules
RULE_QUERIES = {
    "r1_high_click_velocity": "high_click_velocity", "r2_tiny_interval": "tiny_interval", "r3_bot_user_agent": "bot_user_agent",
    "r5_impossible_geo": "impossible_geo", "r6_device_sharing": "device_sharing", "r7_ip_device_fanin": "ip_device_fanin",
    "r8_repeat_ad": "repeat_ad",
}


def _rule_query(key, rule):
    @query(key, sql(f"select event_id, user_id, {RULE_WEIGHTS[rule]}::double as weight from feat where {RULE_SQL[rule]}", "feat"))
    def run(spark, folder):
        hit = R.rule_conditions(T.CONFIG.rule_limits, F.lit(False))[rule]
        return T.features(spark, folder).filter(hit).select("event_id", "user_id", F.lit(RULE_WEIGHTS[rule]).alias("weight"))


for _key, _rule in RULE_QUERIES.items():
    _rule_query(_key, _rule)

_WITH_IP = {**RULE_SQL, "blocked_ip": "ip_address = '45.9.0.7'"}


@query("r4_blocked_ip", sql(f"""select event_id, rule_score, rule_score >= 1.0 as rule_hard, array_to_string(rules_fired, ',') as rules_fired
from (select *, {rule_columns(_WITH_IP)} from feat)""", "feat"))
def blocked_ip(spark, folder):
    ips = T.blocklist(spark).filter("entity_type = 'ip'").select(F.col("entity_id").alias("ip_address"), F.lit(True).alias("_hit"))
    table = T.features(spark, folder).join(ips, "ip_address", "left")
    out = R.evaluate_rules(table, T.CONFIG, blocked=F.coalesce("_hit", F.lit(False)))
    return out.select("event_id", "rule_score", "rule_hard", joined("rules_fired"))


@query("r9_rule_evaluation", sql("select event_id, rule_score, rule_score >= 1.0 as rule_hard, array_to_string(rules_fired, ',') as rules_fired from ruled", "ruled"))
def rule_evaluation(spark, folder):
    return R.evaluate_rules(T.features(spark, folder), T.CONFIG).select("event_id", "rule_score", "rule_hard", joined("rules_fired"))


_OVERRIDE_SQL = {**RULE_SQL, "high_click_velocity": "clicks_1m > 12", "device_sharing": "unique_users_per_device > 2"}


@query("r10_rule_overrides", sql(f"""select event_id, rule_score, array_to_string(rules_fired, ',') as rules_fired
from (select *, {rule_columns(_OVERRIDE_SQL, {**RULE_WEIGHTS, 'bot_user_agent': 0.95})} from feat)""", "feat"))
def rule_overrides(spark, folder):
    edits = spark.createDataFrame([("max_clicks_per_min", 12.0), ("max_users_per_device", 2.0), ("bot_user_agent", 0.95)],
                                  "name string, value double")
    out = R.evaluate_with_overrides(T.features(spark, folder), edits, T.CONFIG)
    return out.select("event_id", "rule_score", joined("rules_fired"))


# ---------------------------------------------------------------- fusion, with stand-in scores for the model layers
STAND_INS = """
layered as (select *, rule_score as score_rules, rule_score >= 1.0 as rule_hard,
  case when event_type <> 'error' then least(1.0, clicks_1m / 40.0::double) end as score_ml,
  case when event_type <> 'signup' then burst_score / (1.0 + burst_score) end as score_online,
  case when event_type not in ('error', 'view') then least(1.0, unique_users_per_ip / 20.0::double) end as score_anomaly,
  case when event_type <> 'purchase' then least(1.0, campaign_click_share_5m) end as score_graph from ruled),
""" + fuse_sql("layered", "fusedx").strip()


def layered(spark, folder):
    """Features and rules with deterministic stand-ins for the model layers, some of them missing."""
    kind, c = F.col("event_type"), F.col
    table = R.evaluate_rules(T.features(spark, folder), T.CONFIG)
    return table.withColumns({
        "score_rules": c("rule_score"),
        "score_ml": F.when(kind != "error", F.least(F.lit(1.0), c("clicks_1m") / F.lit(40.0))),
        "score_online": F.when(kind != "signup", c("burst_score") / (F.lit(1.0) + c("burst_score"))),
        "score_anomaly": F.when(~kind.isin("error", "view"), F.least(F.lit(1.0), c("unique_users_per_ip") / F.lit(20.0))),
        "score_graph": F.when(kind != "purchase", F.least(F.lit(1.0), c("campaign_click_share_5m")))})


@query("z1_weighted_mean", sql(f"select event_id, {r6_of('mean_risk')} as mean_risk, {r6_of('used_w')} as used_weight from fusedx", "ruled", STAND_INS))
def weighted_mean(spark, folder):
    return layered(spark, folder).select("event_id", r6(Z.weighted_mean(T.CONFIG), "mean_risk"), r6(Z.used_weight(T.CONFIG), "used_weight"))


@query("z2_peak_lift", sql(f"select event_id, {r6_of('lifted')} as lifted from fusedx", "ruled", STAND_INS))
def peak_lift(spark, folder):
    return layered(spark, folder).select("event_id", r6(Z.peak_lift(Z.weighted_mean(T.CONFIG)), "lifted"))


@query("z3_graph_boost", sql(f"select event_id, {r6_of('boosted')} as boosted from fusedx", "ruled", STAND_INS))
def graph_boost(spark, folder):
    risk = Z.graph_noisy_or(Z.peak_lift(Z.weighted_mean(T.CONFIG)), T.CONFIG.graph_boost)
    return layered(spark, folder).select("event_id", r6(risk, "boosted"))


@query("z4_hard_floor", sql(f"""select event_id, {r6_of("least(1.0, greatest(0.0, case when user_agent like 'curl%' then greatest(score_graph, 0.75) else coalesce(score_graph, 0.0) - 0.01 end))")} as risk
from layered""", "ruled", STAND_INS))
def hard_floor(spark, folder):
    hard = F.col("user_agent").startswith("curl")
    g = F.col("score_graph")
    base = F.when(hard, g).otherwise(F.coalesce(g, F.lit(0.0)) - F.lit(0.01))
    return layered(spark, folder).select("event_id", r6(Z.floor_and_clamp(base, hard, T.CONFIG.hard_floor), "risk"))


@query("z5_level_action", sql(f"select event_id, {r6_of('risk_raw')} as risk, level, action from fusedx", "ruled", STAND_INS))
def level_action(spark, folder):
    return Z.fuse(layered(spark, folder), T.CONFIG).select("event_id", r6("risk_raw", "risk"), "level", "action")


@query("z6_confidence", sql("select event_id, confidence from fusedx", "ruled", STAND_INS))
def layer_confidence(spark, folder):
    return Z.fuse(layered(spark, folder), T.CONFIG).select("event_id", "confidence")


@query("z7_decisions", sql(f"""select event_id, ts_us, user_id, ip_mask, {r6_of('risk_raw')} as risk, level, action, confidence,
  {r6_of('score_rules')} as rules, {r6_of('score_graph')} as graph, array_to_string(rules_fired, ',') as rules_fired from decisions""", "decisions"))
def decision_rows(spark, folder):
    return T.decisions(spark, folder).select("event_id", "ts_us", "user_id", "ip_mask", r6("risk_raw", "risk"), "level", "action",
                                             "confidence", r6("score_rules", "rules"), r6("score_graph", "graph"), joined("rules_fired"))


@query("z8_rejected", sql("select event_id, user_id, device_id, risk, level, action, confidence, array_to_string(rules_fired, ',') as rules_fired, "
                           "reason_title, reason, score_rules, score_graph from enforced where hit", "enforced"))
def rejected(spark, folder):
    return T.enforced(spark, folder).filter("action = 'REJECTED'").select(
        "event_id", "user_id", "device_id", "risk", "level", "action", "confidence", joined("rules_fired"), "reason_title", "reason",
        "score_rules", "score_graph")


@query("x8_reason_detail", sql("""select event_id, level, action, risk, array_to_string(rules_fired, ',') as rules, score_rules as rules_score, score_graph as graph_score,
  graph_users, graph_devices, ts_us as event_us, reason, reason_title as title, case when level in ('HIGH', 'CRITICAL') and not hit then least(3, len(rules_fired)) else 0 end::int as n_factors,
  case when level in ('HIGH', 'CRITICAL') and not hit and len(rules_fired) > 0 then upper(substr(rules_fired[1], 1, 1)) || replace(substr(rules_fired[1], 2), '_', ' ') end as first_factor
  from enforced""", "enforced"))
def reason_detail(spark, folder):
    """The evidence behind every decision, as alerts, blocks and the analyst view carry it."""
    rows = T.enforced(spark, folder).select("event_id", X.reason_detail().alias("d"))
    return rows.select("event_id", "d.level", "d.action", "d.risk", F.array_join("d.rules", ",").alias("rules"), F.col("d.scores.rules").alias("rules_score"),
                       F.col("d.scores.graph").alias("graph_score"), F.col("d.graph.users").alias("graph_users"), F.col("d.graph.devices").alias("graph_devices"),
                       "d.event_us", "d.reason", "d.title", F.size("d.factors").alias("n_factors"), F.get("d.factors", F.lit(0))["label"].alias("first_factor"))


# ---------------------------------------------------------------- graph
EDGES = """
gx as (select 'U:' || user_id as src, 'D:' || device_id as dst, ts_us from clicks
  union all select 'D:' || device_id, 'I:' || ip_address, ts_us from clicks
  union all select 'I:' || ip_address, 'S:' || regexp_extract(ip_address, '^(.*)[.][^.]*$', 1), ts_us from clicks),
ge as (select src, dst, max(ts_us) as last_us from gx group by 1, 2)"""
REACH = EDGES + """,
gl as (select src, dst from ge union select dst, src from ge),
gr(node, other) as (select src, src from gl union select r.node, l.dst from gr r join gl l on r.other = l.src),
gc as (select node, min(other) as component from gr group by node),
gp as (select component, count(*) filter (node like 'U:%') as users, count(*) filter (node like 'D:%') as devices,
  count(*) filter (node like 'I:%') as ips, count(*) filter (node like 'S:%') as subnets from gc group by 1)"""


@query("g1_edges", sql("select src, dst, last_us from ge", "clicks", EDGES))
def edges(spark, folder):
    return G.click_edges(T.clicks(spark, folder))


@query("g2_live_edges", sql("select src, dst, last_us from ge where last_us >= (select max(ts_us) from clicks) - 900000000", "clicks", EDGES))
def live_edges(spark, folder):
    rows = T.clicks(spark, folder)
    return G.live_edges(G.click_edges(rows), rows.agg(F.max("ts_us")).scalar(), T.CONFIG.graph_ttl_s)


def _components(spark, folder):
    from fraudloom.session import staged
    return staged(spark, "components", (folder,), lambda: G.connected_components(G.click_edges(T.clicks(spark, folder))))


@query("g3_components", sql("select node, component from gc", "clicks", REACH))
def components(spark, folder):
    return _components(spark, folder)


@query("g4_component_profile", sql("select component, users, devices, ips, subnets from gp", "clicks", REACH))
def component_profile(spark, folder):
    return G.component_profile(_components(spark, folder))


@query("g5_graph_score", sql(f"""select c.event_id, {r6_of("1.0 - exp(-greatest(0, greatest(users, devices) - 3) / 6.0::double)")} as score
from clicks c join gc on gc.node = 'D:' || c.device_id join gp using (component)""", "clicks", REACH))
def component_score(spark, folder):
    nodes = _components(spark, folder)
    scores = nodes.filter("node like 'D:%'").join(G.scored_components(nodes), "component").select("node", "score")
    probes = T.clicks(spark, folder).select("event_id", F.concat(F.lit("D:"), "device_id").alias("node"))
    return probes.join(scores, "node").select("event_id", r6("score"))


@query("g6_snapshot_score", graph_sql(f"""select c.event_id, graph_users, graph_devices, graph_ips, graph_subnets, {r6_of('score_graph')} as score_graph
from clicks c join gscores g on c.ts_us // 900000000 = g."window" and c.device_id = g.device_id"""))
def snapshot_score(spark, folder):
    out = G.with_graph_score(T.clicks(spark, folder), T.graph_scores(spark, folder), T.CONFIG)
    return out.select("event_id", "graph_users", "graph_devices", "graph_ips", "graph_subnets", r6("score_graph"))


@query("g7_ego_subgraph", sql("""select src, dst from ge where src in (select node from ego) and dst in (select node from ego)""", "clicks", REACH + """,
ego as (select node from gc where component = (select component from gc where node = 'U:U1') )"""))
def ego(spark, folder):
    table = G.click_edges(T.clicks(spark, folder))
    return G.ego_subgraph(table, _components(spark, folder), "U:U1")[1]


@query("g8_reached_within", sql("select origin, node, min(hop)::int as hop from hops where node <> origin group by 1, 2", "clicks", EDGES + """,
gk as (select src, dst from ge where src not like 'I:%' union select dst, src from ge where src not like 'I:%'),
hops(origin, node, hop) as (select distinct src, src, 0 from gk where src in (select 'U:' || user_id from clicks where user_id = 'U1')
  union select h.origin, k.dst, h.hop + 1 from hops h join gk k on h.node = k.src where h.hop < 2)"""))
def reached_within(spark, folder):
    rows = T.clicks(spark, folder)
    start = rows.filter("user_id = 'U1'").select(F.concat(F.lit("U:"), "user_id").alias("origin")).distinct()
    used_from = G.click_edges(rows).filter("src not like 'I:%'")
    return G.reached_within(used_from, start, 2)


@query("g9_user_campaign", sql("select user_id, campaign_id, count(*) as clicks, max(ts_us) as last_us from clicks group by 1, 2"))
def user_campaign(spark, folder):
    return G.user_campaign_edges(T.clicks(spark, folder))


# ---------------------------------------------------------------- patterns
@query("n1_builtin_conditions", sql("select event_id, array_to_string(conditions, ',') as conditions from decisions", "decisions"))
def builtin_conditions(spark, folder):
    return T.decisions(spark, folder).select("event_id", joined("conditions"))


@query("n2_classification", sql("select classification, count(*) as n from decisions group by 1", "decisions"))
def classification(spark, folder):
    return T.decisions(spark, folder).groupBy("classification").agg(rows_n().alias("n"))


def signatures(spark):
    return spark.createDataFrame([
        (1, "fast clicker", None, True, [("clicks_1m", ">=", 20.0), ("interval_cv", "<=", 1.2), ("repeat_ad_ratio", ">", 0.5)]),
        (2, "shared hardware", 2, True, [("unique_users_per_device", ">", 2.0), ("unique_devices_per_ip", ">=", 4.0),
                                         ("geo_user_countries", "==", 2.0), ("no_such_feature", ">", 0.0)]),
        (3, "switched off", 2, False, [("clicks_1h", ">=", 1.0), ("clicks_1m", ">=", 1.0)])], P.CONDITION_SCHEMA)


_MET1 = "(clicks_1m >= 20)::int + (interval_cv <= 1.2)::int + (repeat_ad_ratio > 0.5)::int >= 3"
_MET2 = "(unique_users_per_device > 2)::int + (unique_devices_per_ip >= 4)::int + (geo_user_countries = 2)::int >= 2"
MATCHED = f"""
matched as (select *, list_filter([case when {_MET1} then 'fast clicker' end, case when {_MET2} then 'shared hardware' end],
  lambda x: x is not null) as names from decisions)"""


@query("n3_signature_match", sql("select event_id, array_to_string(names, ',') as names from matched where len(names) > 0", "decisions", MATCHED))
def signature_match(spark, folder):
    out = P.match_signatures(T.decisions(spark, folder), signatures(spark))
    return out.filter(F.size("pattern_names") > 0).select("event_id", joined("pattern_names", "names"))


@query("n5_signature_preview", sql("""select count(*) as checked, count(*) filter (hit) as matches,
  array_to_string(list_slice(list(event_id order by ts_us desc, event_id desc) filter (hit), 1, 10), ',') as examples
from (select *, list_contains(names, 'fast clicker') as hit from matched where level in ('CRITICAL', 'HIGH'))""", "decisions", MATCHED))
def signature_preview(spark, folder):
    return P.preview(T.decisions(spark, folder), signatures(spark).filter("pattern_id = 1"))


@query("n6_pattern_hits", sql("""select n.id as pattern_id, count(*) as hits, max(ts_us) as last_us
from matched, (values (1::bigint, 'fast clicker'), (2::bigint, 'shared hardware')) n(id, name)
where list_contains(names, n.name) and level in ('HIGH', 'CRITICAL') and ts_us >= 600000000 group by 1""", "decisions", MATCHED))
def pattern_hits(spark, folder):
    labelled = P.label_suspicious(T.decisions(spark, folder), signatures(spark))
    return P.hit_counts(P.pattern_hits(labelled), 600 * SECOND)


@query("n7_labelled_titles", sql("""select event_id, case when len(names) > 0 then reason_title || ' (' || array_to_string(list_slice(names, 1, 2), ', ') || ')' else reason_title end as reason_title
from matched where level in ('HIGH', 'CRITICAL')""", "decisions", MATCHED))
def labelled_titles(spark, folder):
    return P.label_suspicious(T.decisions(spark, folder), signatures(spark)).select("event_id", "reason_title")


# ---------------------------------------------------------------- reasons and investigation
@query("x1_rule_reasons", sql("select event_id, reason_title, reason from decisions where len(rules_fired) > 0", "decisions"))
def rule_reasons(spark, folder):
    return T.decisions(spark, folder).filter(F.size("rules_fired") > 0).select("event_id", "reason_title", "reason")


@query("x2_fallback_reasons", sql("select event_id, reason_title, reason from decisions where len(rules_fired) = 0", "decisions"))
def fallback_reasons(spark, folder):
    return T.decisions(spark, folder).filter(F.size("rules_fired") == 0).select("event_id", "reason_title", "reason")


FACTORS_SQL = """select event_id, 'clicks in the last minute was ' || clicks_1m::bigint || ' (normal 1); accounts sharing this device was '
  || unique_users_per_device::bigint || ' (normal 1)' as line from feat"""


@query("x3_factor_lines", sql(FACTORS_SQL, "feat"))
def factor_lines(spark, folder):
    factor = lambda f: F.struct(F.lit(f).alias("feature"), F.lit(f).alias("label"), F.col(f).alias("value"),
                                F.lit(1.0).alias("typical"), F.lit(0.1).alias("contribution"))
    lines = X.factor_lines(F.array(factor("clicks_1m"), factor("unique_users_per_device")))
    return T.features(spark, folder).select("event_id", F.array_join(lines, "; ").alias("line"))


_BARE = " ".join(f"when '{n}' then '{RULE_TEXT[n][1].split('{')[0].strip()}'" for n in RULE_TEXT)


@query("x4_reason_backfill", sql(f"""select event_id, case when len(rules_fired) > 0 then
  upper(substr(b, 1, 1)) || substr(b, 2) else reason end as reason, reason_title
from (select *, case rules_fired[1] {_BARE} end as b from decisions)""", "decisions"))
def reason_backfill(spark, folder):
    empty = F.array().cast("array<struct<feature:string,label:string,value:double,typical:double,contribution:double>>")
    old = T.decisions(spark, folder).withColumns({"reason": F.lit(None).cast("string"), "reason_title": F.lit(None).cast("string"),
                                                  "factors": empty})
    return X.backfill_reasons(old).select("event_id", "reason", "reason_title")


INVESTIGATED = """
latest as (select *, case when graph_users >= 10 and unique_devices_per_ip >= 6 then 'device farm' when graph_users >= 10 then 'distributed click farm'
    when geo_user_countries >= 2 or unique_ips_per_device >= 3 then 'IP rotation'
    when clicks_10s >= 15 or (min_interval < 0.25 and clicks_1m >= 5) then 'click burst / scripted bot'
    when ua_bot_flag > 0 and interval_cv < 0.3 then 'scripted bot' when unique_users_per_device >= 3 then 'mimicry ring (shared devices)'
    when repeat_ad_ratio > 0.8 and clicks_5m >= 10 then 'low-and-slow repeat clicking' else 'suspicious (unclassified)' end as kind
  from decisions qualify row_number() over (partition by user_id order by ts_us desc, event_id desc) = 1)"""
LATEST_COLUMNS = ["user_id", "event_id", "ts_us", "device_id", "campaign_id", "risk", "level", "reason", "reason_title", "graph_users",
                  "graph_devices", "clicks_1m", "clicks_5m", "clicks_10s", "min_interval", "interval_cv", "unique_devices_per_ip",
                  "unique_users_per_device", "unique_ips_per_device", "geo_user_countries", "repeat_ad_ratio", "ua_bot_flag",
                  "campaign_click_share_5m"]


def _latest(spark, folder):
    return FE.latest_per_user(T.decisions(spark, folder), LATEST_COLUMNS)


@query("x5_attack_type", sql("select user_id, event_id, kind as attack_type from latest", "decisions", INVESTIGATED))
def attack_types(spark, folder):
    return _latest(spark, folder).select("user_id", "event_id", X.attack_type().alias("attack_type"))


@query("x6_recommendation", sql("""select user_id, event_id, kind as attack_type, floor(risk * 1000 + 0.5) / 1000 as confidence, reason as summary,
  case when risk >= 0.9 then 'block' when risk >= 0.5 then 'monitor' else 'allow' end as recommendation, reason_title, 'pending' as status from latest""",
                                    "decisions", INVESTIGATED))
def recommendations(spark, folder):
    return X.recommend(_latest(spark, folder))


@query("x7_evidence", sql(f"""select l.user_id, l.event_id, l.risk, l.level, l.graph_users, l.graph_devices, {r6_of('l.campaign_click_share_5m')} as share_5m,
  (select count(*) from clicks c where c.device_id = l.device_id and c.ts_us between l.ts_us - 3600000000 and l.ts_us) as device_clicks_1h,
  (select count(distinct c.user_id) from clicks c where c.device_id = l.device_id and c.ts_us between l.ts_us - 3600000000 and l.ts_us) as device_users,
  (select count(*) from (select 1 from clicks c where c.user_id = l.user_id limit 30)) as history_n,
  (select array_to_string(list(ad_id order by ts_us desc, event_id desc), ',') from (select * from clicks c where c.user_id = l.user_id
     order by ts_us desc, event_id desc limit 30)) as history_ads from latest l""", "decisions", INVESTIGATED))
def evidence(spark, folder):
    rows, last = T.clicks(spark, folder), _latest(spark, folder)
    history = FE.click_history(rows, "user_id", 30).groupBy("user_id").agg(
        rows_n().alias("history_n"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "ad_id"))), lambda x: x["ad_id"]), ",").alias("history_ads"))
    device = sliding_count(rows.select("event_id", "device_id", "ts_us"), ["device_id"], "ts_us", 3600, "device_clicks_1h").select(
        "event_id", "device_clicks_1h")
    last = last.withColumn("device_users", F.col("unique_users_per_device").cast("long"))
    return (last.join(history, "user_id").join(device, "event_id")
            .select("user_id", "event_id", "risk", "level", "graph_users", "graph_devices", r6("campaign_click_share_5m", "share_5m"),
                    "device_clicks_1h", "device_users", "history_n", "history_ads"))


@query("m12_rule_factors", sql("""select event_id, case when len(rules_fired) = 0 then 'No single dominant factor.' else
  array_to_string([upper(substr(r, 1, 1)) || replace(substr(r, 2), '_', ' ') for r in list_slice(rules_fired, 1, 3)], '; ') end as line from decisions""", "decisions"))
def rule_factor_text(spark, folder):
    return T.decisions(spark, folder).select("event_id", X.explanation_text(X.rule_factors(F.col("rules_fired"))).alias("line"))
