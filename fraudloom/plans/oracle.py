"""Building blocks of the DuckDB check queries: the same tables as ``plans.tables``, written as plain SQL."""

from __future__ import annotations

from fraudloom.config import (BOT_TOKENS, INTERVAL_EDGES, LAYER_TEXT, PATTERN_LABELS,
                              RULE_TEXT, RULE_WEIGHTS)

CLICKS = """
clicks as (
  select 'evt_' || event_id as event_id,
    case arch when 0 then (user_id * 37 % 60) * 60000000 + (us0 // 60000)
              when 5 then (user_id * 37 % 60) * 60000000 + (us0 // 3000)
              else us0 // 600 end as ts_us,
    event_type, 'U' || user_id as user_id,
    'AD' || (100 + case when arch in (0, 1, 5) then user_id % 12 else k % 12 end) as ad_id,
    'C' || (10 + (case when arch in (0, 1, 5) then user_id % 12 else k % 12 end) % 6) as campaign_id,
    'PUB' || (user_id % 6) as publisher_id,
    case arch when 2 then 'DS' || (user_id // 50) else 'D' || user_id end as device_id,
    case arch when 3 then '185.' || k || '.' || (event_id % 256) || '.' || (2 + user_id % 240)
              when 4 then '45.9.' || (user_id // 100) || '.7'
              else '11.' || (user_id // 250) || '.' || (user_id % 250) || '.9' end as ip_address,
    case arch when 1 then 'curl/8.4.0' when 6 then 'Mozilla/5.0 (iPhone; CPU iPhone OS 17_4)'
              else 'Mozilla/5.0 (Windows NT 10.0; Win64; x64)' end as user_agent,
    case when arch = 3 then case k % 3 when 0 then 'IN' when 1 then 'VN' else 'RU' end else 'IN' end as country,
    (user_id * 7919 % 3000) / 10.0::double as account_age_days,
    case when arch <= 5 then 1 else 0 end as label,
    case arch when 0 then 'burst' when 1 then 'bot' when 2 then 'mimicry' when 3 then 'ip_rotation'
              when 4 then 'device_farm' when 5 then 'low_and_slow' else 'normal' end as attack_type,
    'live' as source, 'run_' || (user_id % 2) as run_id, (event_id % 97) / 4.0::double as latency_ms
  from (select event_id, user_id, event_type, user_id % 10 as arch, epoch_us(ts) - 1704067200000000 as us0,
               cast(json_extract_string(props, '$.k') as int) as k from events))
"""

MASK = ("case when len(string_split({ip}, '.')) = 4 then split_part({ip}, '.', 1) || '.' || split_part({ip}, '.', 2) || '.x.x' "
        "when length({ip}) > 9 then substr({ip}, 1, 9) || '…' else {ip} end")


def mask(ip: str = "ip_address") -> str:
    return MASK.format(ip=ip)


BOT_FLAG = ("case when user_agent = '' or " + " or ".join(f"contains(lower(user_agent), '{t}')" for t in BOT_TOKENS)
            + " then 1.0::double else 0.0::double end")

_BINS = " + ".join(f"(case when g > {e} then 1 else 0 end)" for e in INTERVAL_EDGES)

FEATURE_TABLE = f"""
windowed as (
  select *,
    count(*) over (u rows between unbounded preceding and unbounded following) * 0 + count(*) over u10 as clicks_10s,
    count(*) over u60 as clicks_1m, count(*) over u300 as clicks_5m, count(*) over u3600 as clicks_1h,
    count(distinct ad_id) over u3600 as unique_ads_1h, count(distinct country) over u3600 as geo_user_countries,
    list(ad_id) over u300 as ads5,
    count(*) over d60 as device_clicks_1m, count(distinct user_id) over d3600 as unique_users_per_device,
    count(distinct ip_address) over d3600 as unique_ips_per_device,
    count(*) over i60 as ip_clicks_1m, count(distinct device_id) over i3600 as unique_devices_per_ip,
    count(distinct user_id) over i3600 as unique_users_per_ip, count(distinct country) over i3600 as geo_ip_countries,
    count(*) over c300 as campaign_5m, count(*) over g300 as all_5m,
    list(ts_us) over (partition by user_id order by ts_us, event_id rows between 20 preceding and current row) as last21
  from clicks
  window u as (partition by user_id order by ts_us),
    u10 as (partition by user_id order by ts_us range between 10000000 preceding and current row),
    u60 as (partition by user_id order by ts_us range between 60000000 preceding and current row),
    u300 as (partition by user_id order by ts_us range between 300000000 preceding and current row),
    u3600 as (partition by user_id order by ts_us range between 3600000000 preceding and current row),
    d60 as (partition by device_id order by ts_us range between 60000000 preceding and current row),
    d3600 as (partition by device_id order by ts_us range between 3600000000 preceding and current row),
    i60 as (partition by ip_address order by ts_us range between 60000000 preceding and current row),
    i3600 as (partition by ip_address order by ts_us range between 3600000000 preceding and current row),
    c300 as (partition by campaign_id order by ts_us range between 300000000 preceding and current row),
    g300 as (order by ts_us range between 300000000 preceding and current row)),
gapped as (
  select *, [(r[i] - r[i - 1]) / 1e6 for i in range(2, len(r) + 1)] as gap
  from (select *, list_filter(last21, lambda t: t >= ts_us - 3600000000) as r from windowed)),
timed as (
  select *, case when len(gap) = 0 then 300.0 else ((r[len(r)] - r[1]) / 1e6) / len(gap) end as avg_interval,
    coalesce(list_min(gap), 300.0) as min_interval, [{_BINS.replace('g >', 'g >')} for g in gap] as bins
  from gapped),
spread as (
  select *, case when len(gap) = 0 then 50.0
    else sqrt(list_sum([(g - avg_interval) * (g - avg_interval) for g in gap]) / len(gap)) end as interval_std
  from timed),
feat as (
  select event_id, ts_us, event_type, user_id, ad_id, campaign_id, publisher_id, device_id, ip_address, user_agent,
    country, account_age_days, label, attack_type, source, run_id, latency_ms,
    clicks_10s::double as clicks_10s, clicks_1m::double as clicks_1m, clicks_5m::double as clicks_5m,
    clicks_1h::double as clicks_1h, avg_interval, min_interval, interval_std,
    case when avg_interval > 0 and len(gap) >= 3 then interval_std / avg_interval else 1.0 end as interval_cv,
    case when len(gap) < 4 then 2.5 else 0.0 - list_sum([
      (case when n > 0 then n / len(bins) * log2(n / len(bins)) else 0 end)
      for n in [len([x for x in bins if x = b]) for b in range(0, {len(INTERVAL_EDGES) + 1})]]) end as timing_entropy,
    clicks_10s / (1.0 + clicks_5m / 30.0::double) as burst_score, unique_ads_1h::double as unique_ads_1h,
    case when clicks_5m >= 3 then list_max([len([x for x in ads5 if x = a]) for a in list_distinct(ads5)]) / clicks_5m
      else 0.0 end as repeat_ad_ratio,
    device_clicks_1m::double as device_clicks_1m, unique_users_per_device::double as unique_users_per_device,
    unique_ips_per_device::double as unique_ips_per_device, ip_clicks_1m::double as ip_clicks_1m,
    unique_devices_per_ip::double as unique_devices_per_ip, unique_users_per_ip::double as unique_users_per_ip,
    campaign_5m / greatest(1, all_5m) as campaign_click_share_5m, geo_user_countries::double as geo_user_countries,
    geo_ip_countries::double as geo_ip_countries, {BOT_FLAG} as ua_bot_flag
  from spread)
""".replace("count(*) over (u rows between unbounded preceding and unbounded following) * 0 + ", "")

RULE_SQL = {
    "high_click_velocity": "clicks_1m > 30", "tiny_interval": "min_interval < 0.25 and clicks_1m >= 5",
    "bot_user_agent": "ua_bot_flag > 0", "impossible_geo": "geo_user_countries > 1 and clicks_1h >= 3",
    "device_sharing": "unique_users_per_device > 4", "ip_device_fanin": "unique_devices_per_ip > 6",
    "repeat_ad": "repeat_ad_ratio > 0.9 and clicks_5m >= 20",
}


def rule_columns(conditions: dict[str, str], weights: dict[str, float] = RULE_WEIGHTS) -> str:
    score = ", ".join(f"case when {c} then {weights[n]} else 0.0 end" for n, c in conditions.items())
    names = ", ".join(f"case when {conditions[n]} then '{n}' end" for n in sorted(conditions))
    return f"greatest({score})::double as rule_score, list_filter([{names}], lambda x: x is not null) as rules_fired"


RULED = f"ruled as (select *, {rule_columns(RULE_SQL)} from feat)"

# One graph per 900-second window; every node reaches the smallest name of its component.
GRAPH = """
gedges as (
  select distinct w || '|' || a as a, w || '|' || b as b from (
    select ts_us // 900000000 as w, 'U:' || user_id as a, 'D:' || device_id as b from clicks
    union all select ts_us // 900000000, 'D:' || device_id, 'I:' || ip_address from clicks
    union all select ts_us // 900000000, 'I:' || ip_address,
      'S:' || split_part(ip_address, '.', 1) || '.' || split_part(ip_address, '.', 2) || '.' || split_part(ip_address, '.', 3)
      from clicks)),
glinks as (select a, b from gedges union select b, a from gedges),
greach(node, other) as (
  select a, a from glinks union select g.node, l.b from greach g join glinks l on g.other = l.a),
gnodes as (select node, min(other) as component from greach group by node),
gprofile as (
  select component, count(*) filter (node like '%|U:%') as graph_users, count(*) filter (node like '%|D:%') as graph_devices,
    count(*) filter (node like '%|I:%') as graph_ips, count(*) filter (node like '%|S:%') as graph_subnets
  from gnodes group by component),
gscores as (
  select split_part(n.node, '|', 1)::bigint as "window", substr(n.node, instr(n.node, '|') + 3) as device_id, p.*,
    1.0 - exp(-greatest(0, greatest(graph_users, graph_devices) - 3) / 6.0::double) as score_graph
  from gnodes n join gprofile p using (component) where n.node like '%|D:%')
"""

LAYERS = ["rules", "ml", "online", "anomaly"]
LAYER_W = {"rules": "0.3::double", "ml": "0.45::double", "online": "0.1::double", "anomaly": "0.15::double"}


def fuse_sql(source: str, out: str) -> str:
    """CTE chain that fuses score_* columns of ``source`` into ``out``."""
    used = " + ".join(f"(case when score_{layer} is not null then {LAYER_W[layer]} else 0.0::double end)" for layer in LAYERS)
    total = " + ".join(f"coalesce({LAYER_W[layer]} * score_{layer}, 0.0::double)" for layer in LAYERS)
    n = " + ".join(f"(score_{layer} is not null)::int" for layer in LAYERS)
    return f"""
{out}_m as (select *, 0.0::double + {used} as used_w, {n} as n_layers,
  greatest(coalesce(score_rules, 0.0), coalesce(score_ml, 0.0)) as peak,
  0.0::double + {total} as total_s from {source}),
{out}_n as (select *, case when used_w > 0 then total_s / used_w else 0.0 end as mean_risk from {out}_m),
{out}_p as (select *, case when peak >= 0.95 and n_layers > 1 then greatest(mean_risk, 0.5 * mean_risk + 0.5 * peak)
  else mean_risk end as lifted from {out}_n),
{out}_g as (select *, case when score_graph > 0 then 1.0 - (1.0 - lifted) * (1.0 - 0.6::double * score_graph) else lifted end
  as boosted from {out}_p),
{out}_r as (select *, case when used_w <= 0 and coalesce(score_graph, 0.0) = 0 then 0.0
  else least(1.0, greatest(0.0, case when rule_hard then greatest(boosted, 0.75) else boosted end)) end as risk_raw from {out}_g),
{out}_l as (select *, case when risk_raw >= 0.9 then 'CRITICAL' when risk_raw >= 0.7 then 'HIGH' when risk_raw >= 0.3 then 'MEDIUM'
  else 'LOW' end as level, case when used_w >= 0.85 then 'HIGH' when used_w >= 0.5 then 'MEDIUM' else 'LOW' end as confidence
  from {out}_r),
{out} as (select *, round(risk_raw, 4) as risk, case level when 'CRITICAL' then 'BLOCK' when 'HIGH' then 'FLAG'
  when 'MEDIUM' then 'MONITOR' else 'ALLOW' end as action from {out}_l)
"""


SCORES = f"""
withgraph as (
  select r.*, rule_score as score_rules, null::double as score_ml, null::double as score_online, null::double as score_anomaly,
    g.score_graph, g.graph_users, g.graph_devices, rule_score >= 1.0 as rule_hard, {mask('r.ip_address')} as ip_mask
  from ruled r left join gscores g on r.ts_us // 900000000 = g."window" and r.device_id = g.device_id),
{fuse_sql('withgraph', 'fused')}
"""


def _sentence(name: str) -> str:
    text = RULE_TEXT[name][1].replace("'", "''")
    cents = "((round(min_interval * 1e6)::bigint + 5000) // 10000)"
    values = {
        "clicks_1m": "clicks_1m::bigint", "over_limit": "', well above the normal rate of 30 a minute'",
        "min_interval": f"({cents} // 100) || '.' || lpad(({cents} % 100)::varchar, 2, '0')",
        "under_limit": "', below the 0.25 second minimum'", "ua": "user_agent", "ip": "ip_mask",
        "geo_user_countries": "geo_user_countries::bigint", "unique_users_per_device": "unique_users_per_device::bigint",
        "unique_devices_per_ip": "unique_devices_per_ip::bigint",
        "repeat_ad_ratio": "round_even(repeat_ad_ratio * 100, 0)::bigint || '%'",
    }
    parts, rest = [], text
    while "{" in rest:
        lit, _, tail = rest.partition("{")
        key, _, rest = tail.partition("}")
        parts += [f"'{lit}'", f"({values[key]})"]
    return " || ".join([*parts, f"'{rest}'"])


_SAID = ", ".join(f"case when list_contains(rules_fired, '{n}') then {{'title': '{RULE_TEXT[n][0]}', 'text': {_sentence(n)}}} end"
                  for n in sorted(RULE_TEXT))
_FALL = "coalesce(" + ", ".join(
    f"case when coalesce(score_{layer}, 0.0) >= 0.6 then {{'title': 'Suspicious to {p}', 'text': '{p} gave this click a score of ' "
    f"|| format('{{:.2f}}', score_{layer})}} end" for layer, p in LAYER_TEXT.items()
) + ", {'title': 'Unusual click pattern', 'text': 'several weak signals added up to a higher-than-usual risk score'})"

_COND = {
    "click_velocity": "clicks_1m >= 25 or clicks_10s >= 10",
    "tight_interval": "coalesce(nullif(min_interval, 0), 9) < 0.35",
    "interval_regularity": "coalesce(nullif(interval_cv, 0), 1) < 0.3 and clicks_1m >= 5",
    "bot_agent": "ua_bot_flag <> 0", "device_farm": "unique_users_per_device >= 3", "ip_fanin": "unique_devices_per_ip >= 4",
    "geo_spread": "coalesce(nullif(geo_user_countries, 0), 1) >= 2",
    "repeat_ad": "repeat_ad_ratio >= 0.8 and clicks_5m >= 8",
    "new_account": "coalesce(nullif(account_age_days, 0), 999) <= 1",
    "graph_cluster": "coalesce(graph_users, 0) >= 5 or coalesce(graph_devices, 0) >= 5",
}
_KEYS = ", ".join(f"case when {c} then '{k}' end" for k, c in _COND.items())
_LABELS = ", ".join(f"case when {c} then '{PATTERN_LABELS[k].lower()}' end" for k, c in _COND.items())

DECISIONS = f"""
said as (select *, list_filter([{_SAID}], lambda x: x is not null) as hit_s, level in ('HIGH', 'CRITICAL') as hot,
  list_filter([{_KEYS}], lambda x: x is not null) as conditions, list_filter([{_LABELS}], lambda x: x is not null) as labels
  from fused),
said2 as (select *, case when len(hit_s) > 0 then hit_s else [{_FALL}] end as s from said),
said3 as (select *, s[1].title as reason_title, array_to_string(list_slice(list_concat([x.text for x in list_slice(s, 1, 2)],
  case when hot and len(rules_fired) > 0
    then [upper(substr(rules_fired[1], 1, 1)) || replace(substr(rules_fired[1], 2), '_', ' ')] else [] end), 1, 2), '; ') as body
  from said2),
decisions as (select * exclude (hit_s, s, body, labels, hot), upper(substr(body, 1, 1)) || substr(body, 2) as reason,
  case when len(labels) >= 2 then array_to_string(list_slice(labels, 1, 3), ', ') else 'unclassified' end as classification
  from said3)
"""

ENFORCED = """
enforced as (select * replace (
    case when hit then 1.0 else risk end as risk, case when hit then 'CRITICAL' else level end as level,
    case when hit then 'REJECTED' else action end as action, case when hit then 'HIGH' else confidence end as confidence,
    case when hit then ['blocked_entity'] else rules_fired end as rules_fired,
    case when hit then 'Already blocked' else reason_title end as reason_title,
    case when hit then 'This account, device or network address is already blocked, so the click was rejected' else reason end as reason,
    case when hit then null else score_rules end as score_rules, case when hit then null else score_graph end as score_graph)
  from (select *, user_id = 'U0' or device_id = 'D1' or ip_address = '45.9.0.7' as hit from decisions))
"""

FLAGGED = "sum(case when action in ('FLAG', 'BLOCK') then 1 else 0 end)::bigint"
STAGES = [("clicks", CLICKS), ("feat", FEATURE_TABLE), ("ruled", RULED), ("gscores", GRAPH), ("fused", SCORES),
          ("decisions", DECISIONS), ("enforced", ENFORCED)]


def sql(body: str, upto: str = "clicks", extra: str = "") -> str:
    """Check query: the base tables up to ``upto``, further CTEs in ``extra``, then ``body``."""
    parts = []
    for name, text in STAGES:
        if upto in ("feat", "ruled") and name == "gscores":
            break
        parts.append(text.strip())
        if name == upto:
            break
    if extra:
        parts.append(extra.strip())
    return "with recursive " + ",\n".join(parts) + "\n" + body


def graph_sql(body: str, extra: str = "") -> str:
    """Check query over clicks and the windowed graph only."""
    return "with recursive " + ",\n".join([CLICKS.strip(), GRAPH.strip(), *([extra.strip()] if extra else [])]) + "\n" + body
