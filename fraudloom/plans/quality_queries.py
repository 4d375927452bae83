"""Queries over evaluation, drift and the external log."""

from __future__ import annotations

from pyspark.sql import functions as F

from fraudloom.config import FEATURES, SEEN_ATTACKS, UNSEEN_ATTACKS
from fraudloom.operators import analytics as Q
from fraudloom.operators import drift as D
from fraudloom.operators import evaluate as E
from fraudloom.operators import external as K
from fraudloom.operators import fusion as Z
from fraudloom.plans import tables as T
from fraudloom.plans.analyst_queries import BLOCKS, SNAPSHOT, _blocks
from fraudloom.plans.click_queries import EXTERNAL
from fraudloom.plans.detection_queries import STAND_INS, layered
from fraudloom.plans.oracle import sql
from fraudloom.plans.registry import query, r6, r6_of, r6_sql
from fraudloom.session import staged
from fraudloom.sources import clicks as C

LAYERS = {"rules": "score_rules", "ml": "score_ml", "online": "score_online", "anomaly": "score_anomaly", "graph": "score_graph", "fused": "risk_raw"}
LONG = STAND_INS + """,
sc as (""" + " union all ".join(f"select event_id, attack_type, label, '{k}' as layer, {v} as score from fusedx where {v} is not null" for k, v in LAYERS.items()) + """),
conf as (select layer, count(*) filter (score >= 0.5 and label = 1) as tp, count(*) filter (score >= 0.5 and label = 0) as fp,
  count(*) filter (score < 0.5 and label = 1) as fn, count(*) filter (score < 0.5 and label = 0) as tn from sc group by 1),
pts as (select layer, score, count(*) filter (label = 1) as p, count(*) filter (label = 0) as n from sc group by 1, 2),
cum as (select *, sum(p) over (partition by layer order by score desc) as tp, sum(n) over (partition by layer order by score desc) as fp from pts),
rank_m as (select layer, sum(n * (tp - p / 2.0::double)) / (sum(p) * sum(n))::double as roc_auc, sum(p * tp::double / (tp + fp)) / sum(p)::double as pr_auc from cum group by 1)"""
RATES = {"precision": "case when tp + fp > 0 then tp / (tp + fp) else 0 end", "recall": "case when tp + fn > 0 then tp / (tp + fn) else 0 end",
         "f1": "case when 2 * tp + fp + fn > 0 then 2 * tp / (2 * tp + fp + fn) else 0 end",
         "fpr": "case when fp + tn > 0 then fp / (fp + tn) else 0 end", "fnr": "case when fn + tp > 0 then fn / (fn + tp) else 0 end"}
RATES_SQL = ", ".join(f'{r6_of(e)} as "{n}"' for n, e in RATES.items())


def _rates():
    return [r6(n) for n in RATES]


def _fused(spark, folder):
    return staged(spark, "fused", (folder,), lambda: Z.fuse(layered(spark, folder), T.CONFIG))


def _scores(spark, folder):
    return staged(spark, "scores", (folder,), lambda: E.long_scores(_fused(spark, folder), LAYERS))


@query("e1_confusion", sql(f"select layer, tp, fp, fn, tn, {RATES_SQL} from conf", "ruled", LONG))
def confusion(spark, folder):
    return E.confusion(_scores(spark, folder)).select("layer", "tp", "fp", "fn", "tn", *_rates())


@query("e2_roc_auc", sql(f"select layer, {r6_of('roc_auc')} as roc_auc from rank_m", "ruled", LONG))
def roc_auc(spark, folder):
    return E.ranking_metrics(_scores(spark, folder)).select("layer", r6("roc_auc"))


@query("e3_average_precision", sql(f"select layer, {r6_of('pr_auc')} as pr_auc from rank_m", "ruled", LONG))
def average_precision(spark, folder):
    return E.ranking_metrics(_scores(spark, folder)).select("layer", r6("pr_auc"))


@query("e4_pr_points", sql(f"""select layer, {r6_of('score')} as score, {r6_of('tp / (tp + fp)')} as "precision", {r6_of('tp / (sum(p) over (partition by layer))')} as recall from cum""", "ruled", LONG))
def pr_points(spark, folder):
    return E.precision_recall_points(_scores(spark, folder)).select("layer", r6("score"), r6("precision"), r6("recall"))


@query("e5_layer_comparison", sql(f"select layer, tp, fp, fn, tn, {RATES_SQL}, {r6_sql('roc_auc', 'pr_auc')} from conf join rank_m using (layer)", "ruled", LONG))
def layer_comparison(spark, folder):
    return E.layer_comparison(_scores(spark, folder)).select("layer", "tp", "fp", "fn", "tn", *_rates(), r6("roc_auc"), r6("pr_auc"))


@query("m9_label_metrics", """
with sc as (select doc_id, 'length' as layer, toxic as label, least(1.0, n_chars / 5000.0::double) as score from labels join documents using (doc_id)),
pts as (select layer, score, count(*) filter (label = 1) as p, count(*) filter (label = 0) as n from sc group by 1, 2),
cum as (select *, sum(p) over (partition by layer order by score desc) as tp, sum(n) over (partition by layer order by score desc) as fp from pts),
conf as (select layer, count(*) filter (score >= 0.5 and label = 1) as tp, count(*) filter (score >= 0.5 and label = 0) as fp, count(*) filter (score < 0.5 and label = 1) as fn from sc group by 1)
select layer, """ + r6_of("case when 2 * tp + fp + fn > 0 then 2 * tp / (2 * tp + fp + fn) else 0 end") + " as f1, " + r6_of("roc_auc") + " as roc_auc, " + r6_of("pr_auc") + """ as pr_auc
from conf join (select layer, sum(n * (tp - p / 2.0::double)) / (sum(p) * sum(n))::double as roc_auc, sum(p * tp::double / (tp + fp)) / sum(p)::double as pr_auc from cum group by 1) using (layer)""")
def label_metrics(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "n_chars")
    rows = spark.read.parquet(f"{folder}/labels.parquet").join(docs, "doc_id")
    scores = rows.select(F.lit("length").alias("layer"), F.col("toxic").alias("label"), F.least(F.lit(1.0), F.col("n_chars") / F.lit(5000.0)).alias("score"))
    return E.layer_comparison(scores).select("layer", r6("f1"), r6("roc_auc"), r6("pr_auc"))


@query("e6_per_attack", sql(f"""select attack_type, count(*) as events, {r6_of("avg(case when action in ('FLAG', 'BLOCK', 'REJECTED') then 1.0 else 0.0 end)")} as flagged_rate,
  {r6_of("avg(case when action in ('BLOCK', 'REJECTED') then 1.0 else 0.0 end)")} as blocked_rate from enforced group by 1""", "enforced"))
def per_attack(spark, folder):
    return E.per_attack(T.enforced(spark, folder)).select("attack_type", "events", r6("flagged_rate"), r6("blocked_rate"))


@query("e7_per_actor", sql("""select attack, count(*) as actors, count(clicks) as detected, median(clicks)::double as median_clicks from (
  select user_id, max(attack_type) as attack, min(rn) filter (action in ('FLAG', 'BLOCK', 'REJECTED')) as clicks from (
    select *, row_number() over (partition by user_id order by ts_us, event_id) as rn from enforced) where label = 1 group by 1) group by 1""", "enforced"))
def per_actor(spark, folder):
    return E.per_actor(T.enforced(spark, folder))


@query("e8_unseen_recall", sql(f"""select layer, attack_type, {r6_of('avg(case when score >= 0.5 then 1.0 else 0.0 end)')} as recall, count(*) as events
from sc where attack_type in ('ip_rotation', 'low_and_slow', 'mimicry') group by 1, 2""", "ruled", LONG))
def unseen_recall(spark, folder):
    return E.recall_by_attack(_scores(spark, folder), UNSEEN_ATTACKS).select("layer", "attack_type", r6("recall"), "events")


@query("e9_legit_blocked", sql("select count(distinct user_id) as legit_users_blocked from blocks where user_id in (select user_id from decisions where label = 0)", "decisions", BLOCKS))
def legit_blocked(spark, folder):
    return E.legit_users_blocked(T.decisions(spark, folder), _blocks(spark, folder))


@query("e10_flag_metrics", sql(f"""select tp, fp, fn, tn, {RATES_SQL} from (select count(*) filter (det and label = 1) as tp, count(*) filter (det and label = 0) as fp,
  count(*) filter (not det and label = 1) as fn, count(*) filter (not det and label = 0) as tn from (select *, action in ('FLAG', 'BLOCK', 'REJECTED') as det from enforced))""", "enforced"))
def flag_metrics(spark, folder):
    return E.confusion(T.enforced(spark, folder), detected=E.is_detected(), keys=()).select("tp", "fp", "fn", "tn", *_rates())


# ---------------------------------------------------------------- calibration and drift
# Both sides bin values of six decimals, so that equal values fall into one bin whatever their last bit is.
FLONG = " union all ".join(f"select event_id, label, '{f}' as feature, {r6_of(f)} as value from feat" for f in FEATURES)


def _rounded(spark, folder):
    return T.features(spark, folder).withColumns({f: r6(f) for f in FEATURES})


@query("m7_calibration", sql(f"""select event_id, {r6_of('least(greatest((below / n - 0.95) / 0.05, 0.0), 1.0)')} as score_anomaly
from (select event_id, (select count(*) from feat l where l.label = 0 and l.burst_score < f.burst_score) as below, (select count(*) from feat where label = 0)::double as n from feat f)""", "feat"))
def calibration(spark, folder):
    rows = T.features(spark, folder).select("event_id", "label", "burst_score")
    return D.calibrate(rows, rows.filter("label = 0"), "burst_score").select("event_id", r6("score_anomaly"))


@query("m8_baseline", sql(f"select feature, {r6_of('median(value)')} as typical from fl where label = 0 group by 1", "feat", f"fl as ({FLONG})"))
def baseline(spark, folder):
    return D.legit_baseline(_rounded(spark, folder)).select("feature", r6("typical"))


QUANT = ", ".join(f"quantile_cont(value, {i / 10})" for i in range(1, 10))
DRIFT = f"""
base as (select min(ts_us) as t0, max(ts_us) as t1 from feat),
ref as (select * from feat where ts_us >= (select t0 from base) + 600000000 and ts_us < (select t0 from base) + 1500000000),
live as (select * from feat where ts_us > (select t1 from base) - 900000000),
fl as ({FLONG}),
edges as (select feature, list_sort(list_distinct([{QUANT}])) as edges from fl group by 1),
rl as ({FLONG.replace(' from feat', ' from ref')}), ll as ({FLONG.replace(' from feat', ' from live')}),
tb as (select feature, len([e for e in edges if e <= value]) as bin, count(*) as n from fl join edges using (feature) group by 1, 2),
rb as (select feature, len([e for e in edges if e <= value]) as bin, count(*) as n from rl join edges using (feature) group by 1, 2),
lb as (select feature, len([e for e in edges if e <= value]) as bin, count(*) as n from ll join edges using (feature) group by 1, 2)"""


def _edges(spark, folder):
    return staged(spark, "edges", (folder,), lambda: D.decile_edges(_rounded(spark, folder)))


@query("m16_bins", sql(f"select feature, bin::int as bin, {r6_of('n / (sum(n) over (partition by feature))')} as share from tb", "feat", DRIFT))
def bins(spark, folder):
    return D.bin_shares(_rounded(spark, folder), _edges(spark, folder)).select("feature", "bin", r6("share"))


def psi_sql(expected: str, actual: str) -> str:
    return f"""select feature, {r6_of('v')} as psi, case when v < 0.1 then 'stable' when v < 0.25 then 'moderate' else 'drift' end as status from (
  select feature, sum((a - e) * ln(a / e)) as v from (select feature, bin, greatest(coalesce(x.share, 0), 1e-4) as e, greatest(coalesce(y.share, 0), 1e-4) as a
    from (select *, n / (sum(n) over (partition by feature)) as share from {expected}) x
    full join (select *, n / (sum(n) over (partition by feature)) as share from {actual}) y using (feature, bin)) group by 1)"""


def _psi(spark, folder):
    rows, edges = _rounded(spark, folder), _edges(spark, folder)
    return D.psi(D.bin_shares(D.reference_window(rows), edges), D.bin_shares(D.live_window(rows), edges))


@query("m17_feature_psi", sql(psi_sql("rb", "lb"), "feat", DRIFT))
def feature_psi(spark, folder):
    return _psi(spark, folder).select("feature", r6("psi"), "status")


@query("m17_training_skew", sql(psi_sql("tb", "rb"), "feat", DRIFT))
def training_skew(spark, folder):
    rows, edges = _rounded(spark, folder), _edges(spark, folder)
    return D.psi(D.bin_shares(rows, edges), D.bin_shares(D.reference_window(rows), edges)).select("feature", r6("psi"), "status")


SCORE_BINS = STAND_INS + """,
base as (select min(ts_us) as t0, max(ts_us) as t1 from fusedx),
rs as (select * from fusedx where ts_us >= (select t0 from base) + 600000000 and ts_us < (select t0 from base) + 1500000000),
ls as (select * from fusedx where ts_us > (select t1 from base) - 900000000),
rsb as (select 'score_ml' as feature, least(floor(score_ml * 10), 9)::int as bin, count(*) as n from rs where score_ml is not null group by 2),
lsb as (select 'score_ml' as feature, least(floor(score_ml * 10), 9)::int as bin, count(*) as n from ls where score_ml is not null group by 2)"""


@query("m18_score_psi", sql(psi_sql("rsb", "lsb"), "ruled", SCORE_BINS))
def score_psi(spark, folder):
    rows = layered(spark, folder)
    return D.psi(D.score_shares(D.reference_window(rows), "score_ml"), D.score_shares(D.live_window(rows), "score_ml")).select("feature", r6("psi"), "status")


@query("m19_windows", sql("select 'reference' as side, event_id from ref union all select 'live', event_id from live", "feat", DRIFT))
def windows(spark, folder):
    rows = T.features(spark, folder)
    return D.reference_window(rows).select(F.lit("reference").alias("side"), "event_id").unionByName(
        D.live_window(rows).select(F.lit("live").alias("side"), "event_id"))


@query("m20_splits", sql(f"""select event_id, case user_n % 4 when 2 then 'val' when 3 then 'test' else 'train' end as part,
  attack_type = 'normal' or attack_type in ({', '.join(f"'{a}'" for a in SEEN_ATTACKS)}) as seen from (select *, substr(user_id, 2)::bigint as user_n from clicks)"""))
def splits(spark, folder):
    n = F.substring("user_id", 2, 20).cast("long") % 4
    part = F.when(n == 2, "val").when(n == 3, "test").otherwise("train")
    return T.clicks(spark, folder).select("event_id", part.alias("part"), F.col("attack_type").isin("normal", *SEEN_ATTACKS).alias("seen"))


@query("m14_committed_labels", sql("""select event_id, coalesce(f.label, s.staged_label) as label, case when f.label is not null then 'analyst' else 'staged' end as origin
from (select event_id, ts_us as staged_us, case when level = 'CRITICAL' then 1 else 0 end as staged_label from fusedx
  where (level = 'CRITICAL' and score_rules >= 0.9 and score_ml >= 0.9) or (level = 'LOW' and score_ml > 0 and score_ml <= 0.1 and ('0x' || substr(md5(event_id), 1, 8))::bigint % 50 = 0)) s
full join (select event_id, case event_type when 'error' then 1 else 0 end as label from clicks where event_type in ('error', 'purchase')) f using (event_id)
where f.label is not null or (select max(ts_us) from clicks) - staged_us >= 60000000""", "ruled", STAND_INS))
def committed_labels(spark, folder):
    rows = T.clicks(spark, folder)
    feedback = rows.filter(F.col("event_type").isin("error", "purchase")).select(
        "event_id", F.when(F.col("event_type") == "error", 1).otherwise(0).alias("label"))
    staged_rows = D.staged_labels(_fused(spark, folder), benign_max=0.1)
    return D.committed_labels(staged_rows, feedback, rows.agg(F.max("ts_us")).scalar())


@query("m15_page_hinkley", sql("""select campaign_id, ts_us, event_id from (select campaign_id, ts_us, event_id,
    cum - least(0.0, min(cum) over (partition by campaign_id order by ts_us, event_id)) as gap
  from (select *, sum(risk - mean - 0.01) over (partition by campaign_id order by ts_us, event_id) as cum
    from (select *, avg(risk) over (partition by campaign_id order by ts_us, event_id rows between unbounded preceding and current row) as mean from decisions)))
where gap > 5 qualify row_number() over (partition by campaign_id order by ts_us, event_id) = 1""", "decisions"))
def page_hinkley(spark, folder):
    return D.page_hinkley(T.decisions(spark, folder), "campaign_id", "risk", threshold=5.0)


RESETS = """
seq as (select campaign_id, ts_us, event_id, risk, row_number() over (partition by campaign_id order by ts_us, event_id) as i from decisions),
ph(campaign_id, i, n, mean, cum, low, hit) as (
  select campaign_id, 1::bigint, 1::bigint, risk, -0.01::double, -0.01::double, false from seq where i = 1
  union all select campaign_id, i, n, mean, case when hit then 0.0 else cum end, case when hit then 0.0 else low end, hit from (
    select *, cum - low > 10 as hit from (select *, least(low0, cum) as low from (
      select p.campaign_id, s.i, case when p.hit then 1 else p.n + 1 end as n, case when p.hit then s.risk else p.mean + (s.risk - p.mean) / (p.n + 1) end as mean,
        p.cum + s.risk - (case when p.hit then s.risk else p.mean + (s.risk - p.mean) / (p.n + 1) end) - 0.01 as cum, p.low as low0
      from ph p join seq s on s.campaign_id = p.campaign_id and s.i = p.i + 1))))"""


@query("m15_page_hinkley_resets", sql("select s.campaign_id, s.ts_us, s.event_id from ph join seq s using (campaign_id, i) where hit", "decisions", RESETS))
def page_hinkley_resets(spark, folder):
    return D.page_hinkley_resets(T.decisions(spark, folder), "campaign_id", "risk", threshold=10.0)


@query("q29_metric_alerts", sql(f"""select alert, {r6_of('value')} as value, firing from (
  select 'high_latency' as alert, p95 as value, p95 > 500 as firing from (select latency_ms as p95 from lats where rn = floor(0.95 * n) + 1)
  union all select 'model_drift', m, m > 0.25 from (select max(psi) as m from ({psi_sql('rb', 'lb')}))
  union all select 'flagged_ratio', flagged / total_events, false from snap)""", "enforced", SNAPSHOT.strip() + ",\n" + DRIFT.strip()))
def metric_alerts(spark, folder):
    worst = _psi(spark, folder).agg(F.max(r6("psi"))).scalar()
    return Q.metric_alerts(Q.snapshot(T.enforced(spark, folder)), worst).select("alert", r6("value"), "firing")


# ---------------------------------------------------------------- external log
XSQL = f"with {EXTERNAL.strip()}"


def _external(spark, folder):
    return staged(spark, "external", (folder,), lambda: C.external_from_events(C.events_table(spark, folder)))


@query("k1_group_counts", f"""{XSQL} select event_id, count(*) over (partition by ip) as ip_count, count(*) over (partition by ip, app) as ip_app_count,
  count(*) over (partition by ip, device, os) as ip_dev_os_count, count(*) over (partition by ip, channel) as ip_channel_count from external""")
def group_counts(spark, folder):
    return K.group_counts(_external(spark, folder)).select("event_id", *K.GROUPS)


@query("k2_previous_gaps", f"""{XSQL} select event_id, {r6_of("least(coalesce((click_us - lag(click_us) over (partition by ip order by click_us, event_id)) / 1e6, 3600), 3600)")} as prev_gap_ip,
  {r6_of("least(coalesce((click_us - lag(click_us) over (partition by ip, device, os order by click_us, event_id)) / 1e6, 3600), 3600)")} as prev_gap_ipdevos from external""")
def previous_gaps(spark, folder):
    return K.previous_gaps(_external(spark, folder)).select("event_id", r6("prev_gap_ip"), r6("prev_gap_ipdevos"))


PRIOR = """row_number() over (partition by ip order by click_us, event_id) - 1 as ip_clicks_prior,
  (sum(fresh) over (partition by ip order by click_us, event_id))::bigint as ip_unique_channels_prior"""
FRESH = "(select *, case when row_number() over (partition by ip, channel order by click_us, event_id) = 1 then 1 else 0 end as fresh from external)"


@query("k3_prior_clicks", f"{XSQL} select event_id, row_number() over (partition by ip order by click_us, event_id) - 1 as ip_clicks_prior from external")
def prior_clicks(spark, folder):
    return K.prior_counts(_external(spark, folder)).select("event_id", "ip_clicks_prior")


@query("k4_prior_channels", f"{XSQL} select event_id, ip_unique_channels_prior from (select *, {PRIOR} from {FRESH})")
def prior_channels(spark, folder):
    return K.prior_counts(_external(spark, folder)).select("event_id", "ip_unique_channels_prior")


@query("k5_hour_and_ids", f"{XSQL} select event_id, app, device, os, channel, hour(make_timestamp(click_us))::int as hour from external")
def hour_and_ids(spark, folder):
    return K.with_hour(_external(spark, folder)).select("event_id", "app", "device", "os", "channel", "hour")


@query("k6_temporal_split", f"""{XSQL} select event_id, case when row_number() over (order by click_us, event_id) <= floor(0.7 * count(*) over ()) then 'train' else 'test' end as part from external""")
def temporal_split(spark, folder):
    parts = K.temporal_split(_external(spark, folder))
    return parts.select("event_id", "part")
