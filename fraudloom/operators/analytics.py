"""Analyst views over scored decisions. All aggregates combine before the shuffle; lists end in a top-k."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fraudloom.config import LEVEL_RANK, SECOND, TIMELINES, EngineConfig
from fraudloom.functions.scalars import device_type, flagged_sum
from fraudloom.operators.prefix import bucket_start, running_totals


def rows_n() -> Column:
    return F.count(F.lit(1))


def flagged_n() -> Column:
    return flagged_sum(F.col("action")).alias("flagged")


def mean_risk() -> Column:
    """Mean of the four-digit risk, summed as integers so that the order of the rows cannot show."""
    return F.sum(F.round(F.col("risk") * 10000).cast("long")) / rows_n() / F.lit(10000.0)


def three_digits(x: Column) -> Column:
    return F.floor(x * 1000 + 0.5) / F.lit(1000.0)


def levels_from(min_level: str) -> list[str]:
    return [name for name, rank in LEVEL_RANK.items() if rank >= LEVEL_RANK[min_level]]


def filter_events(table: DataFrame, level: str | None = None, user_id: str | None = None, campaign_id: str | None = None,
                  country: str | None = None, source: str | None = None, run_id: str | None = None, q: str | None = None,
                  since_us: int | None = None, before_us: int | None = None, min_risk: float | None = None,
                  min_level: str | None = None) -> DataFrame:
    """Only the filters that are set are added, so each reaches the scan."""
    exact = {"level": level, "user_id": user_id, "campaign_id": campaign_id, "country": country, "source": source, "run_id": run_id}
    for column, value in exact.items():
        if value is not None:
            table = table.filter(F.col(column) == value)
    if since_us is not None:
        table = table.filter(F.col("ts_us") >= since_us)
    if before_us is not None:
        table = table.filter(F.col("ts_us") < before_us)
    if min_risk is not None:
        table = table.filter(F.col("risk") >= min_risk)
    if min_level is not None:
        table = table.filter(F.col("level").isin(levels_from(min_level)))
    if q:
        hit = F.lit(False)
        for column in ("ad_id", "device_id", "reason_title", "user_id"):
            hit = hit | F.col(column).contains(q)
        table = table.filter(hit)
    return table


def newest(table: DataFrame, limit: int = 100) -> DataFrame:
    return table.orderBy(F.desc("ts_us"), F.desc("event_id")).limit(limit)


def search_everything(table: DataFrame, q: str, limit: int = 20, incidents: DataFrame | None = None, alerts: DataFrame | None = None) -> DataFrame:
    """Matches among users, campaigns, ads, devices and, where given, incidents and alerts as one long table."""
    users = F.count_distinct("user_id").cast("string")
    none = F.lit(None).cast("string")
    parts = []
    for kind, column, detail in (("user", "user_id", F.max("country")), ("campaign", "campaign_id", F.max(none)),
                                 ("ad", "ad_id", F.max(none)), ("device", "device_id", users)):
        hits = table.filter(F.col(column).contains(q)).groupBy(F.col(column).alias("id")).agg(
            rows_n().alias("n"), F.max("ts_us").alias("last_us"), detail.alias("detail"))
        parts.append(hits.orderBy(F.desc("n"), "id").limit(limit).select(F.lit(kind).alias("kind"), "id", "n", "last_us", "detail"))
    if incidents is not None:
        hits = incidents.filter(F.col("incident").contains(q)).select(F.lit("incident").alias("kind"), F.col("incident").alias("id"),
                                                                      F.col("entity_events_n").cast("long").alias("n"), "last_us", none.alias("detail"))
        parts.append(hits.orderBy(F.desc("last_us"), "id").limit(limit))
    if alerts is not None:
        hits = alerts.filter(F.col("title").contains(q)).select(F.lit("alert").alias("kind"), F.col("event_id").alias("id"),
                                                                F.lit(1).cast("long").alias("n"), F.col("ts_us").alias("last_us"), F.col("severity").alias("detail"))
        parts.append(hits.orderBy(F.desc("last_us"), "id").limit(limit))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def top_risk_users(table: DataFrame, limit: int = 10) -> DataFrame:
    users = table.groupBy("user_id").agg(F.max("risk").alias("max_risk"), mean_risk().alias("avg_risk"), rows_n().alias("clicks"), flagged_n())
    return users.orderBy(F.desc("max_risk"), F.desc("flagged"), "user_id").limit(limit)


def totals(table: DataFrame) -> DataFrame:
    return table.agg(rows_n().alias("n"), F.coalesce(flagged_sum(F.col("action")), F.lit(0)).alias("flagged"), F.avg("latency_ms").alias("latency_ms"))


def flagged_by(table: DataFrame, key: str | Column, limit: int | None = None, then_n: bool = False) -> DataFrame:
    """Counts and flagged counts per key, optionally only the keys with most flagged clicks."""
    column = F.col(key) if isinstance(key, str) else key
    out = table.groupBy(column.alias("k")).agg(rows_n().alias("n"), flagged_n())
    if limit is None:
        return out
    order = [F.desc("flagged"), *([F.desc("n")] if then_n else []), F.asc("k")]
    return out.orderBy(*order).limit(limit)


def timeline(table: DataFrame, window: str = "5m", now: Column | None = None) -> DataFrame:
    span, bucket = TIMELINES[window]
    if now is not None:
        table = table.filter(F.col("ts_us") >= now - span * SECOND)
    return table.groupBy(bucket_start("ts_us", bucket).alias("bucket_s")).agg(
        rows_n().alias("n"), flagged_n(), F.sum(F.when(F.col("action") == "BLOCK", 1).otherwise(0)).alias("blocked"),
        mean_risk().alias("avg_risk"), F.max("risk").alias("max_risk"))


def device_types(table: DataFrame, devices: DataFrame) -> DataFrame:
    """Counts per device type, from the agent first stored for the device."""
    kinds = devices.select("device_id", device_type(F.col("user_agent")).alias("k"))
    return table.select("device_id", "action").join(kinds, "device_id").groupBy("k").agg(rows_n().alias("n"), flagged_n())


def campaign_stats(table: DataFrame, config: EngineConfig) -> DataFrame:
    """Spend and waste per campaign. The price list is part of the configuration, so it enters as a literal map."""
    prices = F.create_map(*[F.lit(x) for kv in config.cpc.items() for x in kv])
    cpc = F.coalesce(F.try_element_at(prices, F.col("campaign_id")), F.lit(config.default_cpc))
    base = table.groupBy("campaign_id").agg(rows_n().alias("clicks"), flagged_sum(F.col("action")).alias("suspicious"),
                                            F.count_distinct("user_id").alias("users")).withColumn("cpc", cpc)
    return base.select("*", (F.col("clicks") - F.col("suspicious")).alias("valid"), F.round(F.col("clicks") * F.col("cpc"), 2).alias("spend"),
                       F.round(F.col("suspicious") * F.col("cpc"), 2).alias("wasted"),
                       (F.col("suspicious") / F.greatest("clicks", F.lit(1))).alias("fraud_rate"))


def cluster_key() -> Column:
    pick = lambda c: F.nullif(F.col(c), F.lit(""))
    return F.coalesce(pick("campaign_id"), pick("ad_id"), pick("device_id"), F.lit("unattributed"))


def criticals_n() -> Column:
    return F.sum(F.when(F.col("level") == "CRITICAL", 1).otherwise(0)).alias("criticals")


def combined_clusters(table: DataFrame, min_risk: float = 0.0, limit: int = 40) -> DataFrame:
    out = table.filter(F.col("risk") >= min_risk).groupBy(cluster_key().alias("k")).agg(
        rows_n().alias("events"), F.count_distinct("user_id").alias("users"), F.count_distinct("device_id").alias("devices"),
        F.count_distinct("ip_mask").alias("ips"), three_digits(F.max("risk")).alias("peak_risk"),
        three_digits(mean_risk()).alias("avg_risk"), criticals_n())
    return out.filter("events >= 2").orderBy(F.desc("peak_risk"), F.desc("events"), "k").limit(limit)


def combined_kinds(decisions: DataFrame, incidents: DataFrame, alerts: DataFrame, blocks: DataFrame, min_risk: float = 0.0) -> DataFrame:
    part = lambda df, kind, key: df.groupBy(key.alias("k")).agg(rows_n().alias("n")).select(F.lit(kind).alias("kind"), "k", "n")
    return (part(incidents, "incidents", F.col("status"))
            .unionByName(part(alerts.filter("status = 'open'"), "alerts", F.col("severity")))
            .unionByName(part(blocks.filter("active"), "blocked", F.col("entity_type")))
            .unionByName(part(decisions.filter(F.col("risk") >= min_risk), "classifications",
                              F.coalesce("classification", F.lit("unclassified")))))


def combined_totals(table: DataFrame, min_risk: float = 0.0) -> DataFrame:
    return table.filter(F.col("risk") >= min_risk).agg(
        rows_n().alias("decisions"), F.count_distinct("user_id").alias("users"), three_digits(F.max("risk")).alias("peak_risk"),
        three_digits(mean_risk()).alias("avg_risk"))


def combined_timeline(table: DataFrame, min_risk: float = 0.0) -> DataFrame:
    return table.filter(F.col("risk") >= min_risk).groupBy(bucket_start("ts_us", 300).alias("bucket_s")).agg(
        rows_n().alias("n"), three_digits(F.max("risk")).alias("peak_risk"))


def targeted_campaigns(table: DataFrame, limit: int = 40) -> DataFrame:
    out = table.groupBy("campaign_id").agg(rows_n().alias("clicks"), F.count_distinct("user_id").alias("users"),
                                           three_digits(F.max("risk")).alias("peak_risk"), criticals_n())
    return out.orderBy(F.desc("criticals"), F.desc("clicks"), "campaign_id").limit(limit)


def targeted_victims(table: DataFrame, limit: int = 40) -> DataFrame:
    out = table.filter("risk >= 0.4").groupBy("user_id").agg(
        F.max("country").alias("country"), rows_n().alias("clicks"), three_digits(F.max("risk")).alias("peak_risk"),
        F.count_distinct("campaign_id").alias("campaigns"), F.count_distinct("device_id").alias("devices"))
    return out.orderBy(F.desc("peak_risk"), F.desc("clicks"), "user_id").limit(limit)


def clean_campaigns(table: DataFrame, limit: int = 40) -> DataFrame:
    out = table.filter("risk < 0.4").groupBy("campaign_id").agg(rows_n().alias("clicks"), F.count_distinct("user_id").alias("users"))
    return out.orderBy(F.desc("clicks"), "campaign_id").limit(limit)


def targeted_waste(table: DataFrame) -> DataFrame:
    """Clicks of all campaigns with a critical click, and the number of all users at risk."""
    campaigns = table.groupBy("campaign_id").agg(rows_n().alias("clicks"), criticals_n())
    wasted = campaigns.filter("criticals > 0").agg(F.coalesce(F.sum("clicks"), F.lit(0)).alias("wasted_clicks"))
    at_risk = table.filter("risk >= 0.4").agg(F.count_distinct("user_id")).scalar()
    return wasted.select("wasted_clicks", at_risk.alias("at_risk_users"))


def compare_runs(table: DataFrame, runs: DataFrame) -> DataFrame:
    """Level counts, peak risk, decisions and users per run; ``runs`` lists (run_id, event_id)."""
    level = lambda name: F.count(F.when(F.col("level") == name, 1)).alias(name.lower())
    return (runs.join(table.select("event_id", "user_id", "level", "risk"), "event_id").groupBy("run_id")
            .agg(*[level(n) for n in LEVEL_RANK], F.max("risk").alias("peak_risk"), rows_n().alias("decisions"),
                 F.count_distinct("user_id").alias("users")))


def rolling_quality(table: DataFrame, bucket_s: int = 10) -> DataFrame:
    """Confusion counts per bucket with precision and recall of the bucket and up to it."""
    detected = F.col("action").isin("FLAG", "BLOCK", "REJECTED")
    fraud = F.col("label") == 1
    one = lambda cond: F.when(cond, 1).otherwise(0).cast("long")
    marks = table.filter("label is not null").select(
        bucket_start("ts_us", bucket_s).alias("bucket_s"), F.lit(0).alias("all"), one(detected & fraud).alias("tp"),
        one(detected & ~fraud).alias("fp"), one(~detected & fraud).alias("fn"), one(~detected & ~fraud).alias("tn"))
    run = running_totals(marks, ["all"], "bucket_s", ["tp", "fp", "fn", "tn"])
    share = lambda a, b: F.when(F.col(a) + F.col(b) > 0, F.col(a) / (F.col(a) + F.col(b)))
    out = run.select("bucket_s", *[F.col(f"{m}_step").alias(f"window_{m}") for m in ("tp", "fp", "fn", "tn")], "tp", "fp", "fn", "tn")
    return out.select("*", share("tp", "fp").alias("precision"), share("tp", "fn").alias("recall"),
                     share("window_tp", "window_fp").alias("window_precision"), share("window_tp", "window_fn").alias("window_recall"))


def nearest_rank(table: DataFrame, value: str, share: float) -> DataFrame:
    """One row ``q``: the sorted values' element number int(share * n), at most the last one."""
    ranked = running_totals(table.select(F.lit(0).alias("all"), value, F.lit(1).cast("long").alias("n")), ["all"], value, ["n"])
    total = table.agg(rows_n()).scalar()
    rank = F.least(total - 1, F.floor(F.lit(share) * total).cast("long"))
    return ranked.filter((F.col("n") > rank) & (F.col("n") - F.col("n_step") <= rank)).select(F.col(value).alias("q"))


def snapshot(table: DataFrame) -> DataFrame:
    """Operational figures: volumes, levels, activity and latency."""
    live = table.filter("action <> 'REJECTED'")
    end = table.agg(F.max("ts_us")).scalar()
    level = lambda name: F.count(F.when((F.col("level") == name) & (F.col("action") != "REJECTED"), 1)).alias(name.lower())
    scored = F.col("action") != "REJECTED"
    base = table.withColumn("_end", end).agg(
        F.count(F.when(scored, 1)).alias("total_events"), flagged_sum(F.col("action")).alias("flagged"),
        F.count(F.when(~scored, 1)).alias("rejected"), *[level(n) for n in LEVEL_RANK],
        F.count_distinct(F.when(F.col("ts_us") >= F.col("_end") - 60 * SECOND, F.col("user_id"))).alias("active_users"),
        F.count_distinct("campaign_id").alias("active_campaigns"), F.avg(F.when(scored, F.col("latency_ms"))).alias("latency_avg"),
        (F.count(F.when(F.col("ts_us") >= F.col("_end") - 10 * SECOND, 1)) / 10.0).alias("events_per_s"))
    return base.select("*", (F.col("flagged") / F.col("total_events")).alias("fraud_rate"),
                       nearest_rank(live, "latency_ms", 0.5).scalar().alias("latency_p50"),
                       nearest_rank(live, "latency_ms", 0.95).scalar().alias("latency_p95"))


def metric_alerts(snap: DataFrame, max_psi: Column, p95_ms: float = 500.0, psi: float = 0.25) -> DataFrame:
    """Conditions of the operational alerts that hold."""
    return snap.select(F.inline(F.array(
        F.struct(F.lit("high_latency").alias("alert"), F.col("latency_p95").alias("value"), (F.col("latency_p95") > p95_ms).alias("firing")),
        F.struct(F.lit("model_drift").alias("alert"), max_psi.alias("value"), (max_psi > psi).alias("firing")),
        F.struct(F.lit("flagged_ratio").alias("alert"), F.col("fraud_rate").alias("value"), F.lit(False).alias("firing")))))


def prune(decisions: DataFrame, now_us: Column, days: int, max_events: int) -> DataFrame:
    """Decisions kept by retention: newer than ``days`` and, above ``max_events``, newer than row max_events + 1."""
    young = decisions.filter(F.col("ts_us") >= now_us - days * 86400 * SECOND)
    ranked = running_totals(young.select(F.lit(0).alias("all"), "ts_us", F.lit(1).cast("long").alias("n")), ["all"], "ts_us", ["n"],
                            descending=True)
    edge = ranked.filter(F.col("n") > max_events).agg(F.max("ts_us")).scalar()
    return young.filter(F.col("ts_us") > F.coalesce(edge, F.lit(-1)))


def keep_newest(table: DataFrame, key: str, n: int) -> DataFrame:
    """Rows of the ``n`` highest keys (the newest runs)."""
    kept = table.select(key).distinct().orderBy(F.desc(key)).limit(n)
    return table.join(kept, key, "left_semi")


def keep_unfinished(table: DataFrame, ts: str, cutoff_us: Column, open_status: str) -> DataFrame:
    """Retention for work items: old rows stay only while they are open."""
    return table.filter((F.col(ts) >= cutoff_us) | (F.col("status") == open_status))


def rank_within(table: DataFrame, keys: list[str], order: list, n: int) -> DataFrame:
    return (table.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
            .filter(F.col("_rank") <= n).drop("_rank"))
