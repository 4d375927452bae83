"""Incident correlation: suspicious clicks that share entities close in time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fraudloom.config import SECOND, EngineConfig
from fraudloom.functions.scalars import subnet24
from fraudloom.operators.graph import connected_components
from fraudloom.operators.prefix import with_island
from fraudloom.session import materialize

CAMPAIGN = "campaign_attack:"
KEPT = ["event_id", "ts_us", "user_id", "device_id", "ip_mask", "campaign_id", "risk", "level", "reason_title", "rules_fired"]


def incident_keys(decisions: DataFrame, graph_key: str | None = "graph_key") -> DataFrame:
    """Suspicious decisions with ``keys``, every way a click may belong to an incident."""
    rows = decisions.filter(F.col("level").isin("HIGH", "CRITICAL"))
    keys = [F.concat(F.lit("user:"), "user_id"), F.concat(F.lit("device:"), "device_id"), F.concat(F.lit("ip:"), "ip_mask"),
            F.concat(F.lit("subnet:"), subnet24(F.col("ip_address")), F.lit(".0/24")),
            F.concat(F.lit(CAMPAIGN), "campaign_id", F.lit("|"), "attack_type")]
    if graph_key:
        keys.append(F.concat(F.lit("graph:"), graph_key))
    return rows.withColumn("keys", F.array_compact(F.array(*keys)))


def _linked(rows: DataFrame, config: EngineConfig) -> DataFrame:
    """(event_id, node): the (key, run) pairs of each event. A run has no pause longer than the key's limit."""
    long = rows.select("event_id", "ts_us", F.explode("keys").alias("key"))
    weak = F.col("key").startswith(CAMPAIGN)
    runs = (with_island(long.filter(~weak), ["key"], "ts_us", config.incident_idle_s, "start")
            .unionByName(with_island(long.filter(weak), ["key"], "ts_us", config.campaign_link_s, "start")))
    return runs.select("event_id", F.concat_ws("@", "key", "start").alias("node"))


def correlate(rows: DataFrame, config: EngineConfig) -> DataFrame:
    """Set-based incidents: events of one run of a key belong together, and so do runs that share an event.

    Only runs enter the component search, and each event contributes links from its smallest run to its others, so a run of
    any length is a single node.
    """
    nodes = materialize(_linked(rows, config), "runs")
    hub = nodes.groupBy("event_id").agg(F.min("node").alias("src"))
    links = nodes.join(hub, "event_id").select("src", F.col("node").alias("dst")).distinct()
    labels = connected_components(links)
    # A run without any other stays its own incident.
    named = hub.join(labels.withColumnRenamed("node", "src"), "src", "left")
    return rows.join(named.select("event_id", F.coalesce("component", "src").alias("incident")), "event_id")


# ---------------------------------------------------------------- roll-ups
def entity_rollup(assigned: DataFrame, blocks: DataFrame | None = None) -> DataFrame:
    """Per incident and entity: first and last activity, events, flagged events, peak risk, blocked events."""
    long = assigned.select("incident", "ts_us", "risk", F.inline(F.array(
        F.struct(F.lit("user").alias("entity_type"), F.col("user_id").alias("entity_id")),
        F.struct(F.lit("device").alias("entity_type"), F.col("device_id").alias("entity_id")),
        F.struct(F.lit("ip").alias("entity_type"), F.col("ip_mask").alias("entity_id")))))
    if blocks is None:
        long = long.withColumn("_blocked", F.lit(0))
    else:  # active blocks, addresses masked like the entities
        names = blocks.select("entity_type", "entity_id", F.lit(1).alias("_hit")).distinct()
        long = long.join(names, ["entity_type", "entity_id"], "left").withColumn("_blocked", F.coalesce("_hit", F.lit(0)))
    n = F.count(F.lit(1))
    return long.groupBy("incident", "entity_type", "entity_id").agg(
        F.min("ts_us").alias("first_us"), F.max("ts_us").alias("last_us"), n.alias("events"), n.alias("flagged"),
        F.max("risk").alias("peak_risk"), F.sum("_blocked").alias("blocked"))


def incident_counters(entities: DataFrame) -> DataFrame:
    """Counters per incident. ``entity_events_n`` adds up over entities, so a click counts once per entity."""
    kind = lambda t: F.count(F.when(F.col("entity_type") == t, 1))
    return entities.groupBy("incident").agg(
        kind("user").alias("users_n"), kind("device").alias("devices_n"), kind("ip").alias("ips_n"),
        F.sum("events").alias("entity_events_n"), F.sum("flagged").alias("flagged_n"), F.sum("blocked").alias("blocked_n"),
        F.max("peak_risk").alias("peak_risk"), F.sum(F.when(F.col("entity_type") == "user", F.col("events"))).alias("events_n"),
        F.min("first_us").alias("first_us"), F.max("last_us").alias("last_us"))


def incident_campaigns(assigned: DataFrame) -> DataFrame:
    """Sorted campaigns per incident; pairs are made distinct before they are gathered."""
    pairs = assigned.select("incident", "campaign_id").distinct()
    return pairs.groupBy("incident").agg(F.array_sort(F.collect_list("campaign_id")).alias("campaigns"))


def with_live_status(incidents: DataFrame, as_of: Column, idle_s: int = 300) -> DataFrame:
    """Open incidents without activity for ``idle_s`` read as closed, with their idle time."""
    idle = (as_of - F.col("last_us")) / F.lit(float(SECOND))
    return incidents.withColumn("status", F.when(idle > idle_s, "closed").otherwise("open")).withColumn(
        "idle_s", F.when(F.col("status") == "closed", F.round(idle, 1)))


def with_summary(incidents: DataFrame) -> DataFrame:
    text = F.concat(F.col("entity_events_n").cast("string"), F.lit(" suspicious clicks from "), F.col("users_n").cast("string"),
                    F.lit(" account(s) across "), F.col("devices_n").cast("string"), F.lit(" device(s) on "),
                    F.coalesce(F.nullif(F.array_join("campaigns", ", "), F.lit("")), F.lit("no campaign")),
                    F.lit("; peak risk "), F.format_string("%.2f", "peak_risk"))
    return incidents.withColumn("summary", text)


def build_incidents(assigned: DataFrame, config: EngineConfig, blocks: DataFrame | None = None) -> DataFrame:
    """Incident rows: counters, campaigns, title, waste and summary."""
    first = F.struct("ts_us", "event_id")
    heads = assigned.groupBy("incident").agg(F.min_by(F.struct("reason_title", "campaign_id"), first).alias("h"))
    prices = F.create_map(*[F.lit(x) for kv in config.cpc.items() for x in kv])
    cpc = F.coalesce(F.try_element_at(prices, F.col("campaign_id")), F.lit(config.default_cpc))
    waste = assigned.groupBy("incident").agg(F.round(F.sum(cpc), 2).alias("wasted_spend"))
    rows = incident_counters(entity_rollup(assigned, blocks)).join(incident_campaigns(assigned), "incident").join(heads, "incident")
    rows = rows.join(waste, "incident").withColumn("classification", F.concat(F.col("h.reason_title"), F.lit(" on "), F.col("h.campaign_id")))
    return with_summary(rows.drop("h"))


def top_parts(assigned: DataFrame, reasons: int = 5, rules: int = 8) -> DataFrame:
    """Most frequent reasons and rules per incident as rows (incident, kind, name, n)."""
    said = assigned.select("incident", F.lit("reason").alias("kind"), F.col("reason_title").alias("name"))
    fired = assigned.select("incident", F.lit("rule").alias("kind"), F.explode("rules_fired").alias("name"))
    counts = said.unionByName(fired).groupBy("incident", "kind", "name").agg(F.count(F.lit(1)).alias("n"))
    rank = F.row_number().over(Window.partitionBy("incident", "kind").orderBy(F.desc("n"), "name"))
    keep = F.when(F.col("kind") == "reason", reasons).otherwise(rules)
    return counts.withColumn("_r", rank).filter(F.col("_r") <= keep).drop("_r")


def level_counts(assigned: DataFrame) -> DataFrame:
    return assigned.groupBy("incident", "level").agg(F.count(F.lit(1)).alias("n"))


def newest_incidents(incidents: DataFrame) -> DataFrame:
    """All incidents, newest first; how many to list is up to the caller."""
    return incidents.orderBy(F.desc("last_us"), "incident")


def entity_preview(entities: DataFrame, n: int = 6) -> DataFrame:
    """The ``n`` leading entities of each incident as ``type:id``."""
    order = [F.desc("flagged"), F.desc("events"), F.asc("entity_type"), F.asc("entity_id")]
    ranked = entities.withColumn("_r", F.row_number().over(Window.partitionBy("incident").orderBy(*order))).filter(F.col("_r") <= n)
    names = F.sort_array(F.collect_list(F.struct("_r", F.concat_ws(":", "entity_type", "entity_id").alias("name"))))
    return ranked.groupBy("incident").agg(F.transform(names, lambda x: x["name"]).alias("entities"))
