"""Blocks, alerts and the blocklist, all on event time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fraudloom.config import SECOND, EngineConfig
from fraudloom.operators.prefix import sliding_count, throttle, time_bucket
from fraudloom.operators.reasons import reason_detail
from fraudloom.session import materialize


def auto_blocks(decisions: DataFrame, config: EngineConfig) -> DataFrame:
    """First time a user reaches ``block_min_hits`` CRITICAL decisions inside the window, with the device of that click."""
    critical = decisions.filter("level = 'CRITICAL'").select("event_id", "ts_us", "user_id", "device_id", "campaign_id", "risk")
    counted = sliding_count(critical, ["user_id"], "ts_us", config.block_window_s, "hits")
    order = F.struct("ts_us", "event_id")
    first = counted.filter(F.col("hits") >= config.block_min_hits).groupBy("user_id").agg(
        F.min_by(F.struct("ts_us", "event_id", "device_id", "campaign_id", "risk"), order).alias("r"))
    return first.select("user_id", F.col("r.ts_us").alias("block_us"), "r.event_id", "r.device_id", "r.campaign_id", "r.risk")


def block_records(blocks: DataFrame, decisions: DataFrame) -> DataFrame:
    """Blocklist rows of the auto-blocks with why: a one-line reason and the full detail of the decision that led to them."""
    detail = decisions.select("event_id", "rules_fired", reason_detail().alias("reason_detail"))
    why = F.format_string("auto: risk %.2f (%s)", F.col("risk"), F.when(F.size("rules_fired") > 0, F.array_join("rules_fired", ", ")).otherwise("ml/graph/anomaly"))
    rows = blocks.join(detail, "event_id").withColumn("why", why)
    return rows.select(F.inline(F.array(
        F.struct(F.lit("user").alias("entity_type"), F.col("user_id").alias("entity_id")),
        F.struct(F.lit("device").alias("entity_type"), F.col("device_id").alias("entity_id")))),
        F.col("block_us").alias("ts_us"), F.col("why").alias("reason"), "reason_detail")


def block_events(blocks: DataFrame) -> DataFrame:
    """Blocklist changes of the auto-blocks: the user and, with it, the device."""
    return blocks.select(F.inline(F.array(
        F.struct(F.lit("user").alias("entity_type"), F.col("user_id").alias("entity_id")),
        F.struct(F.lit("device").alias("entity_type"), F.col("device_id").alias("entity_id")))),
        F.col("block_us").alias("ts_us"), F.lit(True).alias("active"), F.col("user_id").alias("linked_user"))


def cluster_alerts(blocks: DataFrame, config: EngineConfig, earlier: DataFrame | None = None, last: DataFrame | None = None) -> DataFrame:
    """Campaigns under attack: enough blocks inside the window, then silence for the same time.

    A stream goes on where it stopped: ``earlier`` has blocks that count but no longer alert, ``last`` (campaign_id, ts_us) the latest
    alert of each campaign.
    """
    rows = blocks.select("campaign_id", F.col("block_us").alias("ts_us"), F.lit(True).alias("_new"))
    if earlier is not None:
        rows = rows.unionByName(earlier.select("campaign_id", F.col("block_us").alias("ts_us"), F.lit(False).alias("_new")))
    counted = sliding_count(rows, ["campaign_id"], "ts_us", config.cluster_window_s, "blocks")
    gap = config.cluster_window_s * SECOND + 1
    enough = counted.filter((F.col("blocks") >= config.cluster_blocks) & F.col("_new"))
    if last is not None:
        enough = _after(enough, last, "campaign_id", gap)
    sizes = materialize(enough.groupBy("campaign_id", "ts_us").agg(F.max("blocks").alias("blocks")), "sizes")  # read twice
    return throttle(sizes, ["campaign_id"], "ts_us", gap).join(sizes, ["campaign_id", "ts_us"])


def _after(rows: DataFrame, last: DataFrame, key: str, gap_us: int) -> DataFrame:
    """Rows at least ``gap_us`` after their key's latest alert; every row of a key without one."""
    free = last.groupBy(key).agg((F.max("ts_us") + gap_us).alias("_free"))
    return rows.join(free, key, "left").filter("_free is null or ts_us >= _free").drop("_free")


def user_alerts(decisions: DataFrame, clusters: DataFrame, config: EngineConfig, last: DataFrame | None = None) -> DataFrame:
    """(user_id, ts_us) of HIGH/CRITICAL alerts: one per user and gap, none while the campaign's cluster alert is live.

    Cluster alerts of a campaign are more than their window apart, so a bucket of that width holds at most one, and the
    one that mutes a click lies in the click's bucket or the one before. ``last`` (user_id, ts_us): the latest alert of each user so far.
    """
    width = config.cluster_window_s
    live = clusters.select("campaign_id", F.col("ts_us").alias("from_us"), time_bucket("ts_us", width).alias("_b"))
    rows = decisions.filter(F.col("level").isin("HIGH", "CRITICAL")).select("user_id", "campaign_id", "ts_us")
    rows = rows.withColumn("_b", time_bucket("ts_us", width))
    here = live.withColumnRenamed("from_us", "here_us")
    earlier = live.select("campaign_id", F.col("from_us").alias("before_us"), (F.col("_b") + 1).alias("_b"))
    marked = rows.join(here, ["campaign_id", "_b"], "left").join(earlier, ["campaign_id", "_b"], "left")
    mutes = lambda c: F.coalesce((F.col(c) <= F.col("ts_us")) & (F.col("ts_us") < F.col(c) + width * SECOND), F.lit(False))
    heard = marked.filter(~mutes("here_us") & ~mutes("before_us"))
    if last is not None:
        heard = _after(heard, last, "user_id", config.alert_gap_s * SECOND)
    return throttle(heard, ["user_id"], "ts_us", config.alert_gap_s * SECOND)


def alert_rows(alerts: DataFrame, decisions: DataFrame) -> DataFrame:
    """Alert records: the strongest decision of the user at the alert's time."""
    best = decisions.filter(F.col("level").isin("HIGH", "CRITICAL")).groupBy("user_id", "ts_us").agg(
        F.max_by(F.struct("event_id", "campaign_id", "level", "risk", "reason", "reason_title", "event_type", reason_detail().alias("detail")),
                 F.struct("risk", "event_id")).alias("d"))
    joined = alerts.join(best, ["user_id", "ts_us"])
    return joined.select("user_id", "ts_us", "d.event_id", "d.campaign_id", F.col("d.level").alias("severity"), "d.risk", "d.reason",
                         "d.reason_title", F.col("d.detail").alias("reason_detail"), F.concat(F.lit("Suspicious activity: "), "user_id").alias("title"),
                         F.when(F.col("d.event_type") == "signup", "resolved").otherwise("open").alias("status"))


def with_incident(alerts: DataFrame, assigned: DataFrame) -> DataFrame:
    """Alerts with the ``incident_id`` their click belongs to; an event is in one incident, so no alert is multiplied."""
    home = assigned.select("event_id", F.col("incident").alias("incident_id"))
    return alerts.join(home, "event_id", "left")


def blocklist_state(changes: DataFrame) -> DataFrame:
    """Current blocklist: the latest change of each entity wins; at one instant an unblock wins."""
    return (changes.groupBy("entity_type", "entity_id")
            .agg(F.max_by("active", F.struct("ts_us", ~F.col("active"))).alias("active"), F.max("ts_us").alias("changed_us")))


def linked_unblocks(unblocks: DataFrame, blocks: DataFrame) -> DataFrame:
    """Device releases that follow a user's first unblock after a block: the devices blocked together with that user."""
    first = (unblocks.withColumnRenamed("ts_us", "unblock_us").join(blocks, "user_id").filter("block_us <= unblock_us")
             .groupBy("user_id", "device_id", "block_us").agg(F.min("unblock_us").alias("unblock_us")))
    return (first.select(F.lit("device").alias("entity_type"), F.col("device_id").alias("entity_id"), F.col("unblock_us").alias("ts_us"),
                    F.lit(False).alias("active"), F.col("user_id").alias("linked_user")))


def enforce_blocks(decisions: DataFrame, blocks: DataFrame) -> DataFrame:
    """Reject what a blocked user or device does after its block.

    One pass: features and blocks come from the unblocked log. Per micro-batch enforcement is ``streaming.scoring``.
    Both sides of the joins are unique per entity, so no row is multiplied.
    """
    users = blocks.groupBy("user_id").agg(F.min("block_us").alias("_user_us"))
    devices = blocks.groupBy("device_id").agg(F.min("block_us").alias("_device_us"))
    out = decisions.join(users, "user_id", "left").join(devices, "device_id", "left")
    late = F.coalesce(F.col("ts_us") > F.least("_user_us", "_device_us"), F.lit(False))
    return out.withColumn("is_blocked", late).drop("_user_us", "_device_us")


def incident_blocks(entities: DataFrame, active: DataFrame) -> DataFrame:
    """Entities of incidents that are not on the active blocklist yet."""
    return entities.join(active.select("entity_type", "entity_id"), ["entity_type", "entity_id"], "left_anti").select(
        "entity_type", "entity_id", "incident", F.concat(F.lit("incident "), "incident").alias("reason"), "peak_risk")


def approved_blocks(recommendations: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Users to block: recommended for it and approved by a person."""
    return (recommendations.filter("recommendation = 'block'").join(verdicts.filter("verdict = 'approve'"), "user_id")
            .select(F.lit("user").alias("entity_type"), F.col("user_id").alias("entity_id"),
                    F.concat(F.lit("approved recommendation: "), "attack_type").alias("reason"), "confidence"))
