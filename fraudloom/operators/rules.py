"""Rule layer: which limits a click breaks, and the strongest of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fraudloom.config import EngineConfig

OVERRIDE_COLUMNS = ["name", "value"]


def rule_conditions(limits: dict, blocked: Column) -> dict[str, Column]:
    """Condition of each rule. ``limits`` values may be numbers or columns."""
    lim = {k: v if isinstance(v, Column) else F.lit(v) for k, v in limits.items()}
    c = F.col
    return {
        "high_click_velocity": c("clicks_1m") > lim["max_clicks_per_min"],
        "tiny_interval": (c("min_interval") < lim["min_interval_s"]) & (c("clicks_1m") >= lim["min_interval_clicks"]),
        "bot_user_agent": c("ua_bot_flag") > 0,
        "blocked_ip": blocked,
        "impossible_geo": (c("geo_user_countries") > 1) & (c("clicks_1h") >= 3),
        "device_sharing": c("unique_users_per_device") > lim["max_users_per_device"],
        "ip_device_fanin": c("unique_devices_per_ip") > lim["max_devices_per_ip"],
        "repeat_ad": (c("repeat_ad_ratio") > lim["repeat_ad_ratio"]) & (c("clicks_5m") >= lim["repeat_ad_min_clicks"]),
    }


def evaluate_rules(table: DataFrame, config: EngineConfig | None = None, blocked: Column | None = None,
                   limits: dict | None = None, weights: dict | None = None) -> DataFrame:
    """Add ``rule_score``, ``rules_fired`` (sorted names) and ``rule_hard``."""
    config = config or EngineConfig()
    if blocked is None:
        blocked = F.col("ip_address").isin(*config.blocked_ips) if config.blocked_ips else F.lit(False)
    conditions = rule_conditions(limits or config.rule_limits, blocked)
    weights = {k: v if isinstance(v, Column) else F.lit(float(v)) for k, v in (weights or config.rule_weights).items()}
    fired = F.array_compact(F.array(*[F.when(conditions[n], F.lit(n)) for n in sorted(conditions)]))
    hits = [F.when(cond, weights[n]).otherwise(F.lit(0.0)) for n, cond in conditions.items()]
    return (table.withColumns({"rule_score": F.greatest(*hits), "rules_fired": fired})
            .withColumn("rule_hard", F.col("rule_score") >= 1.0))


def overridden(defaults: dict, table: DataFrame) -> dict[str, Column]:
    """Settings from a (name, value) table over the defaults, as scalar subqueries: edits need no code change."""
    chosen = table.agg(F.map_from_entries(F.collect_list(F.struct(*OVERRIDE_COLUMNS)))).scalar()
    return {k: F.coalesce(F.element_at(chosen, F.lit(k)), F.lit(float(v))) for k, v in defaults.items()}


def evaluate_with_overrides(table: DataFrame, overrides: DataFrame, config: EngineConfig | None = None) -> DataFrame:
    """Rules under an override table. It holds at most one row per setting: it is filtered to the known names."""
    config = config or EngineConfig()
    known = overrides.filter(F.col("name").isin(*config.rule_limits, *config.rule_weights))
    latest = known.groupBy("name").agg(F.max("value").cast("double").alias("value"))
    return evaluate_rules(table, config, limits=overridden(config.rule_limits, latest),
                          weights=overridden(config.rule_weights, latest))
