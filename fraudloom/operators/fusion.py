"""Fusion of the layer scores into risk, level, action and confidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fraudloom.config import ACTIONS, RULE_TEXT, EngineConfig
from fraudloom.functions.scalars import mask_ip

LAYERS = ["rules", "ml", "online", "anomaly"]


def score_column(layer: str) -> Column:
    return F.col(f"score_{layer}")


def used_weight(config: EngineConfig) -> Column:
    """Total weight of the layers that gave a score."""
    total = F.lit(0.0)
    for layer in LAYERS:
        w = config.layer_weights[layer]
        total = total + F.when(score_column(layer).isNotNull(), F.lit(w)).otherwise(F.lit(0.0))
    return total


def weighted_mean(config: EngineConfig) -> Column:
    total = F.lit(0.0)
    for layer in LAYERS:
        total = total + F.coalesce(F.lit(config.layer_weights[layer]) * score_column(layer), F.lit(0.0))
    return F.when(used_weight(config) > 0, total / used_weight(config)).otherwise(0.0)


def available_layers() -> Column:
    n = F.lit(0)
    for layer in LAYERS:
        n = n + score_column(layer).isNotNull().cast("int")
    return n


def peak_lift(risk: Column) -> Column:
    """A strong rule or model signal may not be diluted by quiet layers."""
    peak = F.greatest(F.coalesce(score_column("rules"), F.lit(0.0)), F.coalesce(score_column("ml"), F.lit(0.0)))
    lifted = F.greatest(risk, F.lit(0.5) * risk + F.lit(0.5) * peak)
    return F.when((peak >= 0.95) & (available_layers() > 1), lifted).otherwise(risk)


def graph_noisy_or(risk: Column, boost: float) -> Column:
    g = score_column("graph")
    return F.when(g > 0, F.lit(1.0) - (F.lit(1.0) - risk) * (F.lit(1.0) - F.lit(boost) * g)).otherwise(risk)


def floor_and_clamp(risk: Column, hard: Column, floor: float) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.when(hard, F.greatest(risk, F.lit(floor))).otherwise(risk)))


def risk_level(risk: Column, limits: dict) -> Column:
    return (F.when(risk >= limits["CRITICAL"], "CRITICAL").when(risk >= limits["HIGH"], "HIGH")
            .when(risk >= limits["MEDIUM"], "MEDIUM").otherwise("LOW"))


def action_of(level: Column) -> Column:
    chain = F.when(level == "LOW", ACTIONS["LOW"])
    for name in ("MEDIUM", "HIGH", "CRITICAL"):
        chain = chain.when(level == name, ACTIONS[name])
    return chain


def confidence(config: EngineConfig) -> Column:
    """Share of layer weight behind the decision. A click without any layer and graph signal is LOW."""
    cover = used_weight(config) / F.lit(sum(config.layer_weights[layer] for layer in LAYERS))
    return F.when(cover >= 0.85, "HIGH").when(cover >= 0.5, "MEDIUM").otherwise("LOW")


def fuse(table: DataFrame, config: EngineConfig | None = None) -> DataFrame:
    """Add risk_raw, risk (four digits), level, action and confidence from score_* and rule_hard.

    Levels compare the unrounded risk. A null layer is left out; it is not a zero.
    """
    config = config or EngineConfig()
    table = table.withColumn("_mean", weighted_mean(config))
    table = table.withColumn("_risk", graph_noisy_or(peak_lift(F.col("_mean")), config.graph_boost))
    nothing = (used_weight(config) <= 0) & (F.coalesce(score_column("graph"), F.lit(0.0)) == 0)
    table = table.withColumn("risk_raw", F.when(nothing, 0.0).otherwise(
        floor_and_clamp(F.col("_risk"), F.col("rule_hard"), config.hard_floor)))
    table = table.withColumn("level", risk_level(F.col("risk_raw"), config.level_limits))
    return table.withColumns({"risk": F.round("risk_raw", 4), "action": action_of(F.col("level")),
                              "confidence": confidence(config)}).drop("_mean", "_risk")


def assemble_decisions(table: DataFrame, model_version: str = "none") -> DataFrame:
    """Decision rows with the nested score map and rule list."""
    scores = F.create_map(*[x for layer in [*LAYERS, "graph"] for x in (F.lit(layer), F.round(score_column(layer), 4))])
    return table.select("event_id", "ts_us", "user_id", "ad_id", "campaign_id", "device_id",
                        mask_ip(F.col("ip_address")).alias("ip_mask"), "risk", "level", "action", "confidence",
                        scores.alias("scores"), "rules_fired", F.lit(model_version).alias("model_version"),
                        "latency_ms", "label", "attack_type")


def reject_blocked(table: DataFrame, blocked: str = "is_blocked") -> DataFrame:
    """Overwrite the decision of clicks from blocked entities: no layer has a say, and the reason tells why.

    Columns of the decision that ``table`` does not have yet are added for the rejected rows (null elsewhere).
    """
    hit, (title, text) = F.col(blocked), RULE_TEXT["blocked_entity"]
    fixed = {"risk": F.lit(1.0), "level": F.lit("CRITICAL"), "action": F.lit("REJECTED"), "confidence": F.lit("HIGH"),
             "rules_fired": F.array(F.lit("blocked_entity")), "reason_title": F.lit(title), "reason": F.lit(text[0].upper() + text[1:])}
    given = {f"score_{layer}" for layer in [*LAYERS, "graph"]} & set(table.columns)
    fixed |= {c: F.lit(None).cast("double") for c in given}
    fixed |= {"risk_raw": F.lit(1.0)} if "risk_raw" in table.columns else {}
    fixed |= {"factors": F.array().cast(table.schema["factors"].dataType)} if "factors" in table.columns else {}
    return table.withColumns({c: F.when(hit, v).otherwise(F.col(c)) if c in table.columns else F.when(hit, v) for c, v in fixed.items()})
