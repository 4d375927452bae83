"""Plain-language reasons, factor lines, and the rule-based investigation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fraudloom.config import FACTOR_TEXT, LAYER_TEXT, RULE_TEXT, EngineConfig
from fraudloom.operators.fusion import score_column


def two_decimals(x: Column) -> Column:
    """Seconds with two digits, rounded from whole microseconds."""
    h = F.call_function("div", F.round(x * 1e6).cast("long") + 5000, F.lit(10000).cast("long"))
    return F.concat(F.call_function("div", h, F.lit(100).cast("long")).cast("string"), F.lit("."),
                    F.lpad((h % 100).cast("string"), 2, "0"))


def whole(x: Column) -> Column:
    return x.cast("long").cast("string")


def _values(config: EngineConfig | None) -> dict[str, Column]:
    limits = config.rule_limits if config else {}
    over = f", well above the normal rate of {limits['max_clicks_per_min']:g} a minute" if limits else ""
    under = f", below the {limits['min_interval_s']:g} second minimum" if limits else ""
    return {
        "clicks_1m": whole(F.col("clicks_1m")), "min_interval": two_decimals(F.col("min_interval")),
        "geo_user_countries": whole(F.col("geo_user_countries")), "ua": F.col("user_agent"),
        "unique_users_per_device": whole(F.col("unique_users_per_device")),
        "unique_devices_per_ip": whole(F.col("unique_devices_per_ip")),
        "repeat_ad_ratio": F.concat(whole(F.rint(F.col("repeat_ad_ratio") * 100)), F.lit("%")),
        "ip": F.col("ip_mask"), "over_limit": F.lit(over), "under_limit": F.lit(under),
    }


def _fill(template: str, values: dict[str, Column]) -> Column:
    """Template with {names} replaced by columns, as one concat."""
    parts, rest = [], template
    while "{" in rest:
        text, _, tail = rest.partition("{")
        name, _, rest = tail.partition("}")
        parts += [F.lit(text), values[name]]
    return F.concat(*parts, F.lit(rest))


def rule_sentences(rules: Column, config: EngineConfig | None = None, values: dict[str, Column] | None = None) -> Column:
    """Array of (title, text) of the fired rules, in their order."""
    values = values or _values(config)
    # A CASE per rule: the text of a rule that did not fire is never built.
    said = [F.when(F.array_contains(rules, name), F.struct(
        F.lit(title).alias("title"), F.coalesce(_fill(text, values), F.lit(text.split("{")[0].strip())).alias("text")))
        for name, (title, text) in sorted(RULE_TEXT.items())]
    return F.array_compact(F.array(*said))


def factor_line(factor: Column) -> Column:
    """Phrase of one factor struct (feature, label, value, typical, contribution)."""
    known = F.create_map(*[F.lit(x) for kv in FACTOR_TEXT.items() for x in kv])
    label = F.coalesce(F.element_at(known, factor["feature"]), F.regexp_replace(factor["label"], "_", " "))
    value, typical = short_number(factor["value"]), short_number(factor["typical"])
    return (F.when(factor["value"].isNull(), label)
            .when(factor["contribution"].isNull(), F.concat(label, F.lit(" was "), value))
            .otherwise(F.concat(label, F.lit(" was "), value, F.lit(" (normal "), typical, F.lit(")"))))


def short_number(x: Column) -> Column:
    """Number with at most three decimals and no trailing zeros."""
    text = F.format_string("%.3f", x)
    return F.regexp_replace(F.regexp_replace(text, r"0+$", ""), r"\.$", "")


def factor_lines(factors: Column, limit: int = 3) -> Column:
    return F.transform(F.slice(factors, 1, limit), factor_line)


def rule_factors(rules: Column) -> Column:
    """Factors when no model is available: the fired rules themselves."""
    label = lambda r: F.concat(F.upper(F.substring(r, 1, 1)),
                               F.regexp_replace(F.substr(r, F.lit(2)), "_", " "))
    none = F.lit(None).cast("double")
    return F.transform(rules, lambda r: F.struct(r.alias("feature"), label(r).alias("label"), none.alias("value"),
                                                 none.alias("typical"), none.alias("contribution")))


def explanation_text(factors: Column) -> Column:
    """Up to three factors that raised the score, as one line."""
    part = lambda f: F.when(f["contribution"].isNull(), f["label"]).when(f["contribution"] > 0, F.concat(
        f["label"], F.lit(" = "), short_number(f["value"]), F.lit(" (typical "), short_number(f["typical"]),
        F.lit(") raised the score by "), F.format_string("%+.2f", f["contribution"])))
    line = F.array_join(F.array_compact(F.transform(F.slice(factors, 1, 3), part)), "; ")
    return F.when(F.coalesce(line, F.lit("")) == "", "No single dominant factor.").otherwise(line)


def fallback_sentence() -> Column:
    """(title, text) when no rule fired: the first layer at 0.6 or more, else a general phrase."""
    hits = [F.when(F.coalesce(score_column(layer), F.lit(0.0)) >= 0.6, F.struct(
        F.lit(f"Suspicious to {phrase}").alias("title"),
        F.concat(F.lit(f"{phrase} gave this click a score of "), F.format_string("%.2f", score_column(layer))).alias("text")))
        for layer, phrase in LAYER_TEXT.items()]
    lines = F.array_join(factor_lines(F.col("factors")), "; ")
    weak = F.lit("several weak signals added up to a higher-than-usual risk score")
    general = F.struct(F.lit("Unusual click pattern").alias("title"), F.when(lines == "", weak).otherwise(lines).alias("text"))
    return F.coalesce(*hits, general)


def capitalized(text: Column) -> Column:
    return F.concat(F.upper(F.substring(text, 1, 1)), F.substr(text, F.lit(2)))


def explain(table: DataFrame, config: EngineConfig | None = None) -> DataFrame:
    """Add ``reason_title`` and ``reason``. Needs score_*, rules_fired, factors, ip_mask and the features."""
    table = table.withColumn("_said", rule_sentences(F.col("rules_fired"), config))
    table = table.withColumn("_said", F.when(F.size("_said") > 0, F.col("_said")).otherwise(F.array(fallback_sentence())))
    texts = F.transform(F.slice("_said", 1, 2), lambda s: s["text"])
    extra = F.filter(F.slice(factor_lines(F.col("factors")), 1, 3), lambda x: ~F.array_contains(texts, x))
    body = F.slice(F.concat(texts, F.slice(extra, 1, 1)), 1, 2)
    return (table.withColumns({"reason_title": F.element_at("_said", 1)["title"],
                               "reason": capitalized(F.array_join(body, "; "))}).drop("_said"))


def reason_detail(blockers: Column | None = None) -> Column:
    """Everything a decision rests on, as one struct: for alerts, blocks and the analyst's detail view.

    ``blockers`` lists blocked entities that the click was also seen with. Computed from columns of the decision, so storing it once
    with an alert or a block is enough; it converts to JSON as it is.
    """
    layers = ["rules", "ml", "online", "anomaly", "graph"]
    none = F.array().cast("array<string>")
    return F.struct(
        F.col("reason_title").alias("title"), "reason", "event_id", "level", "action", "risk", F.col("rules_fired").alias("rules"),
        F.slice("factors", 1, 3).alias("factors"), F.struct(*[score_column(x).alias(x) for x in layers]).alias("scores"),
        F.coalesce(blockers, none).alias("blockers") if blockers is not None else none.alias("blockers"),
        F.struct(*[F.col(f"graph_{x}").alias(x) for x in ("users", "devices", "ips", "subnets")]).alias("graph"),
        "user_id", "device_id", "campaign_id", F.col("ts_us").alias("event_us"))


def backfill_reasons(stored: DataFrame) -> DataFrame:
    """Reasons for rows written without one, from their rules and scores alone."""
    bare = {k: F.lit(None).cast("string") for k in _values(None)}
    bare.update(over_limit=F.lit(""), under_limit=F.lit(""))
    said = rule_sentences(F.col("rules_fired"), None, bare)
    rebuilt = F.coalesce(F.try_element_at(F.transform(said, lambda s: s["text"]), F.lit(1)), fallback_sentence()["text"])
    title = F.coalesce(F.try_element_at(F.transform(said, lambda s: s["title"]), F.lit(1)), fallback_sentence()["title"])
    return stored.withColumns({"reason": F.coalesce("reason", capitalized(rebuilt)),
                               "reason_title": F.coalesce("reason_title", title)})


def attack_type() -> Column:
    """Eight-way decision list on the newest features and component profile of a user."""
    c = F.col
    return (F.when((c("graph_users") >= 10) & (c("unique_devices_per_ip") >= 6), "device farm")
            .when(c("graph_users") >= 10, "distributed click farm")
            .when((c("geo_user_countries") >= 2) | (c("unique_ips_per_device") >= 3), "IP rotation")
            .when((c("clicks_10s") >= 15) | ((c("min_interval") < 0.25) & (c("clicks_1m") >= 5)), "click burst / scripted bot")
            .when((c("ua_bot_flag") > 0) & (c("interval_cv") < 0.3), "scripted bot")
            .when(c("unique_users_per_device") >= 3, "mimicry ring (shared devices)")
            .when((c("repeat_ad_ratio") > 0.8) & (c("clicks_5m") >= 10), "low-and-slow repeat clicking")
            .otherwise("suspicious (unclassified)"))


def recommend(latest: DataFrame) -> DataFrame:
    """Recommendation per user from the newest decision row."""
    action = F.when(F.col("risk") >= 0.9, "block").when(F.col("risk") >= 0.5, "monitor").otherwise("allow")
    kind = attack_type()
    headline = F.when(F.coalesce("reason", F.lit("")) != "", F.col("reason")).otherwise(F.concat(kind, F.lit(": no strong evidence")))
    return latest.select("user_id", "event_id", kind.alias("attack_type"), (F.floor(F.col("risk") * 1000 + 0.5) / F.lit(1000.0)).alias("confidence"),
                         headline.alias("summary"), action.alias("recommendation"), "reason_title",
                         F.lit("pending").alias("status"))
