"""Named patterns: built-in conditions, classification, and analyst signatures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fraudloom.config import FEATURES, PATTERN_LABELS

MIN_CONDITIONS = 2
CONDITION_SCHEMA = ("pattern_id bigint, name string, min_match int, enabled boolean, "
                    "conditions array<struct<field:string,op:string,value:double>>")


def _or_default(feature: str, default: float) -> Column:
    """A missing or zero value counts as the default."""
    c = F.col(feature)
    return F.when(c.isNull() | (c == 0), F.lit(float(default))).otherwise(c)


def builtin_conditions() -> dict[str, Column]:
    z = lambda f: F.coalesce(F.col(f), F.lit(0.0))
    tight = _or_default("min_interval", 9)
    return {
        "click_velocity": (z("clicks_1m") >= 25) | (z("clicks_10s") >= 10),
        "tight_interval": (tight >= 0) & (tight < 0.35),
        "interval_regularity": (_or_default("interval_cv", 1) < 0.3) & (z("clicks_1m") >= 5),
        "bot_agent": z("ua_bot_flag") != 0,
        "device_farm": z("unique_users_per_device") >= 3,
        "ip_fanin": z("unique_devices_per_ip") >= 4,
        "geo_spread": _or_default("geo_user_countries", 1) >= 2,
        "repeat_ad": (z("repeat_ad_ratio") >= 0.8) & (z("clicks_5m") >= 8),
        "new_account": _or_default("account_age_days", 999) <= 1,
        "graph_cluster": (F.coalesce("graph_users", F.lit(0)) >= 5) | (F.coalesce("graph_devices", F.lit(0)) >= 5),
        "blocked_entity": F.coalesce("is_blocked", F.lit(False)),
    }


def classify(table: DataFrame) -> DataFrame:
    """Add ``conditions`` (keys that hold) and ``classification`` (first three labels, or unclassified)."""
    conditions = builtin_conditions()
    hits = F.array_compact(F.array(*[F.when(cond, F.lit(key)) for key, cond in conditions.items()]))
    labels = F.array_compact(F.array(*[F.when(cond, F.lit(PATTERN_LABELS[key].lower())) for key, cond in conditions.items()]))
    label = F.when(F.size(labels) >= MIN_CONDITIONS, F.array_join(F.slice(labels, 1, 3), ", ")).otherwise("unclassified")
    return table.withColumns({"conditions": hits, "classification": label})


def _holds(value: Column, op: Column, limit: Column) -> Column:
    return (F.when(op == ">=", value >= limit).when(op == "<=", value <= limit).when(op == ">", value > limit)
            .when(op == "<", value < limit).when(op == "==", value == limit).otherwise(False))


def match_signatures(table: DataFrame, patterns: DataFrame) -> DataFrame:
    """Add ``pattern_ids`` and ``pattern_names`` of the enabled signatures that hold, ordered by name.

    The pattern library is small by contract (200 patterns of 20 conditions), so it enters as one array from a scalar
    subquery and every row is decided locally, without any shuffle.
    """
    need = F.greatest(F.coalesce("min_match", F.size("conditions")), F.lit(MIN_CONDITIONS))
    rows = patterns.filter("enabled").select("name", "pattern_id", need.alias("need"), "conditions")
    library = rows.agg(F.array_sort(F.collect_list(F.struct("name", "pattern_id", "need", "conditions")))).scalar()
    values = F.create_map(*[x for f in FEATURES for x in (F.lit(f), F.col(f))])
    table = table.withColumns({"_values": values, "_library": library})
    met = lambda p: F.size(F.filter(p["conditions"], lambda c: F.coalesce(
        _holds(F.col("_values")[c["field"]], c["op"], c["value"]), F.lit(False))))
    hits = F.filter("_library", lambda p: met(p) >= p["need"])
    table = table.withColumn("_hits", hits)
    return table.withColumns({"pattern_ids": F.transform("_hits", lambda p: p["pattern_id"]),
                              "pattern_names": F.transform("_hits", lambda p: p["name"])}).drop("_values", "_library", "_hits")


def label_suspicious(decisions: DataFrame, patterns: DataFrame) -> DataFrame:
    """Append the first two matching pattern names to the title of HIGH and CRITICAL decisions."""
    matched = match_signatures(decisions.filter(F.col("level").isin("HIGH", "CRITICAL")), patterns)
    names = F.array_join(F.slice("pattern_names", 1, 2), ", ")
    return matched.withColumn("reason_title", F.when(F.size("pattern_names") > 0, F.concat(
        "reason_title", F.lit(" ("), names, F.lit(")"))).otherwise(F.col("reason_title")))


def pattern_hits(matched: DataFrame) -> DataFrame:
    """Hit log: one row per decision and pattern, with device and incident kept apart."""
    return matched.select(F.explode("pattern_ids").alias("pattern_id"), "ts_us", "event_id", "user_id", "device_id")


def hit_counts(hits: DataFrame, since_us: int = 0) -> DataFrame:
    return (hits.filter(F.col("ts_us") >= since_us).groupBy("pattern_id")
            .agg(F.count(F.lit(1)).alias("hits"), F.max("ts_us").alias("last_us")))


def preview(decisions: DataFrame, pattern: DataFrame, examples: int = 10) -> DataFrame:
    """Dry run of a signature over all suspicious decisions: checked, matches and the newest matching events."""
    checked = match_signatures(decisions.filter(F.col("level").isin("CRITICAL", "HIGH")), pattern)
    hit = F.size("pattern_ids") > 0
    newest = checked.filter(hit).orderBy(F.desc("ts_us"), F.desc("event_id")).limit(examples)
    ids = F.sort_array(F.collect_list(F.struct("ts_us", "event_id")), asc=False)  # of at most ``examples`` rows
    return checked.agg(F.count(F.lit(1)).alias("checked"), F.count(F.when(hit, 1)).alias("matches")).select(
        "*", newest.agg(F.array_join(F.transform(ids, lambda e: e["event_id"]), ",")).scalar().alias("examples"))
