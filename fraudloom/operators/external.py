"""Features of the public ad-click log: all causal counts and gaps, split by time for any address volume."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fraudloom.operators.prefix import previous_time, range_pieces, running_rows
from fraudloom.session import materialize

GROUPS = {"ip_count": ["ip"], "ip_app_count": ["ip", "app"], "ip_dev_os_count": ["ip", "device", "os"], "ip_channel_count": ["ip", "channel"]}
EXTERNAL_FEATURES = ["app", "device", "os", "channel", "hour", "ip_count", "ip_app_count", "ip_dev_os_count", "ip_channel_count",
                     "prev_gap_ip", "prev_gap_ipdevos", "ip_clicks_prior", "ip_unique_channels_prior"]


def group_counts(clicks: DataFrame) -> DataFrame:
    """Add the size of each group. Sizes are aggregated from the log as it came, one row per group, and joined back.

    A click without a key of a group leaves with that group's join and is not counted by the groups after it.
    """
    counted, out = clicks, clicks
    for name, keys in GROUPS.items():
        out = out.join(counted.groupBy(*keys).agg(F.count(F.lit(1)).alias(name)), keys)
        counted = counted.dropna(subset=keys)
    return out


def previous_gaps(clicks: DataFrame, limit_s: float = 3600.0) -> DataFrame:
    """Seconds since the group's preceding click, at most ``limit_s``."""
    for name, keys in (("prev_gap_ip", ["ip"]), ("prev_gap_ipdevos", ["ip", "device", "os"])):
        clicks = previous_time(clicks, keys, "click_us", ["event_id"], "_prev")
        gap = (F.col("click_us") - F.col("_prev")) / F.lit(1e6)
        clicks = clicks.withColumn(name, F.least(F.coalesce(gap, F.lit(limit_s)), F.lit(limit_s))).drop("_prev")
    return clicks


def prior_counts(clicks: DataFrame) -> DataFrame:
    """Clicks of the address before this one, and distinct channels up to and including it."""
    order = F.struct("click_us", "event_id")
    first = clicks.groupBy("ip", "channel").agg(F.min(order).alias("_first"))
    marked = clicks.join(first, ["ip", "channel"]).withColumn("_new", (order == F.col("_first")).cast("long")).drop("_first")
    out = running_rows(marked, ["ip"], "click_us", ["event_id"], {"_seen": F.lit(1).cast("long"), "ip_unique_channels_prior": F.col("_new")})
    return out.withColumn("ip_clicks_prior", F.col("_seen") - 1).drop("_seen", "_new")


def with_hour(clicks: DataFrame) -> DataFrame:
    return clicks.withColumn("hour", F.hour(F.timestamp_micros("click_us")))


def featurize(clicks: DataFrame) -> DataFrame:
    """All features. Each step reads its rows twice, so what a step makes is written before the next one."""
    rows = materialize(group_counts(with_hour(clicks)), "groups")
    rows = prior_counts(materialize(previous_gaps(rows), "gaps"))
    return rows.select("event_id", "click_us", "is_attributed", *[F.col(f).cast("double").alias(f) for f in EXTERNAL_FEATURES])


def temporal_split(rows: DataFrame, share: float = 0.7) -> DataFrame:
    """Add ``part``: the first int(share x n) rows by time, ties by event, train, the rest test.

    Rows are cut into ranges of (time, event). The sizes of the ranges tell which one holds the cut; only its rows are ranked.
    """
    pieces = range_pieces(rows, ["click_us", "event_id"])
    sizes = sorted((r["_b"], r["count"]) for r in pieces.groupBy("_b").count().collect())  # one row a piece
    train, before, crossing = int(share * sum(n for _, n in sizes)), 0, -1
    for piece, n in sizes:
        if before + n > train:
            crossing = piece
            break
        before += n
    inner = Window.partitionBy("_b").orderBy("click_us", "event_id")
    middle = pieces.filter(F.col("_b") == crossing).withColumn("part", F.when(F.row_number().over(inner) <= train - before, "train").otherwise("test"))
    rest = pieces.filter(F.col("_b") != crossing).withColumn("part", F.when((F.col("_b") < crossing) | (F.lit(crossing) < 0), "train").otherwise("test"))
    return rest.unionByName(middle).drop("_b")


def require_positives(parts: DataFrame, least: int = 2) -> None:
    """Refuse a split with too few positive labels on a side."""
    for row in parts.groupBy("part").agg(F.sum("is_attributed").alias("n")).collect():  # two rows
        if row["n"] < least:
            raise ValueError("too few positive labels for a split; use a larger sample")
