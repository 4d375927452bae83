"""Event-time behaviour features per user, device, address and campaign.

Counts and distinct counts are running sums of small +1/-1 steps, so the cost does not depend on how many events a window
holds, and a key of any size is spread over time buckets. See ``operators.prefix``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fraudloom.config import FEATURES, INTERVAL_EDGES, SECOND, EngineConfig
from fraudloom.functions.scalars import is_bot_agent
from fraudloom.operators.prefix import islands, never_null, parts_for, running_steps, running_totals, sliding_deltas, time_bucket

USER, DEVICE, IP = range(3)
MEASURES = [f"m{i}" for i in range(1, 8)]
# Entity kind -> (feature, measure) pairs; the measures are shared between kinds to keep the rows narrow.
OUTPUTS = {
    USER: {"clicks_10s": "m1", "clicks_1m": "m2", "clicks_5m": "m3", "clicks_1h": "m4",
           "unique_ads_1h": "m5", "geo_user_countries": "m6", "_top_ad": "m7"},
    DEVICE: {"device_clicks_1m": "m1", "unique_users_per_device": "m2", "unique_ips_per_device": "m3"},
    IP: {"ip_clicks_1m": "m1", "unique_devices_per_ip": "m2", "unique_users_per_ip": "m3", "geo_ip_countries": "m4"},
}
# (kind, key column, counted column, measure)
DISTINCTS = [
    (USER, "user_id", "ad_id", "m5"), (USER, "user_id", "country", "m6"),
    (DEVICE, "device_id", "user_id", "m2"), (DEVICE, "device_id", "ip_address", "m3"),
    (IP, "ip_address", "device_id", "m2"), (IP, "ip_address", "user_id", "m3"), (IP, "ip_address", "country", "m4"),
]


# (kind, seconds after the event or None for the event itself, change per measure)
COUNT_STEPS = [
    (USER, None, {"m1": 1, "m2": 1, "m3": 1, "m4": 1}), (USER, 10, {"m1": -1}), (USER, 60, {"m2": -1}),
    (USER, 300, {"m3": -1}), (USER, 3600, {"m4": -1}),
    (DEVICE, None, {"m1": 1}), (DEVICE, 60, {"m1": -1}), (IP, None, {"m1": 1}), (IP, 60, {"m1": -1}),
]

#: Step rows a click makes in the sweep, mostly, and narrow rows a click with its features weighs in a sort.
STEP_ROWS, WIDE = 13, 8


def _pick(code: Column, values: list) -> Column:
    """Value for a small integer code: a constant array keeps the generated code short, unlike a CASE per column."""
    return F.lit(values[0]) if len(set(values)) == 1 else F.get(F.array(*[F.lit(v) for v in values]), code)


def _count_steps(clicks: DataFrame, wanted: Column) -> DataFrame:
    """Rows that open and close every counting window of a click; only those of ``wanted`` clicks carry the event they describe."""
    code = F.col("code")
    kinds = [k for k, _, _ in COUNT_STEPS]
    kind = _pick(code, kinds)
    key = F.get(F.array("user_id", "device_id", "ip_address"), kind)
    at_event = _pick(code, [after is None for _, after, _ in COUNT_STEPS])
    shift = _pick(code, [0 if after is None else after * SECOND + 1 for _, after, _ in COUNT_STEPS])
    rows = clicks.select(F.when(wanted, F.col("event_id")).alias("event_id"), "ts_us", "user_id", "device_id", "ip_address",
                         F.explode(F.array(*[F.lit(i) for i in range(len(COUNT_STEPS))])).alias("code"))
    return rows.select(kind.alias("kind"), key.alias("key"), (F.col("ts_us") + shift).alias("ts_us"),
                       F.when(at_event, F.col("event_id")).alias("event_id"),
                       *[_pick(code, [change.get(m, 0) for _, _, change in COUNT_STEPS]).alias(m) for m in MEASURES])


def _distinct_steps(clicks: DataFrame, horizon_s: int) -> DataFrame:
    """+1 when a value becomes active for its key, -1 when its last sighting leaves the horizon."""
    pairs = clicks.select("ts_us", F.inline(F.array(*[
        F.struct(F.lit(i).alias("pair"), F.col(key).alias("key"), F.col(value).alias("value"))
        for i, (_, key, value, _) in enumerate(DISTINCTS)])))
    runs = islands(pairs, ["pair", "key", "value"], "ts_us", horizon_s)
    steps = runs.select("pair", "key", F.inline(F.filter(F.array(
        F.struct(F.when(F.col("opens"), F.col("first")).alias("ts_us"), F.lit(1).alias("n")),
        F.struct(F.when(F.col("ends"), F.col("last") + (horizon_s * SECOND + 1)).alias("ts_us"), F.lit(-1).alias("n"))),
        lambda s: s["ts_us"].isNotNull())))
    kind = F.element_at(F.array(*[F.lit(d[0]) for d in DISTINCTS]), F.col("pair") + 1)
    into = {m: [i for i, d in enumerate(DISTINCTS) if d[3] == m] for m in MEASURES}
    return steps.select(kind.alias("kind"), "key", "ts_us", *[
        (F.when(F.col("pair").isin(into[m]), F.col("n")).otherwise(0) if into[m] else F.lit(0)).alias(m)
        for m in MEASURES])


def top_count_steps(clicks: DataFrame, key: str, value: str, width_s: int, bucket_s: int, parts: int | None = None) -> DataFrame:
    """(key, ts, n) steps whose running sum is the count of the key's most frequent value in the window.

    The largest count equals the number of levels k >= 1 that at least one value has reached. Each event lifts one value
    by one level and each expiry lowers one, so levels are tracked by the same running sums as everything else.
    """
    per_value = running_totals(sliding_deltas(clicks, [key, value], "ts_us", width_s * SECOND, F.lit(1).cast("long")),
                               [key, value], "ts_us", ["n"], time_bucket("ts_us", bucket_s), parts=parts)
    before, after = F.col("n") - F.col("n_step"), F.col("n")
    moves = (per_value.filter("n_step <> 0")
             .select(key, "ts_us", F.signum("n_step").cast("long").alias("n"),
                     F.explode(F.sequence(F.least(before, after) + 1, F.greatest(before, after))).alias("level")))
    holders = running_totals(moves, [key, "level"], "ts_us", ["n"], time_bucket("ts_us", bucket_s), parts=parts)
    was, now = F.col("n") - F.col("n_step") > 0, F.col("n") > 0
    return (holders.filter(was != now)
            .select(F.col(key).alias("key"), "ts_us", F.when(now, 1).otherwise(-1).alias("n")))


def window_counts(clicks: DataFrame, config: EngineConfig, size: int, wanted: Column) -> DataFrame:
    """event_id of ``wanted`` clicks plus every count and distinct-count feature, from one sweep over all entity kinds; ``size``: number of clicks."""
    spark = clicks.sparkSession
    top = top_count_steps(clicks, "user_id", "ad_id", 300, config.bucket_s, parts_for(spark, 2 * size)).select(
        F.lit(USER).alias("kind"), "key", "ts_us",
        *[(F.col("n") if m == "m7" else F.lit(0)).alias(m) for m in MEASURES])
    steps = (_count_steps(clicks, wanted).unionByName(_distinct_steps(clicks, config.horizon_s), allowMissingColumns=True)
             .unionByName(top, allowMissingColumns=True))
    found = running_steps(steps, ["kind", "key"], "ts_us", MEASURES, time_bucket("ts_us", config.bucket_s),
                          keep=F.col("event_id").isNotNull(), parts=parts_for(spark, STEP_ROWS * size))
    return found.repartition(parts_for(spark, WIDE * size), "event_id").groupBy("event_id").agg(*[
        F.max(F.when(F.col("kind") == kind, F.col(m))).alias(name)
        for kind, outs in OUTPUTS.items() for name, m in outs.items()])


def campaign_counts(clicks: DataFrame, width_s: int = 300) -> DataFrame:
    """(campaign_id, ts_us, _campaign_5m, _all_5m) at every instant of a campaign's clicks.

    Clicks of one instant are added up first, campaigns are then added up to the whole, and both sums run over pieces cut from the
    data: neither a campaign nor the whole log is ever one task.
    """
    at = never_null(clicks.select("campaign_id", "ts_us"), ["campaign_id"]).groupBy("campaign_id", "ts_us").agg(F.count(F.lit(1)).alias("c"))
    mine = running_totals(sliding_deltas(at, ["campaign_id"], "ts_us", width_s * SECOND, F.col("c")), ["campaign_id"], "ts_us", ["n"])
    whole = at.groupBy("ts_us").agg(F.sum("c").alias("c")).withColumn("all", F.lit(0))
    whole = running_totals(sliding_deltas(whole, ["all"], "ts_us", width_s * SECOND, F.col("c")), ["all"], "ts_us", ["n"])
    return (at.join(mine.select("campaign_id", "ts_us", F.col("n").alias("_campaign_5m")), ["campaign_id", "ts_us"])
            .join(whole.select("ts_us", F.col("n").alias("_all_5m")), "ts_us").drop("c"))


def recent_times(clicks: DataFrame, config: EngineConfig, last: int = 21, parts: int | None = None, wanted: Column | None = None) -> DataFrame:
    """event_id and ``recent``: the user's last 21 click times inside the horizon, oldest first, of the ``wanted`` clicks or all.

    Inside a (user, bucket) piece this is a short ROWS frame; the 20 times before the piece come from the tails of the
    20 preceding non-empty buckets. With ``parts``, clicks are dealt by (user, bucket) once, into so many partitions.
    """
    keep = last - 1
    wanted = F.lit(True) if wanted is None else wanted
    rows = clicks.select("event_id", "user_id", "ts_us", wanted.alias("_wanted")).withColumn("_b", time_bucket("ts_us", config.bucket_s))
    rows = rows.repartition(parts, "user_id", "_b") if parts else rows
    inside = Window.partitionBy("user_id", "_b").orderBy("ts_us", "event_id")
    local = rows.withColumn("recent", F.collect_list("ts_us").over(inside.rowsBetween(-keep, 0))).filter("_wanted")
    tails = (rows.withColumn("_rank", F.row_number().over(Window.partitionBy("user_id", "_b").orderBy(
                 F.desc("ts_us"), F.desc("event_id")))).filter(F.col("_rank") <= keep)
             .groupBy("user_id", "_b").agg(F.sort_array(F.collect_list("ts_us")).alias("tail")))
    earlier = Window.partitionBy("user_id").orderBy("_b").rowsBetween(-keep, -1)
    carry = tails.select("user_id", "_b", F.flatten(F.collect_list("tail").over(earlier)).alias("_before"))
    joined = local.join(carry, ["user_id", "_b"])
    both = F.concat("_before", "recent")
    tail = F.slice(both, F.greatest(F.size(both) - keep, F.lit(1)), last)
    horizon = F.col("ts_us") - config.horizon_s * SECOND
    return (joined.withColumn("recent", tail)
            .select("event_id", F.filter("recent", lambda t: t >= horizon).alias("recent")))


def gaps(times: Column) -> Column:
    """Seconds between neighbouring times."""
    pairs = F.arrays_zip(F.slice(times, 1, F.greatest(F.size(times) - 1, F.lit(0))).alias("a"),
                         F.slice(times, 2, F.greatest(F.size(times) - 1, F.lit(0))).alias("b"))
    return F.transform(pairs, lambda p: (p["b"] - p["a"]) / F.lit(1e6))


def _fold(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def _bin_weight(gap: Column) -> Column:
    bins = F.when(gap <= float(INTERVAL_EDGES[0]), F.lit(1).cast("long"))
    for i, edge in enumerate(INTERVAL_EDGES[1:-1], 1):
        bins = bins.when(gap <= float(edge), F.lit(1 << 5 * i).cast("long"))
    return bins.otherwise(F.lit(0).cast("long"))


def packed_bins(gap: Column) -> Column:
    """Histogram of at most 31 gaps: five bits of one long for each bin but the last two, so that one pass over the gaps fills all."""
    return F.aggregate(gap, F.lit(0).cast("long"), lambda acc, x: acc + _bin_weight(x))


def gaps_beyond(gap: Column) -> Column:
    """Number of gaps in the last bin, mostly none."""
    last = float(INTERVAL_EDGES[-1])
    return F.when(F.array_max(gap) > last, F.size(F.filter(gap, lambda x: x > last))).otherwise(0)


def entropy(gap: Column, bins: Column, beyond: Column) -> Column:
    """Shannon entropy in bits of the gap histogram (``packed_bins`` and ``gaps_beyond``); 2.5 when fewer than four gaps are known."""
    n = F.size(gap)
    counts = [F.shiftright(bins, 5 * i).bitwiseAND(F.lit(31).cast("long")) for i in range(len(INTERVAL_EDGES) - 1)]
    rest = n - sum(counts[1:], counts[0])
    total = F.lit(0.0)
    for c in [*counts, rest - beyond, beyond]:
        total = total + F.when(c > 0, c / n * F.log2(c / n)).otherwise(0.0)
    return F.when(n < 4, 2.5).when(n >= 4, F.lit(0.0) - total)


def timing_features(recent: DataFrame) -> DataFrame:
    """event_id plus the gap statistics of the recent click times."""
    n = F.size("gap")
    base = recent.select("event_id", gaps(F.col("recent")).alias("gap"), (
        (F.element_at("recent", -1) - F.element_at("recent", 1)) / F.lit(1e6)).alias("span"))
    base = base.withColumns({"avg_interval": F.when(n == 0, 300.0).otherwise(F.col("span") / n), "_bins": packed_bins(F.col("gap")),
                             "_beyond": gaps_beyond(F.col("gap"))})
    # zip_with keeps the mean an argument; referred to inside a lambda it would be recomputed per element.
    spread = _fold(F.zip_with("gap", F.array_repeat("avg_interval", n), lambda x, m: (x - m) * (x - m)))
    base = base.withColumn("interval_std", F.when(n == 0, 50.0).otherwise(F.sqrt(spread / n)))
    return base.select(
        "event_id", "avg_interval", F.coalesce(F.array_min("gap"), F.lit(300.0)).alias("min_interval"), "interval_std",
        F.when((F.col("avg_interval") > 0) & (n >= 3), F.col("interval_std") / F.col("avg_interval"))
        .otherwise(1.0).alias("interval_cv"), entropy(F.col("gap"), F.col("_bins"), F.col("_beyond")).alias("timing_entropy"))


def compute_features(clicks: DataFrame, config: EngineConfig | None = None, only: str | None = None) -> DataFrame:
    """Clicks with the 23 features as doubles. ``event_id`` must be unique (see ``sources.clicks.deduplicate``).

    With ``only``, a boolean column, just the clicks it marks are described, and the column goes; the others count as what came before.
    """
    config = config or EngineConfig()
    wanted = F.lit(True) if only is None else F.col(only)
    narrow = clicks.select("event_id", "ts_us", "user_id", "ad_id", "campaign_id", "device_id", "ip_address", "country", *([only] if only else []))
    size = clicks.count()
    parts = parts_for(clicks.sparkSession, WIDE * size)
    counts = window_counts(narrow, config, size, wanted)
    timing = timing_features(recent_times(narrow, config, parts=parts, wanted=wanted))
    shares = campaign_counts(narrow).withColumnsRenamed({"campaign_id": "_campaign", "ts_us": "_at"})
    clicks = clicks.filter(wanted).drop(only) if only else clicks
    wide = clicks.join(shares, (F.coalesce("campaign_id", F.lit("")) == F.col("_campaign")) & (F.col("ts_us") == F.col("_at")))
    wide = wide.repartition(parts, "event_id").join(counts, "event_id").join(timing, "event_id")
    derived = {
        "burst_score": F.col("clicks_10s") / (F.lit(1.0) + F.col("clicks_5m") / F.lit(30.0)),
        "repeat_ad_ratio": F.when(F.col("clicks_5m") >= 3, F.col("_top_ad") / F.col("clicks_5m")).otherwise(0.0),
        "campaign_click_share_5m": F.col("_campaign_5m") / F.greatest(F.col("_all_5m"), F.lit(1)),
        "ua_bot_flag": is_bot_agent(F.col("user_agent"), config.bot_tokens),
    }
    return wide.select(*clicks.columns, *[
        derived.get(f, F.col(f)).cast("double").alias(f) for f in FEATURES if f not in clicks.columns])


def feature_columns(table: DataFrame) -> list[Column]:
    return [F.col(f) for f in FEATURES]


def vectorize(table: DataFrame, out: str = "vector") -> DataFrame:
    """Dense vector of the features in their fixed order."""
    from pyspark.ml.feature import VectorAssembler
    return VectorAssembler(inputCols=FEATURES, outputCol=out).transform(table)


def click_history(clicks: DataFrame, key: str = "user_id", last: int = 30) -> DataFrame:
    """The ``last`` newest clicks of each key, ranked 1 (newest) upwards.

    A row limit on ``row_number`` is applied per input partition before the shuffle, so a hot key ships few rows.
    """
    newest = Window.partitionBy(key).orderBy(F.desc("ts_us"), F.desc("event_id"))
    return (clicks.withColumn("rank", F.row_number().over(newest)).filter(F.col("rank") <= last)
            .select(key, "rank", "event_id", "ts_us", "ad_id", "device_id", "country"))


def latest_per_user(table: DataFrame, columns: list[str]) -> DataFrame:
    """Newest row of each user; a plain aggregate, combined before the shuffle."""
    order = F.struct("ts_us", "event_id")
    return (table.groupBy("user_id").agg(F.max_by(F.struct(*columns), order).alias("row"))
            .select("user_id", *[F.col("row")[c].alias(c) for c in columns if c != "user_id"]))


def active_users(clicks: DataFrame, as_of: Column, window_s: int = 60) -> DataFrame:
    """Users with a click in the last ``window_s`` seconds of ``as_of``."""
    return (clicks.filter((F.col("ts_us") >= as_of - window_s * SECOND) & (F.col("ts_us") <= as_of))
            .agg(F.count_distinct("user_id").alias("active_users")))


def clicks_per_window(clicks: DataFrame, window_s: int = 60) -> DataFrame:
    """Click counter per user and fixed window."""
    return (clicks.groupBy("user_id", (time_bucket("ts_us", window_s) * window_s).alias("window_s"))
            .agg(F.count(F.lit(1)).alias("clicks")))


def user_timing_features(events: DataFrame, config: EngineConfig | None = None) -> DataFrame:
    """Counts, gap statistics and burst score per event from (event_id, user_id, ts_us) alone."""
    config = config or EngineConfig()
    widths = {"clicks_10s": 10, "clicks_1m": 60, "clicks_5m": 300, "clicks_1h": 3600}
    one = F.lit(1).cast("long")
    steps = [F.struct(F.col("event_id").alias("event_id"), F.col("ts_us").alias("ts_us"), *[one.alias(n) for n in widths])]
    for name, width in widths.items():
        steps.append(F.struct(F.lit(None).cast("string").alias("event_id"), (F.col("ts_us") + width * SECOND + 1).alias("ts_us"),
                              *[(-one if n == name else one * 0).alias(n) for n in widths]))
    moves = events.select("user_id", F.inline(F.array(*steps)))
    counts = running_steps(moves, ["user_id"], "ts_us", list(widths), time_bucket("ts_us", config.bucket_s),
                           keep=F.col("event_id").isNotNull())
    counts = counts.select("event_id", "user_id", *[F.col(n).cast("double").alias(n) for n in widths])
    timing = timing_features(recent_times(events, config))
    return counts.join(timing, "event_id").withColumn(
        "burst_score", F.col("clicks_10s") / (F.lit(1.0) + F.col("clicks_5m") / F.lit(30.0)))
