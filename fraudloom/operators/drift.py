"""Drift: bins and PSI, reference and live windows, Page-Hinkley alarms, score calibration."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from fraudloom.config import FEATURES, SECOND
from fraudloom.operators.prefix import count_below, quantiles, running_rows


def long_features(table: DataFrame, extra: tuple = ()) -> DataFrame:
    """(feature, value) rows."""
    return table.select(*extra, F.inline(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("value")) for f in FEATURES])))


def decile_edges(table: DataFrame) -> DataFrame:
    """(feature, edges): the distinct deciles of each feature, at most nine."""
    q = quantiles(long_features(table), ["feature"], "value", [i / 10 for i in range(1, 10)])
    return q.groupBy("feature").agg(F.array_sort(F.collect_set("q")).alias("edges"))


def bin_shares(table: DataFrame, edges: DataFrame) -> DataFrame:
    """(feature, bin, share) of the rows; bin = number of edges at or below the value."""
    # One row of at most nine edges per feature: 23 rows, so the broadcast is bounded.
    binned = long_features(table).join(F.broadcast(edges), "feature").select(
        "feature", F.size(F.filter("edges", lambda e: e <= F.col("value"))).alias("bin"))
    return _shares(binned, ["feature"])


def score_shares(table: DataFrame, column: str, bins: int = 10) -> DataFrame:
    """(feature, bin, share) of equal-width score bins on [0, 1], under the name of the score."""
    binned = table.filter(F.col(column).isNotNull()).select(
        F.lit(column).alias("feature"), F.least(F.floor(F.col(column) * bins), F.lit(bins - 1)).cast("int").alias("bin"))
    return _shares(binned, ["feature"])


def _shares(binned: DataFrame, keys: list[str]) -> DataFrame:
    counts = binned.groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("n"))
    sizes = counts.groupBy(*keys).agg(F.sum("n").alias("size"))
    return counts.join(sizes, keys).select(*keys, "bin", (F.col("n") / F.col("size")).alias("share"))


def psi(expected: DataFrame, actual: DataFrame, eps: float = 1e-4) -> DataFrame:
    """(feature, psi, status) between two share tables. A bin missing on both sides adds nothing."""
    both = expected.withColumnRenamed("share", "e").join(actual.withColumnRenamed("share", "a"), ["feature", "bin"], "full")
    clip = lambda c: F.greatest(F.coalesce(c, F.lit(0.0)), F.lit(eps))
    a, e = clip(F.col("a")), clip(F.col("e"))
    return both.groupBy("feature").agg(F.sum((a - e) * F.log(a / e)).alias("psi")).withColumn("status", drift_status(F.col("psi")))


def drift_status(value: Column) -> Column:
    return F.when(value < 0.1, "stable").when(value < 0.25, "moderate").otherwise("drift")


def reference_window(table: DataFrame, warmup_s: int = 600, span_s: int = 900) -> DataFrame:
    """All rows of the ``span_s`` seconds after the warm-up."""
    start = table.agg(F.min("ts_us")).scalar() + warmup_s * SECOND
    return table.filter((F.col("ts_us") >= start) & (F.col("ts_us") < start + span_s * SECOND))


def live_window(table: DataFrame, span_s: int = 900) -> DataFrame:
    """All rows of the last ``span_s`` seconds."""
    return table.filter(F.col("ts_us") > table.agg(F.max("ts_us")).scalar() - span_s * SECOND)


def calibrate(probes: DataFrame, legit: DataFrame, raw: str, out: str = "score_anomaly") -> DataFrame:
    """Map a raw score to [0, 1] by its rank among legitimate traffic: only the top five percent score above 0."""
    size = legit.agg(F.count(F.lit(1))).scalar()
    ranked = count_below(probes, legit, raw, "_below")
    share = F.col("_below") / size
    return ranked.withColumn(out, F.least(F.greatest((share - 0.95) / 0.05, F.lit(0.0)), F.lit(1.0))).drop("_below")


def legit_baseline(table: DataFrame) -> DataFrame:
    """(feature, typical): median of each feature over legitimate rows."""
    q = quantiles(long_features(table.filter("label = 0")), ["feature"], "value", [0.5])
    return q.select("feature", F.col("q").alias("typical"))


# ---------------------------------------------------------------- Page-Hinkley
def page_hinkley(rows: DataFrame, key: str, value: str, delta: float = 0.01, threshold: float = 30.0) -> DataFrame:
    """First alarm of each key on an upward shift of the mean: (key, ts_us, event_id).

    Running mean, cumulated deviation and its running minimum are running sums and minima, computed in pieces.
    """
    base = running_rows(rows.select(key, "ts_us", "event_id", F.col(value).alias("x")), [key], "ts_us", ["event_id"],
                        {"sum": F.col("x"), "n": F.lit(1).cast("long")})
    step = F.col("x") - F.col("sum") / F.col("n") - F.lit(delta)
    moved = running_rows(base.select(key, "ts_us", "event_id", step.alias("step")), [key], "ts_us", ["event_id"], {"cum": F.col("step")})
    low = running_rows(moved, [key], "ts_us", ["event_id"], {}, {"low": F.col("cum")})
    alarm = F.col("cum") - F.least("low", F.lit(0.0)) > threshold
    return (low.filter(alarm).groupBy(key).agg(F.min(F.struct("ts_us", "event_id")).alias("a"))
            .select(key, F.col("a.ts_us").alias("ts_us"), F.col("a.event_id").alias("event_id")))


class HinkleyState:
    """Detector of one key: count, mean, cumulated deviation and its minimum since the last alarm. It lives across batches of rows."""

    __slots__ = ("n", "mean", "cum", "low")

    def __init__(self) -> None:
        self.n, self.mean, self.cum, self.low = 0, 0.0, 0.0, 0.0

    def alarms(self, values: list[float], delta: float, threshold: float) -> list[int]:
        """Places in ``values`` where the detector raises an alarm and starts afresh."""
        n, mean, cum, low, out = self.n, self.mean, self.cum, self.low, []
        for i, x in enumerate(values):
            n += 1
            mean += (x - mean) / n
            cum += x - mean - delta
            if cum < low:
                low = cum
            elif cum - low > threshold:
                out.append(i)
                n, mean, cum, low = 0, 0.0, 0.0, 0.0
        self.n, self.mean, self.cum, self.low = n, mean, cum, low
        return out


HINKLEY_STATE = "n long, mean double, cum double, low double"


def hinkley_step(rows: DataFrame, key: str, value: str, state: DataFrame | None = None, delta: float = 0.01, threshold: float = 30.0) -> DataFrame:
    """Alarms of a batch of rows, and every key's detector after it.

    Result: the key, ``ts_us``, ``event_id`` (null for a detector) and the detector's ``n``, ``mean``, ``cum``, ``low`` (null for an alarm).
    ``state`` has the detectors before the batch. One pass: rows are sorted by key and time within partitions and streamed behind
    their detector, four numbers that outlive an Arrow batch. A restart forgets all before it, so a key cannot be cut; a very busy
    one is one stream of constant memory.
    """
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    given = rows.filter(F.col(value).isNotNull()).select(key, "ts_us", "event_id", F.col(value).cast("double").alias("mean"))
    given = given.select(F.lit(1).alias("kind"), key, "ts_us", "event_id", F.lit(0).cast("long").alias("n"), "mean", *[F.lit(0.0).alias(c) for c in ("cum", "low")])
    if state is not None:
        given = given.unionByName(state.select(F.lit(0).alias("kind"), key, F.lit(0).cast("long").alias("ts_us"), F.lit(None).cast(given.schema["event_id"].dataType).alias("event_id"), "n", "mean", "cum", "low"))
    dealt = given.repartition(parts, key).sortWithinPartitions(key, "kind", "ts_us", "event_id")
    schema = T.StructType([given.schema[c] for c in (key, "ts_us", "event_id")] + [T.StructField(c, T.LongType() if c == "n" else T.DoubleType()) for c in ("n", "mean", "cum", "low")])
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in schema])

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(schema)
        at, held = None, None

        def packed(out: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(list(zip(*out)) or [()] * len(arrow), arrow)], schema=arrow)

        for batch in batches:
            out: list[tuple] = []
            kind, keys, ts, ids, n, x, cum, low = (c.to_pylist() for c in batch.columns)
            edges = [i for i in range(len(keys)) if i == 0 or keys[i] != keys[i - 1]] + [len(keys)]
            for start, stop in zip(edges, edges[1:]):
                if held is None or keys[start] != at:
                    out += [(at, None, None, held.n, held.mean, held.cum, held.low)] if held else []
                    at, held = keys[start], HinkleyState()
                if kind[start] == 0:
                    held.n, held.mean, held.cum, held.low = n[start], x[start], cum[start], low[start]
                    start += 1
                out += [(at, ts[start + i], ids[start + i], None, None, None, None) for i in held.alarms(x[start:stop], delta, threshold)]
            yield packed(out)
        if held:
            yield packed([(at, None, None, held.n, held.mean, held.cum, held.low)])

    return dealt.select("kind", key, "ts_us", "event_id", "n", "mean", "cum", "low").mapInArrow(stream, schema)


def page_hinkley_resets(rows: DataFrame, key: str, value: str, delta: float = 0.01, threshold: float = 30.0) -> DataFrame:
    """Every alarm of each key, with the detector restarted after each: (key, ts_us, event_id), in one pass."""
    return hinkley_step(rows, key, value, None, delta, threshold).filter("n is null").select(key, "ts_us", "event_id")


# ---------------------------------------------------------------- training labels
def sample_bucket(event_id: Column, n: int) -> Column:
    return F.conv(F.substring(F.md5(event_id), 1, 8), 16, 10).cast("long") % n


def staged_labels(table: DataFrame, benign_max: float = 0.02, sample: int = 50) -> DataFrame:
    """Pseudo-labels where rules and model agree: fraud, or a sparse hash sample of clearly benign clicks."""
    fraud = (F.col("level") == "CRITICAL") & (F.col("score_rules") >= 0.9) & (F.col("score_ml") >= 0.9)
    benign = (F.col("level") == "LOW") & (F.col("score_ml") > 0) & (F.col("score_ml") <= benign_max) & (sample_bucket(F.col("event_id"), sample) == 0)
    return table.select("event_id", F.col("ts_us").alias("staged_us"), F.when(fraud, 1).when(benign, 0).alias("staged_label")).filter("staged_label is not null")


def committed_labels(staged: DataFrame, feedback: DataFrame, now_us: Column, delay_s: int = 60) -> DataFrame:
    """Labels to learn from: analyst feedback at once, staged ones after the delay unless an analyst decided."""
    both = staged.join(feedback, "event_id", "full")
    ready = F.col("label").isNotNull() | (now_us - F.col("staged_us") >= delay_s * SECOND)
    return both.filter(ready).select("event_id", F.coalesce("label", "staged_label").alias("label"),
                                     F.when(F.col("label").isNotNull(), "analyst").otherwise("staged").alias("origin"))
