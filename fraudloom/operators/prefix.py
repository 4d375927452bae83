"""Ordered computations that stay parallel when one key holds most of the rows.

A plain ``Window.partitionBy(key)`` sends a whole key to one task, and a moving RANGE frame costs rows x frame.
Everything here works on (key, bucket) pieces instead: rows are first aggregated to one row per distinct position
(map-side combined), pieces are processed in parallel, and what crosses a piece boundary is carried by one small row per
(key, bucket). The only window over a whole key runs on those bucket rows.

Buckets of a key's events are spans of time. Rankings of values, and counters of few keys that all rows share, have their buckets cut
from the data: quantile sketches (map-side combined) of every key give the cuts, so that a narrow range of values or a busy instant
makes no larger piece than any other.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fraudloom.config import SECOND
from fraudloom.session import materialize


#: Keys whose cuts may pass through the driver, and pieces a key is cut into at most.
FEW_KEYS, MOST_PIECES = 64, 1023
#: Narrow rows (some 200 bytes in memory) that a task sorts at most where rows are dealt by their number.
TASK_ROWS = 500_000


def time_bucket(ts: str | Column, seconds: int) -> Column:
    """Number of the ``seconds``-wide bucket a microsecond time falls in."""
    col = F.col(ts) if isinstance(ts, str) else ts
    return F.call_function("div", col, F.lit(seconds * SECOND).cast("long"))


def bucket_start(ts: str | Column, seconds: int) -> Column:
    """Start, in epoch seconds, of the bucket."""
    return time_bucket(ts, seconds) * F.lit(seconds)


def parts_for(spark: SparkSession, rows: int) -> int:
    """Partitions that hold ``rows`` rows in pieces a task sorts in memory, however few partitions the session names."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), rows // TASK_ROWS + 1)


def never_null(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Declare key columns non-null, so the two sides of a self-join keep one plan and share its shuffle."""
    empty = {"string": F.lit("")}
    types = dict(df.dtypes)
    return df.withColumns({c: F.coalesce(c, empty.get(types[c], F.lit(0).cast(types[c]))) for c in columns})


def data_cuts(rows: DataFrame, keys: Sequence[str], order: str, pieces: int | None = None) -> DataFrame:
    """(keys, ``_cuts``): ascending values that part each key's rows into ``pieces`` of about equal size.

    ``pieces`` is twice the number of shuffle partitions by default. Cuts come from sketches of bounded size; a value that fills several
    pieces repeats. Up to ``FEW_KEYS`` keys, as in all rankings here, they pass through the driver (8 kB a key at most) and are broadcast;
    more of them are joined from a written table, where Spark knows their size.
    """
    spark = rows.sparkSession
    pieces = pieces or max(8, 2 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    pieces = min(pieces, MOST_PIECES)
    shares = F.array(*[F.lit(i / pieces) for i in range(1, pieces)])
    found = rows.groupBy(*keys).agg(F.percentile_approx(order, shares, F.lit(20 * pieces)).alias("_cuts"))
    few = found.limit(FEW_KEYS + 1).collect()
    return F.broadcast(spark.createDataFrame(few, found.schema)) if len(few) <= FEW_KEYS else materialize(found, "cuts")


def piece_of(cuts: str | Column, value: str | Column) -> Column:
    """Number of cuts below a value, by binary search (null and an unknown key: 0)."""
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(MOST_PIECES.bit_length()))])
    at, of = (F.col(c) if isinstance(c, str) else c for c in (cuts, value))
    return F.aggregate(steps, F.lit(0), lambda n, step: F.when(F.get(at, n + step - 1) < of, n + step).otherwise(n)).cast("long")


def in_pieces(points: DataFrame, rows: DataFrame, keys: Sequence[str], order: str, pieces: int | None = None) -> DataFrame:
    """Add the piece ``_b`` of each point of ``order``, as cut from ``rows``."""
    cuts = data_cuts(rows, keys, order, pieces)
    return points.join(cuts, list(keys), "left").withColumn("_b", piece_of("_cuts", order)).drop("_cuts")


def range_pieces(rows: DataFrame, order: Sequence[str], pieces: int | None = None) -> DataFrame:
    """Rows in pieces ``_b`` along columns of any ordered types, ties parted by the later columns.

    Spark's range partitioning samples the cuts; the pieces are written, so that all who read them see the same ones.
    """
    pieces = pieces or max(8, 2 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return materialize(rows.repartitionByRange(pieces, *order).withColumn("_b", F.spark_partition_id().cast("long")), "pieces")


def running_totals(deltas: DataFrame, keys: Sequence[str], order: str, measures: Sequence[str],
                   bucket: Column | None = None, descending: bool = False, parts: int | None = None) -> DataFrame:
    """One row per distinct (keys, order) with inclusive running sums of ``measures``.

    The sum of the row itself is kept as ``<measure>_step``. ``bucket`` must be monotone in ``order``; without one, pieces are cut from
    the data (``data_cuts``). With ``parts``, rows are dealt by (keys, bucket) once, into so many partitions, and everything else but the
    carried sums happens where they are.
    """
    keys = list(keys)
    deltas = never_null(deltas, keys)
    if bucket is None:
        points = deltas.groupBy(*keys, order).agg(*[F.sum(m).alias(f"{m}_step") for m in measures])
        points = in_pieces(points, deltas, keys, order)
    else:
        rows = deltas.withColumn("_b", F.coalesce(bucket, F.lit(0).cast("long")))
        rows = rows.repartition(parts, *keys, "_b") if parts else rows
        points = rows.groupBy(*keys, "_b", order).agg(*[F.sum(m).alias(f"{m}_step") for m in measures])
    by = F.desc if descending else F.asc
    inside = Window.partitionBy(*keys, "_b").orderBy(by(order)).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys).orderBy(by("_b")).rowsBetween(Window.unboundedPreceding, -1)
    totals = points.groupBy(*keys, "_b").agg(*[F.sum(f"{m}_step").alias(m) for m in measures])
    carry = totals.select(*keys, "_b", *[F.coalesce(F.sum(m).over(before), F.lit(0)).alias(f"_{m}") for m in measures])
    local = points.select("*", *[F.sum(f"{m}_step").over(inside).alias(m) for m in measures])
    return (local.join(carry.hint("merge"), [*keys, "_b"])
            .select(*keys, order, *[f"{m}_step" for m in measures],
                    *[(F.col(m) + F.col(f"_{m}")).alias(m) for m in measures]))


def running_steps(steps: DataFrame, keys: Sequence[str], order: str, measures: Sequence[str], bucket: Column,
                  keep: Column | None = None, parts: int | None = None) -> DataFrame:
    """Row-level form of ``running_totals``: every row gets the running sums up to and including its peers.

    Rows are not combined by position first, which saves a shuffle when positions rarely repeat. Only rows that satisfy
    ``keep`` are returned. ``parts`` as in ``running_totals``.
    """
    keys = list(keys)
    rows = never_null(steps, keys).withColumn("_b", F.coalesce(bucket, F.lit(0).cast("long")))
    rows = rows.repartition(parts, *keys, "_b") if parts else rows
    inside = Window.partitionBy(*keys, "_b").orderBy(order).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    # Counting kept rows by their position makes the totals read every column, so that they share the shuffle of the rows.
    kept = F.coalesce(order, F.lit(0))
    kept = F.count(kept if keep is None else F.when(keep, kept))
    totals = rows.groupBy(*keys, "_b").agg(*[F.sum(m).alias(m) for m in measures], kept.alias("_kept"))
    carry = totals.select(*keys, "_b", "_kept", *[F.coalesce(F.sum(m).over(before), F.lit(0)).alias(f"_{m}") for m in measures])
    carry = carry.filter("_kept > 0").drop("_kept")
    local = rows.withColumns({m: F.sum(m).over(inside) for m in measures})
    if keep is not None:
        local = local.filter(keep)
    return (local.join(carry.hint("merge"), [*keys, "_b"])
            .withColumns({m: F.col(m) + F.col(f"_{m}") for m in measures}).drop("_b", *[f"_{m}" for m in measures]))


def sliding_deltas(df: DataFrame, keys: Sequence[str], ts: str, width_us: int, amount: Column) -> DataFrame:
    """+amount at each event and -amount just after it leaves the (closed) window."""
    return df.select(*keys, F.inline(F.array(
        F.struct(F.col(ts).alias(ts), amount.alias("n")),
        F.struct((F.col(ts) + width_us + 1).alias(ts), (-amount).alias("n")))))


def sliding_count(df: DataFrame, keys: Sequence[str], ts: str, width_s: int, out: str,
                  amount: Column | None = None, bucket_s: int = 300) -> DataFrame:
    """Add the number of rows (or sum of an integer ``amount``) of the key in the closed window [ts - width, ts]."""
    amount = F.lit(1).cast("long") if amount is None else amount.cast("long")
    sweep = running_totals(sliding_deltas(df, keys, ts, width_s * SECOND, amount), keys, ts, ["n"],
                           time_bucket(ts, bucket_s))
    return df.join(sweep.select(*keys, ts, F.col("n").alias(out)), [*keys, ts])


def running_rows(df: DataFrame, keys: Sequence[str], ts: str, order: Sequence[str], sums: dict[str, Column],
                 mins: dict[str, Column] | None = None, bucket: Column | None = None, bucket_s: int = 300) -> DataFrame:
    """Row-level running sums (and minima) per key in (ts, order) order, with unique positions."""
    keys, mins = list(keys), mins or {}
    df = df.withColumn("_b", time_bucket(ts, bucket_s) if bucket is None else bucket)
    inside = Window.partitionBy(*keys, "_b").orderBy(ts, *order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    totals = df.groupBy(*keys, "_b").agg(*[F.sum(c).alias(f"_t_{n}") for n, c in sums.items()],
                                         *[F.min(c).alias(f"_t_{n}") for n, c in mins.items()])
    carry = totals.select(*keys, "_b", *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_c_{n}") for n in sums],
                          *[F.min(f"_t_{n}").over(before).alias(f"_c_{n}") for n in mins])
    local = df.select("*", *[F.sum(c).over(inside).alias(n) for n, c in sums.items()],
                      *[F.min(c).over(inside).alias(n) for n, c in mins.items()])
    out = local.join(carry.hint("merge"), [*keys, "_b"])
    out = out.withColumns({**{n: F.col(n) + F.col(f"_c_{n}") for n in sums}, **{n: F.least(n, f"_c_{n}") for n in mins}})
    return out.drop("_b", *[f"_c_{n}" for n in [*sums, *mins]])


def previous_time(df: DataFrame, keys: Sequence[str], ts: str, order: Sequence[str], out: str,
                  bucket_s: int = 300) -> DataFrame:
    """Time of the key's preceding row (null on its first)."""
    keys = list(keys)
    df = df.withColumn("_b", time_bucket(ts, bucket_s))
    inside = Window.partitionBy(*keys, "_b").orderBy(ts, *order)
    ends = df.groupBy(*keys, "_b").agg(F.max(ts).alias("_end"))
    carry = ends.select(*keys, "_b", F.lag("_end").over(Window.partitionBy(*keys).orderBy("_b")).alias("_carried"))
    return (df.withColumn(out, F.lag(ts).over(inside)).join(carry, [*keys, "_b"])
            .withColumn(out, F.coalesce(out, "_carried")).drop("_b", "_carried"))


def islands(df: DataFrame, keys: Sequence[str], ts: str, gap_s: int = 0, gap_us: int | None = None) -> DataFrame:
    """(keys, bucket, first, last, start, opens, ends): maximal runs of events no more than the gap apart.

    Buckets are one gap wide, so events of one bucket always belong together and one row per (key, bucket) is enough.
    ``start`` is the time of the run's first event; ``opens`` and ``ends`` mark its first and last bucket.
    """
    keys, gap = list(keys), gap_s * SECOND if gap_us is None else gap_us
    spans = (df.withColumn("bucket", _gap_bucket(ts, gap)).groupBy(*keys, "bucket")
             .agg(F.min(ts).alias("first"), F.max(ts).alias("last")))
    order = Window.partitionBy(*keys).orderBy("bucket")
    opens = F.col("_prev").isNull() | (F.col("first") - F.col("_prev") > gap)
    return (spans.withColumn("_prev", F.lag("last").over(order)).withColumn("_next", F.lead("first").over(order))
            .withColumn("opens", opens)
            .withColumn("ends", F.col("_next").isNull() | (F.col("_next") - F.col("last") > gap))
            .withColumn("start", F.max(F.when(F.col("opens"), F.col("first"))).over(order))
            .drop("_prev", "_next"))


def _gap_bucket(ts: str | Column, gap_us: int) -> Column:
    col = F.col(ts) if isinstance(ts, str) else ts
    return F.call_function("div", col, F.lit(gap_us).cast("long"))


def with_island(df: DataFrame, keys: Sequence[str], ts: str, gap_s: int, out: str) -> DataFrame:
    """Add the start time of the run each event belongs to."""
    runs = islands(df, keys, ts, gap_s).select(*keys, F.col("bucket").alias("_b"), F.col("start").alias(out))
    return df.withColumn("_b", _gap_bucket(ts, gap_s * SECOND)).join(runs, [*keys, "_b"]).drop("_b")


def throttle(df: DataFrame, keys: Sequence[str], ts: str, gap_us: int) -> DataFrame:
    """(keys, ts) of the events that pass a per-key throttle: the first one, then each first one ``gap_us`` or more later.

    Greedy per key, yet no key is walked in order by one task. A pause of ``gap_us`` or more restarts the rule, so runs
    between pauses are independent; a run shorter than the gap passes only its first event. In longer runs every event
    points at the first one that may follow it, and the chain from the run's start is marked by pointer doubling: the
    number of rounds is the logarithm of the longest run over the gap.
    """
    keys = list(keys)
    points = materialize(df.select(*keys, ts).distinct(), "points")
    runs = islands(points, keys, ts, gap_us=gap_us - 1)
    bounds = runs.groupBy(*keys, "start").agg((F.max("last") - F.col("start")).alias("span"))
    passed = bounds.select(*keys, F.col("start").alias(ts))
    longest = bounds.agg(F.max("span")).first()[0] or 0
    steps = longest // gap_us
    if not steps:
        return passed
    jump = materialize(_first_after(points, keys, ts, gap_us), "jump")
    jumps = [jump]
    while 2 ** len(jumps) <= steps:
        hop = jumps[-1]
        onward = hop.select(*keys, F.col(ts).alias("next"), F.col("next").alias("far"))
        jumps.append(materialize(hop.join(onward, [*keys, "next"]).select(*keys, ts, F.col("far").alias("next")), "jump"))
    for hop in reversed(jumps):
        passed = passed.unionByName(passed.join(hop, [*keys, ts]).select(*keys, F.col("next").alias(ts)))
        passed = materialize(passed.distinct(), "passed")
    return passed


def _first_after(points: DataFrame, keys: list[str], ts: str, gap_us: int) -> DataFrame:
    """(keys, ts, next): the first point at or after ts + gap, looked up in the probe's bucket and the one after it."""
    rows = points.select(*keys, F.inline(F.array(
        F.struct(F.col(ts).alias("at"), F.col(ts).alias("point"), F.lit(None).cast("long").alias("asked")),
        F.struct((F.col(ts) + gap_us).alias("at"), F.lit(None).cast("long").alias("point"), F.col(ts).alias("asked")))))
    rows = rows.withColumn("_b", _gap_bucket("at", gap_us))
    # Backwards in time, so that the frame grows row by row; Spark computes a frame to the end anew for every row.
    onward = Window.partitionBy(*keys, "_b").orderBy(F.desc("at")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    probes = rows.withColumn("near", F.min("point").over(onward)).filter("asked is not null")
    firsts = points.groupBy(*keys, (_gap_bucket(ts, gap_us) - 1).alias("_b")).agg(F.min(ts).alias("later"))
    found = probes.join(firsts, [*keys, "_b"], "left")
    return found.select(*keys, F.col("asked").alias(ts), F.coalesce("near", "later").alias("next")).filter("next is not null")


def order_statistics(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """One row per distinct (keys, value): ``n_step`` rows have it, ``n`` rows are at or below it."""
    return running_totals(df.select(*keys, value, F.lit(1).cast("long").alias("n")), keys, value, ["n"])


def quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float]) -> DataFrame:
    """Exact linearly interpolated quantiles: rows (keys, prob, q).

    Distinct values are counted and ranked in pieces; no aggregation buffer ever holds a group's values.
    """
    keys = list(keys)
    ranked = order_statistics(df, keys, value)
    want = (df.groupBy(*keys).agg(F.count(F.lit(1)).alias("size"))
            .withColumn("wanted", F.transform(F.array(*[F.lit(float(p)) for p in probs]), lambda p: F.struct(
                p.alias("prob"), F.floor(p * (F.col("size") - 1)).cast("long").alias("low"),
                (p * (F.col("size") - 1) - F.floor(p * (F.col("size") - 1))).alias("part")))))
    hits = ranked.join(want, keys)
    covers = lambda rank: (rank < F.col("n")) & (rank >= F.col("n") - F.col("n_step"))
    near = F.filter("wanted", lambda w: covers(w["low"]) | covers(F.least(w["low"] + 1, F.col("size") - 1)))
    picked = hits.select(*keys, value, "n", "n_step", "size", F.explode(near).alias("w"))
    low = F.max(F.when(covers(F.col("w.low")), F.col(value)))
    high = F.max(F.when(covers(F.least(F.col("w.low") + 1, F.col("size") - 1)), F.col(value)))
    return (picked.groupBy(*keys, F.col("w.prob").alias("prob"), F.col("w.part").alias("part"))
            .agg(low.alias("low"), high.alias("high"))
            .select(*keys, "prob", (F.col("low") + (F.col("high") - F.col("low")) * F.col("part")).alias("q")))


def count_below(probes: DataFrame, reference: DataFrame, value: str, out: str) -> DataFrame:
    """Add to each probe how many reference values are smaller: one merged ranking instead of a range join."""
    marks = reference.select(F.lit(0).alias("all"), value, F.lit(1).cast("long").alias("n")).unionByName(
        probes.select(F.lit(0).alias("all"), value, F.lit(0).cast("long").alias("n")))
    ranked = running_totals(marks, ["all"], value, ["n"])
    return probes.join(ranked.select(value, (F.col("n") - F.col("n_step")).alias(out)), value)
