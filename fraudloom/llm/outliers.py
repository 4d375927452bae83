"""Quality rules for reasons: text statistics, fixed rules, and robust multivariate outliers per language and source.

Only DataFrame functions. Statistics of a text are computed inside its row; the covariance of each (``lang``, ``source``) group is a
minimum-covariance-determinant estimate found by concentration steps over the table of statistics. ``source`` is the event's
source; ``lang`` is not among the engine's records and is brought by the caller.
"""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fraudloom.llm.common import pack, unpack
from fraudloom.session import materialize

WHITE = r"[\x20\x09-\x0D]"
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: Smallest standard deviation of each transformed statistic, so that a statistic most texts share exactly keeps a scale.
FLOORS = {"x_length": 0.02, "x_symbols": 0.05, "x_lines": 0.08, "x_repeats": 0.08}
DIMS = list(FLOORS)


def chi2_quantile(p: float, d: int) -> float:
    """Wilson and Hilferty's approximation."""
    return d * (1 - 2 / (9 * d) + NormalDist().inv_cdf(p) * (2 / (9 * d)) ** 0.5) ** 3


def text_counts(records: DataFrame, window: int = 8) -> DataFrame:
    """The columns of ``COUNTS`` and ``n_lines`` (lines with a word) in place of ``reason``. Nothing is shuffled."""
    has_word = lambda line: line.rlike(f"[^{WHITE[1:]}")
    out = records.withColumn("_text", F.coalesce("reason", F.lit(""))).drop("reason")
    out = out.withColumn("_words", F.filter(F.split("_text", WHITE + "+"), lambda w: w != ""))
    out = out.withColumn("_hash", F.transform("_words", lambda w: F.xxhash64(w)))
    out = out.withColumn("_lines", F.filter(F.split("_text", "\n"), has_word))
    last = F.size("_hash") - window  # position of the last window
    # Windows are named by 64-bit hashes of their words' hashes, compared within one text only.
    names = F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*[F.col("_hash")[i + k] for k in range(window)]))
    out = out.withColumn("_windows", F.when(last >= 1, names))
    out = out.withColumn("_again", F.when(F.size(F.array_distinct("_windows")) < F.size("_windows"),
                                          F.array_sort(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    at = F.col("_again")
    twin = lambda x, i: F.when((F.get(at, i - 1)["h"] == x["h"]) | (F.get(at, i + 1)["h"] == x["h"]), x["i"])
    out = out.withColumn("_starts", F.array_sort(F.filter(F.transform("_again", twin), lambda i: i.isNotNull())))
    out = out.withColumn("_covered", F.transform("_starts", lambda s, i: F.least(F.lit(window), F.coalesce(F.get("_starts", i + 1) - s, F.lit(window)))))
    counts = {"n_words": F.size("_words"), "word_chars": F.length(F.array_join("_words", "")), "n_symbols": F.regexp_count("_text", F.lit("[#*$%&|<>]")),
              "n_dup_lines": F.size("_lines") - F.size(F.array_distinct("_lines")),
              "n_repeat_words": F.coalesce(F.aggregate("_covered", F.lit(0), lambda a, x: a + x), F.lit(0)), "n_lines": F.size("_lines")}
    return out.withColumns({k: v.cast("long") for k, v in counts.items()}).drop("_text", "_words", "_hash", "_lines", "_windows", "_again", "_starts", "_covered")


def _bin_quantile(rows: DataFrame, groups: list[str], value: Column, share: float, width: float, name: str) -> DataFrame:
    """Per group the first bin of ``width`` at which the running count reaches ``share`` of the rows.

    Rows are counted per bin before any shuffle and only bins are ordered, so a group of any size is a few thousand rows.
    """
    bins = rows.groupBy(*groups, F.floor(value / width).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*groups)
    running = bins.withColumn("upto", F.sum("n").over(w.orderBy("bin"))).withColumn("all", F.sum("n").over(w))
    return running.filter(F.col("upto") >= share * F.col("all")).groupBy(*groups).agg(F.min("bin").alias(name))


def _distance(rows: DataFrame, shape: DataFrame) -> DataFrame:
    """Squared Mahalanobis distance ``d2`` of rows to their group's ``m_*`` under the Cholesky factor ``l_*``."""
    out = rows.join(shape, "group", "left")
    for i, x in enumerate(DIMS):
        rest = sum((F.col(f"l_{i}_{k}") * F.col(f"z_{k}") for k in range(i)), F.lit(0.0))
        out = out.withColumn(f"z_{i}", (F.col(x) - F.col(f"m_{i}") - rest) / F.col(f"l_{i}_{i}"))
    return out.withColumn("d2", sum((F.col(f"z_{i}") * F.col(f"z_{i}") for i in range(len(DIMS))), F.lit(0.0))).select(*rows.columns, "d2")


def _shape(subset: DataFrame) -> DataFrame:
    """Mean and Cholesky factor of the covariance of each group, with the floors added to the diagonal."""
    d = len(DIMS)
    sums = [F.avg(x).alias(f"m_{i}") for i, x in enumerate(DIMS)]
    products = [F.avg(F.col(DIMS[i]) * F.col(DIMS[j])).alias(f"p_{i}_{j}") for i in range(d) for j in range(i + 1)]
    out = subset.groupBy("group").agg(*sums, *products)
    for j in range(d):
        for i in range(j, d):
            c = F.col(f"p_{i}_{j}") - F.col(f"m_{i}") * F.col(f"m_{j}")
            if i == j:
                c = F.greatest(c, F.lit(0.0)) + FLOORS[DIMS[i]] ** 2
            rest = sum((F.col(f"l_{i}_{k}") * F.col(f"l_{j}_{k}") for k in range(j)), F.lit(0.0))
            value = F.sqrt(F.greatest(c - rest, F.lit(FLOORS[DIMS[i]] ** 2))) if i == j else (c - rest) / F.col(f"l_{j}_{j}")
            out = out.withColumn(f"l_{i}_{j}", value)
    return out.select("group", *[f"m_{i}" for i in range(d)], *[f"l_{i}_{j}" for i in range(d) for j in range(i + 1)])


def _falls(old: DataFrame, new: DataFrame) -> float:
    """Largest fall of a group's log determinant between two estimates: one number on the driver."""
    det = lambda shape, name: shape.select("group", sum((F.log(F.col(f"l_{i}_{i}")) for i in range(len(DIMS))), F.lit(0.0)).alias(name))
    return old.transform(lambda s: det(s, "a")).join(det(new, "b"), "group").agg(F.max(2 * (F.col("a") - F.col("b")))).first()[0] or 0.0


def quality_verdict(records: DataFrame, most_steps: int = 20, core: float = 0.75, confidence: float = 1 - 1e-6, least_rows: int = 50) -> DataFrame:
    """Text statistics, base rules and the outlier verdict of every record.

    ``records``: ``event_id``, ``reason``, ``lang``, ``source``; further columns pass through, ``reason`` does not. Adds the
    columns of ``COUNTS``, ``base_failed`` (under 20 words, or over 30 % of words in windows of 8 words that occur again),
    ``distance`` (squared, scaled so that a group's median is that of the chi-square law) and ``kept``.

    A record that passes the base rules is kept if its distance is within the chi-square quantile ``confidence``. Statistics are
    the shrunken logarithm of the word length and square roots of the shares of symbols, repeated lines and repeated words. The
    estimate starts from medians and median absolute deviations and takes concentration steps on the ``core`` share of a group's
    passing records that are nearest (records in one bin of distance stay together) until no group's determinant falls by more than
    a hundredth, ``most_steps`` at most. A record is judged against the nearest level with ``least_rows`` passing records: its source in its
    language, its language, or all records; if even these are fewer, against all of them.

    Null or empty text has no words and fails the base rules. Null ``lang`` or ``source`` is a group of its own. Repeated rows
    count as often as they occur. An empty table gives an empty result. Input columns with a result's name are replaced.
    """
    stats = text_counts(pack(records, "event_id", "reason", "lang", "source"))
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    key = F.to_json(F.struct(F.col("lang").alias("l"), F.col("source").alias("s")))
    prior = F.lit(100.0)  # words whose weight a short text borrows from a text of five letters a word
    stats = stats.withColumns({
        "base_failed": failed, "_group": key,
        "x_length": F.log((F.col("word_chars") + 5.0 * prior) / (F.col("n_words") + prior)),
        "x_symbols": F.sqrt(F.col("n_symbols") / (F.col("word_chars") + 5.0 * prior)),
        "x_lines": F.sqrt(F.col("n_dup_lines") / (F.col("n_lines") + 10.0)),
        "x_repeats": F.sqrt(F.col("n_repeat_words") / (F.col("n_words") + prior))})
    levels = [key, F.to_json(F.struct(F.col("lang").alias("l"))), F.lit("all")]
    stats = materialize(stats.withColumn("_levels", F.array(*levels)).drop("_group"), "text-statistics")
    # One row a group: written, so that Spark knows its size and need not deal the records by group.
    sizes = stats.filter("not base_failed").select(F.explode("_levels").alias("group")).groupBy("group").agg(F.count(F.lit(1)).alias("_n"))
    large = materialize(sizes.filter((F.col("_n") >= least_rows) | (F.col("group") == "all")), "large-groups").select("group")
    for i in range(2):
        here = large.select(F.col("group").alias(f"_at{i}"), F.lit(True).alias(f"_has{i}"))
        stats = stats.join(here, F.col("_levels")[i] == F.col(f"_at{i}"), "left")
    stats = stats.withColumn("group", F.when(F.col("_has0"), F.col("_levels")[0]).when(F.col("_has1"), F.col("_levels")[1]).otherwise("all"))
    stats = materialize(stats.drop("_at0", "_has0", "_at1", "_has1"), "grouped-statistics")

    # A record counts at every level by which some record is judged.
    used = materialize(stats.select("group").distinct(), "used-groups")
    passing = stats.filter("not base_failed").select(F.explode("_levels").alias("group"), *DIMS).join(used, "group", "left_semi")
    stats = stats.drop("_levels")
    each = passing.select("group", F.posexplode(F.array(*DIMS)).alias("dim", "x"))
    middle = materialize(_bin_quantile(each, ["group", "dim"], F.col("x"), 0.5, 0.005, "mid"), "outlier-middle")
    spread = _bin_quantile(each.join(middle, ["group", "dim"]).withColumn("off", F.abs(F.col("x") - (F.col("mid") + 0.5) * 0.005)),
                           ["group", "dim"], F.col("off"), 0.5, 0.005, "mad")
    start = middle.join(spread, ["group", "dim"]).groupBy("group").agg(
        *[F.max(F.when(F.col("dim") == i, (F.col("mid") + 0.5) * 0.005)).alias(f"m_{i}") for i in range(len(DIMS))],
        *[F.max(F.when(F.col("dim") == i, F.greatest(1.4826 * (F.col("mad") + 0.5) * 0.005, F.lit(FLOORS[x])))).alias(f"l_{i}_{i}") for i, x in enumerate(DIMS)])
    start = start.withColumns({f"l_{i}_{j}": F.lit(0.0) for i in range(len(DIMS)) for j in range(i)})
    shape = materialize(start, "outlier-start")
    bin_width = 1 / 32
    level = F.log(F.col("d2") + 1e-9)
    for _ in range(most_steps):
        far = _distance(passing, shape)
        cut = _bin_quantile(far, ["group"], level, core, bin_width, "cut")
        cut = materialize(cut, "outlier-cut")
        before, shape = shape, materialize(_shape(far.join(cut, "group").filter(F.floor(level / bin_width) <= F.col("cut"))), "outlier-step")
        if _falls(before, shape) <= 0.01:
            break
    middle = _bin_quantile(_distance(passing, shape), ["group"], level, 0.5, bin_width, "mid")
    scale = middle.select("group", F.greatest(F.exp((F.col("mid") + 0.5) * bin_width) / chi2_quantile(0.5, len(DIMS)), F.lit(1.0)).alias("scale"))
    scale = materialize(scale, "outlier-scale")
    out = _distance(stats, shape).join(scale, "group", "left")
    out = out.withColumn("distance", F.col("d2") / F.col("scale"))
    kept = ~F.col("base_failed") & F.coalesce(F.col("distance") <= chi2_quantile(confidence, len(DIMS)), F.lit(True))
    return unpack(out.withColumn("kept", kept), records, [*COUNTS, "base_failed", "distance", "kept"], ("reason",))
