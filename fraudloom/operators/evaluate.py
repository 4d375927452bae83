"""Detection quality: confusion figures, ranking metrics, per-attack and per-actor views.

Metrics work on a long table (layer, label, score), so any number of layers is measured in one pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fraudloom.operators.prefix import quantiles, running_totals


def long_scores(table: DataFrame, layers: dict[str, str]) -> DataFrame:
    """(layer, label, score) rows of the score columns that are present on a row."""
    parts = F.array(*[F.struct(F.lit(name).alias("layer"), F.col(column).alias("score")) for name, column in layers.items()])
    return table.select("event_id", "attack_type", "label", F.inline(parts)).filter("score is not null")


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def with_rates(counts: DataFrame) -> DataFrame:
    """Precision, recall, F1, FPR and FNR from tp, fp, fn, tn; an empty denominator gives 0."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return counts.withColumns({"precision": _ratio(tp, tp + fp), "recall": _ratio(tp, tp + fn), "f1": _ratio(2 * tp, 2 * tp + fp + fn),
                               "fpr": _ratio(fp, fp + tn), "fnr": _ratio(fn, fn + tp)})


def confusion(scores: DataFrame, detected: Column | None = None, threshold: float = 0.5, keys: tuple = ("layer",)) -> DataFrame:
    hit = F.col("score") >= threshold if detected is None else detected
    fraud = F.col("label") == 1
    n = lambda cond: F.count(F.when(cond, 1))
    counts = scores.groupBy(*keys).agg(n(hit & fraud).alias("tp"), n(hit & ~fraud).alias("fp"), n(~hit & fraud).alias("fn"),
                                       n(~hit & ~fraud).alias("tn"))
    return with_rates(counts)


def ranked_scores(scores: DataFrame) -> DataFrame:
    """Per layer and distinct score, from the highest: positives and negatives at and above it."""
    marks = scores.select("layer", "score", (F.col("label") == 1).cast("long").alias("tp"), (F.col("label") != 1).cast("long").alias("fp"))
    return running_totals(marks, ["layer"], "score", ["tp", "fp"], descending=True)


def ranking_metrics(scores: DataFrame) -> DataFrame:
    """ROC-AUC (ties count half) and average precision per layer; null when a class is missing."""
    ranked = ranked_scores(scores)
    above = F.col("tp") - F.col("tp_step") / 2.0
    sums = ranked.groupBy("layer").agg(F.sum("tp_step").alias("p"), F.sum("fp_step").alias("n"), F.sum(F.col("fp_step") * above).alias("won"),
                                       F.sum(F.col("tp_step") * F.col("tp") / (F.col("tp") + F.col("fp"))).alias("ap"))
    both = (F.col("p") > 0) & (F.col("n") > 0)
    return sums.select("layer", F.when(both, F.col("won") / (F.col("p") * F.col("n"))).alias("roc_auc"),
                       F.when(both, F.col("ap") / F.col("p")).alias("pr_auc"))


def precision_recall_points(scores: DataFrame) -> DataFrame:
    totals = scores.groupBy("layer").agg(F.count(F.when(F.col("label") == 1, 1)).alias("p"))
    return ranked_scores(scores).join(totals, "layer").select(
        "layer", "score", (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"), _ratio(F.col("tp"), F.col("p")).alias("recall"))


def layer_comparison(scores: DataFrame, threshold: float = 0.5) -> DataFrame:
    return confusion(scores, threshold=threshold).join(ranking_metrics(scores), "layer")


def is_detected() -> Column:
    return F.col("action").isin("FLAG", "BLOCK", "REJECTED")


def is_stopped() -> Column:
    return F.col("action").isin("BLOCK", "REJECTED")


def per_attack(decisions: DataFrame) -> DataFrame:
    share = lambda cond: F.avg(F.when(cond, 1.0).otherwise(0.0))
    return decisions.groupBy("attack_type").agg(F.count(F.lit(1)).alias("events"), share(is_detected()).alias("flagged_rate"),
                                                share(is_stopped()).alias("blocked_rate"))


def clicks_to_first_flag(decisions: DataFrame) -> DataFrame:
    """Fraud users with the number of clicks up to their first detection (null when never detected)."""
    order = F.struct("ts_us", "event_id")
    first = decisions.groupBy("user_id").agg(F.min(F.when(is_detected() & (F.col("label") == 1), order)).alias("first"),
                                             F.max(F.when(F.col("label") == 1, F.col("attack_type"))).alias("attack"))
    fraud = first.filter("attack is not null")
    upto = decisions.join(fraud, "user_id").groupBy("user_id", "attack").agg(F.count(F.when(order <= F.col("first"), 1)).alias("n"))
    return upto.select("user_id", "attack", F.when(F.col("n") > 0, F.col("n")).alias("clicks"))


def per_actor(decisions: DataFrame) -> DataFrame:
    """Actors, detected actors, and the median clicks to the first flag per attack."""
    actors = clicks_to_first_flag(decisions)
    counts = actors.groupBy("attack").agg(F.count(F.lit(1)).alias("actors"), F.count("clicks").alias("detected"))
    found = actors.filter("clicks is not null").withColumn("clicks", F.col("clicks").cast("double"))
    middle = quantiles(found, ["attack"], "clicks", [0.5]).select("attack", F.col("q").alias("median_clicks"))
    return counts.join(middle, "attack", "left")


def recall_by_attack(scores: DataFrame, attacks: list[str], threshold: float = 0.5) -> DataFrame:
    return scores.filter(F.col("attack_type").isin(attacks)).groupBy("layer", "attack_type").agg(
        F.avg(F.when(F.col("score") >= threshold, 1.0).otherwise(0.0)).alias("recall"), F.count(F.lit(1)).alias("events"))


def legit_users_blocked(decisions: DataFrame, blocks: DataFrame) -> DataFrame:
    legit = decisions.filter("label = 0").select("user_id")
    return blocks.select("user_id").distinct().join(legit, "user_id", "left_semi").agg(F.count(F.lit(1)).alias("legit_users_blocked"))
