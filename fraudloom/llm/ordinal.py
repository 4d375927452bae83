"""Quality of reasons: ordinal cumulative-link regression on graded ratings.

One weight vector over hashed text features is shared by all grades; ordered thresholds cut its score into grades:
P(grade > k) = logistic(score - threshold k).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fraudloom.llm.common import map_rows
from fraudloom.llm.features import common_only, contained


@dataclass
class GradeModel:
    weights: np.ndarray
    thresholds: np.ndarray
    cut: float

    def tails(self, texts: list[str | None]) -> np.ndarray:
        """P(grade > k) for each text and k = 0, 1, ..."""
        score = np.array([self.weights[contained(t, len(self.weights))].sum() for t in texts])
        return 1 / (1 + np.exp(-np.clip(score[:, None] - self.thresholds[None, :], -40, 40)))


def fit(bags: list[np.ndarray], grades: np.ndarray, n_grades: int, buckets: int = 1 << 18, epochs: int = 10, rate: float = 1.0, keep: float = 0.99) -> GradeModel:
    """Stochastic gradient ascent of the cumulative-link likelihood (per-weight step sizes, classes weighted alike).

    Thresholds stay ordered because each is the one before plus an exponential. Every fifth bag is left out and sets ``cut``, the
    tail probability of the top grade that ``keep`` of the left-out top-graded texts reach, at most one half.
    """
    bags = common_only(bags, buckets)
    rng = np.random.default_rng(5)
    w, seen = np.zeros(buckets), np.full(buckets, 1e-3)
    free = np.concatenate([[-1.0], np.zeros(n_grades - 2)])
    check = np.arange(len(bags)) % 5 == 4 if len(bags) >= 50 else np.zeros(len(bags), bool)
    train = np.flatnonzero(~check)
    counts = np.bincount(grades[train], minlength=n_grades)
    weight = np.sqrt(len(train) / np.maximum(1, counts) / n_grades)

    def thresholds() -> np.ndarray:
        return free[0] + np.concatenate([[0.0], np.cumsum(np.exp(free[1:]))])

    for epoch in range(epochs):
        for i in rng.permutation(train):
            at, y, t = bags[i], grades[i], thresholds()
            above = 1 / (1 + np.exp(-np.clip(w[at].sum() - t, -40, 40)))
            edge = np.concatenate([[1.0], above, [0.0]])
            slope = np.concatenate([[0.0], above * (1 - above), [0.0]])
            p = max(edge[y] - edge[y + 1], 1e-9)
            g = np.clip((slope[y] - slope[y + 1]) / p, -5, 5) * weight[y]
            seen[at] += g * g
            w[at] += rate * g / np.sqrt(seen[at] * len(at))
            d = np.zeros(n_grades - 1)  # gradient by threshold
            if y > 0:
                d[y - 1] -= slope[y] / p
            if y < n_grades - 1:
                d[y] += slope[y + 1] / p
            d = np.clip(d, -5, 5) * weight[y]
            tail = np.cumsum(d[::-1])[::-1]
            step = 0.02 / (1 + epoch)
            free[0] += step * tail[0]
            free[1:] += step * tail[1:] * np.exp(free[1:])
    model = GradeModel(w, thresholds(), 0.5)
    top = [i for i in (np.flatnonzero(check) if check.any() else train) if grades[i] == n_grades - 1]
    if top:
        p = 1 / (1 + np.exp(-np.clip(np.array([w[bags[i]].sum() for i in top]) - model.thresholds[-1], -40, 40)))
        model.cut = min(0.5, float(np.quantile(p, 1 - keep)))
    return model


def labelled_bags(records: DataFrame, labels: DataFrame, label: str, per_class: int, classes: list[int], buckets: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Feature sets of a bounded sample: at most ``per_class`` labels of each class, those with the smallest hash of the id.

    The sample is drawn from the labels alone, so no text is shuffled: its ids, a bounded number, are sent to the scan of the records.
    """
    draw = F.xxhash64("event_id", F.lit("sample"))
    known = labels.filter(F.col("event_id").isNotNull()).select("event_id", F.col(label).alias("class"))
    parts = [known.filter(F.col("class") == k).orderBy(draw, "event_id").limit(per_class) for k in classes]
    drawn = parts[0]
    for part in parts[1:]:
        drawn = drawn.unionByName(part)
    some = records.select("event_id", "reason").join(F.broadcast(drawn), "event_id")  # len(classes) * per_class ids at most
    sets = map_rows(some, ["reason"], {"at": T.BinaryType()}, lambda texts: [[contained(t, buckets).astype(np.uint32).tobytes() for t in texts]])
    # Rows that repeat an id and its text count once; a text is bounded by ``buckets``.
    once = sets.select("class", "event_id", "at").dropDuplicates()
    out = sorted((r["class"], bytes(r["at"])) for r in once.select("class", "at").collect())
    out = [out[i] for i in np.random.default_rng(3).permutation(len(out))]
    return [np.frombuffer(at, dtype=np.uint32).astype(np.int64) for _, at in out], np.array([k for k, _ in out], dtype=np.int64)


def grade_quality(records: DataFrame, ratings: DataFrame, n_grades: int = 3, per_grade: int = 2500, buckets: int = 1 << 18) -> DataFrame:
    """Expected grade and selection of every record from a sample of graded ones.

    ``records``: ``event_id``, ``reason``; ``ratings``: ``event_id``, ``grade`` (0 to ``n_grades`` - 1, at least two grades). Adds
    ``expected_grade``, ``p_top`` (probability of the top grade) and ``selected`` (``p_top`` reaches the model's cut). The model learns
    from at most ``per_grade`` ratings of each grade, and of these from the ones whose record is there; ratings with a null, outside grade or unknown id are ignored, and a record
    rated twice counts for each rating. Whole texts are scored; null or empty text is scored like any other. Without a rating
    nothing is known: ``expected_grade`` and ``p_top`` are null and every record is selected. An empty table gives an empty result;
    input columns with the result's names are replaced.
    """
    bags, grades = labelled_bags(records, ratings, "grade", per_grade, list(range(n_grades)), buckets)
    names = {"expected_grade": T.DoubleType(), "p_top": T.DoubleType(), "selected": T.BooleanType()}
    if not bags:
        return map_rows(records, ["reason"], names, lambda texts: ([None] * len(texts), [None] * len(texts), [True] * len(texts)))
    here = records.sparkSession.sparkContext.broadcast(fit(bags, grades, n_grades, buckets))  # ``buckets`` weights

    def rate(texts: list):
        tails = here.value.tails(texts)
        return tails.sum(axis=1), tails[:, -1], tails[:, -1] >= here.value.cut

    return map_rows(records, ["reason"], names, rate)
