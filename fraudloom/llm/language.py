"""Language of reasons: averaged hashed subword embeddings with a linear softmax.

The engine's records carry no language of their own, so ``lang`` is a column of the labelled rows that the caller brings.
"""

from __future__ import annotations

from dataclasses import dataclass
from statistics import NormalDist

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fraudloom.llm.common import map_rows

SIZES = (2, 3, 4)
UNKNOWN = "und"
#: A text of few subwords is judged with so many usual ones, so that a rare name alone does not reject it.
SMOOTH = 20
#: Bytes of a lower-cased text: letters and bytes of other scripts stay, all else is a boundary.
_LETTER = np.array([c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256)], dtype=np.uint8)


def subwords(data: bytes, buckets: int) -> list[np.ndarray]:
    """For each subword size, the bucket of the byte n-gram that starts at each position; 0 where a boundary lies inside."""
    b = _LETTER[np.frombuffer(data, dtype=np.uint8)].astype(np.uint32)
    out, h = [], b
    inside = np.concatenate([(b[:-1] != 32) | (b[1:] != 32), np.zeros(min(1, len(b)), bool)])
    for n in range(2, max(SIZES) + 1):
        m = max(0, len(b) - n + 1)
        h = h[:m] * np.uint32(0x01000193) ^ b[n - 1:n - 1 + m]
        if n > 2:
            inside = inside[:m] & (b[n - 2:n - 2 + m] != 32)  # so a text's runs never reach into the next
        if n in SIZES:
            mixed = h * np.uint32(0x9E3779B1)
            out.append(np.where(inside[:m], (mixed >> np.uint32(8)) % np.uint32(buckets - 1) + np.uint32(1), np.uint32(0)))
    return out


def has_letter(text: str | None) -> bool:
    return any(map(str.isalpha, text or ""))


@dataclass
class LanguageModel:
    """``table``: logits that a subword adds, by bucket and language. ``heat``: temperature. ``known``: log rate of a subword in the
    language that has it most often, ``usual`` its mean over texts, ``floor`` the lowest accepted mean (``familiarity``)."""

    languages: list[str]
    table: np.ndarray
    bias: np.ndarray
    heat: float
    floor: float = -np.inf
    known: np.ndarray | None = None
    usual: float = 0.0

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, list[bool]]:
        """Language, calibrated probability and whether it is rejected, for whole texts at once."""
        n, known = len(texts), np.array([has_letter(t) for t in texts], bool) & bool(self.languages)
        if not known.any():
            return [UNKNOWN] * n, np.zeros(n), [True] * n
        pieces = [f" {t.lower()} ".encode(errors="replace") if k else b"  " for t, k in zip(texts, known)]
        starts = np.concatenate([[0], np.cumsum([len(p) for p in pieces])])[:-1]
        logits, used, told = np.zeros((n, len(self.languages))), np.zeros(n), np.zeros(n)
        for buckets in subwords(b"".join(pieces) + b"    ", len(self.table)):
            used += np.add.reduceat((buckets > 0).astype(np.float64), starts)
            if self.known is not None:
                told += np.add.reduceat(self.known[buckets], starts, dtype=np.float64)
            for i in range(len(self.languages)):
                logits[:, i] += np.add.reduceat(self.table[:, i][buckets], starts, dtype=np.float64)
        p = _softmax((logits / np.maximum(used, 1)[:, None] + self.bias) / self.heat)
        best = p.argmax(axis=1)
        score = np.where(known, p[np.arange(n), best], 0.0)
        return ([self.languages[b] if k else UNKNOWN for b, k in zip(best, known)], score, (~known | (familiarity(told, used, self.usual) < self.floor)).tolist())


def familiarity(told, used, usual: float):
    """Mean log rate of ``used`` subwords whose rates add up to ``told``, as if ``SMOOTH`` usual ones were among them."""
    return (told + SMOOTH * usual) / (used + SMOOTH)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit(bags: list[tuple[np.ndarray, np.ndarray]], labels: list[str], buckets: int = 1 << 15, dim: int = 16, epochs: int = 6,
        rate: float = 0.5, keep: float = 0.999) -> LanguageModel:
    """Stochastic gradient descent over (buckets, weights) bags; every fifth bag is left out of it and calibrates.

    The temperature minimises the log loss of the calibration bags, whose certainty is taken as (n + 1) / (n + 2). The floor is the
    ``familiarity`` that ``keep`` of the rightly predicted calibration bags reach, and no higher than a normal curve through them
    has it, as few bags do not show so rare a case. Each subword counts by the language that has it
    most often, so a text in several known languages is familiar and one in an unlearned language is not, however sure the softmax.
    """
    languages = sorted(set(labels))
    if not languages:
        return LanguageModel([], np.zeros((buckets, 0), np.float32), np.zeros(0), 1.0)
    y = np.array([languages.index(x) for x in labels])
    rng = np.random.default_rng(7)
    table = rng.normal(0, 0.1, (buckets, dim))
    head, bias = rng.normal(0, 0.1, (dim, len(languages))), np.zeros(len(languages))
    calibration = np.arange(len(bags)) % 5 == 4 if len(bags) >= 50 else np.zeros(len(bags), bool)
    train = np.flatnonzero(~calibration)
    for epoch in range(epochs):
        for i in rng.permutation(train):
            at, weight = bags[i]
            mean = weight @ table[at]
            g = _softmax(mean @ head + bias)
            g[y[i]] -= 1.0
            step = rate * (1 - epoch / epochs)
            back = head @ g
            head -= step * np.outer(mean, g)
            bias -= 0.1 * step * g
            table[at] -= step * len(at) ** 0.5 * weight[:, None] * back
    check = np.flatnonzero(calibration) if calibration.any() else train
    z = np.array([bags[i][1] @ table[bags[i][0]] @ head + bias for i in check])
    heats = np.geomspace(0.02, 5, 60)
    sure = (len(check) + 1) / (len(check) + 2)  # no sample proves certainty

    def loss(t: float) -> float:
        p = np.clip(_softmax(z / t)[np.arange(len(check)), y[check]], 1e-12, 1 - 1e-12)
        return float(-(sure * np.log(p) + (1 - sure) * np.log(1 - p)).mean())

    heat = float(min(heats, key=loss))
    p = _softmax(z / heat)
    counts = np.zeros((buckets, len(languages)))
    for i in train:
        counts[bags[i][0], y[i]] += bags[i][1]
    counts *= 1000 / np.maximum(counts.sum(axis=0), 1e-12)
    known = np.log((counts.max(axis=1) + 0.001) / 1000).astype(np.float32)
    known[0] = 0.0
    means = np.array([bags[i][1] @ known[bags[i][0]] for i in check])
    used = np.array([1 / bags[i][1].min() for i in check])  # the rarest subword of a bag is mostly there once
    usual = float(means.mean())
    right = familiarity(means * used, used, usual)[p.argmax(axis=1) == y[check]]
    floor = min(float(np.quantile(right, 1 - keep)), float(right.mean() + NormalDist().inv_cdf(1 - keep) * right.std())) if len(right) else -np.inf
    table[0] = 0.0
    return LanguageModel(languages, (table @ head).astype(np.float32), bias, heat, floor, known, usual)


def train_on(labelled: DataFrame, per_language: int = 1000, buckets: int = 1 << 15) -> LanguageModel:
    """Fit on a bounded sample: about ``per_language`` rows of each ``lang``, chosen by a hash; every value of ``lang`` is learned."""
    rows = labelled.select("event_id", "reason", "lang").filter(F.col("lang").isNotNull() & F.col("reason").isNotNull())
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row a language
    if not sizes:
        return fit([], [], buckets)
    share = F.element_at(F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, min(1.0, per_language / n))]), F.col("lang"))
    draw = F.pmod(F.xxhash64("event_id", F.lit("language")), F.lit(1 << 20)) / F.lit(float(1 << 20))
    drawn = rows.filter(draw < share)

    def bag(texts: list[str]):
        out = []
        for text in texts:
            found = np.concatenate(subwords(f" {text.lower()} ".encode(errors="replace"), buckets))
            at, count = np.unique(found[found > 0], return_counts=True)
            out.append((at.astype(np.uint32).tobytes(), (count / max(1, count.sum())).astype(np.float32).tobytes()))
        return [x[0] for x in out], [x[1] for x in out]

    bags = map_rows(drawn, ["reason"], {"at": T.BinaryType(), "weight": T.BinaryType()}, bag).select("lang", "at", "weight")
    got = sorted(((r["lang"], bytes(r["at"]), bytes(r["weight"])) for r in bags.collect() if r["at"]))
    order = np.random.default_rng(3).permutation(len(got))
    return fit([(np.frombuffer(got[i][1], dtype=np.uint32), np.frombuffer(got[i][2], dtype=np.float32).astype(np.float64)) for i in order],
               [got[i][0] for i in order], buckets)


def held_out(event_id: Column) -> Column:
    """Rows kept out of learning: crc32 of the id as text is a multiple of 5 (a null id counts as empty text)."""
    return F.crc32(F.coalesce(event_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def identify(records: DataFrame, model: LanguageModel) -> DataFrame:
    """Add ``lang_pred``, ``score`` (calibrated probability, 0 to 1) and ``rejected`` to records with a ``reason``.

    Every whole text is read. Null text or text without a letter is ``und`` with score 0 and is rejected, and so is every text if
    the model has seen no language. A text under the model's floor keeps its prediction and is rejected. An empty table gives an
    empty result; input columns with the result's names are replaced, others pass through.
    """
    model_here = records.sparkSession.sparkContext.broadcast(model)  # buckets x languages floats, bounded by both parameters
    return map_rows(records, ["reason"], {"lang_pred": T.StringType(), "score": T.DoubleType(), "rejected": T.BooleanType()},
                    lambda texts: model_here.value.predict(texts))


def identify_language(records: DataFrame, per_language: int = 1000) -> DataFrame:
    """Learn from the labelled rows that are not held out and predict all rows.

    ``records``: ``event_id``, ``reason``, ``lang`` (null where unknown). Adds ``held_out`` to what ``identify`` adds. Learning
    reads only text and ``lang``; a prediction only text. ``per_language`` bounds the sample that is learned from.
    """
    marked = records.drop("held_out").withColumn("held_out", held_out(F.col("event_id")))
    return identify(marked, train_on(marked.filter(~F.col("held_out")), per_language))
