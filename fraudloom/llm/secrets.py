"""Secrets in reasons: fixed patterns, and a character convolutional network for what they miss.

The patterns' findings are the labels. A candidate is a run of at least 12 characters of ``[A-Za-z0-9+/_.=-]``, the least length of
an assigned value, or a pattern's match; the network reads the candidate with the characters around it.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fraudloom.llm.common import LOWER, map_rows, pack, unpack
from fraudloom.session import discard, materialize

#: Fixed patterns; the first runs on bytes with A-Z lower-cased.
ASSIGN = re.compile(rb"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([a-z0-9+/_.=-]+)""")
ASSIGN_WORDS = (b"passw", b"secret", b"token", b"api")
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]{16,}")
KINDS = ("assign", "access", "hex", "model")
CANDIDATE = re.compile(rb"[A-Za-z0-9+/_.=-]{12,}")

ROUNDS = 8  # of training
BEFORE, BODY, AFTER = 20, 40, 8
WINDOW = BEFORE + BODY + AFTER
_CODE = np.minimum(np.arange(256), 128).astype(np.uint8)


def base_spans(data: bytes) -> list[tuple[int, int, str, int]]:
    """(start, end, kind, start of the value) in bytes, by start and then kind."""
    low = data.translate(LOWER)
    out = []
    if any(w in low for w in ASSIGN_WORDS):
        out += [(m.start(), m.end(), "assign", m.start(1)) for m in ASSIGN.finditer(low) if m.end(1) - m.start(1) >= 12]
    out += [(m.start(), m.end(), "access", m.start()) for m in ACCESS.finditer(data) if m.end() - m.start() >= 18]
    out += [(m.start(), m.end(), "hex", m.start()) for m in HEX.finditer(data)]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def candidate_runs(data: bytes) -> list[tuple[int, int]]:
    """All runs of at least 12 candidate characters; whether one is a secret is left to the network."""
    return [m.span() for m in CANDIDATE.finditer(data)]


def code_points(data: bytes, plain: bool):
    """From a byte offset to the number of characters before it, counted once for the whole text."""
    if plain:
        return lambda i: i
    before = np.concatenate([[0], np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80, dtype=np.int32)])
    return lambda i: int(before[i])


def windows(data: bytes, start: int, end: int) -> list[bytes]:
    """The candidate in pieces of ``BODY`` bytes, each with its context, padded with zero bytes to one width."""
    out = []
    for at in range(start, max(end, start + 1), BODY):
        left = data[max(0, at - BEFORE):at].rjust(BEFORE, b"\0")
        body = data[at:min(end, at + BODY)]
        out.append(left + body.ljust(BODY, b"\0") + data[at + len(body):at + len(body) + AFTER].ljust(AFTER, b"\0"))
    return out


@dataclass
class CharCNN:
    """Embedding, one convolution, maximum over positions, a logistic output; ``slope`` and ``shift`` calibrate its logit."""

    embed: np.ndarray
    filters: np.ndarray
    offset: np.ndarray
    out: np.ndarray
    bias: float
    slope: float = 1.0
    shift: float = 0.0
    threshold: float = 2.0
    report: dict = field(default_factory=dict)

    def _forward(self, codes: np.ndarray):
        e = self.embed[codes]
        width = self.filters.shape[0] // e.shape[2]
        view = np.lib.stride_tricks.sliding_window_view(e, width, axis=1).transpose(0, 1, 3, 2).reshape(len(codes), -1, width * e.shape[2])
        act = view @ self.filters + self.offset
        at = act.argmax(axis=1)
        top = np.maximum(np.take_along_axis(act, at[:, None, :], axis=1)[:, 0, :], 0)
        return view, at, top, top @ self.out + self.bias

    def logits(self, pieces: list[bytes]) -> np.ndarray:
        out = [self._forward(_codes(pieces[i:i + 512]))[3] for i in range(0, len(pieces), 512)]
        return np.concatenate(out) if out else np.zeros(0)

    def probability(self, pieces: list[bytes]) -> np.ndarray:
        return self._sure(self.logits(pieces))

    def _sure(self, z: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * z + self.shift, -50, 50)))

    def calibrate(self, z: np.ndarray, t: np.ndarray, n: np.ndarray, recall: float) -> None:
        """Slope, shift and threshold from left-out logits ``z`` of label ``t``, each standing for ``n`` windows.

        The threshold is the lowest one, within two hundredths of the best precision, at which the positives are recalled at the rate
        ``recall``, half-way to the next negative below.
        """
        share = n / max(n.sum(), 1)
        for _ in range(200):  # logistic fit of slope and shift
            off = (self._sure(z) - t) * share
            self.slope -= 0.05 * float((off * z).sum())
            self.shift -= 0.05 * float(off.sum())
        order = np.argsort(self._sure(z), kind="stable")
        p, t, n = self._sure(z)[order], t[order], n[order]
        level, first = np.unique(p, return_index=True)
        hits, all_ = (np.add.reduceat(x, first) if len(first) else np.zeros(0) for x in (n * t, n))
        passed = np.cumsum(hits) - hits
        allowed = np.flatnonzero((hits > 0) & (passed <= int((1 - recall) * hits.sum())))  # any of these as threshold keeps the recall
        above, total = np.cumsum(hits[::-1])[::-1], np.cumsum(all_[::-1])[::-1]
        if len(allowed):
            right = above[allowed] / total[allowed]
            best = level[allowed[int(np.argmax(right >= right.max() - 0.02))]]  # the lowest that is about as precise: negatives are unchecked labels
            below = level[(all_ > hits) & (level < best)]
            self.threshold = float(best + (below.max() if len(below) else 0.0)) / 2
        chosen = p >= self.threshold
        self.report = {"recall": float((n * t)[chosen].sum() / hits.sum()) if len(allowed) else None,
                       "precision": float((n * t)[chosen].sum() / n[chosen].sum()) if chosen.any() else None}


_PARTS = ("embed", "filters", "offset", "out", "bias")


@dataclass
class Learning:
    """A network with what Adam remembers; those of several tasks are averaged."""

    net: CharCNN
    speed: dict
    step: float = 0

    @staticmethod
    def start(filters: int = 24, width: int = 5, dim: int = 8) -> Learning:
        rng = np.random.default_rng(11)
        net = CharCNN(rng.normal(0, 0.5, (129, dim)), rng.normal(0, 0.2, (width * dim, filters)), np.zeros(filters), rng.normal(0, 0.2, filters), 0.0)
        return Learning(net, {k: [np.zeros_like(getattr(net, k), dtype=float)] * 2 for k in _PARTS})

    def learn(self, pieces: list[bytes], y: np.ndarray, positive: float, rng: np.random.Generator) -> None:
        """One pass over windows in batches of 64; ``positive`` is the share of positives among all windows."""
        net, codes = self.net, _codes(pieces)
        (filters,), dim = net.offset.shape, net.embed.shape[1]
        width = len(net.filters) // dim
        weight = np.where(y > 0, 0.5 / positive, 0.5 / (1 - positive))
        for rows in np.array_split(rng.permutation(len(y)), max(1, len(y) // 64)):
            view, at, top, z = net._forward(codes[rows])
            g = (1 / (1 + np.exp(-np.clip(z, -50, 50))) - y[rows]) * weight[rows] / len(rows)
            back = g[:, None] * net.out * (top > 0)
            chosen = np.take_along_axis(view, at[:, :, None], axis=1)
            d_embed = np.zeros_like(net.embed)
            spread = (back[:, :, None] * net.filters.T[None]).reshape(len(rows), filters, width, dim)
            np.add.at(d_embed, codes[rows][np.arange(len(rows))[:, None, None], at[:, :, None] + np.arange(width)], spread)
            grads = {"embed": d_embed, "filters": np.einsum("rf,rfk->kf", back, chosen), "offset": back.sum(0), "out": top.T @ g, "bias": g.sum()}
            self.step += 1
            for k in _PARTS:
                m, v = self.speed[k]
                self.speed[k] = [0.9 * m + 0.1 * grads[k], 0.999 * v + 0.001 * grads[k] ** 2]
                setattr(net, k, getattr(net, k) - 0.01 * (self.speed[k][0] / (1 - 0.9 ** self.step)) / (np.sqrt(self.speed[k][1] / (1 - 0.999 ** self.step)) + 1e-8))

    @staticmethod
    def mean(states: list[tuple[int, Learning]]) -> Learning:
        """The average of (number of windows, state)."""
        share = np.array([n for n, _ in states], float) / sum(n for n, _ in states)
        mix = lambda values: sum(w * v for w, v in zip(share, values))
        net = CharCNN(*[mix([getattr(s.net, k) for _, s in states]) for k in _PARTS])
        return Learning(net, {k: [mix([s.speed[k][i] for _, s in states]) for i in (0, 1)] for k in _PARTS}, mix([s.step for _, s in states]))


def _codes(pieces: list[bytes]) -> np.ndarray:
    return _CODE[np.frombuffer(b"".join(pieces), dtype=np.uint8).reshape(-1, WINDOW)]


def fit(pieces: list[bytes], labels: np.ndarray, recall: float = 0.95, epochs: int = ROUNDS) -> CharCNN | None:
    """Train on labelled windows; every fourth is left out, calibrates the logit and sets the threshold (see ``calibrate``).

    None if either class has fewer than 8 windows. ``fit_all`` is the form for a table of any size.
    """
    y = np.asarray(labels, dtype=float)
    if min(y.sum(), (1 - y).sum()) < 8:
        return None
    state, order = Learning.start(), np.random.default_rng(11).permutation(len(y))
    check, train = order[::4], order[np.arange(len(order)) % 4 != 0]
    for epoch in range(epochs):
        state.learn([pieces[i] for i in train], y[train], float(y.mean()), np.random.default_rng([11, epoch]))
    state.net.calibrate(state.net.logits([pieces[i] for i in check]), y[check], np.ones(len(check)), recall)
    return state.net


def _without_context(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Labelled windows, and findings without their tell-tale context: each once more after the context of a negative of its batch."""
    for batch in batches:
        labels, pieces = batch.column("label").to_pylist(), batch.column("piece").to_pylist()
        contexts = [p[:BEFORE] for p, y in zip(pieces, labels) if not y]
        bare = [c + p[BEFORE:] for p, c in zip([p for p, y in zip(pieces, labels) if y], contexts)]
        yield pa.RecordBatch.from_arrays([pa.array(labels + [1] * len(bare), pa.int32()), pa.array(pieces + bare, pa.binary())], ["label", "piece"])


def fit_all(labelled: DataFrame, recall: float = 0.95, task_rows: int = 8192, most_tasks: int = 64) -> list[CharCNN] | None:
    """Two networks from all different labelled windows (``label``, ``piece``), each from the half that the other does not see.

    There are ``ROUNDS`` rounds. In each, tasks of about ``task_rows`` windows go on from one state, and their states are averaged by the
    number of windows. Few windows are all learned in every round, many in one round each; none is left out. A fourth of each
    half calibrates: its logits are counted in bins of a hundredth. The driver sees ``most_tasks`` states and the bins at most. None if a half
    has fewer than 8 windows of a class.
    """
    spark, draw = labelled.sparkSession, F.xxhash64("piece", "label")
    different = materialize(labelled.select("label", "piece").distinct(), "secret-labels")
    n = different.count()
    tasks = lambda rows: max(1, min(most_tasks, round(rows / task_rows)))
    dealt = different.repartition(tasks(n), draw).sortWithinPartitions(draw, "piece")
    lessons = materialize(dealt.mapInArrow(_without_context, "label int, piece binary").select(
        "label", "piece", F.crc32("piece").bitwiseAND(F.lit(1)).cast("int").alias("half"),
        F.pmod(F.xxhash64("piece", F.lit("check")), F.lit(4)).cast("int").alias("check"),
        F.pmod(F.xxhash64("piece", F.lit("round")), F.lit(ROUNDS)).cast("int").alias("slot")), "secret-lessons")
    discard(different)
    sizes = lessons.groupBy("half").agg(F.sum("label").alias("positive"), F.count(F.lit(1)).alias("n")).collect()  # two rows
    of = {1 - r["half"]: (r["positive"], r["n"] - r["positive"]) for r in sizes}  # a network learns from the other half
    if any(min(of.get(k, (0, 0))) < 8 for k in (0, 1)):
        return None
    positive = {k: p / (p + q) for k, (p, q) in of.items()}
    n = sum(r["n"] for r in sizes)
    passes = min(ROUNDS, max(1, -(-ROUNDS * task_rows // n)))
    states, learned = [Learning.start(), Learning.start()], [0, 0]
    for turn in range(ROUNDS):
        here = spark.sparkContext.broadcast(states)

        def learn(batches: Iterable[pa.RecordBatch], turn: int = turn, here=here) -> Iterator[pa.RecordBatch]:
            mine, seen, part = pickle.loads(pickle.dumps(here.value)), [0, 0], 0
            for batch in batches:
                half, label = (batch.column(c).to_numpy() for c in ("half", "label"))
                pieces, part = batch.column("piece").to_pylist(), part + 1
                for k in (0, 1):
                    rows = np.flatnonzero(half != k)
                    if len(rows):
                        mine[k].learn([pieces[i] for i in rows], label[rows].astype(float), positive[k], np.random.default_rng([11, turn, part]))
                        seen[k] += len(rows)
            yield pa.RecordBatch.from_arrays([pa.array([0, 1], pa.int32()), pa.array(seen, pa.int64()), pa.array([pickle.dumps(m) for m in mine], pa.binary())], ["net", "n", "state"])

        now = lessons.filter((F.col("check") > 0) & (F.pmod(F.col("slot") + turn * passes, F.lit(ROUNDS)) < passes))
        now = now.repartition(tasks(n * passes / ROUNDS), draw).sortWithinPartitions(draw, "piece")
        found = now.mapInArrow(learn, "net int, n long, state binary").filter("n > 0").orderBy("net", "n", F.xxhash64("state")).collect()
        for k in (0, 1):
            got = [(r["n"], pickle.loads(bytes(r["state"]))) for r in found if r["net"] == k]
            states[k] = Learning.mean(got) if got else states[k]
            learned[k] += sum(n for n, _ in got)
        here.unpersist()
    nets = [s.net for s in states]
    here = spark.sparkContext.broadcast(nets)

    def logit(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            half, pieces = batch.column("half").to_numpy(), batch.column("piece").to_pylist()
            bins = np.zeros(len(half), np.int64)
            for k in (0, 1):
                rows = np.flatnonzero(half != k)
                bins[rows] = np.floor(np.clip(here.value[k].logits([pieces[i] for i in rows]), -50, 50) * 100)
            yield pa.RecordBatch.from_arrays([pa.array(1 - half, pa.int32()), batch.column("label"), pa.array(bins)], ["net", "label", "bin"])

    counted = lessons.filter("check = 0").select("label", "piece", "half").mapInArrow(logit, "net int, label int, bin long")
    bins = counted.groupBy("net", "label", "bin").agg(F.count(F.lit(1)).alias("n")).orderBy("net", "bin", "label").collect()  # 2 x 2 x 10,001 at most
    discard(lessons)
    for k, net in enumerate(nets):
        z, t, size = (np.array([r[c] for r in bins if r["net"] == k], float) for c in ("bin", "label", "n"))
        net.calibrate((z + 0.5) / 100, t, size, recall)
        net.report |= {"learned": learned[k] // passes, "checked": int(size.sum())}
    return nets


def _fold(piece: bytes) -> int:
    return crc32(piece) & 1


def find_secrets(records: DataFrame, recall: float = 0.95) -> DataFrame:
    """Spans of secrets in the ``reason`` of every record.

    Result: the input columns without ``reason``, ``findings`` (array of kind, start, end in code points, end exclusive; by start,
    then kind in the order assign, access, hex, model) . Pattern findings always stay; ``model`` spans are candidates that overlap
    none of them and whose calibrated probability reaches the threshold, set so that ``recall`` of left-out labelled findings are
    found. Two networks are trained, each on half of the labels, and a candidate is read by the one that has not seen
    it. They learn from, and are calibrated by, all different labelled candidates (``fit_all``); with fewer than
    8 of a class there are no ``model`` spans. Null and empty texts have no findings, texts are read whole, repeated rows are
    treated alike, and an input column named ``findings`` is replaced.
    """
    span = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    spot = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("label", T.IntegerType()),
                         T.StructField("pieces", T.ArrayType(T.BinaryType()))])

    def scan(texts: list):
        base, spots = [], []
        for text in texts:
            data = (text or "").encode(errors="replace")
            found = base_spans(data)
            runs = candidate_runs(data)
            at = code_points(data, len(data) == len(text or ""))
            base.append([{"kind": k, "start": at(a), "end": at(b)} for a, b, k, _ in found])
            mine = [{"start": at(a), "end": at(b), "label": 1, "pieces": windows(data, v, b)} for a, b, k, v in found if k != "hex"]
            last = 0
            for a, b in runs:  # both lists are in order
                while last < len(found) and found[last][1] <= a:
                    last += 1
                if not any(x < b and y > a for x, y, *_ in found[max(0, last - 2):last + 4]):
                    mine.append({"start": at(a), "end": at(b), "label": 0, "pieces": windows(data, a, b)})
            spots.append(mine)
        return base, spots

    marked = map_rows(pack(records, "event_id", "reason"), ["reason"], {"findings": T.ArrayType(span), "_spots": T.ArrayType(spot)}, scan)
    marked = materialize(marked.drop("reason"), "secret-candidates")

    each = marked.filter(F.size("_spots") > 0).select(F.explode("_spots").alias("s")).select(
        F.col("s.label").alias("label"), F.element_at("s.pieces", 1).alias("piece"))
    nets = fit_all(each, recall)
    if nets is None:
        return unpack(marked, records, ["findings"], ("reason",))
    here = records.sparkSession.sparkContext.broadcast(nets)

    def add(found: list, spots: list):
        tests = [(i, s) for i, mine in enumerate(spots) for s in mine or [] if not s["label"]]
        out = [list(f) for f in found]
        for k, net in enumerate(here.value):
            mine = [(i, s) for i, s in tests if _fold(s["pieces"][0]) == k]
            p = net.probability([w for _, s in mine for w in s["pieces"]])
            at = np.concatenate([[0], np.cumsum([len(s["pieces"]) for _, s in mine])]).astype(int)
            for (i, s), a, b in zip(mine, at, at[1:]):
                if p[a:b].max() >= net.threshold:
                    out[i].append({"kind": "model", "start": s["start"], "end": s["end"]})
        return [[sorted(f, key=lambda s: (s["start"], KINDS.index(s["kind"]))) for f in out]]

    return unpack(map_rows(marked, ["findings", "_spots"], {"findings": T.ArrayType(span)}, add), records, ["findings"], ("reason",))
