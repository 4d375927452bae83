"""Benchmark decontamination: reasons that repeat held-out evaluation cases, also edited or paraphrased.

Seeds are the rare runs of words of a case: those that chance would put into at most one reason, judged by how many reasons hold
each word, or else the rarest half. (How often a run itself occurs would say nothing: a run may be frequent because its case has
leaked often.) A seed found in a reason marks a passage there, and a Smith-Waterman alignment of the case with the passage decides. Cases are processed in blocks of
bounded size that are sent to all tasks; reasons are never shuffled.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fraudloom.llm.common import map_rows, slices
from fraudloom.llm.features import prefix_sums, word_bounds, word_hashes, words_of


def word_names(text: str | None) -> np.ndarray:
    """64-bit name of every word (letters and digits, lower-cased) of a text."""
    data = words_of(text)
    starts, ends = word_bounds(data)
    return word_hashes(prefix_sums(data), starts, ends) if len(starts) else np.zeros(0, np.uint64)


def runs(names: np.ndarray, n: int) -> np.ndarray:
    """Name of the run of ``n`` words at each position; one run for a shorter text."""
    if not len(names):
        return names
    n = min(n, len(names))
    out = names[:len(names) - n + 1].copy()
    for k in range(1, n):
        out = (out * np.uint64(0x9E3779B97F4A7C15)) ^ names[k:len(names) - n + 1 + k]
    return out ^ (out >> np.uint64(32))


def align(case: np.ndarray, passage: np.ndarray) -> tuple[int, int]:
    """Best Smith-Waterman score (match 1, mismatch -1, gap -1) and the passage position where it ends."""
    steps = np.arange(len(passage) + 1)
    row, best, end = np.zeros(len(passage) + 1, np.int64), 0, 0
    for word in case:
        new = np.zeros_like(row)
        new[1:] = np.maximum(np.maximum(row[:-1] + np.where(passage == word, 1, -1), row[1:] - 1), 0)
        new = np.maximum.accumulate(new + steps) - steps  # gaps along the passage
        row = np.maximum(new, 0)
        top = int(row.max())
        if top > best:
            best, end = top, int(row.argmax())
    return best, end


class Names:
    """A sorted set of 64-bit names with a quick test."""

    def __init__(self, names: np.ndarray) -> None:
        self.sorted = np.unique(names)
        self.low = np.zeros(1 << 20, bool)
        self.low[self.sorted & np.uint64((1 << 20) - 1)] = True

    def find(self, names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of the names that are in the set, and their places in it."""
        if not len(self.sorted) or not len(names):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        maybe = np.flatnonzero(self.low[names & np.uint64((1 << 20) - 1)])
        place = np.minimum(np.searchsorted(self.sorted, names[maybe]), len(self.sorted) - 1)
        same = self.sorted[place] == names[maybe]
        return maybe[same], place[same]


@dataclass
class Block:
    """Pieces of cases: their words, the case each belongs to, and the runs, sorted, with the piece and offset of each."""

    pieces: list[np.ndarray]
    owner: list[int]
    run: int
    names: np.ndarray
    at: np.ndarray
    seeds: Names


def make_block(texts: list[str | None], run: int, piece_words: int) -> Block:
    """Cases longer than ``piece_words`` words are cut into pieces that overlap by half."""
    pieces, owner, names, at = [], [], [np.zeros(0, np.uint64)], [np.zeros((0, 2), np.int64)]
    for i, text in enumerate(texts):
        words = word_names(text)
        for start in range(0, max(1, len(words) - piece_words // 2), max(1, piece_words // 2)):
            part = words[start:start + piece_words]
            if len(part):
                names.append(runs(part, run))
                at.append(np.stack([np.full(len(names[-1]), len(pieces)), np.arange(len(names[-1]))], axis=1))
                pieces.append(part)
                owner.append(i)
    return _indexed(pieces, owner, run, np.concatenate(names), np.concatenate(at))


def _indexed(pieces, owner, run: int, names: np.ndarray, at: np.ndarray) -> Block:
    order = np.argsort(names, kind="stable")
    return Block(pieces, owner, run, names[order], at[order], Names(names))


def keep_rare(block: Block, vocabulary: Names, counts: np.ndarray, records: int) -> Block:
    """The block with only those runs expected in at most one of ``records`` texts, or no more often than its piece's median run.

    Expected are ``records`` times the product of the shares of texts that hold each word of the run.
    """
    keep = np.zeros(len(block.names), bool)
    order = np.argsort(block.at[:, 0], kind="stable")
    for mine in np.split(order, np.flatnonzero(np.diff(block.at[order, 0])) + 1):
        if len(mine):
            words = block.pieces[block.at[mine[0], 0]]
            share = np.log((counts[np.searchsorted(vocabulary.sorted, words)] + 0.5) / (records + 1))
            n = min(block.run, len(words))
            expected = np.array([share[o:o + n].sum() for o in block.at[mine, 1]]) + np.log(records + 1)
            keep[mine] = expected <= max(0.0, np.sort(expected)[(len(mine) - 1) // 2])
    return _indexed(block.pieces, block.owner, block.run, block.names[keep], block.at[keep])


def leaks_in(text: str | None, block: Block, least_score: float, least_words: int) -> list[tuple[int, float, int]]:
    """(case number, best share of the piece that aligns, word where the alignment ends) for every case that a text repeats."""
    words = word_names(text)
    found = runs(words, block.run)
    spots: dict[int, list[int]] = {}
    for p in block.seeds.find(found)[0]:
        a, b = np.searchsorted(block.names, found[p], "left"), np.searchsorted(block.names, found[p], "right")
        for piece, offset in block.at[a:b]:
            spots.setdefault(int(piece), []).append(int(p) - int(offset))
    best: dict[int, tuple[float, int]] = {}
    for piece, begins in spots.items():
        case = block.pieces[piece]
        slack = len(case) // 2 + 2
        need = max(least_score * len(case), min(least_words, len(case)))
        begins.sort()
        low = begins[0]
        for i, b in enumerate(begins):
            if i + 1 < len(begins) and begins[i + 1] - b <= slack and begins[i + 1] - low <= 4 * len(case):
                continue  # neighbouring seeds share a passage
            start = max(0, low - slack)
            passage = words[start:b + len(case) + slack]
            if i + 1 < len(begins):
                low = begins[i + 1]
            if np.isin(case, passage).sum() < need:
                continue
            score, end = align(case, passage)
            share = score / len(case)
            if score >= need and share > best.get(block.owner[piece], (0.0, 0))[0]:
                best[block.owner[piece]] = (share, start + end)
    return [(owner, share, end) for owner, (share, end) in sorted(best.items())]


def _blocks(cases: DataFrame, words: int) -> Iterator[tuple[list, list]]:
    ids, texts, size = [], [], 0
    for row in cases.select("case_id", "reason").filter("reason is not null").orderBy("case_id").toLocalIterator():
        n = len(row["reason"]) // 4 + 1
        if ids and size + n > words:
            yield ids, texts
            ids, texts, size = [], [], 0
        ids.append(row["case_id"])
        texts.append(row["reason"])
        size += n
    if ids:
        yield ids, texts


def _texts_with(records: DataFrame, vocabulary: Names) -> tuple[np.ndarray, int]:
    """How many records hold each word of the vocabulary, and how many records there are; one number a word reaches the driver."""
    known = records.sparkSession.sparkContext.broadcast(vocabulary)

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here = known.value
        total = np.zeros(len(here.sorted) + 1, np.int64)  # the last counts texts
        for batch in batches:
            for part in slices(batch):
                for text in part.column(0).to_pylist():
                    held = np.zeros(len(total), bool)
                    held[here.find(word_names(text))[1]] = held[-1] = True
                    total += held
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["word", "n"])

    out = np.zeros(len(vocabulary.sorted) + 1, np.int64)
    for r in records.select("reason").mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).toLocalIterator():
        out[r["word"]] = r["n"]
    return out[:-1], int(out[-1])


def mark_leaks(records: DataFrame, cases: DataFrame, run: int = 3, least_score: float = 0.5, least_words: int = 8, piece_words: int = 200,
               block_words: int = 1_000_000) -> DataFrame:
    """Add ``leaks`` to every record: the evaluation cases its ``reason`` repeats.

    ``records``: ``event_id``, ``reason``, further columns pass through; ``cases``: ``case_id``, ``reason``, the held-out evaluation cases. A leak has
    ``case_id``, ``score`` (best alignment score as a share of the case's words, 1 for an exact copy) and ``at_word`` (where it ends).
    A case leaks if the score reaches ``least_score`` and at least ``least_words`` words more match than do not (all words of a shorter
    case). A case of over ``piece_words`` words is judged by pieces that overlap by half, any of which suffices.

    Whole texts are read. Cases are taken in blocks of about ``block_words`` words, which bounds what is sent to tasks; each block
    reads the records twice, once to count its words. Null or empty texts have no leaks, null or empty cases leak nowhere, a case that occurs twice is found
    twice, and repeated records are marked alike. Empty tables give an empty result or no leaks. An input column named ``leaks`` is replaced.
    """
    spark = records.sparkSession
    leak = T.StructType([T.StructField("case_id", cases.schema["case_id"].dataType), T.StructField("score", T.DoubleType()), T.StructField("at_word", T.LongType())])
    kind = T.ArrayType(leak)
    out = records.drop("leaks").withColumn("leaks", F.array().cast(kind))
    for ids, texts in _blocks(cases, block_words):
        block = make_block(texts, run, piece_words)
        vocabulary = Names(np.concatenate([np.zeros(0, np.uint64), *block.pieces]))
        counts, total = _texts_with(records, vocabulary)
        rare = spark.sparkContext.broadcast((keep_rare(block, vocabulary, counts, total), ids))

        def search(texts: list, before: list, rare=rare):
            block, ids = rare.value
            return [[list(old) + [{"case_id": ids[i], "score": s, "at_word": e} for i, s, e in leaks_in(text, block, least_score, least_words)]
                     for text, old in zip(texts, before)]]

        out = map_rows(out, ["reason", "leaks"], {"leaks": kind}, search)
    return out


def without_leaks(records: DataFrame, cases: DataFrame, **options) -> DataFrame:
    """The records that repeat no evaluation case, with their own columns (a record with a column ``leaks`` loses it)."""
    return mark_leaks(records, cases, **options).filter(F.size("leaks") == 0).drop("leaks")
