"""Reasons whose sets of word shingles are alike: every pair with a Jaccard similarity of 0.8 or more, and no other.

Candidates come from prefix filtering, which loses no pair: with the shingles of all sets in one order, two sets that are alike
share one of the first n - ceil(0.8 n) + 1 of each, and two of the first n - ceil(0.8 n) + 2. The order may be any; shingles common in
a share of the texts come last, which only saves work. A shingle that many sets have early is split by the second one that a pair must share.
Sets that a first round has already connected are not paired again, so a large group of copies is not squared: the round pairs each
set with one other of equal least hash, and with one whose SimHash fingerprint is within four bits. A candidate must first pass a bound on the overlap from two small bit maps, which loses no pair either; only
what passes has its whole sets fetched. All links rest on the exact similarity of the whole sets.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fraudloom.llm.common import LOWER, map_rows
from fraudloom.llm.simhash import fingerprint, fingerprint_links
from fraudloom.operators.graph import connected_components
from fraudloom.session import discard, materialize

#: Odd factors; the least product of a set is one of its names in the first round.
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53,
                     0x94D049BB133111EB, 0xBF58476D1CE4E5B9], dtype=np.uint64)


BLOCK = 1 << 16  # pairs sent on at a time
SPOTS, COMMON = 1 << 23, 1 << 25  # bits of the fixed filters: 1 and 4 MB


def shingle_set(text: str | None, shingle: int) -> np.ndarray:
    """Different shingles' XXH64 (seed 42), ascending; words as in ``simhash.fingerprint``, none for a blank text."""
    words = (text or "").encode(errors="replace").translate(LOWER).split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate([[0], ends[:-1]])
    stops = (ends - 1)[min(shingle, len(words)) - 1:]
    digest = xxhash.xxh64_digest
    h = b"".join([digest(joined[a:b], 42) for a, b in zip(starts.tolist(), stops.tolist())])
    return np.unique(np.frombuffer(h, dtype=">u8").astype(np.uint64))


def _name(shingles: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(shingles.tobytes(), 7)).astype(np.int64))


def prefix(shingles: np.ndarray, common: np.ndarray) -> np.ndarray:
    """The first n - ceil(0.8 n) + 2 shingles: those without a bit in the map ``common`` first, each part by value."""
    if not len(shingles):
        return shingles
    at = (shingles & np.uint64(64 * len(common) - 1)).astype(np.int64)
    usual = (common[at >> 6] >> (at & 63)) & 1 == 1
    n = len(shingles)
    return np.concatenate([shingles[~usual], shingles[usual]])[:n - (8 * n + 9) // 10 + 2]


def bit_map(shingles: np.ndarray) -> bytes:
    """Bits that a set's shingles hit among a power of two, two to four times their number."""
    bits = np.zeros(max(64, 1 << (2 * len(shingles)).bit_length()), bool)
    bits[(shingles & np.uint64(len(bits) - 1)).astype(np.int64)] = True
    return np.packbits(bits, bitorder="little").tobytes()


def most_in_common(n: int, mine: bytes, other: bytes) -> int:
    """A number that the overlap of two sets cannot exceed: every bit that only mine has stands for a shingle that only mine has."""
    a, b = np.frombuffer(mine, np.uint64), np.frombuffer(other, np.uint64)
    while len(a) > len(b):  # a bit of the smaller map is any of two of the larger one
        a = a[:len(a) // 2] | a[len(a) // 2:]
    while len(b) > len(a):
        b = b[:len(b) // 2] | b[len(b) // 2:]
    return n - int(np.bitwise_count(a & ~b).sum())


@F.pandas_udf(T.BooleanType())
def _may_be_alike(n_a: pd.Series, map_a: pd.Series, n_b: pd.Series, map_b: pd.Series) -> pd.Series:
    return pd.Series([9 * min(most_in_common(n, x, y), most_in_common(m, y, x)) >= 4 * (n + m) for n, x, m, y in zip(n_a, map_a, n_b, map_b)], dtype=bool)


def _flags(spots: DataFrame, size: int) -> np.ndarray:
    """Bit map of ``size`` bits, as 64-bit words, of the numbers (0 to ``size`` - 1) in the one column of ``spots``."""
    at = F.col(spots.columns[0])
    words = spots.groupBy((at / 64).cast("int").alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (at % 64).cast("int"))).alias("bits"))
    flags = np.zeros(size // 64, np.int64)
    for row in words.toLocalIterator():
        flags[row["word"]] = row["bits"]
    return flags


def _common(records: DataFrame, shingle: int, share: float) -> np.ndarray:
    """Bits of the shingles that three or more texts of a share of all hold; they decide the order of shingles and so the cost, never a result."""
    drawn = records.filter(F.pmod(F.xxhash64("event_id", F.lit("shingles")), F.lit(1 << 20)) < int((1 << 20) * share))
    held = map_rows(drawn.select("reason"), ["reason"], {"s": T.ArrayType(T.LongType())},
                    lambda texts: [[shingle_set(t, shingle).view(np.int64) for t in texts]])
    often = held.select(F.explode("s").alias("s")).groupBy("s").count().filter("count > 2")
    return _flags(often.select(F.col("s").bitwiseAND(COMMON - 1).alias("at")), COMMON)


def _pairs(sid: np.ndarray, n: np.ndarray, comp: np.ndarray, pos: np.ndarray) -> Iterator[np.ndarray]:
    """Pairs of a shingle's sets in different components that can still be alike, given lengths and positions; block by block."""
    after = np.searchsorted(comp, comp, side="right")  # rows come by component
    out, held = [], 0
    for i in range(len(sid)):
        j = np.arange(after[i], len(sid))
        j = j[(10 * np.minimum(n[i], n[j]) >= 8 * np.maximum(n[i], n[j])) & (9 * (pos[i] + pos[j]) <= n[i] + n[j])]
        if len(j):
            out.append(np.stack([np.minimum(sid[i], sid[j]), np.maximum(sid[i], sid[j])], axis=1))
            held += len(j)
            if held >= BLOCK:
                yield np.concatenate(out)
                out, held = [], 0
    if out:
        yield np.concatenate(out)


def _paired(postings: DataFrame, most: int | None) -> DataFrame:
    """(src, dst, hot) from (shingle, sid, n, comp, pos). A shingle of more than ``most`` sets gives no pairs but (sid, shingle, true)."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left: list[np.ndarray] | None = None
        hot_one = None  # the shingle whose rows have already been passed on in part

        def packed(both: np.ndarray, hot: bool) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1]), pa.array(np.full(len(both), hot))], ["src", "dst", "hot"])

        def close(columns: list[np.ndarray], start: int, stop: int) -> Iterator[pa.RecordBatch]:
            shingle, sid, n, comp, pos = (c[start:stop] for c in columns)
            if most is not None and (shingle[0] == hot_one or len(sid) > most):
                yield packed(np.stack([sid, shingle], axis=1), True)
            elif len(sid) > 1:
                for both in _pairs(sid, n, comp, pos):
                    yield packed(both, False)

        for batch in batches:
            columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if not len(columns[0]):
                continue
            if left is not None:
                columns = [np.concatenate(both) for both in zip(left, columns)]
            edges = np.flatnonzero(np.concatenate([[True], columns[0][1:] != columns[0][:-1], [True]]))
            sizes = np.diff(edges)
            for k in np.flatnonzero((sizes[:-1] > 1) | (columns[0][edges[:-2]] == hot_one if hot_one is not None else False)).tolist():
                yield from close(columns, edges[k], edges[k + 1])
            left = [c[edges[-2]:] for c in columns]
            if most is not None and len(left[0]) > most:
                yield from close(left, 0, len(left[0]))
                hot_one, left = left[0][0], None
        if left is not None:
            yield from close(left, 0, len(left[0]))

    count = int(postings.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = postings.select("shingle", "sid", "n", "comp", "pos").repartition(count, "shingle").sortWithinPartitions("shingle", "comp", "sid")
    return dealt.mapInArrow(run, "src long, dst long, hot boolean")


def _candidates(sets: DataFrame, most: int) -> DataFrame:
    """(src, dst): pairs that prefixes, lengths and positions leave; ``sets``: ``sid``, ``n``, ``comp``, ``prefix``."""
    early = sets.filter("n >= 4").select("sid", "n", "comp", F.posexplode(F.slice("prefix", 1, F.size("prefix") - 1)).alias("pos", "shingle"))
    found = materialize(_paired(early, most), "paired")
    hot = found.filter("hot").select(F.col("src").alias("sid"), F.col("dst").alias("first")).distinct()
    split = hot.join(sets.select("sid", "n", "comp", "prefix"), "sid").withColumn("pos", F.array_position("prefix", F.col("first")) - 1)
    split = split.withColumn("other", F.explode("prefix")).filter("other <> first").withColumn("shingle", F.xxhash64("first", "other"))
    pairs = found.filter("not hot").unionByName(_paired(split, None)).select("src", "dst").distinct()
    return pairs


def _known(rows: DataFrame, name: str, values: DataFrame) -> DataFrame:
    """Rows with ``_known``: false if the number ``name`` is surely not in the one column of ``values``, by a bit map of fixed size (1 MB).

    The map is a broadcast row and the test a plain expression: stages that read sets run no Python worker for it.
    """
    spot = lambda value: F.pmod(F.xxhash64(value), F.lit(SPOTS)).cast("int")
    flags = _flags(values.select(spot(F.col(values.columns[0])).alias("at")), SPOTS)
    one = rows.sparkSession.createDataFrame(pa.table({"_flags": pa.array([flags], pa.list_(pa.int64()))}))
    at = spot(F.col(name))
    word = F.get("_flags", F.shiftright(at, 6))
    bit = F.call_function("shiftright", word, at.bitwiseAND(63)).bitwiseAND(F.lit(1).cast("long"))
    return rows.crossJoin(F.broadcast(one)).withColumn("_known", bit == 1).drop("_flags")


def _alike(records: DataFrame, sets: DataFrame, pairs: DataFrame, shingle: int, label: str) -> DataFrame:
    """The pairs whose whole sets have a Jaccard similarity of 0.8 or more."""
    maps = sets.select("sid", "n", "map")
    side = lambda at, end: maps.select(F.col("sid").alias(at), F.col("n").alias(f"n_{end}"), F.col("map").alias(f"map_{end}"))
    close = pairs.join(side("src", "a"), "src").join(side("dst", "b"), "dst")
    pairs = materialize(close.filter(_may_be_alike("n_a", "map_a", "n_b", "map_b")).select("src", "dst"), f"{label}-candidates")
    sids = pairs.select(F.explode(F.array("src", "dst")).alias("sid")).distinct()
    ids = materialize(sets.select("sid", "first_id").join(sids, "sid", "left_semi").select(F.col("first_id").alias("event_id")).distinct(), f"{label}-ids")
    texts = _known(records, "event_id", ids).filter("_known").join(ids, "event_id", "left_semi").select("reason")

    def whole(texts: list):
        found = [shingle_set(t, shingle) for t in texts]
        return [_name(s) for s in found], [s.view(np.int64) for s in found]

    held = map_rows(texts, ["reason"], {"sid": T.LongType(), "s": T.ArrayType(T.LongType())}, whole).select("sid", "s")
    held = materialize(held.join(sids, "sid", "left_semi").dropDuplicates(["sid"]), f"{label}-sets")
    both = (pairs.join(held.select(F.col("sid").alias("src"), F.col("s").alias("a")), "src")
            .join(held.select(F.col("sid").alias("dst"), F.col("s").alias("b")), "dst"))
    out = materialize(both.filter("9 * size(array_intersect(a, b)) >= 4 * (size(a) + size(b))").select("src", "dst"), label)
    for done in (pairs, ids, held):
        discard(done)
    return out


def _fingerprint_pairs(sets: DataFrame, radius: int = 4) -> DataFrame:
    """(src, dst): candidates that connect all sets whose SimHash fingerprints ``fp`` are linked within ``radius`` bits; ``sets``: ``sid``, ``fp``, ``n``.

    The sets of one fingerprint are paired with one of them, which stands for the fingerprint in its links to others.
    """
    some = sets.filter("n > 0")
    leads = materialize(some.groupBy("fp").agg(F.min("sid").alias("lead")), "fingerprint-leads")
    equal = some.join(leads, "fp").filter("sid <> lead").select("sid", "lead")
    links = fingerprint_links(leads.select("fp"), radius)
    near = (links.join(leads.select(F.col("fp").alias("src"), F.col("lead").alias("sid")), "src")
            .join(leads.select(F.col("fp").alias("dst"), "lead"), "dst").select("sid", "lead"))
    return equal.unionByName(near).select(F.least("sid", "lead").alias("src"), F.greatest("sid", "lead").alias("dst"))


def near_copies(records: DataFrame, shingle: int = 5, share: float = 1 / 16, most: int = 500) -> DataFrame:
    """Component of every reason among reasons whose shingle sets have a Jaccard similarity of 0.8 or more.

    ``records``: ``event_id`` (not null) and ``reason``. Words and short texts as in ``simhash.near_duplicates``; a shingle counts once in a set, and
    all blank texts are alike. Result, one row per record: ``event_id`` and ``component_id``, the smallest ``event_id`` that can
    be reached over links. Sets and shingles are told apart by 64-bit hashes. A ``share`` of the texts decides which shingles are common, and a
    shingle in the prefixes of more than ``most`` sets is split by second shingles; neither changes a result. An ``event_id`` that stands
    on different texts is in the component of each of them, and its rows are returned with the component of their own text.
    """
    records = records.select("event_id", "reason")
    here = records.sparkSession.sparkContext.broadcast(_common(records, shingle, share))

    def read(texts: list):
        out = []
        for text in texts:
            s = shingle_set(text, shingle)
            keys = [int(k) for k in (s[:, None] * _FACTORS).min(axis=0).view(np.int64)] if len(s) else []
            out.append((_name(s), len(s), keys, prefix(s, here.value).view(np.int64), bit_map(s), fingerprint(text, shingle)))
        return [list(x) for x in zip(*out)] if out else [[], [], [], [], [], []]

    longs = T.ArrayType(T.LongType())
    made = {"sid": T.LongType(), "n": T.LongType(), "keys": longs, "prefix": longs, "map": T.BinaryType(), "fp": T.LongType()}
    prints = materialize(map_rows(records, ["reason"], made, read).drop("reason"), "shingle-sets")
    texts = materialize(prints.select("event_id", "sid"), "text-sets")
    first = materialize(texts.groupBy("sid").agg(F.min("event_id").alias("first_id"), F.count(F.lit(1)).alias("copies")), "first-ids")
    # Most sets stand on one text only; the rest are told by a bit map and folded by a shuffle of their own. They are written, since all
    # that follows reads them: each of its plans would broadcast the bit map again.
    marked = _known(prints.drop("event_id"), "sid", first.filter("copies > 1").select("sid"))
    sets = materialize(marked.filter("not _known").unionByName(marked.filter("_known").dropDuplicates(["sid"])).drop("_known"), "different-sets")
    discard(prints)
    firsts = first.select("sid", "first_id")

    named = sets.select("sid", "n", F.posexplode("keys").alias("k", "key")).withColumn("h", F.xxhash64("sid", "k"))
    leads = named.groupBy("k", "key").agg(F.min(F.struct("h", "sid", "n")).alias("lead"), F.count(F.lit(1)).alias("rows")).filter("rows > 1").drop("rows")
    stars = named.join(leads, ["k", "key"]).filter("sid <> lead.sid and 10 * least(n, lead.n) >= 8 * greatest(n, lead.n)")
    stars = stars.select(F.least("sid", "lead.sid").alias("src"), F.greatest("sid", "lead.sid").alias("dst"))
    stars = stars.unionByName(_fingerprint_pairs(sets.select("sid", "fp", "n"))).distinct()
    fetch = sets.select("sid", "n", "map").join(firsts, "sid")
    near = _alike(records, fetch, stars, shingle, "alike-first")
    linked = connected_components(near).withColumnsRenamed({"node": "sid", "component": "comp"})

    placed = sets.select("sid", "n", "prefix").join(linked, "sid", "left").withColumn("comp", F.coalesce("comp", "sid"))
    far = _alike(records, fetch, _candidates(placed, most), shingle, "alike-rest")
    members = connected_components(near.unionByName(far)).withColumnsRenamed({"node": "sid", "component": "comp"})
    grouped = firsts.join(members, "sid", "left").withColumn("comp", F.coalesce("comp", "sid"))
    smallest = grouped.groupBy("comp").agg(F.min("first_id").alias("component_id"))
    classes = grouped.join(smallest, "comp").select("sid", "component_id")
    return texts.join(classes, "sid").select("event_id", "component_id")
