"""Exact removal of long repeated substrings from reasons, by anchors and windows ranked by doubled byte ranks.

Ranks of byte strings double in length: the rank of 2h bytes at a position is the name of the pair (rank of h bytes there, rank of h
bytes h further on). Sorting pairs and re-ranking all positions of a corpus would shuffle many times its size, so three things keep
it small, none of which changes the result. Ranks are 64-bit names, so that a rank needs no look-up of its position. Positions are
sorted sparsely at first: every ``length``-byte window belongs to one anchor, the smallest ``SEED``-byte rank in it, which depends on
nothing but the window's bytes, so equal windows have equal anchors at equal distances. And a position leaves as soon as its rank is unique:

1. Anchors are sorted by the rank of their seed. Alone with its seed: all its windows are new. Equal to an earlier anchor over the
   whole range of its windows: all of them are repeats. Otherwise its windows go on.
2. Those windows are sorted by the rank of their full ``length``; all but the first of each rank are repeats.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fraudloom.llm.common import map_rows, mix64, pack, slices, unpack
from fraudloom.session import materialize

SEED = 48
PIECE = 1 << 20  # bytes of a longer text ranked at a time
TOGETHER = 1 << 16  # bytes of short texts ranked at a time
FLUSH = 200_000  # positions a task holds before it sorts and sends them
SPREAD = 4  # contexts of one seed in one flush beyond which they are dealt by context
_LOW = np.uint64((1 << 24) - 1)
FILTER_BITS = 1 << 23


def ranks(data: np.ndarray, sizes: tuple[int, ...], salt: int = 0) -> dict[int, np.ndarray]:
    """Ranks of so many bytes (powers of two) at every position that has them; smaller ranks on the way are let go."""
    h, n = data.astype(np.uint64) + np.uint64(1 + salt), 1
    out = {}
    while n < max(sizes) and len(h) > n:
        h = mix64(h[:-n], h[n:], n + salt)
        n *= 2
        if n in sizes:
            out[n] = h
    return out


def _stretch(h: dict[int, np.ndarray], at: np.ndarray, size, half: int, salt: int) -> np.ndarray:
    """Rank of ``size`` bytes, between ``half`` and twice as many, from two overlapping ranks of ``half`` bytes."""
    return mix64(h[half][at], h[half][at + size - half], salt)


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    n = 1
    while 2 * n <= width:
        x = np.minimum(x[:-n], x[n:])
        n *= 2
    rest = width - n
    return np.minimum(x[:len(x) - rest], x[rest:]) if rest else x


def anchors(data: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Anchors of several texts laid end to end: seed, context rank, text number, and first and last window (offsets in the text)."""
    h = ranks(data, (32, 64, 128))
    seed = _stretch(h, np.arange(max(0, len(data) - SEED + 1)), SEED, 32, SEED)
    where = (_sliding_min(seed & ~_LOW | np.arange(len(seed), dtype=np.uint64), length - SEED + 1) & _LOW).astype(np.int64)
    starts = np.concatenate([[0], ends[:-1]])
    text = np.repeat(np.arange(len(ends)), ends - starts)[:len(where)]
    first = np.flatnonzero(np.arange(len(where)) + length <= ends[text])
    at = where[first]
    new = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (first[1:] != first[:-1] + 1)])) if len(first) else np.zeros(0, np.int64)
    p0, a = first[new], at[new]
    p1 = first[np.concatenate([new[1:], [len(first)]])[:len(new)] - 1] if len(new) else p0
    size = p1 - p0 + length
    context = np.zeros(len(a), np.uint64)
    for half in (64, 128):
        some = (size > 128) == (half == 128)
        if some.any():
            context[some] = _stretch(h, p0[some], size[some], half, half)
    context = mix64(context, ((a - p0) << 10 | size).astype(np.uint64), 7)
    base = starts[text[p0]] if len(p0) else p0
    return seed[a], context, text[p0], p0 - base, p1 - base


def _laid_out(pairs: Iterable[tuple[int, bytes]], length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, ends, order, base): texts laid end to end; a very long one comes in pieces that share ``length`` - 1 bytes."""
    held: list[tuple[int, int, bytes]] = []
    size = 0

    def lay():
        return (np.frombuffer(b"".join(x[2] for x in held), dtype=np.uint8), np.cumsum([len(x[2]) for x in held]),
                np.array([x[0] for x in held], dtype=np.int64), np.array([x[1] for x in held], dtype=np.int64))

    for order, data in pairs:
        for base in range(0, max(0, len(data) - length) + 1, PIECE):
            piece = data[base:base + PIECE + length - 1]
            if len(piece) < length:
                continue
            if held and size + len(piece) > TOGETHER:
                yield lay()
                held, size = [], 0
            held.append((order, base, piece))
            size += len(piece)
    if held:
        yield lay()


def _texts(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int, bytes]]:
    for batch in batches:
        for part in slices(batch):
            for order, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                yield order, (text or "").encode(errors="replace")


def _packed(columns: list[np.ndarray], order_at: int) -> bytes:
    """Columns of one length as bytes; the ascending one as differences, which compress."""
    n = len(columns[0])
    out = [np.array([n], np.int64).tobytes()]
    for i, c in enumerate(columns):
        c = np.concatenate([c[:1], np.diff(c)]) if i == order_at else c
        if i == order_at:  # low bytes together, high bytes together
            c = np.ascontiguousarray(c.astype("<i8").view(np.uint8).reshape(-1, 8).T)
        out.append(c.tobytes())
    return b"".join(out)


def _unpacked(data: bytes, kinds: list, order_at: int) -> list[np.ndarray]:
    n, at, out = int(np.frombuffer(data, np.int64, 1)[0]), 8, []
    for i, kind in enumerate(kinds):
        c = np.frombuffer(data, kind, n, at)
        at += n * np.dtype(kind).itemsize
        if i == order_at:
            c = np.cumsum(np.ascontiguousarray(c.view(np.uint8).reshape(8, n).T).reshape(-1).view("<i8"))
        out.append(c)
    return out


def _firsts(keys: list[np.ndarray], order: np.ndarray, offset: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorting by keys and then position: (permutation, starts a group of equal keys, stands after the group's first position)."""
    by = np.lexsort([offset, order, *keys[::-1]])
    new = np.zeros(len(by), bool)
    for key in keys:
        k = key[by]
        new[1:] |= k[1:] != k[:-1]
    new[:1] = True
    lead = by[np.flatnonzero(new)][np.cumsum(new) - 1]
    return by, new, (order[by] != order[lead]) | (offset[by] != offset[lead])


def _merged(order: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Union of spans of each text."""
    by = np.lexsort([start, order])
    order, start, stop = order[by], start[by].astype(np.int64), stop[by].astype(np.int64)
    if not len(order):
        return order, start, stop
    head = np.concatenate([[True], order[1:] != order[:-1]])
    group = np.cumsum(head) - 1
    wide = int(stop.max()) + 1
    reach = np.maximum.accumulate(stop + group * wide) - group * wide
    new = np.flatnonzero(head | np.concatenate([[False], start[1:] > reach[:-1]]))
    return order[new], start[new], reach[np.concatenate([new[1:], [len(order)]]) - 1]


_ANCHOR = [np.uint64, np.uint64, np.int64, np.int32, np.uint8, np.uint8]  # seed, context, order, first window, windows, flag
_WINDOW = [np.uint64, np.uint32, np.int64, np.int32]  # rank, check, order, window
_SENT = "key long, kind int, data binary"


def _send(kinds: list, columns: list[np.ndarray], deal: np.ndarray, buckets: int) -> Iterator[tuple[int, int, bytes]]:
    """(bucket, 0, packed rows) for the rows dealt to each bucket, in the order of their texts."""
    bucket = (deal % np.uint64(buckets)).astype(np.int64)
    by = np.lexsort([columns[3], columns[2], bucket])
    bucket = bucket[by]
    edges = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]])) if len(by) else np.zeros(1, np.int64)
    for a, b in zip(edges[:-1], edges[1:]):
        yield int(bucket[a]), 0, _packed([c[by[a:b]].astype(kind) for c, kind in zip(columns, kinds)], 2)


def _spans(order: np.ndarray, start: np.ndarray, stop: np.ndarray) -> list[tuple[int, int, bytes]]:
    """Covered spans as one row, dealt by the first text."""
    o, a, b = _merged(order, start, stop)
    return [(int(o[0]), 1, _packed([o, a.astype(np.int32), b.astype(np.int32)], 0))] if len(o) else []


def _batch(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [(), (), ()]
    return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.binary())], ["key", "kind", "data"])


def _found(order, start, stop, at, kind: int) -> pa.RecordBatch:
    n = len(order)
    return pa.RecordBatch.from_arrays([pa.array(np.asarray(order, np.int64)), pa.array(np.asarray(start, np.int32)), pa.array(np.asarray(stop, np.int32)),
                                       pa.array(np.full(n, kind, np.int32))], ["order", "start", "stop", "open"])


_FOUND = "order long, start int, stop int, open int"


def _by_bucket(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int, int, list[bytes]]]:
    """Groups of the sorted rows of ``_SENT``."""
    at, held = None, []
    for batch in batches:
        for key, kind, data in zip(*[c.to_pylist() for c in batch.columns]):
            if (kind, key) != at:
                if held:
                    yield at[1], at[0], held
                at, held = (kind, key), []
            held.append(data)
    if held:
        yield at[1], at[0], held


def _joined(parts: list[bytes], kinds: list, order_at: int) -> list[np.ndarray]:
    return [np.concatenate(c) for c in zip(*[_unpacked(p, kinds, order_at) for p in parts])]


def _anchor_round(texts: DataFrame, length: int, buckets: int) -> DataFrame:
    """Spans found to be repeats (``open`` 0) and ranges of windows still to be compared (``open`` 1)."""
    def send(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        count = 0

        def flush() -> list[tuple[int, int, bytes]]:
            seed, context, order, p0, n = (np.concatenate(c) for c in zip(*held))
            by, new, later = _firsts([seed, context], order, p0)
            rows = _spans(order[by[later]], p0[by[later]], p0[by[later]] + n[by[later]] + length)
            by = by[new]
            seed, context, order, p0, n = seed[by], context[by], order[by], p0[by], n[by]
            head = np.concatenate([[True], seed[1:] != seed[:-1]])
            group = np.cumsum(head) - 1
            many = np.bincount(group)[group] > SPREAD
            rows += _send(_ANCHOR, [x[~many] for x in (seed, context, order, p0, n)] + [np.zeros((~many).sum())], seed[~many], buckets)
            rows += _send(_ANCHOR, [x[many] for x in (seed, context, order, p0, n)] + [np.ones(many.sum())], mix64(seed[many], context[many], 3), buckets)
            beacon = many & head  # tells the seed's own bucket that there are more
            rows += _send(_ANCHOR, [x[beacon] for x in (seed, context, order, p0, n)] + [np.full(beacon.sum(), 2)], seed[beacon], buckets)
            return rows

        for data, ends, orders, bases in _laid_out(_texts(batches), length):
            seed, context, text, p0, p1 = anchors(data, ends, length)
            held.append((seed, context, orders[text], p0 + bases[text], p1 - p0))
            count += len(seed)
            if count >= FLUSH:
                ready, count = _batch(flush()), 0
                held.clear()
                yield ready
        if held:
            yield _batch(flush())

    def decide(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, kind, parts in _by_bucket(batches):
            if kind == 1:
                yield _found(*_joined(parts, [np.int64, np.int32, np.int32], 0), None, 0)
                continue
            seed, context, order, p0, n, flag = _joined(parts, _ANCHOR, 2)
            # A beacon and a dealt row of one seed sort with their like only; both leave the seed's contexts open.
            by, new, later = _firsts([seed, (flag == 1).astype(np.uint64), context], order, p0)
            later &= flag[by] != 2
            real = by[later]
            yield _found(order[real], p0[real], p0[real] + n[real].astype(np.int32) + length, None, 0)
            s, f = seed[by], flag[by]
            group = np.cumsum(np.concatenate([[True], (s[1:] != s[:-1]) | ((f[1:] == 1) != (f[:-1] == 1))])) - 1
            contexts = np.bincount(group, weights=new)
            shared = (contexts[group] > 1) | (f == 1) | (np.bincount(group, weights=f == 2)[group] > 0)
            rest = by[new & shared & ~later]
            lead = by[~later & shared & (f != 2)]
            rest = np.unique(np.concatenate([rest[flag[rest] != 2], lead]))
            yield _found(order[rest], p0[rest], p0[rest] + n[rest].astype(np.int32), None, 1)

    parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sent = texts.mapInArrow(send, _SENT).repartition(parts, "kind", "key").sortWithinPartitions("kind", "key")
    return sent.mapInArrow(decide, _FOUND)


def _window_round(open_texts: DataFrame, length: int, buckets: int) -> DataFrame:
    """Spans of repeats among the open windows; ``open_texts``: ``order``, ``reason``, ``ranges`` (start and stop of each)."""
    def send(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        count = 0

        def flush() -> list[tuple[int, int, bytes]]:
            rank, check, order, p = (np.concatenate(c) for c in zip(*held))
            by, new, later = _firsts([rank, check], order, p)
            rows = _spans(order[by[later]], p[by[later]], p[by[later]] + length)
            by = by[new]
            return rows + list(_send(_WINDOW, [x[by] for x in (rank, check, order, p)], rank[by], buckets))

        for batch in batches:
            for part in slices(batch):
                for order, text, ranges in zip(*[c.to_pylist() for c in part.columns]):
                    data = np.frombuffer((text or "").encode(errors="replace"), dtype=np.uint8)
                    _, low, high = _merged(np.zeros(len(ranges), np.int64), np.array([r["start"] for r in ranges]), np.array([r["stop"] + 1 for r in ranges]))
                    for a, b in zip(low.tolist(), high.tolist()):  # windows [a, b)
                        for at in range(a, b, PIECE):
                            end = min(b, at + PIECE)
                            piece = data[at:end + length - 1]
                            p = np.arange(end - at)
                            rank, check = (_stretch(ranks(piece, (64,), salt), p, length, 64, 100) for salt in (0, 1 << 20))
                            held.append((rank, (check >> np.uint64(32)).astype(np.uint32), np.full(len(p), order, np.int64), p + at))
                            count += len(p)
                            if count >= FLUSH:
                                ready, count = _batch(flush()), 0
                                held.clear()
                                yield ready
        if held:
            yield _batch(flush())

    def decide(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, kind, parts in _by_bucket(batches):
            if kind == 1:
                yield _found(*_joined(parts, [np.int64, np.int32, np.int32], 0), None, 0)
                continue
            rank, check, order, p = _joined(parts, _WINDOW, 2)
            by, _, later = _firsts([rank, check], order, p)
            real = by[later]
            yield _found(*_merged(order[real], p[real], p[real] + length), None, 0)

    parts = int(open_texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sent = open_texts.mapInArrow(send, _SENT).repartition(parts, "kind", "key").sortWithinPartitions("kind", "key")
    return sent.mapInArrow(decide, _FOUND)


def _spot(order: Column) -> Column:
    return F.pmod(F.xxhash64(order), F.lit(FILTER_BITS)).cast("int")


def _may_have(orders: DataFrame) -> "callable":
    """Test for texts that are surely not among ``orders``: a bit map of fixed size, one megabyte on the driver and in each task."""
    spot = _spot(F.col("order"))
    words = orders.groupBy((spot / 64).cast("int").alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), spot % 64)).alias("bits"))
    flags = np.zeros(FILTER_BITS // 64, np.int64)
    for row in words.toLocalIterator():
        flags[row["word"]] = row["bits"]
    here = orders.sparkSession.sparkContext.broadcast(flags)

    @F.pandas_udf("boolean")
    def known(at: pd.Series) -> pd.Series:
        at = at.to_numpy()
        return pd.Series((here.value[at // 64] >> (at % 64)) & 1 == 1)

    return lambda order: known(_spot(order))


def _numbered(records: DataFrame) -> DataFrame:
    """Records with ``order``: ids themselves if they are integers, each once; otherwise numbers in the order of id (null last) and text hash."""
    if isinstance(records.schema["event_id"].dataType, (T.LongType, T.IntegerType, T.ShortType, T.ByteType)):
        twice = records.groupBy("event_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1 or event_id is null")
        if twice.isEmpty():
            return records.withColumn("order", F.col("event_id").cast("long"))
    name = F.sha2(F.coalesce("reason", F.lit("")).cast("binary"), 256)
    keys = records.select(F.col("event_id").alias("_id"), name.alias("_name")).distinct()
    parts = int(records.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = keys.repartitionByRange(parts, F.col("_id").asc_nulls_last(), "_name").sortWithinPartitions(F.col("_id").asc_nulls_last(), "_name")
    numbers = materialize(ranged.withColumn("order", F.monotonically_increasing_id()), "record-order")
    return records.join(numbers, F.col("event_id").eqNullSafe(F.col("_id")) & (name == F.col("_name"))).drop("_id", "_name")


def remove_repeats(records: DataFrame, length: int = 100) -> DataFrame:
    """Remove from ``reason`` every byte covered by a ``length``-byte string that also starts earlier.

    ``records``: ``event_id`` (ordered), ``reason``; further columns pass through, ``reason`` does not. A string starts earlier if it does
    in a record of smaller ``event_id``, or before in the same record; overlapping strings count, strings never cross records, and all is
    judged on the texts as given. Adds ``kept`` (the remaining UTF-8 bytes joined, which may cut a character), ``n_bytes``,
    ``n_removed`` and ``n_spans`` (maximal removed runs). ``length`` is 64 to 128.

    Null or empty text and text under ``length`` bytes loses nothing. A null ``event_id`` comes after all others. Rows that share an
    ``event_id`` are taken in the order of their text's SHA-256, and rows equal in both are one record (none removes the other). An
    empty table gives an empty result. Input columns with a result's name are replaced.
    """
    if not 64 <= length <= 128:
        raise ValueError("length must be 64 to 128")
    made = {"kept": T.BinaryType(), "n_bytes": T.LongType(), "n_removed": T.LongType(), "n_spans": T.LongType()}
    numbered = _numbered(pack(records, "event_id", "reason"))
    size = numbered.agg(F.sum(F.octet_length("reason"))).first()[0] or 0
    buckets = max(256, size >> 25)
    texts = numbered.select("order", "reason").filter(F.octet_length("reason") >= length)
    found = materialize(_anchor_round(texts, length, buckets), "anchor-spans")
    opened = found.filter("open = 1").groupBy("order").agg(F.collect_list(F.struct("start", "stop")).alias("ranges"))
    has_open = _may_have(found.filter("open = 1").select("order"))
    again = materialize(_window_round(texts.filter(has_open(F.col("order"))).join(opened, "order").select("order", "reason", "ranges"), length, buckets), "window-spans")
    every = found.filter("open = 0").unionByName(again)
    spans = every.groupBy(F.col("order").alias("_order")).agg(F.collect_list(F.struct("start", "stop")).alias("_spans"))
    has_span = _may_have(every.select("order"))(F.col("order"))

    def cut(texts: list, spans: list):
        out = ([], [], [], [])
        for text, mine in zip(texts, spans):
            data = (text or "").encode(errors="replace")
            _, low, high = _merged(np.zeros(len(mine or ()), np.int64), np.array([s["start"] for s in mine or ()], np.int64), np.array([s["stop"] for s in mine or ()], np.int64))
            keep, at = [], 0
            for a, b in zip(low.tolist(), high.tolist()):
                keep.append(data[at:a])
                at = b
            keep.append(data[at:])
            kept = b"".join(keep)
            for column, value in zip(out, (kept, len(data), len(data) - len(kept), len(low))):
                column.append(value)
        return out

    marked = numbered.withColumn("_hit", has_span)
    hit = marked.filter("_hit").join(spans, F.col("order") == F.col("_order"), "left").drop("_order", "_hit")
    rest = marked.filter("not _hit").drop("_hit").withColumn("_spans", F.lit(None).cast("array<struct<start:int,stop:int>>"))
    return unpack(map_rows(hit.unionByName(rest), ["reason", "_spans"], made, cut), records, list(made), ("reason",))
