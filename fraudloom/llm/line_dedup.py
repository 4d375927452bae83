"""Line deduplication: lines that many reasons share stay in one of them.

Two Bloom filters find the lines worth shuffling. Every task marks the key hashes it has seen once and those it has seen twice;
merging two tasks adds what both have seen once to the second filter. Only keys the merged second filter knows are shuffled, and
for them an exact count by 128-bit hash decides.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fraudloom.llm.common import LOWER, WHITE, map_rows, pack, slices, unpack
from fraudloom.session import materialize

BLOCK = 1 << 19
PROBES = 2


def line_keys(text: str | None, min_chars: int) -> list[bytes | None]:
    """128-bit hash of each line's key, None for a key under ``min_chars`` code points."""
    out: list[bytes | None] = []
    for line in (text or "").split("\n"):
        bare = line.strip(WHITE)
        out.append(hashlib.blake2b(bare.encode().translate(LOWER), digest_size=16).digest() if len(bare) >= min_chars else None)
    return out


def _bits(keys: list[bytes], size: int) -> np.ndarray:
    return np.frombuffer(b"".join(keys), dtype=np.uint64).reshape(-1, PROBES) & np.uint64(size - 1)


def repeat_filter(records: DataFrame, min_chars: int, size: int) -> np.ndarray:
    """The twice-seen filter over all records: ``size`` flags, so at most ``size`` / 8 bytes reach the driver."""
    def mark(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, twice = np.zeros(size, bool), np.zeros(size, bool)
        for batch in batches:
            for part in slices(batch):
                keys = [k for text in part.column(0).to_pylist() for k in set(line_keys(text, min_chars)) if k]
                if not keys:
                    continue
                found, counts = np.unique(np.frombuffer(b"".join(keys), dtype="V16"), return_counts=True)
                at = found.view(np.uint64).reshape(-1, PROBES) & np.uint64(size - 1)
                again = once[at].all(axis=1) | (counts > 1)
                twice[at[again]] = True
                once[at] = True
        rows = []
        for block in range(0, size, BLOCK):
            if once[block:block + BLOCK].any():
                rows.append((block, *(zlib.compress(np.packbits(x[block:block + BLOCK]).tobytes(), 1) for x in (once, twice))))
        yield pa.RecordBatch.from_arrays([pa.array(list(x), kind) for x, kind in zip(list(zip(*rows)) or [[]] * 3, (pa.int64(), pa.binary(), pa.binary()))],
                                         ["block", "once", "twice"])

    def merge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for block, *both in zip(*[batch.column(i).to_pylist() for i in range(3)]):
                once, twice = (np.frombuffer(zlib.decompress(x), dtype=np.uint8) for x in both)
                if block in held:
                    once, twice = held[block][0] | once, held[block][1] | twice | (held[block][0] & once)
                held[block] = once, twice
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), pa.array([zlib.compress(t.tobytes(), 1) for _, t in held.values()], pa.binary())],
                                         ["block", "twice"])

    marked = records.select("reason").mapInArrow(mark, "block long, once binary, twice binary")
    parts = min(size // BLOCK, int(records.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    merged = marked.repartition(parts, "block").mapInArrow(merge, "block long, twice binary")
    out = np.zeros(size // 8, np.uint8)
    for row in merged.toLocalIterator():
        out[row.block // 8:(row.block + BLOCK) // 8] = np.frombuffer(zlib.decompress(row.twice), dtype=np.uint8)
    return out


def dedup_lines(records: DataFrame, min_chars: int = 20, min_records: int = 3, filter_bits: int = 1 << 26) -> DataFrame:
    """Drop shared lines of ``reason`` everywhere but in the record with the largest ``event_id`` holding them.

    ``records``: ``event_id`` (any ordered type), ``reason`` and whatever else; further columns pass through. A line's key is the
    line without whitespace at its ends, A-Z lower-cased. Keys of at least ``min_chars`` code points that at least
    ``min_records`` records hold lose all their lines except those of the record that keeps them, which keeps all of its own.
    Result: the input columns with the shortened ``reason``, and ``n_lines`` (before) and ``n_dropped``.

    Null or empty text is one empty line and is left as it is (null stays null). Records with the same ``event_id`` count as
    one record and are treated alike. A null ``event_id`` is no record to count: its lines neither count nor go. An empty
    table gives an empty result. Input columns named ``n_lines`` or ``n_dropped`` are replaced.

    ``filter_bits`` (a power of two of at least 524,288) bounds what is broadcast at an eighth as many bytes. When there are
    more different keys than about a tenth of it, more lines are suspected and shuffled; the result never changes.
    """
    if filter_bits < BLOCK or filter_bits & (filter_bits - 1):
        raise ValueError(f"filter_bits must be a power of two of at least {BLOCK}")
    named = records.filter(F.col("event_id").isNotNull())
    repeats = records.sparkSession.sparkContext.broadcast(repeat_filter(named, min_chars, filter_bits))
    id_type = records.schema["event_id"].dataType

    def suspects(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags = repeats.value
        for batch in batches:
            for part in slices(batch):
                rows, keys = [], []
                for i, text in enumerate(part.column(1).to_pylist()):
                    mine = {k for k in line_keys(text, min_chars) if k}
                    rows += [i] * len(mine)
                    keys += mine
                at = _bits(keys, filter_bits)
                hit = (flags[at >> np.uint64(3)] >> (np.uint8(7) - (at & np.uint64(7)).astype(np.uint8)) & 1).all(axis=1)
                both = np.frombuffer(b"".join(keys), dtype=np.int64).reshape(-1, 2)[hit]
                ids = part.column(0).take(pa.array(np.array(rows, dtype=np.int64)[hit]))
                yield pa.RecordBatch.from_arrays([ids, pa.array(both[:, 0]), pa.array(both[:, 1])], ["event_id", "k1", "k2"])

    schema = T.StructType([T.StructField("event_id", id_type), T.StructField("k1", T.LongType()), T.StructField("k2", T.LongType())])
    held = materialize(named.select("event_id", "reason").mapInArrow(suspects, schema).distinct(), "line-suspects")
    shared = (held.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("n"), F.max("event_id").alias("keeper"))
              .filter(F.col("n") >= min_records).drop("n"))
    shared = materialize(shared, "shared-lines")  # a table of its own: a very common key is then split in the join below
    goes = (held.join(shared, ["k1", "k2"]).filter(F.col("event_id") != F.col("keeper"))
            .groupBy(F.col("event_id").alias("_of")).agg(F.collect_list(F.struct("k1", "k2")).alias("_keys")))

    def cut(texts: list, dropped: list):
        kept, before, gone = [], [], []
        for text, keys in zip(texts, dropped):
            lines = (text or "").split("\n")
            before.append(len(lines))
            if keys:
                out = {np.array([k["k1"], k["k2"]], dtype=np.int64).tobytes() for k in keys}
                left = [line for line, key in zip(lines, line_keys(text, min_chars)) if key not in out]
                gone.append(len(lines) - len(left))
                text = "\n".join(left)
            else:
                gone.append(0)
            kept.append(text)
        return kept, before, gone

    joined = pack(records, "event_id", "reason").join(goes, F.col("event_id") == F.col("_of"), "left").drop("_of")
    out = map_rows(joined, ["reason", "_keys"], {"reason": T.StringType(), "n_lines": T.LongType(), "n_dropped": T.LongType()}, cut)
    return unpack(out, records, ["n_lines", "n_dropped"])
