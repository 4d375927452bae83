"""Near-duplicate reasons by 64-bit SimHash and BK-trees.

Fingerprints within ``radius`` bits of each other are linked, and linked reasons form components. The different fingerprints
are cut into shards: a fingerprint goes to one shard for each choice of blocks that two linked fingerprints must share, so no
link is lost. Each shard is a BK-tree, whose children are keyed by their Hamming distance to the parent; a search follows only
edges within the radius. Shard trees travel to the tasks by a shuffle: broadcasting them would put every fingerprint through the
driver.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fraudloom.llm.common import LOWER, map_rows
from fraudloom.operators.graph import connected_components
from fraudloom.session import materialize

_BIT = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def fingerprint(text: str | None, shingle: int) -> int:
    """SimHash as a signed 64-bit number: a bit is 1 if it is set in over half of the shingles' XXH64 (seed 42)."""
    words = (text or "").encode().translate(LOWER).split()  # bytes.split() cuts at [\x20\x09-\x0D]
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate([[0], ends[:-1]])
    n = max(1, len(words) - shingle + 1)
    stops = (ends - 1)[min(shingle, len(words)) - 1:]
    digest = xxhash.xxh64_digest
    h = np.frombuffer(b"".join([digest(joined[a:b], 42) for a, b in zip(starts[:n].tolist(), stops.tolist())]), dtype=np.uint8).reshape(-1, 8)
    counts = np.stack([np.bincount(h[:, 7 - i], minlength=256) for i in range(8)]) @ _BIT
    return int(np.packbits(2 * counts.reshape(-1) > n, bitorder="little").view(np.int64)[0])


class BKTree:
    """Node: (fingerprint, position, children by distance to it)."""

    def __init__(self) -> None:
        self.root: tuple | None = None

    def add(self, value: int, position: int) -> None:
        if self.root is None:
            self.root = (value, position, {})
            return
        node = self.root
        while True:
            d = (value ^ node[0]).bit_count()
            child = node[2].get(d)
            if child is None:
                node[2][d] = (value, position, {})
                return
            node = child

    def within(self, value: int, radius: int) -> list[int]:
        found, todo = [], [self.root] if self.root else []
        while todo:
            other, position, children = todo.pop()
            d = (value ^ other).bit_count()
            if d <= radius:
                found.append(position)
            todo += [child for edge, child in children.items() if d - radius <= edge <= d + radius]
        return found


def _forest(values: list[int], in_tree: list[bool], asks: list[bool], radius: int) -> list[tuple[int, int]]:
    """Links that connect what the shard's links connect, at most one less than there are values."""
    tree, lead, out = BKTree(), list(range(len(values))), []

    def find(i: int) -> int:
        while lead[i] != i:
            lead[i] = lead[lead[i]]
            i = lead[i]
        return i

    bare = [v & 0xFFFFFFFFFFFFFFFF for v in values]
    for i, v in enumerate(bare):
        if in_tree[i]:
            tree.add(v, i)
    for i, v in enumerate(bare):
        if asks[i]:
            for j in tree.within(v, radius):
                a, b = find(i), find(j)
                if a != b:
                    lead[a] = b
                    out.append((values[i], values[j]))
    return out


def fingerprint_links(fingerprints: DataFrame, radius: int = 4, shard_rows: int = 1000) -> DataFrame:
    """(src, dst): links between different fingerprints that connect exactly what all links within ``radius`` bits connect.

    The 64 bits are cut into ``radius`` + 2 blocks; two fingerprints within the radius agree in at least two of them, so each
    pair of blocks makes a shard key. A shard of more than ``shard_rows`` fingerprints is dealt into pieces, and each pair of
    pieces becomes a tree and the queries against it, so that no task holds more than twice ``shard_rows`` at a time.
    """
    blocks = radius + 2
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    keys = []
    for number, pair in enumerate(combinations(range(blocks), 2)):
        parts = [F.shiftrightunsigned("fp", cuts[b]).bitwiseAND((1 << (cuts[b + 1] - cuts[b])) - 1) for b in pair]
        width = cuts[pair[1] + 1] - cuts[pair[1]]
        keys.append(F.shiftleft(parts[0], width).bitwiseOR(parts[1]) + F.lit(number << 40))
    shards = fingerprints.select("fp", F.explode(F.array(*keys)).alias("shard"))
    large = (shards.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > shard_rows)
             .select("shard", F.ceil(F.col("n") / shard_rows).cast("int").alias("pieces")))
    dealt = (shards.join(large, "shard", "left").withColumn("pieces", F.coalesce("pieces", F.lit(1)))
             .withColumn("piece", F.pmod(F.xxhash64("fp", "shard"), "pieces").cast("int")))
    cells = dealt.select("fp", "shard", "piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("other"))
    cells = cells.select("fp", "shard", "piece", F.least("piece", "other").alias("tree"), F.greatest("piece", "other").alias("asks"))

    def link(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        at = None

        def close() -> list[tuple[int, int]]:
            if len(held) < 2:
                return []
            _, tree, asks = at
            return _forest([v for v, _ in held], [p == tree for _, p in held], [p == asks for _, p in held], radius)

        def packed(found: list[tuple[int, int]]) -> pa.RecordBatch:
            both = np.array(found, dtype=np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], ["src", "dst"])

        for batch in batches:
            found = []
            for fp, shard, piece, tree, asks in zip(*[c.to_pylist() for c in batch.columns]):
                if (shard, tree, asks) != at:
                    found += close()
                    held, at = [], (shard, tree, asks)
                held.append((fp, piece))
            yield packed(found)
        yield packed(close())

    n = int(fingerprints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_cells = cells.repartition(n, "shard", "tree", "asks").sortWithinPartitions("shard", "tree", "asks", "fp")
    return sorted_cells.mapInArrow(link, "src long, dst long").distinct()


def near_duplicates(records: DataFrame, shingle: int = 4, radius: int = 4, shard_rows: int = 1000) -> DataFrame:
    """Component of every reason among reasons with near fingerprints.

    ``records``: ``event_id`` (any ordered type) and ``reason``; other columns are left out. Words are runs without
    ``[\\x20\\x09-\\x0D]`` of the text with A-Z lower-cased; shingles of ``shingle`` words count as often as they occur, and a
    shorter text is one shingle. Null, empty and blank texts have fingerprint zero and link like any other.
    Result, one row per record: ``event_id``, ``fingerprint`` (16 hex digits) and ``component_id``, the smallest ``event_id``
    that can be reached over links (null only if all of a component's ids are null). Repeated rows give repeated results.
    """
    prints = map_rows(records.select("event_id", "reason"), ["reason"], {"fp": T.LongType()},
                      lambda texts: [[fingerprint(t, shingle) for t in texts]]).select("event_id", "fp")
    prints = materialize(prints, "fingerprints")
    different = materialize(prints.groupBy("fp").agg(F.min("event_id").alias("first_id")), "different-fingerprints")
    members = connected_components(fingerprint_links(different.select("fp"), radius, shard_rows))
    named = different.join(members.select(F.col("node").alias("fp"), "component"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    smallest = named.groupBy("component").agg(F.min("first_id").alias("component_id"))
    classes = named.join(smallest, "component").select("fp", "component_id")
    return prints.join(classes, "fp").select("event_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
