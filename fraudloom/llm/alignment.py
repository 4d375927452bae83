"""Two tokenizers' views of the same reasons: where their tokens end together, and how often pairs of tokens do.

Records are numbered in containers of at most 65,536. Every pair of token ids that ends together somewhere in a container gets one
posting: compressed bitmaps over the container's records, one for each binary digit of the number of links (multiplicity planes).
OR-merging the planes and counting bits gives the records that hold the pair; bits weighted by their plane give its links. A pair's
postings are added up over all containers, and each posting takes its pair's score back to the records whose bits it holds. No
pair has more than one posting in a container, so no pair is a hot key.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fraudloom.llm.bpe import byte_letters
from fraudloom.llm.common import pack, slices, unpack
from fraudloom.session import materialize

CONTAINER = 1 << 16  # records, at most
CONTAINER_LINKS = 4_000_000  # links after which a container ends
#: Fixed value: how byte-level vocabularies cut text before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
COUNTS = ("n_a", "n_b", "n_groups", "n_links")
SCORES = ("n_best", "count_sum")


class Tokenizers:
    """A byte-level vocabulary (A) and a piece model (B) that see the same bytes: a space and the text."""

    def __init__(self, spec_a: bytes, model_b: bytes) -> None:
        spec = json.loads(spec_a)
        back = {letter: b for b, letter in enumerate(byte_letters())}
        ranks = {bytes(back[c] for c in token): i for token, i in spec["model"]["vocab"].items()
                 if not any(token == t["content"] for t in spec["added_tokens"])}
        self.a = tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})  # ids rise with the rank of merges
        self.b = sentencepiece.SentencePieceProcessor(model_proto=model_b)
        self.bytes_a: list[bytes] = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            self.bytes_a[i] = token
        pieces = [(self.b.id_to_piece(i), self.b.is_byte(i)) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if is_byte else p.replace("▁", " ").encode() for p, is_byte in pieces]
        self.sizes = [np.array([len(x) for x in names], np.int64) for names in (self.bytes_a, self.bytes_b)]
        # An id and what stands behind it: A has "," inside a group and "|" at its end, B has "," and ";".
        self.shown = [f"{i}{sign}" for names, signs in ((self.bytes_a, ",|"), (self.bytes_b, ",;")) for i in range(len(names)) for sign in signs]

    def tokens(self, text: str | None) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of A and B, or none if there is no text or their bytes are not those of the text."""
        if not text:
            return None
        whole = " " + text
        a, b, data = self.a.encode_ordinary(whole), self.b.encode(text, num_threads=1), whole.encode()
        if b"".join(map(self.bytes_a.__getitem__, a)) != data or b"".join(map(self.bytes_b.__getitem__, b)) != data:
            return None
        return np.array(a, np.int64), np.array(b, np.int64)

    def cuts(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which tokens of A, and which of B, end where one of the other ends."""
        end_a, end_b = np.cumsum(self.sizes[0][a]), np.cumsum(self.sizes[1][b])
        at = np.searchsorted(end_a, end_b)  # both end at the text's end
        cut_b = end_a[at] == end_b
        cut_a = np.zeros(len(a), bool)
        cut_a[at[cut_b]] = True
        return cut_a, cut_b

    def groups(self, a: np.ndarray, b: np.ndarray, cut_a: np.ndarray, cut_b: np.ndarray) -> str:
        """``a1,a2|b1;a3|b2,b3``: ids between the cuts."""
        until_a, until_b = np.flatnonzero(cut_a) + 1, np.flatnonzero(cut_b) + 1
        group_a, group_b = np.cumsum(cut_a) - cut_a, np.cumsum(cut_b) - cut_b
        out = np.empty(len(a) + len(b), np.int64)
        out[np.arange(len(a)) + np.concatenate([[0], until_b])[group_a]] = 2 * a + cut_a
        out[np.arange(len(b)) + until_a[group_b]] = 2 * (len(self.bytes_a) + b) + cut_b
        return "".join(map(self.shown.__getitem__, out.tolist()))[:-1]


_LOADED: dict[tuple[str, str], Tokenizers] = {}


def _shared(df: DataFrame, vocabulary_a: str, model_b: str):
    """Loader for tasks; the two files, some megabytes whatever the records, are broadcast."""
    specs = []
    for path in (vocabulary_a, model_b):
        with open(path, "rb") as file:
            specs.append(file.read())
    sent = df.sparkSession.sparkContext.broadcast(tuple(specs))

    def load() -> Tokenizers:
        key = (vocabulary_a, model_b)
        if key not in _LOADED:
            _LOADED[key] = Tokenizers(*sent.value)
        return _LOADED[key]

    return load


def compress(spots: np.ndarray, size: int) -> bytes:
    """A bitmap of ``size`` bits with the bits ``spots`` (ascending): the bits themselves, or a list of 16-bit spots if that is shorter."""
    if 16 * len(spots) < size:
        return b"\0" + spots.astype("<u2").tobytes()
    bits = np.zeros(-(-size // 8) * 8, bool)
    bits[spots] = True
    return b"\1" + np.packbits(bits, bitorder="little").tobytes()


def expand(data: bytes) -> np.ndarray:
    """Bits of a compressed bitmap, ascending."""
    body = np.frombuffer(data, np.uint8, offset=1)
    return body.view("<u2").astype(np.int64) if data[0] == 0 else np.flatnonzero(np.unpackbits(body, bitorder="little"))


def postings(links: np.ndarray, size: int) -> list[tuple[int, int, int, list[bytes]]]:
    """(pair, records, links, planes) of a container of ``size`` records; ``links``: pair << 16 | record, any order and often."""
    links, times = np.unique(links, return_counts=True)
    pair, spot = links >> 16, links & 0xFFFF
    edges = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1], [True]])) if len(pair) else np.zeros(1, np.int64)
    out = []
    for start, stop in zip(edges[:-1].tolist(), edges[1:].tolist()):
        mine, n = spot[start:stop], times[start:stop]
        planes = [compress(mine[n >> k & 1 == 1], size) for k in range(int(n.max()).bit_length())]
        out.append((int(pair[start]), stop - start, int(n.sum()), planes))
    return out


def counted(planes: list[bytes], size: int) -> tuple[int, int]:
    """Records and links of a posting: bits of the merged planes, and bits weighted by their plane."""
    merged, links = np.zeros(size, bool), 0
    for k, plane in enumerate(planes):
        spots = expand(plane)
        merged[spots] = True
        links += len(spots) << k
    return int(np.count_nonzero(merged)), links


def _token_rows(records: DataFrame, load) -> DataFrame:
    """Records (kind 1) and postings (kind 0), each with its container."""
    made = T.StructType([
        T.StructField("container", T.LongType()), T.StructField("kind", T.IntegerType()), T.StructField("spot", T.LongType()),
        *[T.StructField(c, T.LongType()) for c in COUNTS], T.StructField("groups_sha256", T.StringType()), T.StructField("pair", T.LongType()),
        T.StructField("records", T.LongType()), T.StructField("links", T.LongType()), T.StructField("planes", T.ArrayType(T.BinaryType()))])
    passed = [f for f in records.schema.fields if f.name != "reason"]
    names = [f.name for f in passed]
    from pyspark.sql.pandas.types import to_arrow_type
    kinds = {f.name: to_arrow_type(f.dataType) for f in made.fields}

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizers, number, spot, held, size = load(), 0, 0, [], 0
        first = TaskContext.get().partitionId() << 32

        def batch(columns: dict, n: int, given: pa.RecordBatch | None, types: dict) -> pa.RecordBatch:
            own = [given.column(c) if given else pa.nulls(n, types[c]) for c in names]
            return pa.RecordBatch.from_arrays(own + [pa.array(columns[c], k) if c in columns else pa.nulls(n, k) for c, k in kinds.items()], names + list(kinds))

        def close(types: dict) -> Iterator[pa.RecordBatch]:
            links = np.concatenate([*held, np.zeros(0, np.int64)])
            found = postings(links, spot)
            for at in range(0, len(found), 10_000):
                part = found[at:at + 10_000]
                columns = dict(zip(("pair", "records", "links", "planes"), zip(*part)))
                yield batch(columns | {"container": [first + number] * len(part), "kind": [0] * len(part)}, len(part), None, types)

        types: dict = {}
        for given in batches:
            for part in slices(given):
                types = {c: part.column(c).type for c in names}
                done: list[tuple] = []
                start = 0
                for i, text in enumerate(part.column("reason").to_pylist()):
                    row = (first + number, 1, spot, 0, 0, 0, 0, "")
                    if (ids := tokenizers.tokens(text)) is not None:
                        a, b = ids
                        cut_a, cut_b = tokenizers.cuts(a, b)
                        held.append((a[cut_a] << 32 | b[cut_b] << 16) | spot)
                        size += len(held[-1])
                        digest = hashlib.sha256(tokenizers.groups(a, b, cut_a, cut_b).encode()).hexdigest()
                        row = (*row[:3], len(a), len(b), len(held[-1]), len(held[-1]), digest)
                    done.append(row)
                    spot += 1
                    if spot == CONTAINER or size >= CONTAINER_LINKS:
                        columns = dict(zip(("container", "kind", "spot", *COUNTS, "groups_sha256"), zip(*done)))
                        yield batch(columns, len(done), part.slice(start, len(done)), types)
                        yield from close(types)
                        done, start, number, spot, held, size = [], i + 1, number + 1, 0, [], 0
                if done:
                    columns = dict(zip(("container", "kind", "spot", *COUNTS, "groups_sha256"), zip(*done)))
                    yield batch(columns, len(done), part.slice(start, len(done)), types)
        if spot:
            yield from close(types)

    return records.mapInArrow(run, T.StructType([T.StructField(f.name, f.dataType) for f in passed] + made.fields))


def pair_scores(rows: DataFrame) -> DataFrame:
    """(``pair``, ``count``, ``records``, ``best``) from postings: links and records of a pair of ids, and whether its B id has no pair with more."""
    totals = rows.filter("kind = 0").groupBy("pair").agg(F.sum("links").alias("count"), F.sum("records").alias("records"))
    totals = totals.withColumn("b", F.col("pair").bitwiseAND(0xFFFF))
    most = totals.groupBy("b").agg(F.max("count").alias("most"))
    return totals.join(most, "b").select("pair", "count", "records", (F.col("count") == F.col("most")).alias("best"))


def _with_scores(rows: DataFrame, scores: DataFrame) -> DataFrame:
    """Records with ``n_best`` and ``count_sum``: each posting's score goes to the records whose bits it holds."""
    plain = [f for f in rows.schema.fields if f.name not in ("kind", "pair", "records", "links", "planes")]
    back = rows.filter("kind = 0").select("container", "pair", "planes").join(scores.select("pair", "count", "best"), "pair")
    back = back.select("container", F.lit(0).alias("kind"), "planes", "count", "best", F.lit(None).cast(T.StructType(plain)).alias("record"))
    own = rows.filter("kind = 1").select("container", F.lit(1).alias("kind"), F.lit(None).cast("array<binary>").alias("planes"), F.lit(None).cast("long").alias("count"),
                                         F.lit(None).cast("boolean").alias("best"), F.struct(*[f"`{f.name}`" for f in plain]).alias("record"), F.col("spot").alias("at"))
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    both = back.withColumn("at", F.lit(None).cast("long")).unionByName(own).repartition(n, "container").sortWithinPartitions("container", "kind")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, totals, bests = None, None, None
        for given in batches:
            for part in slices(given):
                of, own = part.column("container").to_numpy(), part.column("kind").to_numpy() == 1
                best, total = np.zeros(part.num_rows, np.int64), np.zeros(part.num_rows, np.int64)
                edges = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1], [True]])) if len(of) else np.zeros(1, np.int64)
                for start, stop in zip(edges[:-1].tolist(), edges[1:].tolist()):
                    if of[start] != at:
                        at, totals, bests = of[start], np.zeros(CONTAINER, np.int64), np.zeros(CONTAINER, np.int64)
                    middle = start + int(np.count_nonzero(~own[start:stop]))  # postings come before records
                    mine = part.slice(start, middle - start)
                    for planes, count, is_best in zip(*[mine.column(c).to_pylist() for c in ("planes", "count", "best")]):
                        for k, plane in enumerate(planes):
                            spots = expand(plane)
                            totals[spots] += count << k
                            if is_best:
                                bests[spots] += 1 << k
                    spots = part.column("at").slice(middle, stop - middle).to_numpy()
                    best[middle:stop], total[middle:stop] = bests[spots], totals[spots]
                keep = pa.array(own)
                yield pa.RecordBatch.from_arrays([part.column("record"), pa.array(best), pa.array(total)], ["record", *SCORES]).filter(keep)

    schema = T.StructType([T.StructField("record", T.StructType(plain)), *[T.StructField(c, T.LongType()) for c in SCORES]])
    done = both.select("container", "kind", "planes", "count", "best", "at", "record").mapInArrow(run, schema)
    return done.select("record.*", *SCORES)


def align_reasons(records: DataFrame, vocabulary_a: str, model_b: str) -> tuple[DataFrame, DataFrame]:
    """How the tokens of two vocabularies line up in every ``reason``, and how often pairs of tokens do in all of them.

    ``records``: ``reason``; all other columns (``event_id``, ``title``, ...) pass through, ``reason`` does not. ``vocabulary_a`` is the path
    of a byte-level vocabulary file, which encodes a space and the text; ``model_b`` that of a piece model with byte fallback, which
    adds the space itself. Strings of special tokens in a text are plain text. A text is cut where a token of both ends at the same
    byte; the two tokens that end there are linked.

    Result: the records with ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``n_best`` (links whose pair is the most frequent of its B id, ties
    included), ``count_sum`` (frequencies of the pairs, over links) and ``groups_sha256`` (lowercase hex of ``a1,a2|b1;a3|b2,b3``: ids by
    group); and the pairs with ``a``, ``b``, ``count`` (links in all records), ``records`` that hold the pair, and ``best``.

    Null and empty texts, and those whose tokens do not give their bytes back, have no tokens: zeros and an empty digest. Texts are
    taken whole. Repeated rows count and are returned as often as they come; an empty table gives empty results. Input columns with
    a result's name are replaced.
    """
    made = [*COUNTS, *SCORES, "groups_sha256"]
    packed = pack(records, "reason")
    rows = materialize(_token_rows(packed, _shared(records, vocabulary_a, model_b)), "token-postings")
    scores = materialize(pair_scores(rows), "pair-scores")
    aligned = unpack(_with_scores(rows, scores), records, made, ("reason",))
    pairs = scores.select(F.shiftright("pair", 16).alias("a"), F.col("pair").bitwiseAND(0xFFFF).alias("b"), "count", "records", "best")
    return aligned, pairs
