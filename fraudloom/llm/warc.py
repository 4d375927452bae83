"""WARC archives of event payloads: a writer with revisit records, and a splittable reader.

An archive is a set of ``.warc.gz`` files, one gzip member per record. The reader cuts files into byte ranges without an index:
a task looks for gzip magic in its range, takes a candidate for a member only if its WARC header decodes, the member's checksum
holds and another member or the end of the file follows, and owns exactly the records that start inside its range.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterable, Iterator
from datetime import datetime, timezone
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fraudloom.llm.common import map_rows, slices
from fraudloom.session import materialize, shared_folder

MAGIC = b"\x1f\x8b\x08"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: application/octet-stream\r\n\r\n"
RECORD = "event_id string, uri string, record_type string, payload_digest string, payload_bytes long, refers_to string, payload binary"


def payload_digest(payload: bytes) -> str:
    """Upper-case base32 of the SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _urn(event_id: str | None) -> str:
    return f"<urn:event:{quote(event_id or '', safe='')}>"


def _of_urn(value: str | None) -> str | None:
    return unquote(value[len("<urn:event:"):-1]) or None if value else None


def member(event_id, uri, ts_us, payload: bytes, digest: str, size: int, refers_to) -> bytes:
    """One record as a gzip member; a revisit repeats the payload's digest and length but not the payload."""
    when = datetime.fromtimestamp((ts_us or 0) // 1_000_000, timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    block = HTTP if refers_to is not None else HTTP + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if refers_to is not None else 'response'}", f"WARC-Record-ID: {_urn(event_id)}",
             f"WARC-Target-URI: {quote(uri or '', safe=':/?#[]@!$&()*+,;=%')}", f"WARC-Date: {when}", f"WARC-Payload-Digest: sha1:{digest}",
             f"X-Payload-Length: {size}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    if refers_to is not None:
        lines += [f"WARC-Refers-To: {_urn(refers_to)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    press = zlib.compressobj(6, zlib.DEFLATED, 31)
    return press.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + press.flush()


def write_archive(events: DataFrame, folder: str | None = None, revisit_bytes: int = 0, file_bytes: int = 64 << 20) -> DataFrame:
    """Write one record per event and return the manifest (``path``, ``bytes``, ``records``), one row per file.

    ``events``: ``event_id``, ``uri``, ``payload`` (binary) and optionally ``ts_us``; other columns are not archived. Among events
    with equal payloads of at least ``revisit_bytes`` bytes the one with the smallest ``event_id`` is a response and the others
    revisit it; shorter payloads are all responses. A null payload is empty. A null ``event_id`` cannot be referred to. Repeated
    rows of one ``event_id`` with one payload are all responses.

    Files go to ``folder``, which all executors must reach through a path that pyarrow's file systems open; by default the
    session's shared folder. A file has a name of its own for each attempt and counts only once the manifest lists it, so a
    repeated task leaves no duplicate records behind.
    """
    spark = events.sparkSession
    folder = (folder or f"{shared_folder(spark)}/fraudloom/archive-{uuid.uuid4().hex}").rstrip("/")
    ts = F.col("ts_us").cast("long") if "ts_us" in events.columns else F.lit(None).cast("long")
    rows = events.select("event_id", F.col("uri").cast("string").alias("uri"), ts.alias("ts_us"), F.coalesce("payload", F.lit(b"")).alias("payload"))
    facts = map_rows(rows, ["payload"], {"digest": T.StringType(), "size": T.LongType()},
                     lambda payloads: ([payload_digest(p) for p in payloads], [len(p) for p in payloads]))
    first = facts.groupBy("digest", "size").agg(F.min("event_id").alias("first_id"))
    again = (F.col("size") >= revisit_bytes) & (F.coalesce(F.col("event_id") != F.col("first_id"), F.col("first_id").isNotNull()))
    ready = facts.join(first, ["digest", "size"]).select(
        F.col("event_id").cast("string").alias("event_id"), "uri", "ts_us", F.when(~again, F.col("payload")).alias("payload"), "digest", "size",
        F.when(again, F.col("first_id").cast("string")).alias("refers_to"))

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = sink = path = None
        done, count = [], 0

        def close() -> None:
            done.append((path, sink.tell(), count))
            sink.close()

        for batch in batches:
            for part in slices(batch):
                for row in part.to_pylist():
                    if sink is None:
                        store, base = fs.FileSystem.from_uri(folder)
                        store.create_dir(base, recursive=True)
                        name = f"{uuid.uuid4().hex}.warc.gz"
                        path, sink, count = f"{folder}/{name}", store.open_output_stream(f"{base}/{name}", compression=None), 0
                    sink.write(member(row["event_id"], row["uri"], row["ts_us"], row["payload"] or b"", row["digest"], row["size"], row["refers_to"]))
                    count += 1
                    if sink.tell() >= file_bytes:
                        close()
                        sink = None
        if sink is not None:
            close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(list(x)) for x in zip(*done)], ["path", "bytes", "records"])

    return materialize(ready.mapInArrow(write, "path string, bytes long, records long"), "archive-manifest")


class _Window:
    """Bytes of a file from a moving position on, read in steps."""

    def __init__(self, source, start: int, step: int) -> None:
        self.source, self.step, self.at, self.data, self.ended = source, step, start, bytearray(), False
        source.seek(start)

    def need(self, size: int) -> bool:
        while len(self.data) < size and not self.ended:
            more = self.source.read(self.step)
            self.ended = not more
            self.data += more
        return len(self.data) >= size

    def skip(self, size: int) -> None:
        del self.data[:size]
        self.at += size


def _decode(window: _Window) -> tuple[bytes, int, bool] | None:
    """The record at the window's front, its length in the file, and whether another member or the end follows; None if none is valid."""
    press, out, used, checked = zlib.decompressobj(31), [], 0, False
    while not press.eof:
        if not window.need(used + 1):
            return None
        piece = window.data[used:used + (window.step if checked else 512)]
        try:
            out.append(press.decompress(piece))
        except zlib.error:
            return None
        used += len(piece)
        if not checked:
            head = b"".join(out)
            if not b"WARC/".startswith(head[:5]):
                return None
            checked = len(head) >= 5
    used -= len(press.unused_data)
    body = b"".join(out)
    if not body.startswith(b"WARC/") or b"\r\n\r\n" not in body:
        return None
    window.need(used + len(MAGIC))
    after = bytes(window.data[used:used + len(MAGIC)])
    return body, used, after == MAGIC or not after


def _stored_inside(source, at: int, step: int) -> bool:
    """Whether the member at ``at`` is part of another one's payload: an earlier member that reaches beyond it.

    Goes back from candidate to candidate until a member that ends before ``at`` and has another one right behind it.
    """
    stop = at
    while stop > 0:
        start = max(0, stop - step)
        source.seek(start)
        data = source.read(stop - start + len(MAGIC) - 1)
        found = data.rfind(MAGIC)
        while found >= 0:
            got = _decode(_Window(source, start + found, step))
            if got:
                if start + found + got[1] > at:
                    return True
                if got[2]:
                    return False
            found = data.rfind(MAGIC, 0, found + len(MAGIC) - 1)
        stop = start
    return False


def records_in(source, start: int, stop: int, step: int = 1 << 20) -> Iterator[bytes]:
    """Decoded records of the members that start in [start, stop).

    A valid header and checksum make a member. One that is not followed by another may be stored in the payload of an earlier one, which
    a range that starts behind that one's start cannot know: only then the file is read backwards.
    """
    window, known = _Window(source, start, step), start == 0  # known: nothing before reaches beyond the window's front
    while window.at < stop and window.need(len(MAGIC)):
        found = window.data.find(MAGIC)
        if found < 0:
            window.skip(len(window.data) - len(MAGIC) + 1)
            continue
        if window.at + found >= stop:
            return
        window.skip(found)
        got = _decode(window)
        if got and not got[2] and not known:
            inside = _stored_inside(source, window.at, step)
            source.seek(window.at + len(window.data))
            got, known = (None, False) if inside else (got, True)
        if got is None:
            window.skip(1)
        else:
            known = True
            yield got[0]
            window.skip(got[1])


def parse(record: bytes) -> dict:
    head, _, rest = record.partition(b"\r\n\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in head.decode(errors="replace").split("\r\n")[1:])}
    block = rest[:int(fields.get("content-length", len(rest)))]
    kind = fields.get("warc-type")
    payload = block.partition(b"\r\n\r\n")[2] if fields.get("content-type", "").startswith("application/http") else block
    revisit = kind == "revisit"
    stated = fields.get("warc-payload-digest", "").removeprefix("sha1:") or None
    return {"event_id": _of_urn(fields.get("warc-record-id")), "uri": unquote(fields.get("warc-target-uri", "")) or None, "record_type": kind,
            "payload_digest": stated if revisit else payload_digest(payload),
            "payload_bytes": int(fields["x-payload-length"]) if revisit and "x-payload-length" in fields else None if revisit else len(payload),
            "refers_to": _of_urn(fields.get("warc-refers-to")), "payload": None if revisit else payload}


def read_archive(spark: SparkSession, manifest: DataFrame, split_bytes: int = 8 << 20) -> DataFrame:
    """Records of the files in ``manifest`` (``path``, ``bytes``), read in ranges of ``split_bytes``.

    Columns: ``event_id``, ``uri`` (null if empty), ``record_type``, ``payload_digest`` and ``payload_bytes`` of the full payload (computed
    from a response's bytes, stated by a revisit), ``refers_to`` (null but for revisits), ``payload`` (null for revisits). Damaged members
    and bytes between members are skipped; a member stored in another one's payload is not a record. A file may hold any number of ranges; a range holds one record in memory at a time.
    """
    starts = F.sequence(F.lit(0), F.greatest(F.col("bytes") - 1, F.lit(0)), F.lit(split_bytes))
    ranges = manifest.filter("bytes > 0").select("path", F.explode(starts).alias("start"))
    ranges = ranges.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "path", "start")

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(*[c.to_pylist() for c in batch.columns]):
                store, base = fs.FileSystem.from_uri(path)
                held, size = [], 0
                with store.open_input_file(base) as source:
                    for record in records_in(source, start, start + split_bytes):
                        held.append(parse(record))
                        size += len(record)
                        if size > 4 << 20:
                            yield pa.RecordBatch.from_pylist(held, _SCHEMA)
                            held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_pylist(held, _SCHEMA)

    return ranges.mapInArrow(read, RECORD)


_SCHEMA = pa.schema([("event_id", pa.string()), ("uri", pa.string()), ("record_type", pa.string()), ("payload_digest", pa.string()),
                     ("payload_bytes", pa.int64()), ("refers_to", pa.string()), ("payload", pa.binary())])
