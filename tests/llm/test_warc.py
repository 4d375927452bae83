import base64
import gzip
import hashlib
import io
import random
import zlib

import pytest
from fraudloom.llm.warc import MAGIC, member, parse, payload_digest, read_archive, records_in, write_archive


def digest(b):
    return base64.b32encode(hashlib.sha1(b).digest()).decode()


ROWS = [(f"e{i:03d}", f"https://ads.example/click?i={i}&x=ä b", bytes(random.Random(i % 17).randbytes(i % 17 * 40))) for i in range(90)]
ODD = [("f0", None, None), ("f1", "", b""), ("f2", "http://x/\r\nWARC-Type: fake", b"\r\n\r\n\r\n"), ("f 3/ü", "u", MAGIC * 500), ("f4", "u", b"x" * 3_000_000),
       ("f5", "u", gzip.compress(b"WARC/1.1\r\nWARC-Type: response\r\n\r\nhidden") * 3), (None, "u", b"no id"), ("f6", "u", b"same"), ("f6", "u", b"same"), (None, "u", b"same")]
KIND = "event_id string, uri string, payload binary"


def expected(rows, least=0):
    first = {}
    for i, _, p in rows:
        if i is not None:
            first[p or b""] = min(first.get(p or b"", i), i)
    out = []
    for i, _, p in rows:
        p = p or b""
        to = first.get(p) if len(p) >= least and first.get(p) != i else None
        out.append((i, len(p), digest(p), "revisit" if to else "response", to, None if to else p))
    return sorted(out, key=str)


def got(df):
    return sorted(((r.event_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, None if r.payload is None else bytes(r.payload)) for r in df.collect()), key=str)


@pytest.mark.parametrize("split,file_bytes", [(700, 5_000), (64 << 10, 64 << 20), (8 << 20, 64 << 20)])
def test_round_trip(spark, split, file_bytes):
    rows = ROWS + ODD
    manifest = write_archive(spark.createDataFrame(rows, KIND).repartition(3), file_bytes=file_bytes)
    assert got(read_archive(spark, manifest, split)) == expected(rows)


def test_short_payloads_do_not_revisit_and_files_are_plain_gzip(spark):
    manifest = write_archive(spark.createDataFrame(ROWS, KIND), revisit_bytes=200)
    assert got(read_archive(spark, manifest)) == expected(ROWS, 200)
    names = [r.path.removeprefix("file://") for r in manifest.collect()]
    assert sum(gzip.open(n).read().count(b"WARC/1.1\r\n") for n in names) == len(ROWS)


def test_every_cut_finds_each_record_once():
    records = [member(str(i), "u", 0, random.Random(i).randbytes(60), "d", 60, None) for i in range(12)]
    data = b"".join(records)
    for size in (1, 7, 100, 333, len(data)):
        found = [parse(r)["event_id"] for a in range(0, len(data), size) for r in records_in(io.BytesIO(data), a, a + size, step=64)]
        assert found == [str(i) for i in range(12)]


def test_damage_costs_only_the_damaged_records():
    records = [member(str(i), "u", 0, random.Random(i).randbytes(300), "d", 300, None) for i in range(6)]
    broken = bytearray(records[2])
    broken[60] ^= 0xFF
    data = records[0] + records[1] + bytes(broken) + records[3] + b"garbage" + records[4] + records[5][:-20]
    found = [parse(r)["event_id"] for r in records_in(io.BytesIO(data), 0, len(data))]
    assert found == ["0", "1", "4"] or found == ["0", "1", "3", "4"]


def test_a_stored_member_inside_a_payload_is_not_a_record():
    inner = member("inner", "u", 0, b"abc", "d", 3, None)
    press = zlib.compressobj(0, zlib.DEFLATED, 31)  # stored, so the inner bytes appear as they are
    outer = press.compress(b"WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:event:outer>\r\nContent-Length: " + str(len(inner)).encode() + b"\r\n\r\n" + inner + b"\r\n\r\n") + press.flush()
    for start in range(0, len(outer), 5):
        assert all(parse(r)["event_id"] == "outer" for r in records_in(io.BytesIO(outer), start, len(outer)))


def test_bytes_between_members_cost_no_record():
    """Zero bytes behind the second of three members, whatever the range and the step."""
    parts = [member(f"e{i}", "u", 0, bytes([65 + i]) * 300, "d", 300, None) for i in range(3)]
    data = parts[0] + parts[1] + bytes(16) + parts[2] + bytes(5)
    for split in (1, 7, 100, len(parts[0]) + 3, len(data)):
        got = [parse(r)["event_id"] for start in range(0, len(data), split) for r in records_in(io.BytesIO(data), start, start + split, 64)]
        assert got == ["e0", "e1", "e2"], split


def test_a_stored_member_is_found_out_from_every_range():
    inner = member("inner", "u", 0, b"abc", "d", 3, None)
    press = zlib.compressobj(0, zlib.DEFLATED, 31)
    head = b"WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:event:outer>\r\nContent-Length: "
    outer = press.compress(head + str(len(inner) * 2 + 7).encode() + b"\r\n\r\n" + inner + bytes(7) + inner + b"\r\n\r\n") + press.flush()
    data = member("first", "u", 0, b"x", "d", 1, None) + outer + bytes(9) + member("last", "u", 0, b"y", "d", 1, None)
    for split in (1, 5, 64, len(data)):
        got = [parse(r)["event_id"] for start in range(0, len(data), split) for r in records_in(io.BytesIO(data), start, start + split, 32)]
        assert len(got) == 3 and (got[0], got[2]) == ("first", "last") and "inner" not in got, split


def test_very_long_record_is_read_in_steps():
    import time
    payload, started = random.Random(1).randbytes(64 << 20), time.time()
    data = member("long", "u", 0, payload, "d", len(payload), None)
    assert [parse(r)["payload"] == payload for r in records_in(io.BytesIO(data), 0, 100)] == [True]
    assert time.time() - started < 60


def test_empty_table_extra_columns_and_times(spark):
    assert read_archive(spark, write_archive(spark.createDataFrame([], KIND))).count() == 0
    df = spark.createDataFrame([(7, "u", b"x", 1_700_000_000_000_000, "d", 3)], "event_id long, uri string, payload binary, ts_us long, digest string, size int")
    assert [r.event_id for r in read_archive(spark, write_archive(df)).collect()] == ["7"]
    assert payload_digest(b"") == "3I42H3S6NNFQ2MSVX7XZKYAYSCX5QBYJ"
