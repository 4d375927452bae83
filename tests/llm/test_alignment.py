"""Alignment against the public libraries and plain counting."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from fraudloom.llm import alignment, catalogue
from tokenizers import Tokenizer

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def public():
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B)


@pytest.fixture(scope="module")
def mine():
    with open(A, "rb") as a, open(B, "rb") as b:
        return alignment.Tokenizers(a.read(), b.read())


def brute(public, texts):
    """Rows of the contract from both libraries, by dictionaries."""
    a_of, b_of = public
    letters = {c: b for b, c in enumerate(alignment.byte_letters())}
    docs = []
    for text in texts:
        docs.append(([], [], [], []))
        if not text:
            continue
        a, b = a_of.encode(" " + text, add_special_tokens=False).ids, b_of.encode(text)
        in_a = [bytes(letters[c] for c in a_of.id_to_token(i)) for i in a]
        in_b = [bytes([int(b_of.id_to_piece(i)[3:5], 16)]) if b_of.is_byte(i) else b_of.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if b"".join(in_a) != (" " + text).encode() or b"".join(in_b) != (" " + text).encode():
            continue
        ends = [np.cumsum([len(x) for x in names]).tolist() for names in (in_a, in_b)]
        both = sorted(set(ends[0]) & set(ends[1]))
        links = [(a[ends[0].index(e)], b[ends[1].index(e)]) for e in both]
        groups = ";".join("|".join(",".join(str(i) for i, e in zip(ids, at) if low < e <= high) for ids, at in zip((a, b), ends)) for low, high in zip([0, *both], both))
        docs[-1] = (a, b, links, groups)
    count = Counter(x for d in docs for x in d[2])
    most = {}
    for (_, b), n in count.items():
        most[b] = max(n, most.get(b, 0))
    return [(len(a), len(b), len(links), len(links), sum(count[x] == most[x[1]] for x in links), sum(count[x] for x in links),
             hashlib.sha256(groups.encode()).hexdigest() if links else "") for a, b, links, groups in docs], count


TEXTS = ["User made 45 clicks in 1 minute.", "", None, " x", "a  b\n\nc", "<|endoftext|></s>", "naïve café 漢字🙂", "▁", "a▁b", "\0\x01", "User made 45 clicks in 1 minute.", "Device DS1\tshared", "   ", "<0x41>"]


def test_same_as_counting(spark, public):
    rng = random.Random(3)
    texts = TEXTS + [" ".join(rng.choice(["click", "ring", "9.9.9.9", "é", "  ", "device-farm", "\n"]) for _ in range(rng.randrange(60))) for _ in range(60)]
    shape = "event_id string, reason string, pair int, spot string, n_a string, container int, title string"
    rows = [(f"evt_{i}", t, 5, "s", "n", 1, None) for i, t in enumerate(texts)]
    for parts, container in ((1, 1 << 16), (3, 7)):
        held, alignment.CONTAINER = alignment.CONTAINER, container
        try:
            out, pairs = alignment.align_reasons(spark.createDataFrame(rows, shape).repartition(parts), A, B)
            assert sorted(out.columns) == sorted(["event_id", "pair", "spot", "container", "title", *alignment.COUNTS, *alignment.SCORES, "groups_sha256"])
            got = {r.event_id: r for r in out.collect()}
            counts = {(r.a, r.b): r["count"] for r in pairs.collect()}
        finally:
            alignment.CONTAINER = held
        want, count = brute(public, texts)
        assert counts == count
        for i, w in enumerate(want):
            r = got[f"evt_{i}"]
            assert (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) == w, texts[i]
            assert (r.pair, r.spot, r.container) == (5, "s", 1)


def test_repeated_null_and_empty(spark):
    df = spark.createDataFrame([(None, None), ("e", "one text"), ("e", "one text")], "event_id string, reason string")
    out, pairs = alignment.align_reasons(df, A, B)
    assert sorted((r.n_a > 0, r.count_sum == 2 * r.n_links) for r in out.collect()) == [(False, True), (True, True), (True, True)]
    assert all(r["records"] == 2 and r["count"] >= 2 for r in pairs.collect())
    assert [x.count() for x in alignment.align_reasons(df.filter("false"), A, B)] == [0, 0]


def test_same_tokens_as_the_library_for_odd_text(mine, public):
    rng = random.Random(5)
    parts = ["'s", "’", "\x1c", "\x85", "　", "\t", "  ", "١٢", "x" * 30, "ǅ", "<|endoftext|>", "🙂", "́", "a", "\r\n", "​"]
    for _ in range(1500):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(1, 25)))
        got = mine.a.encode_ordinary(" " + text)
        assert got == public[0].encode(" " + text, add_special_tokens=False).ids, repr(text)


def test_very_long_runs(mine):
    for text in ("a" * 300_000, " " * 300_000, "ab " * 200_000):
        assert mine.tokens(text) is not None


def test_bitmaps_and_postings():
    rng = np.random.default_rng(1)
    for size in (1, 9, 1000, 1 << 16):
        for n in (1, size // 20, size):
            spots = np.sort(rng.choice(size, min(max(n, 1), size), replace=False))
            assert alignment.expand(alignment.compress(spots, size)).tolist() == spots.tolist()
    links = [(int(p) << 16) | int(s) for p, s in zip(rng.integers(0, 5, 4000), rng.integers(0, 300, 4000))]
    for pair, records, n, planes in alignment.postings(np.array(links), 300):
        held = [x & 0xFFFF for x in links if x >> 16 == pair]
        assert (records, n) == (len(set(held)), len(held)) == alignment.counted(planes, 300)


def test_query_on_all_documents(spark, public):
    folder = "/root/testdata/sf0.001"
    got = {r.doc_id: r for r in catalogue.QUERIES["op13_token_alignment"](spark, folder).collect()}
    docs = spark.read.parquet(f"{folder}/documents.parquet").orderBy("doc_id").collect()
    docs = [r for r in docs]
    want, _ = brute(public, [r.text if len(r.text) < 4000 else None for r in docs])
    for r, w in zip(docs, want):
        g = got[r.doc_id]
        if len(r.text) < 4000:
            assert (g.n_a, g.n_b, g.n_groups, g.n_links, g.groups_sha256) == (*w[:4], w[6])
    assert len(got) == len(docs)
