"""Tokens against the public library, for text as it comes and for odd text."""

import random
import unicodedata

import numpy as np
import public_tokenizers
import pytest
from fraudloom.llm import bpe
from pyspark.sql import functions as F
from tokenizers import Tokenizer

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def both():
    with open(PATH, "rb") as file:
        return bpe.WordBPE(file.read()), Tokenizer.from_file(PATH)


def ids(mine, text):
    return np.frombuffer(mine.encode(text), "<u4").tolist()


def test_random_texts(both):
    mine, public = both
    rng = random.Random(2)
    parts = ["click", "Device", "'S", "'ll", "ring", "42", "<|endoftext|>", "<|startoftext|>", "<|END", "ß", "Σ", "ΟΣ", "İ", "é", "漢字", "🙂", "\x1c", "\x85", "　", " ", "\n\t", "...", "-", "#", "x" * 40, "</w>", "​"]
    for _ in range(2000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(40)))
        assert ids(mine, text) == public.encode(text, add_special_tokens=False).ids, repr(text)


def test_every_assigned_character(both):
    """All characters that this Python knows; those newer than its Unicode tables may be taken for signs."""
    mine, public = both
    known = [chr(c) for c in range(0x30000) if unicodedata.category(chr(c)) not in ("Cs", "Cn")]
    texts = ["a" + "b".join(known[i:i + 50]) for i in range(0, len(known), 50)]
    newer = sum(e.ids != ids(mine, t) for t, e in zip(texts, public.encode_batch(texts, add_special_tokens=False)))
    assert newer <= 2


def test_long_words_join_in_the_same_order(both):
    mine, public = both
    rng = random.Random(4)
    for n in (1, bpe.LONG - 1, bpe.LONG, bpe.LONG + 1, 5000):
        word = "".join(rng.choice("abcdeinth") for _ in range(n))
        assert ids(mine, word) == public.encode(word, add_special_tokens=False).ids
    text = ("of campaigns " * 200_000)[: bpe.BLOCK * 2 + 17]
    assert ids(mine, text) == public.encode(text, add_special_tokens=False).ids


def test_records_of_the_engine(spark, both):
    _, public = both
    rows = [("evt_1", "User made 45 clicks in 1 minute.", 7, "x"), ("evt_2", None, 7, None), ("evt_3", "", 7, "x"), (None, "User made 45 clicks in 1 minute.", 7, "x"),
            ("evt_4", "Shared device DS1 " * 30_000, None, "x"), ("evt_1", "User made 45 clicks in 1 minute.", 7, "x")]
    df = spark.createDataFrame(rows, "event_id string, reason string, token_ids int, decoded string")
    out = bpe.decode_tokens(bpe.encode_reasons(df, PATH), PATH)
    assert sorted(out.columns) == ["decoded", "event_id", "n_tokens", "reason", "token_ids"]
    got = out.collect()
    for r in got:
        want = public.encode(r.reason or "", add_special_tokens=False).ids
        assert np.frombuffer(r.token_ids, "<u4").tolist() == want and r.n_tokens == len(want)
        assert r.decoded == public.decode(want, skip_special_tokens=False)
    assert len(got) == len(rows)
    assert bpe.encode_reasons(df.filter("false"), PATH).count() == 0


def test_ids_outside_the_vocabulary_and_null(spark, both):
    df = spark.createDataFrame([(None,), (b"",), (np.array([320, 10**6, 49407], "<u4").tobytes(),)], "token_ids binary")
    _, public = both
    assert [r.decoded for r in bpe.decode_tokens(df, PATH).collect()] == [None, "", public.decode([320, 49407], skip_special_tokens=False)]


def test_query_matches_the_library(spark, both):
    import hashlib

    from fraudloom.llm.catalogue import QUERIES
    _, public = both
    folder = "/root/testdata/sf0.001"
    got = {r.doc_id: r for r in QUERIES["op11_bpe"](spark, folder).collect()}
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text")).collect()
    assert len(got) == len(docs)
    for r in docs:
        want = public.encode(r.text, add_special_tokens=False).ids
        assert got[r.doc_id].n_tokens == len(want) and got[r.doc_id].ids_sha256 == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()
        assert got[r.doc_id].decoded_sha256 == hashlib.sha256(public.decode(want, skip_special_tokens=False).encode()).hexdigest()
