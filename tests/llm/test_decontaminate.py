import random

import numpy as np
import pytest
from fraudloom.llm.decontaminate import align, leaks_in, make_block, mark_leaks, runs, without_leaks, word_names


def plain_align(a, b):
    h = np.zeros((len(a) + 1, len(b) + 1), int)
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            h[i, j] = max(0, h[i - 1, j - 1] + (1 if a[i - 1] == b[j - 1] else -1), h[i - 1, j] - 1, h[i, j - 1] - 1)
    return int(h.max())


def test_alignment_equals_the_plain_table():
    rng = random.Random(1)
    for _ in range(60):
        a, b = ([rng.randrange(4) for _ in range(rng.randint(1, 25))] for _ in range(2))
        assert align(np.array(a), np.array(b))[0] == plain_align(a, b)


@pytest.fixture()
def world(prose):
    rng = random.Random(7)
    unique = lambda n: " ".join(f"{rng.choice('bcdfgklmprst')}{rng.choice('aeiou')}{rng.randrange(300)}" for _ in range(n))
    cases = [(f"c{i}", unique(rng.randint(15, 50))) for i in range(20)]

    def edited(text, share):
        words = text.split()
        for k in rng.sample(range(len(words)), int(share * len(words))):
            words[k] = rng.choice(["", "changed", words[k] + " more"])
        return " ".join(words).upper().replace(" ", ", ", 3)

    records, want = [], set()
    for i, (c, text) in enumerate(cases):
        for share in (0.0, 0.1, 0.2):
            records.append((f"e{len(records):03d}", prose(rng.randint(0, 200)) + " " + edited(text, share) + " " + prose(rng.randint(0, 100))))
            want.add((records[-1][0], c))
    records += [(f"n{i:03d}", prose(200) + " " + unique(100)) for i in range(60)]
    return records, cases, want


@pytest.mark.parametrize("block_words", [1_000_000, 20])
def test_exact_and_edited_copies_are_found_and_others_left_alone(spark, world, block_words):
    records, cases, want = world
    df, held = spark.createDataFrame(records, "event_id string, reason string"), spark.createDataFrame(cases, "case_id string, reason string")
    got = {(r.event_id, x.case_id): x.score for r in mark_leaks(df, held, block_words=block_words).collect() for x in r.leaks}
    assert set(got) == want and max(got.values()) == 1.0
    assert {r.event_id for r in without_leaks(df, held).collect()} == {i for i, _ in records if i not in {e for e, _ in want}}


def test_long_cases_short_cases_and_odd_rows(spark, prose):
    long = " ".join(f"w{i}" for i in range(2000))
    cases = [(1, long), (2, "only five words in here"), (3, None), (4, ""), (5, "only five words in here"), (None, "one more case of nine words as it is")]
    records = [("a", prose(50) + " " + " ".join(f"w{i}" for i in range(700, 920)), 1), ("b", "Only five words in HERE!", 2), ("c", "only five words", 3), ("d", None, 4), ("e", "", 5),
               (None, "one more case of nine words as it is", 6), ("b", "Only five words in HERE!", 7)]
    df = spark.createDataFrame(records, "event_id string, reason string, leaks int")
    got = sorted((r.event_id or "", [x.case_id for x in r.leaks]) for r in mark_leaks(df, spark.createDataFrame(cases, "case_id long, reason string")).collect())
    assert got == [("", [None]), ("a", [1]), ("b", [2, 5]), ("b", [2, 5]), ("c", []), ("d", []), ("e", [])]


def test_empty_tables(spark):
    one, none = spark.createDataFrame([("a", "text")], "event_id string, reason string"), spark.createDataFrame([], "event_id string, reason string")
    cases = spark.createDataFrame([("c", "text")], "case_id string, reason string")
    assert mark_leaks(none, cases).count() == 0
    assert mark_leaks(one, cases.filter("false")).first().leaks == []


def test_seeds_cover_every_run(prose):
    text = prose(60)
    block = make_block([text], 3, 200)
    assert len(block.names) == 58 and (block.seeds.find(runs(word_names(prose(5) + " " + text), 3))[0] >= 3).all()
    assert leaks_in(text, block, 0.5, 8) == [(0, 1.0, 60)]


def test_a_case_in_a_third_of_all_records_is_still_found(spark, world, prose):
    _, cases, _ = world
    half = " ".join(cases[3][1].split()[:len(cases[3][1].split()) * 3 // 4])
    rows = [(f"e{i:03d}", prose(30) + (" " + half if i % 3 == 0 else "") + " " + prose(20)) for i in range(90)]
    got = mark_leaks(spark.createDataFrame(rows, "event_id string, reason string"), spark.createDataFrame(cases, "case_id string, reason string"))
    assert {r.event_id for r in got.filter("size(leaks) > 0").collect()} == {i for i, t in rows if half in t}
