"""Repair of exchanges against all edits tried one by one."""

import hashlib
import random
import re
from functools import cache
from zlib import crc32

import pytest
from fraudloom.llm import catalogue, exchanges
from pyspark.sql import functions as F

WELL = re.compile(r"(s?(ua)+)?")
SHAPE = "user_id long, turn int, role string, content string"


def faults_of(rows):
    """(role, content, fault) of rows in order."""
    seen, out = set(), []
    for role, content in rows:
        signs = [c for c in content if c not in " \t\n\x0b\x0c\r"]
        fault = "blank" if not signs else "duplicate" if (role, content) in seen else "truncated" if signs[-1] not in ".!?" else None
        seen.add((role, content))
        out.append((role, content, fault))
    return out


def every_edit(rows):
    """All (cost, audit, repaired) with at most two insertions in a place."""
    def places(i):
        tails = [(0, "", ())]
        for n in (1, 2):
            for k in range(2 ** n):
                tails.append((3 * n, "I" * n, tuple((("user", "assistant")[k >> j & 1], "") for j in range(n))))
        if i == len(rows):
            yield from tails
            return
        role, content, fault = rows[i]
        ways = [(4, "D", ())]
        if fault not in ("blank", "duplicate"):
            more = 3 if fault == "truncated" else 0
            ways += [(more, "K", ((role, content),))] + [(3 + more, "R", ((r, content),)) for r in ("user", "assistant")]
        for a in tails:
            for b in ways:
                for c in rest(i + 1):
                    yield a[0] + b[0] + c[0], a[1] + b[1] + c[1], a[2] + b[2] + c[2]

    @cache
    def rest(i):
        return [x for x in places(i) if x[0] <= bound]

    bound = 5 * len(rows)
    return [x for x in rest(0) if WELL.fullmatch("".join(r[:1] or "?" for r, _ in x[2]))]


def brute(rows, small=True):
    marked = faults_of(rows)
    count = lambda kind: sum(f == kind for *_, f in marked)
    illegal = sum(a[:1] + b[:1] not in ("su", "ua", "au") for (a, _), (b, _) in zip(rows, rows[1:]))
    cost, audit, repaired = min(every_edit(marked))
    return count("blank"), count("duplicate"), count("truncated"), illegal, cost, audit, "\n".join(f"{r}:{c}" for r, c in repaired)


def test_same_as_all_edits(spark):
    rng, rows, order = random.Random(1), [], {}
    for user in range(150):
        mine = [(rng.choice(["system", "user", "assistant", "user", "assistant", "tool", "", None]), rng.choice(["Risk is high.", "Why?", "Because", " ", None, "Block!\n "]))
                for _ in range(rng.randrange(0, 4))]
        order[user] = [(r if r is not None else " ", c if c is not None else " ") for r, c in mine]
        rows += [(user, (None if i == 0 and user % 7 == 0 else 2 * i), r, c) for i, (r, c) in enumerate(mine)]
    rng.shuffle(rows)
    faults, repaired = exchanges.repair_exchanges(spark.createDataFrame(rows, SHAPE))
    digests = {r.user_id: r.digest for r in exchanges.exchange_digest(repaired).collect()}
    texts = {}
    for r in sorted(repaired.collect(), key=lambda r: (r.user_id, r.position)):
        texts.setdefault(r.user_id, []).append(f"{r.role}:{r.content}")
    got = {r.user_id: r for r in faults.collect()}
    assert set(got) == {u for u in order if order[u]}
    for user, r in got.items():
        want = brute(order[user])
        assert (r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, "\n".join(texts.get(user, []))) == want, order[user]
        assert digests.get(user, hashlib.sha256(b"").hexdigest()) == hashlib.sha256(want[-1].encode()).hexdigest()


def test_gaps_ties_and_odd_tables(spark):
    shape = SHAPE + ", digest int, kind string"
    rows = [(1, 3, "user", "a.", 1, "x"), (1, 7, "assistant", "b.", 1, "x"), (1, None, "system", "s.", 1, "x"), (1, 7, "assistant", "b.", 1, "x"), (None, None, None, None, 1, "x"),
            (2, 5, "user", "long words " * 100_000, 1, "x")]
    faults, repaired = exchanges.repair_exchanges(spark.createDataFrame(rows, shape))
    got = {r.user_id: r for r in faults.collect()}
    assert (got[1].gaps, got[1].duplicate, got[1].audit, got[1].cost) == (3, 1, "KKKD", 4)
    assert (got[None].gaps, got[None].blank, got[None].audit) == (0, 1, "D") and (got[2].gaps, got[2].truncated, got[2].audit) == (0, 1, "D")
    assert [(r.position, r.turn, r.role, r.edit) for r in repaired.orderBy("position").collect()] == [(0, None, "system", "K"), (1, 3, "user", "K"), (2, 7, "assistant", "K")]
    empty = exchanges.repair_exchanges(spark.createDataFrame([], shape))
    assert [x.count() for x in empty] == [0, 0]


@pytest.mark.parametrize("batch", [3, 10_000])
def test_state_crosses_batches(spark, batch):
    rows = [(1, t, ("user", "assistant")[t % 2], f"Turn {t}.") for t in range(40)] + [(1, 100 + t, "user", f"Turn {t}.") for t in (3, 4, 0)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        faults, _ = exchanges.repair_exchanges(spark.createDataFrame(rows, SHAPE))
        r = faults.first()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert (r.audit, r.cost, r.duplicate, r.gaps) == ("K" * 40 + "DKDI", 11, 2, 62)


def test_choices_beyond_memory():
    held = exchanges.Choices(spill=7)
    for i in range(50):
        held.add(i)
    assert list(held.backwards()) == list(range(49, -1, -1))
    few, many = exchanges.Exchange(1, spill=3), exchanges.Exchange(1)
    for e in (few, many):
        for turn in range(30, 0, -1):
            e.add(turn, ("user", "assistant", "tool")[turn % 3], turn % 5 == 0, turn % 4 == 0, False, 1)
    assert few.summary() == many.summary()


def test_query_against_brute_force(spark):
    """Counts, gaps and cost of every conversation; edits of the short ones."""
    folder = "/root/testdata/sf0.001"
    got = {r.conv_id: r for r in catalogue.QUERIES["op12_conversation_repair"](spark, folder).collect()}
    groups = {}
    for r in spark.read.parquet(f"{folder}/conversations.parquet").orderBy("conv_id", F.col("turn").asc_nulls_first()).collect():
        case = crc32(f"{r.conv_id}:{r.turn}".encode()) % 20
        text = "" if case == 1 else re.sub("[.!?]", "", r.text) if case == 2 else r.text
        groups.setdefault(r.conv_id, []).extend([(r.turn, "user" if case == 4 else r.role, text)] * (0 if case == 0 else 2 if case == 3 else 1))
    assert set(got) == set(groups)
    for conv, rows in groups.items():
        turns = {t for t, *_ in rows}
        assert got[conv].gaps == (max(turns) - min(turns) + 1 - len(turns) if turns else 0)
        marked = faults_of([x[1:] for x in rows])
        assert [got[conv].blank, got[conv].duplicate, got[conv].truncated] == [sum(f == k for *_, f in marked) for k in ("blank", "duplicate", "truncated")]
        if len(rows) <= 4:
            *_, cost, audit, repaired = brute([x[1:] for x in rows])
            assert (got[conv].cost, got[conv].audit, got[conv].repaired_sha256) == (cost, audit, hashlib.sha256(repaired.encode()).hexdigest())
