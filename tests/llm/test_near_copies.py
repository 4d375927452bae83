import random
import re

import corpus_pipeline as P
import numpy as np
import pytest
from fraudloom.llm import near_copies as N
from fraudloom.llm.near_copies import near_copies
from fraudloom.session import materialize


def shingles(text, k=5):
    words = re.findall(r"[^ \t\n\x0b\x0c\r]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    return {" ".join(words[i:i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def brute(rows):
    """Smallest id of each row's component, by the Jaccard similarity of all pairs."""
    sets, lead = [shingles(t) for _, t in rows], list(range(len(rows)))

    def find(i):
        while lead[i] != i:
            i = lead[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if 10 * len(a & sets[j]) >= 8 * len(a | sets[j]):
                lead[find(i)] = find(j)
    return [min(e for k, (e, _) in enumerate(rows) if find(k) == find(i)) for i in range(len(rows))]


def corpus(prose):
    rng, rows = random.Random(3), []
    for i in range(40):
        words = prose(rng.choice([6, 30, 120, 300])).split()
        for _ in range(rng.randint(1, 6)):
            w = list(words)
            for _ in range(rng.choice([0, 1, 1, 2, 3, 5])):
                w[rng.randrange(len(w))] = f"edited{rng.randrange(50)}"
            rows.append((len(rows), " ".join(w[:rng.choice([len(w), len(w) - 2])])))
    shared = prose(60)
    rows += [(1000 + i, shared + " " + prose(12)) for i in range(25)]
    return rows + [(2000, None), (2001, ""), (2002, "word"), (2003, "WORD"), (2004, "a b c d"), (2005, "a b c e")]


@pytest.mark.parametrize("share,most", [(0.02, 500), (1.0, 500), (0.02, 3), (1.0, 1)])
def test_same_as_all_pairs(spark, prose, share, most):
    rows = corpus(prose)
    got = {r.event_id: r.component_id for r in near_copies(spark.createDataFrame(rows, "event_id long, reason string"), share=share, most=most).collect()}
    assert got == dict(zip([i for i, _ in rows], brute(rows)))
    assert len(set(got.values())) < len(rows) - 20


def test_stage_keeps_one_of_each_group_of_edited_copies(spark, prose):
    rows = corpus(prose)
    out = P.drop_near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    assert sorted(r.doc_id for r in out.collect()) == sorted(set(brute(rows)))


def test_bound_is_never_below_the_overlap():
    rng = np.random.default_rng(2)
    for _ in range(300):
        n, m = rng.integers(1, 400, 2)
        pool = rng.integers(0, 1 << 63, 600, dtype=np.uint64)
        a, b = (np.unique(rng.choice(pool, k)) for k in (n, m))
        both = len(np.intersect1d(a, b))
        assert N.most_in_common(len(a), N.bit_map(a), N.bit_map(b)) >= both and N.most_in_common(len(b), N.bit_map(b), N.bit_map(a)) >= both


def test_a_passage_at_the_start_of_many_texts(spark, prose):
    """Shingles that hundreds of sets have early are split, and arrive in several Arrow batches."""
    shared, rng = prose(40), random.Random(8)
    rows = [(i, shared + " " + " ".join(f"w{rng.randrange(10**6)}" for _ in range(14))) for i in range(300)]
    rows += [(1000 + i, rows[i][1] + " more") for i in range(20)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 64)
    try:
        got = {r.event_id: r.component_id for r in near_copies(spark.createDataFrame(rows, "event_id long, reason string"), share=0.0, most=20).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == {i: i % 1000 for i, _ in rows}


def test_one_id_on_two_texts(spark, prose):
    a, b = prose(50), prose(50)
    df = spark.createDataFrame([(1, a), (1, b), (2, b + " x"), (3, a + " y"), (4, a), (4, a)], "event_id long, reason string")
    assert sorted((r.event_id, r.component_id) for r in near_copies(df).collect()) == [(1, 1), (1, 1), (2, 1), (3, 1), (4, 1), (4, 1)]


def test_fingerprints_connect_what_their_bits_connect(spark):
    """Candidates join the sets of near or equal SimHash fingerprints, and no others."""
    rng, rows = random.Random(8), []
    for i in range(12):
        fp = rng.getrandbits(63)
        rows += [(10 * i + j, fp ^ sum(1 << b for b in rng.sample(range(63), bits)), 9, i) for j, bits in enumerate([0, 0, 2, 4])]
    rows.append((999, rows[0][1], 0, -1))  # a blank text is like no other
    pairs = N._fingerprint_pairs(spark.createDataFrame(rows, "sid long, fp long, n long, family int")).collect()
    family = {r[0]: r[3] for r in rows}
    lead = {r[0]: r[0] for r in rows}

    def find(i):
        while lead[i] != i:
            i = lead[i]
        return i

    for p in pairs:
        assert family[p.src] == family[p.dst]
        lead[find(p.src)] = find(p.dst)
    assert all(len({find(s) for s in family if family[s] == i}) == 1 for i in range(12))


def test_fingerprints_take_part_in_the_stage(reasons_of, prose, monkeypatch):
    asked = []
    monkeypatch.setattr(N, "fingerprint_links", lambda prints, radius, real=N.fingerprint_links: asked.append(prints.count()) or real(prints, radius))
    rows = [(i, t) for i, t in enumerate([prose(200)] * 3 + [prose(200)] + [""])]
    df = reasons_of([(f"e{i}", t) for i, t in rows])
    got = {r.event_id: r.component_id for r in near_copies(df).collect()}
    assert got == dict(zip([f"e{i}" for i in range(5)], brute([(f"e{i}", t) for i, t in rows]))) and asked == [2]


def test_test_of_known_numbers_runs_without_python(spark):
    """It misses none of the values, errs on few others, and adds no Python worker to the stage that reads the rows."""
    rows = spark.range(3000).withColumnRenamed("id", "sid")
    marked = N._known(rows, "sid", rows.filter("sid % 100 = 0"))
    found = {r.sid for r in marked.filter("_known").collect()}
    assert {i for i in range(3000) if i % 100 == 0} <= found and len(found) < 60
    assert marked.filter("not _known").count() == 3000 - len(found) and marked.columns == ["sid", "_known"]
    assert "EvalPython" not in marked._jdf.queryExecution().executedPlan().toString()


def test_different_sets_are_told_apart_once(spark, monkeypatch):
    """The bit map of repeated sets is broadcast for the table of different sets only, not for every plan that reads it."""
    seen = []

    def watched(df, label="step"):
        seen.append((label, "_flags" in df._jdf.queryExecution().optimizedPlan().toString()))
        return materialize(df, label)

    monkeypatch.setattr(N, "materialize", watched)
    long = " ".join(f"word{i}" for i in range(60))
    rows = [(1, long), (2, long), (3, long + " more"), (4, "quite another text of a few words only"), (5, None), (6, "")]
    out = near_copies(spark.createDataFrame(rows, "event_id long, reason string"), shingle=5)
    assert sorted(tuple(r) for r in out.collect()) == [(1, 1), (2, 1), (3, 1), (4, 4), (5, 5), (6, 5)]
    assert {label for label, flagged in seen if flagged} <= {"different-sets", "alike-first-sets", "alike-rest-sets"}
