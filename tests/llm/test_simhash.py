import random

import pytest
import xxhash
from fraudloom.llm.common import LOWER
from fraudloom.llm.simhash import BKTree, fingerprint, fingerprint_links, near_duplicates


def plain_print(text, k=4):
    words = (text or "").encode().translate(LOWER).decode().split(" ")
    words = [w for w in (text or "").encode().translate(LOWER).split() if w]
    if not words:
        return 0
    grams = [b" ".join(words[i:i + k]) for i in range(max(1, len(words) - k + 1))]
    h = [xxhash.xxh64_intdigest(g, seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(prints, ids, radius=4):
    lead = {p: p for p in prints}

    def find(p):
        while lead[p] != p:
            p = lead[p]
        return p

    ps = sorted(set(prints))
    for i, a in enumerate(ps):
        for b in ps[i + 1:]:
            if (a ^ b).bit_count() <= radius:
                lead[find(a)] = find(b)
    return [min(j for q, j in zip(prints, ids) if find(q) == find(p)) for p in prints]


def test_fingerprint(prose):
    for text in [None, "", " \t\n", "One", "one TWO three", prose(4), prose(500), "ä b c d E f", prose(3) + "\x0b\x0c" + prose(9)]:
        assert fingerprint(text, 4) & 0xFFFFFFFFFFFFFFFF == plain_print(text)


def test_same_as_brute_force(reasons_of, prose):
    rng, rows = random.Random(2), []
    for i in range(30):
        words = prose(150).split()
        for j in range(rng.randint(1, 6)):
            w = list(words)
            for _ in range(rng.choice([0, 0, 1, 2])):
                w[rng.randrange(len(w))] = "edited"
            rows.append((f"e{len(rows):03d}", " ".join(w)))
    rows += [("e900", None), ("e901", ""), ("e902", "  \n"), ("e903", "word"), ("e904", "word"), ("e904", "word"), ("e905", "word " * 50_000)]
    want = components([plain_print(t) for _, t in rows], [i for i, _ in rows])
    got = near_duplicates(reasons_of(rows)).collect()
    assert sorted(tuple(r) for r in got) == sorted((i, f"{plain_print(t):016x}", c) for (i, t), c in zip(rows, want))
    again = near_duplicates(reasons_of(rows), shard_rows=3).collect()
    assert sorted(tuple(r) for r in again) == sorted(tuple(r) for r in got)


def test_bk_tree_finds_all_within_the_radius():
    rng = random.Random(1)
    values = [rng.getrandbits(12) for _ in range(400)]
    tree = BKTree()
    for i, v in enumerate(values):
        tree.add(v, i)
    for v in values[:50]:
        assert sorted(tree.within(v, 4)) == [i for i, w in enumerate(values) if (v ^ w).bit_count() <= 4]


def test_links_keep_chains_and_no_pair_beyond_the_radius(spark):
    chain = [sum(0b11 << (2 * j) for j in range(i)) for i in range(20)]  # neighbours differ in 2 bits, ends in 38
    df = spark.createDataFrame([(v,) for v in chain + [-1]], "fp long")
    links = [(r.src, r.dst) for r in fingerprint_links(df, shard_rows=4).collect()]
    assert all(((a ^ b) & 0xFFFFFFFFFFFFFFFF).bit_count() <= 4 for a, b in links)
    seen, todo = {0}, [0]
    while todo:
        x = todo.pop()
        for a, b in links:
            for p, q in ((a, b), (b, a)):
                if p == x and q not in seen:
                    seen.add(q)
                    todo.append(q)
    assert seen == set(chain)


@pytest.mark.parametrize("kind", ["string", "long"])
def test_empty_table_null_ids_and_extra_columns(spark, reasons_of, kind):
    assert near_duplicates(reasons_of([], kind)).count() == 0
    df = reasons_of([(None, "same words here", 1), (None, "same words here", 2)], kind, ", fp int")
    assert [r.component_id for r in near_duplicates(df).collect()] == [None, None]
