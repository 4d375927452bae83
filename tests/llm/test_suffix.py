import random

import pytest
from fraudloom.llm import suffix
from fraudloom.llm.suffix import remove_repeats


def brute(rows, length=100):
    seen, out = set(), []
    for i, text in rows:
        data = (text or "").encode()
        covered = [False] * len(data)
        for p in range(len(data) - length + 1):
            piece = data[p:p + length]
            if piece in seen:
                covered[p:p + length] = [True] * length
            seen.add(piece)
        runs = sum(c and not (k and covered[k - 1]) for k, c in enumerate(covered))
        out.append((i, bytes(b for b, c in zip(data, covered) if not c), len(data), sum(covered), runs))
    return out


def got(df, **options):
    return sorted((r.event_id, bytes(r.kept), r.n_bytes, r.n_removed, r.n_spans) for r in remove_repeats(df, **options).collect())


@pytest.fixture()
def corpus(prose):
    rng, rows = random.Random(3), []
    for _ in range(12):
        text = prose(80)
        for _ in range(rng.randint(1, 5)):
            w = text.split()
            for _ in range(rng.randint(0, 4)):
                w[rng.randrange(len(w))] = rng.choice(["äöü", "edited", "x", ""])
            rows.append(" ".join(w))
    common = prose(12)
    rows += [prose(9) + common + prose(9) for _ in range(20)] + ["ab" * 300, "ab" * 300, "a" * 450, "x" + "a" * 120, prose(40) * 3, "ü" * 200]
    rows += ["q" * 99, "q" * 100, "q" * 100, "", "short"]
    return [(f"e{i:04d}", t) for i, t in enumerate(rows)]


@pytest.mark.parametrize("small", [False, True])
@pytest.mark.parametrize("length", [100, 64, 128])
def test_same_as_brute_force(reasons_of, corpus, monkeypatch, small, length):
    if small:  # rounds that send often, spread hot seeds and cut long texts
        for name, value in (("FLUSH", 40), ("SPREAD", 1), ("TOGETHER", 500), ("PIECE", 150)):
            monkeypatch.setattr(suffix, name, value)
    assert got(reasons_of(corpus), length=length) == brute(corpus, length)


def test_whole_copies_and_integer_ids(reasons_of, prose):
    text = prose(60)
    rows = [(30, text), (4, text), (17, text)]
    assert got(reasons_of(rows, "long")) == brute(sorted(rows))


def test_nulls_repeated_ids_empty_table_and_extra_columns(spark, reasons_of, prose):
    assert remove_repeats(reasons_of([], "long")).count() == 0
    text, other = prose(50), prose(50)
    df = reasons_of([(1, text, 5, "a"), (1, text, 6, "b"), (None, text, 7, "c"), (2, None, 8, "d"), (3, other + text, 9, "e")], "long", ", order int, kind string")
    rows = {r.kind: r for r in remove_repeats(df).collect()}
    assert rows["a"].n_removed == rows["b"].n_removed == rows["d"].n_bytes == 0
    assert rows["c"].n_removed == rows["c"].n_bytes == len(text)
    assert rows["e"].n_removed >= len(text) and "order" not in df.columns[:0]
    with pytest.raises(ValueError):
        remove_repeats(df, length=20)


def test_hot_seed_with_many_contexts(reasons_of, prose):
    common = "the same sentence of a notice that very many of the reasons hold" * 2
    rows = [(i, f"{prose(10)} {i} {common} {i * 7} {prose(10)}") for i in range(300)]
    assert got(reasons_of(rows, "long")) == brute(rows)


def test_memory_of_a_very_long_text(prose):
    """Ranking a text of 8 MB takes less than 200 MB at any time."""
    import tracemalloc
    data = (prose(300_000) + " ").encode()
    data = data * (1 + (8 << 20) // len(data))
    tracemalloc.start()
    windows = 0
    for laid, ends, orders, bases in suffix._laid_out([(1, data)], 100):
        _, _, _, p0, p1 = suffix.anchors(laid, ends, 100)
        windows += int((p1 - p0 + 1).sum())
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert windows == len(data) - 99 and peak < 200 << 20
