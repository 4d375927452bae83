import random


import numpy as np
import pytest
from fraudloom.llm.features import contained, word_bounds, word_hashes, words_of, prefix_sums
from fraudloom.llm.mixing import mix_sources
from fraudloom.llm.ordinal import grade_quality

BAD, RUDE = ["buy", "now", "free", "prize", "$$$"], ["idiot", "trash"]


def corpus(prose, n=500):
    rng, rows = random.Random(3), []
    for i in range(n):
        words, grade = prose(rng.randint(10, 80)).split(), rng.choice([0, 1, 2, 2, 2])
        for _ in range(rng.randint(2, 5)):
            if grade < 2:
                words.insert(rng.randrange(len(words)), rng.choice(RUDE if grade == 0 else BAD))
        rows.append((f"e{i:03d}", " ".join(words), grade))
    return rows


def frames(spark, rows, labelled):
    return (spark.createDataFrame([r[:2] for r in rows], "event_id string, reason string"), spark.createDataFrame([(r[0], r[2]) for r in labelled], "event_id string, grade int"))


def test_equal_words_have_equal_hashes():
    data = words_of("alpha beta ALPHA, é alpha")
    h = word_hashes(prefix_sums(data), *word_bounds(data))
    assert h[0] == h[2] == h[4] and len(set(h.tolist())) == 3
    a, b = contained("one two two", 1 << 16), contained("two one one", 1 << 16)
    assert sorted(a) == sorted(b) and len(set(a.tolist())) == len(a)
    assert contained(None, 1 << 16).tolist() == contained("", 1 << 16).tolist() == [0]


def test_grades_of_held_out_records(spark, prose):
    rows = corpus(prose)
    out = {r.event_id: r for r in grade_quality(*frames(spark, rows, rows[:350])).collect()}
    rest = rows[350:]
    by = [np.mean([out[i].expected_grade for i, _, g in rest if g == k]) for k in range(3)]
    assert by[0] < by[1] < by[2]
    assert np.mean([out[i].selected for i, _, g in rest if g == 2]) > 0.95 and np.mean([out[i].selected for i, _, g in rest if g == 0]) < 0.2
    assert all(0 <= r.p_top <= 1 and 0 <= r.expected_grade <= 2 for r in out.values())


def test_grades_without_ratings_and_odd_rows(spark, prose):
    odd = [(None, "x", 0), ("z1", None, 0), ("z2", "", 0), ("z2", "", 0), ("z3", "word " * 50_000, 0)]
    df, none = frames(spark, odd, [])
    assert all(r.selected and r.p_top is None for r in grade_quality(df, none).collect())
    rows = corpus(prose, 100)
    df, ratings = frames(spark, rows + odd, rows)
    ratings = ratings.unionByName(spark.createDataFrame([(None, 1), ("e001", None), ("e002", 9), ("unknown", 1)], "event_id string, grade int"))
    assert grade_quality(df, ratings).count() == 105
    assert grade_quality(df.filter("false"), ratings).count() == 0


@pytest.mark.parametrize("goal", [{"good": 0.8, "low": 0.15, "toxic": 0.05}, {"good": 1, "low": 1, "toxic": 1}])
def test_rates_meet_the_targets(spark, prose, goal):
    rows = corpus(prose)
    df, _ = frames(spark, rows, rows)
    labels = spark.createDataFrame([(i, ["toxic", "low", "good"][g]) for i, _, g in rows[:350]], "event_id string, domain string")
    out = mix_sources(df, labels, goal).collect()
    p, n, r = np.array([x.posterior for x in out]), np.array([x.n_tokens for x in out]), np.array([x.rate for x in out])
    assert (r >= 0).all() and n.tolist() == [len(x.reason.split()) for x in out]
    want = np.array([goal[d] for d in sorted(goal)]) / sum(goal.values())
    assert np.abs((n * r) @ p / n.sum() - want).max() < 1e-3
    truth = dict(zip([i for i, *_ in rows], [g for *_, g in rows]))
    right = np.mean([sorted(goal)[x.posterior.index(max(x.posterior))] == ["toxic", "low", "good"][truth[x.event_id]] for x in out])
    assert right > 0.9


def test_rates_equal_the_least_squares_solution_by_hand(spark):
    """With posteriors of whole records (zero or one) the rate of a domain is its target share over its own share."""
    from fraudloom.llm.mixing import _rates, fit_rates
    soft = spark.createDataFrame([([1.0, 0.0], 30), ([1.0, 0.0], 10), ([0.0, 1.0], 60)], "posterior array<double>, n_tokens long")
    steps = fit_rates(soft, np.array([0.7, 0.3]))
    assert np.allclose(_rates(np.array([[1.0, 0], [0, 1]]), steps), [0.7 / 0.4, 0.3 / 0.6])
    out_of_reach = fit_rates(spark.createDataFrame([([0.6, 0.4], 30), ([0.5, 0.5], 30)], "posterior array<double>, n_tokens long"), np.array([1.0, 0.0]))
    assert (_rates(np.array([[0.6, 0.4], [0.5, 0.5]]), out_of_reach) >= 0).all()


def test_mixing_odd_rows(spark):
    goal = {"a": 0.5, "b": 0.5}
    df = spark.createDataFrame([(None, "x y", 1), ("e1", None, 2), ("e2", "", 3), ("e2", "", 3)], "event_id string, reason string, rate int")
    none = spark.createDataFrame([], "event_id string, domain string")
    out = mix_sources(df, none, goal).collect()
    assert [r.rate for r in out] == [1.0] * 4 and sorted(r.n_tokens for r in out) == [0, 0, 0, 2]
    labels = spark.createDataFrame([("e1", None), (None, "a"), ("e1", "zzz"), ("nobody", "a")], "event_id string, domain string")
    assert mix_sources(df, labels, goal).count() == 4 and mix_sources(df.filter("false"), labels, goal).count() == 0
