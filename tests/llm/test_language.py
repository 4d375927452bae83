import numpy as np
from fraudloom.llm.language import UNKNOWN, fit, has_letter, identify, identify_language, subwords, train_on
from pyspark.sql import functions as F
from zlib import crc32

EN = "the rule saw many clicks from one device and the address was shared by all of them within a minute".split()
DE = "die regel sah viele klicks von einem gerät und die adresse wurde von allen innerhalb einer minute geteilt".split()


def rows(n=300):
    rng = np.random.default_rng(1)
    return [(i, " ".join(rng.choice(EN if i % 2 else DE, rng.integers(3, 60))), "en" if i % 2 else "de") for i in range(n)]


def test_held_out_accuracy_and_scores(spark):
    df = identify_language(spark.createDataFrame(rows(), "event_id long, reason string, lang string"))
    got = df.collect()
    assert all(r.held_out == (crc32(str(r.event_id).encode()) % 5 == 0) for r in got)
    held = [r for r in got if r.held_out]
    assert len(held) > 30 and np.mean([r.lang == r.lang_pred for r in held]) > 0.98
    assert all(0 <= r.score <= 1 for r in got) and np.mean([r.rejected for r in got]) < 0.02


def test_prediction_reads_only_the_text(spark):
    base = spark.createDataFrame(rows(), "event_id long, reason string, lang string")
    model = train_on(base)
    changed = base.withColumns({"event_id": F.lit(1).cast("long"), "lang": F.lit("xx")})
    assert sorted(r.lang_pred for r in identify(base, model).collect()) == sorted(r.lang_pred for r in identify(changed, model).collect())


def test_a_prediction_does_not_depend_on_its_neighbours(spark):
    model = train_on(spark.createDataFrame(rows(), "event_id long, reason string, lang string"))
    texts = [r[1] for r in rows(40)] + [None, "", "12 34", "a"]
    together = model.predict(texts)[1]
    assert np.allclose(together, [model.predict([t])[1][0] for t in texts])


def test_odd_texts(spark):
    odd = [(900, None, "en"), (901, "", "de"), (902, "123 !? \n", "en"), (None, "the device and the rule", None), (904, "die regel " * 40_000, None),
           (905, "the clicks", "en"), (905, "the clicks", "en")]
    got = {r.event_id: r for r in identify_language(spark.createDataFrame(rows() + odd, "event_id long, reason string, lang string")).collect()}
    for i in (900, 901, 902):
        assert (got[i].lang_pred, got[i].score, got[i].rejected) == (UNKNOWN, 0.0, True)
    assert (got[None].lang_pred, got[None].held_out, got[904].lang_pred) == ("en", True, "de")


def test_empty_table_unlabelled_rows_and_clashing_names(spark):
    kind = "event_id long, reason string, lang string, score string, other int"
    assert identify_language(spark.createDataFrame([], kind)).count() == 0
    r = identify_language(spark.createDataFrame([(1, "the rule", None, "x", 5)], kind)).first()
    assert (r.lang_pred, r.score, r.other) == (UNKNOWN, 0.0, 5)


def test_letters():
    assert has_letter("1 ß") and not has_letter("1_2") and not has_letter(None)


def test_unlearned_languages_and_noise_are_rejected_and_mixed_texts_stay():
    rng = np.random.default_rng(2)
    fr = "la règle voit beaucoup de clics depuis un seul appareil pendant cette heure où quelques personnes parlaient ensemble".split()
    pl = "reguła widzi wiele kliknięć jednego urządzenia przez godzinę kiedy ludzie rozmawiali wspólnie".split()
    noise = lambda: " ".join("".join(rng.choice(list("bcdfghjklmnpqrstvwxz"), rng.integers(3, 10))) for _ in range(25))
    model = learn(rows(600))
    assert all(model.predict([" ".join(rng.choice(w, 30)) for w in (fr, pl) for _ in range(20)] + [noise() for _ in range(20)])[2])
    mixed = [" ".join(rng.choice(EN, 15)) + " " + " ".join(rng.choice(DE, k)) for k in (5, 10, 15, 30) for _ in range(10)]
    assert np.mean(model.predict(mixed)[2]) < 0.03


def learn(examples):
    bags = []
    for _, text, _ in examples:
        found = np.concatenate(subwords(f" {text.lower()} ".encode(), 1 << 15))
        at, count = np.unique(found[found > 0], return_counts=True)
        bags.append((at, count / count.sum()))
    order = np.random.default_rng(3).permutation(len(bags))
    return fit([bags[i] for i in order], [examples[i][2] for i in order])
