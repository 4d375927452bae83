import random
import re

import numpy as np
from fraudloom.llm.outliers import COUNTS, chi2_quantile, quality_verdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    windows = {}
    for i in range(len(words) - 7):
        windows.setdefault(tuple(words[i:i + 8]), []).append(i)
    covered = {j for at in windows.values() if len(at) > 1 for i in at for j in range(i, i + 8)}
    n = len(words)
    return (n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered), n < 20 or 100 * len(covered) > 30 * n)


def record(prose, i, rng):
    text = prose(rng.randint(20, 300))
    return (f"e{i:04d}", text.replace(" the ", " the\n"), rng.choice(["en", "de"]), rng.choice(["live", "live", "import"]))


KIND = "event_id string, reason string, lang string, source string"


def test_counts_equal_brute_force(spark, prose):
    rng = random.Random(1)
    rows = [record(prose, i, rng) for i in range(80)]
    line = prose(11)
    texts = [None, "", " \n\t", "a", "one two", "ab " * 400, (line + "\n") * 5 + prose(60), "# * $\n\n# * $\n|<>", "ä ö ü " * 30, "x\x0by\x0cz\rw " * 9, prose(20_000),
             " ".join(["p q r s t u v w"] * 2 + [prose(50)]), "\n".join([line, line + " ", line]), "w " * 8, "w " * 9]
    rows += [(f"o{i}", t, None if i % 2 else "en", None if i % 3 else "live") for i, t in enumerate(texts)] + [(None, prose(30), "en", "live")]
    got = {r.event_id: r for r in quality_verdict(spark.createDataFrame(rows, KIND)).collect()}
    assert len(got) == len(rows)
    for i, t, *_ in rows:
        assert tuple(got[i][c] for c in (*COUNTS, "base_failed")) == brute(t), i
        assert not (got[i].base_failed and got[i].kept)


def test_outliers_go_and_plain_texts_stay(spark, prose):
    rng = random.Random(2)
    rows = [record(prose, i, rng) for i in range(600)]
    loud = [(f"x{i}", " ".join(w + "$$$" for w in prose(80).split()), "en", "live") for i in range(60)]
    got = {r.event_id: r for r in quality_verdict(spark.createDataFrame(rows + loud, KIND)).collect()}
    assert not any(got[i].kept for i, *_ in loud)
    assert sum(got[i].kept for i, *_ in rows if not got[i].base_failed) >= 0.99 * sum(not got[i].base_failed for i, *_ in rows)


def test_small_groups_are_judged_by_the_next_level(spark, prose):
    few = [(f"e{i}", prose(50), "en", f"s{i}") for i in range(10)]
    assert all(r.kept for r in quality_verdict(spark.createDataFrame(few, KIND)).collect())
    # The same loud text goes whether its source, its language or only the whole table has enough rows.
    loud = " ".join(w + "$" * 12 for w in prose(60).split())
    for rows in ([(f"e{i}", prose(60), "en", "live") for i in range(300)], [(f"e{i}", prose(60), "en", f"s{i % 30}") for i in range(300)], [(f"e{i}", prose(60), f"l{i}", None) for i in range(45)]):
        got = {r.event_id: r.kept for r in quality_verdict(spark.createDataFrame([*rows, ("loud", loud, "en", "live")], KIND)).collect()}
        assert not got["loud"] and all(got[i] for i, *_ in rows)


def test_empty_table_and_clashing_names(spark, prose):
    kind = KIND + ", kept string, x_length int, _text int, d2 int"
    assert quality_verdict(spark.createDataFrame([], kind)).count() == 0
    r = quality_verdict(spark.createDataFrame([("e1", prose(40), "en", "live", "x", 1, 2, 3)], kind)).first()
    assert (r.kept, r.x_length, r._text, r.d2) == (True, 1, 2, 3)


def test_plan_has_no_python(spark, prose):
    plan = quality_verdict(spark.createDataFrame([("e1", prose(40), "en", "live")], KIND))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_chi_square_quantile():
    assert np.allclose([chi2_quantile(0.5, 4), chi2_quantile(0.99, 4)], [3.3567, 13.2767], rtol=0.01)
