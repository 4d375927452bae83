"""The pipeline's stages, each against a brute-force reading of its rule on its own input."""

import corpus_pipeline as P
import pytest
from fraudloom.llm import catalogue
from test_line_dedup import brute as brute_lines
from test_near_copies import brute as brute_groups

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Input and output of each stage, written and read again as the pipeline does."""
    docs, out = spark.read.parquet(f"{FOLDER}/documents.parquet"), {}
    for name, stage in P.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / name)
        stage(spark, docs, FOLDER).write.parquet(path)
        before, docs = docs, spark.read.parquet(path)
        out[name] = (before.orderBy("doc_id").collect(), docs.orderBy("doc_id").collect(), docs.columns)
    return out


def test_columns(spark, stages):
    names = spark.read.parquet(f"{FOLDER}/documents.parquet").columns
    for name, (_, _, columns) in list(stages.items())[:-1]:
        assert columns == names, name
    assert stages["source_mixing"][2] == [*names, "n_tokens", "rate"]


def test_language_keeps_texts_with_letters(stages):
    before, after, _ = stages["language_id"]
    assert {r.doc_id for r in after} <= {r.doc_id for r in before if any(map(str.isalpha, r.text or ""))}
    assert len(after) >= 0.99 * len(before)


def test_lines(stages):
    before, after, _ = stages["line_dedup"]
    want = {i: t for i, t, *_ in brute_lines([(r.doc_id, r.text) for r in before])}
    assert {r.doc_id: r.text for r in after} == want and all(r.n_chars == len(r.text) for r in after)


def test_one_document_of_each_group_stays(stages):
    before, after, _ = stages["simhash_near_dedup"]
    assert sorted(r.doc_id for r in after) == sorted(set(brute_groups([(r.doc_id, r.text) for r in before])))


def test_no_benchmark_item_is_left_whole(spark, stages):
    before, after, _ = stages["benchmark_decontamination"]
    words = lambda t: " ".join("".join(c if c.isalnum() else " " for c in (t or "").lower()).split())
    items = [words(r.reason) for r in catalogue.cases(spark, FOLDER).collect()]
    leaking = {r.doc_id for r in before if any(i in words(r.text) for i in items)}
    assert leaking and not leaking & {r.doc_id for r in after}
    assert len(after) >= len(before) - len(leaking) - 2


def test_mixing_keeps_all_with_a_positive_rate(stages):
    before, after, _ = stages["source_mixing"]
    assert all(r.rate > 0 and r.n_tokens == len(r.text.split()) for r in after) and len(after) >= 0.9 * len(before)


def test_run_gives_the_last_stage(spark, stages):
    assert sorted(r.doc_id for r in P.run(spark, FOLDER).collect()) == [r.doc_id for r in stages["source_mixing"][1]]


@pytest.mark.parametrize("name,stage", P.STAGES)
def test_odd_documents(spark, name, stage):
    kind = "doc_id long, text string, lang string, source string, n_chars long, n_lines int, event_id string, reason int, rate double, `_row` int"
    rows = [(1, None, None, None, None, 1, "x", 2, 0.5, 9), (2, "", "en", "s", 0, 1, "x", 2, 0.5, 9), (2, "", "en", "s", 0, 1, "x", 2, 0.5, 9), (None, "the word of it all", None, None, 5, 1, "y", 2, 0.5, 9),
            (5, "long word " * 30_000, "en", "s", 5, 1, "x", 2, None, 9)] + [(10 + i, "the same words in all of these", "en", "s", 5, 1, "x", 2, 0.5, 9) for i in range(4)]
    df = spark.createDataFrame(rows, kind)
    out = stage(spark, df, FOLDER)
    assert out.columns[:len(df.columns)] == df.columns
    got = out.collect()
    assert all(r.event_id in ("x", "y") and r.reason == 2 and r._row == 9 for r in got)
    assert stage(spark, df.filter("false"), FOLDER).count() == 0
