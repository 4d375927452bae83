"""Queries with a SQL twin against DuckDB, the others for their contract's columns and one row per record."""

import pytest
from compare import compare, views
from fraudloom.llm.catalogue import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"
COLUMNS = {"op2": "doc_id n_bytes n_removed n_spans kept_sha256", "op3": "doc_id n_assign n_access n_hex base_sha256 spans", "op4": "doc_id rate", "op5": "doc_id held_out lang_pred score",
           "op7": "doc_id expected_grade p_top selected", "op8": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept", "op10": "doc_id fingerprint component_id", "op11": "doc_id n_tokens ids_sha256 decoded_sha256",
           "op13": "doc_id n_a n_b n_groups n_links n_best count_sum groups_sha256"}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, name):
    out = compare(spark, views(FOLDER), FOLDER, name, QUERIES[name], ORACLES[name])
    assert out.startswith("ok") and "types" not in out, out


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if n.split("_")[0] in COLUMNS))
def test_one_row_per_document(spark, name):
    out = QUERIES[name](spark, FOLDER)
    assert set(COLUMNS[name.split("_")[0]].split()) <= set(out.columns)
    assert sorted(r.doc_id for r in out.select("doc_id").collect()) == list(range(200))
