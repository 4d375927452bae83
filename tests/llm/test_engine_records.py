"""Operators on the engine's own decisions, whose reasons they are made for."""

import public_tokenizers
import pytest
from fraudloom.llm import alignment, bpe, exchanges
from fraudloom.plans import tables
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def decisions(spark):
    return tables.decisions(spark, "/root/testdata/sf0.001")


def test_reasons_are_encoded_and_decoded(decisions):
    path = public_tokenizers.path("word_bpe_49k.json")
    out = bpe.decode_tokens(bpe.encode_reasons(decisions, path), path)
    assert set(decisions.columns) <= set(out.columns) and out.count() == decisions.count()
    bad = out.filter("n_tokens = 0 or translate(replace(decoded, '</w>', ''), ' ', '') <> translate(lower(reason), ' ', '')")
    assert bad.count() == 0


def test_reasons_are_aligned(decisions):
    out, pairs = alignment.align_reasons(decisions.select("event_id", "reason", "reason_title", "factors"),
                                         public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    total = out.agg(F.count(F.lit(1)), F.sum("n_links"), F.sum("n_best")).first()
    assert total[0] == decisions.count() and total[1] == pairs.agg(F.sum("count")).first()[0] and 0 < total[2] <= total[1]


def test_messages_about_users_are_repaired(decisions):
    """What an investigation would exchange about a user: the request names the newest reason, the answer the action."""
    newest = decisions.groupBy("user_id").agg(F.max_by(F.struct("reason", "action"), F.struct("ts_us", "event_id")).alias("d"))
    message = lambda turn, role, content: F.struct(F.lit(turn).alias("turn"), F.lit(role).alias("role"), content.alias("content"))
    rows = newest.select("user_id", F.explode(F.array(
        message(0, "system", F.lit("You investigate click fraud.")), message(1, "user", F.concat("d.reason", F.lit("."))),
        message(1, "user", F.concat("d.reason", F.lit("."))),
        message(3, "assistant", F.concat(F.lit("Recommended: "), "d.action", F.lit("."))))).alias("m")).select("user_id", "m.*")
    faults, repaired = exchanges.repair_exchanges(rows)
    assert {(r.audit, r.cost, r.gaps, r.duplicate) for r in faults.collect()} == {("KKDK", 4, 1, 1)}
    assert repaired.count() == 3 * newest.count()
