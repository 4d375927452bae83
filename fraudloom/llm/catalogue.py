"""Queries of the text operators over the corpus tables, and their DuckDB check queries.

Each query only maps table columns to the operator's record fields and back: ``doc_id`` becomes ``event_id`` and ``text``
becomes ``reason``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fraudloom.llm import alignment, bpe, decontaminate, exchanges, language, line_dedup, mixing, ordinal, outliers, secrets, simhash, suffix, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def reasons(documents: DataFrame) -> DataFrame:
    """A documents table as records of the engine."""
    return documents.withColumnsRenamed({"doc_id": "event_id", "text": "reason"})


def documents(records: DataFrame) -> DataFrame:
    return records.withColumnsRenamed({"event_id": "doc_id", "reason": "text"})


WHITE_SQL = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
LOWER_SQL = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP9_SQL = f"""
with lines as (
  select doc_id, u.line, u.i, {LOWER_SQL.format(f"trim(u.line, {WHITE_SQL})")} as key
  from (select doc_id, string_split(coalesce(text, ''), chr(10)) as ls from documents) d,
       unnest(d.ls) with ordinality as u(line, i)),
shared as (
  select key, max(doc_id) as keeper from lines where length(key) >= 20 group by key having count(distinct doc_id) >= 3)
select l.doc_id, count(*) as n_lines, count(*) filter (s.key is not null and l.doc_id <> s.keeper) as n_dropped,
  sha256(coalesce(string_agg(case when s.key is null or l.doc_id = s.keeper then l.line end, chr(10) order by l.i), '')) as kept_sha256
from lines l left join shared s on l.key = s.key
group by l.doc_id"""


@query("op9_line_dedup", OP9_SQL)
def op9(spark: SparkSession, folder: str) -> DataFrame:
    out = line_dedup.dedup_lines(reasons(table(spark, folder, "documents").select("doc_id", "text")))
    return out.select(F.col("event_id").alias("doc_id"), "n_lines", "n_dropped",
                      F.sha2(F.coalesce("reason", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


@query("op10_simhash_near_dedup")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    out = simhash.near_duplicates(reasons(table(spark, folder, "documents")))
    return out.withColumnRenamed("event_id", "doc_id")


SPAN_SQL = "array_join(transform({}, x -> concat(x.kind, ':', x.start, ':', x.end)), ',')"
BASE = "filter(findings, x -> x.kind <> 'model')"


@query("op3_secret_scan")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    out = secrets.find_secrets(reasons(table(spark, folder, "documents").select("doc_id", "text")))
    count = "cast(size(filter(findings, x -> x.kind = '{0}')) as bigint) as n_{0}"
    return out.selectExpr("event_id as doc_id", *[count.format(kind) for kind in ("assign", "access", "hex")],
                          f"sha2(cast({SPAN_SQL.format(BASE)} as binary), 256) as base_sha256", f"{SPAN_SQL.format('findings')} as spans")


@query("op5_language_id")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    out = language.identify_language(reasons(table(spark, folder, "documents").select("doc_id", "text", "lang")))
    return out.select(F.col("event_id").alias("doc_id"), "held_out", "lang_pred", "score", "rejected", "lang")


OP1_SQL = """
with d as (select page_id, coalesce(html, '') as h, sha1(coalesce(html, '')) as x from pages),
r as (select *, min(page_id) over (partition by h) as first_id from d)
select page_id, strlen(h) as payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    (((('0x' || substr(x, ((i // 4) * 5 + 1)::int, 5))::bigint >> (15 - 5 * (i % 4))::int) & 31) + 1)::int, 1)), '') as payload_digest,
  case when page_id = first_id then 'response' else 'revisit' end as record_type,
  case when page_id <> first_id then first_id end as refers_to
from r"""


@query("op1_warc", OP1_SQL)
def op1(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages").select(F.col("page_id").alias("event_id"), F.col("url").alias("uri"), F.col("html").cast("binary").alias("payload"))
    out = warc.read_archive(spark, warc.write_archive(pages))
    return out.select(F.col("event_id").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("long").alias("refers_to"))


@query("op8_quality_outliers")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    return outliers.quality_verdict(reasons(table(spark, folder, "documents").select("doc_id", "text", "lang", "source"))).withColumnRenamed("event_id", "doc_id")


#: Wanted shares of the training tokens by domain.
TARGETS = {"good": 0.94, "low": 0.05, "toxic": 0.01}


def domains(labels: DataFrame) -> DataFrame:
    return labels.filter("doc_id is not null and (toxic is not null or quality is not null)").select(
        F.col("doc_id").alias("event_id"), F.expr("case when toxic = 1 then 'toxic' when quality = 0 then 'low' else 'good' end").alias("domain"))


@query("op4_source_mixing")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    docs = reasons(table(spark, folder, "documents").select("doc_id", "text", "source"))
    out = mixing.mix_sources(docs, domains(table(spark, folder, "labels")), TARGETS)
    names = [F.col("posterior")[i].alias(f"p_{d}") for i, d in enumerate(sorted(TARGETS))]
    return out.select(F.col("event_id").alias("doc_id"), "source", "n_tokens", *names, "rate")


def cases(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "benchmark").select(F.col("item_id").alias("case_id"), F.col("text").alias("reason"))


@query("op6_decontamination")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    out = decontaminate.mark_leaks(reasons(table(spark, folder, "documents").select("doc_id", "text")), cases(spark, folder))
    return out.select(F.col("event_id").alias("doc_id"), F.explode("leaks").alias("l")).selectExpr(
        "doc_id", "l.case_id as item_id", "l.score as score", "l.at_word as at_word")


@query("op7_quality_grades")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    grades = table(spark, folder, "labels").selectExpr("doc_id as event_id", "case when toxic = 1 then 0 when quality = 0 then 1 when quality = 1 then 2 end as grade")
    out = ordinal.grade_quality(reasons(table(spark, folder, "documents").select("doc_id", "text")), grades)
    return out.select(F.col("event_id").alias("doc_id"), "expected_grade", "p_top", "selected")


@query("op2_suffix_dedup")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    out = suffix.remove_repeats(reasons(table(spark, folder, "documents").select("doc_id", "text")))
    return out.select(F.col("event_id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def vocabulary(name: str) -> str:
    """Path of a public vocabulary file."""
    import public_tokenizers
    return public_tokenizers.path(name)


@query("op11_bpe")
def op11(spark: SparkSession, folder: str) -> DataFrame:
    path = vocabulary("word_bpe_49k.json")
    docs = reasons(table(spark, folder, "documents").select("doc_id", "text"))
    out = bpe.decode_tokens(bpe.encode_reasons(docs, path).drop("reason"), path)
    return out.select(F.col("event_id").alias("doc_id"), "n_tokens", F.sha2("token_ids", 256).alias("ids_sha256"),
                      F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def damaged(messages: DataFrame) -> DataFrame:
    """Messages (``user_id``, ``turn``, ``role``, ``content``) with faults put in by a checksum of user and turn; nulls are one space."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    case = F.crc32(F.concat(blank("user_id"), F.lit(":"), blank("turn")).cast("binary")) % 20
    text = F.when(case == 1, "").when(case == 2, F.translate(blank("content"), ".!?", "")).otherwise(blank("content"))
    rows = messages.select("user_id", "turn", F.when(case == 4, "user").otherwise(blank("role")).alias("role"), text.alias("content"), case.alias("case"))
    return rows.filter("case <> 0").select("user_id", "turn", "role", "content", F.explode(F.expr("array_repeat(0, if(case = 3, 2, 1))"))).drop("col")


@query("op12_conversation_repair")
def op12(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "conversations").select(F.col("conv_id").alias("user_id"), "turn", "role", F.col("text").alias("content"))
    faults, repaired = exchanges.repair_exchanges(damaged(rows))
    every, digests = rows.select(F.col("user_id").alias("conv_id")).distinct(), exchanges.exchange_digest(repaired)
    out = (every.join(faults, F.col("conv_id").eqNullSafe(faults["user_id"]), "left").drop("user_id")
           .join(digests, F.col("conv_id").eqNullSafe(digests["user_id"]), "left"))
    zeros = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in exchanges.COUNTS]
    return out.select("conv_id", *zeros, F.coalesce("audit", F.lit("")).alias("audit"),
                      F.coalesce("digest", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))


@query("op13_token_alignment")
def op13(spark: SparkSession, folder: str) -> DataFrame:
    docs = reasons(table(spark, folder, "documents").select("doc_id", "text"))
    out, _ = alignment.align_reasons(docs, vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model"))
    return out.select(F.col("event_id").cast("long").alias("doc_id"), *alignment.COUNTS, *alignment.SCORES, "groups_sha256")
