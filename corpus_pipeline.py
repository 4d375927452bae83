"""From the documents table to a training mix, in five stages.

Each stage works on all that the one before kept and returns the columns of its input; only the last adds columns. Columns that a
stage does not know travel along untouched, whatever their names. Documents with a null id are judged like others but belong to
no near-duplicate group; rows that share an id are one document and stay or go together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fraudloom.llm import catalogue, decontaminate, language, line_dedup, mixing, near_copies
from fraudloom.session import materialize


def _records(docs: DataFrame, *shown: str) -> DataFrame:
    """Documents as records; all other columns are packed into one, where no operator sees their names."""
    rest = [F.col(c) for c in docs.columns if c not in ("doc_id", "text")] or [F.lit(None).cast("string").alias("_")]
    return docs.select(F.col("doc_id").alias("event_id"), F.col("text").alias("reason"), *shown, F.struct(*rest).alias("_row"))


def _documents(records: DataFrame, columns: list[str], *added: str) -> DataFrame:
    names = {"doc_id": "event_id", "text": "reason"}
    return records.select(*[F.col(names.get(c) or f"_row.`{c}`").alias(c) for c in columns], *added)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is rejected (no letters, null, or a score under the model's floor) go."""
    return _documents(language.identify_language(_records(docs, "lang")).filter("not rejected"), docs.columns)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that three documents or more share stay in one of them; ``n_chars`` follows the text."""
    out = _documents(line_dedup.dedup_lines(_records(docs)), docs.columns)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (Jaccard similarity of five-word shingles 0.8 or more) the document with the smallest id stays.

    SimHash fingerprints and prefixes of the shingle sets give the candidates; the exact similarity decides.
    """
    groups = near_copies.near_copies(_records(docs.filter("doc_id is not null")), shingle=5)
    repeats = groups.filter("event_id <> component_id").select(F.col("event_id").alias("doc_id")).distinct()
    return docs.join(repeats, "doc_id", "left_anti").select(*docs.columns)


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that repeat a benchmark item go."""
    return _documents(decontaminate.without_leaks(_records(docs), catalogue.cases(spark, sf_dir)), docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document gets a rate at which the token shares of the domains meet the targets; a rate of zero leaves it out."""
    labels = catalogue.domains(catalogue.table(spark, sf_dir, "labels"))
    out = mixing.mix_sources(_records(docs), labels, catalogue.TARGETS).filter("rate > 0")
    return _documents(out, docs.columns, *[F.col(c).alias(c if c not in docs.columns else f"mix_{c}") for c in ("n_tokens", "rate")])


STAGES = [("language_id", identify_language), ("line_dedup", dedup_lines), ("simhash_near_dedup", drop_near_duplicates),
          ("benchmark_decontamination", decontaminate_benchmark), ("source_mixing", mix)]

#: The learned stages have no SQL form; tests compare each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
