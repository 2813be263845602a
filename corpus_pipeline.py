"""The corpus pipeline: toxicity, near duplicates, repeated passages, benchmark leaks, mixture. Belongs to the subpackage llm.

Null, empty and very long texts, null and repeated ids, repeated rows and further columns pass as the stages say; further columns are kept, whatever
their names (the mixture replaces copy, mix_key and rate). An empty table gives an empty result. Near copies are linked at the operator's radius of
4 bits of 64, so near copies that differ in more stay.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import decontaminate, mixing, simhash, suffixes, toxicity
from quarry.llm.common import fresh, materialize, read


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the tagger rejects go; it learns from the labels of the whole corpus's documents that are not held out."""
    chain = toxicity.fit(read(spark, sf_dir, "documents", "doc_id", "text"), read(spark, sf_dir, "labels", "doc_id", "toxic"))
    return toxicity.keep_clean(docs, chain)


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies the document of least id stays; documents without a word are copies of one another."""
    return simhash.keep_one(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes that a 100-byte string of an earlier document or place covers are taken out; documents of which nothing is left go.
    Texts that were null or empty before stay."""
    had = fresh(docs, "had_text")
    kept = suffixes.dedup_text(docs.withColumn(had, F.coalesce(F.length("text") > 0, F.lit(False))))
    return kept.withColumn("n_chars", F.length("text").cast("long")).where(~F.col(had) | (F.col("text") != "")).select(*[F.col(f"`{c}`") for c in docs.columns])


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain at least 0.8 of a benchmark item's five-word shingles go. Documents with a null id are told apart by their texts."""
    key = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("null "), F.sha2(F.coalesce("text", F.lit("")), 256)))
    name = fresh(docs, "leak_key")
    keyed = docs.withColumn(name, key)
    leaks = decontaminate.contaminated(keyed, read(spark, sf_dir, "benchmark", "item_id", "text"), id_col=name).select(F.col("doc_id").alias(name)).distinct()
    return keyed.join(materialize(leaks, "leaks"), name, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture: sources of equal weight, documents repeated by Poisson numbers, in global random order."""
    return mixing.poisson_mix(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", one_of_near_copies),
    ("suffix_array_dedup", cut_repeats),
    ("benchmark_decontamination", drop_leaks),
    ("poisson_mix", mix_sources),
]

#: SQL can't express the tagger, the fingerprints' components or the covered bytes; tests/llm checks the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return materialize(STAGES[-1][1](spark, docs, sf_dir), STAGES[-1][0])
