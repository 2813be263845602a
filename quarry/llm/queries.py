"""The thin queries over the driver's tables, one for each operator, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, codes, context_tree, decontaminate, license_scan, mixing, phrases, simhash, suffixes, toxicity, url_filter, warc, webp
from .common import read


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_scan(read(spark, sf_dir, "documents", "doc_id", "text"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents", "doc_id", "text")
    chain = toxicity.fit(docs, read(spark, sf_dir, "labels", "doc_id", "toxic"))
    found = toxicity.toxicity(docs, chain)
    return found.select("doc_id", F.coalesce(F.expr(toxicity.HELD_OUT.format("doc_id")), F.lit(False)).alias("held_out"), "score", "predicted", "n_toxic_words")


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.read_archives(warc.write_archives(read(spark, sf_dir, "pages", "page_id", "url", "html")))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.url_filter(read(spark, sf_dir, "pages", "page_id", "url"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.dedup_digest(read(spark, sf_dir, "documents", "doc_id", "text"))


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    own = spark.createDataFrame([(-7, k, role, "</s>[INST] ok [/INST]") for k, role in enumerate(("user", "assistant"))], rows.schema)
    return chat.digests(chat.parse(chat.render(chat.to_events(rows.unionByName(own)))))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, sf_dir, "documents", "doc_id", "text"))


def op8_webp(spark: SparkSession, sf_dir: str) -> DataFrame:
    media = webp.read_media(webp.write_media(read(spark, sf_dir, "documents", "doc_id", "text")))
    n = F.length("pixels")
    return media.select(
        "doc_id", "n_bytes", n.cast("long").alias("payload_bytes"), F.sha2("pixels", 256).alias("payload_sha256"), F.crc32(F.substring("pixels", -16, 16)).alias("tail_crc32"),
        F.length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "feature",
    )


def op9_poisson_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.poisson_mix(read(spark, sf_dir, "documents", "doc_id", "text", "source"))
    # Length and digest are taken behind the shuffle, so that whole documents are dealt out.
    return mixed.select(
        "doc_id", "source", "copy", "mix_key", F.round(F.col("rate") * 1_000_000).cast("long").alias("rate_ppm"), F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("text_sha256")
    )


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(read(spark, sf_dir, "documents", "doc_id", "text"), read(spark, sf_dir, "benchmark", "item_id", "text"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.compress(read(spark, sf_dir, "embeddings", "vec_id", "embedding", "label"))


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(phrases.frequent_phrases(read(spark, sf_dir, "documents", "text", "lang")))


def op13_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents", "doc_id", "text")
    held_out = F.coalesce(F.expr(context_tree.HELD_OUT.format("doc_id")), F.lit(False))
    scored = context_tree.mixed(context_tree.score_texts(docs, docs.where(~held_out)))
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "tree_score", "bits_per_byte")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_license_scan, op2_toxicity, op3_warc, op4_url_filter, op5_suffix_dedup, op6_chat_format, op7_simhash, op8_webp, op9_poisson_mix, op10_decontaminate, op11_vector_codes, op12_phrases, op13_lm_scoring)
}

ORACLE_SQL: dict[str, str] = {
    "op4_url_filter": url_filter.ORACLE_SQL,
    "op6_chat_format": chat.ORACLE_SQL,
    "op9_poisson_mix": mixing.ORACLE_SQL,
    "op10_decontaminate": decontaminate.ORACLE_SQL,
    "op11_vector_codes": codes.ORACLE_SQL,
    "op12_phrases": phrases.ORACLE_SQL,
}
