"""Ingestion as one job: parsed items to normalised texts, chunks, the index without the files' old chunks, and a report row for each file."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import ids
from ..functions import text as T
from ..sources.bindings import with_defaults
from ..sources.scratch import written
from . import chunk as CH
from .index import replace_by_key


@dataclass
class Ingested:
    """chunks: rows of build_nodes(); index: the old index with the files' chunks replaced; report: one row a file."""

    chunks: DataFrame
    index: DataFrame
    report: DataFrame


def markdown(items: DataFrame) -> DataFrame:
    """(doc, text): a document's items in order, tables behind their captions, between blank lines; what normalisation starts from."""
    part = F.when((F.col("label") == "TABLE") & (F.coalesce("caption", F.lit("")) != ""), F.concat(F.lit("**Table: "), F.col("caption"), F.lit("**\n\n"), F.col("text"))).otherwise(F.col("text"))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("ordinal", part.alias("x")))), lambda e: e["x"])
    return items.where(F.coalesce("text", F.lit("")) != "").groupBy("doc").agg(F.array_join(parts, "\n\n").alias("text"))


def preview(structure: DataFrame, normalized: DataFrame) -> DataFrame:
    """(doc, preview): the typed entries that have content, in order; documents without any show their normalised text (doc, text)."""
    shown = structure.where(T.strip(F.coalesce("content", F.lit(""))) != "")
    parts = F.transform(F.array_sort(F.collect_list(F.struct("ordinal", T.strip(F.col("content")).alias("x")))), lambda e: e["x"])
    made = shown.groupBy("doc").agg(F.array_join(parts, "\n\n").alias("made"))
    return normalized.select("doc", "text").join(made, "doc", "left").select("doc", F.coalesce("made", "text").alias("preview"))


#: The name that stands for a missing one, and the counts that a report may lack.
UNNAMED = "unknown.pdf"
COUNTS = ("table_parent_count", "table_anchor_count", "table_visual_done_count", "table_visual_pending_count", "table_visual_failed_count", "table_visual_selected_count", "table_visual_skipped_count")


def shown(results: DataFrame) -> DataFrame:
    """Of results (ingested_markdown, and what there is of filename and COUNTS) those with a text that isn't blank, with defaults for what is missing."""
    filled = with_defaults(results, {"filename": UNNAMED, **dict.fromkeys(COUNTS, 0)})
    return filled.where(T.strip(F.coalesce("ingested_markdown", F.lit(""))) != "").withColumnRenamed("ingested_markdown", "markdown")


def compacted(results: DataFrame) -> DataFrame:
    """results with the length of a text in its place; a missing text stays missing."""
    return results.withColumn("ingested_markdown", F.concat(F.lit("<"), F.length("ingested_markdown"), F.lit(" chars>")))


def visible(diagnostics: DataFrame, only_parents: bool = False, only_selected: bool = False) -> DataFrame:
    """diagnostics (chunk_kind, table_visual_selected) that pass the filters that are on; a missing selection is none."""
    kept = diagnostics.where("chunk_kind = 'table_parent'") if only_parents else diagnostics
    return kept.where(F.coalesce("table_visual_selected", F.lit(False))) if only_selected else kept


def ingest(files: DataFrame, items: DataFrame, index: DataFrame | None = None, tokens: int = 768, overlap: int = 200, schema_version: int = 2) -> Ingested:
    """files: (doc, filename), items: (doc, ordinal, label, text, caption, page). A file whose items have no text fails without stopping the others.
    The filename decides what is replaced in the index, so a file that has changed leaves no chunks behind. Items, texts and structure go several ways and are
    written once."""
    items = written(items, "items")
    normalized = written(T.normalize_markdown(markdown(items)).select("doc", F.col("normalized").alias("text")).where("text <> ''").join(files, "doc"), "texts")
    structure = written(CH.structure_map(items), "structure")
    entries = structure.select("doc", "ordinal", F.col("content").alias("text"), "page")
    chunks = CH.build_nodes(CH.structured_nodes(structure, tokens, overlap).join(normalized.select("doc"), "doc", "left_semi"), normalized, CH.page_segments(entries), schema_version)
    replaced = (index.groupBy("filename").agg(F.count("*").alias("replaced_points")) if index is not None else chunks.limit(0).select("filename", F.lit(0).cast("long").alias("replaced_points")))
    kind = lambda k: F.count_if(F.col("chunk_kind") == k)
    n_chars = F.length(T.strip(F.col("text")))
    per_chunk = chunks.groupBy("filename").agg(
        F.count("*").alias("chunks"), kind("table_parent").alias("table_parent_count"), kind("table_anchor").alias("table_anchor_count"), F.count_if(n_chars < 50).alias("empty_chunk_count"),
        F.bround(F.sum(F.length("text")) / F.count("*"), 0).cast("long").alias("avg_chunk_len"),
    )
    of_type = lambda k: F.count_if(F.col("type") == k)
    per_entry = structure.groupBy("doc").agg(of_type("table").alias("table_count"), of_type("figure").alias("figure_count"), of_type("text").alias("text_count"))
    told = normalized.select("doc", ids.document_id(F.col("text")).alias("doc_id"), T.fallback_summary(F.col("text")).alias("global_summary"))
    joined = files.join(told, "doc", "left").join(per_entry, "doc", "left").join(per_chunk, "filename", "left").join(replaced, "filename", "left")
    counts = ["chunks", "replaced_points", "table_parent_count", "table_anchor_count", "empty_chunk_count", "avg_chunk_len", "table_count", "figure_count", "text_count"]
    report = joined.select(
        "doc", "filename", F.when(F.col("doc_id").isNull(), "failed").otherwise("ingested").alias("status"), "doc_id", "global_summary", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts],
        F.lit(schema_version).alias("chunking_schema_version"),
    )
    return Ingested(chunks, chunks if index is None else replace_by_key(index, chunks), report)
