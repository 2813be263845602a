"""Chunking and alignment: islands of text, offsets, as-of sections, table chunks, nodes; `align` finds the chunks' places."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ids
from ..functions import tables as T
from ..functions import text as C
from ..sources.scratch import written
from .align import positions


def island_marks(entries: DataFrame) -> DataFrame:
    """Adds `island` to (doc, ordinal, kind, ...): neighbouring text entries share a number, others have one of their own."""
    w = Window.partitionBy("doc").orderBy("ordinal")
    return entries.withColumn("island", F.sum(F.when((F.col("kind") != "text") | (F.coalesce(F.lag("kind").over(w), F.lit("")) != "text"), 1).otherwise(0)).over(w))


def islands(entries: DataFrame) -> DataFrame:
    """(doc, island, kind, text, page): neighbouring text entries of (doc, ordinal, kind, text, page) become one; others stand alone."""
    part = F.array_sort(F.collect_list(F.struct("ordinal", "text", "page")))
    return island_marks(entries).groupBy("doc", "island").agg(F.min("kind").alias("kind"), part.alias("p")).select(
        "doc", "island", "kind", F.array_join(F.transform("p", lambda x: x["text"]), "\n\n").alias("text"), F.get(F.filter(F.transform("p", lambda x: x["page"]), lambda x: x.isNotNull()), F.lit(0)).alias("page"),
    )


def offsets(entries: DataFrame, gap: int) -> DataFrame:
    """Adds `offset`: the characters before an entry of (doc, ordinal, text), with gap between neighbours."""
    before = Window.partitionBy("doc").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1)
    return entries.withColumn("offset", F.coalesce(F.sum(F.length("text") + gap).over(before), F.lit(0)).cast("long"))


def as_of(points: DataFrame, events: DataFrame, position: str = "offset", label: str = "label") -> DataFrame:
    """points (doc, position, ...) with the label of the last event (doc, offset, label) at or before their position; nothing for a missing position or
    before the first event. Points and events of a document are sorted together once; a running window carries the label on."""
    at = points.select("doc", F.col(position).alias("_at"), F.lit(1).alias("_kind"), F.lit(None).cast("string").alias("_label"), F.struct(*[F.col(f"`{c}`") for c in points.columns]).alias("_row"))
    told = events.select("doc", F.col("offset").alias("_at"), F.lit(0).alias("_kind"), F.col("label").alias("_label"))
    w = Window.partitionBy("doc").orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = at.unionByName(told, allowMissingColumns=True).withColumn("_last", F.last("_label", ignorenulls=True).over(w)).where("_kind = 1")
    return both.select(*[F.col(f"_row.`{c}`").alias(c) for c in points.columns], F.col("_last").alias(label))


def with_anchors(tables: DataFrame, most: int = 6) -> DataFrame:
    """Adds `anchors` to (caption, content); rows and anchors are generated columns, so that each is made once."""
    parsed = tables.withColumn("_rows", F.explode(F.array(T.rows(F.col("content")))))
    return parsed.withColumn("anchors", F.explode(F.array(T.anchor_texts(F.col("_rows"), F.col("content"), F.col("caption"), most)))).drop("_rows")


def table_chunks(tables: DataFrame, most: int = 6) -> DataFrame:
    """(order_id, chunk_ix, chunk_kind, text): each table's parent, whole, then its anchors."""
    tables = with_anchors(tables, most)
    parent = F.concat(F.lit("**Table: "), F.col("caption"), F.lit("**\n\n"), F.col("content"))
    kinds = F.concat(F.array(F.struct(F.lit("table_parent").alias("chunk_kind"), parent.alias("text"))), F.transform("anchors", lambda a: F.struct(F.lit("table_anchor").alias("chunk_kind"), a.alias("text"))))
    return tables.select("order_id", F.posexplode(kinds).alias("chunk_ix", "c")).select("order_id", "chunk_ix", "c.chunk_kind", "c.text")


def picture_description(items: DataFrame) -> Column:
    """What is said of a picture: its description, else the first of its annotations that isn't blank, else its text; null where there is none.
    items may lack the columns description (string) and annotations (array of strings)."""
    said = lambda c: F.nullif(C.strip(c), F.lit(""))
    ladder = [said(F.col("description"))] if "description" in items.columns else []
    if "annotations" in items.columns:
        ladder.append(F.get(F.filter(F.transform("annotations", said), lambda a: a.isNotNull()), F.lit(0)))
    return F.coalesce(*ladder, said(F.col("text")))


def structure_map(items: DataFrame) -> DataFrame:
    """Typed entries (doc, ordinal, type, table_id, page, content) of parsed items (doc, ordinal, label, text, caption, page, and description and
    annotations, if pictures have any): tables are numbered within their document, captions and texts of at most two characters go."""
    label, text = F.upper("label"), C.strip(F.coalesce("text", F.lit("")))
    kind = F.when(label == "TABLE", "table").when(label.isin("PICTURE", "CHART"), "figure").when(label != "CAPTION", "text")
    number = F.sum(F.when(label == "TABLE", 1).otherwise(0)).over(Window.partitionBy("doc").orderBy("ordinal"))
    caption = F.when(F.coalesce("caption", F.lit("")) != "", F.col("caption"))
    table = F.concat(F.coalesce(F.concat(F.lit("**Table: "), caption, F.lit("**\n\n")), F.lit("")), F.col("text"))
    figure = F.coalesce(F.nullif(F.concat_ws("\n\n", caption, picture_description(items)), F.lit("")), F.concat(F.lit("["), F.lower("label"), F.lit(" on page "), F.coalesce(F.col("page").cast("string"), F.lit("?")), F.lit("]")))
    typed = items.withColumn("type", kind).withColumn("table_id", F.when(F.col("type") == "table", F.format_string("table_%04d", number)))
    typed = typed.withColumn("caption", caption)
    kept = typed.where(F.col("type").isin("table", "figure") | ((F.col("type") == "text") & (F.length(text) > 2)))
    return kept.select("doc", "ordinal", "type", "table_id", "page", "caption", F.when(F.col("type") == "table", table).when(F.col("type") == "figure", figure).otherwise(F.col("text")).alias("content"))


def aligned_form(df: DataFrame, text_col: str, out: str) -> DataFrame:
    """df with the form in which texts are compared with pages: normalised, page markers kept, single blanks."""
    return C.normalize_markdown(df, text_col, out, keep_markers=True).withColumn(out, C.collapse(F.col(out)))


def page_segments(entries: DataFrame, least: int = 24, pages: DataFrame | None = None) -> DataFrame:
    """(doc, page, segments): the aligned texts of at least `least` characters of each page, in order. Documents without any take those of pages
    (doc, page, markdown), if given."""
    rows = aligned_form(entries.where("page is not null").select("doc", "page", "ordinal", "text"), "text", "x").where(F.length("x") >= least)
    found = rows.groupBy("doc", "page").agg(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "x"))), lambda e: e["x"]).alias("segments"))
    if pages is None:
        return found
    whole = aligned_form(pages.select("doc", "page", "markdown"), "markdown", "x").where(F.length("x") >= least)
    return found.unionByName(whole.join(found.select("doc").distinct(), "doc", "left_anti").select("doc", "page", F.array("x").alias("segments")))


def page_alignment(segments: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((doc, alignment), (doc, offset, label)) of (doc, page, segments): all segments by page between blank lines, and where each begins."""
    rows = segments.select("doc", "page", F.posexplode("segments").alias("k", "x"))
    before = Window.partitionBy("doc").orderBy("page", "k").rowsBetween(Window.unboundedPreceding, -1)
    events = rows.select("doc", F.coalesce(F.sum(F.length("x") + 2).over(before), F.lit(0)).cast("long").alias("offset"), F.concat(F.lit("Page "), F.col("page")).alias("label"))
    text = rows.groupBy("doc").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "k", "x"))), lambda e: e["x"]), "\n\n").alias("alignment"))
    return text, events


def section_events(texts: DataFrame) -> DataFrame:
    """(doc, offset, label): the start of (doc, text) as `Document`, and every heading with where its line begins."""
    lines = offsets(texts.select("doc", F.posexplode(F.split("text", "\n")).alias("ordinal", "text")), 1)
    titled = lines.select("doc", "offset", C.heading(F.col("text")).alias("label")).where("label is not null")
    return texts.select("doc", F.lit(0).cast("long").alias("offset"), F.lit("Document").alias("label")).unionByName(titled)


NODE = ["doc", "place", "part", "content_type", "chunk_kind", "text", "page", "table_id", "parent_id"]


def _split(texts: DataFrame, tokens: int, overlap: int) -> DataFrame:
    """NODE rows of (doc, place, text, page): normalised texts in chunks; those that come out blank go."""
    normal = C.normalize_markdown(texts, "text", "_normal").withColumn("_chunks", C.sentence_chunks(tokens, overlap)("_normal"))
    parts = normal.select("doc", "place", "page", F.posexplode("_chunks").alias("part", "text"))
    return parts.select("doc", "place", "part", F.lit("text").alias("content_type"), F.lit("text").alias("chunk_kind"), "text", "page", F.lit(None).cast("string").alias("table_id"), F.lit(None).cast("string").alias("parent_id"))


def flat_nodes(texts: DataFrame, tokens: int = 768, overlap: int = 200) -> DataFrame:
    """NODE rows of whole texts (doc, text), for documents without a structure map."""
    return _split(texts.select("doc", F.lit(0).cast("long").alias("place"), "text", F.lit(None).cast("int").alias("page")), tokens, overlap)


def structured_nodes(entries: DataFrame, tokens: int = 768, overlap: int = 200, anchors: int = 6) -> DataFrame:
    """NODE rows of a structure map (doc, ordinal, type, table_id, page, content, caption): neighbouring texts are joined and split, a table is one parent
    and its anchors, a figure is one node. Places order the nodes of a document."""
    marked = island_marks(entries.withColumnRenamed("type", "kind").withColumnRenamed("content", "text")).withColumn("place", F.col("island").cast("long"))
    merged = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "text"))), lambda x: x["text"]), "\n\n")
    texts = marked.where("kind = 'text'").groupBy("doc", "place").agg(merged.alias("text"), F.min_by("page", F.when(F.col("page").isNotNull(), F.col("ordinal"))).alias("page"))
    tables = with_anchors(marked.where("kind = 'table'").withColumn("content", F.col("text")), anchors)
    kinds = F.concat(F.array(F.struct(F.lit("table_parent").alias("k"), F.col("content").alias("text"))), F.transform("anchors", lambda a: F.struct(F.lit("table_anchor").alias("k"), a.alias("text"))))
    spread = tables.select("doc", "place", "page", "table_id", F.posexplode(kinds).alias("part", "e"))
    tabled = spread.select("doc", "place", "part", F.lit("table").alias("content_type"), F.col("e.k").alias("chunk_kind"), F.col("e.text").alias("text"), "page", "table_id", F.when(F.col("part") > 0, F.col("table_id")).alias("parent_id"))
    none = F.lit(None).cast("string")
    figures = marked.where("kind = 'figure'").select("doc", "place", F.lit(0).alias("part"), F.lit("figure").alias("content_type"), F.lit("figure").alias("chunk_kind"), "text", "page", none.alias("table_id"), none.alias("parent_id"))
    return _split(texts, tokens, overlap).unionByName(tabled).unionByName(figures).select(*NODE)


def _placed(nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """(doc, chunk_index, offset): where nodes (doc, chunk_index, text) begin in their document's text (doc, text)."""
    ordered = nodes.groupBy("doc").agg(F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "text"))), lambda x: C.strip(x["text"])).alias("parts"))
    found = positions(ordered.join(texts, "doc"))
    return found.select("doc", F.posexplode("pos").alias("chunk_index", "offset")).select("doc", "chunk_index", F.col("offset").cast("long").alias("offset"))


def build_nodes(nodes: DataFrame, normalized: DataFrame, segments: DataFrame, schema_version: int = 2) -> DataFrame:
    """Chunk rows of NODE rows: numbered within their document, with ids, the section of their place in the document's normalised text (doc, text,
    filename) and the page of their place in the pages' segments, or else of the structure map. Nodes, texts and segments go several ways, so they are
    written once: else each way would read, split and normalise all of them anew."""
    w = Window.partitionBy("doc").orderBy("place", "part")
    rows = written(nodes.withColumn("chunk_index", F.row_number().over(w) - 1).withColumn("total_chunks", F.count("*").over(Window.partitionBy("doc"))), "nodes")
    normalized, segments = written(normalized.select("doc", "text", "filename"), "normalized"), written(segments, "segments")
    alignment, page_events = page_alignment(segments)
    sections = as_of(_placed(rows, normalized.select("doc", "text")), section_events(normalized.select("doc", "text")), label="section_title")
    pages = as_of(_placed(rows, alignment.withColumnRenamed("alignment", "text")), page_events, label="page_label")
    key = ["doc", "chunk_index"]
    both = rows.join(sections.drop("offset"), key, "left").join(pages.drop("offset"), key, "left").join(normalized.select("doc", "filename"), "doc", "left")
    chunk = ids.chunk_id(F.col("doc").cast("string"), F.col("chunk_index"))
    label = F.coalesce("page_label", F.concat(F.lit("Page "), F.col("page")))
    return both.select(
        ids.point_uuid(chunk).alias("point_id"), chunk.alias("chunk_id"), F.col("doc").alias("source_doc_id"), "filename", "chunk_index", "total_chunks", "content_type", "chunk_kind", "text",
        F.coalesce("section_title", F.lit("Document")).alias("section_title"), label.alias("page_label"), "table_id", "parent_id", F.lit(schema_version).alias("schema_version"),
        F.lit("not_applicable").alias("table_visual_status"), F.lit(0).alias("table_visual_attempts"), F.lit(0.0).alias("table_visual_score"), F.lit(False).alias("table_visual_selected"),
    )


def diagnostics(chunks: DataFrame) -> DataFrame:
    """One row per chunk of build_nodes(): what tells how a document was cut, without its texts."""
    kept = ["chunk_id", "chunk_index", "content_type", "table_id", "parent_id", "section_title", "page_label", "schema_version", "table_visual_status", "table_visual_attempts", "table_visual_score", "table_visual_selected"]
    kind = F.coalesce("chunk_kind", "content_type", F.lit("text"))
    return chunks.select(*kept, kind.alias("chunk_kind"), F.length(C.strip(F.col("text"))).cast("long").alias("char_len"))


def visual_counts(entries: DataFrame) -> DataFrame:
    """Tables of each (doc, status, selected) by the state of their interpretation."""
    state = lambda s: F.count_if(F.col("status") == s)
    return entries.groupBy("doc").agg(
        *[state(s).alias(f"visual_{s}") for s in ("done", "pending", "failed")], F.count_if("selected").alias("visual_selected"), F.count_if(~F.col("selected")).alias("visual_skipped"),
    )
