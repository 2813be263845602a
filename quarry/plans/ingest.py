"""Queries from pages to the index: parsed items, structure, chunks, the report of an ingestion, and the index kept by buckets."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import ids
from ..operators import chunk as CH
from ..operators import index as IX
from ..operators import ingest as IN
from ..operators import rank as R
from ..operators.store import ChunkStore, PagedTable
from ..sources import bindings as B
from ..sources import html as H
from ..sources import records as RE
from ..sources import scratch as SC
from .queries import CHUNKS, query

#: SQL: entities that the tables' pages hold, read; the ampersand last.
READ = "replace(replace(replace(replace(x, '&lt;', '<'), '&gt;', '>'), '&quot;', chr(34)), '&amp;', '&')"
#: SQL: a page without what is no content, and without tags.
BODY = "html"
for _name in ("head", "nav", "footer", "script", "style"):
    BODY = rf"regexp_replace({BODY}, '<{_name}\b.*?(</{_name}\s*>|$)', '', 'gs')"
BODY = rf"regexp_replace(regexp_replace({BODY}, '<!--.*?-->', '', 'gs'), '<[^>]*(>|$)', ' ', 'g')"


@query("s03_headings", rf"SELECT doc, '# ' || trim(regexp_replace({READ}, '\s+', ' ', 'g')) AS text FROM (SELECT page_id AS doc, unnest(regexp_extract_all(html, '<h1[^>]*>([^<]*)', 1)) AS x FROM pages) WHERE trim(x) <> ''")
def s03_headings(spark, sf):
    return _items(spark, sf).where("label = 'SECTION_HEADER'").select("doc", "text")


@query("s03_html_text", rf"SELECT doc, sha256(regexp_replace({READ}, '\s+', '', 'g')) AS text_sha256 FROM (SELECT page_id AS doc, {BODY} AS x FROM pages)")
def s03_text(spark, sf):
    """All content of a page but its title is in some item, in order: the items' characters, without blanks and marks, are the page's."""
    plain = F.regexp_replace("text", "^(- |#{1,6} )", "")
    parts = F.transform(F.array_sort(F.collect_list(F.struct("ordinal", plain.alias("x")))), lambda e: e["x"])
    return _items(spark, sf).where("label <> 'TITLE'").groupBy("doc").agg(F.sha2(F.regexp_replace(F.array_join(parts, ""), r"\s+", ""), 256).alias("text_sha256"))


def _items(spark, sf):
    return H.html_items(B.table(spark, sf, "pages"))


def _files(spark, sf):
    """A page's file is named by its id; pages are the uploads."""
    return B.table(spark, sf, "pages").select(F.col("page_id").alias("doc"), F.concat(F.lit("page-"), "page_id", F.lit(".pdf")).alias("filename"))


@query("s03_html_items")
def s03(spark, sf):
    """Items of the pages' html by tokenizer and open elements."""
    return _items(spark, sf)


@query("s07_html_structure")
def s07(spark, sf):
    return CH.structure_map(_items(spark, sf)).select("doc", "ordinal", "type", "table_id", "page", F.sha2("content", 256).alias("content_sha256"))


@query("c08_html_nodes")
def c08(spark, sf):
    """Pages as parsed items, through structure map and nodes, to chunk rows."""
    return IN.ingest(_files(spark, sf), _items(spark, sf)).chunks.withColumn("text", F.sha2("text", 256))


@query("c10_ingest_report")
def c10(spark, sf):
    """The ingestion of all pages into an index that holds a chunk of every fourth file already."""
    files = _files(spark, sf)
    none = IN.ingest(files, _items(spark, sf).limit(0)).chunks  # for its columns
    held = files.where("doc % 4 = 0").select(*[F.lit(None).cast(t).alias(n) if n != "filename" else F.col("filename") for n, t in none.dtypes])
    return IN.ingest(files, _items(spark, sf), held).report


@query("f32_preview_pages")
def f32(spark, sf):
    """Previews with the fallback to the normalised text for pages without typed entries."""
    items = _items(spark, sf)
    normalized = IN.T.normalize_markdown(IN.markdown(items)).select("doc", F.col("normalized").alias("text"))
    return IN.preview(CH.structure_map(items), normalized).select("doc", F.sha2("preview", 256).alias("preview_sha256"))


CHANGED = f"(SELECT chunk_id, source_doc_id, filename, chunk_index, chunk_kind, CASE WHEN doc_id % 4 = 0 THEN 3 ELSE schema_version END AS schema_version FROM {CHUNKS} WHERE (doc_id % 4 <> 0 OR chunk_index = 0) AND doc_id % 10 <> 7)"


def _kept(spark, sf):
    """An index of all chunks in which every fourth file was replaced by its first chunk, a batch that came twice, and every tenth deleted."""
    def build():
        store = ChunkStore(spark, f"{SC.shared_dir(spark)}/store-{uuid.uuid4().hex}", buckets=8)
        chunks = B.chunks(spark, sf).drop("doc_id")
        first = chunks.where(F.regexp_extract("filename", r"(\d+)\.pdf$", 1).cast("long") % 4 == 0).where("chunk_index = 0").withColumn("schema_version", F.lit(3))
        store.upsert(chunks, "files", 0)
        for _ in range(2):
            store.upsert(first, "files", 1)
        store.delete(B.documents(spark, sf).where("doc_id % 10 = 7").select("filename"))
        return spark.createDataFrame([(store.root,)], "root string")

    return ChunkStore(spark, SC.published(spark, "store", [f"{sf}/documents.parquet"], build).first()["root"], buckets=8)


@query("s14_upsert", f"SELECT filename, count(*) AS n, max(schema_version) AS version FROM {CHANGED} GROUP BY filename")
def s14(spark, sf):
    return _kept(spark, sf).read().groupBy("filename").agg(F.count("*").alias("n"), F.max("schema_version").alias("version"))


@query("a01_catalog_kept", f"""WITH c AS {CHANGED}, k AS (SELECT source_doc_id, chunk_kind, count(*) AS n FROM c GROUP BY ALL), m AS (SELECT source_doc_id, string_agg(chunk_kind || '=' || n, ',' ORDER BY chunk_kind) AS kinds FROM k GROUP BY 1)
SELECT source_doc_id AS doc_id, min_by(filename, chunk_id) AS filename, count(*) AS chunks, max(chunk_index) AS max_chunk_index, any_value(kinds) AS kinds FROM c JOIN m USING (source_doc_id) GROUP BY source_doc_id""")
def a01_kept(spark, sf):
    """The catalog from the parts that the buckets keep; no chunk is read."""
    kinds = F.array_join(F.transform(F.map_entries("chunk_kind_counts"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    return _kept(spark, sf).catalog().select("doc_id", "filename", "chunks", "max_chunk_index", kinds.alias("kinds"))


@query("a02_totals_kept", f"SELECT count(DISTINCT source_doc_id) AS total_documents, count(*) AS total_chunks, count(*) AS scanned_points, false AS truncated FROM {CHANGED}")
def a02_kept(spark, sf):
    """Totals from the kept catalog: nothing is scanned, so nothing is cut short."""
    return _kept(spark, sf).catalog().agg(F.count("*").alias("total_documents"), F.sum("chunks").alias("total_chunks"), F.sum("chunks").alias("scanned_points"), F.lit(False).alias("truncated"))


@query("s11_page_tokens", f"SELECT (n / 256)::BIGINT AS page, chunk_id AS token FROM (SELECT chunk_id, row_number() OVER (ORDER BY chunk_id) AS n, count(*) OVER () AS total FROM {CHUNKS}) WHERE n % 256 = 0 AND n < total")
def s11_tokens(spark, sf):
    """Where each page of 256 chunks ends, from a table sorted over files with bounds."""
    return PagedTable(B.chunks(spark, sf), SC.shared_dir(spark), "chunk_id").tokens(256)


#: SQL: texts without blanks around them that points of documents hold, in each way in which they can.
HELD = r"(SELECT *, regexp_replace(text, '^\s+|\s+$', '', 'gs') AS stripped FROM documents)"


@query("s13_stored_nodes", f"""SELECT doc_id, CASE WHEN doc_id % 6 = 0 THEN 'node_' || doc_id ELSE 'point_' || doc_id END AS node_id, sha256(stripped) AS text_sha256, source, CASE WHEN doc_id % 6 = 0 THEN lang END AS lang, CASE WHEN doc_id % 6 = 2 THEN 3 ELSE 2 END AS fields
  FROM {HELD} WHERE doc_id % 6 <> 3 AND stripped <> ''""")
def s13_nodes(spark, sf):
    """Every document as a stored point, whose text stands in a whole node, or in one of the payload's fields beside a node that can't be read."""
    k, way = F.col("doc_id").cast("string"), F.col("doc_id") % 6
    whole = F.to_json(F.struct(F.concat(F.lit("node_"), k).alias("id_"), "text", F.struct(F.lit("inner").alias("source"), "lang").alias("metadata")))
    node = F.when(way == 0, whole).when(way == 1, "{broken").when(way == 2, '{"text": "  "}').when(way == 4, '{"text": 5}').when(way == 5, '["text"]')
    field = lambda when, value: F.when(when, value)
    payload = F.to_json(F.struct(
        node.alias("_node_content"), F.lit("TextNode").alias("_node_type"), F.col("source"),
        field(way >= 4, F.col("text")).when(way.isin(2, 3), " ").alias("text"), field(way == 1, F.col("text")).alias("document"), field(way == 2, F.col("text")).alias("content"),
    ))
    nodes = RE.decode(B.table(spark, sf, "documents").select("doc_id", F.concat(F.lit("point_"), k).alias("id"), payload.alias("payload")))
    return nodes.select("doc_id", "node_id", F.sha2("text", 256).alias("text_sha256"), F.col("metadata")["source"].alias("source"), F.col("metadata")["lang"].alias("lang"), F.size("metadata").alias("fields"))


@query("p01_payload_filter", f"SELECT chunk_id, source_doc_id FROM {CHUNKS} WHERE chunk_kind = 'table_parent' AND chunk_index // 10 = 1")
def p01_filter(spark, sf):
    """Table parents of one table number, over the chunks of all documents."""
    numbered = B.chunks(spark, sf).withColumn("table_id", F.concat(F.lit("table_"), (F.col("chunk_index") / 10).cast("int")))
    return IX.matching(numbered, {"chunk_kind": "table_parent", "table_id": "table_1"}).select("chunk_id", "source_doc_id")


@query("r09_get_document", f"""WITH w AS (SELECT DISTINCT CASE WHEN doc_id % 5 = 0 THEN 'doc_none_' || doc_id ELSE 'doc_' || substr(sha256(text), 1, 20) END AS doc_id FROM documents)
SELECT w.doc_id, min_by(filename, chunk_id) AS filename, CASE WHEN count(chunk_id) > 0 THEN count(chunk_id) END AS chunks, max(chunk_index) AS max_chunk_index, CASE WHEN count(chunk_id) > 0 THEN 'found' ELSE 'not_found' END AS status
FROM w LEFT JOIN {CHUNKS} c ON c.source_doc_id = w.doc_id GROUP BY w.doc_id""")
def r09_get(spark, sf):
    """Every document by its id; each fifth is asked for by one that isn't there."""
    wanted = B.documents(spark, sf).select(F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("doc_none_"), "doc_id")).otherwise(ids.document_id(F.col("text"))).alias("doc_id"))
    return IX.get_documents(B.chunks(spark, sf), wanted).select("doc_id", "filename", "chunks", "max_chunk_index", "status")


#: SQL: what an ingestion tells of documents; every third has no name, every seventh no text, every eleventh a blank one.
RESULTS = "(SELECT doc_id AS doc, CASE WHEN doc_id % 3 > 0 THEN source || '/' || doc_id || '.pdf' END AS filename, CASE WHEN doc_id % 7 = 0 THEN NULL WHEN doc_id % 11 = 0 THEN ' ' ELSE text END AS ingested_markdown FROM documents)"


def _results(spark, sf):
    doc = F.col("doc_id")
    text = F.when(doc % 7 != 0, F.when(doc % 11 == 0, " ").otherwise(F.col("text")))
    return B.documents(spark, sf).select(doc.alias("doc"), F.when(doc % 3 > 0, F.col("filename")).alias("filename"), text.alias("ingested_markdown"))


@query("p13_previews", f"SELECT doc, coalesce(filename, 'unknown.pdf') AS filename, sha256(ingested_markdown) AS markdown_sha256, 0 AS table_parent_count FROM {RESULTS} WHERE trim(coalesce(ingested_markdown, ''), ' ' || chr(9) || chr(10) || chr(13)) <> ''")
def p13_previews(spark, sf):
    return IN.shown(_results(spark, sf)).select("doc", "filename", F.sha2("markdown", 256).alias("markdown_sha256"), "table_parent_count")


@query("p13_compact_results", f"SELECT doc, filename, '<' || length(ingested_markdown) || ' chars>' AS ingested_markdown FROM {RESULTS}")
def p13_compact(spark, sf):
    return IN.compacted(_results(spark, sf))


@query("p12_visible_rows", f"SELECT chunk_id FROM {CHUNKS} WHERE chunk_kind = 'table_parent' AND length(text) >= 80")
def p12_visible(spark, sf):
    """Both filters on, over the chunks of all documents; long texts count as selected, short ones are not told of."""
    told = B.chunks(spark, sf).withColumn("table_visual_selected", F.when(F.length("text") >= 80, True))
    return IN.visible(told, only_parents=True, only_selected=True).select("chunk_id")


@query("w11_last_512", "SELECT event_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 512")
def w11_queue(spark, sf):
    """The limit is the feature: a queue that holds its last 512 entries."""
    return R.latest(B.table(spark, sf, "events"), ["ts", "event_id"]).select("event_id")
