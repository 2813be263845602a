"""More queries over the driver's tables, registered beside those of `queries`: filters, projections, messages, visual interpretation, catalog."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import chat as C
from ..functions import ids
from ..functions import tables as TB
from ..functions import text as T
from ..operators import chunk as CH
from ..operators import index as IX
from ..operators import rank as R
from ..sources import bindings as B
from .queries import BEST, CANDIDATES, CHUNKS, ENTRIES, FUSED, LISTS, ORDERS, REWRITE, _candidates, _dense, _entries, _fused, _sparse, _talk, query

TIDY = r"(SELECT conv_id, turn, lower(trim(role)) AS role, regexp_replace(text, '^\s+|\s+$', '', 'g') AS content FROM conversations WHERE lower(trim(role)) IN ('system', 'user', 'assistant') AND regexp_matches(text, '\S'))"


@query("p04_message_filter", f"SELECT conv_id, turn, role, content FROM {TIDY}")
def p04(spark, sf):
    return C.messages(_talk(spark, sf)).select("conv_id", F.inline("messages")).select("conv_id", "turn", "role", "content")


@query("f14_messages", f"SELECT conv_id, count(*) AS n, string_agg(role || '=' || content, '|' ORDER BY turn) AS messages FROM (SELECT * FROM {TIDY} QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 4) GROUP BY conv_id")
def f14(spark, sf):
    found = C.messages(_talk(spark, sf), 4)
    return found.select("conv_id", F.size("messages").cast("long").alias("n"), F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit("="), m["content"])), "|").alias("messages"))


@query("f15_router_prompt", f"""SELECT conv_id, CASE WHEN h IS NULL THEN '' ELSE 'Riwayat Obrolan:' || chr(10) || h || chr(10) || chr(10) END || 'Pertanyaan Terbaru: ' || q AS prompt FROM (
  SELECT conv_id, max(content) FILTER (last = 1) AS q, string_agg(CASE role WHEN 'user' THEN 'User: ' ELSE 'Assistant: ' END || content, chr(10) ORDER BY turn) FILTER (last > 1 AND role <> 'system') AS h
  FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS last FROM {TIDY}) GROUP BY conv_id)""")
def f15(spark, sf):
    found = C.messages(_talk(spark, sf))
    return found.select("conv_id", C.router_prompt(F.slice("messages", 1, F.size("messages") - 1), F.element_at("messages", -1)["content"]).alias("prompt"))


@query("f16_clean_json", "SELECT conv_id, turn, '{\"n\": ' || turn || '}' AS plain FROM conversations")
def f16(spark, sf):
    body = F.concat(F.lit('{"n": '), F.col("turn"), F.lit("}"))
    reply = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(F.col("turn") % 3 == 1, F.concat(F.lit("  "), body, F.lit("\n"))).otherwise(F.concat(F.lit("```\n"), body))
    return _talk(spark, sf).select("conv_id", "turn", C.unfenced(reply).alias("plain"))


@query("p06_generic_guard", "SELECT conv_id, turn, CASE WHEN turn % 3 = 2 THEN 'cheap flights' ELSE text END AS q FROM conversations")
def p06(spark, sf):
    rewritten = F.when(F.col("turn") % 3 == 0, " Ringkasan ").when(F.col("turn") % 3 == 1, "SUMMARY").otherwise("cheap flights")
    return _talk(spark, sf).select("conv_id", "turn", C.guarded_query(rewritten, F.col("text")).alias("q"))


RAW = "([' TRUE ', 'on', 'no', '12', '-3', '0.5', 'x', NULL])[event_id % 8 + 1]"


@query("f19_coerce", f"SELECT event_id, coalesce(lower(trim({RAW})) IN ('1', 'true', 'yes', 'on'), false) AS flag, greatest(1, coalesce(CASE WHEN regexp_full_match({RAW}, '[+-]?[0-9]+') THEN try_cast({RAW} AS INT) END, 7)) AS whole, least(1.0, greatest(0.0, coalesce(try_cast(trim({RAW}) AS DOUBLE), 0.75)))::DOUBLE AS share FROM events")
def f19(spark, sf):
    values = F.array(*[F.lit(x).cast("string") for x in (" TRUE ", "on", "no", "12", "-3", "0.5", "x", None)])
    raw = F.get(values, (F.col("event_id") % 8).cast("int"))
    return B.table(spark, sf, "events").select("event_id", T.to_bool(raw).alias("flag"), T.to_int(raw, 7).alias("whole"), T.to_float(raw, 0.75, 0.0, 1.0).alias("share"))


@query("f20_chart_signals", "SELECT doc_id, len(list_filter(['flow', 'decision', 'diagram', 'chart', 'arrow', 'connector', 'handoff', 'swimlane', 'panah'], lambda x: contains(lower(text), x))) > 0 AS chart FROM documents")
def f20(spark, sf):
    return B.documents(spark, sf).select("doc_id", TB.chart_signals(F.col("text")).alias("chart"))


@query("f22_separator_rows", f"SELECT order_id, count(*) AS lines, count(*) FILTER (regexp_full_match(x, '\\|[\\s:|-]+\\|')) AS separators FROM (SELECT order_id, unnest(string_split(content, chr(10))) AS x FROM {ORDERS}) GROUP BY order_id")
def f22(spark, sf):
    lines = B.order_tables(spark, sf).select("order_id", F.explode(F.split("content", "\n")).alias("x"))
    return lines.groupBy("order_id").agg(F.count("*").alias("lines"), F.count_if(TB.is_separator(F.col("x"))).alias("separators"))


@query("f23_bullets", f"SELECT order_id, 'a ' || caption || '~second' AS bullets FROM {ORDERS}")
def f23(spark, sf):
    content = F.concat("content", F.lit("\n\n" + TB.HEADING + "\n\nintro\n- a "), "caption", F.lit("\nbetween\n2. second\n- \n\n- later"))
    return B.order_tables(spark, sf).select("order_id", F.array_join(TB.visual_bullets(content), "~").alias("bullets"))


@query("f24_append", f"SELECT order_id, content || chr(10) || chr(10) || '### Table Visual Interpretation' || chr(10) || CASE order_id % 3 WHEN 0 THEN '- flows' WHEN 1 THEN '1. flows' ELSE '- to be' END || chr(10) AS content FROM {ORDERS}")
def f24(spark, sf):
    said = F.when(F.col("order_id") % 3 == 0, " flows ").when(F.col("order_id") % 3 == 1, "1. flows").otherwise("- to be")
    once = TB.append_interpretation(F.col("content"), said)
    return B.order_tables(spark, sf).select("order_id", TB.append_interpretation(once, said).alias("content"))


@query("f25_pending_marker", f"SELECT order_id, content || chr(10) || chr(10) || '### Table Visual Interpretation' || chr(10) || '- Pending visual interpretation retry after ' || order_id % 5 || ' attempt(s).' || CASE WHEN order_id % 2 = 0 THEN ' Last error: ' || repeat('e', 280) ELSE '' END || chr(10) AS content FROM {ORDERS}")
def f25(spark, sf):
    attempts, error = F.col("order_id") % 5, F.when(F.col("order_id") % 2 == 0, F.repeat(F.lit("e"), 300))
    once = TB.append_pending(F.col("content"), attempts, error)
    return B.order_tables(spark, sf).select("order_id", TB.append_pending(once, attempts, error).alias("content"))


@query("f26_visual_prompt", f"SELECT order_id, '{TB.VISUAL_PROMPT}' || chr(10) || chr(10) || '{TB.PROMPT_CONTEXT}' || chr(10) || '```markdown' || chr(10) || substr(content, 1, 2500) || chr(10) || '```' AS prompt FROM {ORDERS}")
def f26(spark, sf):
    return B.order_tables(spark, sf).select("order_id", TB.visual_prompt(F.col("content")).alias("prompt"))


@query("f27_completion_text", "SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'plain ' || event_id WHEN 1 THEN 'a' || event_id || chr(10) || 'b' END AS said FROM events")
def f27(spark, sf):
    n = F.col("event_id").cast("string")
    content = F.when(F.col("event_id") % 4 == 0, F.concat(F.lit('" plain '), n, F.lit(' "'))).when(F.col("event_id") % 4 == 1, F.concat(F.lit('[{"type":"text","text":" a'), n, F.lit('"},{"text":" "},{"type":"image"},{"text":"b"}]'))).otherwise('"  "')
    payload = F.when(F.col("event_id") % 4 == 3, '{"choices":[]}').otherwise(F.concat(F.lit('{"choices":[{"message":{"content":'), content, F.lit("}}]}")))
    return B.table(spark, sf, "events").select("event_id", C.completion_text(payload).alias("said"))


HEADED = f"(SELECT doc, ordinal, kind, CASE WHEN ordinal % 5 = 0 THEN '## ' ELSE '' END || text AS text FROM {ENTRIES})"


def _headed(spark, sf):
    return _entries(spark, sf).withColumn("text", F.concat(F.when(F.col("ordinal") % 5 == 0, "## ").otherwise(""), F.col("text")))


@query("f29_section_events", rf"""WITH o AS (SELECT *, coalesce(sum(length(text) + 1) OVER (PARTITION BY doc ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS pos FROM {HEADED})
SELECT doc, 0::BIGINT AS "offset", 'Document' AS section FROM o WHERE ordinal = 0 UNION ALL
SELECT doc, pos, substr(trim(regexp_extract(trim(text), '^#{{1,6}}\s+(.+)$', 1)), 1, 200) FROM o WHERE regexp_extract(trim(text), '^#{{1,6}}\s+(.+)$', 1) <> ''""")
def f29(spark, sf):
    placed = CH.offsets(_headed(spark, sf), 1).withColumn("section", T.heading(F.col("text")))
    start = placed.where("ordinal = 0").select("doc", F.lit(0).cast("long").alias("offset"), F.lit("Document").alias("section"))
    return start.unionByName(placed.where("section is not null").select("doc", "offset", "section"))


PAGED = f"(SELECT doc, ordinal, CASE WHEN ordinal % 4 = 3 THEN 'Page ' || ordinal || ' of 90' ELSE text END AS text FROM {ENTRIES})"


@query("f30_page_events", f"""SELECT doc, pos AS "offset", text_.replace(' of 90', '') AS page FROM (SELECT doc, ordinal, text AS text_, coalesce(sum(length(text) + 1) OVER (PARTITION BY doc ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS pos FROM {PAGED}) WHERE regexp_full_match(text_, 'Page [0-9]+ of 90')""")
def f30(spark, sf):
    marked = _entries(spark, sf).withColumn("text", F.when(F.col("ordinal") % 4 == 3, F.concat(F.lit("Page "), F.col("ordinal"), F.lit(" of 90"))).otherwise(F.col("text")))
    return CH.offsets(marked, 1).select("doc", "offset", T.page_label(F.col("text")).alias("page")).where("page is not null")


@query("f32_preview", f"SELECT doc, coalesce(string_agg(text, chr(10) || chr(10) ORDER BY ordinal) FILTER (trim(text) <> '' AND kind = 'table'), 'none') AS preview FROM {ENTRIES} GROUP BY doc")
def f32(spark, sf):
    part = F.when((F.col("kind") == "table") & (T.strip(F.col("text")) != ""), F.struct("ordinal", "text"))
    parts = F.transform(F.array_sort(F.collect_list(part)), lambda x: x["text"])
    return _entries(spark, sf).groupBy("doc").agg(parts.alias("p")).select("doc", F.when(F.size("p") > 0, F.array_join("p", "\n\n")).otherwise("none").alias("preview"))


@query("f35_ground_tokens", "SELECT item_id, array_to_string(list_sort(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]{3,}'))), ' ') AS tokens FROM benchmark")
def f35(spark, sf):
    return B.table(spark, sf, "benchmark").select("item_id", F.array_join(F.array_sort(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]{3,}"), F.lit(0)))), " ").alias("tokens"))


@query("a03_exact_count", f"SELECT chunk_kind, count(*) AS n FROM {CHUNKS} WHERE schema_version = 2 GROUP BY chunk_kind")
def a03(spark, sf):
    return B.chunks(spark, sf).where("schema_version = 2").groupBy("chunk_kind").agg(F.count("*").alias("n"))


@query("a09_line_counts", r"""SELECT doc_id, lower(p) AS line, count(*) AS n FROM (SELECT doc_id, trim(unnest(string_split(text, chr(10)))) AS p FROM documents)
WHERE p <> '' AND length(p) <= 80 AND len(regexp_split_to_array(p, '\s+')) <= 12 AND NOT regexp_matches(p, '^(#{1,6}\s|[-*+]\s|[0-9]+\.\s|>\s|\|)') GROUP BY ALL""")
def a09(spark, sf):
    lines = B.documents(spark, sf).select("doc_id", F.explode(F.split("text", "\n")).alias("x")).withColumn("x", T.strip(F.col("x")))
    return lines.where(T.short_line(F.col("x"))).groupBy("doc_id", F.lower("x").alias("line")).agg(F.count("*").alias("n"))


@query("a15_query_weights", f"SELECT query, round(sum(weight), 6) AS weight, min(pos) AS pos FROM (SELECT unnest([short, plain]) AS query, unnest([0.6::DOUBLE, 0.4::DOUBLE]) AS weight, unnest([item_id * 2, item_id * 2 + 1]) AS pos FROM {REWRITE}) GROUP BY query")
def a15(spark, sf):
    asked = B.table(spark, sf, "benchmark").select("item_id", F.posexplode(T.variants(F.col("text"))).alias("k", "v"))
    return asked.groupBy("v.query").agg(F.round(F.sum("v.weight"), 6).alias("weight"), F.min(F.col("item_id") * 2 + F.col("k")).alias("pos"))


@query("p13_document_table", f"SELECT source_doc_id AS doc_id, min_by(filename, chunk_id) AS filename, coalesce(string_agg(DISTINCT schema_version::VARCHAR, ', ' ORDER BY schema_version::VARCHAR) FILTER (source_doc_id < 'doc_8'), 'n/a') AS versions FROM {CHUNKS} GROUP BY source_doc_id")
def p13(spark, sf):
    points = B.chunks(spark, sf).withColumn("schema_version", F.when(F.col("source_doc_id") < "doc_8", F.col("schema_version")))
    return IX.catalog(points).select("doc_id", "filename", F.coalesce(F.nullif(F.array_join("schema_versions", ", "), F.lit("")), F.lit("n/a")).alias("versions"))


@query("p15_debug_candidates", f"SELECT q, rank, node_id, round_even(score, 6) AS score FROM {FUSED} WHERE rank <= 8")
def p15(spark, sf):
    return _fused(spark, sf).where("rank <= 8").select("q", "rank", "node_id", F.bround("score", 6).alias("score"))


@query("p16_public_fields", f"SELECT doc, ordinal, kind, text FROM {ENTRIES}")
def p16(spark, sf):
    rows = _entries(spark, sf).withColumn("_image", F.lit(None).cast("binary")).withColumn("_profile", F.lit("x")).withColumn("ordinal", F.col("ordinal").cast("long"))
    return B.public(rows).drop("page")


@query("p17_defaults", f"SELECT chunk_id, CASE WHEN doc_id % 3 = 0 THEN 'text' ELSE chunk_kind END AS chunk_kind, coalesce(CASE WHEN doc_id % 2 = 0 THEN filename END, 'unknown') AS filename, 0 AS page FROM {CHUNKS}")
def p17(spark, sf):
    bare = B.chunks(spark, sf).select("chunk_id", F.when(F.col("doc_id") % 3 != 0, F.col("chunk_kind")).alias("chunk_kind"), F.when(F.col("doc_id") % 2 == 0, F.col("filename")).alias("filename"))
    return B.with_defaults(bare, {"chunk_kind": "text", "filename": "unknown", "page": 0})


@query("l03_scored_rerank", f"SELECT q, node_id, score, rank FROM (SELECT q, node_id, score, row_number() OVER (PARTITION BY q ORDER BY score DESC NULLS LAST, pos) AS rank FROM {CANDIDATES} QUALIFY rank <= 8) WHERE score >= 0.001")
def l03(spark, sf):
    return R.rerank(_candidates(spark, sf)).select("q", "node_id", "score", "rank")


@query("l06_catalog_order", f"SELECT source_doc_id AS doc_id, lower(min_by(filename, chunk_id)) AS name FROM {CHUNKS} GROUP BY source_doc_id")
def l06(spark, sf):
    return IX.catalog(B.chunks(spark, sf)).select("doc_id", F.lower("filename").alias("name")).orderBy("name", "doc_id")


@query("u03_first_of_node", f"SELECT q, node_id, list_ix, rank FROM {LISTS} QUALIFY row_number() OVER (PARTITION BY q, node_id ORDER BY list_ix, rank) = 1")
def u03(spark, sf):
    lists = [_dense(spark, sf), _sparse(spark, sf)]
    both = [one.select("q", "node_id", F.lit(k).alias("list_ix"), "rank") for k, one in enumerate(lists)]
    return R.top_k(both[0].unionByName(both[1]), ["q", "node_id"], ["list_ix", "rank"], 1, "_n").drop("_n")


@query("u07_missing_parents", f"SELECT b.q, b.doc, b.parent_id FROM {BEST} b WHERE NOT EXISTS (SELECT 1 FROM {CANDIDATES} p WHERE p.kind = 'table_parent' AND p.q = b.q AND p.doc = b.doc AND p.parent_id = b.parent_id)")
def u07(spark, sf):
    found = _candidates(spark, sf)
    return R.best_anchors(found.where("kind = 'table_anchor'")).join(found.where("kind = 'table_parent'"), ["q", "doc", "parent_id"], "left_anti").select("q", "doc", "parent_id")


@query("u08_filenames", f"SELECT DISTINCT filename FROM {CHUNKS}")
def u08(spark, sf):
    return B.chunks(spark, sf).select("filename").distinct().orderBy("filename")


@query("w04_table_ids", f"SELECT doc, ordinal, 'table_' || lpad((row_number() OVER (PARTITION BY doc ORDER BY ordinal))::VARCHAR, 4, '0') AS table_id FROM {ENTRIES} WHERE kind = 'table'")
def w04(spark, sf):
    n = F.row_number().over(Window.partitionBy("doc").orderBy("ordinal"))
    return _entries(spark, sf).where("kind = 'table'").select("doc", F.col("ordinal").cast("long").alias("ordinal"), F.format_string("table_%04d", n).alias("table_id"))


@query("w08_anchor_index", f"SELECT order_id, unnest([1, 2])::INT AS anchor_ix, unnest(['Table caption: ' || caption, 'Table headers: No, Activity, Waktu, Output']) AS anchor FROM {ORDERS}")
def w08(spark, sf):
    tables = CH.with_anchors(B.order_tables(spark, sf), 2)
    return tables.select("order_id", F.posexplode("anchors").alias("k", "anchor")).select("order_id", (F.col("k") + 1).alias("anchor_ix"), "anchor")


@query("r09_delete_document", f"SELECT filename, deleted, CASE WHEN deleted > 0 THEN 'deleted' ELSE 'not_found' END AS status FROM (SELECT w.filename, count(c.filename) AS deleted FROM (SELECT source || '/' || doc_id || CASE WHEN doc_id % 2 = 0 THEN '.pdf' ELSE '.doc' END AS filename FROM documents WHERE doc_id % 5 < 2) w LEFT JOIN {CHUNKS} c ON c.filename = w.filename GROUP BY w.filename)")
def r09(spark, sf):
    named = B.documents(spark, sf).where("doc_id % 5 < 2")
    wanted = named.select(F.concat("source", F.lit("/"), "doc_id", F.when(F.col("doc_id") % 2 == 0, ".pdf").otherwise(".doc")).alias("filename")).distinct()
    return IX.deletion_report(B.chunks(spark, sf), wanted)


OUTCOMES = "(SELECT l_orderkey AS order_id, list(CASE l_partkey % 4 WHEN 0 THEN 'ok' WHEN 1 THEN 'failed' ELSE 'retryable' END ORDER BY l_linenumber, l_partkey) AS all_ FROM lineitem GROUP BY l_orderkey)"


@query("r13_retry_states", f"""SELECT order_id, CASE WHEN t[n] = 'ok' THEN 'done' WHEN list_contains(t[1:n], 'retryable') THEN 'pending' ELSE 'failed' END AS status, n::INT AS attempts
FROM (SELECT order_id, t, coalesce(list_min(list_filter([list_position(t, 'ok'), list_position(t, 'failed')], lambda x: x > 0)), len(t)) AS n FROM (SELECT order_id, all_[1:5] AS t FROM {OUTCOMES}))""")
def r13(spark, sf):
    said = F.when(F.col("l_partkey") % 4 == 0, "ok").when(F.col("l_partkey") % 4 == 1, "failed").otherwise("retryable")
    tries = B.table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", said.alias("o")))).alias("t"))
    return tries.select(F.col("l_orderkey").alias("order_id"), TB.retried(F.transform("t", lambda x: x["o"])).alias("r")).select("order_id", "r.status", "r.attempts")


ITEMS = f"(SELECT doc, ordinal, text, page, (['TABLE', 'PICTURE', 'PARAGRAPH', 'CAPTION', 'CHART', 'TEXT'])[ordinal % 6 + 1] AS label, CASE WHEN ordinal % 4 < 2 THEN 'cap ' || ordinal END AS caption FROM {ENTRIES})"


@query("s07_structure_map", rf"""SELECT doc, ordinal, type, table_id, content FROM (SELECT doc, ordinal, text, CASE WHEN label = 'TABLE' THEN 'table' WHEN label IN ('PICTURE', 'CHART') THEN 'figure' WHEN label <> 'CAPTION' THEN 'text' END AS type,
  CASE WHEN label = 'TABLE' THEN 'table_' || lpad((count(*) FILTER (label = 'TABLE') OVER (PARTITION BY doc ORDER BY ordinal))::VARCHAR, 4, '0') END AS table_id,
  CASE WHEN label = 'TABLE' THEN CASE WHEN caption IS NOT NULL THEN '**Table: ' || caption || '**' || chr(10) || chr(10) ELSE '' END || text
    WHEN label IN ('PICTURE', 'CHART') THEN coalesce(nullif(concat_ws(chr(10) || chr(10), caption, nullif(trim(text), '')), ''), '[' || lower(label) || ' on page ' || coalesce(page::VARCHAR, '?') || ']') ELSE text END AS content FROM {ITEMS})
WHERE type IN ('table', 'figure') OR (type = 'text' AND length(trim(text)) > 2)""")
def s07(spark, sf):
    labels = F.array(*map(F.lit, ("TABLE", "PICTURE", "PARAGRAPH", "CAPTION", "CHART", "TEXT")))
    items = _entries(spark, sf).withColumn("label", F.get(labels, F.col("ordinal") % 6)).withColumn("caption", F.when(F.col("ordinal") % 4 < 2, F.concat(F.lit("cap "), F.col("ordinal"))))
    return CH.structure_map(items).select("doc", F.col("ordinal").cast("long").alias("ordinal"), "type", "table_id", "content")


@query("s08_picture_descriptions", rf"""SELECT doc, ordinal, coalesce(nullif(concat_ws(chr(10) || chr(10), caption, said), ''), '[' || lower(label) || ' on page ' || coalesce(page::VARCHAR, '?') || ']') AS content FROM (
  SELECT *, nullif(CASE ordinal % 3 WHEN 0 THEN 'Shown: ' || trim(text) WHEN 1 THEN 'Noted: ' || trim(text) ELSE trim(text) END, '') AS said FROM {ITEMS} WHERE label IN ('PICTURE', 'CHART'))""")
def s08_pictures(spark, sf):
    """What figures say: every third item has a description, another third only annotations, of which the third isn't blank."""
    labels, third = F.array(*map(F.lit, ("TABLE", "PICTURE", "PARAGRAPH", "CAPTION", "CHART", "TEXT"))), F.col("ordinal") % 3
    items = _entries(spark, sf).withColumns({
        "label": F.get(labels, F.col("ordinal") % 6), "caption": F.when(F.col("ordinal") % 4 < 2, F.concat(F.lit("cap "), F.col("ordinal"))),
        "description": F.when(third == 0, F.concat(F.lit(" Shown: "), F.trim("text"), F.lit("\n"))).otherwise(" "),
        "annotations": F.when(third == 1, F.array(F.lit(None).cast("string"), F.lit("\t"), F.concat(F.lit("Noted: "), F.trim("text")), F.lit("later"))),
    })
    return CH.structure_map(items).where("type = 'figure'").select("doc", F.col("ordinal").cast("long").alias("ordinal"), "content")


@query("s09_page_segments", rf"SELECT doc, page, string_agg(x, chr(10) ORDER BY ordinal) AS segments FROM (SELECT doc, ordinal, page, trim(regexp_replace(text, '\s+', ' ', 'g')) AS x FROM {ENTRIES} WHERE page IS NOT NULL) WHERE length(x) >= 24 GROUP BY ALL")
def s09(spark, sf):
    return CH.page_segments(_entries(spark, sf)).select("doc", F.col("page").cast("long").alias("page"), F.array_join("segments", "\n").alias("segments"))


@query("f36_doc_key", f"SELECT q, node_id, coalesce(CASE WHEN pos % 3 > 0 THEN doc::VARCHAR END, '__node__:' || node_id) AS doc_key FROM {CANDIDATES}")
def f36(spark, sf):
    return _candidates(spark, sf).withColumn("doc", F.when(F.col("pos") % 3 > 0, F.col("doc").cast("string"))).select("q", "node_id", ids.doc_key(F.col("doc"), F.col("node_id")).alias("doc_key"))


@query("f09_normalize_query", r"SELECT conv_id, turn, trim(regexp_replace(text, '\s+', ' ', 'g'), ' ') AS query FROM conversations")
def f09(spark, sf):
    return _talk(spark, sf).select("conv_id", "turn", T.normalize_query(F.col("text")).alias("query"))


@query("f11_variants_disabled", f"SELECT item_id, plain AS query, 1.0::DOUBLE AS weight FROM {REWRITE}")
def f11_disabled(spark, sf):
    plain = B.table(spark, sf, "benchmark").select("item_id", F.explode(F.array(T.normalize_query(F.col("text")))).alias("text"))
    return plain.select("item_id", F.explode(T.variants(F.col("text"), enabled=False)).alias("v")).select("item_id", "v.query", "v.weight")


@query("f31_alignment_form", rf"SELECT doc, ordinal, trim(regexp_replace(text, '\s+', ' ', 'g'), ' ') AS form FROM {ENTRIES}")
def f31(spark, sf):
    return CH.aligned_form(_entries(spark, sf), "text", "form").select("doc", F.col("ordinal").cast("long").alias("ordinal"), "form")


SEGMENTS = rf"(SELECT doc, page, ordinal, x FROM (SELECT doc, page, ordinal, trim(regexp_replace(text, '\s+', ' ', 'g'), ' ') AS x FROM {ENTRIES} WHERE page IS NOT NULL) WHERE length(x) >= 24)"


@query("c09_page_alignment", f"""SELECT doc, coalesce(sum(length(x) + 2) OVER (PARTITION BY doc ORDER BY page, ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset", 'Page ' || page AS label,
  sha256(string_agg(x, chr(10) || chr(10)) OVER (PARTITION BY doc ORDER BY page, ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS alignment_sha256 FROM {SEGMENTS}""")
def c09(spark, sf):
    text, events = CH.page_alignment(CH.page_segments(_entries(spark, sf)))
    return events.join(text.select("doc", F.sha2("alignment", 256).alias("alignment_sha256")), "doc")


@query("p10_routing_mode", "SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'always_on' WHEN 1 THEN 'always_on' WHEN 2 THEN 'always_on' ELSE 'auto_signal' END AS mode, (event_id % 6) IN (0, 2) AS enabled FROM events")
def p10(spark, sf):
    pick = lambda *xs: F.get(F.array(*[F.lit(x).cast("string") for x in xs]), (F.col("event_id") % 6).cast("int"))
    return B.table(spark, sf, "events").select("event_id", TB.routing_mode(pick(" Always", "ALL", "always_on ", "auto", "", None)).alias("mode"), T.to_bool(pick("1", "off", " Yes", "2", "", None)).alias("enabled"))


@query("p11_threshold", "SELECT event_id, CASE event_id % 5 WHEN 0 THEN 0.5::DOUBLE WHEN 1 THEN 1.0::DOUBLE WHEN 2 THEN 0.0::DOUBLE ELSE CASE event_id % 4 WHEN 0 THEN 0.65::DOUBLE WHEN 1 THEN 0.55::DOUBLE ELSE 0.75::DOUBLE END END AS threshold FROM events")
def p11(spark, sf):
    pick = lambda n, *xs: F.get(F.array(*[F.lit(x).cast("string") for x in xs]), (F.col("event_id") % n).cast("int"))
    return B.table(spark, sf, "events").select("event_id", TB.signal_threshold(pick(5, " 0.5", "7", "-1", "many", None), pick(4, "Balanced ", "recall", "precision", None)).alias("threshold"))


@query("p19_request_validation", "SELECT conv_id, turn, CASE WHEN turn % 5 = 1 THEN 'role' WHEN turn % 5 = 2 OR NOT regexp_matches(text, '\\S') THEN 'content' WHEN turn % 5 = 3 THEN 'max_points' END AS error FROM conversations")
def p19(spark, sf):
    at = F.col("turn") % 5
    role, content = F.when(at == 1, "tool").otherwise(F.col("role")), F.when(at == 2, " \n").otherwise(F.col("text"))
    points = F.when((at == 3) & (F.col("turn") % 2 == 0), 0).when(at == 3, 100_001).otherwise(100_000)
    return _talk(spark, sf).select("conv_id", "turn", C.request_error(role, content, points).alias("error"))


@query("r15_retry_queue", "SELECT l_orderkey AS order_id, l_linenumber AS line FROM lineitem WHERE l_returnflag = 'R' AND l_linenumber % 2 = 1")
def r15(spark, sf):
    state = F.when(F.col("l_returnflag") == "R", "pending").otherwise("done")
    kept = F.when(F.col("l_linenumber") % 2 == 1, "t.png").when(F.col("l_linenumber") % 4 == 2, "")
    return TB.retry_queue(B.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").alias("line"), state.alias("status"), kept.alias("image_path"))).select("order_id", "line")


@query("a06_visual_counts", "SELECT l_suppkey AS doc, count(*) FILTER (l_returnflag = 'A') AS visual_done, count(*) FILTER (l_returnflag = 'R') AS visual_pending, count(*) FILTER (l_returnflag = 'N') AS visual_failed, count(*) FILTER (l_partkey % 3 = 0) AS visual_selected, count(*) FILTER (l_partkey % 3 <> 0) AS visual_skipped FROM lineitem GROUP BY 1")
def a06_visual(spark, sf):
    state = F.when(F.col("l_returnflag") == "A", "done").when(F.col("l_returnflag") == "R", "pending").otherwise("failed")
    return CH.visual_counts(B.table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("doc"), state.alias("status"), (F.col("l_partkey") % 3 == 0).alias("selected")))


@query("s12_parent_lookup", f"SELECT chunk_id, doc_id FROM {CHUNKS} WHERE chunk_kind = 'table_parent' AND doc_id % 3 = 0 QUALIFY row_number() OVER (PARTITION BY source_doc_id, chunk_kind, filename ORDER BY chunk_id) = 1")
def s12(spark, sf):
    points = B.chunks(spark, sf)
    wanted = points.where("doc_id % 3 = 0 and chunk_kind = 'table_parent'").select("source_doc_id", "chunk_kind", "filename").distinct()
    return IX.lookup(points, wanted).select("chunk_id", "doc_id")


PROMPTS = {k: v.replace("'", "''") for k, v in C.PROMPTS.items()}


@query("f39_prompts", "SELECT item_id, kind, replace(replace(template, '{context}', 'Sources of ' || item_id), '{question}', text) AS prompt FROM benchmark, (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in PROMPTS.items()) + ") AS t(kind, template)")
def f39(spark, sf):
    made = F.array(*[F.struct(F.lit(k).alias("kind"), C.prompt(k, F.col("text"), F.concat(F.lit("Sources of "), "item_id")).alias("prompt")) for k in C.PROMPTS])
    return B.table(spark, sf, "benchmark").select("item_id", F.inline(made))


def _structure(spark, sf):
    labels = F.array(*map(F.lit, ("TABLE", "PICTURE", "PARAGRAPH", "TEXT", "CHART", "TEXT")))
    items = _entries(spark, sf).withColumn("label", F.get(labels, F.col("ordinal") % 6)).withColumn("caption", F.when(F.col("ordinal") % 4 < 2, F.concat(F.lit("cap "), F.col("ordinal"))))
    return CH.structure_map(items)


@query("c05_structured_nodes")
def c05(spark, sf):
    return CH.structured_nodes(_structure(spark, sf), 40, 10).select("doc", "place", "part", "chunk_kind", "page", "table_id", F.sha2("text", 256).alias("text_sha256"))


@query("c06_flat_nodes")
def c06(spark, sf):
    texts = B.documents(spark, sf).select(F.col("doc_id").alias("doc"), "text")
    return CH.flat_nodes(texts).select("doc", "part", "chunk_kind", F.sha2("text", 256).alias("text_sha256"))


@query("c08_build_nodes")
def c08(spark, sf):
    """Documents as parsed items, through structure map and nodes, to the chunk rows of the index."""
    texts = T.normalize_markdown(B.documents(spark, sf)).select(F.col("doc_id").alias("doc"), F.col("normalized").alias("text"), "filename")
    built = CH.build_nodes(CH.structured_nodes(_structure(spark, sf)), texts, CH.page_segments(_entries(spark, sf)))
    return built.withColumn("text", F.sha2("text", 256))


@query("p14_chunk_diagnostics")
def p14_all(spark, sf):
    texts = T.normalize_markdown(B.documents(spark, sf)).select(F.col("doc_id").alias("doc"), F.col("normalized").alias("text"), "filename")
    return CH.diagnostics(CH.build_nodes(CH.flat_nodes(texts.select("doc", "text")), texts, CH.page_segments(_entries(spark, sf))))
