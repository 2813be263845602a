import hashlib
import random
import re
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.functions import chat as C
from quarry.functions import digests as D
from quarry.functions import ids
from quarry.functions import tables as TB
from quarry.functions import text as T
from quarry.operators import align as AL
from quarry.operators import answer as A
from quarry.operators import chunk as CH
from quarry.operators import index as IX
from quarry.operators import rank as R
from quarry.operators import vectors as V


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column).first()[0]


def normal(spark, text, keep=False):
    return T.normalize_markdown(spark.createDataFrame([(text,)], "text string"), keep_markers=keep).first()["normalized"]


def test_normalize(spark):
    assert normal(spark, "Page 1 of 10\nThis is a hyphen-\nated word.\n\nPage 2 of 10\nNext line.") == "This is a hyphenated word.\n\nNext line."
    assert normal(spark, "Page 1 of 3\nAlpha\n\nPage 2 of 3\nBeta", True).count("Page") == 2
    assert normal(spark, "ﬁne\r\ntwo  blanks") == "fine\ntwo blanks"
    assert normal(spark, None) == ""
    rows = "\n".join(["| Name | Value |", "|---|---|", "| a | 1 |", ""] * 10)
    assert normal(spark, rows).count("| a | 1 |") == 10


def test_boilerplate_share(spark):
    def kept(times, n=100):
        text = "\n".join(["Same line"] * times + [f"A long enough line of its own, number {k}" for k in range(n - times)])
        return normal(spark, text).count("Same line")

    assert kept(4) == 0 and kept(3) == 3 and kept(4, 101) == 4


def test_text(spark):
    assert one(spark, T.trim_text(F.col("t"), 12), t="alpha beta gamma") == "alpha beta..."
    assert one(spark, T.collapse(F.col("t")), t="  what is\n\nthis\tquery about?  ") == "what is this query about?"
    assert one(spark, T.rewrite(F.col("t")), t="What are the traffic traffic analysis features in the application") == "traffic analysis features application"
    assert one(spark, T.rewrite(F.col("t")), t="what is the") == "what is the"
    found = one(spark, T.variants(F.col("t"), 0.7), t="What are the main features of the traffic analysis application?")
    assert found[0]["query"] == "main features traffic analysis application" and sum(v["weight"] for v in found) == pytest.approx(1)
    assert one(spark, T.variants(F.col("t")), t="  ") == []
    assert [one(spark, T.page_label(F.col("t")), t=x) for x in ("Page 3 of 9", "3/9", "0", "5001")] == ["Page 3", "Page 3", None, None]
    assert one(spark, T.normalize_query(F.col("t")), t="  ﬁnd\u00a0the\n\ttable ") == "find the table"
    assert [v["query"] for v in one(spark, T.variants(F.col("t"), enabled=False), t="What is the traffic?")] == ["What is the traffic?"]
    assert one(spark, T.strip(F.col("t")), t="\u3000\x1f x y\u2028\n") == "x y"


def test_splitter(spark):
    text = "Para one. It has sentences; and clauses, yes. End!\n\nPara two is here.\n\nA very long paragraph " + "word " * 50
    for tokens, overlap in ((8, 3), (20, 5), (768, 200)):
        assert "".join(p for p, _ in T._units(text, tokens)) == text
        chunks = T.split_text(text, tokens, overlap)
        assert all(len(c.split()) <= tokens for c in chunks) and chunks[0].startswith("Para one") and chunks[-1].endswith("word")
        assert sum(len(c.split()) for c in chunks) <= len(text.split()) + overlap * len(chunks)
        at = 0
        for c in chunks:  # whole texts: every chunk begins at or before the end of the one before
            here = text.index(c)
            assert here <= at + 1 or not text[at:here].strip()
            at = here + len(c)
    rows = spark.createDataFrame([(1, None), (2, ""), (3, text)], "n int, text string").select("n", T.sentence_chunks(20, 5)("text").alias("c")).collect()
    assert [len(r["c"]) for r in rows[:2]] == [0, 0] and rows[2]["c"] == T.split_text(text, 20, 5)


def test_ids(spark):
    assert one(spark, ids.chunk_id(F.lit("doc"), F.lit(7))) == "doc:chunk:00007"
    assert one(spark, ids.point_uuid(F.lit("doc:chunk:00007"))) == str(uuid.uuid5(uuid.NAMESPACE_URL, "doc:chunk:00007"))


def test_chat(spark):
    assert one(spark, C.citations(F.col("t")), t="Feature A is supported [S1]. Another claim [S2] and repeat [S1].") == ["S1", "S2"]
    have = F.array(*map(F.lit, ("S1", "S2", "S3")))
    valid = lambda *x: one(spark, C.citations_valid(F.array(*map(F.lit, x)) if x else F.array().cast("array<string>"), have))
    assert (valid("S1", "S3"), valid("S4"), valid()) == (True, False, False)
    assert one(spark, C.insufficient(F.col("t")), t="I do not have enough information here") and not one(spark, C.insufficient(F.col("t")), t="It uses OCR [S1].")
    reply = C.router_reply(F.col("t"), F.lit("q"))
    assert one(spark, reply, t='```json\n{"intention": "SUMMARIZATION", "rewritten_query": "x"}\n```')["intention"] == "SUMMARIZATION"
    assert one(spark, reply, t="not json")[:2] == ("SEARCH", "q")
    assert one(spark, C.grounding(F.lit("abc xyz"), F.lit("zabcz"))) == 0.5


def test_tables(spark):
    assert one(spark, TB.split_row(F.lit("|a||"))) == ["a"] and one(spark, TB.split_row(F.lit("|a|b"))) == [] == one(spark, TB.split_row(F.lit("a|")))
    p = lambda n, c, e, s, lane, strong: F.struct(F.lit(n).alias("num_rows"), F.lit(c).alias("num_cols"), F.lit(e).alias("empty_ratio"), F.lit(s).alias("span_ratio"), F.lit(lane).alias("lane"), F.lit(strong).alias("strong"))
    score = lambda *x: one(spark, TB.visual_score(p(*x)))
    assert score(0, 0, 0.0, 0.0, False, False)[0] == 0.0
    assert tuple(score(0, 0, 0.0, 0.0, False, True)) == (0.85, ["strong_visual_keyword"], True)
    found = score(8, 7, 0.65, 0.0, True, False)
    assert found[0] == 0.82 and found[1] == ["lane_headers", "high_empty_cell_ratio", "wide_table", "long_table", "structural_flow_pattern"]
    assert score(3, 5, 0.60, 0.0, True, False)[0] == pytest.approx(0.37)
    once = TB.append_interpretation(F.lit("| a |"), F.lit("flows"))
    assert one(spark, once) == one(spark, TB.append_interpretation(once, F.lit("flows")))


def test_anchors(spark):
    rows = "\n".join(f"| {k} | act {k} | {k} min | out {k} |" for k in range(39))
    df = spark.createDataFrame([(1, "", "| No. | Kegiatan | Waktu | Output |\n|---|---|---|---|\n" + rows)], "order_id long, caption string, content string")
    chunks = CH.table_chunks(df).orderBy("chunk_ix").collect()
    assert [c["chunk_kind"] for c in chunks] == ["table_parent"] + ["table_anchor"] * 5
    assert chunks[2]["text"] == "Roles and lanes: Waktu, Output" and chunks[3]["text"].count("|") == 7


def test_rank(spark):
    lists = spark.createDataFrame([(1, 0, 1, "a", 0.9), (1, 0, 2, "b", 0.8), (1, 1, 1, "b", 5.0), (1, 1, 2, "c", 4.0)], "q int, list_ix int, rank int, node_id string, score double")
    for df in (lists, lists.repartition(3, "node_id")):
        got = R.reciprocal_rank_fusion(df, 24).orderBy("rank").collect()
        assert [r["node_id"] for r in got] == ["b", "a", "c"] and got[0]["score"] == pytest.approx(1 / 62 + 1 / 61)
    only = R.reciprocal_rank_fusion(lists.where("list_ix = 0"), 1).collect()
    assert [(r["node_id"], r["score"]) for r in only] == [("a", 0.9)]
    rows = [(1, k, n, d) for k, (n, d) in enumerate([("a1", "a"), ("a2", "a"), ("a3", "a"), ("b1", "b"), ("c1", "c")])]
    ranked = spark.createDataFrame(rows, "q int, pos int, node_id string, doc string")
    assert [r["node_id"] for r in R.diversify(ranked, 4, 1).orderBy("rank").collect()] == ["a1", "b1", "c1", "a2"]
    again = spark.createDataFrame([(1, 0, "s", "a"), (1, 1, "s", "a"), (1, 2, "b1", "b")], ranked.schema)
    assert [r["node_id"] for r in R.diversify(again, 3, 0).orderBy("rank").collect()] == ["s", "b1"]
    c = spark.createDataFrame([(1, 0, "x", 0.9), (1, 1, "y", 0.8), (1, 2, "z", None)], "q int, pos int, node_id string, score double")
    assert [r["node_id"] for r in R.rerank(c, 3).orderBy("rank").collect()] == ["x", "y"]


def test_parents(spark):
    schema = "q int, pos int, node_id string, doc string, kind string, parent_id string, score double"
    parents = spark.createDataFrame([("d", "t1", "p1")], "doc string, parent_id string, node_id string")
    fetched = R.expand_parents(spark.createDataFrame([(1, 0, "a1", "d", "table_anchor", "t1", 0.7)], schema), parents).collect()
    assert [(r["node_id"], round(r["score"], 6)) for r in fetched] == [("p1", 0.700001)]
    kept = R.expand_parents(spark.createDataFrame([(1, 0, "a1", "d", "table_anchor", "t2", 0.7)], schema), parents).collect()
    assert [r["node_id"] for r in kept] == ["a1"]
    both = R.expand_parents(spark.createDataFrame([(1, 0, "a1", "d", "table_anchor", "t1", 0.9), (1, 1, "p1", "d", "table_parent", "t1", 0.4)], schema), parents).collect()
    assert [(r["node_id"], r["score"]) for r in both] == [("p1", 0.4)]


def test_index(spark):
    rows = [("doc_a", "a.pdf", 0, "text", 2, "a0"), ("doc_a", "a.pdf", 1, "table_parent", 2, "a1"), ("doc_b", "b.pdf", 0, None, 2, "b0")]
    points = spark.createDataFrame(rows, "source_doc_id string, filename string, chunk_index int, chunk_kind string, schema_version int, chunk_id string")
    found = {r["doc_id"]: r for r in IX.catalog(points).collect()}
    assert found["doc_a"]["chunks"] == 2 and found["doc_a"]["max_chunk_index"] == 1 and found["doc_b"]["chunk_kind_counts"] == {"text": 1}
    assert tuple(IX.scan(points, 2).first()) == (2, True) and tuple(IX.scan(points, 3).first()) == (3, False)
    left, gone = IX.delete_by_key(points, "filename", "a.pdf")
    assert (left.count(), gone) == (1, 2)


def test_positions_and_events(spark):
    text = "x" * 30 + "\n" + "The first sentence that is long enough." + "\n" + "The second sentence that is long enough."
    df = spark.createDataFrame([("d", text, ["The first sentence that is long enough.", "short", "The second sentence that is long enough."])], "doc string, text string, parts array<string>")
    assert AL.positions(df).first()["pos"] == [text.index("The first"), None, text.index("The second")]
    events = spark.createDataFrame([("d", 0, "Document"), ("d", 40, "A"), ("e", 9, "B")], "doc string, offset long, label string")
    points = spark.createDataFrame([("d", 1, 39), ("d", 2, 40), ("d", 3, None), ("e", 4, 8), ("f", 5, 1)], "doc string, n int, at long")
    assert {r["n"]: r["label"] for r in CH.as_of(points, events, "at").collect()} == {1: "Document", 2: "A", 3: None, 4: None, 5: None}


def test_build_nodes(spark):
    """Structure map to chunk rows: a table is a parent with anchors, texts around it are chunks, with sections and pages."""
    intro, outro = "The introduction says what this document is about.", "The closing words stand on the last page of it."
    table = "| No | Kegiatan | Waktu |\n|---|---|---|\n| 1 | tulis | 3 hari |"
    items = [("d", 0, "SECTION", "# Scope", None, 1), ("d", 1, "TEXT", intro, None, 1), ("d", 2, "TABLE", table, "Steps", 2), ("d", 3, "PICTURE", "", "A picture", 2), ("d", 4, "TEXT", "## Close", None, 3), ("d", 5, "TEXT", outro, None, 3), ("d", 6, "CAPTION", "gone", None, 3)]
    rows = spark.createDataFrame(items, "doc string, ordinal int, label string, text string, caption string, page int")
    nodes = CH.structured_nodes(CH.structure_map(rows))
    markdown = "\n\n".join(["# Scope", intro, f"**Table: Steps**\n\n{table}", "A picture", "## Close", outro])
    texts = spark.createDataFrame([("d", markdown, "a.pdf")], "doc string, text string, filename string")
    entries = rows.select("doc", "ordinal", "text", "page")
    built = CH.build_nodes(nodes, texts, CH.page_segments(entries)).orderBy("chunk_index").collect()
    kinds = [r["chunk_kind"] for r in built]
    assert kinds[:3] == ["text", "table_parent", "table_anchor"] and kinds[-2:] == ["figure", "text"] and set(kinds[2:-2]) == {"table_anchor"}
    by_kind = {r["chunk_kind"]: r for r in built}
    first, last, parent = built[0], built[-1], by_kind["table_parent"]
    assert first["text"] == f"# Scope\n\n{intro}" and first["chunk_id"] == "d:chunk:00000" and first["total_chunks"] == len(built)
    assert first["section_title"] == "Scope" and last["section_title"] == "Close" and last["page_label"] == "Page 3"
    assert parent["text"].startswith("**Table: Steps**") and parent["table_id"] == "table_0001" and parent["parent_id"] is None and parent["page_label"] == "Page 2"
    assert by_kind["table_anchor"]["parent_id"] == "table_0001" and by_kind["figure"]["text"] == "A picture"
    assert first["point_id"] == str(uuid.uuid5(uuid.NAMESPACE_URL, "d:chunk:00000")) and first["filename"] == "a.pdf"
    told = CH.diagnostics(CH.build_nodes(nodes, texts, CH.page_segments(entries)))
    assert told.count() == len(built) and len(told.columns) == 14
    flat = CH.flat_nodes(texts.select("doc", "text"), 12, 3).collect()
    assert len(flat) > 2 and {r["chunk_kind"] for r in flat} == {"text"}
    empty = CH.page_segments(entries.where("page > 9"), pages=spark.createDataFrame([("d", 4, "A whole page of markdown stands here.")], "doc string, page int, markdown string")).collect()
    assert [(r["page"], r["segments"]) for r in empty] == [(4, ["A whole page of markdown stands here."])]


def test_sources_and_contexts(spark):
    rows = [(1, 1, "n1", "doc_1", "a.pdf", 0.4213579, " text [1] ", "text", "Page 3", "Capabilities"), (1, 2, "n2", None, None, None, "| a |" * 20, "table_parent", None, None)]
    ranked = spark.createDataFrame(rows, "q int, rank int, node_id string, doc string, filename string, score double, text string, kind string, page_label string, section_title string")
    one_, two = A.sources(ranked, most_chars=30).orderBy("n").collect()
    assert (one_["source_id"], one_["page_label"], one_["section_title"], one_["score"], one_["snippet"]) == ("S1", "Page 3", "Capabilities", 0.421358, "text [1]")
    assert (two["doc"], two["filename"], two["chunk_index"], two["chunk_id"], two["score"], two["snippet"]) == ("unknown", "unknown", "?", "n2", None, "| a |" * 20)
    context = A.contexts(A.sources(ranked, most_chars=30)).first()["context"].split("\n\n")
    assert context[0].split("\n") == ["[S1]", "filename: a.pdf", "content_type: text", "chunk_kind: text", "table_id: n/a", "parent_id: n/a", "doc_id: doc_1", "chunk_id: n1", "chunk_index: ?", "page_label: Page 3", "section_title: Capabilities", "content:", "text [1]"]
    assert context[1].startswith("[S2]\nfilename: unknown")


def test_routing_and_settings(spark):
    asked = spark.createDataFrame([(1, "budget?", '{"intention": "SEARCH", "rewritten_query": "ringkasan"}'), (2, "hi", '{"intention": "CHIT_CHAT"}'), (3, "it", '{"intention": "AMBIGUOUS", "clarification_question": "Which one?"}'), (4, "x", "broken")], "q int, text string, reply string")
    assert {r["q"]: (r["action"], r["query"]) for r in A.route(asked).collect()} == {1: ("retrieve", "budget?"), 2: ("chat", "hi"), 3: ("clarify", "it"), 4: ("retrieve", "x")}
    threshold = lambda s, b: one(spark, TB.signal_threshold(F.lit(s).cast("string"), F.lit(b).cast("string")))
    assert [threshold(*x) for x in (("0.4", None), ("3", None), (None, "recall"), ("x", "balanced"), (None, None))] == [0.4, 1.0, 0.55, 0.65, 0.75]
    assert one(spark, C.request_error(F.lit("user"), F.lit("x"), F.lit(0))) == "max_points" and one(spark, C.request_error(F.lit("user"), F.lit("x"), F.lit(1))) is None
    c = spark.createDataFrame([(1, 0, "x", 0.9), (1, 1, "y", 0.8), (2, 0, "x", 0.5), (2, 1, "y", 0.4)], "q int, pos int, node_id string, score double")
    scored = R.rerank_scored(c, lambda d: d.withColumn("scored", F.when((F.col("q") == 1) | (F.col("pos") == 0), F.col("pos") + 1.0)))
    assert [(r["q"], r["node_id"]) for r in scored.orderBy("q", "rank").collect()] == [(1, "y"), (1, "x"), (2, "x"), (2, "y")]


def test_sources_and_sinks(spark, tmp_path):
    from quarry.sources import bindings as B
    from quarry.streaming.ingest import replace_stream

    (tmp_path / "up").mkdir()
    (tmp_path / "up" / "a.PDF").write_bytes(b"%PDF")
    (tmp_path / "up" / "b.txt").write_bytes(b"x")
    assert {r["filename"]: r["status"] for r in B.accepted(B.uploads(spark, str(tmp_path / "up"))).collect()} == {"a.PDF": "accepted", "b.txt": "failed"}
    (tmp_path / "cases.json").write_text('[{"id": "1", "question": "why?"}]')
    cases = B.eval_cases(spark, str(tmp_path / "cases.json"))
    B.eval_report(cases, str(tmp_path / "report"))
    assert spark.read.json(str(tmp_path / "report")).count() == 1
    schema = "point_id string, filename string, v int"
    old = spark.createDataFrame([("p1", "a", 1), ("p2", "b", 1)], schema)
    assert sorted(map(tuple, IX.upsert(old, spark.createDataFrame([("p2", "b", 2), ("p3", "c", 2)], schema)).collect())) == [("p1", "a", 1), ("p2", "b", 2), ("p3", "c", 2)]
    versions = []
    for k, rows in enumerate(([("p1", "a", 1), ("p2", "b", 1)], [("p9", "b", 2)])):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        arrivals = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        run = replace_stream(arrivals, str(tmp_path / "index"), lambda: spark.read.parquet(versions[-1]) if versions else None, lambda path, batch: versions.append(path), str(tmp_path / "check"))
        run.processAllAvailable()
        run.stop()
        assert len(versions) == k + 1
    assert sorted(map(tuple, spark.read.parquet(versions[-1]).collect())) == [("p1", "a", 1), ("p9", "b", 2)]


def test_refusal(spark):
    df = spark.createDataFrame([("No.", "No.", ["S1"]), ("No.", "Yes [S1].", ["S1"]), ("Yes [S1].", "", ["S1"])], "first string, second string, source_ids array<string>")
    assert [r["outcome"] for r in A.enforce_citations(df).collect()] == ["refused", "retry", "first"]


def test_dense_search_in_blocks(spark):
    """More queries than one block: each gets its neighbours, each block is within the stated size."""
    vectors = spark.range(1_300).select(F.col("id").alias("node_id"), F.array(F.cos(F.col("id") * 0.001), F.sin(F.col("id") * 0.001)).alias("v"))
    queries = vectors.withColumnRenamed("node_id", "q").where("q < 1100")
    near = vectors.where("node_id % 10 = 0")
    got = V.exact_top_k(queries, near, 1, query_bytes=4_000).collect()
    assert len(got) == 1_100 and all(abs(r["q"] - r["node_id"]) <= 5 for r in got)


HARD_TEXTS = {
    "blank-free": "x" * 500_000, "chinese": "这是一个很长的句子没有空格。" * 10_000, "marks": "word " * 800 + "!" * 100_000, "blanks": "a" + " " * 200_000 + "b", "lines": "\n" * 100_000 + "end",
    "mixed": ("Ein Satz, und noch einer; dann? " * 30 + "\n\n") * 50, "emoji": "🙂" * 30_000, "thai": "ภาษาไทยไม่มีช่องว่าง" * 3_000,
}


@pytest.mark.parametrize("name", list(HARD_TEXTS))
def test_chunks_keep_their_bound(name):
    """No chunk has more tokens than allowed, nothing but blanks at the edges is lost, and the time is linear."""
    import time

    text = HARD_TEXTS[name]
    begin = time.time()
    chunks = T.split_text(text, 768, 0)
    assert time.time() - begin < 5
    assert all(len(T.plain_tokens(c)) <= 768 for c in chunks)
    assert "".join("".join(chunks).split()) == "".join(text.split())
    assert all(len(T.plain_tokens(c)) <= 768 for c in T.split_text(text[:20_000], 768, 200))


def test_chunks_by_a_tokenizer():
    import pathlib

    path = pathlib.Path("/opt/tokenizers/word_bpe_49k.json")
    if not path.exists():
        pytest.skip("no tokenizer file")
    ends = T.subwords(path.read_text())
    for text in ("plain words of a text. " * 400, "这是一个很长的句子。" * 500, "xq7" * 2_000):
        chunks = T.split_text(text, 100, 20, ends)
        assert len(chunks) > 1 and "".join("".join(T.split_text(text, 100, 0, ends)).split()) == "".join(text.split())
        assert all(len(ends(c)) <= 110 for c in chunks)  # a cut between units may part a token in two


def test_units_join_to_the_text():
    import random

    rng = random.Random(9)
    for _ in range(300):
        text = "".join(rng.choice(["a", "bc ", " ", "\n", "\n\n", ". ", "!", ",", "。", "字", "x" * 20]) for _ in range(rng.randint(0, 120)))
        for tokens in (1, 2, 5, 40):
            units = T._units(text, tokens)
            assert "".join(p for p, _ in units) == text and all(n <= tokens and n == len(T.plain_tokens(p)) for p, n in units)


def test_chunks_without_a_shuffle(spark, sf):
    """Chunks are numbered in their document's row: no line is shuffled."""
    from quarry.sources import bindings

    assert "Exchange" not in bindings.chunks(spark, sf)._jdf.queryExecution().executedPlan().toString()


def test_word_bytes():
    for text in ("", "a", "K9 Straße \u0130X \u212aelvin é1\x00b_c\ufeff9", "Of  THE\n\n2 x-ray\u0660\u0661 ２３"):
        assert [w.decode() for w in T.word_bytes(text)] == re.findall("[a-z0-9]+", text.lower())


def test_md5_heads_of_words_and_pairs():
    """Words and pairs at the edges of a block of the digest, longer ones too, and more of them than are worked on together."""
    deal = random.Random(5)
    words = [bytes(deal.choice(b"abz019") for _ in range(n)) for n in [1, 2, D.SHORT - 1, D.SHORT, D.SHORT + 1, 54, 55, 56, 63, 64, 65, 500] * 12]
    first, second = (np.array([deal.randrange(len(words)) for _ in range(D.TOGETHER + 100)]) for _ in range(2))
    want = [hashlib.md5(m).digest()[:8] for m in [*words, *(words[a] + b" " + words[b] for a, b in zip(first, second, strict=True))]]
    assert D.md5_heads(words, first, second).astype(">u8").tobytes() == b"".join(want)
    none = np.zeros(0, np.int64)
    assert not len(D.md5_heads([], none, none)) and len(D.md5_heads([b"ab"], none, none)) == 1
