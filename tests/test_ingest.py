"""Items from HTML, the ingestion of files, the versioned index, and paging."""

import html.parser
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quarry.operators import index as IX
from quarry.operators import ingest as IN
from quarry.operators.store import ChunkStore, Conflict, PagedTable
from quarry.sources import html as H
from quarry.streaming.ingest import upsert_stream

PAGE = """<!DOCTYPE html><html><head><title>A &amp; B</title><style>p{}</style></head><body><nav><ul><li>menu</li></ul></nav>
<h1>Head<br>line</h1><p>One<p>two <b>bold</b> &lt;x&gt;<ul><li>first<li>second</ul>
<table><caption>Sizes</caption><tr><th>a<th>b</tr><tr><td>1 | 2<td>3</table>
<figure><img src=x alt="a cat"><figcaption>The cat</figcaption></figure><hr><pre>keep
 this</pre><div>loose text<script>var t="</p>";</script> more</div></span><!-- gone <p>not</p> --><footer>foot</footer><p>open"""


def test_items():
    assert H.read_items(PAGE) == [
        ["TITLE", "A & B", None, 1], ["SECTION_HEADER", "# Head line", None, 1], ["PARAGRAPH", "One", None, 1], ["PARAGRAPH", "two bold <x>", None, 1], ["LIST_ITEM", "- first", None, 1], ["LIST_ITEM", "- second", None, 1],
        ["TABLE", "| a | b |\n|---|---|\n| 1 \\| 2 | 3 |", "Sizes", 1], ["PICTURE", "a cat", "The cat", 1], ["CODE", "keep\n this", None, 2], ["TEXT", "loose text more", None, 2], ["PARAGRAPH", "open", None, 2],
    ]


class Plain(html.parser.HTMLParser):
    """All text outside of scripts and the like, by another reader."""

    def __init__(self):
        super().__init__()
        self.skipped, self.out = 0, []

    def handle_data(self, data):
        self.out.append(data)


def test_items_of_malformed_pages():
    """Any markup is read without an error, and text outside of what is no content is in some item."""
    rng = random.Random(6)
    bits = ["<p>", "</p>", "<b>", "</b>", "<div class='a'>", "</div>", "<ul>", "<li>", "</ul>", "<h2>", "</h2>", "word", " and ", "&amp;", "<br>", "<a href=\"x>y\">", "</a>", "<table>", "<tr>", "<td>", "</table>", "<!-- c -->", "</i>", "<3", "<", ">", "<img alt=q>", "<hr/>"]
    for _ in range(500):
        page = "".join(rng.choice(bits) for _ in range(rng.randint(0, 40)))
        items = H.read_items(page)
        assert all(i[3] >= 1 for i in items)
        if "<table" not in page and "<3" not in page and "<<" not in page and page.count("<") == page.count(">"):
            plain = Plain()
            plain.feed(page)
            plain.close()
            got = "".join("".join(i[1].split()) for i in items if i[0] != "PICTURE").replace("-", "").replace("#", "")
            want = "".join("".join(plain.out).split()).replace("-", "").replace("#", "")
            if "<" not in want:
                assert got == want, page


def test_references_end_with_a_semicolon():
    """A heading that was cut within a reference keeps what is left of it, as the SQL of s03_headings and s03_html_text does."""
    assert [i[:2] for i in H.read_items("<h1>a&amp;b&amp</h1><p>&lt;x&gt; &#65; &copy 2020 &ampx; &quot;</p>")] == [["SECTION_HEADER", "# a&b&amp"], ["PARAGRAPH", '<x> A &copy 2020 &ampx; "']]


def test_items_table(spark):
    pages = spark.createDataFrame([(1, PAGE, "c"), (2, None, "c"), (3, "", None), (None, "<p>no id", "c"), (5, "<p>" * 50_000, "c")], "page_id long, html string, doc string")
    rows = H.html_items(pages).collect()
    assert {r["doc"] for r in rows} == {1, None} and [r["ordinal"] for r in rows if r["doc"] == 1] == list(range(11))
    assert H.html_items(pages.limit(0)).collect() == []


def test_ingest(spark):
    pages = spark.createDataFrame([(1, PAGE), (2, "<p>" + "A sentence of some length here. " * 400), (3, "<script>x</script>")], "page_id long, html string")
    files = spark.createDataFrame([(1, "a.pdf"), (2, "b.pdf"), (3, "empty.pdf"), (4, "missing.pdf")], "doc long, filename string")
    first = IN.ingest(files, H.html_items(pages), tokens=100, overlap=0)
    report = {r["filename"]: r for r in first.report.collect()}
    assert {k: r["status"] for k, r in report.items()} == {"a.pdf": "ingested", "b.pdf": "ingested", "empty.pdf": "failed", "missing.pdf": "failed"}
    a, b = report["a.pdf"], report["b.pdf"]
    assert (a["table_count"], a["figure_count"], a["table_parent_count"], a["replaced_points"]) == (1, 1, 1, 0) and a["table_anchor_count"] > 0 and a["doc_id"].startswith("doc_")
    assert b["chunks"] > 10 and b["text_count"] == 1 and b["empty_chunk_count"] == 0 and b["global_summary"].startswith("- A sentence")
    chunks = first.chunks.where("filename = 'a.pdf'").orderBy("chunk_index").collect()
    assert [c["chunk_index"] for c in chunks] == list(range(len(chunks))) and {c["content_type"] for c in chunks} == {"text", "table", "figure"}
    assert [c["section_title"] for c in chunks if c["text"].startswith("keep")] == ["Head line"] and len({c["chunk_id"] for c in chunks}) == len(chunks)
    # The same file again replaces its chunks; other files keep theirs.
    again = IN.ingest(files.where("doc = 1"), H.html_items(pages.where("page_id = 1")), first.index, tokens=100, overlap=0)
    assert again.report.first()["replaced_points"] == len(chunks) == again.report.first()["chunks"] and again.index.count() == first.index.count()


def test_preview(spark):
    structure = spark.createDataFrame([(1, 0, "text", "one "), (1, 1, "table", "| t |"), (2, 0, "text", " ")], "doc long, ordinal long, type string, content string")
    normalized = spark.createDataFrame([(1, "n1"), (2, "n2"), (3, "n3")], "doc long, text string")
    assert {r["doc"]: r["preview"] for r in IN.preview(structure, normalized).collect()} == {1: "one\n\n| t |", 2: "n2", 3: "n3"}


CHUNK = "chunk_id string, source_doc_id string, filename string, chunk_index int, chunk_kind string, schema_version int"


def rows_of(files, per, version=1, kind="text"):
    return [(f"{f}:{k:03d}:{version}", f"doc_{f}", f, k, kind if k % 3 else None, version) for f in files for k in range(per)]


def plain_catalog(df):
    return sorted(map(repr, IX.catalog(df).collect()))


def test_store_rewrites_touched_buckets(spark, tmp_path):
    store = ChunkStore(spark, str(tmp_path), buckets=6)
    assert store.read().count() == 0 and store.catalog().count() == 0 and store.delete(spark.createDataFrame([("a",)], "filename string")) == 0
    names = [f"f{k}" for k in range(20)]
    now = {f: rows_of([f], 5) for f in names}
    assert store.upsert(spark.createDataFrame(sum(now.values(), []), CHUNK)) == 1
    before = store.manifest()["buckets"]
    now["f3"], now["new"] = rows_of(["f3"], 2, 2, "table_parent"), rows_of(["new"], 1, 2)
    assert store.upsert(spark.createDataFrame(now["f3"] + now["new"], CHUNK)) == 2
    after = store.manifest()["buckets"]
    assert sum(before.get(k) != v for k, v in after.items()) <= 2  # of six buckets at most the two keys' own were rewritten
    assert sorted(map(tuple, store.read().select(*[c.split()[0] for c in CHUNK.split(", ")]).collect()), key=repr) == sorted(sum(now.values(), []), key=repr)
    assert plain_catalog(store.read()) == sorted(map(repr, store.catalog().collect()))
    store.delete(spark.createDataFrame([("f3",), ("f5",), ("never",)], "filename string"))
    assert {r["filename"] for r in store.read().select("filename").distinct().collect()} == {*now} - {"f3", "f5"}
    assert plain_catalog(store.read()) == sorted(map(repr, store.catalog().collect()))
    assert [r["chunk_index"] for r in store.get("f7").collect()] == list(range(5)) and store.get("f3").count() == 0
    assert store.read(1).count() == 100  # older versions stay readable


def test_store_two_writers(spark, tmp_path, monkeypatch):
    """Of two writers that began at one version the second is refused; trying again keeps both changes."""
    one, two = ChunkStore(spark, str(tmp_path), buckets=4), ChunkStore(spark, str(tmp_path), buckets=4)
    one.upsert(spark.createDataFrame(rows_of(["a", "b"], 2), CHUNK))
    began = two.manifest()
    one.upsert(spark.createDataFrame(rows_of(["a"], 3, 2), CHUNK))
    with monkeypatch.context() as m:
        m.setattr(two, "manifest", lambda number=None: began)
        with pytest.raises(Conflict):
            two.upsert(spark.createDataFrame(rows_of(["b"], 4, 2), CHUNK))
    assert {r["filename"]: r["count"] for r in one.read().groupBy("filename").count().collect()} == {"a": 3, "b": 2}
    calls = []

    def change(store):
        calls.append(1)
        if len(calls) == 1:
            raise Conflict("first")
        return store.upsert(spark.createDataFrame(rows_of(["b"], 4, 2), CHUNK))

    two.retried(change)
    assert {r["filename"]: r["count"] for r in one.read().groupBy("filename").count().collect()} == {"a": 3, "b": 4}


def test_store_crash_before_the_manifest(spark, tmp_path, monkeypatch):
    """A writer that dies between its files and the manifest changes nothing; the batch runs again, once."""
    store = ChunkStore(spark, str(tmp_path), buckets=4)
    store.upsert(spark.createDataFrame(rows_of(["a", "b"], 2), CHUNK), "s", 0)
    batch = spark.createDataFrame(rows_of(["a"], 5, 2), CHUNK)
    with monkeypatch.context() as m:
        m.setattr(store, "_announce", lambda made: (_ for _ in ()).throw(OSError("died")))
        with pytest.raises(OSError, match="died"):
            store.upsert(batch, "s", 1)
    assert store.manifest()["version"] == 1 and store.read().count() == 4 and len(store.unnamed()) == 1
    assert store.upsert(batch, "s", 1) == 2 and store.upsert(batch, "s", 1) == 2 and store.upsert(batch, "s", 0) == 2
    assert store.read().count() == 7


def test_store_stream_restarts(spark, tmp_path):
    """A stream of chunks ends in the state of its batches, with a restart from the checkpoint between them; the catalog stays the index's."""
    arrivals, store = tmp_path / "in", ChunkStore(spark, str(tmp_path / "store"), buckets=4)
    state = {}
    for k, (files, per) in enumerate([(["a", "b"], 3), (["b", "c"], 1), (["a"], 2)]):
        spark.createDataFrame(rows_of(files, per, k + 1), CHUNK).coalesce(1).write.mode("append").parquet(str(arrivals))
        state |= {f: (per, k + 1) for f in files}
        query = upsert_stream(spark.readStream.schema(CHUNK).parquet(str(arrivals)), store, "arrivals", str(tmp_path / "check"))
        query.processAllAvailable()
        query.stop()
        assert {r["filename"]: (r["n"], r["v"]) for r in store.read().groupBy("filename").agg(F.count("*").alias("n"), F.max("schema_version").alias("v")).collect()} == state
        assert plain_catalog(store.read()) == sorted(map(repr, store.catalog().collect()))


def test_pages(spark, tmp_path):
    """Pages put together are the table, in order; each reads the files that hold it, not the others."""
    rows = spark.range(1000).select(F.md5(F.col("id").cast("string").cast("binary")).alias("point_id"), "id")
    table = PagedTable(rows, str(tmp_path), files=8)
    want = [r["point_id"] for r in rows.orderBy("point_id").collect()]
    for size in (256, 1000, 300):
        got, token, tokens = [], None, []
        while True:
            page, token, files = table.page(token, size)
            got += [r["point_id"] for r in page.collect()]
            assert len(files) <= -(-size // 100) + 3
            if token is None:
                break
            tokens.append(token)
        assert got == want
        assert [r["token"] for r in table.tokens(size).orderBy("page").collect()] == tokens
    assert table.page("zzz")[0].count() == 0 and table.page("zzz")[1] is None
    assert PagedTable(rows.limit(0), str(tmp_path)).page()[1] is None


def test_pages_are_read_in_slices(monkeypatch):
    """A whole Arrow batch's items are never held together: as many slices as its bytes need, the same items in order."""
    pages = [None, "", *[f"<h1>Page {k}</h1><p>{'word ' * (k % 7)}</p>" for k in range(40)]]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(pages)), pa.int64()), pa.array(pages, pa.string())], ["doc", "html"])
    whole = [r for b in H._run(iter([batch])) for r in b.to_pylist()]
    monkeypatch.setattr(H, "READ_BYTES", 100)
    sliced = list(H._run(iter([batch])))
    assert len(sliced) > 10 and [r for b in sliced for r in b.to_pylist()] == whole
    assert max(b.num_rows for b in sliced) <= 8


def test_ingestion_reads_pages_once(spark):
    """Chunks and report come from written items: their plans read no page anew."""
    pages = spark.createDataFrame([(k, f"<h1>Head {k}</h1><p>Some words of page {k}.</p><table><tr><td>a</td></tr></table>") for k in range(3)], "page_id long, html string")
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    files = pages.selectExpr("page_id AS doc", "concat('p', page_id) AS filename")
    made = IN.ingest(files, H.html_items(pages.mapInArrow(counted, pages.schema)))
    assert len({r["source_doc_id"] for r in made.chunks.collect()}) == 3 and made.report.count() == 3
    assert read.value == 3
