"""The vector and postings indexes against plain searches."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.operators import postings as PO
from quarry.operators import search as S
from quarry.operators import vectors as V
from quarry.sources import scratch as SC

VECTORS = "node_id long, v array<double>"


def plain_top(queries, vectors, k):
    out = set()
    for q, a in queries:
        na = sum(x * x for x in a) ** 0.5
        scored = []
        for i, b in vectors:
            if b is None or len(b) != len(a) or None in b or not any(b) or not np.isfinite(b).all():
                continue
            scored.append((-sum(x * y for x, y in zip(a, b, strict=True)) / (na * sum(x * x for x in b) ** 0.5), i))
        out |= {(q, i, r) for r, (_, i) in enumerate(sorted(scored)[:k], 1)}
    return out


def odd_vectors(n=300, dims=6, seed=1):
    """Whole numbers, so that sums are exact; equal vectors far apart, a hot vector, and rows that can't be found."""
    rng = random.Random(seed)
    rows = [(k, [float(rng.randint(-9, 9)) for _ in range(dims)]) for k in range(n)]
    rows += [(n + k, rows[7][1]) for k in range(80)] + [(1000 + k, [2 * x for x in rows[7][1]]) for k in range(5)]
    return [*rows, (2000, None), (2001, [0.0] * dims), (2002, [1.0]), (2003, [None] * dims), (2004, [float("nan")] * dims), (2005, [])]


@pytest.mark.parametrize("query_bytes", [1 << 20, 200])
def test_exact_top_k(spark, query_bytes):
    rows = odd_vectors()
    asked = [(k, v) for k, v in rows[:20] if any(v)]
    got = V.exact_top_k(spark.createDataFrame(asked, "q long, v array<double>"), spark.createDataFrame(rows, VECTORS).repartition(3), 30, query_bytes).collect()
    want = plain_top(asked, rows, 30)
    assert len(got) == len(want) and {(r["q"], r["node_id"]) for r in got} == {(q, i) for q, i, _ in want}
    assert V.exact_top_k(spark.createDataFrame([], "q long, v array<double>"), spark.createDataFrame(rows, VECTORS)).collect() == []
    assert V.exact_top_k(spark.createDataFrame(asked, "q long, v array<double>"), spark.createDataFrame([], VECTORS)).collect() == []


def test_inverted_file_exact(spark):
    """Few probes, then the cells that bounds allow: the rows of a plain search; cells of many rows, also with a hot vector."""
    rows = odd_vectors()
    table = spark.createDataFrame(rows, VECTORS).repartition(3)
    asked = [(k, v) for k, v in rows[:20] if any(v)]
    centroids = V.fit_centroids(table, 12)
    cells = V.build_cells(table, centroids, block=16).cache()
    assert cells.agg(F.max(F.size("ids"))).first()[0] <= 16 and cells.agg(F.sum("n")).first()[0] == 385
    queries = spark.createDataFrame(asked, "q long, v array<double>")
    exact = {(r["q"], r["node_id"], r["rank"], r["score"]) for r in V.exact_top_k(queries, table, 10).collect()}
    for probes in (1, 3, 12):
        assert {(r["q"], r["node_id"], r["rank"], r["score"]) for r in V.ivf_top_k(queries, cells, centroids, 10, probes, exact=True).collect()} == exact
    empty = spark.createDataFrame([], VECTORS)
    assert V.ivf_top_k(queries, V.build_cells(empty, V.fit_centroids(empty)), V.fit_centroids(empty)).collect() == []


def test_inverted_file_recall(spark):
    """On vectors with clusters few cells hold the neighbours, and no vector meets all queries in the plan."""
    rng = np.random.default_rng(4)
    centre = rng.normal(size=(40, 24))
    rows = [(k, (centre[k % 40] + 0.3 * rng.normal(size=24)).tolist()) for k in range(3000)]
    table = spark.createDataFrame(rows, VECTORS)
    queries = spark.createDataFrame([(k, v) for k, v in rows[:50]], "q long, v array<double>")
    centroids = V.fit_centroids(table)
    cells = V.build_cells(table, centroids).cache()
    found = V.ivf_top_k(queries, cells, centroids, 24, probes=6)
    best = {(r["q"], r["node_id"]) for r in V.exact_top_k(queries, table, 24).collect()}
    assert len({(r["q"], r["node_id"]) for r in found.collect()} & best) >= 0.9 * len(best)
    assert "NestedLoop" not in found._jdf.queryExecution().toString() and "Cartesian" not in found._jdf.queryExecution().toString()


def test_query_recall(spark, sf):
    from quarry.plans import queries as Q

    row = Q.j01_ivf(spark, sf).agg(F.avg("recall").alias("r"), F.min("recall").alias("least")).first()
    assert row["r"] >= 0.9


@pytest.mark.parametrize("width,first", [(1, 1), (4, 2), (32, 8)])
def test_postings_against_plain_search(spark, width, first):
    rng = random.Random(width)
    words = [f"w{min(rng.randrange(60), rng.randrange(60))}" for _ in range(4000)]
    docs = [(k, " ".join(rng.choice(words) for _ in range(rng.choice([0, 3, 20, 300])))) for k in range(300)] + [(300, None), (301, ""), (302, "w0 " * 500), (303, "w0 " * 500)]
    asked = [(q, " ".join(rng.choice(words) for _ in range(rng.randint(0, 6)))) for q in range(25)] + [(25, None), (26, "never seen")]
    texts, queries = spark.createDataFrame(docs, "node_id long, text string").repartition(3), spark.createDataFrame(asked, "q long, text string")
    terms = S.term_counts(queries, "q").withColumnRenamed("tf", "weight")
    found, read = PO.search(terms, PO.build_postings(texts, S.tokens, width).cache(), 5, first)
    want = {tuple(r) for r in S.sparse_top_k(queries, texts, 5).select("q", "node_id", "score", "rank").collect()}
    assert {tuple(r) for r in found.select("q", "node_id", "score", "rank").collect()} == want
    steps = {r["step"]: r["postings"] for r in read.collect()}
    assert steps["ahead"] + steps["rest"] <= steps["all"]


def test_postings_are_skipped(spark, sf):
    """On the documents a part of the postings is never read."""
    texts = spark.read.parquet(f"{sf}/documents.parquet").select(F.col("doc_id").alias("node_id"), "text")
    queries = spark.read.parquet(f"{sf}/benchmark.parquet").select(F.col("item_id").alias("q"), "text")
    _, read = PO.search(S.term_counts(queries, "q").withColumnRenamed("tf", "weight"), PO.build_postings(texts, S.tokens).cache(), 3, 8)
    steps = {r["step"]: r["postings"] for r in read.collect()}
    assert steps["ahead"] + steps["rest"] < 0.5 * steps["all"], steps


def test_published_once(spark, tmp_path):
    """An index is built once for an input, and anew when its files change."""
    calls = []

    def build():
        calls.append(1)
        return spark.range(3)

    path = f"{tmp_path}/t"
    spark.range(2).write.parquet(path)
    for _ in range(2):
        assert SC.published(spark, "x", [path], build).count() == 3
    assert len(calls) == 1
    spark.range(1).write.mode("append").parquet(path)
    SC.published(spark, "x", [path], build)
    assert len(calls) == 2


def test_text_vectors(spark):
    docs = spark.createDataFrame([(1, "red apples and green apples"), (2, "green apples grow"), (3, "the of and"), (4, None)], "node_id long, text string")
    counts = V.feature_counts(docs, "node_id", ["and", "the", "of"])
    assert {(r["feature"], r["tf"]) for r in counts.where("node_id = 1").collect()} == {("red", 1), ("apples", 2), ("green", 1), ("red apples", 1), ("apples green", 1), ("green apples", 1)}
    made = {r["node_id"]: r["v"] for r in V.project(counts, V.feature_weights(counts, 4), "node_id").collect()}
    assert set(made) == {1, 2} and all(len(v) == V.DIMS for v in made.values()) and any(made[1])


def test_text_vectors_in_one_pass(spark, monkeypatch):
    """The documents' and the questions' vectors are those of counts, weights and projection, in any number of parts."""
    rng = random.Random(8)
    docs = [(k, " ".join(f"w{min(rng.randrange(40), rng.randrange(40))}" for _ in range(rng.choice([0, 1, 5, 60])))) for k in range(80)] + [(80, None), (81, "The OF x Kelvin w1 w2 w1 w2")]
    texts, asked = spark.createDataFrame(docs, "key long, text string").repartition(3), spark.createDataFrame([(0, "w1 w2 never seen"), (1, "nothing known")], "key long, text string")
    counts = V.feature_counts(texts, "key", ["of", "the"])
    weights = V.feature_weights(counts, len(docs))
    want = {(True, *map(repr, r)) for r in V.project(counts, weights, "key").collect()} | {(False, *map(repr, r)) for r in V.project(V.feature_counts(asked, "key", ["of", "the"]), weights, "key").collect()}
    for part_bytes, sent in ((8 << 20, 10**5), (100, 7)):
        monkeypatch.setattr(V, "PART_BYTES", part_bytes)
        monkeypatch.setattr(V, "SENT", sent)
        assert {(r["own"], repr(r["key"]), repr(r["v"])) for r in V.text_vectors(texts, "key", ["of", "the"], asked).collect()} == want
    assert V.text_vectors(texts.limit(0), "key", [], asked).collect() == []


def test_text_vectors_parts_grow(spark):
    """As many parts as the texts need, which adaptive execution doesn't merge: ten times the texts are ten times the parts, not larger ones."""
    texts = spark.range(40).select(F.col("id").alias("key"), F.expr("repeat('one two three four ', 100000)").alias("text"))
    for n in (1, 4):
        many = texts.crossJoin(spark.range(n).withColumnRenamed("id", "copy")).select((F.col("key") + 40 * F.col("copy")).alias("key"), "text")
        assert V.text_vectors(many, "key", []).rdd.getNumPartitions() == max(spark.sparkContext.defaultParallelism, -(-40 * n * 1_900_000 // V.PART_BYTES))


def test_text_vectors_ask_once_for_a_part(spark):
    """What travels for a feature that every text has is a row's share of each part's, not a row of each text; texts of a repeated key are one."""
    texts = spark.createDataFrame([(k % 500, f"same words w{k % 500}") for k in range(1000)], "key long, text string")
    counts = V.feature_counts(texts, "key", [])
    want = {repr(tuple(r)) for r in V.project(counts, V.feature_weights(counts, 1000), "key").collect()}
    assert {repr((r["key"], r["v"])) for r in V.text_vectors(texts, "key", []).collect()} == want
    every = texts.select(F.lit(True).alias("own"), "key", "text", F.pmod("key", F.lit(4)).cast("int").alias("part"))
    asks = every.repartitionById(4, "part").mapInArrow(V._asks("key", [], 3), "part int, bucket int, first long, digests binary, held binary").collect()
    digests = [d for r in asks for d in V.np.frombuffer(r["digests"], V.np.uint64).tolist()]
    assert len(digests) == 2 * 500 + 4 * 3 and len(set(digests)) == 2 * 500 + 3 and len(asks) <= 12
    assert sum(int(V.np.frombuffer(r["held"], V.np.uint32).sum()) for r in asks) == 5 * 500


@pytest.mark.parametrize("weight_bytes", [1 << 20, 900])
def test_scan_top_k(spark, weight_bytes):
    """One pass over the texts gives the rows of the plain search, also in blocks of queries and with struct ids."""
    rng = random.Random(3)
    docs = [(k, " ".join(f"w{min(rng.randrange(60), rng.randrange(60))}" for _ in range(rng.choice([0, 3, 20, 300])))) for k in range(1300)] + [(5000 + k, "w0 w1 w2") for k in range(40)] + [(6000, None), (6001, "W0 the w0, W1")]
    asked = [(q, " ".join(f"w{rng.randrange(70)}" for _ in range(rng.randint(0, 6)))) for q in range(25)] + [(25, None), (26, "never seen"), (27, "the of")]
    texts, queries = spark.createDataFrame(docs, "node_id long, text string").repartition(3), spark.createDataFrame(asked, "q long, text string")
    got = S.scan_top_k(queries.select(F.struct("q", F.lit(1).alias("ix")).alias("q"), "text"), texts, 5, weight_bytes)
    want = {tuple(r) for r in S.sparse_top_k(queries, texts, 5).select("q", "node_id", "score", "rank").collect()}
    assert {tuple(r) for r in got.select("q.q", "node_id", "score", "rank").collect()} == want
    assert S.scan_top_k(queries.limit(0), texts).collect() == [] and S.scan_top_k(queries, texts.limit(0)).collect() == []
