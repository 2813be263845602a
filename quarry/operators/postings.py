"""A postings index with impact bounds, and top-k search on it.

Texts are dealt to ranges of similar length (about WIDTH texts each), and a posting row holds a token's texts of one range with their term counts and
the greatest of them. A query's score in a range is at most the sum of its weights times these. The search looks first into each query's few ranges of
greatest bound; the k-th score found there is a threshold, and of the other ranges only those are read whose bound reaches it. No text that can be among
the first k is lost. A frequent token is many rows, one a range, so no task gets all of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import written
from .rank import top_k

#: Texts of a range on average, ranges that a query looks into first, and terms of all queries (about 50 bytes each) up to which they are sent to every task.
WIDTH, FIRST, BROADCAST_TERMS = 8, 16, 500_000


def build_postings(docs: DataFrame, terms, width: int = WIDTH) -> DataFrame:
    """(token, part, most, nodes array<(node_id, tf)>) of docs (node_id, text); terms: a function from a text column to its array of tokens. Ranges are
    bands of length (a quarter of a doubling each), and within a band equal shares by hash. Texts are dealt by id before they are taken apart, so
    their counts need no shuffle."""
    worded = docs.select("node_id", "text").repartition(F.col("node_id")).select("node_id", F.explode(F.array(terms(F.coalesce("text", F.lit(""))))).alias("words")).withColumn("band", F.floor(4 * F.log2(F.size("words") + 1)))
    shares = worded.groupBy("band").agg(F.greatest(F.lit(1), F.ceil(F.count("*") / width)).alias("shares"))
    dealt = worded.join(F.broadcast(shares), "band")  # at most a row for each quarter of a doubling of the longest text
    part = F.shiftleft("band", 40) + F.pmod(F.xxhash64("node_id"), F.col("shares"))
    counted = dealt.select(part.alias("part"), "node_id", F.explode("words").alias("token")).groupBy("part", "node_id", "token").agg(F.count("*").cast("int").alias("tf"))
    return counted.groupBy("token", "part").agg(F.max("tf").alias("most"), F.collect_list(F.struct("node_id", "tf")).alias("nodes"))


def _scores(asked: DataFrame, postings: DataFrame) -> DataFrame:
    """(q, node_id, score) in the asked (q, part, token, weight)."""
    met = postings.join(asked, ["token", "part"]).select("q", "weight", F.explode("nodes").alias("n"))
    return met.groupBy("q", "n.node_id").agg(F.sum(F.col("weight") * F.col("n.tf")).alias("score"))


def postings_top_k(terms: DataFrame, postings: DataFrame, k: int = 24, first: int = FIRST) -> DataFrame:
    """(q, node_id, score, rank): the k texts of greatest inner product with the queries' terms (q, token, weight), weights not negative, ties by node_id."""
    found, _ = search(terms, postings, k, first)
    return found


def search(terms: DataFrame, postings: DataFrame, k: int = 24, first: int = FIRST) -> tuple[DataFrame, DataFrame]:
    """(postings_top_k()'s rows, (step, pairs, postings): pairs of query and posting row, and their postings, that each step has read, and all there are)."""
    few = terms.count() <= BROADCAST_TERMS
    sent = F.broadcast(terms) if few else terms
    bounds = postings.select("token", "part", "most", F.size("nodes").alias("n")).join(sent, "token").select("q", "part", "token", "weight", (F.col("weight") * F.col("most")).alias("bound"), "n")
    parts = written(bounds.groupBy("q", "part").agg(F.sum("bound").alias("bound"), F.collect_list(F.struct("token", "weight", "n")).alias("terms")), "bounds")
    ahead = written(top_k(parts, ["q"], [F.desc("bound"), "part"], first, "_first").drop("_first"), "ahead")
    spread = lambda p: p.select("q", "part", F.inline("terms")).drop("n")
    near = written(top_k(_scores(spread(ahead), postings), ["q"], [F.desc("score"), "node_id"], k).drop("rank"), "near")
    kth = near.groupBy("q").agg(F.when(F.count("*") >= k, F.min("score")).otherwise(0.0).alias("kth"))
    rest = parts.join(kth, "q", "left").where(F.col("bound") >= F.coalesce("kth", F.lit(0.0))).select("q", "part", "terms").join(ahead.select("q", "part"), ["q", "part"], "left_anti")
    every = near.unionByName(_scores(spread(rest), postings))
    read = lambda step, p: p.select(F.explode("terms").alias("t")).agg(F.lit(step).alias("step"), F.count("*").alias("pairs"), F.coalesce(F.sum("t.n"), F.lit(0)).alias("postings"))
    return top_k(every, ["q"], [F.desc("score"), "node_id"], k), read("ahead", ahead).unionByName(read("rest", rest)).unionByName(read("all", parts))
