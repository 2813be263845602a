"""Ranking: fusion, reranking, diversification, parent expansion. Order is explicit: every tie has a column that breaks it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ids import doc_key


def top_k(df: DataFrame, by: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first k rows of each group with their rank from 1; Spark cuts groups to k rows before the shuffle."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(rank) <= k)


def latest(queue: DataFrame, order: list[str], most: int = 512) -> DataFrame:
    """The last rows of a queue that holds at most so many, by ascending columns: each task keeps its own last ones, which are merged."""
    return queue.orderBy(*map(F.desc, order)).limit(most)


def reciprocal_rank_fusion(lists: DataFrame, k: int, rrf_k: int = 60) -> DataFrame:
    """(q, node_id, score, rank) of ranked lists (q, list_ix, rank, node_id, score): the sum of 1/(rrf_k + rank); ties in order of list, then rank.
    A query with one list keeps its scores."""
    per = lists.groupBy("q", "node_id").agg(
        F.sum(F.lit(1.0) / (F.lit(rrf_k) + F.col("rank"))).alias("fused"), F.min(F.struct("list_ix", "rank")).alias("first"), F.min_by("score", F.struct("list_ix", "rank")).alias("own"),
        F.max("list_ix").alias("last_list"),
    )
    own = Window.partitionBy("q")
    scored = per.withColumn("one", F.min("first.list_ix").over(own) == F.max("last_list").over(own)).withColumn("score", F.when(F.col("one"), F.col("own")).otherwise(F.col("fused")))
    place = F.when(F.col("one"), F.col("first.rank")).otherwise(0)
    return top_k(scored, ["q"], [place, F.desc("fused"), "first.list_ix", "first.rank"], k).select("q", "node_id", "score", "rank")


def rerank(candidates: DataFrame, k: int = 8, least: float = 0.001) -> DataFrame:
    """(q, node_id, score, pos): by score, missing ones last, the first k, then those of at least the least score."""
    return top_k(candidates, ["q"], [F.desc(F.coalesce("score", F.lit(-1.0))), "pos"], k).where(F.col("score") >= least)


def rerank_scored(candidates: DataFrame, scorer: Callable[[DataFrame], DataFrame], k: int = 8, least: float = 0.001) -> DataFrame:
    """rerank() by what scorer adds as column `scored` (null: it failed); a query for which it failed anywhere keeps its own scores."""
    failed = F.max(F.when(F.col("scored").isNull(), 1).otherwise(0)).over(Window.partitionBy("q")) == 1
    return rerank(scorer(candidates).withColumn("score", F.when(failed, F.col("score")).otherwise(F.col("scored"))).drop("scored"), k, least)


def diversify(candidates: DataFrame, most: int = 5, per_doc: int = 2) -> DataFrame:
    """At most `most` of each query's (q, pos, node_id, doc), first those within per_doc of their document, then the others; a node once."""
    first = candidates.withColumn("again", F.row_number().over(Window.partitionBy("q", "node_id").orderBy("pos"))).where("again = 1").drop("again")
    key = doc_key(F.col("doc").cast("string"), F.col("node_id").cast("string"))
    within = F.row_number().over(Window.partitionBy("q", key).orderBy("pos"))
    late = F.lit(0) if per_doc <= 0 else F.when(within <= per_doc, 0).otherwise(1)
    return top_k(first.withColumn("late", late), ["q"], ["late", "pos"], max(0, most)).drop("late")


def best_anchors(candidates: DataFrame) -> DataFrame:
    """Of each (q, doc, parent) the anchor of the highest score, the first of equal ones; a missing score counts as 0."""
    return top_k(candidates, ["q", "doc", "parent_id"], [F.desc(F.coalesce("score", F.lit(0.0))), "pos"], 1, "_rn").drop("_rn")


def expand_parents(candidates: DataFrame, parents: DataFrame, k: int = 24) -> DataFrame:
    """Table anchors give way to their parents. candidates: (q, pos, node_id, doc, kind, parent_id, score); parents: (doc, parent_id, node_id).

    Other rows pass, each node once. Of each table the best anchor counts; it goes if its parent is a candidate (which keeps its own score),
    becomes the parent with a score of 1e-6 more if that exists, and stays if not. The first k by score, missing ones last, then place."""
    anchor = (F.col("kind") == "table_anchor") & F.col("doc").isNotNull() & F.col("parent_id").isNotNull()
    passing = candidates.where(~F.coalesce(anchor, F.lit(False)))
    passing = top_k(passing, ["q", "node_id"], ["pos"], 1, "_rn").drop("_rn")
    best = best_anchors(candidates.where(anchor))
    present = passing.where("kind = 'table_parent'").select("q", "doc", "parent_id").distinct()
    left = best.join(present, ["q", "doc", "parent_id"], "left_anti")
    found = left.join(parents.select("doc", "parent_id", F.col("node_id").alias("parent_node")), ["doc", "parent_id"], "left")
    has = F.col("parent_node").isNotNull()
    moved = found.withColumn("node_id", F.coalesce("parent_node", "node_id")).withColumn("kind", F.when(has, "table_parent").otherwise(F.col("kind"))).withColumn("score", F.when(has, F.coalesce("score", F.lit(0.0)) + 1e-6).otherwise(F.col("score"))).drop("parent_node")
    both = passing.unionByName(moved.select(*passing.columns))
    return top_k(both, ["q"], [F.desc_nulls_last("score"), "pos"], k)
