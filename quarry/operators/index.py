"""The chunk index as tables: catalog, totals, lookups, replace and delete by key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rank import top_k


def catalog(points: DataFrame) -> DataFrame:
    """One row per document of (source_doc_id, filename, chunk_index, chunk_kind, schema_version, chunk_id): counts by kind as a map in order of keys.
    Two sums, by document and kind and then by document, so that a large document is summed where it lies."""
    rows = points.select(F.coalesce("source_doc_id", F.lit("unknown")).alias("doc_id"), F.coalesce("filename", F.lit("unknown")).alias("filename"), "chunk_index", F.coalesce("chunk_kind", F.lit("text")).alias("kind"), "schema_version", "chunk_id")
    per_kind = rows.groupBy("doc_id", "kind").agg(F.count("*").alias("n"), F.max("chunk_index").alias("most"), F.min(F.struct("chunk_id", "filename")).alias("first"), F.collect_set("schema_version").alias("versions"))
    return per_kind.groupBy("doc_id").agg(
        F.min("first").alias("first"), F.sum("n").alias("chunks"), F.max("most").alias("max_chunk_index"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("kind", "n")))).alias("chunk_kind_counts"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("versions")))).alias("schema_versions"),
    ).select("doc_id", F.col("first.filename").alias("filename"), "chunks", "max_chunk_index", "chunk_kind_counts", "schema_versions")


def totals(points: DataFrame) -> DataFrame:
    return points.agg(F.count_distinct("source_doc_id").alias("total_documents"), F.count("*").alias("total_chunks"))


def scan(points: DataFrame, most: int) -> DataFrame:
    """(scanned_points, truncated): one more row than the cap is asked for; it tells whether a next page exists."""
    return points.select(F.lit(1).alias("x")).limit(most + 1).agg(F.count("*").alias("n")).select(F.least("n", F.lit(most)).cast("long").alias("scanned_points"), (F.col("n") > most).alias("truncated"))


def lookup(points: DataFrame, wanted: DataFrame, order: str = "chunk_id") -> DataFrame:
    """The first point, by order, for each row of wanted, all of whose columns are to be equal: many lookups at once, as one join."""
    return top_k(points.join(wanted.distinct(), wanted.columns, "left_semi"), wanted.columns, [F.col(order)], 1, "_first").drop("_first")


#: Fields of a point that filters may name.
FILTERED = ("source_doc_id", "filename", "chunk_kind", "table_id")


def matching(points: DataFrame, wanted: dict[str, object]) -> DataFrame:
    """points all of whose wanted fields are equal to the values; plain comparisons, which reach the scan. No wanted field, no filter."""
    if unknown := set(wanted) - set(FILTERED):
        raise ValueError(f"no filter by {sorted(unknown)}")
    for field, value in wanted.items():
        points = points.where(F.col(field) == F.lit(value))
    return points


def get_documents(points: DataFrame, wanted: DataFrame) -> DataFrame:
    """The catalog's rows of the wanted (doc_id), each once, with a status: found, or not_found with nulls. Only points of wanted documents are summed."""
    asked = wanted.select("doc_id").where("doc_id is not null").distinct()
    held = points.join(asked.withColumnRenamed("doc_id", "source_doc_id"), "source_doc_id", "left_semi")
    return asked.join(catalog(held), "doc_id", "left").withColumn("status", F.when(F.col("chunks").isNotNull(), "found").otherwise("not_found"))


def replace_by_key(old: DataFrame, new: DataFrame, key: str = "filename") -> DataFrame:
    """old without the rows whose key new has, and new."""
    return old.join(new.select(key).distinct(), key, "left_anti").select(*old.columns).unionByName(new)


def delete_by_key(points: DataFrame, key: str, value: str) -> tuple[DataFrame, int]:
    """(what stays, rows deleted); nothing deleted means not found."""
    gone = points.where(F.col(key) == value)
    return points.where((F.col(key) != value) | F.col(key).isNull()), gone.count()


def upsert(old: DataFrame, new: DataFrame, key: str = "point_id") -> DataFrame:
    return replace_by_key(old, new, key)


def deletion_report(points: DataFrame, wanted: DataFrame, key: str = "filename") -> DataFrame:
    """(key, deleted, status) for every wanted key: points are counted by key before they meet the request."""
    counts = points.groupBy(key).agg(F.count("*").alias("deleted"))
    return wanted.select(key).distinct().join(counts, key, "left").select(key, F.coalesce("deleted", F.lit(0)).alias("deleted"), F.when(F.col("deleted") > 0, "deleted").otherwise("not_found").alias("status"))
