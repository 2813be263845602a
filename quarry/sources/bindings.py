"""Sources and sinks, and how the driver's tables stand for the engine's entities (conventions of this repository)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ids


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def uploads(spark: SparkSession, path: str) -> DataFrame:
    """Files as (filename, content); other files than PDF are kept apart by accepted()."""
    return spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("filename"), "content")


def accepted(files: DataFrame) -> DataFrame:
    """files with a status: only PDF names are taken, others fail without stopping the batch."""
    return files.withColumn("status", F.when(F.lower("filename").endswith(".pdf"), "accepted").otherwise("failed"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text", F.concat("source", F.lit("/"), F.col("doc_id"), F.lit(".pdf")).alias("filename"), "source", "lang")


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One chunk for each line with text, numbered within its document; every seventh is a table parent, every fifth an anchor."""
    named = documents(spark, sf_dir).select("doc_id", "filename", "text", ids.document_id(F.col("text")).alias("source_doc_id"))
    # A document's lines stand in its row, so they are numbered there and no text is shuffled.
    held = F.filter(F.transform(F.split("text", "\n"), lambda body, line: F.struct(line.alias("line"), body.alias("body"))), lambda e: F.trim(e["body"]) != "")
    lines = named.select("doc_id", "source_doc_id", "filename", F.posexplode(held).alias("chunk_index", "e")).select("*", F.col("e.line").alias("line"))
    kind = F.when(F.col("line") % 7 == 6, "table_parent").when(F.col("line") % 5 == 4, "table_anchor").otherwise("text")
    rows = lines.select("doc_id", "source_doc_id", "filename", "chunk_index", F.col("e.body").alias("text"), kind.alias("chunk_kind"))
    return rows.withColumn("chunk_id", ids.chunk_id(F.col("doc_id").cast("string"), F.col("chunk_index"))).withColumn("schema_version", F.lit(2))


def order_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A markdown table for each order: (order_id, caption, content)."""
    items = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("order_id"), "l_linenumber",
        F.concat(F.lit("| "), F.col("l_linenumber"), F.lit(" | part "), F.col("l_partkey"), F.lit(" | "), F.col("l_quantity").cast("int"), F.lit(" | "), F.when(F.col("l_returnflag") == "N", "").otherwise(F.col("l_returnflag")), F.lit(" |")).alias("row"),
    )
    made = items.groupBy("order_id").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "row"))).alias("rows"))
    content = F.concat(F.lit("| No | Activity | Waktu | Output |\n|---|---|---|---|\n"), F.array_join(F.transform("rows", lambda r: r["row"]), "\n"))
    return made.select("order_id", F.concat(F.lit("Order "), F.col("order_id")).alias("caption"), content.alias("content"))


def publish(df: DataFrame, root: str, version: str = "") -> str:
    """Writes df as a new version beside the old ones and returns its path: readers of an older version are never disturbed. A named version that a
    failed attempt left is written anew."""
    path = f"{root.rstrip('/')}/{version or f'v-{uuid.uuid4().hex}'}"
    df.write.mode("overwrite" if version else "errorifexists").parquet(path)
    return path


def eval_cases(spark: SparkSession, path: str) -> DataFrame:
    """(id, question) from a JSON list."""
    return spark.read.schema("id string, question string").json(path, multiLine=True)


def eval_report(cases: DataFrame, path: str) -> None:
    """One JSON object per case."""
    cases.write.mode("overwrite").json(path)


def public(df: DataFrame) -> DataFrame:
    """df without its internal columns, whose names begin with an underscore."""
    return df.select(*[F.col(f"`{c}`") for c in df.columns if not c.startswith("_")])


def with_defaults(df: DataFrame, defaults: dict[str, object]) -> DataFrame:
    """df with missing values and columns filled."""
    return df.withColumns({c: F.coalesce(F.col(f"`{c}`"), F.lit(v)) if c in df.columns else F.lit(v) for c, v in defaults.items()})
