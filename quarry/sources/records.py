"""Stored points read back as nodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip

#: Payload fields that hold a whole node, and the fields that may hold its text, in the order in which they are tried.
CONTENT, INTERNAL, TEXTS = "_node_content", ("_node_content", "_node_type"), ("text", "document", "content")


def _parsed(json: Column) -> Column:
    """A JSON object as a variant; null for what is no JSON (a repeated key included) or no object."""
    read = F.try_parse_json(json)
    return F.when(F.schema_of_variant(read).startswith("OBJECT"), read)


def _text(read: Column, field: str) -> Column:
    """The field's text without blanks around it, if it is a string that holds more."""
    found = F.try_variant_get(read, f"$.{field}", "variant")
    return F.when(F.schema_of_variant(found) == "STRING", F.nullif(strip(F.try_variant_get(read, f"$.{field}", "string")), F.lit("")))


def _fields(read: Column) -> Column:
    """A JSON object's fields as a map: strings as they are, other values as JSON."""
    return F.coalesce(F.from_json(F.to_json(read), "map<string,string>"), F.create_map().cast("map<string,string>"))


def decode(points: DataFrame) -> DataFrame:
    """points (id, payload, and other columns, which stay) as nodes: node_id, text, metadata in place of the payload, a JSON object.

    The payload may hold a whole node as JSON (CONTENT): its id and text come first, and its metadata fill in what the payload lacks. Without such a text
    the first of TEXTS counts that is a string and not blank. Points without any text are no nodes and have no row; a payload or node that can't be read
    counts as missing."""
    rest = [F.col(f"`{c}`") for c in points.columns if c not in ("id", "payload")]
    # Each JSON text is read once: explode keeps the reading from being repeated in every column that is made of it.
    outer = points.select(*rest, "id", F.explode(F.array(_parsed(F.col("payload")))).alias("_outer"))
    node = F.when(F.schema_of_variant(F.try_variant_get("_outer", f"$.{CONTENT}", "variant")) == "STRING", F.try_variant_get("_outer", f"$.{CONTENT}", "string"))
    inner = outer.select(*rest, "id", "_outer", F.explode(F.array(_parsed(node))).alias("_inner"))
    text = F.coalesce(_text(F.col("_inner"), "text"), *[_text(F.col("_outer"), field) for field in TEXTS])
    own = F.map_filter(_fields(F.col("_outer")), lambda k, _: ~k.isin(*INTERNAL))
    lent = F.map_filter(_fields(F.try_variant_get("_inner", "$.metadata", "variant")), lambda k, _: ~F.map_contains_key(F.col("_own"), k))
    node_id = F.coalesce(F.nullif(F.try_variant_get("_inner", "$.id_", "string"), F.lit("")), F.col("id").cast("string"))
    read = inner.withColumns({"_text": text, "_own": own}).where("_text is not null")
    return read.select(*rest, node_id.alias("node_id"), F.col("_text").alias("text"), F.map_concat("_own", lent).alias("metadata"))
