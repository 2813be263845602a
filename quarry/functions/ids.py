"""Deterministic ids as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the URL namespace of name-based UUIDs.
NAMESPACE_URL = "6ba7b8119dad11d180b400c04fd430c8"


def document_id(text: Column) -> Column:
    return F.concat(F.lit("doc_"), F.substring(F.sha2(F.encode(text, "UTF-8"), 256), 1, 20))


def chunk_id(doc_id: Column, index: Column) -> Column:
    return F.format_string("%s:chunk:%05d", doc_id, index)


def point_uuid(chunk: Column) -> Column:
    """The version 5 UUID of a chunk id."""
    h = F.sha1(F.concat(F.unhex(F.lit(NAMESPACE_URL)), F.encode(chunk, "UTF-8")))
    variant = F.lower(F.hex((F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3)).bitwiseOR(8)))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def doc_key(doc: Column, node: Column) -> Column:
    """The document of a candidate; a candidate without one is its own."""
    return F.coalesce(doc, F.concat(F.lit("__node__:"), node))
