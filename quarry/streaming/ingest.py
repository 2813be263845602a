"""Continuous ingestion: each micro-batch replaces the chunks of its filenames and publishes a new version of the index."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.index import replace_by_key
from ..operators.store import ChunkStore
from ..sources.bindings import publish


def replace_stream(arrivals: DataFrame, root: str, current: Callable[[], DataFrame | None], announce: Callable[[str, int], None], checkpoint: str) -> StreamingQuery:
    """arrivals: a streaming DataFrame of chunks. current() gives the index so far, announce(path, batch) makes a new version the current one.

    A version is named after its batch, so a batch that runs again after a failure writes the same version anew. A version holds the whole index:
    batches should be as large as the delay that is allowed permits."""

    def batch(new: DataFrame, number: int) -> None:
        old = current()
        announce(publish(new if old is None else replace_by_key(old, new), root, f"v-{number:010d}"), number)

    return arrivals.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).start()


def upsert_stream(arrivals: DataFrame, store: ChunkStore, source: str, checkpoint: str) -> StreamingQuery:
    """arrivals: a streaming DataFrame of chunks. Each micro-batch rewrites the buckets of its filenames; a batch that runs again after a failure is
    skipped if the manifest has it."""

    def batch(new: DataFrame, number: int) -> None:
        held = new.persist()  # a batch is read for its buckets, its keys and its rows
        try:
            store.retried(lambda s: s.upsert(held, source, number))
        finally:
            held.unpersist()

    return arrivals.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).start()
