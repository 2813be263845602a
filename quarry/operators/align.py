"""Where chunks begin in their document, by a gram index: hashes of the beginnings of all chunks are looked up among the hashes of the document's places
once, and a cursor then goes through the chunks with the places that were found. The work follows the lengths of text and chunks, also for chunks
that stand nowhere."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Lengths of the beginnings by which a chunk is looked for, the least length of one, and the step behind a find.
PROBES, LEAST_PROBE, STEP = (220, 160, 100, 70), 24, 120
#: Lengths that are hashed; a beginning is looked up by the longest that fits into it and compared whole where its hash stands.
GRAMS = (192, 96, 48, LEAST_PROBE)
_BASE, _MOD = 0x9E3779B97F4A7C15, (1 << 64) - 1


def place_hashes(codes: np.ndarray, size: int) -> np.ndarray:
    """A polynomial hash of the `size` characters from each place on, by doubling."""
    h, have = codes.astype(np.uint64) + np.uint64(1), 1
    while have < size:
        step = min(have, size - have)
        # The window of have + step characters from i on is that of `have` from i on, then that of `step` behind it.
        tail = (h if step == have else place_hashes(codes, step))[have:]
        h = h[: len(tail)] * np.uint64(pow(_BASE, step, 1 << 64)) + tail
        have += step
    return h


def text_hash(text: str) -> int:
    value = 0
    for c in text:
        value = (value * _BASE + ord(c) + 1) & _MOD
    return value


def probes(part: str) -> list[str]:
    """Beginnings of a chunk, the longest first, without repetitions."""
    found = [part[:n].strip(" ") for n in PROBES]
    return list(dict.fromkeys(p for p in found if len(p) >= LEAST_PROBE))


def find_all(parts: list[str | None], text: str | None) -> list[int | None]:
    """For each part the place of its first probe that stands at or after the cursor, else of the first that stands anywhere, else None."""
    text = text or ""
    asked = [probes(p or "") for p in parts]
    size_of = lambda p: next(g for g in GRAMS if g <= len(p))
    wanted: dict[int, dict[str, int]] = {}
    for own in asked:
        for p in own:
            wanted.setdefault(size_of(p), {})[p[: size_of(p)]] = 0
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    places: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for size, grams in wanted.items():
        for g in grams:
            grams[g] = text_hash(g)
        if len(codes) >= size:
            h = place_hashes(codes, size)
            at = np.flatnonzero(np.isin(h, np.fromiter(grams.values(), np.uint64, len(grams))))
            order = np.lexsort((at, h[at]))
            places[size] = h[at][order], at[order]
    out: list[int | None] = []
    cursor = 0
    for own in asked:
        held = []
        for p in own:
            size = size_of(p)
            if size in places:
                h, at = places[size]
                key = np.uint64(wanted[size][p[:size]])
                held.append((p, at[np.searchsorted(h, key) : np.searchsorted(h, key, "right")]))
        found = None
        for begin in (cursor, 0):
            for p, at in held:
                found = next((k for i in range(int(np.searchsorted(at, begin)), len(at)) if text.startswith(p, k := int(at[i]))), None)
                if found is not None:
                    break
            if found is not None:
                break
        if found is not None:
            cursor = max(cursor, found + STEP)
        out.append(found)
    return out


def positions(chunks: DataFrame) -> DataFrame:
    """(doc, pos array): where the ordered chunks (array of strings `parts`) of (doc, parts, text) begin in `text`, from 0; nothing where none is found."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [find_all(parts.as_py() or [], text.as_py()) for parts, text in zip(batch.column(1), batch.column(2), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int32()))], ["doc", "pos"])

    return chunks.select("doc", "parts", "text").mapInArrow(run, f"doc {chunks.schema['doc'].dataType.simpleString()}, pos array<int>")
