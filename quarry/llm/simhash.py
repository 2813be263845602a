"""SimHash near-duplicates by covering locality-sensitive hashing.

Bit i of a fingerprint gets a nonzero vector m(i) of radius + 1 bits; table v (a nonzero vector too) keeps the bits with m(i).v odd. Any radius
differing bits span at most radius dimensions, so some v is orthogonal to all of them and its table leaves them out: every pair within the radius agrees on a whole table key.
A bucket of too many fingerprints is covered again over the bits that its table leaves out: a pair within the radius differs in those bits alone, so of
radius + 1 parts of them it agrees on one. Each such step keeps one part more, and buckets that leave out few bits are small.

Null and empty texts have fingerprint zero and link like any other; texts of fewer words than a shingle hash as a whole. Equal fingerprints are
one node, however many rows have them. Very long texts are hashed whole. Repeated ids keep their rows. Columns other than id and text are ignored; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, materialize, payload, small_or_shuffled, task_partitions
from .components import connected_components

SHINGLE, RADIUS, SEED = 4, 4, 42
#: Distinct fingerprints in one bucket above which its left-out bits are covered again, unless at most FEW_BITS are left out.
BLOCK, FEW_BITS = 4096, 12


def fingerprint(text: bytes, shingle: int = SHINGLE) -> bytes:
    """Eight bytes, the highest bit first: the majority of each bit over the XXH64 of all word shingles."""
    words = text.lower().split()
    if not words:
        return bytes(8)
    flat = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_digest(flat, SEED)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(lengths)
    starts = (ends - lengths)[: len(words) - shingle + 1].tolist()
    hashed = xxhash.xxh64_digest
    digests = b"".join([hashed(flat[a:b], SEED) for a, b in zip(starts, (ends[shingle - 1 :] - 1).tolist(), strict=True)])
    n = len(starts)
    bits = np.unpackbits(np.frombuffer(digests, np.uint8).reshape(n, 8), axis=1)
    whole = n // 255 * 255
    counts = bits[whole:].sum(0, dtype=np.int64)
    if whole:
        counts += np.add.reduce(bits[:whole].reshape(-1, 255, 64), axis=1, dtype=np.uint8).sum(0, dtype=np.int64)
    return np.packbits(counts * 2 > n).tobytes()


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data = b"".join(fingerprint(x.as_py()) for x in batch.column(1))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.frombuffer(data, ">i8").astype(np.int64))], names=["doc_id", "fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp as a signed long), one row per row of docs."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), payload(text_col).alias("text")).mapInArrow(_fingerprints, "doc_id long, fp long")


def covering_masks(radius: int = RADIUS, bits: int = 64) -> list[int]:
    """2^(radius+1) - 1 masks: any radius bits are left out together by some mask."""
    size = 1 << (radius + 1)
    owner = [1 + i % (size - 1) for i in range(bits)]
    return [sum(1 << i for i in range(bits) if (owner[i] & v).bit_count() & 1) for v in range(1, size)]


def finer_masks(mask: int, radius: int = RADIUS) -> list[int]:
    """radius + 1 masks that keep what mask keeps and one part each of what it leaves out: any radius bits that it leaves out, some of them leaves out too."""
    left = [i for i in range(64) if not mask >> i & 1]
    return [mask | sum(1 << i for i in left[k :: radius + 1]) for k in range(radius + 1)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _stars(radius: int):
    """Within each bucket, a spanning star of every set of fingerprints that links chain together: at most one edge per fingerprint."""

    def one(fps: np.ndarray, out: list[tuple[int, int]]) -> None:
        left = np.unique(fps).view(np.uint64)
        while len(left) > 1:
            root, front, left = left[0], [left[0]], left[1:]
            while front and len(left):
                near = np.bitwise_count(left ^ front.pop()) <= radius
                if near.any():
                    found = left[near]
                    front.extend(found)
                    out.extend((int(root.view(np.int64)), x) for x in found.view(np.int64).tolist())
                    left = left[~near]

    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest_key, rest_fp = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def flush(key: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
            at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
            size = np.diff(np.append(at, len(key)))
            two = at[size == 2]
            near = two[np.bitwise_count((fp[two] ^ fp[two + 1]).view(np.uint64)) <= radius]
            out = [(int(a), int(b)) for a, b in zip(fp[near], fp[near + 1], strict=True) if a != b]
            for a, n in zip(at[size > 2], size[size > 2], strict=True):
                one(fp[a : a + n], out)
            return pa.RecordBatch.from_arrays([pa.array([a for a, _ in out], pa.int64()), pa.array([b for _, b in out], pa.int64())], names=["u", "v"])

        for batch in batches:
            key, fp = np.concatenate([rest_key, batch.column(0).to_numpy()]), np.concatenate([rest_fp, batch.column(1).to_numpy()])
            if not len(key):
                continue
            cut = int(np.searchsorted(key, key[-1]))
            rest_key, rest_fp = key[cut:], fp[cut:]
            yield flush(key[:cut], fp[:cut])
        yield flush(rest_key, rest_fp)

    return edges


def near_edges(distinct: DataFrame, radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """(u, v): links among distinct fingerprints (fp) that connect whatever is within the radius of one another, directly or by others.

    Every level deals the fingerprints of hot buckets to the tables of a second cover, a fixed number a fingerprint; a table is known by the bits it keeps."""
    spark = distinct.sparkSession
    keys = [F.struct(F.lit(_signed(m)).alias("kept"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("k")) for m in covering_masks(radius)]
    rows = distinct.select("fp", F.explode(F.array(*keys)).alias("t")).select("fp", "t.kept", F.xxhash64("t.kept", "t.k").alias("bucket"))
    ready = []
    while True:
        hot = rows.groupBy("bucket", "kept").agg(F.count("*").alias("n")).where(F.col("n") > block).where(64 - F.bit_count("kept") > FEW_BITS)
        hot = materialize(hot.select("bucket", "kept"), "hot")
        n_hot = hot.count()
        if not n_hot:
            ready.append(rows)
            break
        hot = small_or_shuffled(hot, n_hot)
        ready.append(rows.join(hot, ["bucket", "kept"], "left_anti"))
        used = [r["kept"] for r in hot.select("kept").distinct().collect()]  # at most as many as a level has tables
        finer = spark.createDataFrame([(m, [_signed(f) for f in finer_masks(m & (1 << 64) - 1, radius)]) for m in used], "kept long, finer array<long>")
        again = rows.join(hot, ["bucket", "kept"], "left_semi").join(F.broadcast(finer), "kept").select("fp", F.explode("finer").alias("kept"))
        rows = materialize(again.select("fp", "kept", F.xxhash64("kept", F.col("fp").bitwiseAND(F.col("kept"))).alias("bucket")), "finer")
    every = ready[0]
    for more in ready[1:]:
        every = every.unionByName(more)
    dealt = every.select("bucket", "fp").repartition(task_partitions(spark), "bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(_stars(radius), "u long, v long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """(doc_id, fingerprint as 16 hex digits, component_id), one row per row of docs."""
    prints = materialize(fingerprints(docs, id_col, text_col), "prints")
    classes = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")), "classes")
    roots = connected_components(near_edges(classes, radius))
    joined = classes.join(roots, classes.fp == roots.node, "left").select("fp", "rep", F.coalesce("root", "fp").alias("root"))
    joined = materialize(joined, "joined")
    least = materialize(joined.groupBy("root").agg(F.min("rep").alias("component_id")), "least")
    named = materialize(joined.join(least, "root").select("fp", "component_id"), "named")
    return prints.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one document of each component, that of least id; null, empty and wordless texts, all of fingerprint zero, are one component.
    Rows of one id go or stay together; where ids repeat, of rows of equal id and text one stays."""
    found, name = near_duplicates(docs, id_col, text_col), fresh(docs, "gone_id")
    gone = materialize(found.where("doc_id <> component_id").select(F.col("doc_id").alias(name)).distinct(), "gone")
    kept = docs.join(gone, F.col(f"`{id_col}`") == F.col(name), "left_anti")
    repeated = docs.groupBy(id_col).count().where("count > 1").limit(1).count()
    return kept.dropDuplicates([id_col, text_col]) if repeated else kept
