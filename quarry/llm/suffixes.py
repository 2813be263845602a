"""Suffix dedup by a common-prefix-aware distributed merge sort of sampled suffixes.

Every window of LENGTH bytes picks the place in it whose GRAM-byte hash is least (the first of equal ones). Equal windows pick the same place, so
suffixes that begin at picked places, and they alone, need sorting: about one in forty. An item is such a suffix with the stretch of windows
that picked its beginning: the bytes from the picked place to the end of the last window, then the bytes from the first window's start to the place.

Map side: items are sorted in runs; equal items of a run are one item, its first place, and the others are covered at once, so a frequent
passage leaves a task once. Runs are front-coded (bytes shared with the item before are not sent), compressed, and dealt by the hash of
the picked bytes, since only suffixes with equal beginnings have to meet. Reduce side: a loser tree merges the runs; it keeps with
each loser the prefix it shares with the winner, so known prefixes are never compared again. Neighbours with a common prefix of GRAM bytes form
groups; in a group, equal items are covered whole, and of the others only the windows within the prefix shared with a neighbour are looked up.
A group is read as a stream: its windows are looked up by a digest of 128 bits, in groups of every size, GROUP_ITEMS items at a time; if there are
more, each piece's first places of windows go by digest to a second shuffle, where the first place of each digest stays and the others are
covered. (Among 10^14 windows some two different ones have equal digests with a probability of about 10^-11.) Runs are decoded in pieces, and at most
MERGE_WIDTH of them are merged at once.

A byte is removed if a LENGTH-byte string covers it that also starts earlier: at a smaller id, or in the same text before. Null ids come first.
Rows of equal id and equal text are one text with one result; rows of equal id and different texts are ordered by hash. Null texts are empty;
texts shorter than LENGTH keep all. Columns other than id and text are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import os
import struct
import tempfile
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import payload, task_partitions

LENGTH, GRAM = 100, 20
#: Items sorted at a time in a task, bytes of text hashed at a time, and items of a group whose windows are held at a time.
RUN_ITEMS, BATCH_BYTES, GROUP_ITEMS = 300_000, 2 << 20, 2_000
#: Decoded items of all runs that a merging task holds, bytes of compressed runs that it holds before the others go to a file in Spark's local folders,
#: runs that are merged at once (more are merged in passes), and items of a block of a run that a pass makes.
OPEN_ITEMS, HELD_BYTES, MERGE_WIDTH, BLOCK_ITEMS = 500_000, 64 << 20, 256, 20_000
#: Compression of runs: level 5 is a sixth smaller than level 1 on sorted text, at a quarter of its speed.
RUN_LEVEL = 5
#: A text's windows are taken in pieces of so many starts; each piece has all bytes of its windows.
PIECE_BYTES = 4 << 20
#: Odd multipliers of the byte hash and of its doublings.
_FACTORS = [0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA24BAED4963EE407, 0x9FB21C651E98DF25, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xE7037ED1A0B428DB]
_LOW = np.uint64(0xFFFFFF)


def gram_hashes(data: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """A 64-bit hash of the gram bytes from each place on."""
    h = (data.astype(np.uint64) + np.uint64(1)) * np.uint64(_FACTORS[0])
    size, k = 1, 1
    while size < gram:
        step = min(size, gram - size)
        h = h[: len(h) - step] * np.uint64(_FACTORS[k]) + h[step:]
        h ^= h >> np.uint64(29)
        size, k = size + step, k + 1
    h *= np.uint64(_FACTORS[0])
    return h ^ (h >> np.uint64(32))


def picks(data: np.ndarray, bounds: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Stretches of windows with one picked place, in texts laid end to end (bounds: their ends): (first, last, place, hash of the place, text)."""
    if len(data) < length:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    h = gram_hashes(data, gram)
    least = (h & ~_LOW) | np.arange(len(h), dtype=np.uint64)
    size, window = 1, length - gram + 1
    while size < window:
        step = min(size, window - size)
        least = np.minimum(least[: len(least) - step], least[step:])
        size += step
    place = (least & _LOW).astype(np.int64)
    begins = np.concatenate([[0], bounds[:-1]])
    whole = bounds - begins >= length
    turn = np.zeros(len(place) + 1, np.int8)
    turn[begins[whole]] = 1
    inside = np.zeros(len(place) + 1, np.int64)
    np.add.at(inside, begins[whole], 1)
    np.add.at(inside, bounds[whole] - length + 1, -1)
    valid = np.cumsum(inside)[:-1] > 0
    new = np.concatenate([[True], (place[1:] != place[:-1]) | ~valid[:-1]]) | (turn[:-1] == 1)
    first = np.flatnonzero(valid & new)
    ends = np.flatnonzero(np.concatenate([new[1:] | ~valid[1:], [True]]) & valid)
    return first, ends, place[first], h[place[first]], np.searchsorted(bounds, first, "right")


def front_code(strings: list[bytes], right: np.ndarray, start: np.ndarray, keys: list[bytes]) -> bytes:
    """A sorted run: for each item the prefix it shares with the one before, and the rest."""
    n = len(strings)
    size = np.fromiter(map(len, strings), np.int64, n)
    wide = int(size.max())
    table = np.zeros((n, wide), np.uint8)
    table[np.arange(wide) < size[:, None]] = np.frombuffer(b"".join(strings), np.uint8)
    shared = np.zeros(n, np.int64)
    if n > 1:
        differ = table[1:] != table[:-1]
        shared[1:] = np.minimum(np.where(differ.any(1), differ.argmax(1), wide), np.minimum(size[1:], size[:-1]))
    cells = np.arange(wide)
    rest = table[(cells >= shared[:, None]) & (cells < size[:, None])].tobytes()
    key_size = np.fromiter(map(len, keys), np.uint8, n)
    parts = [shared.astype("<u2").tobytes(), size.astype("<u2").tobytes(), right.astype("<u2").tobytes(), start.astype("<u4").tobytes(), key_size.tobytes(), b"".join(keys), rest]
    return zstandard.ZstdCompressor(level=RUN_LEVEL).compress(struct.pack("<II", n, sum(map(len, keys))) + b"".join(parts))


def run_items(blob: bytes | Callable[[], bytes], piece: int = OPEN_ITEMS) -> Iterator[tuple[bytes, int, bytes, int, int]]:
    """(string, prefix shared with the item before, key, start, bytes from the picked place on) of a run, or of what returns one;
    at most `piece` items are held: for each piece the run is decompressed anew."""
    k = at = done = 0
    before, n = b"", 1
    while done < n:
        raw = zstandard.ZstdDecompressor().decompress(blob() if callable(blob) else blob)
        n, key_bytes = struct.unpack_from("<II", raw)
        here = min(piece, n - done)
        column, columns = 8, []
        for kind, wide in (("<u2", 2), ("<u2", 2), ("<u2", 2), ("<u4", 4), ("u1", 1)):
            columns.append(np.frombuffer(raw, kind, here, column + done * wide).tolist())
            column += n * wide
        if not done:
            k, at = column, column + key_bytes
        key_end, end = k + sum(columns[4]), at + sum(columns[1]) - sum(columns[0])
        names, rest = raw[k:key_end], raw[at:end]
        del raw
        i = j = 0
        for shared, size, right, start, key_size in zip(*columns, strict=True):
            before = before[:shared] + rest[j : j + size - shared]
            j += size - shared
            yield before, shared, names[i : i + key_size], start, right
            i += key_size
        k, at, done = key_end, end, done + here


def _mismatch(a: bytes, b: bytes, at: int) -> int:
    """The first place from `at` on where a and b differ, or where the shorter ends."""
    end = min(len(a), len(b))
    while at < end:
        x, y = a[at : at + 16], b[at : at + 16]
        if x != y:
            n = min(len(x), len(y))
            differ = int.from_bytes(x[:n], "big") ^ int.from_bytes(y[:n], "big")
            return at + n - (differ.bit_length() + 7) // 8
        at += 16
    return end


def merge(runs: list[Iterator[tuple]]) -> Iterator[tuple]:
    """The items of sorted runs in order, each with the prefix it shares with the item put out before it, by a loser tree on common prefixes."""
    leaves = 1
    while leaves < len(runs):
        leaves *= 2
    now: list[tuple | None] = [next(r, None) for r in runs] + [None] * (leaves - len(runs))
    known = [0] * leaves

    def beats(i: int, j: int) -> bool:
        """Whether i comes before j; the loser then knows the prefix it shares with the winner."""
        a, b = now[i], now[j]
        if a is None or b is None:
            return b is None
        if known[i] != known[j]:
            return known[i] > known[j]
        x, y = a[0], b[0]
        m = _mismatch(x, y, known[i])
        if m == len(x) or (m < len(y) and x[m] < y[m]):
            known[j] = m
            return True
        known[i] = m
        return False

    loser = [0] * leaves

    def play(node: int) -> int:
        if node >= leaves:
            return node - leaves
        i, j = play(2 * node), play(2 * node + 1)
        if beats(i, j):
            loser[node] = j
            return i
        loser[node] = i
        return j

    winner = play(1) if leaves > 1 else 0
    while (item := now[winner]) is not None:
        yield item, known[winner]
        following = next(runs[winner], None)
        now[winner] = following
        known[winner] = following[1] if following is not None else 0
        node = (winner + leaves) >> 1
        while node:
            j = loser[node]
            a, b = now[winner], now[j]
            if b is not None:
                if a is None or known[winner] < known[j] or (known[winner] == known[j] and not beats(winner, j)):
                    loser[node], winner = winner, j
            node >>= 1


def _looked_up(group: Iterable[tuple], out: list[tuple[bytes, int, int]], length: int) -> Iterator[tuple[bytes, int, int, bytes]]:
    """(key, start, last window, text) of a group's items that share windows with a neighbour; equal items but the first go to out as covered.
    Only the items of one string are held, one for each place of the picked bytes."""
    kept: dict[int, tuple] = {}  # by the bytes from the picked place on
    first = 0  # prefix shared with the string before

    def closed(following: int) -> Iterator[tuple[bytes, int, int, bytes]]:
        for text, _, key, start, right in kept.values():
            near = len(text) if len(kept) > 1 else max(first, following)
            last = min(len(text) - length, len(text) - right - length + min(near, right))
            if last >= 0:
                yield key, start, last, text[right:] + text[:right]

    string = None
    for item, shared in group:
        if item[0] != string:
            yield from closed(shared)
            first, string, kept = 0 if string is None else shared, item[0], {item[4]: item}
            continue
        old = kept.setdefault(item[4], item)
        if old is not item:
            new, gone = (item, old) if (item[2], item[3]) < (old[2], old[3]) else (old, item)
            kept[item[4]] = new
            out.append((gone[2], gone[3], gone[3] + len(gone[0])))
    yield from closed(0)


def _piece_cover(todo: list[tuple[bytes, int, int, bytes]], out: list[tuple[bytes, int, int]], length: int) -> dict[bytes, tuple[bytes, int]]:
    """The first place of each window looked up in todo; places after it go to out."""
    seen: dict[bytes, tuple[bytes, int]] = {}
    digest = xxhash.xxh3_128_digest
    todo.sort(key=lambda x: x[:2])
    for key, start, last, text in todo:
        begin = -1
        for j in range(last + 1):
            window = digest(text[j : j + length])
            if window in seen:
                if begin < 0:
                    begin = j
            else:
                seen[window] = (key, start + j)
                if begin >= 0:
                    out.append((key, start + begin, start + j - 1 + length))
                    begin = -1
        if begin >= 0:
            out.append((key, start + begin, start + last + length))
    return seen


def stream_cover(group: Iterable[tuple], length: int = LENGTH) -> Iterator[tuple[list[tuple[bytes, int, int]], dict[bytes, tuple[bytes, int]]]]:
    """For a group of merged items ((string, _, key, start, right), shared), in sorted order: pieces of (key, start, end) covered, and with each the
    first places in the piece of windows by digest, (key, start), which are to be compared between pieces; none if the group is one piece."""
    out: list[tuple[bytes, int, int]] = []
    todo: list[tuple[bytes, int, int, bytes]] = []
    large = False
    for entry in _looked_up(group, out, length):
        if len(todo) >= GROUP_ITEMS:
            large = True
            seen = _piece_cover(todo, out, length)
            yield out[:], seen
            out.clear(), todo.clear()
        todo.append(entry)
        if len(out) > 50_000:
            yield out[:], {}
            out.clear()
    seen = _piece_cover(todo, out, length)
    yield out, seen if large else {}


def _cover_batch(found: list[tuple[bytes, int, int]]) -> list[pa.Array]:
    return [pa.array([x[0] for x in found], pa.binary()), pa.array([x[1] << 31 | x[2] for x in found], pa.int64())]


def _make_runs(parts: int):
    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items: list[bytes] = []
        keys: list[bytes] = []
        meta: list[np.ndarray] = []

        def flush() -> Iterator[pa.RecordBatch]:
            part, right, start = (np.concatenate([m[k] for m in meta]) for k in range(3))
            order = np.argsort(part, kind="stable")
            edges = np.searchsorted(part[order], np.arange(parts + 1))
            covered: list[tuple[bytes, int, int]] = []
            for p in range(parts):
                own = order[edges[p] : edges[p + 1]].tolist()
                if not own:
                    continue
                own.sort(key=items.__getitem__)
                keep: list[int] = []
                same: dict[int, int] = {}
                for i in own:
                    if not keep or items[keep[-1]] != items[i]:
                        same = {int(right[i]): len(keep)}
                        keep.append(i)
                        continue
                    k = same.get(int(right[i]))
                    if k is None:
                        same[int(right[i])] = len(keep)
                        keep.append(i)
                        continue
                    j = keep[k]
                    new, gone = (i, j) if (keys[i], start[i]) < (keys[j], start[j]) else (j, i)
                    keep[k] = new
                    covered.append((keys[gone], int(start[gone]), int(start[gone]) + len(items[gone])))
                blob = front_code([items[i] for i in keep], right[keep], start[keep], [keys[i] for i in keep])
                yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([blob], pa.binary()), pa.array([None], pa.binary()), pa.array([None], pa.int64())], names=["part", "run", "key", "span"])
            for k in range(0, len(covered), 100_000):
                key, span = _cover_batch(covered[k : k + 100_000])
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(key)) % parts, pa.int32()), pa.nulls(len(key), pa.binary()), key, span], names=["part", "run", "key", "span"])

        def take(texts: list[bytes], own: list[tuple[bytes, int]]) -> None:
            raw = b"".join(texts)
            bounds = np.cumsum([len(t) for t in texts])
            first, last, place, h, text = picks(np.frombuffer(raw, np.uint8), bounds)
            items.extend([raw[a:b] + raw[s:a] for s, a, b in zip(first.tolist(), place.tolist(), (last + LENGTH).tolist(), strict=True)])
            keys.extend([own[t][0] for t in text.tolist()])
            origin = np.concatenate([[0], bounds[:-1]]) - np.array([offset for _, offset in own], np.int64)
            meta.append(np.stack([((h >> np.uint64(3)) & np.uint64(0xFFFFF)).astype(np.int64) % parts, last + LENGTH - place, first - origin[text]]))

        texts: list[bytes] = []
        own: list[tuple[bytes, int]] = []
        size = 0
        for batch in batches:
            for key, text in zip(batch.column(0), batch.column(1), strict=True):
                data = text.as_py()
                if len(data) < LENGTH:
                    continue
                for offset in range(0, len(data) - LENGTH + 1, PIECE_BYTES):
                    texts.append(data[offset : offset + PIECE_BYTES + LENGTH - 1])
                    own.append((key.as_py(), offset))
                    size += len(texts[-1])
                    if size >= BATCH_BYTES:
                        take(texts, own)
                        texts, own, size = [], [], 0
                    if len(items) >= RUN_ITEMS:
                        yield from flush()
                        items.clear(), keys.clear(), meta.clear()
        if texts:
            take(texts, own)
        if items:
            yield from flush()

    return runs


def _groups(pairs: Iterator[tuple]) -> Iterator[Iterator[tuple]]:
    """Streams of the merged items whose neighbours share GRAM bytes; each stream is to be read before the next. Single items are left out."""
    ahead = next(pairs, None)
    while ahead is not None:
        head, ahead = ahead, next(pairs, None)
        if ahead is None or ahead[1] < GRAM:
            continue

        def group(head: tuple = head) -> Iterator[tuple]:
            nonlocal ahead
            yield head
            while ahead is not None and ahead[1] >= GRAM:
                pair, ahead = ahead, next(pairs, None)
                yield pair

        yield group()


class _Runs:
    """Sorted runs of a merging task: each is a list of (blob or what reads it, prefix shared with the item before the blob's first)."""

    def __init__(self, spilled) -> None:
        self.spilled, self.end, self.held, self.all = spilled, 0, 0, []

    def kept(self, blob: bytes) -> bytes | Callable[[], bytes]:
        self.held += len(blob)
        if self.held <= HELD_BYTES:
            return blob
        self.spilled.write(blob)
        self.spilled.flush()
        at, self.end = self.end, self.end + len(blob)
        return lambda: os.pread(self.spilled.fileno(), len(blob), at)

    def merged(self, runs: list[list[tuple]]) -> Iterator[tuple]:
        piece = max(16, OPEN_ITEMS // max(1, len(runs)))

        def items(run: list[tuple]) -> Iterator[tuple]:
            for blob, shared in run:
                inside = run_items(blob, piece)
                first = next(inside)
                yield first[0], shared, *first[2:]
                yield from inside

        return merge([items(r) for r in runs]) if runs else iter(())

    def narrowed(self) -> Iterator[tuple]:
        """All runs merged; where they are more than MERGE_WIDTH, some at a time become longer runs first."""
        while len(self.all) > MERGE_WIDTH:
            longer = []
            for k in range(0, len(self.all), MERGE_WIDTH):
                run, block = [], []

                def close(run: list = run, block: list = block) -> None:
                    strings, _, keys, start, right = zip(*(x for x, _ in block), strict=True)
                    run.append((self.kept(front_code(list(strings), np.array(right), np.array(start), list(keys))), block[0][1]))
                    block.clear()

                for pair in self.merged(self.all[k : k + MERGE_WIDTH]):
                    block.append(pair)
                    if len(block) >= BLOCK_ITEMS:
                        close()
                if block:
                    close()
                longer.append(run)
            self.all = longer
        return self.merged(self.all)


def _merge_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans covered (digest null), and of groups in pieces the first places in a piece of windows by digest."""
    names = ["key", "span", "digest"]
    with tempfile.TemporaryFile(dir=os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0] or None) as spilled:
        runs = _Runs(spilled)
        for batch in batches:
            here = batch.column(0).is_valid().to_numpy(zero_copy_only=False)
            for x in batch.column(0).filter(pa.array(here)):
                runs.all.append([(runs.kept(x.as_py()), 0)])
            rest = batch.filter(pa.array(~here))
            if rest.num_rows:
                yield pa.RecordBatch.from_arrays([rest.column(1), rest.column(2), pa.nulls(rest.num_rows, pa.binary())], names=names)
        found: list[tuple[bytes, int, int]] = []
        for group in _groups(runs.narrowed()):
            for spans, seen in stream_cover(group):
                found += spans
                if seen:
                    key, span = _cover_batch([(k, start, start + LENGTH) for k, start in seen.values()])
                    yield pa.RecordBatch.from_arrays([key, span, pa.array(seen, pa.binary())], names=names)
                if len(found) > 50_000:
                    yield pa.RecordBatch.from_arrays([*_cover_batch(found), pa.nulls(len(found), pa.binary())], names=names)
                    found = []
        yield pa.RecordBatch.from_arrays([*_cover_batch(found), pa.nulls(len(found), pa.binary())], names=names)


def _later_places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by digest, key and span, those without a digest, and those after the first of their digest."""
    before = None
    for batch in batches:
        digests = batch.column(2).to_pylist()
        if not digests:
            continue
        later = [d is None or d == b for d, b in zip(digests, [before, *digests[:-1]], strict=True)]
        before = digests[-1]
        yield batch.filter(pa.array(later)).select(["key", "span"])


def _keyed(docs: DataFrame, id_col: str, text_col: str, *more: str) -> tuple[DataFrame, bool]:
    """(rows, whether their ids are unique). Adds `key`, which orders as the ids do: nothing for a null id, else eight bytes; then the text's hash where ids are not unique."""
    rows = docs.select(*more, F.col(id_col).cast("long").alias("_id"), payload(text_col).alias("_data"))
    unique = not docs.select(F.col(id_col).alias("_id")).groupBy("_id").count().where("count > 1 or _id is null").limit(1).count()
    key = F.unhex(F.lpad(F.hex(F.col("_id").bitwiseXOR(F.lit(-(1 << 63)))), 16, "0"))
    return rows.withColumn("key", key if unique else F.concat(F.coalesce(key, F.lit(b"")), F.unhex(F.lpad(F.hex(F.xxhash64("_data")), 16, "0")))), unique


def covered(keyed: DataFrame) -> DataFrame:
    """(key, span): spans of texts (key, _data) that an equal earlier string covers; start and end packed in one long. Spans may overlap."""
    parts = task_partitions(keyed.sparkSession)
    runs = keyed.select("key", "_data").mapInArrow(_make_runs(parts), "part int, run binary, key binary, span long")
    dealt = runs.repartitionById(parts, "part").select("run", "key", "span")
    found = dealt.mapInArrow(_merge_runs, "key binary, span long, digest binary")
    met = found.repartition(parts, F.when(F.col("digest").isNull(), F.xxhash64("key", "span")).otherwise(F.xxhash64("digest")))
    return met.sortWithinPartitions("digest", "key", "span").mapInArrow(_later_places, "key binary, span long")


def remove_spans(data: bytes, spans: np.ndarray) -> tuple[np.ndarray, int, int]:
    """(which bytes stay, bytes removed, maximal removed runs) for spans packed as longs."""
    turn = np.zeros(len(data) + 1, np.int32)
    np.add.at(turn, spans >> 31, 1)
    np.add.at(turn, spans & ((1 << 31) - 1), -1)
    gone = np.cumsum(turn)[:-1] > 0
    runs = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()) if len(gone) else 0
    return ~gone, int(gone.sum()), runs


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches with `_data` compressed: half of what the shuffle's own compression leaves of texts."""
    made = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        at = batch.schema.get_field_index("_data")
        yield batch.set_column(at, "_data", pa.array([made.compress(x.as_py()) for x in batch.column(at)], pa.binary()))


def _unpacked(column: pa.Array) -> Iterator[bytes]:
    reader = zstandard.ZstdDecompressor()
    return (reader.decompress(x.as_py()) for x in column)


def _with_spans(keyed: DataFrame, unique: bool) -> DataFrame:
    """keyed with its spans gathered, `_data` compressed: each text meets its own spans by key. Rows of equal id and text are one text: only
    one of them is looked at, else each would cover the other."""
    spans = covered(keyed if unique else keyed.select("key", "_data").dropDuplicates(["key", "_data"])).groupBy("key").agg(F.collect_set("span").alias("spans"))
    return keyed.mapInArrow(_pack, keyed.schema).join(spans, "key", "left")


def dedup_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256), one row per row of docs."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for data, spans in zip(_unpacked(batch.column(1)), batch.column(2), strict=True):
                n = runs = 0
                kept = data
                if spans.is_valid:
                    stay, n, runs = remove_spans(data, spans.values.to_numpy())
                    kept = np.frombuffer(data, np.uint8)[stay].tobytes()
                rows.append((len(data), n, runs, hashlib.sha256(kept).hexdigest()))
            columns = list(zip(*rows, strict=True)) if rows else [()] * 4
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    keyed, unique = _keyed(docs, id_col, text_col)
    return _with_spans(keyed, unique).select("_id", "_data", "spans").mapInArrow(digest, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def dedup_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the repeated bytes taken out of its texts; a character goes only if all its bytes do, so that texts stay valid UTF-8."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for data, spans in zip(_unpacked(batch.column("_data")), batch.column("spans"), strict=True):
                if spans.is_valid:
                    stay, n, _ = remove_spans(data, spans.values.to_numpy())
                    raw = np.frombuffer(data, np.uint8)
                    if n:
                        head = (raw & 0xC0) != 0x80
                        owner = np.cumsum(head) - 1
                        whole = np.bincount(owner[owner >= 0], stay[owner >= 0]) > 0
                        stay = whole[np.maximum(owner, 0)]
                    data = raw[stay].tobytes()
                out.append(data.decode("utf-8", "replace"))
            named = {n: batch.column(n) for n in batch.schema.names if n not in ("_data", "spans")}
            yield pa.RecordBatch.from_arrays([*named.values(), pa.array(out, pa.string())], names=[*named, "_text"])

    others = [c for c in docs.columns if c != text_col]
    kept = docs.select(*[F.col(f"`{c}`") for c in docs.columns])
    keyed, unique = _keyed(kept, id_col, text_col, F.struct(*[F.col(f"`{c}`") for c in others]).alias("_row"), F.col(text_col).isNull().alias("_none"))
    joined = _with_spans(keyed, unique).select("_row", "_none", "_data", "spans")
    schema = joined.select("_row", "_none").schema.add("_text", "string")
    done = joined.mapInArrow(cut, schema)
    return done.select(*[F.when(~F.col("_none"), F.col("_text")).alias(c) if c == text_col else F.col(f"_row.`{c}`").alias(c) for c in docs.columns])
