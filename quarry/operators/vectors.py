"""Vectors: text vectors without a model, exact search of a stated query set, and an inverted-file index.

Text vectors hash words and word pairs, weigh them by how rare they are, and add each to a few signed places (a sparse random projection), all in
whole numbers: step by step in built-in functions (feature_counts, feature_weights, project), or part by part on Arrow batches (text_vectors). Exact search reads each vector once and multiplies Arrow batches with a block of queries. The inverted file cuts
the vectors into cells around centroids that are fitted on a bounded sample, and keeps each cell as rows of at most BLOCK vectors, so that a large
cell is many rows; a search reads the cells nearest to its query, and in exact mode then those whose bound reaches its k-th score.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.digests import md5_heads
from ..functions.text import word_bytes
from ..sources.scratch import written
from .rank import top_k

#: Bytes of queries that are sent to every task at once; more are searched in blocks, one pass over the vectors each.
QUERY_BYTES = 32 << 20
#: Vectors a row of the index holds, queries a packed row holds, and rows of the sample that centroids are fitted on.
BLOCK, PACK, SAMPLE = 1024, 256, 10_000
#: A bound is raised by this much, more than rounding can take from it.
SLACK = 1e-9
#: Places of a text vector, and places that one feature is added to.
DIMS, SPREAD = 256, 4
#: Bytes and rows of texts for each of the parts that text_vectors() deals them and their features to: a part's memory stays the same however many texts there are.
PART_BYTES, PART_ROWS = 8 << 20, 50_000
#: Digests that a row holds, and numbers of the vectors that are added up together.
SENT, PLACED = 100_000, 1 << 20
_LOW = (1 << 32) - 1


def words(text: Column, stopwords: list[str]) -> Column:
    """The words of a text without stopwords, in order."""
    return F.filter(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]{2,}"), F.lit(0)), lambda w: ~w.isin(stopwords))


def feature_counts(texts: DataFrame, key: str, stopwords: list[str]) -> DataFrame:
    """(key, feature, tf) of texts (key, text): the words without stopwords, and neighbouring pairs of them.
    The words are a column of their own before pairs are made of them, so that a text is read once. Texts are dealt by key before they are taken apart:
    they are smaller than their features, few large files spread over all tasks, and the counts need no shuffle of their own."""
    with_words = texts.select(key, "text").repartition(F.col(key)).select(key, F.explode(F.array(words(F.coalesce("text", F.lit("")), stopwords))).alias("_words"))
    pairs = F.zip_with(F.slice("_words", 1, F.greatest(F.size("_words") - 1, F.lit(0))), F.slice("_words", 2, F.greatest(F.size("_words"), F.lit(1))), lambda a, b: F.concat_ws(" ", a, b))
    return with_words.select(key, F.explode(F.concat("_words", pairs)).alias("feature")).groupBy(key, "feature").agg(F.count("*").alias("tf"))


def feature_weights(counts: DataFrame, n_texts: int) -> DataFrame:
    """(feature, weight): thousandths of 1 + ln(texts / texts with the feature), rounded down."""
    return counts.groupBy("feature").agg(F.floor(1000 * (1 + F.log(F.lit(float(n_texts)) / F.count("*")))).alias("weight"))


def project(counts: DataFrame, weights: DataFrame, key: str, dims: int = DIMS, spread: int = SPREAD) -> DataFrame:
    """(key, v array<long>): tf x weight of each feature, added to `spread` places with signs, both from the feature's MD5. Features that no weight is
    known for are left out; keys without any have no row."""
    if not 1 <= spread <= 4:
        raise ValueError("spread is 1 to 4: 16 hexadecimal digits of a feature's MD5, four a place")
    # The digest is taken once a feature, and a count's row carries its digits as one number; places are told apart beside their key, after the shuffle.
    digits = F.conv(F.substring(F.md5(F.col("feature").cast("binary")), 1, 16), 16, -10).cast("long")
    weighed = counts.join(weights.withColumn("_digits", digits), "feature").select(key, (F.col("tf") * F.col("weight")).alias("x"), "_digits").repartition(F.col(key))
    number = F.explode(F.array(*[F.shiftright("_digits", 48 - 16 * k).bitwiseAND(F.lit(0xFFFF)) for k in range(spread)]))
    placed = weighed.select(key, "x", number.alias("n"))
    summed = placed.groupBy(key, (F.shiftright("n", 1) % dims).cast("int").alias("place")).agg(F.sum(F.when(F.col("n") % 2 == 0, F.col("x")).otherwise(-F.col("x"))).alias("x"))
    held = summed.groupBy(key).agg(F.collect_list(F.struct("place", "x")).alias("_held"))
    empty = F.transform(F.array_except(F.sequence(F.lit(0), F.lit(dims - 1)), F.col("_held.place")), lambda p: F.struct(p.alias("place"), F.lit(0).cast("long").alias("x")))
    return held.select(key, F.transform(F.array_sort(F.concat("_held", empty)), lambda e: e["x"]).alias("v"))


class _Texts:
    """The features of a part's texts: `digests` (sorted, each once) are the first 64 bits of their MD5, `held` the keys with own that have each, and
    `at`, `digest`, `tf` a row for each feature of each of `names` (own, key)."""

    def __init__(self, batches: list[pa.RecordBatch], key: str, left_out: frozenset[bytes]) -> None:
        found, sizes, whose = [], [], []
        for batch in batches:
            for own, name, text in zip(*(_column(batch, c).to_pylist() for c in ("own", key, "text")), strict=True):
                some = word_bytes(text or "")
                found += some
                sizes.append(len(some))
                whose.append((own, name))
        told = pa.array(found, pa.binary()).dictionary_encode()
        del found
        words = told.dictionary.to_pylist()
        stays = np.array([len(w) > 1 and w not in left_out for w in words], bool)
        every = told.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        text = np.repeat(np.arange(len(sizes)), sizes)[stays[every]]
        every = (np.cumsum(stays) - 1)[every[stays[every]]]
        words = [w for w, stay in zip(words, stays.tolist(), strict=True) if stay]
        names: dict[tuple[bool, object], int] = {}
        at = np.zeros(len(sizes), np.int64)
        for j in np.unique(text).tolist():
            at[j] = names.setdefault(whose[j], len(names))
        self.names, row = list(names), at[text]
        # A pair is of two neighbouring words of one text. Two numbers are told apart again by shifts, which are quicker than a division.
        begin = np.flatnonzero(text[1:] == text[:-1])
        pairs, pair = np.unique(every[begin] << 32 | every[begin + 1], return_inverse=True)
        self.digests, place = np.unique(md5_heads(words, pairs >> 32, pairs & _LOW), return_inverse=True)
        both = np.concatenate([row, row[begin]]) << 32 | np.concatenate([place[every], place[len(words) + pair]])
        met, self.tf = np.unique(both, return_counts=True)
        self.at, self.digest = met >> 32, met & _LOW
        own = np.array([o for o, _ in self.names], bool)
        self.held = np.bincount(self.digest[own[self.at]], minlength=len(self.digests))


def _asks(key: str, stopwords: list[str], buckets: int):
    """(part, bucket, first, digests, held): a part's digests in rows by bucket, which are ranges of digests, so that their order is that of all; `first` is a
    row's place among the part's."""
    left_out = frozenset(w.encode() for w in stopwords)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        part, texts = _column(held[0], "part")[0].as_py(), _Texts(held, key, left_out)
        if not texts.names:
            return
        bucket = ((texts.digests >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
        cut = np.flatnonzero(np.diff(bucket, prepend=-1))
        for begin, end in zip(cut.tolist(), [*cut[1:].tolist(), len(bucket)], strict=True):
            for first in range(begin, end, SENT):
                some = slice(first, min(first + SENT, end))
                columns = [[part], [int(bucket[begin])], [first], [texts.digests[some].tobytes()], [texts.held[some].astype(np.uint32).tobytes()]]
                kinds = [pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["part", "bucket", "first", "digests", "held"])

    return run


def _answers(n_texts: int):
    """(part, first, weights): to each row of a bucket its digests' weights, thousandths of 1 + ln(texts / texts with the feature), 0 where no text has it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = [row for batch in batches for row in zip(*(_column(batch, c).to_pylist() for c in ("part", "first", "digests", "held")), strict=True)]
        if not asked:
            return
        known, place = np.unique(np.concatenate([np.frombuffer(row[2], np.uint64) for row in asked]), return_inverse=True)
        total = np.zeros(len(known), np.int64)
        np.add.at(total, place, np.concatenate([np.frombuffer(row[3], np.uint32) for row in asked]).astype(np.int64))
        counts, count = np.unique(total, return_inverse=True)
        weight = np.array([math.floor(1000 * (1 + math.log(n_texts / n))) if n else 0 for n in counts.tolist()], np.uint16)[count]
        ends = np.cumsum([len(row[2]) // 8 for row in asked])
        for (part, first, *_), w in zip(asked, np.split(weight[place], ends[:-1]), strict=True):
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([first], pa.int64()), pa.array([w.tobytes()], pa.binary())], ["part", "first", "weights"])

    return run


def _sums(key: str, stopwords: list[str], dims: int, spread: int):
    """(own, key, v) of a part's texts and the weights of its digests."""
    left_out = frozenset(w.encode() for w in stopwords)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, told = [], []
        for batch in batches:
            said = _column(batch, "weights")
            told += [row for row in zip(_column(batch, "first").to_pylist(), said.to_pylist(), strict=True) if row[1] is not None]
            if said.null_count:
                held.append(batch.filter(said.is_null()))
        if not held:
            return
        texts, kind = _Texts(held, key, left_out), _column(held[0], key).type
        if not texts.names:
            return
        weight = np.concatenate([np.frombuffer(w, np.uint16) for _, w in sorted(told)]).astype(np.int64)
        x = texts.tf * weight[texts.digest]
        starts = np.searchsorted(texts.at, np.arange(len(texts.names) + 1))
        some = max(1, PLACED // dims)
        for first in range(0, len(texts.names), some):
            last = min(first + some, len(texts.names))
            own = slice(int(starts[first]), int(starts[last]))
            total = np.zeros((last - first) * dims, np.int64)
            for k in range(spread):
                n = ((texts.digests[texts.digest[own]] >> np.uint64(48 - 16 * k)) & np.uint64(0xFFFF)).astype(np.int64)
                # Sums below 2^53 are exact as floats too, and these are far below.
                total += np.bincount((texts.at[own] - first) * dims + (n >> 1) % dims, np.where(n & 1, -x[own], x[own]), len(total)).astype(np.int64)
            known = np.flatnonzero(np.bincount(texts.at[own] - first, x[own] > 0, last - first))  # features of texts weigh 1000 at least
            if len(known):
                flat = pa.array(total.reshape(-1, dims)[known].reshape(-1))
                v = pa.ListArray.from_arrays(pa.array(np.arange(len(known) + 1, dtype=np.int32) * dims), flat)
                names = [texts.names[first + j] for j in known.tolist()]
                yield pa.RecordBatch.from_arrays([pa.array([o for o, _ in names]), pa.array([n for _, n in names], kind), v], ["own", key, "v"])

    return run


def text_vectors(texts: DataFrame, key: str, stopwords: list[str], asked: DataFrame | None = None, dims: int = DIMS, spread: int = SPREAD) -> DataFrame:
    """(own, key, v): project() of the feature_counts() of texts (key, text), weighed by texts, and with own = false those of asked (key, text), weighed by
    texts too. Texts are dealt to as many parts as they need. A part asks for the weights of its features, each once, and gets two bytes for each, in the
    order in which it asked; features of a text never travel, so their texts are taken apart twice. A feature is the first 64 bits of its MD5, which its
    places are taken from: two of 10^8 features have equal ones with a probability of 3 in 10^4."""
    if not 1 <= spread <= 4:
        raise ValueError("spread is 1 to 4: 16 hexadecimal digits of a feature's MD5, four a place")
    size = texts.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()
    parts = max(texts.sparkSession.sparkContext.defaultParallelism, -(-size["bytes"] // PART_BYTES), -(-size["n"] // PART_ROWS))
    every = texts.select(F.lit(True).alias("own"), key, "text")
    if asked is not None:
        every = every.unionByName(asked.select(F.lit(False).alias("own"), key, "text"))
    kind = texts.schema[key].dataType.simpleString()
    every = every.withColumn("part", F.pmod(F.hash(key), F.lit(parts)).cast("int"))
    asks = every.repartitionById(parts, "part").mapInArrow(_asks(key, stopwords, parts), "part int, bucket int, first long, digests binary, held binary")
    answers = asks.repartitionById(parts, "bucket").mapInArrow(_answers(size["n"]), "part int, first long, weights binary")
    both = every.unionByName(answers, allowMissingColumns=True).repartitionById(parts, "part")
    return both.select("own", key, "text", "first", "weights").mapInArrow(_sums(key, stopwords, dims, spread), f"own boolean, `{key}` {kind}, v array<bigint>")


def _matrix(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places, vectors, norms) of the vectors of that width without nulls whose norm is neither 0 nor infinite."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = pc.list_value_length(column).fill_null(-1).to_numpy(zero_copy_only=False)
    at = np.flatnonzero(sizes == width)
    flat = column.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = flat.reshape(len(at), width)
    with np.errstate(invalid="ignore", over="ignore"):
        norm = np.sqrt((x * x).sum(axis=1))
    good = np.isfinite(norm) & (norm > 0)
    return at[good], x[good], norm[good]


def _column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


class _Best:
    """The k best vectors of each query so far, by cosine, then by id. A matrix product tells which vectors can be among them; those are scored anew, each
    pair by the same sum, so that equal vectors have equal scores wherever they lie."""

    def __init__(self, x: np.ndarray, norms: np.ndarray, k: int) -> None:
        self.x, self.norms, self.k = x, norms, k
        self.all: list[list[tuple[float, object]]] = [[] for _ in x]

    def add(self, v: np.ndarray, norms: np.ndarray, ids: list) -> None:
        near = (self.x @ v.T) / (self.norms[:, None] * norms[None])
        least = np.partition(near, near.shape[1] - self.k, axis=1)[:, near.shape[1] - self.k] if near.shape[1] > self.k else np.full(len(near), -np.inf)
        for q, held in enumerate(self.all):
            bound = max(least[q], -held[-1][0] if len(held) == self.k else -np.inf) - SLACK
            at = np.flatnonzero(near[q] >= bound)
            if len(at):
                scores = (v[at] * self.x[q]).sum(axis=1) / (self.norms[q] * norms[at])
                held += [(-s, ids[j]) for s, j in zip(scores.tolist(), at.tolist(), strict=True)]
                held.sort()
                del held[self.k :]


def _found(qs: list, best: _Best, q_type: pa.DataType, id_type: pa.DataType) -> pa.RecordBatch:
    rows = [(q, i, -s) for q, held in zip(qs, best.all, strict=True) for s, i in held]
    q, i, s = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(q, q_type), pa.array(i, id_type), pa.array(s, pa.float64())], ["q", "node_id", "score"])


def _out_schema(queries: DataFrame, vectors: DataFrame) -> str:
    return f"q {queries.schema['q'].dataType.simpleString()}, node_id {vectors.schema['node_id'].dataType.simpleString()}, score double"


def exact_top_k(queries: DataFrame, vectors: DataFrame, k: int = 24, query_bytes: int = QUERY_BYTES) -> DataFrame:
    """(q, node_id, score, rank) by cosine, ties by node_id. queries: (q, v), a stated set; vectors: (node_id, v). Queries are counted, cut by hash into
    blocks of at most query_bytes and sent to every task, which keeps k vectors of each query; no vector is shuffled. Vectors that are null, of another
    length than the queries, or without a norm are not found."""
    spark = vectors.sparkSession
    size = queries.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("width")).first()
    width = size["width"] or 0
    blocks = max(1, -(-size["n"] * max(width, 1) * 8 // query_bytes))
    schema = _out_schema(queries, vectors)

    def search(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            qs, x, norms = shared.value
            best, types = _Best(x, norms, k), None
            for batch in batches:
                types = _column(batch, "node_id").type
                at, v, vn = _matrix(_column(batch, "v"), width)
                if len(at) and len(qs):
                    best.add(v, vn, _column(batch, "node_id").take(pa.array(at)).to_pylist())
            if types is not None:
                yield _found(qs, best, q_type, types)

        return run

    from pyspark.sql.pandas.types import to_arrow_type

    q_type, every = to_arrow_type(queries.schema["q"].dataType), None
    for b in range(blocks):
        own = queries.select("q", "v").where(F.pmod(F.xxhash64("q"), F.lit(blocks)) == b).toArrow()
        at, x, norms = _matrix(own.column("v"), width)
        shared = spark.sparkContext.broadcast(([own.column("q")[int(i)].as_py() for i in at], x, norms))
        one = vectors.select("node_id", "v").mapInArrow(search(shared), schema)
        every = one if every is None else every.unionByName(one)
    return top_k(every, ["q"], [F.desc("score"), "node_id"], k)


def fit_centroids(vectors: DataFrame, n: int | None = None, sample: int = SAMPLE, rounds: int = 10) -> np.ndarray:
    """Unit centroids of `vectors` (node_id, v): spherical k-means of about sqrt(rows) cells, at most 4,096, on the `sample` rows whose ids have the
    least hashes (a parameter, whatever the number of rows)."""
    rows = vectors.count()
    n = n or max(1, min(4096, int(rows**0.5)))
    taken = vectors.select("node_id", "v").orderBy(F.xxhash64("node_id"), "node_id").limit(sample).toArrow()
    widths = pc.list_value_length(taken.column("v")).drop_null().to_pylist()
    if not widths:
        return np.zeros((1, 0))
    _, x, norms = _matrix(taken.column("v"), max(widths))
    x = x / norms[:, None]
    if not len(x):
        return np.zeros((1, max(widths)))
    centre = x[:: max(1, len(x) // n)][:n].copy()
    for _ in range(rounds):
        cell = (x @ centre.T).argmax(axis=1)
        total = np.zeros_like(centre)
        np.add.at(total, cell, x)
        norm = np.sqrt((total * total).sum(axis=1))
        centre[norm > 0] = total[norm > 0] / norm[norm > 0, None]
    return centre


def build_cells(vectors: DataFrame, centroids: np.ndarray, block: int = BLOCK) -> DataFrame:
    """The index: rows (cell, least, n, ids, data) of at most `block` vectors of one cell, each with its norm behind it; `least` is the least cosine of a row's vectors to its
    centroid. Made where the vectors lie, without a shuffle; rows that a task leaves short are no trouble. Vectors without a norm are left out."""
    width = centroids.shape[1]
    shared = vectors.sparkSession.sparkContext.broadcast(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        kind = None

        def row(cell: int) -> pa.RecordBatch:
            ids, data, near = zip(*held.pop(cell), strict=True)
            return pa.RecordBatch.from_arrays([pa.array([cell], pa.int32()), pa.array([float(min(near))]), pa.array([len(ids)], pa.int32()), pa.array([list(ids)], pa.list_(kind)), pa.array([np.stack(data).astype("<f8").tobytes()], pa.binary())], ["cell", "least", "n", "ids", "data"])

        for batch in batches:
            kind = _column(batch, "node_id").type
            at, x, norms = _matrix(_column(batch, "v"), width)
            if not len(at):
                continue
            near = (x @ shared.value.T) / norms[:, None]
            cells = near.argmax(axis=1)
            ids = _column(batch, "node_id").take(pa.array(at)).to_pylist()
            for j, cell in enumerate(cells.tolist()):
                held.setdefault(cell, []).append((ids[j], np.append(x[j], norms[j]), near[j, cell]))
                if len(held[cell]) >= block:
                    yield row(cell)
        for cell in list(held):
            yield row(cell)

    kind = vectors.schema["node_id"].dataType.simpleString()
    return vectors.select("node_id", "v").mapInArrow(run, f"cell int, least double, n int, ids array<{kind}>, data binary")


def _packed(asked: DataFrame) -> DataFrame:
    """(cell, qs, data): the queries (cell, q, data) of a cell in rows of at most PACK, so that a cell that many ask for is many rows."""
    deal = F.pmod(F.xxhash64("q"), F.lit(max(1, asked.sparkSession.sparkContext.defaultParallelism)))
    cut = asked.withColumn("_deal", deal).withColumn("_cut", F.floor((F.row_number().over(Window.partitionBy("cell", "_deal").orderBy("q")) - 1) / PACK))
    return cut.groupBy("cell", "_deal", "_cut").agg(F.collect_list(F.struct("q", "data")).alias("all")).select("cell", F.transform("all", lambda x: x["q"]).alias("qs"), F.transform("all", lambda x: x["data"]).alias("datas"))


def _products(pairs: DataFrame, schema: str, width: int, k: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                qs, ids = _column(batch, "qs")[r], _column(batch, "ids")[r]
                x = np.frombuffer(b"".join(_column(batch, "datas")[r].as_py()), "<f8").reshape(-1, width + 1)
                v = np.frombuffer(_column(batch, "data")[r].as_py(), "<f8").reshape(-1, width + 1)
                best = _Best(x[:, :-1], x[:, -1], k)
                best.add(v[:, :-1], v[:, -1], ids.as_py())
                yield _found(qs.as_py(), best, qs.type.value_type, ids.type.value_type)

    return pairs.select("qs", "datas", "ids", "data").mapInArrow(run, schema)


def ivf_top_k(queries: DataFrame, cells: DataFrame, centroids: np.ndarray, k: int = 24, probes: int = 8, exact: bool = False) -> DataFrame:
    """(q, node_id, score, rank) by cosine from an index of build_cells(). Each query reads its `probes` nearest cells. With exact, it then reads the other
    cells whose bound reaches its k-th score: no vector of a cell is nearer than the angle to its centroid less the cell's widest angle."""
    spark, width = cells.sparkSession, centroids.shape[1]
    widest = np.full(len(centroids), 1.0)
    held = np.zeros(len(centroids), bool)
    for r in cells.groupBy("cell").agg(F.min("least").alias("least")).collect():
        widest[r["cell"]], held[r["cell"]] = r["least"], True
    shared = spark.sparkContext.broadcast((centroids, np.arccos(np.clip(widest, -1, 1)), held))
    q_kind = queries.schema["q"].dataType.simpleString()

    def ask(first: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            centre, wide, full = shared.value
            for batch in batches:
                at, x, norms = _matrix(_column(batch, "v"), width)
                if not len(at) or not full.any():
                    continue
                near = np.where(full[None], (x @ centre.T) / norms[:, None], -np.inf)
                order = np.argsort(-near, axis=1, kind="stable")
                place = np.empty_like(order)
                np.put_along_axis(place, order, np.arange(order.shape[1])[None], axis=1)
                take = (place < probes) & full[None]
                if not first:
                    bound = np.cos(np.maximum(np.arccos(np.clip(near, -1, 1)) - wide[None], 0)) + SLACK
                    take = ~take & full[None] & (bound >= _column(batch, "kth").take(pa.array(at)).to_numpy(zero_copy_only=False)[:, None])
                row, cell = np.nonzero(take)
                datas = [np.append(v, n).astype("<f8").tobytes() for v, n in zip(x, norms, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), _column(batch, "q").take(pa.array(at[row])), pa.array([datas[j] for j in row.tolist()], pa.binary())], ["cell", "q", "data"])

        return run

    schema, asks = _out_schema(queries, cells.select(F.explode("ids").alias("node_id"))), f"cell int, q {q_kind}, data binary"

    def search(asked: DataFrame) -> DataFrame:
        return _products(_packed(asked).join(cells.drop("least", "n"), "cell"), schema, width, k)

    near = search(queries.select("q", "v").mapInArrow(ask(True), asks))
    if not exact:
        return top_k(near, ["q"], [F.desc("score"), "node_id"], k)
    near = written(top_k(near, ["q"], [F.desc("score"), "node_id"], k).drop("rank"), "probed")
    kth = near.groupBy("q").agg(F.when(F.count("*") >= k, F.min("score")).otherwise(-2.0).alias("kth"))
    rest = queries.select("q", "v").join(kth, "q", "left").select("q", "v", F.coalesce("kth", F.lit(-2.0)).alias("kth"))
    return top_k(near.unionByName(search(rest.mapInArrow(ask(False), asks))), ["q"], [F.desc("score"), "node_id"], k)
