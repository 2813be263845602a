"""Vector code compression (product quantisation): vectors of floor(4096 x) are cut into parts, each part is replaced by the index of the nearest entry
of its position's codebook, and the codebooks are settled by rounds of assigning and averaging over all rows.

Nearest entries are found by a vantage-point tree over the entries of a part position, searched by branch and bound for whole batches: distances are
rounded outwards, a subtree is entered unless its bound is strictly beyond the best distance (so that ties are seen), and what decides is the exact
squared distance in integers, then the lower index. A task reads its rows in Arrow batches and sends one partial sum for each entry; codebooks
(parts x entries x width integers, whatever the number of rows) are all that goes through the driver.

Defined results: null vectors and vectors with a null, NaN or infinite component are dropped. Null ids and labels stay (null ids come last among the
seeds; rows without a label share one group). Repeated rows count each. Equal ids among the seeds are ordered by their components. Fewer rows than
entries give smaller codebooks. Vectors of other lengths than the longest, and lengths that no equal parts fit, are filled with zeros at their end. An
empty table gives an empty result. Components so large that squared distances could pass 63 bits raise ValueError. Further columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

PARTS, ENTRIES, SCALE, ROUNDS = 8, 16, 4096, 6
#: A square root of an integer is off by less than this share; bounds are moved by it to the safe side.
SLACK = 2.0**-50


def quantize(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS, scale: int = SCALE) -> DataFrame:
    """(id, label, x array<bigint>) of the rows that can be used, x of the same length in each, a multiple of parts; written as a table."""
    v = F.col(f"`{vector_col}`")
    whole = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    used = vectors.where(v.isNotNull() & whole).select(
        F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").alias("label"), F.transform(v, lambda x: F.floor(x.cast("double") * scale)).alias("x"), F.array_max(F.transform(v, lambda x: F.abs(x.cast("double")))).alias("m")
    )
    size = used.agg(F.max(F.size("x")).alias("most"), F.max("m").alias("m")).first()
    width = -(-(size["most"] or 0) // parts) * parts
    if width * (2 * scale * (size["m"] or 0.0) + 2) ** 2 >= 2.0**63:
        raise ValueError(f"components up to {size['m']:g} are too large for squared distances in 63 bits")
    return materialize(used.select("id", "label", F.concat("x", F.array_repeat(F.lit(0).cast("long"), F.lit(width) - F.size("x"))).alias("x")), "quantized")


class VantageTree:
    """The entries (n, width) of one part position. A node is (entry, (least, largest distance, node) of the near half, the same of the far half)."""

    def __init__(self, entries: np.ndarray) -> None:
        self.entries = entries
        self.root = self._grow(list(range(len(entries))))

    def _grow(self, ids: list[int]):
        if not ids:
            return None
        point, rest = ids[0], ids[1:]
        far = {i: int(((self.entries[i] - self.entries[point]) ** 2).sum()) for i in rest}
        rest.sort(key=lambda i: (far[i], i))
        half = (len(rest) + 1) // 2
        sides = []
        for side in (rest[:half], rest[half:]):
            if side:
                sides.append((far[side[0]] ** 0.5 * (1 - SLACK), far[side[-1]] ** 0.5 * (1 + SLACK), self._grow(sorted(side))))
        return point, sides

    def nearest(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index, squared distance) of the nearest entry of each query, the lower index of equally near ones."""
        best = np.full(len(queries), np.iinfo(np.int64).max)
        which = np.full(len(queries), len(self.entries))

        def visit(node, rows: np.ndarray) -> None:
            point, sides = node
            square = ((queries[rows] - self.entries[point]) ** 2).sum(axis=1)
            better = (square < best[rows]) | ((square == best[rows]) & (point < which[rows]))
            best[rows[better]], which[rows[better]] = square[better], point
            root = np.sqrt(square.astype(np.float64))
            low, high = root * (1 - SLACK), root * (1 + SLACK)
            # Those nearer to the near half look there first, the others in the far half: the first look lowers the bound for the second.
            near = root <= (sides[0][1] + sides[-1][0]) / 2 if sides else None
            for group, order in ((near, sides), (~near, sides[::-1])) if sides else ():
                for least, most, child in order:
                    bound = np.maximum(low[group] - most, least - high[group]) * (1 - SLACK)
                    seen = bound <= np.sqrt(best[rows[group]].astype(np.float64)) * (1 + SLACK)
                    if seen.any():
                        visit(child, rows[group][seen])

        if self.root is not None and len(queries):
            visit(self.root, np.arange(len(queries)))
        return which, best


def _matrix(column: pa.Array, parts: int) -> np.ndarray:
    """A list column as (rows, parts, width) integers."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False)
    return flat.reshape(len(column), parts, -1) if len(flat) else np.zeros((len(column), parts, 0), np.int64)


def _arrays(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def entry_sums(table: DataFrame, book: np.ndarray) -> DataFrame:
    """(part, entry, place, n, total): how many parts of all rows are nearest to an entry, and the sum of each of their components."""
    parts, entries, width = book.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = [VantageTree(book[p]) for p in range(parts)]
        count, total = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, width), np.int64)
        for batch in batches:
            rows = _matrix(_arrays(batch, "x"), parts)
            for p in range(parts):
                which, _ = trees[p].nearest(rows[:, p])
                count[p] += np.bincount(which, minlength=entries)
                np.add.at(total[p], which, rows[:, p])
        p, e = np.nonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(count[p, e]), pa.array(list(total[p, e]), pa.list_(pa.int64()))], ["part", "entry", "n", "totals"])

    sums = table.select("x").mapInArrow(run, "part int, entry int, n long, totals array<bigint>")
    spread = sums.select("part", "entry", "n", F.posexplode("totals").alias("place", "total"))
    return spread.groupBy("part", "entry", "place").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))


def train(table: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    """The codebooks (parts, entries, width) of a table of quantize(): seeds are the rows of the smallest ids, each round replaces an entry by the
    rounded-down mean of the parts nearest to it; entries without any stay."""
    seeds = table.orderBy(F.col("id").asc_nulls_last(), "x").limit(entries).collect()
    book = np.array([list(r["x"]) for r in seeds], np.int64).reshape(len(seeds), parts, -1 if seeds and len(seeds[0]["x"]) else 0).swapaxes(0, 1).copy()
    for _ in range(rounds if book.size else 0):
        for r in entry_sums(table, book).collect():
            book[r["part"], r["entry"], r["place"]] = int(r["total"]) // r["n"]
    return book


def encode(table: DataFrame, book: np.ndarray) -> DataFrame:
    """(id, label, code, error) of a table of quantize(): two hex digits a part, and the squared distances summed over the parts."""
    parts = len(book)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = [VantageTree(book[p]) for p in range(parts)]
        for batch in batches:
            rows = _matrix(_arrays(batch, "x"), parts)
            found = [trees[p].nearest(rows[:, p]) for p in range(parts)]
            codes = np.stack([w for w, _ in found], axis=1).astype(np.uint8)
            error = sum(d for _, d in found)
            yield pa.RecordBatch.from_arrays([_arrays(batch, "id"), _arrays(batch, "label"), pa.array([c.tobytes().hex() for c in codes]), pa.array(error)], ["id", "label", "code", "error"])

    kinds = dict(table.dtypes)
    return table.mapInArrow(run, f"id {kinds['id']}, label {kinds['label']}, code string, error long")


def decode(codes: DataFrame, book: np.ndarray) -> DataFrame:
    """codes (code, ...) with `x`: the entries that the code names, one after the other."""
    entries = F.array(*[F.array(*[F.array(*[F.lit(int(v)).cast("long") for v in e]) for e in part]) for part in book])
    digits = F.transform(F.sequence(F.lit(0), F.lit(len(book) - 1)), lambda p: F.conv(F.substring("code", p * 2 + 1, F.lit(2)), 16, 10).cast("int"))
    return codes.withColumn("x", F.flatten(F.zip_with(entries, digits, lambda part, d: F.get(part, d))))


def fingerprint(book: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, book.ravel().tolist())).encode()).hexdigest()


def compress(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, scale: int = SCALE, rounds: int = ROUNDS) -> DataFrame:
    """(id_col, code, error, label_error, codebooks_sha256): codes after the last round; label_error sums the errors of all rows of equal label.

    Sums by label are made in the map tasks first; they meet their rows by a join, whose hot labels Spark splits."""
    table = quantize(vectors, id_col, vector_col, label_col, parts, scale)
    book = train(table, parts, entries, rounds)
    coded = materialize(encode(table, book), "codes")
    sums = coded.groupBy(F.col("label").alias("of_label")).agg(F.sum(F.col("error").cast("decimal(38,0)")).cast("long").alias("label_error"))
    both = coded.join(sums, F.col("label").eqNullSafe(F.col("of_label")))
    return both.select(F.col("id").alias(id_col), "code", "error", "label_error", F.lit(fingerprint(book)).alias("codebooks_sha256"))


def _oracle() -> str:
    """DuckDB SQL: the rounds written out one after the other."""
    square = "list_sum(list_transform(range(1, len(q) + 1), lambda i: (q[i] - c[i]) * (q[i] - c[i])))"
    steps = [
        """v AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: floor(4096 * x::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        "p AS MATERIALIZED (SELECT vec_id, label, part, x[part * (len(x) // 8) + 1 : (part + 1) * (len(x) // 8)] AS q FROM v, (SELECT unnest(range(0, 8)) AS part))",
        "b0 AS MATERIALIZED (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS e, q AS c FROM p WHERE vec_id IN (SELECT vec_id FROM v ORDER BY vec_id LIMIT 16))",
    ]
    for k in range(ROUNDS + 1):
        steps.append(f"a{k} AS MATERIALIZED (SELECT vec_id, label, part, any_value(q) AS q, min({{'d': d, 'e': e}}) AS best FROM (SELECT p.*, e, {square} AS d FROM p JOIN b{k} USING (part)) GROUP BY vec_id, label, part)")
        if k < ROUNDS:
            steps.append(f"""m{k} AS (SELECT part, e, list((s - ((s % n) + n) % n) // n ORDER BY i)::BIGINT[] AS c FROM (SELECT part, best.e AS e, i, sum(q[i]) AS s, count(*) AS n FROM a{k}, LATERAL (SELECT unnest(range(1, len(q) + 1)) AS i) GROUP BY ALL) GROUP BY ALL)""")
            steps.append(f"b{k + 1} AS MATERIALIZED (SELECT part, e, coalesce(m{k}.c, b{k}.c) AS c FROM b{k} LEFT JOIN m{k} USING (part, e))")
    last = ROUNDS
    return (
        "WITH " + ",\n".join(steps) + f""",
r AS (SELECT vec_id, label, string_agg(printf('%02x', best.e::INT), '' ORDER BY part) AS code, sum(best.d)::BIGINT AS error FROM a{last} GROUP BY vec_id, label)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
  (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, e)) FROM b{last}) AS codebooks_sha256 FROM r"""
    )


ORACLE_SQL = _oracle()
