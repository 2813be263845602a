"""Language-model scoring by context-tree weighting: each byte is eight binary decisions, each decision has a tree of the bytes before it, and
Krichevsky-Trofimov estimates of all depths are mixed with the weights that the training texts give them.

A Krichevsky-Trofimov estimate depends on two counts only, and counts add up: tasks count byte strings of DEPTH + 1 bytes, Spark adds them up, and the
trees are made from there, depth by depth, as tables: a node's weighted probability is half its own estimate and half the product of its children's.
A node then needs two numbers, its estimate and the share `stop` of its own estimate in the mixture; a decision's probability is
stop x estimate + (1 - stop) x that of the next deeper node on its path, and 1/2 below the last node that was seen. So it depends on that last node
alone: it is worked out once for each node, and a decision looks its own up from the deepest tree on, where nearly all strings are found.

The text that is modelled is what the words are taken from: UTF-8 with A-Z lower-cased. It is coded with one end, the byte 0xFF, which no text holds; so
are the bytes before its start. So the probabilities of all texts add up to at most one.

Nodes are sent to every task if they are at most MOST_NODES, counted before (16 bytes each). Else distinct byte strings meet the nodes by their last two
bytes of context in a shuffle; both ways give the same scores. The unigram base works alike: the TOP_WORDS most frequent words are sent to every task,
the occurrences of others meet the counts by a join.

Defined results: a null text is empty (one token, the end); rows whose doc_id is null belong to the training rows. Repeated rows count each and get equal
scores. Very long texts are coded in slices. Without training rows every bit has probability 1/2 and every token base probability 1. Further columns
are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize

DEPTH, EDGE = 4, b"\xff"
HELD_OUT = "crc32(cast(cast({} as string) as binary)) % 7 = 2"
#: Bytes of text that a task counts together, and at which it cuts long texts; it scores half as many together.
LOT = 4 << 20
MOST_NODES, TOP_WORDS, LONG_WORD = 8_000_000, 200_000, 64
#: Scores of byte strings that a task remembers.
REMEMBERED = 1_000_000
#: Nodes that are settled together.
TOGETHER = 1 << 18


def _packed(flat: bytes, depth: int) -> np.ndarray:
    """Each stretch of depth + 1 bytes (8 at most) as an integer: eight bytes are read from every place, and those that are too many shifted out."""
    every = np.ndarray(len(flat) - depth, ">u8", flat + bytes(8), strides=(1,)).astype(np.uint64)
    return (every >> np.uint64(56 - 8 * depth)).view(np.int64)


def codes_of(texts: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(codes, text): each byte of the texts and each end with the depth bytes before it, packed into an integer, and which text it is of."""
    edge = EDGE * depth
    lengths = np.array([len(t) + 1 for t in texts])
    code = _packed(edge.join([b"", *[t + EDGE for t in texts]]), depth)
    begin = np.cumsum(lengths[:-1] + depth)
    real = np.ones(len(code), bool)
    real[(begin[:, None] - 1 - np.arange(depth)).ravel()] = False  # bytes before the start of the texts behind the first
    return code[real], np.repeat(np.arange(len(texts), dtype=np.int32), lengths)


def _lots(batches: Iterator[pa.RecordBatch], depth: int, lot: int) -> Iterator[list[tuple[tuple[int, str | None], bytes, bytes, bool]]]:
    """Lists of ((row, id), bytes, context, last): slices of texts of about `lot` bytes together; a slice has the bytes before it as its context."""
    held, size, row = [], 0, 0
    for batch in batches:
        names = batch.column(batch.schema.get_field_index("id")) if "id" in batch.schema.names else pa.nulls(batch.num_rows)
        for name, text in zip(names, batch.column(batch.schema.get_field_index("text")), strict=True):
            raw = (text.as_py() or "").encode("utf-8", "replace").lower()
            for at in range(0, len(raw) or 1, lot):
                piece = raw[at : at + lot]
                held.append(((row, name.as_py()), piece, (EDGE * depth + raw[max(at - depth, 0) : at])[-depth:] if depth else b"", at + lot >= len(raw)))
                size += len(piece) + 1
                if size >= lot:
                    yield held
                    held, size = [], 0
            row += 1
    if held:
        yield held


def _strings(held: list[tuple[tuple[int, str | None], bytes, bytes, bool]], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """codes_of() for slices: those that go on have no end, those that continue have a context."""
    code, owner = codes_of([p for _, p, _, _ in held], depth)
    cut = [k for k, (_, _, context, last) in enumerate(held) if not last or context != EDGE * depth]
    if not cut:
        return code, owner
    parts, owners = [code[~np.isin(owner, cut)]], [owner[~np.isin(owner, cut)]]
    for k in cut:
        _, piece, context, last = held[k]
        own = _packed(context + piece + (EDGE if last else b""), depth)
        parts.append(own)
        owners.append(np.full(len(own), k, np.int32))
    return np.concatenate(parts), np.concatenate(owners)


class Words:
    """Cuts a text's slices into tokens: a word that a slice cuts through is put together again."""

    def __init__(self) -> None:
        self.open = b""

    def of(self, piece: bytes, last: bool) -> list[bytes]:
        raw = self.open + piece
        words = raw.split()
        self.open = b""
        if not last and words and not raw[-1:].isspace():
            self.open = words.pop()
        return words


def _told_apart(words: list[bytes]) -> tuple[np.ndarray, pa.Array]:
    """(the place of each word among the distinct ones, the distinct ones)."""
    told = pa.array(words, pa.binary()).dictionary_encode()
    return told.indices.to_numpy().astype(np.int64), told.dictionary


def _count(depth: int, lot: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for held in _lots(batches, depth, lot):
            found = []
            for _, piece, _, last in held:
                found += words.of(piece, last)
                if last:
                    found.append(b"")
            place, distinct = _told_apart(found)
            n = len(distinct)
            yield pa.RecordBatch.from_arrays([distinct.cast(pa.string()), pa.nulls(n, pa.int64()), pa.array(np.bincount(place, minlength=n), pa.int64())], ["word", "code", "n"])
            codes, counts = np.unique(_strings(held, depth)[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.nulls(len(codes), pa.string()), pa.array(codes), pa.array(counts)], ["word", "code", "n"])

    return run


def corpus_counts(texts: DataFrame, depth: int = DEPTH, lot: int = LOT) -> DataFrame:
    """(word, code, n) of texts (text): how often each word stands in all of them ('' for the end), and each packed byte string; written as a table."""
    counted = texts.select("text").mapInArrow(_count(depth, lot), "word string, code long, n long")
    return materialize(counted.groupBy("word", "code").agg(F.sum("n").alias("n")), "corpus_counts")


def log_gamma(x: Column) -> Column:
    """The logarithm of the gamma function for x > 0: Stirling's series at x + 8, less the factors in between."""
    z = x + 8
    series = 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5) - 1 / (1680 * z**7)
    product = x
    for k in range(1, 8):
        product = product * (x + k)
    # Eight factors pass the range of doubles beyond 10^38, where no count comes.
    return (z - 0.5) * F.log(z) - z + 0.5 * math.log(2 * math.pi) + series - F.log(product)


def context_trees(counts: DataFrame, depth: int = DEPTH) -> tuple[list[DataFrame], list[DataFrame]]:
    """(nodes by depth, 0 first, of byte strings (code, n): (key, p, stop); the scratch tables they are read from). key: bytes of context, then the path of
    bits within the byte from 1."""
    bit = F.expr("shiftright(code, 7 - j) & 1")
    paths = counts.select("code", "n", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("j")).select(
        F.expr("(shiftright(code, 8) << 8) | (1L << j) | shiftright(code & 255, 8 - j)").alias("key"), F.when(bit == 0, F.col("n")).otherwise(0).alias("a"), F.when(bit == 1, F.col("n")).otherwise(0).alias("b")
    )
    nodes = paths.groupBy("key").agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.lit(0.0).alias("below"))
    out, tables = [], []
    a, b = F.col("a").cast("double"), F.col("b").cast("double")
    for d in range(depth, -1, -1):
        own = log_gamma(a + 0.5) + log_gamma(b + 0.5) - log_gamma(a + b + 1) - math.log(math.pi)
        told = nodes.withColumn("own", own)
        most = F.greatest("own", "below")
        both = most + F.log(F.exp(F.col("own") - most) + F.exp(F.col("below") - most)) - math.log(2)
        told = materialize(told.withColumn("weighted", F.col("own") if d == depth else both), f"nodes{d}")
        tables.append(told)
        stop = F.lit(1.0) if d == depth else F.least(F.lit(1.0), F.exp(F.col("own") - F.col("weighted")) / 2)
        # The probability of a one, or less than zero that of a zero, whichever is smaller: near one a float has no room, and what was never seen would be impossible.
        p = F.when(b > a, -(a + 0.5) / (a + b + 1)).otherwise((b + 0.5) / (a + b + 1))
        out.insert(0, told.select("key", p.cast("float").alias("p"), stop.cast("float").alias("stop")))
        if d:
            nodes = told.groupBy(F.expr(f"key & {(1 << (8 * d)) - 1}L").alias("key")).agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.sum("weighted").alias("below"))
    return out, tables


def settled(trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> list[tuple[np.ndarray, np.ndarray]]:
    """By depth (sorted keys, the probability of a one where a path ends at that node) of trees (sorted keys, p, stop). A node's shallower ones are
    nodes too, since counts add up."""
    out = []
    for deepest, (every, *_) in enumerate(trees):
        ones = np.full(len(every), 0.5)
        for first in range(0, len(every), TOGETHER):
            some = slice(first, first + TOGETHER)
            for d in range(deepest, -1, -1):
                keys, p, stop = trees[d]
                at = np.searchsorted(keys, every[some] & ((1 << (8 * (d + 1))) - 1))
                share, own = stop[at].astype(np.float64), p[at].astype(np.float64)
                ones[some] = share * np.where(own < 0, 1 + own, own) + (1 - share) * ones[some]
        out.append((every, ones))
    return out


def log10_settled(codes: np.ndarray, nodes: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """log10 of the probability of each packed byte string's last byte after the others; nodes: settled() trees. Sorted strings are found sooner."""
    byte, total = codes & 255, np.zeros(len(codes))
    for j in range(8):
        path = (1 << j) | (byte >> (8 - j))
        one, left = np.full(len(codes), 0.5), np.arange(len(codes))
        for d in range(len(nodes) - 1, -1, -1):
            keys, ones = nodes[d]
            if len(keys) and len(left):
                key = (((codes[left] >> 8) & ((1 << (8 * d)) - 1)) << 8) | path[left]
                at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
                met = keys[at] == key
                one[left[met]] = ones[at[met]]
                left = left[~met]
        total += np.log10(np.where((byte >> (7 - j)) & 1 == 1, one, 1 - one))
    return total


def log10_bytes(codes: np.ndarray, trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> np.ndarray:
    """log10_settled() from trees by depth (sorted keys, p, stop)."""
    return log10_settled(codes, settled(trees))


def _sorted(rows) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    key, p, stop = (np.asarray(rows[c], kind) for c, kind in (("key", np.int64), ("p", np.float32), ("stop", np.float32)))
    order = np.argsort(key)
    return key[order], p[order], stop[order]


class Scores:
    """log10_settled() with a memory of what was asked before."""

    def __init__(self, nodes) -> None:
        self.nodes, self.codes, self.scores = nodes, np.zeros(0, np.int64), np.zeros(0)

    def of(self, codes: np.ndarray) -> np.ndarray:
        """codes: distinct ones, sorted."""
        at = np.searchsorted(self.codes, codes)
        known = np.zeros(len(codes), bool)
        inside = at < len(self.codes)
        known[inside] = self.codes[at[inside]] == codes[inside]
        out = np.zeros(len(codes))
        out[known] = self.scores[at[known]]
        out[~known] = log10_settled(codes[~known], self.nodes)
        if len(self.codes) + np.count_nonzero(~known) > REMEMBERED:
            self.codes, self.scores = codes, out
        else:
            self.codes, self.scores = np.insert(self.codes, at[~known], codes[~known]), np.insert(self.scores, at[~known], out[~known])
        return out


def _totals(codes: np.ndarray, owner: np.ndarray, n: int, depth: int, scores: Scores) -> np.ndarray:
    """The sum of the scores of each of n owners' strings."""
    bits = n.bit_length()
    if 8 * (depth + 1) + bits > 64:
        distinct, back = np.unique(codes, return_inverse=True)
        return np.bincount(owner, scores.of(distinct)[back], n)
    # Sorted in one number with their owners, strings need no way back to their places.
    both = np.sort(codes.view(np.uint64) << np.uint64(bits) | owner.astype(np.uint64))
    codes, owner = (both >> np.uint64(bits)).view(np.int64), (both & np.uint64((1 << bits) - 1)).view(np.int64)
    first = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
    return np.bincount(owner, np.repeat(scores.of(codes[first]), np.diff(first, append=len(codes))), n)


ROW = "row long, id string, n_tokens long, n_bytes long, n_known long, base double, score double, rare array<struct<word:string,n:long>>, codes array<struct<code:long,n:long>>"


def _score(depth: int, lot: int, words, nodes):
    """A row for each slice of a text: tokens among the words that were sent, the other tokens, and the score, or the byte strings where nodes is None."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, scores = words.value, Scores(nodes.value) if nodes is not None else None
        base = TaskContext.get().partitionId() << 40
        cutter = Words()
        for held in _lots(batches, depth, lot):
            codes, owner = _strings(held, depth)
            n = len(held)
            total, strings = np.zeros(n), [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * n
            if scores is not None:
                total = _totals(codes, owner, n, depth, scores)
            else:
                order = np.argsort(owner, kind="stable")
                strings = [np.unique(own, return_counts=True) for own in np.split(codes[order], np.searchsorted(owner[order], np.arange(1, n)))]
            found, tokens = [], []
            for _, piece, _, last in held:
                own = cutter.of(piece, last)
                if last:
                    own.append(b"")
                found += own
                tokens.append(len(own))
            place, distinct = _told_apart(found)
            value = np.fromiter(map(known.get, distinct.to_pylist(), repeat(0.0)), np.float64, len(distinct))[place]  # of a word that was sent more than 0
            whose, other = np.repeat(np.arange(n), tokens), value == 0
            rare, times = np.unique(whose[other] << 32 | place[other], return_counts=True)
            yield pa.RecordBatch.from_arrays([
                pa.array([base + row for (row, _), *_ in held]), pa.array([name for (_, name), *_ in held], pa.string()), pa.array(tokens, pa.int64()),
                pa.array([len(piece) + last for _, piece, _, last in held], pa.int64()), pa.array(np.bincount(whose[~other], minlength=n), pa.int64()), pa.array(np.bincount(whose, value, n), pa.float64()), pa.array(total, pa.float64()),
                _lists([distinct.take(pa.array(rare & 0xFFFFFFFF)).cast(pa.string()), pa.array(times, pa.int64())], ["word", "n"], np.bincount(rare >> 32, minlength=n)),
                _lists([pa.array(np.concatenate([c for c, _ in strings]), pa.int64()), pa.array(np.concatenate([m for _, m in strings]), pa.int64())], ["code", "n"], [len(c) for c, _ in strings]),
            ], [c.split()[0] for c in ROW.split(", ")])

    return run


def _lists(columns: list[pa.Array], names: list[str], sizes) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.StructArray.from_arrays(columns, names))


def mixed(scored: DataFrame) -> DataFrame:
    """score_texts()'s rows with the score of the trees as `tree_score` and, as `score`, that of an equal mixture of the trees and the unigram base: a text's
    probability is half that by the trees and half that by its words. The trees have to spell a word that training lacks and to code blanks, for
    which the base takes one event or none; so on little training the base is ahead of them, and the mixture is never more than log10(2) behind either.
    As in the base, all words that training lacks are one event, so `score` is no probability of their spelling; `tree_score` is."""
    most = F.greatest("score", "base_score")
    both = most + F.log10(F.pow(F.lit(10.0), F.col("score") - most) + F.pow(F.lit(10.0), F.col("base_score") - most)) - math.log10(2)
    return scored.withColumn("tree_score", F.col("score")).withColumn("score", both)


def _apart(strings: DataFrame, trees: list[DataFrame]) -> DataFrame:
    """(code, lp) of distinct byte strings (code), where there are too many nodes to send: what lies above two bytes of context is sent (at most
    65,535 nodes of 255 x 257), the rest meets the strings of equal last two bytes of context in one group."""
    spark = strings.sparkSession
    top = spark.sparkContext.broadcast([_sorted(t.toArrow()) for t in trees[:2]])
    deep, depth = None, len(trees) - 1
    for d, tree in enumerate(trees[2:], 2):
        one = tree.select(F.expr("shiftright(key, 8) & 65535").alias("pair"), F.lit(d).alias("d"), "key", "p", "stop")
        deep = one if deep is None else deep.unionByName(one)

    def run(asked: pd.DataFrame, nodes: pd.DataFrame) -> pd.DataFrame:
        codes = np.sort(asked["code"].to_numpy())
        own = [_sorted(nodes[nodes["d"] == d]) for d in range(2, depth + 1)]
        return pd.DataFrame({"code": codes, "lp": log10_bytes(codes, [*top.value, *own])})

    asked = strings.withColumn("pair", F.expr("shiftright(code, 8) & 65535"))
    if deep is None:
        deep = spark.createDataFrame([], "pair long, d int, key long, p float, stop float")
    return asked.groupBy("pair").cogroup(deep.groupBy("pair")).applyInPandas(run, "code long, lp double")


def score_texts(docs: DataFrame, training: DataFrame, id_col: str = "doc_id", text_col: str = "text", depth: int = DEPTH, lot: int = LOT, most_nodes: int = MOST_NODES, top_words: int = TOP_WORDS) -> DataFrame:
    """(id_col, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte) for every row of docs, learnt from training (text)."""
    spark = docs.sparkSession
    counts = corpus_counts(training.select(F.col(f"`{text_col}`").alias("text")), depth, lot)
    words, strings = counts.where("word is not null").select("word", "n"), counts.where("word is null").select("code", "n")
    sizes = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    trees, tables = context_trees(strings, depth)
    n_nodes = [t.count() for t in trees]
    sent = words.where(F.octet_length("word") <= LONG_WORD).orderBy(F.desc("n"), "word").limit(top_words)
    table = sent.toArrow()
    known = spark.sparkContext.broadcast({w.encode(): math.log10(n + 1) for w, n in zip(table["word"].to_pylist(), table["n"].to_pylist(), strict=True)})
    small = sum(n_nodes) <= most_nodes
    model = spark.sparkContext.broadcast(settled([_sorted(t.toArrow()) for t in trees])) if small else None
    if small:
        discard(*tables)
    texts = docs.select(F.col(f"`{id_col}`").cast("string").alias("id"), F.col(f"`{text_col}`").alias("text"))
    # Rows are numbered by task and place; the numbers hold since the table is written.
    pieces = materialize(texts.mapInArrow(_score(depth, max(1, lot // 2), known, model), ROW), "scored")
    whole = pieces.groupBy("row").agg(F.first("id").alias("id"), *[F.sum(c).alias(c) for c in ("n_tokens", "n_bytes", "n_known", "base", "score")])
    rare = pieces.select("row", F.explode("rare").alias("e")).select("row", "e.word", F.col("e.n").alias("m")).join(words, "word")
    rare = rare.groupBy("row").agg(F.sum("m").alias("more"), F.sum(F.col("m") * F.log10(F.col("n") + 1)).alias("more_base"))
    whole = whole.join(rare, "row", "left")
    if not small:
        held = pieces.select("row", F.explode("codes").alias("e")).select("row", "e.code", F.col("e.n").alias("m"))
        far = held.join(_apart(held.select("code").distinct(), trees), "code").groupBy("row").agg(F.sum(F.col("m") * F.col("lp")).alias("far"))
        whole = whole.join(far, "row", "left").withColumn("score", F.col("score") + F.coalesce("far", F.lit(0.0)))
    each = math.log10(sizes["n"] + sizes["v"] + 1)
    return whole.select(
        F.col("id").cast(docs.schema[id_col].dataType).alias(id_col), "n_tokens", (F.col("n_known") + F.coalesce("more", F.lit(0))).alias("n_known"), F.lit(sizes["n"]).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more_base", F.lit(0.0)) - F.col("n_tokens") * each).alias("base_score"), "score", (-F.col("score") * math.log2(10) / F.col("n_bytes")).alias("bits_per_byte"),
    )
