"""Phrase collocation mining: count-min sketches of all n-grams, built in the map tasks, are merged cell by cell; a second pass counts exactly those
n-grams whose cells reach the least frequency, so nothing frequent is lost; phrases are then scored by their least likely cut and subsumed by longer ones.

The sketch is a table, not a value: a task sends each row's touched cells as sorted gaps in blocks, a reducer adds the blocks up in one dense array. Cells
are as many as the text's bytes over two (counted before), so that the noise of a cell stays small at every size. Cells that reach the least frequency are
folded into a bitmap whose size follows their number, at most MOST_BITS bits a row; a fuller bitmap lets more n-grams through to the exact count, it
loses none. Counts in a cell saturate at the least frequency, which is all that is asked of them.

Defined results: a null text is empty, a null language is `und`; a repeated row counts again; ids are not used. Languages are told apart everywhere. Very
long texts are read in slices. An empty table gives an empty result. Further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

LEAST, MOST_WORDS, SHARE, TOP = 10, 3, 50, 2000
#: Rows of the sketch; tokens of a task that are counted together (packed word numbers have 21 bits); bytes of a text that are split at once.
DEPTH, FLUSH_TOKENS, SLICE = 2, 1_200_000, 1 << 20
#: Shares that a language's phrases are dealt to before their first rows are put in order.
SHARES = 32
#: Bits of a folded row at most (16 MB).
MOST_BITS = 1 << 27
ENDS = b".,;:!?\n\x0b\x0c\r"
_MARKED = bytes.maketrans(ENDS, b"." * len(ENDS))
_WORD_BITS, _MOD = 21, (1 << 64) - 1
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


class Vocabulary(dict):
    """Words to numbers from 1, in the order in which they come; 0 is the end of a piece."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


class Tokens:
    """Numbers of the words of many texts, by language. lots() hands out a full lot as (words, {language: (numbers, told)}): the first `told` numbers are
    words of a text that goes on from the lot before; phrases that end among them were counted there."""

    def __init__(self, most_words: int = MOST_WORDS, flush: int = FLUSH_TOKENS, slice_bytes: int = SLICE) -> None:
        self.most_words, self.flush, self.slice_bytes = most_words, flush, slice_bytes
        self._clear()

    def _clear(self) -> None:
        self.words, self.by_lang, self.told, self.n = Vocabulary({b".": 0}), {}, {}, 0

    def _slices(self, text: str) -> Iterator[bytes]:
        raw = text.encode("utf-8", "replace").lower().translate(_MARKED)
        at = 0
        while at < len(raw):
            stop = at + self.slice_bytes
            if stop < len(raw):  # cut behind the last blank or end mark, or else at the next one
                found = max(raw.rfind(c, at, stop) for c in (b" ", b"\t", b"."))
                if found < at:
                    found = min((k for k in (raw.find(c, stop) for c in (b" ", b"\t", b".")) if k >= 0), default=len(raw) - 1)
                stop = found + 1
            yield raw[at:stop].replace(b".", b" . ")
            at = stop

    def _keep(self, lang: str, words: list[bytes]) -> None:
        numbers = np.fromiter(map(self.words.__getitem__, words), np.int64)
        self.by_lang.setdefault(lang, []).append(numbers)
        self.n += len(numbers)

    def lots(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[bytes], dict[str, tuple[np.ndarray, int]]]]:
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py()
                for piece in self._slices(text) if text else ():
                    self._keep(lang, piece.split())
                    if self.n >= self.flush:
                        words, lot = self._lot()
                        yield words, lot
                        last = lot[lang][0]
                        last = last[max(len(last) - self.most_words + 1, 0) :].tolist() if self.most_words > 1 else []
                        open_piece = last[max((k + 1 for k, x in enumerate(last) if x == 0), default=0) :]
                        self._keep(lang, [words[x] for x in open_piece])
                        self.told[lang] = len(open_piece)
                if text:
                    self.by_lang.setdefault(lang, []).append(np.zeros(1, np.int64))
        if self.n:
            yield self._lot()

    def _lot(self):
        out = list(self.words), {k: (np.concatenate(v), self.told.get(k, 0)) for k, v in self.by_lang.items()}
        self._clear()
        return out


def _spans(lot: tuple[np.ndarray, int], size: int) -> np.ndarray:
    """Where phrases of that size begin, without those that were counted before."""
    numbers, told = lot
    if len(numbers) < size:
        return np.zeros(0, np.int64)
    inside = numbers != 0
    ok = inside[: len(numbers) - size + 1].copy()
    for k in range(1, size):
        ok &= inside[k : len(numbers) - size + 1 + k]
    ok[: max(told - size + 1, 0)] = False
    return np.flatnonzero(ok)


def _hashes(lang: str, numbers: np.ndarray, starts: np.ndarray, size: int, table: np.ndarray) -> np.ndarray:
    h = np.full(len(starts), xxhash.xxh64_intdigest(lang.encode()) ^ size, np.uint64)
    for k in range(size):
        h = (h * _MULTIPLIER) ^ table[numbers[starts + k]]
        h ^= h >> np.uint64(29)
    return h


def _cells(h: np.ndarray, row: int, bits: int) -> np.ndarray:
    """The cell of each hash in a row: the top bits of a mixed number."""
    z = h + np.uint64((row + 1) * 0xD1B54A32D192ED03 & _MOD)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z >> np.uint64(64 - bits)


def _word_table(words: list[bytes]) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(w) for w in words), np.uint64, len(words))


def _block_bits(bits: int) -> int:
    return max(20, min(24, bits - 12))


def _sketch(most_words: int, least: int, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1)
        shift = np.uint64(_block_bits(bits))
        for words, by_lang in Tokens(most_words).lots(batches):
            table = _word_table(words)
            every = np.concatenate([_hashes(lang, x[0], _spans(x, size), size, table) for lang, x in by_lang.items() for size in range(1, most_words + 1)])
            for row in range(DEPTH):
                cells, n = np.unique(_cells(every, row, bits), return_counts=True)
                n = np.minimum(n, least).astype(np.uint8 if least < 256 else np.uint32)
                block = (cells >> shift).astype(np.int64)
                cuts = np.flatnonzero(np.diff(block, prepend=-1))
                blocks, gaps, counts = block[cuts], [], []
                low = (cells & np.uint64((1 << int(shift)) - 1)).astype("<u4")
                for a, b in zip(cuts, [*cuts[1:], len(cells)], strict=True):
                    gap = np.diff(low[a:b], prepend=np.uint32(0))
                    gaps.append(pack.compress(gap.view(np.uint8).reshape(-1, 4).T.tobytes()))
                    counts.append(pack.compress(n[a:b].tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(blocks), row), pa.int32()), pa.array(blocks), pa.array(gaps, pa.binary()), pa.array(counts, pa.binary())], ["row", "block", "gaps", "counts"])

    return run


def _merge(least: int, bits: int):
    """Adds up one block of one row and gives the cells that reach the least frequency, as bits."""

    def run(blobs: pd.DataFrame) -> pd.DataFrame:
        unpack = zstandard.ZstdDecompressor()
        total = np.zeros(1 << _block_bits(bits), np.uint8 if least < 128 else np.uint32)
        for gaps, counts in zip(blobs["gaps"], blobs["counts"], strict=True):
            cells = np.cumsum(np.frombuffer(unpack.decompress(gaps), np.uint8).reshape(4, -1).T.copy().view("<u4").ravel())
            total[cells] = np.minimum(total[cells] + np.frombuffer(unpack.decompress(counts), np.uint8 if least < 256 else np.uint32), least)
        found = np.flatnonzero(total >= least)
        return pd.DataFrame({"row": blobs["row"].iloc[:1], "block": blobs["block"].iloc[:1], "n": [len(found)], "cells": [found.astype("<u4").tobytes()]})

    return run


def _fold(block_bits: int):
    """The bits of all blocks that meet in one chunk of the folded row."""

    def run(blobs: pd.DataFrame) -> pd.DataFrame:
        held = np.zeros(1 << block_bits, bool)
        for cells in blobs["cells"]:
            held[np.frombuffer(cells, "<u4")] = True
        return pd.DataFrame({"row": blobs["row"].iloc[:1], "chunk": blobs["chunk"].iloc[:1], "held": [np.packbits(held).tobytes()]})

    return run


def frequent_cells(texts: DataFrame, least: int = LEAST, most_words: int = MOST_WORDS) -> tuple[np.ndarray, int, int]:
    """(bitmaps (DEPTH, bytes), bits of a cell's number, bits of a folded number) of texts (lang, text): the cells of the merged sketch that reach `least`."""
    n_bytes = texts.agg(F.sum(F.octet_length("text").cast("decimal(38,0)"))).first()[0] or 0
    bits = max(20, min(50, (int(n_bytes) // 2).bit_length()))
    block_bits = _block_bits(bits)
    sketch = texts.mapInArrow(_sketch(most_words, least, bits), "row int, block long, gaps binary, counts binary")
    cells = materialize(sketch.groupBy("row", "block").applyInPandas(_merge(least, bits), "row int, block long, n long, cells binary").where("n > 0"), "cells")
    heavy = (cells.groupBy("row").agg(F.sum("n").alias("n")).agg(F.max("n")).first()[0] or 0) * 16
    folded = max(block_bits, min(bits, heavy.bit_length(), MOST_BITS.bit_length() - 1))
    chunks = cells.withColumn("chunk", F.expr(f"block & {(1 << (folded - block_bits)) - 1}L"))
    maps = np.zeros((DEPTH, 1 << (folded - 3)), np.uint8)
    size = 1 << (block_bits - 3)
    for r in chunks.groupBy("row", "chunk").applyInPandas(_fold(block_bits), "row int, chunk long, held binary").collect():
        maps[r["row"], r["chunk"] * size : (r["chunk"] + 1) * size] = np.frombuffer(r["held"], np.uint8)
    return maps, bits, folded


def _exact(most_words: int, maps, bits: int, folded: int):
    """Counts the n-grams that pass all bitmaps, by the numbers of their words; size 0 counts a language's words."""
    mask = np.uint64((1 << folded) - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = maps.value
        for words, by_lang in Tokens(most_words).lots(batches):
            table = _word_table(words)
            for lang, lot in by_lang.items():
                numbers, told = lot
                yield _rows(lang, 0, [""], [int(np.count_nonzero(numbers)) - told])
                for size in range(1, most_words + 1):
                    starts = _spans(lot, size)
                    h = _hashes(lang, numbers, starts, size, table)
                    for row in range(DEPTH):
                        at = _cells(h, row, bits) & mask
                        keep = (held[row][(at >> np.uint64(3)).astype(np.int64)] >> (7 - (at & np.uint64(7)).astype(np.uint8))) & 1 == 1
                        starts, h = starts[keep], h[keep]
                    grams, n = np.unique(np.stack([numbers[starts + k] for k in range(size)], axis=1), axis=0, return_counts=True) if size > 3 else _packed(numbers, starts, size)
                    for a in range(0, len(grams), 100_000):
                        yield _rows(lang, size, [b" ".join([words[i] for i in g]).decode("utf-8", "replace") for g in grams[a : a + 100_000].tolist()], n[a : a + 100_000])

    return run


def _packed(numbers: np.ndarray, starts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct phrases of at most three words and their counts; word numbers are packed into one integer, which sorts faster than rows."""
    code = np.zeros(len(starts), np.int64)
    for k in range(size):
        code = (code << _WORD_BITS) | numbers[starts + k]
    code, n = np.unique(code, return_counts=True)
    return np.stack([(code >> (_WORD_BITS * (size - 1 - k))) & ((1 << _WORD_BITS) - 1) for k in range(size)], axis=1), n


def _rows(lang: str, size: int, phrases: list[str], n) -> pa.RecordBatch:
    m = len(phrases)
    return pa.RecordBatch.from_arrays([pa.array([lang] * m, pa.string()), pa.array([size] * m, pa.int32()), pa.array(phrases, pa.string()), pa.array(n, pa.int64())], ["lang", "size", "phrase", "n"])


def frequent_phrases(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, most_words: int = MOST_WORDS) -> DataFrame:
    """(lang, size, phrase, f): every phrase of up to most_words words that occurs `least` times or more in its language, with its exact count; size 0 has
    the language's number of words. Written as a table."""
    texts = docs.select(F.coalesce(F.col(f"`{lang_col}`"), F.lit("und")).alias("lang"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    maps, bits, folded = frequent_cells(texts, least, most_words)
    shared = docs.sparkSession.sparkContext.broadcast(maps)
    counts = texts.mapInArrow(_exact(most_words, shared, bits, folded), "lang string, size int, phrase string, n long").groupBy("lang", "size", "phrase").agg(F.sum("n").alias("f"))
    return materialize(counts.where((F.col("size") == 0) | (F.col("f") >= least)), "phrases")


def collocations(counts: DataFrame, share: int = SHARE, top: int = TOP) -> DataFrame:
    """The first `top` phrases of each language of a table of frequent_phrases(): (lang, rank, phrase, a, l, r, n, score)."""
    wide = F.col("f").cast("decimal(18,0)")
    phrases = counts.where("size >= 2").withColumn("words", F.split("phrase", " "))
    part = lambda begin, length: F.array_join(F.slice("words", begin, length), " ")
    cut = phrases.select("lang", "phrase", "size", F.col("f").alias("a"), "words", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cut = cut.select("lang", "phrase", "size", "a", "k", part(F.lit(1), F.col("k")).alias("first"), part(F.col("k") + 1, F.col("size") - F.col("k")).alias("rest"))
    known = counts.where("size >= 1")
    cut = cut.join(known.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l")), ["lang", "first"]).join(known.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")), ["lang", "rest"])
    big = lambda c: F.col(c).cast("decimal(18,0)")
    score = F.call_function("div", (big("a") * big("a")).cast("decimal(31,0)") * F.lit(1_000_000).cast("decimal(7,0)"), big("l") * big("r"))
    best = cut.withColumn("score", score).groupBy("lang", "phrase", "size", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("b"))
    # What stands inside a longer phrase that is frequent enough goes: the largest count of a longer phrase is found for each part of it.
    sizes = F.sequence(F.lit(2), F.col("size") - 1)
    inner = phrases.where("size >= 3").select("lang", F.col("f").alias("longer"), "words", "size", F.explode(sizes).alias("m"))
    inner = inner.select("lang", "longer", "words", "m", F.explode(F.sequence(F.lit(1), F.col("size") - F.col("m") + 1)).alias("i")).groupBy("lang", part(F.col("i"), F.col("m")).alias("phrase")).agg(F.max("longer").alias("longer"))
    kept = best.join(inner, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (F.col("longer") * 100 < F.col("a") * share))
    order = [F.desc("b.score"), F.desc("a"), F.col("phrase")]
    # Each share of a language is cut to its first rows before they meet, so that the task of a large language gets SHARES x top rows at most.
    share_of = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(SHARES))).orderBy(*order)
    first = kept.withColumn("rank", F.row_number().over(share_of)).where(F.col("rank") <= top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    totals = counts.where("size = 0").select("lang", F.col("f").alias("n"))
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "b.l", "b.r", "n", "b.score")


ORACLE_SQL = r"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(p, '[^ \t]+') AS w FROM (
  SELECT lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x{0A}-\x{0D}]')) AS p FROM documents)),
totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM pieces GROUP BY lang),
grams AS (SELECT lang, s AS size, array_to_string(w[i : i + s - 1], ' ') AS phrase, count(*) AS f FROM pieces, (SELECT unnest([1, 2, 3]) AS s), LATERAL (SELECT unnest(range(1, len(w) - s + 2)) AS i) GROUP BY ALL HAVING count(*) >= 10),
cut AS (SELECT g.lang, g.phrase, g.size, g.f AS a, k, l.f AS l, r.f AS r, (1000000::HUGEINT * g.f * g.f // (l.f::HUGEINT * r.f))::BIGINT AS score
  FROM (SELECT *, string_split(phrase, ' ') AS w FROM grams WHERE size >= 2) g, LATERAL (SELECT unnest(range(1, size)) AS k)
  JOIN grams l ON l.lang = g.lang AND l.phrase = array_to_string(g.w[1:k], ' ') JOIN grams r ON r.lang = g.lang AND r.phrase = array_to_string(g.w[k + 1:], ' ')),
best AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inside AS (SELECT lang, array_to_string(w[i : i + 1], ' ') AS phrase, max(f) AS longer FROM (SELECT lang, f, string_split(phrase, ' ') AS w FROM grams WHERE size = 3), (SELECT unnest([1, 2]) AS i) GROUP BY ALL),
kept AS (SELECT b.* FROM best b LEFT JOIN inside i ON i.lang = b.lang AND i.phrase = b.phrase WHERE longer IS NULL OR longer * 100 < a * 50)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM kept JOIN totals USING (lang) QUALIFY rank <= 2000"""
