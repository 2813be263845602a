"""Toxicity: a linear-chain conditional random field tags toxic spans; forward-backward marginals give document scores and offending offsets.

Fitting reads a bounded sample of labelled rows (``sample_rows``, ``max_fit_chars``; the chain ``chain_rows`` and ``chain_chars``) and never a
held-out one. Word forms, their beginnings and endings that stand in toxic documents nearly alone become features, at most ``most_features``, the
most telling first. Labels stand at documents, so the tokens that train the chain are labelled by this rule: a word that carries a feature and
stands in a toxic document is toxic, all others are not. The chain weighs a word's own features, those of the words before and behind it, and
the tags' neighbourhood, so that it tells a listed word in clean surroundings from one among others. Scoring reads every word of every text;
a document's score is a logistic function of its largest marginal, the sum of its marginals of LEAST_MARGINAL or more, and its words, fitted
on the same sample.

Null and empty texts have no words and score 0; very long texts are scored whole (for fitting, those over ``max_fit_chars`` are left out). Repeated
rows each get the same result; for fitting, equal texts count once, with the label of the least id, and a label that stands twice counts as toxic
if either says so. Equal likelihood ratios are ordered by feature. Columns other than the id and the text are never read, so labels, lang,
source and clashing names can't enter a score. Without labelled rows or documents nothing is learnt and all scores are 0. Spans are offsets in
the text as given: characters whose small form is longer are kept as they are.
"""

from __future__ import annotations

import itertools
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import payload

#: Bounds of the fitting sample: labelled rows, characters of one of them, rows and characters of those that train the chain (half of each label), features.
SAMPLE_ROWS, MAX_FIT_CHARS = 20_000, 60_000
CHAIN_ROWS, CHAIN_CHARS = 1_000, 6_000_000
MOST_FEATURES = 50_000
THRESHOLD = 0.3
HELD_OUT = "crc32(cast(cast({0} as string) as binary)) % 4 = 2"
SCHEMA = "doc_id long, score double, predicted int, n_toxic_words long, toxic_spans array<struct<start:int,end:int,p:double>>, top double, mass double, n_words long"
_NAMES = ["doc_id", "score", "predicted", "n_toxic_words", "toxic_spans", "top", "mass", "n_words"]
_WORD = re.compile(r"[^\W\d_]+")
#: Smallest natural-log likelihood ratio (two-sided G statistic) and toxic share of a feature.
LEAST_G, LEAST_SHARE = 14.0, 0.8
LEAST_MARGINAL = 0.05


def features(word: str) -> list[str]:
    """The word, its beginnings and its endings of three to six letters."""
    n = len(word)
    return [f"w:{word}", *(f"p:{word[:k]}" for k in range(3, min(7, n))), *(f"s:{word[-k:]}" for k in range(4, min(7, n)))]


def lower(text: str) -> str:
    """text in small letters, character for character, so that offsets hold; a character whose small form is longer stays."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(x if len(x := c.lower()) == 1 else c for c in text)


class Chain:
    """A two-tag chain: weights of features for the tag toxic (three rows: of the word itself, of the one before, of the one behind), a bias, and
    a score for each pair of neighbouring tags."""

    def __init__(self, index: dict[str, int], weights: np.ndarray, bias: float, moves: np.ndarray, calibration: np.ndarray | None = None) -> None:
        table = np.zeros((3, len(index)))
        table[: np.ndim(weights) and len(np.atleast_2d(weights))] = weights
        self.index, self.weights, self.bias, self.moves, self.calibration = index, table, bias, moves, calibration
        self._seen: dict[str, int] = {}
        self._rows = [(0.0, 0.0, 0.0)]

    def _row(self, word: str) -> int:
        known = [self.index[f] for f in features(word) if f in self.index]
        if not known:
            return 0
        self._rows.append(tuple(self.weights[:, known].sum(1)))
        return len(self._rows) - 1

    def emissions(self, words: list[str], first: np.ndarray) -> np.ndarray:
        """The score of the tag toxic of every word of many texts laid end to end; first marks each text's first word."""
        seen = self._seen
        found = list(map(seen.get, words))
        if None in found:
            if len(seen) > 2_000_000:
                seen.clear()
                self._rows = self._rows[:1]
                found = [None] * len(words)
            for k, x in enumerate(found):
                if x is None:
                    word = words[k]
                    if (row := seen.get(word)) is None:
                        row = seen[word] = self._row(word)
                    found[k] = row
        own, before, behind = np.array(self._rows)[np.array(found, np.int64)].T
        e = self.bias + own
        e[1:] += np.where(first[1:], 0.0, before[:-1])
        e[:-1] += np.where(first[1:], 0.0, behind[1:])
        return e


def _passes(e: np.ndarray, first: np.ndarray, moves: np.ndarray, block: int) -> tuple[np.ndarray, ...]:
    """The toxic weight of each token, alpha of both tags with it, beta of both tags without it; up to a factor for each token.

    The chains run as one: a text's first token forgets what came before. Tokens are laid out in rows of ``block``; the rows' 2x2 products are
    made for all rows at once and carried from row to row, then all rows run from their known entry. Exact, with O(block) numpy steps a pass.
    """
    n = len(e)
    weight = np.exp(np.clip(e, -60, 60))
    step = np.exp(moves - moves.max())
    rows = -(-n // block)
    pad = rows * block - n

    def run(w: np.ndarray, cut: np.ndarray, t: list[list[float]], own: bool) -> tuple[np.ndarray, np.ndarray]:
        """The two tags' masses at each token from all tokens up to it in running order, without its own weight unless own."""
        w = np.ascontiguousarray(np.concatenate([w, np.ones(pad)]).reshape(rows, block).T)
        cut = np.ascontiguousarray(np.concatenate([cut, np.zeros(pad, bool)]).reshape(rows, block).T)
        cuts = cut.any(1)
        (t00, t01), (t10, t11) = t

        def advance(k: int, m0: np.ndarray, m1: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            n0, n1 = m0 * t00 + m1 * t10, m0 * t01 + m1 * t11
            if cuts[k]:
                c = cut[k]
                n0[c] = n1[c] = (m0 + m1)[c]
            return n0, n1

        a0, a1, b0, b1 = np.ones(rows), np.zeros(rows), np.zeros(rows), np.ones(rows)
        for k in range(block):
            a0, a1 = advance(k, a0, a1)
            b0, b1 = advance(k, b0, b1)
            a1 *= w[k]
            b1 *= w[k]
            if k % 4 == 3:
                most = np.maximum(np.maximum(a0, a1), np.maximum(b0, b1))
                a0, a1, b0, b1 = a0 / most, a1 / most, b0 / most, b1 / most
        entry, x, y = [], 0.5, 0.5
        for p0, p1, q0, q1 in zip(a0.tolist(), a1.tolist(), b0.tolist(), b1.tolist(), strict=True):
            entry.append((x, y))
            x, y = x * p0 + y * q0, x * p1 + y * q1
            x, y = x / (x + y), y / (x + y)
        m0, m1 = (np.array(v) for v in zip(*entry, strict=True))
        out0, out1 = np.empty((block, rows)), np.empty((block, rows))
        for k in range(block):
            m0, m1 = advance(k, m0, m1)
            if not own:
                out0[k], out1[k] = m0, m1
            m1 = m1 * w[k]
            total = m0 + m1
            m0, m1 = m0 / total, m1 / total
            if own:
                out0[k], out1[k] = m0, m1
        return out0.T.reshape(-1)[:n], out1.T.reshape(-1)[:n]

    alpha0, alpha1 = run(weight, first, step.tolist(), True)
    last = np.roll(first, -1)
    last[-1] = True
    beta0, beta1 = (x[::-1] for x in run(weight[::-1], last[::-1], step.T.tolist(), False))
    return weight, alpha0, alpha1, beta0, beta1


def forward_backward(e: np.ndarray, first: np.ndarray, moves: np.ndarray, block: int = 64) -> np.ndarray:
    """P(tag = toxic) of every token of many texts laid end to end; first marks each text's first token."""
    if not len(e):
        return np.zeros(0)
    _, alpha0, alpha1, beta0, beta1 = _passes(e, first, moves, block)
    toxic = alpha1 * beta1
    return toxic / (toxic + alpha0 * beta0)


def marginals(e: np.ndarray, first: np.ndarray, moves: np.ndarray, block: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """(P(tag = toxic) of every token, expected numbers of the neighbouring tag pairs 00, 01, 10, 11 within texts)."""
    if not len(e):
        return np.zeros(0), np.zeros(4)
    weight, alpha0, alpha1, beta0, beta1 = _passes(e, first, moves, block)
    toxic = alpha1 * beta1
    step, inner = np.exp(moves - moves.max()), ~first[1:]
    pairs = np.stack([a[:-1] * step[i, j] * b for i, a in enumerate((alpha0, alpha1)) for j, b in enumerate((beta0[1:], weight[1:] * beta1[1:]))])
    pairs = pairs[:, inner]
    return toxic / (toxic + alpha0 * beta0), (pairs / pairs.sum(0)).sum(1)


def train_chain(index: dict[str, int], token_features: list[list[int]], tags: np.ndarray, first: np.ndarray, rounds: int = 80) -> Chain:
    """Maximum conditional likelihood with a small Gaussian prior, by Adam: expected less labelled counts of features, tags and pairs of tags."""
    n, size = max(1, len(tags)), len(index)
    rows = np.array([k for k, fs in enumerate(token_features) for _ in fs], np.int64)
    cols = np.array([f for fs in token_features for f in fs], np.int64)
    fits_behind, fits_before = (rows + 1 < n) & ~np.append(first, True)[rows + 1], ~first[rows]
    rows, cols = np.concatenate([rows, rows[fits_behind] + 1, rows[fits_before] - 1]), np.concatenate([cols, cols[fits_behind] + size, cols[fits_before] + 2 * size])
    theta = np.concatenate([np.zeros(3 * size), [-4.0], np.zeros(4)])
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    true_pairs = np.bincount((tags[:-1] * 2 + tags[1:])[~first[1:]], minlength=4).astype(float)
    for t in range(1, rounds + 1):
        e = theta[3 * size] + np.bincount(rows, theta[cols], n)
        p, pairs = marginals(e, first, theta[3 * size + 1 :].reshape(2, 2))
        gap = p - tags
        grad = np.concatenate([np.bincount(cols, gap[rows], 3 * size), [gap.sum()], pairs - true_pairs]) + 0.05 * theta
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        theta -= 0.25 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return Chain(index, theta[: 3 * size].reshape(3, size), float(theta[3 * size]), theta[3 * size + 1 :].reshape(2, 2))


def _feature_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of each label that hold a feature, summed within the task."""
    toxic, clean = Counter(), Counter()
    for batch in batches:
        for text, label in zip(batch.column(0), batch.column(1), strict=True):
            found = {f for w in set(_WORD.findall(lower(text.as_py().decode("utf-8", "replace")))) for f in features(w)}
            (toxic if label.as_py() else clean).update(found)
    names = list(toxic)
    for k in range(0, len(names), 50_000):
        part = names[k : k + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array(part), pa.array([toxic[x] for x in part], pa.int64()), pa.array([0] * len(part), pa.int64())], names=["feature", "toxic", "clean"])
    names = list(clean)
    for k in range(0, len(names), 50_000):
        part = names[k : k + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array(part), pa.array([0] * len(part), pa.int64()), pa.array([clean[x] for x in part], pa.int64())], names=["feature", "toxic", "clean"])


def fit(
    docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, chain_rows: int = CHAIN_ROWS, max_fit_chars: int = MAX_FIT_CHARS, chain_chars: int = CHAIN_CHARS, most_features: int = MOST_FEATURES,
) -> Chain:
    """Learns from the sample_rows labelled, not held-out documents of smallest hash; duplicates of a text count once. What reaches the driver is
    bounded by the parameters: feature counts and scores of the sample, and the texts of the chain."""
    ids = (
        labels.where("doc_id is not null and toxic is not null").where(f"not ({HELD_OUT.format('doc_id')})")
        .groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    )
    sample = (
        docs.select("doc_id", F.col("text")).where("text is not null").join(F.broadcast(ids), "doc_id")
        .where(F.length("text") <= max_fit_chars).groupBy(F.sha2("text", 256).alias("h")).agg(F.min_by(F.struct("text", "toxic"), F.struct("doc_id", "toxic")).alias("x"))
        .select(payload("x.text").alias("text"), F.col("x.toxic").alias("toxic"), "h").persist()
    )
    try:
        n = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
        pos, neg = n.get(1, 0), sum(c for k, c in n.items() if k != 1)
        if not pos:
            return Chain({}, np.zeros(0), -12.0, np.zeros((2, 2)))
        counted = sample.select("text", "toxic").mapInArrow(_feature_counts, "feature string, toxic long, clean long").groupBy("feature").agg(F.sum("toxic").alias("t"), F.sum("clean").alias("c"))
        share = F.lit(pos / (pos + neg))
        fit_share = F.col("t") / (F.col("t") + F.col("c"))
        g = 2 * (F.col("t") * F.log(fit_share / share) + F.when(F.col("c") > 0, F.col("c") * F.log((1 - fit_share) / (1 - share))).otherwise(0.0))
        lexicon = counted.where((F.col("t") >= 3) & (fit_share >= LEAST_SHARE)).where(g >= LEAST_G).orderBy(F.desc(g), "feature").limit(most_features).collect()
        # A beginning or ending that is rarer than a word or longer beginning it shares all documents with adds nothing; weights settle the rest.
        index = {r["feature"]: k for k, r in enumerate(lexicon)}
        rows = [r for part in (sample.where("toxic = 1"), sample.where("toxic <> 1")) for r in _first_texts(part, chain_rows // 2, chain_chars // 2)]
        chain = _train(index, rows)
        marginals = sample.select(F.col("toxic").alias("doc_id"), "text").mapInArrow(_scorer(chain), SCHEMA)
        seen = marginals.select(F.col("doc_id").alias("toxic"), "top", "mass", "n_words").collect()
        chain.calibration = _calibrate(np.array([[r["top"], r["mass"], r["n_words"]] for r in seen], float), np.array([r["toxic"] == 1 for r in seen], float))
        return chain
    finally:
        sample.unpersist()


def _first_texts(part: DataFrame, most: int, most_chars: int) -> list:
    """The texts of smallest hash, at most `most` with at most most_chars bytes: hashes and lengths come first, so that only these texts are sent."""
    first = part.select("h", F.length("text").alias("size")).orderBy("h").limit(most).collect()
    fits = list(itertools.takewhile(lambda x: x[1] <= most_chars, zip((r["h"] for r in first), itertools.accumulate(r["size"] for r in first), strict=True)))
    return part.where(F.col("h") <= fits[-1][0]).select("text", "toxic", "h").collect() if fits else []


def _inputs(top: np.ndarray, mass: np.ndarray, n_words: np.ndarray) -> np.ndarray:
    p = np.clip(top, 1e-4, 1 - 1e-6)
    return np.stack([np.ones(len(p)), np.log(p / (1 - p)), np.log1p(mass), np.log1p(n_words)], 1)


def _calibrate(found: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Logistic regression with a small ridge, by Newton steps."""
    x = _inputs(*found.T)
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(len(w))
        w -= np.clip(np.linalg.solve(h, x.T @ (p - toxic) + 0.1 * w), -5, 5)
    return w


def _train(index: dict[str, int], rows: list) -> Chain:
    """The chain from labelled tokens: in toxic documents the words that carry a feature are toxic, elsewhere none; texts in order of their hash."""
    token_features: list[list[int]] = []
    tags: list[int] = []
    first: list[bool] = []
    seen: dict[str, list[int]] = {}
    for r in sorted(rows, key=lambda r: r["h"]):
        words = _WORD.findall(lower(bytes(r["text"]).decode("utf-8", "replace")))
        for k, w in enumerate(words):
            if (known := seen.get(w)) is None:
                known = seen[w] = [index[f] for f in features(w) if f in index]
            token_features.append(known)
            tags.append(int(r["toxic"] == 1 and bool(known)))
            first.append(k == 0)
    if not tags:
        return Chain({}, np.zeros(0), -12.0, np.zeros((2, 2)))
    return train_chain(index, token_features, np.array(tags), np.array(first))


def score_texts(chain: Chain, texts: list[bytes]) -> list[list]:
    """(score, words tagged at THRESHOLD, spans of neighbouring tagged words as character offsets, top, mass, words) of each text."""
    lows = [lower(x.decode("utf-8", "replace")) for x in texts]
    words = [_WORD.findall(x) for x in lows]
    counts = np.array([len(w) for w in words], np.int64)
    ends = np.cumsum(counts)
    first = np.zeros(int(counts.sum()), bool)
    first[(ends - counts)[counts > 0]] = True
    p = forward_backward(chain.emissions([w for ws in words for w in ws], first), first, chain.moves)
    out = []
    for text, end, n in zip(lows, ends, counts, strict=True):
        own = p[end - n : end]
        hit = np.flatnonzero(own >= THRESHOLD)
        spans: list[tuple] = []
        if len(hit):
            at = [m.span() for m in _WORD.finditer(text)]
            for k in hit:
                if spans and spans[-1][3] == k - 1:
                    spans[-1] = (spans[-1][0], at[k][1], max(spans[-1][2], float(own[k])), k)
                else:
                    spans.append((at[k][0], at[k][1], float(own[k]), k))
        top, mass = float(own.max(initial=0.0)), float(own[own >= LEAST_MARGINAL].sum())
        out.append([top, len(hit), [{"start": a, "end": b, "p": q} for a, b, q, _ in spans], top, mass, int(n)])
    if chain.calibration is not None and out:
        known = _inputs(*(np.array([r[k] for r in out], float) for k in (3, 4, 5))) @ chain.calibration
        for r, x in zip(out, known.tolist(), strict=True):
            r[0] = 1 / (1 + math.exp(-min(max(x, -30), 30))) if r[5] else 0.0
    return out


def _scorer(chain: Chain):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Chain(chain.index, chain.weights, chain.bias, chain.moves, chain.calibration)
        span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64())]))
        kinds = [pa.float64(), pa.int32(), pa.int64(), span, pa.float64(), pa.float64(), pa.int64()]
        for whole in batches:
            for batch in (whole.slice(k, 500) for k in range(0, whole.num_rows, 500)):
                rows = [(r[0], int(r[0] >= THRESHOLD), *r[1:]) for r in score_texts(own, [x.as_py() for x in batch.column(1)])]
                columns = list(zip(*rows, strict=True)) if rows else [()] * len(kinds)
                yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=_NAMES)

    return score


def toxicity(docs: DataFrame, chain: Chain, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs (SCHEMA): no shuffle, one pass over the texts. The chain, at most most_features of fit(), travels with the tasks."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), payload(text_col).alias("text")).mapInArrow(_scorer(chain), SCHEMA)


def keep_clean(docs: DataFrame, chain: Chain, text_col: str = "text") -> DataFrame:
    """The rows of docs, as they are, whose text is not predicted toxic: one pass, no shuffle; rows keep their place beside their score."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Chain(chain.index, chain.weights, chain.bias, chain.moves, chain.calibration)
        for whole in batches:
            for batch in (whole.slice(k, 500) for k in range(0, whole.num_rows, 500)):
                scores = score_texts(own, [x.as_py() for x in batch.column(batch.num_columns - 1)])
                stay = batch.filter(pa.array([r[0] < THRESHOLD for r in scores], pa.bool_()))
                yield stay.select(list(range(batch.num_columns - 1)))

    rows = docs.select(*[F.col(f"`{c}`") for c in docs.columns], payload(text_col).alias("_bytes"))
    return rows.mapInArrow(keep, docs.schema)
