"""A pair scorer without a model: late interaction of token vectors.

A token's vector has a one for each of its character trigrams (with its ends marked); each token of the question takes its best cosine among the text's
tokens, and the score is their mean. Texts are cut into slices of tokens, so that a long one is no large matrix.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions.text import STOPWORDS

SLICE = 4096
_WORD = re.compile("[a-z0-9]{2,}")


def _tokens(text: str) -> list[str]:
    return sorted(set(_WORD.findall(text.lower())) - set(STOPWORDS))


def _trigrams(token: str) -> set[str]:
    marked = f"^{token}$"
    return {marked[i : i + 3] for i in range(len(marked) - 2)}


def interaction(asked: list[str], words: list[str]) -> float | None:
    """The mean over asked tokens of the best cosine among words; None if there are none on either side."""
    if not asked or not words:
        return None
    grams = [_trigrams(t) for t in asked]
    place = {g: k for k, g in enumerate(sorted(set().union(*grams)))}
    mine = np.zeros((len(asked), len(place)))
    for r, own in enumerate(grams):
        mine[r, [place[g] for g in own]] = 1
    sizes, best = np.array([len(g) for g in grams]), np.zeros(len(asked))
    for at in range(0, len(words), SLICE):
        rows = [_trigrams(w) for w in words[at : at + SLICE]]
        met = [(r, place[g]) for r, own in enumerate(rows) for g in own if g in place]
        if met:
            theirs = np.zeros((len(rows), len(place)))
            theirs[tuple(zip(*met, strict=True))] = 1
            best = np.maximum(best, ((mine @ theirs.T) / np.sqrt(sizes[:, None] * np.array([len(own) for own in rows])[None])).max(axis=1))
    return float(best.sum() / len(asked))


@F.pandas_udf(DoubleType())
def pair_score(question: pd.Series, text: pd.Series) -> pd.Series:
    asked: dict[str, list[str]] = {}
    out = []
    for q, t in zip(question, text, strict=True):
        if q not in asked:
            asked[q] = _tokens(q or "")
        out.append(interaction(asked[q], _tokens(t or "")))
    return pd.Series(out, dtype="float64").astype(object).where(pd.notna(pd.Series(out, dtype="float64")), None)


def score_pairs(candidates: DataFrame, questions: DataFrame, texts: DataFrame, out: str = "scored") -> DataFrame:
    """candidates (q, node_id, ...) with `out`: how well the text (node_id, text) answers the question (q, text); null where either has no token. Each
    candidate meets its text by one join; equal texts are scored for each question anew."""
    asked = questions.select("q", F.col("text").alias("_asked"))
    held = texts.select("node_id", F.col("text").alias("_text"))
    return candidates.join(asked, "q", "left").join(held, "node_id", "left").withColumn(out, pair_score("_asked", "_text")).drop("_asked", "_text")

