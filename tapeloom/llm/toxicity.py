"""Toxicity scores: FTRL-proximal logistic regression over hashed n-grams.

Features of a text are the distinct hashed word unigrams, bigrams and
skip-grams (one word left out) of its lower-cased words. The model is fitted
on a bounded sample of labelled rows by FTRL-proximal: one learning rate per
coordinate, and an L1 term that leaves most weights exactly zero, so that what
is shipped to the executors is a short list of (index, weight).
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeloom.llm.common import WordHashes, fresh

WORD = re.compile(r"\w+")
_HASHES = WordHashes("toxicity", seed=5)
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5], dtype=np.uint64)


def feature_ids(text: str | None, bits: int) -> np.ndarray:
    """Hashed n-grams and skip-grams of a whole text, repeats included."""
    words = WORD.findall((text or "").lower())
    h = np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))
    shift = np.uint64(64 - bits)
    pair = (h[:-1] * _MIX[0] + h[1:] * _MIX[1]) >> shift
    skip = (h[:-2] * _MIX[2] + h[2:] * _MIX[3]) >> shift
    return np.concatenate([h >> shift, pair, skip]).astype(np.int64)


@dataclass
class SparseModel:
    """Bias and the non-zero weights, by ascending feature index."""

    bits: int
    bias: float
    index: np.ndarray
    weight: np.ndarray

    def dense(self) -> np.ndarray:
        w = np.zeros(1 << self.bits, np.float32)
        w[self.index] = self.weight
        return w


def fit_ftrl(examples: list[np.ndarray], labels: list[int], bits: int = 20, alpha: float = 1.0, beta: float = 1.0,
             l1: float = 8.0, l2: float = 0.0, epochs: int = 4, seed: int = 11) -> SparseModel:
    """Fit on arrays of distinct feature ids; the last coordinate is the bias."""
    size = 1 << bits
    z, n = np.zeros(size), np.zeros(size)
    zb, nb = 0.0, 0.0
    rng = np.random.default_rng(seed)

    def weights(zi: np.ndarray, ni: np.ndarray) -> np.ndarray:
        return np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(ni)) / alpha + l2))

    for _ in range(epochs):
        for k in rng.permutation(len(examples)):
            idx, y = examples[k], labels[k]
            zi, ni = z[idx], n[idx]
            w = weights(zi, ni)
            b = -zb / ((beta + math.sqrt(nb)) / alpha + l2)
            g = 1 / (1 + math.exp(-max(-35.0, min(35.0, b + float(w.sum()))))) - y
            gg = g * g
            z[idx] = zi + g - (np.sqrt(ni + gg) - np.sqrt(ni)) / alpha * w
            n[idx] = ni + gg
            zb += g - (math.sqrt(nb + gg) - math.sqrt(nb)) / alpha * b
            nb += gg
    w = weights(z, n)
    keep = np.flatnonzero(w)
    return SparseModel(bits, -zb / ((beta + math.sqrt(nb)) / alpha + l2), keep, w[keep])


def train_toxicity(docs: DataFrame, labels: DataFrame, train_if: Column, id_col: str = "doc_id", text_col: str = "text",
                   label_col: str = "toxic", max_rows_per_class: int = 2000, bits: int = 20) -> SparseModel:
    """Fit on at most about ``max_rows_per_class`` labelled rows of each class.

    The rows are those of least hash of their id, so the sample is the same on
    every run and its size does not grow with the input. Rows with a null id,
    a label other than 0 or 1, or an id labelled both ways are not used; of the
    texts of a repeated id the least counts. With
    no rows of a class, the model is constant: label 1 only if all known rows
    have it, else label 0, so that nothing is rejected for want of labels.
    """
    known = (labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).where(train_if)
             .groupBy(F.col(id_col).alias("_id")).agg(F.min(label_col).alias("_y"), F.max(label_col).alias("_y1"))
             .where("_y = _y1").select("_id", "_y"))
    counts = {r["_y"]: r["count"] for r in known.groupBy("_y").count().collect()}

    def constant(classes: set[int]) -> SparseModel:
        return SparseModel(bits, 4.0 if classes == {1} else -4.0, np.zeros(0, np.int64), np.zeros(0))

    if len(counts) < 2:
        return constant(set(counts))
    share = {y: min(1.0, max_rows_per_class / n) for y, n in counts.items()}
    dice = F.pmod(F.xxhash64("_id", F.lit("sample")), F.lit(1 << 20)) / F.lit(float(1 << 20))
    sample = known.where(dice < F.when(F.col("_y") == 1, share[1]).otherwise(share[0]))
    few = F.broadcast(sample.orderBy(dice, "_id").limit(3 * max_rows_per_class))  # ids and labels only, of a stated number of rows
    picked = (docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(few, "_id")
              .groupBy("_id", "_y").agg(F.min("_text").alias("_text")))

    @F.pandas_udf("binary")
    def distinct_features(text: pd.Series) -> pd.Series:
        return text.map(lambda t: np.unique(feature_ids(t, bits)).astype(np.int32).tobytes(), na_action=None)

    rows = picked.select("_id", "_y", distinct_features("_text").alias("f")).toPandas().sort_values("_id")
    if rows["_y"].nunique() < 2:
        return constant(set(rows["_y"]))
    return fit_ftrl([np.frombuffer(f, np.int32) for f in rows["f"]], rows["_y"].tolist(), bits)


_TABLES: dict[tuple, np.ndarray] = {}


def score_texts(texts: pd.Series, model: SparseModel) -> pd.Series:
    """Probability of label 1 for each whole text; null scores as empty."""
    key = model.bits, model.index.tobytes(), model.weight.tobytes()
    if key not in _TABLES:
        _TABLES.clear()
        _TABLES[key] = model.dense()
    table, out = _TABLES[key], np.empty(len(texts))
    for k, text in enumerate(texts):
        ids = feature_ids(text, model.bits)
        hit = np.unique(ids[table[ids] != 0])
        out[k] = model.bias + float(table[hit].sum(dtype=np.float64))
    return pd.Series(1 / (1 + np.exp(-np.clip(out, -35, 35))))


def score_toxicity(docs: DataFrame, model: SparseModel, text_col: str = "text", out_col: str = "score") -> DataFrame:
    """``docs`` with ``out_col``: 0 to 1, higher is likelier toxic.

    Null and empty texts get the score of a text without features. All columns
    stay; a column named ``out_col`` is replaced.
    """

    @F.pandas_udf("double")
    def score(text: pd.Series) -> pd.Series:
        return score_texts(text, model)

    return docs.withColumn(out_col, score(F.col(text_col)))


def drop_toxic(docs: DataFrame, model: SparseModel, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """Rows that score below ``threshold``, with the columns of ``docs``."""
    (score,) = fresh(docs, "toxic_score")
    return score_toxicity(docs, model, text_col, score).where(F.col(score) < threshold).drop(score)
