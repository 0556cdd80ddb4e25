"""Language identification: a byte convolutional network, trained in numpy.

Bytes are embedded, filters of several widths slide over fixed-length windows,
each filter's largest response in a window is kept (max pooling) and a softmax
layer names the language. A text is cut into windows that together cover all
of it; its log-probabilities are the average over windows, by bytes.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeloom.llm.common import discard, fresh, materialize

WINDOW = 256
UNKNOWN = "und"


@dataclass
class ByteCNN:
    """``embed`` (256, d), ``filters`` (width*d, n) zero-padded to the widest, ``out`` (n, languages)."""

    labels: list[str]
    width: int
    embed: np.ndarray
    filters: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray


def _columns(model: ByteCNN, x: np.ndarray) -> np.ndarray:
    """im2col: (windows, WINDOW) bytes -> (windows, WINDOW, width*d)."""
    n, d, w = len(x), model.embed.shape[1], model.width
    e = np.zeros((n, WINDOW + w - 1, d), np.float32)
    e[:, :WINDOW] = model.embed[x]
    cols = np.empty((n, WINDOW, w, d), np.float32)
    for k in range(w):
        cols[:, :, k] = e[:, k:k + WINDOW]
    return cols.reshape(n, WINDOW, w * d)


def window_log_probs(model: ByteCNN, x: np.ndarray, chunk: int = 64) -> np.ndarray:
    out = np.empty((len(x), len(model.labels)), np.float32)
    for at in range(0, len(x), chunk):
        cols = _columns(model, x[at:at + chunk])
        z = (cols.reshape(-1, cols.shape[2]) @ model.filters).reshape(len(cols), WINDOW, -1).max(1) + model.bias
        s = np.maximum(z, 0) @ model.out + model.out_bias
        s -= s.max(1, keepdims=True)
        out[at:at + chunk] = s - np.log(np.exp(s).sum(1, keepdims=True))
    return out


def fit_byte_cnn(texts: list[str], langs: list[str], labels: list[str], widths: tuple[int, ...] = (2, 3, 4), per_width: int = 12,
                 dim: int = 6, epochs: int = 10, rate: float = 0.01, batch: int = 64, seed: int = 3) -> ByteCNN:
    """Train with Adam on random crops of 8 to WINDOW bytes of each text."""
    rng, w, n = np.random.default_rng(seed), max(widths), per_width * len(widths)
    mask = np.concatenate([np.repeat((np.arange(w) < k).astype(np.float32), dim)[:, None].repeat(per_width, 1) for k in widths], 1)
    embed = rng.normal(0, 0.5, (256, dim)).astype(np.float32)
    embed[0] = 0
    model = ByteCNN(labels, w, embed, rng.normal(0, 0.3, (w * dim, n)).astype(np.float32) * mask, np.zeros(n, np.float32),
                    rng.normal(0, 0.2, (n, len(labels))).astype(np.float32), np.zeros(len(labels), np.float32))
    params = [model.embed, model.filters, model.bias, model.out, model.out_bias]
    m, v, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    place = {x: k for k, x in enumerate(labels)}
    raw, y_all = [t.lower().encode() for t in texts], np.array([place[x] for x in langs], np.int64)
    for epoch in range(epochs):
        order = rng.permutation(len(raw))
        for at in range(0, len(order), batch):
            pick = order[at:at + batch]
            x = np.zeros((len(pick), WINDOW), np.uint8)
            for r, k in enumerate(pick):
                size = int(rng.integers(8, WINDOW + 1)) if rng.random() < 0.5 else WINDOW
                start = int(rng.integers(0, max(1, len(raw[k]) - size + 1)))
                piece = raw[k][start:start + size]
                x[r, :len(piece)] = np.frombuffer(piece, np.uint8)
            y, cols = y_all[pick], _columns(model, x)
            z = cols @ model.filters
            top = z.argmax(1)
            h0 = np.take_along_axis(z, top[:, None], 1)[:, 0] + model.bias
            h = np.maximum(h0, 0)
            s = h @ model.out + model.out_bias
            p = np.exp(s - s.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(y)), y] -= 1
            p /= len(y)
            dh = (p @ model.out.T) * (h0 > 0)
            hit = cols[np.arange(len(y))[:, None], top]
            g_embed = np.zeros((256, dim), np.float32)
            dcol = (dh[:, :, None] * model.filters.T[None]).reshape(len(y), n, w, dim)
            for k in range(w):
                pos = top + k
                np.add.at(g_embed, x[np.arange(len(y))[:, None], np.minimum(pos, WINDOW - 1)][pos < WINDOW], dcol[:, :, k][pos < WINDOW])
            g_embed[0] = 0
            grads = [g_embed, np.einsum("bfc,bf->cf", hit, dh) * mask, dh.sum(0), h.T @ p, p.sum(0)]
            step += 1
            lr = rate * (1 - epoch / epochs)
            for q, g, a, b in zip(params, grads, m, v):
                a += 0.1 * (g - a)
                b += 0.01 * (g * g - b)
                q -= lr * (a / (1 - 0.9 ** step)) / (np.sqrt(b / (1 - 0.99 ** step)) + 1e-8)
    return model


def train_langid(docs: DataFrame, train_if: Column, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id",
                 max_rows_per_lang: int = 1500, crop: int = 400, max_rows: int = 300_000) -> ByteCNN:
    """Fit on at most about ``max_rows_per_lang`` rows of every language, fewer where all languages together would pass ``max_rows``.

    No language is left out: the row of least hashed rank of each is always in
    the sample. Rows with null text, language or id are not used. From each sampled row a
    crop of ``crop`` characters is taken, at a hashed position anywhere in the
    text, so what reaches the driver is bounded by ``max_rows`` (or the number of languages,
    if greater) x crop, as is the model by the number of languages. The
    sample follows from the rows alone, so every run fits the same model.
    """
    known = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & F.col(id_col).isNotNull()).where(train_if)
    dice = F.pmod(F.xxhash64(F.col(id_col), F.lit("sample")), F.lit(1 << 20)) / F.lit(float(1 << 20))
    langs = materialize(known.groupBy(F.col(lang_col).alias("_y")).agg(F.count("*").alias("_n"), F.min(dice).alias("_least")), "languages")
    names = sorted(r["_y"] for r in langs.select("_y").collect())
    if not names:
        return fit_byte_cnn([], [], [UNKNOWN])
    each = max(1, min(max_rows_per_lang, max_rows // len(names)))
    room = F.greatest(F.length(text_col) - crop, F.lit(0)) + 1
    start = 1 + F.pmod(F.xxhash64(F.col(id_col), F.lit("crop")), room)
    first = F.col("_d") == F.col("_least")
    rows = (known.select(F.col(id_col).alias("_i"), F.col(lang_col).alias("_y"), dice.alias("_d"), F.substring(text_col, start.cast("int"), F.lit(crop)).alias("_t"))
            .join(langs, "_y").where((F.col("_d") * F.col("_n") < each) | first)
            .orderBy((~first), "_d", "_i", "_t").limit(2 * each * len(names)).select("_i", "_y", "_t").toPandas().sort_values(["_i", "_t"]))
    discard(langs)
    return fit_byte_cnn(rows["_t"].tolist(), rows["_y"].tolist(), names)


def classify(texts: pd.Series, model: ByteCNN, windows_at_once: int = 4096) -> pd.DataFrame:
    """``lang_pred`` and ``score`` of each whole text."""
    step = WINDOW - model.width + 1
    total = np.zeros((len(texts), len(model.labels)))
    lettered = np.zeros(len(texts), bool)
    rows: list[np.ndarray] = []
    parts: list[np.ndarray] = []
    held = 0

    def flush() -> None:
        nonlocal held
        if parts:
            x = np.concatenate(parts)
            logp = window_log_probs(model, x) * (x != 0).sum(1, keepdims=True)
            np.add.at(total, np.concatenate(rows), logp)
        rows.clear()
        parts.clear()
        held = 0

    for k, text in enumerate(texts):
        if not isinstance(text, str) or not any(map(str.isalpha, text)):
            continue
        lettered[k] = True
        data = np.frombuffer(text.lower().encode("utf-8", "replace"), np.uint8)
        for at in range(0, max(1, len(data) - model.width + 1), step * windows_at_once):
            part = data[at:at + step * windows_at_once + model.width - 1]
            n = max(1, -(-(len(part) - model.width + 1) // step))
            padded = np.zeros((n - 1) * step + WINDOW, np.uint8)
            padded[:len(part)] = part
            parts.append(np.lib.stride_tricks.sliding_window_view(padded, WINDOW)[::step])
            rows.append(np.full(n, k))
            held += n
            if held >= windows_at_once:
                flush()
    flush()
    size = np.array([max(1, len(t.encode("utf-8", "replace"))) if isinstance(t, str) else 1 for t in texts])
    total /= size[:, None]
    p = np.exp(total - total.max(1, keepdims=True)) if len(texts) else total
    p /= np.maximum(p.sum(1, keepdims=True), 1e-12)
    best = p.argmax(1)
    return pd.DataFrame({"lang_pred": np.where(lettered, np.array(model.labels, object)[best], UNKNOWN),
                         "score": np.where(lettered, p.max(1), 0.0).astype(float)})


def detect_language(docs: DataFrame, model: ByteCNN, text_col: str = "text", lang_out: str = "lang_pred", score_out: str = "score") -> DataFrame:
    """``docs`` with a language and its probability for every whole text.

    Null texts and texts without a letter get ``und`` and 0. Only the text is
    an input. Other columns stay; columns named like the outputs are replaced.
    """

    @F.pandas_udf("lang_pred string, score double")
    def predict(text: pd.Series) -> pd.DataFrame:
        return classify(text, model)

    (both,) = fresh(docs, "lang_and_score")
    kept = [c for c in docs.columns if c.lower() not in (lang_out.lower(), score_out.lower())]
    return (docs.withColumn(both, predict(F.col(text_col)))
            .select(*kept, F.col(both)["lang_pred"].alias(lang_out), F.col(both)["score"].alias(score_out)))
