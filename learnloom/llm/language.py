"""Language identification by a byte convolutional network.

Filters of several widths run over byte embeddings, each is max-pooled over a window of
fixed length, and a softmax layer reads the pooled values. The network is trained in numpy
on the driver from a bounded sample of labelled texts (``per_language`` documents with
``WINDOWS_PER_TEXT`` windows each); it is then applied in tasks to every window of every
whole text, and the window probabilities are averaged per text.

Edge cases: a null text, or one without a letter, is ``und`` with score 0. Shorter texts are
padded with spaces to one window. Repeated rows get equal answers. Without any labelled text
every answer is ``und`` with score 0. Columns of the input are kept; the two result columns
replace input columns of the same name.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from learnloom.llm.common import boxed, small_batches, unboxed

WINDOW = 256  # bytes
WINDOWS_PER_TEXT = 8
WIDTHS = (2, 3, 4)
FILTERS = 16
EMBED = 8
PER_LANGUAGE = 400
UNDETERMINED = "und"
LETTER = re.compile(r"[^\W\d_]")


@dataclass
class ByteNetwork:
    """Weights: byte embedding, one filter bank per width, softmax layer."""

    languages: list[str]
    embed: np.ndarray
    filters: list[np.ndarray]  # (width, EMBED, FILTERS)
    bias: list[np.ndarray]
    out: np.ndarray
    out_bias: np.ndarray

    def tables(self) -> list[list[np.ndarray]]:
        """Per width: what a pair of bytes (or the odd last byte) adds to the filters."""
        tables = []
        for width, bank, bias in zip(WIDTHS, self.filters, self.bias):
            single = [(self.embed @ bank[j]).astype(np.float32) for j in range(width)]
            single[0] = single[0] + bias
            parts = [
                (single[j][:, None, :] + single[j + 1][None, :, :]).reshape(-1, FILTERS)
                for j in range(0, width - 1, 2)
            ]
            if width % 2:
                parts.append(single[-1])
            tables.append(parts)
        return tables

    def probabilities(self, windows: np.ndarray, tables: list[list[np.ndarray]]) -> np.ndarray:
        """Softmax rows for (n, WINDOW) bytes."""
        pairs = windows[:, :-1].astype(np.int32) * 256 + windows[:, 1:]
        pooled = []
        for width, parts in zip(WIDTHS, tables):
            n = WINDOW - width + 1
            total = np.take(parts[0], pairs[:, :n], axis=0)
            for j in range(2, width, 2):
                if j + 1 < width:
                    total += np.take(parts[j // 2], pairs[:, j : j + n], axis=0)
                else:
                    total += np.take(parts[-1], windows[:, j : j + n], axis=0)
            pooled.append(np.maximum(total.max(axis=1), 0))
        return softmax(np.concatenate(pooled, axis=1) @ self.out + self.out_bias)


def softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def cut_windows(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All windows of all texts, and the index of the text each belongs to.

    The last window of a text ends with it, so it overlaps the one before.
    """
    padded = [t.ljust(WINDOW) for t in texts]
    sizes = np.array([len(t) for t in padded], np.int64)
    counts = -(-sizes // WINDOW)
    owner = np.repeat(np.arange(len(texts)), counts)
    k = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    base = np.repeat(np.cumsum(sizes) - sizes, counts)
    start = base + np.minimum(k * WINDOW, np.repeat(sizes, counts) - WINDOW)
    data = np.frombuffer(b"".join(padded), np.uint8)
    return data[start[:, None] + np.arange(WINDOW)], owner


def train(windows: np.ndarray, labels: np.ndarray, languages: list[str], epochs: int = 6, seed: int = 7) -> ByteNetwork:
    """Adam on the cross entropy; max pooling passes the gradient to the largest position."""
    rng = np.random.default_rng(seed)
    n_features = FILTERS * len(WIDTHS)
    params = [rng.normal(0, 0.5, (256, EMBED))]
    params += [rng.normal(0, 1 / np.sqrt(w * EMBED), (w, EMBED, FILTERS)) for w in WIDTHS]
    params += [np.zeros(FILTERS) for _ in WIDTHS]
    params += [rng.normal(0, 1 / np.sqrt(n_features), (n_features, len(languages))), np.zeros(len(languages))]
    params = [p.astype(np.float32) for p in params]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    m = len(WIDTHS)
    step, batch = 0, 64
    for _ in range(epochs):
        order = rng.permutation(len(windows))
        for start in range(0, len(order), batch):
            rows = order[start : start + batch]
            x, y = windows[rows], labels[rows]
            embed, banks, biases, out, out_bias = params[0], params[1 : 1 + m], params[1 + m : 1 + 2 * m], params[-2], params[-1]
            e = embed[x]
            pooled, where = [], []
            for width, bank, bias in zip(WIDTHS, banks, biases):
                n = WINDOW - width + 1
                total = sum(e[:, j : j + n] @ bank[j] for j in range(width)) + bias
                at = total.argmax(axis=1)
                where.append(at)
                pooled.append(np.take_along_axis(total, at[:, None, :], axis=1)[:, 0])
            raw = np.concatenate(pooled, axis=1)
            hidden = np.maximum(raw, 0)
            grad = softmax(hidden @ out + out_bias)
            grad[np.arange(len(y)), y] -= 1
            grad /= len(y)
            g_hidden = (grad @ out.T) * (raw > 0)
            grads = [np.zeros_like(p) for p in params]
            grads[-2], grads[-1] = hidden.T @ grad, grad.sum(axis=0)
            for i, width in enumerate(WIDTHS):
                g = g_hidden[:, i * FILTERS : (i + 1) * FILTERS]
                grads[1 + m + i] = g.sum(axis=0)
                row = np.arange(len(y))[:, None]
                for j in range(width):
                    byte = x[row, where[i] + j]
                    grads[1 + i][j] = np.einsum("bfe,bf->ef", embed[byte], g)
                    np.add.at(grads[0], byte, g[:, :, None] * banks[i][j].T[None])
            step += 1
            for p, g, a, b in zip(params, grads, first, second):
                a += 0.1 * (g - a)
                b += 0.001 * (g * g - b)
                p -= 0.01 * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)
    return ByteNetwork(languages, params[0], params[1 : 1 + m], params[1 + m : 1 + 2 * m], params[-2], params[-1])


def fold(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4


def fit(documents: DataFrame, per_language: int = PER_LANGUAGE) -> ByteNetwork | None:
    """Train on documents outside the held-out fold; None when none is labelled.

    The sample is bounded: per language the ``per_language`` texts with the smallest hash,
    each with WINDOWS_PER_TEXT windows spread over the whole text.
    """
    usable = documents.where((fold(F.col("doc_id")) != 2) & F.col("text").isNotNull() & F.col("lang").isNotNull())
    sizes = dict(usable.groupBy("lang").count().collect())  # one row per class of the network
    if not sizes:
        return None
    # The smallest hashes of a language lie below a bound that its size gives; only those rows move.
    enough = per_language + 8 * int(per_language**0.5) + 64
    bounds = [F.lit(x) for lang, n in sizes.items() for x in (lang, min(1 << 31, enough * (1 << 31) // n))]
    spread_id = F.shiftrightunsigned(F.xxhash64("doc_id", F.lit("lid")), 33)
    usable = usable.where(spread_id < F.element_at(F.create_map(*bounds), F.col("lang")))
    size = F.length("text")
    first = Window.partitionBy("lang").orderBy("_spread", "doc_id", "_size")
    spread = F.transform(
        F.sequence(F.lit(0), F.lit(WINDOWS_PER_TEXT - 1)),
        lambda i: F.substring(F.col("text"), F.floor(i * F.greatest(size - WINDOW, F.lit(0)) / (WINDOWS_PER_TEXT - 1)).cast("int") + 1, F.lit(WINDOW)),
    )
    sample = (
        usable.select("doc_id", "lang", spread_id.alias("_spread"), size.alias("_size"), F.array_distinct(spread).alias("parts"))
        .withColumn("_rank", F.row_number().over(first))
        .where(F.col("_rank") <= per_language)
        .select("lang", "_rank", "parts")
        .orderBy("lang", "_rank")
        .collect()
    )
    languages = sorted({r["lang"] for r in sample})
    parts = [(p.lower().encode(), languages.index(r["lang"])) for r in sample for p in r["parts"] if LETTER.search(p)]
    if not parts:
        return None
    windows, owner = cut_windows([p[:WINDOW] for p, _ in parts])
    return train(windows, np.array([label for _, label in parts])[owner], languages)


def predictor(network: ByteNetwork | None):
    """Pandas UDF: text -> struct(lang_pred, score)."""

    @F.pandas_udf("struct<lang_pred string, score double>")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        tables = network.tables() if network else None
        for texts in batches:
            langs = np.full(len(texts), UNDETERMINED, dtype=object)
            scores = np.zeros(len(texts))
            known = [i for i, t in enumerate(texts) if isinstance(t, str) and LETTER.search(t)] if network else []
            for group in groups(known, texts):
                windows, owner = cut_windows([texts.iloc[i].lower().encode() for i in group])
                p = np.concatenate(
                    [network.probabilities(windows[s : s + 256], tables) for s in range(0, len(windows), 256)]
                )
                counts = np.bincount(owner)
                mean = np.add.reduceat(p.astype(np.float64), np.cumsum(counts) - counts, axis=0) / counts[:, None]
                best = mean.argmax(axis=1)
                langs[group] = [network.languages[b] for b in best]
                scores[group] = np.minimum(mean[np.arange(len(best)), best], 1.0)
            yield pd.DataFrame({"lang_pred": langs, "score": scores})

    return predict


def groups(rows: list[int], texts: pd.Series, limit: int = 1 << 20) -> Iterator[list[int]]:
    """Rows whose texts have about ``limit`` characters together."""
    group, size = [], 0
    for i in rows:
        group.append(i)
        size += len(texts.iloc[i])
        if size >= limit:
            yield group
            group, size = [], 0
    if group:
        yield group


def identify(documents: DataFrame, network: ByteNetwork | None) -> DataFrame:
    """Add ``lang_pred`` and ``score`` to every row."""
    small_batches(documents.sparkSession)
    kept = [c for c in documents.columns if c not in ("lang_pred", "score")]
    guess = documents.select(boxed(documents), predictor(network)("text").alias("_guess"))
    return guess.select(*unboxed(kept), F.col("_guess.lang_pred").alias("lang_pred"), F.col("_guess.score").alias("score"))
