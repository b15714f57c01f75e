"""Quality scores: logistic regression over hashed word n-grams, fitted by
follow-the-regularised-leader updates and scored as sparse dot products.

A text is a run of lower-case words without punctuation and, apart from these, a run of its
symbol groups.  Features are single words, symbol groups, and pairs of neighbouring words; a
word next to itself is a pair of its own kind.  Values are log counts scaled to unit length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_remainder, materialize
from .labelled import training_rows, within_bytes

BITS = 20
SAMPLE_ROWS, SAMPLE_BYTES = 8_000, 96 << 20
MODULUS, HELD_OUT, THRESHOLD = 4, 2, 0.7
_WORDS = bytes(b if b > 127 else (ord(chr(b).lower()) if chr(b).isalnum() else 32) for b in range(256))
_SYMBOLS = bytes(32 if b > 127 or chr(b).isalnum() or b < 33 else b for b in range(256))
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _hashes(tokens: list[bytes]) -> np.ndarray:
    return np.fromiter(map(zlib.crc32, tokens), np.uint64, len(tokens))


def features(text: str | None, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """``(indices, values)`` of the whole text, indices ascending."""
    raw = (text or "").encode()
    words, symbols = _hashes(raw.translate(_WORDS).split()), _hashes(raw.translate(_SYMBOLS).split())
    left, right = words[:-1], words[1:]
    pairs = np.where(left == right, np.uint64(1), (left * np.uint64(31) ^ right) * _MIX)
    grams = np.concatenate([words * _MIX, (symbols + np.uint64(1 << 33)) * _MIX, (pairs + np.uint64(1 << 34)) * _MIX]) >> np.uint64(64 - bits)
    index, count = np.unique(grams, return_counts=True)
    value = np.log1p(count)
    return index.astype(np.int32), (value / max(1e-9, np.sqrt((value**2).sum()))).astype(np.float32)


class Ftrl:
    """Per-coordinate follow-the-regularised-leader with L1 and L2 terms."""

    def __init__(self, bits: int = BITS, alpha: float = 0.3, beta: float = 1.0, l1: float = 0.3, l2: float = 0.1):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1)  # the last one is the bias

    def weights(self, at: np.ndarray | slice) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= self.l1, 0.0, -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def update(self, index: np.ndarray, value: np.ndarray, label: int) -> None:
        w = self.weights(index)
        g = (1 / (1 + np.exp(-np.clip(w @ value, -30, 30))) - label) * value
        n = self.n[index]
        self.z[index] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[index] = n + g * g


def fit(rows: list[tuple[np.ndarray, np.ndarray]], label: np.ndarray, bits: int = BITS, epochs: int = 4, seed: int = 7) -> np.ndarray:
    """Dense weights, bias last; deterministic for given rows in a given order."""
    model, rng = Ftrl(bits), np.random.default_rng(seed)
    for _ in range(epochs):
        for k in rng.permutation(len(rows)):
            index, value = rows[k]
            model.update(np.append(index, 1 << bits), np.append(value, 1.0), int(label[k]))
    return model.weights(slice(None)).astype(np.float32)


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", sample_rows: int = SAMPLE_ROWS, modulus: int = MODULUS, held_out: int = HELD_OUT, id_col: str = "doc_id", text_col: str = "text") -> np.ndarray:
    """Fit on a bounded sample: only the sparse rows of the sample reach the driver, of about
    ``SAMPLE_BYTES`` together; where texts are so long that they come to more, fewer rows do."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [features(t) for t in pdf["text"]]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "label": pdf["label"], "h": pdf["h"], "i": [i.tobytes() for i, _ in rows], "v": [v.astype(np.float16).tobytes() for _, v in rows]})

    rows = training_rows(docs, labels, label_col, modulus, held_out, sample_rows, id_col, text_col)
    rows = materialize(rows.mapInPandas(run, "doc_id long, label int, h long, i binary, v binary"), "features")
    rows = within_bytes(rows, F.octet_length("i") + F.octet_length("v"), SAMPLE_BYTES)
    got = rows.drop("h").toPandas().sort_values(["doc_id", "label", "i", "v"])
    return fit([(np.frombuffer(i, np.int32), np.frombuffer(v, np.float16).astype(np.float32)) for i, v in zip(got["i"], got["v"], strict=True)], got["label"].to_numpy(np.int64))


def quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, sample_rows: int = SAMPLE_ROWS, modulus: int = MODULUS, held_out: int = HELD_OUT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` for every row of ``docs``.

    Null and empty texts have no feature and get the bias as their score; without training rows
    every score is 0.5.  Repeated rows are scored each; a null id has a null ``held_out``.
    Other columns are not read.  An empty table gives an empty result.
    """
    held = docs.sparkSession.sparkContext.broadcast(train(docs, labels, "quality", sample_rows, modulus, held_out, id_col, text_col))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        weights = held.value
        for pdf in batches:
            margin = np.fromiter((weights[-1] + weights[i] @ v for i, v in map(features, pdf["text"])), float, len(pdf))
            score = 1 / (1 + np.exp(-np.clip(margin, -30, 30)))
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "score": score, "predicted": (score >= threshold).astype(np.int32)})

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    scored = rows.mapInPandas(run, "doc_id long, score double, predicted int")
    return scored.select("doc_id", (id_remainder("doc_id", modulus) == held_out).alias("held_out"), "score", "predicted")
