"""Toxicity scores from a factorization machine over hashed terms.

A term is a lower-case word without its punctuation, or the beginning of a longer one (so that
inflected and compounded forms share it), present or absent, hashed into buckets.
Buckets that tell the classes apart (chi-square on the sample) are kept as features.  The
score is sigmoid(w0 + sum w_i + sum over pairs <v_i, v_j>), so a pair of terms can count for
more, or less, than its parts.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_remainder, materialize
from .labelled import training_rows

BUCKET_BITS = 20
STEMS = (4, 5, 6, 7)  # bytes
FEATURES, LEAST_SEEN = 1024, 4
FACTORS = 8
SAMPLE_ROWS = 16_000
MODULUS, HELD_OUT, THRESHOLD = 5, 0, 0.5
# every ASCII character but letters, digits becomes a blank; letters become lower case
_FOLD = bytes(b if b > 127 else (ord(chr(b).lower()) if chr(b).isalnum() else 32) for b in range(256))


def buckets(text: str | None, bits: int = BUCKET_BITS) -> np.ndarray:
    """Sorted distinct buckets of the whole text's terms: words and the beginnings of words."""
    terms = set((text or "").encode().translate(_FOLD).split())
    for n in STEMS:
        terms |= {w[:n] + b"-" for w in terms if len(w) > n and w[-1:] != b"-"}
    return np.unique(np.fromiter(map(zlib.crc32, terms), np.uint32, len(terms)) & np.uint32((1 << bits) - 1)).astype(np.int32)


@dataclass
class FactorizationMachine:
    feature_of: np.ndarray  # bucket -> feature or -1
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def margin(self, bucket_lists: list[np.ndarray]) -> np.ndarray:
        ids = [(f := self.feature_of[b])[f >= 0] for b in bucket_lists]
        n = np.fromiter(map(len, ids), np.int64, len(ids))
        row = np.repeat(np.arange(len(ids)), n)
        flat = np.concatenate(ids) if ids else np.zeros(0, np.int64)
        out = self.bias + np.bincount(row, self.weights[flat], len(ids))
        for k in range(self.factors.shape[1]):
            v = self.factors[flat, k]
            out += 0.5 * (np.bincount(row, v, len(ids)) ** 2 - np.bincount(row, v * v, len(ids)))
        return out

    def score(self, bucket_lists: list[np.ndarray]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(bucket_lists), -30, 30)))


def chosen_buckets(seen: np.ndarray, pos: np.ndarray, n: int, n1: int, features: int = FEATURES) -> np.ndarray:
    """The buckets that tell ``n1`` positive texts from the others best: those found in ``seen`` texts,
    ``pos`` of them positive, whose chi-square passes the 0.001 level; ascending."""
    expected = seen * n1 / n
    chi = (pos - expected) ** 2 / np.maximum(expected * (1 - n1 / n) * (1 - seen / (n + 1)), 1e-9)
    chi[seen < LEAST_SEEN] = 0
    chosen = np.sort(np.argsort(-chi, kind="stable")[:features])
    return chosen[chi[chosen] > 10.8]


def constant(n: int, n1: int, rank: int = FACTORS, bits: int = BUCKET_BITS) -> FactorizationMachine:
    """The smoothed share of positive texts, for samples without both classes."""
    share = (n1 + 0.5) / (n + 1)
    return FactorizationMachine(np.full(1 << bits, -1, np.int32), float(np.log(share / (1 - share))), np.zeros(0), np.zeros((0, rank)))


def descend(feature_lists: list[np.ndarray], label: np.ndarray, chosen: np.ndarray, rank: int = FACTORS, bits: int = BUCKET_BITS, epochs: int = 30, rate: float = 0.2, l2: float = 1e-4, seed: int = 7) -> FactorizationMachine:
    """Adagrad on logistic loss over rows of chosen features; deterministic for given rows in a given
    order."""
    n, n1 = len(label), int(label.sum())
    feature_of = np.full(1 << bits, -1, np.int32)
    feature_of[chosen] = np.arange(len(chosen), dtype=np.int32)
    x = np.zeros((n, len(chosen)), bool)
    for row, f in enumerate(feature_lists):
        x[row, f] = True
    rng = np.random.default_rng(seed)
    w0, w, v = float(np.log(n1 / (n - n1))), np.zeros(len(chosen)), rng.normal(0, 0.02, (len(chosen), rank))
    g0, gw, gv = 1e-6, np.full(len(chosen), 1e-6), np.full(v.shape, 1e-6)
    for _ in range(epochs):
        for batch in np.array_split(rng.permutation(n), max(1, n // 256)):
            xb = x[batch].astype(np.float32)
            xv = xb @ v
            margin = w0 + xb @ w + 0.5 * (xv**2 - xb @ v**2).sum(1)
            err = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - label[batch]) / len(batch)
            d0, dw = err.sum(), xb.T @ err + l2 * w
            dv = xb.T @ (err[:, None] * xv) - (xb.T @ err)[:, None] * v + l2 * v
            g0, gw, gv = g0 + d0**2, gw + dw**2, gv + dv**2
            w0, w, v = w0 - rate * d0 / np.sqrt(g0), w - rate * dw / np.sqrt(gw), v - rate * dv / np.sqrt(gv)
    return FactorizationMachine(feature_of, float(w0), w, v)


def fit(bucket_lists: list[np.ndarray], label: np.ndarray, features: int = FEATURES, rank: int = FACTORS, bits: int = BUCKET_BITS, **options) -> FactorizationMachine:
    """Choose features and descend, for rows of buckets that are at hand; ``train()`` does the same
    on stored rows."""
    n, n1 = len(label), int(label.sum())
    if not n or n1 in (0, n):
        return constant(n, n1, rank, bits)
    seen, pos = np.zeros(1 << bits), np.zeros(1 << bits)
    for b, mark in zip(bucket_lists, label, strict=True):
        seen[b] += 1
        if mark == 1:
            pos[b] += 1
    chosen = chosen_buckets(seen, pos, n, n1, features)
    return descend([features_of(b, chosen) for b in bucket_lists], label, chosen, rank, bits, **options)


def features_of(found: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """Places in ``chosen`` of the buckets found; both ascending."""
    return np.flatnonzero(np.isin(chosen, found, assume_unique=True))


def train(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", sample_rows: int = SAMPLE_ROWS, modulus: int = MODULUS, held_out: int = HELD_OUT, id_col: str = "doc_id", text_col: str = "text") -> FactorizationMachine:
    """Fit on a bounded sample.  Counts of its buckets are summed in Spark; of a text, however long,
    only the chosen features reach the driver: at most ``FEATURES`` of 2 bytes."""

    def terms(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "label": pdf["label"], "terms": [buckets(t).tobytes() for t in pdf["text"]]})

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen, pos = np.zeros(1 << BUCKET_BITS, np.int64), np.zeros(1 << BUCKET_BITS, np.int64)
        for pdf in batches:
            for t, mark in zip(pdf["terms"], pdf["label"], strict=True):
                b = np.frombuffer(t, np.int32)
                seen[b] += 1
                pos[b] += int(mark == 1)
        found = np.flatnonzero(seen)
        yield pd.DataFrame({"bucket": found, "seen": seen[found], "pos": pos[found]})

    rows = training_rows(docs, labels, label_col, modulus, held_out, sample_rows, id_col, text_col)
    rows = materialize(rows.mapInPandas(terms, "doc_id long, label int, terms binary"), "terms")
    n, n1 = rows.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()
    if n1 in (0, n):
        return constant(n, n1)
    sums = rows.mapInPandas(count, "bucket long, seen long, pos long").groupBy("bucket").agg(F.sum("seen").alias("seen"), F.sum("pos").alias("pos"))
    sums = sums.where(F.col("seen") >= LEAST_SEEN).toPandas()  # a row a bucket at most
    seen, pos = np.zeros(1 << BUCKET_BITS), np.zeros(1 << BUCKET_BITS)
    seen[sums["bucket"]], pos[sums["bucket"]] = sums["seen"], sums["pos"]
    chosen = chosen_buckets(seen, pos, n, n1)

    def pick(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "label": pdf["label"], "f": [features_of(np.frombuffer(t, np.int32), chosen).astype(np.int16).tobytes() for t in pdf["terms"]]})

    got = rows.mapInPandas(pick, "doc_id long, label int, f binary").toPandas().sort_values(["doc_id", "label", "f"])
    return descend([np.frombuffer(f, np.int16) for f in got["f"]], got["label"].to_numpy(np.int64), chosen)


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, sample_rows: int = SAMPLE_ROWS, modulus: int = MODULUS, held_out: int = HELD_OUT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` for every row of ``docs``.

    Null and empty texts have no term and get the bias as their score.  Repeated rows are scored
    each; a null id has a null ``held_out``.  Without labels of both classes the score is the
    smoothed share of toxic ones.  Other columns are not read.  An empty table gives an empty result.
    """
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, "toxic", sample_rows, modulus, held_out, id_col, text_col))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            score = model.value.score([buckets(t) for t in pdf["text"]])
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "score": score, "predicted": (score >= threshold).astype(np.int32)})

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    scored = rows.mapInPandas(run, "doc_id long, score double, predicted int")
    return scored.select("doc_id", (id_remainder("doc_id", modulus) == held_out).alias("held_out"), "score", "predicted")


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, sample_rows: int = SAMPLE_ROWS, modulus: int = MODULUS, held_out: int = HELD_OUT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of ``docs`` whose text is not predicted toxic, all columns kept, whatever their names.

    Every row is judged by its own text; its id may be null or repeated.  Without labels of both
    classes there is nothing to judge by, and all rows stay.  An empty table stays empty.
    """
    fitted = train(docs, labels, "toxic", sample_rows, modulus, held_out, id_col, text_col)
    if not fitted.weights.size:
        return docs
    model = docs.sparkSession.sparkContext.broadcast(fitted)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(model.value.score([buckets(t) for t in texts]) < threshold)

    return docs.where(F.pandas_udf(run, "boolean")(F.col(text_col).cast("string")))
