"""Toxicity by a linear classifier over character n-grams whose features are scaled by naive Bayes log-count ratios.

A text's features are its character n-grams (four orders, hashed) in lower case, spaces included, valued by the
logarithm of their counts.  Each is scaled by the smoothed log ratio of its document frequency in toxic and in other
labelled texts; ratios within a few standard errors of zero count as zero.  A logistic regression with a quadratic
penalty is fitted over the scaled features.  The intercept is set back from the sample to the labels' true shares.

Defined cases: null and empty texts get the intercept's score; without labels of both classes every score is the share
of label 1 (0 without labels).  Very long texts are scored whole; repeated rows get equal scores; a score of exactly 0.5
predicts 1; an empty table gives no rows; columns of the input named score or predicted give way to the operator's own."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.llm.common import LOWER, append_columns, labelled_sample, remainder, share
from corvane.llm.crf import Adam

#: Rows of each label that the model is fitted on, at most.
SAMPLE_PER_LABEL = 1500
BITS = 18
ORDERS = (3, 4, 5, 6)
_FLAT = bytes(32 if i in b"\t\n\v\f\r" else LOWER[i] for i in range(256))


@dataclass
class ToxicityModel:
    weights: np.ndarray  # of each bucket: its log-count ratio times its fitted coefficient
    bias: float


def ngram_slices(texts: list):
    """For each text, its n-gram buckets, repeats included."""
    flat = [b" " + (t or b"").translate(_FLAT) + b" " for t in texts]
    decoded = [t.decode("utf-8", "replace") for t in flat]
    ends = np.cumsum([len(d) for d in decoded])
    codes = np.frombuffer("".join(decoded).encode("utf-32-le", "replace"), np.uint32)
    h = np.zeros(len(codes), np.uint32)
    hashed = []
    for n in range(1, max(ORDERS) + 1):
        m = len(codes) - n + 1
        if m <= 0:
            break
        h = h[:m] * np.uint32(0x01000193) + codes[n - 1 :] + np.uint32(n)
        if n in ORDERS:
            hashed.append((n, ((h ^ (h >> np.uint32(15))) * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)))
    start = 0
    for end in ends.tolist():
        parts = [x[start : end - n + 1] for n, x in hashed if end - n + 1 > start]
        yield np.concatenate(parts) if parts else np.zeros(0, np.uint32)
        start = end


def counted(buckets: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct chosen buckets of a text, and the logarithm of one more than their counts."""
    b, c = np.unique(buckets[chosen[buckets]], return_counts=True)
    return b, np.log2(1.0 + c)


def train(rows: list, shares: dict, steps: int = 80, smooth: float = 1.0, least_errors: float = 4.0) -> ToxicityModel:
    """rows: (text, label 0 or 1) pairs; shares: how many rows of each label there are in all."""
    total = sum(shares.get(x, 0) for x in (0, 1))
    positive = shares.get(1, 0) / total if total else 0.0
    flat = float(np.log((positive + 1e-6) / (1 - positive + 1e-6)))
    labels = np.array([y for _, y in rows])
    zero = np.zeros(1 << BITS, np.float32)
    if len(set(labels.tolist())) < 2:
        return ToxicityModel(zero, flat)
    texts = [(t or "").encode("utf-8", "replace") for t, _ in rows]
    seen = np.zeros((2, 1 << BITS))
    for t, y in zip(texts, labels.tolist(), strict=True):
        seen[y, np.unique(next(ngram_slices([t])))] += 1
    size = np.bincount(labels, minlength=2)
    ratio = np.log((seen[1] + smooth) / (size[1] + 2 * smooth)) - np.log((seen[0] + smooth) / (size[0] + 2 * smooth))
    ratio[np.abs(ratio) < least_errors * np.sqrt(1 / (seen[1] + smooth) + 1 / (seen[0] + smooth))] = 0
    kept = [counted(next(ngram_slices([t])), ratio != 0) for t in texts]
    index = np.concatenate([b for b, _ in kept])
    doc = np.repeat(np.arange(len(kept)), [len(b) for b, _ in kept])
    scaled = ratio[index] * np.concatenate([c for _, c in kept])
    p, adam = {"v": np.zeros(1 << BITS), "b": np.zeros(1)}, Adam(0.02)
    for _ in range(steps):
        z = np.bincount(doc, p["v"][index] * scaled, len(kept)) + p["b"]
        d = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels) / len(kept)
        adam.step(p, {"v": np.bincount(index, d[doc] * scaled, 1 << BITS) + 1e-4 * p["v"], "b": np.array([d.sum()])})
    shift = flat - float(np.log(size[1] / size[0]))
    return ToxicityModel((p["v"] * ratio).astype(np.float32), float(p["b"][0]) + shift)


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "toxic", per_label: int = SAMPLE_PER_LABEL) -> ToxicityModel:
    """Fit on a bounded sample: at most `per_label` rows of each label, chosen by hash of the key."""
    rows, counts = labelled_sample(docs, labels.where(F.col(label).isin(0, 1)), label, text, key, per_label)
    return train([(t, y) for _, y, t in rows], counts)


def score(docs: DataFrame, model: ToxicityModel, text: str = "text") -> DataFrame:
    """docs with score (0 to 1) and predicted (1 if the score is 0.5 or more)."""
    shared = share(docs.sparkSession, model)

    def make():
        m = shared()
        chosen = m.weights != 0

        def kernel(texts: list) -> list:
            z = np.array([float(m.weights[b] @ c) for b, c in (counted(x, chosen) for x in ngram_slices(texts))])
            s = 1 / (1 + np.exp(-np.clip(z + m.bias, -30, 30)))
            return [s, (s >= 0.5).astype(np.int32)]

        return kernel

    return append_columns(docs, text, [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())], make)


def op7(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The contract's digest: learn from four fifths of the labels, score every row."""
    held = F.coalesce(remainder("doc_id", 5) == 0, F.lit(False))
    model = fit(docs, labels.where(~held))
    return score(docs.select("doc_id", "text"), model).select("doc_id", held.alias("held_out"), "score", "predicted")
