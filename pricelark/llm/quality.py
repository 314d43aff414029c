"""Quality classifier by positive-unlabelled learning.

Trusted positives are labelled good; web text without a label is a mixture whose share of
good text, the class prior, is estimated.  A linear model on features of a text's surface
minimises the non-negative unbiased risk

    prior * E_P[l(z)] + max(0, E_U[l(-z)] - prior * E_P[l(-z)])

with the logistic loss, so no negative example is needed.

Shape at scale: the fit sees a bounded sample, drawn by hash (``most`` rows of each
kind, a parameter); one scan of the texts serves it, another scores every whole text in
Arrow batches.  Nothing is shuffled but ids and labels.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import jaccard, tokens
from .common import give_back
from .tokens import slices

#: Byte classes, one column each: upper, lower, digit, white space, sentence marks, brackets and quotes, other symbols, beyond ASCII.
_CLASSES = np.zeros((256, 8))
for _b in range(256):
    _c = chr(_b)
    _CLASSES[_b, 7 if _b > 127 else 0 if _c.isupper() else 1 if _c.islower() else 2 if _c.isdigit() else 3 if _c.isspace() else 4 if _c in ".,;:?" else 5 if _c in "()[]{}'\"-_/" else 6] = 1

FEATURES = 25


def features(text: str | None) -> np.ndarray:
    """Numbers that describe a text's surface; an empty text has zeros and a flag."""
    out = np.zeros(FEATURES)
    data = (text or "").encode()
    words = data.split()
    if not words:
        out[0] = 1
        return out
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    share = counts @ _CLASSES / len(data)
    out[1:9] = share
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    n = len(words)
    seen = Counter(words)
    lines = [x for x in data.split(b"\n") if x.strip()]
    long_lines = [x for x in lines if len(x) > 20]
    marks = b".!?\xbb\"')"
    out[9] = math.log1p(n)
    out[10] = lengths.mean()
    out[11] = lengths.std()
    out[12] = math.log1p(int(lengths.max()))
    out[13] = len(seen) / n
    out[14] = max(seen.values()) / n
    out[15] = sum(v for v in seen.values() if v > 1) / n
    out[16] = 1 - len(set(lines)) / len(lines)
    out[17] = 1 - len(set(long_lines)) / len(long_lines) if long_lines else 0
    out[18] = math.log1p(len(data) / len(lines))
    out[19] = sum(x[-1] in marks for x in lines) / len(lines)
    out[20] = (counts[ord("!")] + counts[ord("?")]) / n
    out[21] = sum(w.isupper() and len(w) > 1 for w in words) / n
    out[22] = sum(v for w, v in seen.items() if not any(65 <= b <= 90 or 97 <= b <= 122 or b > 127 for b in w[:1])) / n
    out[23] = sum(v for w, v in seen.items() if w[-1] in b"#*$%&|<>!=+~^@\\") / n
    out[24] = math.log(max(1, len(data)) / len(zlib.compress(data[:], 1)))
    return out


def expand(x: np.ndarray) -> np.ndarray:
    """Features with their square roots and squares beside them, for a linear model to bend."""
    return np.concatenate([x, np.sqrt(np.abs(x)), x**2], axis=1)


@dataclass(frozen=True)
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray
    bias: float
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        if not len(x):
            return np.zeros(0)
        z = np.clip((expand(x) - self.mean) / self.scale, -6, 6) @ self.weight + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit_pu(positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = 1500, rate: float = 0.03, decay: float = 1e-4) -> Model:
    """Minimise the non-negative risk by full-batch Adam; where the negative part falls below 0, climb it instead."""
    both = expand(np.concatenate([positive, unlabelled]))
    mean, scale = both.mean(0), both.std(0) + 1e-6
    p, u = (np.clip((expand(x) - mean) / scale, -6, 6) for x in (positive, unlabelled))
    sigma = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    w, m, v = np.zeros(p.shape[1] + 1), 0.0, 0.0
    w[-1] = math.log(prior / (1 - prior))
    for k in range(1, steps + 1):
        zp, zu = p @ w[:-1] + w[-1], u @ w[:-1] + w[-1]
        negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        gp, gu = sigma(zp) / len(zp), sigma(zu) / len(zu)
        g_neg = np.append(gu @ u - prior * (gp @ p), gu.sum() - prior * gp.sum())
        if negative >= 0:
            down = (sigma(zp) - 1) / len(zp)
            g = prior * np.append(down @ p, down.sum()) + g_neg
        else:
            g = -g_neg
        g = g + decay * np.append(w[:-1], 0)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
    return Model(mean, scale, w[:-1], float(w[-1]), prior)


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 0


def _make_room() -> None:
    """Drop what operators before this one keep in the same Python worker: token pieces and word hashes, some hundred MB."""
    if tokens._encoders or jaccard._words:
        tokens._encoders.clear()
        jaccard._words.clear()
        give_back()


def _sample(docs: DataFrame, labels: DataFrame, most: int) -> DataFrame:
    """(id, good): at most ``most`` trusted positives and as many documents without a label, the first by hash.  No held-out rows."""
    order = F.xxhash64("id"), F.col("id")
    known = labels.select(F.col("doc_id").alias("id"), "quality").where(F.col("id").isNotNull())
    positive = known.where((F.col("quality") == 1) & ~held_out(F.col("id"))).select("id").distinct().orderBy(*order).limit(most)
    plain = docs.select(F.col("doc_id").alias("id")).where(F.col("id").isNotNull() & ~held_out(F.col("id"))).join(known.select("id"), "id", "left_anti")
    return positive.withColumn("good", F.lit(True)).unionByName(plain.distinct().orderBy(*order).limit(most).withColumn("good", F.lit(False)))


def train(docs: DataFrame, labels: DataFrame, most: int = 10_000) -> Model | None:
    """Fit on at most ``most`` positives and ``most`` unlabelled texts; None if either kind is missing.

    The class prior is the share of 1 among all labels that aren't held out, with one
    label of each kind added.  Labels of 0 serve that estimate and nothing else.
    """
    prior = labels.where(~held_out(F.col("doc_id")) & F.col("quality").isNotNull()).agg((F.sum("quality") + 1) / (F.count("*") + 2)).first()[0]
    chosen = F.broadcast(_sample(docs, labels, most))  # 2 * most rows of an id and a flag

    def run(batches):
        _make_room()
        for b in (s for x in batches for s in slices(x)):
            rows = [features(t).tolist() for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), b.column("good"), pa.array(rows, pa.list_(pa.float64()))], names=["id", "good", "x"])

    met = docs.select("doc_id", "text").join(chosen, F.col("doc_id") == F.col("id"))
    # Of rows that share an id the one whose text's hash is smallest: the sample bounds rows, not ids alone.
    met = met.groupBy("doc_id", "good").agg(F.min_by("text", F.struct(F.xxhash64("text"), F.length("text"))).alias("text"))
    got = met.mapInArrow(run, "id long, good boolean, x array<double>").toArrow().sort_by("id")  # bounded by `most`
    good = got.column("good").to_numpy(zero_copy_only=False).astype(bool)
    x = np.array(got.column("x").to_pylist(), np.float64).reshape(len(good), FEATURES)
    if not good.any() or good.all():
        return None
    return fit_pu(x[good], x[~good], float(min(max(prior or 0.5, 0.01), 0.99)))


def score(docs: DataFrame, model: Model | None, threshold: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row, from its whole text alone.

    Null and empty texts have the features of an empty text.  Without a model every score
    is 0.5.  Rows that share a doc_id are scored one by one.  Other columns are not looked at.
    """

    def run(batches):
        _make_room()
        for b in (s for x in batches for s in slices(x)):
            x = np.array([features(t) for t in b.column("text").to_pylist()]).reshape(-1, FEATURES)
            s = np.full(len(x), 0.5) if model is None else model.score(x)
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), b.column("held"), pa.array(s)], names=["doc_id", "held_out", "score"])

    scored = docs.select("doc_id", held_out(F.col("doc_id")).alias("held"), "text").mapInArrow(run, "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep(docs: DataFrame, model: Model | None, threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs`` whose score reaches the threshold, with all their columns, whatever their names.

    Null and empty texts are scored as empty ones; rows that repeat are scored one by one; without a model all stay, and an empty table stays empty.
    """
    if model is None:
        return docs

    def run(batches):
        _make_room()
        for b in (s for x in batches for s in slices(x)):
            x = np.array([features(t) for t in b.column("text").to_pylist()]).reshape(-1, FEATURES)
            yield b.filter(pa.array(model.score(x) >= threshold))

    return docs.mapInArrow(run, docs.schema)
