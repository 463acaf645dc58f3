"""Language identification: averaged hashed subword embeddings with a linear softmax."""

from __future__ import annotations

from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import fresh_names, ship_package
from .kernels import buffers, slices

SIZES = (2, 3, 4)
BUCKET_BITS = 16
_FOLD = np.arange(256, dtype=np.uint8)
for _c in range(128):
    _FOLD[_c] = ord(chr(_c).lower()) if chr(_c).isalpha() else ord(" ")


def subwords(raw: np.ndarray, offsets: np.ndarray):
    """For each size, the buckets of the folded bytes' n-grams and the first n-gram of each row.

    Letters are lower-cased and all other ASCII characters read as spaces, so an n-gram also tells a word's begin and end. N-grams of spaces only don't count (bucket -1), nor those that reach into the next row.
    """
    x = _FOLD[raw].astype(np.uint32)
    n = len(x)
    space = x == 32
    for size in SIZES:
        code, blank = np.zeros(n, np.uint32), np.ones(n, bool)
        code[:] = size
        for j in range(size):
            code[: n - j] = code[: n - j] * np.uint32(0x01000193) ^ x[j:]
            blank[: n - j] &= space[j:]
        code *= np.uint32(0x9E3779B1)
        bucket = (code >> np.uint32(32 - BUCKET_BITS)).astype(np.int32)
        bucket[blank] = -1
        for j in range(1, size):
            edge = offsets[1:] - j
            bucket[edge[(edge >= offsets[:-1])]] = -1
        yield bucket


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # buckets + 1 x languages: what a subword adds to each logit; the last row is for those that don't count
    bias: np.ndarray
    known: np.ndarray  # buckets + 1: 1 where training has seen the bucket
    temperature: float = 1.0
    least_confidence: float = 0.0
    least_known: float = 0.0

    def logits(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(logits, share of known subwords, number of subwords) of each row."""
        rows = len(offsets) - 1
        total, known, count = np.zeros((rows, len(self.languages))), np.zeros(rows), np.zeros(rows)
        full = np.flatnonzero(offsets[1:] > offsets[:-1])
        if len(full):
            start = offsets[full]
            for bucket in subwords(raw, offsets):
                total[full] += np.add.reduceat(self.table[bucket], start, axis=0)
                known[full] += np.add.reduceat(self.known[bucket], start)
                count[full] += np.add.reduceat((bucket >= 0).astype(np.float32), start)
        n = np.maximum(count, 1)
        return total / n[:, None] + self.bias, known / n, count

    def score(self, raw: np.ndarray, offsets: np.ndarray):
        """(best language, calibrated confidence, share of known subwords, accepted)."""
        z, known, count = self.logits(raw, offsets)
        z = z / self.temperature
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        best = p.argmax(axis=1)
        confidence = p[np.arange(len(p)), best]
        return best, confidence, known, (count > 0) & (confidence >= self.least_confidence) & (known >= self.least_known)


def _counts(texts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    ids, weights = [], []
    for t in texts:
        raw = np.frombuffer(t.encode(), np.uint8)
        b = np.concatenate([x[x >= 0] for x in subwords(raw, np.array([0, len(raw)]))])
        u, c = np.unique(b, return_counts=True)
        ids.append(u)
        weights.append((c / max(1, c.sum())).astype(np.float32))
    return ids, weights


def train(texts: list[str], labels: list[str], dim: int = 16, epochs: int = 12, rate: float = 4.0, batch: int = 16, seed: int = 3) -> Model:
    """Stochastic gradient descent on the cross-entropy of softmax(W mean(E[subwords]) + b)."""
    languages = sorted(set(labels))
    y = np.array([languages.index(x) for x in labels])
    ids, weights = _counts(texts)
    rng = np.random.default_rng(seed)
    emb = rng.uniform(-1 / dim, 1 / dim, (1 << BUCKET_BITS, dim)).astype(np.float32)
    w, bias = np.zeros((dim, len(languages)), np.float32), np.zeros(len(languages), np.float32)
    share = 1 / np.maximum(1, np.bincount(y, minlength=len(languages))) * len(y) / len(languages)
    some = np.array([i for i in range(len(texts)) if len(ids[i])], int)
    known = np.zeros((1 << BUCKET_BITS) + 1, np.float32)
    for u in ids:
        known[u] = 1
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        order = rng.permutation(some)
        for a in range(0, len(order), batch):
            part = order[a : a + batch]
            u = np.concatenate([ids[i] for i in part])
            f = np.concatenate([weights[i] for i in part])
            start = np.concatenate(([0], np.cumsum([len(ids[i]) for i in part])[:-1]))
            x = np.add.reduceat(emb[u] * f[:, None], start, axis=0)
            z = x @ w + bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(part)), y[part]] -= 1
            p *= (share[y[part]] / len(part))[:, None]
            g = p @ w.T
            w -= (step * (x.T @ p)).astype(np.float32)
            bias -= (step * p.sum(axis=0)).astype(np.float32)
            row = np.repeat(np.arange(len(part)), [len(ids[i]) for i in part])
            np.subtract.at(emb, u, (step * f[:, None] * g[row]).astype(np.float32))
    table = np.zeros(((1 << BUCKET_BITS) + 1, len(languages)), np.float32)
    table[:-1] = emb @ w
    table[:-1][known[:-1] == 0] = 0
    return Model(languages, table, bias, known)


def calibrate(model: Model, texts: list[str], labels: list[str], reject: float) -> Model:
    """Fit the temperature on held-out texts, then set both thresholds where a share ``reject`` of the rightly named ones lies below; neither is stricter than half of the way."""
    raw = [t.encode() for t in texts]
    offsets = np.concatenate(([0], np.cumsum([len(r) for r in raw]))).astype(np.int64)
    z, known, count = model.logits(np.frombuffer(b"".join(raw), np.uint8), offsets)
    y = np.array([model.languages.index(x) if x in model.languages else -1 for x in labels])
    ok = (count > 0) & (y >= 0)
    z, known, y = z[ok], known[ok], y[ok]
    if not len(z):
        return model

    def log_loss(t):
        s = z / t
        s = s - s.max(axis=1, keepdims=True)
        return -(s[np.arange(len(s)), y] - np.log(np.exp(s).sum(axis=1))).mean()

    model.temperature = float(min(np.geomspace(0.05, 20, 61), key=log_loss))
    s = z / model.temperature
    p = np.exp(s - s.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    right = p.argmax(axis=1) == y
    if right.any():
        half = (1 + 1 / len(model.languages)) / 2
        model.least_confidence = float(min(np.quantile(p.max(axis=1)[right], reject), half))
        model.least_known = float(min(np.quantile(known[right], reject), 0.5))
    return model


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", rows_per_label: int = 600, held_out: float = 0.3, reject: float = 0.002, most_bytes: int = 24_000_000) -> Model | None:
    """Train on a bounded sample of labelled rows: about ``rows_per_label`` a label, whole texts, taken by the hash of their ids; ``held_out`` of them calibrate.

    The rows beyond ``most_bytes`` of text in all are left out of the sample. None where no row has text and label.
    """
    labelled = docs.where(F.col(label_col).isNotNull() & (F.length(F.trim(text_col)) > 0)).select(F.col(label_col).cast("string").alias("y"), F.col(text_col).cast("string").alias("text"), F.xxhash64(F.lit(5), F.col(id_col)).alias("h"))
    counts = {r.y: r["count"] for r in labelled.groupBy("y").count().collect()}
    if not counts:
        return None
    cut = F.lit(False)
    for label, n in counts.items():
        cut = cut | ((F.col("y") == label) & (F.col("h") <= int(-(2**63) + min(1.0, rows_per_label / n) * (2**64 - 1)) if rows_per_label < n else F.col("y") == label))
    sample, size, texts, labels = labelled.where(cut).orderBy("h", "y", F.xxhash64("text")), 0, [], []
    for r in sample.toLocalIterator():
        size += len(r.text.encode())
        if size > most_bytes and len(set(labels)) == len(counts):
            break
        texts.append(r.text)
        labels.append(r.y)
    cut_at = max(1, int(len(texts) * (1 - held_out)))
    model = train(texts[:cut_at], labels[:cut_at])
    return calibrate(model, texts[cut_at:], labels[cut_at:], reject)


def _score(batches, model: Model, text_at: int, names: list[str]):
    for b in batches:
        raw, offsets = buffers(b.column(text_at))
        for i, j in slices(offsets):
            best, confidence, known, accepted = model.score(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            part = b.slice(i, j - i)
            predicted = [model.languages[k] if a else None for k, a in zip(best.tolist(), accepted.tolist())]
            extra = [pa.array(predicted, pa.string()), pa.array(confidence), pa.array(known), pa.array(accepted)]
            yield pa.RecordBatch.from_arrays([*part.columns, *extra], names)


def identify(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """``docs`` with ``predicted``, ``confidence``, ``known_share`` and ``accepted``.

    ``predicted`` is null where the model rejects: no subwords (null, empty, only ASCII symbols and digits), a calibrated probability
    below the model's bound, or too few subwords that training has seen. Without a model every row is rejected. Ties go to the
    first language in order. Repeated rows are scored alike; an empty table gives no rows. Columns pass through whatever
    their names; the new ones take leading underscores where the name is taken.
    """
    ship_package(docs.sparkSession)
    new = fresh_names(docs, "predicted", "confidence", "known_share", "accepted")
    if model is None:
        return docs.select("*", F.lit(None).cast("string").alias(new[0]), F.lit(0.0).alias(new[1]), F.lit(0.0).alias(new[2]), F.lit(False).alias(new[3]))
    plain = [f"c{i}" for i in range(len(docs.columns) + len(new))]
    kinds = [f.dataType for f in docs.schema] + [T.StringType(), T.DoubleType(), T.DoubleType(), T.BooleanType()]
    schema = T.StructType([T.StructField(n, k) for n, k in zip(plain, kinds)])
    score = partial(_score, model=model, text_at=docs.columns.index(text_col), names=plain)
    return docs.toDF(*plain[: len(docs.columns)]).mapInArrow(score, schema).toDF(*docs.columns, *new)
