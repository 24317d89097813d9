"""Quality by positive-unlabelled learning with the non-negative risk."""

from __future__ import annotations

import zlib
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradewinds.llm._io import crc_mod
from tradewinds.llm._learn import Adam, bounded, labelled, sigmoid, texts_of, unlabelled

#: Bounds of the samples that the model is fitted to: positives and unlabelled documents, one row an id.
MOST_POSITIVE, MOST_UNLABELLED = 12_000, 24_000
#: Rates and penalties of the risk minimiser, among which a validation part of the samples decides; its share is 1 / PARTS.
SETTINGS, PARTS = ((0.1, 1e-6), (0.1, 1e-4), (0.03, 1e-5)), 5

#: Classes of bytes whose pairs describe a text's typography.
_CLASSES = [b"", b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" ", b"\n", b"\t\r\x0b\x0c", b".,", b"!?", b";:'\"()", b"#*$%&", b"|<>=~^_@/\\", bytes(range(128, 256))]
N_CLASSES = len(_CLASSES)
_TABLE = np.zeros(256, np.uint8)
for _i, _chars in enumerate(_CLASSES):
    _TABLE[list(_chars)] = _i
N_FEATURES = N_CLASSES**2 + 8


def features(text: str | None) -> np.ndarray:
    """Square roots of the shares of pairs of byte classes, and eight figures of length and repetition, over the whole text."""
    out = np.zeros(N_FEATURES, np.float32)
    raw = (text or "").encode("utf-8", "surrogatepass")
    if len(raw) > 1:
        c = _TABLE[np.frombuffer(raw, np.uint8)]
        pairs = np.bincount(c[:-1].astype(np.int16) * N_CLASSES + c[1:], minlength=N_CLASSES**2)
        out[: N_CLASSES**2] = np.sqrt(pairs / (len(raw) - 1))
    ws = raw.split()
    lines = [x for x in raw.split(b"\n") if x.strip()]
    n, m = len(ws), len(lines)
    pairs = len(set(zip(ws, ws[1:])))
    out[-8:] = (sum(map(eq, ws, ws[1:])) / n if n else 0, pairs / (n - 1) if n > 1 else 1, np.log1p(n) / 5, n < 20, len(set(ws)) / n if n else 0, (m - len(set(lines))) / m if m else 0, np.log1p(m) / 5, len(raw) / n / 10 if n else 0)
    return out


def _featurised(batches):
    for batch in batches:
        x = [features(t).tobytes() for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(x, pa.binary())], ["label", "x"])


def fit_nnpu(pos: np.ndarray, unl: np.ndarray, prior: float, steps: int = 800, rate: float = 0.1, l2: float = 1e-6) -> dict:
    """Minimise prior * R_p^+ + max(0, R_u^- - prior * R_p^-) of the logistic loss over a linear score; where the second part is negative, step against it."""
    both = np.concatenate([pos, unl])
    mean, std = both.mean(0), both.std(0) + 1e-2
    p, u = (pos - mean) / std, (unl - mean) / std
    w, opt = np.zeros(pos.shape[1] + 1), Adam(pos.shape[1] + 1, rate)
    for _ in range(steps):
        w = opt.step(w, risk_gradient(w, p, u, prior) + l2 * np.concatenate([[0], w[1:]]))
    return {"w": (w[1:] / std), "b": float(w[0] - (w[1:] * mean / std).sum()), "prior": prior}


def risk_gradient(w: np.ndarray, p: np.ndarray, u: np.ndarray, prior: float) -> np.ndarray:
    """The direction to step against: the gradient of the risk, or, where R_u^- < prior * R_p^-, that of prior * R_p^- - R_u^-."""
    zp, zu = p @ w[1:] + w[0], u @ w[1:] + w[0]
    negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
    gp, gu = -prior * sigmoid(-zp) / len(p), sigmoid(zu) / len(u)
    rest = -prior * sigmoid(zp) / len(p)
    a, b = (gp + rest, gu) if negative >= 0 else (-rest, -gu)
    return np.concatenate([[a.sum() + b.sum()], a @ p + b @ u])


def risk(model: dict, pos: np.ndarray, unl: np.ndarray) -> float:
    """The non-negative risk of the sigmoid loss."""
    lp, lu = sigmoid(pos @ model["w"] + model["b"]), sigmoid(unl @ model["w"] + model["b"])
    return model["prior"] * (1 - lp).mean() + max(0.0, lu.mean() - model["prior"] * lp.mean())


def class_prior(pos: np.ndarray, unl: np.ndarray, delta: float = 0.1) -> float:
    """The share of positives among unlabelled texts, from the scores of both by a classifier of positives against unlabelled: the best-bin estimate.

    Above any score, the share of unlabelled texts over that of positives bounds the prior from above; it is tight where negatives do not score. The
    score is taken whose ratio, with the uncertainty of both shares added, is least.
    """
    cuts = np.unique(pos)
    qp = 1 - np.searchsorted(np.sort(pos), cuts) / len(pos)
    qu = 1 - np.searchsorted(np.sort(unl), cuts) / len(unl)
    spread = np.sqrt(np.log(4 / delta) / 2) * (1 / np.sqrt(len(pos)) + 1 / np.sqrt(len(unl)))
    k = int(((qu + 1.01 * spread) / qp).argmin())
    return float(min(0.98, max(0.02, qu[k] / qp[k])))


def fit_samples(pos: np.ndarray, unl: np.ndarray, part_p: np.ndarray, part_u: np.ndarray) -> dict:
    """Prior, rate and penalty from the validation parts (part 0), without any other label than the positives'; the model from all rows."""
    tp, tu, vp, vu = pos[part_p != 0], unl[part_u != 0], pos[part_p == 0], unl[part_u == 0]
    if not min(map(len, (tp, tu, vp, vu))):
        tp, tu, vp, vu = pos, unl, pos, unl
    against = fit_against(tp, tu)
    prior = class_prior(vp @ against["w"] + against["b"], vu @ against["w"] + against["b"])
    rate, l2 = min(SETTINGS, key=lambda s: risk(fit_nnpu(tp, tu, prior, 400, *s), vp, vu))
    return fit_nnpu(pos, unl, prior, 800, rate, l2)


def fit_against(pos: np.ndarray, unl: np.ndarray, steps: int = 300, rate: float = 0.1) -> dict:
    """Logistic regression of positives against unlabelled texts, both weighing the same."""
    both = np.concatenate([pos, unl])
    mean, std = both.mean(0), both.std(0) + 1e-2
    p, u = (pos - mean) / std, (unl - mean) / std
    w, opt = np.zeros(pos.shape[1] + 1), Adam(pos.shape[1] + 1, rate)
    for _ in range(steps):
        a, b = -sigmoid(-(p @ w[1:] + w[0])) / len(p), sigmoid(u @ w[1:] + w[0]) / len(u)
        w = opt.step(w, np.concatenate([[a.sum() + b.sum()], a @ p + b @ u]))
    return {"w": (w[1:] / std), "b": float(w[0] - (w[1:] * mean / std).sum())}


def fit(docs: DataFrame, labels: DataFrame, most_positive: int = MOST_POSITIVE, most_unlabelled: int = MOST_UNLABELLED) -> dict | None:
    """Model of label 1 from at most `most_positive` trusted positives and `most_unlabelled` unlabelled texts; None without positives.

    Negatives serve for nothing. The class prior is estimated from the two samples.
    """
    positive = labelled(labels, "quality", 3, 1).where("label = 1")
    ids = bounded(positive, most_positive).unionByName(unlabelled(docs, 3, 1, most_unlabelled))
    rows = texts_of(docs, ids).select("label", "text").mapInArrow(_featurised, "label int, x binary").toPandas()
    raw = {y: sorted(rows["x"][rows["label"] == y]) for y in (1, -1)}
    if not raw[1] or not raw[-1]:
        return None
    x = {y: np.frombuffer(b"".join(v), np.float32).reshape(len(v), -1) for y, v in raw.items()}
    part = {y: np.array([zlib.crc32(r) % PARTS for r in v]) for y, v in raw.items()}
    return fit_samples(x[1], x[-1], part[1], part[-1])


def score(docs: DataFrame, model: dict | None) -> DataFrame:
    """doc_id, held_out, score, predicted of every whole text. Null texts score as empty ones; without a model every score is 0.5.

    Rows with null ids are not held out; equal rows score the same; an empty table gives an empty one.
    """
    rows = docs.select("doc_id", F.coalesce(crc_mod(F.col("doc_id"), 3) == 1, F.lit(False)).alias("held_out"), "text")

    def scored(batches):
        for batch in batches:
            texts = batch.column("text").to_pylist()
            if model is None:
                s = np.full(len(texts), 0.5)
            else:
                x = np.array([features(t) for t in texts]).reshape(len(texts), N_FEATURES)
                s = sigmoid(x @ model["w"] + model["b"])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return rows.mapInArrow(scored, "doc_id long, held_out boolean, score double, predicted int")


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, fit(docs, labels))
