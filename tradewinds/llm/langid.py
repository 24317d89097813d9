"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradewinds.llm._io import crc_mod, materialise, release
from tradewinds.llm._learn import bounded

#: Hashed n-grams of 1 to 3 characters; share of the labelled documents that calibrates.
BITS, ORDERS, CALIBRATION = 15, 3, 0.2
#: Bounds of the sample that the weights are fitted to: labelled documents, and distinct n-grams over all of them, which are what the driver holds.
MOST_LABELLED, MOST_GRAMS = 8_000, 12_000_000
_MULT = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D))


def has_letter(text: str | None) -> bool:
    """Letters are the characters of Unicode's categories L; numerals and fractions are none."""
    return any(map(str.isalpha, text or ""))


def grams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the character n-grams of a whole text in lower case, and their counts."""
    c = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    counts = np.zeros(1 << BITS, np.int32)
    h = np.zeros(len(c), np.uint32)
    for n in range(min(ORDERS, len(c))):
        h = (h[: len(c) - n] * _MULT[0]) ^ (c[n:] * _MULT[1] + np.uint32(n))
        counts += np.bincount(((h ^ (h >> np.uint32(15))) * _MULT[2]) >> np.uint32(32 - BITS), minlength=1 << BITS).astype(np.int32)
    at = np.flatnonzero(counts)
    return at, counts[at]


def vector(text: str | None, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at, n = grams(text)
    v = (1 + np.log(n)) * idf[at]
    return at, v / max(1e-12, float(np.sqrt((v * v).sum())))


def _frequencies(batches):
    df, n = np.zeros(1 << BITS, np.int64), 0
    for batch in batches:
        for t in batch.column("text").to_pylist():
            df[grams(t)[0]] += 1
            n += 1
    at = np.flatnonzero(df)
    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([at, [-1]])), pa.array(np.concatenate([df[at], [n]]))], ["at", "n"])


def idf_of(docs: DataFrame) -> np.ndarray:
    """Inverse document frequencies over all documents that may be learned from; at most 2**BITS + 1 sums come to the driver."""
    got = docs.select("text").mapInArrow(_frequencies, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toPandas()
    df = np.zeros(1 << BITS)
    total = int(got.loc[got["at"] < 0, "n"].sum())
    known = got[got["at"] >= 0]
    df[known["at"].to_numpy()] = known["n"].to_numpy()
    return np.log((1 + total) / (1 + df)) + 1


def fit_ftrl(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, k: int, epochs: int = 2, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.1) -> np.ndarray:
    """Follow-the-regularised-leader, proximal, by coordinate: the elastic net keeps weights of small sums at 0. Column 2**BITS is the bias."""
    d = (1 << BITS) + 1
    z, n = np.zeros((k, d)), np.zeros((k, d))

    def weights(at):
        zz, nn = z[:, at], n[:, at]
        return np.where(np.abs(zz) <= l1, 0.0, -(zz - np.sign(zz) * l1) / ((beta + np.sqrt(nn)) / alpha + l2))

    for _ in range(epochs):
        for (at, v), label in zip(rows, y):
            at, v = np.append(at, d - 1), np.append(v, 1.0)
            w = weights(at)
            s = w @ v
            p = np.exp(s - s.max())
            p /= p.sum()
            p[label] -= 1
            g = p[:, None] * v[None, :]
            nn = n[:, at]
            sigma = (np.sqrt(nn + g * g) - np.sqrt(nn)) / alpha
            z[:, at] += g - sigma * w
            n[:, at] = nn + g * g
    return weights(slice(None))


def temperature(scores: np.ndarray, y: np.ndarray) -> float:
    """The divisor of the scores that makes the labels of the calibration rows likeliest."""
    if not len(y):
        return 1.0
    grid = np.exp(np.linspace(np.log(0.02), np.log(20), 141))

    def loss(t):
        s = scores / t
        top = s.max(1)
        return (np.log(np.exp(s - top[:, None]).sum(1)) + top - s[np.arange(len(y)), y]).mean()

    return float(min(grid, key=loss))


def fit(docs: DataFrame, most: int = MOST_LABELLED, most_grams: int = MOST_GRAMS) -> dict | None:
    """Model from texts with a language whose crc32 modulo 4 is not 2: IDF from all of them, weights from a bounded sample; None without any.

    The sample is one row of each of at most `most` ids, in the order of a hash, as far as their distinct n-grams stay within `most_grams`.
    """
    usable = docs.select(F.col("doc_id").alias("id"), "lang", "text").where((crc_mod(F.col("doc_id"), 4) != 2) & F.col("lang").isNotNull())
    ids = bounded(usable.select("id").distinct(), most)
    one = F.min_by(F.struct("lang", "text"), F.xxhash64("lang", "text")).alias("one")
    rows = usable.join(F.broadcast(ids), "id").groupBy("id").agg(one).select("id", "one.lang", "one.text")
    idf = idf_of(usable)

    def vectors(batches):
        for batch in batches:
            xs = [vector(t, idf) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("lang"), pa.array([len(a) for a, _ in xs], pa.int64()), pa.array([a.astype(np.int32).tobytes() for a, _ in xs], pa.binary()), pa.array([v.astype(np.float32).tobytes() for _, v in xs], pa.binary())],
                ["id", "lang", "n", "at", "v"],
            )

    table = materialise(rows.mapInArrow(vectors, "id long, lang string, n long, at binary, v binary"))
    upto = table.select("id", F.xxhash64("id").alias("h"), "n").toPandas().sort_values(["h", "id"])
    last = upto[upto["n"].cumsum() <= most_grams].tail(1).to_dict("records")
    got = table.where(" or ".join(f"xxhash64(id) < {r['h']}L or xxhash64(id) = {r['h']}L and id <= {r['id']}L" for r in last) or "false").toPandas()
    release(table)
    if not len(got):
        return None
    got = got.assign(h=[(int(i) * 2654435761) % 4294967296 for i in got["id"]]).sort_values(["h", "id", "lang", "at", "v"]).reset_index(drop=True)
    langs = sorted(set(got["lang"]))
    y = np.array([langs.index(x) for x in got["lang"]])
    xs = [(np.frombuffer(a, np.int32), np.frombuffer(v, np.float32).astype(float)) for a, v in zip(got["at"], got["v"])]
    cut = int(len(xs) * (1 - CALIBRATION)) or len(xs)
    w = fit_ftrl(xs[:cut], y[:cut], len(langs))
    held = np.array([w[:, a] @ v + w[:, -1] for a, v in xs[cut:]]).reshape(len(xs) - cut, len(langs))
    return {"langs": langs, "w": w, "idf": idf, "t": temperature(held, y[cut:])}


def predict(docs: DataFrame, model: dict | None) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every whole text; `und` with score 0 where text is null, has no letter, or no language could be learned.

    Rows with null ids are not held out; equal rows are predicted each; an empty table gives an empty one.
    """
    rows = docs.select("doc_id", F.coalesce(crc_mod(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out"), "text")

    def predicted(batches):
        for batch in batches:
            lang, score = [], []
            for t in batch.column("text").to_pylist():
                if model is None or not has_letter(t):
                    lang.append("und")
                    score.append(0.0)
                    continue
                at, v = vector(t, model["idf"])
                s = (model["w"][:, at] @ v + model["w"][:, -1]) / model["t"]
                p = np.exp(s - s.max())
                k = int(p.argmax())
                lang.append(model["langs"][k])
                score.append(float(p[k] / p.sum()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(lang, pa.string()), pa.array(score, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    return rows.mapInArrow(predicted, "doc_id long, held_out boolean, lang_pred string, score double")


def report(docs: DataFrame) -> DataFrame:
    return predict(docs, fit(docs))
