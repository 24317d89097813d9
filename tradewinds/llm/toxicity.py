"""Toxicity by multiple-instance learning: sentences are instances, a document is their noisy-or."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradewinds.llm._io import crc_mod, materialise, release
from tradewinds.llm._learn import Adam, bounded, labelled, sigmoid, texts_of
from tradewinds.llm._text import Cache

#: Bound of the labelled documents that the model is fitted to, one row an id.
MOST_LABELLED = 16_000
#: What a validation part of them, a share of 1 / PARTS, decides among: whether beginnings of words are features, and how many features there are.
SETTINGS, PARTS = ((False, 512), (False, 2048), (True, 512), (True, 2048)), 5
BITS = 22
#: A word's features are the word itself and its first letters, so many of them.
PREFIXES = range(3, 9)
#: A feature is weighed if its one-sided chi-square is above this and it is in so many documents.
LEAST_GAIN, LEAST_DOCS = 10.0, 4
#: A sentence ends at these marks or at a line's end; a word is a run of letters, in lower case.
SENTENCE = re.compile(r"[^.!?\n]+")
LETTERS = re.compile(r"[^\W\d_]+")
_END = 0xFFFFFFFF


def buckets(word: str) -> tuple[int, ...]:
    """Hashes of the word (even) and of its beginnings (odd)."""
    place = lambda x: (xxhash.xxh3_64_intdigest(x) >> (64 - BITS)) & ~1
    return (place(word), *(place("^" + word[:k]) | 1 for k in PREFIXES if len(word) >= k))


def _counts(batches):
    """For each feature the documents with it, by label."""
    cache = Cache(buckets)
    df = np.zeros((2, 1 << BITS), np.int32)
    for batch in batches:
        for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist()):
            ids = {b for w in set(LETTERS.findall((text or "").lower())) for b in cache[w]}
            df[int(label == 1)][np.fromiter(ids, np.int64, len(ids))] += 1
    at = np.flatnonzero(df.sum(0))
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(df[0][at]), pa.array(df[1][at])], ["at", "n0", "n1"])


def choose(sample: DataFrame, most: int) -> list[int]:
    """For words and for beginnings the `most` features with the largest one-sided chi-square of their documents against the label, by that."""
    totals = sample.agg(F.sum((F.col("label") == 1).cast("long")).alias("p"), F.count("*").alias("n")).first()
    if not totals["p"]:
        return []
    counts = sample.select("label", "text").mapInArrow(_counts, "at long, n0 int, n1 int").groupBy("at").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    n = F.col("n0") + F.col("n1")
    expected = n * (totals["p"] / totals["n"])
    gain = (F.col("n1") - expected) * (F.col("n1") - expected) / expected
    ranked = counts.where((n >= LEAST_DOCS) & (F.col("n1") > expected) & (gain > LEAST_GAIN)).select("at", gain.alias("gain"))
    best = [r for odd in (0, 1) for r in ranked.where(F.col("at") % 2 == odd).orderBy(F.col("gain").desc(), "at").limit(most).collect()]
    return [r["at"] for r in sorted(best, key=lambda r: (-r["gain"], r["at"]))]


def _bags(chosen: list[int]):
    """For each text the chosen features of its sentences: slots, each sentence that has any ended by _END, and the number of its other sentences with words."""
    slot = {b: k for k, b in enumerate(chosen)}

    def run(batches):
        cache = Cache(lambda w: [slot[b] for b in buckets(w) if b in slot])
        for batch in batches:
            out, plain = [], []
            for text in batch.column("text").to_pylist():
                ids, n = [], 0
                for s in SENTENCE.findall((text or "").lower()):
                    ws = LETTERS.findall(s)
                    if here := {k for w in ws for k in cache[w]}:
                        ids.extend(here)
                        ids.append(_END)
                    else:
                        n += bool(ws)
                out.append(np.array(ids, np.uint32).tobytes())
                plain.append(n)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), pa.array(out, pa.binary()), pa.array(plain, pa.int64())], ["id", "label", "x", "plain"])

    return run


class Bags:
    """Documents as sentences of features: `word` k of `sent`ence, `doc` of a sentence, and each document's `plain` sentences, which have none of the features."""

    def __init__(self, bags: list[np.ndarray], plain: np.ndarray, keep: np.ndarray):
        ids = np.concatenate([*bags, np.empty(0, np.uint32)])
        doc = np.repeat(np.arange(len(bags)), [len(b) for b in bags])
        end = ids == _END
        sent = np.cumsum(end) - end
        place = np.cumsum(keep) - 1
        on = ~end
        on[on] = keep[ids[on]]
        some, self.sent = np.unique(sent[on], return_inverse=True)
        self.word, self.doc = place[ids[on]], doc[end][some]
        self.n, self.m, self.k = len(bags), len(some), int(keep.sum())
        self.plain = plain + np.bincount(doc[end], minlength=self.n) - np.bincount(self.doc, minlength=self.n)

    def clean(self, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """z of each sentence, and -log P(no sentence is toxic) of each document."""
        z = np.bincount(self.sent, w[1 + self.word], self.m) + w[0]
        return z, np.maximum(np.bincount(self.doc, np.logaddexp(0, z), self.n) + self.plain * np.logaddexp(0, w[0]), 1e-12)

    def loss(self, w: np.ndarray, y: np.ndarray) -> float:
        """Mean negative log likelihood of P(doc) = 1 - prod(1 - sigmoid(z of a sentence))."""
        a = self.clean(w)[1]
        return float(np.where(y == 1, -np.log(-np.expm1(-a)), a).mean())

    def gradient(self, w: np.ndarray, y: np.ndarray) -> np.ndarray:
        z, a = self.clean(w)
        slope = np.where(y == 1, -1 / np.expm1(np.minimum(a, 40)), 1.0) / self.n
        dz = slope[self.doc] * sigmoid(z)
        return np.concatenate([[dz.sum() + (slope * self.plain).sum() * sigmoid(w[0])], np.bincount(self.word, dz[self.sent], self.k)])


def fit_mil(bags: Bags, y: np.ndarray, steps: int = 300, rate: float = 0.1, l2: float = 2e-5) -> np.ndarray:
    """A bias and the features' weights, by the likelihood of the documents."""
    w, opt = np.zeros(bags.k + 1), Adam(bags.k + 1, rate)
    w[0] = -6.0
    for _ in range(steps):
        w = opt.step(w, bags.gradient(w, y) + l2 * np.concatenate([[0], w[1:]]))
    return w


def fit(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED) -> dict | None:
    """Model from at most `most` labelled documents whose crc32 modulo 5 is not 0; None without both labels.

    Features are ranked on the training part, the setting is the one likeliest on the validation part, and the weights are of all rows.
    """
    sample = materialise(texts_of(docs, bounded(labelled(labels, "toxic", 5, 0), most)))
    part = F.pmod(F.xxhash64("id", F.lit("part")), F.lit(PARTS))
    chosen = choose(sample.where(part != 0), max(n for _, n in SETTINGS))
    rows = sample.mapInArrow(_bags(chosen), "id long, label int, x binary, plain long").withColumn("part", part).toPandas().sort_values("id").reset_index(drop=True)
    release(sample)
    y = (rows["label"].to_numpy() == 1).astype(int) if len(rows) else np.empty(0, int)
    train = rows["part"].to_numpy() != 0
    if not y[train].any() or y[train].all():
        return None
    raw, plain = [np.frombuffer(x, np.uint32) for x in rows["x"]], rows["plain"].to_numpy()
    odd = np.array(chosen, np.int64) % 2 == 1

    def kept(setting: tuple[bool, int]) -> np.ndarray:
        able = ~odd | setting[0]
        return able & (np.cumsum(able) <= setting[1])

    def some(rows_: np.ndarray, keep: np.ndarray) -> Bags:
        return Bags([x for x, on in zip(raw, rows_) if on], plain[rows_], keep)

    held = ~train if (~train).any() else train
    best = min(SETTINGS, key=lambda s: some(held, kept(s)).loss(fit_mil(some(train, kept(s)), y[train]), y[held]))
    keep = kept(best)
    w = fit_mil(some(np.ones(len(y), bool), keep), y)
    weighed = [(int(b), float(v)) for b, v in zip(np.array(chosen, np.int64)[keep], w[1:]) if abs(v) > 1e-3]
    return {"bias": float(w[0]), "weights": dict(weighed), "setting": best}


def hits(model: dict | None) -> Cache:
    """For a word its weighed features."""
    weights = model["weights"] if model else {}
    return Cache(lambda w: {b: weights[b] for b in buckets(w) if b in weights})


def offending(text: str | None, model: dict, cache: Cache) -> tuple[float, list[tuple[int, int, float]]]:
    """The document's probability and its sentences of 0.5 or more: start, end (code points, end exclusive), probability."""
    log_clean, found = 0.0, []
    base = float(np.logaddexp(0, model["bias"]))
    for m in SENTENCE.finditer(text or ""):
        ws = LETTERS.findall(m[0].lower())
        if not ws:
            continue
        hit: dict[int, float] = {}
        for w in ws:
            if found_in := cache[w]:
                hit |= found_in
        if not hit:
            log_clean -= base
            continue
        z = model["bias"] + sum(hit.values())
        p = float(sigmoid(np.float64(z)))
        log_clean -= float(np.logaddexp(0, z))
        if p >= 0.5:
            found.append((m.start(), m.end(), p))
    return -float(np.expm1(log_clean)), found


SCHEMA = "doc_id long, held_out boolean, score double, predicted int, n_offending int, offending string"


def score(docs: DataFrame, model: dict | None) -> DataFrame:
    """Every whole text's probability, verdict and offending sentences as start:end, comma-joined.

    Empty and null texts have no sentence and score 0; without a model every score is 0. Rows with null ids are not held out; equal rows score the same; an
    empty table gives an empty one.
    """
    rows = docs.select("doc_id", F.coalesce(crc_mod(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out"), "text")

    def scored(batches):
        cache = hits(model)
        for batch in batches:
            got = [offending(t, model, cache) if model else (0.0, []) for t in batch.column("text").to_pylist()]
            s = np.array([g[0] for g in got], float)
            spans = [",".join(f"{a}:{b}" for a, b, _ in g[1]) for g in got]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(s), pa.array((s >= 0.5).astype(np.int32)), pa.array([len(g[1]) for g in got], pa.int32()), pa.array(spans, pa.string())],
                ["doc_id", "held_out", "score", "predicted", "n_offending", "offending"],
            )

    return rows.mapInArrow(scored, SCHEMA)


def keep_clean(docs: DataFrame, model: dict | None) -> DataFrame:
    """The documents below 0.5, with the columns of `docs`; null and empty texts stay, of equal rows all or none."""
    schema = docs.schema

    def clean(batches):
        cache = hits(model)
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
            yield batch.filter(pa.array([not model or offending(t, model, cache)[0] < 0.5 for t in texts], pa.bool_()))

    return docs.mapInArrow(clean, schema)


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, fit(docs, labels))
