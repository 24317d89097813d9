"""Packing documents into sequences by vector best-fit."""

from __future__ import annotations

import json
import zlib
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tradewinds.llm._io import materialise
from tradewinds.llm.tokencount import tokenizer

#: Parts of a length's pieces, by id: ranks are taken within a part.
SALTS = 64


@dataclass(frozen=True)
class Capacity:
    """What a sequence holds at most: tokens, pieces, and attention cost (the sum of squared piece lengths); and the weights of the three.

    The defaults are the task's: only its 2,048 tokens bind there. A piece has at least one token and squares sum to at most the square of the sum, so the
    other two limits cannot be met first; with tighter limits they choose and close bins as the tokens do.
    """

    tokens: int = 2048
    pieces: int = 2048
    attention: int = 2048 * 2048
    weights: tuple[float, float, float] = (1.0, 0.01, 0.01)


#: Parts that are encoded together; distinct parts that a worker keeps, beside those of one batch.
TOGETHER, KEPT = 512, 600_000


class Ids:
    """Token ids of texts.

    For a tokenizer that drops white space and joins nothing across it: the parts between blanks and line ends are encoded as they stand, each once, and kept.
    The parts that a batch of texts lacks are encoded together with blanks between them, and cut by the tokens' places. Other tokenizers encode whole texts.
    """

    def __init__(self, path: str):
        self.tok = tokenizer(path, plain=False)
        self.cuts = drops_blanks(path)
        self._clear()

    def _clear(self) -> None:
        self.slot: dict[str, int] = {"": 0}
        self.ids, self.upto = np.empty(1 << 16, np.uint32), np.zeros(1 << 14, np.int64)  # a slot's ids end at upto[slot + 1]

    def _learn(self, parts: list[str]) -> None:
        """Ids of new parts, in new slots."""
        for i in range(0, len(parts), TOGETHER):
            some = parts[i : i + TOGETHER]
            got = self.tok.encode_batch([" ".join(some)], add_special_tokens=False)[0]
            new = np.array(got.ids, np.uint32)
            ends = np.cumsum(np.fromiter(map(len, some), np.int64, len(some)) + 1)
            at = np.searchsorted(np.array([o[0] for o in got.offsets], np.int64), ends)
            first = len(self.slot)
            begin = self.upto[first]
            self.ids, self.upto = _room(self.ids, begin + len(new)), _room(self.upto, first + len(some) + 1)
            self.ids[begin : begin + len(new)] = new
            self.upto[first + 1 : first + len(some) + 1] = begin + at
            self.slot.update(zip(some, range(first, first + len(some))))

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one behind the other, and where each text's begin (and the last one's end). Null texts have none."""
        texts = pc.fill_null(texts, "")
        if not self.cuts:
            each = [np.array(self.tok.encode(t, add_special_tokens=False).ids, np.uint32) for t in texts.to_pylist()]
            return np.concatenate([*each, np.empty(0, np.uint32)]), np.cumsum([0, *map(len, each)])
        lists = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        parts = lists.flatten().dictionary_encode()
        known = parts.dictionary.to_pylist()
        if len(self.slot) > KEPT:
            self._clear()
        slots = np.fromiter(map(self.slot.get, known, repeat(-1)), np.int64, len(known))
        lacking = np.flatnonzero(slots < 0)
        first = len(self.slot)
        self._learn([known[i] for i in lacking.tolist()])
        slots[lacking] = np.arange(first, first + len(lacking))
        slots = slots[parts.indices.to_numpy()]
        ends = np.cumsum(pc.list_value_length(lists).to_numpy())
        del lists, parts, known
        begin = self.upto[slots]
        n = (self.upto[slots + 1] - begin).astype(np.int32)
        upto = np.concatenate(([0], np.cumsum(n, dtype=np.int64)))
        del slots
        small = np.int32 if max(len(self.ids), int(upto[-1])) < 2**31 else np.int64  # the largest arrays of a batch
        at = np.repeat((begin - upto[:-1]).astype(small), n)
        at += np.arange(upto[-1], dtype=small)
        return self.ids[at], np.concatenate(([0], upto[ends]))


def _room(x: np.ndarray, n: int) -> np.ndarray:
    return x if n <= len(x) else np.concatenate([x, np.zeros(max(n, 2 * len(x)) - len(x), x.dtype)])


def drops_blanks(path: str) -> bool:
    """Whether a tokenizer ignores case and white space and joins no characters across it, so that the parts of a text can be encoded each."""
    t = json.loads(tokenizer(path, plain=False).to_str())
    steps = (t["pre_tokenizer"] or {}).get("pretokenizers", [])
    inner = t["normalizer"] or {}
    split = steps[0] if steps else {}
    pattern = split.get("pattern", {}).get("Regex", "")
    runs = pattern.split("|")
    whole = all("\\s" not in r or r == r"[^\s\p{L}\p{N}]+" for r in runs) and " " not in pattern
    lower = any(n.get("type") == "Lowercase" for n in inner.get("normalizers", [inner]))
    special = all(not x["lstrip"] and not x["rstrip"] and not x["single_word"] and not any(c.isspace() or c.isupper() for c in x["content"]) for x in t["added_tokens"])
    return split.get("type") == "Split" and split.get("behavior") == "Removed" and split.get("invert") is True and r"[\p{L}]+" in runs and whole and lower and special and all(s.get("type") in ("Split", "ByteLevel") and not s.get("add_prefix_space") and not s.get("use_regex") for s in steps)


_ids: dict[str, Ids] = {}


def ids_of(path: str) -> Ids:
    """One for each worker, whose cache lasts over its tasks."""
    if path not in _ids:
        _ids[path] = Ids(path)
    return _ids[path]


def pieces(docs: DataFrame, path: str, tokens: int) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: each document's ids and a closing 0, cut every `tokens` ids."""

    def cut(batches):
        encode = ids_of(path)
        for batch in batches:
            cols: list[list] = [[] for _ in range(5)]
            ids, at = encode(batch.column("text"))
            at = at.tolist()
            for doc, a, b in zip(batch.column("doc_id").to_pylist(), at, at[1:]):
                raw = ids[a:b].tobytes() + b"\0\0\0\0"
                for k, at in enumerate(range(0, len(raw), 4 * tokens)):
                    part = raw[at : at + 4 * tokens]
                    for col, v in zip(cols, (doc, k, at // 4, len(part) // 4, zlib.crc32(part))):
                        col.append(v)
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select("doc_id", "text").mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


def plan(counts: dict[int, int], cap: Capacity) -> np.ndarray:
    """Vector best-fit decreasing over classes of equal pieces.

    Bins of equal content are one group with a multiplicity, so the work follows the number of lengths (at most `cap.tokens`), not of pieces. For each length,
    longest first, the group that fits under every capacity and leaves the smallest weighted norm of residuals takes pieces: one in each of
    its bins, or, in part of them, which then split off. Without such a group new bins open.
    Returns rows (length, first, bins, sequence, offset): pieces first .. first + bins - 1 of a length go to sequences sequence .. + bins - 1 at offset.
    """
    most = np.array([cap.tokens, cap.pieces, cap.attention], float)
    scale = np.array(cap.weights) / most**2
    room = np.empty((0, 3))  # of each group
    many: list[int] = []
    base: list[list[tuple[int, int]]] = []  # a group's bins: (first sequence, bins), as they split
    rows: list[tuple[int, int, int, int, int]] = []
    sequences = 0
    size = 0

    def add(residual, n, first):
        nonlocal room, size
        if size == len(room):
            room = np.vstack([room, np.full((max(64, len(room)), 3), -1.0)])
        room[size] = residual
        many.append(n)
        base.append(first)
        size += 1

    for length in sorted(counts, reverse=True):
        need = np.array([length, 1, length * length], float)
        if (need > most).any():
            raise ValueError(f"a piece of {length} tokens fits no empty sequence")
        left, done = counts[length], 0
        while left:
            after = room[:size] - need
            fits = (after >= 0).all(1)
            if fits.any():
                cost = np.where(fits, (after * after) @ scale, np.inf)
                g = int(cost.argmin())
            else:
                fill = max(1, int(min(most // need)))
                n = max(1, left // fill) if left >= fill else 1
                add(most, n, sequences)
                sequences += n
                g = size - 1
            n = min(left, many[g])
            if n < many[g]:  # part of the group stays as it is
                add(room[g].copy(), many[g] - n, base[g] + n)
                many[g] = n
            rows.append((length, done, n, base[g], int(most[0] - room[g][0])))
            room[g] = room[g] - need
            done += n
            left -= n
    return np.array(rows, np.int64).reshape(-1, 5)


def pack(docs: DataFrame, path: str, cap: Capacity = Capacity()) -> DataFrame:
    """All pieces with their sequence and the place there.

    Lengths are counted (at most `cap.tokens` of them come to the driver), the plan is made over counts, and the pieces of a length take its places
    by rank. Ranks are taken within 64 parts of a length, so no length, however common, meets in one task.
    Null texts are empty: their only id is 0. Rows with null or equal ids are packed each. An empty table gives an empty one.
    """
    cut = materialise(pieces(docs, path, cap.tokens)).withColumn("part", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(SALTS)).cast("int"))
    counts = cut.groupBy("length", "part").agg(F.count("*").alias("n"))
    placed = plan({r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}, cap)
    before = counts.select("length", "part", F.coalesce(F.sum("n").over(W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    rank = F.row_number().over(W.partitionBy("length", "part").orderBy("doc_id", "piece", "ids_crc32")) - 1
    ranked = cut.withColumn("rank", rank).join(before, ["length", "part"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("rank") + F.col("before")).alias("rank"))
    key = placed[:, 0] * (1 << 44) + placed[:, 1]
    order = np.argsort(key, kind="stable")
    key, placed = key[order], placed[order]

    def seated(batches):
        for batch in batches:
            length = batch.column("length").to_numpy(zero_copy_only=False)
            r = batch.column("rank").to_numpy(zero_copy_only=False)
            at = placed[np.searchsorted(key, length * (1 << 44) + r, "right") - 1]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")], pa.array(at[:, 3] + r - at[:, 1]), pa.array(at[:, 4])], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.mapInArrow(seated, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def report(docs: DataFrame) -> DataFrame:
    return pack(docs, default_path())
