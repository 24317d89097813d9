"""Words, hashes and batches shared by the operators that work in Python."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash

#: A word: a run of characters other than space and \x09-\x0D.
WORD = r"[^\x20\x09-\x0D]+"

#: Entries of each half of a worker's cache, which bound its memory.
CACHE = 400_000

_MIX = np.uint64(0x9E3779B97F4A7C15)
_MUL = np.uint64(0xD6E8FEB86659FD93)


class Cache(dict):
    """A dictionary that computes what it lacks with `make`. At `CACHE` entries they become the older half, whose entries come back when asked for and go at the next turn."""

    def __init__(self, make: Callable):
        super().__init__()
        self.make, self.old = make, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        self.turn()
        self[key] = value
        return value

    def turn(self) -> None:
        """A full cache becomes the older half."""
        if len(self) >= CACHE:
            self.old = dict(self)
            self.clear()


def word_cache() -> Cache:
    return Cache(xxhash.xxh3_64_intdigest)


def words(text: str | None) -> list[bytes]:
    """Bytes.split() parts at exactly space and \\x09-\\x0D."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _MUL
    return x ^ (x >> np.uint64(29))


def shingles(text: str | None, cache: Cache, n: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of n words; a text of 1 to n-1 words has one shingle, its whole."""
    ws = words(text)
    if not ws:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(cache.__getitem__, ws), np.uint64, len(ws))
    k = min(n, len(h))
    out = h[: len(h) - k + 1].copy()
    with np.errstate(over="ignore"):
        for i in range(1, k):
            out = mixed(out * _MIX + h[i : len(h) - k + 1 + i])
        out = mixed(out + np.uint64(k))
    out.sort()
    return out[np.concatenate(([True], out[1:] != out[:-1]))]


def groups(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Whole groups of a partition that is sorted by `keys` (non-null longs), one table each."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(batch.schema.get_field_index(k)).to_numpy(zero_copy_only=False) for k in keys]
        new = np.zeros(batch.num_rows, bool)
        for c in cols:
            new[1:] |= c[1:] != c[:-1]
        first = tuple(c[0] for c in cols)
        if held and first != last:
            yield pa.Table.from_batches(held)
            held = []
        cuts = [0, *np.flatnonzero(new).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            if a:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
        last = tuple(c[-1] for c in cols)
    if held:
        yield pa.Table.from_batches(held)
