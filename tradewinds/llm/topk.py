"""Exact top-k by inner product with a table of distances to pivots."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tradewinds.llm._io import append, empty_table, materialise, release, reread

#: Pivots; bounded sample that they are chosen from; rows of a block of candidates; queries of a round, on average; candidates of a chunk, that share ranges of
#: distances; pivots that a block's chunks are held against at once, and the share of pairs of query and chunk that each such step must rule out for the next
#: one to pay; queries scored at once.
PIVOTS, SAMPLE, BLOCK, ROUND, CHUNK, STEP, PAYS, TILE = 128, 8_000, 2_048, 4_096, 64, 16, 0.1, 256

#: The least long: a floor that every score reaches.
LEAST = -(2**63)


def quantised(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id, dim, v: floor(scale * x) of each component. Vectors that are null or hold a null or non-finite component are left out, null ids too; empty ones have dimension 0."""
    x = F.col("embedding")
    bad = F.exists(x, lambda e: e.isNull() | F.isnan(e) | (F.abs(e.cast("double")) == float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("embedding")).where(x.isNotNull() & F.col("vec_id").isNotNull() & ~bad)
    return rows.select("vec_id", F.size("embedding").alias("dim"), F.transform("embedding", lambda e: F.floor(e.cast("double") * scale).cast("double")).alias("v"))


def _by_dim(rows: pa.Table | pa.RecordBatch):
    """dim, ids and the matrix of each dimension of vec_id, dim, v."""
    if isinstance(rows, pa.Table):
        if not rows.num_rows:
            return
        rows = rows.combine_chunks().to_batches()[0]
    dims, ids = rows.column("dim").to_numpy(), rows.column("vec_id").to_numpy()
    flat = rows.column("v").flatten().to_numpy(zero_copy_only=False).astype(float)
    start = np.cumsum(dims, dtype=np.int64) - dims
    for d in np.unique(dims).tolist():
        at = np.flatnonzero(dims == d)
        yield d, ids[at], flat[start[at][:, None] + np.arange(d)].reshape(len(at), d)


def choose_pivots(x: np.ndarray, n: int) -> np.ndarray:
    """Farthest-first from the vector farthest from the mean."""
    if not len(x):
        return x
    at = [int(((x - x.mean(0)) ** 2).sum(1).argmax())]
    near = ((x - x[at[0]]) ** 2).sum(1)
    while len(at) < min(n, len(x)) and near.max() > 0:
        at.append(int(near.argmax()))
        near = np.minimum(near, ((x - x[at[-1]]) ** 2).sum(1))
    return x[at]


class Space:
    """The pivots of a dimension. `radius2`: the largest squared norm of a candidate; one more coordinate lifts every candidate to it."""

    def __init__(self, pivots: np.ndarray, radius2: float):
        self.pivots, self.radius2 = pivots, radius2
        self.lift = np.sqrt(np.maximum(radius2 - (pivots * pivots).sum(1), 0))

    def distances(self, x: np.ndarray, lifted: bool) -> np.ndarray:
        """Distances to the pivots of candidates (lifted) or queries (at 0)."""
        n2 = (x * x).sum(1)
        lift = np.sqrt(np.maximum(self.radius2 - n2, 0)) if lifted else np.zeros(len(x))
        p = self.pivots
        d = n2[:, None] + (p * p).sum(1)[None, :] - 2 * x @ p.T + (lift[:, None] - self.lift[None, :]) ** 2
        return np.sqrt(np.maximum(d, 0))

    def upper(self, q2: np.ndarray | float, low: np.ndarray) -> np.ndarray:
        """The largest score of a query with squared norm q2 and candidates at a distance of `low` or more; with room for rounding."""
        return (q2 + self.radius2 - low * low) / 2 + 1e-6 * (self.radius2 + q2) + 1


def scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Integer inner products, exact: doubles while every sum stays below 2**53, else Python integers, held to the range of a long."""
    if q.size and x.size and float(np.abs(q).max()) * float(np.abs(x).max()) * q.shape[-1] >= 2**53:
        exact = [[sum(int(a) * int(b) for a, b in zip(u, v)) for v in x] for u in q]
        return np.array([[max(-(2**63), min(2**63 - 1, s)) for s in row] for row in exact], object)
    return (q @ x.T).astype(np.int64)


class Block:
    """Candidates with the ranges of their precomputed distances to the pivots, as a whole and by chunks of CHUNK."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, dx: np.ndarray):
        self.ids, self.x = ids, x
        self.edges = np.arange(0, len(ids), CHUNK)
        self.lows, self.highs = (f.reduceat(dx, self.edges, axis=0).astype(float) if len(ids) else np.zeros(dx.shape) for f in (np.minimum, np.maximum))
        self.low, self.high = (self.lows.min(0), self.highs.max(0)) if len(ids) else (np.zeros(dx.shape[1]), np.zeros(dx.shape[1]))
        self.norm = float(np.sqrt(np.einsum("ij,ij->i", x, x, dtype=float).max())) if x.size else 0.0
        self.most = float(np.abs(x).max()) if x.size else 0.0
        self.order = np.argsort(ids, kind="stable")
        self.sorted = ids[self.order]
        starts = np.flatnonzero(np.r_[True, self.sorted[1:] != self.sorted[:-1]]) if len(ids) else np.zeros(1, int)
        self.repeats = int(np.diff(np.r_[starts, len(ids)]).max())  # rows of the most frequent id


class Best:
    """The k best candidates so far of each query, one entry an id, best first, and the score that another one has to reach."""

    def __init__(self, k: int, floor: np.ndarray):
        self.k, n = k, len(floor)  # floor: a score that each query's k-th candidate is known to reach
        self.floor = np.array([LEAST if f == -np.inf else int(f) for f in floor.tolist()], np.int64)
        self.n, self.ids, self.scores = np.zeros(n, np.int64), np.zeros((n, k), np.int64), np.zeros((n, k), np.int64)

    @property
    def found(self) -> list[dict[int, int]]:
        return [dict(zip(i[:n].tolist(), s[:n].tolist())) for n, i, s in zip(self.n, self.ids, self.scores)]

    def rows(self, at: np.ndarray | slice = slice(None)) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query, id and score of each entry of some queries; a query is its place in `at`."""
        r, c = np.nonzero(np.arange(self.k) < self.n[at][:, None])
        return r, self.ids[at][r, c], self.scores[at][r, c]

    def add(self, i: np.ndarray, ids: np.ndarray, s: np.ndarray) -> None:
        """Candidates of queries i; those that cannot enter are left out here."""
        full = self.n[i] == self.k
        stay = (s >= self.floor[i]) & ~(full & (s == self.scores[i, -1]) & (ids >= self.ids[i, -1]))
        i, ids, s = i[stay], ids[stay], s[stay]
        if not len(i):
            return
        at, place = np.unique(i, return_inverse=True)
        r, old, old_s = self.rows(at)
        r, ids, s = np.concatenate([r, place]), np.concatenate([old, ids]), np.concatenate([old_s, s])
        by = np.lexsort((~s, ids, r))  # ~s: descending
        r, ids, s = r[by], ids[by], s[by]
        first = np.r_[True, (r[1:] != r[:-1]) | (ids[1:] != ids[:-1])]
        r, ids, s = r[first], ids[first], s[first]
        by = np.lexsort((ids, ~s, r))
        r, ids, s = r[by], ids[by], s[by]
        n = np.bincount(r, minlength=len(at))
        rank = np.arange(len(r)) - (np.cumsum(n) - n)[r]
        keep = rank < self.k
        self.ids[at[r[keep]], rank[keep]], self.scores[at[r[keep]], rank[keep]] = ids[keep], s[keep]
        self.n[at] = np.minimum(n, self.k)
        full = at[n >= self.k]
        self.floor[full] = np.maximum(self.floor[full], self.scores[full, -1])


def _score(q_ids: np.ndarray, q: np.ndarray, rows: np.ndarray, block: Block, lo: int, hi: int, best: Best, kind: type) -> None:
    """Score queries `rows` with candidates lo to hi by one product of matrices and add what reaches their floors."""
    ids, x = block.ids[lo:hi], block.x[lo:hi]
    s = q[rows].astype(kind) @ x.astype(kind, copy=False).T if kind is not object else scores(q[rows], x).astype(np.int64)
    own = np.searchsorted(block.sorted, q_ids[rows]), np.searchsorted(block.sorted, q_ids[rows], side="right")
    mine = np.zeros(s.shape, bool) if (own[1] > own[0]).any() else None
    for i in np.flatnonzero(own[1] > own[0]).tolist():
        at = block.order[own[0][i] : own[1][i]]
        mine[i, at[(at >= lo) & (at < hi)] - lo] = True
    reach = best.floor[rows].astype(s.dtype)
    hit = s >= reach[:, None]
    if mine is not None:
        hit &= ~mine
    least = best.k * block.repeats  # so many rows have k ids at least
    many = np.flatnonzero(np.count_nonzero(hit, axis=1) > least)
    if len(many):
        top = np.where(hit[many], s[many], reach[many][:, None])
        hit[many] &= top >= np.partition(top, -least, axis=1)[:, -least][:, None]
    r, c = np.nonzero(hit)
    if len(r):
        best.add(rows[r], ids[c], s[r, c].astype(np.int64))


def search(space: Space, q_ids: np.ndarray, q: np.ndarray, dq: np.ndarray, block: Block, best: Best) -> int:
    """Add the candidates of a block that may be among the k best; returns how many were scored.

    With all candidates lifted to one norm, score = (|q|^2 + radius2 - d^2) / 2, and d is at least the largest |d(q, pivot) - d(x, pivot)|: an upper bound of
    the score. A query whose bound over the whole block is below its k-th score leaves the block. Else the same is asked of each chunk of the block, with STEP
    pivots at a time, those farthest from the block's distances first, as long as they rule chunks out. What is left is scored, chunks in order of the bound
    where some were ruled out, by products of matrices, which cost less than a bound for each candidate.
    """
    if not len(q) or not len(block.ids):
        return 0
    q2 = (q * q).sum(1)

    def may(rows, low):
        """The bound of queries at a distance of `low` or more; no score is below the least long."""
        return np.maximum(space.upper(q2[rows] if low.ndim == 1 else q2[rows][:, None], low), float(LEAST))

    some = np.arange(len(q))
    if dq.shape[1]:
        gap = np.maximum(block.low - dq, dq - block.high).max(1)
        some = np.flatnonzero(may(some, np.maximum(gap, 0)) >= best.floor)
    if not len(some):
        return 0
    low = np.zeros((len(some), len(block.edges)))
    left = low.size
    if len(block.edges) > 1 and (best.floor[some] > LEAST).any():
        order = np.argsort(-np.abs(dq[some] - (block.low + block.high) / 2).mean(0), kind="stable")
        for a in range(0, len(order), STEP):
            by = order[a : a + STEP]
            for j in by.tolist():
                d = dq[some, j][:, None]
                np.maximum(low, block.lows[:, j] - d, out=low)
                np.maximum(low, d - block.highs[:, j], out=low)
            before, left = left, int((may(some, low) >= best.floor[some][:, None]).sum())
            if not left or before - left < PAYS * before:
                break
    if left > (1 - PAYS) * low.size:
        parts, bound = [(0, len(block.ids))], np.full((len(some), 1), np.inf)
    else:
        parts, bound = [(a, min(a + CHUNK, len(block.ids))) for a in block.edges.tolist()], may(some, low)
    # exact in floats: every sum of products is at most the product of the norms, or of the largest components and the dimension
    norm, most = np.sqrt(q2), np.abs(q).max(1) if q.shape[1] else np.zeros(len(q))
    single = (norm * block.norm < 2**24) & (norm < 2**24) & (block.norm < 2**24)
    double = most * block.most * q.shape[1] < 2**53
    scored = 0
    for p in np.argsort(-bound.mean(0), kind="stable").tolist():
        lo, hi = parts[p]
        rows = some[bound[:, p] >= best.floor[some]]
        for kind, of in ((np.float32, rows[single[rows]]), (np.float64, rows[~single[rows] & double[rows]]), (object, rows[~single[rows] & ~double[rows]])):
            for a in range(0, len(of), TILE):
                _score(q_ids, q, of[a : a + TILE], block, lo, hi, best, kind)
        scored += len(rows) * (hi - lo)
    return scored


TABLE = "dim int, first int, last int, ids binary, wide boolean, v binary, dx binary"


def _rows(ids: np.ndarray, dim: int, cell: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), dim, np.int32)), pa.array(cell.astype(np.int32)), pa.array(ids), pa.array([r.tobytes() for r in x], pa.binary())], ["dim", "cell", "vec_id", "v"])


def pivot_table(rows: DataFrame, spaces: dict[int, Space]) -> DataFrame:
    """Blocks of candidates of one dimension that lie together, by nearest pivot, with their distances to all pivots: written once.

    Rows are dealt out by range of (dimension, nearest pivot, hash), so a pivot with very many candidates is split.
    """

    def near(batches):
        for batch in batches:
            for dim, ids, x in _by_dim(batch):
                dx = spaces[dim].distances(x, True)
                yield _rows(ids, dim, dx.argmin(1) if dx.shape[1] else np.zeros(len(ids)), x)

    def packed(batches):
        for batch in batches:
            dims, cells, ids = (batch.column(c).to_numpy() for c in ("dim", "cell", "vec_id"))
            raw = batch.column("v").to_pylist()
            edges = [0, *(np.flatnonzero(np.diff(dims)) + 1).tolist(), len(dims)]
            for lo, hi in zip(edges, edges[1:]):
                for a in range(lo, hi, BLOCK):
                    b = min(a + BLOCK, hi)
                    dim = int(dims[a])
                    x = np.frombuffer(b"".join(raw[a:b])).reshape(b - a, dim)
                    wide = bool(x.size and np.abs(x).max() >= 2**24)
                    dx = spaces[dim].distances(x, True).astype(np.float32)
                    lie = np.lexsort((dx.min(1) if dx.shape[1] else np.zeros(b - a), cells[a:b]))  # chunks that lie together
                    x, dx = x[lie], dx[lie]
                    one = [dim, int(cells[a]), int(cells[b - 1]), ids[a:b][lie].astype(np.int64).tobytes(), wide, (x if wide else x.astype(np.float32)).tobytes(), dx.tobytes()]
                    types = [pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.bool_(), pa.binary(), pa.binary()]
                    yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(one, types)], ["dim", "first", "last", "ids", "wide", "v", "dx"])

    dealt = rows.mapInArrow(near, "dim int, cell int, vec_id long, v binary").repartitionByRange("dim", "cell", F.xxhash64("vec_id", "v"))
    return materialise(dealt.sortWithinPartitions("dim", "cell").mapInArrow(packed, TABLE))


def _blocks(batches, spaces: dict[int, Space]):
    for batch in batches:
        for r in batch.to_pylist():
            ids = np.frombuffer(r["ids"], np.int64)
            x = np.frombuffer(r["v"], np.float64 if r["wide"] else np.float32).reshape(len(ids), r["dim"])
            yield r, Block(ids, x, np.frombuffer(r["dx"], np.float32).reshape(len(ids), len(spaces[r["dim"]].pivots)))


def top_k(vectors: DataFrame, every: int = 50, k: int = 5, pivots: int = PIVOTS) -> DataFrame:
    """Queries are the rows whose id is divisible by `every`; candidates all rows but those of the query's id.

    Pivots are chosen from a sample of SAMPLE rows. The pivot table is written once. Queries come in rounds of about ROUND, the only part of them that the
    driver holds; a round goes over the table twice: first each query meets the blocks of its nearest pivot, which gives a score that its k-th candidate
    reaches, then all blocks, from which that score and the pivots' bounds rule candidates out. Each task returns at most k candidates a query.

    Repeated ids are queries and candidates each (the result has one list an id, over all its vectors, a candidate's best score counting; equal rows once).
    Vectors of different lengths are never compared; empty vectors score 0 with one another. Ties go to smaller ids. Fewer than k candidates give fewer
    rows; an empty table gives none; columns other than vec_id and embedding are not read.
    Returns query_id, rank, vec_id, score.
    """
    spark = vectors.sparkSession
    rows = quantised(vectors)
    norms = rows.groupBy("dim").agg(F.max(F.aggregate("v", F.lit(0.0), lambda a, e: a + e * e)).alias("r2"))
    radius = {r["dim"]: float(r["r2"]) for r in norms.collect()}  # one row a dimension
    found = empty_table(spark, "query_id long, score long, vec_id long")
    if radius:
        sample = rows.orderBy(F.xxhash64("vec_id", "v"), "vec_id").limit(SAMPLE).toArrow()
        chosen = {d: choose_pivots(x, pivots) for d, _, x in _by_dim(sample)}
        spaces = {d: Space(chosen.get(d, np.zeros((0, d))), r2) for d, r2 in radius.items()}
        table = pivot_table(rows, spaces)
        queries = materialise(rows.where(F.col("vec_id") % every == 0).distinct())
        rounds = -(-queries.count() // ROUND)
        for r in range(rounds):
            mine = queries.where(F.pmod(F.xxhash64("vec_id", "v"), F.lit(rounds)) == r).toArrow()
            append(_round(table, {d: (ids, x) for d, ids, x in _by_dim(mine)}, spaces, k), found)
        release(queries)
        release(table)
    best = reread(found).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _round(table: DataFrame, queries: dict, spaces: dict[int, Space], k: int) -> DataFrame:
    """Candidates of a round of queries: by task at most k a query, all that are among the k best of all."""
    dq = {d: spaces[d].distances(x, False) for d, (_, x) in queries.items()}

    def nearest(batches):
        for r, block in _blocks(batches, spaces):
            if r["dim"] not in queries:
                continue
            ids, x = queries[r["dim"]]
            d = dq[r["dim"]]
            cell = d.argmin(1) if d.shape[1] else np.zeros(len(ids))
            at = np.flatnonzero((cell >= r["first"]) & (cell <= r["last"]))
            best = Best(k, np.full(len(at), LEAST, np.int64))
            search(spaces[r["dim"]], ids[at], x[at], d[at], block, best)
            i, x, s = best.rows()
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), r["dim"], np.int32)), pa.array(at[i].astype(np.int32)), pa.array(s), pa.array(x)], ["dim", "row", "score", "vec_id"])

    def every(batches):
        best = {d: Best(k, floor[d].copy()) for d in queries}
        for r, block in _blocks(batches, spaces):
            if r["dim"] in queries:
                ids, x = queries[r["dim"]]
                search(spaces[r["dim"]], ids, x, dq[r["dim"]], block, best[r["dim"]])
        for d, b in best.items():
            i, x, s = b.rows()
            yield pa.RecordBatch.from_arrays([pa.array(queries[d][0][i]), pa.array(s), pa.array(x)], ["query_id", "score", "vec_id"])

    floor = {d: np.full(len(ids), LEAST, np.int64) for d, (ids, _) in queries.items()}
    near = table.mapInArrow(nearest, "dim int, row int, score long, vec_id long").groupBy("dim", "row", "vec_id").agg(F.max("score").alias("score"))
    place = F.row_number().over(W.partitionBy("dim", "row").orderBy(F.col("score").desc()))
    for r in near.withColumn("place", place).where(F.col("place") == k).collect():  # at most one a query of the round
        floor[r["dim"]][r["row"]] = r["score"]
    return table.mapInArrow(every, "query_id long, score long, vec_id long")


ORACLE = """
with v as (
  select vec_id, list_transform(embedding, lambda e: floor(256 * e::double)) as x from embeddings
  where embedding is not null and vec_id is not null and len(list_filter(embedding, lambda e: e is null or isnan(e) or isinf(e))) = 0
), s as (
  select q.vec_id as query_id, c.vec_id, list_inner_product(q.x, c.x)::bigint as score
  from v q join v c on q.vec_id % 50 = 0 and q.vec_id <> c.vec_id and len(q.x) = len(c.x)
)
select query_id, (row_number() over (partition by query_id order by score desc, vec_id))::int as rank, vec_id, score
from s qualify rank <= 5
"""
