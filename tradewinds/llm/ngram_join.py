"""N-gram Jaccard join: a MinHash LSH forest finds candidates, exact set overlaps verify them."""

from __future__ import annotations

from fractions import Fraction
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradewinds.llm._io import materialise, release
from tradewinds.llm._text import groups, mixed, shingles, word_cache

N, THRESHOLD = 5, 0.8
#: Trees of the forest, the deepest prefix and the shortest, and the recall of a pair at the threshold until which prefixes are shortened.
TREES, DEEPEST, SHORTEST, RECALL = 24, 7, 4, 0.9999
#: A run of at most so many signatures is short; longer ones are told apart by octaves.
CROWD = 64
#: A candidate pair whose signatures agree by less than the threshold minus so many standard errors is no candidate.
ERRORS = 5.0
#: Members and bytes of a block of a group; a group meets block by block.
BLOCK, BLOCK_BYTES = 512, 16 << 20
#: Rows of signatures that are compared at once; columns of the overlap product.
STEP, COLUMNS = 128, 4096
#: Bytes of a hash in a label; a label's first byte is its tree's number.
WIDTH = 2


def recall(threshold: float, depths) -> float:
    """The chance that a pair at the threshold shares a prefix of the given depth in at least one tree."""
    return 1 - float(np.prod([1 - threshold**d for d in depths]))


def shortened(crowds: np.ndarray, threshold: float, target: float = RECALL) -> np.ndarray:
    """Depths of a signature's prefixes, one a tree.

    crowds[t, d - SHORTEST]: octaves by which the run of signatures with the same prefix of d in tree t is longer than CROWD. All prefixes start at the
    deepest. The one whose next shorter run is least crowded is shortened by one, the deeper and then the earlier tree of equals, until a pair at the
    threshold has the target recall. Octaves, not counts, decide, so that a single partner hardly ever steers away from the tree where it is.
    """
    depths = np.full(len(crowds), SHORTEST + crowds.shape[1] - 1)
    while recall(threshold, depths) < target:
        open_ = np.flatnonzero(depths > SHORTEST)
        if not len(open_):
            break
        order = np.lexsort((open_, -depths[open_], crowds[open_, depths[open_] - 1 - SHORTEST]))
        depths[open_[order[0]]] -= 1
    return depths


def _coefficients(k: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240229)
    return rng.integers(1, 2**32, k, dtype=np.uint32) | np.uint32(1), rng.integers(0, 2**32, k, dtype=np.uint32)


def signature(s: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Minimum of each hash over the shingles; in slices, so memory does not grow with the text."""
    x = (mixed(s) >> np.uint64(32)).astype(np.uint32)
    out = np.full(len(a), np.uint32(0xFFFFFFFF))
    for i in range(0, len(x), 4096):
        part = x[i : i + 4096]
        for j in range(0, len(a), 20):
            np.minimum(out[j : j + 20], (part[None, :] * a[j : j + 20, None] + b[j : j + 20, None]).min(1), out=out[j : j + 20])
    return out


def fingerprint(s: np.ndarray) -> int:
    """64 bits of a set of shingles, as a long."""
    with np.errstate(over="ignore"):
        h = mixed(np.uint64(len(s)) + (mixed(s + np.uint64(0x51ED270B)) * np.arange(1, 2 * len(s), 2, dtype=np.uint64)).sum(dtype=np.uint64) if len(s) else np.uint64(0x1234567))
    return int(np.asarray(h, np.uint64).view(np.int64))


def signed(docs: DataFrame, n: int, trees: int, deepest: int) -> DataFrame:
    """doc_id, text_hash, node (fingerprint of the set), size, labels (of each tree: its number and `deepest` hashes of two bytes) and low (a byte of each hash)."""
    a, b = _coefficients(trees * deepest)

    def run(batches):
        cache = word_cache()
        label = np.empty((trees, 1 + WIDTH * deepest), np.uint8)
        label[:, 0] = np.arange(trees)
        for batch in batches:
            node, size, labels, low = [], [], [], []
            for text in batch.column("text").to_pylist():
                s = shingles(text, cache, n)
                node.append(fingerprint(s))
                size.append(len(s))
                g = ((signature(s, a, b) * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype(">u2")
                label[:, 1:] = g.view(np.uint8).reshape(trees, -1)
                labels.append(label.tobytes() if len(s) else b"")
                low.append(g.view(np.uint8)[::2].tobytes() if len(s) else b"")
            columns = [pa.array(node, pa.int64()), pa.array(size, pa.int64()), pa.array(labels, pa.binary()), pa.array(low, pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), *columns], ["doc_id", "text_hash", "node", "size", "labels", "low"])

    slim = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"), "text")
    return slim.mapInArrow(run, "doc_id long, text_hash long, node long, size long, labels binary, low binary")


def clusters(linked: np.ndarray) -> np.ndarray:
    """For each row of a symmetric matrix the smallest row that links reach."""
    n = len(linked)
    low = np.arange(n)
    while True:
        then = np.minimum(low, np.where(linked, low[None, :], n).min(1)) if n else low
        then = then[then]
        if (then == low).all():
            return low
        low = then


def _similar(low: np.ndarray, least: float) -> np.ndarray:
    """Which rows' bytes agree in at least the share `least`."""
    out = np.empty((len(low), len(low)), bool)
    for i in range(0, len(low), STEP):
        out[i : i + STEP] = (low[i : i + STEP, None, :] == low[None, :, :]).sum(2, dtype=np.int32) >= least * low.shape[1]
    return out


def sorted_runs(signs: DataFrame, trees: int, deepest: int) -> DataFrame:
    """The tries: each tree's labels in order. For each label that shares the shortest prefix with a neighbour its tree, crowds and the hashes of its prefixes.

    Labels are dealt out by range, so a run of any length is cut into many parts. A run is measured within a batch of the sorted labels, at least; what
    stands at a batch's ends is kept, as its run may go on beyond. Returns node, tree, crowds (bytes) and prefixes (longs), both from the shortest to the deepest.
    """
    width = 1 + WIDTH * deepest
    at = F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.substring("labels", t * width + 1, F.lit(width)))
    leaves = signs.where("size > 0").select(F.explode(at).alias("label"), "node")

    def run(batches):
        for batch in batches:
            node = batch.column("node").to_numpy()
            label = np.frombuffer(b"".join(batch.column("label").to_pylist()), np.uint8).reshape(-1, width)
            if not len(label):
                continue
            same = label[1:] == label[:-1]
            crowds, hashes = [], []
            h = np.full(len(label), 0x51ED, np.uint64)
            met = None
            with np.errstate(over="ignore"):
                for k in range(width):
                    h = mixed(h * np.uint64(0x9E3779B97F4A7C15) + label[:, k].astype(np.uint64) + np.uint64(1))
                    if k >= WIDTH * SHORTEST and k % WIDTH == 0:
                        start = np.concatenate(([True], ~same[:, : k + 1].all(1)))
                        of = np.cumsum(start) - 1
                        size = np.bincount(of)[of]
                        if met is None:
                            met = (size > 1) | (of == 0) | (of == of[-1])
                        crowds.append(np.ceil(np.log2(np.maximum(size / CROWD, 1))).astype(np.uint8))
                        hashes.append(h)
            where = np.flatnonzero(met)
            crowd, prefix = np.stack(crowds, 1)[where], np.stack(hashes, 1)[where].view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(node[where]), pa.array(label[where, 0].astype(np.int32)), pa.array([c.tobytes() for c in crowd], pa.binary()), pa.array(list(prefix), pa.list_(pa.int64()))], ["node", "tree", "crowds", "prefixes"]
            )

    dealt = leaves.repartitionByRange("label", "node").sortWithinPartitions("label", "node")
    return dealt.mapInArrow(run, "node long, tree int, crowds binary, prefixes array<long>")


def prefix_keys(runs: DataFrame, threshold: float, trees: int, deepest: int) -> DataFrame:
    """key, node, own: the prefixes of a signature up to the depth it was shortened to in a tree, which are its own there.

    Two signatures meet where they share a prefix of the shorter of their own depths, so each stands under its shorter prefixes too.
    """
    levels = deepest - SHORTEST + 1

    def run(batches):
        known: dict[bytes, list[int]] = {}
        for batch in batches:
            key, node, own = [], [], []
            for u, rows in zip(batch.column("node").to_pylist(), batch.column("trees").to_pylist()):
                crowds = np.zeros((trees, levels), np.uint8)
                for r in rows:
                    crowds[r["tree"]] = np.frombuffer(r["crowds"], np.uint8)
                pattern = crowds.tobytes()
                if pattern not in known:
                    if len(known) > 50_000:
                        known.clear()
                    known[pattern] = shortened(crowds, threshold).tolist()
                for r in rows:
                    depth = known[pattern][r["tree"]]
                    for d in range(SHORTEST, depth + 1):
                        key.append(r["prefixes"][d - SHORTEST])
                        node.append(u)
                        own.append(d == depth)
            yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(node, pa.int64()), pa.array(own, pa.bool_())], ["key", "node", "own"])

    gathered = runs.groupBy("node").agg(F.collect_list(F.struct("tree", "crowds", "prefixes")).alias("trees"))  # at most one a tree
    return gathered.mapInArrow(run, "key long, node long, own boolean")


def candidate_edges(signs: DataFrame, threshold: float, trees: int, deepest: int) -> DataFrame:
    """Edges (u, v) that span the classes of similar signatures under each prefix; no more edges than members."""
    bits = trees * deepest
    least = threshold - ERRORS * float(np.sqrt(threshold * (1 - threshold) / bits))
    keys = materialise(prefix_keys(sorted_runs(signs, trees, deepest), threshold, trees, deepest))
    met = materialise(keys.groupBy("key").agg(F.count("*").alias("_n"), F.max("own").alias("own")).where("_n > 1 and own").select("key", F.ceil(F.col("_n") / BLOCK).cast("int").alias("_blocks")))
    rows = keys.select("key", "node").join(met, "key").join(signs.select("node", "low"), "node")
    mine = F.pmod(F.xxhash64("node"), F.col("_blocks"))
    dealt = rows.select("key", "node", "low", mine.alias("_b"), F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)).alias("_o"))
    dealt = dealt.select("key", "node", "low", F.least("_b", "_o").cast("long").alias("bi"), F.greatest("_b", "_o").cast("long").alias("bj"))

    def run(batches):
        for g in groups(batches, ["key", "bi", "bj"]):
            node = g.column("node").to_numpy()
            if len(node) < 2:
                continue
            up = clusters(_similar(np.frombuffer(b"".join(g.column("low").to_pylist()), np.uint8).reshape(len(node), bits), least))
            own = up != np.arange(len(node))
            if own.any():
                yield pa.RecordBatch.from_arrays([pa.array(node[own]), pa.array(node[up[own]])], ["u", "v"])

    edges = materialise(dealt.repartition("key", "bi", "bj").sortWithinPartitions("key", "bi", "bj").mapInArrow(run, "u long, v long").distinct())
    release(keys)
    release(met)
    return edges


def _least(edges: DataFrame) -> DataFrame:
    """u and the smallest v of each u; written, so that the join with it can split a u with very many edges."""
    return materialise(edges.groupBy("u").agg(F.min("v").alias("m")))


def components(edges: DataFrame) -> DataFrame:
    """node, root (the smallest node reached) of all nodes of `edges`, by alternating large-star and small-star steps until nothing changes.

    Each step's edges are written to the shared folder, so no lineage grows; nothing comes to the driver but counts.
    """
    sign = lambda e: tuple(e.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first())
    now = materialise(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    state = sign(now)
    while state[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = _least(both)
        large = materialise(both.join(low.select("u", F.least("m", "u").alias("m")), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        release(low)
        low = _least(large)
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
        then = materialise(small.where("u <> v").distinct())
        release(low)
        release(large)
        release(now)
        now, last = then, state
        state = sign(now)
        if state == last:
            break
    roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    out = materialise(roots.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()))
    release(now)
    return out


def overlaps(sets: list[np.ndarray], first: int | None = None) -> np.ndarray:
    """Sizes of the intersections of all pairs; of the first `first` with the rest, if given. Shingles of one set only are left out first."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    values = np.concatenate(sets)
    _, index, counts = np.unique(values, return_inverse=True, return_counts=True)
    column = np.cumsum(counts > 1) - 1
    keep = counts[index] > 1
    owner, index = owner[keep], column[index[keep]]
    order = np.argsort(index, kind="stable")
    owner, index = owner[order], index[order]
    m = len(sets)
    left = m if first is None else first
    out = np.zeros((left, m if first is None else m - first), np.float32)
    width = int(index[-1]) + 1 if len(index) else 0
    for c in range(0, width, COLUMNS):
        a, b = np.searchsorted(index, [c, c + COLUMNS])
        x = np.zeros((m, min(COLUMNS, width - c)), np.float32)
        x[owner[a:b], index[a:b] - c] = 1
        out += x[:left] @ (x.T if first is None else x[first:].T)
    return out.astype(np.int64)


def dealt_pairs(members: DataFrame, threshold: float) -> DataFrame:
    """Members of a component dealt to pairs of blocks (c, across, bi, bj) of their root.

    Sets of which the larger has more than 1 / threshold times the shingles are never similar: with sizes classed by that ratio only sets of one class or of
    neighbouring ones meet. A class is cut into blocks of at most about BLOCK members and BLOCK_BYTES, which a single longer set has to itself. Within a
    class (across 0) each pair of blocks meets once, and each block of class c meets each of class c + 1 (across 1). left: the side of the pair.
    """
    sized = members.withColumn("cls", F.floor(F.log("size") / -log(threshold)).cast("long"))
    blocks = F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("size") * 8 / BLOCK_BYTES)).cast("long")
    counts = materialise(sized.groupBy("root", "cls").agg(blocks.alias("_own")))
    above, below = (counts.select("root", (F.col("cls") + k).alias("cls"), F.col("_own").alias(name)) for k, name in ((-1, "_above"), (1, "_below")))
    all_ = materialise(counts.join(above, ["root", "cls"], "left").join(below, ["root", "cls"], "left"))
    release(counts)
    b = F.pmod(F.xxhash64("node"), F.col("_own"))
    pair = lambda c, across, i, j, left: F.struct(c.alias("c"), F.lit(across).alias("across"), i.alias("bi"), j.alias("bj"), left.alias("left"))
    upto = lambda n: F.when(F.col(n) > 0, F.sequence(F.lit(0).cast("long"), F.col(n) - 1)).otherwise(F.array().cast("array<long>"))
    pairs = F.concat(
        F.transform(upto("_own"), lambda o: pair(F.col("cls"), 0, F.least("_b", o), F.greatest("_b", o), F.col("_b") <= o)),
        F.transform(upto("_above"), lambda o: pair(F.col("cls"), 1, F.col("_b"), o, F.lit(True))),
        F.transform(upto("_below"), lambda o: pair(F.col("cls") - 1, 1, o, F.col("_b"), F.lit(False))),
    )
    dealt = sized.join(all_, ["root", "cls"]).withColumn("_b", b).select("root", "node", "texts", "shingles", F.explode(pairs).alias("p")).select("root", "node", "texts", "shingles", "p.*")
    keys = ["root", "c", "across", "bi", "bj"]
    return dealt.repartition(*keys).sortWithinPartitions(*keys)


def links(members: DataFrame, threshold: float) -> DataFrame:
    """From root, node, size, texts, shingles (bytes): u, v (spanning edges of the true links) and links (texts that u is linked with in this pair of blocks; v is u there)."""
    share = Fraction(str(threshold))
    p, q = share.numerator, share.denominator

    def run(batches):
        for g in groups(batches, ["root", "c", "across", "bi", "bj"]):
            across = bool(g.column("across")[0].as_py()) or g.column("bi")[0].as_py() != g.column("bj")[0].as_py()
            left = g.column("left").to_numpy()
            first = int(left.sum()) if across else None
            if len(left) < 2 or across and first in (0, len(left)):
                continue
            order = np.argsort(~left, kind="stable")
            raw = g.column("shingles").to_pylist()
            sets, node, texts = [np.frombuffer(raw[i], np.uint64) for i in order], g.column("node").to_numpy()[order], g.column("texts").to_numpy()[order]
            inter = overlaps(sets, first)
            size = np.array([len(s) for s in sets])
            a, b = (size, size) if first is None else (size[:first], size[first:])
            linked = (q + p) * inter >= p * (a[:, None] + b[None, :])
            if first is None:
                np.fill_diagonal(linked, False)
            else:
                square = np.zeros((len(node), len(node)), bool)
                square[:first, first:] = linked
                linked = square | square.T
            n = linked @ texts
            up = clusters(linked)
            own, some = up != np.arange(len(node)), n > 0
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([node[own], node[some]])), pa.array(np.concatenate([node[up[own]], node[some]])), pa.array(np.concatenate([np.zeros(int(own.sum()), np.int64), n[some].astype(np.int64)]))],
                ["u", "v", "links"],
            )

    return dealt_pairs(members, threshold).mapInArrow(run, "u long, v long, links long")


def near_duplicates(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, trees: int = TREES, deepest: int = DEEPEST) -> DataFrame:
    """A row for each document: its group and its links.

    Documents whose texts have the same set of n-word shingles are one class; a text of fewer words has one shingle, and texts without words are copies of one
    another. Classes whose shingle sets have a Jaccard similarity of `threshold` or more are linked.

    Candidates come from a forest of `trees` prefix tries over MinHash signatures. Each trie is the sorted sequence of its labels; a signature's prefixes are
    shortened from the deepest, in the least crowded trees first, until a pair at the threshold meets with a chance of RECALL, and signatures under a
    shared prefix that agree well enough are candidates. Those are gathered in components, within which all sets of like size are verified whole, block by
    block; no pairs are written. Sets are told apart by 64-bit fingerprints. A text and its shingles are held whole in a Python worker.

    Returns doc_id, text_hash, copy_id (smallest id of its class), class_id (smallest id of its group of linked classes), n_links (different other texts that
    it is linked with, those of its own class included), n_copies (other documents of its class), group. Null texts are empty; null ids give null copy_id and
    class_id only where all ids of the class or group are null; equal rows are one text; an empty table gives an empty one; other columns are not read.
    """
    rows = materialise(signed(docs, n, trees, deepest))
    texts = rows.groupBy("node", "text_hash", "doc_id").agg(F.count("*").alias("n")).groupBy("node", "text_hash")
    texts = texts.agg(F.sum("n").alias("n"), F.min("doc_id").alias("doc_id"), F.min_by("n", "doc_id").alias("same"))
    totals = [F.min("doc_id").alias("copy_id"), F.sum("n").alias("n"), F.count("*").alias("texts"), F.min("text_hash").alias("_h"), F.min_by("doc_id", "text_hash").alias("_d"), F.min_by("same", "text_hash").alias("_same")]
    classes = materialise(texts.groupBy("node").agg(*totals))
    signs = materialise(rows.groupBy("node").agg(F.first("size").alias("size"), F.first("labels").alias("labels"), F.first("low").alias("low")))
    edges = candidate_edges(signs, threshold, trees, deepest)
    found = components(edges)
    release(edges)
    wanted = materialise(classes.join(found, "node").join(signs.select("node", "size"), "node").select("node", "root", "size", "texts", "_d", "_h", "_same"))
    release(found)
    release(signs)
    read = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"), "text")
    of = lambda some: read.join(some, F.expr("doc_id <=> _d and text_hash = _h")).select("root", "node", "size", "texts", "text")

    def shingled(batches):
        cache = word_cache()
        for batch in batches:
            s = [shingles(t, cache, n).tobytes() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("root", "node", "size", "texts")], pa.array(s, pa.binary())], ["root", "node", "size", "texts", "shingles"])

    # merged at every size of the input; rows that are repeated as they stand are few or equal, and are gathered first
    once = of(wanted.where("_same = 1").hint("merge")).unionByName(of(wanted.where("_same is null or _same > 1")).dropDuplicates(["node"]))
    members = materialise(once.mapInArrow(shingled, "root long, node long, size long, texts long, shingles binary"))
    true = materialise(links(members, threshold))
    release(members)
    release(wanted)
    grouped = components(true.where("u <> v").select("u", "v"))
    counts = true.groupBy("u").agg(F.sum("links").alias("linked")).select(F.col("u").alias("node"), "linked")
    n_links = F.coalesce("linked", F.lit(0)) + F.col("texts") - 1
    known = materialise(classes.join(grouped, "node", "left").join(counts, "node", "left").select("node", "copy_id", "n", F.coalesce("root", "node").alias("root"), n_links.alias("n_links")))
    for t in (classes, grouped, true):
        release(t)
    heads = materialise(known.groupBy("root").agg(F.min("copy_id").alias("class_id")))
    joined = rows.select("doc_id", "text_hash", "node").join(known, "node").join(heads, "root")
    out = materialise(joined.select("doc_id", "text_hash", "copy_id", "class_id", "n_links", (F.col("n") - 1).alias("n_copies"), F.col("root").alias("group")))
    for t in (rows, known, heads):
        release(t)
    return out


def keep_one(docs: DataFrame, **params) -> DataFrame:
    """One document of each group: the smallest id that is not null, the smallest text hash among equals; columns of `docs`."""
    rows = near_duplicates(docs, **params)
    head = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    kept = rows.groupBy("group").agg(F.min(head).alias("k")).select(F.col("k.doc_id").alias("_d"), F.col("k.text_hash").alias("_h"))
    again = rows.groupBy("doc_id", "text_hash").agg(F.count("*").alias("_n"))
    kept = materialise(kept.join(again, F.expr("_d <=> doc_id and _h = text_hash")).select("_d", "_h", "_n"))
    row = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    same = F.expr("row.doc_id <=> _d and xxhash64(coalesce(row.text, '')) = _h")
    once = row.join(kept.where("_n = 1"), same, "left_semi")
    more = row.join(kept.where("_n > 1"), same).withColumn("_k", F.to_json("row")).groupBy("_d", "_h").agg(F.min_by("row", "_k").alias("row")).select("row")
    return once.unionByName(more).select("row.*")


def report(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs).select("doc_id", "class_id", "n_links", "copy_id", "n_copies")


#: The groups by joining the classes' shingles; for tables of some thousand documents.
ORACLE = r"""
with recursive t as (
  select doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents
), d as (
  select text, any_value(w) as w from t group by text
), sets as (
  select text, list_sort(list_distinct(case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')] else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) end)) as s from d
), classes as (
  select s, len(s) as n, count(*) as texts, row_number() over (order by min(text)) as c from sets group by s
), member as (
  select text, c from sets join classes using (s)
), shingles as (
  select c, n, unnest(s) as g from classes
), pairs as (
  select a.c as a, b.c as b, any_value(a.n) as na, any_value(b.n) as nb, count(*) as i from shingles a join shingles b on a.g = b.g and a.c < b.c group by 1, 2
), linked as (
  select a, b from pairs where 9 * i >= 4 * (na + nb) union all select b, a from pairs where 9 * i >= 4 * (na + nb)
), reach as (
  select c, c as r from classes union select l.b, reach.r from reach join linked l on l.a = reach.c
), roots as (
  select c, min(r) as r from reach group by c
), near as (
  select a as c, sum(texts)::bigint as texts from linked join classes on classes.c = b group by a
), docs as (
  select doc_id, c from t join member using (text)
), copies as (
  select c, min(doc_id) as copy_id, count(*) - 1 as n_copies from docs group by c
), groups_ as (
  select r, min(copy_id) as class_id from copies join roots using (c) group by r
)
select docs.doc_id, class_id, coalesce(near.texts, 0) + classes.texts - 1 as n_links, copy_id, n_copies
from docs join classes using (c) join copies using (c) join roots using (c) join groups_ using (r) left join near using (c)
"""
