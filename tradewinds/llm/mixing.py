"""Mixing sources to target weights by systematic sampling; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tradewinds.llm._io import materialise
from tradewinds.llm._text import WORD

#: Strata of a source's documents: octaves of the size cut in STEPS, each dealt out to SALTS parts by the id.
STEPS, SALTS = 8, 256
#: The strata's table is broadcast if it has been counted and has at most so many rows (some 60 bytes each); else rows are joined by shuffle.
MOST_BROADCAST = 100_000


def n_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """Targets of sources.

    `sizes` has one row a source: source, source_size (long). Sources by code point, null last, weigh `weights`, repeating. They share the
    sum of all sizes by weight; a target stops at `most` times its source's size, and the excess is shared again by weight until none is above.
    Ranking all sources is one task's work over a row of some 50 bytes each.
    The fixed point is min(most * size, weight * level); the level follows from sorting the sources by most * size / weight.
    Returns source, source_size, target (double). No rows for no sources; a source of size 0 has target 0.
    """
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.select("source", "source_size", (F.row_number().over(by_name) - 1).alias("_i"))
    ranked = ranked.withColumn("_w", F.element_at(F.array(*map(F.lit, weights)), (F.col("_i") % len(weights) + 1).cast("int")).cast("double"))
    ranked = ranked.withColumn("_cap", (F.col("source_size") * most).cast("double"))
    by_cap = W.orderBy(F.col("_cap") / F.col("_w"), "_i")
    before, onward = by_cap.rowsBetween(W.unboundedPreceding, -1), by_cap.rowsBetween(0, W.unboundedFollowing)
    level = ranked.select(
        "*",
        (F.sum("source_size").over(W.partitionBy()).cast("double") - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))).alias("_left"),
        F.sum("_w").over(onward).alias("_rest"),
    )
    level = level.withColumn("_fits", F.when(F.col("_left") * F.col("_w") <= F.col("_cap") * F.col("_rest"), F.struct("_i", "_left", "_rest")))
    level = level.withColumn("_level", F.first("_fits", ignorenulls=True).over(by_cap.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    target = F.least(F.col("_cap"), F.col("_w") * F.col("_level._left") / F.col("_level._rest"))
    return level.select("source", "source_size", F.coalesce(target, F.col("_cap")).alias("target"))


def offset(source: Column, seed: str) -> Column:
    """The random offset of a source: a multiple of 2**-20 in [0, 1), so that sums with whole ratios are exact."""
    digest = F.md5(F.concat(F.lit(seed), F.coalesce(source, F.lit("\x00"))).cast("binary"))
    return F.conv(F.substring(digest, 1, 5), 16, 10).cast("double") / 1048576


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3, seed: str = "mix", carry: list[str] | None = None) -> DataFrame:
    """Each document with the number of copies that the mix takes of it.

    A document's expected copies are its source's target over its source's size. Documents of a source stand in order of size octave,
    part and id; the expected copies are summed as prefixes, one offset is added, and a document is emitted once for each integer that its
    interval crosses. Ordered by size, the words taken stay within about the words of one document of the target.

    The prefix of a row is ratio * (rows of the source before it), so only counts of (source, octave, part) are summed and ranks are taken
    within a part: no source, however hot, meets in one task.

    The counts are written once and read for the targets and the prefixes. `row` holds the columns `carry` names beside doc_id and source, all by default.

    Returns struct `row` (columns of `docs`), size, source_size, target, copies (long). Rows with null text or source take part (size 0; a
    source of its own, last); equal rows are each counted; rows with null ids are dealt out by text; an empty table gives an empty one.
    """
    id_ = F.coalesce(F.col("row.doc_id").cast("long"), F.col("text_hash"))
    part = F.pmod(F.pmod(id_, F.lit(1000003)) * 7919, F.lit(SALTS))
    kept = docs.columns if carry is None else ["doc_id", "source", *carry]
    sized = docs.select(F.struct(*[docs[c] for c in kept]).alias("row"), n_words(docs["text"]).alias("size"), F.xxhash64(docs["text"]).alias("text_hash"))
    sized = sized.select("row", "size", "text_hash", F.col("row.source").alias("source"), F.floor(F.log2(F.col("size") + 1) * STEPS).cast("int").alias("octave"), part.cast("int").alias("part"))
    strata = materialise(sized.groupBy("source", "octave", "part").agg(F.count("*").alias("n"), F.sum("size").alias("words")))
    counts = strata.withColumn("before", F.coalesce(F.sum("n").over(W.partitionBy("source").orderBy("octave", "part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    targets = source_targets(counts.groupBy("source").agg(F.sum("words").alias("source_size")), weights, most)
    keyed = counts.alias("c").join(targets.alias("t"), F.expr("c.source <=> t.source")).select(
        F.col("c.source").alias("_s"), F.col("c.octave").alias("_o"), F.col("c.part").alias("_p"), "before", "source_size", "target",
    )
    keyed = F.broadcast(keyed) if strata.count() <= MOST_BROADCAST else keyed
    rank = F.row_number().over(W.partitionBy("source", "octave", "part").orderBy("row.doc_id", "size", "text_hash"))
    placed = sized.withColumn("rank", rank).join(keyed, F.expr("source <=> _s and octave = _o and part = _p"))
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    at = lambda k: F.floor(offset(F.col("source"), seed) + ratio * (F.col("before") + F.col("rank") + k))
    copies = F.least(F.lit(most), F.greatest(F.lit(0), at(0) - at(-1))).cast("long")
    return placed.select("row", "size", "source_size", "target", copies.alias("copies"))


def mixed_rows(docs: DataFrame, **params) -> DataFrame:
    """The mix itself: each document as often as it was taken, with the columns of `docs`."""
    taken = mix(docs, **params).where("copies > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("_copy")).select("row.*")


def report(docs: DataFrame) -> DataFrame:
    return mix(docs, carry=[]).select(
        F.col("row.doc_id").alias("doc_id"), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), F.col("row.source").alias("source"), "copies",
    )


_HEX = " + ".join(f"(strpos('0123456789abcdef', substr(h, {i}, 1)) - 1) * {16 ** (5 - i)}" for i in range(1, 6))

ORACLE = rf"""
with sized as (
  select doc_id, text, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size from documents
), keyed as (
  select *, floor(log2(size + 1) * {STEPS})::int as octave,
    ((((coalesce(doc_id, 0) % 1000003) + 1000003) % 1000003) * 7919) % {SALTS} as part
  from sized
), ranked as (
  select *, row_number() over (partition by source order by octave, part, doc_id, size) as r from keyed
), sizes as (
  select source, sum(size)::bigint as source_size from sized group by source
), weighed as (
  select *, row_number() over (order by source nulls last) - 1 as i from sizes
), capped as (
  select *, (i % 3 + 1)::double as w, (source_size * 3)::double as cap from weighed
), levels as (
  select *, sum(source_size) over ()::double - coalesce(sum(cap) over (order by cap / w, i rows between unbounded preceding and 1 preceding), 0) as remaining,
    sum(w) over (order by cap / w, i rows between current row and unbounded following) as rest
  from capped
), level as (
  select remaining, rest from levels where remaining * w <= cap * rest order by cap / w, i limit 1
), hexed as (
  select source, source_size, coalesce(least(cap, w * (select remaining from level) / (select rest from level)), cap) as target, md5('mix' || coalesce(source, chr(0))) as h from levels
), targets as (
  select source, source_size, target, ({_HEX})::double / 1048576 as u, case when source_size > 0 then target / source_size else 0.0 end as ratio from hexed
)
select d.doc_id, d.size, t.source_size, t.target,
  (least(3, greatest(0, floor(u + ratio * r) - floor(u + ratio * (r - 1))))::bigint * d.size)::bigint as taken, d.source,
  least(3, greatest(0, floor(u + ratio * r) - floor(u + ratio * (r - 1))))::bigint as copies
from ranked d join targets t on d.source is not distinct from t.source
"""
