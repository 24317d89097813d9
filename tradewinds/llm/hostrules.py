"""Quality rules by document and host; DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradewinds.llm._io import materialise
from tradewinds.llm._text import WORD

WINDOW = 8
#: Rules besides the base: more symbols than this share of the words' characters; more repeated lines than this share of the lines with a word.
SYMBOL_SHARE, LINE_SHARE = 0.1, 0.3
#: A host is rejected when its shrunken rate of failing documents is above this, and its beta prior weighs at most PRIOR_MOST documents.
HOST_RATE, PRIOR_MOST = 0.5, 1e6


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` over `value`, which is computed once: a lambda variable, where a plain reference would be inlined in each lambda."""
    return F.transform(F.array(value), body)[0]


def repeated_words(words: Column, n: int = WINDOW) -> Column:
    """Words that lie in a window of n words found twice or more in `words`, the first one included.

    Windows are compared by 64-bit hashes of 64-bit word hashes. The windows' positions are sorted only where some window repeats.
    """
    hashes = F.transform(words, lambda w: F.xxhash64(w))
    windows = let(hashes, lambda h: F.transform(F.sequence(F.lit(1), F.size(h) - (n - 1)), lambda i: F.xxhash64(*[F.element_at(h, i + k) for k in range(n)])))

    def covered(w: Column) -> Column:
        pairs = F.sort_array(F.transform(w, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        last = F.size(w) - 1

        def marked(s: Column) -> Column:
            same = lambda a, b: F.get(s, a)["h"] == F.get(s, b)["h"]
            return F.filter(s, lambda x, k: F.coalesce((k > 0) & same(k - 1, k), F.lit(False)) | F.coalesce((k < last) & same(k, k + 1), F.lit(False)))

        at = let(pairs, lambda s: F.array_sort(F.transform(marked(s), lambda x: x["i"])))
        start = F.struct(F.lit(0).alias("n"), F.lit(-n).alias("end"))
        step = lambda acc, p: F.struct((acc["n"] + F.least(F.lit(n), p + n - acc["end"])).alias("n"), (p + n).alias("end"))
        return F.aggregate(at, start.cast("struct<n:int,end:int>"), lambda acc, p: step(acc, p), lambda acc: acc["n"])

    repeated = let(windows, lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0)).otherwise(covered(w)))
    return F.when(F.size(words) < n, F.lit(0)).otherwise(repeated).cast("long")


def measures(docs: DataFrame) -> DataFrame:
    """doc_id, source and the figures of each whole text; null texts have no words."""
    text = F.coalesce(docs["text"], F.lit(""))
    parts = docs.select(docs["doc_id"], docs["source"], text.alias("text"), F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1)).alias("words"))
    lines = F.filter(F.split("text", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return parts.select(
        "doc_id",
        "source",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("text", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("dup"))).alias("lines"),
        repeated_words(F.col("words")).alias("n_repeat_words"),
    ).select("doc_id", "source", "n_words", "word_chars", "n_symbols", F.col("lines.dup").cast("long").alias("n_dup_lines"), "n_repeat_words", F.col("lines.n").cast("long").alias("n_lines"))


def judged(figures: DataFrame) -> DataFrame:
    base = (F.col("n_words") < 20) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 30)
    more = (F.col("n_symbols") > F.col("word_chars") * SYMBOL_SHARE) | (F.col("n_dup_lines") > F.col("n_lines") * LINE_SHARE)
    return figures.withColumn("base_failed", base).withColumn("rule_failed", base | more)


def host_rates(rows: DataFrame) -> DataFrame:
    """Hosts with their failing documents shrunk by a beta prior, which the method of moments fits to all hosts' rates, each weighed by its documents.

    Of a variance that sampling alone explains, the prior is PRIOR_MOST documents strong, and every host has about the common rate.
    Returns source, n, failed, rate (double). The moments are one row, the only thing that is broadcast. Rows join their hosts by a shuffle that splits a hot
    host, or by a broadcast where Spark finds the hosts small.
    """
    hosts = rows.groupBy("source").agg(F.count("*").alias("n"), F.sum(F.col("rule_failed").cast("long")).alias("failed"))
    total = hosts.agg(F.sum("n").alias("N"), F.sum("failed").alias("K"), F.count("*").alias("H"), F.sum(F.col("n").cast("double") * F.col("n")).alias("N2"), F.sum(F.col("failed").cast("double") * F.col("failed") / F.col("n")).alias("S"))
    mean = F.col("K") / F.col("N")
    # between-host variance of a binomial mixture: weighted squares less what sampling adds
    spread = F.col("S") - F.col("K") * mean
    scale = F.col("N") - F.col("N2") / F.col("N")
    between = F.when(scale > 0, (spread - (F.col("H") - 1) * mean * (1 - mean)) / scale)
    strength = F.when(between > 0, mean * (1 - mean) / between - 1)
    prior = total.select(mean.alias("mean"), F.least(F.lit(PRIOR_MOST), F.greatest(F.lit(1.0), F.coalesce(strength, F.lit(PRIOR_MOST)))).alias("strength"))
    rate = (F.col("failed") + F.col("mean") * F.col("strength")) / (F.col("n") + F.col("strength"))
    return hosts.join(F.broadcast(prior)).select("source", "n", "failed", rate.alias("rate"))  # one row


def apply_rules(docs: DataFrame) -> DataFrame:
    """Every document's figures, whether base rules fail, its host's shrunken rate and the verdict.

    A document stays unless its base rules fail or its host is rejected. The figures are written once and read for the hosts' rates and for
    the result. Null sources are one host; equal rows are judged each; empty texts fail; an empty table gives an empty one.
    """
    rows = materialise(judged(measures(docs)))
    hosts = host_rates(rows).select(F.col("source").alias("_host"), F.col("rate").alias("host_rate"))
    joined = rows.join(hosts, F.expr("source <=> _host"), "left")
    return joined.withColumn("kept", ~F.col("base_failed") & (F.col("host_rate") <= HOST_RATE)).drop("_host")


def report(docs: DataFrame) -> DataFrame:
    return apply_rules(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


ORACLE = rf"""
with t as (
  select row_number() over () as k, doc_id, source, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words from documents
), lines as (
  select k, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as ls from t
), win as (
  select k, i, array_to_string(words[i:i + 7], ' ') as w from (select k, words, unnest(range(1, len(words) - 6)) as i from t where len(words) >= 8)
), rep as (
  select k, i from (select k, i, count(*) over (partition by k, w) as c from win) where c > 1
), cov as (
  select k, count(distinct p) as n from (select k, unnest(range(i, i + 8)) as p from rep) group by k
), f as (
  select t.k, doc_id, source, len(words)::bigint as n_words, length(array_to_string(words, ''))::bigint as word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols,
    (len(ls) - len(list_distinct(ls)))::bigint as n_dup_lines, coalesce(cov.n, 0)::bigint as n_repeat_words, len(ls)::bigint as n_lines
  from t join lines using (k) left join cov using (k)
), j as (
  select *, n_words < 20 or n_repeat_words * 100 > n_words * 30 as base_failed,
    n_words < 20 or n_repeat_words * 100 > n_words * 30 or n_symbols > word_chars * {SYMBOL_SHARE} or n_dup_lines > n_lines * {LINE_SHARE} as rule_failed
  from f
), h as (
  select source, count(*) as n, sum(rule_failed::bigint)::bigint as failed from j group by source
), m as (
  select sum(n)::double as nn, sum(failed)::double as kk, count(*) as hh, sum(n::double * n) as n2, sum(failed::double * failed / n) as s from h
), p as (
  select kk / nn as mean, case when nn - n2 / nn > 0 then (s - kk * kk / nn - (hh - 1) * (kk / nn) * (1 - kk / nn)) / (nn - n2 / nn) end as b from m
), q as (
  select mean, least({PRIOR_MOST}, greatest(1.0, coalesce(case when b > 0 then mean * (1 - mean) / b - 1 end, {PRIOR_MOST}))) as strength from p
), r as (
  select source, (failed + mean * strength) / (n + strength) as rate from h, q
)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, (not base_failed and rate <= {HOST_RATE}) as kept
from j join r on j.source is not distinct from r.source
"""
