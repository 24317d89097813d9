"""Personal data by weak supervision; DataFrame functions only.

Candidates are voted on by labelers (pattern, gazetteer, context). Expectation-maximisation over the counts of vote patterns estimates the labelers'
reliabilities, and a logistic span classifier of each kind is trained on the posteriors, over votes, context and shape. The counts have at most
len(KINDS) * 2**len(FEATURES) rows, whatever the input; they alone come to the driver. Work on a text grows in proportion to it and to its matches.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradewinds.llm._io import materialise
from tradewinds.llm.hostrules import let

KINDS = ("email", "ip", "card", "phone", "secret")

# Patterns. Possessive and behind-looking forms find what the plain ones find, without backtracking: a run of the first class that fails at its start fails
# throughout, \G admits a start right behind the match before, and nothing follows a greedy tail.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
#: Maximal chains of 13 to 19 digits; shorter and longer ones fail whole.
CARD = r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){12,18}+(?![ -]?[0-9])"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
#: Candidates beyond the base: local phone numbers, and long runs of letters and digits.
#: The latter never hold a plus sign, with which the base's numbers begin, so one search finds both and takes nothing from the base.
PHONES = PHONE + r"|(?<![0-9+(.-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])"
SECRET = r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*[0-9])[A-Za-z0-9+/_-]{20,}+"

# Gazetteers and context words.
TOP_DOMAINS = r"\.(com|org|net|edu|gov|info|io|de|fr|es|it|uk|eu)$"
COUNTRY_CODES = r"^\+(1|7|20|27|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])"
CONTEXT = {
    "email": "mail|contact|write|address",
    "ip": r"\bip\b|host|server|address|client",
    "card": "card|visa|credit|payment|account",
    "phone": "phone|tel|call|fax|mobile",
    "secret": "token|secret|passw|api|key|credential",
}
#: Words before a number that is no personal one.
NUMBERING = r"\b(no|number|id|ref|order|version|isbn|page|commit|sha|hash|md5|uuid|build|revision)\b"
#: Characters before a span, back to the match before it, that are its context.
BEFORE = 24
#: Matches whose places are summed at once; characters of the parts that a text is cut into to take out pieces of it.
CHUNK, PART = 256, 4096

SPAN = "struct<start:int,end:int,s:string,before:string>"


def running(x: Column, op: Callable[[Column, Column], Column]) -> Column:
    """Running totals of a non-empty array of ints by an associative `op` with 0 as its start.

    An array grows by copying, so totals are taken within chunks of CHUNK and over the chunks: some n * CHUNK steps, not n squared.
    """
    zero, none = F.lit(0), F.array().cast("array<int>")

    def totals(values: Column, first: Column) -> Column:
        start = F.struct(first.alias("at"), none.alias("out"))
        return F.aggregate(values, start, lambda acc, v: let(op(acc["at"], v), lambda t: F.struct(t.alias("at"), F.concat(acc["out"], F.array(t)).alias("out"))), lambda acc: acc["out"])

    def chunked(a: Column) -> Column:
        chunks = F.transform(F.sequence(zero, ((F.size(a) - 1) / CHUNK).cast("int")), lambda c: F.slice(a, c * CHUNK + 1, CHUNK))

        def joined(cs: Column) -> Column:
            before = F.concat(F.array(zero), totals(F.transform(cs, lambda c: F.aggregate(c, zero, op)), zero))
            return let(before, lambda b: F.flatten(F.transform(cs, lambda c, i: totals(c, F.get(b, i)))))

        return let(chunks, joined)

    return let(x, lambda a: F.when(F.size(a) <= CHUNK, totals(a, zero)).otherwise(chunked(a)))


def found(text: Column, pattern: str, when: Column) -> Column:
    """Matches of `pattern` in `text`, leftmost and without overlap: start, end (code points, end exclusive), the string and what stands before it.

    The pattern splits the text into the gaps between its matches; places are running sums of both. The text is searched only `when`, and split only
    where there is a match.
    """
    none = F.array().cast(f"array<{SPAN}>")

    def placed(hits: Column) -> Column:
        def spans(gaps: Column) -> Column:
            ends = running(F.transform(hits, lambda m, i: F.length(m) + F.length(F.get(gaps, i))), lambda a, b: a + b)
            one = lambda e: lambda m, i: F.struct((F.get(e, i) - F.length(m)).alias("start"), F.get(e, i).alias("end"), m.alias("s"), F.right(F.get(gaps, i), F.lit(BEFORE)).alias("before"))
            return let(ends, lambda e: F.transform(hits, one(e)))

        return let(F.split(text, pattern, -1), spans)

    hits = let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m: F.when(F.size(m) == 0, none).otherwise(placed(m)))
    return F.when(when, hits).otherwise(none)


def luhn(s: Column) -> Column:
    def total(d: Column) -> Column:
        n = F.length(d)

        def step(acc: Column, i: Column) -> Column:
            x = F.substring(d, n - i + 1, F.lit(1)).cast("int")
            return acc + F.when(i % 2 == 0, x * 2 - F.when(x > 4, 9).otherwise(0)).otherwise(x)

        return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), step)

    return let(F.regexp_replace(s, "[^0-9]", ""), total) % 10 == 0


def _passes(kind: str, s: Column) -> Column:
    """The pattern labeler; for the first four kinds, the base rule."""
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return F.forall(F.split(s, r"\."), lambda p: p.rlike("^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    if kind == "card":
        return luhn(s)
    if kind == "phone":
        n = F.length(F.regexp_replace(s, "[^0-9]", ""))
        return s.startswith("+") & n.between(9, 15)
    return F.length(s).isin(32, 40, 64) & s.rlike("[A-Za-z]")


def _listed(kind: str, s: Column) -> Column:
    """The gazetteer labeler."""
    if kind == "email":
        return F.lower(s).rlike(TOP_DOMAINS)
    if kind == "ip":
        return s.rlike(r"^(?!0|10\.|127\.|22[4-9]\.|2[3-9][0-9]\.)")
    if kind == "card":
        return s.rlike("^[3-6]")
    if kind == "phone":
        return s.rlike(COUNTRY_CODES)
    return s.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$")


VOTES = ("r", "g", "c")
FEATURES = (*VOTES, "q", "k", "l", "d", "m", "s")


def candidates(text: Column) -> Column:
    """All candidates of a text, by kind as in KINDS and start: kind (its index), start, end, base, and the votes and features (0 or 1).

    r, g, c: pattern, gazetteer and context labelers. Context: q, a quote, colon or equals sign stands before; k, a word of numbering does. Shape: l, longer than
    16 characters; d, half of them digits or more; m, capital and small letters; s, separators.
    """
    digit = text.rlike("[0-9]")
    spans = [found(text, EMAIL, F.contains(text, F.lit("@"))), found(text, IP, digit), found(text, CARD, digit), found(text, PHONES, digit), found(text, SECRET, digit)]
    flag = lambda x, name: F.coalesce(x.cast("int"), F.lit(0)).alias(name)

    def judged(k: int, kind: str, array: Column) -> Column:
        def one(x: Column) -> Column:
            s, before = x["s"], F.lower(x["before"])
            passes = _passes(kind, s)
            digits = F.length(F.regexp_replace(s, "[^0-9]", ""))
            shape = [flag(F.length(s) > 16, "l"), flag(digits * 2 >= F.length(s), "d"), flag(s.rlike("[a-z]") & s.rlike("[A-Z]"), "m"), flag(s.rlike("[^A-Za-z0-9]"), "s")]
            return F.struct(
                F.lit(k).alias("kind"), x["start"].alias("start"), x["end"].alias("end"), F.coalesce(passes & F.lit(kind != "secret"), F.lit(False)).alias("base"),
                flag(passes, "r"), flag(_listed(kind, s), "g"), flag(before.rlike(CONTEXT[kind]), "c"), flag(before.rlike("[\"'=:]\\s*$"), "q"), flag(before.rlike(NUMBERING), "k"), *shape,
            )

        return F.transform(array, one)

    return F.concat(*[judged(k, kind, a) for k, (kind, a) in enumerate(zip(KINDS, spans))])


def vote_counts(spans: DataFrame) -> list:
    """How many spans have each pattern of kind, votes and features: at most len(KINDS) * 2**len(FEATURES) rows."""
    return spans.select(F.explode("found").alias("x")).groupBy("x.kind", *[f"x.{f}" for f in FEATURES]).agg(F.count("*").alias("n")).orderBy("kind", *FEATURES).collect()


def posteriors(rows: list, rounds: int = 60) -> list[float]:
    """P(personal data) of each pattern by expectation-maximisation; the labelers of a kind err independently.

    Reliabilities start at 0.8, as a prior worth ten spans, so a kind that is not seen or has one pattern only stays defined.
    """
    out = [0.0] * len(rows)
    for kind in sorted({r["kind"] for r in rows}):
        own = [i for i, r in enumerate(rows) if r["kind"] == kind]
        share, hit, false = 0.5, dict.fromkeys(VOTES, 0.8), dict.fromkeys(VOTES, 0.2)
        for _ in range(rounds):
            for i in own:
                a, b = math.log(share), math.log(1 - share)
                for v in VOTES:
                    a += math.log(hit[v] if rows[i][v] else 1 - hit[v])
                    b += math.log(false[v] if rows[i][v] else 1 - false[v])
                out[i] = 1 / (1 + math.exp(min(700.0, b - a)))
            yes = sum(out[i] * rows[i]["n"] for i in own)
            no = sum((1 - out[i]) * rows[i]["n"] for i in own)
            share = (yes + 5) / (yes + no + 10)
            for v in VOTES:
                hit[v] = (8 + sum(out[i] * rows[i]["n"] for i in own if rows[i][v])) / (10 + yes)
                false[v] = (2 + sum((1 - out[i]) * rows[i]["n"] for i in own if rows[i][v])) / (10 + no)
    return out


def train(rows: list, labels: list[float], steps: int = 400, rate: float = 1.0, l2: float = 1e-3) -> dict[int, list[float]]:
    """For each kind a logistic regression of the posteriors on a constant and the features: the mean loss over all spans of the kind."""
    out = {}
    for kind in sorted({r["kind"] for r in rows}):
        own = [([1.0, *(float(r[f]) for f in FEATURES)], y, r["n"]) for r, y in zip(rows, labels) if r["kind"] == kind]
        total = sum(n for _, _, n in own)
        w = [0.0] * (1 + len(FEATURES))
        for _ in range(steps):
            g = [l2 * v for v in w]
            for x, y, n in own:
                p = 1 / (1 + math.exp(-max(-40.0, min(40.0, sum(a * b for a, b in zip(w, x))))))
                for j, v in enumerate(x):
                    if v:
                        g[j] += n / total * (p - y)
            w = [a - rate * b for a, b in zip(w, g)]
        out[kind] = w
    return out


def fit(spans: DataFrame) -> dict[int, list[float]]:
    rows = vote_counts(spans)
    return train(rows, posteriors(rows))


def chosen(array: Column, w: dict[int, list[float]]) -> Column:
    """Base spans, and phone numbers and secrets that the classifier gives 0.5 or more; by kind, then start.

    Base spans of a kind never overlap others of it, as one search finds both. An address or card number that fails its range or checksum is none.
    """

    def keep(x: Column) -> Column:
        more = F.lit(False)
        for kind in (KINDS.index("phone"), KINDS.index("secret")):
            if kind in w:
                z = sum((F.lit(v) * x[f] for v, f in zip(w[kind][1:], FEATURES)), F.lit(w[kind][0]))
                more = more | ((x["kind"] == kind) & (z >= 0))
        return x["base"] | more

    return F.transform(F.filter(array, keep), lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"), x["base"].alias("base")))


def written(array: Column) -> Column:
    name = lambda k: F.element_at(F.array(*map(F.lit, KINDS)), k + 1)
    return F.array_join(F.transform(array, lambda x: F.concat_ws(":", name(x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def find_pii(docs: DataFrame) -> DataFrame:
    """doc_id and spans (kind, start, end, base) of each whole text; null texts are empty, equal rows are searched each, an empty table gives an empty one.

    Candidates are written once, then counted for the model and judged by it.
    """
    spans = materialise(docs.select("doc_id", candidates(F.coalesce(F.col("text"), F.lit(""))).alias("found")))
    return spans.select("doc_id", chosen(F.col("found"), fit(spans)).alias("spans"))


def report(docs: DataFrame) -> DataFrame:
    base = F.filter("spans", lambda x: x["base"])
    out = find_pii(docs).select("doc_id", "spans", base.alias("base"))
    of = lambda k: F.filter("base", lambda x: x["kind"] == k)
    counts = [F.size(of(k)).cast("long").alias(f"n_{kind}") for k, kind in enumerate(KINDS[:4])]
    return out.select("doc_id", *counts, F.sha2(written(F.col("base")).cast("binary"), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))


def piece(parts: Column, a: Column, b: Column) -> Column:
    """Code points a (included) to b of a text that is cut into parts of PART."""
    i, j = (a / PART).cast("int"), (b / PART).cast("int")
    head = lambda n: F.coalesce(F.substring(F.get(parts, i), a - i * PART + 1, n), F.lit(""))
    tail = F.coalesce(F.substring(F.get(parts, j), F.lit(1), b - j * PART), F.lit(""))
    return F.when(i == j, head(b - a)).otherwise(F.concat(head(F.lit(PART)), F.array_join(F.slice(parts, i + 2, j - i - 1), ""), tail))


def replaced(text: Column, spans: Column) -> Column:
    """The text with each span, or run of overlapping spans, replaced by its (first) kind in brackets."""
    tags = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    order = F.array_sort(F.transform(spans, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"))))

    def built(xs: Column, ends: Column, parts: Column) -> Column:
        before = lambda i: F.coalesce(F.get(ends, i - 1), F.lit(0))
        one = lambda x, i: F.when((i == 0) | (x["start"] >= before(i)), F.concat(piece(parts, before(i), x["start"]), F.element_at(tags, x["kind"] + 1))).otherwise("")
        return F.concat(F.array_join(F.transform(xs, one), ""), piece(parts, F.element_at(ends, -1), F.length(text)))

    ends = lambda xs: running(F.transform(xs, lambda x: x["end"]), lambda a, b: F.greatest(a, b))
    parts = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PART}}}"), F.lit(0))
    return let(order, lambda xs: let(ends(xs), lambda e: let(parts, lambda p: built(xs, e, p))))


def redacted(docs: DataFrame) -> DataFrame:
    """The documents with each span, or run of overlapping spans, replaced by its (first) kind in brackets; n_chars, where there is one, follows the text.

    Each text is searched once: rows and their candidates are written, the model is fitted to the candidates and the texts are rewritten. Null texts stay
    null, empty ones empty; equal rows are treated each; an empty table gives an empty one.
    """
    row = F.struct(*[docs[c] for c in docs.columns]).alias("row")
    rows = materialise(docs.select(row, candidates(F.coalesce(docs["text"], F.lit(""))).alias("found")))
    text = F.col("row.text")
    new = let(chosen(F.col("found"), fit(rows)), lambda s: F.when(F.size(s) == 0, text).otherwise(replaced(text, s)))
    parts = {"text": F.col("_new")} | ({"n_chars": F.length("_new").cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    return rows.select("row", new.alias("_new")).select(*[parts[c].alias(c) if c in parts else F.col("row")[c].alias(c) for c in docs.columns])
