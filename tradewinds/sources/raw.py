"""Raw declaration files: repair, typing and quality counters; code tables, manifests and the parquet store."""

from __future__ import annotations

import re
import zipfile
from html.parser import HTMLParser
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tradewinds.functions.scalars import clean, normalize_code, parse_amount, parse_date

RESOURCE = r"(?i)(exp|imp)\w*[_-](\d{4})[_-]?(\d{2})(?:[_-]?(?:parte|part|p)(\d+))?"


def list_resources(files: DataFrame) -> DataFrame:
    """Files by name: kind, year, month and part (1 where the name has none); others are left out. `files` has path (and may have size)."""
    name = F.element_at(F.split("path", "/"), -1)
    part = lambda k: F.regexp_extract(name, RESOURCE, k)
    out = files.withColumns({"kind": F.lower(part(1)), "year": F.nullif(part(2), F.lit("")).cast("int"), "month": F.nullif(part(3), F.lit("")).cast("int"), "part": F.coalesce(F.nullif(part(4), F.lit("")).cast("int"), F.lit(1))})
    return out.where("year is not null and month between 1 and 12").orderBy("kind", "year", "month", "part")


def hashes(spark: SparkSession, path: str) -> DataFrame:
    """path, size and sha256 of files."""
    return spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


def write_manifest(resources: DataFrame, path: str) -> None:
    resources.write.mode("overwrite").option("header", True).csv(path)


def first_parts(manifest: DataFrame) -> DataFrame:
    return manifest.where("part = 1")


def extract(archive: str, to: str) -> str:
    """The only .txt of a zip archive, unpacked by the driver; anything else is an error."""
    with zipfile.ZipFile(archive) as z:
        names = [n for n in z.namelist() if n.lower().endswith(".txt")]
        if len(names) != 1:
            raise ValueError(f"{archive} holds {len(names)} text files, not one")
        target = Path(to) / Path(names[0]).name
        target.parent.mkdir(parents=True, exist_ok=True)
        with z.open(names[0]) as src, target.open("wb") as dst:
            while chunk := src.read(1 << 20):
                dst.write(chunk)
    return str(target)


def _repair_run(lines: list[str], n: int) -> list[tuple[str, str]]:
    """Left to right: a short line that has n fields with the next one at its end is one line with it; other short lines are filled up."""
    out, k = [], 0
    count = lambda s: s.count(";") + 1
    while k < len(lines):
        have = count(lines[k])
        if have >= n:
            out.append((lines[k], "long" if have > n else "ok"))
        elif k + 1 < len(lines) and count(lines[k] + lines[k + 1]) == n:
            out.append((lines[k] + lines[k + 1], "joined"))
            k += 1
        else:
            out.append((lines[k] + ";" * (n - have), "padded"))
        k += 1
    return out


def read_lines(spark: SparkSession, path: str, n_fields: int, encoding: str = "ISO-8859-1") -> DataFrame:
    """file, line (text of n fields) and state: ok, joined, padded, or long, which later steps reject.

    Only runs of short lines with the line behind them are repaired in Python, one run a group; all other lines stay in the JVM. A file with a
    line of the wrong length has its lone carriage returns turned to blanks. Lines are numbered by their place in the file, so order does not depend on splits.
    """
    raw = spark.read.option("encoding", encoding).option("lineSep", "\n").text(path, wholetext=False)
    lines = raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), F.regexp_replace("value", r"\r$", "").alias("line")).where("line <> ''")
    lines = lines.withColumn("short", F.size(F.split("line", ";", -1)) < n_fields)
    wrong = lines.groupBy("file").agg(F.bool_or(F.size(F.split("line", ";", -1)) != n_fields).alias("repair"))
    lines = lines.join(wrong, "file").withColumn("line", F.when(F.col("repair"), F.regexp_replace("line", "\r", " ")).otherwise(F.col("line")))
    w = W.partitionBy("file").orderBy("block", "at")
    before = F.coalesce(F.lag("short").over(w), F.lit(False))
    # a run: consecutive short lines, and the line after them
    marked = lines.withColumn("_start", (F.col("short") & ~before).cast("int")).withColumn("_in", F.col("short") | before).withColumn("run", F.sum("_start").over(w)).withColumn("pos", F.row_number().over(w))
    whole = marked.where("not _in").select("file", "line", F.when(F.size(F.split("line", ";", -1)) > n_fields, "long").otherwise("ok").alias("state"))

    def fix(pdf: pd.DataFrame) -> pd.DataFrame:
        got = _repair_run(list(pdf.sort_values("pos")["line"]), n_fields)
        return pd.DataFrame({"file": pdf["file"].iloc[0], "line": [g[0] for g in got], "state": [g[1] for g in got]})

    fixed = marked.where("_in").select("file", "run", "pos", "line").groupBy("file", "run").applyInPandas(fix, "file string, line string, state string")
    return whole.unionByName(fixed)


def typed(lines: DataFrame, columns: list[str], dates: list[str], numbers: list[str]) -> DataFrame:
    """Columns of the lines that have their number of fields: text, dates and amounts; null where they cannot be read, counted by `coerced_dates` and `coerced_numbers`."""
    fields = F.split("line", ";", -1)
    raw = lines.where("state <> 'long'").select("file", *[clean(fields[k]).alias(c) for k, c in enumerate(columns)])
    lost = lambda c, parsed: (F.col(c).isNotNull() & parsed(F.col(c)).isNull()).cast("int")
    real = lambda c: F.nullif(c, F.lit("00000000"))
    return raw.select(
        "file",
        *[(parse_date(F.col(c)) if c in dates else parse_amount(F.col(c)) if c in numbers else F.col(c)).alias(c) for c in columns],
        sum([(real(F.col(c)).isNotNull() & parse_date(F.col(c)).isNull()).cast("int") for c in dates], F.lit(0)).alias("coerced_dates"),
        sum([lost(c, parse_amount) for c in numbers], F.lit(0)).alias("coerced_numbers"),
    )


def ingest_log(lines: DataFrame, rows: DataFrame, date: str, period: Column) -> DataFrame:
    """Counters by file: rows, repaired and rejected lines with three samples, lost values and rows of another month."""
    a = lines.groupBy("file").agg(
        F.count_if(F.col("state") == "joined").alias("lines_joined"), F.count_if(F.col("state") == "padded").alias("lines_padded"), F.count_if(F.col("state") == "long").alias("invalid_rows"),
        F.slice(F.sort_array(F.collect_set(F.when(F.col("state") == "long", F.substring("line", 1, 200)))), 1, 3).alias("invalid_samples"),
    )
    out = F.col(date).isNotNull() & (F.date_format(date, "yyyy-MM") != period)
    b = rows.groupBy("file").agg(F.count("*").alias("rows"), F.sum("coerced_dates").alias("date_coerced"), F.sum("coerced_numbers").alias("numeric_coerced"), F.count_if(out).alias("rows_outside_month"))
    return a.join(b, "file", "left")


def log_totals(log: DataFrame, counters: list[str], by: str = "kind") -> DataFrame:
    """Sums of an ingest log's counters for each flow; a counter that a row lacks is 0."""
    return log.groupBy(by).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in counters])


def upsert_log(previous: DataFrame, new: DataFrame) -> DataFrame:
    """The last row of each kind, year and month."""
    both = previous.withColumn("_seq", F.lit(0)).unionByName(new.withColumn("_seq", F.lit(1)), allowMissingColumns=True)
    r = F.row_number().over(W.partitionBy("kind", "year", "month").orderBy(F.desc("_seq")))
    return both.withColumn("_r", r).where("_r = 1").drop("_r", "_seq").orderBy("kind", "year", "month")


def write_months(rows: DataFrame, root: str) -> None:
    """One partition a flow and month, replaced as a whole."""
    rows.write.partitionBy("flow", "period").option("compression", "zstd").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(root)


def missing_months(wanted: DataFrame, stored: DataFrame) -> DataFrame:
    return wanted.join(stored.select("flow", "period").distinct(), ["flow", "period"], "left_anti")


def load(spark: SparkSession, root: str, flow: str, columns: list[str] | None = None, periods: list[str] | None = None) -> DataFrame:
    """Months of a flow: partitions and columns are pruned at the scan."""
    rows = spark.read.parquet(root).where(F.col("flow") == flow)
    rows = rows.where(F.col("period").isin(periods)) if periods else rows
    return rows.select(*columns, "period") if columns else rows


def read_codes(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    return spark.read.schema(T.StructType([T.StructField(c, T.StringType()) for c in columns])).option("header", True).csv(path)


def code_table(rows: DataFrame, name: str, code: str, pseudo_from: int | None = None, **constants: str) -> DataFrame:
    """code and gloss, codes normalised, the first of each; constants added; codes of `pseudo_from` and more are pseudo-countries."""
    out = rows.select("seq", normalize_code(F.col(code)).alias("code"), clean(F.col(name)).alias("gloss")).where("code is not null")
    out = out.withColumn("_r", F.row_number().over(W.partitionBy("code").orderBy("seq"))).where("_r = 1").drop("_r", "seq")
    out = out.withColumns({k: F.lit(v) for k, v in constants.items()}) if constants else out
    return out.withColumn("pseudo", F.col("code").cast("int") >= pseudo_from) if pseudo_from is not None else out


def port_hierarchy(rows: DataFrame) -> DataFrame:
    """Rows (seq, kind: continent, country or port, code, name) to ports with the titles above them; a continent ends its predecessor's country."""
    w = W.orderBy("seq")
    continent = F.last(F.when(F.col("kind") == "continent", F.col("name")), ignorenulls=True).over(w)
    block = F.sum((F.col("kind") == "continent").cast("int")).over(w)
    titled = rows.withColumn("continent", continent).withColumn("_b", block)
    country = F.last(F.when(F.col("kind") == "country", F.col("name")), ignorenulls=True).over(W.partitionBy("_b").orderBy("seq"))
    return titled.withColumn("country", country).where("kind = 'port'").select(normalize_code(F.col("code")).alias("code"), F.col("name").alias("gloss"), "country", "continent")


class _Tables(HTMLParser):
    """Tables of a page as lists of rows, each with the text before it."""

    def __init__(self):
        super().__init__()
        self.tables: list[tuple[str, list[list[str]]]] = []
        self.before, self.cell = "", None
        self.open = 0

    def _close(self):
        if self.cell is not None:
            self.tables[-1][1][-1].append(re.sub(r"\s+", " ", self.cell).strip())
            self.cell = None

    def handle_starttag(self, tag, attrs):
        if tag in ("table", "tr", "td", "th"):
            self._close()  # end tags of cells may be left out
        if tag == "table":
            self.open += 1
            self.tables.append((re.sub(r"\s+", " ", self.before)[-200:].strip(), []))
        elif self.open and tag == "tr":
            self.tables[-1][1].append([])
        elif self.open and tag in ("td", "th") and self.tables[-1][1]:
            self.cell = ""

    def handle_endtag(self, tag):
        if tag in ("table", "tr", "td", "th"):
            self._close()
        if tag == "table" and self.open:
            self.open -= 1
            self.before = ""

    def handle_data(self, data):
        if self.cell is not None:
            self.cell += data
        elif not self.open:
            self.before = (self.before + data)[-1000:]


def html_tables(pages: DataFrame) -> DataFrame:
    """page_id, table, before, row, cells of all HTML tables of pages (page_id, html)."""

    def run(batches):
        for pdf in batches:
            out = []
            for page, html in zip(pdf["page_id"], pdf["html"]):
                p = _Tables()
                p.feed(html or "")
                out += [(page, k, before, r, cells) for k, (before, rows) in enumerate(p.tables) for r, cells in enumerate(rows)]
            yield pd.DataFrame(out, columns=["page_id", "table", "before", "row", "cells"])

    return pages.select("page_id", "html").mapInPandas(run, "page_id long, table int, before string, row int, cells array<string>")


def find_table(tables: DataFrame, before: str, header: str) -> DataFrame:
    """Rows below the header of each page's first table that has `before` in the text ahead of it and `header` in a cell of its first row, whatever the case."""
    has = lambda c, text: F.contains(F.lower(c), F.lit(text.lower()))
    wanted = tables.where((F.col("row") == 0) & has(F.col("before"), before) & F.exists("cells", lambda c: has(c, header)))
    return tables.join(wanted.groupBy("page_id").agg(F.min("table").alias("table")), ["page_id", "table"]).where("row > 0")
