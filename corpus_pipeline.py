"""The corpus pipeline: toxicity, near duplicates, personal data, mixing, packing.

STAGES are applied in order; each gets the documents that its predecessor wrote. run() applies them to `documents`, each stage's result written to the shared folder.

All stages take null texts as empty ones, treat equal rows one by one unless they say otherwise, keep columns that they do not know, and give an empty table
for an empty one. A text is held whole by the task that works on it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tradewinds.llm import mixing, ngram_join, packing, pii, toxicity
from tradewinds.llm._io import configure, materialise, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the sentence-level toxicity model rejects go: those with a probability of 0.5 or more that some sentence is toxic.

    The model is trained on labelled documents among `docs`; without both labels nothing is rejected. Null and empty texts stay. Columns of `docs`.
    """
    configure(spark)
    return toxicity.keep_clean(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked texts stays: the smallest id that is not null, the smallest text hash among equal ids.

    Texts without words are copies of one another, so one of them stays. Of equal rows one stays. Columns of `docs`.
    """
    configure(spark)
    return ngram_join.keep_one(docs)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind in brackets; overlapping spans by the first one's kind, once. n_chars follows the text; null texts stay null.

    Every row stays. Columns of `docs`.
    """
    configure(spark)
    return pii.redacted(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: not at all up to three times, by its source's target over its source's size.

    Null sources are a source of their own; documents without words have no size and are taken like others of their source. Columns of `docs`.
    """
    configure(spark)
    return mixing.mixed_rows(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their place in a sequence; a document without text is one piece of one token. Copies that the mix made are packed each.

    Returns doc_id, piece, start, length, ids_crc32, sequence_id, offset.
    """
    configure(spark)
    return packing.report(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("pii", redact),
    ("mixing", mix_sources),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = materialise(docs)
    return docs


#: The trained stages have no SQL form; the stages are tested against brute force instead.
ORACLE_SQL = None
