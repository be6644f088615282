"""The documents from raw rows to packed training sequences, in stages that read what the one before wrote.

Rows without a doc_id pass every stage that goes by ids unchanged. Null and empty texts count as text
without a letter and end at the first stage. Repeated rows count as copies: one of them stays; rows of one doc_id with different texts all stay. Columns
beside those of `documents` are kept until the last stage; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quayline.llm import langid, mixing, packing, simhash, substring
from quayline.llm.common import read_table, stored

#: Letters of a text for each one that its language doesn't have: with fewer, it is in no learned language.
LEAST_PHRASE = 1.5
#: The encoder's memo: small, since the Python workers of the other stages stay beside it.
ENCODER_WORDS = 100_000


def language(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents in a language of the labelled rows; without a letter, or with over two thirds of letters it doesn't have, they go."""
    known = langid.labelled(docs).where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("unknown_letters") * LEAST_PHRASE <= 1))
    return known.select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest doc_id.

    Rows that share a doc_id and differ in text are documents of their own: those of a kept doc_id stay.
    """
    named = docs.where("doc_id IS NOT NULL")
    chosen = simhash.components(named).where(F.col("doc_id") == F.col("component_id")).select("doc_id").distinct()
    kept = named.join(chosen, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return kept.select(*docs.columns).unionByName(docs.where("doc_id IS NULL"))


def repeated_passages(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Texts without the passages of 50 words and more that an earlier document has; what nothing is left of goes."""
    others = [c for c in docs.columns if c not in ("doc_id", "text", "n_chars")]
    found = substring.deduplicated(docs, carry=others).where((F.col("n_removed") == 0) | (F.col("kept") != ""))
    found = found.withColumnRenamed("kept", "text").withColumn("n_chars", F.length("text").cast("long"))
    return found.select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents as often as their source's weight asks for, in random order."""
    return mixing.mixed(docs).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """The pieces of all documents with their place in sequences of 4096 tokens."""
    return packing.packed(docs, memo=ENCODER_WORDS)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("mix", mix),
    ("pack", pack),
]

#: SQL has no tokenizer and no suffix automaton; tests/llm holds a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, folder: str) -> DataFrame:
    docs = read_table(spark, folder, "documents")
    for place, (name, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, folder)
        if place < len(STAGES):
            docs = stored(docs, name)
    return docs
