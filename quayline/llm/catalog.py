"""Queries of the pipeline's operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quayline.llm import extraction, idfile, imatch, langid, lengths, mixing, ngram, packing, phrases, repair, simhash, substring, topk
from quayline.llm.common import read_table
from quayline.llm.tokens import vocabulary
from quayline.session import scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}


def query(run: Callable[[SparkSession, str], DataFrame]):
    QUERIES[run.__name__] = run
    return run


@query
def op1_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return substring.kept_digest(substring.deduplicated(read_table(spark, folder, "documents")))


@query
def op4_simhash(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.components(read_table(spark, folder, "documents"))
    return found.select("doc_id", simhash.hex_digits(F.col("simhash")).alias("fingerprint"), "component_id")


@query
def op3_language_id(spark: SparkSession, folder: str) -> DataFrame:
    return langid.identified(read_table(spark, folder, "documents"))


@query
def op7_poisson_mix(spark: SparkSession, folder: str) -> DataFrame:
    found = mixing.mixed(read_table(spark, folder, "documents"))
    return found.select("doc_id", "source", "copy", F.length("text").alias("n_chars"), "shuffle_key")


CHECKS["op7_poisson_mix"] = mixing.check_sql()


@query
def op5_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.packed(read_table(spark, folder, "documents")).withColumn("length", F.col("length").cast("long"))


@query
def op6_id_files(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_path(spark, "ids")
    idfile.write_ids(read_table(spark, folder, "documents"), path, vocabulary("byte_bpe_50k.json"))
    found = idfile.read_ids(spark, path)
    return found.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query
def op8_ngram_scores(spark: SparkSession, folder: str) -> DataFrame:
    return ngram.scored(read_table(spark, folder, "documents"))


@query
def op9_imatch(spark: SparkSession, folder: str) -> DataFrame:
    found = imatch.compared(read_table(spark, folder, "documents"))
    digits = lambda c: F.lower(F.hex(c))
    return found.select(
        "doc_id", "n_chars", digits("edited_sha256").alias("edited_sha256"), digits("fingerprint").alias("fingerprint"),
        digits("edited").alias("edited_fingerprint"), "near_edited", "near_next",
    )


@query
def op10_topk_search(spark: SparkSession, folder: str) -> DataFrame:
    return topk.searched(read_table(spark, folder, "embeddings"))


CHECKS["op10_topk_search"] = """
WITH rows AS (
  SELECT vec_id, [floor(x::DOUBLE * 256)::BIGINT for x in embedding] AS parts FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len([x for x in embedding if x IS NULL OR isnan(x) OR isinf(x)]) = 0
), pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.parts::DOUBLE[], c.parts::DOUBLE[])::BIGINT AS score
  FROM rows q JOIN rows c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM pairs
)
SELECT query_id, rank::INT AS rank, vec_id, score FROM ranked WHERE rank <= 5
"""


@query
def op2_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    return extraction.extracted(read_table(spark, folder, "pages")).select("page_id", "url", "text", "n_chars")


@query
def op11_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return lengths.counted(read_table(spark, folder, "documents"), vocabulary("word_bpe_49k.json"))


@query
def op13_phrase_mining(spark: SparkSession, folder: str) -> DataFrame:
    return phrases.mined(read_table(spark, folder, "documents"))


CHECKS["op13_phrase_mining"] = phrases.check_sql()


@query
def op12_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    return repair.after_damage(read_table(spark, folder, "conversations"))


CHECKS["op12_conversation_repair"] = repair.check_sql()
