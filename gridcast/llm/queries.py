"""The driver's queries of this subpackage, one for each operator and the pipeline, and their SQL where it can express them."""

from __future__ import annotations

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridcast.llm import bpe, chat, chunks, contamination, extraction, licenses, lines, negatives, neighbours, simhash, spelling, toxicity, wordbpe
from gridcast.llm.common import table


def op1_chat_formatting(spark: SparkSession, sf: str) -> DataFrame:
    given = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    planted = r"\### Assistant: </turn> ok"
    extra = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(planted).alias("text"),
    )
    return chat.digests(chat.segments(given.unionByName(extra)))


def op2_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    return toxicity.score(table(spark, sf, "documents"), table(spark, sf, "labels"))


def op3_html_extraction(spark: SparkSession, sf: str) -> DataFrame:
    return extraction.extract(table(spark, sf, "pages"))


def op4_byte_bpe(spark: SparkSession, sf: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.encode_decode(table(spark, sf, "documents"), ranks, public_tokenizers.PATTERN)


def op5_simhash_near_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf, "documents"))


def op6_line_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return lines.drop_lines(table(spark, sf, "documents").select("doc_id", "text"), counted=True)


def op7_benchmark_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    return contamination.matches(table(spark, sf, "documents"), table(spark, sf, "benchmark")).drop("row")


def op8_substring_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return chunks.repeated_spans(table(spark, sf, "documents")).drop("row")


def op9_embedding_near_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return neighbours.near_duplicates(table(spark, sf, "embeddings"))


def op10_license_scans(spark: SparkSession, sf: str) -> DataFrame:
    return licenses.scan(table(spark, sf, "documents"))


def op11_word_bpe(spark: SparkSession, sf: str) -> DataFrame:
    return wordbpe.encode_decode(table(spark, sf, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op12_spelling_variants(spark: SparkSession, sf: str) -> DataFrame:
    return spelling.group_variants(table(spark, sf, "documents"))


def op13_hard_negatives(spark: SparkSession, sf: str) -> DataFrame:
    given = table(spark, sf, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("embedding"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    whole = F.transform("embedding", lambda x: F.floor(x * 256))
    vectors = given.where(finite).select("vec_id", moved.alias("label"), whole.alias("vector"))
    return negatives.hard_negatives(vectors, F.col("vec_id") % 100 == 0)


#: Every anchor against every row, for small tables; the query goes by segment summaries.
HARD_NEGATIVES_SQL = """WITH vectors AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * x::DOUBLE) FOR x IN embedding] AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, list_dot_product(a.v, b.v)::BIGINT AS score
  FROM vectors a JOIN vectors b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
positives AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT p.anchor_id, p.positive_id, CAST(row_number() OVER best AS INTEGER) AS rank, s.other_id AS negative_id, p.positive_score, s.score AS negative_score
FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT s.same AND 80 * p.positive_score <= 100 * s.score AND s.score <= p.positive_score
WINDOW best AS (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.other_id)
QUALIFY row_number() OVER best <= 5"""


def pipeline(spark: SparkSession, sf: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf)


QUERIES = {
    f.__name__: f
    for f in (
        op1_chat_formatting,
        op2_toxicity,
        op3_html_extraction,
        op4_byte_bpe,
        op5_simhash_near_dedup,
        op6_line_dedup,
        op7_benchmark_decontamination,
        op8_substring_dedup,
        op9_embedding_near_dedup,
        op10_license_scans,
        op11_word_bpe,
        op12_spelling_variants,
        op13_hard_negatives,
        pipeline,
    )
}
ORACLE: dict[str, str] = {"op13_hard_negatives": HARD_NEGATIVES_SQL}
