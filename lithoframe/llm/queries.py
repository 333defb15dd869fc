"""Queries of the training-data problems of this subpackage, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lithoframe.llm.bpe import count_tokens, decode_ids, encode_texts
from lithoframe.llm.linkage import link
from lithoframe.llm.mojibake import repair
from lithoframe.llm.packing import pack_counted
from lithoframe.llm.runs import collapse_runs
from lithoframe.llm.sentences import split_sentences
from lithoframe.runtime import table

#: Metres a position may be from the one before within a standing stretch.
STILL_M = 1.0
#: Confidence from which a pair of records counts as one trace.
SURE = 0.5


def p2_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every standing stretch with its first and last trace, number of traces and duration in seconds."""
    runs = collapse_runs(table(spark, sf_dir, "trajectory"), "line", "trace", "x", "y", "fix_time", valid="valid", max_distance=STILL_M)
    return runs.select(F.col("grp").alias("line"), F.col("first_ord").alias("first_trace"), F.col("last_ord").alias("last_trace"), F.col("n").alias("n_traces"), F.round("duration_s", 3).alias("duration_s"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """line, first_trace, last_trace of every longest stretch of two or more traces each at most 1 m from the one before."""
    return p2_runs(spark, sf_dir).select("line", "first_trace", "last_trace")


def p3_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best A record of every B record, with the confidence that both are one trace."""
    a, b, labels = (table(spark, sf_dir, t) for t in ("prestack_records", "prestack_records_b", "match_labels"))
    return link(a, b, labels)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """a_record_id, b_record_id of the pairs that are more likely one trace than not."""
    return p3_pairs(spark, sf_dir).where(F.col("confidence") >= SURE).select("a_record_id", "b_record_id").distinct()


def p4_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every header with garbled lines, its text as far as it can be restored, and how."""
    return repair(table(spark, sf_dir, "text_headers")).distinct()


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """header_id of every header of which any part was read in the wrong encoding."""
    return repair(table(spark, sf_dir, "text_headers")).where("header_id is not null").select("header_id").distinct()


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, ids: every document's text by byte_bpe_50k, without special tokens; null and empty texts have no ids."""
    return encode_texts(table(spark, sf_dir, "documents"))


def p6_decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text: the ids of every document decoded again."""
    return decode_ids(p6_ids(spark, sf_dir))


def p7_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The container of each document or piece, for every capacity of token_budgets, sized by byte_bpe_50k."""
    return pack_counted(count_tokens(table(spark, sf_dir, "documents")), table(spark, sf_dir, "token_budgets"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, end_char: the end of every sentence of every document."""
    return split_sentences(table(spark, sf_dir, "documents")).select("doc_id", "end_char")


def p8_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every sentence in order with its span and text."""
    return split_sentences(table(spark, sf_dir, "documents"), with_text=True)


_P2 = """
WITH p AS (SELECT line, trace, min({{'x': x, 'y': y}}) AS p, min(fix_time) AS ft FROM trajectory WHERE valid AND isfinite(x) AND isfinite(y) AND line IS NOT NULL AND trace IS NOT NULL GROUP BY 1, 2), t AS (SELECT line, trace, p.x AS x, p.y AS y, ft FROM p),
s AS (SELECT *, CASE WHEN sqrt((x - lag(x) OVER w) * (x - lag(x) OVER w) + (y - lag(y) OVER w) * (y - lag(y) OVER w)) <= 1 THEN 0 ELSE 1 END AS st FROM t WINDOW w AS (PARTITION BY line ORDER BY trace)),
g AS (SELECT *, sum(st) OVER (PARTITION BY line ORDER BY trace) AS isl FROM s)
SELECT line, min(trace) AS first_trace, max(trace) AS last_trace{more} FROM g GROUP BY line, isl HAVING count(*) >= 2
"""

QUERIES = {"p2_found": p2_found, "p2_runs": p2_runs, "p3_found": p3_found, "p3_pairs": p3_pairs, "p4_found": p4_found, "p4_restored": p4_restored, "p6_ids": p6_ids, "p6_decoded": p6_decoded, "p7_containers": p7_containers, "p8_found": p8_found, "p8_sentences": p8_sentences}
SQL = {
    "p2_found": _P2.format(more=""),
    "p2_runs": _P2.format(more=", count(*) AS n_traces, round((epoch_us(max_by(ft, trace)) - epoch_us(min_by(ft, trace))) / 1e6, 3) AS duration_s"),
    "p6_decoded": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
}
