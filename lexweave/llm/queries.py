"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.llm import leaks, overlaps, packing, pairs, pieces, sentences, subjects, truncation
from lexweave.sources.tables import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = overlaps.overlaps(table(spark, sf_dir, "qa_pairs"))
    return found.select(F.least("qa_id_e", "qa_id_t").alias("qa_id_a"), F.greatest("qa_id_e", "qa_id_t").alias("qa_id_b")).distinct()


def p1_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlaps.overlap_report(table(spark, sf_dir, "qa_pairs"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentences.sentence_units(table(spark, sf_dir, "legal_sections"), table(spark, sf_dir, "niti_results"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.broken_pairs(table(spark, sf_dir, "niti_results"))


def p3_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "niti_results")
    return pairs.defect_report(pairs.broken_pairs(rows), rows)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.oversized_tables(table(spark, sf_dir, "legal_sections"), table(spark, sf_dir, "text_units")).select("rec_table", "rec_id")


def p5_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.piece_rows(pieces.oversized_tables(table(spark, sf_dir, "legal_sections"), table(spark, sf_dir, "text_units")))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncation.truncated(table(spark, sf_dir, "entities"), table(spark, sf_dir, "niti_results")).select("rec_table", "rec_id")


def p6_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncation.truncation_report(table(spark, sf_dir, "entities"), table(spark, sf_dir, "niti_results"))


def p7_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items")).select("doc_id", "item_id").distinct()


def p8_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items")
    return leaks.leak_report(leaks.leaks(documents, items), documents, items)


def _subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = (table(spark, sf_dir, t) for t in ("documents", "subject_examples", "subjects"))
    return subjects.subjects(*tables, table(spark, sf_dir, "legal_sections").select("raw_text"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _subjects(spark, sf_dir).select("doc_id", "subject_id").distinct()


def p9_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subjects.composition(_subjects(spark, sf_dir), table(spark, sf_dir, "subjects"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"p1_found": p1_found, "p1_report": p1_report, "p2_found": p2_found, "p3_found": p3_found, "p3_report": p3_report, "p5_found": p5_found, "p5_pieces": p5_pieces, "p6_found": p6_found, "p6_report": p6_report, "p7_containers": p7_containers, "p8_found": p8_found, "p8_report": p8_report, "p9_found": p9_found, "p9_composition": p9_composition}


def oracle_sql() -> dict[str, str]:
    return {"p5_found": P5_FOUND}


P5_FOUND = r"""
WITH texts AS (
  SELECT 'legal_sections' AS rec_table, CAST(section_id AS VARCHAR) AS rec_id, raw_text AS t, loaded_at FROM legal_sections
  UNION ALL SELECT 'text_units', chunk_id, text, loaded_at FROM text_units),
firsts AS (SELECT rec_table, rec_id, t, row_number() OVER (PARTITION BY rec_table, rec_id ORDER BY loaded_at NULLS LAST) AS rn FROM texts WHERE rec_id IS NOT NULL)
SELECT rec_table, rec_id FROM firsts
WHERE rn = 1 AND len(regexp_extract_all(t, '[A-Za-z]+|[0-9]+|[\x{0e00}-\x{0e7f}]{1,3}|[^ \t\r\n\x{00a0}\x{3000}A-Za-z0-9\x{0e00}-\x{0e7f}]')) > 1200
"""
