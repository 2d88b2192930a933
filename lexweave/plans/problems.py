"""Queries of the problems that belong to the core, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexweave.operators import orphans
from lexweave.sources.tables import table


def _orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orphans.orphan_references(*(table(spark, sf_dir, t) for t in ("relationships", "entities", "text_units", "tombstones")))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orphans(spark, sf_dir).select("ref_table", "ref_id", "ref_field", "ref_key", "status").distinct()


def p4_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orphans.orphan_report(_orphans(spark, sf_dir))


_KEY = r"""trim(regexp_replace(translate(regexp_replace(nfc_normalize({0}), '[\x{{200b}}\x{{200c}}\x{{200d}}\x{{feff}}]', '', 'g'), '๐๑๒๓๔๕๖๗๘๙', '0123456789'),
  '[\t-\r\x{{1c}}-\x{{20}}\x{{85}}\x{{a0}}\x{{1680}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}]+', ' ', 'g'))"""

_P4 = f"""
WITH rel AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY rel_id ORDER BY loaded_at NULLS LAST, source, target) AS rn FROM relationships) WHERE rn = 1),
ent AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY loaded_at NULLS LAST, source_chunk_ids) AS rn FROM entities) WHERE rn = 1),
refs AS (
  SELECT 'relationships' AS ref_table, CAST(rel_id AS VARCHAR) AS ref_id, 'source' AS ref_field, source AS ref_key, 'entity' AS kind, loaded_at FROM rel
  UNION ALL SELECT 'relationships', CAST(rel_id AS VARCHAR), 'target', target, 'entity', loaded_at FROM rel
  UNION ALL SELECT 'entities', id, 'source_chunk_ids', k, 'chunk', loaded_at FROM (SELECT id, loaded_at, unnest(list_distinct(source_chunk_ids)) AS k FROM ent)),
named AS (SELECT *, {_KEY.format("ref_key")} AS key FROM refs WHERE ref_key IS NOT NULL),
live AS (
  SELECT kind, key, min(loaded_at) AS valid_from FROM (
    SELECT 'entity' AS kind, {_KEY.format("name")} AS key, loaded_at FROM entities UNION ALL SELECT 'chunk', {_KEY.format("chunk_id")}, loaded_at FROM text_units) GROUP BY kind, key),
dead AS (SELECT DISTINCT kind, {_KEY.format("deleted_key")} AS key FROM tombstones),
judged AS (
  SELECT n.*, CASE WHEN l.key IS NULL AND d.key IS NOT NULL THEN 'deleted' WHEN l.key IS NULL THEN 'missing' WHEN l.valid_from > n.loaded_at THEN 'late' END AS status
  FROM named n LEFT JOIN live l ON n.kind = l.kind AND n.key = l.key LEFT JOIN dead d ON n.kind = d.kind AND n.key = d.key WHERE n.key <> '')
"""

QUERIES = {"p4_found": p4_found, "p4_report": p4_report}
ORACLE = {
    "p4_found": _P4 + "SELECT DISTINCT ref_table, ref_id, ref_field, ref_key, status FROM judged WHERE status IS NOT NULL",
    "p4_report": _P4 + "SELECT ref_table, ref_field, status, strftime(loaded_at, '%Y-%m') AS month, count(*) AS n_references, count(DISTINCT ref_id) AS n_records FROM judged WHERE status IS NOT NULL GROUP BY ALL",
}
