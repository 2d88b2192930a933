"""Queries over entities and relationships, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.operators import graph
from lexweave.sources.tables import table

SEED, DEPTH = "OFFENSE", 2


def _entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "entities").where("name is not null")
    return e.groupBy("name").agg(F.min("id").alias("id"), F.min("type").alias("type"), F.min("loaded_at").alias("t"))


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "relationships").where("source is not null and target is not null")
    return r.groupBy(F.col("rel_id").alias("ord"), "source", "target", "type", "description", "weight").agg(F.min("loaded_at").alias("t")).drop("t")


def _simple(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.simple_edges(graph.within(_edges(spark, sf_dir), _entities(spark, sf_dir)))


def type_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _entities(spark, sf_dir).groupBy("type").agg(F.count("*").alias("n"))


def relationship_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.distinct_relationships(_edges(spark, sf_dir)).select("source", "target", "type", "description", "weight", "n_rows")


def edge_endpoint_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.within(_edges(spark, sf_dir), _entities(spark, sf_dir)).select("ord", "source", "target", "type")


def undirected_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _simple(spark, sf_dir)


def node_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.degrees(_simple(spark, sf_dir))


def one_hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbours of each offence with the best score that reaches them; an offence's own score is 1."""
    hits = _entities(spark, sf_dir).where(F.col("type") == SEED).select(F.lit(1).cast("long").alias("query_id"), "name", F.lit(1.0).alias("score"))
    found = graph.expand(hits, graph.adjacency(_simple(spark, sf_dir)), 0.8)
    return found.groupBy("name").agg(F.max("score").alias("score"), F.count("*").alias("n_via"))


def k_hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    seeds = _entities(spark, sf_dir).where(F.col("type") == SEED)
    return graph.k_hop(seeds, graph.adjacency(_simple(spark, sf_dir)), DEPTH)


def connected_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.components(_entities(spark, sf_dir), _simple(spark, sf_dir))


def community_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports of the communities that a law's own entities make: the entity's first chunk names its law."""
    e = table(spark, sf_dir, "entities").where("name is not null and size(source_chunk_ids) > 0")
    law = F.split(F.get("source_chunk_ids", F.lit(0)), "__")[0]
    members = e.select("name", "type", F.col("id").alias("ord"), law.alias("community")).groupBy("name").agg(F.min(F.struct("ord", "type", "community")).alias("m")).select("name", "m.*").where("community is not null")
    return graph.community_reports(members, _edges(spark, sf_dir))


def modularity_communities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Modularity of label moving beside that of the components."""
    nodes, simple = _entities(spark, sf_dir), _simple(spark, sf_dir)
    moved = graph.modularity(graph.communities(nodes, simple), simple).withColumn("method", F.lit("label_moving"))
    whole = graph.components(nodes, simple).withColumnRenamed("component", "community")
    return moved.unionByName(graph.modularity(whole, simple).withColumn("method", F.lit("components")))


def pending_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks in which the extraction of offences has found nothing yet."""
    done = table(spark, sf_dir, "entities").where(F.col("type") == SEED).select(F.explode("source_chunk_ids").alias("chunk_id")).distinct()
    return table(spark, sf_dir, "text_units").select("chunk_id").distinct().join(done, "chunk_id", "left_anti")


def set_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names by where they stand: in both tables, only among entities, only as a relationship's end."""
    names = table(spark, sf_dir, "entities").select("name").where("name is not null")
    r = table(spark, sf_dir, "relationships")
    ends = r.select(F.col("source").alias("name")).union(r.select(F.col("target").alias("name"))).where("name is not null")
    tag = lambda df, t: df.select("name", F.lit(t).alias("place"))
    return tag(names.intersect(ends), "both").union(tag(names.subtract(ends), "entities")).union(tag(ends.subtract(names), "ends"))


QUERIES = {
    "type_counts": type_counts, "relationship_dedup": relationship_dedup, "edge_endpoint_filter": edge_endpoint_filter, "undirected_graph": undirected_graph, "node_degrees": node_degrees, "one_hop": one_hop, "k_hop": k_hop,
    "connected_components": connected_components, "community_report": community_report, "modularity_communities": modularity_communities, "pending_anti": pending_anti, "set_ops": set_ops,
}

_BASE = """WITH RECURSIVE ent AS (SELECT name, min(id) AS id, min(type) AS type FROM entities WHERE name IS NOT NULL GROUP BY name),
rel AS (SELECT DISTINCT rel_id AS ord, source, target, type, description, weight FROM relationships WHERE source IS NOT NULL AND target IS NOT NULL),
inside AS (SELECT * FROM rel WHERE source IN (SELECT name FROM ent) AND target IN (SELECT name FROM ent)),
simple AS (SELECT a, b, r.type AS type, r.description AS description, r.weight AS weight FROM (
 SELECT least(source, target) AS a, greatest(source, target) AS b, arg_max({'type': type, 'description': description, 'weight': weight}, ord) AS r FROM inside GROUP BY ALL)),
adj AS (SELECT a AS src, b AS dst FROM simple UNION ALL SELECT b, a FROM simple WHERE a <> b)"""
_SHOW = "array_to_string((list(name ORDER BY ord, name) FILTER (type = '{0}'))[1:{1}], ', ')"
ORACLE = {
    "type_counts": _BASE + " SELECT type, count(*) AS n FROM ent GROUP BY type",
    "relationship_dedup": _BASE + """ SELECT source, target, type, r.description AS description, r.weight AS weight, n_rows FROM (
 SELECT source, target, type, arg_min({'description': description, 'weight': weight}, ord) AS r, count(*) AS n_rows FROM rel GROUP BY ALL)""",
    "edge_endpoint_filter": _BASE + " SELECT ord, source, target, type FROM inside",
    "undirected_graph": _BASE + " SELECT * FROM simple",
    "node_degrees": _BASE + " SELECT src AS name, count(*) AS degree FROM adj GROUP BY src",
    "one_hop": _BASE + " SELECT dst AS name, max(0.8::DOUBLE) AS score, count(*) AS n_via FROM adj WHERE src IN (SELECT name FROM ent WHERE type = 'OFFENSE') GROUP BY dst",
    "k_hop": _BASE + """, walk AS (SELECT name, CAST(0 AS BIGINT) AS hops FROM ent WHERE type = 'OFFENSE' UNION SELECT dst, hops + 1 FROM walk JOIN adj ON src = name WHERE hops < 2)
SELECT name, min(hops) AS hops FROM walk GROUP BY name""",
    "connected_components": _BASE + """, label AS (SELECT name, name AS c FROM ent UNION SELECT dst, c FROM label JOIN adj ON src = label.name)
SELECT name, min(c) AS component FROM label GROUP BY name""",
    "community_report": _BASE + f""", m0 AS (SELECT name, min({{'ord': id, 'type': type, 'community': string_split(source_chunk_ids[1], '__')[1]}}) AS m FROM entities WHERE name IS NOT NULL AND len(source_chunk_ids) > 0 GROUP BY name),
mem AS (SELECT name, m.ord AS ord, m.type AS type, m.community AS community FROM m0 WHERE m.community IS NOT NULL),
inner_rel AS (SELECT x.community, count(*) AS n FROM rel JOIN mem x ON x.name = source JOIN mem y ON y.name = target WHERE x.community = y.community GROUP BY x.community),
w AS (SELECT community, count(*) AS n_members, count(*) FILTER (type = 'OFFENSE') AS no, count(*) FILTER (type = 'SECTION') AS ns, arg_max(name, (ord, name)) FILTER (type = 'SECTION') AS last_section,
 {_SHOW.format('OFFENSE', 3)} AS o3, {_SHOW.format('OFFENSE', 1)} AS o1, {_SHOW.format('SECTION', 1)} AS s1, {_SHOW.format('SECTION', 5)} AS s5, {_SHOW.format('LAW', 2)} AS l2, {_SHOW.format('LEGAL_CONCEPT', 1)} AS c1, {_SHOW.format('LEGAL_CONCEPT', 3)} AS c3, {_SHOW.format('PENALTY', 3)} AS p3 FROM mem GROUP BY community)
SELECT w.community, CASE WHEN no = 1 THEN o1 WHEN no > 1 THEN concat('กลุ่มความผิด: ', o3) WHEN ns = 1 THEN s1 WHEN ns > 1 THEN concat('กลุ่มมาตรา ', s1, '–', last_section) WHEN c1 IS NOT NULL THEN c1 ELSE concat('กลุ่มที่ ', w.community) END AS title,
 coalesce(nullif(array_to_string(list_filter(['กฎหมาย: ' || l2, 'มาตรา: ' || s5 || CASE WHEN ns > 5 THEN concat(' (รวม ', ns, ' มาตรา)') ELSE '' END, 'ความผิด: ' || o3, 'บทลงโทษ: ' || p3, 'แนวคิด: ' || c3], lambda x: x IS NOT NULL), '; '), ''), 'ไม่มีข้อมูล') AS summary,
 round(least(1.0, (n_members + coalesce(n, 0)) / 50.0), 6) AS importance, n_members, coalesce(n, 0) AS n_relationships FROM w LEFT JOIN inner_rel i ON i.community = w.community""",
    "pending_anti": "SELECT DISTINCT chunk_id FROM text_units WHERE chunk_id IS NOT NULL AND chunk_id NOT IN (SELECT k FROM (SELECT unnest(source_chunk_ids) AS k FROM entities WHERE type = 'OFFENSE') WHERE k IS NOT NULL)",
    "set_ops": """WITH n AS (SELECT name FROM entities WHERE name IS NOT NULL), e AS (SELECT source AS name FROM relationships WHERE source IS NOT NULL UNION SELECT target FROM relationships WHERE target IS NOT NULL)
SELECT name, 'both' AS place FROM (SELECT name FROM n INTERSECT SELECT name FROM e) UNION ALL SELECT name, 'entities' FROM (SELECT name FROM n EXCEPT SELECT name FROM e) UNION ALL SELECT name, 'ends' FROM (SELECT name FROM e EXCEPT SELECT name FROM n)""",
}
