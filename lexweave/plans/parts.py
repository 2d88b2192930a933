"""Queries of single operators of search, answers, metrics and sinks, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.config import DEFAULT
from lexweave.functions import text as T
from lexweave.operators import answer, graph, metrics, rank, search
from lexweave.plans import evaluation, extraction, graphs, retrieval
from lexweave.sources import index
from lexweave.sources.tables import table

LAW, FOLDS = "[พรบ.1]", 5
KINDS = ("OFFENSE", "PENALTY", "LEGAL_CONCEPT")


def chapter_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = evaluation._entities(spark, sf_dir).select("name", "source_chunk_ids").distinct()
    return e.select("name", T.display_label(F.col("name")).alias("label"), T.chapter_of(F.col("source_chunk_ids")).alias("chapter"))


def sound_penalties(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = evaluation._entities(spark, sf_dir).where("type = 'PENALTY'").select("name", "description").distinct()
    return e.select("name", F.md5(F.coalesce("description", F.lit(""))).alias("digest"), answer.valid_penalty(F.coalesce("description", F.lit(""))).cast("int").alias("sound"))


def penalty_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation._questions(spark, sf_dir).select("query_id", answer.asks_penalty(F.col("text")).cast("int").alias("asks"))


def _other_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = evaluation._entities(spark, sf_dir).where(F.col("type").isin(*KINDS)).groupBy("name").agg(F.min("type").alias("type"), F.min("description").alias("description"))
    items = e.select(F.col("name").alias("item_id"), F.concat_ws(" ", "name", "description").alias("text"))
    return rank.top_k(rank.bm25(items, retrieval._queries(spark, sf_dir), k=DEFAULT.top_k), DEFAULT.top_k).withColumnRenamed("item_id", "name").join(e, "name")


def answer_extras(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q3, P10: offences, penalties and concepts beside the selected sections."""
    return answer.extras(_other_hits(spark, sf_dir), evaluation.select_sections(spark, sf_dir), retrieval._queries(spark, sf_dir))


def semantic_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M6 over all results; retrieval_recall stands in for the texts' similarity, so it has nulls and values as one has."""
    rows = evaluation._results(spark, sf_dir).where("predicted_answer is not null and question is not null")
    a, q, s = F.col("predicted_answer"), F.col("question"), F.when(F.col("retrieval_recall") > 0, F.col("retrieval_recall"))
    return rows.select("result_id", F.round(metrics.faithfulness(a, q, s) + 1e-9, 6).alias("faithfulness"), F.round(metrics.relevancy(a, q) + 1e-9, 6).alias("relevancy"))


def edge_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edges at each offence."""
    hits = graphs._entities(spark, sf_dir).where(F.col("type") == graphs.SEED).select(F.lit(1).cast("long").alias("query_id"), "name", F.lit(1.0).alias("score"))
    found = graph.expand_edges(hits, graph.adjacency(graphs._simple(spark, sf_dir)), DEFAULT.edge_discount)
    return found.select("name", "type", F.coalesce("description", F.lit("")).alias("description"), "score")


def _first_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "entities").where("name is not null")
    return e.groupBy("name").agg(F.min(F.struct("id", "type", "description", "source_chunk_ids")).alias("e")).select("name", "e.type", "e.description", "e.source_chunk_ids")


def store_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _first_entities(spark, sf_dir)
    members = e.select("name", F.split(F.get("source_chunk_ids", F.lit(0)), "__")[0].alias("community"))
    return index.store_nodes(e, members).select("name", "type", "colour", "source_chunks", "community")


def store_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.store_edges(graphs._edges(spark, sf_dir), graphs._entities(spark, sf_dir)).groupBy("source_type", "type", "target_type").agg(F.count("*").alias("n"), F.round(F.sum("weight"), 4).alias("weight"))


def graph_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.graph_nodes(graphs._entities(spark, sf_dir))


def exact_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.exact_folds(evaluation._questions(spark, sf_dir), "query_id", FOLDS).select("query_id", "fold")


def ranked_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The numbers of the best section hits, and in order of display."""
    found = metrics.ranked_sections(evaluation._section_hits(spark, sf_dir))
    return found.select("query_id", F.array_join("sections", ",").alias("sections"), F.array_join(metrics.display_order(F.col("sections")), ",").alias("display"))


def cited_under_law(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = evaluation._results(spark, sf_dir).where("predicted_answer is not null")
    return rows.select("result_id", F.array_join(F.array_sort(metrics.cited_under_law(F.col("predicted_answer"), LAW)), ",").alias("sections"))


def specificity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.round(rank.specificity(F.col("text"), 0.3, F.lit(0.5)), 6).alias("score"))


def expanded_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions with the beginnings of their two best documents behind them."""
    items, queries = retrieval._items(spark, sf_dir), retrieval._queries(spark, sf_dir)
    found = search.with_bodies(queries, rank.top_k(rank.bm25(items, queries, k=2), 2), items, 2, DEFAULT.hyde_chars)
    return found.select("query_id", F.md5("text").alias("digest"))


def ensemble_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first ten of each question scored again by the mean of two scorers (the BM25 score and the text's length), blended into their order."""
    items = retrieval._items(spark, sf_dir)
    pool = retrieval.bm25_topk(spark, sf_dir).join(items.select("item_id", F.length("text").cast("double").alias("n")), "item_id")
    s = DEFAULT.__class__(ce_top_n=5)
    scorer = lambda head: rank.ensemble(head.withColumn("own", F.col("score")), ["own", "n"])
    found = rank.rerank(pool, lambda head: scorer(head).drop("own"), s)
    return found.select("query_id", "item_id", F.round("score", 6).alias("score"), F.col("rn").cast("long").alias("rn"))


QUERIES = {
    f.__name__: f
    for f in (
        chapter_labels, sound_penalties, penalty_questions, answer_extras, semantic_scores, edge_rows, store_nodes, store_edges, graph_nodes, exact_folds, ranked_sections, cited_under_law, specificity, expanded_questions, ensemble_scores,
    )
}

_q = extraction._q
_FIRST = "first_ent AS (SELECT name, e.type AS type, e.ids AS source_chunk_ids FROM (SELECT name, min({'id': id, 'type': type, 'description': description, 'ids': source_chunk_ids}) AS e FROM entities WHERE name IS NOT NULL GROUP BY name))"
_COLOUR = "CASE type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in index.COLOURS.items()) + f" ELSE '{index.OTHER_COLOUR}' END"
_NUMBER = "translate(regexp_extract({0}, 'มาตรา\\s*([0-9๐-๙]+(?:/[0-9๐-๙]+)?)', 1), '๐๑๒๓๔๕๖๗๘๙', '0123456789')"
_ARABIC = "list_distinct(list_transform(regexp_extract_all({0}, {1}, 1), lambda x: translate(x, '๐๑๒๓๔๕๖๗๘๙', '0123456789')))"
_OVERLAP = "CASE WHEN len({1}) > 0 THEN len(list_intersect({0}, {1})) / len({1}) ELSE 0 END"
_RUN = "'[\\x{0e00}-\\x{0e7f}]{3,}'"
_OTHER = f"oe AS (SELECT name, min(type) AS type, min(description) AS description FROM (SELECT DISTINCT name, type, description, source_chunk_ids FROM entities WHERE name IS NOT NULL) WHERE type IN {KINDS} GROUP BY name)"


ORACLE = {
    "chapter_labels": "SELECT name, regexp_replace(name, '^\\[.*?\\] ', '') AS label, coalesce(replace(string_split(list_filter(source_chunk_ids, lambda x: contains(x, '__'))[1], '__')[2], '_', ' '), '') AS chapter FROM (SELECT DISTINCT name, source_chunk_ids FROM entities WHERE name IS NOT NULL)",
    "sound_penalties": f"SELECT name, md5(d) AS digest, CAST(NOT regexp_matches(d, {_q(answer.PENALTY_NOISE)}) AND regexp_matches(d, {_q(answer.PENALTY_GOOD)}) AS INTEGER) AS sound FROM (SELECT DISTINCT name, description, coalesce(description, '') AS d FROM entities WHERE type = 'PENALTY' AND name IS NOT NULL)",
    "penalty_questions": evaluation._ALL_QUERIES.rstrip(",") + f" SELECT query_id, CAST(regexp_matches(text, {_q(answer.PENALTY_QUERY)}) AS INTEGER) AS asks FROM queries",
    "semantic_scores": evaluation._RES + f""", s AS (SELECT result_id, retrieval_recall AS s, {evaluation._TOK.format('predicted_answer')} AS a, {evaluation._TOK.format('question')} AS b, {evaluation._TOK.format("trim(regexp_replace(predicted_answer, '^คำถาม:[^' || chr(10) || ']*' || chr(10) || '?', ''))")} AS c
 FROM r WHERE predicted_answer IS NOT NULL AND question IS NOT NULL)
SELECT result_id, round(CASE WHEN s > 0 THEN 0.6 * least(1.0, s) + 0.4 * ({_OVERLAP.format('a', 'b')}) ELSE {_OVERLAP.format('a', 'b')} END + 1e-9, 6)::DOUBLE AS faithfulness, round({_OVERLAP.format('c', 'b')} + 1e-9, 6)::DOUBLE AS relevancy FROM s""",
    "edge_rows": graphs._BASE + """, both_ways AS (SELECT a AS src, b AS dst, type, description FROM simple UNION ALL SELECT b, a, type, description FROM simple WHERE a <> b)
SELECT '(' || src || ') -> (' || dst || ')' AS name, type, coalesce(description, '') AS description, 0.7::DOUBLE AS score FROM both_ways WHERE src IN (SELECT name FROM ent WHERE type = 'OFFENSE')""",
    "store_nodes": f"WITH {_FIRST} SELECT name, type, {_COLOUR} AS colour, array_to_string(source_chunk_ids, ', ') AS source_chunks, string_split(source_chunk_ids[1], '__')[1] AS community FROM first_ent",
    "store_edges": graphs._BASE + """ SELECT x.type AS source_type, upper(replace(rel.type, ' ', '_')) AS type, y.type AS target_type, count(*) AS n, round(sum(weight), 4) AS weight FROM rel JOIN ent x ON x.name = source JOIN ent y ON y.name = target GROUP BY ALL""",
    "graph_nodes": graphs._BASE + " SELECT name AS id, CASE WHEN starts_with(name, '[') THEN regexp_replace(name, '^\\[.*?\\] ', '') ELSE name END AS label, type FROM ent",
    "exact_folds": evaluation._ALL_QUERIES.rstrip(",") + f" SELECT query_id, CAST((row_number() OVER (ORDER BY md5('42|' || query_id), query_id) - 1) % {FOLDS} AS INTEGER) AS fold FROM queries",
    "ranked_sections": evaluation._HITS + f""", numbered AS (SELECT query_id, {_NUMBER.format('name')} AS number, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, name) AS p FROM hits WHERE {_NUMBER.format('name')} <> '' QUALIFY p <= 20),
once AS (SELECT query_id, number, min(p) AS p FROM numbered GROUP BY ALL) SELECT query_id, string_agg(number, ',' ORDER BY p) AS sections, string_agg(number, ',' ORDER BY CAST(string_split(number, '/')[1] AS INTEGER), number) AS display FROM once GROUP BY query_id""",
    "cited_under_law": evaluation._RES + f""", s AS (SELECT result_id, {_ARABIC.format('predicted_answer', _q('\\[พรบ\\.1\\]\\s*มาตรา\\s*([0-9๐-๙]+(?:/[0-9๐-๙]+)?)'))} AS named, list_filter(string_split(predicted_answer, chr(10)), lambda x: contains(x, 'มาตราที่เกี่ยวข้อง'))[1] AS line FROM r WHERE predicted_answer IS NOT NULL)
SELECT result_id, array_to_string(list_sort(CASE WHEN line IS NOT NULL THEN list_intersect({_ARABIC.format('line', _q('([0-9๐-๙]+(?:/[0-9๐-๙]+)?)'))}, named) ELSE named END), ',') AS sections FROM s""",
    "specificity": "SELECT doc_id, round(0.7 * 0.5 + 0.3 * (1 / (1 + exp(-(length(text) - 300) / 150.0))), 6) AS score FROM documents WHERE text IS NOT NULL",
    "expanded_questions": retrieval._BASE + retrieval._BM25 + retrieval._ranked("bm25", 2, "b2") + f""", more AS (SELECT query_id, string_agg(substring(text, 1, {DEFAULT.hyde_chars}), ' ' ORDER BY rn) AS more FROM b2 JOIN items USING (item_id) GROUP BY query_id)
SELECT query_id, md5(concat_ws(' ', text, more)) AS digest FROM queries LEFT JOIN more USING (query_id)""",
    "ensemble_scores": retrieval._BASE + retrieval._BM25 + retrieval._ranked("bm25", retrieval.K, "b") + """, pool AS (SELECT b.*, length(text)::DOUBLE AS n FROM b JOIN items USING (item_id)),
head AS (SELECT *, ((score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w + 1e-9) + (n - min(n) OVER w) / (max(n) OVER w - min(n) OVER w + 1e-9)) / 2 AS ce FROM pool WHERE rn <= 5 WINDOW w AS (PARTITION BY query_id)),
head2 AS (SELECT query_id, item_id, round((1 - 0.7) * score + 0.7 * (ce - min(ce) OVER w) / (max(ce) OVER w - min(ce) OVER w + 1e-9) + 1e-9, 6) AS score FROM head WINDOW w AS (PARTITION BY query_id))
SELECT query_id, item_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rn FROM head2 UNION ALL SELECT query_id, item_id, score, rn FROM pool WHERE rn > 5""",
    "answer_extras": evaluation._HITS + evaluation._SELECTED + ", " + _OTHER + f""", oitems AS (SELECT name AS item_id, concat_ws(' ', name, description) AS text FROM oe),
owords AS (SELECT item_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}') AS t FROM oitems WHERE text IS NOT NULL),
opost AS (SELECT item_id, length, term, count(*) AS tf FROM (SELECT item_id, len(t) AS length, unnest(t) AS term FROM owords WHERE len(t) > 0) GROUP BY ALL),
ocorpus AS (SELECT count(*) AS n, avg(length) AS mean_length FROM (SELECT DISTINCT item_id, length FROM opost)),
oraw AS (SELECT term, ln(n - count(*) + 0.5) - ln(count(*) + 0.5) AS raw, mean_length FROM opost, ocorpus GROUP BY term, n, mean_length),
oidf AS (SELECT term, mean_length, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM oraw) ELSE raw END AS idf FROM oraw),
obm AS (SELECT query_id, item_id, round(sum(qf * idf * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * length / mean_length))), 6) AS score FROM asked JOIN oidf USING (term) JOIN opost USING (term) GROUP BY ALL),
{retrieval._ranked("obm", DEFAULT.top_k, "oh0")}, lst AS (SELECT query_id, min(score) AS least FROM selected GROUP BY query_id),
cand AS (SELECT o.query_id, o.item_id AS name, e.type, o.score, coalesce(least, 0) AS least, lower(q.text) AS q, lower(o.item_id) AS n, lower(coalesce(e.description, '')) AS d, q.text AS question, coalesce(e.description, '') AS dd FROM oh0 o JOIN oe e ON e.name = o.item_id JOIN queries q ON q.query_id = o.query_id LEFT JOIN lst ON lst.query_id = o.query_id),
fit AS (SELECT *, CASE WHEN score >= least THEN 'primary' WHEN score > 0.3 THEN 'secondary' END AS role FROM cand WHERE (type <> 'PENALTY' OR (NOT regexp_matches(dd, {_q(answer.PENALTY_NOISE)}) AND regexp_matches(dd, {_q(answer.PENALTY_GOOD)})))
 AND (len(list_filter(regexp_extract_all(n, {_RUN}), lambda x: contains(q, x))) > 0 OR len(list_filter(regexp_extract_all(q, {_RUN}), lambda x: contains(n, x) OR contains(substring(d, 1, 100), x))) > 0 OR (type = 'PENALTY' AND regexp_matches(question, {_q(answer.PENALTY_QUERY)}))))
SELECT query_id, name, type, score, role FROM fit WHERE role IS NOT NULL QUALIFY row_number() OVER (PARTITION BY query_id, role ORDER BY score DESC, name) <= CASE WHEN role = 'primary' THEN {DEFAULT.primary_extras} ELSE {DEFAULT.secondary_extras} END""",
}
