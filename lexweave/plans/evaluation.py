"""Queries of search, answers and metrics, and their SQL.

Questions searched against all rows are the qa_pairs whose id is divisible by 20; those held against a dictionary are all of
qa_pairs. Results are all rows of niti_results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexweave import lexicon
from lexweave.config import DEFAULT
from lexweave.operators import answer, graph, metrics, rank, search
from lexweave.plans import extraction, graphs, retrieval
from lexweave.sources.tables import table

LAWS = ["อาญา", "แพ่ง", "รธน"]
DEPTH, FOLDS = 200, 5
_queries = retrieval._queries


def _questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "qa_pairs").where("qa_id is not null and question is not null").groupBy(F.col("qa_id").alias("query_id")).agg(F.min("question").alias("text"))


def _entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "entities").where("name is not null").select("name", "type", "description", "source_chunk_ids").distinct()


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "text_units").select("chunk_id", "text").distinct()


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "niti_results").drop("run_at").distinct()


def _words(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k,) for k, _ in lexicon.OFFENSES + lexicon.CONCEPTS], "keyword string")


def item_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = search.item_texts(_entities(spark, sf_dir), _chunks(spark, sf_dir))
    return items.select("item_type", "name", F.md5("text").alias("digest"), F.length("text").cast("long").alias("n_chars"))


def fuzzy_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.matched_keywords(_questions(spark, sf_dir), _words(spark))


def keyword_suppress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.suppress_contained(search.matched_keywords(_questions(spark, sf_dir), _words(spark), fuzzy=False))


def _expansions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexicon.derived_expansions(graphs._entities(spark, sf_dir), graphs._edges(spark, sf_dir))


def query_expansion_boost(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = _expansions(spark, sf_dir)
    return search.expansion_boost(search.suppress_contained(search.matched_words(_questions(spark, sf_dir), words)), words)


def section_mention_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over the answers of all results, which name sections as questions here seldom do."""
    texts = _results(spark, sf_dir).select(F.col("result_id").alias("query_id"), F.col("predicted_answer").alias("text")).where("text is not null")
    return search.mentioned_sections(texts, LAWS)


def concept_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over the descriptions of all entities, which name concepts as questions here do not."""
    texts = _entities(spark, sf_dir).select(F.col("name").alias("query_id"), F.col("description").alias("text")).where("text is not null").distinct()
    adj = graph.adjacency(graphs._simple(spark, sf_dir))
    return search.concept_sections(texts, _entities(spark, sf_dir), adj).groupBy("name").agg(F.count("*").alias("n_questions"))


def _chunk_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _chunks(spark, sf_dir).select(F.col("chunk_id").alias("item_id"), "text")
    return rank.top_k(rank.bm25(items, _queries(spark, sf_dir), k=10), 10).select("query_id", F.col("item_id").alias("chunk_id"), "score", "rn")


def chunk_to_entity_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.chunk_entities(_chunk_hits(spark, sf_dir), _entities(spark, sf_dir))


def _section_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _entities(spark, sf_dir).where("type = 'SECTION'").select(F.col("name").alias("item_id"), F.concat_ws(" ", "name", "description").alias("text"))


def _section_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank.top_k(rank.bm25(_section_items(spark, sf_dir), _queries(spark, sf_dir), k=DEFAULT.top_k), DEFAULT.top_k).withColumnRenamed("item_id", "name")


def law_boost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answer.boost(_section_hits(spark, sf_dir), _queries(spark, sf_dir)).select("query_id", "name", "score", "boosted_score")


def select_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answer.select_sections(_section_hits(spark, sf_dir))


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    statutes = search.resolved_sections(_entities(spark, sf_dir).where("type = 'SECTION'"), _chunks(spark, sf_dir))
    return answer.render(select_sections(spark, sf_dir), statutes, _queries(spark, sf_dir)).select("query_id", F.md5("answer").alias("digest"))


def _local(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.local_search(_queries(spark, sf_dir), _entities(spark, sf_dir), _chunks(spark, sf_dir), graphs._edges(spark, sf_dir), _expansions(spark, sf_dir))


def local_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _local(spark, sf_dir).select("query_id", "name", "type", F.md5("description").alias("digest"), "score", "origin")


def global_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.global_search(_queries(spark, sf_dir), graphs.community_report(spark, sf_dir))


def hybrid_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.hybrid(_local(spark, sf_dir), global_rank(spark, sf_dir))


def hit_mrr_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, t = F.col("retrieved_sections"), F.col("ground_truth_sections")
    r = lambda c: F.round(c, 6)
    ten, twenty = metrics.at_k(p, t, 10), metrics.at_k(p, t, 20)
    return _results(spark, sf_dir).select(
        "result_id", metrics.hit(p, t).alias("hit_rate"), r(metrics.precision(p, t)).alias("context_precision"), r(metrics.recall(p, t)).alias("context_recall"), r(metrics.reciprocal_rank(p, t)).alias("reciprocal_rank"),
        r(ten["precision"]).alias("p10"), r(ten["recall"]).alias("r10"), r(twenty["recall"]).alias("r20"),
    )


def citation_prf(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = metrics.citation(F.col("cited_sections"), F.col("ground_truth_sections"))
    return _results(spark, sf_dir).select("result_id", *(F.round(c[k], 6).alias(k) for k in ("precision", "recall", "f1")))


def micro_macro_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.micro(_results(spark, sf_dir), "cited_sections", "ground_truth_sections", ["generator"])


def citation_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _results(spark, sf_dir).where("predicted_answer is not null").select("result_id", F.array_join(F.array_sort(metrics.cited_sections(F.col("predicted_answer"))), ",").alias("sections"))


def keyword_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _results(spark, sf_dir).where("predicted_answer is not null and question is not null")
    return rows.select("result_id", F.round(metrics.overlap(F.col("predicted_answer"), F.col("question")), 6).alias("overlap"), F.round(metrics.benchmark_overlap(F.col("predicted_answer"), F.col("question")), 6).alias("benchmark_overlap"))


def kfold_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["mrr", "retrieval_recall", "citation_f1"]
    per_fold = _results(spark, sf_dir).groupBy(metrics.fold_of(F.col("idx"), FOLDS).alias("fold")).agg(*(F.avg(m).alias(m) for m in names))
    return metrics.fold_summary(per_fold, names)


def _strategies(spark: SparkSession, sf_dir: str) -> DataFrame:
    items, queries = _section_items(spark, sf_dir), _queries(spark, sf_dir)
    lists = {"bm25": rank.top_k(rank.bm25(items, queries, k=DEPTH), DEPTH), "tfidf": rank.top_k(rank.tfidf(items, queries, k=DEPTH), DEPTH)}
    lists["rrf"] = rank.top_k(rank.fuse(lists), DEPTH)
    every = None
    for name, df in lists.items():
        own = df.select(F.lit(name).alias("strategy"), "query_id", "item_id", "rn")
        both = own.unionByName(own.where(F.col("item_id").startswith("[พรบ.")).withColumn("strategy", F.lit(f"{name}+law")))
        every = both if every is None else every.unionByName(both)
    number = F.regexp_extract("item_id", r"มาตรา\s*([0-9]+(?:/[0-9]+)?)", 1)
    first = every.repartition(F.xxhash64("query_id")).groupBy("strategy", "query_id", number.alias("number")).agg(F.min("rn").alias("rn"))
    return first.groupBy("strategy", "query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rn", "number"))), lambda x: x["number"]).alias("sections"))  # at most DEPTH rows


def _truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    clean = F.array_distinct(F.transform("relevant_sections", lambda x: F.translate(F.trim(x), "๐๑๒๓๔๕๖๗๘๙", "0123456789")))
    return table(spark, sf_dir, "qa_pairs").where("qa_id % 20 = 0 and question is not null").select(F.col("qa_id").alias("query_id"), clean.alias("truth")).distinct()


def strategy_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.strategy_matrix(_strategies(spark, sf_dir), _truth(spark, sf_dir))


def best_strategy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per metric the strategy of the greatest mean; equal ones by name."""
    long = strategy_matrix(spark, sf_dir).select("strategy", F.expr("stack(6, 'hit', hit, 'mrr', mrr, 'p10', p10, 'r10', r10, 'r20', r20, 'f10', f10) as (metric, value)"))
    w = Window.partitionBy("metric").orderBy(F.desc("value"), "strategy")
    return long.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


def progress_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running means in order of result, per generator."""
    found = metrics.running_means(_results(spark, sf_dir), "generator", "result_id", ["mrr", "citation_f1"])
    return found.select("generator", "result_id", F.round(F.col("mrr") + 1e-9, 6).alias("mean_mrr"), F.round(F.col("citation_f1") + 1e-9, 6).alias("mean_f1"))


def graph_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 50 nodes by id and the edges with both ends among them."""
    nodes = graphs._entities(spark, sf_dir).orderBy("id", "name").limit(50)
    return graph.within(graphs._edges(spark, sf_dir), nodes).select("source", "target", "type", F.round(F.col("weight") * 2, 6).alias("width"))


QUERIES = {
    f.__name__: f
    for f in (
        item_union, fuzzy_contains, keyword_suppress, query_expansion_boost, section_mention_hits, concept_sections, chunk_to_entity_first, law_boost, select_sections, answers, local_search, global_rank, hybrid_union,
        hit_mrr_recall, citation_prf, micro_macro_f1, citation_parse, keyword_overlap, kfold_summary, strategy_matrix, best_strategy, progress_means, graph_view,
    )
}


def _bm25(items: str) -> str:
    """CTEs asked, post, idf, bm25 over the CTE items."""
    base = retrieval._BASE.replace("WITH items AS (SELECT doc_id AS item_id, text FROM documents),", "").lstrip()
    return items + base + retrieval._BM25


_BASE_REST = retrieval._BASE.replace("WITH items AS (SELECT doc_id AS item_id, text FROM documents),", "").lstrip()
_q = extraction._q
_ENT = "ent AS (SELECT DISTINCT name, type, description, source_chunk_ids FROM entities WHERE name IS NOT NULL), ch AS (SELECT DISTINCT chunk_id, text FROM text_units),"
_QUERIES = "WITH queries AS (SELECT qa_id AS query_id, min(question) AS text FROM qa_pairs WHERE qa_id % 20 = 0 AND question IS NOT NULL GROUP BY qa_id),"
_RES = "WITH r AS (SELECT DISTINCT * EXCLUDE run_at FROM niti_results)"
_SECTION_BM25 = _bm25("WITH items AS (SELECT DISTINCT name AS item_id, concat_ws(' ', name, description) AS text FROM entities WHERE type = 'SECTION' AND name IS NOT NULL),")
_HITS = _SECTION_BM25 + retrieval._ranked("bm25", DEFAULT.top_k, "hits0") + ", hits AS (SELECT query_id, item_id AS name, score, rn FROM hits0)"
_rx = lambda words: f"regexp_matches(text, {_q('|'.join(words))})"
_FACTOR = f"""CASE WHEN law = 'อาญา' AND {_rx(lexicon.CRIMINAL_SIGNS)} THEN 1.25 WHEN law = 'แพ่ง' AND {_rx(lexicon.CIVIL_SIGNS)} THEN 1.25
 WHEN law = 'รธน' THEN CASE WHEN {_rx(lexicon.CONSTITUTION_SIGNS)} AND NOT {_rx(lexicon.ROYAL_OFFENSE_SIGNS)} THEN 1.2 WHEN {_rx(lexicon.CIVIL_SIGNS)} THEN 0.9 WHEN {_rx(lexicon.CRIMINAL_SIGNS)} THEN 0.85 ELSE 1.0 END ELSE 1.0 END"""
_SELECTED = f""", kept AS (SELECT *, max(score) OVER (PARTITION BY query_id) AS top FROM hits WHERE rn <= {DEFAULT.max_sections}),
floor AS (SELECT * FROM kept WHERE rn = 1 OR score >= {DEFAULT.floor_share} * top),
gaps AS (SELECT *, round(score - lead(score) OVER (PARTITION BY query_id ORDER BY rn), 6) AS gap FROM floor),
cuts AS (SELECT query_id, arg_max(rn, (gap, -rn)) AS cut FROM gaps WHERE gap >= {DEFAULT.gap} GROUP BY query_id),
selected AS (SELECT g.query_id, name, score, rn FROM gaps g LEFT JOIN cuts USING (query_id) WHERE cut IS NULL OR rn <= cut)"""
_STATUTE = r"""men0 AS (SELECT chunk_id, text, regexp_extract_all(text, 'มาตรา\s*[0-9๐-๙]+(?:/[0-9๐-๙]+)?') AS hits, regexp_split_to_array(text, 'มาตรา\s*[0-9๐-๙]+(?:/[0-9๐-๙]+)?') AS gaps FROM ch WHERE text IS NOT NULL),
men AS (SELECT chunk_id, length(text) AS n, translate(regexp_extract(hits[i], 'มาตรา\s*([0-9๐-๙]+(?:/[0-9๐-๙]+)?)', 1), '๐๑๒๓๔๕๖๗๘๙', '0123456789') AS number,
 list_sum(list_transform(gaps[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda h: length(h))), 0) AS start FROM (SELECT *, unnest(generate_series(1, len(hits))) AS i FROM men0)),
runs AS (SELECT *, CASE WHEN number <> coalesce(lag(number) OVER w, '') THEN start END AS opens FROM men WINDOW w AS (PARTITION BY chunk_id ORDER BY start)),
stops AS (SELECT *, coalesce(min(opens) OVER (PARTITION BY chunk_id ORDER BY start ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), n) AS stop FROM runs),
spans AS (SELECT chunk_id, number, min(start) AS start, arg_min(stop, start) AS stop FROM stops GROUP BY ALL),
own AS (SELECT name, translate(regexp_extract(name, 'มาตรา\s*([0-9๐-๙]+(?:/[0-9๐-๙]+)?)', 1), '๐๑๒๓๔๕๖๗๘๙', '0123456789') AS number, unnest(source_chunk_ids) AS chunk_id, generate_subscripts(source_chunk_ids, 1) AS pos FROM ent WHERE type = 'SECTION'),
st AS (SELECT name, trim(substring(text, CAST(start + 1 AS BIGINT), CAST(stop - start AS BIGINT))) AS statute FROM (SELECT name, chunk_id, start, stop FROM own JOIN spans USING (chunk_id, number) WHERE number <> '' QUALIFY row_number() OVER (PARTITION BY name ORDER BY pos) = 1) JOIN ch USING (chunk_id))"""
_P, _T = "list_distinct(coalesce({0}, []))", "list_distinct(coalesce(ground_truth_sections, []))"
_WORDS = ", ".join(f"({_q(k)})" for k, _ in lexicon.OFFENSES + lexicon.CONCEPTS)
_ALL_QUERIES = "WITH queries AS (SELECT qa_id AS query_id, min(question) AS text FROM qa_pairs WHERE qa_id IS NOT NULL AND question IS NOT NULL GROUP BY qa_id),"
_EXPANSIONS = r"""en AS (SELECT name, min(type) AS type FROM entities WHERE name IS NOT NULL GROUP BY name),
ew AS (SELECT DISTINCT name, trim(regexp_replace(name, '\s*\([^()]*\)$', '')) AS keyword FROM en WHERE type IN ('OFFENSE', 'LEGAL_CONCEPT')),
ee AS (SELECT keyword, source AS section, max(coalesce(weight, 0.0)) AS weight FROM relationships JOIN ew ON target = name WHERE length(keyword) > 1 AND regexp_matches(source, '^\[[^\]]+\] มาตรา [0-9]') GROUP BY ALL),
ex AS (SELECT keyword, regexp_extract(section, '^(\[[^\]]+\]) มาตรา (.+)$', 1) AS prefix, regexp_extract(section, '^(\[[^\]]+\]) มาตรา (.+)$', 2) AS section, row_number() OVER (PARTITION BY keyword ORDER BY weight DESC, section) AS ord FROM ee QUALIFY ord <= 10),
words AS (SELECT keyword, count(*) AS n FROM ex GROUP BY keyword),"""
_STOP = ", ".join(_q(w) for w in lexicon.STOP_WORDS)
_TOK = (
    "list_distinct(list_concat(list_filter(regexp_extract_all({0}, '[\\x{{0e00}}-\\x{{0e7f}}]{{2,}}'), lambda w: w NOT IN ("
    + _STOP.replace("{", "{{")
    + ")), list_transform(regexp_extract_all({0}, 'มาตรา\\s*([0-9]+(?:/[0-9]+)?)', 1), lambda n: '§' || n)))"
)
_TOK2 = "list_distinct(regexp_extract_all(lower({0}), '[\\x{{0e00}}-\\x{{0e7f}}]{{2,}}|[a-z]{{2,}}'))"
_SUPPRESS = "matched AS (SELECT query_id, keyword FROM queries JOIN words ON contains(text, keyword)), left_over AS (SELECT * FROM matched m WHERE NOT EXISTS (SELECT 1 FROM matched o WHERE o.query_id = m.query_id AND contains(o.keyword, m.keyword) AND length(o.keyword) > length(m.keyword)))"
_GLOBAL = (
    graphs.ORACLE["community_report"].replace("SELECT w.community, CASE", ", rep AS (SELECT w.community, CASE", 1)
    + """), queries AS (SELECT qa_id AS query_id, min(question) AS text FROM qa_pairs WHERE qa_id % 20 = 0 AND question IS NOT NULL GROUP BY qa_id),
qw AS (SELECT query_id, unnest(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '')) AS word FROM queries),
g0 AS (SELECT query_id, community, round(count(*) + importance, 6) AS score FROM (SELECT community, importance, lower(concat_ws(' ', title, summary)) AS body FROM rep) JOIN qw ON contains(body, word) GROUP BY query_id, community, importance),
g AS (SELECT query_id, community, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, community) AS rn FROM g0 QUALIFY rn <= 5)"""
)
_STRATEGIES = _SECTION_BM25 + retrieval._TFIDF + retrieval._ranked("bm25", DEPTH, "b") + "," + retrieval._ranked("tfidf", DEPTH, "t") + f""",
fused AS (SELECT query_id, item_id, round(sum(1.0 / (60 + rn)), 8) AS score FROM (SELECT query_id, item_id, rn FROM b UNION ALL SELECT query_id, item_id, rn FROM t) GROUP BY ALL), {retrieval._ranked("fused", DEPTH, "f")},
lists AS (SELECT 'bm25' AS strategy, query_id, item_id, rn FROM b UNION ALL SELECT 'tfidf', query_id, item_id, rn FROM t UNION ALL SELECT 'rrf', query_id, item_id, rn FROM f),
lists2 AS (SELECT * FROM lists UNION ALL SELECT strategy || '+law', query_id, item_id, rn FROM lists WHERE starts_with(item_id, '[พรบ.')),
numbers AS (SELECT strategy, query_id, regexp_extract(item_id, 'มาตรา\\s*([0-9]+(?:/[0-9]+)?)', 1) AS number, min(rn) AS rn FROM lists2 GROUP BY ALL),
placed AS (SELECT *, row_number() OVER (PARTITION BY strategy, query_id ORDER BY rn, number) AS pos FROM numbers),
truth0 AS (SELECT DISTINCT qa_id AS query_id, list_distinct(list_transform(relevant_sections, lambda x: translate(trim(x), '๐๑๒๓๔๕๖๗๘๙', '0123456789'))) AS truth FROM qa_pairs WHERE qa_id % 20 = 0 AND question IS NOT NULL),
truth AS (SELECT query_id, any_value(truth) AS truth FROM truth0 GROUP BY query_id),
scored AS (SELECT strategy, query_id, any_value(len(truth)) AS nt, coalesce(1.0 / min(pos) FILTER (list_contains(truth, number)), 0) AS mrr, count(*) FILTER (pos <= 10 AND list_contains(truth, number)) AS n10, count(*) FILTER (pos <= 20 AND list_contains(truth, number)) AS n20
 FROM (SELECT DISTINCT strategy FROM placed) CROSS JOIN truth LEFT JOIN placed USING (strategy, query_id) GROUP BY ALL),
each AS (SELECT strategy, mrr, CASE WHEN n10 > 0 THEN 1.0 ELSE 0.0 END AS hit, n10 / 10.0 AS p10, CASE WHEN nt > 0 THEN n10 / nt ELSE 0 END AS r10, CASE WHEN nt > 0 THEN n20 / nt ELSE 0 END AS r20 FROM scored),
matrix AS (SELECT strategy, count(*) AS n, round(avg(hit), 6) AS hit, round(avg(mrr), 6) AS mrr, round(avg(p10), 6) AS p10, round(avg(r10), 6) AS r10, round(avg(r20), 6) AS r20, round(avg(CASE WHEN p10 + r10 > 0 THEN 2 * p10 * r10 / (p10 + r10) ELSE 0 END), 6) AS f10 FROM each GROUP BY strategy)"""

ORACLE = {
    "item_union": "WITH " + _ENT + _STATUTE + """ SELECT 'entity' AS item_type, name, md5(t) AS digest, length(t) AS n_chars FROM (SELECT ent.name AS name, CASE WHEN type = 'SECTION' THEN 'SECTION: ' || ent.name || chr(10) || substring(coalesce(statute, description, ''), 1, 1500)
 ELSE type || ': ' || ent.name || ' - ' || coalesce(description, '') END AS t FROM ent LEFT JOIN st USING (name)) UNION ALL SELECT 'chunk', chunk_id, md5(substring(text, 1, 800)), length(substring(text, 1, 800)) FROM ch""",
    "fuzzy_contains": _ALL_QUERIES + f""" words(keyword) AS (VALUES {_WORDS}) SELECT DISTINCT query_id, keyword FROM queries, words WHERE contains(text, keyword) OR (length(keyword) >= 5 AND (
 len(list_filter(generate_series(1, length(keyword)), lambda i: contains(text, substring(keyword, 1, i - 1) || substring(keyword, i + 1)))) > 0
 OR len(list_filter(generate_series(1, greatest(length(text) - length(keyword) + 1, 1)), lambda s: length(substring(text, s, length(keyword) + 1)) >= length(keyword) AND len(list_filter(generate_series(1, length(keyword) + 1),
  lambda i: substring(substring(text, s, length(keyword) + 1), 1, i - 1) || substring(substring(text, s, length(keyword) + 1), i + 1) = keyword)) > 0)) > 0))""",
    "keyword_suppress": _ALL_QUERIES + f" words(keyword) AS (SELECT DISTINCT * FROM (VALUES {_WORDS})), {_SUPPRESS} SELECT * FROM left_over",
    "query_expansion_boost": _ALL_QUERIES + _EXPANSIONS + _SUPPRESS + """
SELECT query_id, prefix || ' มาตรา ' || section AS name, round(max(1.5 + (n - (ord - 1)) * 0.1), 6)::DOUBLE AS score FROM left_over JOIN ex USING (keyword) JOIN words USING (keyword) GROUP BY ALL""",
    "section_mention_hits": _RES + r""", n AS (SELECT result_id AS query_id, unnest(list_distinct(regexp_extract_all(predicted_answer, 'มาตรา\s*([0-9]+(?:/[0-9]+)?)', 1))) AS n FROM r WHERE predicted_answer IS NOT NULL)
SELECT query_id, p || 'มาตรา ' || n AS name FROM n, (VALUES ('[อาญา] '), ('[แพ่ง] '), ('[รธน] '), ('')) v(p)""",
    "concept_sections": graphs._BASE + """, cn AS (SELECT DISTINCT name FROM entities WHERE type = 'LEGAL_CONCEPT' AND name <> ''), qs AS (SELECT DISTINCT name AS query_id, description AS text FROM entities WHERE name IS NOT NULL AND description IS NOT NULL),
held AS (SELECT query_id, name FROM qs JOIN cn ON contains(text, name)),
near AS (SELECT DISTINCT query_id, dst FROM held JOIN adj ON src = held.name WHERE dst IN (SELECT name FROM ent WHERE type = 'SECTION')) SELECT dst AS name, count(*) AS n_questions FROM near GROUP BY dst""",
    "chunk_to_entity_first": _bm25("WITH items AS (SELECT DISTINCT chunk_id AS item_id, text FROM text_units),") + retrieval._ranked("bm25", 10, "hits") + """,
ent AS (SELECT DISTINCT name, type, description, source_chunk_ids FROM entities WHERE name IS NOT NULL), e AS (SELECT name, unnest(source_chunk_ids) AS item_id, generate_subscripts(source_chunk_ids, 1) AS pos FROM ent)
SELECT query_id, name, round(arg_min(score, (rn, pos)) * 0.95 + 1e-9, 6) AS score FROM hits JOIN e USING (item_id) GROUP BY ALL""",
    "law_boost": _HITS + f" SELECT query_id, name, score, round(score * {_FACTOR}, 6)::DOUBLE AS boosted_score FROM (SELECT hits.*, text, regexp_extract(name, '^\\[([^\\]]+)\\]', 1) AS law FROM hits JOIN queries USING (query_id))",
    "select_sections": _HITS + _SELECTED + " SELECT * FROM selected",
    "answers": _HITS + _SELECTED + "," + _ENT + _STATUTE + f""", lines AS (SELECT query_id, string_agg(concat_ws(chr(10), name, statute), chr(10) || chr(10) ORDER BY rn) AS body, list(regexp_extract(name, 'มาตรา\\s*([0-9]+(?:/[0-9]+)?)', 1) ORDER BY rn) AS n FROM selected LEFT JOIN st USING (name) GROUP BY query_id),
full_text AS (SELECT query_id, body || chr(10) || chr(10) || {_q(answer.CITED)} || array_to_string(list_transform(CASE WHEN len(n) = 2 AND n[1] = n[2] THEN n[1:1] ELSE n END, lambda x: 'มาตรา ' || x), ', ') AS answer FROM lines)
SELECT query_id, md5(CASE WHEN length(trim(coalesce(answer, ''))) < 20 THEN {_q(answer.NOT_FOUND)} ELSE answer END) AS digest FROM queries LEFT JOIN full_text USING (query_id)""",
    "global_rank": _GLOBAL + " SELECT * FROM g",
    "hit_mrr_recall": _RES + f""", s AS (SELECT result_id, coalesce(retrieved_sections, []) AS p, {_T} AS t FROM r)
SELECT result_id, CASE WHEN len(t) = 0 OR list_has_any(p, t) THEN 1.0 ELSE 0.0 END::DOUBLE AS hit_rate, round(CASE WHEN len(p) > 0 THEN len(list_filter(p, lambda x: list_contains(t, x))) / len(p) ELSE 0 END, 6)::DOUBLE AS context_precision,
 round(CASE WHEN len(t) = 0 THEN 1.0 ELSE len(list_intersect(list_distinct(p), t)) / len(t) END, 6)::DOUBLE AS context_recall, round(coalesce(1.0 / list_min(list_filter(list_transform(t, lambda x: list_position(p, x)), lambda v: v > 0)), 0), 6)::DOUBLE AS reciprocal_rank,
 round(len(list_intersect(p[1:10], t)) / 10, 6)::DOUBLE AS p10, round(CASE WHEN len(t) > 0 THEN len(list_intersect(p[1:10], t)) / len(t) ELSE 0 END, 6)::DOUBLE AS r10, round(CASE WHEN len(t) > 0 THEN len(list_intersect(p[1:20], t)) / len(t) ELSE 0 END, 6)::DOUBLE AS r20 FROM s""",
    "citation_prf": _RES + f""", s AS (SELECT result_id, {_P.format('cited_sections')} AS p, {_T} AS t FROM r), c AS (SELECT *, len(list_intersect(p, t)) AS tp FROM s)
SELECT result_id, round(CASE WHEN len(p) = 0 AND len(t) = 0 THEN 1 WHEN len(p) = 0 OR len(t) = 0 THEN 0 ELSE tp / len(p) END, 6)::DOUBLE AS precision, round(CASE WHEN len(p) = 0 AND len(t) = 0 THEN 1 WHEN len(p) = 0 OR len(t) = 0 THEN 0 ELSE tp / len(t) END, 6)::DOUBLE AS recall,
 round(CASE WHEN len(p) = 0 AND len(t) = 0 THEN 1 WHEN tp = 0 THEN 0 ELSE 2 * tp / (len(p) + len(t)) END, 6)::DOUBLE AS f1 FROM c""",
    "micro_macro_f1": _RES + f""", s AS (SELECT generator, {_P.format('cited_sections')} AS p, {_T} AS t FROM r), c AS (SELECT *, len(list_intersect(p, t)) AS tp FROM s),
g AS (SELECT generator, count(*) AS n, sum(tp)::BIGINT AS tp, sum(len(p) - tp)::BIGINT AS fp, sum(len(t) - tp)::BIGINT AS fn, round(avg(CASE WHEN len(p) = 0 AND len(t) = 0 THEN 1 WHEN tp = 0 THEN 0 ELSE 2 * tp / (len(p) + len(t)) END), 6) AS macro_f1 FROM c GROUP BY generator)
SELECT generator, n, tp, fp, fn, round(tp / (tp + fp), 6) AS micro_precision, round(tp / (tp + fn), 6) AS micro_recall, round(2 * tp / (2 * tp + fp + fn), 6) AS micro_f1, macro_f1 FROM g""",
    "citation_parse": _RES + r"""SELECT result_id, array_to_string(list_sort(list_distinct(regexp_extract_all(coalesce(list_filter(string_split(predicted_answer, chr(10)), lambda x: contains(x, 'มาตราที่เกี่ยวข้อง'))[1], predicted_answer), 'มาตรา\s*([0-9]+(?:/[0-9]+)?)', 1))), ',') AS sections FROM r WHERE predicted_answer IS NOT NULL""",
    "keyword_overlap": _RES + f""", s AS (SELECT result_id, {_TOK.format('predicted_answer')} AS a, {_TOK.format('question')} AS b, {_TOK2.format('predicted_answer')} AS c, {_TOK2.format('question')} AS d FROM r WHERE predicted_answer IS NOT NULL AND question IS NOT NULL)
SELECT result_id, round(CASE WHEN len(b) > 0 THEN len(list_intersect(a, b)) / len(b) ELSE 0 END, 6)::DOUBLE AS overlap, round(CASE WHEN len(d) > 0 THEN len(list_intersect(c, d)) / len(d) ELSE 0 END, 6)::DOUBLE AS benchmark_overlap FROM s""",
    "kfold_summary": _RES + f""", f AS (SELECT ('0x' || substring(md5(CAST(idx AS VARCHAR)), 1, 8))::BIGINT % {FOLDS} AS fold, avg(mrr) AS mrr, avg(retrieval_recall) AS retrieval_recall, avg(citation_f1) AS citation_f1 FROM r GROUP BY 1),
l AS (UNPIVOT f ON mrr, retrieval_recall, citation_f1 INTO NAME metric VALUE value) SELECT metric, round(avg(value), 6) AS mean, round(coalesce(stddev_pop(value), 0), 6) AS std, round(min(value), 6) AS min, round(max(value), 6) AS max FROM l GROUP BY metric""",
    "strategy_matrix": _STRATEGIES + " SELECT * FROM matrix",
    "best_strategy": _STRATEGIES + ", l AS (UNPIVOT (SELECT strategy, hit, mrr, p10, r10, r20, f10 FROM matrix) ON hit, mrr, p10, r10, r20, f10 INTO NAME metric VALUE value) SELECT strategy, metric, value FROM l QUALIFY row_number() OVER (PARTITION BY metric ORDER BY value DESC, strategy) = 1",
    "progress_means": _RES + " SELECT generator, result_id, round(avg(mrr) OVER w + 1e-9, 6) AS mean_mrr, round(avg(citation_f1) OVER w + 1e-9, 6) AS mean_f1 FROM r WINDOW w AS (PARTITION BY generator ORDER BY result_id ROWS UNBOUNDED PRECEDING)",
    "graph_view": graphs._BASE + ", n AS (SELECT name FROM ent ORDER BY id, name LIMIT 50) SELECT source, target, type, round(weight * 2, 6) AS width FROM rel WHERE source IN (SELECT name FROM n) AND target IN (SELECT name FROM n)",
}
_ITEMS = _STATUTE + """, items AS (SELECT 'entity|' || ent.name AS item_id, CASE WHEN type = 'SECTION' THEN 'SECTION: ' || ent.name || chr(10) || substring(coalesce(statute, description, ''), 1, 1500)
 ELSE type || ': ' || ent.name || ' - ' || coalesce(description, '') END AS text FROM ent LEFT JOIN st USING (name) UNION ALL SELECT 'chunk|' || chunk_id, substring(text, 1, 800) FROM ch),"""
_LOCAL = (
    graphs._BASE.replace("ent AS (SELECT name, min(id)", "gent AS (SELECT name, min(id)").replace("FROM ent)", "FROM gent)").replace(
        "adj AS (SELECT a AS src, b AS dst FROM simple UNION ALL SELECT b, a FROM simple WHERE a <> b)",
        "adj AS (SELECT a AS src, b AS dst, type, description FROM simple UNION ALL SELECT b, a, type, description FROM simple WHERE a <> b)",
    )
    + ", "
    + _ENT
    + _ITEMS
    + _BASE_REST
    + retrieval._BM25
    + retrieval._TFIDF
    + retrieval._FUSED
    + ","
    + retrieval._ranked("fused", DEFAULT.returned, "hits")
    + ", "
    + (_EXPANSIONS + _SUPPRESS).replace("words AS", "xwords AS").replace("JOIN words", "JOIN xwords")
    + rf""",
kinds AS (SELECT DISTINCT name, type FROM ent), texts AS (SELECT name, type, min(coalesce(description, '')) AS description FROM ent GROUP BY ALL),
h AS (SELECT query_id, split_part(item_id, '|', 1) AS kind, substring(item_id, strpos(item_id, '|') + 1) AS name, score, rn FROM hits),
own_hits AS (SELECT query_id, name, score, rn, -1 AS pos FROM h WHERE kind = 'entity' UNION ALL SELECT query_id, e.name, h.score * 0.95, rn, pos FROM h JOIN (SELECT name, unnest(source_chunk_ids) AS chunk_id, generate_subscripts(source_chunk_ids, 1) - 1 AS pos FROM ent) e ON kind = 'chunk' AND chunk_id = h.name),
firsts AS (SELECT query_id, name, arg_min(score, (rn, pos)) AS score, min(rn) AS rn, arg_min(pos, (rn, pos)) AS pos FROM own_hits GROUP BY ALL),
boosted AS (SELECT query_id, prefix || ' มาตรา ' || section AS name, round(max(1.5 + (n - (ord - 1)) * 0.1), 6)::DOUBLE AS score, 2 AS step FROM left_over JOIN ex USING (keyword) JOIN xwords USING (keyword) GROUP BY ALL),
cn AS (SELECT DISTINCT name FROM ent WHERE type = 'LEGAL_CONCEPT' AND name <> ''),
concept AS (SELECT DISTINCT query_id, dst AS name, 1.2 AS score, 1 AS step FROM queries JOIN cn ON contains(text, name) JOIN adj ON src = cn.name WHERE dst IN (SELECT name FROM ent WHERE type = 'SECTION')),
raised AS (SELECT query_id, name, max(score) AS boost, max(step) AS step FROM (SELECT * FROM boosted UNION ALL SELECT * FROM concept) GROUP BY ALL),
numbers0 AS (SELECT query_id, unnest(list_distinct(regexp_extract_all(text, 'มาตรา\s*([0-9]+(?:/[0-9]+)?)', 1))) AS n FROM queries),
named AS (SELECT DISTINCT query_id, p || 'มาตรา ' || n AS name, 1.0 AS mention FROM numbers0, (VALUES ('[อาญา] '), ('[แพ่ง] '), ('[รธน] '), ('')) v(p)),
joined AS (SELECT query_id, name, type, round(coalesce(greatest(score, boost), mention) + 1e-9, 6) AS score, CASE WHEN rn IS NOT NULL THEN 3 ELSE coalesce(step, 0) END AS step, coalesce(rn, 0) AS rn, coalesce(pos, 0) AS pos FROM firsts FULL JOIN raised USING (query_id, name) FULL JOIN named USING (query_id, name) JOIN kinds USING (name)),
found AS (SELECT query_id, name, type, score, row_number() OVER (PARTITION BY query_id ORDER BY step, rn, pos, score DESC, name) AS place FROM joined),
start0 AS (SELECT * FROM found WHERE place <= {DEFAULT.traversal}),
near AS (SELECT query_id, dst AS name, max(score * 0.8) AS score FROM start0 JOIN adj ON src = start0.name GROUP BY ALL),
beside AS (SELECT query_id, '(' || src || ') -> (' || dst || ')' AS name, score * 0.7 AS score, adj.type AS type, coalesce(adj.description, '') AS description FROM start0 JOIN adj ON src = start0.name),
every AS (SELECT query_id, name, type, description, score, 0 AS o FROM found JOIN texts USING (name, type) UNION ALL SELECT query_id, name, type, description, score, 1 FROM near JOIN texts USING (name) UNION ALL SELECT query_id, name, type, description, score, 2 FROM beside),
loc AS (SELECT query_id, name, round(score + 1e-9, 6) AS score, o, type, description FROM every QUALIFY row_number() OVER (PARTITION BY query_id, name ORDER BY round(score + 1e-9, 6) DESC, o, type DESC, description DESC) = 1)"""
)
ORACLE["local_search"] = _LOCAL + " SELECT query_id, name, type, md5(description) AS digest, score, ['entity', 'neighbour', 'edge'][o + 1] AS origin FROM loc"
ORACLE["hybrid_union"] = _LOCAL + ", " + _GLOBAL.replace("WITH RECURSIVE ", "", 1).replace(graphs._BASE.replace("WITH RECURSIVE ", "", 1) + ", ", "", 1).replace(
    "queries AS (SELECT qa_id AS query_id, min(question) AS text FROM qa_pairs WHERE qa_id % 20 = 0 AND question IS NOT NULL GROUP BY qa_id),", "", 1
) + " SELECT query_id, 'local' AS part, name, score FROM loc UNION ALL SELECT query_id, 'global', community, score FROM g"
