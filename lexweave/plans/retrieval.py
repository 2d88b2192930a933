"""Retrieval queries and their SQL. Questions: qa_pairs whose id is divisible by 20, against all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.config import DEFAULT, Settings
from lexweave.operators import rank
from lexweave.sources.tables import table

K = 10


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item_id"), "text")


def _queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "qa_pairs").where("qa_id % 20 = 0 and question is not null").groupBy(F.col("qa_id").alias("query_id")).agg(F.min("question").alias("text"))


def _vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("vector")), e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))


def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank.top_k(rank.bm25(_items(spark, sf_dir), _queries(spark, sf_dir), k=K), K)


def tfidf_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank.top_k(rank.tfidf(_items(spark, sf_dir), _queries(spark, sf_dir), k=K), K)


def dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank.dense(*_vectors(spark, sf_dir), K)


def _ranked_channels(bm25: DataFrame, tfidf: DataFrame, s: Settings) -> dict[str, DataFrame]:
    return {"bm25": rank.top_k(bm25, s.fetch), "tfidf": rank.top_k(tfidf, s.fetch)}


def _channels(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    items, queries = _items(spark, sf_dir), _queries(spark, sf_dir)
    return _ranked_channels(rank.bm25(items, queries, k=DEFAULT.fetch), rank.tfidf(items, queries, k=DEFAULT.fetch), DEFAULT)


def rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank.top_k(rank.fuse(_channels(spark, sf_dir)), DEFAULT.top_k)


def pooled(items: DataFrame, queries: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """query_id, item_id, rrf, cosine of the fused pool; the cosine is each member's own, however far down its channel (0 without a common term)."""
    vocabulary = rank.Vocabulary(items, s)
    channels = _ranked_channels(rank.bm25(items, queries, s, k=s.fetch), rank.tfidf(items, queries, s, k=s.fetch, vocabulary=vocabulary), s)
    pool = rank.top_k(rank.fuse(channels, s), s.pool).select("query_id", "item_id", F.col("score").alias("rrf"))
    return rank.with_cosines(pool, items, queries, s, vocabulary)


def rrf_blend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fused pool blended with the TF-IDF cosine of each of its members, which stands in for the dense similarity."""
    both = pooled(_items(spark, sf_dir), _queries(spark, sf_dir))
    return rank.top_k(rank.blend(both, "rrf", "cosine", DEFAULT.rerank_alpha), DEFAULT.top_k).select("query_id", "item_id", "score", "rn")


QUERIES = {"bm25_topk": bm25_topk, "tfidf_topk": tfidf_topk, "dense_topk": dense_topk, "rrf_fusion": rrf_fusion, "rrf_blend": rrf_blend}

_BASE = r"""
WITH items AS (SELECT doc_id AS item_id, text FROM documents),
queries AS (SELECT qa_id AS query_id, min(question) AS text FROM qa_pairs WHERE qa_id % 20 = 0 AND question IS NOT NULL GROUP BY qa_id),
words AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}') AS t FROM items WHERE text IS NOT NULL),
post AS (SELECT item_id, length, term, count(*) AS tf FROM (SELECT item_id, len(t) AS length, unnest(t) AS term FROM words WHERE len(t) > 0) GROUP BY ALL),
asked AS (SELECT query_id, term, count(*) AS qf FROM (SELECT query_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}')) AS term FROM queries) GROUP BY ALL),
"""
_BM25 = """
corpus AS (SELECT count(*) AS n, avg(length) AS mean_length FROM (SELECT DISTINCT item_id, length FROM post)),
raw AS (SELECT term, ln(n - count(*) + 0.5) - ln(count(*) + 0.5) AS raw, mean_length FROM post, corpus GROUP BY term, n, mean_length),
idf AS (SELECT term, mean_length, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM raw) ELSE raw END AS idf FROM raw),
bm25 AS (SELECT query_id, item_id, round(sum(qf * idf * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * length / mean_length))), 6) AS score FROM asked JOIN idf USING (term) JOIN post USING (term) GROUP BY ALL),
"""
_TFIDF = """
vocabulary AS (SELECT term, ln((1 + (SELECT count(*) FROM items WHERE text IS NOT NULL)) / (1 + count(*))) + 1 AS idf FROM post GROUP BY term ORDER BY sum(tf) DESC, term LIMIT 512),
iv AS (SELECT item_id, term, tf * idf AS w FROM post JOIN vocabulary USING (term)),
qv AS (SELECT query_id, term, qf * idf AS qw FROM asked JOIN vocabulary USING (term)),
inorm AS (SELECT item_id, sqrt(sum(w * w)) AS norm FROM iv GROUP BY item_id), qnorm AS (SELECT query_id, sqrt(sum(qw * qw)) AS qnorm FROM qv GROUP BY query_id),
tfidf AS (SELECT query_id, item_id, round(dot / (norm * qnorm), 6) AS score FROM (SELECT query_id, item_id, sum(w * qw) AS dot FROM qv JOIN iv USING (term) GROUP BY ALL) JOIN inorm USING (item_id) JOIN qnorm USING (query_id)),
"""


def _ranked(name: str, k: int, out: str) -> str:
    return f"{out} AS (SELECT query_id, item_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rn FROM {name} QUALIFY rn <= {k})"


_FUSED = _ranked("bm25", DEFAULT.fetch, "b") + "," + _ranked("tfidf", DEFAULT.fetch, "t") + ", fused AS (SELECT query_id, item_id, round(sum(1.0 / (60 + rn)), 8) AS score FROM (SELECT query_id, item_id, rn FROM b UNION ALL SELECT query_id, item_id, rn FROM t) GROUP BY ALL)"
ORACLE = {
    "bm25_topk": _BASE + _BM25 + _ranked("bm25", K, "r") + " SELECT * FROM r",
    "tfidf_topk": _BASE + _TFIDF + _ranked("tfidf", K, "r") + " SELECT * FROM r",
    "dense_topk": f"""WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
pairs AS (SELECT q.vec_id AS query_id, i.vec_id AS item_id, round(list_dot_product(q.e, i.e) / (sqrt(list_dot_product(q.e, q.e)) * sqrt(list_dot_product(i.e, i.e))), 5) AS score FROM v q, v i WHERE q.vec_id % 20 = 0),
{_ranked("pairs", K, "r")} SELECT * FROM r""",
    "rrf_fusion": _BASE + _BM25 + _TFIDF + _FUSED + "," + _ranked("fused", DEFAULT.top_k, "r") + " SELECT * FROM r",
    "rrf_blend": _BASE + _BM25 + _TFIDF + _FUSED + "," + _ranked("fused", DEFAULT.pool, "pool") + """,
mixed AS (SELECT query_id, item_id, pool.score AS rrf, coalesce(c.score, 0.0) AS cosine FROM pool LEFT JOIN tfidf c USING (query_id, item_id)),
blended AS (SELECT query_id, item_id, round(0.6 * (rrf - min(rrf) OVER w) / (max(rrf) OVER w - min(rrf) OVER w + 1e-9) + 0.4 * (cosine - min(cosine) OVER w) / (max(cosine) OVER w - min(cosine) OVER w + 1e-9), 6) AS score FROM mixed WINDOW w AS (PARTITION BY query_id)),
""" + _ranked("blended", DEFAULT.top_k, "r") + " SELECT * FROM r",
}
