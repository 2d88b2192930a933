import random

from pyspark.sql import functions as F

from lexweave.config import Settings
from lexweave.operators import rank, search
from lexweave.plans import retrieval


class Shallow(Settings):
    fetch, pool = 2, 4


def test_every_member_of_the_pool_has_its_own_cosine(spark):
    texts = ["alpha beta", "alpha alpha gamma", "alpha beta gamma delta", "beta beta beta delta", "alpha", "delta gamma", "beta alpha delta delta", "gamma"]
    items = spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")
    queries = spark.createDataFrame([(1, "alpha beta delta"), (2, "gamma beta")], "query_id long, text string")
    s = Shallow()
    cosine = {(r.query_id, r.item_id): r.score for r in rank.tfidf(items, queries, s).collect()}
    first = {(r.query_id, r.item_id) for r in rank.top_k(rank.tfidf(items, queries, s), s.fetch).collect()}
    got = {(r.query_id, r.item_id): r.cosine for r in retrieval.pooled(items, queries, s).collect()}
    assert got == {k: cosine.get(k, 0.0) for k in got}
    assert any(c > 0 for k, c in got.items() if k not in first)


def test_tfidf_sends_on_only_each_tasks_best(spark):
    items = spark.range(3000, numPartitions=1).selectExpr("id AS item_id", "concat_ws(' ', 'alpha', repeat('beta ', int(id % 50))) AS text")
    queries = spark.createDataFrame([(1, "alpha beta"), (2, "beta")], "query_id long, text string")
    want = [(r.query_id, r.item_id, r.rn) for r in rank.top_k(rank.tfidf(items, queries), 2).orderBy("query_id", "rn").collect()]
    best = rank.tfidf(items, queries, k=2).collect()
    assert len(best) == 4
    assert [(r.query_id, r.item_id, r.rn) for r in rank.top_k(rank.tfidf(items, queries, k=2), 2).orderBy("query_id", "rn").collect()] == want


def test_local_search_sends_a_description_once_and_not_for_each_question(spark):
    rng = random.Random(3)
    long = "theft " + "".join(rng.choice("กขคงจฉชซabcdefgh ") for _ in range(200_000))
    entities = spark.createDataFrame([("A", "OFFENSE", long, ["c"]), ("A", "LAW", "short", ["c"]), ("B", "SECTION", "beside", ["c"])], "name string, type string, description string, source_chunk_ids array<string>")
    edges = spark.createDataFrame([("A", "B", "T", "an edge", 1.0, 1)], "source string, target string, type string, description string, weight double, ord long")
    queries = spark.createDataFrame([(i, "theft") for i in range(40)], "query_id long, text string").repartition(4)
    chunks, words = spark.createDataFrame([("c", "text")], "chunk_id string, text string"), spark.createDataFrame([], "keyword string, prefix string, section string, ord int")

    def written() -> int:
        context = spark.sparkContext
        stages = spark._jsparkSession.sparkContext().statusStore().stageList(None, False, False, context._gateway.new_array(spark._jvm.double, 0), None)
        return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))

    before = written()
    got = search.local_search(queries, entities, chunks, edges, words)
    rows = got.select("query_id", "name", "type", "origin", F.length("description").alias("n")).collect()
    assert {(r.name, r.type, r.origin, r.n) for r in rows if r.query_id == 0} == {("A", "OFFENSE", "entity", len(long)), ("B", "SECTION", "neighbour", 6), ("(A) -> (B)", "T", "edge", 7)}
    assert len(rows) == 3 * 40
    assert written() - before < 20 * len(long)
