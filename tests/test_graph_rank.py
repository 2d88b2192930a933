import math
import random
from collections import Counter, defaultdict
from types import SimpleNamespace

import pyarrow as pa
from pyspark.sql import functions as F

from lexweave.config import Settings
from lexweave.operators import graph, rank


def test_bm25_by_hand(spark):
    docs = {1: "aa bb", 2: "aa aa cc", 3: "dd", 4: "", 5: None}
    items = spark.createDataFrame(list(docs.items()), "item_id long, text string")
    queries = spark.createDataFrame([(1, "aa AA bb zz"), (2, None), (3, "")], "query_id long, text string")
    words = {i: t.split() for i, t in docs.items() if t}
    n, mean = len(words), sum(map(len, words.values())) / len(words)
    df = Counter(w for t in words.values() for w in set(t))
    idf = {w: math.log(n - c + 0.5) - math.log(c + 0.5) for w, c in df.items()}
    average = sum(idf.values()) / len(idf)
    idf = {w: v if v >= 0 else 0.25 * average for w, v in idf.items()}
    want = {}
    for i, t in words.items():
        s = sum(idf[w] * t.count(w) * 2.5 / (t.count(w) + 1.5 * (0.25 + 0.75 * len(t) / mean)) for w in ("aa", "aa", "bb") if w in t)
        if set(t) & {"aa", "bb"}:
            want[(1, i)] = round(s, 6)
    assert {(r.query_id, r.item_id): r.score for r in rank.bm25(items, queries).collect()} == want


def test_bm25_sends_on_only_the_best(spark):
    rng = random.Random(3)
    words = ["common", *(f"w{i}" for i in range(30))]
    docs = [(f"d{i:04}", " ".join(["common", *rng.choices(words, k=rng.randrange(1, 6))])) for i in range(1500)]
    docs += [docs[7], ("d0008", "common w1 w2 w3")]  # rows of an item that is there already
    items = spark.createDataFrame(docs, "item_id string, text string").repartition(3)
    queries = spark.createDataFrame([(1, "common w1 w2"), (2, "w3 w3 w4"), (3, "common"), (4, "absent")], "query_id long, text string")
    every = rank.bm25(items, queries).collect()
    assert len({(r.query_id, r.item_id) for r in every}) == len(every) > 2500
    want = {q: sorted((-r.score, r.item_id) for r in every if r.query_id == q)[:5] for q in (1, 2, 3)}
    best = rank.bm25(items, queries, k=5)
    got = best.collect()
    assert len(got) <= 3 * 5 * best.rdd.getNumPartitions() < 500
    assert {q: [(-r.score, r.item_id) for r in sorted((r for r in rank.top_k(best, 5).collect() if r.query_id == q), key=lambda r: r.rn)] for q in (1, 2, 3)} == want


def test_bm25_keeps_pairs_without_score(spark):
    items = spark.createDataFrame([(1, "aa bb"), (2, "cc dd")], "item_id long, text string")  # each term in half of the items: no weight
    queries = spark.createDataFrame([(1, "aa"), (2, "dd zz")], "query_id long, text string")
    assert sorted((r.query_id, r.item_id, r.score) for r in rank.bm25(items, queries, k=3).collect()) == [(1, 1, 0.0), (2, 2, 0.0)]


def test_fusion_and_blend(spark):
    a = spark.createDataFrame([(1, 10, 1), (1, 11, 2)], "query_id long, item_id long, rn long")
    b = spark.createDataFrame([(1, 11, 1)], "query_id long, item_id long, rn long")
    got = {r.item_id: r.score for r in rank.fuse({"a": a, "b": b}).collect()}
    assert got == {10: round(1 / 61, 8), 11: round(1 / 62 + 1 / 61, 8)}
    pool = spark.createDataFrame([(1, 1, 0.0, 1.0), (1, 2, 1.0, 0.0), (2, 3, 5.0, 5.0)], "query_id long, item_id long, x double, y double")
    got = {r.item_id: r.score for r in rank.blend(pool, "x", "y", 0.4).collect()}
    assert got == {1: 0.4, 2: 0.6, 3: 0.0}


def test_dense_equals_brute_force(spark):
    rng = random.Random(1)
    v = {i: [rng.gauss(0, 1) for _ in range(8)] for i in range(60)}
    items = spark.createDataFrame([*v.items(), (99, None)], "item_id long, vector array<float>").repartition(3)
    queries = items.where("item_id < 5").withColumnRenamed("item_id", "query_id")
    got = defaultdict(list)
    for r in rank.dense(items, queries, 4, block=2).orderBy("query_id", "rn").collect():
        got[r.query_id].append(r.item_id)
    cos = lambda a, b: round(sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a) * sum(y * y for y in b)), 5)
    assert got == {q: sorted(v, key=lambda i: (-cos(v[q], v[i]), i))[:4] for q in range(5)}


def test_rerank_keeps_the_tail(spark):
    pool = spark.createDataFrame([(1, i, 1.0 - i / 10, i) for i in range(1, 5)], "query_id long, item_id long, score double, rn long")
    got = rank.rerank(pool, lambda df: df.withColumn("ce", F.col("item_id").cast("double")), Settings(ce_top_n=2)).orderBy("rn").collect()
    assert [r.item_id for r in got] == [2, 1, 3, 4]


def random_graph(spark, seed, nodes=40, links=35):
    rng = random.Random(seed)
    e = [(f"n{rng.randrange(nodes):02}", f"n{rng.randrange(nodes):02}", "T", str(i), 1.0, i) for i in range(links)]
    return e, spark.createDataFrame(e, "source string, target string, type string, description string, weight double, ord long"), spark.createDataFrame([(f"n{i:02}",) for i in range(nodes)], "name string")


def test_components_and_hops(spark):
    for seed in (1, 2):
        e, edges, nodes = random_graph(spark, seed)
        simple = graph.simple_edges(edges)
        near = defaultdict(set)
        for a, b, *_ in e:
            near[a].add(b)
            near[b].add(a)
        want = {}
        for n in (f"n{i:02}" for i in range(40)):
            seen, todo = {n}, [n]
            while todo:
                for m in near[todo.pop()] - seen:
                    seen.add(m)
                    todo.append(m)
            want[n] = min(seen)
        assert {r.name: r.component for r in graph.components(nodes, simple).collect()} == want
        hops, front = {"n00": 0}, {"n00"}
        for d in (1, 2, 3):
            front = {m for n in front for m in near[n]} - set(hops)
            hops |= dict.fromkeys(front, d)
        assert {r.name: r.hops for r in graph.k_hop(nodes.where("name = 'n00'"), graph.adjacency(simple), 3).collect()} == hops


def test_long_path_is_one_component(spark):
    rows = [(f"p{i:03}", f"p{i + 1:03}", "T", None, 1.0, i) for i in range(100)]
    simple = graph.simple_edges(spark.createDataFrame(rows, "source string, target string, type string, description string, weight double, ord long"))
    nodes = spark.createDataFrame([(f"p{i:03}",) for i in range(101)] + [("alone",)], "name string")
    got = {r.component for r in graph.components(nodes, simple).collect()}
    assert got == {"p000", "alone"}


def test_simple_graph_last_wins(spark):
    rows = [("b", "a", "X", "first", 0.1, 1), ("a", "b", "Y", "last", 0.2, 2), ("a", "gone", "Z", "", 1.0, 3), (None, "a", "Z", "", 1.0, 4)]
    edges = spark.createDataFrame(rows, "source string, target string, type string, description string, weight double, ord long")
    names = spark.createDataFrame([("a",), ("b",)], "name string")
    assert [tuple(r) for r in graph.simple_edges(graph.within(edges, names)).collect()] == [("a", "b", "Y", "last", 0.2)]


def test_communities_find_cliques(spark):
    rows, i = [], 0
    for side in "xy":
        for a in range(5):
            for b in range(a):
                rows.append((f"{side}{a}", f"{side}{b}", "T", None, 1.0, i))
                i += 1
    rows.append(("x0", "y0", "T", None, 1.0, i))
    simple = graph.simple_edges(spark.createDataFrame(rows, "source string, target string, type string, description string, weight double, ord long"))
    nodes = spark.createDataFrame([(f"{s}{a}",) for s in "xy" for a in range(5)], "name string")
    q = graph.modularity(graph.communities(nodes, simple), simple).first()
    whole = graph.modularity(nodes.select("name", F.lit("one").alias("community")), simple).first()
    assert q.modularity > 0.3 > whole.modularity


def test_concepts_of_any_length_are_found(spark):
    long = "หลัก" + "ความสุจริต" * 9
    entities = spark.createDataFrame([(long, "LEGAL_CONCEPT"), ("ตัด", "LEGAL_CONCEPT"), ("[ก] มาตรา 1", "SECTION")], "name string, type string")
    adj = spark.createDataFrame([(long, "[ก] มาตรา 1")], "src string, dst string")
    queries = spark.createDataFrame([(1, f"ถาม {long} ไหม"), (2, long[:-1]), (3, None)], "query_id long, text string")
    from lexweave.operators import search

    assert [(r.query_id, r.name) for r in search.concept_sections(queries, entities, adj).collect()] == [(1, "[ก] มาตรา 1")]


def test_components_that_do_not_settle_are_an_error(spark):
    import pytest

    nodes = spark.createDataFrame([(f"n{i:03d}",) for i in range(40)], "name string")
    simple = spark.createDataFrame([(f"n{i:03d}", f"n{i + 1:03d}") for i in range(39)], "a string, b string")
    with pytest.raises(RuntimeError):
        graph.components(nodes, simple, rounds=1)
    assert {r.component for r in graph.components(nodes, simple).collect()} == {"n000"}


def test_the_retrieval_stack_reads_its_settings(spark):
    from lexweave.operators import search

    items = spark.createDataFrame([(1, "aa bb cc"), (2, "aa dd " + "ee " * 200), (3, "ff")], "item_id long, text string")
    queries = spark.createDataFrame([(7, "aa bb")], "query_id long, text string")
    seen = []

    def similarity(q):
        seen.append(q.first()["text"])
        return spark.createDataFrame([(7, 3, 0.9), (7, 1, 0.1)], "query_id long, item_id long, score double")

    order = lambda **k: [r.item_id for r in search.ranked_items(items, queries, **k).orderBy("rn").collect()]
    assert order() == [1, 2]
    assert set(order(similarity=similarity)) == {1, 2, 3} and seen == ["aa bb"]
    assert order(similarity=similarity, s=Settings(rerank_alpha=1.0))[0] == 3 and order(similarity=similarity, s=Settings(rerank=False, rerank_alpha=1.0))[0] == 1
    seen.clear()
    order(similarity=similarity, s=Settings(hyde_dense_k=1, hyde_chars=5))
    assert seen[1] == "aa bb aa bb"
    assert order(s=Settings(specificity_weight=1.0)) == [2, 1]
    scorer = lambda head: head.withColumn("ce", F.length("text").cast("double"))
    assert order(s=Settings(ce_top_n=2, ce_beta=1.0), scorer=scorer) == [2, 1]


def test_running_means_over_ranges(spark):
    from lexweave.operators import metrics

    rng = random.Random(3)
    rows = [(rng.choice(["a", "b", None]), i, rng.choice([None, rng.random()])) for i in range(300)]
    got = {(r.g, r.i): r.v for r in metrics.running_means(spark.createDataFrame(rows, "g string, i int, v double"), "g", "i", ["v"]).collect()}
    assert len(got) == 300
    seen = defaultdict(list)
    for g, i, v in rows:
        seen[g] += [v] * (v is not None)
        assert (got[g, i] is None) if not seen[g] else math.isclose(got[g, i], sum(seen[g]) / len(seen[g]))


def test_words_are_set_apart_by_a_hook(spark):
    from lexweave.functions import models

    items = spark.createDataFrame([(1, "กขค"), (2, None), (3, "!")], "item_id long, text string")

    def model():
        def split(t):
            if t == "!":
                raise ValueError
            return list(t)

        return split

    assert {r.item_id: r.text for r in models.tokenized(items, model).collect()} == {1: "ก ข ค", 2: None, 3: "!"}


def test_no_more_tasks_than_run_at_once_write_their_best(spark):
    items = spark.createDataFrame([(i, f"word{i % 7} shared rare{i}") for i in range(400)], "item_id long, text string").repartition(40)
    queries = spark.createDataFrame([(q, f"shared word{q}") for q in range(5)], "query_id long, text string")
    most = spark.sparkContext.defaultParallelism * 2
    for scored in (rank.bm25(items, queries, k=2), rank.tfidf(items, queries, k=2)):
        assert max(r["count"] for r in scored.groupBy("query_id").count().collect()) <= most
        assert rank.top_k(scored, 2).count() == 10


def test_few_pairs_are_held_until_the_best_are_known(spark, monkeypatch):
    rng = random.Random(5)
    docs = [(i, " ".join(["shared", *rng.choices([f"w{j}" for j in range(40)], k=rng.randrange(3, 12))])) for i in range(3000)]
    items = spark.createDataFrame(docs, "item_id long, text string")
    queries = spark.createDataFrame([(q, f"shared w{q} w{q + 1} w{q + 2}") for q in range(20)], "query_id long, text string")
    blocks, held, scores, add = [], [0], rank._bm25_scores, rank._Best.add
    monkeypatch.setattr(rank, "_bm25_scores", lambda known, s, k: blocks.append(known) or scores(known, s, k))
    want = {(r.query_id, r.item_id, r.score) for r in rank.top_k(rank.bm25(items, queries, k=5), 5).collect()}
    terms = pa.array(["shared", *(f"w{q}" for q in range(22))])
    own = [None] * blocks[0].value.n_terms  # the terms' numbers, found by their questions and weights
    for q, t in zip(blocks[0].value.query, blocks[0].value.term, strict=True):
        own[t] = (own[t] or set()) | {blocks[0].value.queries[q].as_py()}
    named = {frozenset(range(20)): "shared"} | {frozenset(q for q in range(20) if q <= j <= q + 2): f"w{j}" for j in range(22)}
    known = SimpleNamespace(value=pa.array([named[frozenset(x)] for x in own]))
    assert len(terms) == len(known.value)
    batch = pa.RecordBatch.from_arrays([pa.array([d[0] for d in docs]), pa.array([d[1] for d in docs])], ["item_id", "text"])
    monkeypatch.setattr(rank._Best, "add", lambda self, ids, q, i, s: held.__setitem__(0, held[0] + len(q)) or add(self, ids, q, i, s))
    got = [r for b in scores(blocks[0], Settings(), 5)(rank._indexed(known)(iter([batch]))) for r in b.to_pylist()]
    assert {(r["query_id"], r["item_id"], r["score"]) for r in got} == want
    assert held[0] < 20 * 3000 / 10
