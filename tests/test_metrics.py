"""Literal cases of citation parsing, F1 edges and folds, and of the metrics' edges."""

from pyspark.sql import functions as F

from lexweave.operators import answer, metrics, search


def calc(spark, p, t, f):
    return spark.createDataFrame([(p, t)], "p array<string>, t array<string>").select(f(F.col("p"), F.col("t"))).first()[0]


def parse(spark, text):
    return set(spark.createDataFrame([(text,)], "t string").select(metrics.cited_sections(F.col("t"))).first()[0])


def test_citation_parsing(spark):
    assert parse(spark, "ตอบ\nมาตราที่เกี่ยวข้อง: มาตรา 334, มาตรา 335\nมาตรา 9") == {"334", "335"}
    assert parse(spark, "พ.ศ. 2560\nมาตราที่เกี่ยวข้อง: มาตรา 5") == {"5"}
    assert parse(spark, "มาตราที่เกี่ยวข้อง: มาตรา 112/1, มาตรา 200") == {"112/1", "200"}
    assert parse(spark, "ตามมาตรา 7 และมาตรา 9") == {"7", "9"}


def test_f1_edges(spark):
    f1 = lambda p, t: round(calc(spark, p, t, metrics.citation)["f1"], 6)
    assert f1(["1"], ["1"]) == 1.0
    assert f1([], []) == 1.0 and f1(None, None) == 1.0
    assert f1(["1"], ["2"]) == 0.0 and f1([], ["2"]) == 0.0
    assert f1(["1", "2", "3"], ["1", "2"]) == 0.8


def test_retrieval_edges(spark):
    assert calc(spark, ["9", "1", "1"], ["1"], metrics.precision) == 2 / 3
    assert calc(spark, ["9"], [], metrics.recall) == 1.0
    assert calc(spark, ["9", "1"], ["1"], metrics.reciprocal_rank) == 0.5
    assert calc(spark, None, ["1"], metrics.reciprocal_rank) == 0.0
    assert calc(spark, ["1"], ["1", "2"], lambda p, t: metrics.at_k(p, t, 10))["precision"] == 0.1
    assert calc(spark, ["1"], [], lambda p, t: metrics.at_k(p, t, 10))["hit"] == 0.0


def test_folds(spark):
    def folds(n, k, seed):
        df = spark.range(n).withColumnRenamed("id", "q")
        return {r.q: r.fold for r in metrics.exact_folds(df, "q", k, seed).collect()}

    a = folds(112, 5, 42)
    assert len(a) == 112 and set(a.values()) == set(range(5))
    assert folds(50, 5, 7) == folds(50, 5, 7)
    sizes = [list(folds(100, 5, 1).values()).count(i) for i in range(5)]
    assert max(sizes) - min(sizes) <= 1


def test_fold_summary(spark):
    df = spark.createDataFrame([(0, 1.0), (1, 3.0)], "fold int, m double")
    assert tuple(metrics.fold_summary(df, ["m"]).first()) == ("m", 2.0, 1.0, 1.0, 3.0)


def test_micro_divides_once(spark):
    df = spark.createDataFrame([("g", ["1"], ["1", "2"]), ("g", ["3", "4"], ["3"]), ("h", None, None)], "g string, p array<string>, t array<string>")
    rows = {r.g: r for r in metrics.micro(df, "p", "t", ["g"]).collect()}
    assert (rows["g"].tp, rows["g"].fp, rows["g"].fn) == (2, 1, 1) and rows["g"].micro_f1 == round(2 / 3, 6)
    assert rows["h"].micro_f1 == 0.0 and rows["h"].macro_f1 == 1.0


def test_selection(spark):
    def pick(scores, **kw):
        from lexweave.config import Settings

        df = spark.createDataFrame([(1, f"s{i}", s) for i, s in enumerate(scores)], "query_id int, name string, score double")
        return [r.name for r in answer.select_sections(df, Settings(**kw)).orderBy("rn").collect()]

    assert pick([1.0]) == ["s0"]
    assert pick([1.0, 0.9, 0.8]) == ["s0", "s1"]
    assert pick([1.0, 0.5]) == ["s0"]
    assert pick([1.0, 0.8], max_sections=3) == ["s0"]
    assert pick([1.0, 0.95, 0.7], max_sections=3) == ["s0", "s1"]


def test_law_factor(spark):
    rows = [("ลักทรัพย์", "[อาญา] มาตรา 1"), ("ลักทรัพย์", "[รธน] มาตรา 1"), ("สัญญาลักทรัพย์", "[รธน] มาตรา 1"), ("รัฐสภา", "[รธน] มาตรา 1"), ("อื่น", "[แพ่ง] มาตรา 1"), ("สัญญา", "มาตรา 1")]
    got = [r[0] for r in spark.createDataFrame(rows, "q string, n string").select(answer.law_factor(F.col("q"), F.col("n"))).collect()]
    assert got == [1.25, 0.85, 0.9, 1.2, 1.0, 1.0]


def brute_fuzzy(q, k):
    if k in q:
        return True
    if len(k) < 5:
        return False
    if any(k[:i] + k[i + 1 :] in q for i in range(len(k))):
        return True
    return any(len(w := q[s : s + len(k) + 1]) >= len(k) and any(w[:i] + w[i + 1 :] == k for i in range(len(w))) for s in range(len(q) - len(k) + 2))


def test_fuzzy_containment(spark):
    rows = [("xabcdefy", "abcdef"), ("xabdefy", "abcdef"), ("xabcXdefy", "abcdef"), ("xabXdefy", "abcdef"), ("abcd", "abcde"), ("abc", "abcd"), ("", "abcde"), ("bcdef", "abcdef"), ("abcde", "abcdef"), ("aabcdef", "abcdef"), ("abdcef", "abcdef")]
    got = [r[0] for r in spark.createDataFrame(rows, "q string, k string").select(search.fuzzy_contains(F.col("q"), F.col("k"))).collect()]
    assert got == [brute_fuzzy(*r) for r in rows]


def test_truncate(spark):
    rows = [("a" * 10,), ("คำ " * 40 + " มาตรา 5 " + "ก" * 300,), ("x" * 400,), (" ".join(["word"] * 100),)]
    got = [r[0] for r in spark.createDataFrame(rows, "t string").select(answer.truncate(F.col("t"))).collect()]
    assert got[0] == "a" * 10 and got[1].endswith("คำ ...") and got[2] == "x" * 300 + "..." and got[3].endswith("word ...") and len(got[3]) <= 304


def test_sections_of_one_law(spark):
    rows = [("[แพ่ง] มาตรา ๕ และ [อาญา] มาตรา 7\nมาตราที่เกี่ยวข้อง: มาตรา 5, มาตรา 7",), ("[แพ่ง] มาตรา 9",), ("ไม่มี",)]
    got = [list(r[0]) for r in spark.createDataFrame(rows, "t string").select(metrics.cited_under_law(F.col("t"), "[แพ่ง]")).collect()]
    assert got == [["5"], ["9"], []]
    hits = spark.createDataFrame([(1, "[แพ่ง] มาตรา ๕", 0.5), (1, "[แพ่ง] มาตรา 7", 0.9), (1, "[อาญา] มาตรา 8", 1.0), (1, "[แพ่ง] มาตรา 5", 0.4), (1, "ศาล", 2.0)], "query_id int, name string, score double")
    assert [list(r.sections) for r in metrics.ranked_sections(hits, "[แพ่ง]").collect()] == [["7", "5"]]
    assert list(spark.createDataFrame([(["12", "9/2", "9"],)], "s array<string>").select(metrics.display_order(F.col("s"))).first()[0]) == ["9", "9/2", "12"]


def test_context_and_edges(spark):
    from lexweave.functions.text import chapter_of
    from lexweave.operators import graph

    hits = spark.createDataFrame([(1, "a", "LAW", 0.5), (1, "b", "LAW", 0.9)], "query_id int, name string, type string, score double")
    ents = spark.createDataFrame([("a", None, ["l__c_1__0"]), ("b", "bb", ["l__c_1__0", "l__c_2__0"])], "name string, description string, source_chunk_ids array<string>")
    chunks = spark.createDataFrame([("l__c_1__0", "one"), ("l__c_2__0", "two")], "chunk_id string, text string")
    assert search.context(hits, ents, chunks).first().context == "== Entity Context ==\n[LAW] b: bb\n[LAW] a: \n\n== Source Text ==\none\ntwo"
    assert [r[0] for r in ents.orderBy("name").select(chapter_of(F.col("source_chunk_ids"))).collect()] == ["c 1", "c 1"]
    adj = spark.createDataFrame([("a", "b", "T", "d", 1.0)], "src string, dst string, type string, description string, weight double")
    assert graph.expand_edges(hits, adj, 0.7).first().name == "(a) -> (b)"
    q = spark.createDataFrame([(1, "q")], "query_id int, text string")
    found = search.with_bodies(q, spark.createDataFrame([(1, 7, 1)], "query_id int, item_id int, rn int"), spark.createDataFrame([(7, "body")], "item_id int, text string"), 1, 2)
    assert found.first().text == "q bo" and search.with_bodies(q, q, q, 0, 2) is q
