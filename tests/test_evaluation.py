from lexweave import lexicon
from lexweave.plans import evaluation


def test_every_question_is_held_against_the_dictionary(spark, tmp_path):
    words = [k for k, _ in lexicon.OFFENSES + lexicon.CONCEPTS]
    expanded = "ปลอมดวงตรา"
    spark.createDataFrame([("e1", f"{expanded} (อาญา/1)", "OFFENSE", None)], "id string, name string, type string, loaded_at timestamp").write.parquet(f"{tmp_path}/entities.parquet")
    edges = [(1, "[อาญา] มาตรา 1", f"{expanded} (อาญา/1)", "DEFINES_OFFENSE", None, 0.5, None), (2, "[อาญา] มาตรา 2", f"{expanded} (อาญา/1)", "RELATES_TO", None, 0.9, None), (3, "คน", f"{expanded} (อาญา/1)", "MENTIONS", None, 1.0, None)]
    spark.createDataFrame(edges, "rel_id long, source string, target string, type string, description string, weight double, loaded_at timestamp").write.parquet(f"{tmp_path}/relationships.parquet")
    rows = [(i, f"{words[i % len(words)]} {expanded}") for i in range(1, 25)] + [(30, None)]
    spark.createDataFrame(rows, "qa_id long, question string").write.parquet(f"{tmp_path}/qa_pairs.parquet")
    for name in ("fuzzy_contains", "keyword_suppress", "query_expansion_boost"):
        assert {r.query_id for r in evaluation.QUERIES[name](spark, str(tmp_path)).collect()} == set(range(1, 25))
    boosts = {(r.name, r.score) for r in evaluation.query_expansion_boost(spark, str(tmp_path)).collect()}
    assert boosts == {("[อาญา] มาตรา 2", 1.7), ("[อาญา] มาตรา 1", 1.6)}
