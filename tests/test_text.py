import re
import unicodedata

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexweave.functions import text as T
from lexweave.operators import extract, fold
from lexweave.config import Settings


def one(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


def test_normalize(spark):
    rows = [("﻿ก​  ข\t\tค\n\n\n\nง  ",), ("é ",), (None,), ("",), ("　ab ",)]
    got = one(spark, rows, "t string", T.normalize(F.col("t")))
    assert got == [("ก ข ค\n\nง",), ("é",), (None,), ("",), ("ab",)]


def test_reference_key_equals_python(spark):
    ws = "\t 　  \n"
    values = ["[พรบ.๓]  มาตรา ๕", " ก​ข ", "ผู้", unicodedata.normalize("NFD", "é à"), "ศาล", "﻿", ws, "a" + ws + "b", "น้ํา", "ผู้"]

    def plain(v):
        v = re.sub("[​‌‍﻿]", "", unicodedata.normalize("NFC", v)).translate(str.maketrans(T.THAI_DIGITS, T.ARABIC_DIGITS))
        return " ".join(v.split())

    got = [r[0] for r in one(spark, [(v,) for v in values], "t string", T.reference_key(F.col("t")))]
    assert got == [plain(v) for v in values]


def test_match_spans_equals_python(spark):
    texts = ["มาตรา ๕ ก มาตรา 6/1 ทวิ", "", "ไม่มี", "มาตรา1มาตรา2", None]
    got = one(spark, [(t,) for t in texts], "t string", T.match_spans(F.col("t"), extract.MENTION))
    for t, (spans,) in zip(texts, got):
        want = [] if t is None else [(m.start(), m.group()) for m in re.finditer(extract.MENTION, t)]
        assert [tuple(x) for x in spans] == want


def test_section_and_law_names(spark):
    rows = [("๓๓๔", "ประมวลกฎหมายอาญา"), ("5", "กฎหมายใหม่"), ("7", ""), (None, "x")]
    got = one(spark, rows, "n string, law string", extract.section_name(F.col("n"), F.col("law")))
    assert got == [("[อาญา] มาตรา 334",), ("[กฎหม] มาตรา 5",), ("มาตรา 7",), (None,)]


def test_spans_and_nearest(spark):
    text = "คำนำ\nมาตรา ๑ ผู้ใดลักทรัพย์ ตามมาตรา ๓\nมาตรา ๒ จำเลย"
    chunks = spark.createDataFrame([("c", "ประมวลกฎหมายอาญา", None, text), ("d", None, "อาญา", "ไม่มีมาตรา"), ("e", None, None, None)], "chunk_id string, law_name string, chapter string, text string")
    spans = sorted(tuple(r) for r in extract.header_spans(chunks).collect())
    assert [(s[0], s[2]) for s in spans] == [("c", "preamble"), ("c", "1"), ("c", "2"), ("d", "0")]
    assert sum(s[4] for s in spans if s[0] == "c") == len(text)
    edges = {(r.source, r.target, r.type) for r in extract.edges(chunks).collect()}
    assert ("[อาญา] มาตรา 1", "ความผิดฐานลักทรัพย์", "RELATES_TO") in edges
    assert ("[อาญา] มาตรา 2", "จำเลย", "MENTIONS") in edges
    assert ("[อาญา] มาตรา 1", "[อาญา] มาตรา 3", "REFERENCES") in edges
    assert ("[อาญา] มาตรา 3", "[อาญา] มาตรา 2", "ADJACENT_TO") in edges
    assert not [e for e in edges if e[2] == "REFERENCES" and e[0] == e[1]]


def test_penalty_names(spark):
    rows = [("ต้องระวางโทษจำคุกไม่เกิน 3 ปี และปรับไม่เกิน 60,000 บาท",), ("ประหารชีวิต จำคุกตลอดชีวิต",), ("อื่น",), ("ปรับ" + "ก" * 90 + "บาท",), ("จำคุก,ปรับไม่เกิน 600 บาท",)]
    got = [r[0] for r in one(spark, rows, "t string", extract.penalty_name(F.col("t")))]
    assert got[0] == "โทษจำคุกไม่เกิน 3 ปี และปรับ"  # a comma ends the search for the amount
    assert got[4] == "โทษจำคุก และปรับไม่เกิน 600 บาท"
    assert got[1] == "โทษประหารชีวิต และจำคุกตลอดชีวิต" and got[2] == "" and len(got[3]) == 78


def test_merge_rules():
    def run(*rows):
        m = fold.Merge()
        for r in rows:
            m.add(r)
        return m.end()[0]

    assert run(("short", False), ("longer text", False))[0] == "longer text"
    assert run(("longer text", False), ("def", True), ("much longer but no definition", False))[:2] == ("def", True)
    assert run(("พระราชบัญญัตินี้ ยาว", True), ("x", True))[0] == "x"
    assert run(("aaaa", True), ("bbbbb", True))[0] == "aaaa" and run(("aaaa", True), ("bbbbbbb", True))[0] == "bbbbbbb"
    assert run((None, None))[0] == ""


def test_chunk_packing(spark):
    rows = [("l", "c", i, str(i), t) for i, t in enumerate([50, 40, 30, 200, 60, 50])] + [(None, None, 1, None, None)]
    df = spark.createDataFrame(rows, "law_name string, chapter string, ord int, section_number string, tokens int")
    got = sorted((r.chunk, r.n_sections, r.token_count, r.first_section, r.last_section) for r in fold.pack_sections(df, Settings(chunk_tokens=100)).where("law_name = 'l'").collect())
    assert got == [(0, 2, 90, "0", "1"), (1, 2, 70, "1", "2"), (2, 1, 200, "3", "3"), (3, 1, 60, "4", "4"), (4, 2, 110, "4", "5")]
    assert fold.pack_sections(df.limit(0)).count() == 0


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 130), max_size=25), st.booleans())
def test_packer_keeps_every_section(sizes, carry):
    p = fold.Packer(100, carry)
    out = [c for i, t in enumerate(sizes) for c in p.add((i, t))] + p.end()
    assert [c[0] for c in out] == list(range(len(out)))
    covered = {i for c in out for i in range(c[3], c[4] + 1)}
    assert covered == set(range(len(sizes)))
