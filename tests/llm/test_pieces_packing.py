import random
import re
from datetime import datetime

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lexweave.llm import packing, pieces
from tests.llm.conftest import DOCS, SECTIONS, UNITS

AT = datetime(2024, 1, 1)
TOKEN = re.compile(pieces.TOKEN)


@settings(max_examples=120, deadline=None)
@given(st.text("กา ab.9。\n,　", max_size=400), st.integers(2, 30), st.data())
def test_pieces_cover_overlap_and_keep_the_limit(text, limit, data):
    overlap = data.draw(st.integers(0, limit - 1))
    spans = [m.span() for m in TOKEN.finditer(text)]
    out = pieces.pieces(text, limit, overlap)
    if len(spans) <= limit:
        assert out == []
        return
    starts, ends = [s for s, _ in spans], [e for _, e in spans]
    assert out[0][1] == starts[0] and out[-1][2] == ends[-1]
    for k, a, b, n in out:
        assert n == ends.index(b) - starts.index(a) + 1 <= limit
    for p, q in zip(out, out[1:]):
        assert ends.index(p[2]) + 1 - starts.index(q[1]) == overlap and q[2] > p[2]


def test_dynamic_program_is_the_best():
    rng = random.Random(3)

    def cost(cuts, prices, limit, overlap):
        n, step, total, last = len(prices), limit - overlap, 0.0, 0
        ideal = max(1.0, (n - overlap) / max(1, -(-(n - overlap) // step)))
        for c in cuts:
            own = c - last - (overlap if not last else 0)
            total += pieces.IMBALANCE * (own / ideal - 1) ** 2 + pieces.PER_PIECE + (prices[c] if c < n else 0)
            last = c
        return total

    import numpy as np

    for _ in range(20):
        n, limit, overlap = 14, 6, 2
        prices = np.array([rng.choice([0.0, 2.0, 4.0]) for _ in range(n)])
        best = min(
            (
                [*combo, n]
                for mask in range(1 << (n - 1))
                for combo in [[i + 1 for i in range(n - 1) if mask >> i & 1]]
                if all(b - a <= (limit if not a else limit - overlap) for a, b in zip([0, *combo], [*combo, n])) and all(c > overlap for c in combo)
            ),
            key=lambda c: cost(c, prices, limit, overlap),
        )
        got = pieces.cut_tokens(prices, limit, overlap)
        assert abs(cost(got, prices, limit, overlap) - cost(best, prices, limit, overlap)) < 1e-9


def test_natural_boundaries_are_preferred():
    text = "\n\n".join("คำ " * 40 for _ in range(60))
    out = pieces.pieces(text, 300, 20)
    assert all(text[b:].startswith((" \n\n", "\n\n", "")) and (b == len(text.rstrip()) or "\n\n" in text[b : b + 4]) for _, _, b, _ in out)
    with pytest.raises(ValueError):
        pieces.pieces("x", 5, 5)


def test_oversized_tables(make):
    long, short = "ก " * 1201, "ก " * 1200
    sections = [{"section_id": 1, "raw_text": long, "loaded_at": AT}, {"section_id": 1, "raw_text": long}, {"section_id": 2, "raw_text": short, "loaded_at": AT}, {"section_id": 3}, {"section_id": 4, "raw_text": ""}, {"section_id": 5, "raw_text": "ก" * 60_000}]
    units = [{"chunk_id": None, "text": long, "loaded_at": AT}, {"chunk_id": "u", "text": "字" * 1201, "loaded_at": AT}]
    found = pieces.oversized_tables(make(SECTIONS, sections, clash=True), make(UNITS, units, clash=True))
    assert sorted((r.rec_table, str(r.rec_id)) for r in found.collect()) == [("legal_sections", "1"), ("legal_sections", "5"), ("text_units", "None"), ("text_units", "u")]
    rows = pieces.piece_rows(found).where("rec_id = '5'").orderBy("piece").collect()
    assert all(r.n_tokens <= 1200 for r in rows) and rows[-1].end_pos == 60_000
    assert pieces.oversized_tables(make(SECTIONS, []), make(UNITS, [])).count() == 0


def test_the_earliest_delivery_counts_whatever_its_length(make):
    long, short = "ก " * 1201, "ก"
    later = datetime(2024, 2, 1)
    rows = [{"section_id": 1, "raw_text": short, "loaded_at": AT}, {"section_id": 1, "raw_text": long, "loaded_at": later}, {"section_id": 2, "raw_text": long, "loaded_at": AT}, {"section_id": 2, "raw_text": short, "loaded_at": later}, {"section_id": 3, "raw_text": None, "loaded_at": AT}, {"section_id": 3, "raw_text": long, "loaded_at": later}]
    found = pieces.split_oversized(make(SECTIONS, rows), "section_id", "raw_text", "loaded_at")
    assert [r.section_id for r in found.collect()] == ["2"]


def test_sum_of_squares_places_where_the_sum_is_least():
    rng = random.Random(5)
    s = packing.SumOfSquares(20)
    gaps: dict[int, int] = {}
    for _ in range(300):
        size = rng.randint(1, 20)
        before = s.containers
        options = {}
        for gap in {*gaps.values()} - {0} | {20}:
            if gap >= size:
                count: dict[int, int] = {}
                for g in gaps.values():
                    if g:
                        count[g] = count.get(g, 0) + 1
                if gap < 20:
                    count[gap] -= 1
                if gap > size:
                    count[gap - size] = count.get(gap - size, 0) + 1
                options[gap] = sum(v * v for v in count.values())
        number = s.place(size)
        old = gaps.get(number, 20)
        assert options[old] == min(options.values()) and (number < before or old == 20)
        gaps[number] = old - size
        assert gaps[number] >= 0


def sizes(spark, values):
    return spark.createDataFrame(list(enumerate(values)), "doc_id long, n_tokens int")


def test_packing(spark):
    rng = random.Random(1)
    values = [None, 0, 2048, 2049, 4096, 10_000, *(min(5000, int(rng.expovariate(1 / 500)) + 1) for _ in range(4000))]
    rows = packing.pack(sizes(spark, values), buckets=3).collect()
    fill: dict = {}
    total: dict = {}
    for r in rows:
        total[r.doc_id] = total.get(r.doc_id, 0) + r.n_tokens
        if r.container_id is not None:
            fill[r.container_id] = fill.get(r.container_id, 0) + r.n_tokens
    assert total == {i: v or 0 for i, v in enumerate(values)}
    assert max(fill.values()) <= 2048 and len(fill) <= 1.03 * sum(v or 0 for v in values) / 2048 + 6
    parts = {i: [r.n_tokens for r in rows if r.doc_id == i] for i in range(6)}
    assert len(parts[2]) == 1 and sorted(parts[3]) == [1, 2048] and len(parts[4]) == 2 and len(parts[5]) == 5
    assert {r.container_id for r in rows if r.doc_id < 2} == {None}
    assert sorted(map(tuple, packing.pack(sizes(spark, values), buckets=3).collect()), key=repr) == sorted(map(tuple, rows), key=repr)
    assert packing.pack(sizes(spark, [])).count() == 0


def test_fill_does_not_hang_on_the_session(spark):
    """Of the sizes of the test data's documents, or such as them, at least 0.97 of the containers' room is used, in 8 and in 200 partitions."""
    rng = random.Random(2)
    values = [min(9000, int(rng.lognormvariate(6, 0.9)) + 1) for _ in range(3000)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in (8, 200):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            used = {r.container_id for r in packing.pack(sizes(spark, values)).collect()}
            assert sum(values) / 2048 / len(used) >= 0.97
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_leftovers_of_many_buckets_are_packed_again(spark):
    rng = random.Random(4)
    values = [rng.randint(300, 1500) for _ in range(4000)]
    rows = packing.pack(sizes(spark, values), buckets=150).collect()
    fill: dict = {}
    for r in rows:
        fill[r.container_id] = fill.get(r.container_id, 0) + r.n_tokens
    assert max(fill.values()) <= 2048 and sum(values) / 2048 / len(fill) >= 0.95
    assert sorted(r.doc_id for r in rows) == list(range(4000))


def test_documents(make):
    e = packing.encoding()
    texts = ["ก ข ค", None, "", "the fee", "the fee", "x " * 9000]
    df = make(DOCS, [{"doc_id": i, "text": t} for i, t in enumerate(texts)] + [{"text": "no id"}], clash=True)
    got: dict = {}
    for r in packing.pack_documents(df, buckets=2).collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + r.n_tokens
    assert got == {i: len(e.encode_ordinary(t or "")) for i, t in enumerate(texts)} | {None: len(e.encode_ordinary("no id"))}
