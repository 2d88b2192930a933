import random
from collections import Counter
from datetime import datetime

from hypothesis import given, settings
from hypothesis import strategies as st

from lexweave.llm import overlaps as O
from tests.llm.conftest import QA

AT = datetime(2024, 1, 1)


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return row[-1]


@settings(max_examples=200, deadline=None)
@given(st.text("abc", max_size=14), st.text("abc", max_size=14), st.integers(0, 6))
def test_banded_distance(a, b, k):
    d = levenshtein(a, b)
    assert O.banded_distance(a, b, k) == (d if d <= k else k + 1)


@settings(max_examples=100, deadline=None)
@given(st.text("abcde", min_size=5, max_size=40), st.data())
def test_a_string_within_k_edits_holds_a_segment_near_its_place(s, data):
    k = int(0.2 * len(s))
    t = list(s)
    for _ in range(data.draw(st.integers(0, k))):
        i = data.draw(st.integers(0, max(0, len(t) - 1)))
        op = data.draw(st.sampled_from("sid"))
        if op == "i" or not t:
            t.insert(i, data.draw(st.sampled_from("abcde")))
        elif op == "d":
            del t[i]
        else:
            t[i] = data.draw(st.sampled_from("abcde"))
    cell = O.Cell(0.2, 99)
    cell.add(7, s)
    t = "".join(t)
    if t and levenshtein(s, t) <= k:
        assert [n for n, _ in cell.matches(t, [0])] == [7]


def questions(seed):
    rng = random.Random(seed)
    words = "ผู้ร้อง ผู้คัดค้าน ตลาดท่ากระเบน สัญญาเช่าซื้อ กู้ยืมเงิน ที่ดินแปลงใน ค่าเสียหาย ศาลแขวง ทะเบียนกลาง หนังสือค้ำประกัน".split()
    base = [[rng.choice(words) for _ in range(9)] + [str(rng.randrange(3)), "บาท"] for _ in range(6)]
    rows = []
    for i in range(60):
        w = list(rng.choice(base))
        if rng.random() < 0.5:
            w[rng.randrange(9)] = rng.choice(words)
        if rng.random() < 0.2:
            w = w[5:] + w[:5]
        rows.append({"qa_id": i, "split": rng.choice(["train", "test", "dev"]), "source": "s", "question": rng.choice(["", "เรียนถาม "]) + " ".join(w), "relevant_sections": rng.choice([["1"], ["๑"], ["1", " 1"], ["2"]]), "loaded_at": AT})
    return rows


def brute(rows, edits=O.EDITS, block=O.BLOCK):
    out = set()
    c = {r["qa_id"]: (*O.canonical(r["question"]), O.section_key(r["relevant_sections"])) for r in rows}
    for e in rows:
        for t in rows:
            if e["split"] == "train" or t["split"] != "train":
                continue
            (s, _, n1, k1), (x, starts, n2, k2) = c[e["qa_id"]], c[t["qa_id"]]
            if (n1, k1) != (n2, k2):
                continue
            for r in starts:
                y = x[r:] + x[:r]
                if levenshtein(s, y) <= int(edits * max(len(s), len(y))) and max(O.longest_gap(s, y), O.longest_gap(y, s)) <= block:
                    out.add((e["qa_id"], t["qa_id"]))
                    break
    return out


def found(df):
    return {(r.qa_id_e, r.qa_id_t) for r in df.collect()}


def test_equals_brute_force(make):
    for seed in (1, 2):
        rows = questions(seed)
        want = brute(rows)
        got = found(O.overlaps(make(QA, rows)))
        # every pair by rotation is there; what else comes is of another order of the same sentences
        assert got >= want and len(want) > 5
        forms = {r["qa_id"]: Counter(O.canonical(r["question"])[0]) for r in rows}
        assert all((forms[e] - forms[t]).total() <= 0.2 * max(forms[e].total(), forms[t].total()) for e, t in got)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text("abcdefgh", min_size=12, max_size=25), min_size=3, max_size=4), st.data())
def test_any_order_of_sentences_and_longer_train_strings(parts, data):
    """Whatever the order, the edits, and whichever string is longer: what is within the budget in the right order is found."""
    s = "".join(parts)
    starts = [sum(map(len, parts[:i])) for i in range(len(parts))]
    own = []
    for p in parts:
        t = list(p)
        for _ in range(data.draw(st.integers(0, 3))):
            i = data.draw(st.integers(0, len(t) - 1))
            t[i : i + data.draw(st.integers(0, 1))] = data.draw(st.sampled_from(["x", "xy", ""]))
        own.append("".join(t) or "z")
    order = data.draw(st.permutations(range(len(parts))))
    t = "".join(own[i] for i in order)
    at = [sum(len(own[i]) for i in order[:j]) for j in range(len(order))]
    d = levenshtein(s, "".join(own))
    cell = O.Cell(0.2, 99)
    cell.add(7, s, starts)
    got = cell.matches(t, at)
    if d <= int(0.1 * max(len(s), len(t))) or (list(order) == sorted(order) and d <= int(0.2 * max(len(s), len(t)))):
        assert [n for n, _ in got] == [7]


def test_hot_key_on_a_grid(make, monkeypatch):
    rows = questions(1)
    df = make(QA, rows * 1)
    members = O.classes(df)
    plain = {tuple(r) for r in O.class_links(members).collect()}
    assert {tuple(r) for r in O.class_links(members, cell_rows=2).collect()} == plain and plain


def test_forms_that_are_the_same(make):
    a = "ถ้าผู้ร้องทำสัญญาที่ตลาดท่าเมื่อ 5 ม.ค. 2560 เป็นเงิน 1,000 บาท ผู้ใดต้องรับผิด"
    forms = [a, "เรียนถาม " + a.replace("5", "๕").replace("1,000", "1000"), a.replace(" ", "  ").replace("ม.ค.", "มกราคม"), "ผู้ใดต้องรับผิด " + a.rsplit(" ", 1)[0], a.replace("สัญญา", "สัญ​ญา") + " ครับ"]
    other = [a.replace("2560", "2561"), a.replace("1,000", "2,000")]
    rows = [{"qa_id": 0, "split": "train", "question": a, "relevant_sections": ["1", "๒"], "loaded_at": AT}]
    rows += [{"qa_id": i, "split": "test", "question": q, "relevant_sections": ["2", " 1", "1"], "loaded_at": AT} for i, q in enumerate(forms + other, 1)]
    assert found(O.overlaps(make(QA, rows))) == {(i, 0) for i in range(1, 1 + len(forms))}


def test_edges(make):
    assert found(O.overlaps(make(QA, []))) == set()
    rows = [
        {"qa_id": None, "split": "train", "question": "ก ข", "loaded_at": AT}, {"qa_id": 1, "split": None, "question": "ก ข"}, {"qa_id": 2, "split": "test", "question": None}, {"qa_id": 3, "split": "test", "question": " ​"},
        {"qa_id": 4, "split": "train", "question": "คำถาม"}, {"qa_id": 5, "split": "test", "question": "คำถาม", "relevant_sections": []}, {"qa_id": 5, "split": "test", "question": "คำถาม", "relevant_sections": [], "loaded_at": AT},
        {"qa_id": 6, "split": "test", "question": "ย" * 30_000}, {"qa_id": 7, "split": "train", "question": "ย" * 30_000},
    ]
    df = make(QA, rows, clash=True)
    assert found(O.overlaps(df)) >= {(5, 4)}
    report = {(r.split, r.source): r for r in O.overlap_report(df).collect()}
    assert report[("test", None)].n_rows == 4 and report[("test", None)].n_overlapping >= 1
