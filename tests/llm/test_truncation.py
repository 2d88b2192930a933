import random
from datetime import datetime

import numpy as np

from lexweave.llm import truncation as T
from lexweave.llm import windows as W
from tests.llm.conftest import ENTITIES, NITI

AT = datetime(2024, 1, 1)
HEADS = ["ผู้ร้องต้องแจ้งรายละเอียดเกี่ยวกับ", "ศาลแขวงมีอำนาจสั่งระงับการดำเนินการเกี่ยวกับ", "ผู้จัดการต้องจัดทำบัญชีแยกต่างหากสำหรับ"]
THINGS = ["เงินมัดจำ", "หนังสือค้ำประกัน", "โฉนดที่ดิน", "ของหมั้น"]
TAILS = ["ภายใน {} วันนับแต่วันที่ทราบเหตุ", "และเก็บไว้ไม่น้อยกว่า {} ปี", "เว้นแต่ผู้คัดค้านจะให้ความยินยอมตามมาตรา {}", "ก่อนวันที่ {} มกราคม 2560"]


def sentence(rng):
    return f"{rng.choice(HEADS)}{rng.choice(THINGS)} {rng.choice(TAILS).format(rng.randint(1, 99))}"


def values(seed, n=1500):
    rng = random.Random(seed)
    rows, cut = [], set()
    for i in range(n):
        text = " ".join(sentence(rng) for _ in range(rng.randint(1, 4)))
        if rng.random() < 0.1:
            whole = sentence(rng)
            k = rng.randint(8, len(whole) - 9)
            if not whole[k - 1].isdigit() and whole[k - 1] != " ":
                text += " " + whole[:k]
                cut.add(str(i))
        rows.append({"id": str(i), "source": f"s{i % 3}", "description": text, "loaded_at": AT})
    return rows, cut


def found(df):
    return {(r.rec_table, r.rec_id) for r in df.collect()}


def test_cut_values_are_told_from_whole_ones(make):
    rows, cut = values(1)
    got = {i for _, i in found(T.truncated(make(ENTITIES, rows, clash=True), make(NITI, [], clash=True)))}
    assert len(got & cut) >= 0.93 * len(cut) and len(got - cut) <= 0.03 * len(cut) + 2
    report = T.truncation_report(make(ENTITIES, rows), make(NITI, [])).collect()
    assert sum(r.n_records for r in report) == len(rows) and sum(r.n_cut for r in report) == len(got)


def test_what_an_end_shows(make):
    rows, _ = values(2, 400)
    whole = sentence(random.Random(9))
    more = {"x1": whole + "…", "x2": whole + " ab...", "x3": whole + " กข�", "x4": whole + " 12,", "x5": whole + " (ชุดที่", "y1": whole, "y2": whole + "?", "y3": "...", "y4": None, "y5": "", "y6": " — "}
    rows += [{"id": k, "source": None, "description": v, "loaded_at": AT} for k, v in more.items()]
    rows += [{"id": "y1", "description": whole}, {"id": None, "description": None}, {"id": "z", "description": whole * 500}]
    got = {i for _, i in found(T.truncated(make(ENTITIES, rows), make(NITI, [{"result_id": 1, "predicted_answer": None}, {"result_id": 2, "predicted_answer": "ตอบ…", "run_at": AT}])))}
    assert {"x1", "x2", "x3", "x4", "x5", "2"} <= got and not got & {"y1", "y2", "y3", "y4", "y5", "y6", "1"}


def test_empty_tables(make):
    assert T.truncated(make(ENTITIES, []), make(NITI, [])).count() == 0
    assert T.truncation_report(make(ENTITIES, []), make(NITI, [])).count() == 0


def test_window_hashes():
    texts = ["abcabc", "", "xabcy", "กขabc"]
    w = W.Windows(texts)
    starts, whose = w.every(3)
    got: dict = {}
    for s, i in zip(starts, whose):
        at = s - w.offsets[i]
        got.setdefault(int(w.hashes(np.array([s]), np.array([s + 3]))[0]), set()).add(texts[i][at : at + 3])
    assert all(len(v) == 1 for v in got.values()) and len(got) == len({t[i : i + 3] for t in texts for i in range(len(t) - 2)})
