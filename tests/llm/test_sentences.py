from datetime import datetime

from lexweave.llm import sentences as S
from tests.llm.conftest import NITI, SECTIONS

AT = datetime(2024, 1, 1)
STARTS = ["ผู้ใด", "ถ้าเจ้าของ", "ในกรณีที่ผู้ร้อง", "เมื่อวันที่ 5 มกราคม 2560 ศาล", "อัตราค่าธรรมเนียม"]
ENDS = ["ต้องระวางโทษปรับไม่เกิน 100 บาท หรือจำคุกไม่เกิน 3 ปี", "ต้องแจ้งให้ทราบภายใน 30 วัน นับแต่วันที่ทราบเหตุ", "ให้ถือว่าเป็นโมฆะ เว้นแต่มีหนังสือยินยอม", "ให้เก็บรักษาไว้ ณ ที่ทำการ จนกว่าจะมีคำสั่ง"]
ITEMS = [f"{a}กระทำการ{m} {e}" for a in STARTS for m in ("ดังกล่าว", "นั้น", "โดยมิชอบ") for e in ENDS]
ENGLISH = [f"{a} {b}" for a in ("The fee of 3.5 per cent. a year under sec. 12", "Dr. Orsk, acting under Art. 5 para. 2,", "Any licensee of Tha Morak", "However, the agent in file no. 7,") for b in ("accrues daily from 5 May 2001.", "shall notify the court within 9 days!", "may object by 9.00 a.m. on 3 June 2004.", "did so, i.e. it was found guilty (cf. sec. 9).")]


def tagger():
    return S.Tagger(S.train(ITEMS * 2 + ENGLISH * 4))


def units(text, t=None):
    return [text[a:b] for a, b in (t or tagger()).units(text)]


def test_held_out_thai_sentences():
    t = S.Tagger(S.train([x for i, x in enumerate(ITEMS) if i % 5]))
    held = ITEMS[::5]
    right = total = 0
    for i in range(len(held) - 3):
        text = " ".join(held[i : i + 4])
        got = units(text, t)
        right += len(set(got) & set(held[i : i + 4]))
        total += 4
    assert right >= 0.95 * total


def test_other_scripts():
    t = tagger()
    assert units(" ".join(ENGLISH[:3]), t) == ENGLISH[:3]
    assert units("第1条　甲は「乙。」と述べ、去った。丙は知っていたか？丁！", t) == ["第1条　甲は「乙。」と述べ、去った。", "丙は知っていたか？", "丁！"]
    assert units("主管官员指出：“异议人不得援引。义务存在。”并责令支付1.5元。次。", t) == ["主管官员指出：“异议人不得援引。义务存在。”并责令支付1.5元。", "次。"]


def test_layout():
    t = S.Tagger(tagger().w, frozenset(["ผลวิเคราะห์"]))
    text = f"ผลวิเคราะห์\n{ITEMS[0]}\n\n(1) {ITEMS[1]}\r\n(๒) {ITEMS[2]}\n**มาตราที่เกี่ยวข้อง:** มาตรา 5, มาตรา 6"
    assert units(text, t) == ["ผลวิเคราะห์", ITEMS[0], f"(1) {ITEMS[1]}", f"(๒) {ITEMS[2]}", "**มาตราที่เกี่ยวข้อง:** มาตรา 5, มาตรา 6"]
    assert units(f"มาตรา ๕ {ITEMS[0]} {ITEMS[5]}", t) == [f"มาตรา ๕ {ITEMS[0]}", ITEMS[5]]
    assert units("ขออภัย ไม่อาจตอบได้", t) == ["ขออภัย ไม่อาจตอบได้"]
    assert units('เขาว่า "หนึ่ง สอง. Three four. ห้า" แล้วไป', t) == ['เขาว่า "หนึ่ง สอง. Three four. ห้า" แล้วไป']


def test_units_without_a_space_between():
    t = tagger()
    assert units("".join(ENGLISH[:4]), t) == ENGLISH[:4]
    glued = [ITEMS[0], ITEMS[13], ITEMS[26], ITEMS[51]]
    assert units("".join(glued), t) == glued
    assert units("ต้องขออภัยด้วย ไม่อาจตอบได้", S.Tagger(S.train([*ITEMS, *(f"ขออภัยที่ตอบช้า คำตอบคือ{x}" for x in ITEMS[:9])]))) == ["ต้องขออภัยด้วย ไม่อาจตอบได้"]


def test_numbers_that_begin_a_wrapped_line():
    t = tagger()
    for text in ("The panel (vol. 9, p.\n120) asked for it.", "คณะทำงาน (ชุดที่\n13) เห็นว่าควร", "Any licensee may object under sec.\n498. by day"):
        assert len(t.units(text)) == 1
    assert len(t.units("Items:\n1. one\n2. two.\n3. three")) >= 3


def test_empty_odd_and_long_texts():
    t = tagger()
    for text in (None, "", "  \n ", "— … !", "​"):
        assert t.units(text) == []
    assert units("　x ", t) == ["x"]
    long = " ".join(ITEMS * 40)
    assert sum(b - a for a, b in t.units(long)) + len(t.units(long)) - 1 == len(long)
    assert len(t.units("“" * 20_000 + "ก " * 20_000)) >= 1
    assert S.Tagger(S.train([])).units("ก ข") == [(0, 3)]


def test_tables(make):
    body = "\n".join(f"({i}) {x}" for i, x in enumerate(ITEMS))
    sections = [{"section_id": 1, "raw_text": body, "loaded_at": AT}, {"section_id": 1, "raw_text": body, "loaded_at": None}, {"section_id": 2}, {"section_id": 3, "raw_text": "", "loaded_at": AT}]
    niti = [{"result_id": 9, "predicted_answer": f"{ITEMS[0]} {ITEMS[5]}", "run_at": AT}, {"result_id": None, "predicted_answer": "ก"}]
    rows = [tuple(r) for r in S.sentence_units(make(SECTIONS, sections, clash=True), make(NITI, niti, clash=True)).collect()]
    assert len(rows) == len(set(rows))
    assert len([r for r in rows if r[:2] == ("legal_sections", 1)]) == len(ITEMS)
    assert sorted(r[2:] for r in rows if r[1] == 9) == [(0, len(ITEMS[0])), (len(ITEMS[0]) + 1, len(ITEMS[0]) + 1 + len(ITEMS[5]))]
    assert {r[1] for r in rows} == {1, 9, None}
    assert S.sentence_units(make(SECTIONS, []), make(NITI, [])).count() == 0


def test_beginnings_of_all_items_whatever_the_sample(make):
    bodies = [*ITEMS, *ENGLISH, *(f"อธิบดีกรมที่ดิน{e} ฉบับที่ {i}" for i, e in enumerate(ENDS)), *(f"ระยะทาง{m}ในกรณีที่ผู้ร้อง" for m in ("ก", "ข", "ค"))]
    texts = make(SECTIONS, [{"section_id": k, "raw_text": "\n".join(f"({i}) {x}" for i, x in enumerate([*bodies, "ท้ายรายการทั้งหมดนี้"]))} for k in range(2)] + [{}]).select("raw_text")
    want = S.beginnings(bodies)
    assert any("อธิบดี".startswith(p[:5]) for p in want)
    assert S.trained(texts, sample=6)[S.BEGINS] == want
    assert S.trained(texts.limit(0))[S.BEGINS] == []


def test_a_quotation_of_any_length_is_not_divided():
    tagger = S.Tagger({"gapS": 1.0, "gapN": 1.0})
    for n in (1, 5, 100, 3000):
        text = "The panel said: “" + " ".join(["This was found." for _ in range(n)]) + "” The rest follows."
        assert len(tagger.units(text)) == 2
    assert len(tagger.units('He wrote "open. Then more.\n\nNext one. Last one.')) == 3


def test_contexts_met_before_are_scored_once(monkeypatch):
    """Of a text met before no place at a space behind the first characters is scored again, and it is cut as before."""
    items = [f"{w} {v} ตามกฎหมาย" for w in ("ผู้ใด", "เจ้าพนักงาน", "ศาล") for v in ("ต้องรับโทษ", "สั่งให้จ่าย", "มีอำนาจ")]
    tagger, calls, score = S.Tagger(S.train(items)), [], S.Tagger.score
    monkeypatch.setattr(S.Tagger, "score", lambda self, *x: calls.append(x) or score(self, *x))
    text = " ".join(items * 3)
    first, n = tagger.units(text), len(calls)
    calls.clear()
    assert tagger.units(text) == first == S.Tagger(tagger.w).units(text)
    assert n > 10
    calls.clear()
    tagger.units(text)
    assert len(calls) < 6
