from datetime import datetime, timedelta

from lexweave.llm import pairs as P
from tests.llm.conftest import NITI

AT = datetime(2024, 1, 1)
Q = "ผู้ร้องซึ่งทำสัญญาเช่าซื้อเมื่อวันที่ 5 มกราคม 2560 ต้องรับผิดต่อผู้คัดค้านเรื่องเงินมัดจำเป็นเงิน 5,000 บาทหรือไม่"
GOOD = ["ผู้ร้องต้องแจ้งรายละเอียดเกี่ยวกับเงินมัดจำต่อศาลแขวงภายใน 30 วันนับแต่วันที่ทราบเหตุ", "ถ้าเงินมัดจำมีมูลค่าเกินกว่า 500 บาท ผู้รับอนุญาตต้องจัดทำบัญชีแยกต่างหาก และเก็บไว้ไม่น้อยกว่า 5 ปี", "ได้ ตามมาตรา 53"]
CITE = "\n**มาตราที่เกี่ยวข้อง:** มาตรา 5"
CASES = {
    "": {"empty"}, "—": {"empty"}, "N/A": {"empty"}, "คำตอบ:" + CITE: {"empty"}, "(ว่าง)": {"empty"}, "​": {"empty"},
    Q: {"copy"}, "คำถาม: “" + Q + "”" + CITE: {"copy"}, Q.replace("5,000", "๕,๐๐๐"): {"copy"},
    "ขออภัย ไม่สามารถให้คำตอบในเรื่องนี้ได้" + CITE: {"refusal"}, "ระบบไม่อาจตอบคำถามนี้ กรุณาปรึกษาทนายความ": {"refusal"},
    "The trustee must keep a separate account for at least 5 years.": {"other_language"}, "管理人应当在五日内向主管官员报告。": {"other_language"},
    "Unfortunately no answer can be provided.": {"refusal", "other_language"},
    GOOD[0]: set(), GOOD[2] + CITE: set(), "ขออภัยที่ตอบช้า คำตอบคือ" + GOOD[0]: set(), "ท่านถามว่า " + Q + "\n\n" + GOOD[0]: set(), "ผู้ร้องไม่สามารถปฏิเสธการส่งมอบได้ตามมาตรา 5": set(),
}


def table_rows():
    fill = [{"result_id": 1000 + i, "question": Q, "generator": "g", "predicted_answer": f"{GOOD[i % 3]}{CITE}" if i % 2 else "\n".join(f"- {g}" for g in GOOD), "run_at": AT} for i in range(120)]
    return fill + [{"result_id": i, "question": Q, "generator": "g", "predicted_answer": a, "run_at": AT} for i, a in enumerate(CASES)]


def defects(df):
    out: dict = {}
    for r in df.collect():
        out.setdefault(r.result_id, set()).add(r.defect)
    return out


def test_defects(make):
    rows = table_rows()
    rows += [{"result_id": 500, "question": Q, "generator": None, "predicted_answer": None, "run_at": AT}, {"result_id": 501, "question": None, "predicted_answer": GOOD[0]}, {"result_id": 502, "question": Q, "predicted_answer": GOOD[1][:60] + "…"}]
    rows += [{"result_id": 503, "question": Q, "predicted_answer": Q, "run_at": AT}, {"result_id": 503, "question": Q, "predicted_answer": Q, "run_at": AT + timedelta(days=1)}, {"result_id": None, "predicted_answer": "x"}]
    rows += [{"result_id": 504, "question": Q, "predicted_answer": (GOOD[1] + " ") * 600, "run_at": AT}]
    df = make(NITI, rows, clash=True)
    found = P.broken_pairs(df)
    got = defects(found)
    wrong = {a: (got.get(i, set()), want) for i, (a, want) in enumerate(CASES.items()) if got.get(i, set()) - {"truncated"} != want}
    assert not wrong
    assert got[500] == {"empty"} and "truncated" in got[502] and got[503] >= {"copy"} and not got.get(501, set()) & {"copy", "other_language"} and "empty" not in got.get(504, set())
    assert len(found.collect()) == len({tuple(r) for r in found.collect()})
    report = {(r.generator, r.defect): r for r in P.defect_report(found, df).collect()}
    assert report[(None, "empty")].n_defects == 1 and report[("g", "copy")].n_records == 120 + len(CASES)


def test_empty_table(make):
    assert P.broken_pairs(make(NITI, [])).count() == 0


def test_language():
    assert [P.language(t) for t in ("ผู้ร้อง", "the fee is due", "Wer als Vertreter den Wald nicht schützt", "应当报告", "これは何", "12 !", "")] == ["th", "en", "de", "zh", "ja", "", ""]
