import random
from collections import Counter, defaultdict

from lexweave.llm import subjects as J
from tests.llm.conftest import DOCS, EXAMPLES, SECTIONS, SUBJECTS
from tests.llm.test_sentences import ITEMS

WORDS = {1: ["ทรัพย์ที่ถูกลักไป", "หมายจับ", "ทำร้ายร่างกาย"], 2: ["เงินมัดจำ", "เบี้ยปรับตามสัญญา", "ส่งมอบสินค้า"], 10: ["นักกีฬา", "สโมสรฟุตบอล", "ตารางแข่งขัน"]}
NAMES = {1: "criminal", 2: "contract", 10: "sport"}
FRAMES = ["ผู้ใดกระทำการเกี่ยวกับ{} ต้องระวางโทษปรับไม่เกิน 100 บาท", "ถ้าเจ้าของครอบครอง{} ต้องแจ้งให้ทราบภายใน 30 วัน"]


def sentence(rng, s):
    return rng.choice(FRAMES).format(rng.choice(WORDS[s] if s else ["เรื่องอื่น", "หนังสือทั่วไป", "ทางราชการ", "สิ่งของ", "นายทะเบียน"]))


def tables(make, docs):
    rng = random.Random(2)
    examples = []
    for i in range(150):
        s = rng.choice([1, 2, 10])
        label = s if i % 12 else rng.choice([1, 2, 10, None])
        examples.append({"example_id": i, "subject_id": label, "text": " ".join(sentence(rng, x) for x in (s, None, None, s, None, s))})
    body = "\n".join(f"({i}) {x}" for i, x in enumerate([*ITEMS, *(sentence(rng, s) for s in (1, 2, 10, None) for _ in range(30))]))
    return make(DOCS, docs, clash=True), make(EXAMPLES, examples), make(SUBJECTS, [{"subject_id": k, "subject": v} for k, v in NAMES.items()] + [{}]), make(SECTIONS, [{"section_id": 1, "raw_text": body}]).select("raw_text")


def test_documents_get_their_subjects(make):
    rng, docs, want = random.Random(3), [], set()
    for d in range(60):
        mix = rng.choice([[1] * 8, [2] * 6 + [10] * 4, [10] * 5 + [None] * 5, [1] * 9 + [2], [None] * 5])
        rng.shuffle(mix)
        docs.append({"doc_id": d, "text": " ".join(sentence(rng, s) for s in mix)})
        want |= {(d, s) for s in (1, 2, 10) if mix.count(s) >= 0.2 * len(mix)}
    docs += [{"doc_id": 100}, {"doc_id": 101, "text": " "}, {"doc_id": 0, "text": docs[0]["text"]}, {"doc_id": 102, "text": docs[1]["text"] * 100}]
    args = tables(make, docs)
    rows = J.subjects(*args).collect()
    got = {(r.doc_id, r.subject_id) for r in rows if r.doc_id < 100}
    assert len(got & want) >= 0.95 * len(want) and len(got - want) <= 0.05 * len(want)
    assert not {r.doc_id for r in rows} & {100, 101}
    total = {r.subject_id: r.n_documents for r in J.composition(J.subjects(*args), args[2]).collect()}
    assert set(total) <= {1, 2, 10}


def test_empty_tables(make):
    docs, examples, names, segments = tables(make, [{"doc_id": 1, "text": "the arrest warrant was a confession."}])
    assert J.subjects(make(DOCS, []), examples, names, segments).count() == 0
    assert J.subjects(docs, make(EXAMPLES, []), make(SUBJECTS, []), segments.limit(0)).count() == 0
    assert [r.subject_id for r in J.subjects(docs, make(EXAMPLES, []), names, segments.limit(0)).collect()] == [1]


def test_terms_come_from_all_documents(make):
    rng, docs = random.Random(5), []
    rest = ["in der Sache", "nach Aktenlage", "am Montag", "vor Ort"]
    for d in range(2000):  # a word of a few documents only
        pair = "Der Haftbefehl und die Zellenordnung" if d % 100 == 0 else f"Die {rng.choice(['Anzahlung', 'Lieferfrist'])}" if d % 2 else "Der Verein und der Pokal"
        docs.append({"doc_id": d, "text": " ".join(f"{pair} {rng.choice(rest)} gelten hier." for _ in range(4))})
    docs.append({"doc_id": 5000, "text": "Die Zellenordnung gilt hier. Die Zellenordnung gilt dort."})
    for d in range(6000, 6040):  # Thai that the examples lack
        a, b = ("หมายจับ", "ระเบียบห้องขัง") if d % 2 else ("เงินมัดจำ", "งวดชำระราคา")
        docs.append({"doc_id": d, "text": " ".join(FRAMES[k % 2].format(f"{a} และ {b}") for k in range(4))})
    docs.append({"doc_id": 7000, "text": " ".join(f.format("ระเบียบห้องขัง") for f in FRAMES)})
    got = {(r.doc_id, r.subject_id) for r in J.subjects(*tables(make, docs)).collect()}
    assert {(5000, 1), (7000, 1)} <= got


def _runs(t):
    for rx, lengths in ((J._THAI_RUN, J.THAI_LENGTHS), (J._HAN_RUN, J.HAN_LENGTHS)):
        for run in rx.findall(t):
            yield from (run[i : i + n] for n in lengths for i in range(len(run) - n + 1))
    for stretch in t.split("  "):
        w = stretch.split()
        for n in range(1, J.WORDS + 1):
            yield from (f" {' '.join(x)} " for x in (w[i : i + n] for i in range(len(w) - n + 1)) if all(map(J._WORD.fullmatch, x)) and (n > 1 or len(x[0]) > 3))


def test_counted_terms_are_those_of_all_texts_at_once(make, monkeypatch):
    """However small the chunks, the terms are those that a count of everything gives."""
    rng = random.Random(8)
    known = {"หมายจับ": (1, 1.0), " fugitive ": (1, 1.0), "逮捕": (1, 1.0), "เงินมัดจำ": (2, 1.0), " deposit ": (2, 1.0), "定金": (2, 1.0)}
    body = {1: ["ทรัพย์ที่ถูกลักไป", "a stolen boat", "逮捕令状"], 2: ["งวดชำระราคา", "of purchase orders", "违约金额"]}
    texts = []
    for _ in range(300):
        s = rng.choice([1, 1, 2])
        own = [c.strip() for c, (x, _) in known.items() if x == s]
        parts = [f"{own[k]} {rng.choice(['ผู้ใด', 'the board', '委员会'])} {rng.choice(body[s if rng.random() < 0.9 else 3 - s])}" for k in (0, 0) if own] + [rng.choice(own), rng.choice(own)]
        texts.append(f"no{rng.random()} " + " ".join(parts))
    monkeypatch.setattr(J, "CHUNK", 1500)
    rows = make("text string", [{"text": t} for t in texts]).repartition(3)
    got, _ = J.mined(rows, known)
    matcher, want = J.Matcher(known), {}
    for pool in J.POOLS:
        own = [(t, s) for t in map(J.normal, texts) if bool(J._THAI_RUN.search(t)) == (pool == J.THAI) and (s := J.main_subject(matcher.hits(t))) is not None]
        n, by, seen, sizes = Counter(), defaultdict(Counter), defaultdict(set), Counter(s for _, s in own)
        for d, (t, s) in enumerate(own):
            for c in _runs(t):
                n[c] += 1
                by[c][s] += 1
                seen[c, s].add(d)
        pure = {}
        for c in n:
            s, k = min(by[c].items(), key=lambda x: (-x[1], x[0]))
            a, b = k / sizes[s], (n[c] - k) / max(1, len(own) - sizes[s])
            if k - J.ALONE * n[c] >= len(own) / J.RARE and len(seen[c, s]) >= J.TEXTS and a / (a + b) >= J.PURITY:
                pure[c] = (s, J.weight(a, b, len(own), n[c]))
        want |= {c: (s, round(w, 9), n[c]) for c, (s, w) in J.leading(J.shortest(pure), n).items()}
    assert want and {c: (s, round(w, 9), k) for c, (s, w, k) in got.items()} == want


def test_copies_count_as_often_as_they_come(make):
    """However they fall into tasks."""
    known = {" fugitive ": (1, 1.0), " warrant ": (1, 1.0), " deposit ": (2, 1.0), " guarantee ": (2, 1.0)}
    texts = ["the fugitive and his warrant for a stolen boat"] * 9 + [f"deposit and guarantee number{i} of orders" for i in range(9)]
    for parts in (1, 3):
        got, _ = J.mined(make("text string", [{"text": t} for t in texts]).repartition(parts), known)
        assert got[" stolen "][2] == 9 and got[" orders "][2] == 9
