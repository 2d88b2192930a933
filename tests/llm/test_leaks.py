import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from lexweave.llm import leaks as L
from tests.llm.conftest import DOCS, ITEMS
from tests.llm.test_overlaps import levenshtein


@settings(max_examples=200, deadline=None)
@given(st.text("abcก", max_size=90), st.text("abcก", max_size=90))
def test_myers(a, b):
    assert L.myers(a, b) == levenshtein(a, b)


def passage(rng, n):
    return " ".join("".join(rng.choice("กขคงจฉชซabcdefgh") for _ in range(rng.randint(3, 7))) for _ in range(n))


def test_planted_stretches(make):
    rng = random.Random(4)
    items = {i: passage(rng, 110) for i in range(12)}
    docs, want = [], set()
    for d in range(60):
        i, words = d % 12, items[d % 12].split()
        share = rng.choice([0.2, 0.3, 0.5, 0.7, 1.0])
        n = int(share * len(words))
        a = rng.randrange(len(words) - n + 1)
        part = words[a : a + n]
        for k in range(10, len(part), 15):
            part[k] = "แทน"
        text = passage(rng, 40) + " " + "  ".join(part).upper() + "! " + passage(rng, 40)
        docs.append({"doc_id": d, "text": text})
        if share >= 0.5:
            want.add((d, i))
    got = L.leaks(make(DOCS, docs, clash=True), make(ITEMS, [{"item_id": i, "text": t} for i, t in items.items()], clash=True))
    assert {(r.doc_id, r.item_id) for r in got.collect()} == want
    blocks = L.leaks(make(DOCS, docs), make(ITEMS, [{"item_id": i, "text": t} for i, t in items.items()]), block_chars=2000)
    assert {(r.doc_id, r.item_id) for r in blocks.collect()} == want


def test_no_stretch_within_the_budget_is_lost():
    """Single characters replaced as densely as the budget lets them, every eighth word replaced, and edits at random places."""
    rng = random.Random(6)
    items = [(i, passage(rng, 120)) for i in range(40)]
    m = L.Matcher(items)
    for hurt in ("words", "random", 9, 10, 12, 15, 20, 25):
        for i, text in items:
            words = text.split()
            a = rng.randrange(50)
            own = words[a : a + 65]
            whole = L.normal("".join(own))
            if hurt == "words":
                own[4::8] = [passage(rng, 1) for _ in own[4::8]]
                s = L.normal("".join(own))
            else:
                s = list(whole)
                for j in rng.sample(range(len(s)), int(0.117 * len(s))) if hurt == "random" else range(hurt // 2, len(s), hurt):
                    s[j] = "z" if hurt != "random" else rng.choice(["z", "", s[j] + "y"])
                s = "".join(s)
            if L.myers(whole, s) <= L.MAX_ERRORS * len(whole) and len(whole) >= L.STRETCH * len(L.normal(text)):
                assert i in [f[0] for f in m.find([passage(rng, 60) + s + passage(rng, 60)])[0]], (hurt, i)


def test_scattered_formulas_are_no_case(make):
    rng = random.Random(5)
    formulas = [passage(rng, 12) for _ in range(8)]
    item = " ".join(f"{f} {passage(rng, 6)}" for f in formulas)
    doc = " ".join(f"{f} {passage(rng, 9)}" for f in rng.sample(formulas, 8))
    assert L.leaks(make(DOCS, [{"doc_id": 1, "text": doc}]), make(ITEMS, [{"item_id": 1, "text": item}])).count() == 0


def test_edges(make):
    text = passage(random.Random(1), 100)
    docs = [{"doc_id": 1, "text": text}, {"doc_id": 1, "text": text}, {"doc_id": 2}, {"doc_id": 3, "text": "  "}, {"text": text}, {"doc_id": 4, "text": text * 200}, {"doc_id": 5, "text": "๑๒๓ สั้น"}]
    items = [{"item_id": 7, "text": text}, {"item_id": 7, "text": text}, {"item_id": 8}, {"item_id": 9, "text": " !"}, {"text": "ก"}, {"item_id": 10, "text": "123 สั้น"}]
    got = sorted((r.doc_id or 0, r.item_id) for r in L.leaks(make(DOCS, docs), make(ITEMS, items)).collect())
    assert got == [(0, 7), (1, 7), (1, 7), (4, 7), (5, 10)]
    assert L.leaks(make(DOCS, []), make(ITEMS, items)).count() == 0 == L.leaks(make(DOCS, docs), make(ITEMS, [])).count()
    found = L.leaks(make(DOCS, docs), make(ITEMS, items))
    assert {r.item_id: r.n_documents for r in L.leak_report(found, make(DOCS, docs), make(ITEMS, items)).collect()} == {7: 2, 10: 1}


def test_stretches_that_many_items_share_are_found():
    """The half that a document holds stands in five items, with edits as dense as the budget lets them."""
    rng = random.Random(7)
    shared = [passage(rng, 60) for _ in range(3)]
    items = [(i, f"{shared[i % 3]} {passage(rng, 55)}") for i in range(15)]
    m = L.Matcher(items)
    for f, text in enumerate(shared):
        s = list(L.normal(text))
        s[4::9] = ["z"] * len(s[4::9])
        found = m.find([passage(rng, 60) + "".join(s) + passage(rng, 60)])[0]
        assert {x[0] for x in found} == {i for i, _ in items if i % 3 == f}


def test_filled_forms_are_turned_away_by_few_gaps(monkeypatch):
    """Texts of a form of which the slots are filled in otherwise are no case; that shows before the edits of all gaps are counted."""
    rng = random.Random(8)
    forms = [[passage(rng, 4) for _ in range(14)] for _ in range(4)]
    filled = lambda f: " ".join(f"{x} {passage(rng, 4)}" for x in forms[f])
    items = [(i, filled(i % 4)) for i in range(40)]
    m, calls, myers = L.Matcher(items), [], L.myers
    monkeypatch.setattr(L, "myers", lambda a, b: calls.append(1) or myers(a, b))
    docs = [filled(d % 4) for d in range(20)]
    assert m.find(docs) == [[] for _ in docs]
    assert len(calls) < 20 * len(docs)  # of 10 items in each there are 13 gaps
    assert {i for i, *_ in m.find([items[3][1]])[0]} == {3}


def test_a_text_is_looked_up_once(monkeypatch):
    rng = random.Random(12)
    item = "".join(rng.choices("abcdefghij", k=600))
    text = "".join(rng.choices("klmnop", k=300)) + item[100:500] + "".join(rng.choices("klmnop", k=300))
    m, looked, find = L.Matcher([(1, item)]), [0], L._Numbers.find
    monkeypatch.setattr(L._Numbers, "find", lambda self, h: looked.__setitem__(0, looked[0] + len(h)) or find(self, h))
    assert [(i, d) for i, _, d in m.find([text])[0]] == [(1, 0)]
    assert looked[0] <= len(text)  # for its pieces and its grams, which are the same


def test_a_rising_sequence_is_a_longest_one():
    rng = random.Random(13)
    for _ in range(300):
        numbers = [rng.randrange(30) + i // 3 for i in range(rng.randrange(40))]
        found = L._rising(np.asarray(numbers, np.int64))
        best = [1] * len(numbers)
        for i in range(len(numbers)):
            best[i] = 1 + max([best[j] for j in range(i) if numbers[j] < numbers[i]], default=0)
        assert len(found) == max(best, default=0)
        assert all(a < b and numbers[a] < numbers[b] for a, b in zip(found, found[1:]))


@settings(max_examples=300, deadline=None)
@given(st.text(st.characters(exclude_categories=[]), max_size=40))
def test_normal_form_by_array(text):
    for t in (text, text + "İ", "มาตรา ๑๒ ๆ Ab-" + text):
        assert L.normal(t) == L.unicodedata.normalize("NFC", t).translate(L._NORMAL)
