"""Broken prompt and response pairs (problem 3).

A response is cut into clauses, the sentence units of its body without headings, labels and citation lines. A linear-chain
conditional random field tags each by what it does (answer, refuse, echo the question, courtesy), whether it is foreign and
whether it is unfinished; the defects are the tags' coverage of the body and nothing else. A pair without any clause is empty.

The field is trained here on at most ``SAMPLE`` responses, those of the least hashes, labelled by fixed phrases, overlap with the
question, script and the judgement of the response's end. Its features are those signs and hashed character n-grams; the
phrases are hidden from it in half of its training, so that it learns the wordings around them and decides without them.

Whether the end is cut is judged by the character model of cut texts over all responses; the field has that as a sign.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StringType, StructField, StructType

from lexweave.llm import sentences, truncation
from lexweave.llm.rows import least_hashes
from lexweave.llm.windows import Windows
from lexweave.session import cut_lineage

SAMPLE, EPOCHS, SEED, RATE, PENALTY = 2000, 4, 11, 0.3, 1e-4
BUCKETS = 4096
COPY_SHARE, FOREIGN_SHARE, REFUSAL_SHARE = 0.9, 0.5, 0.8
#: A clause repeats the question if this share of its five-grams stand in it.
ECHO = 0.75

#: A tag is what the clause does, plus FOREIGN, plus UNFINISHED.
ANSWER, REFUSAL, ECHOED, COURTESY = range(4)
FOREIGN, UNFINISHED, TAGS = 4, 8, range(16)
#: The signs that are phrases, and how often they are hidden in training.
PHRASES, HIDE = (9, 10, 11), 0.5
#: Characters of clauses that are scored together.
TOGETHER = 200_000
DEFECTS = ("empty", "truncated", "refusal", "copy", "other_language")

#: What stands for no value; phrases that decline; phrases of courtesy and advice around them; labels.
NO_VALUE = frozenset("n/a na none null nil nan tbd tba unknown empty ไม่ระบุ ไม่มี ไม่มีข้อมูล ว่าง รอข้อมูล ไม่ทราบ 无 無 なし 未定 不明 keine k.a. leer".split())
DECLINE = re.compile(
    "ไม่สามารถให้คำตอบ|ไม่สามารถตอบ|ไม่อาจตอบ|ไม่อาจให้คำตอบ|นอกขอบเขต|มิได้รับอนุญาตให้|ไม่ได้รับอนุญาตให้แนะนำ|ขอสงวนที่จะไม่|ไม่พอให้สรุป|ไม่เพียงพอ|ไม่มีบทบัญญัติในคลัง|ไม่พบข้อมูล|ขอไม่ตอบ"
    "|can ?not (?:be )?answer|unable to answer|not able to (?:give|answer|provide)|no answer can be|does not allow any conclusion|falls outside|outside what this|not permitted to|decline to|cannot provide"
    "|回答できません|お答えできません|无法回答|不能回答|kann (?:ich )?nicht (?:beantworte|beantwortet)|keine auskunft"
)
ADVICE = re.compile(
    "ปรึกษาทนาย|แนะนำให้ติดต่อ|ลองใช้คำค้น|โปรดถามใหม่|กรุณาถามใหม่|ขอบคุณที่ใช้บริการ|หวังว่าจะได้ช่วย"
    "|consult a lawyer|you may contact|try asking|thank you for|hope to help|please rephrase|弁護士|律师|rechtsanwalt"
)
SORRY = re.compile("ขออภัย|เสียใจด้วย|ขอโทษ|sorry|unfortunately|i regret|申し訳|抱歉|leider")
LABEL = re.compile(
    r"^[\s\"“”„「『'*#>\-•–—]*(?:คำตอบ|สรุปคำตอบ|ผลวิเคราะห์|ข้อมูลประกอบ|คำถาม|ถาม|ตอบ|ท่านถามว่า|ผลสืบค้นสำหรับ|answer|summary|question|query|q|a|回答|質問|问题|frage|antwort)(?:\*\*)?\s*[:：]?(?:\*\*)?(?=\s|$)\s*",
    re.I,
)
_DIGITS = re.compile("[0-9]+")
_THAI, _HAN, _KANA, _LATIN = re.compile("[ก-ฯะ-ๆ]+"), re.compile("[一-鿿]+"), re.compile("[぀-ヿ]+"), re.compile("[A-Za-zÀ-ɏ]+")
_GERMAN = re.compile(r"\b(?:der|die|das|und|ist|wer|wenn|mit|für|nicht|von|dem|den|über|nach|wird|bis|zu)\b|[äöüß]", re.I)
_ENGLISH = re.compile(r"\b(?:the|of|and|is|who|if|with|for|not|from|has|that|to|by|under|on|in)\b", re.I)
_CITE_NUMBERS = re.compile(r"(?:มาตรา|sec\.|section|§|第)\s*[0-9]")
_FOLD = {ord(a): b for a, b in zip("๐๑๒๓๔๕๖๗๘๙", "0123456789", strict=True)} | dict.fromkeys([0x200B, 0x200C, 0x200D, 0xFEFF])


def language(text: str) -> str:
    """th, zh, ja, de, en or '' by letters; of Latin text by its small words."""
    thai, han, kana, latin = (sum(map(len, r.findall(text))) for r in (_THAI, _HAN, _KANA, _LATIN))
    if not thai + han + kana + latin:
        return ""
    if thai >= max(2 * (han + kana), 0.7 * latin):
        return "th"
    if 2.5 * (han + kana) >= latin:
        return "ja" if kana > 0.15 * (han + kana) else "zh"
    return "de" if len(_GERMAN.findall(text)) > len(_ENGLISH.findall(text)) else "en"


class _Letters(dict):
    """Code point to itself in lower case if it is a letter, mark or digit, with Arabic digits; made as it is first met."""

    def __missing__(self, code: int) -> str | None:
        c = chr(code)
        kind = unicodedata.category(c)
        self[code] = out = str(unicodedata.digit(c)) if kind == "Nd" else c.lower() if kind[0] in "LM" or c.isalnum() else None
        return out


_LETTERS = _Letters()


def folded(text: str) -> str:
    t = text if unicodedata.is_normalized("NFC", text) else unicodedata.normalize("NFC", text)
    return t.translate(_LETTERS)


def grams(s: str, n: int = 5) -> set[str]:
    return {s[i : i + n] for i in range(len(s) - n + 1)} if len(s) >= n else {s} if s else set()


class Clause:
    __slots__ = ("text", "low", "fold", "echo", "lang", "size", "last")

    def __init__(self, text: str, question: set[str]):
        self.text = text
        self.low = " ".join(text.translate(_FOLD).lower().split())
        self.fold = folded(text)
        own = grams(self.fold)
        self.echo = len(own & question) / len(own) if own else 0.0
        self.lang = language(text)
        self.size = len(self.fold)
        self.last = False


def clauses(question: str | None, answer: str | None, tagger: sentences.Tagger) -> list[Clause]:
    """The units of a response that say something; labels before them, headings, citation lines and stand-ins are left out."""
    if not answer:
        return []
    q, out = grams(folded(question or "")), []
    for a, b in tagger.units(answer):
        unit = answer[a:b]
        if sentences.CITATION.match(unit) or sentences.HEADING_MARK.match(unit) or unit.strip() in tagger.headings:
            continue
        text = sentences.LIST_MARK.sub("", unit, count=1) if sentences.LIST_MARK.match(unit) else unit
        before = None
        while text != before:
            before, text = text, LABEL.sub("", text, count=1)
        bare = re.sub(r"^[\W_]+|[\W_]+$", "", unicodedata.normalize("NFC", text.translate(_FOLD))).lower()
        if not bare or bare in NO_VALUE or text.strip(" ().-—").lower() in NO_VALUE:
            continue
        c = Clause(text, q)
        if c.size:
            out.append(c)
    if out:
        out[-1].last = True
    return out


SIGNS = 19


def features(c: Clause, first: bool, cut: bool, q_lang: str) -> list[int]:
    """Indices of the signs that hold."""
    low = c.low
    f = [0, 1 + min(4, int(c.echo * 5))]
    f.append(6 if not c.lang or not q_lang else 7 if c.lang == q_lang else 8)
    for i, hit in enumerate((DECLINE.search(low), ADVICE.search(low), SORRY.search(low), _CITE_NUMBERS.search(low), first, c.last, c.last and cut)):
        if hit:
            f.append(9 + i)
    f.append(16 + (0 if c.size < 15 else 1 if c.size < 60 else 2))
    return f


def hashed(cs: list[Clause]) -> list[np.ndarray]:
    """Buckets of each clause's character six-grams, numbers read as 0."""
    folds = [_DIGITS.sub("0", c.fold) for c in cs]
    w = Windows(folds)
    starts, whose = w.every(6)
    own = SIGNS + (w.hashes(starts, starts + 6) % np.uint64(BUCKETS)).astype(np.int64)
    return np.split(own, np.searchsorted(whose, np.arange(1, len(cs))))


N_FEATURES = SIGNS + BUCKETS


def weak_label(c: Clause, cut: bool, q_lang: str) -> int:
    if DECLINE.search(c.low):
        does = REFUSAL
    elif c.echo >= ECHO:
        does = ECHOED
    elif ADVICE.search(c.low) or (SORRY.search(c.low) and c.size < 20):
        does = COURTESY
    else:
        does = ANSWER
    return does + (FOREIGN if c.lang and q_lang and c.lang != q_lang else 0) + (UNFINISHED if c.last and cut else 0)


#: Parts of the tags: four of what the clause does, whether it is foreign, whether unfinished; a tag weighs what its parts weigh.
PARTS = np.stack([[t & 3 == k for t in TAGS] for k in range(4)] + [[bool(t & FOREIGN) is b for t in TAGS] for b in (False, True)] + [[bool(t & UNFINISHED) is b for t in TAGS] for b in (False, True)]).astype(np.float32)


class Field:
    """A linear-chain conditional random field over sparse binary features."""

    def __init__(self, weights: np.ndarray | None = None, moves: np.ndarray | None = None):
        self.w = np.zeros((N_FEATURES, len(PARTS))) if weights is None else weights
        self.t = np.zeros((len(TAGS), len(TAGS))) if moves is None else moves

    def scores(self, seq: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        # n-grams weigh together as much as one sign
        return np.stack([self.w[few].sum(0) + self.w[many].sum(0) / max(1, len(many)) ** 0.5 for few, many in seq]) @ PARTS

    def train(self, data: list[tuple[list[tuple[np.ndarray, np.ndarray]], list[int]]], epochs: int = EPOCHS, seed: int = SEED) -> Field:
        """Stochastic gradient ascent of the log-likelihood, by forward-backward."""
        rng = np.random.default_rng(seed)
        seen_w, seen_t = np.full_like(self.w, 1e-2), np.full_like(self.t, 1e-2)
        for _ in range(epochs):
            for i in rng.permutation(len(data)):
                seq, gold = data[i]
                if rng.random() < HIDE:
                    seq = [(few[~np.isin(few, PHRASES)], many) for few, many in seq]
                s = self.scores(seq)
                n = len(s)
                a, b = np.empty_like(s), np.zeros_like(s)
                a[0] = s[0]
                for k in range(1, n):
                    a[k] = s[k] + _logsum(a[k - 1][:, None] + self.t, 0)
                for k in range(n - 2, -1, -1):
                    b[k] = _logsum(self.t + s[k + 1] + b[k + 1], 1)
                z = _logsum(a[-1], 0)
                g = -np.exp(a + b - z)
                g[np.arange(n), gold] += 1
                gt = np.zeros_like(self.t)
                for k in range(1, n):
                    gt -= np.exp(a[k - 1][:, None] + self.t + s[k] + b[k] - z)
                    gt[gold[k - 1], gold[k]] += 1
                seen_t += gt**2
                self.t += RATE * (gt - PENALTY * self.t) / np.sqrt(seen_t)
                for k, (few, many) in enumerate(seq):
                    for idx, scale in ((few, 1.0), (many, 1 / max(1, len(many)) ** 0.5)):
                        if len(idx):
                            step = scale * (g[k] @ PARTS.T)
                            seen_w[idx] += step**2  # a bucket met twice in a clause counts once
                            self.w[idx] += RATE * (step - PENALTY * self.w[idx]) / np.sqrt(seen_w[idx])
        return self

    def decode(self, s: np.ndarray) -> np.ndarray:
        """The best tags of a sequence, by the scores of its clauses."""
        if len(s) == 1:
            return s.argmax(1)
        best, back = s[0], []
        for k in range(1, len(s)):
            m = best[:, None] + self.t
            back.append(m.argmax(0))
            best = m.max(0) + s[k]
        tags = [int(best.argmax())]
        for p in reversed(back):
            tags.append(int(p[tags[-1]]))
        return np.asarray(tags[::-1])


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis=axis, keepdims=True)
    return np.log(np.exp(x - m).sum(axis=axis)) + np.squeeze(m, axis)


def sequence(cs: list[Clause], cut: bool, q_lang: str) -> list[tuple[np.ndarray, np.ndarray]]:
    return [(np.asarray(features(c, i == 0, cut, q_lang)), many) for i, (c, many) in enumerate(zip(cs, hashed(cs), strict=True))]


def covered(cs: list[Clause], tags: np.ndarray) -> list[str]:
    """The pair's defects by the coverage of its clauses' tags."""
    size = np.asarray([c.size for c in cs])
    does = tags & 3
    by = [int(size[does == k].sum()) for k in range(4)]
    total, said = int(size.sum()), int(size.sum()) - by[COURTESY]
    out = []
    if tags[-1] & UNFINISHED:
        out.append("truncated")
    if by[REFUSAL] and by[REFUSAL] >= REFUSAL_SHARE * (by[REFUSAL] + by[ANSWER]):
        out.append("refusal")
    if said and by[ECHOED] >= COPY_SHARE * said:
        out.append("copy")
    if int(size[(tags & FOREIGN) > 0].sum()) > FOREIGN_SHARE * total:
        out.append("other_language")
    return out


def defects(rows: list[tuple[str | None, str | None, bool]], tagger: sentences.Tagger, field: Field) -> list[list[str]]:
    """The defects of each (question, answer, whether its end is cut); the clauses of all are scored together."""
    all_ = [clauses(q, a, tagger) for q, a, _ in rows]
    flat = [c for cs in all_ for c in cs]
    if not flat:
        return [["empty"] for _ in rows]
    few, of = [], []
    for cs, (q, _, cut) in zip(all_, rows, strict=True):
        q_lang = language(q or "") if cs else ""
        for i, c in enumerate(cs):
            own = features(c, i == 0, cut, q_lang)
            few.extend(own)
            of.append(len(own))
    scores = np.add.reduceat(field.w[few], np.concatenate([[0], np.cumsum(of)[:-1]]))
    many = hashed(flat)
    n = np.asarray([len(m) for m in many])
    if n.any():
        some = np.flatnonzero(n)
        sums = np.add.reduceat(field.w[np.concatenate(many)], np.concatenate([[0], np.cumsum(n[some])[:-1]]))
        scores[some] += sums / np.sqrt(n[some])[:, None]
    scores = scores @ PARTS
    out, at = [], 0
    for cs in all_:
        out.append(covered(cs, field.decode(scores[at : at + len(cs)])) if cs else ["empty"])
        at += len(cs)
    return out


def judged_pairs(niti_results: DataFrame) -> DataFrame:
    """result_id, question, answer and whether its end is cut, of each record's earliest delivery."""
    far = F.lit("9999-12-31").cast("timestamp")
    first = niti_results.groupBy("result_id").agg(F.min(F.struct(F.coalesce("run_at", far).alias("t"), "question", "predicted_answer")).alias("f"))
    pairs = first.where("result_id is not null").select("result_id", F.col("f.question").alias("question"), F.col("f.predicted_answer").alias("answer"))
    cut = truncation.judged(truncation.answer_values(niti_results)).where("cut").select(F.col("rec_id").cast("long").alias("result_id"), "cut")
    cut = cut_lineage(cut)  # ids of few bytes, used by the sample and by the whole
    return pairs.join(cut, "result_id", "left").withColumn("cut", F.coalesce("cut", F.lit(False)))


def train(rows: list[tuple[str | None, str | None, bool]], tagger: sentences.Tagger) -> Field:
    data = []
    for q, a, cut in rows:
        cs = clauses(q, a, tagger)
        if cs:
            q_lang = language(q or "")
            data.append((sequence(cs, cut, q_lang), [weak_label(c, cut, q_lang) for c in cs]))
    return Field().train(data)


def broken_pairs(niti_results: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """result_id, defect: one row for each defect of each pair.

    A null answer is empty. Without a question there is no copy and no other language. Repeated rows count once, by
    their earliest delivery; an empty table gives no rows.
    """
    texts = niti_results.select(F.col("predicted_answer").alias("t"))
    tagger = sentences.Tagger(sentences.trained(texts), frozenset(sentences.heading_lines(texts)))
    pairs = judged_pairs(niti_results)
    labelled = least_hashes(pairs, ["result_id"], sample)
    field = train([(r["question"], r["answer"], r["cut"]) for r in labelled], tagger)
    model = niti_results.sparkSession.sparkContext.broadcast((tagger.w, tagger.headings, field.w.astype(np.float32), field.t))

    return pairs.select("result_id", "question", "answer", "cut").mapInArrow(_finder(model), _DEFECTS)


_DEFECTS = StructType([StructField("result_id", LongType()), StructField("defect", StringType())])


def _finder(model) -> Callable:
    schema = to_arrow_schema(_DEFECTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, headings, fw, ft = model.value
        tagger, field = sentences.Tagger(w, headings), Field(fw, ft)
        ids, rows, size = [], [], 0

        def out() -> pa.RecordBatch:
            found = [(k, d) for k, own in zip(ids, defects(rows, tagger, field), strict=True) for d in own]
            return pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], c.type) for i, c in enumerate(schema)], schema=schema)

        for b in batches:
            for key, q, a, cut in zip(*(c.to_pylist() for c in b.columns), strict=True):
                ids.append(key)
                rows.append((q, a, cut))
                size += len(a or "") + 100
                if size >= TOGETHER:
                    yield out()
                    ids, rows, size = [], [], 0
        yield out()

    return run


def defect_report(found: DataFrame, niti_results: DataFrame) -> DataFrame:
    """Per generator and defect: the records that have it, and their share of the generator's records."""
    rows = niti_results.groupBy("result_id").agg(F.min("generator").alias("generator"))
    totals = rows.groupBy("generator").agg(F.count("*").alias("n_records"))
    counts = found.join(rows, "result_id").groupBy("generator", "defect").agg(F.count("*").alias("n_defects"))
    totals = totals.withColumnRenamed("generator", "own")
    joined = counts.join(totals, F.col("generator").eqNullSafe(F.col("own")))
    return joined.select("generator", "defect", "n_defects", "n_records", F.round(F.col("n_defects") / F.col("n_records"), 6).alias("share"))
