"""Subject areas of documents (problem 9).

Weighted terms of each subject are matched by one multi-pattern automaton. A sentence deals with the subject whose terms
weigh most in it, if they outweigh the others; a document has every subject with which at least ``SHARE`` of its
sentences deal. Sentences come from the sentence tagger.

The terms begin with the labelled examples, a table of fixed size, and grow by rule from all documents: those whose known
terms are nearly all of one subject are labelled with it, and every run of characters (Thai, Han and kana) or words in them
that stands in them far more than in others is a term, weighted by how pure and how rare it is. Where the examples show little of
a language, curated terms and the words of the subjects' descriptions begin with them.

They are counted exactly, in two scans of the clear documents, kept deflated on the executors' disks meanwhile. A term's excess is its occurrences in documents of its subject less
``ALONE`` of all its occurrences; it must be at least one in ``RARE`` documents. If that holds of all documents it holds in
at least one chunk of them, so the first scan gives the hashes of what passes in any chunk, and the second counts only those.
No term contains another of its subject. Wrong labels are outvoted: a term needs several texts.
"""

from __future__ import annotations

import math
import re
import unicodedata
import zlib
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BinaryType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

from lexweave.llm import sentences
from lexweave.llm.rows import map_rows
from lexweave.llm.windows import Windows

SHARE = 0.2
#: A term stands in at least this many texts, this share of them of its subject; a document is clear if this share of its known terms are of the same subject.
TEXTS, PURITY, CLEAR = 3, 0.85, 0.7
#: Share of a term's occurrences that do not speak for it; documents of which one must show it.
ALONE, RARE = 0.65, 400
LOOSE = PURITY - ALONE
#: Shortest and longest terms in characters: Thai, Han and kana; in words: others. Lengths that are counted in documents.
THAI_TERM, HAN_TERM, WORDS = (5, 22), (2, 10), 2
THAI_LENGTHS, HAN_LENGTHS = (7,), (2, 3, 4)
#: Characters of the documents that are counted together.
CHUNK = 3_000_000
#: Thresholds that the labelled examples choose from: how far a subject must outweigh the others, and its least weight as a share of the median.
MARGINS, FLOORS = (1.2, 1.5, 2.0, 1.1), (0.1, 0.2, 0.05, 0.3)

#: Curated terms of subjects in English, German, Chinese and Japanese, of which the examples show little.
SEEDS = {
    "criminal": ["stolen goods", "arrest warrant", "confession", "fugitive", "assaulted", "haftbefehl", "geständnis", "tatwaffe", "diebesgut", "凶器", "逮捕", "认罪", "盗", "自白", "逃亡者"],
    "contract": ["guarantee", "deposit", "hire-purchase", "purchase order", "contractual penalty", "bürgschaft", "anzahlung", "vertragsstrafe", "lieferfrist", "定金", "违约金", "保证书", "手付金", "違約金", "保証書"],
    "property": ["easement", "title deed", "boundary fence", "condominium", "usufruct", "grenzzaun", "eigentumswohnung", "wegerecht", "nießbrauch", "地契", "界墙", "地役权", "境界", "通行権", "区分所有"],
    "family": ["marital", "adoption", "betrothal", "last will", "child maintenance", "testament", "unterhalt", "verlob", "ehegatt", "遗嘱", "遗产", "抚养费", "婚", "遺言", "養育費", "相続"],
    "labour": ["wages", "overtime", "severance", "annual leave", "work rules", "überstunden", "abfindung", "jahresurlaub", "arbeitslohn", "工资", "加班", "年假", "解雇", "賃金", "残業", "休暇", "退職"],
    "company": ["share register", "shareholders", "dividend", "bankruptcy", "embellished the accounts", "aktienbuch", "dividende", "insolvenz", "bilanz", "股息", "股东", "破产", "账目", "配当", "株主", "破産", "決算"],
    "tax": ["tax invoice", "tax return", "customs", "import duty", "withholding tax", "steuer", "einfuhrzoll", "finanzamt", "rechnungen", "纳税", "关税", "发票", "预扣税", "関税", "申告", "納税", "源泉"],
    "environment": ["mangrove", "groundwater", "timber", "industrial waste", "untreated water", "gemeindewald", "klärbecken", "industrieabfall", "wasserlizenz", "红树林", "地下水", "工业废物", "污水", "産業廃棄物", "汚水", "取水", "共有林"],
    "software": ["source code", "password", "database", "server", "software", "quellcode", "passwort", "datenbank", "verkehrsprotokoll", "源代码", "密码", "数据库", "服务器", "ソース", "パスワード", "データベース", "サーバー"],
    "sport": ["match ticket", "club", "referee", "boxing", "doping", "pokal", "verein", "schiedsrichter", "spielervertrag", "比赛", "俱乐部", "裁判", "球员", "競技", "選手", "試合", "観戦券"],
}

_INVISIBLE = dict.fromkeys([0x200B, 0x200C, 0x200D, 0xFEFF])
_ODD, _LATIN, _NO_WORD = re.compile("[\u200b-\u200d\ufeff]"), re.compile("[A-Za-z]{3}"), re.compile(r"[^\w฀-๿'’\-]")
_THAI_RUN, _HAN_RUN, _WORD = re.compile("[ก-๎]+"), re.compile("[぀-ヿ一-鿿]+"), re.compile(r"[a-zà-ÿœß]+(?:['’\-][a-zà-ÿœß]+)*")
#: Sentences with Thai and those without.
THAI, OTHER = 0, 1
POOLS = (THAI, OTHER)
#: Times that terms are mined with those mined before.
ROUNDS = 1


def normal(text: str) -> str:
    """Lower case, NFC, no invisible characters; in texts with Latin letters blanks for all but words."""
    return _apart(plain(text))


def _apart(t: str) -> str:
    return f" {_NO_WORD.sub(' ', t.lower())} " if _LATIN.search(t) else t


def candidates(t: str) -> set[str]:
    """Substrings that could be terms: of runs of Thai or Han and kana, and sequences of words."""
    out: set[str] = set()
    for rx, (low, high) in ((_THAI_RUN, THAI_TERM), (_HAN_RUN, HAN_TERM)):
        step = 1 if high <= 10 else 2
        for m in rx.finditer(t):
            run = m.group()
            for n in range(low, min(high, len(run)) + 1, step):
                out.update(run[i : i + n] for i in range(len(run) - n + 1))
    for part in re.split(r"[^a-zà-ÿœß'’\- ]+", t):
        w = _WORD.findall(part)
        for n in range(1, WORDS + 1):
            out.update(f" {' '.join(w[i : i + n])} " for i in range(len(w) - n + 1) if n > 1 or len(w[i]) > 3)
    return out


def curate(texts: list[tuple[str, int]], least: int = TEXTS, purity: float = PURITY) -> dict[str, tuple[int, float]]:
    """Term to its subject and weight, of labelled normal texts."""
    found: Counter[str] = Counter()
    by: dict[str, Counter[int]] = defaultdict(Counter)
    for t, subject in texts:
        for c in candidates(t):
            found[c] += 1
            by[c][subject] += 1
    sizes = Counter(s for _, s in texts)
    pure: dict[str, tuple[int, float]] = {}
    for c, n in found.items():
        if n < least:
            continue
        subject, k = min(by[c].items(), key=lambda x: (-x[1], x[0]))
        own, other = k / sizes[subject], (n - k) / max(1, len(texts) - sizes[subject])
        if k >= least and own / (own + other) >= purity and k / n >= purity - LOOSE:
            pure[c] = (subject, weight(own, other, len(texts), n))
    return leading(shortest(pure), found)


def leading(pure: dict[str, tuple[int, float]], often: dict[str, int]) -> dict[str, tuple[int, float]]:
    """Without the runs that begin one character after another of their subject that stands about as often: where they stand so does that, and only the first counts."""
    before = {(c[1:], s): c for c, (s, _) in pure.items() if kind(c) < 2}
    follows = lambda c, s: (v := before.get((c[:-1], s))) is not None and 0.95 * often[c] <= often[v] <= 1.05 * often[c]
    return {c: x for c, x in pure.items() if kind(c) == 2 or not follows(c, x[0])}


def weight(own: float, other: float, texts: int, n: int) -> float:
    return math.log((own + 1e-4) / (other + 2e-3)) * math.log(1 + texts / n)


def shortest(pure: dict[str, tuple[int, float]]) -> dict[str, tuple[int, float]]:
    """Of pure terms those of some weight that contain no other of their subject."""
    if not pure:
        return {}
    automaton = ahocorasick.Automaton()
    for c in pure:
        automaton.add_word(c, c)
    automaton.make_automaton()
    return {c: (s, w) for c, (s, w) in pure.items() if w > 0 and not any(x != c and pure[x][0] == s for _, x in automaton.iter(c))}


def _left(inside: np.ndarray) -> np.ndarray:
    """How many places from each on lie inside without a break."""
    n = len(inside)
    nxt = np.minimum.accumulate(np.where(inside, n, np.arange(n))[::-1])[::-1] if n else np.zeros(0, np.int64)
    return np.where(inside, nxt - np.arange(n), 0)


class Chunk:
    """Normal texts with their subjects' numbers, and the hashes of all runs in them that could be terms."""

    def __init__(self, texts: list[str], labels: list[int], bits: int):
        self.texts, self.bits = texts, np.uint64(bits)
        self.joined = "\0".join([*texts, ""])
        self.w = Windows(texts)
        self.codes = np.frombuffer(self.joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        self.labels = np.asarray(labels, np.uint64)
        self.whose = np.repeat(np.arange(len(texts)), np.diff(self.w.offsets))

    def _spans(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        c = self.codes
        for inside, lengths in (((c >= 0x0E01) & (c <= 0x0E4E), THAI_LENGTHS), (((c >= 0x3040) & (c <= 0x30FF)) | ((c >= 0x4E00) & (c <= 0x9FFF)), HAN_LENGTHS)):
            if inside.any():
                left = _left(inside)
                for n in lengths:
                    starts = np.flatnonzero(left >= n)
                    yield starts, starts + n
        letter = ((c >= 97) & (c <= 122)) | ((c >= 0xE0) & (c <= 0xFF)) | (c == 0x153)
        word = letter | (c == 0x27) | (c == 0x2019) | (c == 0x2D)
        edge = np.diff(np.concatenate([[0], word.view(np.int8), [0]]))
        a, b = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        whole = (a > 0) & (b < len(c))
        a, b = a[whole], b[whole]
        blank = (c[a - 1] == 32) & (c[b] == 32) & letter[a] & letter[b - 1]
        next_ = np.append(a[1:] == b[:-1] + 1, False) & blank & np.append(blank[1:], False) if len(a) else blank
        follows = blank
        for n in range(1, WORDS + 1):
            if n > 1:
                follows = follows[: len(a) - n + 1] & next_[n - 2 : len(a) - 1] if len(a) >= n else np.zeros(0, bool)
            i = np.flatnonzero(follows)
            if n == 1:
                i = i[b[i] - a[i] > 3]
            yield a[i] - 1, b[i + n - 1] + 1

    def hashes(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Starts, ends and hashes (with room for the label in the lowest bits) of the runs of each length."""
        for starts, ends in self._spans():
            if len(starts):
                yield starts, ends, self.w.hashes(starts, ends) >> self.bits << self.bits

    def passing(self) -> np.ndarray:
        """Hashes of the runs whose excess in this chunk is large enough."""
        least, out = len(self.texts) / RARE, []
        for starts, _, h in self.hashes():
            own = np.sort(h | self.labels[self.whose[starts]])
            first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
            count = np.diff(np.append(first, len(own)))
            key = own[first] >> self.bits
            group = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            best, n = np.maximum.reduceat(count, group), np.add.reduceat(count, group)
            out.append(key[group][best - ALONE * n >= least])
        return np.unique(np.concatenate(out)) if out else np.zeros(0, np.uint64)


class Known:
    """A set of hashes, asked by the array; a bit map leaves few to look up."""

    def __init__(self, hashes: np.ndarray, bits: int, named: np.ndarray):
        self.sorted = np.sort(hashes)
        self.named = np.isin(self.sorted, named)  # those whose terms are asked for in any case
        self.shift = np.uint64(64 - bits - 22)
        self.map = np.zeros(1 << 22, bool)
        self.map[(self.sorted >> self.shift).astype(np.int64)] = True

    def among(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of some hashes are in the set, and the numbers they have there."""
        i = np.flatnonzero(self.map[(h >> self.shift).astype(np.int64)]) if len(self.sorted) else np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.sorted, h[i]), len(self.sorted) - 1)
        same = self.sorted[at] == h[i] if len(i) else np.zeros(0, bool)
        return i[same], at[same]


class Counts:
    """How often, and in how many texts, each known run stands in texts of each label; what a task has seen."""

    def __init__(self, known: Known, labels: int):
        self.known, self.labels = known, labels
        self.n, self.texts = np.zeros((2, len(known.sorted) * labels), np.int32)
        self.names: list[str | None] = [None] * len(known.sorted)
        self.unnamed = np.ones(len(known.sorted), bool)
        self.sizes = np.zeros(labels, np.int64)

    def add(self, chunk: Chunk) -> None:
        self.sizes += np.bincount(chunk.labels.astype(np.int64), minlength=self.labels)
        for starts, ends, h in chunk.hashes():
            i, number = self.known.among(h >> chunk.bits)
            if not len(i):
                continue
            doc = chunk.whose[starts[i]]
            texts = len(chunk.texts)
            both = np.sort((number * self.labels + chunk.labels[doc].astype(np.int64)) * texts + doc)  # a run's texts stand together
            pair = np.flatnonzero(np.concatenate([[True], both[1:] != both[:-1]]))
            key = both[pair] // texts
            first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            own = key[first]
            self.n[own] += np.add.reduceat(np.diff(np.append(pair, len(both))), first)
            self.texts[own] += np.diff(np.append(first, len(key)))
            new, first = np.unique(number[self.unnamed[number]], return_index=True)
            at = i[np.flatnonzero(self.unnamed[number])[first]]
            for k, a, b in zip(new.tolist(), starts[at].tolist(), ends[at].tolist(), strict=True):
                self.names[k] = chunk.joined[a:b]
            self.unnamed[new] = False

    def batches(self, pool: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        """pool, hash, label, occurrences, texts, and the term where it passes in what this task has seen, which it does in some task if it does in all; of label -1 the texts themselves."""
        key = np.flatnonzero(self.n)
        number, label, n = key // self.labels, key % self.labels, self.n[key]
        first = np.flatnonzero(np.concatenate([[True], number[1:] != number[:-1]])) if len(key) else key
        passes = np.zeros(len(self.known.sorted), bool)
        if len(key):
            passes[number[first]] = np.maximum.reduceat(n, first) - ALONE * np.add.reduceat(n, first) >= self.sizes.sum() / RARE
        passes |= self.known.named
        named = np.zeros(len(key), bool)
        named[first] = passes[number[first]]
        names = [None] * len(key)
        for j in np.flatnonzero(named).tolist():
            names[j] = self.names[number[j]]
        own = np.flatnonzero(self.sizes)
        columns = [
            np.concatenate([self.known.sorted[number].view(np.int64), np.zeros(len(own), np.int64)]),
            np.concatenate([label, own]), np.concatenate([n.astype(np.int64), self.sizes[own]]), np.concatenate([self.texts[key], np.full(len(own), -1)]),
        ]
        names += [None] * len(own)
        for i in range(0, len(names), 100_000):
            part = slice(i, i + 100_000)
            values = [pa.array(np.full(len(names[part]), pool)), *(pa.array(c[part]) for c in columns), pa.array(names[part], pa.string())]
            yield pa.RecordBatch.from_arrays([v.cast(f.type) for v, f in zip(values, schema, strict=True)], schema=schema)


def main_subject(hits: list[tuple[int, int, float, int]]) -> int | None:
    """The subject of a clear text: that of nearly all of its known terms, of which it has several."""
    count = Counter(h[1] for h in hits)
    best, n = min(count.items(), key=lambda x: (-x[1], x[0]), default=(None, 0))
    return best if n >= 2 and n >= CLEAR * count.total() else None


_CLEAR = StructType([StructField("pool", IntegerType()), StructField("label", IntegerType()), StructField("text", BinaryType())])


def clear_texts(documents: DataFrame, model) -> DataFrame:
    """pool, label and normal text, deflated, of each document whose known terms are nearly all of one subject."""

    def make() -> Callable:
        terms, numbers, _ = model.value
        matcher = Matcher(terms)

        def one(text: str | None) -> list[tuple]:
            if not text:
                return []
            t = normal(text)
            subject = main_subject(matcher.hits(t))
            return [] if subject is None else [(THAI if _THAI_RUN.search(text) else OTHER, numbers[subject], zlib.compress(t.encode("utf-8", "surrogatepass"), 1))]

        return one

    return map_rows(documents, make, _CLEAR, 512)


def _chunks(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[tuple[int, Chunk]]:
    """Chunks of clear texts of each pool; all of them, copies as often as they come."""
    open_: dict[int, tuple[list[str], list[int]]] = {p: ([], []) for p in POOLS}
    size = dict.fromkeys(POOLS, 0)
    for batch in batches:
        for pool, label, packed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            texts, labels = open_[pool]
            texts.append(zlib.decompress(packed).decode("utf-8", "surrogatepass"))
            labels.append(label)
            size[pool] += len(texts[-1])
            if size[pool] >= CHUNK:
                yield pool, Chunk(texts, labels, bits)
                open_[pool], size[pool] = ([], []), 0
    for pool, (texts, labels) in open_.items():
        if texts:
            yield pool, Chunk(texts, labels, bits)


_TERMS = StructType([StructField("pool", IntegerType()), StructField("h", LongType()), StructField("label", IntegerType()), StructField("n", LongType()), StructField("texts", LongType()), StructField("term", StringType())])


def mined(documents: DataFrame, terms: dict[str, tuple[int, float]], examples: list[tuple[str, int]] | tuple[()] = ()) -> tuple[dict[str, tuple[int, float, int]], dict[str, tuple[int, float]]]:
    """Term to its subject, weight and occurrences, of all clear documents, those with Thai and those without apart; and those of ``terms`` that the documents do not speak against.

    documents: one column of texts. Normal ``examples`` can only speak against a term.
    """
    spark = documents.sparkSession
    ids = sorted({s for s, _ in terms.values()})
    if not ids:
        return {}, terms
    bits, numbers = max(1, len(ids).bit_length()), {s: i for i, s in enumerate(ids)}
    model = spark.sparkContext.broadcast((terms, numbers, bits))

    def passing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = model.value[2]
        for _, chunk in _chunks(batches, bits):
            yield pa.RecordBatch.from_arrays([pa.array(chunk.passing().view(np.int64))], names=["h"])

    texts = clear_texts(documents, model).persist(StorageLevel.DISK_ONLY)
    hashes = texts.mapInArrow(passing, "h long").distinct().toPandas()["h"].to_numpy(np.int64).view(np.uint64)
    asked = np.asarray([Windows([c]).hashes(np.zeros(1, np.int64), np.full(1, len(c)))[0] for c in terms if kind(c)], np.uint64) >> np.uint64(bits)
    known = spark.sparkContext.broadcast((np.union1d(hashes, asked), asked))
    arrow = to_arrow_schema(_TERMS)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, numbers, bits = model.value
        found = Known(known.value[0], bits, known.value[1])
        counts = {p: Counts(found, len(numbers)) for p in POOLS}
        for pool, chunk in _chunks(batches, bits):
            counts[pool].add(chunk)
        for p in POOLS:
            yield from counts[p].batches(p, arrow)

    sums = texts.mapInArrow(counted, _TERMS).groupBy("pool", "h", "label", (F.col("texts") < 0).alias("all")).agg(F.sum("n").alias("n"), F.sum("texts").alias("texts"), F.max("term").alias("term"))
    each = sums.groupBy("pool", "h", F.when(F.col("all"), F.col("label")).alias("whole")).agg(F.max(F.struct(F.col("n").alias("k"), (-F.col("label")).alias("label"), "texts")).alias("top"), F.sum("n").alias("n"), F.max("term").alias("term"))
    rows = each.where("whole is not null or term is not null").collect()  # few, as they passed in a task
    texts.unpersist()
    sizes = {(r["pool"], r["whole"]): r["n"] for r in rows if r["whole"] is not None}
    rows = [r for r in rows if r["whole"] is None]
    out: dict[str, tuple[int, float, int]] = {}
    against = {r["term"] for r in rows if r["n"] >= TEXTS and (r["top"]["k"] < ALONE * r["n"] or terms.get(r["term"], (None,))[0] not in (None, ids[-r["top"]["label"]]))}
    for pool in POOLS:
        total = sum(n for (p, _), n in sizes.items() if p == pool)
        pure: dict[str, tuple[int, float]] = {}
        often: dict[str, int] = {}
        for r in rows:
            k, n, label = r["top"]["k"], r["n"], -r["top"]["label"]
            if r["pool"] != pool or r["top"]["texts"] < TEXTS or k - ALONE * n < total / RARE:
                continue
            own, other = k / sizes[pool, label], (n - k) / max(1, total - sizes[pool, label])
            if own / (own + other) >= PURITY:
                pure[r["term"]], often[r["term"]] = (ids[label], weight(own, other, total, n)), n
        for c, (s, v) in leading(shortest(confirmed(pure, examples)), often).items():
            out[c] = (s, v, often[c])
    return out, {c: v for c, v in terms.items() if c not in against}


def confirmed(pure: dict[str, tuple[int, float]], examples: list[tuple[str, int]] | tuple[()]) -> dict[str, tuple[int, float]]:
    """Without the terms that stand in enough examples of other subjects: labels by hand outvote those by rule."""
    if not pure or not examples:
        return pure
    automaton = ahocorasick.Automaton()
    for c in pure:
        automaton.add_word(c, c)
    automaton.make_automaton()
    by: dict[str, Counter[int]] = defaultdict(Counter)
    for t, s in examples:
        for c in {c for _, c in automaton.iter(t)}:
            by[c][s] += 1
    against = {c for c, n in by.items() if n.total() >= TEXTS and n[pure[c][0]] < (PURITY - LOOSE) * n.total()}
    return {c: v for c, v in pure.items() if c not in against}


def kind(term: str) -> int:
    """0 for Thai, 1 for Han and kana, 2 for words."""
    return 0 if _THAI_RUN.match(term) else 1 if _HAN_RUN.match(term) else 2


class Matcher:
    """The automaton over all terms, and what a text weighs by subject.

    ``floors``: by kind of term the least weight that makes a sentence deal with a subject; a chance hit weighs less.
    """

    def __init__(self, terms: dict[str, tuple[int, float]], floors: tuple[float, float, float] = (0.0, 0.0, 0.0), margin: float = MARGINS[0]):
        self.floors, self.margin = floors, margin
        self.automaton = ahocorasick.Automaton()
        for c, (s, w) in terms.items():
            self.automaton.add_word(c, (len(c), s, w, kind(c)))
        self.empty = not terms
        if terms:
            self.automaton.make_automaton()

    def hits(self, t: str) -> list[tuple[int, int, float, int]]:
        """(start, subject, weight, kind) of each term in a normal text; of overlapping ones of a subject only the first counts."""
        if self.empty:
            return []
        out, until = [], {}
        for end, (n, s, w, k) in self.automaton.iter(t):
            if end - n + 1 >= until.get(s, 0):
                until[s] = end + 1
                out.append((end - n + 1, s, w, k))
        return out

    def heaviest(self, hits: list[tuple[int, int, float, int]]) -> tuple[int | None, float]:
        """The subject that outweighs the others and its weight; no subject under the floor."""
        if not hits:
            return None, 0.0
        if len(hits) == 1:
            _, s, w, k = hits[0]
            return (s if w > 0 and w >= self.floors[k] else None), w
        total: dict[int, float] = {}
        for _, s, w, _ in hits:
            total[s] = total.get(s, 0.0) + w
        best = max(total, key=lambda s: (total[s], -s))
        weight = total[best]
        rest = max((w for s, w in total.items() if s != best), default=0.0)
        return (best if weight > self.margin * rest and weight >= self.floors[hits[0][3]] else None), weight

    def subject(self, t: str) -> int | None:
        return self.heaviest(self.hits(t))[0]


def plain(text: str) -> str:
    """NFC, no invisible characters."""
    t = text.translate(_INVISIBLE) if _ODD.search(text) else text
    return t if unicodedata.is_normalized("NFC", t) else unicodedata.normalize("NFC", t)


def matched(t: str, units: list[tuple[int, int]], matcher: Matcher) -> list[list[tuple[int, int, float, int]]]:
    """The hits of each sentence of a plain text. The whole text is matched once, the hits fall to the sentences by place."""
    n = _apart(t)
    shift = 1 if len(n) == len(t) + 2 else 0
    if len(n) - 2 * shift != len(t):  # lower case of another length: sentence by sentence
        return [matcher.hits(normal(t[a:b])) for a, b in units]
    out, hits, i = [], matcher.hits(n), 0
    for _, b in units:
        first = i
        while i < len(hits) and hits[i][0] - shift < b:
            i += 1
        out.append(hits[first:i])
    return out


def named(subjects_table: DataFrame) -> dict[str, tuple[int, float]]:
    """The curated terms of the subjects of these names, and the words of names and descriptions that stand in those of one subject only, also without a plural s."""
    words: dict[str, set[int]] = defaultdict(set)
    for subject, text in subjects_table.where("subject_id is not null").select("subject_id", F.concat_ws(" ", *(c for c in ("subject", "about") if c in subjects_table.columns))).collect():
        for w in _WORD.findall(normal(text)):
            if len(w) > 3:
                words[f" {w} "].add(subject)
                words[f" {w.removesuffix('s')} "].add(subject)
    curated = {t: (r["subject_id"], 1.0) for r in subjects_table.where("subject_id is not null").select("subject_id", "subject").collect() for t in SEEDS.get(r["subject"], ())}
    return {w: (min(own), 1.0) for w, own in words.items() if len(own) == 1} | curated


def fit(examples: list[tuple[str, int]], names: dict[str, tuple[int, float]], documents: DataFrame, tagger: sentences.Tagger) -> tuple[dict[str, tuple[int, float]], tuple[float, float, float], float]:
    """The terms, the least weights by kind of term, and how far a subject must outweigh the others."""
    given = [(normal(t), s) for t, s in examples]
    shown, few = curate(given), curate(given, least=2)
    terms = names | shown | {c: v for c, v in few.items() if kind(c)}
    for _ in range(ROUNDS):
        found, kept = mined(documents, terms, given)
        terms = kept | {c: v[:2] for c, v in found.items()}
    mined_ = {(kind(c), v[0]) for c, v in found.items()}  # where no document is clear, what was known stays
    terms = {c: v[:2] for c, v in found.items()} | {c: v for c, v in terms.items() if (kind(c), v[0]) not in mined_}
    middle = [_median(sorted((w, n) for c, (_, w, n) in found.items() if kind(c) == k)) for k in range(3)]
    return terms, *calibrated(examples, terms, middle, tagger)


def calibrated(examples: list[tuple[str, int]], terms: dict[str, tuple[int, float]], middle: list[float], tagger: sentences.Tagger) -> tuple[tuple[float, float, float], float]:
    """Of the thresholds to choose from those under which most examples deal most with their subject; the terms are counted over other texts.

    Of equal ones the first stands.
    """
    units = [(t, tagger.units(t), s) for t, s in ((plain(t), s) for t, s in examples)]
    best = None
    for floor in FLOORS:
        for margin in MARGINS:
            floors = tuple(floor * m for m in middle)
            matcher, right = Matcher(terms, floors, margin), 0
            for t, own, s in units:
                count = Counter(x for h in matched(t, own, matcher) if (x := matcher.heaviest(h)[0]) is not None)
                right += bool(count) and min(count.items(), key=lambda x: (-x[1], x[0]))[0] == s
            if best is None or right > best[0]:
                best = (right, floors, margin)
    return best[1], best[2]


def _median(counted: list[tuple[float, int]]) -> float:
    left = sum(n for _, n in counted) // 2
    for w, n in counted:
        left -= n
        if left < 0:
            return w
    return 0.0


_SUBJECTS = StructType([StructField("doc_id", LongType()), StructField("subject_id", LongType()), StructField("share", DoubleType())])


def subjects(documents: DataFrame, examples: DataFrame, subjects_table: DataFrame, segments: DataFrame, share: float = SHARE) -> DataFrame:
    """doc_id, subject_id, share: each document with each subject of at least ``share`` of its sentences.

    segments: the texts whose list items train the sentence tagger. Null and blank texts have no subject, nor has any text
    where there are neither examples nor subjects. Repeated rows give repeated results.
    """
    texts = documents.select("text")
    weights, headings = sentences.trained(segments), frozenset(sentences.heading_lines(texts))
    rows = [(r["text"], r["subject_id"]) for r in examples.where("text is not null and subject_id is not null").select("text", "subject_id").collect()]
    terms, floors, margin = fit(rows, named(subjects_table), texts, sentences.Tagger(weights, headings))
    model = documents.sparkSession.sparkContext.broadcast((weights, headings, terms, floors, margin))

    def make() -> Callable:
        weights, headings, *own = model.value
        tagger, matcher = sentences.Tagger(weights, headings), Matcher(*own)

        def one(doc: int, text: str | None) -> list[tuple]:
            t = plain(text or "")
            units = tagger.units(t)
            count = Counter([s for h in matched(t, units, matcher) if h and (s := matcher.heaviest(h)[0]) is not None])
            return [(doc, s, k / len(units)) for s, k in sorted(count.items()) if k >= share * len(units)]

        return one

    return map_rows(documents.select("doc_id", "text"), make, _SUBJECTS)


def composition(found: DataFrame, subjects_table: DataFrame) -> DataFrame:
    """Per subject its documents, and its weight in the corpus: the sum of its shares of them."""
    names = subjects_table.select("subject_id", "subject")
    return found.groupBy("subject_id").agg(F.countDistinct("doc_id").alias("n_documents"), F.round(F.sum("share"), 6).alias("weight")).join(F.broadcast(names), "subject_id", "left")
