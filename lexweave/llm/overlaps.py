"""The same or nearly the same question in train and in another split (problem 1).

Edit-distance segment join. Each question gets a canonical form: letters and digits in NFC, lower case, Arabic digits,
without courtesy words. Two rows can only match if their sets of sections and their numbers (dates, amounts, periods)
are the same, so rows are shuffled once to that key. A pair may differ by ``edits`` of the longer string's characters, which is at most
k = edits / (1 - edits) of the evaluation string's, as a train string longer than that is out of reach. Each evaluation string is cut
into k + 1 segments and one more for each seam between its sentences: a train string within reach holds one of them unchanged, at most k
characters from its place or, where the order of sentences differs, in a sentence that stands elsewhere. One automaton finds them. The
train string's sentences are put in the order in which the evaluation string has them, and a banded dynamic program verifies.

Equal strings of a key and side are one class, and only classes are matched. A key of many classes is spread over a grid as
wide as it needs for a cell to hold at most ``cell_rows`` of each side; each cell is one task's work.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterator

import ahocorasick
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, BooleanType, IntegerType, LongType, StringType, StructField, StructType

from lexweave.llm.rows import map_rows

EDITS, BLOCK, CELL_ROWS = 0.2, 14, 4000

#: Words of courtesy around a question.
COURTESY = re.compile(
    r"เรียนถามว่า|เรียนถาม|ขอสอบถามว่า|ขอสอบถาม|ขอถามว่า|ขอถาม|สมมติว่า|สมมุติว่า|สวัสดีครับ|สวัสดีค่ะ|สวัสดี|ขอบคุณครับ|ขอบคุณค่ะ|ขอบคุณ|นะครับ|นะคะ|ครับ(?=[\s?]|$)|ค่ะ(?=[\s?]|$)|คะ(?=[\s?]|$)"
    r"|\b(?:hello|hi|dear sir or madam|query:|question:|please advise|please help|thank you|thanks)\b[,.!]?|お尋ねします|教えてください|よろしくお願いします|请问|谢谢|guten tag|bitte um auskunft|vielen dank",
)
#: Short months for the full ones.
MONTHS = dict(
    zip(
        "ม.ค. ก.พ. มี.ค. เม.ย. พ.ค. มิ.ย. ก.ค. ส.ค. ก.ย. ต.ค. พ.ย. ธ.ค.".split(),
        "มกราคม กุมภาพันธ์ มีนาคม เมษายน พฤษภาคม มิถุนายน กรกฎาคม สิงหาคม กันยายน ตุลาคม พฤศจิกายน ธันวาคม".split(),
        strict=True,
    )
)
_MONTH = re.compile("|".join(re.escape(m) for m in sorted(MONTHS, key=len, reverse=True)))
_DIGITS = {ord(a): b for a, b in zip("๐๑๒๓๔๕๖๗๘๙", "0123456789", strict=True)} | dict.fromkeys([0x200B, 0x200C, 0x200D, 0xFEFF])
_STOP, _WIDE_STOP = re.compile(r"[.?!。？！…;:][\"”'」』)）]*$"), re.compile(r"(?<=[。？！])")
_THAI = re.compile("[ก-๛]")
_NUMBER = re.compile(r"[0-9](?:[0-9,]*[0-9])?(?:\.[0-9]+)?")
_WORDS = re.compile(r"[^\W_]+(?:[ัิ-ฺ็-๎゙゚]+[^\W_]*)*|[ัิ-ฺ็-๎]+")


def canonical(question: str) -> tuple[str, list[int], str]:
    """The string to compare, the offsets in it at which a sentence (in Thai, what stands between spaces) may begin, and its numbers as a key."""
    t = unicodedata.normalize("NFC", question.translate(_DIGITS)).lower()
    t = COURTESY.sub(" ", _MONTH.sub(lambda m: MONTHS[m.group()], t))
    numbers = sorted(x.replace(",", "") for x in _NUMBER.findall(t))
    out, starts, at, ended = [], [], 0, True
    for chunk in _WIDE_STOP.sub(" ", t).split():
        s = "".join(_WORDS.findall(chunk))
        thai = bool(_THAI.search(chunk))
        if s:
            if ended or thai:
                starts.append(at)
            out.append(s)
            at += len(s)
        ended = thai or bool(_STOP.search(chunk))
    return "".join(out), starts, " ".join(numbers)


def section_key(sections: list[str | None] | None) -> str:
    """The set of sections, whatever their order, repetition, digits and blanks."""
    names = {re.sub(r"\s+|^มาตรา", "", unicodedata.normalize("NFC", s.translate(_DIGITS)).strip()) for s in sections or [] if s}
    return ",".join(sorted(names - {""}))


def reach(s: str, edits: float) -> int:
    """The edits within which a string can match s at all: the longer of the two allows them."""
    return int(edits / (1 - edits) * len(s) + 1e-9)


def segments(s: str, k: int) -> list[tuple[int, str]]:
    """s cut into k + 1 segments of even length, as (offset, segment); fewer if s is shorter than that."""
    n = min(k + 1, len(s))
    cuts = [len(s) * i // n for i in range(n + 1)] if n else []
    return [(a, s[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def banded_distance(a: str, b: str, k: int) -> int:
    """Edit distance within a band of k diagonals; k + 1 if it is more."""
    n, m = len(a), len(b)
    if abs(n - m) > k:
        return k + 1
    far = k + 1
    row = [j if j <= k else far for j in range(m + 1)]
    for i in range(1, n + 1):
        low, high = max(1, i - k), min(m, i + k)
        new = [far] * (m + 1)
        if i <= k:
            new[0] = i
        best, ca = far, a[i - 1]
        for j in range(low, high + 1):
            d = row[j - 1] if ca == b[j - 1] else 1 + min(row[j - 1], row[j], new[j - 1])
            new[j] = d
            if d < best:
                best = d
        if best > k and not (i <= k and new[0] <= k):
            return far
        row = new
    return min(row[m], far)


def longest_gap(a: str, b: str) -> int:
    """Characters of the longest stretch in which the two strings share no run of four: a whole phrase replaced."""
    grams = {b[i : i + 4] for i in range(len(b) - 3)}
    run = best = 0
    for i in range(len(a) - 3):
        run = 0 if a[i : i + 4] in grams else run + 1
        best = max(best, run)
    return max(0, best - 3)


class Cell:
    """The evaluation strings of one key, against the train strings that follow."""

    def __init__(self, edits: float, block: int):
        self.edits, self.block = edits, block
        self.strings: list[tuple] = []
        self.bags: list[Counter[str]] = []
        self.automaton = None

    def add(self, number: int | bytes, s: str, starts: list[int] | tuple[int, ...] = (0,)) -> None:
        self.strings.append((number, s, tuple(starts)))
        self.bags.append(Counter(s))

    def _build(self) -> None:
        places: dict[str, dict[int, list[int]]] = {}
        for i, (_, s, own) in enumerate(self.strings):
            for at, seg in segments(s, reach(s, self.edits) + max(0, len(own) - 1)):
                places.setdefault(seg, {}).setdefault(i, []).append(at)
        self.automaton = ahocorasick.Automaton()
        for seg, where in places.items():
            self.automaton.add_word(seg, (len(seg), list(where.items())))
        self.automaton.make_automaton()

    def matches(self, t: str, starts: list[int]) -> list[tuple[int | bytes, int]]:
        """(evaluation class, distance) of each string that t is within the allowed edits of, its sentences in whatever order."""
        if not self.strings or not t:
            return []
        if self.automaton is None:
            self._build()
        shifts: dict[int, dict[int, Counter[int]]] = {}
        ends = [*starts[1:], len(t)]
        here = 0
        for end, (length, where) in self.automaton.iter(t):
            p = end - length + 1
            if p < (starts[here] if starts else 0):
                here = 0
            while here + 1 < len(starts) and starts[here + 1] <= p:
                here += 1
            for i, ats in where:
                if len(ats) > 8:  # a segment that stands everywhere: its nearest place will do
                    j = bisect_left(ats, p)
                    ats = ats[max(0, j - 1) : j + 1]
                for at in ats:
                    if len(starts) > 1 or abs(p - at) <= reach(self.strings[i][1], self.edits):
                        shifts.setdefault(i, {}).setdefault(here, Counter())[p - at] += 1
        bag, out = Counter(t), []
        for i, own in shifts.items():
            number, s, places = self.strings[i]
            k = int(self.edits * max(len(s), len(t)))
            if len(s) - len(t) > k or len(t) - len(s) > k or max((self.bags[i] - bag).total(), (bag - self.bags[i]).total()) > k:
                continue  # no order brings them nearer
            best = k + 1
            for turned in self._orders(s, places, t, starts, ends, own):
                d = 0 if s == turned else banded_distance(s, turned, min(k, best))
                if d < best and max(longest_gap(s, turned), longest_gap(turned, s)) <= self.block:
                    best = d
                if not best:
                    break
            if best <= k:
                out.append((number, best))
        return out

    @staticmethod
    def _orders(s: str, places: tuple[int, ...], t: str, starts: list[int], ends: list[int], shifts: dict[int, Counter[int]]) -> list[str]:
        """t as it is, and with its sentences in such orders as s may have them in.

        By the sentences that are most alike, where both have as many; by where most of a sentence's segments stand in s, one
        without any behind the one before it; and turned where most segments' shift says.
        """
        out, n = [t], len(starts)
        if n < 2:
            return out
        orders = []
        if len(places) == n:
            orders.append(_alike([s[a:b] for a, b in zip(places, (*places[1:], len(s)), strict=True)], [t[a:b] for a, b in zip(starts, ends, strict=True)]))
        place, order = -1.0, []
        for j, start in enumerate(starts):
            if j in shifts:
                place = start - min(shifts[j].items(), key=lambda x: (-x[1], abs(x[0])))[0]
            order.append((place, j))
        orders.append([j for _, j in sorted(order)])
        votes: Counter[int] = Counter()
        for own in shifts.values():
            votes.update(own)
        for shift, _ in votes.most_common(3):
            r = min(range(n), key=lambda x: min(abs(shift - starts[x]), abs(shift + len(t) - starts[x])))
            orders.append([*range(r, n), *range(r)])
        for by in orders:
            if (turned := "".join(t[starts[j] : ends[j]] for j in by)) not in out:
                out.append(turned)
        return out


def _alike(a: list[str], b: list[str]) -> list[int]:
    """Which of b stands for each of a in turn: the pairs that differ least in their characters first."""
    bags_a, bags_b = [Counter(x) for x in a], [Counter(x) for x in b]
    cost = sorted(((x - y).total() + (y - x).total(), abs(i - j), i, j) for i, x in enumerate(bags_a) for j, y in enumerate(bags_b))
    of: dict[int, int] = {}
    taken: set[int] = set()
    for _, _, i, j in cost:
        if i not in of and j not in taken:
            of[i] = j
            taken.add(j)
    return [of[i] for i in range(len(a))]


_CANON = StructType(
    [StructField("qa_id", LongType()), StructField("train", BooleanType()), StructField("key", BinaryType()), StructField("cls", BinaryType()), StructField("s", StringType()), StructField("starts", ArrayType(IntegerType()))]
)


def _hash(s: str) -> bytes:
    """128 bits, so that no two strings are taken for one."""
    return xxhash.xxh3_128_digest(s.encode("utf-8", "surrogatepass"))


def classes(qa: DataFrame) -> DataFrame:
    """qa_id, train, key, cls (the class of equal strings of one key and side), s and starts of each record's earliest delivery."""
    far = F.lit("9999-12-31").cast("timestamp")
    first = qa.groupBy("qa_id").agg(F.min(F.struct(F.coalesce("loaded_at", far).alias("t"), "split", "question", "relevant_sections")).alias("f"))
    rows = first.where("qa_id is not null and f.split is not null and f.question is not null").select("qa_id", (F.col("f.split") == "train").alias("train"), F.col("f.question").alias("q"), F.col("f.relevant_sections").alias("r"))

    def make() -> Callable:
        def one(qa_id: int, train: bool, q: str, r: list | None) -> list[tuple]:
            s, starts, numbers = canonical(q)
            if not s:
                return []
            key = f"{section_key(r)}|{numbers}"
            return [(qa_id, train, _hash(key), _hash(f"{train}|{key}|{s}|{starts}"), s, starts)]

        return one

    return map_rows(rows, make, _CANON)


def _joiner(edits: float, block: int) -> Callable:
    schema = pa.schema([("cls_e", pa.binary()), ("cls_t", pa.binary()), ("distance", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, own = Cell(edits, block), None
        for b in batches:
            found = []
            for key, ge, gt, train, cls, s, starts in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if (key, ge, gt) != own:
                    cell, own = Cell(edits, block), (key, ge, gt)
                if train:
                    found.extend((e, cls, d) for e, d in cell.matches(s, starts))
                else:
                    cell.add(cls, s, starts)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*found, strict=True), schema, strict=True)], schema=schema)

    return run


def class_links(members: DataFrame, edits: float = EDITS, block: int = BLOCK, cell_rows: int = CELL_ROWS) -> DataFrame:
    """cls_e, cls_t, distance: each evaluation class with each train class that it matches."""
    n = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    reps = members.groupBy("key", "train", "cls").agg(F.first("s").alias("s"), F.first("starts").alias("starts"))
    # a key's width is known to its own rows only: hot keys are at most as many as all classes by cell_rows
    hot = reps.groupBy("key").agg(F.ceil(F.count("*") / cell_rows).cast("int").alias("g")).where("g > 1")
    reps = reps.join(hot, "key", "left")
    mine = F.pmod(F.xxhash64("cls"), F.coalesce("g", F.lit(1))).cast("int")
    other = F.sequence(F.lit(0), F.coalesce("g", F.lit(1)) - 1)
    cells = reps.withColumn("other", F.explode(other)).select(
        "key", F.when(F.col("train"), F.col("other")).otherwise(mine).alias("ge"), F.when(F.col("train"), mine).otherwise(F.col("other")).alias("gt"), "train", "cls", "s", "starts"
    )
    spread = cells.repartition(n, "key", "ge", "gt").sortWithinPartitions("key", "ge", "gt", "train", "cls")
    return spread.mapInArrow(_joiner(edits, block), "cls_e binary, cls_t binary, distance int")


def overlaps(qa: DataFrame, **options) -> DataFrame:
    """qa_id_e, qa_id_t, distance: each row outside train with each train row that puts the same question.

    Rows without a split, an id or any word in the question match nothing. A null set of sections is the empty set.
    Copies match like any two rows: all their pairs are listed, as the query's columns ask for.
    """
    members = classes(qa)
    links = class_links(members, **options)
    e = members.where("not train").select(F.col("qa_id").alias("qa_id_e"), F.col("cls").alias("cls_e"))
    t = members.where("train").select(F.col("qa_id").alias("qa_id_t"), F.col("cls").alias("cls_t"))
    return links.join(e, "cls_e").join(t, "cls_t").select("qa_id_e", "qa_id_t", "distance")


def overlap_report(qa: DataFrame, **options) -> DataFrame:
    """Per split and source of the evaluation row: its rows, those with a match in train, the share, and the pairs.

    Pairs are counted from the sizes of the classes, and not listed.
    """
    members = classes(qa)
    sizes = members.where("train").groupBy(F.col("cls").alias("cls_t")).agg(F.count("*").alias("n"))
    matched = class_links(members, **options).join(sizes, "cls_t").groupBy(F.col("cls_e").alias("cls")).agg(F.sum("n").alias("pairs"))
    pairs = members.where("not train").join(matched, "cls").select(F.col("qa_id").alias("qa_id_e"), "pairs")
    rows = qa.groupBy(F.col("qa_id").alias("qa_id_e")).agg(F.min("split").alias("split"), F.min("source").alias("source")).where("split <> 'train'")
    joined = rows.join(pairs, "qa_id_e", "left")
    n, hit = F.count("*"), F.count("pairs")
    return joined.groupBy("split", "source").agg(n.alias("n_rows"), hit.alias("n_overlapping"), F.coalesce(F.sum("pairs"), F.lit(0)).alias("n_pairs"), F.round(hit / n, 6).alias("share"))
