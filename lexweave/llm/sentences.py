"""Sentence units across languages and scripts (problem 2).

Each place where a unit could end, a run of white space or a full stop of a script without spaces, is tagged as boundary
or inside by a linear-chain model and Viterbi decoding. Its features are the characters to the left and to the right,
read in normal form (no invisible characters, every number as 0), and the kind of white space.

The model is trained here by a structured perceptron. List items stand on their own lines, each one unit: stripped of
their marks and line ends and joined by spaces they are text of known boundaries, which is all that teaches Thai, where
nothing marks an end. At most ``SAMPLE`` items are taken to fit the weights, by a hash of their text; where a unit can
begin within a run of characters is counted over all items.

Where units follow each other without any space, places within a run of characters are open, too: behind a full stop that
a capital follows, and before what hardly stands within a run otherwise (``beginnings``); they have weights of their own.

What layout decides is no matter of the model: quotations and list items are never divided; a blank line, a list mark, a
heading or a citation line begins a unit; a section heading, a label or an apology stays with what follows it.
"""

from __future__ import annotations

import random
import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import accumulate

import ahocorasick
import pyarrow as pa

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType, TimestampType

from lexweave.llm.rows import earliest_result, least_hashes, map_rows

SAMPLE, EPOCHS, SEED = 10_000, 4, 7
LEFT, RIGHT = (1, 2, 3, 4, 6, 8, 11, 14, 18, 24, 30), (1, 2, 3, 4, 6, 8, 11, 14, 18, 24)
#: A first line is a heading if it is this short and opens at least this share of the texts that have several lines.
HEADING_CHARS, HEADING_SHARE = 40, 0.004

#: Layout marks and words before a statement that never stand as a unit of their own.
LIST_MARK = re.compile(r"[^\S\r\n]*(?:\(?[0-9๐-๙]{1,3}[)）.]|[-•*–·●▪])[^\S\r\n]+(?=\S)")
HEADING_MARK = re.compile(r"[^\S\r\n]*(?:#{1,6}[^\S\r\n]+\S|\*\*[^*\r\n]{1,60}\*\*:?[^\S\r\n]*(?=[\r\n]|$))")
CITATION = re.compile(r"[^\S\r\n]*[*_#>]*[^\S\r\n]*(?:มาตราที่เกี่ยวข้อง|อ้างอิง|Sections|Citations|References|Vorschriften|Fundstellen|関連条文|相关条文|依据条文)[*_]*[^\S\r\n]*[:：]")
SECTION = re.compile(r"\s*(?:มาตรา|ข้อ|Section|Article|Art\.|Sec\.|§)\s*[0-9๐-๙]+(?:[/.][0-9๐-๙]+)*(?=\s)|\s*第[0-9๐-๙零一二三四五六七八九十百千/]+[条條](?=\s)")
APOLOGY = frozenset(["ขออภัย", "ต้องขออภัยด้วย", "เสียใจด้วย", "ขอโทษ", "Sorry,", "Unfortunately", "Unfortunately,", "ถาม", "ท่านถามว่า"])
QUOTES = {'"': '"', "“": "”", "„": "“", "「": "」", "『": "』", "«": "»"}
STOPS, WIDE_STOPS, CLOSERS = frozenset(".!?…"), frozenset("。！？"), frozenset("\"'”’“」』»)]）】*_")

#: The Thai months, full and short; read as one word.
MONTHS = frozenset(
    "มกราคม กุมภาพันธ์ มีนาคม เมษายน พฤษภาคม มิถุนายน กรกฎาคม สิงหาคม กันยายน ตุลาคม พฤศจิกายน ธันวาคม"
    " ม.ค. ก.พ. มี.ค. เม.ย. พ.ค. มิ.ย. ก.ค. ส.ค. ก.ย. ต.ค. พ.ย. ธ.ค.".split()
)

_TOKEN = re.compile(r"\S+")
#: Words of a line that hold no stop or colon, with the one behind them: nothing between them is open outside Thai.
_COARSE = re.compile(r"(?:[^\s.!?…:：]++[^\S\r\n]++(?=\S))*+\S+")
_WIDE = re.compile(r"[。！？]")
_NUMBER = re.compile(r"[0-9๐-๙]+(?:[,./:\-][0-9๐-๙]+)*")
_INVISIBLE = dict.fromkeys([0x200B, 0x200C, 0x200D, 0xFEFF])
_LINE = re.compile(r"\r\n?|\n")
_THAI = re.compile(r"[ก-๛]")
_GLUED = re.compile(r"(?<=[^\W_][^\W_][.!?])(?=[A-ZÄÖÜ](?:[a-zäöüß]|$))|(?<=[.!?)\"”][.!?)\"”])(?=[A-ZÄÖÜ](?:[a-zäöüß]|$))|(?<=[0-9][.!?])(?=[A-ZÄÖÜ](?:[a-zäöüß]|$))")
#: Where the weights keep the beginnings.
BEGINS = "beginnings"
#: Where the weights keep the median score of a training boundary without a space; a single such place in a text needs this share of it.
SCALE, GLUED_ALONE, SHORT = "scale", 0.6, 15
#: A beginning has this many characters, stands in this many items at least, and this share of its places are at their start.
BEGIN_CHARS, BEGIN_ITEMS, BEGIN_SHARE = (5, 30), 3, 0.97
#: A task that counts passes its sums on when it has this many.
PARTIAL = 100_000


def beginnings(items: list[str]) -> list[str]:
    """The shortest prefixes of Thai items that hardly stand anywhere within a run of characters."""
    low, high = BEGIN_CHARS
    bodies = [_body(x) for x in items]
    starts = Counter(b[:n] for b in bodies if _THAI.match(b) for n in range(low, min(high, len(b) - 1) + 1))
    kept = {p: c for p, c in starts.items() if c >= BEGIN_ITEMS and p[-1] != " "}
    if not kept:
        return []
    automaton = ahocorasick.Automaton()
    for p in kept:
        automaton.add_word(p, p)
    automaton.make_automaton()
    within = Counter(p for b in bodies for e, p in automaton.iter(b) if e >= len(p) and b[e - len(p)] != " ")
    sure = {p for p in kept if kept[p] >= BEGIN_SHARE * (kept[p] + within[p])}
    return sorted(p for p in sure if not any(p[:n] in sure for n in range(low, len(p))))


def _body(item: str) -> str:
    return " ".join(_NUMBER.sub("0", item).split())


def _counted(items: DataFrame, make: Callable[[], Callable[[str], list[str]]], schema: StructType) -> DataFrame:
    """What a function of an item's normal form gives, and how often; each task adds up before its rows leave it."""
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f, found = make(), Counter()
        for b in batches:
            for item in b.column(0).to_pylist():
                found.update(f(_body(item)))
            if len(found) > PARTIAL:
                yield pa.RecordBatch.from_arrays([pa.array(list(found), arrow.field(0).type), pa.array(list(found.values()), arrow.field(1).type)], schema=arrow)
                found.clear()
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(list(found), arrow.field(0).type), pa.array(list(found.values()), arrow.field(1).type)], schema=arrow)

    return items.mapInArrow(run, schema).groupBy(schema.names[0]).agg(F.sum(schema.names[1]).alias(schema.names[1]))


def counted_beginnings(items: DataFrame) -> list[str]:
    """``beginnings`` of all items, counted on the executors; only what it gives is collected. items: one string column, repeats count once.

    Inner places are looked at only where a beginning's first characters stand, of which there are few.
    """
    low, high = BEGIN_CHARS
    prefix = StructType([StructField("p", StringType()), StructField("n", LongType())])

    def prefixes(i: int, b: str) -> list[str]:
        return [b[i : i + n] for n in range(low, min(high, len(b) - i) + 1) if b[i + n - 1] != " "]

    def starts(b: str) -> list[str]:
        return prefixes(0, b[:-1]) if _THAI.match(b) else []

    once = map_rows(items, lambda: lambda x: [(" ".join(x.split()),)] if x and x.strip() else [], StructType([StructField("item", StringType())])).distinct().persist(StorageLevel.DISK_ONLY)
    kept = _counted(once, lambda: starts, prefix).withColumnRenamed("n", "n_starts").where(F.col("n_starts") >= BEGIN_ITEMS).persist(StorageLevel.DISK_ONLY)
    try:
        heads = once.sparkSession.sparkContext.broadcast(frozenset(r["h"] for r in kept.select(F.substring("p", 1, low).alias("h")).distinct().collect()))

        def make() -> Callable:
            known = heads.value

            return lambda b: [p for i in range(1, len(b) - low + 1) if b[i - 1] != " " and b[i : i + low] in known for p in prefixes(i, b)]

        within = _counted(once, make, prefix).withColumnRenamed("n", "n_within")
        both = kept.join(within, "p", "left").withColumn("n_within", F.coalesce("n_within", F.lit(0)))
        sure = both.where(F.col("n_starts") >= BEGIN_SHARE * (F.col("n_starts") + F.col("n_within"))).select("p")
        longer = sure.where(F.length("p") > low).select(F.col("p").alias("of"), F.explode(F.expr(f"transform(sequence({low}, length(p) - 1), n -> substring(p, 1, n))")).alias("p")).join(sure, "p", "left_semi").select(F.col("of").alias("p"))
        return sorted(r["p"] for r in sure.join(longer, "p", "left_anti").collect())
    finally:
        once.unpersist()
        kept.unpersist()


class Words(dict):
    """Token to what is to be known of it; emptied when it has grown large.

    (normal form, script: 1 Thai, -1 other letters, 0 neither; its last stop: 2 wide, 1 other, 0 none; ends with a colon;
    is an apology; holds a wide stop; offsets at which it may have to be cut)
    """

    def __init__(self, begins: list[str] | tuple[str, ...] = ()):
        super().__init__()
        self.begins = None
        if begins:
            self.begins = ahocorasick.Automaton()
            for p in begins:
                head = p.split(" ")[0]  # a token holds no space
                if len(head) >= BEGIN_CHARS[0]:
                    self.begins.add_word(head, len(head))
            self.begins = self.begins if len(self.begins) else None
            if self.begins:
                self.begins.make_automaton()

    def __missing__(self, token: str) -> tuple[str, int, int, bool, bool, bool, tuple[int, ...]]:
        if len(self) > 100_000:
            self.clear()
        t = unicodedata.normalize("NFC", token.translate(_INVISIBLE))
        form = "เดือน" if t in MONTHS else _NUMBER.sub("0", t)
        script = 1 if _THAI.search(token) else -1 if any(c.isalpha() for c in token) else 0
        i = len(token) - 1
        while i >= 0 and token[i] in CLOSERS:
            i -= 1
        stop = 0 if i < 0 else 2 if token[i] in WIDE_STOPS else 1 if token[i] in STOPS else 0
        cuts = {m.start() for m in _GLUED.finditer(token)} if script < 0 else set()
        if script > 0 and self.begins and len(token) > BEGIN_CHARS[0] and t not in APOLOGY:
            cuts = {e - n + 1 for e, n in self.begins.iter(token)}
        self[token] = out = (form, script, stop, token[-1] in ":：", token in APOLOGY, not WIDE_STOPS.isdisjoint(token), tuple(sorted(c for c in cuts if 1 < c)))
        return out


_BLANK_LINE = re.compile(r"(?:\r\n?|\n)[^\S\r\n]*(?:\r\n?|\n)")


def quoted(text: str) -> list[tuple[int, int]]:
    """Spans between quotation marks, of whatever length; one that is never closed reaches to the next blank line or the end."""
    spans, i, n = [], 0, len(text)
    for m in re.finditer('["“„「『«]', text):
        if m.start() < i:
            continue
        close = text.find(QUOTES[m.group()], m.start() + 1)
        if close < 0:
            blank = _BLANK_LINE.search(text, m.end())
            close = blank.start() if blank else n
        spans.append((m.start(), close))
        i = close + 1
    return spans


class Candidates:
    """The places of one text where a unit could end, and what layout says of each: True, False, or None for the model."""

    __slots__ = ("spans", "forms", "gaps", "fixed")

    def __init__(self, text: str, words: Words, headings: frozenset[str] = frozenset()):
        spans: list[tuple[int, int]] = []
        infos: list[tuple] = []
        coarse = not _THAI.search(text) and not _WIDE.search(text)
        for m in (_COARSE if coarse else _TOKEN).finditer(text):
            token = m.group()
            if coarse and len(parts := token.split()) > 1:
                last = words[parts[-1]]
                start = m.end() - len(parts[-1])
                head = unicodedata.normalize("NFC", " ".join(parts[:-1]).translate(_INVISIBLE))
                script = last[1] or (-1 if any(map(str.isalpha, head)) else 0)
                cut = start + last[6][0] if last[6] else m.end()
                own = words[token[start - m.start() : cut - m.start()]] if last[6] else last
                spans.append((m.start(), cut))
                infos.append((f"{_NUMBER.sub('0', head)} {own[0]}", own[1] or script, *own[2:]))
                for a, b in zip(last[6], (*last[6][1:], len(parts[-1])), strict=False):
                    spans.append((start + a, start + b))
                    infos.append(words[parts[-1][a:b]])
                continue
            info = words[token]
            if info[5]:  # a script without spaces: its stops end tokens
                self._split(text, m.start(), m.end(), words, spans, infos)
            elif info[6]:
                start = m.start()
                for c in (*info[6], len(m.group())):
                    spans.append((start, m.start() + c))
                    infos.append(words[text[start : m.start() + c]])
                    start = m.start() + c
            else:
                spans.append(m.span())
                infos.append(info)
        self.spans, self.forms = spans, [i[0] for i in infos]
        self.fixed: list[bool | None] = []
        self.gaps: list[str] = []
        if len(spans) < 2:
            return
        fixed_, gaps_ = self.fixed.append, self.gaps.append
        quotes = quoted(text)
        section = SECTION.match(text)
        heading_end = section.end() if section else -1
        q, n_quotes, thai, opened = 0, len(quotes), False, spans[0][0]
        in_item, in_citation = LIST_MARK.match(text), bool(CITATION.match(text))
        dotted = bool(in_item) and in_item.group().rstrip().endswith(".")
        for (_, end), (nxt, _), (_, script, stop, colon, apology, wide, _) in zip(spans, spans[1:], infos):
            if script:
                thai = script > 0
            within = False
            if q < n_quotes:
                while q < n_quotes and quotes[q][1] + 1 < end:
                    q += 1
                within = q < n_quotes and quotes[q][0] < end <= quotes[q][1]
            if nxt - end == 1 and text[end] == " ":
                gaps_("S")
                fixed_(False if within or in_item or in_citation or end <= heading_end or apology or colon else True if stop == 2 else None if stop or thai else False)
                continue
            gap = text[end:nxt]
            if "\n" not in gap and "\r" not in gap:
                gaps_("S" if gap else "G")
                if within or in_item or in_citation or end <= heading_end:
                    fixed_(False)
                elif not gap and wide:
                    fixed_(not (q < n_quotes and quotes[q][1] == end - 1))  # a stop inside a quotation ends only that
                else:
                    short = not gap and end - opened < SHORT  # no unit is so short that another follows without a space
                    fixed_(False if apology or colon or short else True if stop == 2 or (stop and not gap and not thai) else None if stop or thai else False)
                continue
            opened = nxt
            lines = len(_LINE.findall(gap))
            begin, start = _line_begin(text, nxt), _line_begin(text, end)
            line = text[start:end].strip()
            mark, cite = LIST_MARK.match(text, begin), CITATION.match(text, begin)
            if mark and lines == 1 and not self._marks(text, mark, end, colon or dotted):
                mark = None
            if (within and lines < 2) or end <= heading_end:
                fixed = False
            elif lines > 1 or mark or cite or HEADING_MARK.match(text, begin) or HEADING_MARK.match(text, start) or line in headings:
                fixed = not (lines == 1 and not cite and not mark and line in APOLOGY)
            elif in_citation:
                fixed = not gap.endswith(("  ", "\t"))
            elif line in APOLOGY:
                fixed = False
            elif colon and len(line) <= HEADING_CHARS:
                fixed = True
            else:
                fixed = True if stop == 2 else None if stop or thai else False
            if fixed is not False:
                in_item, in_citation = bool(mark), bool(cite)
                dotted = bool(mark) and mark.group().rstrip().endswith(".")
            fixed_(fixed)
            gaps_("P" if lines > 1 else "N")

    @staticmethod
    def _marks(text: str, mark: re.Match, end: int, closed: bool | int) -> bool:
        """Whether what looks like a list mark is one, and not a number that a wrapped line begins with."""
        sign = mark.group().strip()
        if sign[-1] == ".":
            return bool(closed)
        before = text[max(0, end - 80) : end]
        return sign[-1] not in ")）" or sign[0] in "(（" or before.rfind("(") <= before.rfind(")")

    @staticmethod
    def _split(text: str, i: int, end: int, words: Words, spans: list[tuple[int, int]], infos: list[tuple]) -> None:
        start = i
        while i < end:
            if text[i] in WIDE_STOPS:
                while i + 1 < end and (text[i + 1] in CLOSERS or text[i + 1] in WIDE_STOPS):
                    i += 1
                spans.append((start, i + 1))
                infos.append(words[text[start : i + 1]])
                start = i + 1
            i += 1
        if start < end:
            spans.append((start, end))
            infos.append(words[text[start:end]])


def _line_begin(text: str, i: int) -> int:
    return max(text.rfind("\n", 0, i), text.rfind("\r", 0, i)) + 1


class Tagger:
    """Scores of the two tags and Viterbi over them."""

    def __init__(self, weights: dict[str, float] | None = None, headings: frozenset[str] = frozenset()):
        self.w, self.headings = weights or {}, headings
        self.words = Words((weights or {}).get(BEGINS, ()))
        self.scale = (weights or {}).get(SCALE, 1.0)
        self.left: dict[str, float] = {}
        self.right: dict[str, float] = {}
        self.pair: dict[tuple[str, str], float] = {}
        self.spaced: dict[str, float] = {}
        self.moves: tuple[list[list[float]], float] | None = None

    @staticmethod
    def left_features(c: str, glued: bool) -> list[str]:
        g = "G" if glued else ""
        return [f"{g}<{c[-n:]}" for n in LEFT if n <= len(c)] + [f"{g}<^"] * (len(c) < LEFT[-1])

    @staticmethod
    def right_features(c: str, glued: bool) -> list[str]:
        g = "G" if glued else ""
        return [f"{g}>{c[:n]}" for n in RIGHT if n <= len(c)]

    @staticmethod
    def pair_features(a: str, b: str, glued: bool) -> list[str]:
        g = "G" if glued else ""
        return [f"{g}|{a[-4:]}|{b[:4]}", f"{g}|{a[-8:]}|{b[:8]}"]

    @staticmethod
    def contexts(forms: list[str], ks: list[int]) -> list[tuple[str, str]]:
        joined, sums = " ".join(forms), list(accumulate(map(len, forms)))
        far_left, far_right = LEFT[-1], RIGHT[-1]
        return [(joined[end - far_left if end > far_left else 0 : end], joined[end + 1 : end + 1 + far_right]) for end in [sums[k] + k for k in ks]]

    def score(self, left: str, right: str, gap: str) -> float:
        w, glued = self.w, gap == "G"
        if glued:  # few, so not kept
            return sum(w.get(x, 0.0) for x in (*self.left_features(left, True), *self.right_features(right, True), *self.pair_features(left[-8:], right[:8], True), "gapG"))
        a = self.left.get(left)
        if a is None:
            if len(self.left) > 100_000:
                self.left.clear()
            # a context is only known if the shorter ones within it are
            a, size = 0.0, len(left)
            for n in LEFT:
                if n > size or (v := w.get("<" + left[-n:])) is None:
                    break
                a += v
            self.left[left] = a = a + (w.get("<^", 0.0) if size < LEFT[-1] else 0.0)
        b = self.right.get(right)
        if b is None:
            if len(self.right) > 100_000:
                self.right.clear()
            b, size = 0.0, len(right)
            for n in RIGHT:
                if n > size or (v := w.get(">" + right[:n])) is None:
                    break
                b += v
            self.right[right] = b
        key = (left[-8:], right[:8])
        c = self.pair.get(key)
        if c is None:
            if len(self.pair) > 100_000:
                self.pair.clear()
            a8, b8 = key  # as pair_features
            self.pair[key] = c = w.get(f"|{a8[-4:]}|{b8[:4]}", 0.0) + w.get(f"|{a8}|{b8}", 0.0)
        return a + b + c + w.get("gap" + gap, 0.0)

    def scores(self, c: Candidates, ks: list[int]) -> dict[int, float]:
        """The score of each of these places; those at a space by both contexts in one look."""
        joined, sums, gaps, known, far = " ".join(c.forms), list(accumulate(map(len, c.forms))), c.gaps, self.spaced, LEFT[-1]
        out, wide = {}, RIGHT[-1] + 1
        for k in ks:
            end = sums[k] + k
            if end < far or gaps[k] != "S":
                out[k] = self.score(joined[max(0, end - far) : end], joined[end + 1 : end + wide], gaps[k])
                continue
            around = joined[end - far : end + wide]
            v = known.get(around)
            if v is None:
                if len(known) > 100_000:
                    known.clear()
                known[around] = v = self.score(around[:far], around[far + 1 :], "S")
            out[k] = v
        return out

    def _moves(self) -> tuple[list[list[float]], float]:
        """The weights of transitions, and what they can turn at most."""
        if self.moves is None:
            t = [[self.w.get(f"tt{a}{b}", 0.0) for b in (0, 1)] for a in (0, 1)]
            self.moves = t, 2 * sum(abs(x) for row in t for x in row)
        return self.moves

    def viterbi(self, scores: list[float], fixed: list[bool | None]) -> list[bool]:
        """Of all taggings the best, where a fixed place has its tag; transitions are 'tt' + both tags."""
        (t0, t1), sway = self._moves()
        tags: list[bool] = []
        before, i, n = 0, 0, len(scores)
        while i < n:
            s, f = scores[i], fixed[i]
            if f is not None or s > sway or s < -sway:
                tags.append(bool(f) if f is not None else s > 0)
                before = int(tags[-1])
                i += 1
                continue
            # a run of places that transitions can turn, between such as they cannot
            first, (a, b) = (t0, t1)[before], (0.0, 0.0)
            back: list[tuple[int, int]] = []
            start = i
            while i < n and fixed[i] is None and -sway <= scores[i] <= sway:
                s = scores[i]
                if i == start:
                    a, b = first[0], first[1] + s
                else:
                    to0, to1 = b + t1[0] > a + t0[0], b + t1[1] > a + t0[1]
                    back.append((int(to0), int(to1)))
                    a, b = (b + t1[0] if to0 else a + t0[0]), (b + t1[1] if to1 else a + t0[1]) + s
                i += 1
            if i < n:
                tag = int(bool(fixed[i]) if fixed[i] is not None else scores[i] > 0)
                a, b = a + t0[tag], b + t1[tag]
            tag = int(b > a)
            own = [bool(tag)]
            for ptr in reversed(back):
                tag = ptr[tag]
                own.append(bool(tag))
            tags.extend(reversed(own))
            before = int(tags[-1])
        return tags

    def boundaries(self, text: str, c: Candidates) -> list[bool]:
        ks = [k for k, f in enumerate(c.fixed) if f is None]
        if not ks:
            return [bool(f) for f in c.fixed]
        score = self.scores(c, ks)
        out = self._decode(c, score)
        # units stand without spaces throughout a text or nowhere in it
        glued = [k for k in ks if c.gaps[k] == "G" and out[k]]
        if glued:
            spaced = sum(1 for k in ks if c.gaps[k] != "G" and out[k])
            if len(glued) <= spaced or (len(glued) == 1 and score[glued[0]] < GLUED_ALONE * self.scale):
                for k in ks:
                    if c.gaps[k] == "G":
                        c.fixed[k] = False
                out = self._decode(c, score)
        return out

    def _decode(self, c: Candidates, score: dict[int, float]) -> list[bool]:
        sway = self._moves()[1]
        if all([s > sway or s < -sway or c.fixed[k] is not None for k, s in score.items()]):  # no transition can turn any
            return [score[k] > 0 if f is None else f for k, f in enumerate(c.fixed)]
        # inside-only places between two open ones say nothing, so the chain runs over open and boundary places
        where = [k for k, f in enumerate(c.fixed) if f is not False]
        out = [False] * len(c.fixed)
        for k, tag in zip(where, self.viterbi([score.get(k, 0.0) if c.fixed[k] is None else 0.0 for k in where], [c.fixed[k] for k in where]), strict=True):
            out[k] = tag
        return out

    def units(self, text: str | None) -> list[tuple[int, int]]:
        """(start, end) of each unit, by code points."""
        if not text:
            return []
        c = Candidates(text, self.words, self.headings)
        if not c.spans:
            return []
        out, start = [], c.spans[0][0]
        for k, tag in enumerate([*self.boundaries(text, c), True]):
            if tag:
                end = c.spans[k][1]
                if text[start].isalnum() or any(map(str.isalnum, text[start:end])):
                    out.append((start, end))
                if k + 1 < len(c.spans):
                    start = c.spans[k + 1][0]
        return out


def train(items: list[str], epochs: int = EPOCHS, seed: int = SEED, begins: list[str] | None = None) -> dict:
    """Averaged structured perceptron over sequences of joined items; the items are one unit each. begins: those of ``items`` where None."""
    rng = random.Random(seed)
    items = sorted({" ".join(x.split()) for x in items if x.strip()})
    if not items:
        return {"gapN": 1.0, "gapP": 1.0, BEGINS: []}
    epochs = min(4 * epochs, max(epochs, 3000 // len(items)))  # more rounds over few items
    w: dict[str, float] = {}
    total: dict[str, float] = {}
    stamp: dict[str, int] = {}
    step = 0
    begins = beginnings(items) if begins is None else begins
    words = Words(begins)

    def add(f: str, d: float) -> None:
        total[f] = total.get(f, 0.0) + (step - stamp.get(f, 0)) * w.get(f, 0.0)
        stamp[f] = step
        w[f] = w.get(f, 0.0) + d

    for _ in range(epochs):
        order = items[:]
        rng.shuffle(order)
        at = 0
        while at < len(order):
            take = rng.randint(2, 7)
            group = order[at : at + take]
            at += take
            text, ends = "", set()
            for g in group:
                parts = g.split(" ")
                body = parts[0]
                for word in parts[1:]:
                    body += ("\n" if rng.random() < 0.04 else " ") + word
                if text:
                    ends.add(len(text))
                    r = rng.random()
                    text += "\n" if r < 0.33 else "" if r < 0.43 else " "
                text += body
            tagger = Tagger(w)
            c = Candidates(text, words)
            ks = [k for k, f in enumerate(c.fixed) if f is None]
            if not ks:
                continue
            gold_all = [c.spans[k][1] in ends for k in range(len(c.fixed))]
            ctx = tagger.contexts(c.forms, ks)
            seq = [(gold_all[k], ctx[i], c.gaps[k]) for i, k in enumerate(ks)]
            guess = tagger.viterbi([tagger.score(a, b, g) for _, (a, b), g in seq], [None] * len(seq))
            step += 1
            before_gold = before_guess = 0
            for (gold, (a, b), g), tag in zip(seq, guess, strict=True):
                if gold != tag:
                    d = 1.0 if gold else -1.0
                    for f in (*Tagger.left_features(a, g == "G"), *Tagger.right_features(b, g == "G"), *Tagger.pair_features(a[-8:], b[:8], g == "G"), "gap" + g):
                        add(f, d)
                tg, tp = f"tt{before_gold}{int(gold)}", f"tt{before_guess}{int(tag)}"
                if tg != tp:
                    add(tg, 1.0)
                    add(tp, -1.0)
                before_gold, before_guess = int(gold), int(tag)
    out = {f: (total.get(f, 0.0) + (step - stamp.get(f, 0)) * v) / max(1, step) for f, v in w.items()}
    out = out | {BEGINS: begins}  # also those of no weight, so that longer contexts are found behind them
    tagger = Tagger(out)
    scores = []
    for a, b in zip(items[:200], items[200:400], strict=False):
        c = Candidates(a + b, tagger.words)
        ks = [k for k, f in enumerate(c.fixed) if f is None and c.gaps[k] == "G" and c.spans[k][1] == len(a)]
        scores += [tagger.score(x, y, "G") for x, y in tagger.contexts(c.forms, ks)]
    return out | {SCALE: max(1.0, sorted(scores)[len(scores) // 2]) if scores else 1.0}


_ITEM = re.compile(r"(?:^|[\r\n])[^\S\r\n]*(?:\(?[0-9๐-๙]{1,3}[)）]|[-•])[^\S\r\n]+([^\r\n]{12,})(?=[\r\n]+[^\S\r\n]*(?:\(?[0-9๐-๙]{1,3}[)）]|[-•])[^\S\r\n]+\S)")


def list_items(text: str | None) -> list[str]:
    """Bodies of list items that another item follows on the next line, so that their own line is whole."""
    return _ITEM.findall(text) if text else []


def all_items(texts: DataFrame) -> DataFrame:
    """item: each list item of the texts, one string column."""
    return map_rows(texts, lambda: lambda t: [(x,) for x in list_items(t)], StructType([StructField("item", StringType())]))


def training_items(texts: DataFrame, sample: int = SAMPLE) -> list[str]:
    """At most ``sample`` items of all scripts, those of the least hashes; texts: one string column."""
    return _least(all_items(texts), sample)


def _least(items: DataFrame, sample: int) -> list[str]:
    return [r["item"] for r in least_hashes(items, ["item"], sample)]


def trained(texts: DataFrame, sample: int = SAMPLE) -> dict:
    """Weights fitted on at most ``sample`` list items of the texts, with the beginnings of all of them."""
    items = all_items(texts).persist(StorageLevel.DISK_ONLY)
    try:
        return train(_least(items, sample), begins=counted_beginnings(items))
    finally:
        items.unpersist()


def heading_lines(texts: DataFrame, share: float = HEADING_SHARE) -> list[str]:
    """First lines without digits that open at least ``share`` of the texts of several lines: at most 1 / share of them."""
    several = texts.toDF("t").where(F.col("t").contains("\n") | F.col("t").contains("\r"))
    begin = F.substring(F.ltrim("t", F.lit(" \t\n\x0b\f\r")), 1, HEADING_CHARS + 2)
    lines = several.select(F.trim(F.substring_index(F.substring_index(begin, "\n", 1), "\r", 1)).alias("line"))
    counts = lines.where(F.length("line").between(1, HEADING_CHARS)).groupBy("line").count()
    rows = counts.where(F.col("count") >= F.greatest(F.lit(3.0), F.lit(share) * lines.agg(F.count("*").alias("n")).scalar())).collect()
    return [r["line"] for r in rows if r["line"] not in APOLOGY and not any(c.isdigit() for c in r["line"])]


UNIT = StructType([StructField("start_pos", IntegerType()), StructField("end_pos", IntegerType())])


def segment(df: DataFrame, key: str, text: str, time: str, weights: dict[str, float], headings: list[str]) -> DataFrame:
    """key and units, array<start_pos, end_pos>, of each record; null and wordless texts have none. The earliest delivery counts."""
    schema = StructType([StructField("k", LongType()), StructField("t", TimestampType()), StructField("units", ArrayType(UNIT))])
    broadcast = df.sparkSession.sparkContext.broadcast((weights, headings))

    def make() -> Callable:
        w, h = broadcast.value
        tagger = Tagger(w, frozenset(h))
        return lambda k, t, x: [(k, t, [{"start_pos": a, "end_pos": b} for a, b in tagger.units(x)])]

    rows = df.select(F.col(key).cast("long").alias("k"), F.col(time).alias("t"), F.col(text).alias("x"))
    return earliest_result(map_rows(rows, make, schema, 512), ["k"], "t", "units").withColumnRenamed("k", key)


def sentence_units(legal_sections: DataFrame, niti_results: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """rec_table, rec_id, start_pos, end_pos: one row for each unit of raw_text and predicted_answer."""
    texts = legal_sections.select(F.col("raw_text").alias("t")).unionByName(niti_results.select(F.col("predicted_answer").alias("t")))
    weights, headings = trained(texts, sample), heading_lines(texts)
    a = segment(legal_sections, "section_id", "raw_text", "loaded_at", weights, headings).select(F.lit("legal_sections").alias("rec_table"), F.col("section_id").alias("rec_id"), "units")
    b = segment(niti_results, "result_id", "predicted_answer", "run_at", weights, headings).select(F.lit("niti_results").alias("rec_table"), F.col("result_id").alias("rec_id"), "units")
    return a.unionByName(b).select("rec_table", "rec_id", F.explode("units").alias("u")).select("rec_table", "rec_id", *(F.col(f"u.{c}").cast("long").alias(c) for c in UNIT.names))
