"""Evaluation texts leaking into training text (problem 8).

Pigeonhole edit matching. A stretch counts if at most the share ``errors`` of its characters is edited. Each test item's
normal form (letters, digits and marks only) is cut into pieces so short that every stretch of the share ``stretch`` of it
holds more whole pieces than it may hold edits: of m pieces and e edits at least m - e stand unhurt in the document, on
diagonals that differ by e at most. The pieces of all items are looked up in all documents by their hashes, an array at a
time; a document that has m - e of those of a stretch, however many items share them, in a band of such diagonals is a candidate.
Between the runs of characters that the two share there in order, the edits are counted, of the widest gaps first, as long as the least that
the other gaps can have leaves a stretch; the longest stretch within the share of edits is taken, and Myers' bit-parallel distance verifies it.

Documents are only scanned, never shuffled; the items stand in blocks of at most ``block_chars`` characters, one scan of the
documents each.
"""

from __future__ import annotations

import math
import unicodedata
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, IntegerType, LongType, StructField, StructType

from lexweave.llm.windows import SUB_BATCH, Windows

STRETCH, MAX_ERRORS = 0.4, 0.12
#: Longest piece; characters of a gram, which begins a shared run; places of pieces that are held at once.
PIECE, GRAM, HITS = 4, 4, 1 << 20
#: Cells of pieces that are kept for texts of several lengths.
KEPT = 1 << 21
BLOCK_CHARS = 32_000_000

FOUND = StructType([StructField("doc_id", LongType()), StructField("item_id", LongType()), StructField("share", DoubleType()), StructField("distance", IntegerType())])


class _Normal(dict):
    """Code point to its normal form, made as it is first met."""

    def __missing__(self, code: int) -> str | None:
        c = chr(code)
        kind = unicodedata.category(c)
        if kind == "Nd":
            out = str(unicodedata.digit(c))
        elif kind[0] in "LM" or kind == "Nl":
            out = None if c in "ๆฯ" else c.lower()
        else:
            out = None
        self[code] = out
        return out


_NORMAL = _Normal()
#: The same by array, as far as met: 0 for no character, SEVERAL for more than one.
UNMET, SEVERAL = 0xFFFFFFFF, 0xFFFFFFFE
_CODES = np.full(0x110000, UNMET, np.uint32)


def normal(text: str) -> str:
    """Letters, marks and digits only: in lower case, digits Arabic, NFC."""
    text = unicodedata.normalize("NFC", text)
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    out = _CODES[codes]
    most = out.max(initial=0)
    if most == UNMET:
        for code in set(codes[out == UNMET].tolist()):
            c = _NORMAL[code]
            _CODES[code] = 0 if not c else ord(c) if len(c) == 1 else SEVERAL
        out = _CODES[codes]
        most = out.max(initial=0)
    if most == SEVERAL:
        return text.translate(_NORMAL)
    return out[out != 0].tobytes().decode("utf-32-le", "surrogatepass")


def myers(pattern: str, text: str) -> int:
    """Edit distance of the two strings, by bit-parallel columns of any width."""
    m = len(pattern)
    if not m:
        return len(text)
    masks: dict[str, int] = {}
    for i, c in enumerate(pattern):
        masks[c] = masks.get(c, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score = full, 0, m
    for c in text:
        eq = masks.get(c, 0)
        zero = (((eq & plus) + plus) ^ plus) | eq | minus
        h_plus = minus | (full & ~(zero | plus))
        h_minus = plus & zero
        if h_plus & top:
            score += 1
        elif h_minus & top:
            score -= 1
        h_plus = (h_plus << 1 | 1) & full
        h_minus = h_minus << 1 & full
        plus = h_minus | (full & ~(zero | h_plus))
        minus = h_plus & zero
    return score


def cutting(length: int, errors: float) -> tuple[int, int, int]:
    """(piece length, step, pieces that stay unhurt) for stretches of a length; where no cut leaves any, every character begins a piece."""
    edits = int(errors * length)
    for piece in range(PIECE, 0, -1):
        if length // piece - 1 - edits >= 1:
            return piece, piece, length // piece - 1 - edits
    return max(1, length // (edits + 1)), 1, 1


def _distinct(numbers: np.ndarray) -> np.ndarray:
    """Each number once, in order; of a few numbers this takes far less time than ``unique``."""
    out = np.sort(numbers)
    return out[np.append(True, out[1:] != out[:-1])]


def _rising(numbers: np.ndarray) -> list[int]:
    """The places of a longest rising sequence among numbers."""
    offsets, j = numbers.tolist(), 0
    tails: list[int] = []
    ends: list[int] = []
    before: list[int] = []
    for end in [*(np.flatnonzero(numbers[1:] <= numbers[:-1]) + 1).tolist(), len(offsets)]:
        while j < end:  # up to there the numbers rise
            o = offsets[j]
            if not tails or o > tails[-1]:  # then all the rest of them go behind
                before.append(ends[-1] if ends else -1)
                if end - j == 1:
                    tails.append(o)
                    ends.append(j)
                else:
                    before += range(j, end - 1)
                    tails += offsets[j:end]
                    ends += range(j, end)
                break
            i = bisect_left(tails, o)
            before.append(ends[i - 1] if i else -1)
            tails[i], ends[i] = o, j
            j += 1
        j = end
    chain, j = [], ends[-1] if ends else -1
    while j >= 0:
        chain.append(j)
        j = before[j]
    chain.reverse()
    return chain


class _Numbers:
    """The places of hashes among sorted ones: looked up by their first bits, as most stand alone there."""

    def __init__(self, keys: np.ndarray):
        self.keys, bits = np.append(keys, np.uint64(0)), min(22, max(8, 4 + len(keys).bit_length()))
        self.shift = np.uint64(64 - bits)
        count = np.bincount((keys >> self.shift).astype(np.int64), minlength=1 << bits)
        self.first, self.count, self.most = (np.cumsum(count) - count).astype(np.int32), count.astype(np.int32), int(count.max(initial=0))

    def find(self, h: np.ndarray) -> np.ndarray:
        """Of each hash its place, or -1."""
        out = np.full(len(h), -1)
        slot = (h >> self.shift).astype(np.int64)
        i = np.flatnonzero(self.count[slot])
        slot = slot[i]
        for j in range(self.most):
            at = self.first[slot] + j
            same = self.keys[at] == h[i]
            out[i[same]] = at[same]
            rest = ~same & (self.count[slot] > j + 1)
            i, slot = i[rest], slot[rest]
            if not len(i):
                break
        return out


class _Table:
    """The pieces of one length: of each the items and places where it stands; and of each item how many of a stretch must stand in a text."""

    def __init__(self, size: int, rows: list[tuple[int, int, int, int, np.ndarray, np.ndarray]]):
        """rows: item, characters of the pieces of a stretch, how many of them stay unhurt, how far apart their diagonals are, hashes and offsets of its pieces."""
        self.size, self.items = size, [r[0] for r in rows]
        self.span, self.sound, self.near = (np.asarray([r[i] for r in rows], np.int64) for i in (1, 2, 3))
        keys, piece = np.unique(np.concatenate([r[4] for r in rows]), return_inverse=True)
        self.numbers, order = _Numbers(keys), np.argsort(piece, kind="stable")
        self.item = np.repeat(np.arange(len(rows)), [len(r[4]) for r in rows])[order]
        self.offset = np.concatenate([r[5] for r in rows])[order]
        self.times = np.bincount(piece, minlength=len(keys))
        self.first, self.most = np.cumsum(self.times) - self.times, int(self.offset.max(initial=0))
        # so far diagonals are shifted that they count from 0; half bands of them begin where bands do
        self.zero = -(-self.most // (2 * self.near)) * 2 * self.near + (1 << 30) % (2 * self.near)
        self.inverse = (1 / self.near)[self.item]
        self.kept: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}

    def pieces(self, w: Windows, grams: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """text, number of the piece and place of each piece that stands in a text, in order. grams: starts, texts and numbers of the texts' grams."""
        starts, whose, own = grams
        if self.size == GRAM:
            at = self.of_gram[own]
        else:
            starts, whose = w.every(self.size)
            at = self.numbers.find(w.hashes(starts, starts + self.size))
        i = np.flatnonzero(at >= 0)
        return whose[i], at[i], starts[i] - w.offsets[whose[i]]

    def _cells(self, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For texts of up to a length: of each piece of an item its cell, an item's half band, at place 0; each item's first cell; of each cell its item and half of how many must stand there and beside it."""
        step = 1 << max(9, length.bit_length() - 3)
        length = -(-length // step) * step
        if length not in self.kept:
            width = (length + self.zero) // self.near + 2
            owner, first = np.repeat(np.arange(len(self.items)), width), np.cumsum(width) - width
            if len(self.kept) >= min(32, max(8, KEPT // len(self.item))) or length > 1 << 14:
                self.kept.clear()
            self.kept[length] = (self.zero[self.item] - self.offset + 0.5) * self.inverse + first[self.item], first, owner, (-(-self.sound // 2))[owner]
        return self.kept[length]

    def likely(self, piece: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of a text with these pieces those hits (item, half band, place in the item) in whose half band and one beside it there are enough for a stretch."""
        base, first, owner, half = self._cells(int(place[-1]) + 1)
        times = self.times[piece]
        parts = np.cumsum(times) // HITS
        cuts = [0, *(np.flatnonzero(parts[1:] != parts[:-1]) + 1).tolist(), len(piece)]

        def hits(a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
            n = times[a:b]
            slot = np.repeat(self.first[piece[a:b]] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            cell = self.inverse[slot]
            cell *= np.repeat(place[a:b].astype(np.float64), n)
            cell += base[slot]
            return slot, cell.astype(np.int64)

        counts = 0
        for a, b in zip(cuts, cuts[1:]):
            slot, cell = hits(a, b)
            counts = counts + np.bincount(cell, minlength=len(owner))
        many = np.flatnonzero(counts >= half)
        before, behind = counts[np.maximum(many - 1, 0)], counts[np.minimum(many + 1, len(counts) - 1)]
        least, enough = self.sound[owner[many]] - counts[many], np.zeros(len(counts) + 2, bool)
        enough[many[before >= least]] = enough[many[before >= least] + 1] = True
        enough[many[behind >= least] + 1] = enough[many[behind >= least] + 2] = True
        out = []
        for a, b in zip(cuts, cuts[1:]):
            slot, cell = (slot, cell) if len(cuts) == 2 else hits(a, b)
            i = np.flatnonzero(enough[1:][cell])
            own = slot[i]
            item = self.item[own]
            out.append((item, cell[i] - first[item], self.offset[own]))
        return out[0] if len(out) == 1 else tuple(np.concatenate(x) for x in zip(*out))

    def diagonals(self, piece: np.ndarray, place: np.ndarray) -> list[tuple[int, int]]:
        """item, diagonal around which enough pieces of one stretch of it stand in a text, as near as edits allow; in order."""
        item, half, offset = self.likely(piece, place)
        if not len(item):
            return []
        found: set[tuple[int, int]] = set()
        length, wide = self.most + int(self.span.max()) + 1, int(half.max()) + 2
        for shift in (0, 1):  # a band of half the width falls within one of the two cuts
            key = _distinct((item * wide + (half + shift >> 1)) * length + offset)  # a piece counts once
            own = key // (length * wide)
            good = np.searchsorted(key, key + self.span[own]) - np.arange(len(key)) >= self.sound[own]
            if not good.any():
                continue
            band = _distinct(key[good] // length)
            own = band // wide
            found.update(zip(own.tolist(), ((2 * (band % wide) + 1 - shift) * self.near[own] - self.zero[own]).tolist()))
        return [(self.items[k], d) for k, d in sorted(found)]


class Matcher:
    """All items of one block against texts."""

    def __init__(self, items: list[tuple[int, str]], stretch: float = STRETCH, errors: float = MAX_ERRORS):
        self.stretch, self.errors = stretch, errors
        self.items = [(item, n) for item, text in items if (n := normal(text or ""))]
        self.grams: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}
        self.drift = np.asarray([int(errors * len(n)) + 1 for _, n in self.items], np.int64)
        # the pieces that show an item stand in one stretch, on diagonals that differ by its edits at most
        self.near = np.asarray([int(errors * math.ceil(stretch * len(n))) + 1 for _, n in self.items], np.int64)
        rows: dict[int, list[tuple[int, int, int, int, np.ndarray, np.ndarray]]] = defaultdict(list)
        for k, (_, n) in enumerate(self.items):
            length = max(1, math.ceil(stretch * len(n)))
            size, step, sound = cutting(length, errors)
            at = np.arange(0, len(n) - size + 1, step)
            m = max(1, min(len(at), length // step - 1))
            rows[size].append((k, m * step, sound, int(self.near[k]), Windows([n]).hashes(at, at + size), at))
        self.tables = [_Table(size, x) for size, x in rows.items()]
        w = Windows([n for _, n in self.items])
        starts, whose = w.every(GRAM)
        keys, self.gram_ids = np.unique(w.hashes(starts, starts + GRAM), return_inverse=True)
        self.gram_numbers = _Numbers(keys)
        for table in self.tables:  # the number of the piece that each gram is; -1, as the last one, for none
            table.of_gram = np.append(table.numbers.find(keys), -1) if table.size == GRAM else np.zeros(0, np.int64)
        self.spot = np.full(len(keys) + 1, -1)  # of the grams of the item in hand the place among them; -1 for the others and, as the last one, for none
        self.gram_first = np.concatenate([[0], np.cumsum(np.bincount(whose, minlength=len(self.items)))]).astype(np.int64)

    def _grams(self, w: Windows) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, text and number of each gram of the texts, in order; -1 where no item has it."""
        starts, whose = w.every(GRAM)
        return starts, whose, self.gram_numbers.find(w.hashes(starts, starts + GRAM))

    def _least(self, n: int) -> int:
        """How many grams a stretch must share with the text in order: an edit hurts GRAM of them."""
        length = math.ceil(self.stretch * n)
        return length - GRAM + 1 - GRAM * int(self.errors * length)

    def _shared(self, k: int, diagonal: int, own: np.ndarray) -> list[tuple[int, int]]:
        """The longest chain of places (in the text, in the item) of grams that both share in order around a diagonal; none if it is too short for any stretch."""
        n = len(self.items[k][1])
        least, reach = max(1, self._least(n)), 2 * int(self.drift[k])
        low = max(0, diagonal - reach)
        there = own[low : max(0, diagonal + reach + n)]
        order, ids, first, times = self._sorted_grams(k)
        if not len(ids):
            return []
        self.spot[ids] = np.arange(len(ids))
        number = self.spot[there]
        self.spot[ids] = -1
        at = np.flatnonzero(number >= 0)
        number = number[at]
        count = times[number]
        offset = order[np.repeat(first[number] - (np.cumsum(count) - count), count) + np.arange(count.sum())]
        at = np.repeat(at, count)
        near = np.abs(at + low - offset - diagonal) <= reach
        at, offset = at[near] + low, offset[near]
        held = np.zeros(n, bool)
        held[offset] = True
        own = np.flatnonzero(held)
        if len(own) < least or not self._within(n, own):
            return []
        chain = _rising(offset)  # of one place the greater offsets come first
        if len(chain) < least or not self._dense(n, offset[chain]):
            return []
        return list(zip(at[chain].tolist(), offset[chain].tolist()))

    def _dense(self, n: int, offsets: np.ndarray) -> bool:
        """Whether grams at these offsets of an item, in order, could be those of a stretch: of its length less GRAM for each edit, so many."""
        if self._least(n) < 1:
            return True
        share = 1 - GRAM * self.errors
        more = np.arange(len(offsets)) - share * offsets
        far = np.searchsorted(offsets, offsets - (math.ceil(self.stretch * n) - GRAM), "right")
        return bool((more - np.concatenate([[np.inf], np.minimum.accumulate(more)])[far] >= (share - 2) * GRAM).any())

    def _fits(self, n: int, start: np.ndarray, end: np.ndarray, edits: np.ndarray) -> bool:
        """Whether runs in order could make up a stretch: where they start and end in an item of n characters, and how many edits at least stand before each."""
        sums, far = edits.cumsum(), start.searchsorted(end - math.ceil(self.stretch * n - 1e-9), "right")
        long = far.nonzero()[0]
        most = np.maximum.accumulate(sums - self.errors * start)[far[long] - 1]
        return bool((sums[long] - self.errors * end[long] <= most + 1e-6).any())

    def _within(self, n: int, offsets: np.ndarray) -> bool:
        """Whether there are few enough edits between grams at these offsets of an item: an edit hurts GRAM grams beside each other at most."""
        if self._least(n) < 1:
            return True
        more = offsets[1:] - offsets[:-1]
        new = np.flatnonzero(more > 1)
        end = np.append(offsets[new], offsets[-1]) + GRAM
        start = np.append(offsets[0], offsets[new + 1])
        return self._fits(n, start, end, np.append(0, (more[new] + GRAM - 2) // GRAM))

    def _sorted_grams(self, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The offsets of an item's grams by their numbers, greater ones first; these numbers, and of each the first and how many there are."""
        if k not in self.grams:
            if len(self.grams) > 5000:
                self.grams.clear()
            own = self.gram_ids[self.gram_first[k] : self.gram_first[k + 1]]
            order = len(own) - 1 - np.argsort(own[::-1], kind="stable")
            ids, first, times = np.unique(own[order], return_index=True, return_counts=True)
            self.grams[k] = order, ids, first, times
        return self.grams[k]

    def find(self, texts: list[str | None]) -> list[list[tuple[int, float, int]]]:
        """Of each text (item, share of the item in one connected stretch, its edit distance) of each item that it contains."""
        out: list[list[tuple[int, float, int]]] = [[] for _ in texts]
        normals = [normal(t) if t else "" for t in texts]
        w = Windows(normals)
        known = self._grams(w)
        first = np.searchsorted(known[1], np.arange(len(texts) + 1))
        for table in self.tables:
            text, piece, place = table.pieces(w, known)
            ends = np.searchsorted(text, np.arange(len(texts) + 1)).tolist()
            for t, (a, b) in enumerate(zip(ends, ends[1:])):
                grams, before = known[2][first[t] : first[t + 1]], None
                for k, d in table.diagonals(piece[a:b], place[a:b]) if b > a else ():
                    if before and before[0] == k and d - before[1] <= self.drift[k] - self.near[k]:  # what is nearer lies within the other's reach
                        continue
                    before = k, d
                    if best := self._stretch(k, normals[t], d, grams):
                        out[t].append((self.items[k][0], *best))
        return [_longest(x) for x in out]

    def _stretch(self, k: int, x: str, diagonal: int, grams: np.ndarray) -> tuple[float, int] | None:
        """The longest stretch of an item that stands around a diagonal of a text, if it is long enough: share, distance."""
        n = self.items[k][1]
        size, chain = GRAM, self._shared(k, diagonal, grams)
        if not chain and self._least(len(n)) < 1:  # too short for grams: places of equal characters will do
            size, chain = 1, [(i + d, i) for d in (diagonal,) for i in range(len(n)) if 0 <= i + d < len(x) and n[i] == x[i + d]]
        if not chain:
            return None
        # runs: place and end in the item and in the text, and the edits before each, at first how many they are at least
        runs: list[list[int]] = []
        rim = 2 * int(self.drift[k]) if size == GRAM and self._least(len(n)) > 0 else -1
        places, offsets = (np.asarray(c) for c in zip(*chain))
        new = np.flatnonzero((places[1:] - offsets[1:] != places[:-1] - offsets[:-1]) | (offsets[1:] > offsets[:-1] + size)) + 1
        for i, j in zip([0, *new.tolist()], [*new.tolist(), len(chain)]):
            at, o = chain[i]
            last = chain[j - 1][1] + size
            if not runs:
                runs.append([o, last, at, last + at - o, 0])
                continue
            _, end, _, end_at, _ = runs[-1]
            if at - o == end_at - end and o <= end:
                runs[-1][1], runs[-1][3] = last, last + at - o
                continue
            cut = max(end - o, end_at - at, 0)  # runs on two diagonals may not share characters
            while cut >= size and (i := i + 1) < j:
                at, o = chain[i]
                cut = max(end - o, end_at - at, 0)
            if i == j:
                continue
            own, other = o + cut - end, at + cut - end_at
            least, wide = abs(own - other), max(own, other)
            # neither the first nor the last characters of a gap agree and no gram stands within it, or the chain had it; only at the rim of its reach it may be cut short
            if min(own, other) and abs(at - o - diagonal) + wide <= rim:
                least = max(least, -(-(wide + GRAM - 1) // GRAM))
            runs.append([o + cut, last, at + cut, last + at - o, least])
        start, end, _, _, edits = (np.asarray(r) for r in zip(*runs))
        widest, j = np.argsort(-edits, kind="stable").tolist(), 0
        while self._fits(len(n), start, end, edits):
            if j == len(runs):
                break
            for i in widest[j : 2 * j + 2]:  # the widest gaps first: mostly a few of them show that it is none
                if i:
                    edits[i] = runs[i][4] = myers(n[runs[i - 1][1] : runs[i][0]], x[runs[i - 1][3] : runs[i][2]])
            j = min(2 * j + 2, len(runs))
        else:
            return None
        best = None
        for i, (a, _, c, _, _) in enumerate(runs):
            edits = 0
            for j in range(i, len(runs)):
                if j > i:
                    edits += runs[j][4]
                length = runs[j][1] - a
                if edits <= self.errors * length and (best is None or length > best[1] - best[0]):
                    best = (a, runs[j][1], c, runs[j][3])
        a, b, c, d = best
        if b - a < self.stretch * len(n):
            return None
        distance = myers(n[a:b], x[c:d])
        return ((b - a) / len(n), distance) if distance <= self.errors * (b - a) else None


def _longest(found: list[tuple[int, float, int]]) -> list[tuple[int, float, int]]:
    best: dict[int, tuple[int, float, int]] = {}
    for f in found:
        if f[0] not in best or (f[1], -f[2]) > (best[f[0]][1], -best[f[0]][2]):
            best[f[0]] = f
    return list(best.values())


def leaks(documents: DataFrame, items: DataFrame, block_chars: int = BLOCK_CHARS, **options) -> DataFrame:
    """doc_id, item_id, share, distance: each document with each item of which it holds one connected stretch of ``stretch``.

    Null and blank texts on either side match nothing. Repeated document rows give repeated results; a repeated
    item id counts once, by its longest text. An item of few characters gets shorter pieces, so none is skipped.
    """
    size = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-size // block_chars))
    docs, found = documents.select("doc_id", "text"), None
    for b in range(blocks):
        own: dict[int, str] = {}
        for item, text in items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).select("item_id", "text").toLocalIterator():
            if item is not None and len(text or "") >= len(own.get(item, "")):
                own[item] = text or ""
        part = docs.mapInArrow(_finder(documents.sparkSession.sparkContext.broadcast(list(own.items())), options), FOUND)
        found = part if found is None else found.unionByName(part)
    return found


def _finder(items, options: dict) -> Callable:
    schema = to_arrow_schema(FOUND)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, docs, texts, size = Matcher(items.value, **options), [], [], 0

        def out() -> pa.RecordBatch:
            rows = [(doc, *hit) for doc, hits in zip(docs, m.find(texts), strict=True) for hit in hits]
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)

        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                docs.append(doc)
                texts.append(text)
                size += len(text or "")
                if size >= SUB_BATCH:
                    yield out()
                    docs, texts, size = [], [], 0
        yield out()

    return run


def leak_report(found: DataFrame, documents: DataFrame, items: DataFrame) -> DataFrame:
    """Per test item that leaked: the documents and sources that hold it, and the largest share."""
    sources = documents.select("doc_id", "source")
    kinds = items.groupBy("item_id").agg(F.min("kind").alias("kind"))
    return found.join(sources, "doc_id").groupBy("item_id").agg(F.countDistinct("doc_id").alias("n_documents"), F.countDistinct("source").alias("n_sources"), F.max("share").alias("largest_share")).join(kinds, "item_id")
