"""Text cut off by field limits or in transfer (problem 6).

A backward character n-gram model over ends. Wherever a run of text ends inside a value, at white space or at a mark of
a script without spaces, and where a value itself ends, the last characters before it are counted at several lengths:
how often the text stops there for good (end of the value, a blank line, a list mark or a heading or citation line next)
and how often it goes on. Of the last RUN characters it is also counted how often they end a run and how often they occur.
For each value two chances follow, interpolated from the shortest context to the longest and without the value's own
count: that its last characters end a run (else it was cut within a word or number), and that a run ending so ends the
text (else within a sentence). Both are compared, as log-odds, with the mean of the value's column and language.

All values are counted; contexts are summed in each task before they are shuffled, as hashes, and joined to the values'
own last contexts by hash. Nothing is collected.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType, TimestampType

from lexweave.llm.windows import SUB_BATCH, Windows, mixed, tally

ORDERS = (8, 14, 22, 32)
RUN = 5
#: Weight of the shorter context; thresholds of the two log-odds against the mean of column and language.
BACKOFF, RUN_BACKOFF = 12.0, 2.0
SENTENCE_ODDS, DOTTED_ODDS, WORD_CHANCE = -1.0, -3.0, 0.03
TAIL_CHARS, LANGUAGE_CHARS = 320, 120

#: Marks left out at an end; what stands in the place of a lost rest; what begins after a hard break.
MARKS = r".,!?;:\"”」』'()\[\]…*»。，、；：？！）】\-"
LOST = re.compile(r"(?:…|\.\.\.+|�|\[\.\.\.\]|\[…\])[\s\"”'」)]*$|[0-9๐-๙],\s*$|[(（「『][^)）」』\n]*$")
AFTER_BREAK = r"[ ]*(?:\(?0[)）]|[-•] |#|\*\*|มาตราที่เกี่ยวข้อง|Sections)"

_INVISIBLE = dict.fromkeys([0x200B, 0x200C, 0x200D, 0xFEFF])
_NUMBER, _BLANK = re.compile(r"[0-9๐-๙]+"), re.compile(r"[^\S\n]{2,}|[^\S\n ]")
_END = re.compile(rf"[{MARKS}]*(?:(\s*\n\s*\n\s*|\s*\n(?={AFTER_BREAK}))|(\s*\n\s*)|\s)|[。，、；：？！]+[”」』）)]*")
_STRIP = re.compile(rf"[\s{MARKS}�]+$")
_FULL_STOP = re.compile(r"[!?。！？][\"”'」』)）]*$")
_DOT = re.compile(r"[A-Za-zÄÖÜäöüß0-9)]\.[\"”')]*$")
_THAI, _CJK, _ODD = re.compile(r"[ก-๛]"), re.compile(r"[぀-ヿ一-鿿]"), re.compile("[\u200b-\u200d\ufeff]")
_KANA, _GERMAN = re.compile("[぀-ヿ]"), re.compile(r"[äöüßÄÖÜ]|\b(?:der|die|das|und|ist|nicht|von|dem|den|mit|auf|im|bei|nach|wird)\b", re.I)


def normal(text: str) -> str:
    t = text.translate(_INVISIBLE) if _ODD.search(text) else text
    t = t.replace("\r\n", "\n").replace("\r", "\n") if "\r" in t else t
    t = t if unicodedata.is_normalized("NFC", t) else unicodedata.normalize("NFC", t)
    return _BLANK.sub(" ", _NUMBER.sub("0", t))


def language(tail: str) -> int:
    """Of a value's last characters: 1 Thai, 2 Chinese, 3 Japanese, 4 German, 5 other Latin text."""
    if _THAI.search(tail):
        return 1
    if _CJK.search(tail):
        return 3 if _KANA.search(tail) else 2
    return 4 if _GERMAN.search(tail) else 5


def body(t: str) -> str:
    """The normal form without white space and marks at its end."""
    return _STRIP.sub("", t)


@lru_cache(None)
def _column(name: str) -> int:
    """Columns are few; each has a number of its own name."""
    return xxhash.xxh3_64_intdigest(name) >> 4


def group(column: str, flat: str) -> int:
    """Number of the column and language that a value belongs to."""
    return _column(column) << 3 | language(flat[-LANGUAGE_CHARS:])


class Tail:
    """Of one value the last characters and what its very end shows."""

    __slots__ = ("mark", "dotted", "flat", "group")

    def __init__(self, column: str, text: str | None):
        text = text or ""
        last = normal(text[-TAIL_CHARS:])
        b = body(last)
        if len(b) < LANGUAGE_CHARS + ORDERS[-1] and len(text) > TAIL_CHARS:
            last = normal(text)
            b = body(last)
        self.flat = b.replace("\n", " ")
        #: 0: the model decides, 1: something stands for the rest, half a character or number is left or a bracket is open, 2: whole, or no text at all
        self.mark = 2 if not any(c.isalnum() for c in b) else 1 if LOST.search(text) else 2 if _FULL_STOP.search(last.rstrip()) else 0
        self.group = group(column, self.flat)
        self.dotted = int(self.group & 7 >= 4 and bool(_DOT.search(last.rstrip())))


_COUNTS = pa.schema([("h", pa.int64()), ("a", pa.int64()), ("b", pa.int64())])
#: Kinds of contexts, mixed into their hashes: the group's total, a run, an end by its order's place, the same before a dot.
TOTAL, RUN_KIND, END_KIND, DOTTED_KIND = 1, 2, 10, 20


def count_contexts(columns: list[str], texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the values' inner contexts, with [ends, goes on]; of runs with [ends a run, occurs]."""
    flats, groups, ends, kinds, owner = [], [], [], [], []
    for column, text in zip(columns, texts, strict=True):
        b = body(normal(text))
        if not b:
            continue
        flat = b.replace("\n", " ")
        g = group(column, flat)
        latin, own = g & 7 >= 4, len(flats)
        for m in _END.finditer(b):
            e = m.start()
            if e:
                last = m.lastindex  # 1: a hard break, 2: a single line break, which may be a wrap
                ends.append(e)
                owner.append(own)
                kinds.append((0 if last == 1 else 2 if last == 2 else 1) + (4 if latin and b[e] == "." else 0))
        flats.append(flat)
        groups.append(g)
    if not flats:
        none = np.empty(0, np.int64)
        return none, none, none
    w = Windows(flats)
    gs = np.asarray(groups, np.uint64)
    at = w.offsets[owner] + np.asarray(ends, np.int64) if ends else np.empty(0, np.int64)
    first, kind, g_end = w.offsets[owner] if ends else at, np.asarray(kinds, np.int64), gs[owner] if ends else np.empty(0, np.uint64)
    parts = []
    run = w.hashes(np.maximum(first, at - RUN), at)
    parts.append((mixed(run, g_end, RUN_KIND), np.ones(len(at), np.int64), np.zeros(len(at), np.int64)))
    firm = kind & 3 != 2
    for i, k in enumerate(ORDERS):
        f, a, kd = first[firm], at[firm], kind[firm]
        h = mixed(w.hashes(np.maximum(f, a - k), a), g_end[firm], np.where(kd & 4, DOTTED_KIND + i, END_KIND + i).astype(np.uint64))
        stays = (kd & 3 == 0).astype(np.int64)
        parts.append((h, stays, 1 - stays))
    starts, whose = w.every(RUN)
    parts.append((mixed(w.hashes(starts, starts + RUN), gs[whose], RUN_KIND), np.zeros(len(starts), np.int64), np.ones(len(starts), np.int64)))
    parts.append((mixed(np.zeros(len(at), np.uint64), g_end, TOTAL), np.zeros(len(at), np.int64), np.ones(len(at), np.int64)))
    return tally(parts)


def _counter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    columns: list[str] = []
    texts: list[str] = []
    size = 0

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in count_contexts(columns, texts)], schema=_COUNTS)

    for batch in batches:
        for column, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if text:
                columns.append(column)
                texts.append(text)
                size += len(text)
                if size >= SUB_BATCH:
                    yield out()
                    columns, texts, size = [], [], 0
    yield out()


_HASHES = ["g", *(f"e{k}" for k in ORDERS), "r"]
_KIND = ["dotted", *_HASHES]
_TAIL = StructType(
    [StructField("rec_table", StringType()), StructField("rec_id", StringType()), StructField("t", TimestampType()), StructField("mark", IntegerType()), StructField("dotted", IntegerType())]
    + [StructField(c, LongType()) for c in _HASHES]
)


def _tails(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = to_arrow_schema(_TAIL)
    for b in batches:
        own = [Tail(t, x) for t, x in zip(b.column(0).to_pylist(), b.column(3).to_pylist(), strict=True)]
        if not own:
            continue
        w = Windows([v.flat for v in own])
        first, at = w.offsets[:-1], w.offsets[1:] - 1
        g, dotted = np.asarray([v.group for v in own], np.uint64), np.asarray([v.dotted for v in own], np.uint64)
        hashes = [mixed(np.zeros(len(own), np.uint64), g, TOTAL)]
        hashes += [mixed(w.hashes(np.maximum(first, at - k), at), g, END_KIND + i + (DOTTED_KIND - END_KIND) * dotted) for i, k in enumerate(ORDERS)]
        hashes.append(mixed(w.hashes(np.maximum(first, at - RUN), at), g, RUN_KIND))
        columns = [b.column(0), b.column(1), b.column(2), pa.array([v.mark for v in own], pa.int32()), pa.array([v.dotted for v in own], pa.int32()), *(pa.array(h.view(np.int64)) for h in hashes)]
        yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def tails(values: DataFrame) -> DataFrame:
    """values: rec_table, rec_id, t, text. One row per record, of its earliest delivery."""
    rows = values.mapInArrow(_tails, _TAIL)
    first = F.min(F.struct(F.coalesce("t", F.lit("9999-12-31").cast("timestamp")).alias("t"), "mark", *_KIND)).alias("f")
    return rows.groupBy("rec_table", "rec_id").agg(first).select("rec_table", "rec_id", "f.*")


def _interpolate(pairs: list[tuple[Column, Column]], start: Column, weight: float) -> Column:
    p = start
    for hit, total in pairs:
        p = (F.greatest(hit - 1, F.lit(0)) + weight * p) / (F.greatest(total - 1, F.lit(0)) + weight)
    return p


def judged(values: DataFrame) -> DataFrame:
    """Each record's mark, chances and whether it is cut: rec_table, rec_id, mark, word_chance, end_chance, base, cut.

    values: rec_table, rec_id, t (time of delivery), text. Null and wordless values are never cut. Records are judged by
    what all values of the same column and script show; in a table of a few rows most stay undecided, that is, whole.
    """
    own = tails(values)
    inner = values.select("rec_table", "text").mapInArrow(_counter, "h long, a long, b long")
    ended = own.where("mark <> 2").select(F.explode(F.array(*(F.struct(F.col(c).alias("h"), F.lit(1).alias("a"), F.lit(0).alias("b")) for c in _HASHES))).alias("x")).select("x.*")
    counts = inner.unionByName(ended).groupBy("h").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    # of equal last contexts one stands for all, so that a common end is one row in the join
    kinds = own.where("mark = 0").select(*_KIND).distinct()
    wanted = kinds.select("*", F.explode(F.array(*(F.struct(F.lit(c).alias("which"), F.col(c).alias("h")) for c in _HASHES))).alias("x")).select(*_KIND, "x.*")
    found = wanted.join(counts, "h", "left").groupBy(*_KIND).agg(*(F.max(F.when(F.col("which") == c, F.col(v))).alias(f"{c}_{v}") for c in _HASHES for v in ("a", "b")))
    found = found.fillna(0)
    base = F.greatest(F.col("g_a"), F.lit(1)) / F.greatest(F.col("g_a") + F.col("g_b"), F.lit(1))
    # a run's own last character run counts as one of those that occur
    word = _interpolate([(F.col("r_a"), F.greatest("r_b", "r_a"))], F.lit(0.1), RUN_BACKOFF)
    end = _interpolate([(F.col(f"e{k}_a"), F.col(f"e{k}_a") + F.col(f"e{k}_b")) for k in ORDERS], base, BACKOFF)
    odds = lambda p: F.log(p / (1 - p))
    found = found.select(*_KIND, word.alias("word_chance"), F.least(end, F.lit(0.999)).alias("end_chance"), F.least(base, F.lit(0.999)).alias("base"))
    found = found.withColumn("unsound", (F.col("word_chance") < WORD_CHANCE) | (odds(F.col("end_chance")) - odds(F.col("base")) < F.when(F.col("dotted") == 1, DOTTED_ODDS).otherwise(SENTENCE_ODDS)))
    out = own.join(found, _KIND, "left")
    return out.select("rec_table", "rec_id", "mark", "word_chance", "end_chance", "base", ((F.col("mark") == 1) | ((F.col("mark") == 0) & F.coalesce("unsound", F.lit(False)))).alias("cut"))


def text_values(entities: DataFrame, niti_results: DataFrame) -> DataFrame:
    a = entities.select(F.lit("entities").alias("rec_table"), F.col("id").alias("rec_id"), F.col("loaded_at").alias("t"), F.col("description").alias("text"))
    return a.unionByName(answer_values(niti_results))


def answer_values(niti_results: DataFrame) -> DataFrame:
    return niti_results.select(F.lit("niti_results").alias("rec_table"), F.col("result_id").cast("string").alias("rec_id"), F.col("run_at").alias("t"), F.col("predicted_answer").alias("text"))


def truncated(entities: DataFrame, niti_results: DataFrame) -> DataFrame:
    return judged(text_values(entities, niti_results)).where("cut")


def truncation_report(entities: DataFrame, niti_results: DataFrame) -> DataFrame:
    """Records and cut records per table and source or generator; a null source counts as its own."""
    named = entities.groupBy(F.col("id").alias("rec_id")).agg(F.min("source").alias("source")).select(F.lit("entities").alias("rec_table"), "rec_id", "source")
    named = named.unionByName(niti_results.groupBy(F.col("result_id").cast("string").alias("rec_id")).agg(F.min("generator").alias("source")).select(F.lit("niti_results").alias("rec_table"), "rec_id", "source"))
    all_ = judged(text_values(entities, niti_results)).join(named, ["rec_table", "rec_id"], "left")
    n, cut = F.count("*"), F.sum(F.col("cut").cast("long"))
    return all_.groupBy("rec_table", "source").agg(n.alias("n_records"), cut.alias("n_cut"), F.round(cut / n, 6).alias("rate"))


