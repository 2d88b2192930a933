"""Splitting of oversized items at natural boundaries (problem 5).

A text of more than ``limit`` tokens is cut by dynamic programming over boundary positions: the sum of each
cut's penalty, a fixed price for each piece and the pieces' imbalance is least, no piece exceeds ``limit``
tokens, and each piece begins exactly ``overlap`` tokens before the end of the one before it. Texts within the
limit are recognised in the JVM and never reach Python.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from lexweave.llm.rows import map_rows

LIMIT, OVERLAP = 1200, 100

#: Fixed value: what counts as a token.
TOKEN = "[A-Za-z]+|[0-9]+|[\\u0e00-\\u0e7f]{1,3}|[^ \\t\\r\\n\\u00a0\\u3000A-Za-z0-9\\u0e00-\\u0e7f]"

#: Prices of a cut, by what stands between the tokens; and of a piece, and of a piece's squared relative deviation.
PARAGRAPH, LINE, SENTENCE, SPACE, COMMA, BARE = 0.0, 1.0, 2.0, 4.0, 6.0, 20.0
PER_PIECE, IMBALANCE = 10.0, 6.0

_TOKEN = re.compile(TOKEN)
_BLANK_LINE = re.compile(r"\n[^\S\n]*\n|\r\n?[^\S\n]*\r\n?")
_ENDS = frozenset(".!?…。！？」』”\"'）)")
_STOPS = frozenset(".!?…。！？")
_COMMAS = frozenset(",;:、，；：")

PIECE = StructType([StructField("piece", IntegerType()), StructField("start_pos", IntegerType()), StructField("end_pos", IntegerType()), StructField("n_tokens", IntegerType())])


def _price(gap: str, before: str) -> float:
    if gap:
        if "\n" in gap or "\r" in gap:
            return PARAGRAPH if _BLANK_LINE.search(gap) else LINE
        return SENTENCE if before in _ENDS else SPACE
    return SENTENCE if before in _STOPS and before not in "." else COMMA if before in _COMMAS else BARE


def cut_tokens(prices: np.ndarray, limit: int, overlap: int) -> list[int]:
    """Where to cut; ``prices[i]`` is the price of a cut before token i, for 0 < i < n. Token n closes the last piece.

    The least sum is that over the natural boundaries and, where none follows another within half a piece, every place between those two.
    """
    n, step = len(prices), limit - overlap
    natural = np.flatnonzero(prices < BARE)
    natural = natural[(natural > overlap) & (natural < n)]
    points, last = [0], 0
    for p in [*natural.tolist(), n]:
        if p - last > step // 2:  # no natural boundary for long: any token's
            points.extend(range(max(last, overlap) + 1, p))
        points.append(p)
        last = p
    at = np.asarray(points)
    price = np.where(at < n, prices[np.minimum(at, n - 1)], 0.0) + PER_PIECE
    ideal = max(1.0, (n - overlap) / max(1, -(-(n - overlap) // step)))
    best, back, low = np.full(len(at), np.inf), np.zeros(len(at), int), 0
    best[0] = 0.0
    for j in range(1, len(at)):
        while at[j] - at[low] > (limit if low == 0 else step):
            low += 1
        own = at[j] - at[low:j] - (overlap if low == 0 else 0) * (at[low:j] == 0)
        if not own.size:
            continue
        cost = best[low:j] + IMBALANCE * (own / ideal - 1.0) ** 2
        k = int(cost.argmin())
        best[j], back[j] = cost[k] + price[j], low + k
    cuts, j = [], len(at) - 1
    while j:
        cuts.append(int(at[j]))
        j = int(back[j])
    return cuts[::-1]


def pieces(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, int, int]]:
    """(piece number, start, end, tokens) of a text over the limit; nothing for a text within it."""
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be at least 0 and below limit")
    spans = [m.span() for m in _TOKEN.finditer(text)]
    n = len(spans)
    if n <= limit:
        return []
    prices = np.full(n, BARE)
    for i in range(1, n):
        end = spans[i - 1][1]
        gap = text[end : spans[i][0]]
        before = text[end - 1]
        if gap or before in _COMMAS or before in _STOPS:
            prices[i] = _price(gap, before)
    out, start = [], 0
    for k, c in enumerate(cut_tokens(prices, limit, overlap)):
        out.append((k, spans[start][0], spans[c - 1][1], c - start))
        start = max(0, c - overlap)
    return out


def split_oversized(df: DataFrame, key: str, text: str, time: str, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """The pieces of each text over ``limit`` tokens: key as string, pieces array<piece, start_pos, end_pos, n_tokens>.

    Null and empty texts, and texts within the limit, give no row. Of a repeated key its earliest delivery
    counts. Positions count code points. A text without any natural boundary is cut between tokens.
    """
    rows = df.select(F.col(key).cast("string").alias("k"), F.coalesce(time, F.lit("9999-12-31").cast("timestamp")).alias("t"), F.col(text).alias("x"))
    # the earliest delivery is chosen among all; only long texts are carried along
    long = (F.length("x") > limit) & (F.regexp_count("x", F.lit(TOKEN)) > limit)
    first = rows.select("k", "t", F.when(long, F.col("x")).alias("x")).groupBy("k").agg(F.min(F.struct("t", "x")).alias("f")).where("f.x is not null").select("k", "f.x")
    schema = StructType([StructField(key, StringType()), StructField("pieces", ArrayType(PIECE))])
    return map_rows(first, lambda: lambda k, x: [(k, [dict(zip(PIECE.names, p, strict=True)) for p in pieces(x, limit, overlap)])], schema, 256)


def oversized_tables(legal_sections: DataFrame, text_units: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    a = split_oversized(legal_sections, "section_id", "raw_text", "loaded_at", limit, overlap).select(F.lit("legal_sections").alias("rec_table"), F.col("section_id").alias("rec_id"), "pieces")
    b = split_oversized(text_units, "chunk_id", "text", "loaded_at", limit, overlap).select(F.lit("text_units").alias("rec_table"), F.col("chunk_id").alias("rec_id"), "pieces")
    return a.unionByName(b)


def piece_rows(found: DataFrame) -> DataFrame:
    return found.select("rec_table", "rec_id", F.explode("pieces").alias("p")).select("rec_table", "rec_id", *(F.col(f"p.{c}").cast(LongType()).alias(c) for c in PIECE.names))
