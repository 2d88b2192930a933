"""Text expressions on columns: normal forms, digits, match spans, tokens.

Everything stays in the JVM except NFC, for which Spark has no builtin: the UDF gets a null for each
value that is in NFC by its characters, so that only the rare others cross to Python.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Thai and Arabic digits, invisible characters, Unicode white space as Python's str.isspace has it.
THAI_DIGITS = "\u0e50\u0e51\u0e52\u0e53\u0e54\u0e55\u0e56\u0e57\u0e58\u0e59"
ARABIC_DIGITS = "0123456789"
INVISIBLE = "\u200b\u200c\u200d\ufeff"
UNICODE_SPACE = "[\\x09-\\x0d\\x1c-\\x20\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]"

#: A text without these is in NFC: characters outside Latin-1, Thai, general punctuation, CJK, kana and wide forms; combining kana marks; Thai marks out of order.
MAYBE_NOT_NFC = (
    "[^\\x00-\\xff\\u0e00-\\u0e7f\\u2002-\\u206f\\u3000-\\u3029\\u3030-\\u3098\\u309b-\\u30ff\\u4e00-\\u9fff\\ufeff\\uff00-\\uffef]"
    "|[\\u0e48-\\u0e4b][\\u0e38-\\u0e3a]|[\\u0e38\\u0e39]\\u0e3a"
)


@F.pandas_udf(T.StringType())
def _nfc(values: pd.Series) -> pd.Series:
    return values.map(lambda v: unicodedata.normalize("NFC", v), na_action="ignore")


def nfc(c: Column) -> Column:
    return F.coalesce(_nfc(F.when(c.rlike(MAYBE_NOT_NFC), c)), c)


def arabic_digits(c: Column) -> Column:
    return F.translate(c, THAI_DIGITS, ARABIC_DIGITS)


def drop_invisible(c: Column) -> Column:
    return F.translate(c, INVISIBLE, "")


def strip(c: Column) -> Column:
    """Like Python's str.strip: any Unicode white space, at both ends."""
    return F.regexp_replace(c, f"^{UNICODE_SPACE}+|{UNICODE_SPACE}+$", "")


def normalize(c: Column) -> Column:
    """Drop BOM and zero-width, NFC, collapse blanks and tabs, at most one blank line, strip."""
    c = nfc(drop_invisible(c))
    c = F.regexp_replace(c, "[ \\t]+", " ")
    return strip(F.regexp_replace(c, "\\n{3,}", "\n\n"))


def unix_newlines(c: Column) -> Column:
    return F.regexp_replace(c, "\\r\\n?", "\n")


#: A key without these is in its normal form already: invisible characters, Thai digits, white space other than single inner spaces.
_KEY_NEEDS_WORK = f"[\u200b\u200c\u200d\ufeff\u0e50-\u0e59]|^{UNICODE_SPACE}|{UNICODE_SPACE}$|  |(?! ){UNICODE_SPACE}|{MAYBE_NOT_NFC}"


def reference_key(c: Column) -> Column:
    """The form in which two written keys are the same key; empty for a blank one."""
    full = arabic_digits(drop_invisible(nfc(c)))
    full = strip(F.regexp_replace(full, f"{UNICODE_SPACE}+", " "))
    return F.when(c.rlike(_KEY_NEEDS_WORK), full).otherwise(c)


def match_spans(text: Column, pattern: str) -> Column:
    """All matches with their places: array<struct<start, text>>, start 0-based in characters; empty for null.

    Spark has no find-all with offsets; the pieces between matches and the matches themselves are
    zipped and their lengths summed.
    """
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,text:string>>").alias("out"))

    def step(acc: Column, i: Column) -> Column:
        at = acc["at"] + F.length(F.get(gaps, i))
        hit = F.get(hits, i)
        return F.struct(
            (at + F.length(hit)).alias("at"),
            F.concat(acc["out"], F.array(F.struct(at.alias("start"), hit.alias("text")))).alias("out"),
        )

    index = F.when(F.size(hits) > 0, F.sequence(F.lit(0), F.size(hits) - 1)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(index, start, step, lambda acc: acc["out"])


#: What the term index counts as a term.
TERM = r"[\p{L}\p{N}_]{2,}"


def terms(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(TERM), F.lit(0))


def section_number(c: Column) -> Column:
    """The first section number, in Arabic digits; empty if there is none."""
    return arabic_digits(F.regexp_extract(c, "มาตรา\\s*([0-9๐-๙]+(?:/[0-9๐-๙]+)?)", 1))


def display_label(c: Column) -> Column:
    """The name without its leading [law] mark."""
    return F.regexp_replace(c, "^\\[.*?\\] ", "")


def chapter_of(chunk_ids: Column) -> Column:
    """The chapter in the first chunk id of at least two parts, its underscores as blanks; empty if there is none."""
    first = F.get(F.filter(chunk_ids, lambda c: F.contains(c, F.lit("__"))), F.lit(0))
    return F.coalesce(F.replace(F.split(first, "__")[1], F.lit("_"), F.lit(" ")), F.lit(""))


def safe_ratio(top: Column, bottom: Column) -> Column:
    return F.when(bottom > 0, top / bottom).otherwise(F.lit(0.0))
