"""Rule-based extraction of sections, offences, penalties, concepts and their edges from text chunks.

chunks: chunk_id, law_name, chapter, text. Everything is per chunk, in the JVM, without a shuffle before the final
dedup. The section that a place belongs to is the last one mentioned at or before it, else the chunk's first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexweave.functions.text import arabic_digits, match_spans
from lexweave.lexicon import LAW_ABBREVIATIONS, OFFENSES, keyword_table

# The patterns of the statute's language.
NUMBER = r"[0-9๐-๙]+(?:/[0-9๐-๙]+)?(?:\s*(?:ทวิ|ตรี|จัตวา))?"
MENTION = rf"มาตรา\s*{NUMBER}"
HEADER = r"(?m)^[ \t]*มาตรา\s*[0-9๐-๙]+(?:/[0-9๐-๙]+)?"
REFERENCE = rf"(?:ตาม|ใน|แห่ง|ดังที่บัญญัติไว้ใน)มาตรา\s*{NUMBER}"
OFFENSE = r"กระทำความผิดฐาน([฀-๿\s]+?)(?:\s+ต้องระวาง|$|[\n,])"
PENALTIES = [
    r"ต้องระวางโทษ[^.]*?ประหารชีวิต",
    r"ต้องระวางโทษ[^.]*?จำคุก[^.]*?(?:ปี|เดือน|ตลอดชีวิต)[^.]*",
    r"ต้องระวางโทษ[^.]*?ปรับ[^.]*?บาท[^.]*",
    r"จำคุก(?:ไม่เกิน|ตั้งแต่|ตลอดชีวิต)[^.]*?(?:ปี|เดือน)[^.]*",
    r"ปรับ(?:ไม่เกิน|ตั้งแต่)[^.]*?บาท",
]
#: Edge types and weights.
WEIGHTS = {"PART_OF": 1.0, "DEFINES_OFFENSE": 0.9, "HAS_PENALTY": 0.9, "REFERENCES": 0.8, "ADJACENT_TO": 0.6}


def law_abbreviation(law: Column) -> Column:
    """The first dictionary key that the name contains, else its first four characters."""
    out = F.substring(law, 1, 4)
    for key, short in reversed(LAW_ABBREVIATIONS):
        out = F.when(law.contains(key), short).otherwise(out)
    return out


def section_name(number: Column, law: Column) -> Column:
    """P5: '[law] มาตรา N' in Arabic digits; without the law's mark if it is null or empty."""
    base = F.concat(F.lit("มาตรา "), arabic_digits(F.trim(number)))
    return F.when(F.coalesce(law, F.lit("")) == "", base).otherwise(F.concat(F.lit("["), law_abbreviation(law), F.lit("] "), base))


def law_of(law: Column, chapter: Column) -> Column:
    """The law's name, inferred from the chapter where it is missing."""
    inferred = (
        F.when(chapter.contains("อาญา"), LAW_ABBREVIATIONS[0][0])
        .when(chapter.contains("แพ่ง") | chapter.contains("พาณิชย์"), LAW_ABBREVIATIONS[1][0])
        .when(chapter.contains("รัฐธรรมนูญ"), LAW_ABBREVIATIONS[3][0])
        .otherwise("")
    )
    return F.when(F.coalesce(law, F.lit("")) == "", inferred).otherwise(law)


def _number(mention: Column) -> Column:
    return F.regexp_extract(mention, rf"มาตรา\s*({NUMBER})", 1)


def with_mentions(chunks: DataFrame) -> DataFrame:
    """Adds ``law`` and ``m``, array<struct<start, name>> of all section mentions in order of place."""
    law = law_of(F.col("law_name"), F.col("chapter"))
    out = chunks.where("text is not null").withColumn("law", law).withColumn("spans", match_spans(F.col("text"), MENTION))
    return out.withColumn("m", F.transform("spans", lambda s: F.struct(s["start"].alias("start"), section_name(_number(s["text"]), F.col("law")).alias("name")))).drop("spans")


def nearest(position: Column, mentions: Column) -> Column:
    """J12, an as-of lookup in the chunk's own mentions; null if it has none."""
    before = F.filter(mentions, lambda m: m["start"] <= position)
    return F.coalesce(F.get(before, F.size(before) - 1)["name"], F.get(mentions, F.lit(0))["name"])


def mentions(chunks: DataFrame) -> DataFrame:
    """chunk_id, ord, name, start, at_line_start of every section mention."""
    rows = with_mentions(chunks).select("chunk_id", "text", F.posexplode("m").alias("ord", "s"))
    before = F.substring_index(F.expr("substring(text, 1, s.start)"), "\n", -1)
    return rows.select("chunk_id", F.col("ord").cast("long").alias("ord"), F.col("s.name").alias("name"), F.col("s.start").cast("long").alias("start"), (F.trim(before) == "").alias("at_line_start"))


def header_spans(chunks: DataFrame) -> DataFrame:
    """chunk_id, ord, number, start, length of each section by line-start headers.

    Text before the first header is ``preamble``; a text without one is the section ``0``; a span ends where the next begins.
    """
    rows = chunks.where("text is not null").withColumn("h", match_spans(F.col("text"), HEADER))
    heads = rows.select("chunk_id", F.length("text").alias("n"), F.posexplode("h").alias("ord", "s"))
    w = Window.partitionBy("chunk_id").orderBy("start")
    numbered = heads.select("chunk_id", "n", F.regexp_extract("s.text", r"มาตรา\s*([0-9๐-๙]+(?:/[0-9๐-๙]+)?)", 1).alias("number"), F.col("s.start").alias("start"))
    first = rows.where((F.size("h") > 0) & (F.get("h", F.lit(0))["start"] > 0) & (F.trim(F.expr("substring(text, 1, h[0].start)")) != "")).select("chunk_id", F.length("text").alias("n"), F.lit("preamble").alias("number"), F.lit(0).alias("start"))
    whole = rows.where(F.size("h") == 0).select("chunk_id", F.length("text").alias("n"), F.lit("0").alias("number"), F.lit(0).alias("start"))
    every = numbered.unionByName(first).unionByName(whole)
    end = F.coalesce(F.lead("start").over(w), F.col("n"))
    return every.select("chunk_id", (F.row_number().over(w) - 1).cast("long").alias("ord"), arabic_digits(F.col("number")).alias("number"), F.col("start").cast("long").alias("start"), (end - F.col("start")).cast("long").alias("length"))


def definitions(chunks: DataFrame) -> DataFrame:
    """chunk_id, ord, name, description, is_definition of every mention.

    At a line's start a mention opens its section: up to the next such one, 1,200 characters of it read and 900 kept.
    Elsewhere it is a cross-reference: itself and five characters.
    """
    rows = with_mentions(chunks).withColumn("hits", match_spans(F.col("text"), MENTION)).withColumn("heads", match_spans(F.col("text"), rf"(?:^|\n)\s*{MENTION}"))
    each = rows.select("chunk_id", "text", "heads", "m", F.posexplode("hits").alias("ord", "hit"))
    end = F.col("hit.start") + F.length("hit.text")
    before = F.substring_index(F.expr("substring(text, 1, hit.start)"), "\n", -1)
    at_start = F.trim(before) == ""
    later = F.filter("heads", lambda h: h["start"] > end)
    stop = F.least(F.col("hit.start") + 1200, F.coalesce(F.get(later, F.lit(0))["start"], F.length("text")))
    opened = F.substring(F.trim(F.translate(F.substr("text", F.col("hit.start") + 1, stop - F.col("hit.start")), "\n", " ")), 1, 900)
    crossed = F.trim(F.substr("text", F.col("hit.start") + 1, F.length("hit.text") + 5))
    follows = F.trim(F.substr("text", end + 1, F.lit(20)))
    is_def = at_start & ~follows.startswith("ถึง") & follows.rlike(r"^(?:[\[(]?[0-9๐-๙]|[฀-๿])")
    name = F.get("m", F.col("ord"))["name"]
    return each.select("chunk_id", F.col("ord").cast("long").alias("ord"), name.alias("name"), F.when(at_start, opened).otherwise(crossed).alias("description"), is_def.alias("is_definition"))


def keyword_edges(chunks: DataFrame) -> DataFrame:
    """chunk_id, source, target, type, weight, entity_type; one for each name whose keyword stands in the chunk.

    Of a name that several keywords or kinds give, the first in order counts. A chunk without any section has no edge.
    """
    words = F.broadcast(keyword_table(chunks.sparkSession))  # of fixed size
    held = with_mentions(chunks).join(words, F.col("text").contains(F.col("keyword")))
    first = held.groupBy("chunk_id", "name").agg(F.min_by(F.struct("type", "edge", "weight", nearest(F.expr("locate(keyword, text)") - 1, F.col("m")).alias("source")), "ord").alias("f"))
    return first.where("f.source is not null").select("chunk_id", "f.source", F.col("name").alias("target"), F.col("f.edge").alias("type"), "f.weight", F.col("f.type").alias("entity_type"))


def penalty_clauses(text: Column) -> Column:
    """All penalty clauses, white space collapsed, in order of pattern and place, each once."""
    found = F.flatten(F.array(*(F.regexp_extract_all(text, F.lit(p), F.lit(0)) for p in PENALTIES)))
    clean = F.transform(found, lambda c: F.regexp_replace(F.trim(c), r"\s+", " "))
    return F.array_distinct(F.filter(clean, lambda c: F.length(c) > 5))


def penalty_name(clause: Column) -> Column:
    """A short name of at most 80 characters; empty if the clause names no penalty."""
    prison = F.regexp_extract(clause, "จำคุก[^,]*?(?:ปี|เดือน|ตลอดชีวิต)", 0)
    fine = F.regexp_extract(clause, "ปรับ[^,]*?บาท", 0)
    parts = F.array_compact(
        F.array(
            F.when(clause.contains("ประหารชีวิต"), F.lit("ประหารชีวิต")),
            F.when(clause.contains("จำคุกตลอดชีวิต"), F.lit("จำคุกตลอดชีวิต")).when(clause.contains("จำคุก"), F.when(prison != "", F.trim(prison)).otherwise("จำคุก")),
            F.when(clause.contains("ปรับ"), F.when(fine != "", F.trim(fine)).otherwise("ปรับ")),
        )
    )
    name = F.concat(F.lit("โทษ"), F.array_join(parts, " และ"))
    return F.when(F.size(parts) == 0, "").when(F.length(name) > 80, F.concat(F.substring(name, 1, 77), F.lit("…"))).otherwise(name)


def penalties(chunks: DataFrame) -> DataFrame:
    """chunk_id, source, target: each penalty's name with the section at the first of its clauses."""
    rows = with_mentions(chunks).select("chunk_id", "text", "m", F.posexplode(penalty_clauses(F.col("text"))).alias("ord", "clause"))
    at = F.greatest(F.expr("locate(substring(clause, 1, 30), text)") - 1, F.lit(0))
    named = rows.select("chunk_id", "ord", penalty_name(F.col("clause")).alias("target"), nearest(at, F.col("m")).alias("source")).where("target <> ''")
    first = named.groupBy("chunk_id", "target").agg(F.min_by("source", "ord").alias("source"))
    return first.where("source is not null").select("chunk_id", "source", "target")


def offense_name(raw: Column) -> Column:
    """The dictionary's name of the first keyword held, else 'ความผิดฐาน' and the text; null outside 3 to 60 characters."""
    t = F.trim(raw)
    out = F.concat(F.lit("ความผิดฐาน"), t)
    for key, name in reversed(OFFENSES):
        out = F.when(t.contains(key), name).otherwise(out)
    return F.when(F.length(t).between(3, 60), out)


def offenses(chunks: DataFrame) -> DataFrame:
    """chunk_id, source, target of each offence by pattern."""
    rows = with_mentions(chunks).select("chunk_id", "m", F.explode(match_spans(F.col("text"), OFFENSE)).alias("s"))
    named = rows.select("chunk_id", nearest(F.col("s.start"), F.col("m")).alias("source"), offense_name(F.regexp_extract("s.text", OFFENSE, 1)).alias("target"))
    return named.where("source is not null and target is not null").distinct()


def references(chunks: DataFrame) -> DataFrame:
    """chunk_id, source, target; only a reference directly behind one of the prefix words makes an edge."""
    rows = with_mentions(chunks).select("chunk_id", "law", "m", F.explode(match_spans(F.col("text"), REFERENCE)).alias("s"))
    target = section_name(_number(F.col("s.text")), F.col("law"))
    return rows.select("chunk_id", nearest(F.col("s.start"), F.col("m")).alias("source"), target.alias("target")).where("source <> target").distinct()


def adjacent(chunks: DataFrame) -> DataFrame:
    """chunk_id, source, target of neighbours among the chunk's sections in order of first mention."""
    names = F.array_distinct(F.transform("m", lambda m: m["name"]))
    pairs = F.transform(F.slice(names, 1, F.greatest(F.size(names) - 1, F.lit(0))), lambda n, i: F.struct(n.alias("source"), F.get(names, i + 1).alias("target")))
    return with_mentions(chunks).select("chunk_id", F.explode(pairs).alias("p")).select("chunk_id", "p.source", "p.target")


def part_of(chunks: DataFrame) -> DataFrame:
    """chunk_id, source, target from each section to its law."""
    rows = with_mentions(chunks).where("law <> ''").select("chunk_id", F.col("law").alias("target"), F.explode(F.array_distinct(F.transform("m", lambda m: m["name"]))).alias("source"))
    return rows.select("chunk_id", "source", "target")


def edges(chunks: DataFrame) -> DataFrame:
    """All edges of all chunks: source, target, type, weight, chunk_id."""
    out = keyword_edges(chunks).select("source", "target", "type", "weight", "chunk_id")
    for kind, f in (("PART_OF", part_of), ("DEFINES_OFFENSE", offenses), ("HAS_PENALTY", penalties), ("REFERENCES", references), ("ADJACENT_TO", adjacent)):
        out = out.unionByName(f(chunks).select("source", "target", F.lit(kind).alias("type"), F.lit(WEIGHTS[kind]).alias("weight"), "chunk_id"))
    return out
