"""Answers without a language model: law boost, section selection, extras, rendering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexweave import lexicon
from lexweave.config import DEFAULT, Settings

#: What a penalty's description must hold and must not.
PENALTY_GOOD = "ระวางโทษ|จำคุก|ปรับไม่เกิน|ปรับตั้งแต่|ประหาร|กักขัง|ริบทรัพย์|โทษ"
PENALTY_NOISE = "ปรับปรุง|พัฒนา|โครงสร้าง|แผน|นโยบาย|ยุทธศาสตร์"
PENALTY_QUERY = "โทษ|ระวาง|จำคุก|ปรับ|ประหาร"
NOT_FOUND, CITED = "ไม่พบข้อมูลที่เกี่ยวข้อง", "มาตราที่เกี่ยวข้อง: "


def valid_penalty(description: Column) -> Column:
    """P9."""
    return ~description.rlike(PENALTY_NOISE) & description.rlike(PENALTY_GOOD)


def asks_penalty(question: Column) -> Column:
    """P11."""
    return question.rlike(PENALTY_QUERY)


def law_factor(question: Column, name: Column) -> Column:
    """Q1: the factor of the law that a section's name is marked with."""
    any_of = lambda words: question.rlike("|".join(words))
    criminal, civil = any_of(lexicon.CRIMINAL_SIGNS), any_of(lexicon.CIVIL_SIGNS)
    constitution = any_of(lexicon.CONSTITUTION_SIGNS) & ~any_of(lexicon.ROYAL_OFFENSE_SIGNS)
    law = F.regexp_extract(name, r"^\[([^\]]+)\]", 1)
    return (
        F.when((law == "อาญา") & criminal, 1.25)
        .when((law == "แพ่ง") & civil, 1.25)
        .when(law == "รธน", F.when(constitution, 1.2).when(civil, 0.9).when(criminal, 0.85).otherwise(1.0))
        .otherwise(1.0)
    )


def boost(hits: DataFrame, queries: DataFrame) -> DataFrame:
    """Adds boosted_score; the score itself stays. hits: query_id, name, score."""
    q = queries.select("query_id", F.col("text").alias("question"))
    return hits.join(q, "query_id").withColumn("boosted_score", F.round(F.col("score") * law_factor(F.col("question"), F.col("name")), 6)).drop("question")


def select_sections(hits: DataFrame, s: Settings = DEFAULT, by: str = "score") -> DataFrame:
    """Q2: query_id, name, score, rn of the clearly relevant ones: above the floor, before the largest decisive gap."""
    w = Window.partitionBy("query_id").orderBy(F.desc(by), "name")
    ranked = hits.withColumn("rn", F.row_number().over(w).cast("long")).where(F.col("rn") <= s.max_sections)
    top = Window.partitionBy("query_id")
    kept = ranked.where(F.col(by).isNotNull()).withColumn("top", F.max(by).over(top)).where((F.col("rn") == 1) | (F.col(by) >= s.floor_share * F.col("top")))
    gaps = kept.withColumn("gap", F.round(F.col(by) - F.lead(by).over(w), 6))
    cut = F.max(F.when(F.col("gap") >= s.gap, F.struct("gap", (-F.col("rn")).alias("first")))).over(top)
    return gaps.withColumn("cut", -cut["first"]).where(F.col("cut").isNull() | (F.col("rn") <= F.col("cut"))).select("query_id", "name", F.col(by).alias("score"), "rn")


def relevant(question: Column, name: Column, description: Column) -> Column:
    """P10: a Thai run of the name stands in the question, or one of the question in the name or the description's start."""
    return _related(F.lower(question), _runs(question), name, description)


def _runs(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"[฀-๿]{3,}"), F.lit(0))


def _related(question: Column, runs: Column, name: Column, description: Column) -> Column:
    """``relevant``, of a question in lower case and its runs."""
    n, d = F.lower(name), F.lower(F.coalesce(description, F.lit("")))
    text = F.array(F.concat(n, F.lit("\n"), F.substring(d, 1, 100)))  # as an array of one it is worked out once, not for each run
    return F.exists(_runs(name), lambda x: F.contains(question, x)) | F.exists(text, lambda t: F.exists(runs, lambda x: F.contains(t, x)))


def extras(hits: DataFrame, selected: DataFrame, queries: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """Q3: query_id, name, type, score, role. hits: query_id, name, type, description, score of other entities."""
    q = queries.select("query_id", F.lower("text").alias("question"), _runs(F.col("text")).alias("runs"), asks_penalty(F.col("text")).alias("asks"))
    least = selected.groupBy("query_id").agg(F.min("score").alias("least"))
    sound = hits.where(F.col("type").isin("OFFENSE", "PENALTY", "LEGAL_CONCEPT") & ((F.col("type") != "PENALTY") | valid_penalty(F.coalesce("description", F.lit("")))))
    own = sound.join(q, "query_id").join(least, "query_id", "left")
    fit = ((F.col("type") == "PENALTY") & F.col("asks")) | _related(F.col("question"), F.col("runs"), F.col("name"), F.col("description"))
    role = F.when(F.col("score") >= F.coalesce("least", F.lit(0.0)), "primary").when(F.col("score") > 0.3, "secondary")
    w = Window.partitionBy("query_id", "role").orderBy(F.desc("score"), "name")
    ranked = own.where(fit).withColumn("role", role).where("role is not null").withColumn("rn", F.row_number().over(w))
    return ranked.where(F.col("rn") <= F.when(F.col("role") == "primary", s.primary_extras).otherwise(s.secondary_extras)).select("query_id", "name", "type", "score", "role")


def render(selected: DataFrame, texts: DataFrame, queries: DataFrame, more: DataFrame | None = None, reports: DataFrame | None = None) -> DataFrame:
    """query_id, answer: the sections' texts in order of rank, extras, reports and a line of the sections' numbers; a fixed text if there are none.

    more: query_id, name, description, score, role of extras, at most a few of each role to a question. reports: query_id, title, summary, rn
    of the first reports (T9), of stated number.
    """
    body = selected.join(texts.select("name", "statute"), "name", "left")
    number = F.regexp_extract("name", r"มาตรา\s*([0-9]+(?:/[0-9]+)?)", 1)
    lines = body.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rn", "name", "statute", number.alias("number")))).alias("s"))  # at most max_sections rows
    text = F.array_join(F.transform("s", lambda x: F.concat_ws("\n", x["name"], x["statute"])), "\n\n")
    cited = F.concat(F.lit(CITED), F.array_join(F.array_distinct(F.transform("s", lambda x: F.concat(F.lit("มาตรา "), x["number"]))), ", "))
    blocks = [text]
    if more is not None:
        row = F.struct(F.when(F.col("role") == "primary", 0).otherwise(1).alias("o"), (-F.col("score")).alias("s"), "name", F.concat_ws(": ", "name", truncate(F.col("description"))).alias("line"))
        lines = lines.join(more.groupBy("query_id").agg(F.array_sort(F.collect_list(row)).alias("x")), "query_id", "left")
        blocks.append(F.array_join(F.transform("x", lambda x: F.concat(F.lit("- "), x["line"])), "\n"))
    if reports is not None:
        lines = lines.join(reports.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rn", F.concat_ws(": ", "title", "summary").alias("line")))).alias("r")), "query_id", "left")
        blocks.append(F.array_join(F.transform("r", lambda x: F.concat(F.lit("- "), x["line"])), "\n"))
    full = lines.select("query_id", F.concat_ws("\n\n", *blocks, cited).alias("answer"))
    return queries.select("query_id").join(full, "query_id", "left").select("query_id", F.when(F.length(F.trim(F.coalesce("answer", F.lit("")))) < 20, NOT_FOUND).otherwise(F.col("answer")).alias("answer"))


def truncate(text: Column, limit: int = 300) -> Column:
    """Cut before a later section mention, else at the last blank, else hard."""
    from lexweave.functions.text import match_spans

    starts = F.transform(match_spans(text, r"\s+มาตรา\s+[๐-๙0-9]"), lambda s: s["start"])
    at = F.get(F.filter(starts, lambda p: p > limit * 0.3), F.lit(0))
    blank = limit - F.instr(F.reverse(F.substring(text, 1, limit)), " ")
    end = lambda s: F.concat(F.rtrim(s), F.lit(" ..."))
    return (
        F.when(F.length(text) <= limit, text)
        .when(at.isNotNull(), end(F.substr(text, F.lit(1), at)))
        .when((F.instr(F.substring(text, 1, limit), " ") > 0) & (blank > limit * 0.5), end(F.substr(text, F.lit(1), blank)))
        .otherwise(F.concat(F.substring(text, 1, limit), F.lit("...")))
    )
