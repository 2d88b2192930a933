"""Retrieval, citation and overlap metrics, folds and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexweave.functions.text import arabic_digits, safe_ratio
from lexweave.lexicon import STOP_WORDS
from lexweave.session import cut_lineage

CITATION_LABEL = "มาตราที่เกี่ยวข้อง"


def _set(c: Column) -> Column:
    return F.array_distinct(F.array_compact(F.coalesce(c, F.array().cast("array<string>"))))


def hit(predicted: Column, truth: Column) -> Column:
    """M1: 1.0 if any true one was found; 1.0 for an empty truth."""
    return F.when(F.size(_set(truth)) == 0, 1.0).otherwise(F.arrays_overlap(_set(predicted), _set(truth)).cast("double"))


def precision(predicted: Column, truth: Column) -> Column:
    """M1: over the list as it is, repeats and all."""
    p = F.coalesce(predicted, F.array().cast("array<string>"))
    return safe_ratio(F.size(F.filter(p, lambda x: F.array_contains(_set(truth), x))), F.size(p))


def recall(predicted: Column, truth: Column) -> Column:
    t = _set(truth)
    return F.when(F.size(t) == 0, 1.0).otherwise(F.size(F.array_intersect(_set(predicted), t)) / F.size(t))


def citation(predicted: Column, truth: Column) -> Column:
    """M2: struct of precision, recall, f1 over sets; all 1 if both are empty, all 0 if one is."""
    p, t = _set(predicted), _set(truth)
    tp = F.size(F.array_intersect(p, t))
    pr, rc = tp / F.size(p), tp / F.size(t)
    f1 = F.when(tp == 0, 0.0).otherwise(2 * pr * rc / (pr + rc))
    both, one = (F.size(p) == 0) & (F.size(t) == 0), (F.size(p) == 0) | (F.size(t) == 0)
    pick = lambda v: F.when(both, 1.0).when(one, 0.0).otherwise(v)
    return F.struct(pick(pr).alias("precision"), pick(rc).alias("recall"), pick(f1).alias("f1"))


def reciprocal_rank(predicted: Column, truth: Column) -> Column:
    """One over the first true one's place; 0 if there is none."""
    p = F.coalesce(predicted, F.array().cast("array<string>"))
    places = F.filter(F.transform(p, lambda x, i: F.when(F.array_contains(_set(truth), x), i + 1)), lambda v: v.isNotNull())
    return F.when(F.size(places) > 0, 1.0 / F.get(places, F.lit(0))).otherwise(0.0)


def at_k(predicted: Column, truth: Column, k: int) -> Column:
    """Struct of hit, precision over a fixed k, and recall in the first k; all 0 for an empty truth."""
    t, head = _set(truth), F.slice(F.coalesce(predicted, F.array().cast("array<string>")), 1, k)
    n = F.size(F.array_intersect(head, t))
    empty = F.size(t) == 0
    return F.struct(
        F.when(empty, 0.0).otherwise((n > 0).cast("double")).alias("hit"), F.when(empty, 0.0).otherwise(n / F.lit(k)).alias("precision"), F.when(empty, 0.0).otherwise(n / F.size(t)).alias("recall")
    )


def micro(df: DataFrame, predicted: str, truth: str, by: list[str]) -> DataFrame:
    """A10: sums of true positives and errors first, then one division; beside it the macro mean of f1."""
    p, t = _set(F.col(predicted)), _set(F.col(truth))
    rows = df.select(*by, F.size(F.array_intersect(p, t)).alias("tp"), F.size(F.array_except(p, t)).alias("fp"), F.size(F.array_except(t, p)).alias("fn"), citation(F.col(predicted), F.col(truth))["f1"].alias("f1"))
    s = rows.groupBy(*by).agg(*(F.sum(c).alias(c) for c in ("tp", "fp", "fn")), F.round(F.avg("f1"), 6).alias("macro_f1"), F.count("*").alias("n"))
    pr, rc = safe_ratio(F.col("tp"), F.col("tp") + F.col("fp")), safe_ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    f1 = safe_ratio(2 * pr * rc, pr + rc)
    return s.select(*by, "n", "tp", "fp", "fn", F.round(pr, 6).alias("micro_precision"), F.round(rc, 6).alias("micro_recall"), F.round(f1, 6).alias("micro_f1"), "macro_f1")


def cited_sections(answer: Column) -> Column:
    """M3: section numbers of the first line with the citation label, else of the whole text."""
    lines = F.filter(F.split(answer, "\n"), lambda x: F.contains(x, F.lit(CITATION_LABEL)))
    return F.array_distinct(F.regexp_extract_all(F.coalesce(F.get(lines, F.lit(0)), answer), F.lit(r"มาตรา\s*([0-9]+(?:/[0-9]+)?)"), F.lit(1)))


def cited_under_law(answer: Column, prefix: str) -> Column:
    """M4: numbers of the citation line that the body names under the law's prefix; without such a line all that it names so."""
    mark = "".join(f"\\{c}" if not c.isalnum() else c for c in prefix)
    named = F.array_distinct(F.transform(F.regexp_extract_all(answer, F.lit(rf"{mark}\s*มาตรา\s*([0-9๐-๙]+(?:/[0-9๐-๙]+)?)"), F.lit(1)), arabic_digits))
    line = F.get(F.filter(F.split(answer, "\n"), lambda x: F.contains(x, F.lit(CITATION_LABEL))), F.lit(0))
    listed = F.transform(F.regexp_extract_all(line, F.lit("([0-9๐-๙]+(?:/[0-9๐-๙]+)?)"), F.lit(1)), arabic_digits)
    return F.when(line.isNotNull(), F.array_distinct(F.filter(listed, lambda n: F.array_contains(named, n)))).otherwise(named)


def ranked_sections(hits: DataFrame, prefix: str | None = None, k: int = 20) -> DataFrame:
    """query_id, sections: numbers of the k best section hits, under one law if asked, each once in order of rank.

    hits: query_id, name, score. At most k names of a question are gathered.
    """
    own = hits.where(F.col("name").contains(prefix)) if prefix else hits
    number = arabic_digits(F.regexp_extract("name", r"มาตรา\s*([0-9๐-๙]+(?:/[0-9๐-๙]+)?)", 1))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "name")
    best = own.withColumn("number", number).where("number <> ''").withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= k)
    return best.groupBy("query_id").agg(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("rn", "number"))), lambda x: x["number"])).alias("sections"))


def display_order(sections: Column) -> Column:
    """By the integer before the slash."""
    return F.transform(F.array_sort(F.transform(sections, lambda s: F.struct(F.split(s, "/")[0].cast("int").alias("n"), s.alias("s")))), lambda x: x["s"])


def ground_truth_sections(laws: Column) -> Column:
    """M9: the first number of each law's content, each once. laws: array<struct<law_name, section_content>>."""
    return F.array_distinct(F.filter(F.transform(laws, lambda x: F.regexp_extract(x["section_content"], r"([0-9]+(?:/[0-9]+)?)", 1)), lambda n: n != ""))


def overlap_tokens(text: Column) -> Column:
    """M5: Thai runs of two and more without stop words, and '§N' for each section cited."""
    runs = F.filter(F.regexp_extract_all(text, F.lit("[฀-๿]{2,}"), F.lit(0)), lambda w: ~w.isin(STOP_WORDS))
    cited = F.transform(F.regexp_extract_all(text, F.lit(r"มาตรา\s*([0-9]+(?:/[0-9]+)?)"), F.lit(1)), lambda n: F.concat(F.lit("§"), n))
    return F.array_distinct(F.concat(runs, cited))


def overlap(text: Column, reference: Column) -> Column:
    """The share of the reference's tokens that the text has."""
    b = overlap_tokens(reference)
    return safe_ratio(F.size(F.array_intersect(overlap_tokens(text), b)), F.size(b))


def benchmark_overlap(text: Column, reference: Column) -> Column:
    """M7: as M5 over Thai and Latin runs in lower case, without stop words."""
    tok = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("[฀-๿]{2,}|[a-z]{2,}"), F.lit(0)))
    b = tok(reference)
    return safe_ratio(F.size(F.array_intersect(tok(text), b)), F.size(b))


def semantic(overlap_: Column, similarity: Column | None = None) -> Column:
    """M6: 0.6 of the texts' similarity, held within 0 and 1, and 0.4 of their overlap; the overlap alone where there is no similarity."""
    if similarity is None:
        return overlap_
    return F.when(similarity.isNull(), overlap_).otherwise(0.6 * F.greatest(F.lit(0.0), F.least(F.lit(1.0), similarity)) + 0.4 * overlap_)


def faithfulness(answer: Column, truth: Column, similarity: Column | None = None, judge: Column | None = None) -> Column:
    """M6: a judge's score if there is one, else how the answer compares with the truth."""
    own = semantic(overlap(answer, truth), similarity)
    return own if judge is None else F.coalesce(judge, own)


def relevancy(answer: Column, question: Column, similarity: Column | None = None, judge: Column | None = None) -> Column:
    """M6: as faithfulness, of the answer without the question that its first line may repeat."""
    own = semantic(overlap(without_echo(answer), question), similarity)
    return own if judge is None else F.coalesce(judge, own)


def without_echo(answer: Column) -> Column:
    return F.trim(F.regexp_replace(answer, r"^คำถาม:[^\n]*\n?", ""))


def fold_of(key: Column, k: int) -> Column:
    """W9 at any size: a fold from the key's digest; sizes are even but for chance. ``exact_folds`` evens them out."""
    return F.pmod(F.conv(F.substring(F.md5(key.cast("string")), 1, 8), 16, 10).cast("long"), F.lit(k))


def exact_folds(questions: DataFrame, key: str, k: int, seed: int = 42) -> DataFrame:
    """Adds ``fold``: the place of each key in a seeded order, modulo k, so that sizes differ by at most one.

    The order is that of a digest of seed and key. It is sorted in ranges; the driver gets the ranges' sizes and no keys.
    """
    order = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string")))
    n = int(questions.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = questions.select(key).where(F.col(key).isNotNull()).distinct().withColumn("order", order).repartitionByRange(n, "order", key).sortWithinPartitions("order", key)
    at = F.monotonically_increasing_id()
    placed = cut_lineage(ranged.select(key, F.shiftright(at, 33).alias("range"), at.bitwiseAND(F.lit((1 << 33) - 1)).alias("i")))
    first, before = {}, 0
    for r in placed.groupBy("range").count().orderBy("range").collect():
        first[r["range"]] = before
        before += r["count"]
    starts = F.create_map(*(F.lit(x) for kv in first.items() for x in kv)) if first else F.create_map(F.lit(0).cast("long"), F.lit(0))
    return questions.join(placed.select(key, F.pmod(F.col("i") + starts[F.col("range")], F.lit(k)).cast("int").alias("fold")), key)


def running_means(rows: DataFrame, by: str, order: str, columns: list[str]) -> DataFrame:
    """by, order and for each column its mean over the rows up to each: ranges of rows are summed first, so no group is one task's work.

    The ranges' sums, one row for each range and group, are all that is set against each other.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut_lineage(rows.select(by, order, *columns).repartitionByRange(n, by, order).withColumn("range", F.spark_partition_id()))
    sums = [x for c in columns for x in (F.sum(c).alias(f"{c}_s"), F.count(c).alias(f"{c}_n"))]
    before = Window.partitionBy(by).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranged.groupBy(by, "range").agg(*sums).select(by, "range", *(F.coalesce(F.sum(f"{c}_{x}").over(before), F.lit(0)).alias(f"{c}_{x}") for c in columns for x in "sn"))
    joined = ranged.withColumnRenamed(by, "_by").join(F.broadcast(starts.withColumnRenamed("range", "_range")), F.col("_by").eqNullSafe(F.col(by)) & (F.col("range") == F.col("_range")))
    w = Window.partitionBy("_by", "range").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    mean = lambda c: F.try_divide(F.col(f"{c}_s") + F.coalesce(F.sum(c).over(w), F.lit(0.0)), F.col(f"{c}_n") + F.count(c).over(w))
    return joined.select(F.col("_by").alias(by), order, *(mean(c).alias(c) for c in columns))


def fold_summary(per_fold: DataFrame, metrics: list[str], by: list[str] | None = None) -> DataFrame:
    """Metric, mean, std (population), min, max over the folds."""
    pairs = ", ".join(f"'{m}', {m}" for m in metrics)
    long = per_fold.select(*(by or []), F.expr(f"stack({len(metrics)}, {pairs}) as (metric, value)"))
    r = lambda c: F.round(c, 6)
    return long.groupBy(*(by or []), "metric").agg(r(F.avg("value")).alias("mean"), r(F.coalesce(F.stddev_pop("value"), F.lit(0.0))).alias("std"), r(F.min("value")).alias("min"), r(F.max("value")).alias("max"))


def strategy_matrix(ranked: DataFrame, truth: DataFrame) -> DataFrame:
    """Per strategy the means of hit, MRR, P@10, R@10, R@20 and F1@10.

    ranked: strategy, query_id, sections (array in order of rank). truth: query_id, truth (array).
    """
    rows = truth.join(ranked.select("strategy").distinct()).join(ranked, ["strategy", "query_id"], "left")  # a handful of strategies
    ten, twenty = at_k(F.col("sections"), F.col("truth"), 10), at_k(F.col("sections"), F.col("truth"), 20)
    m = rows.select("strategy", reciprocal_rank(F.col("sections"), F.col("truth")).alias("mrr"), ten["hit"].alias("hit"), ten["precision"].alias("p10"), ten["recall"].alias("r10"), twenty["recall"].alias("r20"))
    m = m.withColumn("f10", safe_ratio(2 * F.col("p10") * F.col("r10"), F.col("p10") + F.col("r10")))
    return m.groupBy("strategy").agg(F.count("*").alias("n"), *(F.round(F.avg(c), 6).alias(c) for c in ("hit", "mrr", "p10", "r10", "r20", "f10")))
