"""Item texts, query expansion, graph expansion and the composition of local, global and hybrid search."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexweave.config import DEFAULT, Settings
from lexweave.functions.text import arabic_digits, match_spans
from lexweave.operators import graph, rank
from lexweave.session import cut_lineage

#: Characters by which concepts are looked up.
HEAD = 8
SECTION_MENTION = r"มาตรา\s*[0-9๐-๙]+(?:/[0-9๐-๙]+)?"


def _number(c: Column) -> Column:
    return arabic_digits(F.regexp_extract(c, r"มาตรา\s*([0-9๐-๙]+(?:/[0-9๐-๙]+)?)", 1))


def statute_spans(chunks: DataFrame) -> DataFrame:
    """chunk_id, number, start, stop: the first mention of each number in a chunk, up to the next of another number."""
    hits = chunks.where("text is not null").select("chunk_id", F.length("text").alias("n"), F.explode(match_spans(F.col("text"), SECTION_MENTION)).alias("s"))
    each = hits.select("chunk_id", "n", _number(F.col("s.text")).alias("number"), F.col("s.start").alias("start"))
    w = Window.partitionBy("chunk_id").orderBy("start")
    run = each.withColumn("opens", F.when(F.col("number") != F.coalesce(F.lag("number").over(w), F.lit("")), F.col("start")))
    stop = F.coalesce(F.first("opens", ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing)), F.col("n"))
    ends = run.withColumn("stop", stop)
    return ends.groupBy("chunk_id", "number").agg(F.min("start").alias("start"), F.min_by("stop", "start").alias("stop"))


def resolved_sections(entities: DataFrame, chunks: DataFrame) -> DataFrame:
    """R2: name, statute: the section's own text from the first of its chunks that holds it, else null.

    entities: name, source_chunk_ids.
    """
    own = entities.select("name", _number(F.col("name")).alias("number"), F.posexplode("source_chunk_ids").alias("pos", "chunk_id")).where("number <> ''")
    found = own.join(statute_spans(chunks), ["chunk_id", "number"])
    first = found.groupBy("name").agg(F.min_by(F.struct("chunk_id", "start", "stop"), "pos").alias("f")).select("name", "f.*")
    texts = chunks.select("chunk_id", "text")
    return first.join(texts, "chunk_id").select("name", F.trim(F.expr("substring(text, start + 1, stop - start)")).alias("statute"))


def item_texts(entities: DataFrame, chunks: DataFrame) -> DataFrame:
    """item_type, name, text of all retrieval items. entities: name, type, description, source_chunk_ids."""
    statutes = resolved_sections(entities.where("type = 'SECTION'"), chunks)
    joined = entities.join(statutes, "name", "left")
    description = F.coalesce("description", F.lit(""))
    section = F.concat(F.lit("SECTION: "), F.col("name"), F.lit("\n"), F.substring(F.coalesce("statute", description), 1, 1500))
    text = F.when(F.col("type") == "SECTION", section).otherwise(F.concat("type", F.lit(": "), "name", F.lit(" - "), description))
    own = joined.select(F.lit("entity").alias("item_type"), "name", text.alias("text"))
    return own.unionByName(chunks.select(F.lit("chunk").alias("item_type"), F.col("chunk_id").alias("name"), F.substring("text", 1, 800).alias("text")))


def fuzzy_contains(query: Column, keyword: Column) -> Column:
    """the keyword stands in the query, or does with one of its characters left out, or the query has one too many.

    Only keywords of five characters and more may differ.
    """
    n = F.length(keyword)
    dropped = F.exists(F.sequence(F.lit(1), n), lambda i: F.contains(query, F.concat(F.substr(keyword, F.lit(1), i - 1), F.substr(keyword, i + 1, n))))
    windows = F.filter(F.sequence(F.lit(1), F.greatest(F.length(query) - n + 1, F.lit(1))), lambda s: F.length(F.substr(query, s, n + 1)) >= n)
    spare = F.exists(
        windows,
        lambda s: F.exists(F.sequence(F.lit(1), n + 1), lambda i: F.concat(F.substr(F.substr(query, s, n + 1), F.lit(1), i - 1), F.substr(F.substr(query, s, n + 1), i + 1, n + 1)) == keyword),
    )
    # one edit leaves one half of the keyword as it is
    half = F.floor(n / 2).cast("int")
    near = F.contains(query, F.substr(keyword, F.lit(1), half)) | F.contains(query, F.substr(keyword, half + 1, n))
    return F.when(F.contains(query, keyword), True).when((n < 5) | ~near, False).otherwise(dropped | spare)


def matched_keywords(queries: DataFrame, words: DataFrame, fuzzy: bool = True) -> DataFrame:
    """query_id, keyword of each dictionary word that a question holds. words: keyword, of fixed size."""
    own = F.broadcast(words.select("keyword").distinct())
    held = fuzzy_contains(F.col("text"), F.col("keyword")) if fuzzy else F.contains("text", "keyword")
    return queries.join(own, held).select("query_id", "keyword")


def matched_words(queries: DataFrame, words: DataFrame, block: int = 200_000) -> DataFrame:
    """query_id, keyword of each word of a dictionary of any size that a question holds, by one automaton in each task, ``block`` words at a time."""
    kind = queries.schema["query_id"].dataType
    held = words_within(queries.select(F.col("query_id").cast("string"), "text"), words.select(F.col("keyword").alias("word")).distinct(), block)
    return held.select(F.col("community").cast(kind).alias("query_id"), F.col("word").alias("keyword"))


def suppress_contained(matched: DataFrame) -> DataFrame:
    """Without the keywords that a longer matched one of the same question contains."""
    longer = matched.select("query_id", F.col("keyword").alias("other"))
    inside = F.contains(longer["other"], matched["keyword"]) & (F.length(longer["other"]) > F.length(matched["keyword"]))
    return matched.join(longer, (matched["query_id"] == longer["query_id"]) & inside, "left_anti")


def expansion_boost(matched: DataFrame, expansions: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """query_id, name, score of the sections that matched keywords stand for; of several the greatest."""
    entries = expansions.join(expansions.groupBy("keyword").agg(F.count("*").alias("n")), "keyword")
    name = F.concat("prefix", F.lit(" มาตรา "), "section")
    score = s.expansion_base + (F.col("n") - (F.col("ord") - 1)) * s.expansion_step
    return matched.join(entries, "keyword").groupBy("query_id", name.alias("name")).agg(F.round(F.max(score), 6).alias("score"))


def mentioned_sections(queries: DataFrame, prefixes: list[str]) -> DataFrame:
    """query_id, name: each number that a question names in Arabic digits, bare and under each law."""
    n = F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"มาตรา\s*([0-9]+(?:/[0-9]+)?)"), F.lit(1))))
    numbers = queries.select("query_id", n.alias("n"))
    names = F.array(*(F.concat(F.lit(f"[{p}] มาตรา "), F.col("n")) for p in prefixes), F.concat(F.lit("มาตรา "), F.col("n")))
    return numbers.select("query_id", F.explode(names).alias("name"))


def concept_sections(queries: DataFrame, entities: DataFrame, adj: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """query_id, name, score of the sections beside a concept that the question names.

    An equi-join, as the concepts grow with the graph: the first ``HEAD`` characters of each concept's name are looked up among
    the question's substrings of that length, then the whole name is compared in place.
    """
    concepts = entities.where("type = 'LEGAL_CONCEPT' and name <> ''").select("name", F.substring("name", 1, HEAD).alias("head")).distinct()
    lengths = F.broadcast(concepts.select(F.length("head").alias("len")).distinct())  # at most HEAD rows
    places = queries.join(lengths, F.length("text") >= F.col("len")).select("query_id", "text", F.explode(F.expr("transform(sequence(1, length(text) - len + 1), i -> named_struct('at', i, 'head', substring(text, i, len)))")).alias("p"))
    whole = F.substr(F.col("text"), F.col("p.at"), F.length("name")) == F.col("name")
    held = places.join(concepts, F.col("p.head") == F.col("head")).where(whole).select("query_id", "name").distinct()
    sections = entities.where("type = 'SECTION'").select(F.col("name").alias("dst"))
    near = held.join(adj.select("src", "dst"), held["name"] == adj["src"]).join(sections, "dst", "left_semi")
    return near.select("query_id", F.col("dst").alias("name")).distinct().withColumn("score", F.lit(s.concept_floor))


def chunk_entities(chunk_hits: DataFrame, entities: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """query_id, name, score: entities of the hit chunks; the first chunk by rank that names one sets its score.

    chunk_hits: query_id, chunk_id, score, rn.
    """
    of = entities.select("name", F.posexplode("source_chunk_ids").alias("pos", "chunk_id"))
    found = chunk_hits.join(of, "chunk_id")
    return found.groupBy("query_id", "name").agg(F.round(F.min_by("score", F.struct("rn", "pos")) * s.chunk_discount + 1e-9, 6).alias("score"))


def trimmed(name: Column, description: Column, limit: int = 1200) -> Column:
    """A section's description up to where another section is first named, beyond its first 40 characters; else at most ``limit`` characters."""
    own = _number(name)
    spans = F.filter(match_spans(description, r"\s+มาตรา\s+[0-9๐-๙]+(?:/[0-9๐-๙]+)?"), lambda m: (m["start"] > 40) & (_number(m["text"]) != own))
    at = F.get(spans, F.lit(0))["start"]
    head = F.substring(description, 1, limit)
    blank = limit - F.instr(F.reverse(head), " ")
    short = F.when((F.instr(head, " ") > 0) & (blank > 400), F.concat(F.rtrim(F.substr(description, F.lit(1), blank)), F.lit(" ..."))).otherwise(F.concat(head, F.lit("...")))
    return F.when(at.isNotNull(), F.rtrim(F.substr(description, F.lit(1), at))).when(F.length(description) > limit, short).otherwise(description)


def context(hits: DataFrame, entities: DataFrame, chunks: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """query_id, context: the hits' lines by score, then the first texts that they come from.

    hits: query_id, name, type, score. A question's hits are of stated number; so are its source texts.
    """
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "name")
    known = entities.select("name", F.coalesce("description", F.lit("")).alias("description"), "source_chunk_ids")
    top = hits.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= s.returned).join(known, "name")
    line = F.concat(F.lit("["), "type", F.lit("] "), "name", F.lit(": "), "description")
    lines = top.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rn", line.alias("line")))).alias("l"))
    named = top.select("query_id", "rn", F.posexplode("source_chunk_ids").alias("pos", "chunk_id")).groupBy("query_id", "chunk_id").agg(F.min(F.struct("rn", "pos")).alias("at"))
    first = named.withColumn("k", F.row_number().over(Window.partitionBy("query_id").orderBy("at", "chunk_id"))).where(F.col("k") <= s.source_texts)
    texts = first.join(chunks.select("chunk_id", "text"), "chunk_id").groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("k", F.substring("text", 1, s.source_chars).alias("text")))).alias("t"))
    body = F.concat(F.lit("== Entity Context ==\n"), F.array_join(F.transform("l", lambda x: x["line"]), "\n"), F.lit("\n\n== Source Text ==\n"), F.array_join(F.transform(F.coalesce("t", F.array().cast("array<struct<k:int,text:string>>")), lambda x: x["text"]), "\n"))
    return lines.join(texts, "query_id", "left").select("query_id", body.alias("context"))


def with_bodies(queries: DataFrame, hits: DataFrame, items: DataFrame, k: int, chars: int) -> DataFrame:
    """Questions with the first ``chars`` characters of their k best items behind them; off at k = 0.

    hits: query_id, item_id, rn; items: item_id, text.
    """
    if not k:
        return queries
    bodies = hits.where(F.col("rn") <= k).join(items, "item_id").groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rn", F.substring("text", 1, chars).alias("text")))).alias("b"))
    more = F.array_join(F.transform("b", lambda x: x["text"]), " ")
    return queries.join(bodies, "query_id", "left").select("query_id", F.concat_ws(" ", "text", more).alias("text"))


def ranked_items(
    items: DataFrame, queries: DataFrame, s: Settings = DEFAULT, similarity: Callable[[DataFrame], DataFrame] | None = None, scorer: Callable[[DataFrame], DataFrame] | None = None
) -> DataFrame:
    """query_id, item_id, score, rn: the retrieval stack. Sparse channels, and a dense one where there is a ``similarity``, fused by rank.

    similarity: from questions to query_id, item_id, score of the pairs it knows; then the pool is blended with it unless ``s.rerank`` is
    off. With ``s.hyde_dense_k`` it is asked again with the best items' beginnings behind the questions, weighted by ``s.hyde_dense_weight``.
    ``s.specificity_weight`` mixes in the prior for longer texts; scorer: adds ``ce`` to the head of ``s.ce_top_n``, whose texts come as ``text`` of
    at most ``s.ce_doc_chars`` characters.
    """
    channels = {"bm25": rank.top_k(rank.bm25(items, queries, s, k=s.fetch), s.fetch), "tfidf": rank.top_k(rank.tfidf(items, queries, s, k=s.fetch), s.fetch)}
    known = None
    if similarity is not None:
        known = similarity(queries)
        if s.hyde_dense_k:
            again = similarity(with_bodies(queries, channels["bm25"], items, s.hyde_dense_k, s.hyde_chars)).withColumnRenamed("score", "more")
            both = known.join(again, ["query_id", "item_id"], "full")
            weight = s.hyde_dense_weight
            known = both.select("query_id", "item_id", ((1 - weight) * F.coalesce("score", F.lit(0.0)) + weight * F.coalesce("more", F.lit(0.0))).alias("score"))
        channels["dense"] = rank.top_k(known, s.fetch)
    pool = rank.top_k(rank.fuse(channels, s), max(s.pool, s.returned)).drop("rn")
    if known is not None and s.rerank:
        cosine = known.select("query_id", "item_id", F.col("score").alias("cosine"))
        pool = pool.withColumnRenamed("score", "rrf").join(cosine, ["query_id", "item_id"], "left").withColumn("cosine", F.coalesce("cosine", F.lit(0.0)))
        pool = rank.blend(pool, "rrf", "cosine", s.rerank_alpha).select("query_id", "item_id", "score")
    if s.specificity_weight:
        pool = pool.join(items, "item_id").select("query_id", "item_id", F.round(rank.specificity(F.col("text"), s.specificity_weight, F.col("score")), 8).alias("score"))
    hits = rank.top_k(pool, s.returned)
    if scorer is None or not s.ce_top_n:
        return hits
    texts = items.select("item_id", F.substring("text", 1, s.ce_doc_chars).alias("text"))
    return rank.rerank(hits, lambda head: scorer(head.join(texts, "item_id")).drop("text"), s)


def matched_entities(queries: DataFrame, entities: DataFrame, hits: DataFrame, expansions: DataFrame, adj: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """query_id, name, type, score, place: what local search starts from, in the order in which it goes on from it.

    hits: query_id, kind ('entity' or 'chunk'), name, score, rn. A hit chunk stands for its entities; of several hits the first by rank
    sets an entity's score. Expansions and concepts raise the score of what they name, explicit mentions do not; what was
    not hit is put in front: mentions before concepts before expansions, the greater score first.
    """
    w = lambda *by: Window.partitionBy("query_id").orderBy(*by)
    own = hits.where("kind = 'entity'").select("query_id", "name", "score", "rn", F.lit(-1).alias("pos"))
    of = entities.select("name", F.posexplode("source_chunk_ids").alias("pos", "chunk_id"))
    via = hits.where("kind = 'chunk'").withColumnRenamed("name", "chunk_id").join(of, "chunk_id").select("query_id", "name", (F.col("score") * s.chunk_discount).alias("score"), "rn", "pos")
    first = own.unionByName(via).groupBy("query_id", "name").agg(F.min_by(F.struct("score", "rn", "pos"), F.struct("rn", "pos")).alias("f")).select("query_id", "name", "f.*")
    boosted = expansion_boost(suppress_contained(matched_words(queries, expansions)), expansions, s).withColumn("step", F.lit(2))
    concept = concept_sections(queries, entities, adj, s).withColumn("step", F.lit(1))
    raised = boosted.unionByName(concept.select(*boosted.columns)).groupBy("query_id", "name").agg(F.max("score").alias("boost"), F.max("step").alias("step"))
    named = mentioned_sections(queries, ["อาญา", "แพ่ง", "รธน"]).distinct().withColumn("mention", F.lit(1.0))
    known = entities.select("name", "type").distinct()
    every = first.join(raised, ["query_id", "name"], "full").join(named, ["query_id", "name"], "full").join(known, "name")
    score = F.coalesce(F.greatest("score", "boost"), "mention")
    place = F.row_number().over(w(F.when(F.col("rn").isNotNull(), 3).otherwise(F.coalesce("step", F.lit(0))), F.coalesce("rn", F.lit(0)), F.coalesce("pos", F.lit(0)), F.desc("score"), "name")).cast("long")
    return every.select("query_id", "name", "type", F.round(score + 1e-9, 6).alias("score"), "rn", "pos", "step").withColumn("place", place).select("query_id", "name", "type", "score", "place")


def local_search(queries: DataFrame, entities: DataFrame, chunks: DataFrame, edges: DataFrame, expansions: DataFrame, s: Settings = DEFAULT, **models) -> DataFrame:
    """query_id, name, type, description, score, origin: what local search finds, each name once, by its greatest score.

    Fused sparse retrieval over all items, boosts and mentions, then one hop over the graph from the first ``traversal`` entities of the
    list: the neighbours, and the edges as rows named '(entity) -> (neighbour)'. Of equal scores entities come before neighbours before edges.
    The items' texts and the graph are worked out once and written to the shared folder. models: those of ``ranked_items``.
    """
    items = cut_lineage(item_texts(entities, chunks).select(F.concat_ws("|", "item_type", "name").alias("item_id"), "text"))
    adj = cut_lineage(graph.adjacency(graph.simple_edges(graph.within(edges, entities))))
    hits = ranked_items(items, queries, s, **models).select("query_id", F.substring_index("item_id", "|", 1).alias("kind"), F.expr("substring(item_id, instr(item_id, '|') + 1)").alias("name"), "score", "rn")
    found = cut_lineage(matched_entities(queries, entities, hits, expansions, adj, s))
    known = entities.select("name", "type", F.coalesce("description", F.lit("")).alias("description")).groupBy("name", "type").agg(F.min("description").alias("description"))
    start = found.where(F.col("place") <= s.traversal)
    near = graph.expand(start, adj, s.neighbour_discount).select("query_id", "name", "score", F.lit("").alias("type"), F.lit("").alias("description"), F.lit(1).alias("o"))
    edge = F.coalesce("description", F.lit("")).alias("description")
    beside = graph.expand_edges(start, adj, s.edge_discount).select("query_id", "name", "score", "type", edge, F.lit(2).alias("o"))
    # entities' descriptions are long, so only what is found is joined to them
    every = found.select("query_id", "name", "score", "type", F.lit("").alias("description"), F.lit(0).alias("o")).unionByName(near).unionByName(beside)
    best = every.groupBy("query_id", "name").agg(F.max(F.struct(F.round(F.col("score") + 1e-9, 6).alias("score"), (-F.col("o")).alias("o"), "type", "description")).alias("b")).select("query_id", "name", "b.*")
    about = known.groupBy("name").agg(F.max("description").alias("greatest"), F.max(F.struct("type", "description")).alias("last"))
    own = F.col("o") == 0
    named = best.where("o > -2").drop("description").join(about, "name").select("query_id", "name", F.when(own, F.col("type")).otherwise(F.col("last.type")).alias("type"), F.when(own, F.col("greatest")).otherwise(F.col("last.description")).alias("description"), "score", F.when(own, "entity").otherwise("neighbour").alias("origin"))
    return named.unionByName(best.where("o = -2").select("query_id", "name", "type", "description", "score", F.lit("edge").alias("origin")))


def global_search(queries: DataFrame, reports: DataFrame, s: Settings = DEFAULT, words_block: int = 200_000) -> DataFrame:
    """query_id, community, score, rn: the words of a question that stand in a report, plus its importance.

    reports: community, title, summary, importance. Any word of a question may be any substring of a report. The distinct words
    of all questions, a set of stated size, go to the tasks in blocks of at most ``words_block``; each report is read once by one
    automaton over them. A word counts as often as the question has it.
    """
    words = queries.select("query_id", F.explode(F.filter(F.split(F.lower("text"), r"\s+"), lambda x: x != "")).alias("word"))
    body = reports.where("summary is not null and summary <> ''").select("community", "importance", F.lower(F.concat_ws(" ", "title", "summary")).alias("body"))
    held = words_within(body.select("community", "body"), words.select("word").distinct(), words_block)
    counted = words.groupBy("query_id", "word").agg(F.count("*").alias("times"))
    hits = held.join(counted, "word").join(body.select("community", "importance"), "community").groupBy("query_id", "community", "importance").agg(F.sum("times").alias("n"))
    scored = hits.select("query_id", F.col("community").alias("item_id"), F.round(F.col("n") + F.col("importance"), 6).alias("score"))
    return rank.top_k(scored, s.top_communities).withColumnRenamed("item_id", "community")


def words_within(bodies: DataFrame, words: DataFrame, block: int) -> DataFrame:
    """community, word: each word that stands anywhere in a body. bodies: an id and a text; the id comes as ``community``."""
    spark = bodies.sparkSession
    n = max(1, -(-words.count() // block))
    found = None
    for b in range(n):
        known = spark.sparkContext.broadcast([r["word"] for r in words.where(F.pmod(F.xxhash64("word"), F.lit(n)) == b).collect()])

        def run(batches: Iterator[pa.RecordBatch], known=known) -> Iterator[pa.RecordBatch]:
            automaton = ahocorasick.Automaton()
            for w in known.value:
                automaton.add_word(w, w)
            if not len(automaton):
                return
            automaton.make_automaton()
            for batch in batches:
                rows = [(c, w) for c, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if t for w in {w for _, w in automaton.iter(t)}]
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string())], ["community", "word"])

        part = bodies.mapInArrow(run, "community string, word string")
        found = part if found is None else found.unionByName(part)
    return found


def hybrid(local: DataFrame, global_: DataFrame) -> DataFrame:
    """Local hits, then communities: query_id, part, name, score."""
    return local.select("query_id", F.lit("local").alias("part"), "name", "score").unionByName(global_.select("query_id", F.lit("global").alias("part"), F.col("community").alias("name"), "score"))
