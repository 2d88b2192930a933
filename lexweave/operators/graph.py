"""The knowledge graph as edge tables: dedup, endpoint check, adjacency, traversal, components, communities, reports.

entities: name, type, description, ord. edges: source, target, type, description, weight, ord. The order columns stand for
the reference's insertion order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexweave.session import cut_lineage


def distinct_relationships(edges: DataFrame) -> DataFrame:
    """A2: one edge per source, target and type, with the first one's description and weight and the number of its rows."""
    first = F.min_by(F.struct("description", "weight"), "ord").alias("f")
    return edges.groupBy("source", "target", "type").agg(first, F.min("ord").alias("ord"), F.count("*").alias("n_rows")).select("source", "target", "type", "f.description", "f.weight", "ord", "n_rows")


def within(edges: DataFrame, entities: DataFrame) -> DataFrame:
    """Edges of which both ends are entities."""
    names = entities.select("name").distinct()
    return edges.join(names.withColumnRenamed("name", "source"), "source", "left_semi").join(names.withColumnRenamed("name", "target"), "target", "left_semi")


def simple_edges(edges: DataFrame) -> DataFrame:
    """One undirected edge a < b per pair of ends, with the last relationship's attributes; loops stay."""
    pair = edges.select(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b"), "type", "description", "weight", "ord")
    last = F.max_by(F.struct("type", "description", "weight"), "ord").alias("l")
    return pair.groupBy("a", "b").agg(last).select("a", "b", "l.type", "l.description", "l.weight")


def adjacency(simple: DataFrame) -> DataFrame:
    """Both directions of each undirected edge, a loop once: src, dst, type, description, weight."""
    rest = ("type", "description", "weight")
    back = simple.where("a <> b").select(F.col("b").alias("src"), F.col("a").alias("dst"), *rest)
    return simple.select(F.col("a").alias("src"), F.col("b").alias("dst"), *rest).unionByName(back)


def degrees(simple: DataFrame) -> DataFrame:
    return adjacency(simple).groupBy(F.col("src").alias("name")).agg(F.count("*").alias("degree"))


def expand(hits: DataFrame, adj: DataFrame, discount: float) -> DataFrame:
    """Neighbours of hits (query_id, name, score) with the discounted score: query_id, name, score, via."""
    return hits.join(adj.select("src", "dst"), hits["name"] == F.col("src")).select("query_id", F.col("dst").alias("name"), (F.col("score") * discount).alias("score"), F.col("src").alias("via"))


def expand_edges(hits: DataFrame, adj: DataFrame, discount: float) -> DataFrame:
    """One row per edge at a hit, named '(hit) -> (neighbour)', with the discounted score and the edge's description."""
    name = F.concat(F.lit("("), F.col("src"), F.lit(") -> ("), F.col("dst"), F.lit(")"))
    own = hits.select("query_id", F.col("name").alias("src"), "score")
    return own.join(adj, "src").select("query_id", name.alias("name"), (F.col("score") * discount).alias("score"), "description", "type")


def k_hop(seeds: DataFrame, adj: DataFrame, depth: int) -> DataFrame:
    """name, hops: every node within ``depth`` of a seed and its least distance. The frontier is what a round adds."""
    reached = seeds.select("name").distinct().withColumn("hops", F.lit(0).cast("long"))
    frontier = reached
    pairs = adj.select("src", "dst").distinct()
    for hop in range(1, depth + 1):
        found = frontier.join(pairs, frontier["name"] == pairs["src"]).select(F.col("dst").alias("name")).distinct()
        fresh = found.join(reached.select("name"), "name", "left_anti").withColumn("hops", F.lit(hop).cast("long"))
        frontier = cut_lineage(fresh)
        reached = reached.unionByName(frontier)
    return reached


def _at_nodes(links: DataFrame, values: DataFrame, share: float = 0.002) -> DataFrame:
    """links with their node's values; u is the node, d the number of its links. The nodes of at least a share of all links, of which there are at most 1 / share, are broadcast."""
    hot = F.broadcast(values.where(F.col("d") >= F.greatest(F.lit(1000.0), share * values.agg(F.sum("d")).scalar())))
    return links.join(hot, "u", "left_anti").join(values, "u").unionByName(links.join(hot, "u"))


def components(nodes: DataFrame, simple: DataFrame, rounds: int = 60) -> DataFrame:
    """Name, component (the least name of its component), by large-star and small-star contraction.

    Each round links every node's neighbours to its least one, so a path halves and stars stay stars; the edges of a round
    are written to the shared folder. A node of a third of all edges is grouped by partial minima and met by broadcast.
    """
    edges = cut_lineage(simple.where("a <> b").select("a", "b").distinct())
    for _ in range(rounds):
        # large star: links of a node to its greater neighbours go to its least neighbour
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count("*").alias("d"))
        large = _at_nodes(both, least).where("v > u").select(F.col("v").alias("x"), F.col("m").alias("y")).where("x <> y").distinct()
        # small star: a node and its lesser neighbours go to the least of them
        down = large.select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v"))
        low = down.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("d"))
        joined = _at_nodes(down, low)
        small = joined.where("v <> m").select(F.col("v").alias("b"), F.col("m").alias("a")).unionByName(low.select(F.col("u").alias("b"), F.col("m").alias("a"))).select("a", "b").distinct()
        new = cut_lineage(small)
        changed = new.join(edges, ["a", "b"], "left_anti").limit(1).count() + edges.join(new, ["a", "b"], "left_anti").limit(1).count()
        edges = new
        if not changed:
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = edges.select(F.col("b").alias("name"), F.col("a").alias("component"))
    return nodes.select("name").distinct().join(roots, "name", "left").select("name", F.coalesce("component", "name").alias("component"))


def modularity(labels: DataFrame, simple: DataFrame) -> DataFrame:
    """One row: the modularity of a partition (name, community) of the unweighted graph without loops."""
    e = simple.where("a <> b").select("a", "b")
    m = e.agg(F.count("*").alias("m"))
    la, lb = labels.select(F.col("name").alias("a"), F.col("community").alias("ca")), labels.select(F.col("name").alias("b"), F.col("community").alias("cb"))
    tagged = e.join(la, "a").join(lb, "b")
    inner = tagged.where("ca = cb").groupBy(F.col("ca").alias("community")).agg(F.count("*").alias("inner"))
    degree = tagged.select(F.explode(F.array("ca", "cb")).alias("community")).groupBy("community").agg(F.count("*").alias("d"))
    parts = degree.join(inner, "community", "left").crossJoin(F.broadcast(m))  # m is one row
    term = F.coalesce("inner", F.lit(0)) / F.col("m") - F.pow(F.col("d") / (2 * F.col("m")), 2)
    return parts.agg(F.round(F.sum(term), 6).alias("modularity"), F.count("*").alias("n_communities"))


def communities(nodes: DataFrame, simple: DataFrame, rounds: int = 8) -> DataFrame:
    """Name, community by deterministic label moving: each round every second node, by hash and round, takes the label
    of greatest modularity gain among its neighbours'. A label is the name of a node. Written out after each round. ``rounds``
    is a parameter of the method, which has no end of its own: labels need not settle.
    """
    adj = cut_lineage(adjacency(simple.where("a <> b")).select("src", "dst").distinct())
    degree = adj.groupBy(F.col("src").alias("name")).agg(F.count("*").alias("k"))
    m2 = adj.agg(F.count("*").alias("m2"))
    labels = cut_lineage(nodes.select("name").distinct().withColumn("community", F.col("name")))
    for r in range(rounds):
        weights = labels.join(degree, "name").groupBy("community").agg(F.sum("k").alias("total"))
        near = adj.join(labels.select(F.col("name").alias("dst"), "community"), "dst").groupBy("src", "community").agg(F.count("*").alias("links"))
        own = labels.select(F.col("name").alias("src"), F.col("community").alias("own"))
        gain = near.join(weights, "community").join(degree.withColumnRenamed("name", "src"), "src").join(own, "src").crossJoin(F.broadcast(m2))
        rest = F.col("total") - F.when(F.col("community") == F.col("own"), F.col("k")).otherwise(0)
        gain = gain.withColumn("gain", F.round(F.col("links") - F.col("k") * rest / F.col("m2"), 9))
        best = gain.groupBy("src").agg(F.max(F.struct("gain", (F.col("community") == F.col("own")).alias("stay"), "community")).alias("best")).select(F.col("src").alias("name"), F.col("best.community").alias("to"), F.col("best.stay").alias("stay"))
        moving = F.pmod(F.xxhash64("name", F.lit(r)), F.lit(2)) == 0
        new = labels.join(best, "name", "left").select("name", F.when(moving & F.col("to").isNotNull(), F.col("to")).otherwise(F.col("community")).alias("community"))
        labels = cut_lineage(new)
    return labels


def community_reports(members: DataFrame, edges: DataFrame) -> DataFrame:
    """Community, title, summary, importance, n_members, n_relationships of each community.

    members: community, name, type, ord. Only the few names that a report shows are ranked and gathered, the best of each task
    before their shuffle; sizes and last names are plain sums.
    """
    w = Window.partitionBy("community", "type").orderBy("ord", "name")
    ranked = members.withColumn("rn", F.row_number().over(w))
    shown = ranked.where("rn <= 5").groupBy("community", "type").agg(F.transform(F.array_sort(F.collect_list(F.struct("rn", "name"))), lambda x: x["name"]).alias("names"))
    sizes = members.groupBy("community", "type").agg(F.count("*").alias("n"), F.max_by("name", F.struct("ord", "name")).alias("last"))
    kinds = shown.join(sizes, ["community", "type"])
    pick = lambda kind, col: F.first(F.when(F.col("type") == kind, F.col(col)), ignorenulls=True)
    wide = kinds.groupBy("community").agg(
        F.sum("n").alias("n_members"), *(pick(t, "names").alias(t) for t in ("SECTION", "OFFENSE", "LAW", "LEGAL_CONCEPT", "PENALTY")), *(pick(t, "n").alias(f"n_{t}") for t in ("SECTION", "OFFENSE")), pick("SECTION", "last").alias("last_section")
    )
    of = members.select("name", "community")
    ends = edges.join(of.withColumnsRenamed({"name": "source", "community": "c1"}), "source").join(of.withColumnsRenamed({"name": "target", "community": "c2"}), "target")
    inner = ends.where("c1 = c2").groupBy(F.col("c1").alias("community")).agg(F.count("*").alias("n_relationships"))
    j = lambda col, k: F.array_join(F.slice(col, 1, k), ", ")
    title = (
        F.when(F.col("n_OFFENSE") == 1, F.col("OFFENSE")[0])
        .when(F.col("n_OFFENSE") > 1, F.concat(F.lit("กลุ่มความผิด: "), j("OFFENSE", 3)))
        .when(F.col("n_SECTION") == 1, F.col("SECTION")[0])
        .when(F.col("n_SECTION") > 1, F.concat(F.lit("กลุ่มมาตรา "), F.col("SECTION")[0], F.lit("–"), F.col("last_section")))
        .when(F.col("LEGAL_CONCEPT").isNotNull(), F.col("LEGAL_CONCEPT")[0])
        .otherwise(F.concat(F.lit("กลุ่มที่ "), F.col("community")))
    )
    parts = F.array_compact(
        F.array(
            F.concat(F.lit("กฎหมาย: "), j("LAW", 2)),
            F.concat(F.lit("มาตรา: "), j("SECTION", 5), F.when(F.col("n_SECTION") > 5, F.concat(F.lit(" (รวม "), F.col("n_SECTION").cast("string"), F.lit(" มาตรา)"))).otherwise("")),
            F.concat(F.lit("ความผิด: "), j("OFFENSE", 3)),
            F.concat(F.lit("บทลงโทษ: "), j("PENALTY", 3)),
            F.concat(F.lit("แนวคิด: "), j("LEGAL_CONCEPT", 3)),
        )
    )
    out = wide.join(inner, "community", "left").withColumn("n_relationships", F.coalesce("n_relationships", F.lit(0)))
    summary = F.when(F.size(parts) > 0, F.array_join(parts, "; ")).otherwise("ไม่มีข้อมูล")
    importance = F.round(F.least(F.lit(1.0), (F.col("n_members") + F.col("n_relationships")) / 50.0), 6)
    return out.select("community", title.alias("title"), summary.alias("summary"), importance.alias("importance"), "n_members", "n_relationships")
