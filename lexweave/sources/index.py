"""The index's tables as files, question sets, and what is handed to other systems."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from lexweave import schemas
from lexweave.functions.text import display_label
from lexweave.operators.graph import within

# The colours of nodes by type, and of any other.
COLOURS = {"LAW": "#e74c3c", "SECTION": "#3498db", "OFFENSE": "#e67e22", "PENALTY": "#9b59b6", "LEGAL_CONCEPT": "#2ecc71", "ORGANIZATION": "#1abc9c", "PERSON_TYPE": "#f1c40f", "COURT": "#34495e", "LEGAL_PROCEDURE": "#95a5a6"}
OTHER_COLOUR = "#bdc3c7"


def read_index(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """S3: one of the four tables; its list columns, JSON text in the files, as arrays."""
    schema, lists = schemas.INDEX[name]
    stored = StructType([StructField(f.name, StringType()) if f.name in lists else f for f in schema])
    df = spark.read.schema(stored).parquet(f"{folder}/{name}.parquet")
    return df.withColumns({c: F.from_json(c, "array<string>") for c in lists})


def write_index(df: DataFrame, folder: str, name: str) -> None:
    """The table with its lists as JSON text."""
    schema, lists = schemas.INDEX[name]
    df.select(*(F.to_json(c).alias(c) if c in lists else F.col(c) for c in schema.names)).write.mode("overwrite").parquet(f"{folder}/{name}.parquet")


def write_json(df: DataFrame, path: str) -> None:
    """Rows as JSON lines."""
    df.write.mode("overwrite").json(path)


def write_chunk_texts(chunks: DataFrame, path: str) -> None:
    """One folder per chunk with its text."""
    chunks.select("chunk_id", F.col("text").alias("value")).repartition("chunk_id").write.mode("overwrite").partitionBy("chunk_id").text(path)


def graph_nodes(entities: DataFrame) -> DataFrame:
    """Id, label, type of each node."""
    return entities.select(F.col("name").alias("id"), F.when(F.col("name").startswith("["), display_label(F.col("name"))).otherwise(F.col("name")).alias("label"), "type")


def graph_links(edges: DataFrame, entities: DataFrame) -> DataFrame:
    """Source, target, type, weight of the edges with both ends."""
    return within(edges, entities).select("source", "target", "type", "weight")


def write_graph(entities: DataFrame, edges: DataFrame, path: str) -> None:
    write_json(graph_nodes(entities), f"{path}/nodes")
    write_json(graph_links(edges, entities), f"{path}/edges")


def store_nodes(entities: DataFrame, members: DataFrame) -> DataFrame:
    """S11, prepared: name, type, description, colour, source chunks (in one string), community of each node for a graph store, in which names are unique by type."""
    colour = F.lit(OTHER_COLOUR)
    chunks = F.array_join("source_chunk_ids", ", ") if "source_chunk_ids" in entities.columns else F.lit("")
    for kind, value in COLOURS.items():
        colour = F.when(F.col("type") == kind, value).otherwise(colour)
    return entities.join(members.select("name", "community"), "name", "left").select("name", "type", "description", colour.alias("colour"), chunks.alias("source_chunks"), "community")


def store_edges(edges: DataFrame, entities: DataFrame) -> DataFrame:
    """S11, prepared: source, source_type, target, target_type, type (upper case, blanks as underscores), description, weight of the edges with both ends."""
    kinds = entities.select("name", F.col("type").alias("kind")).distinct()
    both = edges.join(kinds.withColumnsRenamed({"name": "source", "kind": "source_type"}), "source").join(kinds.withColumnsRenamed({"name": "target", "kind": "target_type"}), "target")
    return both.select("source", "source_type", "target", "target_type", F.upper(F.replace("type", F.lit(" "), F.lit("_"))).alias("type"), "description", "weight")


def send(df: DataFrame, connect, batch: int = 500) -> None:
    """Hands rows to a store, a connection per task. ``connect()`` gives an object with ``write(list of dicts)`` and ``close()``."""

    def run(rows) -> None:
        store, held = connect(), []
        try:
            for r in rows:
                held.append(r.asDict(recursive=True))
                if len(held) >= batch:
                    store.write(held)
                    held = []
            if held:
                store.write(held)
        finally:
            store.close()

    df.foreachPartition(run)


def read_qa(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of question, ground_truth, relevant_sections; malformed rows and unknown keys are errors."""
    wanted = set(schemas.QA_PAIR.names)
    keys = spark.read.option("multiLine", True).option("mode", "FAILFAST").json(path).columns
    unknown = sorted(set(keys) - wanted)
    if unknown:
        raise ValueError(f"unknown keys in {path}: {unknown}")
    return spark.read.schema(schemas.QA_PAIR).option("multiLine", True).option("mode", "FAILFAST").json(path)


def benchmark_items(rows: DataFrame, law: str, limit: int | None = None) -> DataFrame:
    """Rows of which any relevant law's name contains ``law``; with a limit the first so many by question."""
    found = rows.where(F.exists("relevant_laws", lambda x: x["law_name"].contains(law)))
    return found.orderBy("question").limit(limit) if limit else found


def vector_key(items: DataFrame, model: str) -> str:
    """The cache key of a set of item vectors. Texts are digested one by one, the digests summed, so order is no matter."""
    digest = F.conv(F.substring(F.sha1(F.concat(F.lit(model + "\x1f"), F.coalesce("text", F.lit("")), F.lit("\x1e"))), 1, 15), 16, 10).cast("decimal(38,0)")
    n, total = items.agg(F.count("*"), F.coalesce(F.sum(digest), F.lit(0))).first()
    import hashlib

    return hashlib.sha1(json.dumps([model, n, str(total)]).encode()).hexdigest()[:16]


def cached_vectors(items: DataFrame, model: str, encode, folder: str) -> DataFrame:
    """item_id and vector, read from the cache if it holds these texts, else encoded and written."""
    spark = items.sparkSession
    path = f"{folder}/{model.replace('/', '_')}-{vector_key(items, model)}.parquet"
    try:
        return spark.read.parquet(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
    encode(items).select("item_id", "vector").write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
