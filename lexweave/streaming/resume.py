"""Extraction that resumes: chunk files arrive in a folder, each is worked on once, whatever stops in between.

The reference keeps a list of finished chunks in a file; here the file source and its checkpoint do. A batch's edges are
written under its number, so a batch that is repeated after a failure replaces what it wrote before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lexweave import schemas
from lexweave.operators import extract


def pending(chunks: DataFrame, done: DataFrame) -> DataFrame:
    """Chunks that are not done."""
    return chunks.join(done.select("chunk_id").distinct(), "chunk_id", "left_anti")


def extract_new(spark: SparkSession, chunks_dir: str, edges_dir: str, checkpoint: str, files_per_batch: int = 100) -> StreamingQuery:
    """Works through the Parquet files that are new since the last call and stops; edges in ``edges_dir``, by batch."""
    source = spark.readStream.schema(schemas.CHUNK).option("maxFilesPerTrigger", files_per_batch).parquet(chunks_dir)

    def write(batch: DataFrame, number: int) -> None:
        extract.edges(batch.select("chunk_id", "law_name", "chapter", "text")).write.mode("overwrite").parquet(f"{edges_dir}/batch={number}")

    return source.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_edges(spark: SparkSession, edges_dir: str) -> DataFrame:
    """All edges written so far, each source, target and type once with its earliest batch's weight."""
    rows = spark.read.parquet(edges_dir)
    return rows.groupBy("source", "target", "type").agg(F.min_by("weight", "batch").alias("weight"), F.count("*").alias("n_rows"))
