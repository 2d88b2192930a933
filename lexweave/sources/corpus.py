"""Statute files in, sections out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.functions.text import normalize, unix_newlines
from lexweave.operators import extract


def read_files(spark: SparkSession, folder: str, skip_stems: tuple[str, ...] = ()) -> DataFrame:
    """Path, law_name (the file's folder), chapter (its stem), text of every .txt below the folder, line ends as \\n.

    An unreadable file fails its task only if Spark is told to (spark.sql.files.ignoreCorruptFiles).
    """
    raw = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.txt").text(folder, wholetext=True)
    path = F.url_decode(F.replace("_metadata.file_path", F.lit("+"), F.lit("%2B")))
    parts = F.split(path, "/")
    out = raw.select(path.alias("path"), F.element_at(parts, -2).alias("law_name"), F.regexp_replace(F.element_at(parts, -1), r"\.txt$", "").alias("chapter"), unix_newlines(F.col("value")).alias("text"))
    return out.where(~F.col("chapter").isin(*skip_stems)) if skip_stems else out


def split_sections(files: DataFrame) -> DataFrame:
    """law_name, chapter, ord, section_number, raw_text, char_count of each section of each file.

    Text before the first header is ``preamble``, a file without one is the section ``0``; null and empty files give none.
    """
    texts = files.select("path", "law_name", "chapter", normalize(F.col("text")).alias("text")).where("text <> ''")
    spans = extract.header_spans(texts.select(F.col("path").alias("chunk_id"), "text"))
    joined = spans.join(texts, spans["chunk_id"] == texts["path"])
    body = F.trim(F.expr("substring(text, start + 1, length)"))
    return joined.select("law_name", "chapter", "ord", F.col("number").alias("section_number"), body.alias("raw_text"), F.length(body).cast("long").alias("char_count"))
