"""Ordered folds that no aggregate can express, as one pass over sorted partitions.

Rows are shuffled to their key and sorted there; the state of one key at a time is carried along, so a key may have any
number of rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BooleanType, LongType, StringType, StructField, StructType

from lexweave.config import DEFAULT, Settings
from lexweave.functions.text import arabic_digits

#: Phrases that mark a definition, an enacting clause and a penalty.
MEANS, ENACTING, PENAL = "หมายความว่า", "พระราชบัญญัตินี้", "ต้องระวางโทษ"
BATCH = 4096


def fold(df: DataFrame, keys: list[str], order: list[str], start: Callable[[], object], schema: StructType) -> DataFrame:
    """``start()`` makes a key's state, an object with ``add(row) -> results`` and ``end() -> results``."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    arrow = to_arrow_schema(schema)
    width = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, own, out = None, None, []
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if state is None or row[:width] != own:
                    if state is not None:
                        out.extend(own + r for r in state.end())
                    state, own = start(), row[:width]
                out.extend(own + r for r in state.add(row[width:]))
                if len(out) >= BATCH:
                    yield _batch(out, arrow)
                    out = []
        if state is not None:
            out.extend(own + r for r in state.end())
        if out:
            yield _batch(out, arrow)

    return df.repartition(n, *keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


class Merge:
    """Which of an entity's descriptions stands after all its mentions."""

    def __init__(self) -> None:
        self.text: str | None = None
        self.defined = False
        self.count = 0

    def add(self, row: tuple) -> list[tuple]:
        text, defined = row[0] or "", bool(row[1])
        self.count += 1
        if self.text is None:
            self.text, self.defined = text, defined
        elif defined and not self.defined:
            self.text, self.defined = text, True
        elif defined:
            old = self.text
            if (MEANS in text and MEANS not in old) or ENACTING in old or (PENAL in text and PENAL not in old) or len(text) > 1.5 * len(old):
                self.text = text
        elif len(text) > len(self.text) and not self.defined:
            self.text = text
        return []

    def end(self) -> list[tuple]:
        return [(self.text, self.defined, self.count)]


def merge_entities(found: DataFrame) -> DataFrame:
    """name, description, is_definition, n_mentions. found: name, description, is_definition and chunk_id, ord for the order."""
    rows = found.where("name is not null").select("name", "description", "is_definition", "chunk_id", "ord")
    schema = StructType([StructField("name", StringType()), StructField("description", StringType()), StructField("is_definition", BooleanType()), StructField("n_mentions", LongType())])
    return fold(rows, ["name"], ["chunk_id", "ord"], Merge, schema)


class Packer:
    """Sections into chunks of at most the limit, the last one carried into the next; an oversized one stands alone."""

    def __init__(self, limit: int, carry: bool):
        self.limit, self.carry = limit, carry
        self.names: list[str | None] = []
        self.sizes: list[int] = []
        self.chunk = 0

    def _flush(self) -> list[tuple]:
        if not self.names:
            return []
        out = [(self.chunk, len(self.names), sum(self.sizes), self.names[0], self.names[-1])]
        self.chunk += 1
        self.names, self.sizes = (self.names[-1:], self.sizes[-1:]) if self.carry else ([], [])
        return out

    def add(self, row: tuple) -> list[tuple]:
        name, size = row[0], row[1]
        if size > self.limit:
            out = self._flush()
            out.append((self.chunk, 1, size, name, name))
            self.chunk += 1
            self.names, self.sizes = [], []
            return out
        out = self._flush() if sum(self.sizes) + size > self.limit else []
        self.names.append(name)
        self.sizes.append(size)
        return out

    def end(self) -> list[tuple]:
        return self._flush()


def pack_sections(sections: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """law_name, chapter, chunk, n_sections, token_count, first_section, last_section of each chunk.

    sections: law_name, chapter, ord, section_number, tokens. With the carry a chunk can exceed the limit, as its first
    section comes from the one before and the next is not measured again. Null laws and chapters are files of their own.
    """
    limit, carry = s.chunk_tokens, s.chunk_carry
    rows = sections.select("law_name", "chapter", arabic_digits(F.col("section_number")).alias("section_number"), F.coalesce("tokens", F.lit(0)).alias("tokens"), "ord")
    schema = StructType([StructField("law_name", StringType()), StructField("chapter", StringType()), *(StructField(c, LongType()) for c in ("chunk", "n_sections", "token_count")), StructField("first_section", StringType()), StructField("last_section", StringType())])
    return fold(rows, ["law_name", "chapter"], ["ord"], lambda: Packer(limit, carry), schema)
