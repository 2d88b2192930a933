"""What the operators of this subpackage share: batches as Python rows, and the earliest delivery of a record."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

_FAR = "9999-12-31 00:00:00"


def map_rows(df: DataFrame, make: Callable[[], Callable[..., list[tuple]]], schema: StructType, out_rows: int = 4096) -> DataFrame:
    """Applies a function from the values of one row to any number of result rows.

    ``make`` runs once in each task and returns that function, so a model is built once there. Rows cross as
    Arrow batches and results leave in batches of at most about ``out_rows``.
    """
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f, found = None, []
        for b in batches:
            if f is None:
                f = make()
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                found.extend(f(*row))
                if len(found) >= out_rows:
                    yield _batch(found, arrow)
                    found = []
        if found:
            yield _batch(found, arrow)

    return df.mapInArrow(run, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def tally(df: DataFrame, make: Callable[[], Callable[..., None]], schema: StructType, most: int = 100_000) -> DataFrame:
    """Sums by key. ``make`` returns a function that adds one row's share to a Counter whose keys hold all columns but the last.

    Each task passes its sums on when it has ``most`` keys; they are added up after their shuffle.
    """
    arrow, (*keys, n) = to_arrow_schema(schema), schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f, found = make(), Counter()
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                f(found, *row)
                if len(found) >= most:
                    yield _batch([(*k, c) for k, c in found.items()], arrow)
                    found.clear()
        if found:
            yield _batch([(*k, c) for k, c in found.items()], arrow)

    return df.mapInArrow(run, schema).groupBy(*keys).agg(F.sum(n).alias(n))


def earliest_result(df: DataFrame, keys: list[str], time: str, value: str) -> DataFrame:
    """Of each record the result from its earliest delivery; unknown times count as last, equal times go by the result."""
    first = F.min(F.struct(F.coalesce(time, F.lit(_FAR).cast("timestamp")).alias("t"), F.col(value).alias("v")))
    return df.groupBy(*keys).agg(first.alias("first")).select(*keys, F.col("first.v").alias(value))


def least_hashes(df: DataFrame, by: list[str], n: int) -> list:
    """The n rows of least hash of some columns, the same at every run. They are picked on the executors: the driver gets n rows."""
    picked = df.withColumn("_h", F.xxhash64(*by)).orderBy("_h", *by).limit(n).drop("_h")
    return picked.repartition(1).collect()
