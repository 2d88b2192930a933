"""Filling of fixed-capacity containers (problem 7).

Sum-of-squares packing: each item goes where the sum of the squared numbers of open containers per residual gap
becomes least; of equal places, to the one that it fills most. Documents are spread by a hash of their id over
buckets, each packed on its own, the largest items first; only ids and sizes are shuffled. There are as many buckets as the
tokens of all documents need for ``BUCKET_CONTAINERS`` containers each, however the session is set. What a bucket leaves in
containers less than ``FULL`` full is packed once more with the other buckets' leftovers, a share of about that many at a time.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BooleanType, IntegerType, LongType, StringType, StructField, StructType

from lexweave.llm.rows import map_rows
from lexweave.session import cut_lineage

CAPACITY = 2048
#: Containers of one bucket; a container this full stays as it is.
BUCKET_CONTAINERS, FULL = 5000, 0.98
VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"

#: Fixed value: the byte-level tokenizers' pattern of words.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def encoding(path: str = VOCABULARY) -> tiktoken.Encoding:
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=WORDS, mergeable_ranks=ranks, special_tokens={})


def token_sizes(documents: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """doc_id and n_tokens, 0 for a null text. The vocabulary is read once in each task."""

    def make() -> Callable:
        e = encoding(path)
        return lambda doc, text: [(doc, len(e.encode_ordinary(text)) if text else 0)]

    return map_rows(documents.select("doc_id", "text"), make, StructType([StructField("doc_id", LongType()), StructField("n_tokens", IntegerType())]))


class SumOfSquares:
    """The state of one bucket: open containers by residual gap."""

    def __init__(self, capacity: int = CAPACITY):
        self.capacity = capacity
        self.open = np.zeros(capacity + 1, np.int64)
        self.ids: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.containers = 0

    def place(self, size: int) -> int:
        """The container's number. Closing a gap of n containers changes the sum by 1 - 2n, making one of m by 1 + 2m."""
        if not 0 < size <= self.capacity:
            raise ValueError(f"size {size}")
        gaps = size + np.flatnonzero(self.open[size : self.capacity])
        rest = self.capacity - size
        new = 1 + 2 * self.open[rest] if rest else 0
        gap = self.capacity
        if gaps.size:
            change = 1 - 2 * self.open[gaps] + np.where(gaps > size, 1 + 2 * self.open[gaps - size], 0)
            i = int(change.argmin())  # the first, so the least gap
            if change[i] <= new:
                gap = int(gaps[i])
        if gap == self.capacity:
            number = self.containers
            self.containers += 1
        else:
            number = self.ids[gap].pop()
            self.open[gap] -= 1
        if gap > size:
            self.open[gap - size] += 1
            self.ids[gap - size].append(number)
        return number


PACKED = StructType([StructField("doc_id", LongType()), StructField("part", IntegerType()), StructField("n_tokens", IntegerType()), StructField("container_id", StringType()), StructField("left", BooleanType())])


def _packer(capacity: int, name: str, full: float) -> Callable:
    """Rows come sorted by bucket; a bucket is packed when its rows end: (document, part, size) and its container, and whether that is left for the next round."""
    schema = to_arrow_schema(PACKED)

    def packed(bucket: int, rows: list[tuple[int, int, int]]) -> pa.RecordBatch:
        state, filled = SumOfSquares(capacity), []
        own = []
        for _, _, size in rows:
            if not size:
                own.append(-1)
                continue
            own.append(state.place(size))
            filled.extend([0] * (state.containers - len(filled)))
            filled[own[-1]] += size
        left = [c >= 0 and filled[c] < full * capacity for c in own]
        columns = [*zip(*rows, strict=True), [None if c < 0 else f"{name}{bucket}-{c}" for c in own], left]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, rows = None, []
        for b in batches:
            for own, *row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if own != bucket:
                    if rows:
                        yield packed(bucket, rows)
                    bucket, rows = own, []
                rows.append(tuple(row))
        if rows:
            yield packed(bucket, rows)

    return run


def _spread(parts: DataFrame, n: int, capacity: int, name: str, full: float) -> DataFrame:
    bucketed = parts.select(F.pmod(F.xxhash64("doc_id", F.lit(name)), F.lit(n)).cast("int").alias("bucket"), "doc_id", "part", "n_tokens")
    return bucketed.repartition("bucket").sortWithinPartitions("bucket", F.desc("n_tokens"), "doc_id", "part").mapInArrow(_packer(capacity, name, full), PACKED)


def pack(sizes: DataFrame, capacity: int = CAPACITY, buckets: int | None = None) -> DataFrame:
    """sizes: doc_id, n_tokens. Rows doc_id, part, n_tokens, container_id, one for each part of each document.

    A document over the capacity becomes full parts and a rest; any other is one part. One of no tokens, or of a
    null text, takes no room and gets a null container. Repeated doc_ids are packed as often as they come. ``buckets`` sets
    their number; sizes are best kept (a checkpoint, a table), as they are read twice.
    """
    size = F.coalesce("n_tokens", F.lit(0))
    full = F.floor(F.greatest(size - 1, F.lit(0)) / capacity).cast("int")
    parts = sizes.select("doc_id", F.posexplode(F.transform(F.sequence(F.lit(0), full), lambda i: F.least(F.lit(capacity), size - i * capacity).cast("int"))).alias("part", "n_tokens"))
    if buckets is None:
        total = sizes.agg(F.coalesce(F.sum(F.col("n_tokens").cast("long")), F.lit(0))).first()[0]
        buckets = max(1, round(total / capacity / BUCKET_CONTAINERS))
    first = cut_lineage(_spread(parts, buckets, capacity, "", FULL))
    left = first.where("left")
    # the leftovers of so many buckets that they fill about one bucket's containers
    again = max(1, round(left.agg(F.coalesce(F.sum(F.col("n_tokens").cast("long")), F.lit(0))).first()[0] / capacity / BUCKET_CONTAINERS))
    return first.where("not left").unionByName(_spread(left, again, capacity, "r", 0.0)).drop("left")


def pack_documents(documents: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY, buckets: int | None = None) -> DataFrame:
    return pack(cut_lineage(token_sizes(documents, vocabulary)), capacity, buckets)
