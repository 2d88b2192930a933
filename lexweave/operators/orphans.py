"""References to keys that are missing, deleted or late (problem 4).

Parents and references are shuffled once to the same partitions by key and sorted there; one pass over the
sorted stream carries the last parent's validity interval forward and settles every reference. Nothing is
broadcast but the hot keys: a key is hot if it holds more than a quarter of what a partition should get, so there are
never more than four for each partition. References to a hot key are spread by their own id over as many
partitions as bring it below that, and its one parent row is repeated in each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexweave.functions.text import reference_key

ENTITY, CHUNK = "entity", "chunk"
STATUS_SCHEMA = "ref_table string, ref_id string, ref_field string, ref_key string, loaded_at timestamp, status string"


def _keyed(df: DataFrame, written: str) -> DataFrame:
    """With the key's normal form, empty for a blank one; rows of a null key are left out.

    Blank keys stay until the merge: a filter on the form would be pushed below it and work it out twice.
    """
    return df.where(F.col(written).isNotNull()).withColumn("key", reference_key(F.col(written)))


def references(relationships: DataFrame, entities: DataFrame) -> DataFrame:
    """Every reference as written, with the kind of its key and its record's earliest time; null ones are no references, nor, in the merge, are blank ones.

    A redelivered record repeats all columns but the time, so its rows fall together; rows of one id with other
    ends are other references.
    """
    rel = relationships.groupBy("rel_id", "source", "target").agg(F.min("loaded_at").alias("loaded_at"))
    ends = rel.select(
        F.lit("relationships").alias("ref_table"), F.col("rel_id").cast("string").alias("ref_id"), "loaded_at",
        F.explode(F.array(*(F.struct(F.lit(f).alias("ref_field"), F.col(f).alias("ref_key"), F.lit(ENTITY).alias("kind")) for f in ("source", "target")))).alias("r"),
    )
    ent = entities.groupBy("id", "source_chunk_ids").agg(F.min("loaded_at").alias("loaded_at"))
    chunks = ent.select(
        F.lit("entities").alias("ref_table"), F.col("id").alias("ref_id"), "loaded_at",
        F.explode(F.transform(F.array_distinct("source_chunk_ids"), lambda k: F.struct(F.lit("source_chunk_ids").alias("ref_field"), k.alias("ref_key"), F.lit(CHUNK).alias("kind")))).alias("r"),
    )
    return ends.unionByName(chunks).select("ref_table", "ref_id", "loaded_at", "r.*")


def written_keys(relationships: DataFrame, entities: DataFrame) -> DataFrame:
    """The keys as written, of all rows: what the hot ones are counted over. No record needs to be found for that."""
    ends = relationships.select(F.lit(ENTITY).alias("kind"), F.explode(F.array("source", "target")).alias("ref_key"))
    return ends.unionByName(entities.select(F.lit(CHUNK).alias("kind"), F.explode("source_chunk_ids").alias("ref_key")))


def parents(entities: DataFrame, text_units: DataFrame, tombstones: DataFrame) -> DataFrame:
    """One row per kind and key: the start of its validity, or only its deletion."""
    live = entities.select(F.lit(ENTITY).alias("kind"), F.col("name").alias("k"), F.col("loaded_at").alias("valid_from"), F.lit(True).alias("live"))
    live = live.unionByName(text_units.select(F.lit(CHUNK).alias("kind"), F.col("chunk_id").alias("k"), F.col("loaded_at").alias("valid_from"), F.lit(True).alias("live")))
    dead = tombstones.select("kind", F.col("deleted_key").alias("k"), F.lit(None).cast("timestamp").alias("valid_from"), F.lit(False).alias("live"))
    rows = _keyed(live.unionByName(dead), "k")
    return rows.groupBy("kind", "key").agg(F.min("valid_from").alias("valid_from"), F.max("live").alias("live"))


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The linear merge; blank keys are no references. Of each key its parent row comes first; the last parent seen is carried over batches."""
    last: tuple | None = None
    schema = pa.schema([("ref_table", pa.string()), ("ref_id", pa.string()), ("ref_field", pa.string()), ("ref_key", pa.string()), ("loaded_at", pa.timestamp("us", tz="UTC")), ("status", pa.string())])
    for b in batches:
        n = b.num_rows
        if not n:
            continue
        col = {name: b.column(i) for i, name in enumerate(b.schema.names)}
        is_ref = np.asarray(col["is_ref"].to_numpy(zero_copy_only=False), dtype=bool)
        kind, key = col["kind"].to_numpy(zero_copy_only=False), col["key"].to_numpy(zero_copy_only=False)
        valid = col["valid_from"].cast(pa.int64()).fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False)
        live = col["live"].fill_null(False).to_numpy(zero_copy_only=False).astype(bool)
        loaded = col["loaded_at"].cast(pa.int64()).fill_null(np.iinfo(np.int64).max).to_numpy(zero_copy_only=False)
        at = np.maximum.accumulate(np.where(is_ref, -1, np.arange(n)))
        carried = at < 0
        own = np.maximum(at, 0)
        same = (kind[own] == kind) & (key[own] == key) & ~carried
        p_live, p_valid = np.where(same, live[own], False), np.where(same, valid[own], np.iinfo(np.int64).min)
        if last is not None and carried.any():
            here = carried & (kind == last[0]) & (key == last[1])
            same |= here
            p_live, p_valid = np.where(here, last[2], p_live), np.where(here, last[3], p_valid)
        status = np.where(~same, "missing", np.where(~p_live, "deleted", np.where(p_valid > loaded, "late", "")))
        keep = np.flatnonzero(is_ref & (status != "") & (key != ""))
        if keep.size:
            take = pa.array(keep)
            yield pa.RecordBatch.from_arrays([*(col[c].take(take).cast(schema.field(c).type) for c in schema.names[:5]), pa.array(status[keep].tolist(), pa.string())], schema=schema)
        if at[-1] >= 0:
            i = at[-1]
            last = (kind[i], key[i], bool(live[i]), int(valid[i]))


def hot_keys(written: DataFrame, hot_share: float) -> DataFrame:
    """Normal forms of the written keys that hold at least ``hot_share`` of all, at most 1 / hot_share rows; and over how many partitions to spread each."""
    counts = written.groupBy("kind", "ref_key").count().crossJoin(F.broadcast(written.groupBy().agg((F.count("*") * hot_share).alias("most"))))  # one row
    hot = counts.where(F.col("count") >= F.col("most"))
    return _keyed(hot, "ref_key").groupBy("kind", "key").agg(F.greatest(F.lit(1), F.ceil(F.sum("count") / F.max("most"))).cast("int").alias("spread"))


def orphans(refs: DataFrame, keys: DataFrame, written: DataFrame | None = None, hot_share: float | None = None, salts: int | None = None, partitions: int | None = None) -> DataFrame:
    """References whose key is ``missing``, ``deleted`` or ``late``; sound ones are left out.

    refs: ref_table, ref_id, ref_field, ref_key, kind, loaded_at. keys: one row per (kind, key) with valid_from and
    live. written: kind and ref_key of all references, where they can be had more cheaply than from refs. A null
    time on either side never makes a reference late. Repeated references stay repeated; an empty refs gives an
    empty result, an empty keys makes every reference missing.
    """
    n = partitions or int(refs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    hot = hot_keys(refs.select("kind", "ref_key") if written is None else written, hot_share or 1 / (4 * n))
    hot = hot.withColumn("spread", F.lit(salts)) if salts else hot
    own = _keyed(refs, "ref_key").join(F.broadcast(hot), ["kind", "key"], "left")
    salt: Column = F.when(F.col("spread").isNull(), 0).otherwise(F.pmod(F.hash("ref_table", "ref_id", "ref_field"), F.col("spread")))
    right = own.select("kind", "key", salt.cast("int").alias("salt"), F.lit(True).alias("is_ref"), F.lit(None).cast("timestamp").alias("valid_from"), F.lit(None).cast("boolean").alias("live"), "ref_table", "ref_id", "ref_field", "ref_key", "loaded_at")
    null = lambda c, t: F.lit(None).cast(t).alias(c)
    left = keys.join(F.broadcast(hot), ["kind", "key"], "left").select(
        "kind", "key", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("spread") - 1, F.lit(0)))).alias("salt"), F.lit(False).alias("is_ref"), "valid_from", "live",
        *(null(c, "string") for c in ("ref_table", "ref_id", "ref_field", "ref_key")), null("loaded_at", "timestamp"),
    )
    both = left.unionByName(right).repartition(n, "kind", "key", "salt").sortWithinPartitions("kind", "key", "salt", "is_ref")
    return both.mapInArrow(_merge, STATUS_SCHEMA)


def orphan_references(relationships: DataFrame, entities: DataFrame, text_units: DataFrame, tombstones: DataFrame, **options) -> DataFrame:
    """All orphan references of the graph tables, with the referring record's earliest loaded_at."""
    return orphans(references(relationships, entities), parents(entities, text_units, tombstones), written_keys(relationships, entities), **options)


def orphan_report(found: DataFrame) -> DataFrame:
    """Orphans per table, field, status and month of the referring record's earliest delivery."""
    month = F.date_format("loaded_at", "yyyy-MM")
    return found.groupBy("ref_table", "ref_field", "status", month.alias("month")).agg(F.count("*").alias("n_references"), F.countDistinct("ref_id").alias("n_records"))
