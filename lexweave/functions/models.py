"""Optional models behind plain interfaces: encoders, pair scorers, chat clients. None is needed; tests use fakes.

A model is a factory, called once in each task, so that it is loaded once there.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ENTITY_TYPES = "LAW SECTION OFFENSE PENALTY LEGAL_CONCEPT ORGANIZATION PERSON_TYPE COURT LEGAL_PROCEDURE".split()
DEFAULT_TYPE = "LEGAL_CONCEPT"


def encode(items: DataFrame, model: Callable[[], Callable[[list[str]], list[list[float]]]], batch: int = 64) -> DataFrame:
    """item_id, vector: texts encoded ``batch`` at a time; a failing batch gives null vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = None
        for b in batches:
            f = f or model()
            texts, out = [t or "" for t in b.column(1).to_pylist()], []
            for i in range(0, len(texts), batch):
                part = texts[i : i + batch]
                try:
                    out.extend(f(part))
                except Exception:
                    out.extend([None] * len(part))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.list_(pa.float32()))], ["item_id", "vector"])

    return items.select("item_id", "text").mapInArrow(run, f"item_id {items.schema['item_id'].dataType.simpleString()}, vector array<float>")


def tokenized(items: DataFrame, model: Callable[[], Callable[[str], list[str]]]) -> DataFrame:
    """item_id, text with its words set apart by blanks: the hook for a word splitter of a script without spaces. A text that it fails on stays as it is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = None
        for b in batches:
            split, out = split or model(), []
            for t in b.column(1).to_pylist():
                try:
                    out.append(" ".join(w for w in split(t) if w.strip()) if t else t)
                except Exception:
                    out.append(t)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], ["item_id", "text"])

    return items.select("item_id", "text").mapInArrow(run, f"item_id {items.schema['item_id'].dataType.simpleString()}, text string")


def score_pairs(pairs: DataFrame, model: Callable[[], Callable[[list[tuple[str, str]]], list[float]]]) -> DataFrame:
    """Adds ``ce``: the pair scorer's value for question and text."""
    names = pairs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = None
        for b in batches:
            f = f or model()
            q, t = (b.column(b.schema.get_field_index(c)).to_pylist() for c in ("question", "text"))
            scores = f([(x or "", y or "") for x, y in zip(q, t, strict=True)])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(scores, pa.float64())], [*names, "ce"])

    return pairs.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pairs.schema) + ", ce double")


def parse_reply(text: str | None) -> dict:
    """A model's JSON, without its code fence; else the widest braces in it; else nothing."""
    t = re.sub(r"^\s*```(?:json)?\s*|\s*```\s*$", "", text or "")
    for candidate in (t, (re.search(r"\{.*\}", t, re.S) or [""])[0]):
        try:
            value = json.loads(candidate)
        except ValueError:
            continue
        if isinstance(value, dict):
            return value
    return {}


def extract_with_chat(chunks: DataFrame, client: Callable[[], Callable[[str], str]]) -> DataFrame:
    """chunk_id, name, type, description of the entities that a chat client finds; unknown types become a concept, failures nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ask = None
        for b in batches:
            ask = ask or client()
            rows = []
            for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                try:
                    reply = parse_reply(ask(text or ""))
                except Exception:
                    continue
                for e in reply.get("entities") or []:
                    if isinstance(e, dict) and e.get("name"):
                        kind = str(e.get("type", "")).upper()
                        rows.append((key, str(e["name"]), kind if kind in ENTITY_TYPES else DEFAULT_TYPE, str(e.get("description") or "")))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in (zip(*rows, strict=True) if rows else ((), (), (), ()))], ["chunk_id", "name", "type", "description"])

    return chunks.select("chunk_id", "text").mapInArrow(run, "chunk_id string, name string, type string, description string")


def judged(reply: Column) -> Column:
    """The first number of a judge's reply, within 0 and 1; null if it has none."""
    n = F.regexp_extract(reply, r"([0-9]+(?:\.[0-9]+)?)", 1)
    return F.when(n != "", F.greatest(F.lit(0.0), F.least(F.lit(1.0), n.cast("double"))))


def prefer(first: Column, second: Column) -> Column:
    """Q5: the model's text if there is any, else the one made without it."""
    return F.when(F.trim(F.coalesce(first, F.lit(""))) != "", first).otherwise(second)
