"""Explicit schemas; nothing is inferred."""

from __future__ import annotations

from pyspark.sql.types import ArrayType, DoubleType, LongType, StringType, StructField, StructType

STRINGS = ArrayType(StringType())


def struct(**fields: object) -> StructType:
    return StructType([StructField(k, v) for k, v in fields.items()])


S, L, D = StringType(), LongType(), DoubleType()

SECTION = struct(law_name=S, chapter=S, section_number=S, raw_text=S, char_count=L)
CHUNK = struct(chunk_id=S, law_name=S, chapter=S, sections=STRINGS, text=S, token_count=L)
ENTITY = struct(id=S, name=S, type=S, description=S, source_chunk_ids=STRINGS)
RELATIONSHIP = struct(source=S, target=S, type=S, description=S, weight=D, source_chunk_ids=STRINGS)
COMMUNITY = struct(community_id=L, level=L, entity_ids=STRINGS, title=S, summary=S, importance=D, findings=STRINGS)
QA_PAIR = struct(question=S, ground_truth=S, relevant_sections=STRINGS)
LAW_CONTENT = struct(law_name=S, section_content=S)
BENCHMARK_ITEM = struct(question=S, answer=S, reference_answer=S, relevant_laws=ArrayType(LAW_CONTENT), reference_laws=ArrayType(LAW_CONTENT))

#: The four tables of an index and the columns that its files hold as JSON text.
INDEX = {"entities": (ENTITY, ["source_chunk_ids"]), "relationships": (RELATIONSHIP, ["source_chunk_ids"]), "communities": (COMMUNITY, ["entity_ids", "findings"]), "text_units": (CHUNK, ["sections"])}
