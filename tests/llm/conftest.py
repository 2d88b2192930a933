import pytest
from pyspark.sql.types import StructType

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ITEMS = "item_id long, text string, kind string"
NITI = "result_id long, idx long, question string, generator string, predicted_answer string, run_at timestamp"
SECTIONS = "section_id long, raw_text string, loaded_at timestamp"
UNITS = "chunk_id string, text string, loaded_at timestamp"
ENTITIES = "id string, source string, description string, loaded_at timestamp"
QA = "qa_id long, split string, source string, question string, relevant_sections array<string>, loaded_at timestamp"
EXAMPLES = "example_id long, subject_id long, text string"
SUBJECTS = "subject_id long, subject string"

#: Columns whose names the operators use for their own ends.
CLASHING = ["k", "t", "x", "h", "a", "b", "key", "cls", "s", "starts", "part", "n_tokens", "bucket", "container_id", "units", "pieces", "cut", "mark", "item", "share", "defect", "rec_table", "rec_id", "value", "count", "spread", "train"]


@pytest.fixture
def make(spark):
    """A table of rows by name and value; what is not named is null. ``clash`` adds columns of the operators' own names."""

    def build(schema: str, rows: list[dict], clash: bool = False):
        own = StructType.fromDDL(schema)
        df = spark.createDataFrame([tuple(r.get(f.name) for f in own) for r in rows], own)
        return df.selectExpr("*", *(f"'clash' as {c}" for c in CLASHING if c not in own.names)) if clash else df

    return build
