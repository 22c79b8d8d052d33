import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, score string, fp string, size string"


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from texts or dicts, with further columns whose names clash."""

    def make(*rows):
        full = []
        for i, row in enumerate(rows):
            row = row if isinstance(row, dict) else {"text": row}
            text = row.get("text")
            full.append((row.get("doc_id", i), text, row.get("lang", "en"), row.get("source", "s"), len(text or ""), "x", "y", "z"))
        return spark.createDataFrame(full, SCHEMA)

    return make
