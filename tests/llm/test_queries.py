import duckdb
import pytest

import __spark_entry__ as entry_point
from bibliolake.llm.registry import CHECKS, QUERIES


def test_all_are_registered():
    names = entry_point.queries().keys()
    assert QUERIES.keys() <= names and "pipeline" in names
    assert [sum(n.startswith(f"op{i}_") for n in names) for i in range(1, 14)] == [1] * 13


@pytest.mark.parametrize("name", sorted(CHECKS))
def test_equal_to_sql(spark, sf_dir, name):
    result = QUERIES[name](spark, sf_dir)
    with duckdb.connect() as db:
        for t in ("documents", "conversations"):
            db.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
        cursor = db.execute(CHECKS[name])
        names = [d[0] for d in cursor.description]
        assert sorted(names) == sorted(result.columns)
        assert sorted(cursor.fetchall()) == sorted(tuple(r[c] for c in names) for r in result.collect())


@pytest.mark.parametrize(
    ("name", "columns"),
    [
        ("op1_toxicity", "doc_id held_out score predicted"),
        ("op2_secrets", "doc_id start length value_sha256 score is_secret"),
        ("op3_decontamination", "doc_id item_id windows n_windows coverage reparameterised"),
        ("op4_tokens", "doc_id n_bytes n_tokens over_limit"),
        ("op5_quality", "doc_id held_out score predicted"),
        ("op6_language", "doc_id held_out lang_pred score"),
        ("op7_fingerprints", "doc_id n_chars edited_sha256 fingerprint edited_fingerprint near_edited near_next"),
        ("op9_simhash", "doc_id fingerprint component_id"),
        ("op11_divergence", "lang source part item value rank"),
        ("op12_substrings", "doc_id n_words n_removed kept_sha256"),
        ("op13_spelling", "word form root n n_near form_n"),
    ],
)
def test_columns(spark, sf_dir, name, columns):
    assert set(columns.split()) <= set(QUERIES[name](spark, sf_dir).columns)
