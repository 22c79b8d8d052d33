import corpus_pipeline as P
from bibliolake.llm.common import table
from bibliolake.sources.workspace import through_table

from test_decontaminate import slow_leaks
from test_similar import slow_shingles


def test_stages_against_brute_force(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    kept = {}
    for name, stage in P.STAGES[:-1]:
        docs = through_table(stage(spark, docs, sf_dir), "stage")
        assert docs.columns == table(spark, sf_dir, "documents").columns
        kept[name] = {r.doc_id: r.text for r in docs.collect()}
    before = {r.doc_id: r.text for r in table(spark, sf_dir, "documents").collect()}
    first, second, third, fourth = kept.values()
    assert set(before) - set(first) == {k for k, t in before.items() if not any(c.isalpha() for c in t or "")}
    kinds = sorted((k, slow_shingles(t)) for k, t in first.items())
    group = {k: k for k, _ in kinds}
    for i, (k, x) in enumerate(kinds):
        for m, y in kinds[:i]:
            if len(x & y) >= 0.8 * len(x | y):
                low, high = sorted((group[k], group[m]))
                group = {d: low if g == high else g for d, g in group.items()}
    assert set(second) == set(group.values())
    items = [tuple(r) for r in table(spark, sf_dir, "benchmark").collect()]
    assert set(third) == set(second) - {d for d, _ in slow_leaks(second.items(), items)}
    assert set(fourth) == set(third)
    changed = {k for k in third if third[k] != fourth[k]}
    assert all('oken = "' in third[k] or 'OKEN = "' in third[k] for k in changed)


def test_run_ends_with_the_mix(spark, sf_dir):
    rows = P.run(spark, sf_dir).collect()
    assert rows and all(0 <= r.taken <= 2 * r["size"] for r in rows)
    per = {}
    for r in rows:
        target, taken = per.get(r.source, (r.target, 0))
        per[r.source] = (target, taken + r.taken)
    assert all(target - 1 < taken <= target for target, taken in per.values())


def test_empty_tables(spark, sf_dir, monkeypatch):
    docs = table(spark, sf_dir, "documents").limit(0)
    for name, stage in P.STAGES:
        docs = through_table(stage(spark, docs, sf_dir), "stage")
        assert docs.count() == 0
