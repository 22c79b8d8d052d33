import random

import duckdb
import pytest

from bibliolake.llm import mixing


def by_rounds(sizes):
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight, fixed = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}, {}
    while True:
        rest = 1.5 * sum(sizes.values()) - sum(fixed.values())
        free = sum(w for s, w in weight.items() if s not in fixed)
        over = {s: 2 * sizes[s] for s in order if s not in fixed and rest * weight[s] > 2 * sizes[s] * free}
        if not over:
            return {s: fixed.get(s, rest * weight[s] / free if free else 0) for s in order}
        fixed |= over


def test_targets_are_those_of_rounds(spark):
    rng = random.Random(4)
    cases = [{"a": 10, "b": 1000, "c": 50, "d": 400, None: 7, "e": 0}, {"a": 0, "b": 0}, {"x": 5}, {None: 3, "é": 9, "Z": 9}]
    cases += [{f"s{i}": int(rng.lognormvariate(6, 2)) for i in range(rng.randint(1, 30))} for _ in range(12)]
    for sizes in cases:
        frame = spark.createDataFrame(list(sizes.items()), "source string, size bigint").coalesce(1)
        found = {r.source: r.target for r in mixing.targets(frame).collect()}
        assert found == pytest.approx(by_rounds(sizes))


def test_schedule_is_even_and_ranked(spark):
    quotas = spark.createDataFrame([("a", 1000), ("b", 3001), (None, 500), ("z", 0)], "source string, quota bigint")
    rows = sorted(mixing.schedule(quotas, 10).collect())
    for source, quota in (("a", 1000), ("b", 3001), (None, 500)):
        own = [r for r in rows if r.source == source]
        assert [r["rank"] for r in own] == list(range(len(own))) and sum(r.words for r in own) == quota
    assert {r.source for r in rows} == {"a", "b", None}
    # Every stretch of the schedule holds a source nearly by its weight.
    for k in range(50, len(rows), 50):
        assert abs(sum(r.source == "b" for r in rows[:k]) - k * 301 / 451) < 8


def test_rank_over_stretches(spark, monkeypatch):
    monkeypatch.setattr(mixing, "STRETCH", 16)
    quotas = spark.createDataFrame([("a", 100), ("b", 300)], "source string, quota bigint")
    rows = sorted(mixing.schedule(quotas, 1).collect())
    for source in "ab":
        assert [r["rank"] for r in rows if r.source == source] == list(range(100 if source == "a" else 300))


@pytest.mark.parametrize("block", [7, mixing.BLOCK])
def test_matches_sql(spark, sf_dir, block):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with duckdb.connect() as db:
        db.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf_dir}/documents.parquet')")
        wanted = sorted(db.execute(mixing.SQL).fetchall())
    rows = mixing.mix(docs, block=block).select("doc_id", "size", "source_size", "target", "taken").collect()
    assert sorted(map(tuple, rows)) == wanted
    assert all(r.taken <= 2 * r["size"] for r in rows)


def test_spans_are_the_mix(spark, sf_dir, monkeypatch):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    mixed = mixing.mix(docs, block=64)
    rows = mixed.collect()
    assert all(r.taken == sum(s["words"] for s in r.spans) for r in rows)
    assert all(0 <= s["start"] and s["start"] + s["words"] <= r["size"] and s["words"] > 0 for r in rows for s in r.spans)
    spans = mixing.in_order(mixed).collect()
    assert [(s["slot"], s["at"]) for s in spans] == sorted((s["slot"], s["at"]) for s in spans)
    slots = {}
    for s in spans:
        # A slot is filled without gaps, by one source.
        at, source = slots.get(s["slot"], (0, s.source))
        assert s["at"] == at and s.source == source
        slots[s["slot"]] = (at + s["words"], source)
    assert max(at for at, _ in slots.values()) == 64
    # Any stretch of the schedule holds each source nearly by its target.
    order = [slots[k] for k in sorted(slots)]
    wanted = {r.source: r.target for r in rows}
    everything = sum(wanted.values())
    step = len(order) // 7
    for k in range(0, len(order) - step, step):
        words = sum(at for at, _ in order[k : k + step])
        for source, target in wanted.items():
            assert abs(sum(at for at, s in order[k : k + step] if s == source) - words * target / everything) < 64 * 12
    monkeypatch.setattr(mixing, "_bit_reversed", lambda number, bits: number)
    other = mixing.mix(docs, block=64)
    assert {(r.doc_id, r.taken) for r in other.collect()} == {(r.doc_id, r.taken) for r in rows}
    assert mixing.in_order(other).collect() != spans


def test_many_sources(spark):
    quotas = spark.range(5000).selectExpr("cast(id as string) AS source", "id % 3 AS quota")
    rows = mixing.schedule(quotas, 1).collect()
    assert len(rows) == sum(i % 3 for i in range(5000)) == len({r.slot for r in rows})
    assert mixing.schedule(quotas.limit(0), 1).collect() == []


def test_odd_rows(make_docs):
    docs = make_docs(
        {"text": "a b c", "source": None}, {"text": None, "source": "s"}, {"text": "", "source": "s"}, {"text": "é\tx\x0by z", "source": "s"},
        {"text": "a b c", "source": None, "doc_id": None}, {"text": "a b c", "source": None, "doc_id": None}, {"text": "w " * 50_000, "source": "t"},
    )
    rows = mixing.mix(docs).collect()
    assert len(rows) == 7
    assert sorted(r["size"] for r in rows) == [0, 0, 3, 3, 3, 3, 50_000]
    per = {r.source: (r.target, sum(x.taken for x in rows if x.source == r.source)) for r in rows}
    assert all(target - 1 < taken <= target for target, taken in per.values())
    assert mixing.mix(docs.limit(0)).count() == 0
    assert [r.taken for r in mixing.mix(docs.where("n_chars = 0")).collect()] == [0, 0]
