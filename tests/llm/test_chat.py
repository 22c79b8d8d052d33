import random

import duckdb

from bibliolake.llm import chat

SCHEMA = "conv_id bigint, turn bigint, role string, text string, place string, a string"


def make(spark, *rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)


def by_sql(rows, part=None):
    with duckdb.connect() as db:
        db.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
        if rows:
            db.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
        return set(db.execute(chat.SQL).fetchall())


def test_prefixes_collapse(spark):
    one = [(0, "user", "hi"), (1, "assistant", "hello"), (2, "user", "bye")]
    rows = [(5, *t) for t in one] + [(7, *t) for t in one[:2]] + [(3, *t) for t in one] + [(9, 0, "user", "hi"), (9, 1, "assistant", "other")]
    found = chat.render(make(spark, *rows)).collect()
    assert {r.conv_id for r in found} == {3, 9}
    assert {r.rendered for r in found if r.conv_id == 3} == {
        "<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\nhello<|im_end|>\n<|im_start|>user\nbye<|im_end|>\n"
    }


def test_matches_sql_on_random_logs(spark, monkeypatch):
    rng = random.Random(11)
    rows = []
    for c in [*range(60), None]:
        seed = random.Random(rng.randint(0, 6))
        turns = [(t * 700, seed.choice(["user", "assistant", None]), seed.choice(["a", "b", "", None, "<|im_end|> x"])) for t in range(8)]
        rows += [(c, *t) for t in turns[: rng.randint(1, 8)]]
    rows += rows[:20] + [(1, None, "user", "z"), (1, 0, "tool", "second text"), (2, -5000, "user", "early")]
    frame = make(spark, *rows)
    assert {tuple(r) for r in chat.render(frame).collect()} == by_sql(rows)


def test_long_conversations_in_parts(spark):
    rows = [(1, t, "user", f"t{t}") for t in range(2500)] + [(2, t, "user", f"t{t}") for t in range(1500)] + [(3, t, "user", f"t{t}" if t != 1200 else "no") for t in range(1300)]
    found = {tuple(r) for r in chat.render(make(spark, *rows)).collect()}
    assert found == by_sql(rows) and sorted((c, p) for c, p, _, _ in found) == [(1, 0), (1, 1), (1, 2), (3, 0), (3, 1)]


def test_empty_table(spark):
    assert chat.render(make(spark, (1, 0, "user", "x")).limit(0)).count() == 0


def test_one_hot_conversation_spreads(spark):
    rows = [(None, t, "user", f"text {i}") for t in range(4) for i in range(6000)] + [(1, 0, "user", "hi")]
    frame = make(spark, *rows).repartition(8)
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        turns = chat.prefixes(frame)
        sizes = [r["count"] for r in turns.groupBy("conv", "stretch").count().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert max(sizes) < 12000
    assert {tuple(r) for r in chat.render(frame).collect()} == by_sql(rows)
