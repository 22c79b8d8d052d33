import hashlib
import random
import re
from collections import Counter

import duckdb
from pyspark.sql import functions as F

from bibliolake.llm import syncmers as M


def units(text):
    out = []
    for run in re.findall(r"[^\W\d_]+|\d+|[^\sa-zA-Z0-9À-ɏ]|_", text):
        out += [run[i : i + 8] for i in range(0, len(run), 8)] if run[0].isalnum() else [run]
    return out or [text] * bool(text)


def slow_places(spark, text):
    """Places of the closed syncmers, by the definition; hashes from Spark."""
    u = units(text)
    if not u:
        return []
    frame = spark.createDataFrame(list(enumerate(u)), "i int, u string").select("i", F.xxhash64("u"))
    h = [r[1] for r in sorted(frame.collect())]
    pairs = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(zip(h, h[1:]))], "i int, a bigint, b bigint")
    g = [r[1] for r in sorted(pairs.select("i", F.xxhash64("a", "b")).collect())]
    found = []
    for i in range(len(u) - M.K + 1):
        inner = g[i : i + M.K - M.S + 1]
        if min(inner) in (inner[0], inner[-1]):
            found.append(i)
    return found or [0]


def test_places_of_closed_syncmers(spark):
    rng = random.Random(8)
    words = ["alpha", "beta", "gammadeltaepsilon", "12345678901", "é", "x.", "(y", "\n"]
    texts = ["", "a", "abcd", "abcdefghijk", "short text with words", " ".join(rng.choices(words, k=200)), " " * 300, "ab " * 200]
    frame = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    rows = frame.select("i", M.anchors(F.col("text")).alias("a")).collect()
    for r in rows:
        assert [x.place for x in r.a] == slow_places(spark, texts[r.i]), texts[r.i][:30]


def test_anchors_do_not_depend_on_context(spark):
    rng = random.Random(3)
    inner = " ".join(str(rng.random())[2:9] + "w" for _ in range(150))
    texts = [inner, "before it " * 40 + inner + " and after" * 50]
    a, b = (set(x.anchor for x in r[0]) for r in spark.createDataFrame([(t,) for t in texts], "t string").select(M.anchors(F.col("t"))).collect())
    assert len(a) > 50 and len(a - b) == 0


def test_units_are_the_same_at_every_length(spark):
    text = " ".join(f"{w} of" for w in ["alpha", "river", "stone", "cloud", "seven"] * 20)
    rows = [(text[:n], text[: n + 1]) for n in (20, 100, 254, 255, 256, 257)]
    near = M.likeness(M.sketch(F.col("a")), M.sketch(F.col("b")))
    found = [r[0] for r in spark.createDataFrame(rows, "a string, b string").select(near).collect()]
    # A longer last word changes at most the last K - S + 1 k-mers, of which about half are anchors.
    assert all(x >= 0.8 for x in found[2:]), found
    inner = " ".join(str(random.Random(6).random())[2:9] + f"w{i}" for i in range(22))
    a, b = (set(x.anchor for x in r[0]) for r in spark.createDataFrame([(inner,), ("before it " * 40 + inner,)], "t string").select(M.anchors(F.col("t"))).collect())
    assert len(inner) < 256 and len(a) > 5 and a <= b


def test_edited_texts_and_order(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = dict(duckdb.sql(f"SELECT doc_id, coalesce(text, '') FROM read_parquet('{sf_dir}/documents.parquet') ORDER BY doc_id").fetchall())
    ids = list(texts)
    after = dict(zip(ids, ids[1:] + ids[:1]))
    rows = M.fingerprints(docs).collect()
    assert sorted(r.doc_id for r in rows) == ids
    prints = {r.doc_id: r.fingerprint for r in rows}
    far = []
    for r in rows:
        text, n = texts[r.doc_id], len(texts[r.doc_id])
        edited = text[: n - n // 4] + texts[after[r.doc_id]][: n // 4]
        assert (r.n_chars, r.next_doc_id) == (n, after[r.doc_id])
        assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        if text == texts[after[r.doc_id]]:
            assert r.near_next == 1
        else:
            far.append(r.near_next)
        assert 0 <= r.near_edited <= 1 and (r.fingerprint != "" or text == "")
    assert sum(far) < 0.1 * len(far) and sum(r.near_edited for r in rows) > 0.5 * len(rows)
    same = {}
    for i, t in texts.items():
        same.setdefault(t, set()).add(prints[i])
    assert all(len(v) == 1 for v in same.values())


def test_likeness_estimates_shared_anchors(spark):
    rng = random.Random(6)
    words = [f"w{rng.random()}" for _ in range(4000)]
    texts = [" ".join(words[:3000]), " ".join(words[1000:])]
    row = spark.createDataFrame([tuple(texts)], "a string, b string").select(
        M.likeness(M.sketch(F.col("a")), M.sketch(F.col("b"))), M.anchors(F.col("a")), M.anchors(F.col("b"))
    ).first()
    a, b = ({x.anchor for x in anchors} for anchors in row[1:])
    assert abs(row[0] - len(a & b) / len(a | b)) < 0.2


def test_odd_rows(make_docs, spark):
    docs = make_docs(None, "", {"text": "abc def", "doc_id": None}, {"text": "abc def", "doc_id": 1}, {"text": "abc def", "doc_id": 1}, "x " * 60_000)
    rows = M.fingerprints(docs).collect()
    assert len(rows) == 6
    assert {r.fingerprint for r in rows if r.n_chars == 0} == {""}
    assert len({r.fingerprint for r in rows if r.n_chars == 7}) == 1
    # The last in order has a null id; the first document follows it.
    assert [r.next_doc_id for r in rows if r.doc_id is None] == [0]
    one = M.fingerprints(docs.where("doc_id = 5")).collect()
    assert [(r.next_doc_id, r.near_next) for r in one] == [(5, 1.0)]
    assert M.fingerprints(docs.limit(0)).count() == 0


def test_only_dataframe_operations(spark, sf_dir):
    plan = M.fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def slow_likeness(a, b):
    """Over all anchors: one matches where it and the next one are as far apart in the
    other text, as often as both texts have it."""

    def linked(found):
        rest = [*found[1:], None]
        return Counter((x.anchor, y and (y.anchor, y.place - x.place)) for x, y in zip(found, rest))

    a, b = linked(a), linked(b)
    return (a & b).total() / (a | b).total() if a or b else 1.0


def test_likeness_over_all_anchors(spark, make_docs):
    rng = random.Random(4)
    words = [f"w{rng.randrange(10**6)}" for _ in range(900)]
    phrase = "the same few words again and again, "
    texts = [" ".join(words), " ".join(words[300:] + words[:300]), phrase * 60, phrase * 20 + " ".join(words[:200]), "abcdefgh", "", phrase * 90]
    docs = make_docs(*texts)
    rows = M.fingerprints(docs).collect()
    edited = [t[: len(t) - len(t) // 4] + u[: len(t) // 4] for t, u in zip(texts, texts[1:] + texts[:1])]
    listed = spark.createDataFrame(list(enumerate(texts + edited)), "i int, t string").select("i", M.anchors(F.col("t")).alias("a")).collect()
    found = {r.i: r.a for r in listed}
    n = len(texts)
    for r in rows:
        i = r.doc_id
        assert abs(r.near_edited - slow_likeness(found[i], found[n + i])) < 1e-9
        assert abs(r.near_next - slow_likeness(found[i], found[(i + 1) % n])) < 1e-9


def test_repeats_and_order_count(make_docs):
    phrase = "the same few words again and again, "
    rng = random.Random(2)
    parts = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(10)) for _ in range(60)]
    texts = [phrase * 30, phrase * 60, " ".join(parts), " ".join(rng.sample(parts, 60))]
    rows = {r.doc_id: r for r in M.fingerprints(make_docs(*texts)).collect()}
    assert 0.4 < rows[0].near_next < 0.6
    assert rows[2].near_next < 1
    assert len({r.fingerprint for r in rows.values()}) == 4
