"""Toxicity and quality: held-out accuracy, and rows of every odd kind."""

import numpy as np
import pytest

from bibliolake.llm import chars, quality, toxicity
from bibliolake.llm.common import in_fold
from bibliolake.llm.queries import op1, op5


def area(scores, labels):
    """Share of pairs of both classes that the score orders rightly."""
    good, bad = scores[labels == 1], scores[labels == 0]
    return ((good[:, None] > bad[None, :]) + 0.5 * (good[:, None] == bad[None, :])).mean()


@pytest.mark.parametrize(("query", "label", "least"), [(op1, "toxic", 0.9), (op5, "quality", 0.97)])
def test_held_out(spark, query, label, least):
    folder = "/root/testdata/sf0.1"
    rows = query(spark, folder).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").where("held_out").toPandas()
    assert area(rows["score"].to_numpy(), rows[label].to_numpy()) > least
    assert rows["score"].between(0, 1).all()
    assert (rows["predicted"] == (rows["score"] >= (0.3 if label == "toxic" else 0.7))).all()


def test_subwords_match_definition():
    text = "Ab, cde é  fghij!"
    words = [" ab ", " cde ", " é ", " fghij "]
    grams = [w[i : i + n] for w in words for n in toxicity.GRAMS for i in range(len(w) - n + 1)]
    want = np.zeros(toxicity.BUCKETS)
    for g in grams:
        want[int(chars.gram_hashes(chars.code_points(g).astype(np.uint64), len(g))[0]) % toxicity.BUCKETS] += 1 / len(grams)
    buckets, shares = toxicity.subwords(text)
    got = np.zeros(toxicity.BUCKETS)
    got[buckets] = shares
    assert np.allclose(got, want)


def test_what_stands_for_letters_stays_in_a_word():
    def words(text, within=toxicity.STAND_INS):
        return "".join(map(chr, chars.letters_only(text, within))).split()

    assert words("1d1ot 1D1OT! sh*t sh**t a5 5a 12 *a* i.e. $$$ b@d-d0g") == ["d1ot", "d1ot", "sh*t", "sh**t", "a", "a", "a", "i", "e", "b@d", "d0g"]
    assert words("sh*t a1b", "") == ["sh", "t", "a", "b"] and words("") == words("1*2") == []


def test_a_repeated_id_teaches_once(make_docs, spark, monkeypatch):
    docs = make_docs(*[{"text": f"text {i % 3}", "doc_id": 1} for i in range(500)], {"text": "other", "doc_id": 2})
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id bigint, toxic bigint")
    taught = []
    monkeypatch.setattr(toxicity, "train", lambda sample: taught.extend(sample))
    toxicity.fit(docs, labels)
    assert [y for y, _, _ in taught] == [1, 0]


def test_misspellings_share_subwords():
    rng = np.random.default_rng(0)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 6))
    texts = [(int(i % 3 == 0), " ".join([word() for _ in range(12)] + ["nastyword"] * (i % 3 == 0))) for i in range(300)]
    model = toxicity.train([(y, *toxicity.subwords(t)) for y, t in texts], epochs=30)
    calm, rude, spelled = (model.score(f"aabbcc ddeeff {x} gghhaa bbccdd") for x in ("hhggff", "nastyword", "nastywrd"))
    assert rude > 0.5 > calm and spelled > 2 * calm


def test_toxicity_of_odd_rows(spark, make_docs):
    docs = make_docs("a nice text", None, "", {"text": "a bad text", "doc_id": None}, {"text": "a bad text", "doc_id": 9}, {"text": "a bad text", "doc_id": 9}, "long " * 200_000)
    labels = spark.createDataFrame([(0, 0), (9, 1), (9, 0), (77, 1), (1, None), (None, 1)], "doc_id bigint, toxic bigint")
    rows = toxicity.scored(docs, toxicity.fit(docs, labels)).collect()
    assert len(rows) == 7 and all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if r.doc_id in (9, None)}) == 1
    nothing = toxicity.fit(docs, labels.limit(0))
    assert {r.score for r in toxicity.scored(docs, nothing).collect()} == {0.5}
    assert toxicity.scored(docs.limit(0), nothing).count() == 0


def test_density_matches_definition(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, len(quality.STATISTICS)))
    y = (x[:, 0] + 0.3 * rng.normal(size=400) > 0).astype(int)
    frame = spark.createDataFrame([(i, int(y[i]), x[i].tolist()) for i in range(400)], "doc_id bigint, label int, statistics array<double>")
    model = quality.fit(frame, shrink=0.2, ridge=0.0)
    pooled = sum(np.cov(x[y == k].T, bias=True) * (y == k).mean() for k in (0, 1))
    logs = []
    for k in (0, 1):
        cov = 0.8 * np.cov(x[y == k].T, bias=True) + 0.2 * pooled
        d = x - x[y == k].mean(axis=0)
        logs.append(np.log((y == k).mean()) - 0.5 * np.linalg.slogdet(cov)[1] - 0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(cov), d))
    assert np.allclose(model.score(x), 1 / (1 + np.exp(logs[0] - logs[1])), atol=1e-6)


def test_quality_of_odd_rows(spark, make_docs):
    docs = make_docs("A fine text, with words.", None, "", {"text": "bad bad bad", "doc_id": None}, {"text": "bad bad bad", "doc_id": 9}, {"text": "bad bad bad", "doc_id": 9}, "long " * 200_000)
    measured = quality.measure(docs)
    labels = spark.createDataFrame([(0, 1), (9, 0), (9, 0), (6, 1), (77, 1), (1, None), (None, 1)], "doc_id bigint, quality bigint")
    taught = quality.labelled(measured, labels)
    assert taught.count() == 4
    rows = quality.scored(measured, quality.fit(taught)).collect()
    assert len(rows) == 7 and all(0 <= r.score <= 1 for r in rows)
    assert {r.predicted for r in rows if r.doc_id == 9} == {0} and {r.predicted for r in rows if r.doc_id == 0} == {1}
    assert {r.score for r in quality.scored(measured, quality.fit(taught.limit(0))).collect()} == {0.5}
    assert quality.scored(measured.limit(0), quality.fit(taught)).count() == 0
