from bibliolake.llm import language
from bibliolake.llm.common import in_fold


def test_held_out_accuracy(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = language.fit(docs.where(~in_fold(3, 1)))
    assert set(model.languages) == {"germanic", "romance"}
    rows = language.identify(docs.where(in_fold(3, 1)), model).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert rows and sum(r.lang == r.lang_pred for r in rows) >= 0.95 * len(rows)
    assert all(0 <= r.score <= 1 for r in rows)


def test_foreign_texts_and_noise_are_rejected(spark, sf_dir, make_docs):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = language.fit(docs.where(~in_fold(3, 1)))
    held_out = docs.where(in_fold(3, 1))
    assert language.keep_identified(held_out, model).count() == held_out.count()
    foreign = ["Это предложение написано на русском языке", "Το κείμενο αυτό είναι γραμμένο στα ελληνικά", "这是一个中文句子", "qqqq zzzz xxxx"]
    assert language.keep_identified(make_docs(*foreign, "0 x 0 1"), model).count() == 0


def test_copies_count_once_in_the_sample(make_docs, monkeypatch):
    texts = [{"text": f"word{'abcdefghij'[i % 10] * (i // 10 + 1)} the end", "lang": "en"} for i in range(60)]
    copies = [{"text": "der eine und die andere", "lang": "de"}] * 300 + [{"text": "die zweite von allen", "lang": "de"}]
    seen = []
    machine = language._svm
    monkeypatch.setattr(language, "_svm", lambda x, y, *rest: seen.append(y.tolist()) or machine(x, y, *rest))
    model = language.fit(make_docs(*texts, *copies), rows=40)
    # 20 texts of one language, both texts of the other.
    assert sorted(seen[0]) == [-1.0] * 2 + [1.0] * 20 or sorted(seen[0]) == [-1.0] * 20 + [1.0] * 2
    assert model.predict("der eine und die andere")[0] == "de"


def test_floors_follow_the_length():
    assert [language.length_class(n) for n in (1, 3, 4, 15, 16, 64)] == [0, 0, 1, 1, 2, 3]


def test_whole_text_counts():
    text = "ab " * (language.chars.PIECE // 3) + "zz"
    assert (language.features(text, 64) > 0).sum() >= (language.features("ab ab zz", 64) > 0).sum() - 2
    assert language.features("12 !! \n", 64) is None


def test_odd_rows(make_docs):
    rows = [{"text": t, "lang": k, "doc_id": i % 5} for i, (t, k) in enumerate([("the one and the other", "en"), ("der eine und die andere", "de"), ("le premier et la vie", "fr")] * 6)]
    docs = make_docs(*rows, {"text": None, "doc_id": None}, "", "123 !?", {"text": "the end", "lang": None}, "le " * 300_000)
    model = language.fit(docs)
    found = language.identify(docs, model).collect()
    assert len(found) == 23
    assert sorted(r.lang_pred for r in found).count("und") == 3
    assert all(r.score == 0 for r in found if r.lang_pred == "und")
    kept = language.keep_identified(docs, model)
    assert kept.columns == docs.columns and kept.count() == 20
    nothing = language.fit(docs.limit(0))
    assert {r.lang_pred for r in language.identify(docs, nothing).collect()} == {"und"}
    assert language.identify(docs.limit(0), model).count() == 0


def test_single_language_needs_no_machine(make_docs):
    docs = make_docs("the one", "another one")
    assert [(r.lang_pred, r.score) for r in language.identify(docs, language.fit(docs)).collect()] == [("en", 1.0)] * 2
