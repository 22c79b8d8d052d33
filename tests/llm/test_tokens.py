import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from bibliolake.llm import tokens as T

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def merges():
    with open(PATH) as f:
        return T.Merges.from_json(f.read())


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_matches_library_on_odd_texts(merges, library):
    rng = random.Random(9)
    parts = ["a", "B", " ", "  ", "\n", "\t", "'s", "'LL", "I'll", "12", "½", "²", "é", "中文", "\U0001f600", "!!", "--", "_", " ", " ", "\x1c", "\x85", "<|endoftext|>", "<|endoftext", "the", "́", "‍"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 30))) for _ in range(3000)]
    texts += ["", " ", "a" * 5000, "ab" * 3000, " " * 300, "x y" * 2000, "word " * 500 + " ", "\n\n \n x"]
    got = T.TokenCounter(merges).counts(texts)
    want = [len(e) for e in library.encode_batch(texts, add_special_tokens=False)]
    assert [(t, a, b) for t, a, b in zip(texts, got, want) if a != b] == []


def test_long_text_in_pieces(merges, library, monkeypatch):
    text = "It's a  long text\n\nwith 12 words, and  gaps. " * 300
    whole = T.pieces(text)
    monkeypatch.setattr(T, "PIECE", 37)
    assert sum(len(k) * n for k, n in T.pieces(text).items()) == len(text) == sum(len(k) * n for k, n in whole.items())
    assert T.TokenCounter(merges).counts([text]) == [len(library.encode(text, add_special_tokens=False))]


def test_forgets_and_merges_in_batches(merges, library, monkeypatch):
    monkeypatch.setattr(T, "REMEMBERED", 5)
    monkeypatch.setattr(T, "BATCH", 3)
    counter = T.TokenCounter(merges)
    for text in ["some words and more words", "and others here", "some words again"] * 2:
        assert counter.counts([text]) == [len(library.encode(text, add_special_tokens=False))]


def test_whole_table_matches_library(spark, sf_dir, merges, library):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = T.count_tokens(docs, merges).collect()
    assert len(rows) == len(texts)
    for r in rows:
        n = len(library.encode(texts[r.doc_id] or "", add_special_tokens=False))
        assert (r.n_tokens, r.n_bytes, r.over_limit) == (n, len((texts[r.doc_id] or "").encode()), n > 512)


def test_odd_rows(make_docs, merges):
    docs = make_docs(None, "", {"text": "a b", "doc_id": None}, {"text": "a b", "doc_id": None}, "é " * 400_000)
    rows = [tuple(r) for r in T.count_tokens(docs, merges).collect()]
    assert rows[:4] == [(0, 0, 0, False), (1, 0, 0, False), (None, 3, 2, False), (None, 3, 2, False)]
    assert rows[4][1] == 1_200_000 and rows[4][3]
    assert T.count_tokens(docs.limit(0), merges).count() == 0


def test_other_kinds_are_refused(library):
    with open(public_tokenizers.path("word_bpe_49k.json")) as f, pytest.raises(ValueError):
        T.Merges.from_json(f.read())
