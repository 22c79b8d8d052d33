import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from bibliolake.llm import substrings


def slow(docs, window=13):
    """docs: (id, text); a null id is smaller than any."""
    order = lambda i: float("-inf") if i is None else i
    words = [(i, (t or "").encode().split()) for i, t in docs]
    first = {}
    for i, w in words:
        for k in range(len(w) - window + 1):
            seq = tuple(w[k : k + window])
            first[seq] = min(first.get(seq, float("inf")), order(i))
    rows = []
    for i, w in words:
        gone = set()
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < order(i):
                gone |= set(range(k, k + window))
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        rows.append((i, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return Counter(rows)


def found(frame):
    return Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in frame.collect())


def rows_of(docs):
    return [{"doc_id": i, "text": t} for i, t in docs]


def planted():
    rng = random.Random(11)
    vocabulary = ["a", "b", "The", "the", "é", "x y", "word", "一"]
    shared = [" ".join(rng.choices(vocabulary, k=rng.randint(10, 40))) for _ in range(6)]
    docs = []
    for i in range(80):
        parts = [" ".join(f"u{rng.randrange(10**6)}" for _ in range(rng.randint(0, 15))) for _ in range(4)]
        parts += rng.choices(shared, k=rng.randint(0, 3))
        rng.shuffle(parts)
        docs.append((i * 7 % 80, rng.choice([" ", "\n", " \t "]).join(parts)))
    docs += [docs[3], docs[3], (docs[4][0], docs[5][1]), (None, docs[6][1]), (None, docs[6][1]), (None, None)]
    return docs + [(100, None), (101, ""), (102, " \n"), (103, "a " * 400), (104, "a " * 13), (105, "a " * 12), (-5, "a b " * 20), (106, "b a " * 20)]


@pytest.mark.parametrize(("block", "shard"), [(substrings.BLOCK, substrings.SHARD), (64, 500)])
def test_equal_to_windows_as_tuples(spark, make_docs, monkeypatch, block, shard):
    monkeypatch.setattr(substrings, "BLOCK", block)
    monkeypatch.setattr(substrings, "SHARD", shard)
    monkeypatch.setattr(substrings, "BUCKET", shard)
    docs = planted()
    assert found(substrings.digests(make_docs(*rows_of(docs)).repartition(4))) == slow(docs)


def test_other_windows(spark, make_docs):
    docs = planted()
    for window in (1, 3):
        assert found(substrings.digests(make_docs(*rows_of(docs)), window=window)) == slow(docs, window)


def test_kept_text(spark, make_docs):
    passage = " ".join(f"w{i}" for i in range(20))
    docs = make_docs("one  two " + passage, passage + "\nthree", passage)
    assert [tuple(r) for r in substrings.without_repeats(docs).orderBy("doc_id").collect()] == [
        (0, 22, 0, "one two " + passage), (1, 21, 20, "three"), (2, 20, 20, "")
    ]


def test_long_text_in_pieces(monkeypatch):
    text = " ".join(str(i % 977) for i in range(5000)).encode() + b"  " + b"x" * 300 + b" end"
    whole = substrings.word_hashes(text)
    monkeypatch.setattr(substrings, "PIECE", 64)
    parts = substrings.word_hashes(text)
    assert all(np.array_equal(a, b) for a, b in zip(whole, parts))
    assert substrings._cut(text, np.array([0, 30, 4990, 5002]))[:2] == (5002, 42)


def test_equal_windows_have_equal_hashes_and_others_do_not():
    rng = random.Random(2)
    words = [rng.choice("abc") for _ in range(3000)]
    hashes, checks = substrings.window_hashes(substrings.word_hashes(" ".join(words).encode())[1], 5)
    pairs = {}
    for i in range(len(words) - 4):
        pairs.setdefault(tuple(words[i : i + 5]), set()).add((int(hashes[i]), int(checks[i])))
    assert all(len(v) == 1 for v in pairs.values())
    assert len({min(v) for v in pairs.values()}) == len(pairs)


def test_planes_round_trip():
    for values in (np.array([5, 7, 7, 2**40, -3]), np.array([9, 0, 2**32 - 1], np.uint32), np.empty(0, np.int64)):
        assert np.array_equal(substrings._from_planes(substrings._planes(values), values.dtype.type), values)


def test_equal_hashes_with_other_checks_stay_apart():
    h, g = np.array([5, 5, 5, 5], np.uint64), np.array([1, 2, 1, 2], np.uint16)
    assert substrings._after_the_first(h, g, np.array([3, 1, 4, 1])).tolist() == [False, False, True, False]


def test_empty_table(spark, make_docs):
    assert substrings.digests(make_docs("x").limit(0)).collect() == []


def test_setting_is_given_back(spark, make_docs):
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    substrings.repeated(make_docs("a " * 20, "a " * 20)).collect()
    assert spark.conf.get(name) == before
