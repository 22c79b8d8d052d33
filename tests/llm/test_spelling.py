import random
import zlib
from collections import Counter

import numpy as np
import pytest

from bibliolake.llm import fmindex, spelling
from bibliolake.llm.queries import op13


def slow_words(docs, shortest=7):
    counts = Counter()
    for key, text in docs:
        runs, run = [], ""
        for c in (text or "") + " ":
            if "A" <= c <= "Z" or "a" <= c <= "z" or "À" <= c <= "ÿ":
                run += chr(ord(c) + 32) if "A" <= c <= "Z" else c
            else:
                runs += [run] if run else []
                run = ""
        for run in runs:
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= shortest and n >= 2}


def is_near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def slow_variants(docs):
    words = slow_words(docs)
    # Words that share a deletion or are one are the only candidates.
    by_rest = {}
    for w in words:
        for rest in {w} | {w[:i] + w[i + 1 :] for i in range(len(w))}:
            by_rest.setdefault(rest, set()).add(w)
    near = {w: set() for w in words}
    for group in by_rest.values():
        for a in group:
            near[a] |= {b for b in group if is_near(a, b)}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= 10 * n else None
    rows = set()
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        rows.add((w, form[w], root, n, len(near[w]), words[form[w]] if form[w] else None))
    return rows


def found(frame):
    rows = [(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in frame.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def points(words):
    return np.array([ord(c) for w in words for c in w]), np.array([len(w) for w in words])


@pytest.mark.parametrize("seed", range(6))
def test_index_finds_every_pair_once(seed):
    rng = random.Random(seed)
    words = set()
    while len(words) < 150:
        w = "".join(rng.choice("abé") for _ in range(rng.randint(7, 10)))
        i = rng.randrange(len(w))
        words |= {w, w[:i] + rng.choice(["", "x", "a", "aa"]) + w[i + 1 :]}
    words = sorted(w for w in words if len(w) >= 7)
    held = sorted(rng.sample(words, 90))
    index = fmindex.Index(*points(held))
    pairs = []
    for length in {len(w) for w in words}:
        asked = [w for w in words if len(w) == length]
        for search in (fmindex.with_first_half, fmindex.with_second_half):
            q, f = search(index, np.array([[ord(c) for c in w] for w in asked]))
            pairs += [(asked[i], held[j]) for i, j in zip(q, f)]
    assert sorted(pairs) == sorted((a, b) for a in words for b in held if is_near(a, b))


def test_intervals_of_both_directions_agree():
    words = ["abracada", "abrakada", "cadabra"]
    index = fmindex.Index(*points(words))
    code = dict(zip("abcdkr", index.codes(np.array([ord(c) for c in "abcdkr"]))))
    start = tuple(np.array([v]) for v in (0, 0, 0, index.size))
    left = index.grow(0, index.grow(0, index.grow(0, start, np.array([code["a"]])), np.array([code["r"]])), np.array([code["b"]]))
    right = index.grow(1, index.grow(1, index.grow(1, start, np.array([code["b"]])), np.array([code["r"]])), np.array([code["a"]]))
    assert left[3] == right[3] == 3  # "bra"
    assert left[1] == right[2] and left[2] == right[1]
    assert not len(index.grow(0, start, index.codes(np.array([ord("z")])))[0])


def noisy(rng, n):
    base = ["".join(rng.choice(["er", "tion", "re", "ou", "th", "éa"]) for _ in range(rng.randint(3, 5))) for _ in range(40)]
    texts = []
    for _ in range(n):
        words = []
        for _ in range(rng.randint(0, 60)):
            w = base[min(int(rng.expovariate(0.15)), len(base) - 1)]
            if rng.random() < 0.1:
                i = rng.randrange(len(w))
                w = w[:i] + rng.choice(["", "e", "o", w[i] * 2]) + w[i + 1 :]
            words.append(w.title() if rng.random() < 0.2 else w)
        texts.append(rng.choice([" ", ", ", " ", "1"]).join(words))
    return texts


@pytest.mark.parametrize("cell", [spelling.CELL, 150])
def test_equal_to_all_pairs(spark, make_docs, cell):
    rows = [{"doc_id": i, "text": t} for i, t in enumerate(noisy(random.Random(7), 120))]
    rows += [{"doc_id": None, "text": rows[0]["text"]}, rows[1], rows[1], {"doc_id": 900, "text": None}, {"doc_id": 901, "text": ""}]
    rows += [{"doc_id": 902, "text": "12 3 ЖЖЖЖЖЖЖЖ ×÷×÷×÷×÷ ×÷×÷×÷×÷"}]
    got = found(spelling.variants(make_docs(*rows).repartition(5), cell=cell))
    want = slow_variants([(r["doc_id"], r["text"]) for r in rows])
    assert got == want
    assert any(form for _, form, *_ in want)


def test_roots_follow_forms_to_the_last(spark):
    rows = [(f"w{i:02}", f"w{i + 1:02}") for i in range(13)] + [("x", "w03"), ("y", "z")]
    got = {r.word: r.root for r in spelling._roots(spark.createDataFrame(rows, "word string, form string")).collect()}
    assert got == {**{f"w{i:02}": "w13" for i in range(13)}, "x": "w13", "y": "z"}


def test_chain_of_forms(spark, make_docs):
    counts = {"aaabbbcc": 2, "aaabbbcd": 20, "aaabbbed": 200}
    words = [w for w, n in counts.items() for _ in range(n)]
    docs = [{"doc_id": i, "text": w} for i, w in enumerate(words)]
    got = found(spelling.variants(make_docs(*docs)))
    assert got == slow_variants([(d["doc_id"], d["text"]) for d in docs])


def test_long_text_in_pieces(spark, make_docs, monkeypatch):
    text = "Wonderful  wonderfull " * 500 + "z" * 5000 + " " + "z" * 4999 + " " + "z" * 5000
    docs = [{"doc_id": 3, "text": text}, {"doc_id": 4, "text": text}]
    assert found(spelling.variants(make_docs(*docs))) == slow_variants([(d["doc_id"], d["text"]) for d in docs])
    monkeypatch.setattr(spelling, "PIECE", 50)
    short = "Wonderful  wonderfull Étététés " * 30
    whole = [r for runs in spelling._runs(short, 7) for r in runs]
    monkeypatch.undo()
    assert whole == [r for runs in spelling._runs(short, 7) for r in runs]


def test_empty_table(spark, make_docs):
    assert spelling.variants(make_docs("x").limit(0)).collect() == []
    assert spelling.variants(make_docs(None, "", "\n")).collect() == []


def test_short_words_are_refused(make_docs):
    with pytest.raises(ValueError):
        spelling.variants(make_docs("x"), shortest=5)


def test_query_equals_all_pairs(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    assert found(op13(spark, sf_dir)) == slow_variants([tuple(d) for d in docs])
