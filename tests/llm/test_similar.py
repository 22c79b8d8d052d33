import random

import numpy as np

from bibliolake.llm import similar


def slow_shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def similarity(a, b):
    x, y = slow_shingles(a), slow_shingles(b)
    return len(x & y) / len(x | y) if x | y else 1.0


def planted(seed=11, bases=40):
    """Texts with copies of some edits each, a passage that many share and hard clean ones."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(3000)]
    passage = " ".join(rng.choices(vocabulary, k=60))
    texts = []
    for number in range(bases):
        words = rng.choices(vocabulary, k=rng.choice([30, 80, 200, 500]))
        if number % 3 == 0:
            words += passage.split()
        texts.append(" ".join(words))
        for _ in range(rng.randint(0, 6)):
            changed = list(words)
            for _ in range(rng.randint(0, max(1, len(words) // 45))):
                changed[rng.randrange(len(changed))] = rng.choice(vocabulary)
            texts.append(" ".join(changed))
        texts.append(" ".join(words[: len(words) // 2] + rng.choices(vocabulary, k=len(words) // 2)))
    return texts


def slow_groups(texts):
    group = list(range(len(texts)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    linked = []
    for i, a in enumerate(texts):
        for j in range(i):
            if similarity(a, texts[j]) >= 0.8:
                linked.append((j, i))
                x, y = root(i), root(j)
                group[max(x, y)] = min(x, y)
    return [root(i) for i in range(len(texts))], linked


def test_shingles_match_definition():
    assert [len(similar.shingles(t)) for t in (None, "", " \n", "one", "A b c d e", "a b c d e f", "a " * 50)] == [0, 0, 0, 1, 1, 2, 1]
    assert similar.sketch("A  b c\td e")[0] == similar.sketch("a b c d e")[0] != similar.sketch("a b c d f")[0]


def test_long_text_in_blocks(monkeypatch):
    text = " ".join(str(i) for i in range(500))
    whole = similar.sketch(text)
    monkeypatch.setattr(similar, "BLOCK", 7)
    assert similar.sketch(text) == whole


def test_closest_links_join_as_all_do():
    rng = np.random.default_rng(2)
    a, b, d = rng.integers(0, 60, 90), rng.integers(0, 60, 90), rng.integers(0, 19, 90)
    taken = similar.closest_links(a, b, d, 60)
    every = similar.join_groups(np.arange(60), a, b)
    assert np.array_equal(every, similar.join_groups(np.arange(60), a[taken], b[taken]))
    assert len(taken) == 60 - len(np.unique(every))


def test_groups_match_all_pairs(spark, make_docs):
    texts = planted()
    found = {r.doc_id: r.group_id for r in similar.groups(make_docs(*texts)).collect()}
    expected, linked = slow_groups(texts)
    together = sum(found[a] == found[b] for a, b in linked) / len(linked)
    assert len(linked) > 150 and together >= 0.97
    # Nothing is grouped that links do not reach.
    assert all(expected[i] == expected[g] for i, g in found.items())


def test_one_huge_group_emits_few_links(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(400)]
    texts = []
    for _ in range(300):
        changed = list(words)
        changed[rng.randrange(400)] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(changed))
    rows = [(s[0] - 2**64 if s[0] >> 63 else s[0], s[1] - 2**64 if s[1] >> 63 else s[1], [k - 2**64 if k >> 63 else k for k in s[2]]) for s in {similar.sketch(t)[0]: similar.sketch(t) for t in texts}.values()]
    sketches = spark.createDataFrame(rows, "node bigint, fp bigint, keys array<bigint>")
    for size in (similar.TREE, 50):
        links = similar.candidates(sketches, tree_size=size)
        pairs = [(r.a, r.b) for r in links.collect()]
        assert all(a < b for a, b in pairs)
        assert len(pairs) < 300 * 299 / 2 / 4
        nodes = sorted(r[0] for r in rows)
        place = {n: i for i, n in enumerate(nodes)}
        group = similar.join_groups(np.arange(len(nodes)), *np.array([[place[a], place[b]] for a, b in pairs]).T)
        assert len(np.unique(group)) == 1


def test_odd_rows(spark, make_docs):
    text = " ".join(f"word{i}" for i in range(300))
    docs = make_docs(text, None, "", text + " more", {"text": text, "doc_id": None}, {"text": text, "doc_id": 0}, "other text here", "Other  text here", "other text there", "y " * 100_000)
    found = similar.groups(docs).collect()
    assert len(found) == 10
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.group_id) for r in found) == [(-1, 0), (0, 0), (0, 0), (1, 1), (2, 1), (3, 0), (6, 6), (7, 6), (8, 8), (9, 9)]
    clashing = docs.selectExpr("*", "1 AS node", "2 AS a", "'x' AS first", "3 AS keys", "map('k', 1) AS m")
    kept = similar.keep_one(clashing)
    assert kept.columns == clashing.columns
    assert sorted(r.doc_id for r in kept.collect()) == [0, 1, 6, 8, 9]
    assert similar.groups(docs.limit(0)).count() == 0 == similar.keep_one(docs.limit(0)).count()
    only = make_docs({"text": "a b", "doc_id": None}, {"text": "a b", "doc_id": None})
    assert similar.keep_one(only).count() == 1


def test_distant_link_alone_joins(spark, make_docs, monkeypatch):
    """Texts in one band whose closest fingerprints are not alike: the links of all pairs
    are found, however few are checked at first."""
    monkeypatch.setattr(similar, "FIRST", 1)
    monkeypatch.setattr(similar, "MORE", 2)
    texts = [f"{side} " + " ".join(f"w{i}" for i in range(n)) for n in (20, 22, 24, 27, 30) for side in ("a", "b")]
    # Every text has all bands in common, and its fingerprint says little.
    nodes = {similar.sketch(t)[0]: i for i, t in enumerate(texts)}

    @similar.F.pandas_udf("node bigint, fp bigint, keys array<bigint>")
    def close(column: similar.pd.Series) -> similar.pd.DataFrame:
        node = [similar.sketch(t)[0] for t in column]
        signed = np.array(node, np.uint64).view(np.int64)
        return similar.pd.DataFrame({"node": signed, "fp": [(1 << (nodes[n] * 3 % 10)) - 1 for n in node], "keys": [np.array([1])] * len(node)})

    monkeypatch.setattr(similar, "sketch_column", lambda text="text": close(similar.F.col(text)))
    found = {r.doc_id: r.group_id for r in similar.groups(make_docs(*texts)).collect()}
    expected, _ = slow_groups(texts)
    assert [found[i] for i in range(len(texts))] == expected


def test_unlike_texts_of_one_band_send_few_links(spark, make_docs, monkeypatch):
    """Texts that all meet in each band, hardly any of them alike: no step may send a row for
    each pair of them, and no link may be lost."""
    rng = random.Random(6)
    common = [f"w{i}" for i in range(60)]
    texts = [" ".join(common + rng.choices(["u", "v", "x", "y", "z"], k=40)) for _ in range(80)]
    texts += [t + " end" for t in texts[:10]]

    @similar.F.pandas_udf("node bigint, fp bigint, keys array<bigint>")
    def close(column: similar.pd.Series) -> similar.pd.DataFrame:
        node = np.array([similar.sketch(t)[0] for t in column], np.uint64).view(np.int64)
        return similar.pd.DataFrame({"node": node, "fp": [n & 0x3FF for n in node], "keys": [np.array([1, 2])] * len(node)})

    monkeypatch.setattr(similar, "sketch_column", lambda text="text": close(similar.F.col(text)))
    monkeypatch.setattr(similar, "TREE", 30)
    written, through_table = {}, similar.through_table

    def counted(df, name):
        table = through_table(df, name)
        written[name] = max(written.get(name, 0), table.count())
        return table

    monkeypatch.setattr(similar, "through_table", counted)
    found = {r.doc_id: r.group_id for r in similar.groups(make_docs(*texts)).collect()}
    expected, linked = slow_groups(texts)
    assert 0 < len(linked) < 100
    assert [found[i] for i in range(len(texts))] == expected
    assert max(written.values()) <= 10 * len(texts)


def test_joining_in_shards(spark, make_docs, monkeypatch):
    """The same groups when the texts of a band are cut into shards by their bytes."""
    texts = planted(seed=3, bases=12)
    docs = make_docs(*texts)
    whole = {r.doc_id: r.group_id for r in similar.groups(docs).collect()}
    monkeypatch.setattr(similar, "BYTES", 2_000)
    monkeypatch.setattr(similar, "CHECKED", 100)
    assert {r.doc_id: r.group_id for r in similar.groups(docs).collect()} == whole
