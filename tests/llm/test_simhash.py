import random
from collections import Counter

import numpy as np
import xxhash

from bibliolake.llm import bktree, simhash
from bibliolake.llm.components import components


def slow_print(text):
    words, word = [], ""
    for c in (text or "") + " ":
        if c in " \t\n\r\x0b\x0c":
            words += [word] if word else []
            word = ""
        else:
            word += chr(ord(c) + 32) if "A" <= c <= "Z" else c
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << j for j in range(64) if 2 * sum(h >> j & 1 for h in hashes) > len(hashes))


def slow_components(prints):
    """prints: (id, fp) pairs."""
    group = {i: i for i, _ in enumerate(prints)}

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i, (_, a) in enumerate(prints):
        for j, (_, b) in enumerate(prints[:i]):
            if bin((a ^ b) & (2**64 - 1)).count("1") <= 3:
                group[root(i)] = root(j)
    least = {}
    for i, (k, _) in enumerate(prints):
        if k is not None:
            least[root(i)] = min(k, least.get(root(i), k))
    return Counter((k, f"{f & (2**64 - 1):016x}", least.get(root(i))) for i, (k, f) in enumerate(prints))


def test_fingerprint_matches_definition():
    rng = random.Random(1)
    texts = ["", None, " \n", "one", "Two WORDS", "a b c", "É é Éa b x\x1fy z", "x " * 5000, "\ud800 a b c"]
    texts += [" ".join(rng.choices(["Ab", "cd", "É", "f g"], k=rng.randint(1, 60))) for _ in range(60)]
    for text in texts:
        if text and "\ud800" in text:
            simhash.fingerprint(text)
        else:
            assert simhash.fingerprint(text) == slow_print(text)


def test_long_text_in_blocks():
    text = " ".join(str(i) for i in range(simhash.BLOCK + 100))
    assert simhash.fingerprint(text) == slow_print(text)


def test_trees_find_all_within_radius():
    rng = np.random.default_rng(3)
    seed = rng.integers(0, 2**63, 3, dtype=np.uint64)
    flips = np.array([[1 << int(b) for b in rng.integers(0, 64, 3)] for _ in range(400)], np.uint64)
    values = np.unique(np.bitwise_xor.reduce(flips, axis=1) ^ seed[rng.integers(0, 3, 400)])
    tree = np.sort(rng.integers(0, 4, len(values)))
    tree = np.unique(tree, return_inverse=True)[1]
    query, node = bktree.Forest(values, tree).within(values, tree, 3)
    found = set(zip(query.tolist(), node.tolist()))
    near = np.bitwise_count(values[:, None] ^ values[None, :]) <= 3
    assert found == {(int(i), int(j)) for i, j in zip(*np.nonzero(near & (tree[:, None] == tree[None, :])))}


def planted(n=300):
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(25)]
    prints = []
    for i in range(n):
        f = rng.choice(base)
        for _ in range(rng.choice([0, 0, 1, 2, 3, 4, 6])):
            f ^= 1 << rng.randrange(64)
        prints.append((i * 3 % n if i % 17 else None, f - 2**64 if f >= 2**63 else f))
    return prints + [prints[0], (n, 0), (n + 1, 0), (None, 7)]


def test_components_match_all_pairs(spark):
    prints = planted()
    frame = spark.createDataFrame(prints, "doc_id bigint, fp bigint")
    for size in (simhash.TREE, 3):
        found = simhash.links(frame.select("fp").distinct(), size)
        assert all(bool(r.a != r.b) for r in found.collect())
        rows = frame.join(simhash.assign(frame), "fp").select("doc_id", simhash.as_hex(), "component_id").collect()
        assert Counter(tuple(r) for r in rows) == slow_components(prints)


def test_small_shards_link_the_same(spark):
    frame = spark.createDataFrame(planted(), "doc_id bigint, fp bigint").select("fp").distinct()
    sets = []
    for size in (simhash.TREE, 2):
        groups = {}
        for r in components(simhash.links(frame, size)).collect():
            groups.setdefault(r.root, set()).add(r.node)
        sets.append(sorted(map(sorted, groups.values())))
    assert sets[0] == sets[1]


def test_chain_is_one_component(spark):
    pairs = [(i, i + 1) for i in range(200)] + [(500, 501)]
    rows = components(spark.createDataFrame(pairs, "a bigint, b bigint")).collect()
    assert {(r.node, r.root) for r in rows} == {(i, 0) for i in range(201)} | {(500, 500), (501, 500)}


def test_odd_rows(make_docs):
    text = " ".join(f"word{i}" for i in range(300))
    docs = make_docs(text, None, "", text + " more", {"text": text, "doc_id": None}, {"text": text, "doc_id": 0}, "other text here")
    rows = simhash.near_copies(docs).collect()
    assert len(rows) == 7
    assert {r.component_id for r in rows if r.doc_id in (0, 3, None)} == {0}
    assert {(r.doc_id, r.component_id, r.fingerprint) for r in rows if r.doc_id in (1, 2)} == {(1, 1, "0" * 16), (2, 1, "0" * 16)}
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [0, 1, 6]
    assert simhash.near_copies(docs.limit(0)).count() == 0 == simhash.keep_one(docs.limit(0)).count()
