import re
from collections import Counter, defaultdict

import pytest

from bibliolake.llm import divergence


def slow(docs, least=10, top=10):
    """docs: (lang, source, text)."""
    counts, in_docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for lang, source, text in docs:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        terms = re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", low)
        counts[lang, source].update(terms)
        in_docs[lang].update(set(terms))
    rows = set()
    for lang in {g[0] for g in groups}:
        kept = [t for t, n in in_docs[lang].items() if n >= least]
        sources = sorted(s for a, s in groups if a == lang)

        def shares(of):
            total = sum(of[t] for t in kept)
            return {t: 1 + 10**9 * (of[t] + 2) // (total + 2 * len(kept)) for t in kept}

        p = {s: shares(counts[lang, s]) for s in sources}
        q = shares(sum((counts[lang, s] for s in sources), Counter()))
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pairs = [(-sum(f(p[s][t], p[o][t]) for t in kept), o) for o in sources if o != s]
            terms = [(-f(p[s][t], q[t]), t) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, items in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
                rows |= {(lang, s, part, item, -v, i + 1) for i, (v, item) in enumerate(items)}
    return rows


def found(frame):
    rows = [(r.lang, r.source, r.part, r.item, r.value, r["rank"]) for r in frame.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def frame_of(make_docs, docs):
    return make_docs(*[{"lang": a, "source": s, "text": t} for a, s, t in docs])


def some_docs():
    words = ["alpha", "Beta", "gamma", "déjà", "Été", "naïve", "中文", "it's", "x1y"]
    docs = []
    for i in range(200):
        text = " ".join(words[(i * k + k * k) % len(words)] for k in range(1 + i % 9))
        docs.append((["en", "fr", None][i % 3], ["s0", "s1", None, "s0", "s0"][i % 5], text))
    docs += [("xx", "a", "rare words"), ("xx", "b", None), ("xx", None, "")]  # no kept term
    docs += [("en", "empty", None), ("en", "empty", "12 34"), ("fr", "one", "alpha " * 5000)] + [("en", "s0", docs[0][2])] * 5
    return docs


@pytest.mark.parametrize("small", [False, True])
def test_equal_to_all_terms_and_sources(spark, make_docs, monkeypatch, small):
    if small:
        for name, value in (("BLOCK", 50), ("PIECE", 40), ("SHARD", 2000), ("ROWS", 3)):
            monkeypatch.setattr(divergence, name, value)
    docs = some_docs()
    assert found(divergence.audit(frame_of(make_docs, docs).repartition(4))) == slow(docs)


def test_other_limits(spark, make_docs):
    docs = some_docs()
    assert found(divergence.audit(frame_of(make_docs, docs), least_docs=1, top=2)) == slow(docs, 1, 2)


def test_shares_of_large_counts_are_exact(spark):
    n, total, terms = 9 * 10**14, 10**15 + 7, 12345
    row = spark.range(1).select(divergence._share(*[divergence.F.lit(x).cast("bigint") for x in (n, total, terms)]).alias("p")).first()
    assert row.p == 1 + 10**9 * (n + 2) // (total + 2 * terms)


def test_empty_table(spark, make_docs):
    assert divergence.audit(make_docs("x").limit(0)).collect() == []


def test_long_text_in_pieces(monkeypatch):
    text = ("Word wörd, " * 50).encode()
    whole = [t for some in divergence._terms(text) for t in some]
    monkeypatch.setattr(divergence, "PIECE", 7)
    assert [t for some in divergence._terms(text) for t in some] == whole
