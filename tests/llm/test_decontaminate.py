import re

import numpy as np

from bibliolake.llm import decontaminate as D

ITEM = "Anna buys 12 apples for 3 euros each. How much does Anna pay for 12 apples in total? Her friend Bert has none."


def slow_template(text):
    """Token by token."""
    out, previous, start = [], None, True
    for token in re.findall(r"[^\W\d_]+|\d+(?:[.,]\d+)*|[.!?:\n\r]+", text):
        if token[0] in ".!?:\n\r":
            start, previous = True, None
            continue
        low = token.lower()
        if token[0].isdigit():
            out.append(("number", low))
        elif previous == "number" and low in D.UNITS:
            out.append(("unit", low))
        elif not start and token[0].isupper() and token[1:].islower():
            out.append(("name", low))
        else:
            out.append((low, None))
        previous, start = out[-1][0] if out[-1][1] else None, False
    return out


def slow_windows(text):
    t = slow_template(text)
    size = min(D.WINDOW, len(t))
    rows = [(i, t[i : i + size]) for i in range(len(t) - size + 1)] if size else []
    return [(i, tuple(k for k, _ in w), [v for _, v in w if v]) for i, w in rows if sum(v is None for _, v in w) >= min(D.LITERALS, size)]


def slow_leaks(docs, items):
    found = set()
    for doc, text in docs:
        for item, question in items:
            asked, readings = slow_windows(question), {}
            for i, kinds, values in slow_windows(text or ""):
                for j, other, wanted in asked:
                    if kinds == other:
                        readings.setdefault(i - j, []).append((j, list(zip(wanted, values))))
            covered = set()
            for windows in readings.values():
                pairs = {p for _, ps in windows for p in ps}
                fits = len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs})
                covered |= {j for j, ps in windows if fits or not ps}
            if asked and len(covered) >= D.COVERAGE * len(asked):
                found.add((doc, item))
    return found


def test_templates_and_windows():
    for text in [ITEM, "", "one", "ONE!! TWO!! 3 km", "3 km 4.5 kg. Paris is in France\nBerlin In", "1 2 3 4 5 6 a b", "x² ½ 1.5.2, 3..4 _a_b É \U0001f600 \U00020000z Éa Ab", "In Ümlaut 3 KM. ß"]:
        t = D.Templates([text], D._unit_hashes())
        places, hashes = t.windows()
        slow = slow_windows(text)
        assert places.tolist() == [i for i, _, _ in slow]
        assert [t.values(i) for i in places] == [v for _, _, v in slow]
        assert len(set(hashes.tolist())) == len({k for _, k, _ in slow})


def test_texts_side_by_side():
    texts = ["tiny", "", "12", "km Anna a b c d", "a b", ITEM, "Then Anna has"]
    t = D.Templates(texts, D._unit_hashes())
    places, hashes = t.windows()
    alone = [D.Templates([x], D._unit_hashes()) for x in texts]
    assert hashes.tolist() == [h for a in alone for h in a.windows()[1].tolist()]
    assert [t.values(i) for i in places] == [a.values(i) for a in alone for i in a.windows()[0]]
    assert (t.owner[places] == np.repeat(np.arange(7), [len(a.windows()[0]) for a in alone])).all()


def test_pieces_of_a_long_text_join(monkeypatch):
    text = "Then Anna walks 12 km to Bonn. There " * 40
    one = D.Templates([text], D._unit_hashes())
    monkeypatch.setattr(D, "PIECE", 50)
    many = D.Templates([text], D._unit_hashes())
    assert (one.hashes == many.hashes).all() and (one.slots == many.slots).all()
    assert [one.values(i) for i in one.windows()[0]] == [many.values(i) for i in many.windows()[0]]


def test_reparameterised_and_inconsistent(spark, make_docs):
    other = ITEM.replace("Anna", "Carla").replace("12", "40").replace(" 3 ", " 7 ")
    mixed = ITEM.replace("pay for 12", "pay for 99").replace("does Anna", "does Emil")
    texts = ["Some words before. " + ITEM + " And after.", "x " * 3000 + other, mixed, "nothing of the kind here", ITEM[:40]]
    items = spark.createDataFrame([(7, ITEM), (8, "tiny"), (9, None), (10, ""), (7, ITEM)], "item_id bigint, text string")
    rows = D.contaminated(make_docs(*texts), items).collect()
    assert {(r.doc_id, r.item_id) for r in rows} == slow_leaks(list(enumerate(texts)), [(7, ITEM), (8, "tiny")]) >= {(0, 7), (1, 7)}
    assert {r.doc_id: r.reparameterised for r in rows}[1] and not {r.doc_id: r.reparameterised for r in rows}[0]
    assert 3 not in {r.doc_id for r in rows}


def test_matches_all_pairs_on_tables(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    rows = D.contaminated(docs, items)
    found = {(r.doc_id, r.item_id) for r in rows.collect()}
    assert found == slow_leaks([tuple(r) for r in docs.select("doc_id", "text").limit(10**6).collect()], [tuple(r) for r in items.collect()])
    assert found
    kept = D.keep_clean(docs, items)
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in docs.collect()} - {d for d, _ in found}


def test_odd_rows(spark, make_docs):
    items = spark.createDataFrame([(1, ITEM)], "item_id bigint, text string")
    docs = make_docs(None, "", {"text": ITEM, "doc_id": None}, {"text": ITEM, "doc_id": 5}, {"text": ITEM, "doc_id": 5}, "tiny")
    assert sorted((r.doc_id or -1) for r in D.contaminated(docs, items).collect()) == [-1, 5, 5]
    kept = D.keep_clean(docs, items)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [0, 1, 5]
    assert D.keep_clean(docs, items.limit(0)).count() == 6
    assert D.contaminated(docs.limit(0), items).count() == 0


def test_names_that_begin_sentences(spark, make_docs):
    inside = "Tom has 5 apples. Tom buys 3 more apples. How many apples does Tom have?"
    never = "Marta paints 4 walls in one day. Marta rests on the next one. Then how many walls are painted after 6 days?"
    around = "plain words that stand before and after it " * 50
    texts = [
        around + inside.replace("Tom", "Anna").replace("5", "7").replace("3", "4") + " " + around,
        around + never.replace("Marta", "Igor").replace("4 ", "9 ") + " " + around,
        # Two names for one, so these are no readings of the item.
        inside.replace("Tom has", "Anna has").replace("Tom buys", "Emil buys"),
        inside, never, around,
    ]
    items = spark.createDataFrame([(1, inside), (2, never)], "item_id bigint, text string")
    rows = D.contaminated(make_docs(*texts), items).collect()
    assert {(r.doc_id, r.item_id, r.reparameterised) for r in rows} == {(0, 1, True), (1, 2, True), (3, 1, False), (4, 2, False)}
    assert all(r.windows <= r.n_windows for r in rows)
