import random
import re
from collections import Counter

from leadspark.llm import op4_decontaminate as op4


def grams(words, n):
    return Counter(tuple(words[i : i + n]) for i in range(len(words) - n + 1))


def brute(docs, items, least=0.8):
    """All windows of each item's size against the item."""
    low = lambda t: re.findall("[^\x20\x09-\x0d]+", "".join(c.lower() if c.isascii() else c for c in (t or "")))
    out = set()
    held = {i: low(t) for i, t in items if low(t)}
    for n in {min(5, len(w)) for w in held.values()}:
        mine = {i: grams(w, n) for i, w in held.items() if min(5, len(w)) == n}
        weigh = lambda g: sum(len(w.encode()) for w in g)
        for d, t in docs:
            ws = low(t)
            here = grams(ws, n).keys() if len(ws) >= n else set()
            for i, c in mine.items():
                if not here & c.keys():
                    continue
                size = len(held[i])
                for p in range(1 - size, len(ws)):  # clipped at the edges
                    w = grams(ws[max(p, 0) : p + size], n)
                    if not w.keys() & c.keys():
                        continue
                    both = sum(weigh(g) * min(k, c[g]) for g, k in w.items())
                    total = sum(weigh(g) * k for g, k in w.items()) + sum(weigh(g) * k for g, k in c.items()) - both
                    if total and both / total >= least:
                        out.add((d, i))
    return out


def test_against_brute_force(spark, monkeypatch):
    r = random.Random(2)
    word = lambda: "".join(r.choice("abcdefgé") for _ in range(r.randint(2, 6)))
    text = lambda n: [word() for _ in range(n)]
    items = [(i, " ".join(text(r.randint(30, 70)))) for i in range(20)] + [(40, None), (41, ""), (42, "just three words"), (43, "x y z w q r s t")]
    items.append((44, items[0][1]))
    docs = []
    for d in range(99):
        w = text(r.randint(0, 150))
        if d % 3 == 0:
            passage = "".join(c.upper() if c.isascii() else c for c in r.choice(items[:20])[1]).split()
            for _ in range(r.choice([0, 0, 1, 1, 2])):
                k = r.randrange(len(passage))
                passage[k : k + r.randint(0, 1)] = [word()]
            at = r.randint(0, len(w))
            w[at:at] = passage[r.choice([0, 0, 0, 1, 3]) :]
        docs.append((d, r.choice([" ", "\n"]).join(w)))
    docs += [(200, None), (201, ""), (202, "so just three words here"), (203, "x y z w q r s t " * 300), (None, items[3][1]), (5, docs[5][1]), (6, docs[3][1])]
    a = spark.createDataFrame([(x, y, "z") for x, y in docs], "doc_id long, text string, item_id string").repartition(3)
    b = spark.createDataFrame(items, "item_id long, text string")
    want = brute(docs, items)
    found = op4.contaminated(a, b).select(op4.C.doc_id_back(), "item_id", "similarity").collect()
    got = {(x.doc_id, x.item_id) for x in found}
    assert got <= want and len(got) >= 0.98 * len(want) and len(want) > 20
    assert all(x.similarity >= 0.8 - 1e-9 for x in found)
    monkeypatch.setattr(op4, "ITEM_BYTES", 1500)
    again = op4.contaminated(a, b).select(op4.C.doc_id_back(), "item_id", "similarity").collect()
    assert sorted(map(repr, again)) == sorted(map(repr, found))  # the blocks decide nothing


def test_words_are_cut_at_ascii_space_only(spark):
    items = [(1, "a b c d\xa0e"), (2, "a\xa0b\xa0c\xa0d\xa0e"), (3, "\xa0"), (4, " \t ")]
    docs = [(1, "x a b c d\xa0e y"), (2, "q a\xa0b\xa0c\xa0d\xa0e r"), (3, "a b c d e"), (4, "n \xa0 m")]
    a = spark.createDataFrame(docs, "doc_id long, text string")
    got = {(r.d, r.item_id) for r in op4.contaminated(a, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == brute(docs, items) == {(1, 1), (2, 2), (4, 3)}


def test_long_items(spark):
    text = " ".join(f"w{i * i % 99991}" for i in range(40_000))
    docs = spark.createDataFrame([(1, "ahead " + text + " after"), (2, text[:1000])], "doc_id long, text string")
    got = op4.contaminated(docs, spark.createDataFrame([(5, text), (6, "b " * 30_000)], "item_id long, text string")).collect()
    assert [(r.d, r.item_id, r.start_word) for r in got] == [(1, 5, 1)]


def test_blocks_find_all_within_radius():
    import numpy as np

    r = random.Random(1)
    items = op4.Items(list(range(50)), [" ".join(str(r.random()) for _ in range(30)) for _ in range(50)], 5)
    prints = items.prints.copy()
    for row in prints:
        row[r.sample(range(128), r.randint(0, op4.RADIUS))] ^= 1
    who, item = items.candidates(prints)
    assert set(range(50)) <= {a for a, b in zip(who.tolist(), item.tolist()) if a == b}
    distance = (prints[:, None] != items.prints[None]).sum(2)
    assert {*zip(who.tolist(), item.tolist())} == {*zip(*map(np.ndarray.tolist, np.nonzero(distance <= op4.RADIUS)))}


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    assert op4.contaminated(none, items).count() == 0
    assert op4.contaminated(items.withColumnRenamed("item_id", "doc_id"), items.limit(0)).count() == 0
