import hashlib
import random
from collections import defaultdict

import pytest

from leadspark.llm import op2_suffix_array as op2
from leadspark.llm import op10_automaton as op10


def brute2(rows, length):
    seen = defaultdict(int)
    raws = [(d, (t or "").encode()) for d, t in rows]
    for _, raw in raws:
        for p in range(len(raw) - length + 1):
            seen[raw[p : p + length]] += 1
    out = []
    for d, raw in raws:
        cover = [False] * len(raw)
        for p in range(len(raw) - length + 1):
            if seen[raw[p : p + length]] > 1:
                cover[p : p + length] = [True] * length
        kept = bytes(b for b, c in zip(raw, cover) if not c)
        spans = sum(c and (i == 0 or not cover[i - 1]) for i, c in enumerate(cover))
        out.append((d, len(raw), sum(cover), spans, kept))
    return sorted(out, key=repr)


def brute10(rows, least):
    words = [(d, [w for w in __import__("re").findall("[^\x20\x09-\x0d]+", t or "")]) for d, t in rows]
    first = {}
    for d, ws in words:
        for p in range(len(ws) - least + 1):
            k = tuple(ws[p : p + least])
            first[k] = min(first.get(k, d), d)
    out = []
    for d, ws in words:
        cover = [False] * len(ws)
        for p in range(len(ws) - least + 1):
            if first[tuple(ws[p : p + least])] < d:
                cover[p : p + least] = [True] * least
        out.append((d, len(ws), sum(cover), " ".join(w for w, c in zip(ws, cover) if not c)))
    return sorted(out, key=repr)


def made(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcé") for _ in range(r.randint(1, 4)))
    base = [[word() for _ in range(r.randint(20, 160))] for _ in range(6)]
    rows = []
    for d in range(40):
        b = list(r.choice(base))
        for _ in range(r.randint(0, 4)):
            b[r.randrange(len(b))] = word()
        if r.random() < 0.3:
            b = r.choice(base)[10:60] + b
        rows.append((d, r.choice([" ", "\n", "  "]).join(b)))
    rows += [(100, None), (101, ""), (102, "x" * 3000), (103, "ab " * 900), (104, "ab " * 700 + "c"), (7, rows[7][1]), (50, rows[7][1])]
    return rows


@pytest.mark.parametrize("seed,group", [(1, 256), (2, 3)])
def test_against_brute_force(spark, monkeypatch, seed, group):
    monkeypatch.setattr(op2, "ENTRIES", group)
    monkeypatch.setattr(op10, "SHARD", group)
    rows = made(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    for length, gram in ((60, 12), (400, 64)):
        got = sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in op2.suffix_array_dedup(docs, length, gram).collect()), key=repr)
        assert got == brute2(rows, length)
    got = sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in op10.substring_dedup(docs).collect()), key=repr)
    assert got == brute10(rows, 13)


def test_edges(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert op2.suffix_array_dedup(empty).count() == 0
    assert op10.substring_dedup(empty).count() == 0
    odd = spark.createDataFrame([(None, "w " * 500, 1, "a"), (3, "w " * 500, None, None), (4, None, 2, "b")], "doc_id long, text string, d int, anchor string")
    got = {r.doc_id: r.n_removed for r in op2.suffix_array_dedup(odd).collect()}
    assert got == {None: 1000, 3: 1000, 4: 0}
    got = {r.doc_id: r.n_removed for r in op10.substring_dedup(odd).collect()}
    assert got == {None: 0, 3: 500, 4: 0}


def test_suffix_order_matches_sorting():
    import numpy as np

    r = random.Random(5)
    parts = ["".join(r.choice("ab") for _ in range(r.randint(1, 80))).encode() for _ in range(30)]
    seg = np.concatenate(([0], np.cumsum([len(p) for p in parts])))
    data = np.frombuffer(b"".join(parts), np.uint8)
    got = op2.suffix_order(data, seg, 0 * np.diff(seg), np.diff(seg), 1000).tolist()
    suffix = {int(s) + i: p[i:] for s, p in zip(seg, parts) for i in range(len(p))}
    assert [suffix[p] for p in got] == sorted(suffix.values())


def test_places_beyond_2_to_the_27():
    import numpy as np

    from leadspark.llm import repeats

    mid = np.array([5, 2**31, 2**40])
    back = repeats.unpack(repeats.pack(mid, mid - 336, mid - 5))
    assert [x.tolist() for x in back] == [mid.tolist(), (mid - 336).tolist(), (mid - 5).tolist()]
