import random
import re
from collections import defaultdict

import pytest

from leadspark.llm import common as C
from leadspark.llm import op6_ngram_join as op6


def grams(t):
    w = re.findall("[^\x20\x09-\x0d]+", t or "")
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    sets = [grams(t) for _, t in rows]
    n = len(rows)
    root = list(range(n))

    def top(v):
        while root[v] != v:
            v = root[v]
        return v

    links = [0] * n
    for i in range(n):
        for j in range(i):
            if sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-9:
                links[i] += 1
                links[j] += 1
                root[top(i)] = top(j)
    key = lambda d: (d is not None, d)
    low = defaultdict(list)
    for i in range(n):
        low[top(i)].append(rows[i][0])
    return sorted([(rows[i][0], min(low[top(i)], key=key), links[i]) for i in range(n)], key=repr)


@pytest.mark.parametrize("block", [128, 4])
def test_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(op6, "BLOCK", block)
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdé") for _ in range(r.randint(1, 6)))
    base = [[word() for _ in range(r.randint(60, 200))] for _ in range(12)]
    rows = []
    for d in range(200):
        b = list(r.choice(base[: 1 + d % 12]))
        for _ in range(r.randint(0, 3)):
            b[r.randrange(len(b))] = word()
        rows.append((d, r.choice([" ", "\n"]).join(b)))
    rows += [(300, None), (301, ""), (302, " \n"), (303, "one two"), (304, "one  two"), (305, "w " * 9000), (None, rows[0][1]), (7, rows[7][1]), (7, rows[7][1])]
    docs = spark.createDataFrame([(a, b, 1) for a, b in rows], "doc_id long, text string, s1 int").repartition(3)
    got = op6.ngram_classes(C.keyed(docs)).select(C.doc_id_back(), C.doc_id_back("class").alias("c"), "n_links").collect()
    assert sorted([tuple(x) for x in got], key=repr) == brute(rows)


def test_pruning_keeps_true_pairs():
    needed = op6.least_matches()
    assert list(needed) == list(range(16, 129, 16))
    assert 0 < needed[16] < 0.8 * 16 and 60 < needed[128] < 0.8 * 128


def test_empty(spark):
    assert op6.ngram_classes(C.keyed(spark.createDataFrame([], "doc_id long, text string"))).count() == 0
