import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from leadspark.llm import op13_runs as op13


def least_period(w):
    fall = [0] * len(w)
    k = 0
    for i in range(1, len(w)):
        while k and w[i] != w[k]:
            k = fall[k - 1]
        k += w[i] == w[k]
        fall[i] = k
    return len(w) - fall[-1]


def brute(w, shortest=12):
    out = []
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j > i and j + q - i >= max(shortest, 2 * q) and least_period(w[i : j + q]) == q:
                out.append((i, j + q - i, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def fibonacci(n):
    a, b = [0], [0, 1]
    while len(b) < n:
        a, b = b, b + a
    return b[:n]


@pytest.mark.parametrize("letters", [1, 2, 3, 5])
def test_runs_of_random_sequences(letters):
    r = random.Random(letters)
    for k in range(150):
        w = []
        while len(w) < r.randint(1, 90):
            piece = [r.randrange(letters) for _ in range(r.randint(1, 12))]
            w += piece * r.choice([1, 1, 2, 3, 7])
        for shortest in (2, 12):
            assert op13.runs(w, shortest) == brute(w, shortest)
    w = fibonacci(300)
    assert op13.runs(w, 2) == brute(w, 2)


def test_stretches_hold_all_runs():
    r = random.Random(9)
    for _ in range(60):
        docs = []
        for _ in range(4):
            w = []
            while len(w) < r.randint(0, 200):
                piece = [r.randrange(r.choice([3, 50])) for _ in range(r.randint(1, 14))]
                w += piece * r.choice([1, 1, 1, 2, 5])
            docs.append(w)
        raw = [" ".join(f"w{x}" for x in w) for w in docs]
        data = "".join(raw).encode()
        off = np.concatenate(([0], np.cumsum([len(x) for x in raw])))
        found, collapsed = op13.runs_of_rows(np.frombuffer(data, np.uint8), off)
        assert found == [brute(w) for w in docs]


def expected(rows):
    out = []
    for d, t in rows:
        w = re.findall("[^\x20\x09-\x0d]+", t or "")
        n, h = len(w), zlib.crc32(str(d).encode())
        if d is not None and h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        found = brute(w)
        drop = {k for s, m, q in found for k in range(s + q, s + m)}
        best = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else (None,) * 3
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        out.append((d, len(found), *best, best[1] and 1000 * best[1] // best[2], sha("".join(f"{s},{m},{q}\n" for s, m, q in found)), sha(" ".join(x for i, x in enumerate(w) if i not in drop))))
    return sorted(out, key=repr)


def test_query_against_brute_force(spark, tmp_path):
    r = random.Random(6)
    rows = []
    for d in range(200):
        w = []
        while len(w) < r.randint(1, 150):
            piece = ["".join(r.choice("abéB") for _ in range(r.randint(1, 3))) for _ in range(r.randint(1, 20))]
            w += piece * r.choice([1, 1, 1, 1, 2, 4])
        rows.append((d, r.choice([" ", "\n", " \t"]).join(w)))
    rows += [(None, None), (None, "x " * 20), (300, ""), (301, " \n"), (302, None), (7, rows[7][1]), (303, "ab cd " * 3000), (10**12, rows[3][1])]
    spark.createDataFrame([(a, b, 1, "x") for a, b in rows], "doc_id long, text string, start int, runs string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted([tuple(x) for x in op13.op13_periodic_runs(spark, str(tmp_path)).collect()], key=repr)
    assert got == expected(rows)


def test_empty_and_string_ids(spark):
    empty = spark.createDataFrame([], "doc_id string, text string")
    assert op13.find_runs(op13.made_periodic(empty)).count() == 0
    one = spark.createDataFrame([("a", "la " * 14)], "doc_id string, text string")
    assert [tuple(x) for x in op13.find_runs(one).select("doc_id", "runs", "collapsed").collect()] == [("a", [(0, 14, 1)], "la")]
