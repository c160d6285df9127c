import random
import re

import numpy as np
import pytest

from leadspark.llm import op12_tensored as op12


def shingles(t):
    w = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return {tuple(w[i : i + 4]) for i in range(max(1, len(w) - 3))} if w else set()


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def top(v):
        while root[v] != v:
            v = root[v]
        return v

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                root[top(i)] = top(j)
    key = lambda d: (d is not None, d or 0)
    low = {}
    for i, (d, _) in enumerate(rows):
        low.setdefault(top(i), []).append(d)
    out = []
    for i, (d, _) in enumerate(rows):
        least = min(low[top(i)], key=key)
        out.append((d, len(sets[i]), least, d == least))
    return sorted(out, key=repr)


def run(spark, tmp_path, rows):
    spark.createDataFrame([(a, b, 1, "x", 2) for a, b in rows], "doc_id long, text string, name int, key string, n int").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    return sorted([tuple(x) for x in op12.op12_minhash_near_dedup(spark, str(tmp_path)).collect()], key=repr)


@pytest.mark.parametrize("block", [128, 4])
def test_against_brute_force(spark, tmp_path, monkeypatch, block):
    monkeypatch.setattr(op12, "BLOCK", block)
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdéÉAB") for _ in range(r.randint(1, 6)))
    base = [[word() for _ in range(r.randint(60, 200))] for _ in range(12)]
    rows = []
    for d in range(250):
        b = list(r.choice(base[: 1 + d % 12]))
        for _ in range(r.randint(0, 5)):
            b[r.randrange(len(b))] = word()
        t = r.choice([" ", "\n"]).join(b)
        rows.append((d, t.upper() if d % 9 == 0 and t.isascii() else t))
    rows += [(300, None), (301, ""), (302, " \n"), (303, "one two"), (304, "ONE  two"), (305, "w " * 9000), (306, "a b c d"), (None, rows[0][1]), (7, rows[7][1]), (7, rows[7][1]), (7, "other text on the same id"), (None, "a text alone on no id")]
    assert run(spark, tmp_path, rows) == brute(rows)


def test_loose_group_links_beyond_the_hub(spark, tmp_path):
    """A chain: neighbours are alike, far ones are not, so hubs alone do not link it."""
    r = random.Random(8)
    words = [f"w{i}" for i in range(200)]
    rows = []
    for d in range(60):
        rows.append((d, " ".join(words)))
        for _ in range(3):
            words[r.randrange(200)] = f"x{r.random()}"
    assert run(spark, tmp_path, rows) == brute(rows)


def test_tables_find_pairs_at_the_threshold():
    r = np.random.default_rng(3)
    missed = 0
    for _ in range(2000):
        both, one, two = (r.integers(0, 2**63, k, dtype=np.int64).astype(np.uint64) for k in (80, 10, 10))
        sets = [np.sort(np.concatenate((both, x))) for x in (one, two)]
        v = op12.collections(np.concatenate(sets), np.array([0, 90, 180]))
        same = v[0] == v[1]
        missed += not (same[: op12.SIDE].any() and same[op12.SIDE :].any())
    assert missed <= 3


def test_exact_threshold():
    a = np.arange(90, dtype=np.uint64)
    assert op12.alike(a, np.arange(10, 100, dtype=np.uint64))
    assert not op12.alike(a, np.arange(11, 101, dtype=np.uint64))
    assert op12.common_counts([a, np.arange(11, 101, dtype=np.uint64), a[:5]]).tolist() == [[84, 79, 5], [79, 79, 0], [5, 0, 5]]


def test_empty_and_odd_ids(spark, tmp_path):
    assert run(spark, tmp_path, []) == []
    with pytest.raises(TypeError):
        op12.near_copies(op12.C.keyed(spark.createDataFrame([("a", "b")], "doc_id string, text string")))


def test_texts_of_one_common_line_are_not_compared_all_with_all(spark, tmp_path, monkeypatch):
    """Texts that meet in tables by a line alone, and a family about the threshold: blocks get few rows, and no link is lost."""
    monkeypatch.setattr(op12, "BLOCK", 2)
    r = random.Random(5)
    line = [f"line{i}" for i in range(14)]
    rows = [(d, " ".join(line + [f"w{d}x{i}" for i in range(14)])) for d in range(400)]
    base = [f"b{i}" for i in range(150)]
    for d in range(400, 520):
        b = list(base)
        for _ in range(r.randint(0, 12)):
            b[r.randrange(150)] = f"y{r.random()}"
        rows.append((d, " ".join(b)))
    dealt = []
    by_units = op12.by_units

    def counted(units, links):
        if links is op12.block_links:
            dealt.append(units.count())
        return by_units(units, links)

    monkeypatch.setattr(op12, "by_units", counted)
    assert run(spark, tmp_path, rows) == brute(rows)
    assert sum(dealt) < 20 * len(rows)


def test_counts_of_rare_and_common_shingles(monkeypatch):
    monkeypatch.setattr(op12, "COLUMNS", 8)
    r = np.random.default_rng(2)
    sets = [np.unique(np.concatenate((r.integers(0, 30, 20), r.integers(100, 400, 20), 1000 * k + np.arange(1000, 1003)))).astype(np.uint64) for k in range(40)]
    both = op12.common_counts(sets)
    for i in range(40):
        for j in range(i):
            assert both[i, j] == both[j, i] == len(np.intersect1d(sets[i], sets[j]))
