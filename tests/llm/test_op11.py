import hashlib
import random
import re
import zlib
from functools import lru_cache

import pytest

from leadspark.llm import op11_repair as op11

SPACE = "\x20\x09-\x0d"
NEXT = {"": ("u", "U"), "s": ("u", "U"), "U": ("a", "A"), "A": ("u", "U")}
KEEP = {("", "s"): "s", ("", "u"): "U", ("s", "u"): "U", ("U", "a"): "A", ("A", "u"): "U"}
ROLE = {"u": "user", "a": "assistant"}


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        say = lambda x: " " if x is None else str(x)
        kind = zlib.crc32(f"{say(conv)}:{say(turn)}".encode()) % 20
        role, text = say(role), say(text)
        if kind == 0:
            continue
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        out += [(turn, role, text)] * (2 if kind == 3 else 1)
    return out


def brute(rows):
    """Every edit sequence by recursion; (cost, audit) compared as a pair."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    faults, seen = [], set()
    for _, role, text in rows:
        words = re.findall(f"[^{SPACE}]", text)
        faults.append("b" if not words else "d" if (role, text) in seen else "t" if words[-1] not in ".!?" else "")
        seen.add((role, text))

    @lru_cache(None)
    def best(i, state, inserts):
        options = []
        if i == len(rows) and state in ("", "A"):
            options.append((0, "", ()))
        letter, to = NEXT[state]

        def add(cost, mark, line, rest):
            options.append((cost + rest[0], mark + rest[1], line + rest[2]))

        if inserts < 2:
            add(2, "I", (f"{ROLE[letter]}:",), best(i, to, inserts + 1))
        if i < len(rows):
            _, role, text = rows[i]
            add(3, "D", (), best(i + 1, state, 0))
            if faults[i] in ("", "t"):
                more = 1 if faults[i] else 0
                add(2 + more, "R", (f"{ROLE[letter]}:{text}",), best(i + 1, to, 0))
                if (state, role[:1]) in KEEP:
                    add(more, "K", (f"{role}:{text}",), best(i + 1, KEEP[state, role[:1]], 0))
        return min(options, key=lambda o: o[:2]) if options else (10**9, "", ())

    cost, audit, lines = best(0, "", 0)
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    return (gaps, faults.count("b"), faults.count("d"), faults.count("t"), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def made(r, convs, most):
    rows = []
    for conv in convs:
        turn = 0
        for _ in range(r.randint(1, most)):
            turn += r.choice([1, 1, 1, 2, 5])
            role = r.choice(["system", "user", "user", "assistant", "assistant", "tool", "", None])
            rows.append((conv, r.choice([turn] * 9 + [None]), role, r.choice([f"{turn} a.", "b!", "c ? \n", "d", "é ", "", " \t", None, f"{turn} z"])))
    # Rows of one turn come in the order of role, hash, text: leave no two with one turn and role.
    return list({(a, b, "user" if b is None else c): (a, b, "user" if b is None else c, d) for a, b, c, d in rows}.values())


@pytest.mark.parametrize("spread", [True, False])
def test_against_brute_force(spark, spread):
    r = random.Random(5)
    rows = made(r, [None, *range(150)], 9) + made(r, [1000, 1001], 120)
    rows += [(2000, 5, "user", "x " * 60000 + "."), (2000, 5, "user", "x " * 60000 + "."), (2000, 6, "assistant", "y.")]
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(key, str(not spread).lower())
    try:
        df = spark.createDataFrame([(*x, 1, 2) for x in rows], "conv_id long, turn long, role string, text string, part int, copies int").repartition(3)
        hurt = op11.damaged(df)
        parts = op11.repair(hurt).collect()
        assert not spread or len({(x["conv_id"], x["part"]) for x in parts}) > len({x["conv_id"] for x in parts})
        got = {x["conv_id"]: x for x in op11.with_digests(op11.repair(hurt)).collect()}
    finally:
        spark.conf.unset(key)
    for conv in {x[0] for x in rows}:
        left = damage([x for x in rows if x[0] == conv])
        if not left:
            assert conv not in got
            continue
        x = got[conv]
        gaps = 0 if x["high"] is None else x["high"] - x["low"] + 1 - x["turns"]
        assert (gaps, *(x[n] for n in ("blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"))) == brute(left), conv


def test_query_keeps_every_conversation(spark, tmp_path):
    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    spark.createDataFrame([(gone, 0, "user", "hi."), (7, None, None, None)], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {x["conv_id"]: x for x in op11.op11_conversation_repair(spark, str(tmp_path)).collect()}
    assert set(got) == {gone, 7}
    x = got[gone]
    assert (x["gaps"], x["blank"], x["cost"], x["audit"], x["repaired_sha256"]) == (0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert (got[7]["blank"], got[7]["cost"], got[7]["audit"]) == (1, 3, "D")


def test_empty(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert op11.with_digests(op11.repair(op11.damaged(df))).count() == 0


def test_matrices_compose():
    r = random.Random(2)
    codes = [(r.choice("suax"), r.choice(["", "t", "b", "d"])) for _ in range(60)]
    v = op11.closed(op11.ENDS)
    for lo, hi in ((40, 60), (13, 40), (0, 13)):
        m = op11.matrix(codes[lo:hi])
        v = tuple(min(m[i * 4 + j] + v[j] for j in range(4)) for i in range(4))
    w = op11.closed(op11.ENDS)
    for row in reversed(codes):
        w = op11.before(row, w)
    assert v == w
