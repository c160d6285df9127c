"""Secrets in whole texts: fixed patterns, and literals assigned to sensitive names.

The lexer reads assignments (`name = value`, `name: value`, `"name": value`,
`name := value`, `name => value`, `<name>value</name>`) with their right sides: quoted
(also by three quotes), bare or called literals (`f("...")`: the quoted arguments), names,
`${name}`, joined by `+`; after a colon the value may stand indented on the next line, and
the pairs inside `name: {...}` count as that name's too. Names are bound in order of the
text, so a literal that reaches a sensitive name through other names is found where it
stands. A literal is scored by the most sensitive name that it reaches, its length and its
entropy; the parts of a joined value, short ones too, by the whole value. In a sum a bare
word is a name, and one that nothing is bound to adds nothing. Not read: conditionals,
scopes (a name is bound for the rest of the text) and values with spaces inside.

Defined results: a null text is empty and has no spans; every row gives one row, also
exactly repeated ones; further columns are ignored; an empty table gives no rows.
Places are code points, ends exclusive.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leadspark.llm import common as C

KINDS = ("assign", "access", "hex", "literal")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
HINTS = ("passw", "secret", "token", "apikey", "api_key")

#: Parts of names, and how sure they make us that a value is secret.
NAMES = {
    "password": 1.0, "passwd": 1.0, "passphrase": 1.0, "pwd": 0.9, "secret": 1.0, "token": 0.8, "apikey": 1.0,
    "privatekey": 1.0, "accesskey": 1.0, "secretkey": 1.0, "credential": 0.9, "credentials": 0.9, "auth": 0.6,
    "signature": 0.5, "bearer": 0.8, "connectionstring": 0.7, "encryptionkey": 1.0, "clientsecret": 1.0,
}
#: Values that stand for a secret without being one.
PLACEHOLDERS = {"changeme", "example", "placeholder", "password", "undefined", "required", "redacted", "localhost", "disabled"}
LEAST = 0.6

_NAME = r"""[A-Za-z_][A-Za-z0-9_.\-]*|"[A-Za-z_][A-Za-z0-9_.\- ]*"|'[A-Za-z_][A-Za-z0-9_.\- ]*'"""
_TERM = r""""{3}[\s\S]*?"{3}|'{3}[\s\S]*?'{3}|[A-Za-z_][\w.]*\([^()\n]*\)|"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*'|\$\{[A-Za-z_][\w.]*\}|[^\s,;+"'{}()\[\]<>|]+"""
#: A value on the next line: indented, and not a pair itself.
_NEXT = r"""[ \t]*(?:[|>][+-]?[ \t]*)?\n[ \t]+(?![^\s:"']+:(?:\s|\Z)|-\s)"""
_PAIR = re.compile(rf"(?<![\w.$-])(?:{_NAME})[ \t]*(?:=>|:=|=|:{_NEXT}|:)(?!=)[ \t]*(?:{_TERM})(?:[ \t]*\+[ \t]*(?:{_TERM}))*")
_HEAD = re.compile(rf"({_NAME})[ \t]*(?:=>|:=|=|:{_NEXT}|:)[ \t]*")
_EACH = re.compile(_TERM)
_QUOTED = re.compile(r""""((?:[^"\\\n]|\\.)*)"|'((?:[^'\\\n]|\\.)*)'""")
_GROUP = re.compile(rf"(?<![\w.$-])({_NAME})[ \t]*(?:=>|=|:)[ \t]*\{{([^{{}}]*)\}}")
_ELEMENT = re.compile(r"<([A-Za-z_][\w.\-]*)(?:\s[^<>]*)?>([^<>\s]{8,})</\1>")
_IDENT = re.compile(r"[A-Za-z_][\w.]*\Z")


def sensitivity(name: str) -> float:
    """How sensitive a target name is, from its parts: `db_apiKey` has db, api, key, apikey."""
    parts = [p.lower() for p in re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+", name)]
    both = parts + ["".join(p) for p in zip(parts, parts[1:])]
    return max((NAMES.get(p, 0.0) for p in both), default=0.0)


def entropy(value: str) -> float:
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values()) if n else 0.0


def literal_score(name_score: float, value: str) -> float:
    """0 to 1: what the name says, times what the value looks like."""
    if len(value) < 8 or value.lower() in PLACEHOLDERS or " " in value.strip() or value.startswith(("http:", "https:", "//")):
        return 0.0
    mixed = 1.0 if re.search(r"\d", value) and re.search(r"[A-Za-z]", value) else 0.75
    return name_score * mixed * min(1.0, entropy(value) / 2.5)


class Joined:
    """What `literal_score` asks of a value, kept without the value, so that joining is cheap."""

    def __init__(self, value: str = "") -> None:
        self.counts = Counter(value)
        self.size, self.head, self.space = len(value), value[:16], not value.strip()
        self.lead = value[: len(value) - len(value.lstrip())].count(" ")
        self.trail = value[len(value.rstrip()) :].count(" ")

    def add(self, more: Joined) -> None:
        self.lead = self.counts[" "] + more.lead if self.space else self.lead
        self.trail = self.trail + more.counts[" "] if more.space else more.trail
        self.space = self.space and more.space
        self.head = (self.head + more.head)[:16] if self.size < 16 else self.head
        self.size += more.size
        self.counts.update(more.counts)

    def score(self, name_score: float) -> float:
        placeholder = self.size <= 16 and self.head.lower() in PLACEHOLDERS
        inner = not self.space and self.counts[" "] > self.lead + self.trail
        if self.size < 8 or placeholder or inner or self.head.startswith(("http:", "https:", "//")):
            return 0.0
        seen = [c for c, k in self.counts.items() if k]
        mixed = 1.0 if any(c.isdecimal() for c in seen) and any(c.isascii() and c.isalpha() for c in seen) else 0.75
        bits = -sum(k / self.size * math.log2(k / self.size) for k in self.counts.values() if k)
        return name_score * mixed * min(1.0, bits / 2.5)


def literals(text: str) -> list[tuple[int, int, float]]:
    """Spans of literals that reach a sensitive name, with their scores. An assignment keeps
    links to its literals and to the assignments that its names stand for; scores go down
    the links once, so the work is in proportion to the links, not to what reaches a name."""
    if "=" not in text and ":" not in text and "</" not in text:
        return []
    bound: dict[str, int] = {}
    terms: list[list[int | tuple[int, int, str]]] = []  # of each assignment
    own: list[float] = []
    groups = [(m.start(2), m.end(2), s) for m in _GROUP.finditer(text) if (s := sensitivity(m.group(1)))] if "{" in text else []
    inside = 0
    for pair in _PAIR.finditer(text):
        head = _HEAD.match(text, pair.start(), pair.end())
        if head is None:
            continue
        name = head.group(1).strip("\"'")
        mine: list[int | tuple[int, int, str]] = []
        right = list(_EACH.finditer(text, head.end(), pair.end()))
        for term in right:
            t = term.group()
            if t[:3] in ('"""', "'''") and len(t) >= 6:
                mine.append((term.start() + 3, term.end() - 3, t[3:-3]))
            elif t[0] in "\"'":
                mine.append((term.start() + 1, term.end() - 1, t[1:-1]))
            elif t[-1] == ")" and "(" in t:
                mine += [(term.start() + m.start(m.lastindex), term.start() + m.end(m.lastindex), m.group(m.lastindex)) for m in _QUOTED.finditer(t) if m.lastindex]
            elif t.startswith("${"):
                if t[2:-1] in bound:
                    mine.append(bound[t[2:-1]])
            elif t in bound:
                mine.append(bound[t])
            elif t != "+" and not (_IDENT.match(t) and (len(right) > 1 or text[term.end() : term.end() + 1] == "(")):
                mine.append((term.start(), term.end(), t))
        bound[name] = len(terms)
        if "." in name:
            bound[name.rpartition(".")[2]] = len(terms)
        terms.append(mine)
        while inside < len(groups) and groups[inside][1] <= pair.start():
            inside += 1
        around = groups[inside][2] if inside < len(groups) and groups[inside][0] <= pair.start() else 0.0
        own.append(max(sensitivity(name), around))
    for m in _ELEMENT.finditer(text) if "</" in text else ():
        terms.append([(m.start(2), m.end(2), m.group(2))])
        own.append(sensitivity(m.group(1)))
    if not any(own):
        return []
    parts: list[int] = []  # 0, 1, or 2 for more
    for mine in terms:
        parts.append(min(2, sum(parts[t] if isinstance(t, int) else 1 for t in mine)))
    reach, need = own[:], [s > 0 and n > 1 for s, n in zip(own, parts, strict=True)]
    for i in range(len(terms) - 1, -1, -1):
        for t in terms[i]:
            if isinstance(t, int):
                reach[t] = max(reach[t], reach[i])
                need[t] = need[t] or need[i]
    values: list[Joined | None] = []
    whole = [0.0] * len(terms)  # score of the best joined value that an assignment is part of
    for i, mine in enumerate(terms):
        value = Joined() if need[i] else None
        if value is not None:
            for t in mine:
                value.add(values[t] if isinstance(t, int) else Joined(t[2]))
            if own[i] and parts[i] > 1:
                whole[i] = value.score(own[i])
        values.append(value)
    best: dict[tuple[int, int], float] = {}
    for i in range(len(terms) - 1, -1, -1):
        for t in terms[i]:
            if isinstance(t, int):
                whole[t] = max(whole[t], whole[i])
            elif reach[i]:
                s = literal_score(reach[i], t[2])
                s = max(s, whole[i])
                if s >= LEAST and t[2]:
                    best[t[0], t[1]] = s
    return sorted((s, e, v) for (s, e), v in best.items())


def scan(text: str) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score) by start, then kind as listed."""
    found: list[tuple[str, int, int, float]] = []
    low = text.lower()
    if any(h in low for h in HINTS):
        found += [("assign", m.start(), m.end(), 1.0) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        found += [("access", m.start(), m.end(), 1.0) for m in ACCESS.finditer(text)]
    found += [("hex", m.start(), m.end(), 1.0) for m in HEX.finditer(text)]
    for start, end, score in literals(text):
        if not any(s <= start and end <= e for _, s, e, _ in found):
            found.append(("literal", start, end, score))
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0])))


def scan_secrets(docs: DataFrame) -> DataFrame:
    """doc_id, text and `found`, an array of struct(kind, start, end, score)."""
    C.small_batches(docs.sparkSession)
    rows = C.texts(docs)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))

    def run(batches) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [[dict(zip(("kind", "start", "end", "score"), x)) for x in scan(t)] for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text"), pa.array(out, kind)], names=["doc_id", "text", "found"])

    id_type = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {id_type}, text string, found array<struct<kind:string,start:bigint,end:bigint,score:double>>")


def joined(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(C.documents(spark, sf_dir))
    n = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("found", lambda s: s["kind"] != "literal")
    return found.select(
        "doc_id",
        n("assign").alias("n_assign"),
        n("access").alias("n_access"),
        n("hex").alias("n_hex"),
        F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"),
        joined(F.col("found")).alias("spans"),
        n("literal").alias("n_literal"),
    )


QUERIES = {"op1_secret_scan": op1_secret_scan}
ORACLES: dict[str, str] = {}
