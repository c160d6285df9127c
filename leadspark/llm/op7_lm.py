"""Language-model scores of whole texts.

Words: counts over all training documents, add-one smoothed (the base score). The words
of a group of documents are counted in the group's task, summed over groups by word, and
come back to the group, so no row stands for an occurrence.

Subwords: one layer of causal self-attention over subword ids of a public tokenizer,
trained in numpy. Every id has a vector of its own at the input, and the output is a
softmax over all ids in steps (`Within`): ids fall into classes by their counts over all
training documents (the most frequent ones alone, the rest by equal shares), classes into
the branches of a tree with the ids as leaves; the model gives the class and each branch
down to the id from the context. Every window of every training document is learned from
once: each round takes its share of the windows; groups train from common weights, and
their weights are averaged, weighted by windows. Vectors of ids and branches are averaged
over the groups that saw them. Groups are dealt by hash, so the model depends on the
rows alone, not on their partitions. Texts are encoded once and scored in windows of
`CONTEXT + SCORED` ids, of which the last `SCORED` are scored, so each id is scored once;
attention is masked before the text's start and ahead.

Defined results: a null text is empty and has the end token alone; rows whose crc32 of
doc_id as text leaves 2 when divided by 7 are held out; a null doc_id counts as an empty
text there and stays null; repeated rows are counted and scored each; further columns
are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import copy
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leadspark.llm import common as C

CONTEXT, SCORED = 16, 48
WIDTH, CLASSES, ALONE = 16, 64, 40
ROUNDS, BATCH, RATE = 2, 256, 0.04
LENGTH = CONTEXT + SCORED
#: Branches of a node below the classes.
BRANCH = 32
#: Windows whose gradient is made at once.
BLOCK = 16
#: Windows that are scored at once, and such steps before the ids within classes are.
STEP, STEPS = 32, 32
#: Bytes of text in a group of documents.
GROUP_BYTES = 6 << 20
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
END_WORD = np.uint64(0x9FB21C651E98DF25)


def held_out_of(d: str) -> Column:
    name = F.when(F.col(d) != C.NULL_ID, F.col(d).cast("string")).otherwise("")
    return F.crc32(name.cast("binary")) % 7 == 2


#: Exponents are cut here; those of trained models are far from it.
MOST = 60
_ONES = np.ones((CLASSES, 1), np.float32)


def bounded_exp(x: np.ndarray) -> None:
    if x.size and x.max() > MOST:
        np.minimum(x, np.float32(MOST), out=x)
    np.exp(x, out=x)


_ROOM: dict[str, np.ndarray] = {}


def room(name: str, *shape: int) -> np.ndarray:
    """An array of this shape with any content, which is used again under its name."""
    n = math.prod(shape)
    if name not in _ROOM or _ROOM[name].size < n:
        _ROOM[name] = np.empty(n, np.float32)
    return _ROOM[name][:n].reshape(shape)


def flat(a: np.ndarray) -> np.ndarray:
    return a.reshape(-1, a.shape[-1])


class Model:
    """Weights in one vector, so that they can be averaged."""

    SHAPES = {
        "e": (CLASSES + 1, WIDTH), "p": (CONTEXT + SCORED, WIDTH), "q": (WIDTH, WIDTH), "k": (WIDTH, WIDTH),
        "v": (WIDTH, WIDTH), "o": (WIDTH, WIDTH), "w": (WIDTH, CLASSES), "b": (CLASSES,),
    }
    SIZE = sum(math.prod(s) for s in SHAPES.values())

    def __init__(self, flat: np.ndarray) -> None:
        self.flat = flat.astype(np.float32)
        at = 0
        self.w: dict[str, np.ndarray] = {}
        for name, shape in self.SHAPES.items():
            n = math.prod(shape)
            self.w[name] = self.flat[at : at + n].reshape(shape)
            at += n

    @classmethod
    def start(cls, class_share: np.ndarray) -> Model:
        r = np.random.default_rng(7)
        m = cls(r.normal(0, 0.1, cls.SIZE))
        m.w["e"][-1] = 0
        m.w["b"][:] = np.log(class_share)
        return m

    def forward(self, classes: np.ndarray, keep: bool = False):
        """classes: (n, CONTEXT + SCORED), CLASSES where there is nothing. Logits of the
        classes that follow the last SCORED places."""
        w = self.w
        x = w["e"][classes] + w["p"]
        last = x[:, CONTEXT:]
        q, k, v = last @ w["q"], x @ w["k"], x @ w["v"]
        s = q @ k.transpose(0, 2, 1)
        s *= WIDTH**-0.5
        s += _CAUSAL
        if (classes[:, :CONTEXT] == CLASSES).any():
            s += np.where(classes == CLASSES, np.float32(-1e9), np.float32(0))[:, None, :]
            s[:, :, CONTEXT] = np.maximum(s[:, :, CONTEXT], -1e8)  # never all masked
        s -= s.max(2, keepdims=True)
        np.exp(s, out=s)
        s /= s.sum(2, keepdims=True)
        mixed = s @ v
        h = last + mixed @ w["o"]
        logits = h @ w["w"] + w["b"]
        return (logits, x, q, k, v, s, mixed, h) if keep else logits

    def log_probs(self, inputs: np.ndarray, target: np.ndarray, within: Within | None = None, following: np.ndarray | None = None) -> np.ndarray:
        """Natural logarithms of the target classes (n, SCORED); 0 where there is no target.
        The same as `forward`, with each input's and place's part of queries, keys and values in tables.
        With `within`, inputs are ids, and so are `following`, the targets, whose logarithms are given."""
        w = self.w
        e, p = within.inputs(w["e"]) if within else w["e"], w["p"]
        # Keys, values and 1, so that sums of attention come with the mixed values; queries and what is passed by.
        keys = np.concatenate((w["k"], w["v"] @ w["o"], np.zeros((WIDTH, 1), np.float32)), 1)
        asks = np.concatenate((w["q"] * np.float32(WIDTH**-0.5), np.eye(WIDTH, dtype=np.float32)), 1)
        e_keys, p_keys, e_asks, p_asks = e @ keys, p @ keys, e @ asks, p[CONTEXT:] @ asks
        e_keys[:, -1] = 1
        out = np.empty(target.shape, np.float32)
        kept: list[np.ndarray] = []
        for i in range(0, len(inputs), STEP):
            c, t = inputs[i : i + STEP].astype(np.intp), target[i : i + STEP]
            n = len(c)
            k = np.take(e_keys, c, axis=0, out=room("keys", n, LENGTH, 2 * WIDTH + 1), mode="clip")
            k += p_keys
            void = np.flatnonzero(c.reshape(-1) == len(e) - 1)
            if len(void):
                flat(k)[void] = 0
            q = np.take(e_asks, c[:, CONTEXT:], axis=0, out=room("asks", n, SCORED, 2 * WIDTH), mode="clip")
            q += p_asks
            across = room("across", n, WIDTH, LENGTH)
            across[:] = k[:, :, :WIDTH].transpose(0, 2, 1)
            s = np.matmul(q[:, :, :WIDTH], across, out=room("s", n, SCORED, LENGTH))
            bounded_exp(s)
            s *= _SEEN
            mixed = flat(np.matmul(s, k[:, :, WIDTH:], out=room("mixed", n, SCORED, WIDTH + 1)))
            h = mixed[:, :-1] * (np.float32(1) / np.maximum(mixed[:, -1:], np.float32(1e-30)))
            h += flat(q)[:, WIDTH:]
            logits = np.matmul(h, w["w"], out=room("logits", n * SCORED, CLASSES))
            logits += w["b"]
            t = t.reshape(-1)
            top = logits.reshape(-1)[np.arange(0, logits.size, CLASSES) + np.minimum(t, CLASSES - 1)]
            bounded_exp(logits)
            got = np.minimum(top, MOST) - np.log((logits @ _ONES)[:, 0])
            out[i : i + n] = np.where(t == CLASSES, 0, got).reshape(n, SCORED)
            if within:
                kept.append(h)
                if len(kept) == STEPS or i + STEP >= len(inputs):
                    done = slice(i + n - sum(map(len, kept)) // SCORED, i + n)
                    f = following[done].reshape(-1)
                    out[done] += within.log_probs(np.concatenate(kept), f).reshape(-1, SCORED)
                    kept = []
        return out

    def gradient(self, classes: np.ndarray, target: np.ndarray, within: Within | None = None, ids: np.ndarray | None = None, following: np.ndarray | None = None):
        """Of the mean negative logarithm of the targets' probabilities. With `within` also by the
        vectors of input ids and of nodes: (gradient, ids, theirs, nodes, theirs).
        Forward and back go over `BLOCK` windows at once, which stay in the processor's cache. Attention and
        softmax are kept as exponentials: a column of ones gives their sums, by which narrow factors are divided."""
        w, g = self.w, Model(np.zeros(self.SIZE, np.float32))
        rows, scale = len(classes), np.float32(WIDTH**-0.5)
        query, key_value = w["q"] * scale, np.concatenate((w["k"], w["v"]), 1)
        logits_of, back_of = np.concatenate((w["w"], w["b"][None])), w["w"].T.copy()
        across = np.zeros((2 * WIDTH + 1, WIDTH), np.float32)
        across[:-1] = key_value.T
        x, last = room("x", rows, LENGTH, WIDTH), room("last", rows, SCORED, WIDTH)
        kv, kv_across, q = room("kv", rows, LENGTH, 2 * WIDTH + 1), room("kv_across", rows, 2 * WIDTH + 1, LENGTH), room("q", rows, SCORED, WIDTH)
        s, mixed = room("s", rows, SCORED, LENGTH), room("mixed", rows, SCORED, WIDTH + 1)
        h, dx = room("h", rows * SCORED, WIDTH + 1), room("dx", rows, LENGTH, WIDTH)
        np.take(w["e"], classes, axis=0, out=x, mode="clip")
        if within:
            x += np.take(within.at, ids, axis=0, out=dx, mode="clip")
        x += w["p"]
        last[:] = x[:, CONTEXT:]
        h[:, -1] = 1
        blocks = [slice(i, min(i + BLOCK, rows)) for i in range(0, rows, BLOCK)]
        void = [np.flatnonzero(classes[b].reshape(-1) == CLASSES) for b in blocks]
        for i, b in enumerate(blocks):
            np.matmul(flat(x[b]), key_value, out=flat(kv[b])[:, :-1])
            kv[b, :, -1] = 1
            np.matmul(across, x[b].transpose(0, 2, 1), out=kv_across[b])
            kv_across[b, -1] = 1
            if len(void[i]):
                flat(kv[b])[void[i]] = 0
                kv_across[b][void[i] // LENGTH, :, void[i] % LENGTH] = 0
            np.matmul(flat(last[b]), query, out=flat(q[b]))
            np.matmul(q[b], kv_across[b, :WIDTH], out=s[b])
            bounded_exp(s[b])
            s[b] *= _SEEN
            np.matmul(s[b], kv[b, :, WIDTH:], out=mixed[b])
        sums = np.float32(1) / np.maximum(mixed[:, :, -1:], np.float32(1e-30))
        values = flat(mixed)[:, :-1]
        values *= flat(sums)
        np.matmul(values, w["o"], out=h[:, :-1])
        h[:, :-1] += flat(last)
        t = target.reshape(-1).astype(np.intp)
        is_real = t < CLASSES
        if within:
            below, nodes, dn = within.gradient(h[:, :-1], following.reshape(-1))
        to_class = np.zeros((WIDTH + 1, CLASSES), np.float32)
        to_key_value = np.zeros((WIDTH, 2 * WIDTH), np.float32)
        dh = room("dh", rows * SCORED, WIDTH)
        for b in blocks:
            f = slice(b.start * SCORED, b.stop * SCORED)
            p = np.matmul(h[f], logits_of, out=room("p", f.stop - f.start, CLASSES))
            bounded_exp(p)
            total = p @ _ONES[:, 0]
            p.reshape(-1)[np.arange(0, p.size, CLASSES) + np.minimum(t[f], CLASSES - 1)] -= total
            share = (is_real[f] / total)[:, None]
            to_class += (h[f] * share).T @ p
            np.matmul(p, back_of, out=dh[f])
            dh[f] *= share
        if within:
            dh += below
        g.w["w"][:], g.w["b"][:] = to_class[:-1], to_class[-1]
        g.w["o"][:] = values.T @ dh
        dm = np.empty((rows * SCORED, WIDTH + 1), np.float32)
        np.matmul(dh, w["o"].T, out=dm[:, :-1])
        dm[:, -1] = -np.einsum("ij,ij->i", dm[:, :-1], values)
        dm *= flat(sums)
        dm = dm.reshape(rows, SCORED, WIDTH + 1)
        dq = room("dq", rows, SCORED, WIDTH)
        for i, b in enumerate(blocks):
            n = b.stop - b.start
            ds = np.matmul(dm[b], kv_across[b, WIDTH:], out=room("ds", n, SCORED, LENGTH))
            ds *= s[b]
            dkv = room("dkv", n, LENGTH, 2 * WIDTH)
            np.matmul(ds.transpose(0, 2, 1), q[b], out=dkv[:, :, :WIDTH])
            np.matmul(s[b].transpose(0, 2, 1), dm[b, :, :-1], out=dkv[:, :, WIDTH:])
            if len(void[i]):
                flat(dkv)[void[i]] = 0
            np.matmul(ds, kv[b, :, :WIDTH], out=dq[b])
            to_key_value += flat(x[b]).T @ flat(dkv)
            np.matmul(flat(dkv), key_value.T, out=flat(dx[b]))
        g.w["k"][:], g.w["v"][:] = to_key_value[:, :WIDTH], to_key_value[:, WIDTH:]
        g.w["q"][:] = flat(last).T @ flat(dq) * scale
        dh += flat(dq) @ query.T
        dx[:, CONTEXT:] += dh.reshape(last.shape)
        g.w["p"][:] = dx.sum(0)
        mean = np.float32(1 / max(1, is_real.sum()))
        if within:
            kinds, di = summed(ids.reshape(-1), flat(dx))
            di[kinds == within.ids] = 0
            some, de = summed(within.of[kinds], di)
        else:
            some, de = summed(classes.reshape(-1), flat(dx))
        g.w["e"][some] = de
        g.w["e"][-1] = 0
        g.flat *= mean
        return (g.flat, kinds, di * mean, nodes, dn * mean) if within else g.flat

    def train(self, classes: np.ndarray, target: np.ndarray, rate: float = RATE) -> None:
        """One pass with Adam, in an order that mixes the texts."""
        adam = Adam(self.flat, rate)
        for t, part in enumerate(mixed_parts(len(classes)), 1):
            adam.step(t, slice(None), self.gradient(classes[part], target[part]))

    def train_ids(self, ids: np.ndarray, following: np.ndarray, within: Within, rate: float = RATE) -> None:
        """The same with the vectors of ids and nodes, which take a step where a batch has them."""
        whole, at, below = Adam(self.flat, rate), Adam(within.at, rate), Adam(within.below, rate)
        for t, part in enumerate(mixed_parts(len(ids)), 1):
            i, f = ids[part], following[part]
            g, kinds, di, nodes, dn = self.gradient(within.of[i], within.of[f], within, i, f)
            whole.step(t, slice(None), g)
            at.step(t, kinds, di)
            below.step(t, nodes, dn)


class Adam:
    def __init__(self, x: np.ndarray, rate: float) -> None:
        self.x, self.rate, self.m, self.v = x, rate, np.zeros_like(x), np.zeros_like(x)

    def step(self, t: int, at, g: np.ndarray) -> None:
        """A step of the rows `at`; other rows stay as they are."""
        m, v = self.m[at], self.v[at]
        m += np.float32(0.1) * (g - m)
        g = g * g
        g -= v
        g *= np.float32(0.01)
        v += g
        self.m[at], self.v[at] = m, v
        root = np.sqrt(v * np.float32(1 / (1 - 0.99**t)))
        root += np.float32(1e-8)
        m = m / root
        m *= np.float32(self.rate / (1 - 0.9**t))
        self.x[at] -= m


def mixed_parts(n: int) -> Iterator[np.ndarray]:
    order = np.random.default_rng(n).permutation(n)
    return (order[i : i + BATCH] for i in range(0, n, BATCH))


def summed(key: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different keys (small numbers) in order, and the sums of their rows."""
    at = np.zeros(int(key.max(initial=0)) + 1, np.intp)
    at[key] = 1
    some = np.flatnonzero(at)
    at[some] = np.arange(len(some))
    at = at[key]
    out = np.empty((len(some), x.shape[1]), np.float32)
    for i, column in enumerate(np.ascontiguousarray(x.T)):
        out[:, i] = np.bincount(at, weights=column, minlength=len(some))
    return some, out


_CAUSAL = np.where(np.arange(CONTEXT + SCORED)[None, :] > np.arange(CONTEXT, CONTEXT + SCORED)[:, None], np.float32(-1e9), np.float32(0))
_SEEN = (_CAUSAL == 0).astype(np.float32)


class Classes:
    """Of ids, from their counts: (class, log probability within the class)."""

    def __init__(self, counts: np.ndarray) -> None:
        order = np.argsort(-counts, kind="stable")
        self.of = np.empty(len(counts), np.int64)
        self.of[order[:ALONE]] = np.arange(ALONE)
        rest = order[ALONE:]
        mass = np.cumsum(counts[rest] + 0.5)
        self.of[rest] = ALONE + np.minimum((mass / mass[-1] * (CLASSES - ALONE)).astype(np.int64), CLASSES - ALONE - 1)
        smooth = counts + 0.5
        total = np.bincount(self.of, weights=smooth, minlength=CLASSES)
        self.share = (total + 1e-3) / (total + 1e-3).sum()
        self.within = np.log(smooth / total[self.of]).astype(np.float64)


class Within:
    """Ids below their classes. The ids of a class are the leaves of a tree; a node has up to
    `BRANCH` children of about equal mass, each an id or a node. A node's softmax over its
    children is of their counts' logarithms and of learned vectors times the model's output.
    `at` are the vectors of input ids (and of nothing, 0), `below` those of the children."""

    def __init__(self, counts: np.ndarray, of: np.ndarray) -> None:
        self.ids = len(counts)
        self.of = np.append(of, CLASSES).astype(np.uint8)
        kind = np.uint16 if self.ids < 1 << 16 else np.int32
        self.id_kind = kind
        # An id's node and branch; nothing has none.
        self.leaf, self.slot = np.full(self.ids + 1, -1, np.int32), np.zeros(self.ids + 1, np.int8)
        up, up_slot, offset = [], [], []
        order = np.argsort(-counts, kind="stable")
        smooth = counts + 0.5
        by_class = order[np.argsort(of[order], kind="stable")]
        cut = np.searchsorted(of[by_class], np.arange(CLASSES + 1))
        todo = [(by_class[a:b], -1, 0) for a, b in zip(cut[:-1], cut[1:]) if b - a > 1]
        while todo:
            ids, parent, place = todo.pop()
            node = len(up)
            up.append(parent)
            up_slot.append(place)
            mass = smooth[ids]
            # By the middle of an id's mass, so that no branch holds all; ids of equal mass fill their nodes.
            parts = BRANCH if mass[0] > mass[-1] else min(BRANCH, -(-len(ids) // BRANCH))
            part = ((np.cumsum(mass) - mass / 2) / mass.sum() * parts).astype(np.int64) if len(ids) > BRANCH else np.arange(len(ids))
            first = np.flatnonzero(np.diff(part, prepend=-1))
            total = np.full(BRANCH, -1e4)
            total[: len(first)] = np.log(np.add.reduceat(mass, first) / mass.sum())
            offset.append(total)
            for k, (a, b) in enumerate(zip(first, np.append(first[1:], len(ids)))):
                if b - a > 1:
                    todo.append((ids[a:b], node, k))
                else:
                    self.leaf[ids[a]], self.slot[ids[a]] = node, k
        self.up, self.up_slot = np.array(up, np.int32), np.array(up_slot, np.int8)
        self.offset = np.array(offset, np.float32).reshape(-1, BRANCH)
        self.hold(np.zeros((self.ids + 1, WIDTH), np.float32), np.zeros((len(up), BRANCH, WIDTH), np.float32))

    def hold(self, at: np.ndarray, below: np.ndarray) -> None:
        self.at, self.below = at, below

    def bare(self) -> Within:
        """The tree without vectors, to be sent."""
        out = copy.copy(self)
        out.hold(None, None)
        return out

    def inputs(self, e: np.ndarray) -> np.ndarray:
        return e[self.of] + self.at

    def _steps(self, h: np.ndarray, ids: np.ndarray):
        """The branches taken to the ids, by node: rows of h of each level, the order by node, branches,
        the rows' outputs, logits, and of each node (its first row, the end, the node)."""
        row, node, slot, found = np.arange(len(ids)), self.leaf[ids], self.slot[ids], []
        while len(some := np.flatnonzero(node >= 0)):
            row, node, slot = row[some], node[some], slot[some]
            found.append((row, node, slot))
            node, slot = self.up[node], self.up_slot[node]
        if not found:
            return None
        row, node, slot = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.argsort(node.astype(np.uint16) if len(self.up) < 1 << 16 else node, kind="stable")
        node, slot = node[order], slot[order]
        first = np.flatnonzero(np.concatenate(([True], node[1:] != node[:-1])))
        nodes = list(zip(first.tolist(), [*first[1:].tolist(), len(node)], node[first].tolist(), strict=True))
        outputs = np.take(h, row[order], axis=0)
        z = np.empty((len(node), BRANCH), np.float32)
        for a, b, k in nodes:
            np.matmul(outputs[a:b], self.below[k].T, out=z[a:b])
        z += np.take(self.offset, node, axis=0)
        return [r for r, *_ in found], order, slot, outputs, z, nodes

    def log_probs(self, h: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Natural logarithms of the ids' probabilities in their classes, for outputs h."""
        steps = self._steps(h, ids)
        if not steps:
            return np.zeros(len(ids))
        levels, order, slot, _, z, _ = steps
        top = z.reshape(-1)[np.arange(0, z.size, BRANCH) + slot]
        bounded_exp(z)
        got = np.empty(len(z), np.float32)
        got[order] = np.minimum(top, MOST) - np.log(z @ _ONES[:BRANCH, 0])
        out, at = np.zeros(len(ids)), 0
        for row in levels:  # a level has a row once
            out[row] += got[at : at + len(row)]
            at += len(row)
        return out

    def gradient(self, h: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the sum of the negative logarithms: by h, the nodes, by their children's vectors."""
        out = np.zeros(h.shape, np.float32)
        steps = self._steps(h, ids)
        if not steps:
            return out, np.zeros(0, np.int32), np.zeros((0, BRANCH, WIDTH), np.float32)
        levels, order, slot, outputs, z, nodes = steps
        bounded_exp(z)
        z /= (z @ _ONES[:BRANCH, 0])[:, None]
        z.reshape(-1)[np.arange(0, z.size, BRANCH) + slot] -= 1
        by_child = np.empty((len(nodes), BRANCH, WIDTH), np.float32)
        back = np.empty_like(outputs)
        for (a, b, k), child in zip(nodes, by_child, strict=True):
            np.matmul(z[a:b].T, outputs[a:b], out=child)
            np.matmul(z[a:b], self.below[k], out=back[a:b])
        by_level, at = np.empty_like(back), 0
        by_level[order] = back
        for row in levels:  # a level has a row once
            out[row] += by_level[at : at + len(row)]
            at += len(row)
        return out, np.array([k for *_, k in nodes], np.int32), by_child


def windows_of(ids: np.ndarray, off: np.ndarray, of: np.ndarray, share: int = 0, shares: int = 1, nothing: int = CLASSES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """ids: of all texts, each with its end id. Classes ahead of and at each window's scored
    places, targets, and the text of each window; of every `shares` windows one, if given."""
    size = np.diff(off)
    per = -(-size // SCORED)
    text = np.repeat(np.arange(len(size)), per)
    first = (np.arange(len(text)) - np.repeat(np.cumsum(per) - per, per)) * SCORED
    text, first = text[share::shares], first[share::shares]
    place = first[:, None] + np.arange(-CONTEXT, SCORED)[None, :]  # of the target that follows
    cls = np.concatenate((of[ids], np.array([nothing], of.dtype)))
    base = off[text][:, None]
    # The input before target i is id i - 1; before the first it is an end id.
    inside = (place >= 1) & (place < size[text][:, None])
    before = cls[np.where(inside, base + place - 1, len(ids))]
    before[place == 0] = of[ids[-1]]
    at = place[:, CONTEXT:]
    target = cls[np.where(at < size[text][:, None], base + at, len(ids))]
    return before, target, text


def _texts(column: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    raw, off = C.buffers(column)
    low = _LOWER[raw]
    text = pa.LargeStringArray.from_buffers(len(off) - 1, pa.py_buffer(off.astype(np.int64)), pa.py_buffer(low.tobytes()))
    return text, low, off


_LOADED: dict[str, object] = {}


def encoder(path: str):
    """A byte-level vocabulary of ranks; its number of ids is the end id."""
    if path not in _LOADED:
        import base64

        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
        _LOADED[path] = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _LOADED[path]


def tokenizer_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _subwords(texts: pa.Array, tokenizer: str) -> tuple[np.ndarray, np.ndarray]:
    e = encoder(tokenizer)
    end = e.max_token_value + 1
    coded = [np.array([*e.encode_ordinary(t), end], np.int64) for t in texts.to_pylist()]
    if not coded:
        return np.zeros(0, np.int64), np.zeros(1, np.int64)
    return np.concatenate(coded), np.concatenate(([0], np.cumsum([len(x) for x in coded])))


#: First bytes of white space beyond ASCII, and what is such white space.
_WIDE_LEADS = np.isin(np.arange(256), (0xC2, 0xE1, 0xE2, 0xE3))
_WIDE = np.array([chr(c).encode().ljust(3, b"\0") for c in (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)], "S3")


def with_wide_space(low: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Rows that hold white space beyond ASCII."""
    at = np.flatnonzero(_WIDE_LEADS[low])
    after = np.concatenate((low, np.zeros(2, np.uint8)))
    three = np.stack((low[at], after[at + 1], np.where(low[at] == 0xC2, 0, after[at + 2])), 1)
    at = at[np.isin(np.ascontiguousarray(three).view("S3")[:, 0], _WIDE)]
    return np.unique(np.searchsorted(off, at, "right") - 1)


def spans(a: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places a, a + 1, ... of every span, one after another."""
    return np.repeat(a - (np.cumsum(size) - size), size) + np.arange(size.sum())


def opens_with_space(tokenizer: str) -> np.ndarray:
    name = f"{tokenizer}: opens with a space"
    if name not in _LOADED:
        e = encoder(tokenizer)
        _LOADED[name] = np.array([e.decode_single_token_bytes(i)[:1] == b" " for i in range(e.max_token_value + 1)])
    return _LOADED[name]


def coded_texts(low: np.ndarray, off: np.ndarray, start: np.ndarray, end: np.ndarray, woff: np.ndarray, kind: np.ndarray, tokenizer: str) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all texts, each with its end id, and their offsets, as `_subwords` gives them. The pattern
    never joins a word to white space behind it, so a word of a kind is coded once with one space ahead;
    words with other white space ahead, and what ends a text, are coded with it, each kind once; texts with
    white space beyond ASCII as a whole."""
    e, rows, n = encoder(tokenizer), len(off) - 1, len(start)
    row = np.repeat(np.arange(rows), np.diff(woff))
    ahead = np.concatenate(([0], end[:-1])) if n else end
    first = woff[:-1][np.diff(woff) > 0]
    ahead[first] = off[:-1][np.diff(woff) > 0]
    tail = off[:-1].copy()
    tail[np.diff(woff) > 0] = end[woff[1:][np.diff(woff) > 0] - 1]
    wide = np.zeros(rows, bool)
    wide[with_wide_space(low, off)] = True
    plain = (start - ahead == 1) & ~wide[row]
    plain[plain] = low[ahead[plain]] == 32

    # Entries: words with one space ahead, then everything else that occurs, nothing, and the end.
    some = np.flatnonzero(plain)
    one = np.full(int(kind.max(initial=-1)) + 1, -1)
    one[kind[some]] = some
    had = np.flatnonzero(one >= 0)
    one = one[had]
    entry_of = np.zeros(int(kind.max(initial=-1)) + 1, np.intp)
    entry_of[had] = np.arange(len(had))
    joined = low[spans(ahead[one], end[one] - ahead[one])].tobytes().decode()
    ids = np.array(e.encode_ordinary(joined), np.uint32)
    begin = np.flatnonzero(opens_with_space(tokenizer)[ids]) if len(ids) else np.zeros(0, np.intp)
    if len(begin) != len(had):
        raise ValueError("a word with a space ahead has no ids of its own")

    raw, others, more = low.tobytes(), {b"": len(had)}, [np.zeros(0, np.uint32)]

    def entry(a: int, b: int) -> int:
        text = raw[a:b]
        if text not in others:
            others[text] = len(had) + len(more)
            more.append(np.array(e.encode_ordinary(text.decode()), np.uint32))
        return others[text]

    of_word = np.full(n, len(had))
    of_word[some] = entry_of[kind[some]]
    rest = np.flatnonzero(~plain & ~wide[row])
    of_word[rest] = [entry(a, b) for a, b in zip(ahead[rest].tolist(), end[rest].tolist(), strict=True)]
    tail[wide] = off[:-1][wide]
    of_tail = np.full(rows, len(had))
    rest = np.flatnonzero(tail < off[1:])
    of_tail[rest] = [entry(a, b) for a, b in zip(tail[rest].tolist(), off[1:][rest].tolist(), strict=True)]
    more.append(np.array([e.max_token_value + 1], np.uint32))

    size = np.concatenate((np.diff(np.append(begin, len(ids))), [len(x) for x in more]))
    table = np.concatenate((ids, *more))
    # Per text: its words, its tail, its end.
    items = np.empty(n + 2 * rows, np.intp)
    items[np.arange(n) + 2 * row] = of_word
    items[woff[1:] + 2 * np.arange(rows)] = of_tail
    items[woff[1:] + 2 * np.arange(rows) + 1] = len(size) - 1
    length = size[items]
    return table[spans((np.cumsum(size) - size)[items], length)], np.concatenate(([0], np.cumsum(length)[woff[1:] + 2 * np.arange(rows) + 1]))


def place_of(x: np.ndarray, among: np.ndarray) -> np.ndarray:
    """Places of hashes among sorted different hashes that hold them all."""
    bits = len(among).bit_length() + 1
    begin = np.searchsorted(among, np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits))
    at = begin[(x >> np.uint64(64 - bits)).astype(np.intp)]
    left = np.flatnonzero(among[at] != x)
    while len(left):
        at[left] += 1
        left = left[among[at[left]] != x[left]]
    return at


def gather(groups: DataFrame, tokenizer: str) -> DataFrame:
    """By group (pid), kind 0: word (h) and its training count (n; 0 for words of held-out
    texts only); 1: subword id and its training count; 2: the ids of the group's texts, each
    with its end id, their offsets, keys (d, th), and whether they are held out."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        pid: int | None = None
        held: list[tuple] = []  # of each text batch: words' hashes and training counts, ids, sizes, d, th, held out

        def rows(kind: int, h, n, **more) -> pa.RecordBatch:
            k = len(h)
            cols = [pa.array(np.full(k, pid, np.int32)), pa.array(np.full(k, kind, np.int8)), pa.array(h, pa.int64()), pa.array(n, pa.int64())]
            cols += [pa.array([more[x]] if x in more else [None] * k, pa.binary()) for x in BLOBS]
            return pa.RecordBatch.from_arrays(cols, names=["pid", "kind", "h", "n", *BLOBS])

        def close() -> Iterator[pa.RecordBatch]:
            words, in_train, ids, sizes, d, th, out = (np.concatenate(x) for x in zip(*held, strict=True))
            kinds, at = np.unique(words, return_inverse=True) if len(held) > 1 else (words, np.arange(len(words)))
            count = np.bincount(at, weights=in_train, minlength=len(kinds)).astype(np.int64)
            for i in range(0, len(kinds), 50_000):
                yield rows(0, kinds[i : i + 50_000].view(np.int64), count[i : i + 50_000])
            yield rows(0, np.array([END_WORD]).view(np.int64), np.array([(~out).sum()]))
            count = np.bincount(ids[np.repeat(~out, sizes)], minlength=1)
            some = np.flatnonzero(count)
            yield rows(1, some, count[some])
            yield rows(2, [0], [0], ids=ids.astype(narrow(tokenizer)).tobytes(), sizes=sizes.astype("<i8").tobytes(), d=d.tobytes(), th=th.tobytes(), held=out.tobytes())

        for b in C.all_pieces(batches, 1 << 22):
            every = b.column("pid").to_numpy()
            for g in np.unique(every).tolist():
                part = b.filter(pa.array(every == g))
                if pid is not None and g != pid:
                    yield from close()
                    held = []
                pid = g
                out = part.column("held_out").to_numpy(zero_copy_only=False)
                _, low, off = _texts(part.column("text"))
                start, end, woff = C.word_bounds(low, off)
                kinds, at = np.unique(C.word_hashes(low, start, end), return_inverse=True)
                count = np.bincount(at, weights=np.repeat(~out, np.diff(woff)), minlength=len(kinds))
                ids, ioff = coded_texts(low, off, start, end, woff, at, tokenizer)
                held.append((kinds, count, ids, np.diff(ioff), part.column("d").to_numpy(), part.column("th").to_numpy(), out))
        if pid is not None:
            yield from close()

    return groups.mapInArrow(run, "pid int, kind tinyint, h long, n long, " + ", ".join(f"{x} binary" for x in BLOBS))


BLOBS = ("ids", "sizes", "d", "th", "held")


def narrow(tokenizer: str) -> str:
    """The type that holds any id and the end id."""
    return "<u2" if encoder(tokenizer).max_token_value + 1 < 1 << 16 else "<u4"


def groups_of(batches, kind: str) -> Iterator[tuple[np.ndarray, ...]]:
    """(ids, offsets, d, th, held out) of every group."""
    for b in batches:
        for ids, sizes, d, th, held in zip(*(b.column(x) for x in BLOBS), strict=True):
            off = np.concatenate(([0], np.cumsum(np.frombuffer(sizes.as_buffer(), "<i8"))))
            yield np.frombuffer(ids.as_buffer(), kind), off, *(np.frombuffer(x.as_buffer(), t) for x, t in ((d, "<i8"), (th, "<i8"), (held, bool)))


def cuts(off: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Runs of texts with about so many ids (or one text)."""
    at = 0
    while at < len(off) - 1:
        to = max(int(np.searchsorted(off, off[at] + most, "right")) - 1, at + 1)
        yield at, to
        at = to


#: Rows of `WIDTH` numbers that the model takes; those of ids and of nodes' children follow.
WHOLE = Model.SIZE // WIDTH


def split(weights: np.ndarray, ids: int) -> tuple[Model, np.ndarray, np.ndarray]:
    """The model, vectors of ids and of nodes' children: copies."""
    return Model(weights[:WHOLE].ravel().copy()), weights[WHOLE : WHOLE + ids + 1].copy(), weights[WHOLE + ids + 1 :].reshape(-1, BRANCH, WIDTH).copy()


def id_windows(ids: np.ndarray, off: np.ndarray, within: Within, share: int = 0, shares: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return windows_of(ids, off, np.arange(within.ids, dtype=within.id_kind), share, shares, within.ids)


def fit(groups: DataFrame, classes: Classes, within: Within, kind: str) -> np.ndarray:
    """Weights, averaged over the groups by their windows; rows of ids and nodes over the groups that have them."""
    sc = groups.sparkSession.sparkContext
    rows = WHOLE + within.ids + 1 + within.below.shape[0] * BRANCH
    weights = np.zeros((rows, WIDTH), np.float32)
    weights[:WHOLE] = Model.start(classes.share).flat.reshape(-1, WIDTH)
    tree = sc.broadcast(within.bare())
    names = [f"w{i}" for i in range(WIDTH)]
    for r in range(ROUNDS):
        shared = sc.broadcast(weights)

        def run(batches, shared=shared, r=r) -> Iterator[pa.RecordBatch]:
            within, start = tree.value, shared.value
            for ids, off, _, _, held in groups_of(batches, kind):
                size = np.diff(off)[~held]
                if not len(size):
                    continue
                ids = ids[np.repeat(~held, np.diff(off))]
                before, following, _ = id_windows(ids, np.concatenate(([0], np.cumsum(size))), within, r, ROUNDS)
                n = len(before)
                if n:
                    model, at, below = split(start, within.ids)
                    within.hold(at, below)
                    model.train_ids(before, following, within, RATE / (1 + r))
                    got = np.concatenate((model.flat.reshape(-1, WIDTH), at, below.reshape(-1, WIDTH)))
                    moved = np.flatnonzero((got != start).any(1)).astype(np.int32)
                    x = got[moved].astype(np.float64) * n
                    yield pa.RecordBatch.from_arrays([pa.array(moved), pa.array(np.full(len(moved), n, np.int64)), *(pa.array(np.ascontiguousarray(x[:, i])) for i in range(WIDTH))], names=["i", "n", *names])

        means = groups.mapInArrow(run, "i int, n long, " + ", ".join(f"{x} double" for x in names)).groupBy("i").agg(*((F.sum(x) / F.sum("n")).cast("float").alias(x) for x in names))
        # At most one row for each id and branch of the vocabulary, whatever the corpus.
        got = means.toArrow()
        weights = weights.copy()
        weights[got.column("i").to_numpy()] = np.stack([got.column(x).to_numpy() for x in names], 1)
        # A round's weights and shuffled rows are not needed again.
        shared.destroy()
        del means
        C.drop_shuffles(groups.sparkSession)
    tree.destroy()
    return weights


def attention_scores(groups: DataFrame, weights: np.ndarray, classes: Classes, within: Within, kind: str) -> DataFrame:
    """(d, th, score, unigram_score) of every text, repeats included."""
    shared = groups.sparkSession.sparkContext.broadcast((weights, classes, within.bare()))

    def run(batches) -> Iterator[pa.RecordBatch]:
        weights, classes, within = shared.value
        model, *vectors = split(weights, within.ids)
        within.hold(*vectors)
        alone = (classes.within + np.log(classes.share)[classes.of]) / math.log(10)
        for ids, off, d, th, _ in groups_of(batches, kind):
            score, single = [], []
            for a, b in cuts(off, 1 << 19):
                mine, start = ids[off[a] : off[b]], off[a:b] - off[a]
                before, following, text = id_windows(mine, off[a : b + 1] - off[a], within)
                lp = model.log_probs(before, within.of[following], within, following)
                score.append(np.bincount(text, weights=lp.sum(1, dtype=np.float64), minlength=b - a) / math.log(10))
                single.append(np.add.reduceat(alone[mine], start))
            yield pa.RecordBatch.from_arrays([pa.array(d), pa.array(th), pa.array(np.concatenate(score)), pa.array(np.concatenate(single))], names=["d", "th", "score", "unigram_score"])

    return groups.mapInArrow(run, "d long, th long, score double, unigram_score double")


#: The most partitions that texts are dealt to; a partition holds many groups beyond that.
PARTITIONS = 100_000


def lm_scores(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, the columns of the contract, and unigram_score: of the subword ids alone."""
    spark = docs.sparkSession
    C.small_batches(spark)
    docs = docs.select("doc_id", "text")
    rows = C.keyed(docs).withColumn("held_out", held_out_of("d"))
    size = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")).cast("long"))).first()[0] or 0
    parts = int(size // GROUP_BYTES) + 1
    groups = rows.withColumn("pid", F.pmod(F.xxhash64("d", "th"), F.lit(parts)).cast("int")).repartition(min(parts, PARTITIONS), "pid").sortWithinPartitions("pid", "d", "th")
    raw = C.settle(gather(groups, tokenizer))

    words = raw.where("kind = 0").select("pid", "h", "n")
    counts = C.settle(words.groupBy("h").agg(F.sum("n").alias("c")))
    known = counts.where("c > 0").agg(F.sum("c"), F.count("*")).first()
    total, distinct = int(known[0] or 0), int(known[1])
    vocabulary = encoder(tokenizer).max_token_value + 2
    # At most one row for each id of the vocabulary.
    got = raw.where("kind = 1").groupBy("h").agg(F.sum("n").alias("n")).toArrow()
    subwords = np.zeros(vocabulary)
    subwords[got.column("h").to_numpy()] = got.column("n").to_numpy()
    classes = Classes(subwords)
    within = Within(subwords, classes.of)
    kind = narrow(tokenizer)
    coded = raw.where("kind = 2").select(*BLOBS)
    scores = C.settle(attention_scores(coded, fit(coded, classes, within, kind), classes, within, kind).dropDuplicates(["d", "th"]))

    # A word has at most one row for each group, so no word is more than a column of groups.
    sums = words.join(counts, "h").select("pid", "h", "c")

    def base(left: pa.Table, right: pa.Table) -> pa.Table:
        h = right.column("h").to_numpy().view(np.uint64)
        order = np.argsort(h)
        h, c = h[order], right.column("c").to_numpy()[order]
        ends = int(c[np.searchsorted(h, END_WORD)]) if len(h) and (h == END_WORD).any() else 0
        logs10 = np.log10(c + 1.0)
        out = []
        for b in C.all_pieces(left.combine_chunks().to_batches(), 1 << 21):
            _, low, off = _texts(b.column("text"))
            start, end, woff = C.word_bounds(low, off)
            at = place_of(C.word_hashes(low, start, end), h)
            row = np.repeat(np.arange(b.num_rows), np.diff(woff))
            logs = np.bincount(row, weights=logs10[at], minlength=b.num_rows) + math.log10(ends + 1)
            seen = np.bincount(row, weights=c[at] > 0, minlength=b.num_rows).astype(np.int64) + (ends > 0)
            out.append(pa.table({"d": b.column("d"), "th": b.column("th"), "held_out": b.column("held_out"), "n_tokens": pa.array(np.diff(woff) + 1), "n_known": pa.array(seen), "logs": pa.array(logs)}))
        return pa.concat_tables(out).cast(SCHEMA) if out else SCHEMA.empty_table()

    done = groups.groupBy("pid").cogroup(sums.groupBy("pid")).applyInArrow(base, "d long, th long, held_out boolean, n_tokens long, n_known long, logs double")
    norm = math.log10(total + distinct + 1)
    return done.join(scores, ["d", "th"]).select(
        C.doc_id_back(), "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), (F.col("logs") - F.col("n_tokens") * F.lit(norm)).alias("base_score"), "score", "unigram_score"
    )


SCHEMA = pa.schema([("d", pa.int64()), ("th", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("logs", pa.float64())])


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(C.documents(spark, sf_dir), tokenizer_path())


QUERIES = {"op7_lm_scoring": op7_lm_scoring}
ORACLES: dict[str, str] = {}
