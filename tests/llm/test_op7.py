import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa

from leadspark.llm import common as C
from leadspark.llm import op7_lm as op7


def low(t):
    return re.sub("[A-Z]", lambda m: m.group().lower(), t or "")


def brute(rows):
    held = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 7 == 2
    toks = [(d, re.findall("[^\x20\x09-\x0d]+", low(t)) + [None]) for d, t in rows]
    c = Counter(w for d, ws in toks if not held(d) for w in ws)
    n, v = sum(c.values()), len(c)
    return sorted([(d, held(d), len(ws), sum(c[w] > 0 for w in ws), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws), 6)) for d, ws in toks], key=repr)


def test_counts_and_base_score(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()] + [(None, "The the THE"), (1000, None), (1001, ""), (1002, "É é Zz" * 9000), (3, "again"), (3, "again")]
    docs = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, pid int")
    got = op7.lm_scores(docs, op7.tokenizer_path()).collect()
    assert sorted([(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got], key=repr) == brute(rows)
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)
    assert op7.lm_scores(docs.limit(0), op7.tokenizer_path()).count() == 0


def test_held_out_texts_are_likelier_than_by_single_ids(spark):
    got = [r for r in op7.op7_lm_scoring(spark, "/root/testdata/sf0.01").collect() if r.held_out]
    score, alone = sum(r.score for r in got), sum(r.unigram_score for r in got)
    assert score > 0.9 * alone


def test_each_id_is_scored_once_in_order():
    counts = np.arange(300.0)
    classes = op7.Classes(counts)
    ids = np.arange(1, 71) % 300
    off = np.array([0, 1, 40, 70])
    before, target, text = op7.windows_of(ids, off, classes.of)
    assert (target < op7.CLASSES).sum() == 70
    for i in range(3):
        mine = target[text == i]
        assert mine[mine < op7.CLASSES].tolist() == classes.of[ids[off[i] : off[i + 1]]].tolist()
    scored = before[:, op7.CONTEXT :]
    follow = scored[(target < op7.CLASSES)]
    want = np.concatenate([[classes.of[ids[-1]], *classes.of[ids[a : b - 1]]] for a, b in zip(off[:-1], off[1:])])
    assert follow.tolist() == want.tolist()
    assert abs(np.exp(classes.within)[classes.of == op7.CLASSES - 1].sum() - 1) < 1e-6


def test_attention_sees_no_future_and_gradient_is_right():
    r = np.random.default_rng(1)
    model = op7.Model(r.normal(0, 0.3, op7.Model.SIZE))
    c = r.integers(0, op7.CLASSES, (3, op7.CONTEXT + op7.SCORED))
    c[0, :10] = op7.CLASSES
    t = r.integers(0, op7.CLASSES, (3, op7.SCORED))
    t[2, 9:] = op7.CLASSES
    other = c.copy()
    other[:, 25:] = 5
    assert np.allclose(model.forward(c)[:, :9], model.forward(other)[:, :9], atol=1e-5)
    g = model.gradient(c, t)
    loss = lambda f: -op7.Model(f).log_probs(c, t).sum(dtype=np.float64) / (t < op7.CLASSES).sum()
    for i in r.integers(0, op7.Model.SIZE, 25).tolist():
        step = np.zeros(op7.Model.SIZE, np.float32)
        step[i] = 1e-2
        near = (loss(model.flat + step) - loss(model.flat - step)) / 2e-2
        assert abs(near - g[i]) < 2e-3 + 0.05 * abs(g[i]), i


def test_tables_give_what_forward_gives():
    r = np.random.default_rng(2)
    model = op7.Model(r.normal(0, 0.3, op7.Model.SIZE))
    c, t = r.integers(0, op7.CLASSES, (40, op7.CONTEXT + op7.SCORED)), r.integers(0, op7.CLASSES, (40, op7.SCORED))
    c[:9, : op7.CONTEXT] = op7.CLASSES
    z = model.forward(c)
    want = np.take_along_axis(z, t[:, :, None], 2)[:, :, 0] - np.log(np.exp(z).sum(2))
    assert np.allclose(model.log_probs(c, t), want, atol=2e-4)


def test_every_window_is_learned_from_once():
    ids, off, of = np.arange(500), np.array([0, 1, 130, 500]), np.arange(500) % op7.CLASSES
    _, every, _ = op7.windows_of(ids, off, of)
    parts = [op7.windows_of(ids, off, of, r, op7.ROUNDS)[1] for r in range(op7.ROUNDS)]
    assert sorted(map(repr, np.concatenate(parts).tolist())) == sorted(map(repr, every.tolist()))


def test_scores_do_not_depend_on_partitions(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").limit(60)
    got = [{r.doc_id: r.score for r in op7.lm_scores(d, op7.tokenizer_path()).collect()} for d in (docs.coalesce(1), docs.repartition(5))]
    assert got[0].keys() == got[1].keys() and all(abs(got[0][k] - got[1][k]) < 1e-6 * abs(got[0][k]) for k in got[0])


def ids_model(r, n=3000):
    counts = np.sort(r.integers(0, 500, n))[::-1].astype(float)
    within = op7.Within(counts, op7.Classes(counts).of)
    model = op7.Model(r.normal(0, 0.3, op7.Model.SIZE))
    return counts, within, model


def test_probabilities_of_all_ids_add_up_to_one_and_depend_on_the_context():
    r = np.random.default_rng(3)
    counts, within, model = ids_model(r)
    classes = op7.Classes(counts)
    h = r.normal(0, 1, (2, op7.WIDTH)).astype(np.float32)
    every = np.arange(len(counts))
    # Before anything is learned they are those of the counts.
    assert np.allclose(within.log_probs(np.repeat(h[:1], len(every), 0), every), classes.within, atol=1e-4)
    within.hold(within.at, r.normal(0, 0.5, within.below.shape).astype(np.float32))
    a, b = (within.log_probs(np.repeat(x[None], len(every), 0), every) for x in h)
    for lp in (a, b):
        assert np.allclose(np.bincount(classes.of, weights=np.exp(lp), minlength=op7.CLASSES), 1, atol=1e-4)
    assert np.abs(a - b).max() > 0.5


def test_gradients_of_ids_and_branches_are_right():
    r = np.random.default_rng(4)
    counts, within, model = ids_model(r)
    at = r.normal(0, 0.3, within.at.shape).astype(np.float32)
    at[-1] = 0
    within.hold(at, r.normal(0, 0.3, within.below.shape).astype(np.float32))
    ids, off = r.integers(0, len(counts), 170), np.array([0, 100, 170])
    before, following, _ = op7.id_windows(ids, off, within)
    loss = lambda: -model.log_probs(before, within.of[following], within, following).sum(dtype=np.float64) / len(ids)
    g, kinds, di, nodes, dn = model.gradient(within.of[before], within.of[following], within, before, following)

    def near(array, i):
        was, step, out = array[i], 1e-2, []
        for x in (was + step, was - step):
            array[i] = x
            out.append(loss())
        array[i] = was
        return (out[0] - out[1]) / (2 * step)

    for i in r.integers(0, len(model.flat), 15).tolist():
        assert abs(near(model.flat, i) - g[i]) < 2e-3 + 0.05 * abs(g[i])
    for i in r.integers(0, len(kinds) - 1, 15).tolist():
        assert abs(near(at, (kinds[i], 3)) - di[i, 3]) < 5e-4 + 0.05 * abs(di[i, 3])
    for i in r.integers(0, len(nodes), 15).tolist():
        assert abs(near(within.below, (nodes[i], 0, 5)) - dn[i, 0, 5]) < 5e-4 + 0.05 * abs(dn[i, 0, 5])


def test_ids_of_one_class_are_told_apart_by_their_context():
    # Rare ids come in fixed pairs; by classes and counts alone a pair's second id is a guess.
    r = np.random.default_rng(5)
    pair = r.integers(0, 400, 20_000)
    ids = np.stack((pair, pair + 400), 1).reshape(-1)
    counts = np.bincount(ids, minlength=900).astype(float)
    classes = op7.Classes(counts)
    within, model = op7.Within(counts, classes.of), op7.Model.start(classes.share)
    before, following, _ = op7.id_windows(ids, np.array([0, len(ids)]), within)
    for _ in range(3):
        model.train_ids(before, following, within)
    lp = model.log_probs(before, within.of[following], within, following)[:, 1::2]
    alone = (classes.within + np.log(classes.share)[classes.of])[400:800].mean()
    assert lp[following[:, 1::2] < 900].mean() > 0.8 * alone


def coded_both_ways(texts):
    whole = op7._subwords(op7._texts(texts)[0], op7.tokenizer_path())
    _, low, off = op7._texts(texts)
    start, end, woff = C.word_bounds(low, off)
    kinds, at = np.unique(C.word_hashes(low, start, end), return_inverse=True)
    assert (op7.place_of(kinds[at], kinds) == at).all()
    return whole, op7.coded_texts(low, off, start, end, woff, at, op7.tokenizer_path())


def test_words_coded_once_give_the_ids_of_whole_texts():
    parts = [*"aab'Sté1,.!", "don't", "́", "\U0001f600", *" " * 8, "\n", "\t", "\r\n", "  ", "\xa0", "　", "\x85", "\x1c", "​", " ", " "]
    for seed in range(100):
        r = np.random.default_rng(seed)
        texts = ["".join(r.choice(parts, r.integers(0, 40))) for _ in range(r.integers(1, 12))]
        whole, coded = coded_both_ways(pa.array([*texts, "", " ", "\n a", "a\n"]))
        assert all((a == b).all() for a, b in zip(whole, coded, strict=True))


def test_a_word_is_coded_once_however_often_it_occurs(monkeypatch):
    given, e = [], op7.encoder(op7.tokenizer_path())

    class Counting:
        max_token_value, decode_single_token_bytes = e.max_token_value, e.decode_single_token_bytes

        def encode_ordinary(self, text):
            given.append(len(text))
            return e.encode_ordinary(text)

    text = "start " + "some words that come again and again\n" * 1000
    low = pa.array([text] * 3)
    whole, _ = coded_both_ways(low)
    monkeypatch.setitem(op7._LOADED, op7.tokenizer_path(), Counting())
    _, words, off = op7._texts(low)
    start, end, woff = C.word_bounds(words, off)
    at = np.unique(C.word_hashes(words, start, end), return_inverse=True)[1]
    assert (op7.coded_texts(words, off, start, end, woff, at, op7.tokenizer_path())[0] == whole[0]).all()
    assert sum(given) < 100


def test_a_batch_of_several_blocks_is_the_sum_of_its_windows():
    # Windows with nothing ahead, with few targets, and more windows than are taken at once.
    r = np.random.default_rng(6)
    counts, within, model = ids_model(r)
    within.hold(r.normal(0, 0.3, within.at.shape).astype(np.float32), r.normal(0, 0.3, within.below.shape).astype(np.float32))
    within.at[-1] = 0
    ids, off = r.integers(0, len(counts), 48 * 39 + 5), np.array([0, 7, 300, 48 * 39 + 5])
    before, following, _ = op7.id_windows(ids, off, within)
    assert len(before) > 2 * op7.BLOCK
    whole = model.gradient(within.of[before], within.of[following], within, before, following)[0] * len(ids)
    single = [model.gradient(within.of[before[[i]]], within.of[following[[i]]], within, before[[i]], following[[i]])[0] * (following[i] < within.ids).sum() for i in range(len(before))]
    assert np.allclose(whole, np.sum(single, 0), rtol=1e-3, atol=2e-3)
