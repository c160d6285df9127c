import random
import struct
import zlib

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from leadspark.llm import common as C
from leadspark.llm import op5_sentencepiece as op5
from leadspark.llm import op8_token_tables as op8

ODD = [
    None, "", " ", "   ", "\n", "a", "Hello world", "  two  spaces\n\n next ", "ﬁ①é漢字 \U0001f600", "x" * 3000, "ab" * 900 + " " + "=" * 500,
    "it's they'll 'S 12ab3 \x85a\xa0b  c  d\x1c e\x0bf ​ g　　h   i \t  x", "tab\t\there \r\n", "don't  <|endoftext|> stop<|endoftext|>", "a▁b ▁", "…—“”‘’" * 20,
]


def texts():
    r = random.Random(8)
    out = list(ODD)
    for _ in range(150):
        out.append("".join(r.choice("abcdefghijklmnopqrstuvwxyzABC0123456789'’.,;:!?  \n\té漢 ") for _ in range(r.randint(0, 300))))
        out.append(" ".join("".join(r.choice(["tion", "er", "the", "in", "ou", "éau", "sch"]) for _ in range(r.randint(1, 5))) for _ in range(r.randint(0, 60))))
    return out


def test_encoding_equals_the_library():
    sp = sentencepiece.SentencePieceProcessor(model_file=op5.model_path())
    p = op5.pieces(op5.model_path())
    all_texts = [t or "" for t in texts()]
    for part in (all_texts, all_texts[:40]):
        got = p.encode(part)
        for t, ids in zip(part, got):
            assert np.frombuffer(ids, "<u4").tolist() == sp.encode(t), t
        for t, back in zip(part, p.decode(got)):
            assert back == t.replace("▁", " ")


def test_edges_are_all_occurrences():
    p = op5.pieces(op5.model_path())
    data = "▁there▁▁▁▁▁▁▁▁▁▁▁▁▁▁▁▁▁éa".encode()
    raw = np.frombuffer(data, np.uint8)
    starts = np.flatnonzero((raw & 0xC0) != 0x80)
    s, e, _ = p.edges(data, starts, np.full(len(starts), len(data)))
    known = set(p.text)
    want = [(i, j) for i in starts.tolist() for j in range(i + 1, len(data) + 1) if data[i:j] in known]
    assert list(zip(s.tolist(), e.tolist())) == want


def test_round_trip(spark):
    rows = [(i if i else None, t, "q") for i, t in enumerate(texts())] + [(5, "a", "q")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = op5.round_trip(docs, op5.model_path()).collect()
    assert len(got) == len(rows) and all(r.exact for r in got)
    sp = sentencepiece.SentencePieceProcessor(model_file=op5.model_path())
    assert sorted(r.n_tokens for r in got) == sorted(len(sp.encode(t or "")) for _, t, _ in rows)
    back = op5.decode(op5.encode(docs.where("text is not null"), op5.model_path()), op5.model_path()).collect()
    assert all(r.decoded == r.text.replace("▁", " ") for r in back)
    assert op5.round_trip(docs.limit(0), op5.model_path()).count() == 0


def test_token_tables(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(op8, "BLOCK", 300)
    rows = [(i * 3 - 50 if i else None, t, "q") for i, t in enumerate(texts())] + [(-20, "again and again", "q"), (-20, "again", "q")]
    random.Random(1).shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string, path string")
    shards = op8.write_tables(docs, op8.tokenizer_path(), f"file://{tmp_path}/t")
    got = op8.read_tables(shards).collect()
    tok = Tokenizer.from_file(op8.tokenizer_path())
    ids = lambda t: tok.encode(t or "", add_special_tokens=False).ids + [2]
    want = {}
    for d, t, _ in rows:
        want.setdefault(C.NULL_ID if d is None else d, []).append(struct.pack(f"<{len(ids(t))}I", *ids(t)))
    by = {}
    for r in sorted(got, key=lambda r: r.start):
        by.setdefault(r.d, []).append((r.start, bytes(r.ids)))
    assert {d: sorted(v) for d, v in want.items()} == {d: sorted(x for _, x in v) for d, v in by.items()}
    at = 0
    for d in sorted(by):
        for start, x in by[d]:
            assert start == at
            at += len(x) // 4
    paths = [r.path for r in shards.collect()]
    for d in (-20, 7, 100, 10**6):
        found = [x for p in paths for x in op8.Shard(p).lookup(d)]
        assert sorted(found) == sorted(want.get(d, []))
    shard = op8.Shard(paths[0])
    missing = sum(all(shard.bloom[p >> 3] >> (p & 7) & 1 for p in op8._bloom_places(d, shard.bits)) for d in range(10**7, 10**7 + 2000))
    assert missing < 100
    assert op8.read_tables(op8.write_tables(docs.limit(0), op8.tokenizer_path(), f"file://{tmp_path}/e")).count() == 0


def test_query_digest(spark):
    got = {r.doc_id: r for r in op8.op8_token_tables(spark, "/root/testdata/sf0.001").collect()}
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").collect()
    tok = Tokenizer.from_file(op8.tokenizer_path())
    at = 0
    for d in docs:
        ids = tok.encode(d.text, add_special_tokens=False).ids + [2]
        r = got[d.doc_id]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)))
        at += len(ids)


def test_tied_suffixes_and_equal_scores_are_merged_as_in_the_library():
    # Chunks whose suffixes agree in 8 or 16 bytes, among them runs longer than any piece.
    sp = sentencepiece.SentencePieceProcessor(model_file=op5.model_path())
    p = op5.Pieces(op5.model_path())
    part = [a + b for a in ("", "inter", "aaaa", "éé", "aaaaaaaaaaaaaaaaaaa") for b in ("nationalisation", "nationalisations", "aaaaaaaaaaaaaaaa", "=" * 40, "ééééééééé", "ation" * 9)]
    assert [np.frombuffer(x, "<u4").tolist() for x in p.encode(part)] == [sp.encode(t) for t in part]
    # Bytes of a broken character, and no texts at all.
    lone = np.array([p.byte_id[0xC3], p.byte_id[0x41]], "<u4").tobytes()
    assert p.decode([b"", lone, b""]) == ["", "�A", ""] and p.decode([]) == []
