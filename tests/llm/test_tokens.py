"""BPE by recursive queries, and binary records."""

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from veridoc.llm import bpe, records, registry, vec
from veridoc.llm.common import bpe as library
from veridoc.llm.common import vocabulary

SF = "/root/testdata/sf0.001"


def texts(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def edge(spark):
    rows = [(None, None, "x"), (5, "", "x"), (5, "", "x"), (-2, "word " * 50000 + "é", None), (3, "a" * 300 + "\n\n 's don't <|endoftext|>  ", "y")]
    return spark.createDataFrame(rows, "doc_id long, text string, token_ids string")


def test_bpe_query(spark):
    enc, docs = library(vocabulary(bpe.VOCABULARY)), texts(spark)
    got = registry.op4_byte_bpe(spark, SF).collect()
    assert sorted(r.doc_id for r in got) == sorted(docs)
    for r in got:
        ids = np.array(enc.encode_ordinary(docs[r.doc_id]), "<u4")
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(docs[r.doc_id].encode()).hexdigest()


def test_bpe_words_equal_library():
    enc, rng = library(vocabulary(bpe.VOCABULARY)), random.Random(2)
    c = bpe.Coder(vocabulary(bpe.VOCABULARY))
    words = [bytes(rng.choice(b" aeionrst\xc3\xa9th") for _ in range(rng.randint(1, 24))) for _ in range(3000)] + [b"a" * n for n in range(1, 80)]
    ids, n = c.encode(words)
    ends = np.cumsum(n)
    for w, s, e in zip(words, ends - n, ends):
        assert ids[s:e].tolist() == enc._core_bpe.encode_single_piece(w), w
    back, sizes = c.decode([ids[s:e].astype("<u4").tobytes() for s, e in zip(ends - n, ends)])
    assert back.tobytes() == b"".join(words) and sizes.tolist() == [len(w) for w in words]


def test_bpe_edges(spark):
    enc = library(vocabulary(bpe.VOCABULARY))
    df = edge(spark)
    encoded = bpe.encode(df)
    assert encoded.columns == ["doc_id", "text", "token_ids"]
    decoded = bpe.decode(encoded).collect()
    assert len(decoded) == 5
    for r in decoded:
        assert r.token_ids == enc.encode_ordinary(r.text or "") and bytes(r.decoded).decode() == (r.text or "")
    assert bpe.digest(df.limit(0)).count() == 0
    with pytest.raises(Exception):
        bpe.decode(spark.createDataFrame([([70000],)], "token_ids array<int>")).collect()
    assert bytes(bpe.decode(spark.createDataFrame([(None,)], "token_ids array<int>")).first().decoded) == b""


def brute_records(docs, tok):
    start, out = 0, []
    for i, t in sorted(docs, key=lambda x: (x[0] is not None, x[0] or 0, x[1] or "")):
        ids = np.array(tok.encode(t or "", add_special_tokens=False).ids + [0], "<u4")
        out.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def test_records_query(spark):
    got = registry.op9_token_records(spark, SF).collect()
    want = brute_records(texts(spark).items(), Tokenizer.from_file(vocabulary(records.VOCABULARY)))
    assert sorted(tuple(r)[:4] for r in got) == sorted(want)


def test_records_edges(spark):
    df = edge(spark)
    got = records.roundtrip(df).collect()
    want = brute_records([(r.doc_id, r.text) for r in df.collect()], Tokenizer.from_file(vocabulary(records.VOCABULARY)))
    assert sorted((tuple(r)[:4] for r in got), key=str) == sorted(want, key=str)
    assert records.roundtrip(df.limit(0)).count() == 0


def test_starts_follow_file_numbers(spark):
    names = [(f"part-{k:05d}-x-c{c:03d}.txt", 10_000 * k + c) for k in (0, 1, 99998, 99999, 100000, 100001, 1000000) for c in (0, 1, 999, 1000)]
    random.Random(1).shuffle(names)
    rows = [(name, at, 1 + n % 7, n) for name, n in names for at in (0, 1 + n % 7)]
    index = spark.createDataFrame(rows, "file string, start_in_file long, n_tokens long, n long")
    got = [(r.n, r.start_in, r.start) for r in records.with_starts(index.selectExpr("*", "start_in_file AS start_in")).collect()]
    want, at = [], 0
    for n in sorted(n for _, n in names):
        want += [(n, 0, at), (n, 1 + n % 7, at + 1 + n % 7)]
        at += 2 * (1 + n % 7)
    assert sorted(got) == want


def test_records_of_one_id_over_files(spark, monkeypatch):
    monkeypatch.setattr(records, "FILE_RECORDS", 7)
    rng = random.Random(3)
    rows = [(rng.choice([None, 5, 5, 6]), rng.choice(["", None, "a b", "c" * rng.randint(0, 9) + str(rng.random())]), "x", 1) for _ in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, start string, id int").repartition(6)
    got = records.roundtrip(df).collect()
    want = brute_records([r[:2] for r in rows], Tokenizer.from_file(vocabulary(records.VOCABULARY)))
    assert sorted((tuple(r)[:4] for r in got), key=str) == sorted(want, key=str)
    assert len({r.file for r in got}) > 300 // 7


def test_added_tokens_have_their_ids():
    path, end = vocabulary(records.VOCABULARY), "<|endoftext|>"
    unaltered = Tokenizer.from_file(path)
    texts = [f"a{end}b", "plain text", end, f" {end}  x\n{end}{end} y ", "<|endo", "ftext|> z", "", f"<|<|endoftext|>{end[:-1]}"]
    ids, off = records.token_ids(*vec.flat(pa.array(texts)), path)
    got = [ids[s:e].tolist() for s, e in zip(off[:-1], off[1:])]
    assert got == [unaltered.encode(t, add_special_tokens=False).ids for t in texts] and got[0] == [64, 50256, 65]


def test_records_damage():
    data = b"".join(records.frame(records.serialize(i, np.array([1, 2, 70000 * (i or 0)]))) + b"\n" for i in (None, 0, 1))
    assert [(i, ids.tolist()) for i, ids in (records.deserialize(p) for _, p in records.records(data))] == [(None, [1, 2, 0]), (0, [1, 2, 0]), (1, [1, 2, 70000])]
    for at in range(len(data)):
        broken = bytearray(data)
        broken[at] ^= 4
        with pytest.raises(ValueError):
            list(records.records(bytes(broken)))
    with pytest.raises(ValueError):
        list(records.records(data[:-1]))
