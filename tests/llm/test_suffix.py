import collections
import hashlib
import random

import numpy as np
import pytest

from veridoc.llm import chunks, registry, suffix_dedup

SF = "/root/testdata/sf0.001"


def brute(rows, length):
    """(n_bytes, n_removed, n_spans, kept sha) of each row (id, bytes)"""
    least = {}
    for i, b in rows:
        if i is not None:
            for k in range(len(b) - length + 1):
                w = b[k : k + length]
                least[w] = min(least.get(w, i), i)
    out = []
    for i, b in rows:
        gone = bytearray(len(b))
        if i is not None:
            for k in range(len(b) - length + 1):
                if least[b[k : k + length]] < i:
                    gone[k : k + length] = b"\1" * length
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def test_ranks_are_suffix_order():
    rng = np.random.default_rng(1)
    for length in (1, 3, 8, 9, 16, 17, 31, 50):
        buf = rng.integers(97, 99, 400).astype(np.uint8)
        at = np.arange(len(buf) - length + 1)
        strings = [buf[i : i + length].tobytes() for i in at]
        place = {s: k for k, s in enumerate(sorted(set(strings)))}
        assert suffix_dedup.suffix_ranks(buf, at, length).tolist() == [place[s] for s in strings]


def brute_factors(strings, doc, length):
    """The longest begin of each string that a string of a smaller document also begins with"""
    out = []
    for s, d in zip(strings, doc):
        best = 0
        for t, e in zip(strings, doc):
            if e < d:
                k = 0
                while k < length and s[k] == t[k]:
                    k += 1
                best = max(best, k)
        out.append(best)
    return out


@pytest.mark.parametrize("jumps", [48, 0, 1])
def test_longest_previous_factors_equal_brute_force(monkeypatch, jumps):
    monkeypatch.setattr(suffix_dedup, "JUMPS", jumps)
    rng = random.Random(jumps)
    for length in (1, 3, 8, 9, 16, 17, 31, 50, 70):
        for letters, n_docs in (("ab", 4), ("abcd", 30), ("a", 5)):
            buf = np.frombuffer("".join(rng.choice(letters) for _ in range(length + 120)).encode(), np.uint8)
            at = np.array(sorted(rng.sample(range(121), 90)))
            doc = np.array([rng.randrange(n_docs) for _ in at])
            got = suffix_dedup.longest_previous_factors(buf, at, doc, length)
            assert got.tolist() == brute_factors([buf[i : i + length].tobytes() for i in at], doc.tolist(), length)


def test_ascents_of_any_length():
    n = 5000
    value = np.concatenate([np.arange(n), np.zeros(3, np.int64), np.arange(n, 0, -1)])
    least = np.arange(len(value)) % 17
    low, stack = [], []
    for v, m in zip(value.tolist(), least.tolist()):
        while stack and stack[-1][0] >= v:
            m = min(m, stack.pop()[1])
        low.append(m if stack else 0)
        stack.append((v, m))
    assert suffix_dedup._smaller_before(value, least).tolist() == low


@pytest.mark.parametrize("many,salts", [(1, 1), (1, 3), (2, 64)])
def test_hot_minimizers_take_two_steps(spark, monkeypatch, many, salts):
    monkeypatch.setattr(chunks, "CHUNK_BYTES", 300)
    monkeypatch.setattr(chunks, "MANY", many)
    monkeypatch.setattr(suffix_dedup, "SALTS", salts)
    rng = random.Random(many + salts)
    line = "".join(rng.choice("abcdefgh") for _ in range(90))
    texts = ["".join(rng.choice("abcdefgh ") for _ in range(rng.randint(0, 60))) + rng.choice([line, line[:60], line[10:80], line + line]) for _ in range(80)]
    rows = list(zip(rng.sample(range(1000), len(texts)), texts))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = collections.Counter(tuple(r) for r in suffix_dedup.remove_repeats(df).collect())
    assert got == collections.Counter(brute([(i, t.encode()) for i, t in rows], 50))


def test_partitions_are_dealt_one_by_one(spark):
    for n in (3, 12, 51, 211):
        values = chunks.dealt_evenly(n)
        df = spark.createDataFrame([(v,) for v in values], "v int")
        assert sorted(r[0] for r in df.selectExpr(f"pmod(hash(v), {n})").collect()) == list(range(n))
        thrice = chunks.dealt_evenly(n, 3)
        assert len(set(thrice)) == 3 * n and [chunks._murmur(v) % n for v in thrice] == sorted(3 * list(range(n)))


@pytest.mark.parametrize("seed,length,gram,even", [(1, 10, 4, 8192), (2, 10, 10, 0), (3, 50, 16, 8192)])
def test_equals_brute_force(spark, monkeypatch, seed, length, gram, even):
    monkeypatch.setattr(chunks, "CHUNK_BYTES", 300)
    monkeypatch.setattr(chunks, "EVEN", even)
    monkeypatch.setattr(suffix_dedup, "AT_ONCE", 50)
    rng = random.Random(seed)
    passages = ["".join(rng.choice("abcé ") for _ in range(rng.randint(length - 3, 3 * length))) for _ in range(12)]
    texts = []
    for _ in range(70):
        t = "".join(rng.choice([rng.choice(passages), "".join(rng.choice("abcdefgh ") for _ in range(rng.randint(1, 30)))]) for _ in range(rng.randint(0, 8)))
        texts.append(t)
    texts += [texts[3]] * 4 + ["a" * 200] * 3 + ["a" * 60, None, "", "ab" * 40]
    rows = list(zip(rng.sample(range(-500, 10**6), len(texts)), texts))
    rows += [(rows[0][0], rows[0][1]), (rows[1][0], texts[2]), (None, texts[3]), (None, None)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, p string").repartition(3)
    got = collections.Counter(tuple(r) for r in suffix_dedup.remove_repeats(df, length=length, gram=gram).collect())
    assert got == collections.Counter(brute([(i, (t or "").encode()) for i, t in rows], length))


def test_query(spark):
    rows = [(r.doc_id, (r.text or "").encode()) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = [tuple(r) for r in registry.op7_suffix_array_dedup(spark, SF).collect()]
    want = brute(rows, 50)
    assert sorted(got) == sorted(want) and sum(r[2] for r in want) > 1000


def test_query_equals_sql(spark, duck):
    d = "/root/testdata/sf0.01"
    df = registry.op7_suffix_array_dedup(spark, d)
    rel = duck(d).execute(registry.oracle_sql()["op7_suffix_array_dedup"])
    assert sorted(c[0] for c in rel.description) == sorted(df.columns)
    names = [c[0] for c in rel.description]
    assert sorted(map(tuple, df.select(*names).collect())) == sorted(rel.fetchall())


def test_edges(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert suffix_dedup.remove_repeats(empty).count() == 0
    long = spark.createDataFrame([(2, "word " * 60000), (1, "word " * 11)], "doc_id long, text string")
    got = {r.doc_id: r for r in suffix_dedup.remove_repeats(long, with_text=True).collect()}
    assert got[2].n_removed == 300000 and got[2].n_spans == 1 and bytes(got[2].kept) == b"" and got[1].n_removed == 0
    with pytest.raises(ValueError):
        suffix_dedup.remove_repeats(long, length=4, gram=5)


def test_minimizers_are_dealt_evenly():
    import pyarrow as pa

    rng = random.Random(8)
    texts = ["".join(rng.choice("abcdefghij ") for _ in range(3000)) for _ in range(20)]
    c = suffix_dedup.Chunk(pa.table({"id": pa.array(range(20), pa.int64()), "text": texts}), 50, 16)
    held = np.bincount(chunks.ranges(c.names, 8), minlength=8)
    assert held.min() > 0.7 * held.mean() and held.max() < 1.3 * held.mean()


def test_equal_stretches_share_answers(monkeypatch):
    rng = random.Random(5)
    for collide in (False, True):
        if collide:  # hashes that never tell stretches apart
            monkeypatch.setattr(suffix_dedup.vec, "span_hashes", lambda buf, s, e: np.zeros(len(s), np.uint64))
        for _ in range(60):
            base = ["".join(rng.choice("ab") for _ in range(rng.randint(6, 12))) for _ in range(5)]
            parts = [rng.choice(base) for _ in range(25)]
            ids = np.array([rng.randint(0, 8) for _ in parts])
            buf = np.frombuffer("".join(parts).encode(), np.uint8)
            got = suffix_dedup.earlier_in_stretches(buf, np.array([len(p) - 5 for p in parts]), ids, 6)
            held = [(p[k : k + 6], i) for p, i in zip(parts, ids) for k in range(len(p) - 5)]
            least = {}
            for w, i in held:
                least[w] = min(least.get(w, i), i)
            assert got.tolist() == [least[w] < i for w, i in held]
