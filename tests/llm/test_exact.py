"""Distinct texts stay distinct whatever hashes say, and pieces are those of the libraries."""

import hashlib
import random
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Regex, Tokenizer, pre_tokenizers

from veridoc.llm import bpe, common, jaccard, quality, records, token_counts, vec
from veridoc.llm.common import bpe as library
from veridoc.llm.common import vocabulary


def thue_morse(n, a="a", b="b"):
    return "".join(a if i.bit_count() % 2 == 0 else b for i in range(n))


#: Words that polynomial hashes modulo a power of two take for each other.
TWINS = [(thue_morse(n), thue_morse(n, "b", "a")) for n in (1024, 2048, 4096)]


def test_twin_words_in_every_operator(spark):
    rows = [(2 * k + i, f"{w} and more words") for k, pair in enumerate(TWINS) for i, w in enumerate(pair)]
    rows += [(100 + i, f"{a}\n{b}\n{a}\n x y z") for i, (a, b) in enumerate(TWINS)]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    docs = dict(rows)
    path = vocabulary(bpe.VOCABULARY)
    for r in bpe.digest(df).collect():
        ids = np.array(library(path).encode_ordinary(docs[r.doc_id]), "<u4")
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(docs[r.doc_id].encode()).hexdigest()
    for r in token_counts.attribute_tokens(df).collect():
        assert r.n_tokens == len(library(path).encode_ordinary(r.text))
    assert {r.doc_id: r.n_dup_lines for r in quality.assess(df).collect()} == {i: int(i >= 100) for i in docs}
    tok = Tokenizer.from_file(vocabulary(records.VOCABULARY))
    for r in records.roundtrip(df).collect():
        ids = np.array(tok.encode(docs[r.doc_id], add_special_tokens=False).ids + [0], "<u4")
        assert (r.n_tokens, r.ids_crc32) == (len(ids), zlib.crc32(ids.tobytes()))
    one_word = spark.createDataFrame([(i, w) for i, w in enumerate(w for pair in TWINS for w in pair)], "doc_id long, text string")
    assert all(r.component_id == r.doc_id for r in jaccard.join_groups(one_word).collect())


def brute_distinct(buf, start, end):
    seen = {}
    return [seen.setdefault(buf[s:e].tobytes(), i) for i, (s, e) in enumerate(zip(start, end))]


@pytest.mark.parametrize("bits", [64, 3, 0])
def test_hashes_that_collide_change_nothing(monkeypatch, bits):
    real = vec.span_hashes
    monkeypatch.setattr(vec, "span_hashes", lambda buf, s, e, salt=0: real(buf, s, e, salt) & np.uint64((1 << bits) - 1) | np.uint64(salt << 8))
    rng = random.Random(bits)
    for _ in range(30):
        texts = ["".join(rng.choice("ab") for _ in range(rng.choice([0, 1, 2, 3, 8, 9, 70, 71]))) for _ in range(40)]
        buf, off = vec.flat(pa.array(texts))
        _, first, inverse = vec.distinct(buf, off[:-1], off[1:])
        assert [first[i] for i in inverse] == brute_distinct(buf, off[:-1], off[1:])
    cache = vec.PieceCache(lambda found: (np.concatenate([np.frombuffer(x, np.uint8) for x in found]), np.fromiter(map(len, found), np.int64)), np.uint8, bound=3000)
    for _ in range(60):
        texts = ["".join(rng.choice("ab") for _ in range(rng.randint(1, 5))) for _ in range(30)]
        buf, off = vec.flat(pa.array(texts))
        slots = cache.slots(buf, off[:-1], off[1:])
        assert cache.gather(slots).tobytes() == buf.tobytes() and cache.lengths(slots).tolist() == np.diff(off).tolist()


def test_a_cache_holds_bounded_bytes():
    cache = vec.PieceCache(lambda found: (np.zeros(2 * len(found), np.uint32), np.full(len(found), 2)), np.uint32, bound=1 << 20)
    for k in range(40):
        buf, off = vec.flat(pa.array([f"{k}-{i}-" + "x" * 500 for i in range(400)]))
        cache.slots(buf, off[:-1], off[1:])
        assert cache.nbytes() < 2 * (1 << 20) + 3 * len(buf)


def test_classes_are_the_libraries():
    classes = vec._classes()
    every = "".join(chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000)
    for kind, pattern in ((vec.LETTER, r"\p{L}"), (vec.NUMBER, r"\p{N}"), (vec.SPACE, r"\s")):
        split = pre_tokenizers.Split(Regex(f"[^{pattern}]"), "removed")
        found = "".join(t for k in range(0, len(every), 50_000) for t, _ in split.pre_tokenize_str(every[k : k + 50_000]))
        assert found == "".join(map(chr, np.flatnonzero(classes == kind).tolist()))


def test_unassigned_code_points_are_no_letters(spark):
    rng = random.Random(4)
    strange = [chr(c) for c in rng.sample([*range(0x378, 0x380), *range(0x2FE0, 0x2FF0), *range(0x3FA00, 0x40000), *range(0xE0080, 0xE0100)], 300)]
    texts = [f"a{c}a 1{c}1 {c} '{c}s" for c in strange]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = {i: library(vocabulary(bpe.VOCABULARY)).encode_ordinary(t) for i, t in enumerate(texts)}
    assert {r.doc_id: r.token_ids for r in bpe.encode(df).collect()} == want
    ids, off = records.token_ids(*vec.flat(pa.array(texts)), vocabulary(records.VOCABULARY))
    tok = Tokenizer.from_file(vocabulary(records.VOCABULARY))
    assert [ids[s:e].tolist() for s, e in zip(off[:-1], off[1:])] == [tok.encode(t, add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize("letters", [b"abcdefghijklmnopqrstuvwxyz", b"eeettaoin", b"ab", b"a", b"\xc3\xa9\xe6\xbc\xa2"])
def test_long_words_equal_the_library(letters):
    rng, c = random.Random(len(letters)), bpe.Coder(vocabulary(bpe.VOCABULARY))
    core = library(vocabulary(bpe.VOCABULARY))._core_bpe
    words = [bytes(rng.choice(letters) for _ in range(n)) for n in (95, 96, 97, 128, 129, 160, 161, 500, 5000)]
    words += [(bytes(rng.choice(letters) for _ in range(k)) * 3000)[:3000] for k in (1, 2, 3, 5, 7, 11, 31, 64, 100)]
    ids, n = c.encode(words)
    ends = np.cumsum(n)
    for w, s, e in zip(words, ends - n, ends):
        assert ids[s:e].tolist() == core.encode_single_piece(w)


def test_a_word_of_a_megabyte_takes_linear_time():
    rng, c = random.Random(1), bpe.Coder(vocabulary(bpe.VOCABULARY))
    w = bytes(rng.choice(b"abcdefghijklmnopqrstuvwxyz") for _ in range(1_000_000))
    begun = time.process_time()
    ids, _ = c.encode([w, b"ab" * 50_000])
    assert time.process_time() - begun < 180
    core = library(vocabulary(bpe.VOCABULARY))._core_bpe
    assert ids.tolist() == core.encode_single_piece(w) + core.encode_single_piece(b"ab" * 50_000)


class _Session:
    """A session without spark.checkpoint.dir, on some master."""

    def __init__(self, spark, master):
        self.conf, self.sparkContext, self._jvm, self._jsc, self.master, self.dir = self, self, spark._jvm, spark._jsc, master, None

    def get(self, key, default):
        return default

    def getCheckpointDir(self):
        return self.dir

    def setCheckpointDir(self, path):
        self.dir = path


def test_folders_are_shared(spark):
    assert common.shared_folder(spark, "x").startswith(spark.conf.get("spark.checkpoint.dir"))
    for master in ("local", "local[4]", "local[*, 2]"):
        assert common.shared_folder(_Session(spark, master), "x").startswith("file:///")
    for master in ("yarn", "local-cluster[3,2,1024]", "spark://host:7077"):
        with pytest.raises(ValueError):
            common.shared_folder(_Session(spark, master), "x")
