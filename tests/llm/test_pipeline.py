import collections
import hashlib
import random
import re

import numpy as np

import corpus_pipeline
from veridoc.llm import bpe, mixing, quality, secrets
from veridoc.llm.common import bpe as library
from veridoc.llm.common import vocabulary

SF = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def grams(text, k=5):
    w = WORD.findall(text.translate(LOWER))
    return frozenset(zip(*(w[i:] for i in range(k)))) if len(w) >= k else frozenset([tuple(w)] if w else [])


def spoken(n):
    rng = random.Random(n)
    return ["".join(rng.choice("ka lor min tes ver dal su ro pen gri fo nat el bru shi cor".split()) for _ in range(rng.randint(1, 3))) + rng.choice("aeiouy") for _ in range(n)]


def brute_groups(rows, num=4, den=5):
    """smallest id of each row's group, by an inverted index"""
    sets = {i: grams(t) for i, t in rows}
    group = {i: i for i in sets}

    def root(x):
        while group[x] != x:
            group[x] = x = group[group[x]]
        return x

    holders = collections.defaultdict(list)
    for i, s in sets.items():
        common = collections.Counter(j for g in s for j in holders[g])
        for j, c in common.items():
            if den * c >= num * (len(s) + len(sets[j]) - c):
                a, b = root(i), root(j)
                group[max(a, b)] = min(a, b)
        for g in s:
            holders[g].append(i)
    return {i: root(i) for i in sets}


def test_stages_one_by_one(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    step = dict(corpus_pipeline.STAGES)
    rows = {r.doc_id: r for r in docs.collect()}

    kept = step["quality_rules"](spark, docs, SF)
    assert kept.columns == columns
    got = {r.doc_id: r for r in kept.collect()}
    verdict = {r.doc_id for r in quality.assess(docs).collect() if r.kept}
    assert set(got) == verdict and all(got[i] == rows[i] for i in got)

    unique = step["near_duplicates"](spark, kept, SF)
    assert unique.columns == columns
    group = brute_groups([(i, r.text) for i, r in got.items()])
    left = {r.doc_id: r for r in unique.collect()}
    assert set(left) == {i for i, g in group.items() if i == g} and all(left[i] == rows[i] for i in left)

    clean = step["secret_scan"](spark, unique, SF)
    assert clean.columns == columns
    for r in clean.collect():
        assert r.text.encode() == secrets.redact(rows[r.doc_id].text.encode()) and r.n_chars == len(r.text)
        assert not secrets.spans(r.text.encode())

    mixed = step["mixture"](spark, clean, SF)
    assert mixed.columns == columns
    assert {r.doc_id for r in mixed.collect()} == {r.doc_id for r in mixing.draw(clean).collect() if r.drawn}

    enc = library(vocabulary(bpe.VOCABULARY))
    texts = {r.doc_id: r.text for r in mixed.collect()}
    out = step["tokens"](spark, mixed, SF).collect()
    assert len(out) == len(texts)
    for r in out:
        assert r.n_tokens == len(enc.encode_ordinary(texts[r.doc_id])) and r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_near_copies_go_and_others_stay(spark):
    rng = random.Random(6)
    base = [[f"w{rng.randrange(3000)}" for _ in range(rng.choice([60, 90, 200, 400]))] for _ in range(40)]
    rows = []
    for k, words in enumerate(base):
        rows.append((1000 * k, " ".join(words)))
        for c in range(1, rng.randint(1, 9)):
            w = list(words)
            for _ in range(rng.randint(0, len(w) // 60 + 1)):
                w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
            rows.append((1000 * k + c, " ".join(w)))
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(4)
    group = brute_groups(rows)
    got = corpus_pipeline.near_duplicates(spark, df, "")
    assert sorted(r.doc_id for r in got.collect()) == sorted(i for i, g in group.items() if i == g)


def test_columns_of_any_name_stay(spark):
    words = spoken(80)
    rows = [(i, " ".join(words[i:] + words[:i]), "xx", "s", 1) for i in range(6)] + [(0, " ".join(words), "xx", "s", 2), (3, None, None, None, None)]
    names = ["id", "key", "k1", "k2", "n", "place", "label", "cell", "probability", "redacted", "language", "script", "kept", "n_tokens", "text_", "__key", "__id", "__n", "__source", "__lang", "__topic", "__probability", "__redacted", "topic", "_id", "region", "shingles", "component_id"]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", *(f"'{x}' AS `{x}`" for x in names), "'d' AS `a.b c`")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, df, "")
        assert out.columns == df.columns, name
        got = out.collect()
        assert got and all(r[x] == x for r in got for x in names) and all(r["a.b c"] == "d" for r in got), name
        assert stage(spark, df.limit(0), "").count() == 0
    assert corpus_pipeline.tokens(spark, df, "").count() == 8


def test_run_and_edges(spark, tmp_path):
    text = "one plain sentence follows another and none of them says quite the same thing as the last " * 2
    words = spoken(80)
    rows = [(None, None, None, None, None), (1, "", "en", "s", 0), (2, " ".join(words), "xx", "s", 1), (2, " ".join(words), "xx", "s", 1), (3, text, "en", None, 9), (2, " ".join(words[::-1]), "xx", "s", 1), (None, " ".join(words), "xx", "s", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(str(tmp_path / "a/documents.parquet"))
    df.limit(0).write.parquet(str(tmp_path / "b/documents.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path / "a"))
    assert out.columns == ["doc_id", "lang", "source", "n_tokens", "ids_sha256", "decoded_sha256"]
    enc = library(vocabulary(bpe.VOCABULARY))
    digest = lambda t: hashlib.sha256(np.array(enc.encode_ordinary(t), "<u4").tobytes()).hexdigest()
    # the rules keep the texts of 80 words, of which the second is another set of shingles; those drawn are a part of what near duplicates leave
    left = {(r.doc_id, r.text) for r in corpus_pipeline.near_duplicates(spark, corpus_pipeline.quality_rules(spark, df, ""), "").collect()}
    assert left == {(2, " ".join(words)), (2, " ".join(words[::-1])), (None, " ".join(words))}
    drawn = {(r.doc_id, digest(r.text)) for r in corpus_pipeline.mixture(spark, corpus_pipeline.near_duplicates(spark, corpus_pipeline.quality_rules(spark, df, ""), ""), "").collect()}
    assert {(r.doc_id, r.ids_sha256) for r in out.collect()} == drawn
    assert corpus_pipeline.run(spark, str(tmp_path / "b")).count() == 0
    assert corpus_pipeline.near_duplicates(spark, df, "").count() == 6
