import collections
import random
import re
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from veridoc.llm import common, graph, jaccard, registry, vec

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def shingles(text, k=3):
    w = WORD.findall((text or "").translate(LOWER))
    return frozenset(zip(*(w[i:] for i in range(k)))) if len(w) >= k else frozenset([tuple(w)] if w else [])


def brute(rows, num=90, den=100):
    """component of each row; rows are (id, text)"""
    sets = [shingles(t) for _, t in rows]
    group = list(range(len(rows)))

    def root(x):
        while group[x] != x:
            x = group[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and rows[i][0] is not None and rows[j][0] is not None and den * len(a & b) >= num * len(a | b):
                group[root(i)] = root(j)
    least = collections.defaultdict(lambda: 1 << 62)
    for i, (d, _) in enumerate(rows):
        least[root(i)] = min(least[root(i)], d if d is not None else 1 << 62)
    return [None if d is None else (least[root(i)] if sets[i] else d) for i, (d, _) in enumerate(rows)]


def edited(words, k, rng):
    out = list(words)
    for _ in range(k):
        what, at = rng.random(), rng.randrange(len(out))
        if what < 0.5:
            out[at] = f"e{rng.randrange(10**6)}"
        elif what < 0.75 and len(out) > 1:
            del out[at]
        else:
            out.insert(at, f"i{rng.randrange(10**6)}")
    return out


def corpus(seed, families, size):
    rng = random.Random(seed)
    texts = []
    for _ in range(families):
        n = rng.choice([3, 5, 8, 9, 11, 12, 15, 20, 30, 40, 60, 80, 120, 200, 300])
        base = [f"w{rng.randrange(5000)}" for _ in range(n)]
        for _ in range(rng.randint(1, size)):
            texts.append(" ".join(edited(base, rng.randint(0, max(1, n // 40 + 1)), rng)))
    texts += [texts[0]] * 5 + [texts[0].upper(), None, "", " \n", "one", "one", "one two", "ONE TWO", "two one"]
    rng.shuffle(texts)
    ids = rng.sample(range(10**6), len(texts))
    return list(zip(ids, texts))


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("tight", [False, True])
def test_components_equal_brute_force(spark, monkeypatch, seed, tight):
    if tight:
        for name, n in (("LEAF", 600), ("LEAF_MEMBERS", 4), ("TINY", 2), ("PIVOTS", 3), ("CELL", 2), ("FLUSH", 500)):
            monkeypatch.setattr(jaccard, name, n)
        monkeypatch.setattr(common, "HOT_ROWS", 2)
    rows = corpus(seed, 40, 14)
    df = spark.createDataFrame([(i, t, "x", 0) for i, t in rows], "doc_id long, text string, key string, n int").repartition(5)
    got = {r.doc_id: r for r in jaccard.join_groups(df).collect()}
    want = brute(rows)
    for (i, t), c in zip(rows, want):
        assert got[i].n_shingles == len(shingles(t))
        assert got[i].component_id == c, t


def test_linked_sets_always_share_a_region():
    rng = random.Random(9)
    space = jaccard.Space(Fraction(9, 10))
    hits = 0
    for _ in range(4000):
        n = rng.choice([9, 10, 18, 19, 27, 36, 50, 64, 100, 150, 190, 250])
        a = [rng.getrandbits(64) for _ in range(n)]
        k = rng.randint(0, n // 9 + 1)
        b = a[rng.randint(0, k) :] + [rng.getrandbits(64) for _ in range(rng.randint(0, k))]
        c = len(set(a) & set(b))
        if 10 * c >= 9 * (len(a) + len(b) - c):
            w = np.concatenate([np.sort(np.array(x, np.uint64)) for x in (a, b)])
            names, of = jaccard.signatures(w, np.array([0, len(a), len(a) + len(b)]), space)
            assert set(names[of == 0].tolist()) & set(names[of == 1].tolist()), (n, len(b), c)
            hits += 1
    assert hits > 1500


@pytest.mark.parametrize("p, q", [(3, 5), (1, 2), (1, 3), (1, 8), (2, 3)])
def test_linked_sets_share_a_region_below_two_thirds(p, q):
    rng = random.Random(10 * p + q)
    space = jaccard.Space(Fraction(p, q))
    for n in range(1, 41):
        for m in range(n, n * q // p + 1):
            b = [rng.getrandbits(64) for _ in range(m)]
            w = np.concatenate([np.sort(np.array(x, np.uint64)) for x in (b[:n], b)])
            names, of = jaccard.signatures(w, np.array([0, n, n + m]), space)
            assert set(names[of == 0].tolist()) & set(names[of == 1].tolist()), (n, m)


def family(rng, members, size, edits):
    base = [rng.getrandbits(64) for _ in range(size)]
    out = []
    for _ in range(members):
        s = list(base)
        for _ in range(rng.randint(0, edits)):
            s[rng.randrange(size)] = rng.getrandbits(64)
        out.append(np.unique(np.array(s, np.uint64)))
    return out


def groups_of(sets, links, space):
    """Groups by links given, and by all pairs"""
    every = [(i, j) for i in range(len(sets)) for j in range(i) if space.links(*map(np.array, (len(np.intersect1d(sets[i], sets[j])), len(sets[i]), len(sets[j]))))]
    out = []
    for pairs in (links, every):
        group = list(range(len(sets)))

        def root(x):
            while group[x] != x:
                x = group[x]
            return x

        for a, b in pairs:
            a, b = sorted((root(a), root(b)))
            group[b] = a
        out.append([root(i) for i in range(len(sets))])
    return out


@pytest.mark.parametrize("threshold", [Fraction(9, 10), Fraction(4, 5)])
def test_regions_in_a_task_equal_all_pairs(monkeypatch, threshold):
    monkeypatch.setattr(jaccard, "TINY", 3)
    monkeypatch.setattr(jaccard, "PIVOTS", 3)
    rng, space = random.Random(3), jaccard.Space(threshold)
    several = 0
    for _ in range(40):
        sets = [s for _ in range(rng.randint(1, 4)) for s in family(rng, rng.randint(1, 25), rng.choice([30, 60, 120]), 12)]
        m = jaccard._Members([(i, i, True, s) for i, s in enumerate(sets)], space)
        got, want = groups_of(sets, m.join(), space)
        assert got == want
        several += len(set(want)) < len(want)
    assert several > 20


def test_regions_over_tasks_equal_all_pairs(spark, monkeypatch):
    for name, n in (("LEAF", 1500), ("LEAF_MEMBERS", 6), ("PIVOTS", 3), ("CELL", 4)):
        monkeypatch.setattr(jaccard, name, n)
    rng, space = random.Random(7), jaccard.Space(Fraction(4, 5))
    sets = [s for k in range(6) for s in family(rng, 20, 40 + 10 * k, 14)]
    table = spark.createDataFrame([(i, bytearray(s.tobytes())) for i, s in enumerate(sets)], "key long, shingles binary")
    members = spark.createDataFrame([(r, i, i, True, len(s)) for r in (0, 1) for i, s in enumerate(sets) if r == 0 or i < 50], "region long, node long, label long, home boolean, w long")
    calls = []
    split = jaccard._split
    monkeypatch.setattr(jaccard, "_split", lambda *a: calls.append(1) or split(*a))
    links = {tuple(r) for df in jaccard._by_regions(members, table, space, 4) for r in df.collect()}
    got, want = groups_of(sets, links, space)
    assert got == want and len(set(want)) < len(want) and len(calls) > 1


def test_only_members_outside_the_largest_group_are_at_home(spark):
    distances = spark.createDataFrame([(1, b, 100 if b < 40 else 84, 104, 104) for b in range(2, 50)], "a long, b long, common long, n_a long, n_b long")
    labels = spark.createDataFrame([(b, 1) for b in range(1, 40)], "node long, label long")
    rows = jaccard._unsettled(distances, labels, 0.25, 48).collect()
    assert {r.node for r in rows if r.home} == set(range(40, 50)) and any(not r.home for r in rows)


def test_rows_of_a_large_group_follow_its_size(spark, monkeypatch):
    for name, n in (("LEAF", 1500), ("LEAF_MEMBERS", 6)):
        monkeypatch.setattr(jaccard, name, n)
    rng, space = random.Random(8), jaccard.Space(Fraction(4, 5))
    made = []
    for name in ("_split", "_in_blocks"):
        real = getattr(jaccard, name)
        monkeypatch.setattr(jaccard, name, lambda large, *a, name=name, real=real: made.append((name, large.count())) or real(large, *a))
    sets = family(rng, 150, 40, 16)
    table = spark.createDataFrame([(i, bytearray(s.tobytes())) for i, s in enumerate(sets)], "key long, shingles binary")
    # those of the first 110 are one group already
    members = spark.createDataFrame([(0, i, 0 if i < 110 else i, i >= 110, len(s)) for i, s in enumerate(sets)], "region long, node long, label long, home boolean, w long")
    links = {tuple(r) for df in jaccard._by_regions(members, table, space, 4) for r in df.collect()}
    got, want = groups_of(sets, links | {(0, i) for i in range(110)}, space)
    every = [(i, j) for i in range(150) for j in range(i) if space.links(*map(np.array, (len(np.intersect1d(sets[i], sets[j])), len(sets[i]), len(sets[j]))))]
    want, _ = groups_of(sets, [*every, *((0, i) for i in range(110))], space)
    assert got == want and len(set(want)) > 1
    assert made == [("_in_blocks", 150), ("_split", 0), *made[2:]] and sum(n for _, n in made) == 150


def shuffle_files(spark):
    return {f.getName() for f in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()) if f.getName().startswith("shuffle_")}


def test_files_go_when_nothing_reads_them(spark, tmp_path, monkeypatch):
    before = shuffle_files(spark)
    out = common.checkpointed(spark.range(1000).repartition(5, "id"))
    assert not {x for x in shuffle_files(spark) - before if x.endswith(".data")} and out.count() == 1000
    monkeypatch.setattr(common, "shared_folder", lambda s, name, n=iter(range(10**6)): f"file://{tmp_path}/{name}-{next(n)}")
    rows = corpus(3, 12, 5)
    got = {r.doc_id: r.component_id for r in jaccard.join_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i] for i, _ in rows] == brute(rows)
    left = [spark.read.parquet(str(p)).columns for p in tmp_path.iterdir()]
    assert left and not any("shingles" in c for c in left)


def test_rows_in_buckets_do_not_move(spark, monkeypatch):
    rows = spark.range(500).select("id", F.lit("x").alias("v"))
    held = common.bucketed(rows.repartition(3, "id"), "id", 3)
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("cut_")]
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = spark.range(0, 1000, 5).withColumnRenamed("id", "b").join(held, F.col("b") == F.col("id"))
        assert joined.count() == 100
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert len(re.findall(r"Exchange hashpartitioning", plan)) == 1, plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    common.forget(held)


@pytest.mark.parametrize("bits", [0, 2])
def test_sets_of_one_name_stay_apart(spark, monkeypatch, bits):
    real = jaccard._classes
    rows = corpus(5, 12, 5)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(jaccard, "_classes", lambda r: real(jaccard.checkpointed(r.withColumn("k1", r.k1.bitwiseAND((1 << bits) - 1)))))
    got = {r.doc_id: r.component_id for r in jaccard.join_groups(df).collect()}
    assert [got[i] for i, _ in rows] == brute(rows)


def test_hot_keys_join_as_others(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_ROWS", 3)
    left = spark.createDataFrame([(k, i) for i, k in enumerate([1] * 50 + [2] * 5 + [3, 4, None, None])], "k long, v int")
    right = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (9, "z")], "k long, w string")
    for most in (20_000, 2):
        monkeypatch.setattr(common, "HOT_KEYS", most)
        got = collections.Counter((r.k, r.w) for r in common.skew_join(left, right, "k").collect())
        assert got == {(1, "a"): 50, (2, "b"): 5, (3, "c"): 1, (4, None): 1, (None, None): 2}


def test_query_equals_sql(spark, duck):
    d = "/root/testdata/sf0.01"
    df = registry.op8_ngram_jaccard_join(spark, d)
    rel = duck(d).execute(registry.oracle_sql()["op8_ngram_jaccard_join"])
    assert sorted(c[0] for c in rel.description) == sorted(df.columns)
    names = [c[0] for c in rel.description]
    assert sorted(map(tuple, df.select(*names).collect())) == sorted(rel.fetchall())


def test_edges(spark):
    rows = [(None, "a b c d e f g h i j"), (7, "a b c d e f g h i j"), (7, "a b c d e f g h i j"), (7, "other"), (3, "A B C D E F G H I J"), (9, None), (2, "word " * 60000)]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, component_id string")
    got = collections.Counter(tuple(r) for r in jaccard.join_groups(df).collect())
    assert got == collections.Counter({(None, 8, None): 1, (7, 8, 3): 2, (7, 1, 7): 1, (3, 8, 3): 1, (9, 0, 9): 1, (2, 1, 2): 1})
    assert jaccard.join_groups(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        jaccard.Space(Fraction(1))


def test_words_that_are_few():
    w, off = jaccard.shingle_sets(*vec.flat(pa.array(["a b", "a", "b", "b a", "a  B", "", None])), 3)
    names = [tuple(w[s:e].tolist()) for s, e in zip(off, off[1:])]
    assert names[0] == names[4] and len(set(names[:4])) == 4 and names[5] == names[6] == ()


def test_components_of_paths_and_stars(spark):
    path = [(i, i + 1) for i in range(0, 60)] + [(100, k) for k in range(101, 140)] + [(205, 201), (201, 203), (300, 300)]
    random.Random(1).shuffle(path)
    got = {r.node: r.label for r in graph.components(spark.createDataFrame(path, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{k: 100 for k in range(100, 140)}, 201: 201, 203: 201, 205: 201}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_query(spark):
    d = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    got = {r.doc_id: r for r in registry.op8_ngram_jaccard_join(spark, d).collect()}
    for (i, t), c in zip(rows, brute(rows)):
        assert (got[i].n_shingles, got[i].component_id) == (len(shingles(t)), c)
