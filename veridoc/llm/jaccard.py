"""Exact Jaccard join of shingle sets in a metric space, and the groups that its links form.

Distances are d = 1 - Jaccard, a link is d <= 1 - threshold = r. Regions join recursively:

* A region's *pivots* are members of it. Distances of all members to them are computed, and each
  member's home is the Voronoi region of its nearest pivot. If x and y link and q is the home
  pivot of y, then d(x, q) <= d(x, p) + 2r for the home pivot p of x: by this triangle-inequality
  *window* x is replicated into the regions it may have links in. So each link is found where one of
  its ends is at home. Regions recur into regions of their own until they are small, and
  small ones go on recursively within a task, down to pairs, of which only those are
  compared whose distances to a pivot differ by r at most.
* Members within r of a pivot link to it, so pairs that have one group already aren't compared, and a
  region with one group is done.
* A region that pivots don't split (its members are all about as far from each other) is joined
  in blocks of bounded size, and so is one whose members at home fill a few blocks' sides.
* A link between groups has an end outside a cell's largest group, so only members outside it are at home.

Regions of the whole corpus would be useless: almost all documents lie at distance 1 of each other
and so of any pivot, and every window would hold all of them (figures in the README). So a
filter in front finds what can be near, in spaces that sets map to without growing distances, and
Voronoi regions begin in the cells it gives:

0. *The rest of the corpus as a pivot.* A set's share of shingles that no other set has is a
   lower bound of its distance to every other set. Sets for which it exceeds r link with
   nothing but copies and leave here; shingles are asked for among all sets, in packed form.
1. *Sizes.* d(x, y) >= 1 - min/max of the sizes: bands in geometric steps, and sets above a
   band's upper end that can link with one in it are replicated into that band.
2. *Classes of shingles.* Sets of a band that link differ in at most D shingles. Shingles
   are dealt by hash into D + 1 + s classes, so at least 1 + s classes hold no difference: there
   both sets have the same restriction, at distance 0. Sets with the same restriction in a class share a cell, named
   by the smallest of them, which is the cell's first pivot. A set has an empty restriction in s classes at most,
   else its empty ones count too.

Equal sets are one node from the start, so copies meet once a map task. Sets are told apart by 128
bits of hashes, shingles by 64: two sets of n and m shingles have a common one too many with
probability nm / 2**64. What crosses the network is packed: one row carries thousands
of hashes or signatures.
"""

from __future__ import annotations

from fractions import Fraction
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veridoc.llm import vec
from veridoc.llm.chunks import Dealt, Ordered, deal, elsewhere, unpacked
from veridoc.llm.common import ROWS_A_TASK, bucketed, checkpointed, entered, forget, fresh, released, skew_join, with_columns
from veridoc.llm.graph import components

#: Growth of the size bands; rows of signatures packed, or met, at once.
STEP, FLUSH = 1.5, 500_000
#: Members that meet a pivot in one stream; parts that a pivot's members are dealt to.
CELL, SALTS = 256, 16
#: Pivots of a region; shingles and members of a region, or a block's side, that one task joins; members that are compared without pivots.
PIVOTS, LEAF, LEAF_MEMBERS, TINY = 8, 400_000, 1024, 32
#: Sides of a region's members at home, up to which it goes to blocks unsplit: so they make some 2 * SIDES + 1 times its rows at most.
SIDES = 4
#: A region with more of its parent's shingles than this part isn't split again.
SPLIT = 0.8


class Space:
    """Bands and classes for a threshold p/q."""

    def __init__(self, threshold: Fraction):
        self.p, self.q = threshold.numerator, threshold.denominator
        if not 0 < self.p < self.q:
            raise ValueError("the threshold must lie between 0 and 1")
        edges = [1]
        while edges[-1] < 1 << 40:
            edges.append(max(edges[-1] + 1, int(edges[-1] * STEP)))
        self.edges = np.array(edges, np.int64)
        self.reach = float(1 - Fraction(self.p, self.q)) + 1e-9
        # classes, and of them spare ones: more than the smallest set of a band leaves empty, but for rare chance
        top = np.append(self.edges[1:], 1 << 62) - 1
        need = np.minimum(self.differences(np.minimum(top, 1 << 40)), 1 << 40) + 1
        spare = np.ones(len(self.edges))
        for _ in range(200):
            empty = (need + spare) * np.exp(-self.edges / (need + spare))
            spare = np.minimum(np.maximum(spare, np.ceil(empty + 4 * np.sqrt(empty))), need)
        self.spare = spare.astype(np.int64)

    def links(self, common: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return self.q * common >= self.p * (a + b - common)

    def differences(self, smaller):
        """Most shingles that two linked sets differ in, by the size of the smaller one.

        Common c >= p/q * (a + b - c) gives a + b - 2c <= (a + b)(q - p)/(q + p), and b <= a q/p.
        """
        return smaller * (self.q - self.p) // self.p

    def bands(self, n: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """(which sets, their band): each set's own band, and every one below in which a smaller set can link with it."""
        own = np.searchsorted(self.edges, n, "right") - 1
        out, which, band = [], np.arange(len(n)), own
        while len(which):
            out.append((which, band))
            below = (band > 0) & (self.p * n[which] <= self.q * (self.edges[band] - 1))
            which, band = which[below], band[below] - 1
        return out

    def classes(self, band: np.ndarray) -> np.ndarray:
        return self.differences(self.edges[band + 1] - 1) + 1 + self.spare[band]


def shingle_sets(buf: np.ndarray, off: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of every text, end to end, and where each text's begin.

    A-Z count as a-z. A text of fewer words is one shingle; without words it has none.
    """
    n = len(off) - 1
    low = vec.lower(buf)
    start, end, text_of = vec.words(low, off)
    if not len(start):
        return np.zeros(0, np.uint64), np.zeros(n + 1, np.int64)
    h = vec.span_hashes(low, start, end)
    count = np.bincount(text_of, minlength=n)
    at = np.concatenate([[0], np.cumsum(count)])
    m = len(h) - words + 1
    parts, owners = [], []
    if m > 0:
        w = np.zeros(m, np.uint64)
        for k in range(words):
            w = vec.mix(w * np.uint64(0x9E3779B97F4A7C15) + h[k : k + m])
        inside = text_of[:m] == text_of[words - 1 :]
        parts.append(w[inside])
        owners.append(text_of[:m][inside])
    few = np.flatnonzero((count > 0) & (count < words))
    if len(few):
        w = count[few].astype(np.uint64)
        for k in range(words - 1):
            has = count[few] > k
            w[has] = vec.mix(w[has] * np.uint64(0xC2B2AE3D27D4EB4F) + h[at[few[has]] + k])
        parts.append(w)
        owners.append(few)
    w, owner = np.concatenate(parts), np.concatenate(owners)
    order = np.lexsort((w, owner))
    w, owner = w[order], owner[order]
    new = np.ones(len(w), bool)
    new[1:] = (w[1:] != w[:-1]) | (owner[1:] != owner[:-1])
    w, owner = w[new], owner[new]
    return w, np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=n))])


def _sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of runs that begin at those places, none empty, modulo 2**64."""
    return np.add.reduceat(values, starts) if len(starts) else np.zeros(0, np.uint64)


def set_keys(w: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit names of each set, as int64; of an empty set 0."""
    n = np.diff(off)
    some = np.flatnonzero(n)
    out = []
    for seed in (0x5851F42D4C957F2D, 0x14057B7EF767814F):
        name = np.zeros(len(n), np.uint64)
        name[some] = vec.mix(_sums(vec.mix(w ^ np.uint64(seed)), off[:-1][some]) + vec.mix(n[some].astype(np.uint64)))
        out.append(name.view(np.int64))
    return out[0], out[1]


def signatures(w: np.ndarray, off: np.ndarray, space: Space) -> tuple[np.ndarray, np.ndarray]:
    """Names of the regions of every set in every class of its bands, and the number of the set."""
    n = np.diff(off)
    names, owners = [], []
    value = vec.mix(w ^ np.uint64(0x2545F4914F6CDD1D))
    for which, band in space.bands(n):
        live = space.differences(n[which]) >= 0
        which, band = which[live & (n[which] > 0)], band[live & (n[which] > 0)]
        if not len(which):
            continue
        m = space.classes(band)
        index = vec.gather(np.arange(len(w)), off[which], n[which])
        row = np.repeat(np.arange(len(which)), n[which])
        # a class is a range of hashes, so a sorted set's classes are runs
        cls = ((w[index] >> np.uint64(32)) * m[row].astype(np.uint64) >> np.uint64(32)).astype(np.int64)
        new = np.ones(len(index), bool)
        new[1:] = (row[1:] != row[:-1]) | (cls[1:] != cls[:-1])
        first = np.flatnonzero(new)
        tag = lambda b, c: vec.mix(b.astype(np.uint64) * np.uint64(0x100000001B3) + c.astype(np.uint64) + np.uint64(7))
        names.append(vec.mix(_sums(value[index], first) + tag(band[row[first]], cls[first])))
        owners.append(which[row[first]])
        filled = np.bincount(row[first], minlength=len(which))
        ends = np.cumsum(n[which])
        for r in np.flatnonzero(m - filled > space.spare[band]).tolist():
            empty = np.setdiff1d(np.arange(m[r]), cls[ends[r] - n[which[r]] : ends[r]])
            names.append(vec.mix(tag(np.full(len(empty), band[r]), empty)))
            owners.append(np.full(len(empty), which[r]))
    if not names:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(names), np.concatenate(owners)


# -- stages -----------------------------------------------------------------------------------


class _Sets(Ordered):
    """The sets of a chunk, one row per text, and the distinct hashes in them; rows with a null id count for nothing."""

    def __init__(self, table: pa.Table, words: int):
        super().__init__(table)
        self.w, self.at = shingle_sets(self.buf, self.off, words)
        self.n = np.diff(self.at)
        self.keys, self.also = set_keys(self.w, self.at)
        live = np.flatnonzero((self.n > 0) & ~self.null)
        order = np.lexsort((self.also[live], self.keys[live]))
        k, l = self.keys[live][order], self.also[live][order]
        new = np.ones(len(order), bool)
        new[1:] = (k[1:] != k[:-1]) | (l[1:] != l[:-1])
        self.first = live[order[new]]  # the first row of each set
        values = vec.gather(self.w, self.at[self.first], self.n[self.first])
        self.names, self.inverse, count = np.unique(values, return_inverse=True, return_counts=True)
        self.several = count > 1
        self.row = np.repeat(np.arange(len(self.first)), self.n[self.first])


def _candidates(dealt: Dealt, words: int, space: Space) -> DataFrame:
    """``(id, n, k1, k2, shingles)`` of every row; the packed sorted set only in the chunk's first row of a set that other sets cover up to the threshold."""
    answers = elsewhere(dealt, lambda table: _Sets(table, words).names)
    n = dealt.n
    fields = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("shingles", pa.binary())])

    def covered(key, table: pa.Table, replies: pa.Table) -> pa.Table:
        entered("chunks")
        if not table.num_rows:
            return fields.empty_table()
        s = _Sets(table, words)
        shared = s.several | (unpacked(s.names, replies, n) > 0)
        cover = np.bincount(s.row[shared[s.inverse]], minlength=len(s.first))
        packed: list = [None] * len(s.n)
        for i in s.first[space.q * cover >= space.p * s.n[s.first]].tolist():
            packed[i] = s.w[s.at[i] : s.at[i + 1]].tobytes()
        return pa.Table.from_arrays([pa.array(s.ids, pa.int64(), mask=s.null), pa.array(s.n), pa.array(s.keys), pa.array(s.also), pa.array(packed, pa.binary())], schema=fields)

    return dealt.docs.groupBy("c").cogroup(answers.groupBy("c")).applyInArrow(covered, "id bigint, n bigint, k1 bigint, k2 bigint, shingles binary")


def _classes(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows with ``key``, a name of their set, and (key, smallest id, number of rows) of each set.

    The key is the first of the two names; where sets share it, it is made of both.
    """
    rows, n = rows.withColumn("key", F.col("k1")), rows.count()
    while True:
        classes = checkpointed(rows.filter("n > 0 AND id IS NOT NULL").groupBy("key").agg(F.min("id").alias("first"), F.min("k2").alias("low"), F.max("k2").alias("high")), n)
        shared = classes.filter("low <> high").select("key", F.lit(True).alias("shared"))
        if shared.isEmpty():
            return rows, classes.select("key", "first")
        rows = checkpointed(rows.join(shared, "key", "left").withColumn("key", F.when(F.col("shared"), F.xxhash64("key", "k2")).otherwise(F.col("key"))).drop("shared"))


def _new(*columns: np.ndarray) -> np.ndarray:
    """Where a row of sorted columns differs from the one before."""
    out = np.zeros(len(columns[0]), bool)
    out[:1] = True
    for c in columns:
        out[1:] |= c[1:] != c[:-1]
    return out


def _runs(values: np.ndarray, weights: int) -> list[np.ndarray]:
    """Masks that deal values by range into parts of some FLUSH; equal values stay together."""
    parts = max(1, -(-len(values) // max(1, weights)))
    part = ((vec.mix(values.view(np.uint64)) >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int32)
    return [np.flatnonzero(part == k) for k in range(parts)]


def _files(spark, tasks: int) -> int:
    """A third of the tasks, but enough for all cores: what each task writes is small, and files cost time to make."""
    return max(2 * spark.sparkContext.defaultParallelism, tasks // 3)


def _cells(sets: DataFrame, space: Space, tasks: int) -> DataFrame:
    """Distinct pairs (pivot ``a``, member ``b``) of cells with two members or more."""

    def pack(batches):
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def flush():
            names, keys = (np.concatenate(x) for x in zip(*held))
            held.clear()
            order = np.lexsort((keys, names))
            names, keys = names[order], keys[order]
            new = _new(names, keys)
            names, keys = names[new], keys[new]  # sorted by name, so a bucket is a run
            bucket = (names >> np.uint64(32)) * np.uint64(tasks) >> np.uint64(32)
            cut = np.flatnonzero(_new(bucket))
            stop = np.append(cut[1:], len(names))
            return pa.RecordBatch.from_arrays(
                [pa.array(bucket[cut].astype(np.int32)), pa.array([names[a:b].tobytes() for a, b in zip(cut, stop)], pa.binary()), pa.array([keys[a:b].tobytes() for a, b in zip(cut, stop)], pa.binary())],
                names=["bucket", "names", "keys"],
            )

        entered("cells")
        for b in vec.slices(batches, "shingles"):
            buf, off = vec.flat(b.column("shingles"))
            names, of = signatures(np.ascontiguousarray(buf).view(np.uint64), off // 8, space)
            if len(names):
                held.append((names, np.asarray(b.column("key").to_numpy(zero_copy_only=False), np.int64)[of]))
            if sum(len(x) for x, _ in held) > FLUSH:
                yield flush()
        if held:
            yield flush()

    def meet(batches):
        entered("cells")
        got = [(np.frombuffer(n.as_buffer(), np.uint64).copy(), np.frombuffer(k.as_buffer(), np.int64).copy()) for b in batches for n, k in zip(b.column("names"), b.column("keys"))]
        if not got:
            return
        every_name, every_key = (np.concatenate(x) for x in zip(*got))
        del got
        for part in _runs(every_name, FLUSH):
            names, keys = every_name[part], every_key[part]
            order = np.lexsort((keys, names))
            names, keys = names[order], keys[order]
            new = _new(names, keys)
            names, keys = names[new], keys[new]
            first = _new(names)
            pivot = keys[np.flatnonzero(first)][np.cumsum(first) - 1] if len(names) else keys
            pivot, keys = pivot[~first], keys[~first]
            # a row carries a pivot's members of one salt, so many regions of one group cost few rows
            salt = (vec.mix(keys.view(np.uint64)) % np.uint64(SALTS)).astype(np.int32)
            order = np.lexsort((keys, salt, pivot))
            pivot, salt, keys = pivot[order], salt[order], keys[order]
            new = _new(pivot, salt, keys)
            pivot, salt, keys = pivot[new], salt[new], keys[new]
            first = np.flatnonzero(_new(pivot, salt))
            stop = np.append(first[1:], len(keys))
            for k in range(0, len(first), 20_000):
                f, e = first[k : k + 20_000], stop[k : k + 20_000]
                yield pa.RecordBatch.from_arrays([pa.array(pivot[f]), pa.array(salt[f]), pa.array([keys[x:y].tobytes() for x, y in zip(f, e)], pa.binary())], names=["a", "salt", "members"])
        released()

    def merge(batches):
        entered("cells")
        pivots, members = [], []
        for batch in batches:
            for a, x in zip(batch.column("a").to_pylist(), batch.column("members")):
                pivots.append(a)
                members.append(np.frombuffer(x.as_buffer(), np.int64).copy())
        if not pivots:
            return
        every_a, every_b = np.repeat(np.array(pivots, np.int64), [len(x) for x in members]), np.concatenate(members)
        del pivots, members
        for part in _runs(every_a ^ every_b, FLUSH):
            a, b = every_a[part], every_b[part]
            order = np.lexsort((b, a))
            a, b = a[order], b[order]
            new = _new(a, b)
            a, b = a[new], b[new]
            for k in range(0, len(a), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(a[k : k + 100_000]), pa.array(b[k : k + 100_000])], names=["a", "b"])
        released()

    dealt = sets.select("key", "shingles").mapInArrow(pack, "bucket int, names binary, keys binary").repartition(tasks, "bucket")
    found = dealt.mapInArrow(meet, "a bigint, salt int, members binary").repartition(tasks, "a", "salt")
    return checkpointed(found.mapInArrow(merge, "a bigint, b bigint").coalesce(_files(sets.sparkSession, tasks)))


def _common(pivot: np.ndarray, s: np.ndarray) -> int:
    """Number of common values of two sorted sets."""
    if not len(pivot):
        return 0
    at = np.searchsorted(pivot, s)
    at[at == len(pivot)] = 0
    return int(np.count_nonzero(pivot[at] == s))


def _to_pivots(pairs: DataFrame, sets: DataFrame, tasks: int) -> DataFrame:
    """``(a, b, common, n_a, n_b)`` of pairs (pivot a, member b). A pivot's members are dealt to streams of bounded size, each of which passes the pivot's set."""
    streams = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > CELL).select("a", F.ceil(F.col("n") / CELL).cast("long").alias("streams"))
    dealt = skew_join(pairs, streams, "a").select("a", "b", F.expr("pmod(xxhash64(b), coalesce(streams, 1))").alias("i"))
    members = dealt.join(sets, F.col("b") == F.col("key")).select("a", "i", "b", F.lit(1).alias("role"), "shingles")
    pivots = dealt.select("a", "i").distinct().join(sets, F.col("a") == F.col("key")).select("a", "i", F.lit(None).cast("long").alias("b"), F.lit(0).alias("role"), "shingles")
    rows = members.unionByName(pivots).repartition(tasks, "a", "i").sortWithinPartitions("a", "i", "role")

    def run(batches):
        entered("cells")
        pivot = None
        for batch in batches:
            out = []
            for a, b, x in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), batch.column("shingles")):
                s = np.frombuffer(x.as_buffer(), np.uint64)
                if b is None:
                    pivot = s.copy()
                else:
                    out.append((a, b, _common(pivot, s), len(pivot), len(s)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=["a", "b", "common", "n_a", "n_b"])

    return rows.select("a", "b", "shingles").mapInArrow(run, "a bigint, b bigint, common bigint, n_a bigint, n_b bigint")


def _unsettled(distances: DataFrame, labels: DataFrame, reach: float, n: int) -> DataFrame | None:
    """Members ``region, node, label, home, w`` (shingles) of cells that hold several groups so far, but those nearer to the pivot than any outside the largest group by more than ``reach``: they have no links with these."""
    far = 1 - F.col("common") / (F.col("n_a") + F.col("n_b") - F.col("common"))
    members = distances.select(F.col("a").alias("cell"), F.col("b").alias("node"), far.alias("far"), F.col("n_b").alias("w"))
    pivots = distances.select(F.col("a").alias("cell"), F.col("a").alias("node"), F.lit(0.0).alias("far"), F.col("n_a").alias("w")).distinct()
    labelled = members.unionByName(pivots).join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    labelled = checkpointed(labelled, 2 * n)
    sizes = checkpointed(labelled.groupBy("cell", "label").agg(F.count(F.lit(1)).alias("n"), F.min("far").alias("near")), 2 * n)
    main = sizes.groupBy("cell").agg(F.max_by("label", F.struct("n", "label")).alias("main"), F.count(F.lit(1)).alias("groups"), F.sum("n").alias("size"))
    rest = checkpointed(skew_join(sizes, main.filter("groups > 1 AND size > 2").select("cell", "main"), "cell").filter("label <> main").groupBy("cell").agg(F.min("near").alias("near"), F.first("main").alias("main")), n)
    if rest.isEmpty():
        return None
    open_ = skew_join(labelled, rest, "cell").filter(F.col("far") >= F.col("near") - reach)
    return open_.select(F.col("cell").alias("region"), "node", "label", (F.col("label") != F.col("main")).alias("home"), "w")


class _Members:
    """Members of a region, or of a block, in a task: which shingles they share, as bits, and the groups they form."""

    def __init__(self, rows: list[tuple], space: Space):
        self.space = space
        self.node, self.label, self.home = np.array([r[0] for r in rows], np.int64), [r[1] for r in rows], np.array([r[2] for r in rows], bool)
        self.size = np.array([len(r[3]) for r in rows], np.int64)
        _, inverse, n = np.unique(np.concatenate([r[3] for r in rows]), return_inverse=True, return_counts=True)
        shared = np.cumsum(n > 1) - 1  # shingles of one member meet nothing
        self.bits = np.zeros((len(rows), (int((n > 1).sum()) + 63) // 64), np.uint64)
        keep = n[inverse] > 1
        row, col = np.repeat(np.arange(len(rows)), self.size)[keep], shared[inverse[keep]]
        np.bitwise_or.at(self.bits, (row, col // 64), np.uint64(1) << (col % 64).astype(np.uint64))
        self.group = {x: x for x in self.label}
        self.links: list[tuple[int, int]] = []

    def root(self, x):
        while self.group[x] != x:
            self.group[x] = x = self.group[self.group[x]]
        return x

    def roots(self, which: np.ndarray) -> np.ndarray:
        return np.array([self.root(self.label[i]) for i in which.tolist()], np.int64)

    def common(self, x: int, others: np.ndarray) -> np.ndarray:
        return np.bitwise_count(self.bits[others] & self.bits[x]).sum(axis=1).astype(np.int64)

    def meet(self, x: int, others: np.ndarray) -> np.ndarray:
        """Distances of others to x; those that link with it join its group."""
        common = self.common(x, others)
        for y in others[self.space.links(common, self.size[others], self.size[x])].tolist():
            a, b = self.root(self.label[x]), self.root(self.label[y])
            if a != b:
                self.group[max(a, b)] = min(a, b)
                self.links.append((int(self.node[x]), int(self.node[y])))
        return 1 - common / (self.size[others] + self.size[x] - common)

    def pairs(self, which: np.ndarray, home: np.ndarray) -> None:
        """All links of those at home with all of them that join two groups."""
        if not home.any() or len(which) < 2:
            return
        far = self.meet(int(which[0]), which)
        for x, f in zip(which[home].tolist(), far[home].tolist()):
            near = which[np.abs(far - f) <= self.space.reach]  # the triangle inequality's window
            near = near[self.roots(near) != self.root(self.label[x])]
            if len(near):
                self.meet(x, near)

    def join(self, which: np.ndarray | None = None, home: np.ndarray | None = None) -> list[tuple[int, int]]:
        """The links that join groups, by regions within regions."""
        todo = [(np.arange(len(self.node)), self.home) if which is None else (which, home)]
        while todo:
            which, home = todo.pop()
            if not home.any() or len(set(self.roots(which).tolist())) < 2:
                continue
            if len(which) <= TINY:
                self.pairs(which, home)
                continue
            pivots = which[np.argsort(vec.mix(self.node[which].view(np.uint64)), kind="stable")[:PIVOTS]]
            far = np.array([self.meet(int(p), which) for p in pivots])
            own = far.argmin(axis=0)
            for j in range(len(pivots)):
                inside = far[j] - far.min(axis=0) <= 2 * self.space.reach
                part = which[inside], (home & (own == j))[inside]
                if inside.sum() > SPLIT * len(which):
                    self.pairs(*part)
                else:
                    todo.append(part)
        return self.links


def _grouped(batches, columns: int, empty=None):
    """Runs of rows that agree in their first columns, as (those columns, rows of the others, the last one as an array)."""
    current, held = empty, []
    for batch in batches:
        cols = [batch.column(i).to_pylist() for i in range(batch.num_columns - 1)]
        for *values, x in zip(*cols, batch.column(batch.num_columns - 1)):
            if values[:columns] != current:
                if held:
                    yield current, held
                current, held = values[:columns], []
            held.append((*values[columns:], np.frombuffer(x.as_buffer(), np.uint64).copy()))
    if held:
        yield current, held


def _in_tasks(small: DataFrame, sets: DataFrame, space: Space, tasks: int) -> DataFrame:
    """Links of small regions that join different groups."""
    rows = small.join(sets, F.col("node") == F.col("key")).select("region", "node", "label", "home", "shingles").repartition(tasks, "region").sortWithinPartitions("region", "node")

    def run(batches):
        entered("cells")
        for _, held in _grouped(batches, 1):
            if links := _Members(held, space).join():
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*links)], names=["a", "b"])
        released()

    return rows.mapInArrow(run, "a bigint, b bigint")


def _in_blocks(whole: DataFrame, sets: DataFrame, space: Space, tasks: int) -> DataFrame:
    """Links of regions (with the shingles ``total`` of all and ``own`` of those at home) that aren't split: blocks of some at home with some of all."""
    m = whole.select("*", *(F.ceil(F.col(c) / (LEAF / 2)).cast("long").alias(s) for c, s in (("own", "si"), ("total", "sj"))))
    at_home = m.filter("home").select("region", "node", "label", F.lit(True).alias("home"), F.expr("pmod(xxhash64(node), si)").alias("i"), F.explode(F.expr("sequence(0L, sj - 1)")).alias("j"))
    every = m.select("region", "node", "label", F.lit(False).alias("home"), F.explode(F.expr("sequence(0L, si - 1)")).alias("i"), F.expr("pmod(xxhash64(node, 1), sj)").alias("j"))
    rows = at_home.unionByName(every).join(sets, F.col("node") == F.col("key")).select("region", "i", "j", "node", "label", "home", "shingles")
    rows = rows.repartition(tasks, "region", "i", "j").sortWithinPartitions("region", "i", "j", "home", "node")

    def run(batches):
        entered("cells")
        for _, held in _grouped(batches, 3):
            if links := _Members(held, space).join():
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*links)], names=["a", "b"])
        released()

    return rows.mapInArrow(run, "a bigint, b bigint")


def _split(large: DataFrame, sets: DataFrame, space: Space, tasks: int) -> DataFrame:
    """``region, node, label, home, w, parent`` of the Voronoi regions with their windows, and rows without a region for links ``node``, ``label`` to pivots."""
    seeds = [F.min(F.struct(F.xxhash64("node", F.lit(k)).alias("h"), "node"))["node"] for k in range(PIVOTS)]
    pivots = large.groupBy("region").agg(F.array_distinct(F.array(*seeds)).alias("nodes"), F.first("n").alias("n"), F.first("total").alias("parent"))
    streams = F.ceil(F.col("n") / CELL).cast("long")
    first = pivots.select("region", F.explode(F.expr(f"sequence(0L, cast(ceil(n / {CELL}) as long) - 1)")).alias("i"), F.posexplode("nodes").alias("role", "node"), "parent")
    none = F.lit(None)
    first = first.join(sets, F.col("node") == F.col("key")).select("region", "i", "role", "node", none.cast("long").alias("label"), none.cast("boolean").alias("home"), "parent", "shingles")
    members = large.withColumn("i", F.pmod(F.xxhash64("node", F.lit(7)), streams))
    members = members.join(sets, F.col("node") == F.col("key")).select("region", "i", F.lit(PIVOTS).alias("role"), "node", "label", "home", F.col("total").alias("parent"), "shingles")
    rows = first.unionByName(members).repartition(tasks, "region", "i").sortWithinPartitions("region", "i", "role", "node")

    def run(batches):
        entered("cells")
        current, near = None, []
        for batch in batches:
            out = []
            cols = [batch.column(c).to_pylist() for c in ("region", "i", "role", "node", "label", "home", "parent")]
            for region, i, role, node, label, home, parent, x in zip(*cols, batch.column("shingles")):
                s = np.frombuffer(x.as_buffer(), np.uint64)
                if (region, i) != current:
                    current, near = (region, i), []
                if role < PIVOTS:
                    near.append((node, s.copy()))
                    continue
                n = np.array([len(p) for _, p in near])
                common = np.array([_common(p, s) for _, p in near])
                far = 1 - common / (n + len(s) - common)
                own = int(far.argmin())
                for j in np.flatnonzero(far - far[own] <= 2 * space.reach).tolist():
                    child = int(vec.mix(np.array([region], np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(j + 1)).view(np.int64)[0])
                    out.append((child, node, label, home and j == own, len(s), parent))
                out += [(None, node, near[j][0], None, None, None) for j in np.flatnonzero(space.links(common, n, len(s))).tolist() if near[j][0] != node]
            if out:
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=["region", "node", "label", "home", "w", "parent"])
        released()

    return rows.mapInArrow(run, "region bigint, node bigint, label bigint, home boolean, w bigint, parent bigint")


def _by_regions(members: DataFrame, sets: DataFrame, space: Space, tasks: int, n: int | None = None) -> list[DataFrame]:
    """Links that join different groups of unsettled cells, found by Voronoi regions within regions."""
    found = []
    current = checkpointed(members.withColumn("parent", F.lit(1 << 62)), n)
    while True:
        n = current.count()
        sizes = current.groupBy("region").agg(F.count(F.lit(1)).alias("n"), F.sum("w").alias("total"), F.min("label").alias("low"), F.max("label").alias("high"), F.sum(F.when(F.col("home"), F.col("w"))).alias("own"))
        live = checkpointed(skew_join(current, sizes.filter("low <> high AND own IS NOT NULL").select("region", "n", "total", "own"), "region").filter("n IS NOT NULL"), n)
        small = (F.col("total") <= LEAF) & (F.col("n") <= LEAF_MEMBERS)
        whole = ~small & ((F.col("total") > SPLIT * F.col("parent")) | (F.col("own") <= SIDES * LEAF / 2))
        found.append(checkpointed(_in_tasks(live.filter(small), sets, space, tasks), n, ROWS_A_TASK))
        if live.filter(~small).isEmpty():
            return found
        found.append(checkpointed(_in_blocks(live.filter(whole), sets, space, tasks), n, ROWS_A_TASK))
        parts = checkpointed(_split(live.filter(~small & ~whole), sets, space, tasks), n, ROWS_A_TASK)
        found.append(parts.filter("region IS NULL").select(F.col("node").alias("a"), F.col("label").alias("b")))
        current = parts.filter("region IS NOT NULL")


def _labelled(df: DataFrame, id_col: str, column: str, words: int, threshold: Fraction | str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Every row's (id, n, key, k1, k2); the first id of each key; (key, label, smallest id) of keys that link with others."""
    space = Space(Fraction(threshold))
    dealt = deal(df, id_col, column)
    tasks = dealt.n
    files = _files(df.sparkSession, tasks)
    given = checkpointed(_candidates(dealt, words, space).coalesce(files))
    rows, classes = _classes(given)
    sets = bucketed(rows.filter("shingles IS NOT NULL").select("key", "shingles").repartition(files, "key").dropDuplicates(["key"]), "key", files)
    each = checkpointed(rows.select("id", "n", "key", "k1", "k2"))
    forget(given)
    pairs = _cells(sets, space, tasks)
    distances = checkpointed(_to_pivots(pairs, sets, tasks), pairs.count(), ROWS_A_TASK)
    linked = distances.filter(F.expr(f"{space.q}L * common >= {space.p}L * (n_a + n_b - common)")).select("a", "b")
    n = distances.count()
    labels = components(linked, n)
    members = _unsettled(distances, labels, space.reach, n)
    if members is not None:
        more = reduce(DataFrame.unionByName, _by_regions(members, sets, space, tasks, 2 * n))
        if not more.isEmpty():
            labels = components(linked.unionByName(more), n + more.count())
    forget(sets)
    smallest = labels.join(classes, labels.node == classes.key).groupBy("label").agg(F.min("first").alias("smallest"))
    return each, classes, labels.join(smallest, "label").select(F.col("node").alias("key"), "label", "smallest")


def join_groups(df: DataFrame, id_col: str = "doc_id", column: str = "text", words: int = 3, threshold: Fraction | str = Fraction(9, 10)) -> DataFrame:
    """Per row: id, ``n_shingles`` and ``component_id``, the smallest id that links reach.

    Links hold between sets with Jaccard similarity at or above the threshold, exactly; equal
    sets link. A row without words (null text included) is alone. A null id takes part in no
    link and has a null component. Rows that repeat an id are rows of their own. An empty table gives
    no rows. Other columns of the input play no part, whatever their names.
    """
    each, classes, of_key = _labelled(df, id_col, column, words, threshold)
    known = classes.join(of_key, "key", "left").select("key", F.coalesce("smallest", "first").alias("component"))
    out = skew_join(each.select("id", "n", "key"), known, "key")
    alone = (F.col("n") == 0) | F.col("id").isNull()
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(alone, F.col("id")).otherwise(F.col("component")).alias("component_id"))


def one_of_each(df: DataFrame, id_col: str = "doc_id", column: str = "text", words: int = 5, threshold: Fraction | str = Fraction(4, 5)) -> DataFrame:
    """The row with the smallest id of each group, with the input's columns. Rows without words and rows with a null id stay.

    Of rows that share that id, the set with the smaller name stays; of rows that share id
    and set, the first by their columns as text. An empty table gives no rows; columns may have any names.
    """
    columns = df.columns
    each, classes, of_key = _labelled(df, id_col, column, words, threshold)
    each = each.filter("n > 0 AND id IS NOT NULL").select("id", "key", "k1", "k2")
    grouped = skew_join(each, of_key.select("key", "label"), "key").withColumn("label", F.coalesce("label", "key"))
    grouped = checkpointed(grouped, each.count())
    best = grouped.groupBy("label").agg(F.min(F.struct("id", "k1", "k2")).alias("best"))
    mine, k1, k2, place = fresh(df, "id", "k1", "k2", "place")
    own = F.struct("id", "k1", "k2")
    losers = skew_join(grouped, best, "label").filter(own != F.col("best")).select(F.col("id").alias(mine), F.col("k1").alias(k1), F.col("k2").alias(k2)).distinct()

    def make():
        def fn(texts):
            return list(set_keys(*shingle_sets(*vec.flat(texts), words)))

        return fn

    keyed = with_columns(df, column, f"`{k1}` bigint, `{k2}` bigint", make)
    same = lambda other: [F.col(f"`{id_col}`") == other[mine], keyed[k1] == other[k1], keyed[k2] == other[k2]]
    kept = keyed.join(losers, same(losers), "left_anti")
    repeated = checkpointed(each.groupBy(F.col("id").alias(mine), F.col("k1").alias(k1), F.col("k2").alias(k2)).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n"))
    if not repeated.isEmpty():
        w = Window.partitionBy(f"`{id_col}`", k1, k2).orderBy(*(F.col(f"`{c}`").cast("string") for c in columns))
        some = kept.join(repeated, same(repeated), "left_semi").withColumn(place, F.row_number().over(w)).filter(F.col(place) == 1).drop(place)
        kept = kept.join(repeated, same(repeated), "left_anti").unionByName(some)
    return kept.select(*(f"`{c}`" for c in columns))


# -- the same in DuckDB -----------------------------------------------------------------------


def sql(table: str = "documents", words: int = 3, percent: int = 90) -> str:
    """DuckDB SQL for :func:`join_groups` over a table of ``doc_id`` (none repeated or null) and ``text``: all pairs that share a shingle, for small tables."""
    return rf"""
WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM {table}),
shingles AS MATERIALIZED (SELECT DISTINCT doc_id, s FROM (SELECT doc_id, unnest(CASE WHEN len(w) >= {words} THEN list_transform(range(1, len(w) - {words} + 2), lambda i: w[i:i + {words} - 1]) WHEN len(w) > 0 THEN [w] ELSE [] END) AS s FROM words)),
sizes AS MATERIALIZED (SELECT doc_id, count(s) AS n FROM words LEFT JOIN shingles USING (doc_id) GROUP BY doc_id),
common AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY 1, 2),
links AS MATERIALIZED (SELECT a, b FROM common JOIN sizes p ON a = p.doc_id JOIN sizes q ON b = q.doc_id WHERE 100 * c >= {percent} * (p.n + q.n - c)),
both_ways AS MATERIALIZED (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT a AS node, a AS goal FROM both_ways UNION SELECT r.node, e.b FROM reach r JOIN both_ways e ON e.a = r.goal)
SELECT doc_id, n AS n_shingles, least(doc_id, coalesce(m, doc_id)) AS component_id FROM sizes LEFT JOIN (SELECT node, min(goal) AS m FROM reach GROUP BY node) ON node = doc_id"""
