"""Exact substring dedup by longest-previous-factor arrays over suffixes, distributed.

A byte goes if it is covered by a string of ``length`` bytes that also starts in a document
with a smaller id. Of suffixes in byte order (cut at that length), the nearest one before and
the nearest one after whose document is smaller, the previous and next smaller values, have
the longest common prefixes with a suffix that any smaller document gives: its longest
previous factor. Where that reaches the length, the string is a later copy and goes.

No task sees all suffixes. Equal strings have equal smallest hashes of the q-grams inside
them, so a window's *minimizer* names where it has to go:

1. Texts are dealt to chunks by a hash of the id. A chunk sends each distinct minimizer of
   its windows, four bytes, to the task of that hash.
2. That task answers whether another chunk has it, and whether so many have it that it is *hot*.
3. The chunk makes the array for the windows whose minimizers it holds in two documents, so that matches
   within the chunk are settled. Of the rest, windows whose minimizer another chunk has are
   sent as stretches of text. So a passage is sent once a chunk, however many documents hold it.
4. The minimizer's task makes the array of the stretches and returns the runs of windows that
   have an earlier match. Stretches of a hot minimizer are dealt over several tasks first;
   of each string only the smallest document that such a task has goes on to the minimizer's
   task, so a line that all documents share is reduced in two steps.
5. The chunk marks the bytes.

The chunks' texts cross the network once: the three uses share one exchange. Matches never
cross documents and are judged on the input. A null text is empty; a null id neither removes
nor loses anything; rows that share an id don't remove from each other; texts shorter than
the length stay whole. An empty table gives no rows. Other columns of the input play no part,
whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veridoc.llm import vec
from veridoc.llm.chunks import HOT, Ordered, deal, elsewhere, ranges, unpacked
from veridoc.llm.common import entered, released

LENGTH, GRAM = 50, 16
#: Windows whose suffixes are ordered at once, but for those of one minimizer.
AT_ONCE = 150_000
#: Tasks that the stretches of a hot minimizer are dealt to first.
SALTS = 64
#: Steps from suffix to suffix after which those that still look for a smaller value are settled by a stack.
JUMPS = 48

_HOLD = "bucket int, kind int, c int, names binary, docs binary, ids binary, starts binary, lengths binary, data binary"
#: Kinds of rows: stretches for the last step, runs of windows that are gone, stretches for the first of two steps.
LAST, GONE, FIRST = 0, 1, 2


# -- suffixes ---------------------------------------------------------------------------------


def _levels(buf: np.ndarray, length: int) -> tuple[np.ndarray, dict[int, np.ndarray]]:
    """By prefix doubling, the place of buf[i:i+length] in byte order for every i, and the same for 8, 16, 32 ... bytes; equal strings share it."""
    n = len(buf)
    wide = np.concatenate([buf, np.zeros(length + 16, np.uint8)])
    key = vec.lanes(wide)[: n + length].byteswap()
    have, levels = min(8, length), {}
    key >>= np.uint64(8 * (8 - have))
    while have < length:
        rank = np.unique(key, return_inverse=True)[1].astype(np.uint32)
        levels[have] = rank
        step = min(have, length - have)
        key = rank.astype(np.uint64) << np.uint64(32)
        key[: len(rank) - step] |= rank[step:]
        have += step
    return key, levels


def suffix_ranks(buf: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """The place of buf[i:i+length] in byte order among all such strings, for i in ``at``; equal strings share it."""
    return np.unique(_levels(buf, length)[0][at], return_inverse=True)[1]


def _common(buf: np.ndarray, levels: dict[int, np.ndarray], a: np.ndarray, b: np.ndarray, length: int) -> np.ndarray:
    """Bytes that the strings at a and b have in common at their begin, ``length`` at most."""
    out = np.zeros(len(a), np.int64)
    for size in sorted(levels, reverse=True):
        out += size * (levels[size][a + out] == levels[size][b + out])
    lane = vec.lanes(np.concatenate([buf, np.zeros(2 * length + 8, np.uint8)]))
    x = lane[a + out] ^ lane[b + out]
    low = x & (~x + np.uint64(1))  # the lowest bit that differs
    tail = np.where(x == 0, 8, np.log2(np.maximum(low, 1).astype(np.float64)).astype(np.int64) // 8)
    return np.minimum(out + tail, length)


def _smaller_before(value: np.ndarray, least: np.ndarray) -> np.ndarray:
    """For every place, the minimum of ``least`` from the nearest smaller value before it (exclusive) up to it; 0 where there is none.

    All places jump at once: what a place has passed, so has each that comes to it.
    """
    n = len(value)
    at, low = np.arange(-1, n - 1), least.copy()
    low[:1] = 0
    todo = np.flatnonzero((at >= 0) & (value[np.maximum(at, 0)] >= value))
    for _ in range(JUMPS):
        if not len(todo):
            break
        over = at[todo]
        low[todo], at[todo] = np.minimum(low[todo], low[over]), at[over]
        none = at[todo] < 0
        low[todo[none]] = 0
        todo = todo[~none]
        todo = todo[value[at[todo]] >= value[todo]]
    if len(todo):  # long ascents: one pass with a stack
        stack: list[tuple] = []
        for i, (v, m) in enumerate(zip(value.tolist(), least.tolist())):
            while stack and stack[-1][0] >= v:
                m = min(m, stack.pop()[1])
            low[i] = m if stack else 0
            stack.append((v, m))
    return low


def longest_previous_factors(buf: np.ndarray, at: np.ndarray, doc: np.ndarray, length: int) -> np.ndarray:
    """For the string of ``length`` bytes at each place: how many of its first bytes also start, at one of these places, in a smaller document.

    Equal strings are one entry of the suffix order, with their smallest document. The other
    documents have their longest previous factor there; for the smallest one it is the larger of
    the common prefixes with the previous and the next entry of a smaller document.
    """
    if not len(at):
        return np.zeros(0, np.int64)
    key, levels = _levels(buf, length)
    _, first, inverse = np.unique(key[at], return_index=True, return_inverse=True)
    order = np.lexsort((doc, inverse))
    new = np.ones(len(order), bool)
    new[1:] = inverse[order][1:] != inverse[order][:-1]
    smallest = doc[order][new]
    place = at[first]
    common = np.zeros(len(place) + 1, np.int64)  # of an entry and the one before
    common[1:-1] = _common(buf, levels, place[:-1], place[1:], length)
    before = _smaller_before(smallest, common[:-1])
    after = _smaller_before(smallest[::-1], common[1:][::-1])[::-1]
    return np.where(doc > smallest[inverse], length, np.maximum(before, after)[inverse])


def has_earlier(buf: np.ndarray, at: np.ndarray, doc: np.ndarray, length: int) -> np.ndarray:
    """Whether the string at each place also starts in a smaller document: its longest previous factor reaches the length."""
    return longest_previous_factors(buf, at, doc, length) >= length


def earlier_in_stretches(buf: np.ndarray, count: np.ndarray, ids: np.ndarray, length: int) -> np.ndarray:
    """For stretches laid end to end, of ``count`` windows each: whether each window's string starts in a smaller document of them.

    Of equal stretches only one with the smallest id is ranked. Those with a larger id are later
    copies throughout, those with the same id share its answer.
    """
    size = count + length - 1
    start = np.cumsum(size) - size
    h = vec.span_hashes(buf, start, start + size)
    order = np.lexsort((ids, h))
    new = np.ones(len(order), bool)
    new[1:] = h[order][1:] != h[order][:-1]
    lead = np.empty(len(order), np.int64)
    lead[order] = order[np.flatnonzero(new)][np.cumsum(new) - 1]
    # equal hashes are held against the bytes
    fit = size == size[lead]
    lead[~fit] = np.flatnonzero(~fit)
    other = np.flatnonzero(lead != np.arange(len(lead)))
    if len(other):
        same = vec.gather(buf, start[other], size[other]) == vec.gather(buf, start[lead[other]], size[other])
        wrong = other[~np.logical_and.reduceat(same, np.cumsum(size[other]) - size[other])]
        lead[wrong] = wrong
    leaders = np.flatnonzero(lead == np.arange(len(lead)))
    flat = vec.gather(buf, start[leaders], size[leaders])
    found = has_earlier(flat, _window_starts(count[leaders], length), np.repeat(ids[leaders], count[leaders]), length)
    place = np.zeros(len(lead), np.int64)
    place[leaders] = np.cumsum(count[leaders]) - count[leaders]
    return vec.gather(found, place[lead], count) | np.repeat(ids > ids[lead], count)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """min(x[i:i+width]) for every i where that fits."""
    have, out = 1, x
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out


def chunk_salt(c: int) -> int:
    """Which of the first tasks of hot minimizers a chunk sends to."""
    return int(vec.mix(np.array([c], np.uint64))[0]) % SALTS


class Chunk(Ordered):
    """The same with the minimizers of their windows."""

    def __init__(self, table: pa.Table, length: int, gram: int):
        super().__init__(table)
        size = np.diff(self.off)
        n = np.where(self.null, 0, np.maximum(size - length + 1, 0))
        self.doc = np.repeat(np.arange(len(size)), n)
        starts = np.zeros(len(self.buf) + 1, np.int8)  # places where windows of a text begin, and end
        np.add.at(starts, self.off[:-1][n > 0], 1)
        np.add.at(starts, (self.off[:-1] + n)[n > 0], -1)
        self.at = np.flatnonzero(np.cumsum(starts[:-1], dtype=np.int8))
        if len(self.at):
            grams = vec.gram_hashes(self.buf, gram)
            # minima crowd at the low end, so they are scrambled again before they are dealt by range
            self.low = vec.mix(sliding_min(grams, length - gram + 1)[self.at])
        else:
            self.low = np.zeros(0, np.uint64)
        # runs of windows of one document with one minimizer
        new = np.ones(len(self.at), bool)
        new[1:] = (self.low[1:] != self.low[:-1]) | (self.doc[1:] != self.doc[:-1])
        self.run = np.flatnonzero(new)
        self.names, inverse = np.unique(self.low[self.run], return_inverse=True)
        least, most = np.full(len(self.names), np.iinfo(np.int64).max), np.full(len(self.names), np.iinfo(np.int64).min)
        of = self.ids[self.doc[self.run]]
        np.minimum.at(least, inverse, of)
        np.maximum.at(most, inverse, of)
        self.inverse, self.several = inverse, least < most

    def by_window(self, of_name: np.ndarray) -> np.ndarray:
        """A value per window from a value per minimizer."""
        return np.repeat(of_name[self.inverse], np.diff(np.append(self.run, len(self.at))))


def runs_of(doc: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, first and last of the runs of consecutive window starts; input sorted."""
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (start[1:] != start[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(doc)) - 1 if len(doc) else first
    return doc[first], start[first], start[last]


def _window_starts(count: np.ndarray, length: int) -> np.ndarray:
    """Where windows start in stretches laid end to end; a stretch of k windows has k + length - 1 bytes."""
    base = np.cumsum(count + length - 1) - (count + length - 1)
    return vec.gather(np.arange(int((count + length - 1).sum())), base, count)


def _stretches(buf: np.ndarray, start: np.ndarray, size: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The stretches' bytes end to end, and their window starts there."""
    return vec.gather(buf, start, size), _window_starts(size - length + 1, length)


# -- the operator -----------------------------------------------------------------------------


_FIELDS = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("c", pa.int32()), ("names", pa.binary()), ("docs", pa.binary()), ("ids", pa.binary()), ("starts", pa.binary()), ("lengths", pa.binary()), ("data", pa.binary())])


def _gone(c: int, doc: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple:
    """A row for the chunk: runs of windows that go, by document and byte of its text."""
    return c, GONE, c, None, doc.astype(np.int32).tobytes(), None, first.tobytes(), last.tobytes(), None


class Stretches:
    """Stretches of text laid end to end, as rows of ``_HOLD`` bring them: each has a minimizer, a chunk, a document in it, the document's id, a start there and a number of windows."""

    def __init__(self, batches: list[pa.RecordBatch], length: int):
        read = lambda name, kind: [np.frombuffer(x.as_buffer(), kind) for b in batches for x in b.column(name)]
        parts = read("docs", np.int32)
        self.c = np.repeat([x for b in batches for x in b.column("c").to_pylist()], [len(x) for x in parts])
        self.doc = np.concatenate(parts).astype(np.int64)
        self.id, self.start, self.count = (np.concatenate(read(c, np.int64)) for c in ("ids", "starts", "lengths"))
        self.name, self.data = np.concatenate(read("names", np.uint64)), np.concatenate(read("data", np.uint8))
        self.length = length
        self.size = self.count + length - 1
        self.begin = np.cumsum(self.size) - self.size

    @classmethod
    def cut(cls, c: int, name: np.ndarray, doc: np.ndarray, ids: np.ndarray, start: np.ndarray, count: np.ndarray, buf: np.ndarray, at: np.ndarray, length: int) -> Stretches:
        """Stretches of one chunk from the bytes of its texts."""
        out = cls.__new__(cls)
        out.c, out.name, out.doc, out.id, out.start, out.count, out.length = np.full(len(name), c), name, doc, ids, start, count, length
        out.size, out.data, out.begin = count + length - 1, buf, at
        return out

    def earlier(self):
        """(stretch, window in it, whether its string starts in a smaller document) of all windows, whole minimizers at a time, so that memory follows the largest of them."""
        order = np.argsort(self.name, kind="stable")
        new = np.flatnonzero(np.concatenate([[True], self.name[order][1:] != self.name[order][:-1]]))
        before = (np.cumsum(self.count[order]) - self.count[order])[new] // AT_ONCE
        cut = new[np.concatenate([[True], before[1:] != before[:-1]])]
        for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(order)]):
            part = order[a:b]
            n = self.count[part]
            found = earlier_in_stretches(vec.gather(self.data, self.begin[part], self.size[part]), n, self.id[part], self.length)
            yield np.repeat(part, n), np.arange(len(found)) - np.repeat(np.cumsum(n) - n, n), found

    def part(self, row: np.ndarray, within: np.ndarray) -> Stretches:
        """The stretches of these windows alone; input sorted."""
        r, first, last = runs_of(row, within)
        out = Stretches.__new__(Stretches)
        out.c, out.doc, out.id, out.name, out.data, out.length = self.c[r], self.doc[r], self.id[r], self.name[r], self.data, self.length
        out.start, out.count = self.start[r] + first, last - first + 1
        out.size = out.count + self.length - 1
        out.begin = self.begin[r] + first
        return out

    def rows(self, kind: int, bucket: np.ndarray) -> list[tuple]:
        """A row for each chunk and bucket."""
        order = np.lexsort((bucket, self.c))
        b, c = bucket[order], self.c[order]
        cut = np.flatnonzero(np.concatenate([[True], (b[1:] != b[:-1]) | (c[1:] != c[:-1])])) if len(order) else order
        out = []
        for s, e in zip(cut.tolist(), [*cut[1:].tolist(), len(order)]):
            f = order[s:e]
            data = vec.gather(self.data, self.begin[f], self.size[f])
            out.append((int(b[s]), kind, int(c[s]), self.name[f].tobytes(), self.doc[f].astype(np.int32).tobytes(), self.id[f].tobytes(), self.start[f].tobytes(), self.count[f].astype(np.int64).tobytes(), data.tobytes()))
        return out


def remove_repeats(df: DataFrame, id_col: str = "doc_id", column: str = "text", length: int = LENGTH, gram: int = GRAM, with_text: bool = False) -> DataFrame:
    """Per row: id, ``n_bytes``, ``n_removed``, ``n_spans`` (maximal removed runs), ``kept_sha256``, and the remaining bytes if asked for."""
    if not 0 < gram <= length:
        raise ValueError("the q-gram must not be longer than the string")
    dealt = deal(df, id_col, column)
    n, slots, docs = dealt.n, np.array(dealt.slots), dealt.docs
    answers = elsewhere(dealt, lambda table: Chunk(table, length, gram).names)

    def table_of(rows: list[tuple]) -> pa.Table:
        return pa.Table.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), _FIELDS.types)], schema=_FIELDS) if rows else _FIELDS.empty_table()

    def settle(key, table: pa.Table, replies: pa.Table) -> pa.Table:
        if not table.num_rows:
            return _FIELDS.empty_table()
        mine = key[0].as_py()
        c = Chunk(table, length, gram)
        other = c.by_window(unpacked(c.names, replies, n))
        gone = np.zeros(len(c.at), bool)
        local = np.flatnonzero(c.by_window(c.several))
        if len(local):
            # only stretches that hold such windows are ranked
            d, s, e = runs_of(c.doc[local], c.at[local])
            flat, at = _stretches(c.buf, s, e - s + length, length)
            gone[local] = has_earlier(flat, at, c.ids[c.doc[local]], length)
        rows = [_gone(mine, *runs_of(c.doc[gone], c.at[gone] - c.off[c.doc[gone]]))] if gone.any() else []
        ship = np.flatnonzero((other > 0) & ~gone)
        if len(ship):
            name, doc, at = c.low[ship], c.doc[ship], c.at[ship]
            new = np.ones(len(ship), bool)
            new[1:] = (name[1:] != name[:-1]) | (doc[1:] != doc[:-1]) | (at[1:] != at[:-1] + 1)
            first = np.flatnonzero(new)
            count = np.diff(np.append(first, len(ship)))
            hot = (other[ship[first]] & HOT) > 0
            to = ranges(name[first], n)
            salted = (to + 1 + chunk_salt(mine) * max(1, n // SALTS)) % n
            for kind, which, where in ((LAST, ~hot, to), (FIRST, hot, salted)):
                f = first[which]
                if len(f):
                    s = Stretches.cut(mine, name[f], doc[f], c.ids[doc[f]], at[f] - c.off[doc[f]], count[which], c.buf, at[f], length)
                    rows += s.rows(kind, slots[where[which]])
        return table_of(rows)

    def find(batches):
        entered("chunks")
        held: dict[int, list] = {LAST: [], FIRST: []}
        for b in batches:
            for kind in (GONE, LAST, FIRST):
                some = b.filter(pc.equal(b.column("kind"), kind))
                if some.num_rows and kind == GONE:
                    yield some
                elif some.num_rows:
                    held[kind].append(some)
        out = []
        for kind, parts in held.items():
            if not parts:
                continue
            s = Stretches(parts, length)
            parts.clear()
            hits = []
            for row, within, found in s.earlier():
                hits.append((row[found].astype(np.int32), (s.start[row] + within)[found]))
                if kind == FIRST and not found.all():
                    rest = s.part(row[~found], within[~found])
                    out += rest.rows(LAST, slots[ranges(rest.name, n)])
            row, start = (np.concatenate(x) for x in zip(*hits))
            order = np.lexsort((start, s.doc[row], s.c[row]))
            c, d, x = s.c[row][order], s.doc[row][order], start[order]
            del s
            new = np.flatnonzero(np.diff(c, prepend=-1))
            for a, b in zip(new.tolist(), [*new[1:].tolist(), len(c)]):
                out.append(_gone(int(c[a]), *runs_of(d[a:b], x[a:b])))
        for k in range(0, len(out), 500):
            yield from table_of(out[k : k + 500]).to_batches()
        released()

    stretches = docs.groupBy("c").cogroup(answers.groupBy("c")).applyInArrow(settle, _HOLD)
    for _ in range(2):  # hot minimizers take both steps, the others are done after the first
        stretches = stretches.repartition(n, "bucket").mapInArrow(find, _HOLD)
    gone_runs = stretches.select("c", "docs", "starts", F.col("lengths").alias("ends"))
    fields = [("id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())] + [("kept", pa.binary())] * with_text

    def mark(key, table: pa.Table, runs: pa.Table) -> pa.Table:
        if not table.num_rows:
            return pa.schema(fields).empty_table()
        c = Ordered(table)
        edge = np.zeros(len(c.buf) + 1, np.int32)
        for d, s, e in zip(*(runs.column(x).to_pylist() for x in ("docs", "starts", "ends"))):
            base = c.off[np.frombuffer(d, np.int32)]
            np.add.at(edge, base + np.frombuffer(s, np.int64), 1)
            np.add.at(edge, base + np.frombuffer(e, np.int64) + length, -1)
        gone = np.cumsum(edge[:-1]) > 0
        begin = gone.copy()
        begin[1:] &= ~gone[:-1]
        inner = c.off[:-1][(c.off[:-1] < len(gone))]
        begin[inner] = gone[inner]
        removed, spans = vec.counts_between(gone, c.off[:-1], c.off[1:]), vec.counts_between(begin, c.off[:-1], c.off[1:])
        kept = c.buf[~gone].tobytes()
        ends = np.cumsum(np.diff(c.off) - removed).tolist()
        left = [kept[a:b] for a, b in zip([0, *ends], ends)]
        cols = [pa.array(c.ids, pa.int64(), mask=c.null), np.diff(c.off), removed, spans, [hashlib.sha256(x).hexdigest() for x in left]] + [left] * with_text
        return pa.Table.from_arrays([pa.array(x, t) if not isinstance(x, pa.Array) else x for x, (_, t) in zip(cols, fields)], schema=pa.schema(fields))

    out = docs.groupBy("c").cogroup(gone_runs.groupBy("c")).applyInArrow(mark, "id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + ", kept binary" * with_text)
    return out.withColumnRenamed("id", id_col)


# -- the same in DuckDB -----------------------------------------------------------------------


def sql(table: str = "documents", length: int = LENGTH) -> str:
    """DuckDB SQL for :func:`remove_repeats` over a table of ``doc_id`` (none repeated or null) and ``text``: every string of that length as a row, for small tables."""
    return f"""
WITH bytes AS MATERIALIZED (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM {table}),
windows AS MATERIALIZED (SELECT doc_id, p, substring(h, 2 * p + 1, {2 * length}) AS s FROM (SELECT doc_id, h, unnest(range(0, greatest(0, length(h) // 2 - {length - 1}))) AS p FROM bytes)),
firsts AS (SELECT s, min(doc_id) AS first FROM windows GROUP BY s HAVING min(doc_id) <> max(doc_id)),
gone AS (SELECT doc_id, p FROM windows JOIN firsts USING (s) WHERE first < doc_id),
runs AS MATERIALIZED (SELECT doc_id, min(p) AS a, max(p) + {length} AS b FROM (SELECT doc_id, p, sum(CAST(p > coalesce(q, -{length} - 1) + {length} AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY p) AS g FROM (SELECT doc_id, p, lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS q FROM gone)) GROUP BY doc_id, g),
cuts AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM runs),
kept AS (SELECT doc_id, string_agg(substring(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS head, max(b) AS last, count(*) AS n, sum(b - a) AS removed FROM cuts JOIN bytes USING (doc_id) GROUP BY doc_id)
SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n, 0) AS BIGINT) AS n_spans,
sha256(unhex(coalesce(head || substring(h, 2 * last + 1), h))) AS kept_sha256 FROM bytes LEFT JOIN kept USING (doc_id)"""
