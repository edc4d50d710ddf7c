"""Byte-level BPE by recursive DuckDB queries in each partition.

Texts are cut into the matches of the public pattern. The distinct matches of a batch that
the worker hasn't met become token-position rows, one per byte. A recursive query joins
neighbouring tokens to the merge table, and contracts each word's leftmost pairs of minimum
rank until no pair is left; a match that is a token itself is that token, as in the tiktoken
library. Ids are decoded by an ordered aggregation over the vocabulary table.

All pairs of a word that have the minimum rank and don't overlap are contracted in one step,
where that is the same as one by one: where no token of a smaller rank begins or ends with
the merged one, so that none of the contractions makes a pair that would come first.

A long word is encoded in overlapping blocks, so its steps are few. Blocks are joined at a
token boundary of both where the two tokens beside it, encoded together, stay those two
tokens. Then no contraction crosses it: the first that did would also be made in the two tokens
alone. Blocks that don't join are encoded as one block, so the result is exact, and time
grows in proportion to the word but for words that repeat themselves, whose steps are few.

A null text is empty and has no tokens. Each task handles its rows alone: nothing is
shuffled and equal texts have equal ids. An empty table gives no rows; a column of the input
named like a result is replaced.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from veridoc.llm import vec
from veridoc.llm.common import fresh, kept, ranks, token_lengths, vocabulary, with_columns

VOCABULARY = "byte_bpe_multi_50k.tiktoken"

#: Bytes of distinct words in one recursive query; DuckDB's memory.
QUERY_BYTES, DUCKDB_MEMORY = 400_000, "300MB"
#: A longer word is cut into blocks of that many bytes, each of which overlaps the next; words that one contraction a step is for.
BLOCK, OVERLAP, SHORT = 96, 32, 32

_PAIRS = 1 << 32  # a pair of tokens as one integer: left * _PAIRS + right

#: Short words: the leftmost pair of each word in a step.
_ONE = f"""
WITH RECURSIVE state(w, pos, id, nxt, live) AS (
  SELECT w, pos, id, nxt, true FROM word_bytes
  UNION ALL (
    WITH pairs AS (
      SELECT s.w, s.pos, s.id, m.id AS merged
      FROM (SELECT * FROM state WHERE live) s LEFT JOIN merges m ON m.pair = s.id * {_PAIRS}::BIGINT + s.nxt),
    best AS (SELECT w, min(merged * {_PAIRS}::BIGINT + pos) AS b FROM pairs GROUP BY w),
    chosen AS (SELECT w, b // {_PAIRS}::BIGINT AS id, coalesce(b % {_PAIRS}::BIGINT, -2) AS pos FROM best),
    contracted AS (
      SELECT p.w, p.pos - CASE WHEN c.pos >= 0 AND p.pos > c.pos THEN 1 ELSE 0 END AS pos,
             CASE WHEN p.pos = c.pos THEN c.id ELSE p.id END AS id, c.pos >= 0 AS live
      FROM pairs p JOIN chosen c ON p.w = c.w WHERE p.pos <> c.pos + 1 OR c.pos < 0)
    SELECT w, pos, id, lead(id, 1, -1) OVER (PARTITION BY w ORDER BY pos), live FROM contracted))
SELECT w::INTEGER AS w, id::BIGINT AS id FROM state WHERE NOT live ORDER BY w, pos
"""

#: Others: all pairs of the minimum rank that don't overlap, where that is safe.
_ALL = f"""
WITH RECURSIVE state(w, pos, id, nxt, live) AS (
  SELECT w, pos, id, nxt, true FROM word_bytes
  UNION ALL (
    WITH pairs AS (
      SELECT s.w, s.pos, s.id, m.id AS merged, m.safe
      FROM (SELECT * FROM state WHERE live) s LEFT JOIN merges m ON m.pair = s.id * {_PAIRS}::BIGINT + s.nxt),
    best AS (SELECT w, min(merged) AS merged FROM pairs GROUP BY w),
    hits AS (
      SELECT p.w, p.pos, p.merged, p.safe, row_number() OVER (PARTITION BY p.w ORDER BY p.pos) AS nth
      FROM pairs p JOIN best b ON p.w = b.w AND p.merged = b.merged),
    chosen AS (
      SELECT w, pos, merged FROM (SELECT *, pos - min(pos) OVER (PARTITION BY w, pos - nth) AS far FROM hits)
      WHERE nth = 1 OR safe AND far % 2 = 0),
    marks AS (SELECT w, pos, merged FROM chosen UNION ALL SELECT w, pos + 1, -1 FROM chosen),
    contracted AS (
      SELECT p.w, p.pos, coalesce(c.merged, p.id) AS id, b.merged IS NOT NULL AS live
      FROM pairs p JOIN best b ON p.w = b.w LEFT JOIN marks c ON p.w = c.w AND p.pos = c.pos
      WHERE c.merged IS NULL OR c.merged >= 0)
    SELECT w, row_number() OVER win, id, lead(id, 1, -1) OVER win, live FROM contracted WINDOW win AS (PARTITION BY w ORDER BY pos)))
SELECT w::INTEGER AS w, id::BIGINT AS id FROM state WHERE NOT live ORDER BY w, pos
"""

_DECODE = """
SELECT i.w::INTEGER AS w, string_agg(v.hex, '' ORDER BY i.pos) AS hex
FROM id_rows i JOIN vocabulary v ON v.id = i.id GROUP BY i.w ORDER BY i.w
"""


class Coder:
    """The merge table and vocabulary of a rank file in a DuckDB of its own, for one worker process."""

    def __init__(self, path: str):
        import duckdb

        r = ranks(path)
        merges = [(left * _PAIRS + right, i) for token, i in r.items() for k in range(1, len(token)) if (left := r.get(token[:k])) is not None and (right := r.get(token[k:])) is not None]
        unsafe = {j for token, i in r.items() for k in range(1, len(token)) for part in (token[:k], token[k:]) if (j := r.get(part, -1)) > i}
        self.con = duckdb.connect()
        self.con.execute(f"SET threads = 1; SET memory_limit = '{DUCKDB_MEMORY}'; SET temp_directory = ''; SET preserve_insertion_order = false")
        self._table("merges", pa.table({"pair": pa.array([m[0] for m in merges], pa.int64()), "id": pa.array([m[1] for m in merges], pa.int64()), "safe": [m[1] not in unsafe for m in merges]}))
        self._table("vocabulary", pa.table({"id": pa.array(list(r.values()), pa.int64()), "hex": [t.hex() for t in r]}))
        self.byte_ids = np.array([r[bytes([i])] for i in range(256)], np.int64)
        self.whole = r
        self.tokens = {i: t for t, i in r.items()}
        self.sizes = token_lengths(path)
        self.ids = vec.PieceCache(self.encode, np.uint32)
        self.bytes = vec.PieceCache(self.decode, np.uint8)

    def _table(self, name: str, data: pa.Table) -> None:
        self.con.register("given", data)
        self.con.execute(f"CREATE TABLE {name} AS SELECT * FROM given")
        self.con.unregister("given")

    def _query(self, sql: str, name: str, data: pa.Table) -> pa.Table:
        self.con.register(name, data)
        out = self.con.sql(sql).to_arrow_table()
        self.con.unregister(name)
        return out

    def contract(self, words: list[bytes]) -> list[np.ndarray]:
        """The ids that each word's bytes contract to."""
        out: list = [None] * len(words)
        for query, which in ((_ONE, [i for i, w in enumerate(words) if len(w) <= SHORT]), (_ALL, [i for i, w in enumerate(words) if len(w) > SHORT])):
            sizes = np.array([len(words[i]) for i in which], np.int64)
            for part in np.split(np.arange(len(which)), np.flatnonzero(np.diff(np.cumsum(sizes) // QUERY_BYTES)) + 1):
                if not len(part):
                    continue
                size = sizes[part]
                ends = np.cumsum(size)
                w, pos = np.repeat(np.arange(len(part)), size), np.arange(ends[-1]) - np.repeat(ends - size, size)
                first = self.byte_ids[np.frombuffer(b"".join(words[which[i]] for i in part.tolist()), np.uint8)]
                nxt = np.append(first[1:], -1)
                nxt[ends - 1] = -1
                got = self._query(query, "word_bytes", pa.table({"w": w, "pos": pos, "id": first, "nxt": nxt}))
                n = np.bincount(got["w"].to_numpy(), minlength=len(part))
                for i, ids in zip(part.tolist(), np.split(got["id"].to_numpy(), np.cumsum(n)[:-1])):
                    out[which[i]] = ids
        return out

    def _apart(self, pairs: list[tuple[int, int]]) -> list[bool]:
        """Whether two tokens encoded together stay those two."""
        known = {p: None for p in pairs}
        for p, ids in zip(known, self.contract([self.tokens[a] + self.tokens[b] for a, b in known])):
            known[p] = ids.tolist() == list(p)
        return [known[p] for p in pairs]

    def long(self, words: list[bytes]) -> list[np.ndarray]:
        """Ids of long words from overlapping blocks."""
        # blocks (word, begin, end); those that don't join become one
        blocks = [(i, at, min(at + BLOCK, len(w))) for i, w in enumerate(words) for at in range(0, max(1, len(w) - OVERLAP), BLOCK - OVERLAP)]
        ids: dict[tuple, np.ndarray] = {}
        while True:
            new = [x for x in blocks if x not in ids]
            ids |= zip(new, self.contract([words[i][s:e] for i, s, e in new]))
            bounds = {x: np.concatenate([[0], np.cumsum(self.sizes[ids[x]])]) + x[1] for x in blocks}
            joints = []  # for blocks k and k + 1: places where both have a boundary, latest in the left block's inside first
            for k, (x, y) in enumerate(zip(blocks, blocks[1:])):
                if x[0] == y[0]:
                    both = np.intersect1d(bounds[x][1:-1], bounds[y][1:-1], assume_unique=True)
                    middle = (y[1] + x[2]) // 2
                    both = both[np.argsort(np.abs(both - middle), kind="stable")]
                    i, j = np.searchsorted(bounds[x], both), np.searchsorted(bounds[y], both)
                    joints.append((k, both.tolist(), list(zip(ids[x][i - 1].tolist(), ids[y][j].tolist()))))
            fits = iter(self._apart([p for _, _, pairs in joints for p in pairs]))
            at: dict[int, int] = {}
            for k, places, pairs in joints:
                good = [place for place, fit in zip(places, [next(fits) for _ in pairs]) if fit]
                if good:
                    at[k] = good[0]
            if len(at) == len(joints):
                break
            merged: list[tuple] = []
            for k, x in enumerate(blocks):
                if k and blocks[k - 1][0] == x[0] and k - 1 not in at:
                    merged[-1] = (x[0], merged[-1][1], x[2])
                else:
                    merged.append(x)
            blocks = merged
            ids = {x: ids[x] for x in blocks if x in ids}
        parts: list[list] = [[] for _ in words]
        for k, x in enumerate(blocks):
            begin = at[k - 1] if k and blocks[k - 1][0] == x[0] else x[1]
            s, e = np.searchsorted(bounds[x], [begin, at.get(k, x[2])])
            parts[x[0]].append(ids[x][s:e])
        return [np.concatenate(p) for p in parts]

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words end to end, and how many each has."""
        out: list = [None] * len(words)
        todo: tuple[list[int], list[int]] = [], []
        for i, w in enumerate(words):
            whole = self.whole.get(w)
            if whole is not None or not w:
                out[i] = np.array([] if whole is None else [whole], np.int64)
            else:
                todo[len(w) > BLOCK].append(i)
        for which, how in zip(todo, (self.contract, self.long)):
            for i, ids in zip(which, how([words[i] for i in which]) if which else ()):
                out[i] = ids
        return np.concatenate(out).astype(np.uint32) if out else np.zeros(0, np.uint32), np.fromiter(map(len, out), np.int64, len(out))

    def decode(self, runs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of runs of ids (as little-endian unsigned 32-bit integers) end to end, and how many each has."""
        sizes = np.array([len(r) // 4 for r in runs], np.int64)
        ids = np.frombuffer(b"".join(runs), np.uint32).astype(np.int64)
        w = np.repeat(np.arange(len(runs)), sizes)
        pos = np.arange(len(ids)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        out = self._query(_DECODE, "id_rows", pa.table({"w": w, "pos": pos, "id": ids}))
        got = [b""] * len(runs)
        for i, h in zip(out["w"].to_pylist(), out["hex"].to_pylist()):
            got[i] = bytes.fromhex(h)
        return np.frombuffer(b"".join(got), np.uint8), np.fromiter(map(len, got), np.int64, len(got))

    def encode_texts(self, buf: np.ndarray, off: np.ndarray):
        """Ids of all texts end to end, where each text's begin, and the runs of ids that came from one match: their sizes and texts."""
        start, end, text_of = vec.pieces(buf, off)
        slots = self.ids.slots(buf, start, end)
        sizes = self.ids.lengths(slots)
        return self.ids.gather(slots), vec.offsets_by_text(text_of, sizes, len(off) - 1), sizes, text_of

    def decode_ids(self, ids: np.ndarray, off: np.ndarray, sizes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all id sequences end to end, and where each begins. ``sizes`` cuts the ids into runs that recur; else eight at a time."""
        if sizes is None:
            ends = np.unique(np.concatenate([np.arange(0, len(ids), 8), off]))
            sizes = np.diff(np.append(ends[ends < len(ids)], len(ids)))
        e = np.cumsum(sizes)
        slots = self.bytes.slots(np.ascontiguousarray(ids.astype("<u4")).view(np.uint8), (e - sizes) * 4, e * 4)
        back = self.bytes.gather(slots)
        at = np.concatenate([[0], np.cumsum(self.bytes.lengths(slots))])
        return back, at[np.searchsorted(np.concatenate([[0], e]), off)]


@kept
def coder(path: str) -> Coder:
    return Coder(path)


def encode(df: DataFrame, column: str = "text", out: str = "token_ids", path: str | None = None) -> DataFrame:
    """Append the token ids of each text."""

    def make():
        c = coder(path or vocabulary(VOCABULARY))

        def fn(texts):
            ids, off, _, _ = c.encode_texts(*vec.flat(texts))
            return [pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(ids.astype(np.int32)))]

        return fn

    return with_columns(df, column, f"`{out}` array<int>", make)


def decode(df: DataFrame, column: str = "token_ids", out: str = "decoded", path: str | None = None) -> DataFrame:
    """Append the bytes of each id sequence; null gives empty bytes. Raises ValueError for ids outside the vocabulary."""
    from pyspark.sql import functions as F

    # the ids travel as little-endian bytes, the form that distinct runs are kept in
    hexes = F.transform(F.coalesce(F.col(f"`{column}`"), F.array().cast("array<int>")), lambda x: F.lpad(F.hex(x.cast("bigint")), 8, "0"))
    (name,) = fresh(df, "ids")
    packed = df.withColumn(name, F.unhex(F.array_join(hexes, "")))

    def make():
        c = coder(path or vocabulary(VOCABULARY))

        def fn(values):
            buf, off = vec.flat(values)
            ids = buf.view(">u4").astype(np.uint32) if len(buf) else np.zeros(0, np.uint32)
            if len(ids) and not np.isin(np.unique(ids), np.array(list(c.whole.values()), np.uint32)).all():
                raise ValueError("an id is outside the vocabulary")
            back, at = c.decode_ids(ids, off // 4)
            raw = back.tobytes()
            return [pa.array([raw[a:b] for a, b in zip(at[:-1], at[1:])], pa.binary())]

        return fn

    return with_columns(packed, name, f"`{out}` binary", make, keep=df.columns)


def digest(df: DataFrame, id_col: str = "doc_id", column: str = "text", path: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """Number and digest of each text's ids, and digest of the bytes decoded from them."""

    def make():
        c = coder(path or vocabulary(VOCABULARY))

        def fn(texts):
            ids, off, sizes, _ = c.encode_texts(*vec.flat(texts))
            back, at = c.decode_ids(ids, off, sizes)
            ids, back = memoryview(np.ascontiguousarray(ids.astype("<u4"))).cast("B"), memoryview(np.ascontiguousarray(back))
            sha = lambda view, o, k: [hashlib.sha256(view[k * a : k * b]).hexdigest() for a, b in zip(o[:-1].tolist(), o[1:].tolist())]
            return [np.diff(off), sha(ids, off, 4), sha(back, at, 1)]

        return fn

    return with_columns(df, column, "n_tokens bigint, ids_sha256 string, decoded_sha256 string", make, keep=keep or [id_col])
