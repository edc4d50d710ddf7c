"""Texts dealt to chunks, and the question which of a chunk's hashes another chunk has too.

A chunk sends its distinct hashes, sorted and packed, to the tasks that own their ranges, and
gets for each back whether another chunk has it and whether many have. A row carries the hashes
of one chunk for one task, so neither a hash nor a text costs a row, and a hash that all
documents share is sent once a chunk. Four bytes of a hash are sent besides its range; two
hashes that agree in them are taken for equal, so the answer may name a hash too many, never
one too few.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veridoc.llm import vec
from veridoc.llm.common import entered, partitions_for, planned_bytes, released

#: Bytes of text in a chunk, about. Up to so many chunks are dealt to partitions by a table.
CHUNK_BYTES, EVEN = 2 << 20, 8192
#: Answers: another chunk has the hash; more than MANY chunks have it.
TWICE, HOT, MANY = 1, 2, 64


def _murmur(x: int) -> int:
    """Spark's hash of an int column (Murmur3, seed 42)."""
    m = 0xFFFFFFFF
    rot = lambda v, r: ((v << r) | (v >> (32 - r))) & m
    k = rot(x * 0xCC9E2D51 & m, 15) * 0x1B873593 & m
    h = (rot(42 ^ k, 13) * 5 + 0xE6546B64) & m ^ 4
    h = (h ^ h >> 16) * 0x85EBCA6B & m
    h = (h ^ h >> 13) * 0xC2B2AE35 & m
    h ^= h >> 16
    return h - (1 << 32) if h >> 31 else h


def dealt_evenly(n: int, each: int = 1) -> list[int]:
    """Integers of which ``repartition(n, ...)`` sends exactly ``each`` to each of n partitions, one partition after another."""
    found: list[list[int]] = [[] for _ in range(n)]
    x = missing = 0
    while missing < n * each:
        place = found[_murmur(x) % n]
        if len(place) < each:
            place.append(x)
            missing += 1
        x += 1
    return [x for place in found for x in place]


@dataclass
class Dealt:
    """``docs (id, text, c)``, by chunk in ``n`` partitions; ``slots[b]`` is an integer that goes to the b-th."""

    docs: DataFrame
    n: int
    slots: list[int]


def deal(df: DataFrame, id_col: str, column: str, chunk_bytes: int | None = None) -> Dealt:
    """One exchange of the texts, by a hash of the id, or of the text where the id is null."""
    docs = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{column}`").cast("string").alias("text"))
    n = partitions_for(docs)
    size = planned_bytes(docs)
    # packed text is about half its size
    per = 8 if size is None else max(1, -(-2 * size // (n * (chunk_bytes or CHUNK_BYTES))))
    h = F.xxhash64(F.coalesce("id", F.xxhash64("text")))
    if n * per <= EVEN:
        slots = dealt_evenly(n)
        c = F.element_at(F.array(*map(F.lit, dealt_evenly(n, per))), (F.pmod(h, F.lit(n * per)) + 1).cast("int"))
    else:  # many chunks to a partition come out even by themselves
        slots = list(range(n))
        c = F.pmod(h, F.lit(n * max(per, 8))).cast("int")
    return Dealt(docs.select("id", "text", c.alias("c")).repartition(n, "c"), n, slots)


class Ordered:
    """The documents of a chunk in ascending (id, text) order, null ids last: ``ids``, ``null``, ``buf``, ``off``."""

    def __init__(self, table: pa.Table):
        raw = pc.fill_null(table.column("text").cast(pa.large_binary()), b"").to_pylist()
        ids = table.column("id")
        null = np.asarray(ids.is_null().to_numpy(), bool)
        given = np.asarray(pc.fill_null(ids, 0).to_numpy(), np.int64)
        order = sorted(range(len(raw)), key=lambda i: (bool(null[i]), given[i], raw[i]))
        self.ids, self.null = given[order], null[order]
        self.buf, self.off = vec.flat(pa.array([raw[i] for i in order], pa.large_binary()))


def ranges(names: np.ndarray, n: int) -> np.ndarray:
    """Which of n equal ranges each hash lies in."""
    return ((names >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def elsewhere(dealt: Dealt, names: Callable[[pa.Table], np.ndarray]) -> DataFrame:
    """``(c, b, twice, hot)``: for the sorted distinct hashes that ``names`` makes of a chunk, by range, bits that say which ones another chunk has and which ones many have. Ranges without any have no row."""
    n, slots = dealt.n, dealt.slots

    def send(table: pa.Table) -> pa.Table:
        entered("chunks")
        found = names(table)
        b = ranges(found, n)
        cut = np.flatnonzero(np.diff(b, prepend=-1))
        low = found.astype(np.uint32)
        parts = [low[s:e].tobytes() for s, e in zip(cut, np.append(cut[1:], len(b)))]
        c = table.column("c")[0].as_py()
        return pa.table({"bucket": pa.array([slots[x] for x in b[cut].tolist()], pa.int32()), "b": pa.array(b[cut], pa.int32()), "c": pa.array([c] * len(cut), pa.int32()), "names": pa.array(parts, pa.binary())})

    def answer(batches):
        rows, parts = [], []
        for batch in batches:
            rows += zip(batch.column("b").to_pylist(), batch.column("c").to_pylist())
            parts += [np.frombuffer(x.as_buffer(), np.uint32).copy() for x in batch.column("names")]
        if not rows:
            return
        full = lambda i: parts[i].astype(np.uint64) | np.uint64(rows[i][0] << 32)
        every = np.concatenate([full(i) for i in range(len(rows))])
        every.sort()
        new = np.ones(len(every), bool)
        new[1:] = every[1:] != every[:-1]
        first = np.flatnonzero(new)
        times = np.diff(np.append(first, len(every)))
        twice, often = every[first[times > 1]], every[first[times > MANY]]
        del every, new, first, times

        def among(some: np.ndarray, found: np.ndarray) -> np.ndarray:
            if not len(some):
                return np.zeros(len(found), bool)
            at = np.searchsorted(some, found)
            at[at == len(some)] = 0
            return some[at] == found

        out = []
        for i, (b, c) in enumerate(rows):
            found = full(i)
            bits = among(twice, found)
            if bits.any():
                hot = among(often, found)
                out.append((b, c, np.packbits(bits).tobytes(), np.packbits(hot).tobytes() if hot.any() else None))
            if len(out) == 1000 or out and i == len(rows) - 1:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary() if k > 1 else pa.int32()) for k, x in enumerate(zip(*out))], names=["b", "c", "twice", "hot"])
                out = []
        del parts, rows
        released()

    sent = dealt.docs.groupBy("c").applyInArrow(send, "bucket int, b int, c int, names binary").repartition(n, "bucket")
    return sent.mapInArrow(answer, "b int, c int, twice binary, hot binary")


def unpacked(names: np.ndarray, replies: pa.Table, n: int) -> np.ndarray:
    """For a chunk's sorted distinct hashes: 0, or TWICE and HOT as they hold."""
    out = np.zeros(len(names), np.uint8)
    b = ranges(names, n)
    for x, *answers in zip(*(replies.column(c).to_pylist() for c in ("b", "twice", "hot"))):
        s, e = np.searchsorted(b, [x, x + 1])
        for flag, bits in zip((TWICE, HOT), answers):
            if bits is not None:
                out[s:e] |= np.unpackbits(np.frombuffer(bits, np.uint8), count=e - s) * np.uint8(flag)
    return out
