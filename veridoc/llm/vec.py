"""Whole batches of texts as flat arrays: bytes, words, tokenizer pieces and hashes, without a Python step per word.

A batch is the UTF-8 bytes of its texts one after another, with the offsets of the texts.
Memory is some forty bytes per byte of text, so batches are cut by :func:`slices` to a byte
budget; a single longer text is a batch of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once.
SLICE_BYTES = 2 << 20


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", budget: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in the same order, in batches whose texts have ``budget`` bytes at most or a single row."""
    for b in batches:
        sizes = np.asarray(pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False), np.int64)
        ends = np.cumsum(sizes)
        at = 0
        while at < b.num_rows:
            upto = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + budget, "right"))
            upto = max(upto, at + 1)
            yield b.slice(at, upto - at)
            at = upto


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (one more than texts) of a string column; null is empty."""
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    column = pa.concat_arrays([column]) if column.offset == 0 else pa.array(column.to_pylist(), pa.large_binary())
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64, len(column) + 1) if len(column) else np.zeros(1, np.int64)
    buf = np.frombuffer(data, np.uint8)[: off[-1]] if data is not None and off[-1] else np.zeros(0, np.uint8)
    if off[0]:
        buf, off = buf[off[0] :], off - off[0]
    return buf, off


# -- hashes ---------------------------------------------------------------------------------


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit integers."""
    x = x.astype(np.uint64, copy=True)
    for by in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        x ^= x >> np.uint64(33)
        x *= np.uint64(by)
    x ^= x >> np.uint64(33)
    return x


_KEEP = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
#: Longer spans are hashed and compared one by one, as bytes.
LONG = 64


def lanes(buf: np.ndarray) -> np.ndarray:
    """The eight bytes from every place as a little-endian integer, zeros beyond the end."""
    padded = np.concatenate([buf, np.zeros(8, np.uint8)])
    return np.ndarray((len(buf) + 1,), "<u8", padded.data, 0, (1,))


def span_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray, salt: int = 0) -> np.ndarray:
    """64-bit hashes of byte spans; equal bytes give equal hashes wherever they stand, other bytes may.

    Each eight bytes are scrambled into the hash in turn, so no algebraic pattern of the bytes
    cancels out. Who needs to know that spans are equal compares them (:func:`distinct`).
    """
    size = end - start
    h = mix(size.astype(np.uint64) * np.uint64(0xA24BAED4963EE407) + np.uint64(salt))
    lane = lanes(buf)
    rest, k = np.flatnonzero((size > 0) & (size <= LONG)), 0
    while len(rest):
        x = lane[start[rest] + k] & _KEEP[np.minimum(size[rest] - k, 8)]
        h[rest] = mix((h[rest] ^ x) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0xD6E8FEB86659FD93))
        k += 8
        rest = rest[size[rest] > k]
    long = np.flatnonzero(size > LONG)
    if len(long):
        import xxhash

        view = memoryview(np.ascontiguousarray(buf))
        h[long] = [xxhash.xxh3_64_intdigest(view[s:e], salt) for s, e in zip(start[long].tolist(), end[long].tolist())]
    return h


def gram_hashes(buf: np.ndarray, size: int) -> np.ndarray:
    """The hashes of all strings of ``size`` bytes, from every place where one fits; no index is needed."""
    n = len(buf) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    lane, h = lanes(buf), None
    for k in range(0, size, 8):
        x = np.array(lane[k : k + n])
        if size - k < 8:
            x &= _KEEP[size - k]
        h = mix((x if h is None else h ^ x) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0xD6E8FEB86659FD93))
    return h


def same_bytes(a: np.ndarray, at: np.ndarray, b: np.ndarray, bt: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether a[at:at+size] equals b[bt:bt+size], span by span."""
    out = np.ones(len(size), bool)
    x, y = lanes(a), lanes(b)
    rest, k = np.flatnonzero((size > 0) & (size <= LONG)), 0
    while len(rest):
        differ = ((x[at[rest] + k] ^ y[bt[rest] + k]) & _KEEP[np.minimum(size[rest] - k, 8)]) != 0
        out[rest[differ]] = False
        k += 8
        rest = rest[~differ & (size[rest] > k)]
    for i in np.flatnonzero(size > LONG).tolist():
        out[i] = np.array_equal(a[at[i] : at[i] + size[i]], b[bt[i] : bt[i] + size[i]])
    return out


def distinct(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A hash of each distinct span, where it is first found, and the number of the distinct one for every span.

    Bytes are compared: spans that only share a hash are hashed anew until they don't.
    """
    size, h, salt = end - start, span_hashes(buf, start, end), 0
    while True:
        found, first, inverse = np.unique(h, return_index=True, return_inverse=True)
        lead = first[inverse]
        other = np.flatnonzero(lead != np.arange(len(lead)))
        fit = size[other] == size[lead[other]]
        fit[fit] = same_bytes(buf, start[other[fit]], buf, start[lead[other[fit]]], size[other[fit]])
        wrong = other[~fit]
        if not len(wrong):
            return found, first, inverse
        salt += 1
        h[wrong] = span_hashes(buf, start[wrong], end[wrong], salt)


# -- words and lines ------------------------------------------------------------------------


def _table(members: bytes) -> np.ndarray:
    t = np.zeros(256, bool)
    t[list(members)] = True
    return t


_SPACE = _table(b"\x20\x09\x0a\x0b\x0c\x0d")
_SYMBOL = _table(b"[#*$%&|<>]".strip(b"[]"))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def words(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of the maximal runs of bytes other than 20 and 09-0D; none crosses texts."""
    n = len(buf)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z
    inside = ~_SPACE[buf]
    cut = np.zeros(n + 1, bool)
    cut[off] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | cut[1:n]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | cut[1:n]
    start = np.flatnonzero(first)
    return start, np.flatnonzero(last) + 1, np.searchsorted(off, start, "right") - 1


def lower(buf: np.ndarray) -> np.ndarray:
    """A-Z to a-z, other bytes as they are."""
    return _LOWER[buf]


def per_text(off_of: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Sums of values by text number."""
    return np.bincount(off_of, weights=values, minlength=n).astype(np.int64)


def counts_between(flags: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Number of flags within each span."""
    c = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=c[1:])
    return c[end] - c[start]


def is_lead(buf: np.ndarray) -> np.ndarray:
    """True where a code point begins."""
    return (buf & 0xC0) != 0x80


# -- pieces of byte-level tokenizers --------------------------------------------------------

OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3


@cache
def _classes() -> np.ndarray:
    """The class of each code point as the tokenizer library's own expressions have it."""
    import tiktoken

    every = "".join(chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000)
    one_byte = {bytes([i]): i for i in range(256)}
    out = np.zeros(0x110000, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (SPACE, r"\s")):
        e = tiktoken.Encoding("class", pat_str=pattern, mergeable_ranks=one_byte, special_tokens={})
        out[np.frombuffer(e.decode_bytes(e.encode_ordinary(every)).decode().encode("utf-32-le"), np.uint32)] = kind
    return out


_CONTRACTIONS = [(ord("s"), None), (ord("t"), None), (ord("r"), ord("e")), (ord("v"), ord("e")), (ord("m"), None), (ord("l"), ord("l")), (ord("d"), None)]


def pieces(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of the matches of the public byte-BPE pattern, which cover every text.

    The pattern: ``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+``.
    Stated on runs of one class: a space before a run of another class joins it; of a longer
    run of white space all but the last character form a piece; a contraction is an
    apostrophe that begins a run (no space joined) with its letters.
    """
    if not len(buf):
        z = np.zeros(0, np.int64)
        return z, z, z
    at = np.flatnonzero(is_lead(buf))  # byte of each code point
    cp = np.frombuffer(buf.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    n = len(cp)
    kind = _classes()[cp]
    doc = np.zeros(n + 1, bool)  # first code point of a text
    doc[np.searchsorted(at, off)] = True
    doc[n] = True
    run = doc[:n].copy()
    run[1:] |= kind[1:] != kind[:-1]
    space = kind == SPACE
    begin = run.copy()
    # the last white space before another class, in the same text
    before = np.zeros(n, bool)
    before[:-1] = space[:-1] & ~space[1:] & ~doc[1:n]
    joined = before & (cp == 32)
    begin[1:][joined[:-1]] = False
    begin |= before
    apostrophe = np.flatnonzero(run & (cp == 39))
    if len(apostrophe):
        apostrophe = apostrophe[(apostrophe == 0) | doc[apostrophe] | ~joined[apostrophe - 1]]
        pad = np.concatenate([cp, np.zeros(3, np.uint32)])
        end_of = np.append(np.flatnonzero(doc), n)
        limit = end_of[np.searchsorted(end_of, apostrophe, "right").clip(max=len(end_of) - 1)]
        length = np.zeros(len(apostrophe), np.int64)
        for a, b in reversed(_CONTRACTIONS):
            k = 1 if b is None else 2
            hit = (pad[apostrophe + 1] == a) & (apostrophe + k < limit)
            if b is not None:
                hit &= pad[apostrophe + 2] == b
            length[hit] = k
        apostrophe, length = apostrophe[length > 0], length[length > 0]
        begin[apostrophe + 1] = False
        after = apostrophe + length + 1
        begin[after[after < n]] = True
        for k in (2,):  # the second letter of a long contraction begins nothing
            begin[(apostrophe + k)[length >= k]] = False
    first = np.flatnonzero(begin)
    start = at[first]
    end = np.append(start[1:], len(buf))
    return start, end, np.searchsorted(off, start, "right") - 1


class _Grown:
    """An array that grows at its end; its memory is at most twice its size."""

    def __init__(self, dtype):
        self.data, self.n = np.zeros(0, dtype), 0

    def append(self, more: np.ndarray) -> None:
        need = self.n + len(more)
        if need > len(self.data):
            data = np.zeros(max(need, 2 * self.n), self.data.dtype)
            data[: self.n] = self.data[: self.n]
            self.data = data
        self.data[self.n : need] = more
        self.n = need


class PieceCache:
    """Values of distinct pieces, kept in a worker between batches; forgets all beyond a bound of bytes, so it never changes results.

    ``compute`` gets a list of byte strings and returns their values end to end and the
    number of values of each. The pieces' bytes are kept too, and a piece is known only if its
    bytes are equal. What one batch needs is held whatever its size; arrays grow by doubling, so memory stays
    below twice the bound and what the batch brings.
    """

    def __init__(self, compute, dtype, bound: int = 48 << 20):
        self.compute, self.dtype, self.bound = compute, dtype, bound
        self.clear()

    def clear(self) -> None:
        none = np.zeros(0, np.uint64), np.zeros(0, np.int32)
        self.known = [none, none]
        self.grown, self.ends, self.raw, self.places = _Grown(self.dtype), _Grown(np.int64), _Grown(np.uint8), _Grown(np.int64)
        self.ends.append(np.zeros(1, np.int64))
        self.places.append(np.zeros(1, np.int64))

    def nbytes(self) -> int:
        return sum(x.data.nbytes for x in (self.grown, self.ends, self.raw, self.places)) + sum(x.nbytes for pair in self.known for x in pair)

    @property
    def values(self) -> np.ndarray:
        return self.grown.data[: self.grown.n]

    @property
    def offsets(self) -> np.ndarray:
        return self.ends.data[: self.ends.n]

    def _find(self, h: np.ndarray) -> np.ndarray:
        """Slots with these hashes, -1 where there are none."""
        got = np.full(len(h), -1, np.int64)
        for keys, slots in self.known:
            if len(keys):
                at = np.searchsorted(keys, h)
                at[at == len(keys)] = 0
                hit = keys[at] == h
                got[hit] = slots[at[hit]]
        return got

    def slots(self, buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The slot of each span; values of new ones are computed in one call."""
        if not len(start):
            return np.zeros(0, np.int64)
        _, first, inverse = distinct(buf, start, end)
        if self.nbytes() > self.bound:
            self.clear()
        at, stop = start[first], end[first]
        h, got, ask, salt = span_hashes(buf, at, stop), np.full(len(at), -1, np.int64), np.arange(len(at)), 0
        while len(ask):  # a slot of other bytes: the piece is under its next hash, if at all
            slot = self._find(h[ask])
            ask, slot = ask[slot >= 0], slot[slot >= 0]
            if not len(ask):
                break
            size, place = stop[ask] - at[ask], self.places.data[slot]
            fit = size == self.places.data[slot + 1] - place
            fit[fit] = same_bytes(buf, at[ask[fit]], self.raw.data, place[fit], size[fit])
            got[ask[fit]] = slot[fit]
            ask, salt = ask[~fit], salt + 1
            h[ask] = span_hashes(buf, at[ask], stop[ask], salt)
        new = np.flatnonzero(got < 0)
        if len(new):
            keys, times = np.unique(h[new], return_counts=True)
            if (times > 1).any():  # pieces of one hash that are new together: each but the first of them is looked for later under its next
                taken = set()
                for i in new.tolist():
                    salt = 0
                    while int(h[i]) in taken or self._find(h[i : i + 1])[0] >= 0:
                        salt += 1
                        h[i] = span_hashes(buf, at[i : i + 1], stop[i : i + 1], salt)[0]
                    taken.add(int(h[i]))
            raw = buf.tobytes()
            values, lengths = self.compute([raw[s:e] for s, e in zip(at[new].tolist(), stop[new].tolist())])
            got[new] = self.ends.n - 1 + np.arange(len(new))
            self.ends.append(self.ends.data[self.ends.n - 1] + np.cumsum(lengths))
            self.grown.append(values.astype(self.dtype, copy=False))
            self.raw.append(gather(buf, at[new], stop[new] - at[new]))
            self.places.append(self.places.data[self.places.n - 1] + np.cumsum(stop[new] - at[new]))
            order = np.argsort(h[new])
            self.known[1] = _merged(self.known[1], (h[new][order], got[new][order].astype(np.int32)))
            if len(self.known[1][0]) > 200_000:
                self.known = [_merged(*self.known), (h[:0], self.known[1][1][:0])]
        return got[inverse]

    def lengths(self, slots: np.ndarray) -> np.ndarray:
        return self.offsets[slots + 1] - self.offsets[slots]

    def gather(self, slots: np.ndarray) -> np.ndarray:
        """The values of the slots, end to end."""
        return gather(self.values, self.offsets[slots], self.lengths(slots))


def _merged(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    keys = np.concatenate([a[0], b[0]])
    order = np.argsort(keys, kind="stable")
    return keys[order], np.concatenate([a[1], b[1]])[order]


def gather(values: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """values[start:start+length] of every span, end to end."""
    total = int(length.sum())
    if not total:
        return values[:0]
    ends = np.cumsum(length)
    index = np.arange(total, dtype=np.int64) + np.repeat(start - (ends - length), length)
    return values[index]


def offsets_by_text(text_of: np.ndarray, length: np.ndarray, n: int) -> np.ndarray:
    """Where each text's gathered values begin; one more than texts."""
    out = np.zeros(n + 1, np.int64)
    np.cumsum(np.bincount(text_of, weights=length, minlength=n).astype(np.int64), out=out[1:])
    return out
