"""Media columns: a Matroska writer and a parser of its elements into packet tables.

Payloads are stored as unsigned 8-bit PCM at 8 kHz, so a byte is a sample and 8 samples are
a millisecond. Frames are laced into SimpleBlocks, blocks stand in clusters, and each
cluster has a cue. The parser handles variable-length ids and sizes, unknown sizes,
SimpleBlock and BlockGroup, and no, Xiph, fixed-size and EBML lacing.

A frame of a lace has the block's timestamp and, where its track states how long a frame lasts,
that time after the one before.

Null is an empty text; an empty payload is padded to one unit; equal texts give equal bytes.
Nothing is shuffled, and a text takes memory in proportion to its own size. An empty table
gives no rows; a column of the input named like a result is replaced, the others stay.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from veridoc.llm.common import with_columns

#: Element ids of the published format.
EBML, SEGMENT, INFO, TRACKS, CLUSTER, CUES = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x1654AE6B, 0x1F43B675, 0x1C53BB6B
TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, CODEC_ID, DEFAULT_DURATION = 0xAE, 0xD7, 0x73C5, 0x83, 0x86, 0x23E383
AUDIO, SAMPLING_FREQUENCY, CHANNELS, BIT_DEPTH = 0xE1, 0xB5, 0x9F, 0x6264
TIMESTAMP_SCALE, DURATION, MUXING_APP, WRITING_APP = 0x2AD7B1, 0x4489, 0x4D80, 0x5741
CLUSTER_TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK = 0xE7, 0xA3, 0xA0, 0xA1
CUE_POINT, CUE_TIME, CUE_TRACK_POSITIONS, CUE_TRACK, CUE_CLUSTER_POSITION = 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
MASTERS = {SEGMENT, INFO, TRACKS, CLUSTER, CUES, TRACK_ENTRY, AUDIO, BLOCK_GROUP, CUE_POINT, CUE_TRACK_POSITIONS}

#: Samples: unit of padding, frame, cluster. Frames in a block.
UNIT, FRAME, CLUSTER_SAMPLES, LACED = 64, 512, 32768, 8
SAMPLES_A_MS = 8


def pad(data: bytes) -> bytes:
    """Zero bytes up to a positive multiple of the unit."""
    return data + bytes(-len(data) % UNIT or (0 if data else UNIT))


# -- writing ----------------------------------------------------------------------------------


def _size(n: int) -> bytes:
    w = 1
    while n >= (1 << 7 * w) - 1:
        w += 1
    return ((1 << 7 * w) | n).to_bytes(w, "big")


def _id(x: int) -> bytes:
    return x.to_bytes((x.bit_length() + 7) // 8, "big")


def element(kind: int, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return _id(kind) + _size(len(body)) + body


def _uint(kind: int, n: int) -> bytes:
    return element(kind, n.to_bytes(max(1, (n.bit_length() + 7) // 8), "big"))


def _signed_size(n: int) -> bytes:
    w = 1
    while not -((1 << 7 * w - 1) - 1) <= n <= (1 << 7 * w - 1) - 1:
        w += 1
    return ((1 << 7 * w) | (n + (1 << 7 * w - 1) - 1)).to_bytes(w, "big")


def _block(track: int, relative_ms: int, frames: list[bytes]) -> bytes:
    sizes = [len(f) for f in frames]
    if len(frames) == 1:
        flags, head = 0x80, b""
    elif len(set(sizes)) == 1:
        flags, head = 0x84, bytes([len(frames) - 1])
    else:
        flags = 0x86
        head = bytes([len(frames) - 1]) + _size(sizes[0]) + b"".join(_signed_size(b - a) for a, b in zip(sizes, sizes[1:-1]))
    return element(SIMPLE_BLOCK, _size(track), struct.pack(">hB", relative_ms, flags), head, *frames)


_HEAD = element(EBML, _uint(0x4286, 1), _uint(0x42F7, 1), _uint(0x42F2, 4), _uint(0x42F3, 8), element(0x4282, b"matroska"), _uint(0x4287, 4), _uint(0x4285, 2))
_TRACKS = element(
    TRACKS,
    element(
        TRACK_ENTRY, _uint(TRACK_NUMBER, 1), _uint(TRACK_UID, 1), _uint(TRACK_TYPE, 2), _uint(DEFAULT_DURATION, FRAME * 1_000_000 // SAMPLES_A_MS), element(CODEC_ID, b"A_PCM/INT/LIT"),
        element(AUDIO, element(SAMPLING_FREQUENCY, struct.pack(">d", 8000.0)), _uint(CHANNELS, 1), _uint(BIT_DEPTH, 8)),
    ),
)


def write(payload: bytes) -> bytes:
    """A Matroska file with the payload, a multiple of the unit, as the samples of track 1."""
    info = element(INFO, _uint(TIMESTAMP_SCALE, 1_000_000), element(DURATION, struct.pack(">d", len(payload) / SAMPLES_A_MS)), element(MUXING_APP, b"veridoc"), element(WRITING_APP, b"veridoc"))
    at, clusters, cues = len(info) + len(_TRACKS), [], []
    for c in range(0, len(payload), CLUSTER_SAMPLES):
        part = payload[c : c + CLUSTER_SAMPLES]
        blocks = [_uint(CLUSTER_TIMESTAMP, c // SAMPLES_A_MS)]
        for b in range(0, len(part), FRAME * LACED):
            run = part[b : b + FRAME * LACED]
            blocks.append(_block(1, b // SAMPLES_A_MS, [run[f : f + FRAME] for f in range(0, len(run), FRAME)]))
        clusters.append(element(CLUSTER, *blocks))
        cues.append(element(CUE_POINT, _uint(CUE_TIME, c // SAMPLES_A_MS), element(CUE_TRACK_POSITIONS, _uint(CUE_TRACK, 1), _uint(CUE_CLUSTER_POSITION, at))))
        at += len(clusters[-1])
    return _HEAD + element(SEGMENT, info, _TRACKS, *clusters, element(CUES, *cues))


# -- parsing ----------------------------------------------------------------------------------


@dataclass
class Media:
    #: track, timestamp in ns, number of the frame in its block, first byte, size
    packets: list[tuple[int, int, int, int, int]] = field(default_factory=list)
    tracks: dict[int, str] = field(default_factory=dict)
    #: ns that a frame of the track lasts, where it is stated
    durations: dict[int, int] = field(default_factory=dict)
    #: time in ns, track, byte of the cluster in the file
    cues: list[tuple[int, int, int]] = field(default_factory=list)
    clusters: list[int] = field(default_factory=list)
    scale: int = 1_000_000
    duration_ms: float = 0.0


def _vint(b: bytes, at: int, end: int, keep_marker: bool = False) -> tuple[int, int]:
    if at >= end or not b[at]:
        raise ValueError(f"no variable-length integer at byte {at}")
    w = 9 - b[at].bit_length()
    if at + w > end:
        raise ValueError(f"truncated at byte {at}")
    n = int.from_bytes(b[at : at + w], "big")
    if keep_marker:
        return n, at + w
    n &= (1 << 7 * w) - 1
    return (-1 if n == (1 << 7 * w) - 1 else n), at + w


def _lace(b: bytes, at: int, end: int, flags: int) -> tuple[list[int], int]:
    """Sizes of the frames of a block, and where the first begins."""
    kind = flags & 6
    if not kind:
        return [end - at], at
    n, at = b[at] + 1, at + 1
    if kind == 4:
        if (end - at) % n:
            raise ValueError("fixed-size lacing doesn't divide its block")
        return [(end - at) // n] * n, at
    sizes = []
    for i in range(n - 1):
        if kind == 2:
            size = 0
            while True:
                size, at = size + b[at], at + 1
                if b[at - 1] < 255:
                    break
        elif not i:
            size, at = _vint(b, at, end)
        else:
            w = 9 - b[at].bit_length()
            delta, at = _vint(b, at, end)
            delta = (1 << 7 * w) - 1 if delta < 0 else delta
            size = sizes[-1] + delta - ((1 << 7 * w - 1) - 1)
        sizes.append(size)
    sizes.append(end - at - sum(sizes))
    if min(sizes) < 0:
        raise ValueError("lace sizes exceed their block")
    return sizes, at


def parse(b: bytes) -> Media:
    """The packets, tracks and cues of a file; raises ValueError where it is malformed or truncated."""
    out = Media()
    state = {"cluster": 0, "segment": 0, "track": 0, "cue": [0, 0, 0]}

    def walk(at: int, end: int) -> None:
        while at < end:
            kind, body = _vint(b, at, end, True)
            size, body = _vint(b, body, end)
            stop = end if size < 0 else body + size
            if stop > end:
                raise ValueError(f"element {kind:x} at byte {at} is truncated")
            if kind == SEGMENT:
                state["segment"] = body
            elif kind == CLUSTER:
                out.clusters.append(at)
                if size < 0:  # until the next cluster or the cues
                    stop = _until(body, end)
            if kind in MASTERS:
                if kind == CUE_TRACK_POSITIONS:
                    state["cue"][1:] = [0, 0]
                walk(body, stop)
                if kind == CUE_TRACK_POSITIONS:
                    out.cues.append(tuple(state["cue"]))
            elif kind in (SIMPLE_BLOCK, BLOCK):
                track, p = _vint(b, body, stop)
                if p + 3 > stop:
                    raise ValueError("truncated block")
                relative, flags = struct.unpack_from(">hB", b, p)
                sizes, p = _lace(b, p + 3, stop, flags)
                when = (state["cluster"] + relative) * out.scale
                for i, n in enumerate(sizes):
                    out.packets.append((track, when + i * out.durations.get(track, 0), i, p, n))
                    p += n
            elif kind in (CLUSTER_TIMESTAMP, TIMESTAMP_SCALE, TRACK_NUMBER, DEFAULT_DURATION, CUE_TIME, CUE_TRACK, CUE_CLUSTER_POSITION):
                n = int.from_bytes(b[body:stop], "big")
                if kind == CLUSTER_TIMESTAMP:
                    state["cluster"] = n
                elif kind == TIMESTAMP_SCALE:
                    out.scale = n
                elif kind == TRACK_NUMBER:
                    state["track"] = n
                elif kind == DEFAULT_DURATION:
                    out.durations[state["track"]] = n
                elif kind == CUE_TIME:
                    state["cue"][0] = n * out.scale
                elif kind == CUE_TRACK:
                    state["cue"][1] = n
                else:
                    state["cue"][2] = state["segment"] + n
            elif kind == CODEC_ID:
                out.tracks[state["track"]] = b[body:stop].decode("ascii", "replace")
            elif kind == DURATION:
                out.duration_ms = struct.unpack(">d" if stop - body == 8 else ">f", b[body:stop])[0] * out.scale / 1e6
            at = stop

    def _until(at: int, end: int) -> int:
        while at < end:
            kind, body = _vint(b, at, end, True)
            if kind in (CLUSTER, CUES):
                return at
            size, body = _vint(b, body, end)
            at = body + size
        return end

    kind, body = _vint(b, 0, len(b), True)
    if kind != EBML:
        raise ValueError("no EBML header")
    size, body = _vint(b, body, len(b))
    if size < 0 or body + size > len(b):
        raise ValueError("truncated EBML header")
    walk(body + size, len(b))
    return out


def read_track(b: bytes, media: Media, track: int = 1) -> bytes:
    return b"".join(b[p : p + n] for t, _, _, p, n in media.packets if t == track)


def feature(samples: bytes, media: Media) -> str:
    """Features of the samples read back, as text: packets, clusters, cues, duration, mean, rms, zero crossings, loudest packet."""
    x = np.frombuffer(samples, np.uint8).astype(np.float64) - 128
    loud = max(range(len(media.packets)), key=lambda i: (media.packets[i][4], -i)) if media.packets else -1
    crossings = int(np.count_nonzero((x[1:] >= 0) != (x[:-1] >= 0)))
    return f"packets={len(media.packets)};clusters={len(media.clusters)};cues={len(media.cues)};ms={media.duration_ms:g};mean={x.mean():.4f};rms={np.sqrt((x * x).mean()):.4f};crossings={crossings};longest={loud}"


# -- columns ----------------------------------------------------------------------------------


def _raw(column: pa.Array) -> list[bytes]:
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def to_media(df: DataFrame, column: str = "text", out: str = "media") -> DataFrame:
    """Append the file that holds each text or binary value, padded."""
    return with_columns(df, column, f"`{out}` binary", lambda: lambda values: [pa.array([write(pad(v)) for v in _raw(values)], pa.large_binary())])


def packets(df: DataFrame, column: str = "media") -> DataFrame:
    """Append the packet table of each file: track, timestamp, number in its block, byte range; null for a malformed file."""
    kind = pa.list_(pa.struct([("track", pa.int64()), ("timestamp_ns", pa.int64()), ("lace", pa.int64()), ("first_byte", pa.int64()), ("n_bytes", pa.int64())]))

    def table(b: bytes):
        try:
            return [dict(zip(("track", "timestamp_ns", "lace", "first_byte", "n_bytes"), p)) for p in parse(b).packets]
        except (ValueError, IndexError, struct.error):
            return None

    return with_columns(df, column, "packets array<struct<track:bigint,timestamp_ns:bigint,lace:bigint,first_byte:bigint,n_bytes:bigint>>", lambda: lambda values: [pa.array([table(b) for b in _raw(values)], kind)])


def digest(df: DataFrame, id_col: str = "doc_id", column: str = "text") -> DataFrame:
    """Sizes and digests of each text's payload as read back from its file, and of the file."""

    def one(text: bytes) -> tuple:
        b = write(pad(text))
        media = parse(b)
        back = read_track(b, media)
        return len(text), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-UNIT:]), len(b), hashlib.sha256(b).hexdigest(), feature(back, media)

    def make():
        return lambda texts: [list(x) for x in zip(*map(one, _raw(texts)))]

    return with_columns(df, column, "n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string", make, keep=[id_col])
