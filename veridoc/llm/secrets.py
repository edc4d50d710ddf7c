"""Secret scans: keyword prefilter, anchored expressions near hits, embedded checksums.

One Aho-Corasick pass over the lower-cased bytes finds where a credential can begin; only
there an anchored expression is tried. Runs of hex digits have no keyword; they are found by
mapping bytes to two classes and searching for the shortest reportable run. Tokens that
carry a checksum are reported only if it holds.

A secret is spanned whole, whatever its length. Every text is scanned whole, in one pass without a shuffle. Null is an empty text; an empty
text has no spans; equal texts have equal spans; columns named like the results are replaced.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import json
import re
import zlib
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from veridoc.llm.common import fresh, with_columns

#: In the order in which kinds at one start are listed.
KINDS = ("assign", "access", "hex", "github", "npm", "private_key", "jwt", "slack", "google", "stripe")

MIN_VALUE, MIN_ACCESS, MIN_HEX = 6, 20, 24

_ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I)
_ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
_GITHUB = re.compile(rb"gh[pousr]_([A-Za-z0-9]{36})(?![A-Za-z0-9])")
_NPM = re.compile(rb"npm_([A-Za-z0-9]{36})(?![A-Za-z0-9])")
_PEM_BEGIN = re.compile(rb"-----BEGIN ((?:[A-Z]+ )*PRIVATE KEY)-----")
_PEM_END = re.compile(rb"-----END ((?:[A-Z]+ )*PRIVATE KEY)(?=-----)")
_NO_PEM = re.compile(rb"[^A-Za-z0-9+/=\s:,.-]")
_URL_RUN = re.compile(rb"[A-Za-z0-9_-]*")
_SLACK = re.compile(rb"xox[abprs]-[0-9A-Za-z-]{20,}")
_GOOGLE = re.compile(rb"AIza[0-9A-Za-z_-]{35}(?![0-9A-Za-z_-])")
_STRIPE = re.compile(rb"[sr]k_live_[0-9A-Za-z]{24,}")

_KEYWORDS = {
    "assign": ("password", "passwd", "secret", "token", "apikey", "api_key"),
    "access": ("akia",),
    "github": ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"),
    "npm": ("npm_",),
    "private_key": ("-----begin ",),
    "jwt": ("eyj",),
    "slack": ("xoxa-", "xoxb-", "xoxp-", "xoxr-", "xoxs-"),
    "google": ("aiza",),
    "stripe": ("sk_live_", "rk_live_"),
}
_BASE62 = b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
_HEX = bytes(120 if i in b"0123456789abcdef" else 46 for i in range(256))
_RUN = b"x" * MIN_HEX


def base62_crc32(body: bytes) -> bytes:
    """The checksum that such tokens end with: CRC-32 in six base-62 digits."""
    n, out = zlib.crc32(body), b""
    for _ in range(6):
        n, d = divmod(n, 62)
        out = _BASE62[d : d + 1] + out
    return out


def _checked(m: re.Match) -> bool:
    return base62_crc32(m[1][:30]) == m[1][30:]


def _jwt_header(head: bytes) -> bool:
    try:
        return "alg" in json.loads(base64.urlsafe_b64decode(head + b"=" * (-len(head) % 4)))
    except (ValueError, TypeError, RecursionError):
        return False


def _private_keys(text: bytes):
    """(end, verdict) of the key that begins at a place, for ascending places. Ends are listed once, so a text costs time in its length however many begin."""
    ends: dict[bytes, list[int]] = {}
    for m in _PEM_END.finditer(text):
        ends.setdefault(m[1], []).append(m.start())
    bad = -1

    def at(s: int) -> tuple[int, bool] | None:
        nonlocal bad
        m = _PEM_BEGIN.match(text, s)
        found = ends.get(m[1]) if m else None
        if not found or (k := bisect.bisect_left(found, m.end())) == len(found):
            return None
        if bad < m.end():
            bad = other.start() if (other := _NO_PEM.search(text, m.end())) else len(text)
        return (found[k] + len(m[1]) + 14, True) if found[k] <= bad else None

    return at


def _jwts(text: bytes):
    """The same for three dotted runs: a run's end, and what follows it, are looked up once."""
    end, tail = -1, None

    def at(s: int) -> tuple[int, bool] | None:
        nonlocal end, tail
        if text[s : s + 3] != b"eyJ":
            return None
        if s >= end:
            end, tail = _URL_RUN.match(text, s).end(), None
            if text[end : end + 4] == b".eyJ":
                second = _URL_RUN.match(text, end + 1).end()
                if second - end >= 9 and text[second : second + 1] == b".":
                    third = _URL_RUN.match(text, second + 1).end()
                    tail = third if third - second >= 17 else None
        return (tail, _jwt_header(text[s:end])) if tail and end - s >= 8 else None

    return at


def _anchored(expression: re.Pattern, holds):
    def of(text: bytes):
        def at(s: int) -> tuple[int, bool] | None:
            m = expression.match(text, s)
            return (m.end(), holds(m)) if m else None

        return at

    return of


#: kind: what gives, for a text, the function from a place to the end and the verdict of a match that begins there
_RULES = {
    "assign": _anchored(_ASSIGN, lambda m: len(m[2]) >= MIN_VALUE),
    "access": _anchored(_ACCESS, lambda m: len(m[0]) >= MIN_ACCESS),
    "github": _anchored(_GITHUB, _checked),
    "npm": _anchored(_NPM, _checked),
    "private_key": _private_keys,
    "jwt": _jwts,
    "slack": _anchored(_SLACK, lambda m: True),
    "google": _anchored(_GOOGLE, lambda m: True),
    "stripe": _anchored(_STRIPE, lambda m: True),
}


@cache
def _automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    for kind, words in _KEYWORDS.items():
        for w in words:
            a.add_word(w, (kind, len(w)))
    a.make_automaton()
    return a


def byte_spans(text: bytes) -> list[tuple[int, int, int]]:
    """(start, index of kind, end) in bytes, sorted. Matches of a kind don't overlap: each begins at or after the end of the one before, reported or not."""
    starts: dict[str, list[int]] = {}
    for end, (kind, n) in _automaton().iter(text.lower().decode("latin-1")):
        starts.setdefault(kind, []).append(end - n + 1)
    out = []
    for kind, found in starts.items():
        k, free, at = KINDS.index(kind), 0, _RULES[kind](text)
        for s in sorted(found):
            if s >= free and (m := at(s)):
                free, holds = m
                if holds:
                    out.append((s, k, free))
    runs = text.translate(_HEX)
    k, s = KINDS.index("hex"), runs.find(_RUN)
    while s >= 0:
        e = s + MIN_HEX
        while e < len(runs) and runs[e] == 120:
            e += 1
        out.append((s, k, e))
        s = runs.find(_RUN, e)
    return sorted(out)


def spans(text: bytes) -> list[tuple[int, int, int]]:
    """The same in code points."""
    found = byte_spans(text)
    if found and not text.isascii():
        lead = np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)
        place = lambda i: int(lead[i - 1]) if i else 0
        found = [(place(s), k, place(e)) for s, k, e in found]
    return found


def said(found: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in found)


def _texts(column: pa.Array) -> list[bytes]:
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def find_secrets(df: DataFrame, column: str = "text") -> DataFrame:
    """Append ``secrets array<struct<kind,start,end>>`` in code points, end exclusive."""

    def make():
        def fn(texts):
            rows = [[{"kind": KINDS[k], "start": s, "end": e} for s, k, e in spans(t)] for t in _texts(texts)]
            return [pa.array(rows, pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])))]

        return fn

    return with_columns(df, column, "secrets array<struct<kind:string,start:bigint,end:bigint>>", make)


def redact(text: bytes) -> bytes:
    """The text with the union of its spans replaced, each stretch by the first span's kind in brackets."""
    out, at, done = [], 0, 0
    for s, k, e in byte_spans(text):
        if s >= done:
            out += [text[at:s], b"[" + KINDS[k].encode() + b"]"]
        done = max(done, e)
        at = done
    return b"".join([*out, text[at:]])


def redact_secrets(df: DataFrame, column: str = "text") -> DataFrame:
    """The same rows and columns with secrets in that column replaced; null stays null."""
    columns = df.columns

    def make():
        def fn(texts):
            raw = texts.cast(pa.large_binary()).to_pylist()
            return [pa.array([None if t is None else redact(t).decode() for t in raw], pa.large_string())]

        return fn

    (name,) = fresh(df, "redacted")
    out = with_columns(df, column, f"`{name}` string", make)
    return out.withColumn(column, out[name]).select(*(f"`{c}`" for c in columns))


def digest(df: DataFrame, id_col: str = "doc_id", column: str = "text") -> DataFrame:
    """Counts, digest of the base spans and all spans of each text."""

    def make():
        def fn(texts):
            rows = [spans(t) for t in _texts(texts)]
            base = [[x for x in r if x[1] < 3] for r in rows]
            return [
                *([sum(x[1] == k for x in r) for r in base] for k in range(3)),
                [hashlib.sha256(said(r).encode()).hexdigest() for r in base],
                [said(r) for r in rows],
            ]

        return fn

    return with_columns(df, column, "n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string", make, keep=[id_col])
