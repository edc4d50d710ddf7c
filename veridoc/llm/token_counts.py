"""Offset-mapped token counts of sections and fields.

Whole texts are encoded once. The tokens' spans are joined to the sections' intervals, and a
token that touches several sections goes to one of them by a stated rule: ``largest`` (most
bytes, the earlier one of equals) or ``first`` (where it begins). So the counts of sections
add up to the count of the text, which encoding sections apart would not give.

Sections are the lines of a text, each with its line end, or the fields of a row, joined by
one line feed that belongs to the field before. An empty or null text has no tokens and one
section; equal texts have equal counts. An empty table gives no rows; a column of the input
named like a result, in any case, is replaced, the others stay. One pass, no shuffle.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veridoc.llm import vec
from veridoc.llm.common import bpe_cache, fresh, token_lengths, vocabulary, with_columns

VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def token_spans(buf: np.ndarray, off: np.ndarray, path: str) -> tuple[np.ndarray, np.ndarray]:
    """Byte ends of the tokens of all texts, one after another, and where each text's tokens begin."""
    start, end, text_of = vec.pieces(buf, off)
    held = bpe_cache(path)
    slots = held.slots(buf, start, end) if len(start) else np.zeros(0, np.int64)
    ids = held.gather(slots)
    return np.cumsum(token_lengths(path)[ids]), vec.offsets_by_text(text_of, held.lengths(slots), len(off) - 1)


def allocate(ends: np.ndarray, section_starts: np.ndarray, n_bytes: int, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """The section of each token, and whether it crosses a boundary. Sections are intervals that begin at those bytes, ascending, none empty."""
    starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
    first = np.searchsorted(section_starts, starts, "right") - 1
    last = np.searchsorted(section_starts, ends - 1, "right") - 1
    crossing = last > first
    if rule == "largest" and crossing.any():
        t = np.flatnonzero(crossing)
        n = last[t] - first[t] + 1
        ends_of = np.append(section_starts[1:], n_bytes)
        row = np.repeat(np.arange(len(t)), n)
        section = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[t], n)
        overlap = np.minimum(ends[t][row], ends_of[section]) - np.maximum(starts[t][row], section_starts[section])
        order = np.lexsort((section, -overlap, row))
        first = first.copy()
        first[t] = section[order][np.cumsum(n) - n]
    elif rule not in ("largest", "first"):
        raise ValueError(f"unknown rule {rule}")
    return first, crossing


def count_sections(buf: np.ndarray, off: np.ndarray, path: str, rule: str, section_ends: np.ndarray | None = None):
    """Per text: tokens, crossing tokens; and per section of all texts: first code point, end, tokens; with the sections' offsets by text.

    ``section_ends``: byte ends of the sections of each text but the last; line ends if not given.
    """
    n = len(off) - 1
    inner = np.flatnonzero(buf == 10) + 1 if section_ends is None else section_ends
    bounds = np.unique(np.concatenate([off[:-1], inner])) if n else off[:-1]
    bounds = bounds[bounds < len(buf)]
    ends, token_off = token_spans(buf, off, path)
    section, crossing = allocate(ends, bounds, len(buf), rule)
    tokens = np.bincount(section, minlength=len(bounds))
    text_of_token = np.repeat(np.arange(n), np.diff(token_off))
    n_crossing = np.bincount(text_of_token[crossing], minlength=n)
    lead = np.concatenate([[0], np.cumsum(vec.is_lead(buf))])
    text_of = np.searchsorted(off, bounds, "right") - 1
    edge = np.append(bounds[1:], len(buf))
    base = lead[off[text_of]]
    section_off = np.zeros(n + 1, np.int64)
    np.cumsum(np.bincount(text_of, minlength=n), out=section_off[1:])
    return np.diff(token_off), n_crossing, lead[bounds] - base, lead[edge] - base, tokens, section_off


_FIELDS = "n_tokens bigint, n_sections bigint, n_crossing bigint, section_ends array<bigint>, section_tokens array<bigint>"


def attribute_tokens(df: DataFrame, column: str = "text", rule: str = "largest", path: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """Append the tokens of each line: ``section_ends`` (code points, end exclusive) and ``section_tokens``, in order."""

    def make():
        where = path or vocabulary(VOCABULARY)

        def fn(texts):
            buf, off = vec.flat(texts)
            n_tokens, n_crossing, _, end, tokens, by_text = count_sections(buf, off, where, rule)
            n = np.diff(by_text)
            lists = [pa.ListArray.from_arrays(pa.array(by_text, pa.int32()), pa.array(x, pa.int64())) for x in (end, tokens)]
            return [n_tokens, np.maximum(n, 1), n_crossing, *lists]

        return fn

    return with_columns(df, column, _FIELDS, make, keep)


def attribute_fields(df: DataFrame, fields: list[str], rule: str = "largest", path: str | None = None) -> DataFrame:
    """Append ``field_tokens map<string,bigint>``: the tokens of each field when the row is encoded as its fields joined by line feeds. Null is empty."""
    parts = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in fields]
    sizes = F.concat_ws(",", *(F.octet_length(p).cast("string") for p in parts))
    (name,) = fresh(df, "packed")
    packed = df.withColumn(name, F.concat(sizes, F.lit("\u0000"), F.concat_ws("\n", *parts)))

    def make():
        where = path or vocabulary(VOCABULARY)

        def fn(values):
            raw = [x.partition(b"\0") for x in values.cast(pa.large_binary()).to_pylist()]
            sizes = np.array([[int(n) for n in head.split(b",")] for head, _, _ in raw], np.int64).reshape(len(raw), len(fields))
            buf, off = vec.flat(pa.array([x for _, _, x in raw], pa.large_binary()))
            ends = off[:-1, None] + np.cumsum(sizes + 1, axis=1)
            inner = ends[:, :-1].ravel()
            _, _, _, _, tokens, by_text = count_sections(buf, off, where, rule, inner)
            # a last empty field has no interval of its own
            rows = []
            for i in range(len(raw)):
                got = tokens[by_text[i] : by_text[i + 1]].tolist()
                rows.append(list(zip(fields, got + [0] * (len(fields) - len(got)))))
            return [pa.array(rows, pa.map_(pa.string(), pa.int64()))]

        return fn

    return with_columns(packed, name, "field_tokens map<string,bigint>", make, keep=df.columns)
