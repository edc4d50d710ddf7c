"""Quality rules: base counts of words and repeats, and tokeniser fertility in bands per language.

Public vocabularies measure each text: code points per byte-level BPE token, share of byte
fallbacks among the pieces of a vocabulary that has them, and entropy of the text's tokens in
bits. A text outside the bands of its language is rejected; a language without bands, or none, has
those of the script that most of its letters are in. The entropy of n tokens is at most
log2(n) bits, so the bound on it is lower for short texts.

Words are maximal runs of bytes other than 20 and 09-0D. Null is an empty text: no words, all
counts 0, base failed. Equal texts have equal counts whatever the language column holds. One
pass without a shuffle. Lines and words that count as equal are equal, byte by byte. An empty table gives no rows; a
column of the input named like a result is replaced, other columns stay.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veridoc.llm import vec
from veridoc.llm.common import bpe_cache, fresh, kept, vocabulary, with_columns

VOCABULARY, FALLBACK_VOCABULARY = "byte_bpe_multi_50k.tiktoken", "piece_bpe_32k.model"
MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 50, 50, 3
#: No text needs more than this part of the entropy of as many different tokens: below 135 tokens that is less than 5.3 bits.
MAX_ENTROPY_SHARE = 0.75


@dataclass(frozen=True)
class Band:
    """A text is kept within these bounds, ends included; that of entropy is for texts of many tokens (see MAX_ENTROPY_SHARE)."""

    min_chars_per_token: float
    max_chars_per_token: float
    max_fallback_share: float
    min_entropy: float


#: The least characters per token lie some 8 % below the least of all texts labelled good of the language (2.33 for en, 2.52
#: for de, 2.30 for es, 2.12 for fr among 3243 such texts of the given tables), the entropy 0.25 bits below theirs (5.55).
#: Symbol runs, shouting and loops fall outside.
BANDS = {"en": Band(2.15, 8.0, 0.15, 5.3), "de": Band(2.3, 8.0, 0.15, 5.3), "es": Band(2.08, 8.0, 0.15, 5.3), "fr": Band(1.95, 8.0, 0.15, 5.3)}
#: About half and three times the characters per token that articles of the Universal Declaration of Human Rights have in the
#: script, and an entropy a bit below (characters per token there: Latin 2.95, Cyrillic 3.24, Greek 1.94, Hebrew 1.78, Arabic 1.81,
#: Indic 0.96, Thai 1.05, Hangul 1.30, Han 0.85 and with kana 1.05).
SCRIPTS = {
    "Latin": Band(1.5, 9.0, 0.15, 4.8),
    "Greek": Band(1.0, 6.0, 0.15, 4.8),
    "Cyrillic": Band(1.6, 9.0, 0.15, 4.8),
    "Hebrew": Band(0.9, 6.0, 0.15, 4.6),
    "Arabic": Band(0.9, 6.0, 0.15, 4.6),
    "Indic": Band(0.5, 4.0, 0.4, 3.5),
    "Thai": Band(0.5, 4.0, 0.4, 3.8),
    "Hangul": Band(0.6, 4.0, 0.4, 4.4),
    "Han": Band(0.4, 3.5, 0.5, 4.4),
}
#: First and last code points of the scripts' letters.
SCRIPT_RANGES = {
    "Latin": [(0x41, 0x5A), (0x61, 0x7A), (0xC0, 0x24F), (0x1E00, 0x1EFF)],
    "Greek": [(0x370, 0x3FF), (0x1F00, 0x1FFF)],
    "Cyrillic": [(0x400, 0x52F)],
    "Hebrew": [(0x590, 0x5FF)],
    "Arabic": [(0x600, 0x6FF), (0x750, 0x77F), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF)],
    "Indic": [(0x900, 0xDFF)],
    "Thai": [(0xE00, 0xEFF)],
    "Hangul": [(0x1100, 0x11FF), (0x3130, 0x318F), (0xAC00, 0xD7AF)],
    "Han": [(0x3040, 0x30FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0x20000, 0x323AF)],
}
#: For texts of any other script.
OTHER = Band(0.4, 16.0, 0.9, 3.0)

_FIELDS = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, n_tokens bigint, chars_per_token double, fallback_share double, token_entropy double, script string"


@kept
def _fallback_cache(path: str) -> vec.PieceCache:
    """Pieces of a word, and how many of them are byte fallbacks."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    is_byte = np.array([sp.is_byte(i) for i in range(sp.get_piece_size())])

    def compute(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        ids = sp.encode([w.decode("utf-8") for w in words], num_threads=1)
        n = np.fromiter(map(len, ids), np.int64, len(ids))
        of = np.repeat(np.arange(len(ids)), n)
        byte = np.bincount(of, weights=is_byte[np.fromiter((i for x in ids for i in x), np.int64, n.sum())], minlength=len(ids))
        return np.stack([n, byte.astype(np.int64)], axis=1).ravel(), np.full(len(ids), 2)

    return vec.PieceCache(compute, np.int32)


def _times(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How often each tuple of keys is found, and whether it is the first time."""
    order = np.lexsort(keys)
    new = np.zeros(len(order), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[order][1:] != k[order][:-1]
    group = np.cumsum(new) - 1
    n, first = np.empty(len(order), np.int64), np.zeros(len(order), bool)
    n[order] = np.bincount(group)[group] if len(order) else 0
    first[order[new]] = True  # lexsort is stable
    return n, first


def repeats(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, ...]:
    """Per text: words, code points in them, symbols, lines equal to an earlier one, words in windows found twice or more."""
    n = len(off) - 1
    start, end, text_of = vec.words(buf, off)
    n_words = np.bincount(text_of, minlength=n)
    if not len(start):
        zero = np.zeros(n, np.int64)
        return n_words, zero, vec.counts_between(vec._SYMBOL[buf], off[:-1], off[1:]), zero, zero
    chars = vec.per_text(text_of, vec.counts_between(vec.is_lead(buf), start, end), n)
    symbols = vec.counts_between(vec._SYMBOL[buf], off[:-1], off[1:])
    # lines: from a text's begin or after a line feed, up to the next
    feeds = np.flatnonzero(buf == 10)
    line_start = np.unique(np.concatenate([off[:-1], feeds + 1]))
    line_start = line_start[line_start < len(buf)]
    line_end = np.append(line_start[1:], len(buf))
    line_end -= buf[line_end - 1] == 10
    holds = np.searchsorted(start, line_start) < np.searchsorted(start, line_end)
    line_start, line_end = line_start[holds], line_end[holds]
    line_text = np.searchsorted(off, line_start, "right") - 1
    _, first = _times(vec.distinct(buf, line_start, line_end)[2], line_text)
    dup_lines = np.bincount(line_text[~first], minlength=n)
    repeated = np.zeros(len(start), bool)
    if len(start) >= WINDOW:
        word = vec.distinct(buf, start, end)[2].astype(np.uint64)
        m = len(start) - WINDOW + 1
        inside = np.flatnonzero(text_of[:m] == text_of[WINDOW - 1 :])
        pair = np.unique(word[inside] << np.uint64(32) | word[inside + 1], return_inverse=True)[1]
        triple = np.unique(pair.astype(np.uint64) << np.uint64(32) | word[inside + 2], return_inverse=True)[1]
        often = inside[_times(triple, text_of[inside])[0] > 1]
        for k in range(WINDOW):
            repeated[often + k] = True
    return n_words, chars, symbols, dup_lines, np.bincount(text_of[repeated], minlength=n)


@cache
def _script_of() -> np.ndarray:
    """The number of each code point's script, from 1; 0 is none of them."""
    out = np.zeros(0x110000, np.uint8)
    for i, ranges in enumerate(SCRIPT_RANGES.values()):
        for first, last in ranges:
            out[first : last + 1] = i + 1
    return out


def scripts(buf: np.ndarray, off: np.ndarray) -> list[str]:
    """The script that most letters of each text are in, the first of equals; ``other`` without any."""
    n, k = len(off) - 1, len(SCRIPT_RANGES) + 1
    cp = np.frombuffer(buf.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    per_text = vec.counts_between(vec.is_lead(buf), off[:-1], off[1:])
    count = np.bincount(np.repeat(np.arange(n) * k, per_text) + _script_of()[cp], minlength=n * k).reshape(n, k)[:, 1:]
    names = list(SCRIPT_RANGES)
    return [names[i] if any_ else "other" for i, any_ in zip(count.argmax(axis=1).tolist(), count.any(axis=1).tolist())]


def fertility(buf: np.ndarray, off: np.ndarray, path: str, fallback_path: str) -> tuple[np.ndarray, ...]:
    """Per text: tokens, code points per token, byte-fallback share, entropy in bits; 0 where there are no tokens."""
    n = len(off) - 1
    start, end, text_of = vec.pieces(buf, off)
    held = bpe_cache(path)
    slots = held.slots(buf, start, end)
    sizes = held.lengths(slots)
    tokens = np.bincount(text_of, weights=sizes, minlength=n)
    some = np.maximum(tokens, 1)
    key = (np.repeat(text_of, sizes) << 32) + held.gather(slots).astype(np.int64)
    found, c = np.unique(key, return_counts=True)
    entropy = np.log2(some) - np.bincount(found >> 32, weights=c * np.log2(c), minlength=n) / some
    per_token = vec.counts_between(vec.is_lead(buf), off[:-1], off[1:]) / some
    ws, we, wt = vec.words(buf, off)
    words = _fallback_cache(fallback_path)
    got = words.gather(words.slots(buf, ws, we)).reshape(-1, 2)
    pieces = np.bincount(wt, weights=got[:, 0], minlength=n)
    share = np.bincount(wt, weights=got[:, 1], minlength=n) / np.maximum(pieces, 1)
    return tokens.astype(np.int64), per_token, share, np.where(tokens > 0, np.abs(entropy), 0.0)


def measure(df: DataFrame, column: str = "text", keep: list[str] | None = None, path: str | None = None, fallback_path: str | None = None) -> DataFrame:
    """Append base counts and fertility of each text."""

    def make():
        p, f = path or vocabulary(VOCABULARY), fallback_path or vocabulary(FALLBACK_VOCABULARY)

        def fn(texts):
            buf, off = vec.flat(texts)
            return [*repeats(buf, off), *fertility(buf, off, p, f), scripts(buf, off)]

        return fn

    return with_columns(df, column, _FIELDS, make, keep)


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def in_band(language: Column, script: Column, bands: dict[str, Band] = BANDS, by_script: dict[str, Band] = SCRIPTS, other: Band = OTHER) -> Column:
    """The method's verdict, by the language's bands if it has any, else by the script's, else by the others'."""

    reachable = F.lit(MAX_ENTROPY_SHARE) * F.log2(F.greatest(F.col("n_tokens"), F.lit(1)))

    def within(b: Band) -> Column:
        return F.col("chars_per_token").between(b.min_chars_per_token, b.max_chars_per_token) & (F.col("fallback_share") <= b.max_fallback_share) & (F.col("token_entropy") >= F.least(F.lit(b.min_entropy), reachable))

    out = F.when(F.lit(False), F.lit(False))
    for key, some in ((language, bands), (script, by_script)):
        for name, b in some.items():
            out = out.when(key == name, within(b))
    return out.otherwise(within(other))


def assess(df: DataFrame, column: str = "text", language: str = "lang", keep: list[str] | None = None, bands: dict[str, Band] = BANDS) -> DataFrame:
    """Append the measures, ``base_failed`` and ``kept``; columns of these names are replaced."""
    (name,) = fresh(df, "language")
    lang = F.col(f"`{language}`").cast("string") if language in df.columns else F.lit(None).cast("string")
    out = measure(df.withColumn(name, lang), column, None if keep is None else [*keep, name])
    return out.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & in_band(F.col(name), F.col("script"), bands)).drop(name)


def filter_quality(df: DataFrame, column: str = "text", language: str = "lang") -> DataFrame:
    """The rows that are kept, with the input's columns."""
    columns = df.columns
    renamed = df.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(columns)))
    lang = f"c{columns.index(language)}" if language in columns else "none"
    out = assess(renamed, f"c{columns.index(column)}", lang).filter("kept")
    return out.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(columns)))
