"""Token ids as length-delimited binary records with masked checksums, and a separate offset index.

A record is, little-endian::

    u64 length | u32 masked crc of those 8 bytes | payload | u32 masked crc of the payload | 0x0A

and its payload ``u8 flags | i64 id | u16 or u32 per token``. Flag 1: the id is null; flag 2:
tokens take 4 bytes. A masked crc is ``(crc >> 15 | crc << 17) + 0xA282EAD8`` modulo 2**32 of
a CRC-32. The final line feed is what Spark's text writer puts after each row, through which
files reach any store that Spark can write; readers go by lengths, so the other bytes are free.

Files hold ascending ids, and file names ascend with them. The index has a row per record
(file, byte offset, length, tokens), so a shuffled reader can seek.
"""

from __future__ import annotations

import itertools
import json
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veridoc.llm import vec
from veridoc.llm.common import entered, kept, partitions_for, released, shared_folder, small_batches, vocabulary

VOCABULARY = "byte_bpe_50k.json"
NULL_ID, WIDE = 1, 2
#: Characters of a text that ranges are made from; records in a file.
RANGE_CHARS, FILE_RECORDS = 8, 50_000
_HEAD, _CRC, _PAYLOAD = struct.Struct("<Q"), struct.Struct("<I"), struct.Struct("<Bq")


def masked(crc: int) -> int:
    return ((crc >> 15 | crc << 17) + 0xA282EAD8) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    """A record without its final line feed."""
    head = _HEAD.pack(len(payload))
    return b"".join((head, _CRC.pack(masked(zlib.crc32(head))), payload, _CRC.pack(masked(zlib.crc32(payload)))))


def serialize(doc_id: int | None, ids: np.ndarray) -> bytes:
    wide = bool(len(ids)) and int(ids.max()) > 0xFFFF
    return _PAYLOAD.pack(NULL_ID * (doc_id is None) | WIDE * wide, doc_id or 0) + ids.astype("<u4" if wide else "<u2").tobytes()


def deserialize(payload: bytes) -> tuple[int | None, np.ndarray]:
    flags, doc_id = _PAYLOAD.unpack_from(payload)
    return (None if flags & NULL_ID else doc_id), np.frombuffer(payload, "<u4" if flags & WIDE else "<u2", offset=_PAYLOAD.size)


def records(data: bytes):
    """(offset, payload) of every record of a file; raises ValueError at a damaged or truncated one."""
    at, end, view = 0, len(data), memoryview(data)
    while at < end:
        if at + 12 > end:
            raise ValueError(f"truncated length at byte {at}")
        (n,) = _HEAD.unpack_from(data, at)
        if _CRC.unpack_from(data, at + 8)[0] != masked(zlib.crc32(view[at : at + 8])):
            raise ValueError(f"damaged length at byte {at}")
        stop = at + 12 + n
        if stop + 5 > end:
            raise ValueError(f"truncated record at byte {at}")
        payload = bytes(view[at + 12 : stop])
        if _CRC.unpack_from(data, stop)[0] != masked(zlib.crc32(payload)) or data[stop + 4] != 10:
            raise ValueError(f"damaged record at byte {at}")
        yield at, payload
        at = stop + 5


# -- the tokenizer ----------------------------------------------------------------------------


@kept
def tokenizer(path: str):
    """The tokenizer of the file as it is: its added tokens' strings in a text have their ids."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@kept
def added_tokens(path: str) -> tuple[list[bytes], re.Pattern]:
    """The file's added tokens in bytes, and an expression that finds every place where one stands."""
    found = sorted((t.content.encode() for t in tokenizer(path).get_added_tokens_decoder().values()), key=len)
    return found, re.compile(b"(?=(" + b"|".join(map(re.escape, found)) + b"))")


@kept
def without_added(path: str):
    """The same tokenizer without added tokens, for texts that hold none."""
    return type(tokenizer(path)).from_str(json.dumps(json.loads(tokenizer(path).to_str()) | {"added_tokens": []}))


@kept
def piece_cache(path: str) -> vec.PieceCache:
    """Ids of pre-tokenizer matches. Matches are encoded together, a line feed between any two, which is a match of its own there."""
    t = without_added(path)

    def together(texts: list[str]) -> list[list[int]] | None:
        e = t.encode("\n".join(texts), add_special_tokens=False)
        out: list[list[int]] = [[] for _ in range(2 * len(texts) - 1)]
        if e.word_ids and e.word_ids[-1] != len(out) - 1:
            return None
        for i, w in zip(e.ids, e.word_ids):
            out[w].append(i)
        return out[::2]

    def compute(found: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        texts = [p.decode("utf-8") for p in found]
        ids: list = [None] * len(texts)
        plain = [i for i, x in enumerate(texts) if x.strip() and not x[-1].isspace()]
        for k in range(0, len(plain), 1000):
            part = plain[k : k + 1000]
            for i, got in zip(part, together([texts[i] for i in part]) or ()):
                ids[i] = got
        rest = [i for i, x in enumerate(ids) if x is None]
        for i, e in zip(rest, t.encode_batch([texts[i] for i in rest], add_special_tokens=False)):
            ids[i] = e.ids
        return np.fromiter(itertools.chain.from_iterable(ids), np.uint32), np.fromiter(map(len, ids), np.int64, len(ids))

    return vec.PieceCache(compute, np.uint32)


def token_ids(buf: np.ndarray, off: np.ndarray, path: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts end to end and where each text's begin, as encoding each whole text gives."""
    start, end, text_of = vec.pieces(buf, off)
    held = piece_cache(path)
    slots = held.slots(buf, start, end)
    ids, at = held.gather(slots), vec.offsets_by_text(text_of, held.lengths(slots), len(off) - 1)
    (added, expression), raw = added_tokens(path), buf.tobytes()
    if not any(x in raw for x in added):
        return ids, at
    places = np.array([(m.start(), m.end(1)) for m in expression.finditer(raw)], np.int64).reshape(-1, 2)
    holds = np.searchsorted(off, places[:, 0], "right") - 1
    holds = np.unique(holds[places[:, 1] <= off[holds + 1]]).tolist()
    if not holds:
        return ids, at
    parts = np.split(ids, at[1:-1])  # texts that hold an added token are encoded whole
    for i in holds:
        parts[i] = np.array(tokenizer(path).encode(raw[off[i] : off[i + 1]].decode("utf-8"), add_special_tokens=False).ids, ids.dtype)
    return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(x) for x in parts])])


# -- writing and reading ----------------------------------------------------------------------


def write_records(df: DataFrame, folder: str, id_col: str = "doc_id", column: str = "text", end_id: int = 0, path: str | None = None) -> None:
    """Encode whole texts, append the end id, and write records in ascending id order, nulls first, equal ids by text.

    One range shuffle of the texts; the ids are made after it and go straight to their files.
    Ranges are made from ids and the first characters of texts, of which Spark samples a
    bounded number of rows in all: so rows of one id, or none, spread over files too. A
    file holds a bounded number of records.
    """
    docs = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{column}`").cast("string").alias("text"))
    ordered = docs.repartitionByRange(partitions_for(docs), F.col("id"), F.substring("text", 1, RANGE_CHARS)).sortWithinPartitions("id", "text")

    def run(batches):
        entered("records")
        where = path or vocabulary(VOCABULARY)
        for b in vec.slices(batches):
            ids, off = token_ids(*vec.flat(b.column("text")), where)
            end = np.array([end_id], np.uint32)
            out = [frame(serialize(i, np.concatenate([ids[s:e], end]))) for i, s, e in zip(b.column("id").to_pylist(), off[:-1].tolist(), off[1:].tolist())]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["frame"])
        released()

    with small_batches(df.sparkSession):
        ordered.mapInArrow(run, "frame binary").select(F.col("frame").cast("string").alias("value")).write.option("lineSep", "\n").option("compression", "none").option("maxRecordsPerFile", FILE_RECORDS).text(folder)


def build_index(spark, folder: str, index: str) -> None:
    """Read the files back, check every checksum, and write the index: a row per record. A file is read by one task."""
    fields = "file string, offset bigint, length bigint, doc_id bigint, start_in_file bigint, n_tokens bigint, ids_crc32 bigint"
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder).select("path", "content")

    def run(batches):
        for b in batches:
            for name, data in zip(b.column("path").to_pylist(), b.column("content")):
                at, rows = 0, []
                for offset, payload in records(data.as_buffer().to_pybytes()):
                    doc_id, ids = deserialize(payload)
                    rows.append((name.rsplit("/", 1)[-1], offset, len(payload), doc_id, at, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    at += len(ids)
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if i == 0 else pa.int64()) for i, c in enumerate(zip(*rows))], names=[f.split()[0] for f in fields.split(", ")])

    files.mapInArrow(run, fields).write.parquet(index)


def _number(pattern: str):
    """A number in a file's name, as a number: names of five and of six digits don't sort as text."""
    return F.regexp_extract("file", pattern, 1).cast("long")


def with_starts(index: DataFrame) -> DataFrame:
    """Each record's start in the sequence of all ids: the sum of the files before, a row per file, plus its start in the file."""
    order = Window.orderBy(_number(r"part-(\d+)"), _number(r"-c(\d+)[.]"), "file").rowsBetween(Window.unboundedPreceding, -1)
    totals = index.groupBy("file").agg(F.sum("n_tokens").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(order), F.lit(0)))
    return index.join(totals.select("file", "before"), "file").withColumn("start", F.col("before") + F.col("start_in_file")).drop("before", "start_in_file")


def roundtrip(df: DataFrame, id_col: str = "doc_id", column: str = "text", end_id: int = 0, path: str | None = None) -> DataFrame:
    """Write the records and their index to the shared folder, and return per record what was read back.

    Empty and null texts are records of the end id alone; repeated ids are records of their
    own; an empty table gives no records. Other columns of the input play no part, whatever their names.
    """
    spark = df.sparkSession
    folder = shared_folder(spark, "records")
    write_records(df, f"{folder}/data", id_col, column, end_id, path)
    build_index(spark, f"{folder}/data", f"{folder}/index")
    index = spark.read.schema("file string, offset bigint, length bigint, doc_id bigint, start_in_file bigint, n_tokens bigint, ids_crc32 bigint").parquet(f"{folder}/index")
    return with_starts(index).select("doc_id", "start", "n_tokens", "ids_crc32", "file", "offset", "length")
