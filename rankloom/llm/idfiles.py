"""Token-id files: frequency-ranked ids in byte-aligned codes with separate control bytes.

A file is a run of self-contained segments of at most ``SEGMENT`` ids. Each
segment ranks the ids of all its documents by frequency (ties: smaller id), so
the commonest 256 take one byte. Ranks and document lengths are coded in one to
four bytes; their byte counts stand apart, four two-bit fields to a control
byte, and decoding looks control bytes up in a numpy table. Layout of a segment:

    magic b"RLID1\\0", doc count u32, id count u64, distinct u32,
    doc ids i64[docs], null flags u8[docs], lengths (coded), ranked ids u32[distinct], ranks (coded)

where a coded sequence is data size u64, control bytes, data bytes.

Documents are dealt by ranges of doc_id and sorted, so files and the documents in
them ascend; equal doc_ids are ordered by text, null ones come first. Each task
writes a file of its own name, only files named in the committed manifest are
read, so a task that runs twice does no harm. Empty and null texts hold the end
id alone; an empty table gives no rows; texts of any length are encoded whole;
repeated rows are written as often as they occur. Only doc_id and text are read,
so extra columns of any name do no harm.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankloom.llm import chunked
from rankloom.llm.stores import create_file, open_file
from rankloom.llm.work import id_text, new_path, table

MAGIC = b"RLID1\0"
HEAD = struct.Struct("<IQI")
SEGMENT = 2_000_000  # ids, about 8 MB while a segment is built
WIDTHS = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3) + 1  # control byte -> four byte counts


def code(values: np.ndarray) -> bytes:
    """One to four bytes a value, little-endian; their counts in control bytes of their own."""
    v = values.astype("<u4")
    extra = (v >= 1 << 8).astype(np.uint8) + (v >= 1 << 16) + (v >= 1 << 24)
    data = v.view(np.uint8).reshape(-1, 4)[np.arange(4) <= extra[:, None]].tobytes()
    fields = np.zeros(-(-len(v) // 4) * 4, dtype=np.uint8)
    fields[: len(v)] = extra
    control = (fields.reshape(-1, 4) << np.array([0, 2, 4, 6], dtype=np.uint8)).sum(axis=1).astype(np.uint8)
    return struct.pack("<Q", len(data)) + control.tobytes() + data


def decode(read, n: int) -> np.ndarray:
    """``n`` values from ``read(size)``, the inverse of :func:`code`."""
    (size,) = struct.unpack("<Q", read(8))
    control = np.frombuffer(read(-(-n // 4)), dtype=np.uint8)
    data = np.frombuffer(read(size), dtype=np.uint8)
    width = WIDTHS[control].reshape(-1)[:n]
    start = np.cumsum(width) - width
    out = np.zeros(n, dtype=np.uint32)
    for k in range(4):
        has = width > k
        out[has] |= data[start[has] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def segment(doc_ids: list, docs: list[bytes]) -> bytes:
    ids = np.frombuffer(b"".join(docs), dtype="<u4")
    counts = np.bincount(ids) if len(ids) else np.zeros(0, dtype=np.int64)
    by_rank = np.argsort(-counts, kind="stable")[: np.count_nonzero(counts)]
    rank = np.zeros(len(counts), dtype=np.uint32)
    rank[by_rank] = np.arange(len(by_rank))
    lengths = np.array([len(d) // 4 for d in docs], dtype=np.uint32)
    nulls = np.array([d is None for d in doc_ids], dtype=np.uint8)
    keys = np.array([d or 0 for d in doc_ids], dtype="<i8")
    return MAGIC + HEAD.pack(len(docs), len(ids), len(by_rank)) + keys.tobytes() + nulls.tobytes() + code(lengths) + by_rank.astype("<u4").tobytes() + code(rank[ids])


def segments(source) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
    """(doc ids, lengths, ids) of each segment of an open file, one at a time."""

    def read(n: int) -> bytes:
        got = source.read(n)
        if len(got) != n:
            raise EOFError("the id file ends inside a segment")
        return bytes(got)

    while magic := bytes(source.read(len(MAGIC))):
        if magic != MAGIC:
            raise ValueError("not an id file")
        docs, n, distinct = HEAD.unpack(read(HEAD.size))
        keys = np.frombuffer(read(8 * docs), dtype="<i8").tolist()
        nulls = np.frombuffer(read(docs), dtype=np.uint8).tolist()
        lengths = decode(read, docs)
        by_rank = np.frombuffer(read(4 * distinct), dtype="<u4")
        ranks = decode(read, n)
        yield [None if z else k for k, z in zip(keys, nulls)], lengths, by_rank[ranks]


def write_files(df: DataFrame, tokenizer_path: str, end_id: int) -> DataFrame:
    """Encode every text and write the id files; the manifest (part, path, n_docs, n_ids) is committed as a table."""
    folder = new_path(df.sparkSession, "ids")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = chunked.encoder(tokenizer_path)
        end = struct.pack("<I", end_id)
        part = TaskContext.get().partitionId()
        path = f"{folder}/part-{part:06d}-{uuid.uuid4().hex}.ids"
        keys, docs, size, n_docs, n_ids, sink = [], [], 0, 0, 0, None
        for batch in batches:
            for i in range(0, batch.num_rows, 128):
                rows = batch.slice(i, 128)
                for key, ids in zip(rows.column(0).to_pylist(), enc.encode_many(rows.column(1).to_pylist())):
                    keys.append(key)
                    docs.append(ids + end)
                    size += len(ids) // 4 + 1
                    if size >= SEGMENT:
                        sink = sink or create_file(path)
                        sink.write(segment(keys, docs))
                        n_docs, n_ids = n_docs + len(docs), n_ids + size
                        keys, docs, size = [], [], 0
        if docs:
            sink = sink or create_file(path)
            sink.write(segment(keys, docs))
            n_docs, n_ids = n_docs + len(docs), n_ids + size
        if sink:
            sink.close()
            yield pa.record_batch([pa.array([part], pa.int32()), pa.array([path]), pa.array([n_docs], pa.int64()), pa.array([n_ids], pa.int64())], names=["part", "path", "n_docs", "n_ids"])

    dealt = id_text(df).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return table(dealt.mapInArrow(run, "part int, path string, n_docs long, n_ids long"), "ids-manifest")


def read_files(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids (packed) from the files of a manifest; a task reads whole files, a segment at a time."""
    return _each_file(manifest, "ids binary", pa.binary(), bytes)


def read_digests(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and the CRC-32 of the document's ids, read back from the files."""
    return _each_file(manifest, "ids_crc32 long", pa.int64(), zlib.crc32)


def _each_file(manifest: DataFrame, column: str, kind: pa.DataType, value) -> DataFrame:
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    at = F.row_number().over(Window.orderBy("part")) - 1
    files = manifest.select("path", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("base"), at.alias("at"))
    names = ["doc_id", "start", "n_tokens", column.split()[0]]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, at in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with open_file(path) as source:
                    for keys, lengths, ids in segments(source):
                        flat = memoryview(ids.astype("<u4").tobytes())
                        ends = np.cumsum(lengths.astype(np.int64))
                        starts = ends - lengths
                        values = [value(flat[4 * i : 4 * j]) for i, j in zip(starts.tolist(), ends.tolist())]
                        for i in range(0, len(keys), 2000):
                            j = i + 2000
                            yield pa.record_batch([pa.array(keys[i:j], pa.int64()), pa.array(at + starts[i:j]), pa.array(lengths[i:j].astype(np.int64)), pa.array(values[i:j], kind)], names=names)
                        at += int(ends[-1]) if len(ends) else 0

    spread = files.repartitionById(max(1, manifest.count()), F.col("at")).select("path", "base")  # a task reads a file
    return spread.mapInArrow(run, f"doc_id long, start long, n_tokens long, {column}")
