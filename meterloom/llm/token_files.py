"""Token-ID files: fixed-width bit packing with block offsets.

Ids are stored in the fewest bits that hold the vocabulary's largest id. A file
is Parquet, so any Spark-readable store can hold it; each of its rows is a
segment of whole documents in ascending id order:

    part, segment     which range of documents, and which segment of it
    first             ids of the part before this segment
    width             bits of an id
    n_ids             ids in the segment
    block_offsets     where each block of BLOCK ids begins in `packed`, in bytes
    packed            the blocks, each begun at a byte, most significant bit first
    doc_ids, doc_ends each document and the segment's ids up to its end

With `width` and `block_offsets`, ids i..j of a segment are read without the rest.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import ordered, releasing
from .word_encoder import ROWS, word_encoder

BLOCK = 4096
#: A segment is closed once it has so many ids; a longer document is a segment of its own.
SEGMENT = 1 << 18
_SEGMENT_TYPE = "part int, segment int, first bigint, width int, n_ids bigint, block_offsets array<bigint>, packed binary, doc_ids array<bigint>, doc_ends array<bigint>"


def bit_width(vocab_size: int) -> int:
    return max(1, int(vocab_size - 1).bit_length())


def pack_bits(ids: np.ndarray, width: int) -> bytes:
    """Each id in `width` bits, one after the other; the last byte is filled with zeros."""
    wide = np.ascontiguousarray(ids, ">u4")
    if width == 32:
        return wide.tobytes()
    if width == 16:
        return wide.astype(">u2").tobytes()
    bits = np.unpackbits(wide.view(np.uint8).reshape(-1, 4), axis=1)[:, 32 - width :]
    return np.packbits(bits).tobytes()


def unpack_bits(packed: bytes, width: int, n: int) -> np.ndarray:
    raw = np.frombuffer(packed, np.uint8)
    if width == 32:
        return raw[: 4 * n].view(">u4").astype("<u4")
    if width == 16:
        return raw[: 2 * n].view(">u2").astype("<u4")
    bits = np.zeros((n, 32), np.uint8)
    bits[:, 32 - width :] = np.unpackbits(raw, count=n * width).reshape(n, width)
    return np.packbits(bits, axis=1).view(">u4").reshape(-1).astype("<u4")


def pack_blocks(ids: np.ndarray, width: int) -> tuple[bytes, list[int]]:
    """The blocks of an array of ids, and each block's offset."""
    size = (BLOCK * width + 7) // 8
    return b"".join(pack_bits(ids[i : i + BLOCK], width) for i in range(0, len(ids), BLOCK)), [size * i for i in range(-(-len(ids) // BLOCK))]


def read_ids(packed: bytes, offsets: list[int], width: int, n_ids: int, start: int, stop: int) -> np.ndarray:
    """Ids start..stop of a segment, from the blocks that hold them alone."""
    stop = min(stop, n_ids)
    if start >= stop:
        return np.zeros(0, "<u4")
    first, last = start // BLOCK, (stop - 1) // BLOCK
    parts = []
    for b in range(first, last + 1):
        end = offsets[b + 1] if b + 1 < len(offsets) else len(packed)
        parts.append(unpack_bits(packed[offsets[b] : end], width, min(BLOCK, n_ids - b * BLOCK)))
    return np.concatenate(parts)[start - first * BLOCK : stop - first * BLOCK]


def _segments(batches: Iterator[pa.RecordBatch], tokenizer: str, end_id: int) -> Iterator[pa.RecordBatch]:
    encoder = word_encoder(tokenizer)
    width = bit_width(encoder.vocab_size)
    schema = pa.schema([("part", pa.int32()), ("segment", pa.int32()), ("first", pa.int64()), ("width", pa.int32()), ("n_ids", pa.int64()), ("block_offsets", pa.list_(pa.int64())), ("packed", pa.binary()), ("doc_ids", pa.list_(pa.int64())), ("doc_ends", pa.list_(pa.int64()))])
    part, segment, first = TaskContext.get().partitionId(), 0, 0
    held: list[np.ndarray] = []
    docs: list[int | None] = []
    ends: list[int] = []
    n = 0
    end = np.array([end_id], encoder.dtype)

    def closed() -> pa.RecordBatch:
        packed, offsets = pack_blocks(np.concatenate(held), width)
        return pa.RecordBatch.from_pylist([{"part": part, "segment": segment, "first": first, "width": width, "n_ids": n, "block_offsets": offsets, "packed": packed, "doc_ids": docs, "doc_ends": ends}], schema)

    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            rows = batch.slice(at, ROWS)
            for doc, ids in zip(rows.column(0).to_pylist(), encoder.encode_many(rows.column(1))):
                held += [ids, end]
                n += len(ids) + 1
                docs.append(doc)
                ends.append(n)
                if n >= SEGMENT:
                    yield closed()
                    segment, first = segment + 1, first + n
                    held, docs, ends, n = [], [], [], 0
    if docs:
        yield closed()


def write_token_files(docs: DataFrame, path: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1) -> None:
    """Encodes every whole text and writes the files under path, in ascending id order.

    Null texts count as empty. Null ids come first; rows with equal ids are
    ordered by their texts, so equal rows only are interchangeable. Other
    columns, whatever their names, are not read. An empty table gives no segment.
    """
    rows = ordered(docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")), "doc_id", "text")
    rows.mapInArrow(releasing(lambda batches: _segments(batches, tokenizer, end_id), lambda: word_encoder(tokenizer).forget()), _SEGMENT_TYPE).write.option("compression", "none").parquet(path)


def _bases(spark: SparkSession, path: str) -> dict[int, int]:
    """The ids of all parts before each part. There are as many parts as tasks have written, so the sums are made on the driver."""
    sums = spark.read.schema(_SEGMENT_TYPE).parquet(path).groupBy("part").agg(F.sum("n_ids").alias("n")).collect()
    out, base = {}, 0
    for r in sorted(sums, key=lambda r: r.part):
        out[r.part], base = base, base + r.n
    return out


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it) and ids array<int> of each document."""

    bases = _bases(spark, path)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("ids", pa.list_(pa.int32()))])
        for doc, start, ids in _documents(batches, bases):
            yield pa.RecordBatch.from_pylist([{"doc_id": doc, "start": start, "ids": ids.astype("<i4")}], schema)

    return spark.read.schema(_SEGMENT_TYPE).parquet(path).mapInArrow(read, "doc_id bigint, start bigint, ids array<int>")


def _documents(batches: Iterator[pa.RecordBatch], bases: dict[int, int]) -> Iterator[tuple[int | None, int, np.ndarray]]:
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1).to_pylist()[0]
            ids = read_ids(row["packed"], row["block_offsets"], row["width"], row["n_ids"], 0, row["n_ids"])
            start = 0
            for doc, end in zip(row["doc_ids"], row["doc_ends"]):
                yield doc, bases[row["part"]] + row["first"] + start, ids[start:end]
                start = end


def token_digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each document, from the files."""
    bases = _bases(spark, path)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(d, s, len(x), zlib.crc32(x.tobytes())) for d, s, x in _documents(iter([batch]), bases)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in zip(*rows)], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return spark.read.schema(_SEGMENT_TYPE).parquet(path).mapInArrow(read, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
