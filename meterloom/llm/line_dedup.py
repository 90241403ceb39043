"""Removes lines that many documents share.

Every distinct line key is hashed to 128 bits. The hashes are dealt to shards;
each shard has a minimal perfect hash over its hashes, which numbers them
0..n-1, and arrays of fingerprints and document counts in that order. Documents
are dealt to parts. A part probes the arrays of the shards that its lines fall
into, each of its distinct lines once, so a line that most documents hold costs
one probe a part. The answers meet the part's documents, whose lines are cut;
lines themselves are never joined.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import ASCII_SPACE, fresh, releasing, written

#: Distinct lines in a shard, and lines in a part of the documents, about.
SHARD_KEYS, PART_LINES = 100_000, 50_000
#: Parts that ask a shard in one task, and partitions that parts are dealt to, at most.
ASKERS, MOST_PARTITIONS = 8192, 20_000
_GAMMA = 2
_KEY = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def line_key(line: bytes) -> bytes:
    return line.strip(ASCII_SPACE).lower()


def _digest(key: bytes) -> bytes:
    return xxhash.xxh3_128_digest(key)


def _mix(x: np.ndarray, seed: int) -> np.ndarray:
    """A different hash of 64 bits for each seed."""
    x = x ^ np.uint64((seed * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class RepeatedKey(ValueError):
    """Keys given to PerfectHash.build() are not distinct."""


class PerfectHash:
    """Numbers distinct keys without gaps, in about three bits a key.

    Level by level, keys fall on places of a bit array; a place with one key
    keeps it, keys that share a place go to the next level. A key's number is
    the count of kept places before its own.
    """

    def __init__(self, levels: list[int], bits: np.ndarray):
        self.levels, self.bits = levels, bits
        self.before = np.concatenate(([0], np.cumsum(bits, dtype=np.int64)))

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        levels, parts, rest = [], [], keys
        while len(rest):
            size = max(8, _GAMMA * len(rest))
            place = (_mix(rest, len(levels)) % np.uint64(size)).astype(np.int64)
            hit = np.bincount(place, minlength=size)
            levels.append(size)
            parts.append(hit == 1)
            rest = rest[hit[place] > 1]
            if len(levels) > 64:
                raise RepeatedKey
        return cls(levels, np.concatenate(parts) if parts else np.zeros(0, bool))

    def number(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key; -1 for some of those that were not given to build()."""
        out = np.full(len(keys), -1, np.int64)
        left, base = np.arange(len(keys)), 0
        for level, size in enumerate(self.levels):
            place = base + (_mix(keys[left], level) % np.uint64(size)).astype(np.int64)
            hit = self.bits[place]
            out[left[hit]] = self.before[place[hit]]
            left, base = left[~hit], base + size
        return out


def _smallest(values: np.ndarray) -> np.ndarray:
    return values.astype(np.min_scalar_type(int(values.max(initial=0))))


def _folded(a: np.ndarray, b: np.ndarray, seed: int) -> np.ndarray:
    return a.view(np.uint64) ^ _mix(b.view(np.uint64), seed)


def _build_shard(table: pa.Table) -> pa.Table:
    a, b, n = (table.column(k).combine_chunks().to_numpy() for k in ("a", "b", "n"))
    for seed in range(1, 1000):
        # Two hashes of 128 bits may fold to one of 64; then they are folded in another way.
        keys = _folded(a, b, seed)
        try:
            mph = PerfectHash.build(keys)
            break
        except RepeatedKey:
            continue
    order = mph.number(keys)
    prints, counts = np.zeros(len(keys), np.uint32), np.zeros(len(keys), np.int64)
    prints[order] = b.view(np.uint64) & np.uint64(0xFFFFFFFF)
    counts[order] = n
    counts = _smallest(counts)
    row = {"shard": table.column("shard")[0].as_py(), "seed": seed, "levels": mph.levels, "bits": np.packbits(mph.bits).tobytes(), "prints": prints.tobytes(), "counts": counts.tobytes(), "width": counts.dtype.itemsize}
    return pa.Table.from_pylist([row], _INDEX)


_INDEX = pa.schema([("shard", pa.int32()), ("seed", pa.int32()), ("levels", pa.list_(pa.int64())), ("bits", pa.binary()), ("prints", pa.binary()), ("counts", pa.binary()), ("width", pa.int32())])
_INDEX_TYPE = "shard int, seed int, levels array<bigint>, bits binary, prints binary, counts binary, width int"


def probe(index: dict, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The document count of each line hash; 0 where the index does not hold it."""
    mph = PerfectHash(index["levels"], np.unpackbits(np.frombuffer(index["bits"], np.uint8), count=sum(index["levels"])).astype(bool))
    at = mph.number(_folded(a, b, index["seed"]))
    prints, counts = np.frombuffer(index["prints"], np.uint32), np.frombuffer(index["counts"], f"<u{index['width']}")
    known = at >= 0
    known[known] = prints[at[known]] == (b[known].view(np.uint64) & np.uint64(0xFFFFFFFF))
    out = np.zeros(len(a), np.int64)
    out[known] = counts[at[known]]
    return out


def _doc_keys(text: str | None) -> set[bytes]:
    keys = {line_key(x) for x in (text or "").encode().split(b"\n")}
    keys.discard(b"")
    return {_digest(k) for k in keys}


@releasing
def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Line hashes with their document counts in the batch."""
    for batch in batches:
        found: dict[bytes, int] = {}
        for text in batch.column(0).to_pylist():
            for h in _doc_keys(text):
                found[h] = found.get(h, 0) + 1
        pair = np.frombuffer(b"".join(found), "<i8").reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([pa.array(pair[:, 0]), pa.array(pair[:, 1]), pa.array(list(found.values()), pa.int64())], ["a", "b", "n"])


def line_index(docs: DataFrame, text_col: str = "text") -> tuple[DataFrame, int, int]:
    """One row for each shard with its perfect hash, fingerprints and document counts; the number of shards, and of all documents' distinct lines added up."""
    texts = docs.select(F.col(text_col).alias("text"))
    counts = written(texts.mapInArrow(_counted, "a bigint, b bigint, n bigint").groupBy("a", "b").agg(F.sum("n").alias("n")), "line-counts")
    total, distinct = counts.agg(F.sum("n"), F.count("*")).first()
    shards = max(16, math.ceil((distinct or 0) / SHARD_KEYS))
    dealt = counts.withColumn("shard", F.pmod("a", F.lit(shards)).cast("int"))
    return dealt.groupBy("shard").applyInArrow(_build_shard, _INDEX_TYPE), shards, total or 0


def frequent_lines(docs: DataFrame, min_docs: int, index: DataFrame, shards: int, part_col: str, text_col: str = "text", parts: int = 1) -> DataFrame:
    """(part, hashes): the hashes, 16 bytes each, of the frequent lines that the documents of a part hold; several rows a part.

    Each of the parts asks for each of its distinct lines. So many parts as
    ASKERS meet a shard in one task; with more of them the shard is repeated.
    """

    @releasing
    def probes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[int, set[bytes]] = {}
            for part, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found.setdefault(part, set()).update(_doc_keys(text))
            pair = np.frombuffer(b"".join(h for own in found.values() for h in own), "<i8").reshape(-1, 2)
            part = np.repeat(np.array(list(found), np.int32), [len(own) for own in found.values()])
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(pair[:, 0]), pa.array(pair[:, 1]), pa.array(np.mod(pair[:, 0], shards).astype(np.int32))], ["part", "a", "b", "shard"])

    def answered(asked: pa.Table, index: pa.Table) -> pa.Table:
        schema = pa.schema([("part", pa.int32()), ("hashes", pa.binary())])
        if not asked.num_rows or not index.num_rows:
            return pa.Table.from_pylist([], schema)
        part, a, b = (asked.column(k).combine_chunks().to_numpy() for k in ("part", "a", "b"))
        hit = probe(index.to_pylist()[0], a, b) >= min_docs
        order = np.argsort(part[hit], kind="stable")
        part, pair = part[hit][order], np.stack([a[hit], b[hit]], axis=1)[order]
        parts, first = np.unique(part, return_index=True)
        return pa.Table.from_arrays([pa.array(parts, pa.int32()), pa.array([x.tobytes() for x in np.split(pair, first[1:])] if len(parts) else [], pa.binary())], schema=schema)

    asked = docs.select(F.col(part_col).alias("part"), F.col(text_col).alias("text")).mapInArrow(probes, "part int, a bigint, b bigint, shard int").distinct()
    asked = asked.withColumn("slice", F.floor(F.col("part") / ASKERS).cast("int"))
    index = index.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit((max(parts, 1) - 1) // ASKERS))))
    return asked.groupBy("shard", "slice").cogroup(index.groupBy("shard", "slice")).applyInArrow(answered, "part int, hashes binary")


def _cut(text: str | None, frequent: set[bytes]) -> tuple[str, int, int]:
    """The text without its frequent lines, its lines, and how many of them went."""
    lines = (text or "").encode().split(b"\n")
    keys = [line_key(x) for x in lines]
    kept = [x for x, k in zip(lines, keys) if not k or _digest(k) not in frequent]
    return b"\n".join(kept).decode(), len(lines), len(lines) - len(kept)


def drop_frequent_lines(docs: DataFrame, min_docs: int = 10, id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
    """docs with the lines gone whose key is in at least min_docs documents.

    A text is split at \\n; a null or empty text has one empty line. A line's
    key is the line without ASCII white space at both ends and with A-Z in lower
    case; empty keys never count as frequent. Each row is a document of its own,
    rows with equal or null ids too. All columns stay as they are but for the
    text; null texts stay null. Columns _n_lines and _n_dropped are added, and
    with digest the text is replaced by _kept_sha256, lowercase hex of what
    is kept. An empty table gives an empty one.

    Documents are dealt to parts by id and text. In each part the answers are
    sorted before the documents, so a part of any size streams through its task.
    """
    index, shards, total = line_index(docs, text_col)
    part, hashes = fresh(docs, "_part"), fresh(docs, "_hashes")
    parts = max(16, math.ceil(total / PART_LINES))
    dealt = docs.withColumn(part, F.pmod(F.xxhash64(F.col(id_col), F.col(text_col)), F.lit(parts)).cast("int"))
    answers = frequent_lines(dealt, min_docs, index, shards, part, text_col, parts).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in docs.schema], F.col("part").alias(part), F.col("hashes").alias(hashes))
    rows = dealt.withColumn(hashes, F.lit(None).cast("binary")).unionByName(answers)
    # A partition holds several parts where there are very many.
    rows = rows.repartition(min(parts, MOST_PARTITIONS), part).sortWithinPartitions(F.col(part), F.col(hashes).isNull())
    text_at, part_at = docs.columns.index(text_col), len(docs.columns)
    kept_at = [i for i in range(len(docs.columns)) if not (digest and i == text_at)]
    more = [fresh(docs, x) for x in ["_n_lines", "_n_dropped", *["_kept_sha256"] * digest]]
    names = [docs.columns[i] for i in kept_at] + more
    types = [docs.schema[i].dataType.simpleString() for i in kept_at] + ["bigint", "bigint", *["string"] * digest]
    out_type = ", ".join(f"`{n}` {t}" for n, t in zip(names, types))

    @releasing
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, frequent = None, set()
        for batch in batches:
            done, document = [], []
            for p, answer, text in zip(batch.column(part_at).to_pylist(), batch.column(part_at + 1).to_pylist(), batch.column(text_at).to_pylist()):
                if p != current:
                    current, frequent = p, set()
                document.append(answer is None)
                if answer is None:
                    done.append(_cut(text, frequent))
                else:
                    frequent.update(answer[i : i + 16] for i in range(0, len(answer), 16))
            rows = batch.filter(pa.array(document, pa.bool_()))
            texts = rows.column(text_at).is_valid().to_pylist()
            columns = [pa.array([d[0] if t else None for t, d in zip(texts, done)], pa.string()) if i == text_at else rows.column(i) for i in kept_at]
            columns += [pa.array([d[1] for d in done], pa.int64()), pa.array([d[2] for d in done], pa.int64())]
            if digest:
                columns.append(pa.array([hashlib.sha256(d[0].encode()).hexdigest() for d in done], pa.string()))
            yield pa.RecordBatch.from_arrays(columns, names)

    return rows.mapInArrow(cut, out_type)
