"""Packing documents into training sequences by order-preserving dynamic programming.

Documents stand in ascending id order as one stream of ids. A sequence is a
window of the stream, so the task is to choose the cuts. A cut is dear inside a
sentence, cheaper at a sentence's end and free at a document's end; padding
costs one for each id. A sequence whose length is a power of two is not padded;
its room to the window costs an eighth of an id each, so that short sequences
are not free.
With P[j] the place of boundary j, the least cost of a stream cut at j is

    f[j] = min over i with P[j] - P[i] <= W of f[i] + (W - (P[j] - P[i])) + penalty[j]

and g = f + P makes that g[j] = min g[i] + W + penalty[j], a minimum over a
sliding window, which a queue of increasing g answers in constant time. Powers
of two below W add at most log2 W further places i, where they are boundaries.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import ordered, releasing
from .word_encoder import ROWS, word_encoder

#: What a cut costs, in ids of padding.
SENTENCE_CUT, WORD_CUT = 8, 64
#: So many ids of room in a short sequence cost as much as one id of padding.
ROOM = 8
#: Inside long sentences a boundary is offered every so many ids.
STRIDE = 64
#: Boundaries inside a document that are nearer than this to the last one are left out.
NEAREST = 8
#: The stream is cut by the programme in stretches of about so many ids; the last windows of a stretch begin the next one.
STRETCH = 1 << 20
_TYPE = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, padded bigint"
_NAMES = [x.split()[0] for x in _TYPE.split(", ")]


def choose_cuts(places: np.ndarray, penalties: np.ndarray, window: int, room: int | None = None) -> list[int]:
    """Indices of the boundaries at which the best windows end; the first boundary is the stream's begin.

    Neighbouring places must be at most `window` apart. With room, a sequence of
    a power of two costs an id for each so many that it is short of the window.
    """
    p, pen = places.tolist(), penalties.tolist()
    exact: dict[int, list[tuple[int, int]]] = {}
    for size in (1 << b for b in range(max(window - 1, 0).bit_length()) if 1 << b < window):
        at = np.searchsorted(places, places - size)
        for j in np.flatnonzero(places[at] == places - size).tolist():
            exact.setdefault(j, []).append((int(at[j]), size))
    g, back = [0] * len(p), [0] * len(p)
    queue: deque[int] = deque([0])
    for j in range(1, len(p)):
        least = p[j] - window
        while p[queue[0]] < least:
            queue.popleft()
        back[j] = queue[0]
        cost = g[queue[0]] + window + pen[j]
        for i, size in exact.get(j, ()):
            short = g[i] + size + pen[j] + ((window - size) // room if room else 0)
            if short < cost:
                back[j], cost = i, short
        g[j] = cost
        while queue and g[queue[-1]] >= cost:
            queue.pop()
        queue.append(j)
    cuts, j = [], len(p) - 1
    while j:
        cuts.append(j)
        j = back[j]
    return cuts[::-1]


def boundaries(lengths: list[int], ends: np.ndarray, stride: int = STRIDE) -> tuple[np.ndarray, np.ndarray]:
    """Places and penalties of a stream: of documents of these lengths, with `ends` true after a sentence's last id."""
    doc_ends = np.cumsum(np.asarray(lengths, np.int64))
    kind = np.zeros(len(ends) + 1, np.int8)
    inner = np.flatnonzero(ends) + 1
    kind[inner] = 1
    kind[doc_ends] = 2
    kind[0] = 2
    kept = np.flatnonzero(kind)
    near = np.diff(kept, prepend=-NEAREST) < NEAREST
    kept = kept[(kind[kept] == 2) | ~near]
    gaps = np.diff(kept)
    long = np.flatnonzero(gaps > stride)
    if len(long):
        more = np.concatenate([np.arange(kept[i] + stride, kept[i + 1], stride) for i in long])
        kind[more] = 3
        kept = np.union1d(kept, more)
    return kept, np.array([0, SENTENCE_CUT, 0, WORD_CUT])[kind[kept]]


class _Stream:
    """The stream of one partition; gives its pieces as soon as their sequences are certain."""

    def __init__(self, part: int, window: int):
        self.window, self.sequence = window, part << 32
        self.docs: list[tuple[int | None, int, np.ndarray, int]] = []  # id, ids before, ids, ids of the whole document
        self.ends: list[np.ndarray] = []
        self.n = 0

    def add(self, doc: int | None, ids: np.ndarray, ends: np.ndarray) -> None:
        self.docs.append((doc, 0, ids, len(ids)))
        self.ends.append(ends)
        self.n += len(ids)

    def pieces(self, last: bool) -> Iterator[tuple]:
        if not self.n:
            return
        all_ends = np.concatenate(self.ends)
        places, penalties = boundaries([len(x[2]) for x in self.docs], all_ends, min(STRIDE, self.window))
        cuts = places[choose_cuts(places, penalties, self.window, ROOM)].tolist()
        if not last:
            cuts = cuts[:-2]
        at = k = inside = 0
        for cut in cuts:
            offset, size = 0, cut - at
            padded = size if size & (size - 1) == 0 else self.window
            while at < cut:
                doc, before, ids, total = self.docs[k]
                take = min(len(ids) - inside, cut - at)
                piece = ids[inside : inside + take]
                yield doc, before + inside, take, zlib.crc32(piece.astype("<u4").tobytes()), total, self.sequence, offset, padded
                at, offset, inside = at + take, offset + take, inside + take
                if inside == len(ids):
                    k, inside = k + 1, 0
            self.sequence += 1
        rest = self.docs[k:]
        if rest and inside:
            doc, before, ids, total = rest[0]
            rest[0] = (doc, before + inside, ids[inside:], total)
        self.docs, self.ends, self.n = rest, [all_ends[at:]], self.n - at


def _sentence_ends(encoder) -> np.ndarray:
    """Which ids end a sentence: those whose text is punctuation that ends with a full stop or the like."""
    out = np.zeros(encoder.vocab_size, bool)
    for token, i in encoder.library.get_vocab(with_added_tokens=False).items():
        text = token.removesuffix("</w>")
        out[i] = token.endswith("</w>") and text[-1:] in (".", "!", "?") and not any(c.isalnum() for c in text)
    return out


def _packed(batches: Iterator[pa.RecordBatch], tokenizer: str, end_id: int, window: int) -> Iterator[pa.RecordBatch]:
    encoder = word_encoder(tokenizer)
    table = _sentence_ends(encoder)
    stream = _Stream(TaskContext.get().partitionId(), window)
    end = np.array([end_id], encoder.dtype)

    def table_of(pieces: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
        if rows := list(pieces):
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in zip(*rows)], _NAMES)

    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            rows = batch.slice(at, ROWS)
            for doc, ids in zip(rows.column(0).to_pylist(), encoder.encode_many(rows.column(1))):
                ids = np.concatenate([ids, end])
                stream.add(doc, ids, table[ids])
                if stream.n >= STRETCH:
                    yield from table_of(stream.pieces(False))
    yield from table_of(stream.pieces(True))


def pack_documents(docs: DataFrame, tokenizer: str, window: int = 2048, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1) -> DataFrame:
    """One row for each piece of a document in a sequence of at most `window` ids.

    doc_id, start (ids of the document before the piece), length, ids_crc32,
    doc_tokens, sequence_id, offset in the sequence, and padded, the length of
    the sequence once it is filled up: `window`, or its own if that is a power
    of two. Null texts count as empty and are one end id. Null ids come first,
    repeated rows are documents of their own, other columns are not read. An
    empty table gives no row. Each partition of the ordered documents ends with
    one sequence that may be short. Where sequences begin, and their ids, hang on
    how Spark has dealt the documents to partitions; every cut is valid.
    """
    rows = ordered(docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")), "doc_id", "text")
    return rows.mapInArrow(releasing(lambda batches: _packed(batches, tokenizer, end_id, window), lambda: word_encoder(tokenizer).forget()), _TYPE)
