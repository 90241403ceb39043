"""Exact top-k search by inner product, term at a time.

A block of candidates becomes postings: for each dimension, the candidates with
a value there that is not zero, and these values. A query's values are its
terms. Each term scatters its weighted postings into a dense array of scores,
here of a block of queries at once; when all terms are done, every score is
exact. Each block keeps its k best, and the blocks' results are merged.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows in a block of candidates and of queries as they are shipped, and as scores are held.
CANDIDATES, QUERIES = 1 << 14, 1 << 12
_TILE, _STRIP = 2048, 64


def quantised(vectors: DataFrame, id_col: str, vector_col: str, scale: float) -> DataFrame:
    """vec_id and v array<bigint>: floor(scale * x) of each component, x as double.

    Vectors that are null or hold a null or non-finite component are left out.
    """
    v = F.transform(F.col(vector_col).cast("array<double>"), lambda x: x)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), v.alias("x")).where(F.col("x").isNotNull() & ~bad)
    # floor() of a larger number would be the largest 64-bit integer, a wrong component.
    whole = lambda x: F.when(F.abs(x) < 2.0**62, F.floor(x)).otherwise(F.raise_error(F.lit("a scaled component is beyond 2**62")).cast("bigint"))
    return rows.select("vec_id", F.transform("x", lambda x: whole(x * F.lit(float(scale)))).alias("v"))


def scores_by_term(queries: np.ndarray, candidates: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """For each strip of queries and tile of candidates: their first rows, and the scores (candidates, queries)."""
    wide = max(1, queries.shape[1]) * float(np.abs(queries).max(initial=0)) * float(np.abs(candidates).max(initial=0))
    if wide >= 2**62:
        raise OverflowError("scores may not fit a 64-bit integer")
    kind = np.int32 if wide < 2**31 else np.int64
    for c in range(0, len(candidates), _TILE):
        tile = candidates[c : c + _TILE].astype(kind)
        postings = [(d, at, tile[at, d][:, None]) for d in range(tile.shape[1]) if len(at := np.flatnonzero(tile[:, d]))]
        for q in range(0, len(queries), _STRIP):
            strip = queries[q : q + _STRIP].astype(kind)
            scores = np.zeros((len(tile), len(strip)), kind)
            for d, at, weights in postings:
                term = strip[:, d]
                if term.any():
                    if len(at) == len(tile):
                        scores += weights * term
                    else:
                        scores[at] += weights * term
            yield q, c, scores


def best_of(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Rows of the k highest scores, ties to the smaller id, in no order."""
    if len(scores) <= k:
        return np.arange(len(scores))
    least = np.partition(scores, len(scores) - k)[len(scores) - k]
    above = np.flatnonzero(scores > least)
    level = np.flatnonzero(scores == least)
    return np.concatenate([above, level[np.argsort(ids[level], kind="stable")[: k - len(above)]]])


def _matrix(column: pa.ChunkedArray) -> list[np.ndarray]:
    """The rows of a column of lists, without a Python object for each number."""
    whole = column.combine_chunks()
    values, ends = whole.flatten().to_numpy(), whole.offsets.to_numpy() - whole.offsets[0].as_py()
    return [values[a:b] for a, b in zip(ends, ends[1:])]


def search(vectors: DataFrame, k: int, is_query: F.Column, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 64.0) -> DataFrame:
    """query_id, rank (from 1), vec_id and score of the k best candidates of each query.

    Queries are the rows for which is_query, over the column vec_id, holds;
    candidates of a query are all rows with another id. Scores are integers;
    ties go to the smaller id, null ids last. Rows of one id are candidates each;
    a query id that several rows share is answered once for each of its vectors,
    equal vectors once. Vectors of unlike lengths are compared over the shorter.
    Null vectors and those with null or non-finite components take no part;
    other columns are not read; an empty table gives no row. Components and scores
    must fit a 64-bit integer; if they might not, the job says so and ends.
    """
    rows = quantised(vectors, id_col, vector_col, scale)
    own = rows.where(F.coalesce(is_query, F.lit(False))).distinct()
    n_rows, n_queries = rows.count(), own.count()
    c_blocks, q_blocks = max(1, math.ceil(n_rows / CANDIDATES)), max(1, math.ceil(n_queries / QUERIES))
    # Each block of candidates meets each block of queries in one task; both have bounded sizes.
    lists = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = rows.withColumn("c", F.pmod(F.xxhash64("vec_id", "v"), F.lit(c_blocks)).cast("int")).withColumn("q", lists(q_blocks))
    right = own.withColumn("q", F.pmod(F.xxhash64("v", "vec_id"), F.lit(q_blocks)).cast("int")).withColumn("c", lists(c_blocks))

    def block(candidates: pa.Table, queries: pa.Table) -> pa.Table:
        schema = pa.schema([("query_id", pa.int64()), ("query", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])
        if not candidates.num_rows or not queries.num_rows:
            return pa.Table.from_pylist([], schema)
        cs, qs = _matrix(candidates.column("v")), _matrix(queries.column("v"))
        width = max(map(len, [*cs, *qs]))
        cm, qm = (np.zeros((len(x), width), np.int64) for x in (cs, qs))
        for m, xs in ((cm, cs), (qm, qs)):
            for i, x in enumerate(xs):
                m[i, : len(x)] = x
        last = np.iinfo(np.int64).max
        c_ids, q_ids = (t.column("vec_id").combine_chunks().fill_null(last).to_numpy() for t in (candidates, queries))
        kept: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in qs]
        for q, c, scores in scores_by_term(qm, cm):
            ids = c_ids[c : c + len(scores)]
            for j in range(scores.shape[1]):
                column = np.ascontiguousarray(scores[:, j])
                other = ids != q_ids[q + j]
                at = best_of(column, ids, k + 1) if other.all() else np.flatnonzero(other)[best_of(column[other], ids[other], k)]
                kept[q + j].append((column[at].astype(np.int64), ids[at]))
        out = []
        for i, parts in enumerate(kept):
            scores, ids = (np.concatenate(x) for x in zip(*parts))
            at = best_of(scores, ids, k)
            out.append((np.full(len(at), q_ids[i]), np.full(len(at), i), ids[at], scores[at]))
        columns = [np.concatenate(x) for x in zip(*out)]
        vec = pa.array(columns[2], pa.int64(), mask=columns[2] == last)
        # Queries of one id are told apart by a hash of their vector.
        keys = queries.column("h").combine_chunks().take(pa.array(columns[1]))
        return pa.Table.from_arrays([pa.array(columns[0]), keys, vec, pa.array(columns[3])], schema=schema)

    right = right.withColumn("h", F.xxhash64("v"))
    near = left.groupBy("q", "c").cogroup(right.groupBy("q", "c")).applyInArrow(block, "query_id bigint, query bigint, vec_id bigint, score bigint")
    order = Window.partitionBy("query_id", "query").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
