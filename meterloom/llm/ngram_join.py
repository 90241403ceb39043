"""Similarity self-join on Jaccard of word n-grams, by token-combination prefixes.

A document's tokens are the hashes of its shingles. They stand in one order for
all documents, by how often the shingle is to be expected from its words'
frequencies in the corpus; shingles that seem to stand in the prefixes of
several documents come after all others, which a bitmap of fixed size tells
roughly. Any order gives all pairs, a good one gives few others. Two sets that are similar enough share their first
common token within a short prefix of both. If that token is of the rare class,
it is a signature of both alone. If it is of the frequent class, all common
tokens are; then a prefix longer by m tokens holds m + 1 common ones, so two of
these fall into the same of m classes by hash, and the pairs of frequent tokens
within a class are signatures of both. Such combinations are rarer than their
tokens, and their number stays in proportion to the prefix.

Documents with equal sets have one digest of 128 bits and are one node. All
signatures that share their smallest node make one group. Its nodes are first
compared by sketches, about one bit for each token, that tell exactly how much two
sets differ at least; those that are too different from all others leave the group,
so that few sets are sent to groups, however many share a signature by chance. Sets
that stay are compared exactly, in blocks of bounded size if the group is large;
each block gives a forest of links, and the number of links of each of its nodes.
Two nodes may meet in several groups; the one with the smallest leader counts their
link.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .components import connected_components
from .shared import discard, fresh, releasing, trimmed, written
from .shingles import mixed, shingle_sets, short_set, word_hashes

#: Buckets of word counts; rows they are shipped in.
_WORDS, _CHUNK = 1 << 18, 1 << 14
#: A shingle of the frequent class is expected so often, were words independent.
FREQUENT = 0.1
#: Bits of the map of shingles in several prefixes, and bits of each row it is shipped in. At some size of the
#: input the map is full; then the order is that of word frequencies alone.
_SEEN, _SEEN_CHUNK = 1 << 26, 1 << 16
#: Tables in rows are added up in two steps, the first in so many parts, so that no group grows with the number of tasks.
_ADDERS = 64
#: Added to the score of a shingle that the map shows.
_LATE = 1 << 20
#: Documents of a block, and parts of a group at most, as long as a part's tokens stay below the third.
_BLOCK, _PARTS, _TOKENS = 128, 32, 4_000_000
#: Sketches of a block, and bits of a sketch at least and at most.
_SKETCHES, _SKETCH_BITS = 2048, (64, 1 << 16)
_STEP = 256


def _steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, _STEP):
            yield batch.slice(at, _STEP)


def word_scores(docs: DataFrame, text_col: str) -> tuple[np.ndarray, int]:
    """16 log2 of each word bucket's count over all documents, and the count of all words."""

    @releasing
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(_WORDS, np.int64)
        for rows in _steps(batches):
            h, _ = word_hashes(rows.column(0).to_pylist())
            total += np.bincount(_bucket(h), minlength=_WORDS)
        parts = [total[i : i + _CHUNK].tobytes() for i in range(0, _WORDS, _CHUNK)]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array(parts)], ["chunk", "data"])

    # As many rows as the table of counts has chunks come back, whatever the input.
    rows = _added(docs.select(F.col(text_col)).mapInArrow(count, "chunk int, data binary"), lambda parts: sum(np.frombuffer(x, np.int64) for x in parts).tobytes()).collect()
    total = np.zeros(_WORDS, np.int64)
    for r in rows:
        total[r.chunk * _CHUNK : (r.chunk + 1) * _CHUNK] = np.frombuffer(r.data, np.int64)
    return np.rint(16 * np.log2(np.maximum(total, 1))).astype(np.int32), int(total.sum())


def _added(rows: DataFrame, add: Callable[[list[bytes]], bytes]) -> DataFrame:
    """One row for each chunk: what add() makes of all data of that chunk. add() can be applied to its own results."""

    def merge(table: pa.Table) -> pa.Table:
        return pa.table({"chunk": table.column("chunk").slice(0, 1), "data": pa.array([add(table.column("data").to_pylist())])})

    dealt = rows.withColumn("part", F.pmod(F.spark_partition_id(), F.lit(_ADDERS)))
    return dealt.groupBy("chunk", "part").applyInArrow(merge, "chunk int, data binary").groupBy("chunk").applyInArrow(merge, "chunk int, data binary")


def _add_seen(parts: list[bytes]) -> bytes:
    """Of pairs of bitmaps (held at all, held twice) their union."""
    held, twice = np.zeros(_SEEN_CHUNK // 8, np.uint8), np.zeros(_SEEN_CHUNK // 8, np.uint8)
    for p in parts:
        own = np.frombuffer(zlib.decompress(p), np.uint8).reshape(2, -1)
        twice |= own[1] | (held & own[0])
        held |= own[0]
    return zlib.compress(np.concatenate([held, twice]).tobytes(), 1)


def _seen_bit(tokens: np.ndarray) -> np.ndarray:
    return (mixed(tokens, 31) % np.uint64(_SEEN)).astype(np.int64)


def _set_bits(packed: np.ndarray, bits: np.ndarray) -> None:
    """Sets bits, given in ascending order, of a packed bitmap."""
    if len(bits):
        at, first = np.unique(bits >> 3, return_index=True)
        packed[at] |= np.bitwise_or.reduceat(np.uint8(128) >> (bits & 7).astype(np.uint8), first)


def _get_bits(packed: np.ndarray, bits: np.ndarray) -> np.ndarray:
    return packed[bits >> 3] >> (7 - (bits & 7)).astype(np.uint8) & 1 > 0


def _shipped(held: np.ndarray, twice: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The parts of a pair of packed bitmaps in which a bit is set."""
    size = _SEEN_CHUNK // 8
    for i in range(0, len(held), size):
        if held[i : i + size].any():
            data = zlib.compress(np.concatenate([held[i : i + size], twice[i : i + size]]).tobytes(), 1)
            yield pa.RecordBatch.from_arrays([pa.array([i // size], pa.int32()), pa.array([data])], ["chunk", "data"])


def _collected(parts: DataFrame, which: int) -> np.ndarray:
    """The union of what tasks _shipped(), of which there are at most as many chunks as the bitmap has."""
    out, size = np.zeros(_SEEN // 8, np.uint8), _SEEN_CHUNK // 8
    for r in _added(parts, _add_seen).collect():
        out[r.chunk * size : (r.chunk + 1) * size] = np.frombuffer(zlib.decompress(r.data), np.uint8)[which * size : (which + 1) * size]
    return out


def prefix_map(docs: DataFrame, text_col: str, n: int, scores: np.ndarray, num: int, den: int) -> np.ndarray:
    """Packed bits: those of shingles that the prefixes of two or more different sets hold, and of some others."""

    @releasing
    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, twice = np.zeros(_SEEN // 8, np.uint8), np.zeros(_SEEN // 8, np.uint8)
        seen: set[tuple[int, int]] = set()
        for rows in _steps(batches):
            found = []
            for tokens, own in _sets_with_scores(rows.column(0).to_pylist(), n, scores):
                d = digest_of(tokens)
                if len(tokens) and d not in seen:
                    seen.add(d)
                    size = len(tokens)
                    first = np.argpartition(own, spare)[: spare + 1] if (spare := size - -(-num * size // den)) + 1 < size else slice(None)
                    found.append(np.unique(_seen_bit(tokens[first])))
            if found:
                bits, times = np.unique(np.concatenate(found), return_counts=True)
                _set_bits(twice, bits[(times > 1) | _get_bits(held, bits)])
                _set_bits(held, bits)
        yield from _shipped(held, twice)

    return _collected(docs.select(F.col(text_col)).mapInArrow(mark, "chunk int, data binary"), 1)


def _asked_map(digests: DataFrame) -> np.ndarray:
    """Packed bits that hold all these digests and some others; of fixed size, so that only most other sets stay where they are."""

    @releasing
    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(_SEEN // 8, np.uint8)
        for rows in batches:
            _set_bits(held, np.unique(_seen_bit(rows.column(0).to_numpy().view(np.uint64))))
        yield from _shipped(held, held)

    return _collected(digests.mapInArrow(mark, "chunk int, data binary"), 0)


def _late(tokens: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """Whether the map shows each token."""
    return _get_bits(seen, _seen_bit(tokens))


def _bucket(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - 18)).astype(np.int64)


def _sets_with_scores(texts: list[str | None], n: int, scores: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    h, starts = word_hashes(texts)
    own = scores[_bucket(h)]
    k = max(0, len(h) - n + 1)
    sums = np.zeros(k, np.int64)
    for i in range(n):
        sums += own[i : i + k]
    hashed = np.zeros(k, np.uint64)
    for i in range(n):
        hashed = mixed(hashed + h[i : i + k] * np.uint64(2 * i + 1), i + 1)
    out = []
    for a, b in zip(starts[:-1].tolist(), starts[1:].tolist()):
        if b - a >= n:
            tokens, first = np.unique(hashed[a : b - n + 1], return_index=True)
            out.append((tokens, sums[a : b - n + 1][first]))
        else:
            tokens = short_set(h[a:b])
            out.append((tokens, np.zeros(len(tokens), np.int64)))
    return out


def digest_of(tokens: np.ndarray) -> tuple[int, int]:
    """Two numbers for a set, as signed 64-bit integers; of two sets, equal numbers mean equal sets."""
    if not len(tokens):
        return 0, 0
    out = []
    for seed in (7, 13):
        h = mixed(tokens, seed)
        h = np.bitwise_xor.reduce(h) ^ mixed(np.array([h.sum(dtype=np.uint64)]), seed + 2) ^ np.uint64(len(tokens))
        out.append(int(mixed(h, seed + 4).view(np.int64)[0]))
    return out[0], out[1]


def _classes(size: int, num: int, den: int) -> int:
    """How many classes frequent tokens are dealt to when the smaller set has this size."""
    return 1 << max(0, ((den - num) * size // den)).bit_length() >> 1 or 1


def signatures(tokens: np.ndarray, scores: np.ndarray, frequent_from: float, num: int, den: int) -> np.ndarray:
    """The signatures of a set: of two sets with Jaccard of at least num / den, unless equal, one is the same."""
    n = len(tokens)
    spare = n - -(-num * n // den)
    # Rank by score, then by the token's leading bits; a stable sort of sorted tokens settles the rest alike everywhere.
    key = (scores.astype(np.uint64) << np.uint64(42)) | (tokens >> np.uint64(22))
    far = min(n, spare + _classes(n, num, den) + 2)
    near = np.flatnonzero(key <= np.partition(key, far - 1)[far - 1])
    ranked = tokens[near[np.argsort(key[near], kind="stable")]]
    # The frequent class ends the order: what is expected often, among what the map shows.
    rare = int((scores < _LATE + frequent_from).sum())
    found = [mixed(ranked[: min(rare, spare + 1)], 21)]
    if rare <= spare:
        smallest = -(-num * n // den)
        for m in {_classes(s, num, den) for s in (smallest, n)} | {_classes(1 << b, num, den) for b in range(smallest.bit_length(), n.bit_length())}:
            t = ranked[rare : spare + m + 1]
            kind = (mixed(t, 22) % np.uint64(m)).astype(np.int64)
            by = np.lexsort((t, kind))
            t, kind = t[by], kind[by]
            for gap in range(1, int(np.bincount(kind).max(initial=0))):
                same = kind[gap:] == kind[:-gap]
                found.append(mixed(mixed(t[:-gap][same], 23) + t[gap:][same] + np.uint64(m), 24))
    return np.unique(np.concatenate(found))


def sketch_of(tokens: np.ndarray) -> bytes:
    """For each of about as many bits as there are tokens, whether an odd number of these fall on it: two sets differ in as many tokens as their bits, at least."""
    bits = min(max(_SKETCH_BITS[0], 1 << (len(tokens) - 1).bit_length()), _SKETCH_BITS[1])
    at = (mixed(tokens, 41) % np.uint64(bits)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=bits) & 1).astype(np.uint8)).tobytes()


def _folded(sketch: bytes, size: int) -> np.ndarray:
    """The sketch of the same tokens with half as many bits, or less: bits that fall together are odd if one of them alone is."""
    return np.bitwise_xor.reduce(np.frombuffer(sketch, np.uint64).reshape(-1, size // 8), axis=0)


def may_link(sizes: np.ndarray, sketches: list[bytes], side: np.ndarray, num: int, den: int, groups: list[np.ndarray]) -> np.ndarray:
    """Which sets may be similar to another one by their sketches; side and groups are as in links_within(), and two sets of the same other group are not compared."""
    keep, cross, holders = np.zeros(len(sizes), bool), bool(side.any()), _holders(groups)
    lengths = np.array([len(x) for x in sketches])
    for size in np.unique(lengths).tolist():
        # Similar sets are not twice as large as one another, so their sketches aren't more than twice as long.
        near_size = np.flatnonzero((lengths == size) | (lengths == 2 * size))
        table = np.stack([_folded(sketches[i], size) for i in near_size.tolist()])
        for at in np.flatnonzero(lengths[near_size] == size).tolist():
            i = int(near_size[at])
            near = np.zeros(len(sizes), bool)
            near[near_size] = (den + num) * np.bitwise_count(table ^ table[at]).sum(axis=1, dtype=np.int64) <= (den - num) * (sizes[i] + sizes[near_size])
            near[i] = False
            if cross:
                near &= side != side[i]
            if near.any() and (met := [holders[g] for g in groups[i].tolist() if g in holders]):
                near[np.concatenate(met)] = False
            if near.any():
                keep |= near
                keep[i] = True
    return keep


def _holders(groups: list[np.ndarray]) -> dict[int, np.ndarray]:
    """The sets of each group; groups that one set alone is in say nothing here."""
    if not groups:
        return {}
    number, holder = np.concatenate(groups), np.repeat(np.arange(len(groups)), [len(g) for g in groups])
    names, of = np.unique(number, return_inverse=True)
    order = np.argsort(of, kind="stable")
    parts = np.split(holder[order], np.cumsum(np.bincount(of, minlength=len(names)))[:-1])
    return {g: x for g, x in zip(names.tolist(), parts) if len(x) > 1}


def links_within(sets: list[np.ndarray], side: np.ndarray, num: int, den: int, copies: np.ndarray | None = None, groups: list[np.ndarray] | None = None) -> tuple[list[tuple[int, int]], np.ndarray]:
    """A forest with the components of the similar pairs, and how many copies each set is linked with; side 0 is compared with itself, or with side 1 if there is one.

    Term at a time: each set adds one, for each of its tokens, to all sets that
    hold it. groups holds numbers of other groups of each set; the links of two
    sets that share one of these are not counted.
    """
    sizes = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), sizes)
    tokens, token = np.unique(np.concatenate(sets), return_inverse=True)
    by = np.argsort(token, kind="stable")
    posting, counts = owner[by], np.bincount(token, minlength=len(tokens))
    starts = np.cumsum(counts) - counts
    parent = list(range(len(sets)))
    copies = np.ones(len(sets), np.int64) if copies is None else copies
    linked = np.zeros(len(sets), np.int64)
    holders = _holders(groups or [])

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    cross, ends, out = bool(side.any()), np.cumsum(sizes), []
    for i in range(len(sets)):
        if cross and side[i]:
            continue
        own = token[ends[i] - sizes[i] : ends[i]]
        own = own[counts[own] > 1]
        length = counts[own]
        at = np.repeat(starts[own] - (np.cumsum(length) - length), length) + np.arange(length.sum())
        shared = np.bincount(posting[at], minlength=len(sets))
        near = den * shared >= num * (sizes[i] + sizes - shared)
        near &= (side == 1) if cross else (np.arange(len(sets)) > i)
        near &= shared > 0
        for j in np.flatnonzero(near).tolist():
            a, b = root(i), root(j)
            if a != b:
                parent[max(a, b)] = min(a, b)
                out.append((i, j))
        met = [holders[g] for g in groups[i].tolist() if g in holders] if holders and near.any() else []
        if met:
            near[np.concatenate(met)] = False
        linked[i] += copies[near].sum()
        linked[near] += copies[i]
    return out, linked


def _blocks(members: DataFrame, parts: Column) -> DataFrame:
    """Members of groups dealt to pairs of parts (a, b), of which side tells the second; parts is made of a group's nodes m and their tokens t."""
    sizes = members.groupBy("leader").agg(F.count("*").alias("m"), F.sum("n").alias("t"))
    own = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    dealt = members.join(sizes.select("leader", parts.cast("int").alias("parts")), "leader").withColumn("i", own).withColumn("k", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return dealt.select("node", "leader", "n", "parts", F.least("i", "k").alias("a"), F.greatest("i", "k").alias("b"), (F.col("i") > F.col("k")).cast("tinyint").alias("side"))


def _with_partners(members: DataFrame, sketches: DataFrame, num: int, den: int) -> DataFrame:
    """The members (leader, node, n) that may_link() within their group, by sketches (node, sketch). A pair counts in the group of its smallest leader alone."""

    @trimmed
    def compare(table: pa.Table) -> pa.Table:
        table = table.sort_by("leader")
        leaders, node, n, side = (table.column(k).combine_chunks().to_numpy() for k in ("leader", "node", "n", "side"))
        sketch, groups = table.column("sketch").to_pylist(), table.column("groups").to_pylist()
        keep = np.zeros(len(leaders), bool)
        ends = [*(np.flatnonzero(np.diff(leaders)) + 1).tolist(), len(leaders)]
        for a, b in zip([0, *ends], ends):
            smaller = [g[g < leaders[a]] for g in (np.array(x, np.int64) for x in groups[a:b])]
            keep[a:b] = may_link(n[a:b], sketch[a:b], side[a:b], num, den, smaller)
        return pa.table({"leader": leaders[keep], "node": node[keep], "n": n[keep]})

    dealt = _blocks(members, F.ceil(F.col("m") / _SKETCHES))
    # Groups of one part go together, about as many nodes at a time as a part has.
    together = members.count() // _SKETCHES + 1
    bundle = F.when(F.col("parts") == 1, -1 - F.pmod(F.xxhash64("leader"), F.lit(together))).otherwise(F.col("leader"))
    known = members.groupBy("node").agg(F.collect_set("leader").alias("groups")).join(sketches, "node")
    asking = dealt.withColumn("bundle", bundle).drop("parts").join(known, "node")
    return asking.groupBy("bundle", "a", "b").applyInArrow(compare, "leader bigint, node bigint, n bigint").distinct()


def similar_groups(docs: DataFrame, n: int = 4, num: int = 85, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_shingles, component_id, n_links and set_id of each row.

    Words are runs of anything but ASCII white space, with A-Z in lower case; a
    text's set holds its shingles of n words, or all its words as one if they
    are fewer. Rows link if den * intersection >= num * union; component_id is
    the smallest id reachable by links, n_links the number of other rows that
    the row links with. Null texts and texts without words have an empty set,
    which links with nothing. Every row takes part, rows with equal or null ids
    too; null ids are never a component's name if it has another. set_id is
    equal for rows with equal sets, null for empty ones. Other columns are not
    read; an empty table gives no row.
    """
    texts = docs.select(F.col(text_col).alias("text"))
    scores, total = word_scores(docs, text_col)
    seen_map = docs.sparkSession.sparkContext.broadcast(prefix_map(docs, text_col, n, scores, num, den))
    # Expected count of a shingle, total * product of its words' shares, on the scale of the scores.
    frequent_from = 16 * (np.log2(FREQUENT) + (n - 1) * np.log2(max(total, 1)))

    @releasing
    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Size and digest of each row's set, and the signatures and sketch of the first of equal sets in the task."""
        seen: set[tuple[int, int]] = set()
        for rows in _steps(batches):
            out = []
            for tokens, own in _sets_with_scores(rows.column(1).to_pylist(), n, scores):
                d, sigs, sketch = digest_of(tokens), None, None
                if len(tokens) and d not in seen:
                    seen.add(d)
                    sigs = signatures(tokens, own + _LATE * _late(tokens, seen_map.value), frequent_from, num, den).view(np.int64)
                    sketch = sketch_of(tokens)
                out.append((len(tokens), *d, sigs, sketch))
            if out:
                ns, ds, es, sigs, sketches = zip(*out)
                columns = [*[pa.array(x, pa.int64()) for x in (ns, ds, es)], pa.array(sigs, pa.list_(pa.int64())), pa.array(sketches, pa.binary())]
                yield pa.RecordBatch.from_arrays([rows.column(0), *columns], ["id", "n", "d", "e", "sigs", "sketch"])

    kind = docs.schema[id_col].dataType.simpleString()
    described = written(docs.select(F.col(id_col).alias("id"), F.col(text_col)).mapInArrow(describe, f"id {kind}, n bigint, d bigint, e bigint, sigs array<bigint>, sketch binary"), "sets")
    # Different sets are numbered; the written numbers stay as they are.
    nodes = written(described.where("n > 0").groupBy("d", "e").agg(F.min("id").alias("id"), F.count("*").alias("copies")).withColumn("node", F.monotonically_increasing_id()), "nodes")
    signed = described.where("sigs IS NOT NULL")
    postings = signed.join(nodes.select("d", "e", "node"), ["d", "e"]).select(F.explode("sigs").alias("sig"), "node", "n")
    # A node that several tasks have signed may count twice here; its leader is then itself, and goes below.
    shared = signed.select(F.explode("sigs").alias("sig")).groupBy("sig").count().where("count > 1").select("sig")
    held = written(postings.join(shared, "sig"), "postings")
    # Where sorted sizes jump by more than similar sets can differ, no pair crosses. The windows see each size of a signature once.
    sized = held.groupBy("sig", "n").agg(F.min("node").alias("lo"), F.max("node").alias("hi"))
    by_size = Window.partitionBy("sig").orderBy("n")
    jump = F.coalesce((den * F.lag("n").over(by_size) < num * F.col("n")).cast("int"), F.lit(0))
    run = Window.partitionBy("sig", "run")
    runs = sized.withColumn("jump", jump).withColumn("run", F.sum("jump").over(by_size.rowsBetween(Window.unboundedPreceding, 0)))
    led = runs.withColumns({"leader": F.min("lo").over(run), "last": F.max("hi").over(run)}).where("leader <> last").select("sig", "n", "leader")
    met = written(held.join(led, ["sig", "n"]).select("leader", "node", "n").distinct(), "groups")
    discard(held)
    sketches = signed.select("d", "e", "sketch").join(nodes.select("d", "e", "node"), ["d", "e"]).join(met.select("node").distinct(), "node", "left_semi").groupBy("node").agg(F.first("sketch").alias("sketch"))
    members = written(_with_partners(met, sketches, num, den), "partners")
    discard(met)
    dealt = _blocks(members, F.greatest(F.least(F.ceil(F.col("m") / _BLOCK), F.lit(_PARTS)), F.ceil(F.col("t") / _TOKENS))).drop("n", "parts")

    @releasing
    def tokens_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for rows in _steps(batches):
            out = []
            for s in shingle_sets(rows.column(0).to_pylist(), n):
                d = digest_of(s)
                if len(s) and d not in seen and _late(np.array([d[0]]).view(np.uint64), asked.value)[0]:
                    seen.add(d)
                    # Six bytes tell the tokens of two documents apart.
                    out.append((*d, s.view(np.uint8).reshape(-1, 8)[:, :6].tobytes()))
            if out:
                ds, es, tokens = zip(*out)
                yield pa.RecordBatch.from_arrays([pa.array(ds, pa.int64()), pa.array(es, pa.int64()), pa.array(tokens, pa.binary())], ["d", "e", "tokens"])

    # A node's groups are no more than its signatures.
    needed = written(members.groupBy("node").agg(F.collect_set("leader").alias("groups")).join(nodes, "node").select("d", "e", "node", "copies", "groups"), "members")
    asked = docs.sparkSession.sparkContext.broadcast(_asked_map(needed.select("d")))
    # Tokens are dealt by digest once, for both joins and for keeping one of each set.
    sets = texts.mapInArrow(tokens_of, "d bigint, e bigint, tokens binary").join(needed.select("d", "e"), ["d", "e"], "left_semi").groupBy("d", "e").agg(F.first("tokens").alias("tokens"))
    asking = dealt.join(needed, "node")

    @trimmed
    def compare(table: pa.Table) -> pa.Table:
        node, found = table.column("node").to_pylist(), []
        for x in table.column("tokens").to_pylist():
            wide = np.zeros((len(x) // 6, 8), np.uint8)
            wide[:, :6] = np.frombuffer(x, np.uint8).reshape(-1, 6)
            found.append(wide.view(np.uint64).reshape(-1))
        leader = table.column("leader")[0].as_py()
        groups = [own[own < leader] for own in (np.array(x, np.int64) for x in table.column("groups").to_pylist())]
        side, copies = (table.column(k).combine_chunks().to_numpy() for k in ("side", "copies"))
        pairs, linked = links_within(found, side, num, den, copies, groups)
        rows = [(node[i], node[j], 0) for i, j in pairs] + [(x, None, n) for x, n in zip(node, linked.tolist()) if n]
        return pa.table([pa.array(list(c), pa.int64()) for c in (zip(*rows) if rows else ((), (), ()))], ["a", "b", "n"])

    links = written(asking.join(sets, ["d", "e"]).drop("d", "e").groupBy("leader", "a", "b").applyInArrow(compare, "a bigint, b bigint, n bigint"), "similar")
    discard(members, needed)
    seen_map.destroy()
    asked.destroy()
    roots = connected_components(links.where("b IS NOT NULL").select("a", "b"))
    counts = links.where("b IS NULL").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("links"))
    rooted = nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    names = rooted.groupBy("root").agg(F.min("id").alias("component_id"))
    named = rooted.join(names, "root").join(counts, "node", "left")
    named = written(named.select("d", "e", "node", "component_id", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")), "classes")
    discard(links, nodes)
    out = described.drop("sigs", "sketch").join(named, ["d", "e"], "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), F.col("node").alias("set_id"))


def keep_one(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each component of similar rows: the one with the smallest id.

    Rows with empty sets are in no component and stay. Of several rows with the
    kept id, one for each different text stays; rows with null ids stay in
    components of their own kind only, or all of them where one does. All
    columns stay as they are.
    """
    d, c, h, g = (fresh(docs, x) for x in ("_id", "_component", "_hash", "_goes"))
    groups = similar_groups(docs, n, num, den, id_col, text_col).where("n_shingles > 0").select(F.col(id_col).alias(d), F.col("component_id").alias(c))
    # Ids that go, and those of several rows, which may differ.
    ids = groups.groupBy(d).agg(F.count("*").alias(h), (~F.max(F.col(d).eqNullSafe(F.col(c)))).alias(g))
    asked = written(ids.where(F.col(g) | (F.col(h) > 1)).select(d, g, h), "asked")
    empty = ~F.coalesce(F.col(text_col), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    here = _held_by(docs.sparkSession, asked.select(F.xxhash64(d)))(F.xxhash64(id_col))
    # Only documents whose ids may be asked for are shuffled; all others stay where they are read.
    met = docs.where(~empty & here).join(asked.where(g).select(d), F.col(id_col).eqNullSafe(F.col(d)), "left_anti")
    if asked.where((F.col(h) > 1) & ~F.col(g)).limit(1).count():
        met = met.withColumn(h, F.xxhash64(text_col)).dropDuplicates([id_col, h]).drop(h)
    return met.unionByName(docs.where(empty | ~here))


def _held_by(spark: SparkSession, digests: DataFrame) -> Callable[[Column], Column]:
    """Tells of digests whether they may be among these; of most others it says no."""
    held = spark.sparkContext.broadcast(_asked_map(digests))

    def run(column: pa.Array) -> pa.Array:
        return pa.array(_late(column.to_numpy(zero_copy_only=False).view(np.uint64), held.value))

    return F.arrow_udf(run, "boolean")
