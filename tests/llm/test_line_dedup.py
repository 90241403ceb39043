import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from meterloom.llm import line_dedup, queries
from meterloom.llm.line_dedup import PerfectHash

SPACE = " \t\n\x0b\x0c\r"


def key(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(SPACE))


def brute(texts, least):
    seen = Counter(k for t in texts for k in {key(x) for x in (t or "").split("\n")} if k)
    out = []
    for t in texts:
        lines = (t or "").split("\n")
        kept = [x for x in lines if seen[key(x)] < least]
        out.append((len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return out


def test_perfect_hash_numbers_without_gaps():
    keys = np.unique(np.random.default_rng(0).integers(0, 2**63, 20000).astype(np.uint64))
    for n in (0, 1, 2, len(keys)):
        mph = PerfectHash.build(keys[:n])
        assert sorted(mph.number(keys[:n]).tolist()) == list(range(n))
    assert len(mph.bits) < 4 * len(keys)


def test_op7_equals_brute_force(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").collect()
    want = {(r.doc_id, *x) for r, x in zip(rows, brute([r.text for r in rows], 10))}
    got = {tuple(r) for r in queries.op7_line_dedup(spark, sf).select("doc_id", "n_lines", "n_dropped", "kept_sha256").collect()}
    assert got == want and sum(x[2] for x in want)


def test_every_hit_is_an_answer_of_a_shard(spark, sf):
    """What frequent_lines() finds comes from the shards alone, each frequent line of a part once."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumn("part", F.pmod("doc_id", F.lit(3)).cast("int"))
    index, shards, _ = line_dedup.line_index(docs)
    found = line_dedup.frequent_lines(docs, 10, index, shards, "part").collect()
    got = Counter((r.part, bytes(r.hashes[i : i + 16])) for r in found for i in range(0, len(r.hashes), 16))
    rows = docs.collect()
    seen = Counter(k for r in rows for k in {key(x) for x in r.text.split("\n")} if k)
    want = {(r.part, line_dedup._digest(k.encode())) for r in rows for k in {key(x) for x in r.text.split("\n")} if seen[k] >= 10}
    assert set(got) == want and set(got.values()) == {1}
    nothing = index.where("shard < 0")
    assert line_dedup.frequent_lines(docs, 10, nothing, shards, "part").count() == 0


def test_shard_counts_and_folding(monkeypatch):
    """A shard answers for each of its lines, also if two of them fold to one key at first."""
    rng = np.random.default_rng(1)
    a, b = (rng.integers(-(2**62), 2**62, 500) for _ in range(2))
    n = rng.integers(1, 10**6, 500)
    table = pa.table({"shard": pa.array([3] * 500, pa.int32()), "a": a, "b": b, "n": n})
    folded = line_dedup._folded
    for broken in (0, 1):
        monkeypatch.setattr(line_dedup, "_folded", lambda x, y, seed: folded(x, y, seed) * np.uint64(seed > broken))
        index = line_dedup._build_shard(table).to_pylist()[0]
        assert index["seed"] == 1 + broken
        assert line_dedup.probe(index, a, b).tolist() == n.tolist()
        assert not line_dedup.probe(index, a, b + 1).any()


def test_edge_cases(spark, monkeypatch):
    texts = [None, "", "\n\n", "A b\nown", " a B\x0b\nÉ", "a b\r\né\nx\n", "a b", "a b", "é" * 50000 + "\na b", "a b\u00a0", "A B\n\nA B"]
    ids = [1, 2, 3, None, None, 6, 7, 7, 8, 9, 10]
    docs = spark.createDataFrame([(i, t, "h", 5, 1) for i, t in zip(ids, texts)], "doc_id bigint, text string, _hashes string, _n_lines int, _part int")
    for size in (50_000, 1):  # few parts and shards, and many
        monkeypatch.setattr(line_dedup, "PART_LINES", size)
        monkeypatch.setattr(line_dedup, "SHARD_KEYS", size)
        out = line_dedup.drop_frequent_lines(docs, min_docs=4, digest=True)
        assert out.columns == ["doc_id", "_hashes", "_n_lines", "_part", "__n_lines", "_n_dropped", "_kept_sha256"]
        got = sorted((r[4], r[5], r[6]) for r in out.collect())
        assert got == sorted(brute(texts, 4))
    out = line_dedup.drop_frequent_lines(docs, min_docs=4)
    kept = {(r.doc_id, r.text) for r in out.collect()}
    assert {(1, None), (None, "own"), (7, ""), (10, ""), (9, "a b\u00a0"), (3, "\n\n")} <= kept
    assert line_dedup.drop_frequent_lines(docs.limit(0)).count() == 0


def test_many_parts_share_a_shard_and_a_partition(spark, monkeypatch):
    """More parts than meet a shard in one task, and than there are partitions."""
    monkeypatch.setattr(line_dedup, "PART_LINES", 1)
    monkeypatch.setattr(line_dedup, "ASKERS", 4)
    monkeypatch.setattr(line_dedup, "MOST_PARTITIONS", 3)
    texts = [f"common\nonly {i}\npair {i // 2}\n\nCOMMON " for i in range(30)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    out = line_dedup.drop_frequent_lines(docs, min_docs=3, digest=True)
    assert sorted((r[1], r[2], r[3]) for r in out.collect()) == sorted(brute(texts, 3))
