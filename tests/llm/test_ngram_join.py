from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from meterloom.llm import ngram_join, queries
from meterloom.llm.components import connected_components
from meterloom.llm.ngram_join import keep_one, links_within, signatures, similar_groups


def words_of(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()


def brute(texts, n, num, den=100):
    """(set size, smallest id of the component, links) by comparing all sets that share a shingle."""
    sets, parent, links = {}, {}, Counter()
    for i, t in texts.items():
        w = words_of(t)
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())
        parent[i] = i

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    index = {}
    for i, s in sets.items():
        for t in s:
            index.setdefault(t, []).append(i)
    for i, s in sets.items():
        for j, o in Counter(j for t in s for j in index[t] if j != i).items():
            if den * o >= num * (len(s) + len(sets[j]) - o):
                links[i] += 1
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return {i: (len(sets[i]), root(i), links[i]) for i in texts}


def test_op1_equals_brute_force(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in queries.op1_ngram_join(spark, sf).collect()}
    assert got == brute(texts, 4, 85)


def test_near_copies_of_many_and_blocks(spark, monkeypatch):
    """A group far larger than a block, whose members are not all alike, among other texts."""
    rng = np.random.default_rng(5)
    base = [f"w{x}" for x in rng.integers(0, 5000, 120)]
    texts = {}
    for i in range(400):
        w = list(base)
        for k in rng.integers(0, 120, int(rng.integers(0, 4))):
            w[k] = f"x{rng.integers(0, 10**9)}"
        texts[i] = " ".join(w)
    for i in range(400, 600):
        texts[i] = " ".join(f"w{x}" for x in rng.integers(0, 300, int(rng.integers(1, 90)))) + (" " + " ".join(base[:60]) if i % 3 == 0 else "")
    monkeypatch.setattr(ngram_join, "_BLOCK", 16)
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    want = brute(texts, 4, 85)
    assert len({c for _, c, _ in want.values()}) < 600
    full = np.full(ngram_join._SEEN // 8, 255, np.uint8)
    for seen in (None, full):  # with the map of shingles in several prefixes, and with one that tells nothing
        if seen is not None:
            monkeypatch.setattr(ngram_join, "prefix_map", lambda *_: full)
        got = {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in similar_groups(docs).collect()}
        assert got == want


def test_edge_cases(spark):
    long = " ".join(f"q{i}" for i in range(30000))
    rows = [(5, None), (6, ""), (7, " \t\n"), (3, "A b"), (9, "a  B"), (4, "a b c"), (None, "a b"), (8, long), (2, long + " z"), (1, "Q W e r t y"), (1, "q w e r t y"), (1, "q w e r t y u"), (None, "solo text of five words")]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id bigint, text string, n string, d int")
    found = similar_groups(docs).collect()
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in found]
    assert Counter(r.n_links for r in found if r.n_shingles > 0) == Counter([2, 2, 2, 0, 1, 1, 1, 1, 0, 0]), found
    key = lambda x: tuple((v is None, v) for v in x)
    want = [(5, 0, 5), (6, 0, 6), (7, 0, 7), (3, 1, 3), (9, 1, 3), (4, 1, 4), (None, 1, 3), (8, 29997, 2), (2, 29998, 2), (1, 3, 1), (1, 3, 1), (1, 4, 1), (None, 2, None)]
    assert sorted(got, key=key) == sorted(want, key=key)
    assert similar_groups(docs.limit(0)).count() == 0


@pytest.mark.parametrize("share", [0, 0.5, 1])
def test_similar_sets_share_a_signature(share):
    """Whatever part of the tokens is of the frequent class."""
    rng = np.random.default_rng(int(share * 10))
    for _ in range(300):
        n = int(rng.integers(7, 400))
        pool = rng.integers(0, 2**63, n + 60).astype(np.uint64)
        late = ngram_join._LATE + 1000
        of = {int(t): int(late + rng.integers(0, 9) if rng.random() < share else rng.integers(0, 9)) for t in pool}
        a = np.unique(pool[:n])
        cut = int(rng.integers(0, max(1, n // 12)))
        b = np.unique(np.concatenate((a[cut:], pool[n : n + int(rng.integers(0, max(1, n // 12)))])))
        o = len(np.intersect1d(a, b))
        if 100 * o < 85 * (len(a) + len(b) - o) or len(a) == len(b) == o:
            continue
        sa, sb = (signatures(s, np.array([of[int(t)] for t in s]), 500.0, 85, 100) for s in (a, b))
        assert len(np.intersect1d(sa, sb)), (n, len(a), len(b), o)
        assert len(sa) < 2 * len(a) + 10


def test_links_within_is_exact():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 60, int(rng.integers(1, 50))).astype(np.uint64)) for _ in range(60)]
    similar = {(i, j) for i in range(60) for j in range(i + 1, 60) if 100 * (o := len(np.intersect1d(sets[i], sets[j]))) >= 50 * (len(sets[i]) + len(sets[j]) - o)}
    found, linked = links_within(sets, np.zeros(60, int), 50, 100)
    assert set(found) <= similar and linked.tolist() == [sum(i in p for p in similar) for i in range(60)]
    side, copies = np.arange(60) % 2, rng.integers(1, 9, 60)
    other = [np.array([i % 3], np.int64) for i in range(60)]
    _, linked = links_within(sets, side, 50, 100, copies, other)
    crossing = [p for p in similar if side[p[0]] != side[p[1]] and p[0] % 3 != p[1] % 3]
    assert linked.tolist() == [sum(copies[p[0] + p[1] - i] for p in crossing if i in p) for i in range(60)]

    def groups(pairs):
        p = list(range(60))
        def r(x):
            while p[x] != x:
                x = p[x]
            return x
        for a, b in pairs:
            p[r(a)] = r(b)
        return [[r(i) == r(j) for j in range(60)] for i in range(60)]

    assert groups(found) == groups(similar)


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 50), (50, 100), (7, 7), (200, 100), (-5, -9)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {i: 0 for i in range(41)} | {50: 50, 100: 50, 200: 50, -5: -9, -9: -9}
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_keep_one(spark):
    text = " ".join(f"k{i}" for i in range(60))
    rows = [(3, text, "a"), (2, text + " end", "b"), (9, "other words stand here now ok", "c"), (4, None, "d"), (5, "", "e"), (2, text + " end", "f")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, _id string")
    got = keep_one(docs)
    assert got.columns == docs.columns and sorted(r.doc_id for r in got.collect()) == [2, 4, 5, 9]


def test_keep_one_shuffles_only_what_is_asked_for(spark):
    """Documents without a near copy stay in the partition that they were read in, whatever the number of ids that are kept."""
    words = lambda i: F.concat_ws(" ", F.transform(F.sequence(F.lit(1), F.lit(30)), lambda k: F.concat(F.lit("w"), i * 1000 + k)))
    docs = spark.range(0, 400, 1, 4).select(F.col("id").alias("doc_id"), words(F.when(F.col("id") == 307, 7).otherwise(F.col("id"))).alias("text"), F.floor(F.col("id") / 100).alias("part"))
    docs = docs.union(docs.where("doc_id = 11")).union(docs.where("doc_id = 12").withColumn("text", words(F.lit(5000))))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        got = keep_one(docs).withColumn("now", F.spark_partition_id()).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert sorted(r.doc_id for r in got) == sorted([*set(range(400)) - {307}, 12])
    parts = {}
    for r in got:
        if r.doc_id not in (11, 12):
            parts.setdefault(r.now, set()).add(r.part)
    assert sorted(parts.values(), key=min) == [{0}, {1}, {2}, {3}]


def test_sketches_lose_no_similar_sets():
    """Sets that are similar keep each other, whatever their sizes and the parts they stand in; most others go."""
    rng = np.random.default_rng(11)
    sets = [np.unique(rng.integers(0, 2**62, int(k)).astype(np.uint64)) for k in (1, 5, 60, 64, 127, 129, 500, 1030, 3000, 70000)]
    sets += [np.unique(np.concatenate([s[: len(s) - len(s) // 16], rng.integers(0, 2**62, len(s) // 16).astype(np.uint64)])) for s in sets]
    sets += [s[: -(-len(s) * 86 // 100)] for s in sets[:10]] + [np.unique(rng.integers(0, 2**62, 200).astype(np.uint64)) for _ in range(30)]
    sizes, sketches = np.array([len(s) for s in sets]), [ngram_join.sketch_of(s) for s in sets]
    none = [np.zeros(0, np.int64)] * len(sets)
    for side in (np.zeros(len(sets), np.int8), (np.arange(len(sets)) // 10 % 2).astype(np.int8)):
        links, _ = links_within(sets, side, 85, 100)
        similar = {x for pair in links for x in pair}
        kept = set(np.flatnonzero(ngram_join.may_link(sizes, sketches, side, 85, 100, none)).tolist())
        assert similar and similar <= kept and len(kept) <= len(similar) + 2
    # Two sets that share another group are compared there.
    one = [np.array([7])] * len(sets)
    assert not ngram_join.may_link(sizes, sketches, np.zeros(len(sets), np.int8), 85, 100, one).any()


def test_sets_that_only_share_a_signature_are_not_sent(spark, monkeypatch):
    """With a full map, texts with a common passage meet in groups; the sets of those that are too different are not sent there."""
    rng = np.random.default_rng(3)
    passage = [f"p{i}" for i in range(12)]
    texts = {i: " ".join([f"w{x}" for x in rng.integers(0, 20, 60)] + passage) for i in range(200)}
    texts[300] = texts[7] + " and one more"
    sent = {}
    writing = ngram_join.written
    monkeypatch.setattr(ngram_join, "written", lambda df, name: sent.setdefault(name, writing(df, name).cache()))
    monkeypatch.setattr(ngram_join, "prefix_map", lambda *_: np.full(ngram_join._SEEN // 8, 255, np.uint8))
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in similar_groups(docs).collect()}
    assert got == brute(texts, 4, 85)
    assert sent["nodes"].count() == 201 and sent["members"].count() <= 10


def test_keep_one_sends_few_sets_with_a_full_map(spark, monkeypatch):
    """As in the pipeline's third stage: texts that share a passage meet in groups, and only near copies are sent there."""
    rng = np.random.default_rng(8)
    passage = [f"p{i}" for i in range(14)]
    texts = {i: " ".join([f"w{x}" for x in rng.integers(0, 20, 50)] + passage) for i in range(150)}
    texts[200], texts[201] = texts[9] + " one", texts[9] + " two"
    sent = {}
    writing = ngram_join.written
    monkeypatch.setattr(ngram_join, "written", lambda df, name: sent.setdefault(name, writing(df, name).cache()))
    monkeypatch.setattr(ngram_join, "prefix_map", lambda *_: np.full(ngram_join._SEEN // 8, 255, np.uint8))
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    got = sorted(r.doc_id for r in keep_one(docs).collect())
    assert got == sorted({c for _, c, _ in brute(texts, 5, 80).values()}) == list(range(150))
    assert sent["members"].count() <= 10
