import re
from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline
from meterloom.llm.shared import written

from .test_line_dedup import key
from .test_ngram_join import brute


def test_stages_by_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, schema = docs.columns, docs.schema.simpleString()
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language", "lines", "near_duplicates", "secrets", "packing"]
    first = {r.doc_id: r.text for r in docs.collect()}

    docs = written(stages["language"](spark, docs, sf), "t")
    assert docs.schema.simpleString() == schema
    assert {r.doc_id: r.text for r in docs.collect()} == first  # all are clean

    docs = written(stages["lines"](spark, docs, sf), "t")
    seen = Counter(k for t in first.values() for k in {key(x) for x in t.split("\n")} if k)
    want = {i: "\n".join(x for x in t.split("\n") if seen[key(x)] < 10) for i, t in first.items()}
    assert {r.doc_id: (r.text, r.n_chars) for r in docs.collect()} == {i: (t, len(t)) for i, t in want.items()}

    docs = written(stages["near_duplicates"](spark, docs, sf), "t")
    names = brute(want, 5, 80)
    kept = {i: want[i] for i, (n, c, _) in names.items() if n == 0 or c == i}
    assert {r.doc_id: r.text for r in docs.collect()} == kept and len(kept) < len(want)

    docs = written(stages["secrets"](spark, docs, sf), "t")
    assert docs.columns == columns
    masked = {i: re.sub(r'(token = ")[0-9a-f]{40}(")', r"\1[SECRET]\2", t) for i, t in kept.items()}
    assert {r.doc_id: r.text for r in docs.collect()} == masked

    pieces = stages["packing"](spark, docs, sf).collect()
    assert {r.doc_id for r in pieces} == set(masked)
    assert sorted(map(tuple, pieces)) == sorted(map(tuple, corpus_pipeline.run(spark, sf).collect()))


def test_empty_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, sf), "t")
        assert docs.count() == 0


def test_odd_documents(spark, sf):
    """Null, empty and very long texts, repeated rows, null and equal ids, and columns with names that stages use themselves."""
    base = spark.read.parquet(f"{sf}/documents.parquet")
    some = [r.text for r in base.where("lang = 'en'").orderBy("doc_id").limit(6).collect()]
    rows = [(1, some[0]), (2, some[0]), (3, None), (4, ""), (5, "12 !?"), (None, some[1]), (None, some[2]), (7, some[3]), (7, some[4]), (8, some[3]), (9, some[5] + (" " + some[1]) * 300)]
    teach = base.select("doc_id", "text", "lang", "source", "n_chars").where("doc_id > 60")
    odd = spark.createDataFrame([(i, t, None, "s", 0) for i, t in rows], teach.schema)
    names = ["score", "_scored", "_part", "_hashes", "prediction", "length", "_start", "row", "value", "n", "d", "node", "_component"]
    docs = teach.unionByName(odd).select("*", *[F.lit(k).alias(c) for k, c in enumerate(names)])
    stages, first = dict(corpus_pipeline.STAGES), docs
    for name in list(stages)[:-1]:
        docs = written(stages[name](spark, docs, sf), "t")
        assert docs.columns == first.columns
        assert [docs.where(~F.col(c).eqNullSafe(F.lit(k))).count() for k, c in enumerate(names)] == [0] * len(names), name
    kept = [(r.doc_id, r.text) for r in docs.where("source = 's'").collect()]
    ids = Counter(i for i, _ in kept)
    assert not ids.keys() & {2, 3, 4, 5} and ids[1] == 1 and ids[None] == 2 and ids[9] == 1
    assert ids[7] + ids[8] >= 1 and all(t for _, t in kept)
    pieces = stages["packing"](spark, docs, sf).collect()
    assert {r.doc_id for r in pieces} == {r.doc_id for r in docs.select("doc_id").collect()}
