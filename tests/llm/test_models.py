"""Top-k, language ID, secrets and BPE."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from meterloom.llm import bpe, langid, queries, secrets, topk

BYTE = queries.tokenizer_path("byte_bpe_50k.json")


def brute_topk(rows, k, scale=64.0):
    vs = []
    for i, v in rows:
        if v is not None and all(x is not None and np.isfinite(x) for x in v):
            vs.append((i, [int(np.floor(scale * float(np.float32(x)))) for x in v]))
    out = []
    for i, q in vs:
        if i is not None and i % 20 == 0:
            best = sorted((-sum(a * b for a, b in zip(q, v)), j) for j, v in vs if j != i)[:k]
            out += [(i, r, j, -s) for r, (s, j) in enumerate(best, 1)]
    return sorted(out)


def test_op2_equals_brute_force(spark, sf):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    got = sorted(tuple(r) for r in queries.op2_topk(spark, sf).select("query_id", "rank", "vec_id", "score").collect())
    assert got == brute_topk(rows, 20)


def test_topk_edge_cases(spark, monkeypatch):
    rng = np.random.default_rng(0)
    rows = [(i, rng.normal(size=8).round(1).tolist()) for i in range(150)] + [(20, None), (160, [1.0, None] * 4), (161, [float("nan")] * 8), (162, [float("inf")] * 8), (163, []), (164, [1e6] * 8)]
    rows = [r for r in rows if r[0] != 20] + [(165, [0.0] * 8)]
    docs = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id bigint, embedding array<float>, v int")
    monkeypatch.setattr(topk, "CANDIDATES", 40)
    monkeypatch.setattr(topk, "QUERIES", 3)
    got = sorted(tuple(r) for r in topk.search(docs, 20, F.col("vec_id") % 20 == 0).collect())
    assert got == brute_topk(rows, 20)
    for huge in ([1e30] * 8, [3e16] * 8):
        with pytest.raises(Exception, match="beyond 2|may not fit"):
            topk.search(spark.createDataFrame([(20, huge), (1, huge)], "vec_id bigint, embedding array<double>"), 2, F.col("vec_id") % 20 == 0).collect()
    few = docs.where("vec_id in (0, 1, 2)")
    assert len(topk.search(few, 20, F.col("vec_id") % 20 == 0).collect()) == 2
    assert topk.search(docs.limit(0), 20, F.col("vec_id") % 20 == 0).count() == 0


def test_op9_held_out_accuracy(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    got = queries.op9_langid(spark, sf).join(docs, "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert len(got) == docs.count() and len(held) > 40
    assert np.mean([r.lang_pred == r.lang for r in held if r.lang]) > 0.97
    assert all(0 <= r.score <= 1 for r in got) and not any(r.rejected for r in got)


def grams(text):
    """Counts of 1-, 2- and 3-grams of letters and single spaces, without the operator's code."""
    kept = "".join(c if c.isalpha() else " " for c in f" {text.lower()} ")
    kept = re.sub(" +", " ", kept)
    return Counter(kept[i : i + n] for n in (1, 2, 3) for i in range(len(kept) - n + 1))


def test_op9_equals_brute_force(spark, sf):
    """Idf, vectors and cosines with n-grams in place of hash buckets, against each document's nearest of the model's centroids.

    Buckets that n-grams share move cosines a little, so scores agree roughly and labels nearly always.
    """
    rows = [r for r in spark.read.parquet(f"{sf}/documents.parquet").collect() if r.text]
    taught = [r for r in rows if r.lang and zlib.crc32(str(r.doc_id).encode()) % 3 != 1]
    found = {r.doc_id: grams(r.text) for r in rows}
    df = Counter(g for r in taught for g in found[r.doc_id])
    idf = lambda g: math.log((1 + len(taught)) / (1 + df[g])) + 1

    def vector(counts):
        w = {g: (1 + math.log(n)) * idf(g) for g, n in counts.items()}
        norm = math.sqrt(sum(x * x for x in w.values()))
        return {g: x / norm for g, x in w.items()}

    vectors = {i: vector(c) for i, c in found.items()}
    # One centroid a language stands for its clusters: labels of the nearest of several are compared with it.
    centers = {}
    for lang in {r.lang for r in taught}:
        own = [vectors[r.doc_id] for r in taught if r.lang == lang]
        mean = Counter()
        for v in own:
            for g, x in v.items():
                mean[g] += x
        norm = math.sqrt(sum(x * x for x in mean.values()))
        centers[lang] = {g: x / norm for g, x in mean.items()}
    got = {r.doc_id: r for r in queries.op9_langid(spark, sf).collect()}
    same, off = 0, []
    for r in rows:
        cosines = {lang: sum(x * c.get(g, 0.0) for g, x in vectors[r.doc_id].items()) for lang, c in centers.items()}
        best = max(cosines, key=cosines.get)
        same += got[r.doc_id].lang_pred == best
        off.append(got[r.doc_id].score - cosines[best])
    assert same / len(rows) > 0.99
    assert abs(np.median(off)) < 0.1


def test_language_model_by_its_definition(spark):
    """predict() is idf, weights and cosines as the module's text says, bucket by bucket."""
    texts = [("the cat and the dog sat on the mat", "en"), ("der hund und die katze auf der matte", "de")] * 8
    docs = spark.createDataFrame([(i, f"{t} {i}", lang) for i, (t, lang) in enumerate(texts)], "doc_id bigint, text string, lang string")
    model = langid.fit(docs)
    asked = "the dog and der hund"
    at, counts = langid.buckets_of(asked)
    holders = np.zeros(langid.BUCKETS)
    for i, (t, _) in enumerate(texts):
        holders[langid.buckets_of(f"{t} {i}")[0]] += 1
    w = (1 + np.log(counts)) * (np.log((1 + len(texts)) / (1 + holders[at])) + 1)
    cosines = model.centroids[:, at] @ (w / np.linalg.norm(w))
    lang, score, _ = model.predict(asked)
    assert lang == model.languages[int(cosines.argmax())] and abs(score - cosines.max()) < 1e-5
    assert np.allclose(np.linalg.norm(model.centroids, axis=1), 1, atol=1e-5)


def test_langid_edge_cases(spark, sf):
    train = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang")
    model = langid.fit(train.unionByName(spark.createDataFrame([(None, "x", None), (1, None, "en"), (2, "12", "zz")], "doc_id bigint, text string, lang string")))
    texts = [None, "", "123 !?", "the and of that", "The And Of That", "漢字文章日本語", "éé", "a" * 100000]
    docs = spark.createDataFrame([(i, t, 0.5) for i, t in enumerate(texts)], "doc_id bigint, text string, score double")
    got = {r.doc_id: r for r in langid.predict(docs, model).collect()}
    assert [got[i].lang_pred for i in range(3)] == ["und"] * 3 and all(got[i].rejected and got[i].score == 0 for i in range(3))
    assert got[3].lang_pred == got[4].lang_pred == "en" and got[3].score == got[4].score and not got[3].rejected
    assert got[5].rejected and got[5].lang_pred in ("en", "de", "fr", "es")
    assert [c for c in langid.recognised(docs, model).columns] == docs.columns and {r.doc_id: r.score for r in langid.recognised(docs, model).collect()}[3] == 0.5
    none = langid.fit(train.limit(0))
    assert {r.lang_pred for r in langid.predict(docs, none).collect()} == {"und"}
    assert langid.predict(docs.limit(0), model).count() == 0


def test_langid_rejects_a_language_that_it_did_not_learn(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("text", "lang").where("text IS NOT NULL")
    odd = spark.createDataFrame([("zq xj", lang) for lang in ("en", "fr", "es")], "text string, lang string")
    model = langid.fit(docs.where("lang <> 'de'").unionByName(odd))
    short = docs.select(F.substring("text", 1, 20).alias("text"), F.lit("short").alias("part"), "lang")
    rows = langid.predict(docs.select("text", F.lit("whole").alias("part"), "lang").unionByName(short), model).collect()
    share = lambda part, german: np.mean([r.rejected for r in rows if r.part == part and r.lang and (r.lang == "de") == german])
    assert share("whole", True) > 0.9 and share("short", True) > 0.6
    assert share("whole", False) < 0.02 and share("short", False) < 0.05


def test_op10_findings(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    planted = {(i, m.start(1), m.end(1)) for i, t in docs.items() for m in __import__("re").finditer(r'token = "([0-9a-f]{40})"', t)}
    got = {(r.doc_id, r.start, r.end) for r in queries.op10_secrets(spark, sf).collect()}
    assert got == planted


def test_forest_on_forms_that_it_did_not_learn(spark, sf):
    """Findings are split by form: each fold's forms are new to the forest that scores them."""
    corpus = secrets.count_words(spark.read.parquet(f"{sf}/documents.parquet"))
    labelled = secrets.labelled_findings(spark, 3200)
    hit = Counter()
    for fold in range(4):
        held = F.col("form") % 4 == fold
        scored = secrets.train(labelled.where(~held), corpus).scores(labelled.where(held))
        for r in scored.groupBy("label", (F.col("score") >= secrets.THRESHOLD).alias("said")).count().collect():
            hit[r.label == 1, r.said] += r["count"]
    precision, recall = hit[True, True] / (hit[True, True] + hit[False, True]), hit[True, True] / (hit[True, True] + hit[True, False])
    print(f"precision {precision:.3f}, recall {recall:.3f}")
    assert precision > 0.8 and recall > 0.8


def test_secret_features_by_brute_force(spark, sf):
    """Words, letter pairs and the features made of them, counted again in Python."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    corpus = secrets.count_words(docs)
    df = Counter(w for r in docs.collect() for w in {x for x in re.split("[^a-z]+", (r.text or "").lower()) if 3 <= len(x) <= 24})
    words = {w: n for w, n in df.items() if n >= secrets.COMMON}
    assert {r.word for r in corpus.words.collect()} == set(words) and words
    pairs = Counter()
    for w, n in words.items():
        for i in range(len(w) - 1):
            pairs[w[i : i + 2]] += n
    total = sum(pairs.values())
    log = lambda p: math.log2((pairs[p] + 1) / (total + 676))
    word = max(words, key=len)
    values = [f"{word}_x9", "Ab12cD", "aBc", "0123", "é" + word[:4]]
    rows = spark.createDataFrame([(v, "", "") for v in values], "value string, near string, path string")
    got = {r.value: dict(zip(secrets.FEATURES, r.features.toArray())) for r in secrets.with_features(rows, corpus).collect()}
    for v in values:
        low = v.lower()
        logs = [log(low[i : i + 2]) for i in range(len(low) - 1) if re.fullmatch("[a-z]{2}", low[i : i + 2])]
        assert abs(got[v]["letters"] - (sum(logs) / len(logs) if logs else -math.log2(676))) < 1e-9
        assert abs(got[v]["common"] - sum(len(w) for w in re.split("[^a-z]+", low) if w in words) / len(v)) < 1e-9
        assert got[v]["length"] == len(v) and abs(got[v]["digits"] - sum(c in "0123456789" for c in v) / len(v)) < 1e-9
        assert abs(got[v]["distinct"] - len(set(v)) / len(v)) < 1e-9


def test_secrets_edge_cases(spark):
    key = hashlib.sha256(b"k").hexdigest()[:40]
    texts = [None, "", f'é token = "{key}" x', f"commit {key}", f"{'a' * 200000} secret: {key}", f"api_key={key}", f"api_key={key}", "plain words only"]
    docs = spark.createDataFrame([(None if i == 5 else i % 6, t, None, "q", 1, 777, 1, 5) for i, t in enumerate(texts)], "doc_id bigint, text string, source string, _h string, _spans int, length int, prediction int, features int")
    model = secrets.train(secrets.labelled_findings(spark), secrets.count_words(docs))
    clash = docs.withColumns({"_start": F.lit(1), "_near": F.lit("n"), "value": F.lit("v"), "row": F.lit(2), "score": F.lit(3)})
    found = secrets.find_secrets(clash, model).collect()
    assert {(r.length, r.prediction, r.features, r._start, r._near, r.value, r.row, r.score) for r in found} == {(777, 1, 5, 1, "n", "v", 2, 3)} and {r["__start"] for r in found} == {11, 200009, 8}
    got = {(r.doc_id, r._start, r._end) for r in secrets.find_secrets(docs, model).collect()}
    assert got == {(2, 11, 51), (4, 200009, 200049), (None, 8, 48), (0, 8, 48)}
    out = secrets.redact(docs)
    assert out.columns == docs.columns
    done = sorted((r.text or "")[:40] for r in out.collect())
    assert len(done) == len(texts) and 'é token = "[SECRET]" x' in done and done.count("api_key=[SECRET]") == 2 and f"commit {key}"[:40] in done
    assert secrets.find_secrets(docs.limit(0), model).count() == 0 and secrets.redact(docs.limit(0)).count() == 0


def test_secrets_of_any_shape(spark):
    values = ["Tr0ub4dor9", "kdJwQpLmXzRtYvBn", "P@ss!word#2024", "e5f0c3a7b1d94c2288aa0b1c2d3e4f5a6b7c8d9e"]
    texts = [f"password={values[0]}", f'api_key = "{values[1]}"', f"db password: {values[2]}", f"S3_SECRET_ACCESS_KEY={values[3]}", "the secret: patience and the token: string", "password = ${DB_PASSWORD}"]
    docs = spark.createDataFrame([(i, t, None) for i, t in enumerate(texts)], "doc_id bigint, text string, source string")
    assert {(r.doc_id, r._value) for r in secrets.find_secrets(docs).collect()} == set(enumerate(values))
    out = {r.doc_id: r.text for r in secrets.redact(docs).collect()}
    assert [out[i] for i in range(6)] == [t.replace(values[i], "[SECRET]") if i < 4 else t for i, t in enumerate(texts)]
    nested = spark.createDataFrame([(0, '{"auth": {"token": "Ab9x!Qz7"}}', "")], "doc_id bigint, text string, source string")
    assert [r._value for r in secrets.candidates(nested).collect()] == ["Ab9x!Qz7"]
    path = spark.createDataFrame([(0, "see " + "path/" * 20 + "A1b2C3d4", "")], "doc_id bigint, text string, source string")
    assert [r._value for r in secrets.candidates(path).collect()] == ["path/" * 20 + "A1b2C3d4"]


def test_bpe_equals_library():
    rng = random.Random(1)
    own, t = bpe.ByteBpe(BYTE, max_entries=500), Tokenizer.from_file(BYTE)
    texts = ["", " ", "  ", "a  b", "a \n b", "re.\n\nOf x ", " x", "é" * 3000, "a" * 5000, "-" * 3000, "<|endoftext|> a <|endoftext|>", "don't 've  　x  y\x1c z\x85", "日本語 한국어 😀😀", "�\x00"]
    texts += ["".join(rng.choice("abAB -=.\n1é") for _ in range(rng.randint(1, 200))) for _ in range(300)]
    for text, (ids, decimals) in zip(texts, own.encode_many(pa.array(texts))):
        want = t.encode(text, add_special_tokens=False).ids
        assert ids.tolist() == want and decimals[:-1].decode() == ",".join(map(str, want))
        assert own.decode(ids, step=5) == t.decode(want, skip_special_tokens=False)
    for _ in range(200):
        ids = [rng.randrange(50257) for _ in range(40)]
        assert own.decode(np.array(ids), step=3) == t.decode(ids, skip_special_tokens=False)
    walk, tokens = own.transducer, sorted(own.transducer._own)
    for _ in range(3000):
        pair = rng.choice(tokens), rng.choice(tokens)
        assert walk._apart(*pair) == (walk._merged(pair[0] + pair[1]) == [*pair]), pair
    small = bpe.Transducer({x: i for i, x in enumerate([b"a", b"b", b"aa", b"ab", b"aab", b"aaaa"])}, [(b"a", b"a"), (b"a", b"b"), (b"aa", b"b"), (b"aa", b"aa")])
    for pair in [(x, y) for x in small._own for y in small._own]:
        assert small._apart(*pair) == (small._merged(pair[0] + pair[1]) == [*pair]), pair
    data = ("ab" * 3000).encode()
    assert list(own.transducer.encode(data[i : i + 7] for i in range(0, len(data), 7))) == t.encode(data.decode(), add_special_tokens=False).ids


def test_op5_equals_library(spark, sf):
    t = Tokenizer.from_file(BYTE)
    hexed = lambda s: hashlib.sha256(s.encode()).hexdigest()
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in queries.op5_bpe(spark, sf).collect()}
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        ids = t.encode(r.text or "", add_special_tokens=False).ids
        assert got[r.doc_id] == (len(ids), hexed(",".join(map(str, ids))), hexed(t.decode(ids, skip_special_tokens=False)))
    docs = spark.createDataFrame([(None, None, 1), (1, "a b", 2), (1, "a b", 2)], "doc_id bigint, text string, n_tokens int")
    assert sorted((r.doc_id is None, r.n_tokens) for r in bpe.round_trip_digests(docs, BYTE).collect()) == [(False, 2), (False, 2), (True, 0)]
    back = bpe.decode_ids(bpe.encode_texts(docs, BYTE), BYTE).collect()
    odd = spark.createDataFrame([(1, None), (2, [-1, 64, None, 10**6, 65])], "doc_id bigint, ids array<int>")
    assert {r.doc_id: r.text for r in bpe.decode_ids(odd, BYTE).collect()} == {1: "", 2: t.decode([64, 65], skip_special_tokens=False)}
    assert sorted(r.text for r in back) == ["", "a b", "a b"] and bpe.round_trip_digests(docs.limit(0), BYTE).count() == 0


def test_langid_is_the_same_however_rows_are_dealt(spark):
    """Fitted and asked under two shuffle settings and orders of rows, all columns are equal."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    old, got = spark.conf.get("spark.sql.shuffle.partitions"), []
    try:
        for n, rows in (("3", docs), ("7", docs.repartition(5).orderBy(F.desc("doc_id")))):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            model = langid.fit(rows)
            got.append((model, sorted(map(tuple, langid.predict(docs.select("doc_id", "text"), model).drop("text").collect()))))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    (a, first), (b, second) = got
    assert a.languages == b.languages and (a.centroids == b.centroids).all() and (a.radii == b.radii).all()
    assert first == second


def test_op10_like_the_trees_one_by_one(spark, sf):
    """Findings are the candidates for which the trees' own shares, asked one by one and averaged here, reach the threshold."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "source", "text")
    rows = secrets._candidates(docs, "text", "source")
    scanner = secrets.train(secrets.labelled_findings(spark), secrets.count_words(docs))
    asked = secrets.with_features(rows, scanner.corpus).select("row.doc_id", "start", "end", "features").collect()
    trees, shares = scanner.model.trees, {}
    want = set()
    for r in asked:
        if r.features not in shares:
            shares[r.features] = float(np.mean([tree.predictProbability(r.features)[1] for tree in trees]))
        if round(shares[r.features], 6) >= secrets.THRESHOLD:
            want.add((r.doc_id, r.start, r.end))
    got = {(r.doc_id, r.start, r.end) for r in queries.op10_secrets(spark, sf).collect()}
    assert len(asked) > len(want) and got == want and want
