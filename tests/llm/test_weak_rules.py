import re
from collections import Counter

import numpy as np

from meterloom.llm import queries, weak_rules

SCHEMA = "doc_id bigint, text string, _kept string, votes string, n_words string"


def base(text):
    """The contract's measures, by another way: places one by one."""
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    runs = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {i + k for i in range(len(words) - 4) if runs[tuple(words[i : i + 5])] > 1 for k in range(5)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered), n < 10 or 100 * len(covered) > 20 * n


ROWS = [
    (1, None, "a", "b", "c"),
    (None, "", "a", None, "c"),
    (2, "one two three four five " * 3, "a", "b", "c"),
    (2, "one two three four five " * 3, "a", "b", "c"),
    (3, "x y z w v u t s r q p\nsame line\nsame line\n same line\n\n\n", "a", "b", "c"),
    (4, "a b \x1c c\x85d é" * 4, "a", "b", "c"),
    (5, "word" * 50_000, "a", "b", "c"),
    (6, " ".join(f"w{i}" for i in range(30_000)), "a", "b", "c"),
    (7, "a a a a a a", "a", "b", "c"),
    (8, "#$% <>&|* |" * 20, "a", "b", "c"),
]


def test_measures_and_other_columns(spark):
    found = weak_rules.judge(spark.createDataFrame(ROWS, SCHEMA))
    assert found.columns == ["doc_id", "_kept", "votes", "n_words", *[f"_{m}" for m in weak_rules.MEASURES], "_votes", "_quality", "_base_failed", "__kept"]
    rows = found.collect()
    key = lambda r: (r[0] is None, r[0] or 0)
    for r, (i, text, *others) in zip(sorted(rows, key=key), sorted(ROWS, key=key), strict=True):
        assert [r.doc_id, r._kept, r.votes, r.n_words] == [i, *others]
        assert (*[r[f"_{m}"] for m in weak_rules.MEASURES], r["_base_failed"]) == base(text)
        assert not (r["_base_failed"] and r["__kept"])
    assert weak_rules.judge(spark.createDataFrame([], SCHEMA)).collect() == []


def em(patterns, rounds):
    """The same model, one document and one rule at a time."""
    docs = [p for p, n in patterns for _ in range(n)]
    rules = range(len(docs[0]))
    q = {p: (0.95, 0.5, 0.05)[min(2, p.count("l"))] for p, _ in patterns}
    for _ in range(rounds):
        share = min(0.99, max(0.01, sum(q[d] for d in docs) / len(docs)))
        right = {}
        for j in rules:
            for kind, weight, (yes, no) in (("h", lambda d: q[d], (9, 1)), ("l", lambda d: 1 - q[d], (3, 7))):
                hits = sum(weight(d) for d in docs if d[j] == kind) + yes * len(docs) / 1000
                right[kind, j] = hits / (sum(weight(d) for d in docs if d[j] != "-") + (yes + no) * len(docs) / 1000)
            right["h", j] = min(0.999, max(0.5, right["h", j]))
            right["l", j] = min(0.999, max(1 - right["h", j], right["l", j]))
        new = {}
        for p, _ in patterns:
            high, low = share, 1 - share
            for j in rules:
                if p[j] == "h":
                    high, low = high * right["h", j], low * (1 - right["l", j])
                if p[j] == "l":
                    high, low = high * (1 - right["h", j]), low * right["l", j]
            new[p] = high / (high + low)
        q = new
    return q


def test_op12_like_brute_force(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = queries.op12_quality(spark, sf).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    q = em(sorted(Counter(r.votes for r in rows).items()), 50)
    for r in rows:
        measures = base(texts[r.doc_id])
        assert (*[r[m] for m in weak_rules.MEASURES], r.base_failed) == measures
        assert abs(r.quality - q[r.votes]) < 2e-6
        assert r.kept == (not r.base_failed and r.quality >= 0.5)


def test_rules_as_stated(spark, sf):
    """Votes of texts that each break one rule."""
    good = "\n".join(f"This{i} line{i} has{i} some{i} words{i} in{i} it, and{i} then{i} it{i} ends{i} here{i}." for i in range(8))
    bad = {
        "length": "Only a few words.",
        "symbols": good.replace(" ", " $$ "),
        "symbol_words": good.replace(" ", "# "),
        "commonest": " ".join(["same"] * 30 + ["other"] * 9),
        "dup_lines": good + "\n" + good,
        "capitals": good.upper(),
        "letters": good.replace(" has", " 12 34 56 78 "),
        "sentences": good.replace(".", ""),
        "word_length": " ".join(["x" * 40] * 9 + ["y"]),
    }
    names = [r[0] for r in weak_rules.RULES]
    found = weak_rules.measures(spark.createDataFrame([("good", good), *bad.items()], "name string, text string")).select("name", weak_rules.votes().alias("v"))
    said = {r.name: r.v for r in found.collect()}
    assert set(said["good"]) <= {"h", "-"} and said["good"].count("h") >= 8
    for name in bad:
        assert said[name][names.index(name)] == "l", name


def test_quality_finds_labels(spark):
    """Of labelled documents, most good ones are kept and most bad ones go; labels are read here alone."""
    path = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{path}/labels.parquet").collect()}
    rows = [r for r in queries.op12_quality(spark, path).collect() if r.doc_id in labels]
    kept = np.array([r.kept for r in rows])
    good = np.array([labels[r.doc_id] == 1 for r in rows])
    long = np.array([r.n_words >= 10 for r in rows])
    assert kept[good & long].mean() > 0.97
    assert kept[~good].mean() < 0.15
