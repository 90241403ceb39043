import re
from collections import Counter, defaultdict

import pyarrow as pa
import pytest

from meterloom.llm import phrases

SCHEMA = "doc_id bigint, text string, lang string, phrase string, n bigint"


def brute(rows, least, top):
    f, n = defaultdict(Counter), Counter()
    for _, text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            f[lang].update(tuple(words[i : i + k]) for k in range(1, 6) for i in range(len(words) - k + 1))
    out = set()
    for lang, counts in f.items():
        found = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        hidden = {p[i : i + k] for p, a in found.items() for k in range(2, len(p)) for i in range(len(p) - k + 1) if a >= found[p[i : i + k]]}
        rows = []
        for p, a in found.items():
            if p not in hidden:
                score, k = min((1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
                rows.append((" ".join(p), a, counts[p[:k]], counts[p[k:]], n[lang], score))
        rows.sort(key=lambda r: (-r[5], -r[1], r[0].encode()))
        out |= {(lang, i, *r) for i, r in enumerate(rows[:top], 1)}
    return out


def got(spark, rows, least, top):
    found = phrases.collocations(spark.createDataFrame(rows, SCHEMA), least=least, top=top)
    assert found.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    rows = [tuple(r) for r in found.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


ROWS = [
    (1, "The quick brown fox jumps, over the lazy dog. " * 6, "en", "x", 1),
    (1, "The quick brown fox jumps, over the lazy dog. " * 6, "en", "x", 1),
    (2, "a a a a a a a a a a\tA  a\x0ba", "en", "x", 1),
    (3, None, "en", None, None),
    (None, "", None, "x", 1),
    (4, "é \x01 x é \x01 x é \x01 x", None, "x", 1),
    (5, "é \x01 x", "und", "x", 1),
    (6, " ".join(f"w{i % 37}" for i in range(3000)), "en", "x", 1),
    (7, "z" * 70_000 + " end " + "z" * 70_000, "de", "x", 1),
    (8, ".,;:!?\n\r\x0c", "fr", "x", 1),
]


@pytest.mark.parametrize("least", [2, 5])
def test_like_brute_force(spark, least):
    assert got(spark, ROWS, least, 2000) == brute(ROWS, least, 2000)
    assert got(spark, ROWS, least, 3) == brute(ROWS, least, 3)


def test_no_phrase(spark):
    assert got(spark, ROWS[:0], 2, 10) == set()
    assert got(spark, ROWS, 10**6, 10) == set()


def test_chunks_hold_each_place_once():
    words = [f"w{i * 7919 % 61}".encode() for i in range(5000)]
    for made in (words, words[:9], words[:1], [b"same"] * 3000):
        found = list(phrases._chunks(made, 4))
        assert sum(own for _, own in found) == len(made)
        at = 0
        for text, own in found:
            chunk = text.split(b" ")
            assert chunk == made[at : at + own + 4]
            at += own


def test_equal_passages_give_equal_chunks():
    passage = [f"p{i * 31 % 997}".encode() for i in range(400)]
    one = {c for c, _ in phrases._chunks([b"x"] * 3 + passage, 4)}
    other = {c for c, _ in phrases._chunks([b"y"] * 50 + passage, 4)}
    assert len(one & other) > 0.8 * len(other - {c for c, _ in phrases._chunks([b"y"] * 50, 4)})


def test_full_filter_gives_the_same(spark, monkeypatch):
    """A filter that lets almost all through changes what is counted, not what is found."""
    monkeypatch.setattr(phrases, "_MOST_BITS", 1 << 15)
    rows = [(i, " ".join(f"a{j * (i + 1) % 300}" for j in range(900)), "en", "", 0) for i in range(8)]
    assert got(spark, rows, 3, 2000) == brute(rows, 3, 2000)


def test_words_are_hashed_once_for_a_count(monkeypatch):
    calls, real = [], phrases.word_hashes
    monkeypatch.setattr(phrases, "word_hashes", lambda *a: calls.append(a) or real(*a))
    batch = pa.RecordBatch.from_pydict({"lang": ["en", "de"], "chunk": ["a b a b", "a b"], "own": [4, 2], "n": [2, 1]})
    found = phrases._count(batch, 2, 0, None).to_pylist()
    assert {(r["lang"], r["phrase"]): r["n"] for r in found} == {("en", "a b"): 4, ("en", "b a"): 2, ("de", "a b"): 1} and len(calls) == 1
