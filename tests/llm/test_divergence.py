import re
from collections import Counter, defaultdict

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from meterloom.llm import divergence

SCHEMA = "doc_id bigint, text string, lang string, source string, n bigint, p string"


def brute(rows, min_docs, top):
    """All cells of all pairs, term by term."""
    count, seen, groups = defaultdict(Counter), defaultdict(Counter), set()
    for _, text, lang, source, *_ in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", low)
        count[lang, source].update(terms)
        seen[lang].update(set(terms))
    out = set()
    for lang in {g[0] for g in groups}:
        kept = sorted(t for t, n in seen[lang].items() if n >= min_docs)
        own = sorted(s for la, s in groups if la == lang)
        v = len(kept)

        def shares(n):
            total = sum(n[t] for t in kept)
            return {t: 1 + 10**9 * (n[t] + 2) // (total + 2 * v) for t in kept}

        f = lambda p, q: (p - q) ** 2 // (p + q)
        p = {s: shares(count[lang, s]) for s in own}
        q = shares(sum((count[lang, s] for s in own), Counter()))
        for s in own:
            pairs = [(sum(f(p[s][t], p[o][t]) for t in kept), o) for o in own if o != s]
            terms = [(f(p[s][t], q[t]), t) for t in kept if count[lang, s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                ranked = sorted(found, key=lambda x: (-x[0], x[1].encode()))[:most]
                out |= {(lang, s, part, item, value, i) for i, (value, item) in enumerate(ranked, 1)}
    return out


def got(spark, rows, min_docs, top):
    found = divergence.audit(spark.createDataFrame(rows, SCHEMA), min_docs=min_docs, top=top)
    assert found.columns == ["lang", "source", "part", "item", "value", "rank"]
    rows = [tuple(r) for r in found.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_edge_rows(spark):
    rows = [
        (1, "Word word WORD other 7x7 été É", "en", "a", 1, "x"),
        (1, "Word word WORD other 7x7 été É", "en", "a", 1, "x"),
        (None, None, "en", "b", None, None),
        (2, "", None, None, 1, "x"),
        (3, "word " * 5000 + "z", "en", "c", 1, "x"),
        (4, "only once", "fr", "a", 1, "x"),
        (5, None, "fr", "b", 1, "x"),
        (6, "a" * 100_000 + " word\x00word_word", "en", "", 1, "x"),
    ]
    for least in (1, 2, 3):
        assert got(spark, rows, least, 2) == brute(rows, least, 2)
    assert got(spark, rows[:0], 1, 10) == set()


def test_many_groups_and_words(spark):
    """More groups than a tile holds, and more terms than a word of bits."""
    rows = [(i, " ".join(f"t{chr(97 + j % 26)}{chr(97 + j // 26)}" for j in range(400) if (i * j) % 7 < 3 for _ in range(1 + (i + j) % 4)), "en", f"s{i % 41}", 0, "") for i in range(60)]
    assert got(spark, rows, 2, 10) == brute(rows, 2, 10)


words = st.lists(st.sampled_from(["a", "b", "B", "cc", "ü"]), max_size=12).map(" ".join)


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.none() | words, st.sampled_from([None, "", "en"]), st.sampled_from(["a", "b", None])), max_size=12))
def test_random(spark, drawn):
    rows = [(i, *x, 0, "") for i, x in enumerate(drawn)]
    assert got(spark, rows, 2, 3) == brute(rows, 2, 3)
