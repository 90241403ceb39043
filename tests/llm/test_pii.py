import hashlib
import re
from collections import Counter

import regex

from meterloom.llm import pii, queries

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def brute(text):
    out = []
    for order, (kind, rx) in enumerate(PATTERNS.items()):
        for m in re.finditer(rx, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else 0, "card": 14 <= len(digits) <= 19 and luhn(digits), "phone": 10 <= len(digits) <= 15}[kind]
            if ok:
                out.append((m.start(), order, kind, m.end()))
    out.sort()
    joined = ",".join(f"{k}:{a}:{b}" for a, _, k, b in out)
    return (*[sum(x[2] == k for x in out) for k in PATTERNS], hashlib.sha256(joined.encode()).hexdigest()), joined


def test_op6_equals_brute_force(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = queries.op6_pii(spark, sf).collect()
    assert len(rows) == len(texts) and sum(r.n_email + r.n_phone for r in rows)
    for r in rows:
        want, _ = brute(texts[r.doc_id])
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) == want


def test_edge_cases(spark):
    texts = [
        None, "", "a@b.c_d@e.f x@y", "1.2.3.4.5.6.7.8 0255.1.1.1 256.1.1.1 1.2.3.999999999999999999999", "4111 1111 1111 1111 4111-1111-1111-1112 " + "1" * 6000,
        "+1 (743) 555-3824 +123 +1 2 +" + "1 " * 20 + "+12345678901 5 x", "é😀 a@b.co +1 (743) 555-3824", "a" * 200000 + " z@y.x", "a@" + "b." * 8000 + "c", "x@y.z " * 5000,
        "1@2.3 4.5.6.7@8.9 00.00.00.00", "5500005555555559 4012888888881881",
    ]
    docs = spark.createDataFrame([(None if i % 3 == 0 else i % 5, t, 1) for i, t in enumerate(texts)] * 2, "doc_id bigint, text string, h int")
    got = sorted((r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256, r.spans) for r in pii.find_pii(docs).collect())
    assert got == sorted([(*brute(t)[0], brute(t)[1]) for t in texts] * 2)
    assert pii.find_pii(docs.limit(0)).count() == 0


def test_contexts_find_unseen_identifiers(spark):
    texts = [f"words here and mail me at p{i}@host{i}.example.com now" for i in range(8)]
    texts += ["other words, mail me at user7@localhost, please", "the 4 of us and the 77 others", "nothing at all", "of the a1@b.co x"]
    texts += [f"of the plain text {i}" for i in range(40)] + [f"of the k{i}@b.co" for i in range(4)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: r for r in pii.find_pii(docs).collect()}
    at = texts[8].index("user7")
    assert got[8].added == f"email:{at}:{at + len('user7@localhost')}" and got[8].spans == got[8].added
    assert [k for k, r in got.items() if r.added] == [8]


def test_support_does_not_grow_with_the_seeds(spark):
    texts = [f"word{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)} says q{i}@h.example.com" for i in range(7000)]
    texts += [f"the form has m{i}@h.example.com" for i in range(3)] + ["the form has staff8@intranet"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    assert [(r.doc_id, r.added) for r in pii.find_pii(docs).where("added <> ''").collect()] == [(7003, "email:13:28")]


def test_contexts_without_a_seed(spark):
    texts = [f"mail me at p{i}@h.example.com" for i in range(8)] + [f"mail me at user{i}@localhost" for i in range(3)]
    texts += [f"so we contacted user{i}@localhost" for i in range(3)] + ["so we contacted zed9@intranet"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: r.added for r in pii.find_pii(docs).where("added <> ''").collect()}
    assert set(got) == set(range(8, 15)) and got[14] == "email:16:29"


def test_any_two_words_are_a_context(spark):
    long = "l" * 60 + " " + "m" * 60
    texts = [f"so user 17 mail p{i}@h.example.com" for i in range(4)] + ["so user 17 mail x@localhost"]
    texts += [f"{long}  r{i}@h.example.com" for i in range(4)] + [f"{long}\ny@localhost"]
    texts += [f"9 a@b s{i}@h.example.com" for i in range(4)] + ["9 A@B z@localhost 3"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: r.added for r in pii.find_pii(docs).where("added <> ''").collect()}
    assert got == {4: "email:16:27", 9: "email:122:133", 14: "email:6:17"}


def brute_added(texts):
    """What contexts add to each text: tokens, pattern graph and rounds by their definition, over all texts."""
    space = r"[ \t\n\x0b\f\r]"
    edges, places = [], Counter()
    for i, text in texts.items():
        words = [w for w in re.split(f"{space}+", text.lower()) if w]
        for a, b in zip(words, words[1:]):
            places[f"{a} {b}"] += 1
        if len(words) > 1:
            places[f"{words[-2]} {words[-1]}"] -= 1  # nothing follows the last pair
        base = [(int(a), k, int(b)) for k, a, b in (x.split(":") for x in brute(text)[1].split(",") if x)]
        at = [k for k, w in enumerate(words) if re.search("[0-9@]", w)]
        for n, m in enumerate(re.finditer(r"(?<![^ \t\n\x0b\f\r])[^ \t\n\x0b\f\r]*?[0-9@][^ \t\n\x0b\f\r]*", text)):
            if at[n] < 2:
                continue
            start = m.start() + len(regex.match(r"[^\p{L}\p{N}+]*", m[0])[0])
            end = m.end() - len(regex.search(r"[^\p{L}\p{N}]*$", m[0])[0])
            if end > start:
                seed = next((k for a, k, _ in base if m.start() <= a < m.end()), None)
                covered = any(a < end_ and b > start_ for a, _, b in base for start_, end_ in [(m.start(), m.end())])
                edges.append((i, start, end, m[0].lower(), f"{words[at[n] - 2]} {words[at[n] - 1]}", seed, covered))
    holders = {}
    for e in edges:
        holders.setdefault(e[4], set()).add(e[3])
    edges = [e for e in edges if len(holders[e[4]]) >= pii.SUPPORT and places[e[4]] > 0]
    most = lambda kinds: min(((-n, k) for k, n in Counter(k for k in kinds if k).items()), default=(0, None))[1]
    by = {}
    for e in edges:
        by.setdefault(e[3], []).append(e)
    own = {x: most(e[5] for e in es) for x, es in by.items()}
    seeds = {x for x, es in by.items() if any(e[5] for e in es)}
    score = {x: float(x in seeds) for x in by}
    for _ in range(pii.ROUNDS):
        patterns = {}
        for c in {e[4] for e in edges}:
            es = [e for e in edges if e[4] == c]
            strong = {e[3] for e in es if score[e[3]] >= pii.TRUST}
            confidence = min(sum(score[e[3]] for e in es) / places[c], 1.0)
            if len(strong) >= pii.SUPPORT and confidence >= pii.TRUST:
                patterns[c] = (confidence, most(e[5] for e in es) or most(own[e[3]] for e in es if e[3] in strong))
        for x, es in by.items():
            if x not in seeds:
                doubt = 1.0
                for e in es:
                    doubt *= max(1 - patterns.get(e[4], (0.0, None))[0], 1e-9)
                score[x] = 1 - doubt
                own[x] = max(((p[0], p[1] or "") for e in es if (p := patterns.get(e[4]))), default=(0, None))[1] or None
    added = {}
    for i, start, end, x, c, _, covered in edges:
        if not covered and score[x] >= pii.TRUST and c in patterns and patterns[c][1]:
            added.setdefault(i, set()).add((start, pii.KINDS.index(patterns[c][1]), f"{patterns[c][1]}:{start}:{end}"))
    return {i: ",".join(x[2] for x in sorted(found)) for i, found in added.items()}


def test_added_spans_equal_brute_force(spark, sf):
    """The whole table, with forms beside it that contexts can learn, and lines that say the same again and again."""
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    made = [f"please write to n{i}@h{i}.example.com today" for i in range(6)] + [f"please write to desk{i}@intranet today" for i in range(3)]
    made += [f"or contact the desk{i}@intranet instead" for i in range(3)] + ["or contact the front9@lobby soon"] + ["call us on +1 (743) 555-3824"] * 3
    made += [f"call us on +1743555{i}824 or line7" for i in range(4)] + ["call us on line7 then"] * 5 + ["the 4 of 9 and 8"] * 4
    texts |= {10**6 + i: t for i, t in enumerate(made)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    got = {r.doc_id: r.added for r in pii.find_pii(docs).where("added <> ''").collect()}
    want = brute_added(texts)
    assert got == want and {10**6 + 6, 10**6 + 12} <= set(want)
