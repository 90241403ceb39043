import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from meterloom.llm import packing, queries, token_files
from meterloom.llm.shared import new_path
from meterloom.llm.word_encoder import WordEncoder

PATH = queries.tokenizer_path("word_bpe_49k.json")
ODD = ["", " \n", None, "J̌ ǰ ﬁ İstanbul ΑΣ Σ 日本語 x² ß ẞ ſ", "a\x1cb \x85 \x7f\x00 z", "<|endoftext|> a<|startoftext|>b <|ENDOFTEXT|>", "don't we'RE I'LL 123abc", "tab\tx\x0by", "É" * 300, "A" * 5000]


def library(text):
    return Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids


def test_encoder_equals_library(spark, sf):
    texts = ODD + [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()]
    t = Tokenizer.from_file(PATH)
    got = WordEncoder(PATH, max_entries=2000).encode_many(pa.array(texts, pa.string()))
    assert [x.tolist() for x in got] == [t.encode(x or "", add_special_tokens=False).ids for x in texts]


def test_encoder_looks_words_up_without_their_marks_and_keeps_few():
    e, t = WordEncoder(PATH, max_entries=50), Tokenizer.from_file(PATH)
    text = "Word word, word. word! Éa; éa a.b ... a.. 's. x's, 12. word?!"
    assert e.encode(text).tolist() == t.encode(text, add_special_tokens=False).ids
    assert {x for x in e._chunks if "word" in x} == {"word", "word?!"}
    for i in range(40):
        texts = [f"common {chr(97 + i % 26)}{'xyz'[i // 26]}{chr(97 + k)}." for k in range(26)]
        assert [x.tolist() for x in e.encode_many(pa.array(texts))] == [t.encode(x, add_special_tokens=False).ids for x in texts]
    # Before, 2^18 entries were kept in each worker and all went at once; "common" is asked for each time and stays.
    assert len(e._chunks) + len(e._older) < 2 * 50 + 2 * 30 and "common" in e._chunks


def test_a_task_end_empties_the_caches():
    from meterloom.llm.shared import releasing

    e = WordEncoder(PATH)
    list(releasing(lambda batches: (e.encode(x) for x in batches), e.forget)(iter(["word, 日本"])))
    assert not e._chunks and not e._older and not e._odd_chunks


@pytest.mark.parametrize("width", [1, 3, 8, 13, 16, 17, 31, 32])
def test_bits_round_trip(width):
    ids = np.random.default_rng(0).integers(0, 1 << width, 9001)
    packed, offsets = token_files.pack_blocks(ids, width)
    assert len(packed) <= len(ids) * width / 8 + len(offsets)
    for a, b in [(0, 9001), (0, 0), (4095, 4097), (5000, 9001), (9000, 9001)]:
        assert token_files.read_ids(packed, offsets, width, len(ids), a, b).tolist() == ids[a:b].tolist()


def docs_of(spark, texts, ids=None):
    rows = [(i if ids is None else ids[i], t, "x", 1) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, _hashes string, ids int")


def test_token_files_edge_cases(spark):
    texts = [*ODD, "same", "same"]
    ids = [*range(len(ODD)), None, None]
    path = new_path(spark, "t")
    token_files.write_token_files(docs_of(spark, texts, ids), path, PATH)
    rows = token_files.read_token_files(spark, path).orderBy("start").collect()
    assert [r.doc_id for r in rows] == [None, None, *range(len(ODD))]
    assert [r.ids for r in rows] == [[*library(t), 1] for t in ["same", "same", *ODD]]
    assert [r.start for r in rows] == [0, *np.cumsum([len(r.ids) for r in rows])[:-1]]
    path = new_path(spark, "t")
    token_files.write_token_files(docs_of(spark, []), path, PATH)
    assert token_files.token_digests(spark, path).count() == 0


def test_op4_equals_brute_force(spark, sf):
    t, start = Tokenizer.from_file(PATH), 0
    want = []
    for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect():
        ids = [*t.encode(r.text or "", add_special_tokens=False).ids, 1]
        want.append((r.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    got = queries.op4_token_files(spark, sf).select("doc_id", "start", "n_tokens", "ids_crc32").orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == want


def check_pieces(rows, texts, window):
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    assert set(by_doc) == set(texts)
    for doc, pieces in by_doc.items():
        ids, at = [*library(texts[doc]), 1], 0
        for r in sorted(pieces, key=lambda r: r.start):
            assert r.start == at and r.length > 0 and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= window and {r.padded for r in pieces} == {at if at & (at - 1) == 0 else window}
    return by_sequence


def test_op8_pieces(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = queries.op8_packing(spark, sf).collect()
    sequences = check_pieces(rows, texts, 2048)
    filled = sum(r.length for r in rows)
    # All but the last sequence of each of at most eight partitions are nearly full.
    assert len(sequences) * 2048 - filled < 0.01 * filled + 8 * 2048


def test_packing_edge_cases(spark):
    rows = packing.pack_documents(docs_of(spark, ODD), PATH, window=64).collect()
    check_pieces(rows, dict(enumerate(ODD)), 64)
    assert packing.pack_documents(docs_of(spark, []), PATH).count() == 0
    twice = packing.pack_documents(docs_of(spark, ["a b", "a b"], [None, 7]), PATH).collect()
    assert sorted((r.doc_id is None, r.start, r.length) for r in twice) == [(False, 0, 3), (True, 0, 3)]


def test_cuts_are_optimal():
    rng = np.random.default_rng(3)
    for _ in range(200):
        n = int(rng.integers(1, 40))
        places = np.concatenate(([0], np.cumsum(rng.integers(1, 9, n))))
        pen = np.concatenate(([0], rng.integers(0, 12, n)))
        window = int(rng.integers(8, 30))

        def padding(size):
            return 0 if size & (size - 1) == 0 else window - size

        def cost(cuts):
            at, total = 0, 0
            for c in cuts:
                size = places[c] - places[at]
                assert 0 < size <= window
                total, at = total + padding(size) + pen[c], c
            return total

        best = [0] + [None] * n
        for j in range(1, n + 1):
            best[j] = min(best[i] + padding(places[j] - places[i]) + pen[j] for i in range(j) if places[j] - places[i] <= window)
        assert cost(packing.choose_cuts(places, pen, window)) == best[n]


def test_stretches_do_not_lose_ids(spark, monkeypatch):
    stream = packing._Stream(0, 50)
    got = []
    rng = np.random.default_rng(1)
    docs = {i: rng.integers(0, 1000, int(rng.integers(1, 200))).astype("<u2") for i in range(300)}
    for i, ids in docs.items():
        stream.add(i, ids, rng.random(len(ids)) < 0.05)
        if stream.n >= 500:
            got += list(stream.pieces(False))
    got += list(stream.pieces(True))
    for i, ids in docs.items():
        pieces = sorted((x for x in got if x[0] == i), key=lambda x: x[1])
        assert [x[1] for x in pieces] == [0, *np.cumsum([x[2] for x in pieces])[:-1]] and sum(x[2] for x in pieces) == len(ids)
        assert all(x[3] == zlib.crc32(ids[x[1] : x[1] + x[2]].astype("<u4").tobytes()) and x[4] == len(ids) for x in pieces)


def test_very_long_texts_through_the_queries(spark, monkeypatch):
    """Texts longer than a segment, a stretch and many windows, beside short and null ones."""
    monkeypatch.setattr(token_files, "SEGMENT", 500)
    long = "one two three. four five six seven " * 4000
    rows = [(1, "short"), (2, long), (3, None), (4, long + "end"), (4, "again"), (None, "no id")]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id bigint, text string, start int")
    t = Tokenizer.from_file(PATH)
    ids = {(i, text): [*t.encode(text or "", add_special_tokens=False).ids, 1] for i, text in rows}
    crc = lambda x: zlib.crc32(np.array(x, "<u4").tobytes())
    path = new_path(spark, "files")
    token_files.write_token_files(docs, path, PATH)
    got = [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in token_files.token_digests(spark, path).collect()]
    assert sorted(x[2:] for x in got) == sorted((len(x), crc(x)) for x in ids.values())
    assert sorted(x[1] for x in got) == sorted(np.cumsum([0, *[x[2] for x in sorted(got, key=lambda x: x[1])][:-1]]).tolist())
    pieces = packing.pack_documents(docs, PATH, window=256).collect()
    assert sum(p.length for p in pieces) == sum(map(len, ids.values())) and max(p.length for p in pieces) <= 256
    whole = {i: x for (i, _), x in ids.items() if i == 2}[2]
    for p in pieces:
        if p.doc_id == 2:
            assert p.ids_crc32 == crc(whole[p.start : p.start + p.length]) and p.doc_tokens == len(whole)


def test_room_has_a_price():
    """Short sequences are taken only where a cut at the window's end costs more than their room."""
    rng = np.random.default_rng(5)
    for _ in range(100):
        n, window, room = int(rng.integers(1, 40)), 32, 4
        places = np.concatenate(([0], np.cumsum(rng.integers(1, 9, n))))
        pen = np.concatenate(([0], rng.integers(0, 12, n)))
        price = lambda size: (window - size) // room if size & (size - 1) == 0 else window - size
        best = [0] + [None] * n
        for j in range(1, n + 1):
            best[j] = min(best[i] + price(places[j] - places[i]) + pen[j] for i in range(j) if places[j] - places[i] <= window)
        cuts = [0, *packing.choose_cuts(places, pen, window, room)]
        assert sum(price(places[b] - places[a]) + pen[b] for a, b in zip(cuts, cuts[1:])) == best[n]


def test_few_sequences_and_little_padding(spark, sf):
    rows = queries.op8_packing(spark, sf).collect()
    sizes = defaultdict(int)
    padded = {r.sequence_id: r.padded for r in rows}
    for r in rows:
        sizes[r.sequence_id] += r.length
    ids = sum(sizes.values())
    assert sum(padded.values()) - ids < 0.02 * ids and len(sizes) <= 1.02 * ids / 2048 + 8
