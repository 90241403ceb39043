"""Phrases of up to five words that stand together more often than chance, counted in a prefix-free parse.

Texts are cut into overlapping chunks where their own words say so, so equal
passages give equal chunks wherever they stand. The dictionary of distinct
chunks with their numbers is all that is counted in: each chunk's phrases count
once for each time that it was parsed. A chunk carries the words that follow it
as far as the longest phrase reaches; a phrase belongs to the chunk that its first
word belongs to, so what chunks share is counted once.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import releasing, written
from .shingles import mixed, word_hashes

#: A chunk begins anew after a word whose checksum is a multiple of _EVERY, if it has _LEAST words; after _MOST at any word.
_LEAST, _EVERY, _MOST = 8, 8, 512
#: Bytes of chunks that a task holds before it hands them on.
_HELD = 4 << 20
#: Bytes of chunks that are counted together.
_TOGETHER = 3 << 20
#: Bits of a filter of frequent phrases for each of them, and all bits at most.
_BITS_EACH, _MOST_BITS = 16, 1 << 27
_PIECE_ENDS = b".,;:!?\x0b\x0c\r"
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ" + _PIECE_ENDS + b"\t", b"abcdefghijklmnopqrstuvwxyz" + b"\n" * len(_PIECE_ENDS) + b" ")
_DICTIONARY = "lang string, chunk string, own int, n bigint"
_COUNTED = "lang string, phrase string, h bigint, n bigint"


def _chunks(words: list[bytes], reach: int) -> Iterator[tuple[bytes, int]]:
    """The chunks of a piece: their words, joined, and how many of them are their own."""
    first = 0
    while len(words) - first > _LEAST + reach:
        last, most = first + _LEAST, min(first + _MOST, len(words))
        while last < most and crc32(words[last - 1]) % _EVERY:
            last += 1
        if last == len(words):
            break
        yield b" ".join(words[first : last + reach]), last - first
        first = last
    yield b" ".join(words[first:]), len(words) - first


def parse(docs: DataFrame, longest: int = 5, lang: str = "lang", text: str = "text") -> DataFrame:
    """lang, chunk, own, n: distinct chunks of the pieces of all texts, and how often each was parsed.

    Pieces end at . , ; : ! ? and the line ends \\n \\v \\f \\r; words are what spaces and
    tabs leave of them, A-Z in lower case. No phrase goes over the end of a piece.
    """
    reach = longest - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def rows() -> pa.RecordBatch:
            langs, chunks, own = zip(*held)
            out = pa.RecordBatch.from_arrays([pa.array(langs), pa.array(chunks, pa.binary()).cast(pa.string()), pa.array(own, pa.int32()), pa.array(held.values(), pa.int64())], names=["lang", "chunk", "own", "n"])
            held.clear()
            return out

        size = 0
        for batch in batches:
            for la, text in zip(*[c.to_pylist() for c in batch.columns]):
                for piece in text.encode().translate(_LOWER).split(b"\n"):
                    words = piece.split()
                    if words:
                        held.update((la, *c) for c in _chunks(words, reach))
                size += len(text)
                if size > _HELD:
                    if held:
                        yield rows()
                    size = 0
        if held:
            yield rows()

    texts = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    return texts.mapInArrow(releasing(run), _DICTIONARY).groupBy("lang", "chunk", "own").agg(F.sum("n").alias("n"))


def _filter_of(frequent: DataFrame, n_rows: int) -> tuple[int, bytes]:
    """A bitmap of the hashes of frequent phrases: its bits, a power of two, and their bytes.

    Up to _MOST_BITS / _BITS_EACH (eight million) phrases it lets about one
    other in sixteen through; with more it grows no further and lets more
    through, so more is counted, with the same result.
    """
    bits = min(_MOST_BITS, 1 << max(15, (n_rows * _BITS_EACH - 1).bit_length()))
    cell = F.col("h").bitwiseAND(F.lit(bits - 1))
    # Rows of 32768 bits, so _MOST_BITS makes 4096 of them.
    rows = frequent.select(F.call_function("shiftright", cell, F.lit(15)).alias("k"), cell.bitwiseAND(F.lit(32767)).alias("at")).groupBy("k").agg(F.bitmap_construct_agg("at").alias("map"))
    out = bytearray(bits // 8)
    for r in rows.collect():
        out[r.k * 4096 : r.k * 4096 + 4096] = r.map
    return bits, bytes(out)


def _passes(h: np.ndarray, bits: int, table: np.ndarray) -> np.ndarray:
    cell = h & np.uint64(bits - 1)
    return (table[cell >> np.uint64(3)] >> (cell & np.uint64(7)).astype(np.uint8)) & 1 == 1


def _together(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Batches put together to about size bytes each, so that more of equal phrases meet before they are shuffled."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.nbytes for b in held) >= size:
            yield pa.concat_batches(held)
            held = []
    if held:
        yield pa.concat_batches(held)


def phrase_counts(chunks: DataFrame, n: int, shorter: tuple[int, bytes] | None = None) -> DataFrame:
    """lang, phrase, h, n: the phrases of n words and how often they occur; h is a hash of a phrase in its language.

    With shorter, the filter of frequent phrases of n - 1 words, phrases whose
    begin or end isn't frequent are left out: they can't be frequent either.
    """
    spark = chunks.sparkSession
    bits = shorter[0] if shorter else 0
    # Of bounded size: see _filter_of().
    sent = spark.sparkContext.broadcast(shorter[1]) if shorter else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.frombuffer(sent.value, np.uint8) if sent else None
        for batch in _together(batches, _TOGETHER):
            if batch.num_rows:
                yield _count(batch, n, bits, table)

    counted = chunks.mapInArrow(releasing(run), _COUNTED)
    return counted.groupBy("lang", "phrase").agg(F.min("h").alias("h"), F.sum("n").alias("n"))


def _count(batch: pa.RecordBatch, n: int, bits: int, table: np.ndarray | None) -> pa.RecordBatch:
    langs, own, times = (batch.column(c) for c in ("lang", "own", "n"))
    raw = batch.column("chunk").to_pylist()
    whole = " ".join(raw)
    words = word_hashes([whole])[0]
    again = mixed(words, 1)
    names = langs.dictionary_encode()
    seeds = np.array([crc32(x.encode()) for x in names.dictionary.to_pylist()], np.uint64)[names.indices.to_numpy(zero_copy_only=False)]
    counts = np.array([x.count(" ") + 1 for x in raw])
    starts = np.cumsum(counts) - counts
    chunk = np.repeat(np.arange(len(raw)), counts)
    place = np.arange(len(words)) - starts[chunk]
    seed = mixed(seeds, 7)[chunk]

    def joined_at(h: np.ndarray, k: int, at: np.ndarray) -> np.ndarray:
        out = seed[at]
        for i in range(k):
            out = mixed(out + h[at + i] * np.uint64(2 * i + 1), i + 1)
        return out

    def joined(h: np.ndarray, k: int) -> np.ndarray:
        """Hashes of the k words from each place on; those that go over a chunk's end mean nothing."""
        out = seed.copy()
        for i in range(k):
            out[: len(h[i:])] = mixed(out[: len(h[i:])] + h[i:] * np.uint64(2 * i + 1), i + 1)
        return out

    ok = (place < own.to_numpy()[chunk]) & (place + n <= counts[chunk])
    if table is not None:
        short = _passes(joined(words, n - 1), bits, table)
        ok[:-1] &= short[1:]
        ok &= short
    at = np.flatnonzero(ok)
    first, second = joined_at(words, n, at), joined_at(again, n, at)
    order = np.argsort(first, kind="stable")
    first, second, at = first[order], second[order], at[order]
    # Two hashes tell phrases apart; where they are the same phrase all the same, later sums are by its text.
    heads = np.flatnonzero(np.r_[True, (first[1:] != first[:-1]) | (second[1:] != second[:-1])]) if len(at) else at
    sums = np.add.reduceat(times.to_numpy()[chunk[at]], heads) if len(at) else at
    said = pa.array(_phrases(whole.encode(), at[heads], n), pa.binary()).cast(pa.string())
    return pa.RecordBatch.from_arrays([langs.take(pa.array(chunk[at[heads]])), said, pa.array(first[heads].view(np.int64)), pa.array(sums, pa.int64())], names=["lang", "phrase", "h", "n"])


def _phrases(words: bytes, at: np.ndarray, n: int) -> list[bytes]:
    """The texts of n words from the places at on; words are joined by single spaces."""
    ends = np.flatnonzero(np.frombuffer(words + b" ", np.uint8) == 32)
    begins = np.r_[0, ends[:-1] + 1]
    return [words[a:b] for a, b in zip(begins[at].tolist(), ends[at + n - 1].tolist())]


def _score(a: Column, n: Column, left: Column, right: Column) -> Column:
    """floor(1000 a n / (l r)); exact for counts under 10^15."""
    whole = lambda c: c.cast("decimal(15,0)")
    top = (F.lit(1000).cast("decimal(4,0)") * whole(a)).cast("decimal(19,0)") * whole(n)
    return F.call_function("div", top, whole(left) * whole(right))


def _inner(words: Column, shortest: int, longest: Column) -> Column:
    """All runs of words of shortest to longest words, as an array of texts."""
    of_size = lambda k: F.transform(F.sequence(F.lit(1), F.size(words) - k + 1), lambda i: F.array_join(F.slice(words, i, k), " "))
    return F.flatten(F.transform(F.sequence(F.lit(shortest), longest), of_size))


def _salted(rows: DataFrame, part: str, frequent: DataFrame, name: str, salts: int = 16) -> DataFrame:
    """rows with the count of their phrase part. Many rows may have one part, so they are salted and single words are repeated."""
    single = ~F.col("phrase").contains(" ")
    side = frequent.select(F.col("lang").alias("_l"), F.col("phrase").alias("_p"), F.col("n").alias(name), F.explode(F.when(single, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))).alias("_k"))
    salt = F.when(F.col(part).contains(" "), F.lit(0)).otherwise(F.pmod(F.xxhash64("phrase"), F.lit(salts)).cast("int"))
    return rows.join(side, (F.col("lang") == F.col("_l")) & (F.col(part) == F.col("_p")) & (salt == F.col("_k"))).drop("_l", "_p", "_k")


def collocations(docs: DataFrame, least: int = 100, longest: int = 5, top: int = 2000, covered: int = 100, lang: str = "lang", text: str = "text") -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's phrases that stand together most.

    A phrase of 2 to longest words with a = f(phrase) >= least is scored by its
    worst cut into two parts with counts l and r: floor(1000 a n / (l r)), n being all words of the
    language. It goes where a longer such phrase holds it and has covered hundredths
    of its occurrences. Order: score, then a, both descending, then phrase in UTF-8 order.

    Null language is `und`, null or empty text has no word. Each row is a
    document, equal rows count each. Other columns are not read. An empty table,
    or one without frequent phrases, gives no row.
    """
    chunks = written(parse(docs, longest, lang, text), "chunks")
    words = chunks.groupBy("lang").agg(F.sum(F.col("n") * F.col("own")).alias("_all"))
    levels, shorter = [], None
    for k in range(1, longest + 1):
        found = written(phrase_counts(chunks, k, shorter).where(F.col("n") >= least), "phrases")
        levels.append(found)
        n_rows = found.count()
        if not n_rows:
            break
        shorter = _filter_of(found, n_rows) if k < longest else None
    frequent = levels[0]
    for found in levels[1:]:
        frequent = frequent.unionByName(found)
    phrase = F.split("phrase", " ")
    candidates = frequent.where(F.contains("phrase", F.lit(" "))).select("lang", "phrase", F.col("n").alias("a"), phrase.alias("_words"))
    longer = candidates.where(F.size("_words") > 2).select("lang", F.explode(_inner(F.col("_words"), 2, F.size("_words") - 1)).alias("phrase"), F.col("a").alias("_longer"))
    hidden = longer.groupBy("lang", "phrase").agg(F.max("_longer").alias("_longer"))
    kept = candidates.join(hidden, ["lang", "phrase"], "left").where(F.col("_longer").isNull() | (100 * F.col("_longer") < covered * F.col("a")))
    cut = F.explode(F.transform(F.sequence(F.lit(1), F.size("_words") - 1), lambda k: F.struct(k.alias("k"), F.array_join(F.slice("_words", F.lit(1), k), " ").alias("left"), F.array_join(F.slice("_words", k + 1, F.size("_words") - k), " ").alias("right"))))
    cuts = kept.select("lang", "phrase", "a", cut.alias("_cut")).select("lang", "phrase", "a", "_cut.*")
    cuts = _salted(_salted(cuts, "left", frequent, "l"), "right", frequent, "r")
    # One row a language meets many phrases of it, so it is repeated too.
    spread = words.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(63))))
    cuts = cuts.withColumn("_k", F.pmod(F.xxhash64("phrase"), F.lit(64)).cast("int")).join(spread, ["lang", "_k"])
    cuts = cuts.withColumn("score", _score(F.col("a"), F.col("_all"), F.col("l"), F.col("r")))
    worst = cuts.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r", F.col("_all").alias("n"))).alias("w")).select("lang", "phrase", "w.*")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # Many phrases may be of one language: first the best of each part of them, then the best of all.
    parts = worst.withColumn("_part", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    some = parts.withColumn("_n", F.row_number().over(Window.partitionBy("lang", "_part").orderBy(*order))).where(F.col("_n") <= top)
    best = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("bigint")).where(F.col("rank") <= top)
    return best.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
