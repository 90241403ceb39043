"""How far the sources of a language differ in their words, from bitmaps of terms by count.

A group is a language and a source. With f for two smoothed frequencies p and q,
the distance of two groups is the sum of f over all terms. p hangs on a group and
a term's count there alone, so for two groups it is enough to know how many terms
have count x in one and y in the other. Each group's terms with one count are a
bitset; AND and a count of bits give those joint cells, each is multiplied by its
f, and the cells of terms that a group lacks follow by complement.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import releasing, written

#: Bytes of a term stay, A-Z in lower case; any other ASCII character ends one.
_TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: Terms that a task counts before it hands them on.
_HELD = 200_000
_COUNTS = "lang string, source string, term string, n bigint, docs bigint"
#: Terms of a bundle, the unit of work, and groups of a tile; a pair of tiles meets in one task.
_BUNDLE, _TILE = 1024, 16
_SALTS = 64
_ONE = 1_000_000_000


def _texts(docs: DataFrame, lang: str, source: str, text: str) -> DataFrame:
    return docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for n, c in (("lang", lang), ("source", source), ("text", text))])


def term_counts(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text") -> DataFrame:
    """lang, source, term, n (occurrences) and docs (documents that hold it); a row with term null for each group."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[tuple[str, str], tuple[Counter, Counter]] = {}

        def rows() -> Iterator[pa.RecordBatch]:
            for (la, so), (n, held) in groups.items():
                terms = [None, *n]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([la] * len(terms)), pa.array([so] * len(terms)), pa.array([t and t.decode() for t in terms], pa.string()), pa.array([0, *n.values()], pa.int64()), pa.array([0, *[held[t] for t in n]], pa.int64())],
                    names=["lang", "source", "term", "n", "docs"],
                )
            groups.clear()

        size = 0
        for batch in batches:
            for la, so, text in zip(*[c.to_pylist() for c in batch.columns]):
                n, held = groups.setdefault((la, so), (Counter(), Counter()))
                terms, before = text.encode().translate(_TERM_BYTES).split(), len(n)
                n.update(terms)
                held.update(set(terms))
                size += len(n) - before + 1
                if size > _HELD:
                    yield from rows()
                    size = 0
        yield from rows()

    counted = _texts(docs, lang, source, text).mapInArrow(releasing(count), _COUNTS)
    return counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _smoothed(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(10^9 (n + 2) / (total + 2 terms)), exact for counts that fit 64 bits."""
    part = (n + 2).cast("decimal(20,0)") * F.lit(_ONE).cast("decimal(10,0)")
    return F.lit(1) + F.call_function("div", part, (total.cast("decimal(20,0)") + terms.cast("decimal(20,0)") * 2).cast("decimal(22,0)"))


def _f(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def dealt_terms(terms: DataFrame) -> DataFrame:
    """lang, term, bundle, word and bit: the place of each term in its language's bitsets.

    terms has lang, term and n, the language's count. Bundles hold terms of like
    frequency, the most frequent first, so that a group has few counts in a word.
    """
    rank = F.floor(F.log2(F.col("n").cast("double"))).cast("int")
    rows = terms.select("lang", "term", "n", rank.alias("_class"))
    size = rows.groupBy("lang", "_class").agg(F.ceil(F.count("*") / _BUNDLE).alias("_parts"))
    # A class may hold most terms, so its size is repeated and they are salted.
    size = size.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
    rows = rows.withColumn("_salt", F.pmod(F.xxhash64("term", "lang"), F.lit(_SALTS)).cast("int")).join(size, ["lang", "_class", "_salt"]).withColumn("_part", F.pmod(F.xxhash64("term"), F.col("_parts")))
    slot = F.row_number().over(Window.partitionBy("lang", "_class", "_part").orderBy(F.desc("n"), "term")) - 1
    rows = rows.withColumn("_slot", slot)
    return rows.select("lang", "term", F.concat_ws(":", "_class", "_part").alias("bundle"), F.floor(F.col("_slot") / 64).cast("int").alias("word"), (F.col("_slot") % 64).alias("bit"))


def bitmaps(kept: DataFrame, places: DataFrame) -> DataFrame:
    """lang, bundle, word, source, p, bits: a group's terms of one count, 64 terms a word.

    kept has lang, source, term and p, which tells counts apart; places is of dealt_terms().
    """
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("bit"))
    return kept.join(places, ["lang", "term"]).groupBy("lang", "bundle", "word", "source", "n", "p").agg(F.bit_or(bit).alias("bits"))


def _cells(rows: pd.DataFrame) -> pd.DataFrame:
    """Sums of f over the terms of a bundle, for the pairs of groups of two tiles.

    Rows with word -1 name the groups, with p of a count of 0; the bundle's terms
    in each word are those of size.
    """
    zero = rows[rows.word < 0].drop_duplicates("source").sort_values("source")
    names, p0, tiles = zero.source.tolist(), zero.p.to_numpy(np.int64), zero.tile.to_numpy()
    one_tile = rows["_t"].iloc[0] == rows["_u"].iloc[0]
    place = {s: i for i, s in enumerate(names)}
    sums = np.zeros((len(names), len(names)), np.int64)
    f00 = (p0[:, None] - p0) ** 2 // (p0[:, None] + p0)
    held = rows[rows.word >= 0]
    n_terms = int(zero["size"].iloc[0])
    at = held.source.map(place).to_numpy(np.int64)
    word, p, bits = held.word.to_numpy(), held.p.to_numpy(np.int64), held.bits.to_numpy(np.int64).view(np.uint64)
    order = np.lexsort((at, word))
    at, word, p, bits = at[order], word[order], p[order], bits[order]
    ends = np.searchsorted(word, np.arange((n_terms + 63) // 64 + 1))
    for w, (a, b) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist())):
        size, g, q = min(64, n_terms - 64 * w), at[a:b], p[a:b]
        if not len(g):
            sums += size * f00
            continue
        first = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
        here = g[first]
        both = np.bitwise_count(bits[a:b, None] & bits[a:b]).astype(np.int64)
        f = (q[:, None] - q) ** 2 // (q[:, None] + q)
        joint = np.add.reduceat(np.add.reduceat(both * f, first, axis=0), first, axis=1)
        seen = np.zeros((len(g), len(names)), np.int64)
        seen[:, here] = np.add.reduceat(both, first, axis=1)
        own = np.bitwise_count(bits[a:b]).astype(np.int64)
        # Terms of a row's count that the other group lacks, and those that both lack.
        lacking = np.zeros_like(sums)
        lacking[here] = np.add.reduceat((own[:, None] - seen) * ((q[:, None] - p0) ** 2 // (q[:, None] + p0)), first, axis=0)
        has, common = np.zeros(len(names), np.int64), np.zeros_like(sums)
        has[here] = np.add.reduceat(own, first)
        common[here] = np.add.reduceat(seen, first, axis=0)
        sums += lacking + lacking.T + (size - has[:, None] - has + common) * f00
        sums[np.ix_(here, here)] += joint
    i, j = np.nonzero(np.triu(np.ones_like(sums), 1) if one_tile else (tiles[:, None] < tiles))
    return pd.DataFrame({"lang": rows.lang.iloc[0], "a": [names[x] for x in i], "b": [names[x] for x in j], "value": sums[i, j]})


def pair_sums(bits: DataFrame, places: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, a, b, value: the sum of f over all kept terms, for each two groups of a language.

    groups has lang, source and p0. Bundles meet pairs of tiles of groups, so a
    task holds two tiles and a bundle, whatever the number of groups and terms.
    """
    n_tiles = groups.groupBy("lang").agg(F.ceil(F.count("*") / _TILE).cast("int").alias("_tiles"))
    placed = groups.join(n_tiles, "lang").withColumn("tile", F.pmod(F.xxhash64("source"), F.col("_tiles")).cast("int"))
    bundles = places.groupBy("lang", "bundle").agg(F.count("*").alias("size"))
    # Each bundle meets all groups of its language; salted, as one language may have most bundles.
    salted = placed.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
    zero = bundles.withColumn("_salt", F.pmod(F.xxhash64("bundle"), F.lit(_SALTS)).cast("int")).join(salted, ["lang", "_salt"])
    zero = zero.select("lang", "bundle", F.lit(-1).alias("word"), "source", F.col("p0").alias("p"), F.lit(0).cast("bigint").alias("bits"), "size", "tile", "_tiles")
    held = bits.join(placed.select("lang", "source", "tile", "_tiles"), ["lang", "source"]).select("lang", "bundle", "word", "source", "p", "bits", F.lit(None).cast("bigint").alias("size"), "tile", "_tiles")
    other = F.explode(F.sequence(F.lit(0), F.col("_tiles") - 1)).alias("_other")
    met = held.unionByName(zero).select("*", other).withColumns({"_t": F.least("tile", "_other"), "_u": F.greatest("tile", "_other")})
    schema = "lang string, a string, b string, value bigint"
    parts = met.drop("_other", "_tiles").groupBy("lang", "bundle", "_t", "_u").applyInPandas(_cells, schema)
    return parts.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def _ranked(rows: DataFrame, top: int | None) -> DataFrame:
    by = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    out = rows.withColumn("rank", F.row_number().over(by))
    return out if top is None else out.where(F.col("rank") <= top)


def audit(docs: DataFrame, min_docs: int = 10, top: int = 10, lang: str = "lang", source: str = "source", text: str = "text") -> DataFrame:
    """lang, source, part, item, value, rank: how far each source stands from each other one, and by which terms from its language.

    Part `pair` has a row for each other source of the language, part `term` the
    top terms that the source has more often than its language. Terms are runs of
    ASCII letters and of characters beyond ASCII, A-Z in lower case; a language
    keeps those in min_docs of its documents.

    Null text, language or source is ''. A text without terms still makes its
    group; in a language that keeps no term all pairs have 0. Each row is a
    document, equal rows too. Equal values stand by item in UTF-8 order. Other
    columns are not read. An empty table gives no row.
    """
    counts = written(term_counts(docs, lang, source, text), "term-counts")
    groups = counts.where("term IS NULL").select("lang", "source")
    terms = written(counts.where("term IS NOT NULL").groupBy("lang", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")).where(F.col("docs") >= min_docs).select("lang", "term", "n"), "kept-terms")
    whole = terms.groupBy("lang").agg(F.count("*").alias("v"), F.sum("n").alias("total"))
    kept = counts.where("term IS NOT NULL").join(terms.select("lang", "term", F.col("n").alias("_all")), ["lang", "term"])
    sums = kept.groupBy("lang", "source").agg(F.sum("n").alias("_total"))
    v, total = F.coalesce("v", F.lit(0)), F.coalesce("_total", F.lit(0))
    stats = groups.join(sums, ["lang", "source"], "left").join(whole, "lang", "left").select("lang", "source", v.alias("_v"), total.alias("_group"), F.coalesce("total", F.lit(0)).alias("_lang"))
    stats = written(stats.withColumn("p0", F.when(F.col("_v") > 0, _smoothed(F.lit(0).cast("bigint"), F.col("_group"), F.col("_v")))), "group-sizes")
    priced = kept.join(stats, ["lang", "source"]).withColumns({"p": _smoothed(F.col("n"), F.col("_group"), F.col("_v")), "q": _smoothed(F.col("_all"), F.col("_lang"), F.col("_v"))})
    priced = written(priced.select("lang", "source", "term", "n", "p", "q"), "term-shares")
    places = written(dealt_terms(terms), "term-places")
    found = pair_sums(bitmaps(priced, places), places, stats.where("_v > 0").select("lang", "source", "p0"))
    both = found.select("lang", F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))).alias("x"), "value").select("lang", "x.source", F.lit("pair").alias("part"), "x.item", "value")
    # A language without a kept term has no bundle; its pairs are of equal groups.
    bare = stats.where("_v = 0").select("lang", "source")
    equal = bare.join(bare.select("lang", F.col("source").alias("item")), "lang").where("source <> item").select("lang", "source", F.lit("pair").alias("part"), "item", F.lit(0).cast("bigint").alias("value"))
    over = priced.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), _f(F.col("p"), F.col("q")).alias("value"))
    return _ranked(both.unionByName(equal), None).unionByName(_ranked(over, top))
