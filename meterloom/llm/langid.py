"""Language identification by nearest centroids of TF-IDF vectors of character n-grams.

Fitting passes over all labelled documents once for the document frequency of
each n-gram bucket, and clusters a bounded sample of each language: its
centroids are what a document is compared with, by cosine. A document is rejected
if it is farther from its nearest centroid than this centroid's radius for texts
of its length: short texts have lower cosines. Radii come from a low quantile of
the cosines of the sample documents and of pieces of them, each taken without its
document's own part in the centroid, so single odd documents don't widen them.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import fresh, release, releasing

#: Hash buckets of n-grams, and the n of the n-grams.
BUCKETS, ORDERS = 1 << 14, (1, 2, 3)
#: Documents sampled for each language on average, and at most; centroids for each language.
SAMPLE, MOST, CLUSTERS = 500, 1000, 4
#: Languages that are learned at most, those with most documents first.
LANGUAGES = 1000
#: Length classes: texts of 2**k letters and more, up to the last k.
CLASSES = 13
#: This share of the low quantile of cosines still lies inside; a quantile is taken of so many cosines at least.
LOW, INSIDE, LEAST = 0.05, 0.5, 10
UNKNOWN = "und"


@functools.cache
def _letters() -> np.ndarray:
    """Whether each code point of the basic plane is a letter."""
    return np.array([chr(i).isalpha() for i in range(1 << 16)])


def buckets_of(text: str) -> tuple[np.ndarray, np.ndarray] | None:
    """The distinct n-gram buckets of a text in lower case and their counts; None without a letter.

    Everything that is not a letter is one space between words.
    """
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    low = points < 1 << 16
    letter = np.zeros(len(points), bool)
    letter[low] = _letters()[points[low]]
    if not low.all():
        letter[~low] = [chr(c).isalpha() for c in points[~low].tolist()]
    if not letter.any():
        return None
    letter = np.concatenate(([False], letter, [False]))
    points = np.where(letter, np.concatenate(([0], points, [0])), 0).astype(np.uint64)
    points = points[letter | np.concatenate(([True], letter[:-1]))]
    found = []
    for n in ORDERS:
        if len(points) >= n:
            h = np.full(len(points) - n + 1, n, np.uint64)
            for k in range(n):
                h = (h ^ points[k : len(points) - n + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
                h ^= h >> np.uint64(29)
            found.append((h >> np.uint64(3)) % np.uint64(BUCKETS))
    counts = np.bincount(np.concatenate(found).astype(np.int64), minlength=BUCKETS)
    at = np.flatnonzero(counts)
    return at, counts[at]


def _weights(at: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    w = (1 + np.log(counts)) * idf[at]
    return (w / max(np.sqrt((w * w).sum()), 1e-12)).astype(np.float32)


def _lowered(texts: pa.Array, step: int = 512) -> Iterator[list[str | None]]:
    for at in range(0, len(texts), step):
        yield pc.utf8_lower(texts.slice(at, step)).to_pylist()


def _length_class(counts: np.ndarray) -> int:
    return min(int(counts.sum()) // len(ORDERS), 1 << (CLASSES - 1)).bit_length() - 1


@dataclass
class Model:
    languages: list[str]  # of each centroid
    centroids: np.ndarray  # (centroids, BUCKETS), of length one each
    radii: np.ndarray  # (centroids, CLASSES)
    idf: np.ndarray

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, cosine with its nearest centroid, and whether the document is rejected. The text is in lower case."""
        found = buckets_of(text) if text else None
        if found is None or not self.languages:
            return UNKNOWN, 0.0, True
        at, counts = found
        cosines = self.centroids[:, at] @ _weights(at, counts, self.idf)
        best = int(cosines.argmax())
        score = float(min(max(cosines[best], 0.0), 1.0))
        return self.languages[best], score, bool(1 - score > self.radii[best, _length_class(counts)])


def _clusters(vectors: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Centroids by k-means on the sphere, begun with vectors drawn at random."""
    centers = vectors[np.random.default_rng(0).choice(len(vectors), min(k, len(vectors)), replace=False)].copy()
    for _ in range(rounds):
        own = (vectors @ centers.T).argmax(axis=1)
        for j in range(len(centers)):
            if (own == j).any():
                mean = vectors[own == j].sum(axis=0)
                centers[j] = mean / max(float(np.linalg.norm(mean)), 1e-12)
    return centers


def _radii(texts: list[str], vectors: np.ndarray, centers: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """(centroids, CLASSES). A centroid with few cosines of a length has its language's radius; lengths longer than all that were seen have that of the longest."""
    own = (vectors @ centers.T).argmax(axis=1)
    sums = np.array([vectors[own == j].sum(axis=0) for j in range(len(centers))])
    norms = (sums * sums).sum(axis=1)
    seen = []
    for text, x, mine in zip(texts, vectors, own.tolist()):
        rest = norms.copy()
        rest[mine] += 1 - 2 * float(sums[mine] @ x)
        for size in [1 << k for k in range(1, CLASSES) if 1 << k < len(text)] + [len(text)]:
            start = text.find(" ", (len(text) - size) // 2) + 1 if size < len(text) else 0
            found = buckets_of(text[start : start + size])
            if found is None:
                continue
            at, w = found[0], _weights(*found, idf)
            dots = sums[:, at] @ w
            dots[mine] -= x[at] @ w
            cosines = np.where(rest > 1e-6, dots / np.sqrt(np.maximum(rest, 1e-6)), -1)
            seen.append((int(cosines.argmax()), _length_class(found[1]), max(float(cosines.max()), 0.0)))
    near, length, cosine = (np.array(x) for x in zip(*seen))
    radii = np.ones((len(centers), CLASSES))
    for k in range(CLASSES):
        for j in range(len(centers)):
            chosen = cosine[(length == k) & (near == j)]
            chosen = chosen if len(chosen) >= LEAST else cosine[length == k]
            radii[j, k] = 1 - INSIDE * np.quantile(chosen, LOW) if len(chosen) >= LEAST else radii[j, max(k - 1, 0)]
    return radii


def fit(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> Model:
    """Learns from rows with text and lang; rows where one is null or the text has no letter are left out.

    About `sample` rows of each language, chosen by a hash of the row and never
    more than twice as many, are clustered; repeated texts count once there. Of
    labels, the LANGUAGES with most rows are learned. The sample is put in order
    before it is used, so equal rows give an equal model however they are dealt.
    """
    rows = labelled.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.xxhash64(*[F.col(c) for c in labelled.columns]).alias("h")).where("lang IS NOT NULL AND text IS NOT NULL")

    @releasing
    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(BUCKETS, np.int64), 0
        for batch in batches:
            for texts in _lowered(batch.column(0)):
                for text in texts:
                    found = buckets_of(text)
                    if found is not None:
                        total[found[0]] += 1
                        n += 1
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1).astype(np.int32)), pa.array(np.append(total[at], n))], ["bucket", "n"])

    counted = rows.select("text").mapInArrow(frequencies, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    df, n = np.zeros(BUCKETS), 0
    for r in counted:
        if r.bucket < 0:
            n = r.n
        else:
            df[r.bucket] = r.n
    idf = np.log((1 + n) / (1 + df)) + 1
    sizes = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES).collect()}
    if not sizes:
        return Model([], np.zeros((0, BUCKETS), np.float32), np.zeros((0, CLASSES)), idf)
    share = F.create_map(*[x for lang, size in sizes.items() for x in (F.lit(lang), F.lit(min(1.0, sample / size)))])
    picked = rows.where(F.pmod("h", F.lit(1 << 20)) < share[F.col("lang")] * (1 << 20)).select("lang", "text").distinct().withColumn("h", F.xxhash64("text"))
    most = 2 * sample

    def cluster(table: pa.Table) -> pa.Table:
        table = table.sort_by([("h", "ascending"), ("text", "ascending")]).slice(0, most)
        texts = pc.utf8_lower(table.column("text")).to_pylist()
        pairs = [(t, x) for t, x in zip(texts, map(buckets_of, texts)) if x is not None]
        texts, found = [t for t, _ in pairs], [x for _, x in pairs]
        schema = pa.schema([("lang", pa.string()), ("center", pa.binary()), ("radii", pa.list_(pa.float64()))])
        if not found:
            return pa.Table.from_pylist([], schema)
        vectors = np.zeros((len(found), BUCKETS), np.float32)
        for row, x in zip(vectors, found):
            row[x[0]] = _weights(*x, idf)
        centers = _clusters(vectors, CLUSTERS)
        lang = table.column("lang")[0].as_py()
        return pa.Table.from_pylist([{"lang": lang, "center": c.tobytes(), "radii": r.tolist()} for c, r in zip(centers, _radii(texts, vectors, centers, idf))], schema)

    found = picked.groupBy("lang").applyInArrow(cluster, "lang string, center binary, radii array<double>").collect()
    found.sort(key=lambda r: (r.lang, r.center))
    centers = np.array([np.frombuffer(r.center, np.float32) for r in found]).reshape(len(found), BUCKETS)
    return Model([r.lang for r in found], centers, np.array([r.radii for r in found]).reshape(len(found), CLASSES), idf)


def scored(text: Column, model: Model) -> Column:
    """struct<lang_pred, score, rejected> of a column of whole texts.

    The language of a text that is null, empty or without a letter is `und`, its
    score 0, and it is rejected. Every row stands for itself; equal texts get
    equal results. Without a labelled row in fit() all are `und`. Only texts go
    to Python; the rows they stand in stay where they are.
    """

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kinds = {"lang_pred": pa.string(), "score": pa.float64(), "rejected": pa.bool_()}
        try:
            for texts in batches:
                done = [model.predict(t) for part in _lowered(texts) for t in part]
                yield pa.StructArray.from_arrays([pa.array([d[i] for d in done], k) for i, k in enumerate(kinds.values())], list(kinds))
        finally:
            release()

    return F.arrow_udf(run, "lang_pred string, score double, rejected boolean")(text)


def predict(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs with lang_pred, score (0 to 1) and rejected as scored() tells; columns of these names are replaced."""
    added = ["lang_pred", "score", "rejected"]
    found = fresh(docs, "_scored")
    rows = docs.drop(*[c for c in added if c != text_col]).withColumn(found, scored(F.col(text_col), model))
    return rows.select(*[c for c in rows.columns if c != found and c not in added], *[F.col(f"{found}.{c}").alias(c) for c in added])


def recognised(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of docs that are not rejected, as they are."""
    return docs.where(~scored(F.col(text_col), model)["rejected"])


def held_out(id_col: str = "doc_id") -> F.Column:
    """True where crc32 of the id as text leaves 1 when divided by 3; false for null ids."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))
