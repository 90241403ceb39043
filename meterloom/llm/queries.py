"""One query for each operator of this subpackage, over whole tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, divergence, langid, line_dedup, media, ngram_join, packing, phrases, pii, secrets, token_files, topk, weak_rules
from .shared import bounded_batches, new_path, written


def tokenizer_path(name: str) -> str:
    """Where the public tokenizer files of this installation are; pass another path to the operators to use other files."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar_groups(_table(spark, sf_dir, "documents"), n=4, num=85, den=100).select("doc_id", "n_shingles", "component_id", "n_links")


def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(_table(spark, sf_dir, "embeddings"), k=20, is_query=F.col("vec_id") % 20 == 0)


def op3_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The files are stored as a column and read back; what is read back is what the digests are of.
    stored = written(media.encode_texts(_table(spark, sf_dir, "documents")), "media")
    return media.media_digests(stored)


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "token-files")
    token_files.write_token_files(_table(spark, sf_dir, "documents"), path, tokenizer_path("word_bpe_49k.json"))
    return token_files.token_digests(spark, path)


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip_digests(_table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(_table(spark, sf_dir, "documents"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    out = line_dedup.drop_frequent_lines(docs, min_docs=10, digest=True)
    return out.select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_dropped").alias("n_dropped"), F.col("_kept_sha256").alias("kept_sha256"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), window=2048)


def op9_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang", langid.held_out().alias("held_out"))
    model = langid.fit(docs.where(~F.col("held_out")).select("doc_id", "text", "lang"))
    return langid.predict(docs.drop("lang"), model).select("doc_id", "held_out", "lang_pred", "score", "rejected")


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(_table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return found.select("doc_id", F.col("_start").alias("start"), F.col("_end").alias("end"), F.sha2("_value", 256).alias("value_sha256"), F.col("_score").alias("score"))


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(_table(spark, sf_dir, "documents"), min_docs=10, top=10)


def op12_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = weak_rules.judge(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    named = [F.col(f"_{c}").alias(c) for c in (*weak_rules.MEASURES, "base_failed", "kept", "quality", "votes")]
    return found.select("doc_id", *named)


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(_table(spark, sf_dir, "documents"), least=100, longest=5, top=2000)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_ngram_join": op1_ngram_join,
        "op2_topk": op2_topk,
        "op3_media": op3_media,
        "op4_token_files": op4_token_files,
        "op5_bpe": op5_bpe,
        "op6_pii": op6_pii,
        "op7_line_dedup": op7_line_dedup,
        "op8_packing": op8_packing,
        "op9_langid": op9_langid,
        "op10_secrets": op10_secrets,
        "op11_divergence": op11_divergence,
        "op12_quality": op12_quality,
        "op13_phrases": op13_phrases,
    }


_OP7_SQL = r"""
WITH lines AS (
  SELECT doc_id, i, line,
         lower_az(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', '')) AS k
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
               generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i
        FROM documents)
), frequent AS (
  SELECT k FROM lines WHERE k <> '' GROUP BY k HAVING count(DISTINCT doc_id) >= 10
)
SELECT l.doc_id, count(*) AS n_lines, count(f.k) AS n_dropped,
       sha256(coalesce(string_agg(l.line, chr(10) ORDER BY l.i) FILTER (f.k IS NULL), '')) AS kept_sha256
FROM lines l LEFT JOIN frequent f ON l.k = f.k
GROUP BY l.doc_id
""".replace("lower_az(", "translate(").replace("'[\\x20\\x09-\\x0D]+$', ''))", "'[\\x20\\x09-\\x0D]+$', ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")


_OP1_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN []
    WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s
  FROM words
), tokens AS (
  SELECT doc_id, unnest(s) AS t FROM sets
), shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o
  FROM tokens a JOIN tokens b ON a.t = b.t AND a.doc_id <> b.doc_id GROUP BY 1, 2
), links AS (
  SELECT a, b FROM shared JOIN sets x ON x.doc_id = a JOIN sets y ON y.doc_id = b
  WHERE 100 * o >= 85 * (len(x.s) + len(y.s) - o)
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM sets
  UNION
  SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, r.component_id, (SELECT count(*) FROM links l WHERE l.a = s.doc_id) AS n_links
FROM sets s JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) r ON r.a = s.doc_id
"""

_OP2_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""


_OP11_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS d, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
  FROM documents
), groups AS (
  SELECT DISTINCT lang, source FROM docs
), words AS (
  SELECT d, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs
), kept AS (
  SELECT lang, term FROM words GROUP BY lang, term HAVING count(DISTINCT d) >= 10
), c AS (
  SELECT lang, source, term, count(*) AS n FROM words JOIN kept USING (lang, term) GROUP BY lang, source, term
), sizes AS (
  SELECT g.lang, g.source, coalesce(sum(c.n), 0)::HUGEINT AS total, (SELECT count(*) FROM kept k WHERE k.lang = g.lang)::HUGEINT AS v
  FROM groups g LEFT JOIN c ON c.lang = g.lang AND c.source = g.source GROUP BY g.lang, g.source
), p AS (
  SELECT s.lang, s.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 2)) // (s.total + 2 * s.v) AS p
  FROM sizes s JOIN kept k ON k.lang = s.lang LEFT JOIN c ON c.lang = s.lang AND c.source = s.source AND c.term = k.term
), q AS (
  SELECT lang, term, 1 + (1000000000::HUGEINT * (sum(n) + 2)) // (sum(sum(n)) OVER (PARTITION BY lang) + 2 * count(*) OVER (PARTITION BY lang)) AS q
  FROM c GROUP BY lang, term
), pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), every AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(x.value, 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pairs x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
  UNION ALL
  SELECT p.lang, p.source, 'term', p.term, ((p.p - q.q) * (p.p - q.q)) // (p.p + q.q)
  FROM p JOIN q ON p.lang = q.lang AND p.term = q.term WHERE p.n > 0 AND p.p > q.q
), ranked AS (
  SELECT lang, source, part, item, CAST(value AS BIGINT) AS value,
         CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
  FROM every
)
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 10
"""


_OP13_SQL = r"""
WITH pieces AS (
  SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS w
  FROM (SELECT coalesce(lang, 'und') AS lang,
               unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
        FROM documents)
), starts AS (
  SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM pieces
), f AS (
  SELECT lang, m, array_to_string(w[i:i + m - 1], ' ') AS phrase, count(*) AS n
  FROM starts, range(1, 6) t(m) WHERE i + m - 1 <= len(w) GROUP BY ALL
), total AS (
  SELECT lang, sum(n) AS n FROM f WHERE m = 1 GROUP BY lang
), c AS (
  SELECT lang, m, phrase, n AS a, string_split(phrase, ' ') AS w FROM f WHERE m > 1 AND n >= 100
), hidden AS (
  SELECT x.lang, array_to_string(x.w[i:i + k - 1], ' ') AS phrase, max(x.a) AS longer
  FROM c x, range(2, 5) k(k), range(1, 5) i(i) WHERE k < x.m AND i + k - 1 <= x.m GROUP BY ALL
), cuts AS (
  SELECT c.lang, c.phrase, c.a, k.k, l.n AS l, r.n AS r, t.n,
         (1000::HUGEINT * c.a * t.n) // (l.n::HUGEINT * r.n) AS score
  FROM c LEFT JOIN hidden h ON h.lang = c.lang AND h.phrase = c.phrase
  JOIN range(1, 5) k(k) ON k.k < c.m
  JOIN f l ON l.lang = c.lang AND l.m = k.k AND l.phrase = array_to_string(c.w[1:k.k], ' ')
  JOIN f r ON r.lang = c.lang AND r.m = c.m - k.k AND r.phrase = array_to_string(c.w[k.k + 1:c.m], ' ')
  JOIN total t ON t.lang = c.lang
  WHERE h.longer IS NULL OR 100 * h.longer < 100 * c.a
), worst AS (
  SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS o FROM cuts
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM worst WHERE o = 1
)
SELECT lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM ranked WHERE rank <= 2000
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_ngram_join": _OP1_SQL, "op2_topk": _OP2_SQL, "op7_line_dedup": _OP7_SQL, "op11_divergence": _OP11_SQL, "op13_phrases": _OP13_SQL}
