"""Personal data: fixed patterns, and contexts bootstrapped from what they find.

Spans of the fixed patterns are the seeds. Each word-like token with a digit or
an @ is an instance, the two words before it are a pattern. Patterns and
instances form a graph that is scored in rounds: a pattern's confidence is the
share of all its places in the corpus, whatever follows it there, at which an
instance believed to be personal data stands; an instance is believed as far as
its patterns are trusted. Instances in trusted patterns that no fixed pattern
found are added. Everything is DataFrame code.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import written
from .spans import joined, matches

KINDS = ("email", "ip", "card", "phone")
#: The fixed patterns, written so that Java's matcher neither recurses nor tries one run of characters from each of its places.
_PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
#: A token with a digit or @, and what is stripped from its ends.
_TOKEN = r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+"
#: Rounds of scoring; a pattern counts with so many different believed instances, and is trusted from this confidence on.
ROUNDS, SUPPORT, TRUST = 3, 3, 0.5


def _valid(kind: str, value: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return value.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$")
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "card":
        return F.length(digits).between(14, 19) & F.call_function("luhn_check", digits)
    return F.length(digits).between(10, 15)


def base_spans(text: Column) -> Column:
    """array<struct<start, order, kind, end>> of the fixed patterns' valid matches, by start, then kind as listed."""
    def of_kind(order: int, kind: str) -> Column:
        valid = F.filter(matches(text, _PATTERNS[kind]), lambda m: _valid(kind, m["value"]))
        return F.transform(valid, lambda m: F.struct(m["start"].alias("start"), F.lit(order).alias("order"), F.lit(kind).alias("kind"), m["end"].alias("end")))

    found = [of_kind(i, k) for i, k in enumerate(KINDS)]
    return F.array_sort(F.concat(*found))


def _words(text: Column) -> Column:
    """The words of a text in lower case."""
    return F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")


def _tokens(text: Column, base: Column) -> Column:
    """Instances with their pattern and the kind of the base span that begins in them, if one does."""

    def one(m: Column, w: Column, at: Column) -> Column:
        context = F.when(at >= 2, F.concat_ws(" ", F.get(w, at - 2), F.get(w, at - 1))).otherwise("")
        seed = F.get(F.filter(base, lambda b: (b["start"] >= m["start"]) & (b["start"] < m["end"])), F.lit(0))
        # The span of an addition is the token without marks at its ends.
        head = F.length(F.regexp_extract(m["value"], r"^[^\p{L}\p{N}+]*+", 0))
        tail = F.length(F.regexp_extract(m["value"], r"[^\p{L}\p{N}]*$", 0))
        covered = F.exists(base, lambda b: (b["start"] < m["end"]) & (b["end"] > m["start"]))
        return F.struct((m["start"] + head).alias("start"), (m["end"] - tail).alias("end"), F.lower(m["value"]).alias("instance"), context.alias("context"), seed["kind"].alias("seed"), covered.alias("covered"))

    # The words with a digit or @ are the tokens, in the same order. Lambdas' variables hold the arrays, so that they are computed once.
    found = F.transform(F.array(matches(text, _TOKEN)), lambda m: F.struct(m.alias("m"), F.when(F.size(m) > 0, _words(text)).otherwise(F.array().cast("array<string>")).alias("w")))
    placed = F.transform(found, lambda b: F.struct(b["m"].alias("m"), b["w"].alias("w"), F.filter(F.transform(b["w"], lambda w, i: F.when(w.rlike("[0-9@]"), i)), lambda i: i.isNotNull()).alias("at")))
    tokens = F.transform(placed, lambda b: F.transform(b["m"], lambda m, j: one(m, b["w"], F.get(b["at"], j))))[0]
    return F.filter(tokens, lambda t: (t["context"] != "") & (t["end"] > t["start"]))


def _most(kind: Column) -> Column:
    """The kind with the most places (column n) of a group, the first by name of several; null without one."""
    named = sorted(KINDS)
    sums = [F.sum(F.when(kind == k, F.col("n")).otherwise(F.lit(0))) for k in named]
    best = F.greatest(*sums)
    return F.coalesce(*[F.when((s == best) & (s > 0), F.lit(k)) for k, s in zip(named, sums)])


def _discovered(docs: DataFrame, found: DataFrame) -> DataFrame:
    """id, h, kind, start and end of instances that trusted patterns add. docs has text, found has tokens."""
    edges = written(found.select("id", "h", F.explode("tokens").alias("t")).select("id", "h", "t.*"), "pii-edges")
    # Only patterns with enough instances can ever be trusted; their places are counted over all texts.
    asked = written(edges.groupBy("context").agg(F.count_distinct("instance").alias("n")).where(F.col("n") >= SUPPORT).select(F.xxhash64("context").alias("key"), "context"), "pii-patterns")
    pairs = docs.where(F.col("text").isNotNull()).select(_words(F.col("text")).alias("w")).where(F.size("w") > 2)
    keys = F.transform(F.sequence(F.lit(0), F.size("w") - 3), lambda i: F.xxhash64(F.concat_ws(" ", F.get("w", i), F.get("w", i + 1))))
    # Each task adds up its own places before they are dealt by key, so a common context is a row for each task, and the join sees it once.
    places = pairs.select(F.explode(keys).alias("key")).groupBy("key").agg(F.count("*").alias("places"))
    totals = written(asked.join(places, "key").select("context", "places"), "pii-places")
    located = edges.join(totals, "context")
    # Places of one instance in one context are alike, so scoring sees them once, with their number.
    known = written(located.groupBy("context", "instance", "seed").agg(F.count("*").alias("n"), F.first("places").alias("places")), "pii-graph")
    scores = known.groupBy("instance").agg(F.max(F.col("seed").isNotNull().cast("double")).alias("score"), F.max(F.col("seed").isNotNull()).alias("is_seed"), _most(F.col("seed")).alias("own"))
    # Sums of fractions hang on the order of rows, so they are rounded before they are compared.
    for _ in range(ROUNDS):
        believed = known.join(scores, "instance")
        strong = F.when(F.col("score") >= TRUST, F.col("instance"))
        # A context without a seed has the kind of its believed instances.
        kind = F.coalesce(_most(F.col("seed")), _most(F.when(F.col("score") >= TRUST, F.col("own"))))
        patterns = believed.groupBy("context").agg(F.round(F.sum(F.col("score") * F.col("n")), 6).alias("mass"), F.first("places").alias("places"), F.count_distinct(strong).alias("support"), kind.alias("kind"))
        patterns = written(patterns.where(F.col("support") >= SUPPORT).select("context", "kind", F.least(F.col("mass") / F.col("places"), F.lit(1.0)).alias("confidence")).where(F.col("confidence") >= TRUST), "pii-trusted")
        # Belief of an instance: one less the chance that all of its patterns are wrong, place by place.
        doubt = F.exp(F.sum(F.col("n") * F.log(F.greatest(1 - F.coalesce("confidence", F.lit(0.0)), F.lit(1e-9)))))
        scores = believed.join(patterns, "context", "left").groupBy("instance").agg(F.max("is_seed").alias("is_seed"), F.max("own").alias("own"), F.max(F.struct("confidence", "kind"))["kind"].alias("kind"), doubt.alias("doubt"))
        scores = scores.select("instance", "is_seed", F.when(F.col("is_seed"), F.col("own")).otherwise(F.col("kind")).alias("own"), F.when(F.col("is_seed"), F.lit(1.0)).otherwise(F.round(1 - F.col("doubt"), 6)).alias("score"))
    added = located.where(~F.col("covered")).join(scores.where(F.col("score") >= TRUST), "instance").join(patterns.where("kind IS NOT NULL"), "context")
    return added.select("id", "h", "kind", "start", "end").distinct()


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_email, n_ip, n_card, n_phone, base_sha256, spans and added as text, and n_spans, the number of all spans.

    One row for each row of docs. A null text counts as empty and has no span.
    Rows with null or equal ids stand for themselves; equal rows get equal
    results. Base spans of different kinds may overlap. added holds what the
    bootstrapped patterns contribute; spans holds both, by start, then kind.
    Other columns are not read; an empty table gives no row.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("h", F.xxhash64("text"))
    located = rows.withColumn("base", base_spans(F.col("text")))
    found = written(located.select("id", "h", "base", _tokens(F.col("text"), F.col("base")).alias("tokens")), "pii-found")
    order = F.create_map(*[x for i, k in enumerate(KINDS) for x in (F.lit(k), F.lit(i))])
    span = F.struct("start", order[F.col("kind")].alias("order"), "kind", "end")
    added = _discovered(rows, found).groupBy(F.col("id").alias("_id"), F.col("h").alias("_h")).agg(F.array_sort(F.collect_list(span)).alias("more"))
    out = found.join(added, F.col("id").eqNullSafe(F.col("_id")) & (F.col("h") == F.col("_h")), "left")

    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    more = F.coalesce("more", F.array().cast("array<struct<start:int,order:int,kind:string,end:int>>"))
    spans = F.concat("base", more)
    return out.select(F.col("id").alias(id_col), *map(count, KINDS), F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.array_sort(spans)).alias("spans"), joined(more).alias("added"), F.size(spans).cast("bigint").alias("n_spans"))
