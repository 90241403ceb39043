"""Secret scans: candidates by pattern, and a random forest that removes false positives.

Candidates are values assigned to a telling name, of any length, and strings of 16
characters and more, with a digit, that look like keys or hashes. The forest sees a
candidate's length, character classes and transitions, how likely its letters
follow each other in the corpus, how much of it is words of the corpus or of
programs, the document's path and the words before it. Letter pairs and words
are counted over all documents. The forest is trained on labelled findings.
Everything is DataFrame code and the forest is Spark's own.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import fresh, written
from .spans import matches

#: A string of characters that keys are made of, begun where no such character stands before.
_VALUE = r"(?:(?<![A-Za-z0-9+/_.~-])|\G)(?=[A-Za-z+/_.~-]*+[0-9])[A-Za-z0-9+/_.~-]{16,}+={0,2}"
#: Beginnings by which providers mark their keys. Fixed values.
_PROVIDER = r"^(?:AKIA|ASIA|ghp_|gho_|ghs_|ghu_|github_pat_|glpat-|xox[baprs]-|sk_live_|rk_live_|sk-|AIza|eyJ|npm_|SG\.)"
#: Names that secrets are assigned to, and an assignment right before the value.
_NAME = r"(?i)(?:token|secret|passw(?:or)?d|pwd|passphrase|api[_-]?key|access[_-]?key|private[_-]?key|auth|bearer|credential)"
_ASSIGNED = rf"{_NAME}[A-Za-z0-9_-]{{0,16}}[\"']?\s{{0,4}}(?:[:=]|=>|:=)?\s{{0,4}}[\"']?$"
#: A telling name, a sign and where the value begins; names that are the value of another come again as names.
_LEAD = rf"(?<![A-Za-z]){_NAME}[A-Za-z0-9_-]{{0,16}}[\"'`]?\s{{0,4}}(?::=|=>|={{1,3}}|:)\s{{0,4}}(?:(?:bearer|basic)\s{{1,4}})?".replace("(?<![A-Za-z])(?i)", "(?i)(?=[tspabc])")
#: The value of a telling name, of any length and characters: what is quoted on its line, or all to white space.
_GIVEN = rf"{_LEAD}(?![\[{{(\"'`]{{0,4}}{_LEAD[4:]})(?:\"[^\"\r\n]++(?=\")|'[^'\r\n]++(?=')|`[^`\r\n]++(?=`)|[^\s\"'`]\S*+)"
#: Words before a value, or in it, and parts of paths, by what they say of it.
_NEAR_WORDS = {
    "near_hash": r"(?i)\b(?:commit|sha1|sha256|md5|checksum|digest|hash|integrity|revision|etag|fingerprint)\b",
    "near_example": r"(?i)\b(?:example|dummy|sample|placeholder|your|fake|test)\b",
    "near_number": r"(?i)\b(?:uuid|guid|id|version|build|release|order|paid|card|phone)\b",
}
_PATHS = {
    "path_test": r"(?i)(?:^|[/_.-])(?:test|tests|example|examples|sample|fixture|fixtures|mock)(?:$|[/_.-])",
    "path_text": r"(?i)(?:^|[/_.-])(?:docs?|readme|lock|license|changelog)(?:$|[/_.-])",
    "path_config": r"(?i)(?:^|[/_.-])(?:config|conf|env|settings|secrets?|prod|deploy)(?:$|[/_.-])",
}
_UUID = r"^[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}$"
_WORDS = "access|account|admin|alpha|application|backup|beta|build|cache|change|client|common|config|connection|content|current|data|default|demo|development|document|domain|dummy|element|example|factory|field|file|folder|function|handler|identifier|image|index|input|insert|internal|item|library|local|manager|master|message|method|model|module|name|network|number|object|output|package|page|param|password|path|placeholder|private|process|production|project|property|public|query|release|remote|report|request|resource|response|result|return|sample|schema|secret|server|service|session|setting|simple|source|stack|string|system|table|template|test|text|thread|token|type|update|user|value|version|window|your"
FEATURES = ["spaces", "code", "plain", "passworded", "length", "digits", "upper", "lower", "marks", "transitions", "distinct", "hex", "covered", "common", "letters", "uuid", "provider", "assigned", "quoted", *_NEAR_WORDS, *_PATHS]
#: A word counts as one of the corpus if so many documents hold it; words of other lengths are not looked at.
COMMON, _LENGTHS = 5, (3, 24)
#: Texts with a candidate, and how many characters before one are looked at.
_ANY, _NEAR = rf"(?:{_VALUE})|(?:{_GIVEN})", 48
#: Candidates with at least this score are findings.
THRESHOLD = 0.5


def _near(found: Column, i: Column) -> Column:
    """The last characters of the text before match i, whatever other matches are in them."""
    last = F.transform(F.slice(found, F.greatest(i - 9, F.lit(0)) + 1, F.least(i, F.lit(9))), lambda m: F.concat(F.right(m["before"], F.lit(_NEAR)), F.right(m["value"], F.lit(_NEAR))))
    return F.right(F.concat(F.array_join(last, ""), F.right(F.get(found, i)["before"], F.lit(_NEAR))), F.lit(_NEAR))


def _all_candidates(text: Column) -> Column:
    """array<struct<start, end, value, near>>: the values of telling names, and strings that look like keys outside them."""

    def given(m: Column, near: Column) -> Column:
        lead = F.regexp_extract(m["value"], rf"^{_LEAD}[\"'`]?", 0)
        tail = F.regexp_extract(m["value"], r"[,;)\]}>\"'`]*$", 0)
        tail = F.when(F.right(lead, F.lit(1)).isin('"', "'", "`"), "").otherwise(tail)
        start, end = m["start"] + F.length(lead), m["end"] - F.length(tail)
        value = F.substr(m["value"], F.length(lead) + 1, end - start)
        return F.struct(start.alias("start"), end.alias("end"), value.alias("value"), F.right(F.concat(near, lead), F.lit(_NEAR)).alias("near"))

    def placed(pattern: str, made) -> Column:  # noqa: ANN001
        return F.transform(F.array(matches(text, pattern)), lambda a: F.transform(a, lambda m, i: made(m, _near(a, i))))[0]

    by_name = F.filter(placed(_GIVEN, given), lambda m: m["end"] > m["start"])
    alone = placed(_VALUE, lambda m, near: F.struct(m["start"].alias("start"), m["end"].alias("end"), m["value"].alias("value"), near.alias("near")))
    both = F.transform(F.array(F.struct(by_name.alias("g"), alone.alias("v"))), lambda b: F.concat(b["g"], F.filter(b["v"], lambda v: ~F.exists(b["g"], lambda g: (g["start"] == v["start"]) & (g["end"] == v["end"])))))
    return both[0]


@dataclass
class Words:
    """What is counted over a corpus: log2 of the share of each pair of letters a to z, and the words of at least COMMON documents."""

    pairs: list[float]
    words: DataFrame


def count_words(docs: DataFrame, text_col: str = "text") -> Words:
    """Counts over all whole texts. Null texts hold no word; an empty table gives no word and equal shares."""
    spelled = F.array_distinct(F.filter(F.split(F.lower(F.col(text_col)), "[^a-z]+"), lambda w: F.length(w).between(*_LENGTHS)))
    counts = docs.select(F.explode(spelled).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    words = written(counts.where(F.col("n") >= COMMON), "words")
    parts = F.transform(F.sequence(F.lit(1), F.length("word") - 1), lambda i: F.substr("word", i, F.lit(2)))
    # There are 26 * 26 pairs at most.
    found = {r.pair: r.n for r in words.select(F.explode(parts).alias("pair"), "n").groupBy("pair").agg(F.sum("n").alias("n")).collect()}
    total = sum(found.values())
    letters = "abcdefghijklmnopqrstuvwxyz"
    return Words([math.log2((found.get(a + b, 0) + 1) / (total + len(letters) ** 2)) for a in letters for b in letters], words.select("word"))


def _candidates(docs: DataFrame, text_col: str, path_col: str | None) -> DataFrame:
    """row (all columns but the text, so that their names meet no other), start, end, value, near and path of each candidate."""
    text, keep = F.col(text_col), [c for c in docs.columns if c != text_col]
    path = F.coalesce(F.col(path_col).cast("string"), F.lit("")) if path_col else F.lit("")
    row = F.struct(*[F.col(f"`{c}`") for c in keep], F.lit(0).alias(fresh(docs, "_")))
    return docs.where(text.rlike(_ANY)).select(row.alias("row"), path.alias("path"), F.explode(_all_candidates(text)).alias("m")).select("row", "path", "m.*")


def with_features(rows: DataFrame, corpus: Words) -> DataFrame:
    """rows (value, near: the text before it, and path) with the vector features, in the order of FEATURES.

    The rows are written, so that each has a number that stays, and the words in
    them are looked up among the corpus's by a join.
    """
    rows = written(rows.withColumn("number", F.monotonically_increasing_id()), "candidates")
    v = F.col("value")
    size = F.length(v).cast("double")
    runs = F.filter(F.split(F.lower(v), "[^a-z]+"), lambda w: F.length(w).between(*_LENGTHS))
    known = rows.select("number", F.explode(runs).alias("word")).join(corpus.words, "word").groupBy("number").agg(F.sum(F.length("word")).alias("known"))
    rows = rows.join(known, "number", "left")

    def share(pattern: str) -> Column:
        return F.regexp_count(v, F.lit(pattern)) / size

    covered = size - F.length(F.regexp_replace(v, f"(?i)(?:{_WORDS})", ""))
    # Pairs of letters within runs of letters, by their share in the corpus.
    pairs = F.filter(F.transform(F.sequence(F.lit(1), F.greatest(F.length(v) - 1, F.lit(1))), lambda i: F.substr(F.lower(v), i, F.lit(2))), lambda p: p.rlike("^[a-z]{2}$"))
    table = F.array(*map(F.lit, corpus.pairs))
    logs = F.transform(pairs, lambda p: F.get(table, (F.ascii(p) - 97) * 26 + F.ascii(F.substr(p, F.lit(2), F.lit(1))) - 97))
    found = {
        "spaces": share(" "),
        "code": v.rlike(r"^[$<{%\[(*]|[(\[{]|://|^(?:os|process|self|this|env|config|settings)\b").cast("double"),
        "plain": v.rlike(r"^[A-Za-z]?[a-z]*[.,:;!?]?$").cast("double"),
        "passworded": F.col("near").rlike(r"(?i)(?:passw(?:or)?d|pwd|passphrase)[A-Za-z0-9_-]{0,16}[\"'`]?\s{0,4}[:=]").cast("double"),
        "length": size,
        "digits": share("[0-9]"),
        "upper": share("[A-Z]"),
        "lower": share("[a-z]"),
        "marks": share("[^A-Za-z0-9]"),
        "transitions": share("[0-9](?=[A-Za-z])|[A-Za-z](?=[0-9])|[a-z](?=[A-Z])|[A-Z](?=[a-z])"),
        "distinct": F.size(F.array_distinct(F.split(v, ""))) / F.least(size, F.lit(64.0)),
        "hex": v.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$").cast("double"),
        "covered": covered / size,
        "common": F.coalesce(F.col("known"), F.lit(0)) / size,
        "letters": F.when(F.size(pairs) > 0, F.aggregate(logs, F.lit(0.0), lambda a, x: a + x) / F.size(pairs)).otherwise(F.lit(-math.log2(26 * 26))),
        "uuid": v.rlike(_UUID).cast("double"),
        "provider": v.rlike(_PROVIDER).cast("double"),
        "assigned": F.col("near").rlike(_ASSIGNED).cast("double"),
        "quoted": F.col("near").rlike("[\"']$").cast("double"),
        **{k: (F.col("near").rlike(p) | v.rlike(p)).cast("double") for k, p in _NEAR_WORDS.items()},
        **{k: F.col("path").rlike(p).cast("double") for k, p in _PATHS.items()},
    }
    return rows.withColumn("features", array_to_vector(F.array(*[found[k].cast("double") for k in FEATURES]))).drop("number", "known")


def candidates(docs: DataFrame, text_col: str = "text", path_col: str | None = "source") -> DataFrame:
    """One row for each candidate: all columns but the text, with _start, _end (code points, end exclusive) and _value.

    Null and empty texts have none; repeated rows have theirs each; null paths
    count as empty. Names that are taken get more underscores.
    """
    kept = [c for c in docs.columns if c != text_col]
    rest = docs.drop(text_col)
    named = [F.col(k).alias(fresh(rest, f"_{k}")) for k in ("start", "end", "value")]
    return _candidates(docs, text_col, path_col).select(*[F.col(f"row.`{c}`") for c in kept], *named)


def labelled_findings(spark: SparkSession, n: int = 6000) -> DataFrame:
    """n findings (value, near, path) with a label and their form, made by rule: keys in places where secrets stand, and hashes, names and versions where they don't.

    The values come from digests of row numbers, so they are alike in each run.
    No table at hand labels secrets; one of the user's own has the same columns.
    """
    i = F.col("id")
    hexes = F.sha2(F.concat(F.lit("finding"), i.cast("string")), 512)
    mixed = F.regexp_replace(F.base64(F.unhex(hexes)), "=+$", "")
    word = F.element_at(F.split(F.lit(_WORDS), r"\|"), (F.pmod(F.xxhash64(i), F.lit(90)) + 1).cast("int"))
    other = F.element_at(F.split(F.lit(_WORDS), r"\|"), (F.pmod(F.xxhash64(i, i), F.lit(90)) + 1).cast("int"))
    size = (F.pmod(F.xxhash64("id", F.lit(3)), F.lit(33)) + 16).cast("int")
    name = F.element_at(F.array(*map(F.lit, ["token", "api_key", "secret", "password", "AUTH_TOKEN", "access-key"])), (F.pmod(i, F.lit(6)) + 1).cast("int"))
    sign = F.element_at(F.array(*map(F.lit, [' = "', "=", ": ", ":'", ' => "'])), (F.pmod(F.floor(i / 6), F.lit(5)) + 1).cast("int"))
    assigned = F.concat(F.lit("the "), name, sign)
    uuid = F.concat_ws("-", F.substr(hexes, F.lit(1), F.lit(8)), F.substr(hexes, F.lit(9), F.lit(4)), F.substr(hexes, F.lit(13), F.lit(4)), F.substr(hexes, F.lit(17), F.lit(4)), F.substr(hexes, F.lit(21), F.lit(12)))
    digits = F.translate(hexes, "abcdef", "012345")
    version = F.concat_ws(".", word, other, F.pmod(i, F.lit(10)), F.pmod(F.floor(i / 7), F.lit(20)), F.lit("release"))
    letters = F.regexp_replace(F.translate(mixed, "0123456789", "kQwZrTyVbN"), "[^A-Za-z]", "x")
    marked = F.concat(F.substr(letters, F.lit(1), F.lit(2)), F.lit("@"), F.substr(mixed, F.lit(3), F.lit(4)), F.lit("!"), F.substr(hexes, F.lit(1), F.lit(3)))
    phrase = F.concat_ws(" ", word, other, F.lit("battery"), word)
    login = F.concat(F.lit("with "), F.element_at(F.array(*map(F.lit, ["password", "DB_PASSWORD", "pwd"])), (F.pmod(i, F.lit(3)) + 1).cast("int")), sign)
    quoted = F.concat(F.lit("set "), name, F.lit(' = "'))
    spoken = F.concat(F.lit("and the "), name, F.lit(": "))
    # (value, text before it, path, label)
    made = [
        (F.substr(hexes, F.lit(1), size), assigned, "src/app", 1),
        (F.substr(hexes, F.lit(1), F.lit(40)), assigned, "", 1),
        (F.substr(mixed, F.lit(1), size), assigned, "config/prod", 1),
        (F.concat(F.lit("ghp_"), F.regexp_replace(F.substr(mixed, F.lit(1), F.lit(36)), "[^A-Za-z0-9]", "x")), F.lit("with "), "", 1),
        (F.concat(F.lit("AKIA"), F.upper(F.substr(hexes, F.lit(1), F.lit(16)))), F.lit("id: "), "", 1),
        (F.substr(hexes, F.lit(1), F.lit(40)), F.lit("in commit "), "", 0),
        (F.substr(hexes, F.lit(1), F.lit(64)), F.lit("sha256: "), "", 0),
        (F.substr(hexes, F.lit(1), size), F.lit("and the "), "", 0),
        (uuid, F.lit("the id is "), "", 0),
        (F.substr(digits, F.lit(1), F.lit(16)), F.lit("paid by "), "", 0),
        (F.substr(digits, F.lit(1), size), assigned, "tests/data", 0),
        (F.concat_ws("_", F.lit("your"), word, other, F.pmod(i, F.lit(100))), assigned, "docs/guide", 0),
        (F.concat_ws("-", word, other, F.lit("example"), F.pmod(i, F.lit(100))), assigned, "", 0),
        (version, F.lit("version "), "", 0),
        (F.concat_ws("/", word, other, F.lit("index2"), word), F.lit("see "), "", 0),
        (F.substr(mixed, F.lit(1), size), F.lit("checksum "), "package.lock", 0),
        # Short values, values without a digit, with other marks, of several words; and what else stands after telling names.
        (F.concat(F.initcap(word), F.lpad(F.pmod(F.xxhash64(i), F.lit(1000)).cast("string"), 3, "7")), login, "", 1),
        (F.concat(F.substr(mixed, F.lit(1), F.lit(5)), F.lpad(F.pmod(F.xxhash64(i), F.lit(1000)).cast("string"), 3, "7")), login, "src/app", 1),
        (F.substr(letters, F.lit(1), F.lit(16)), quoted, "", 1),
        (F.substr(letters, F.lit(1), size), assigned, "src/app", 1),
        (marked, login, "", 1),
        (F.concat(marked, F.lit("#"), F.substr(digits, F.lit(1), F.lit(4))), assigned, "config/prod", 1),
        (phrase, F.lit('the passphrase = "'), "", 1),
        (word, spoken, "", 0),
        (word, assigned, "", 0),
        (F.concat(word, F.lit(",")), spoken, "", 0),
        (F.concat(F.lit("${"), F.upper(word), F.lit("}")), login, "", 0),
        (F.concat(F.lit("os.environ["), F.upper(word), F.lit("]")), assigned, "src/app", 0),
        (F.concat(word, F.lit("_"), other, F.lit("()")), assigned, "src/app", 0),
        (F.concat(F.lit("<your-"), word, F.lit(">")), login, "", 0),
        (F.concat_ws("_", F.lit("S3"), F.upper(word), F.lit("SECRET_KEY=")), F.lit("export "), "", 0),
        (F.concat(F.lit("https://"), word, F.lit(".org/"), other), spoken, "", 0),
    ]
    kinds = F.array(*[F.struct(v.alias("value"), b.alias("near"), F.lit(p).alias("path"), F.lit(float(y)).alias("label"), F.lit(form).alias("form")) for form, (v, b, p, y) in enumerate(made)])
    return spark.range(n).select(F.get(kinds, F.pmod(i, F.lit(len(made))).cast("int")).alias("k")).select("k.*")


@dataclass
class Scanner:
    """A forest and the counts over the corpus that its features need."""

    model: RandomForestClassificationModel
    corpus: Words

    def scores(self, rows: DataFrame) -> DataFrame:
        """rows (value, near, path) with score, the forest's share of votes for a secret."""
        scored = self.model.transform(with_features(rows, self.corpus))
        return scored.withColumn("score", F.round(vector_to_array("probability")[1], 6)).drop("features", "rawPrediction", "probability", "prediction")


def train(labelled: DataFrame, corpus: Words) -> Scanner:
    """The forest, from rows with value, near, path and label (1 for a secret)."""
    vectors = with_features(labelled, corpus).select("features", "label")
    return Scanner(RandomForestClassifier(numTrees=40, maxDepth=8, seed=7).fit(vectors), corpus)


def find_secrets(docs: DataFrame, scanner: Scanner | None = None, text_col: str = "text", path_col: str | None = "source") -> DataFrame:
    """The findings: all columns of docs but the text, with _start, _end (code points, end exclusive), _value and _score.

    One row for each candidate that the forest scores THRESHOLD or more; a string
    that looks like a key inside a longer value is one of its own. Rows
    with null or empty texts have none; repeated rows have their findings each;
    null paths count as empty; names that are taken get more underscores; an
    empty table gives no row. Without a scanner one is trained on
    labelled_findings() and the words of docs.
    """
    scanner = scanner or train(labelled_findings(docs.sparkSession), count_words(docs, text_col))
    found = scanner.scores(_candidates(docs, text_col, path_col)).where(F.col("score") >= THRESHOLD)
    rest = docs.drop(text_col)
    named = [F.col(k).alias(fresh(rest, f"_{k}")) for k in ("start", "end", "value", "score")]
    return found.select(*[F.col(f"row.`{c}`") for c in rest.columns], *named)


def redact(docs: DataFrame, text_col: str = "text", path_col: str | None = "source", id_col: str = "doc_id", mark: str = "[SECRET]", scanner: Scanner | None = None) -> DataFrame:
    """docs with each finding in the texts replaced by a mark; all else stays as it is.

    Only texts with a candidate are joined to findings, by id and a hash of the
    text; rows with equal or null ids are told apart by that. Null texts stay
    null; an empty table gives an empty one. Without a scanner one is trained as
    in find_secrets().
    """
    scanner = scanner or train(labelled_findings(docs.sparkSession), count_words(docs, text_col))
    key, spans, h2, id2 = (fresh(docs, x) for x in ("_h", "_spans", "_h2", "_id2"))
    suspect = F.coalesce(F.col(text_col).rlike(_ANY), F.lit(False))
    rows = docs.where(suspect).withColumn(key, F.xxhash64(text_col))
    asked = rows.select(F.col(id_col).alias(id2), F.col(key).alias(h2), F.col(text_col).alias("text"), *([F.col(path_col).alias("source")] if path_col else []))
    found = find_secrets(asked.dropDuplicates([id2, h2]), scanner, path_col="source" if path_col else None)
    by_doc = found.groupBy(id2, h2).agg(F.array_sort(F.collect_list(F.struct("_start", "_end"))).alias(spans))
    joined = rows.join(by_doc, F.col(id_col).eqNullSafe(F.col(id2)) & (F.col(key) == F.col(h2)), "left")
    text = F.col(text_col)
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    step = lambda s, m: F.when(m["_start"] < s["at"], F.struct(F.greatest(s["at"], m["_end"]).alias("at"), s["out"].alias("out"))).otherwise(F.struct(m["_end"].alias("at"), F.concat(s["out"], F.substr(text, s["at"] + 1, m["_start"] - s["at"]), F.lit(mark)).alias("out")))
    done = F.aggregate(spans, start, step, lambda s: F.concat(s["out"], F.substr(text, s["at"] + 1)))
    cut = joined.withColumn(text_col, F.when(F.col(spans).isNull(), text).otherwise(done)).select(*docs.columns)
    return docs.where(~suspect).unionByName(cut)
