"""Quality of documents by weak supervision: rules vote, and how far each can be trusted is learned from where they agree.

Each rule says high, low or nothing of a document. Rules err, each in its own
way; expectation-maximisation finds shares of high documents and of right votes
under which the corpus's votes are likeliest. A document's quality is the
probability of high, given its votes. No label is read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import ASCII_SPACE, fresh, releasing, written

_SYMBOLS = b"#*$%&|<>"
_UPPER, _LOWER = bytes(range(65, 91)), bytes(range(97, 123))
_NO_LETTERS = bytes(b for b in range(128) if not chr(b).isalpha())
_WINDOW = 5
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: What rules look at besides: lines with a word, words with a letter or a symbol, those that end a sentence, the commonest word's number, letters A-Z and a-z.
_MORE = ("n_lines", "n_letter_words", "n_symbol_words", "n_ends", "n_commonest", "n_upper", "n_lower")

#: name, low if, high if. Neither holds: the rule says nothing. Whole numbers on both sides, so no rounding decides.
#: What can be wrong with a text is looked at by two rules or more in different ways, since they are trusted where they agree.
RULES = (
    ("length", "n_words < 10", "n_words >= 50"),
    ("word_length", "word_chars < 2 * n_words or word_chars > 15 * n_words", "word_chars between 3 * n_words and 10 * n_words"),
    ("symbols", "10 * n_symbols > n_words", "100 * n_symbols <= n_words"),
    ("symbol_words", "5 * n_symbol_words > n_words", "50 * n_symbol_words <= n_words"),
    ("dup_lines", "10 * n_dup_lines > 3 * n_lines", "n_dup_lines = 0 and n_lines >= 3"),
    ("repeats", "10 * n_repeat_words > n_words", "100 * n_repeat_words <= n_words"),
    ("commonest", "n_words >= 20 and 5 * n_commonest > n_words", "n_words >= 20 and 8 * n_commonest <= n_words"),
    ("letters", "10 * n_letter_words < 8 * n_words", "100 * n_letter_words >= 98 * n_words"),
    ("capitals", "10 * n_upper > 3 * (n_upper + n_lower)", "10 * n_upper <= n_upper + n_lower"),
    ("sentences", "2 * n_ends > n_words or (n_ends = 0 and n_words >= 50)", "n_ends between n_words div 60 and n_words div 3"),
)


def _repeated(words: list[bytes]) -> int:
    """Words that lie in a run of five words which the text holds twice or more."""
    runs = list(zip(*[words[i:] for i in range(_WINDOW)]))
    if len(set(runs)) == len(runs):
        return 0
    times, covered, upto = Counter(runs), 0, 0
    for i, run in enumerate(runs):
        if times[run] > 1:
            covered += i + _WINDOW - max(i, upto)
            upto = i + _WINDOW
    return covered


def measured(text: str) -> tuple[int, ...]:
    """MEASURES and what the rules look at besides, of one whole text."""
    data = text.encode()
    words = data.split()
    lines = [x for x in data.split(b"\n") if x.strip(ASCII_SPACE)]
    letters = sum(1 for w in words if w.translate(None, _NO_LETTERS))
    symbols = sum(1 for w in words if len(w.translate(None, _SYMBOLS)) < len(w))
    commonest = max(Counter(words).values(), default=0)
    ends = sum(1 for w in words if w[-1] in b".?!")
    without = lambda drop: len(data) - len(data.translate(None, drop))
    return (len(words), len(text) - without(ASCII_SPACE), without(_SYMBOLS), len(lines) - len(set(lines)), _repeated(words), len(lines), letters, symbols, ends, commonest, without(_UPPER), without(_LOWER))


def measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs without the text, with MEASURES and what the rules look at; columns of those names must not be there."""
    kept = [c for c in docs.columns if c != text]
    names = [*MEASURES, *_MORE]
    rows = docs.select(*[F.col(f"`{c}`") for c in kept], F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias(text))
    schema = rows.drop(text).schema
    for n in names:
        schema = schema.add(n, "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [measured(t) for t in batch.column(len(kept)).to_pylist()]
            columns = zip(*found) if found else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], *[pa.array(c, pa.int64()) for c in columns]], names=[*kept, *names])

    return rows.mapInArrow(releasing(run), schema)


def votes() -> Column:
    """A letter for each rule, in order: h, l or - for nothing."""
    return F.concat(*[F.when(F.expr(low), "l").when(F.expr(high), "h").otherwise("-") for _, low, high in RULES])


@dataclass
class Model:
    """What was learned: the share of high documents, and for each rule how often it votes high on high documents and low on low ones."""

    share: float
    right_high: np.ndarray
    right_low: np.ndarray

    def log_odds(self, said: np.ndarray) -> np.ndarray:
        """Of high against low, for rows of votes 1 (high), -1 (low) and 0."""
        up = np.log(self.right_high / (1 - self.right_low))
        down = np.log((1 - self.right_high) / self.right_low)
        return np.log(self.share / (1 - self.share)) + (said == 1) @ up + (said == -1) @ down


def fit(patterns: list[tuple[str, int]], rounds: int = 50, high_prior: tuple[float, float] = (9.0, 1.0), low_prior: tuple[float, float] = (3.0, 7.0)) -> Model:
    """Expectation-maximisation over votes() and the number of documents with them.

    It starts from what a filter by all rules would say, softened: 0.95 without
    a low vote, 0.5 with one, 0.05 with more. Priors of right votes on high and on
    low documents weigh as much as ten documents of a thousand each. A vote for
    low never counts in favour of a document, nor one for high against it.
    """
    patterns = sorted(patterns)
    said = np.array([[{"h": 1, "l": -1}.get(x, 0) for x in p] for p, _ in patterns])
    n = np.array([c for _, c in patterns], float)
    scale = n.sum() / 1000
    high, low = said == 1, said == -1
    faults = low.sum(1)
    q = np.select([faults == 0, faults == 1], [0.95, 0.5], 0.05)

    def right(votes: np.ndarray, weight: np.ndarray, prior: tuple[float, float]) -> np.ndarray:
        return (votes.T @ weight + prior[0] * scale) / ((high | low).T @ weight + sum(prior) * scale)

    model = None
    for _ in range(rounds):
        share = float(np.clip((q * n).sum() / n.sum(), 0.01, 0.99))
        right_high = np.clip(right(high, q * n, high_prior), 0.5, 0.999)
        model = Model(share, right_high, np.clip(right(low, (1 - q) * n, low_prior), 1 - right_high, 0.999))
        q = 1 / (1 + np.exp(-model.log_odds(said)))
    return model


def judge(docs: DataFrame, text: str = "text", least: float = 0.5) -> DataFrame:
    """docs without the text, with _-prefixed MEASURES, _base_failed, _quality and _kept.

    Base fails with fewer than ten words, or with more than a fifth of the words
    in repeated runs. Others are kept if their quality is least or more. All
    documents vote, base failures too; the patterns of votes, 3^10 at most, are what comes
    to the driver.

    Null and empty text has no word and fails. Each row is a document, equal rows
    alike. Other columns pass as they are; a name that is taken gets another
    underscore. An empty table gives no row.
    """
    names = {c: f"c{i}" for i, c in enumerate(docs.columns) if c != text}
    plain = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()], F.col(f"`{text}`").alias("text"))
    rows = written(measures(plain).withColumn("votes", votes()), "votes")
    model = fit([(r.votes, r.n) for r in rows.groupBy("votes").agg(F.count("*").alias("n")).collect()]) if rows.limit(1).count() else Model(0.5, *np.full((2, len(RULES)), 0.5))
    odds = F.lit(float(np.log(model.share / (1 - model.share))))
    up, down = np.log(model.right_high / (1 - model.right_low)), np.log((1 - model.right_high) / model.right_low)
    for i, (a, b) in enumerate(zip(up.tolist(), down.tolist())):
        vote = F.substring("votes", i + 1, 1)
        odds = odds + F.when(vote == "h", a).when(vote == "l", b).otherwise(0.0)
    rows = rows.withColumn("quality", F.round(1 / (1 + F.exp(-odds)), 6))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    rows = rows.withColumns({"base_failed": failed, "kept": ~failed & (F.col("quality") >= least)})
    taken = docs.drop(text)
    return rows.select(*[F.col(n).alias(c) for c, n in names.items()], *[F.col(c).alias(fresh(taken, f"_{c}")) for c in (*MEASURES, "votes", "quality", "base_failed", "kept")])
