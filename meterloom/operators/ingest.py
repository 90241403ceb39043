"""Raw log rows to records and issues, as whole-table jobs.

A log's lines carry source_path and line_no; lines are filtered and reduced to a
few columns before anything else. What hangs on what stands before a line in its
file is found in two levels: within a slot of lines by a window, and from the
slots before by a carry of each slot. So one huge file is the work of many tasks.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import variants as V
from ..functions.paths import folders_above
from ..schema import TOKENS, as_issues, as_records

#: Paths under which rows name things, in the order in which they count. Fixed values.
ALIASES = {
    "model": ["model", "message.model", "response.model", "payload.model", "payload.collaboration_mode.settings.model"],
    "session": ["sessionId", "session_id", "conversationId", "conversation_id", "chatId", "chat_id"],
    "context": ["sessionId", "session_id", "conversationId", "conversation_id", "uuid", "payload.id", "payload.session_id"],
    "start": ["startedAt", "started_at", "timestamp", "createdAt", "created_at"],
    "end": ["endedAt", "ended_at", "completedAt", "completed_at"],
    "observed": ["observedAt", "observed_at", "timestamp", "createdAt", "created_at"],
    "usage": ["payload.info.last_token_usage", "usage", "message.usage", "response.usage", "payload.usage"],
    "cost": ["costUsd", "costUSD", "cost_usd", "totalCostUsd", "totalCostUSD", "total_cost_usd", "billing.costUsd", "billing.costUSD", "billing.cost_usd"],
    "input": ["input", "inputTokens", "input_tokens"],
    "output": ["output", "outputTokens", "output_tokens"],
    "cached_input": ["cachedInput", "cached_input", "cachedInputTokens", "cached_input_tokens"],
    "cache_read": ["cacheRead", "cache_read", "cache_read_input_tokens"],
    "cache_write_5m": ["cacheWrite5m", "cache_write_5m", "cacheWrite", "cache_write", "ephemeral_5m_input_tokens", "cache_creation.ephemeral_5m_input_tokens", "cache_creation_input_tokens"],
    "cache_write_1h": ["cacheWrite1h", "cache_write_1h", "ephemeral_1h_input_tokens", "cache_creation.ephemeral_1h_input_tokens"],
}
#: The names that counter logs use. Fixed values.
COUNTERS = {
    "input": ["input_tokens", "inputTokens", "input"],
    "cached_input": ["cached_input_tokens", "cachedInputTokens", "cachedInput", "cached_input"],
    "output": ["output_tokens", "outputTokens", "output"],
}
#: Line types that carry bulk text, and keys whose presence makes such a line count as context all the same. Fixed values.
BULK_TYPES = ("compacted", "response_item")
CONTEXT_KEYS = ("model", "usage", "sessionId", "session_id", "conversationId", "conversation_id", "uuid")


_TOTALS = "payload.info.total_token_usage"
_BILLED = ("cost.total", "cost.currency")
#: What may stand in an object with counts. Rows hold these names at several places, or are such an object themselves.
_COUNTS = list(dict.fromkeys([*(p for t in TOKENS for p in ALIASES[t]), *(p for found in COUNTERS.values() for p in found), *_BILLED]))
#: Names of struct fields are told apart without regard to case, so names that differ by case alone are read by a second look.
_TWICE = [p for p in ALIASES["cost"] if p.endswith("USD")]
_ONCE = [p for p in ALIASES["cost"] if p not in _TWICE]
#: Every place that records are made from.
PLACES = list(
    dict.fromkeys(
        [
            *_COUNTS, *[f"{at}.{p}" for at in ("tokens", *ALIASES["usage"], _TOTALS) for p in _COUNTS], *_ONCE,
            *[p for k in ("model", "session", "context", "start", "end", "observed") for p in ALIASES[k]], "type", "id", "provider", "payload.type",
        ]
    )
)
#: Of these, the places that counter logs are read at. Every field of the parsed struct is copied with each row, so there are no others.
COUNTER_PLACES = list(
    dict.fromkeys(
        [
            *[f"{at}.{p}" for at in (*ALIASES["usage"], _TOTALS) for found in COUNTERS.values() for p in found],
            *[p for k in ("model", "context", "start", "end", "observed") for p in ALIASES[k]], "type", "payload.type",
        ]
    )
)


def held(df: DataFrame, *columns: str | Column) -> DataFrame:
    """Like select(), but the columns are computed there and nowhere else.

    The optimizer puts a column's expression into each filter above that names
    it, so a text would be parsed again for each. It does not look through the
    one-element explode here.
    """
    return df.select(F.explode(F.array(F.struct(*columns))).alias("_r")).select("_r.*")


#: Lines of a slot, the part of a file that one window spans.
SLOT_LINES = 100_000


def in_slots(rows: DataFrame, lasts: dict[str, tuple[str, bool]], wholes: dict[str, Column] | None = None, counts: dict[str, Column] | None = None, slot_lines: int = SLOT_LINES) -> DataFrame:
    """rows with the last value of columns before each row, with what holds of its whole file, and with running counts.

    lasts has, by name, a column and whether the row's own value counts; nulls
    are passed over. wholes has, by name, min() or max() aggregates over the file;
    counts has conditions, whose rows are counted up to each row and with it.
    A slot folds into one row of its last values; these are gone through file
    by file and given to the slots that follow. Rows are dealt by slot once.
    Rows without a path or number have nothing before them but in their slot.
    """
    wholes, counts = wholes or {}, counts or {}
    slot = F.floor(F.col("line_no") / slot_lines).cast("bigint")
    dealt = rows.withColumn("_slot", slot).repartition("source_path", "_slot")
    found_in = F.col("source_path").isNotNull() & F.col("_slot").isNotNull()
    ends = {f"_end_{n}": F.max_by(c, F.when(F.col(c).isNotNull(), F.col("line_no"))) for n, (c, _) in lasts.items()}
    folded = dealt.groupBy("source_path", "_slot").agg(*[c.alias(n) for n, c in ends.items()], *[c.alias(n) for n, c in wholes.items()], *[F.count_if(c).alias(f"_end_{n}") for n, c in counts.items()])
    file = Window.partitionBy("source_path")
    before = file.orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    carried = [F.last(f"_end_{n}", ignorenulls=True).over(before).alias(f"_from_{n}") for n in lasts] + [F.sum(f"_end_{n}").over(before).alias(f"_from_{n}") for n in counts]
    # A whole is a minimum or maximum, and so is one of those of slots.
    whole = [(F.min if n.startswith("_min") else F.max)(n).over(file) for n in wholes]
    # A file of one slot has nothing to carry, so what meets the rows is as small as the long files are few.
    carries = folded.select(F.col("source_path").alias("_file"), F.col("_slot").alias("_part"), *carried, *[c.alias(f"_from_{n}") for n, c in zip(wholes, whole)], F.count("*").over(file).alias("_slots")).where("_slots > 1").drop("_slots")
    here = Window.partitionBy("source_path", "_slot").orderBy("line_no")
    upto, entire = here.rowsBetween(Window.unboundedPreceding, 0), here.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    found = dealt.withColumns({n: F.last(c, ignorenulls=True).over(upto if own else here.rowsBetween(Window.unboundedPreceding, -1)) for n, (c, own) in lasts.items()} | {n: F.count_if(c).over(upto) for n, c in counts.items()} | {n: F.when(found_in, c.over(entire)) for n, c in wholes.items()})
    # By the keys that rows are dealt by, so they stay where they are.
    met = found.join(carries, (F.col("source_path") == F.col("_file")) & (F.col("_slot") == F.col("_part")), "left")
    out = met.withColumns({n: F.coalesce(F.col(n), F.col(f"_from_{n}")) for n in lasts} | {n: F.coalesce(F.col(f"_from_{n}"), F.col(n)) for n in wholes} | {n: F.col(n) + F.coalesce(F.col(f"_from_{n}"), F.lit(0)) for n in counts})
    return out.drop("_slot", "_file", "_part", *[f"_from_{n}" for n in (*lasts, *wholes, *counts)])


def skip_bulk(lines: DataFrame) -> DataFrame:
    """Leaves out lines whose type, named near their begin, carries bulk text, unless a context key occurs in them. Done on the text, before any parsing."""
    kind = F.regexp_extract(F.substring("value", 1, 120), r'^.{0,80}?"type":"([^"]*)"', 1)
    context = F.col("value").rlike(rf'"(?:{"|".join(CONTEXT_KEYS)})"\s*:')
    # A plain search tells most lines apart from bulk ones before the patterns are tried.
    named = _any_of("value", [f'"type":"{k}"' for k in BULK_TYPES])
    return lines.where(~named | ~kind.isin(*BULK_TYPES) | context)


def _any_of(column: str, texts: list[str]) -> Column:
    return reduce(Column.__or__, [F.col(column).contains(x) for x in texts])


#: Names of which a line of a counter log holds one if a record, a state or an issue can be made of it. A name may also stand there in escapes.
_TELLING = sorted({p.split(".")[-1] for k in ("model", "context", "usage") for p in ALIASES[k]} | {_TOTALS.split(".")[-1]})


def telling(lines: DataFrame) -> DataFrame:
    """Leaves out lines of counter logs that hold none of the names that rows are made of. Done on the text, before any parsing; such lines may still be broken."""
    # An object of info says something even without these; heartbeats, of which there are many, have null there.
    info = F.replace("value", F.lit('"info":null'), F.lit("")).contains('"info"')
    return lines.where(_any_of("value", [*[f'"{n}"' for n in _TELLING], "\\"]) | info)


def _looked_up(text: Column, places: list[str], twice: list[str]) -> list[Column]:
    again = V.parse_object(F.when(text.rlike("CostUSD|costUSD"), text), twice) if twice else F.lit(None)
    return [V.parse_object(text, places).alias("r"), again.alias("r2")]


def parse_rows(lines: DataFrame, recover: bool = False, places: list[str] | None = None, keep: bool = False) -> tuple[DataFrame, DataFrame]:
    """Rows (source_path, line_no, r, r2) of the lines that are JSON objects, and issues for those that are not; blank lines are neither.

    r is the struct of V.parse_object() for the places, r2 that of names that
    differ from others by case alone. With recover, a line that begins with a
    backslash and a brace is read without the backslash. Rows and issues come
    from one parsed frame; keep persists it, for callers that use both.
    """
    text = F.trim("value")
    if recover:
        text = F.when(text.startswith("\\{"), F.substr(text, F.lit(2))).otherwise(text)
    # The parser accepts text after a complete value; an object's line must end with its brace.
    whole = F.when(~text.startswith("{") | text.endswith("}"), text)
    texts = lines.where(F.trim("value") != "").select("source_path", "line_no", whole.alias("t"))
    read = held(texts, "source_path", "line_no", "t", *_looked_up(F.col("t"), places or PLACES, [] if places else _TWICE))
    # Texts without a fault are not looked at again.
    v = F.try_parse_json("t")
    fault = F.when(F.col("t").isNull(), "error").when(F.col(f"r.{V.ODD}").isNotNull(), F.when(v.isNull(), "error").when(~V.is_object(v), "warning"))
    rows = None if keep else read.where(fault.isNull()).select("source_path", "line_no", "r", "r2")
    read = held(read, "source_path", "line_no", "r", "r2", fault.alias("fault"))
    read = read.persist() if keep else read
    broken = F.col("fault") == "error"
    issues = read.where("fault IS NOT NULL").select(
        F.col("fault").alias("severity"),
        F.when(broken, "malformed_jsonl").otherwise("record_not_object").alias("code"),
        F.when(broken, "line is not valid JSON").otherwise("line is not an object").alias("message"),
        "source_path", "line_no",
    )
    # Rows alone need no other copy of what was parsed.
    return read.where("fault IS NULL").drop("fault") if keep else rows, as_issues(issues)


def rows_of(documents: DataFrame) -> DataFrame:
    """Rows as of parse_rows() from (source_path, line_no, v VARIANT), such as scan_json_docs() gives; values that are no objects give none."""
    text = F.when(V.is_object(F.col("v")), F.to_json("v"))
    return held(documents, "source_path", "line_no", *_looked_up(text, PLACES, _TWICE)).where("r IS NOT NULL")


def token_source(r: Column) -> Column:
    """The object of a generic row that holds its counts: tokens, else a usage object, else the row."""
    tops = list(dict.fromkeys(p.split(".")[0] for p in _COUNTS))
    return F.coalesce(*[V.leaf(r, p) for p in ("tokens", *ALIASES["usage"])], F.struct(*[r[t].alias(t) for t in tops]))


def normalise_tokens(source: Column) -> Column:
    """The tokens struct from a column that holds token_source().

    A total of cache writes counts as 5-minute writes where these are not named apart.
    """
    return F.struct(*[V.count(V.first_present_number(source, ALIASES[t])).cast("bigint").alias(t) for t in TOKENS])


def imported_cost(r: Column, r2: Column) -> Column:
    """A cost in USD under one of several names, else a message's billed total with its currency."""
    usd = F.coalesce(*[V.number(V.leaf(r2 if p in _TWICE else r, p)) for p in ALIASES["cost"]])
    total = V.number(V.leaf(r, "message.usage.cost.total"))
    said = V.string(V.leaf(r, "message.usage.cost.currency"))
    code = F.when(said.rlike("^[A-Za-z]{3}$"), F.upper(said)).otherwise(F.lit("USD"))
    money = lambda amount, currency: F.struct(amount.cast("decimal(38,10)").alias("amount"), currency.alias("currency"))
    return F.when(usd.isNotNull(), money(usd, F.lit("USD"))).when(total.isNotNull(), money(total, code))


def has_usage(tokens: Column, cost: Column) -> Column:
    some = F.greatest(*[F.coalesce(tokens[t], F.lit(0)) for t in TOKENS]) > 0
    return some | cost.isNotNull()


def normalise_times(r: Column) -> dict[str, Column]:
    """Start, end and observed instants as text; the first alias that is not blank decides, even if it can't be parsed."""
    return {f"_{k}": V.first_string(r, ALIASES[k]) for k in ("start", "end", "observed")}


def _with_times(rows: DataFrame, read_at: Column) -> DataFrame:
    at = {c: V.instant(F.col(k)) for c, k in (("started_at", "_start"), ("ended_at", "_end"), ("observed_at", "_observed"))}
    return rows.withColumns(at | {"observed_at": F.coalesce(at["observed_at"], read_at)}).drop("_start", "_end", "_observed")


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]+?)(?:\.[^./\\]+)?$", 1)


def fill_from_file(rows: DataFrame, lasts: dict[str, tuple[str, bool]] | None = None, counts: dict[str, Column] | None = None, slot_lines: int = SLOT_LINES) -> DataFrame:
    """own_model, model and session_id of rows with _model, _session and _context, and more lasts and counts of in_slots().

    own_model is the row's model, else the last one before it in its file; model
    is that, else the file's only one; session_id is the row's, else the last
    context's before it, else the file's base name.
    """
    named = {"own_model": ("_model", True), "_last_context": ("_context", True)}
    found = in_slots(rows, named | (lasts or {}), {"_min_model": F.min("_model"), "_max_model": F.max("_model")}, counts, slot_lines)
    only = F.when(F.col("_min_model") == F.col("_max_model"), F.col("_min_model"))
    found = found.withColumns({"model": F.coalesce("own_model", only), "session_id": F.coalesce("_session", "_last_context", base_name(F.col("source_path")))})
    return found.drop("_min_model", "_max_model", "_last_context")


def _session_context(r: Column) -> Column:
    header = F.when(V.string(r["type"]) == "session", V.string(r["id"]))
    return F.coalesce(header, V.first_string(r, ALIASES["context"]))


def ingest_generic(rows: DataFrame, provider: str, read_at: Column | None = None, cut: Callable[[DataFrame], DataFrame] = lambda df: df) -> tuple[DataFrame, DataFrame]:
    """Records and issues of parsed rows that carry their own usage.

    cut gets the rows once they are parsed and reduced to a few columns; a caller
    may write them there, so that nothing is parsed again for what follows.
    """
    r = F.col("r")
    flat = held(
        rows.select("*", token_source(r).alias("_source")),
        "source_path", "line_no", normalise_tokens(F.col("_source")).alias("tokens"), imported_cost(r, F.col("r2")).alias("imported_cost"), V.first_string(r, ALIASES["model"]).alias("_model"),
        V.first_string(r, ALIASES["session"]).alias("_session"), _session_context(r).alias("_context"), V.string(r["provider"]).alias("_provider"), *[c.alias(k) for k, c in normalise_times(r).items()],
    )
    flat = cut(_with_times(flat, read_at if read_at is not None else F.current_timestamp()))
    used = has_usage(F.col("tokens"), F.col("imported_cost"))
    kept = fill_from_file(flat, counts={"_records": used}).where(used)
    kept = kept.withColumns({"provider": F.lit(provider), "seq": F.col("_records") - 1})
    other = F.col("_provider").isin("claude", "codex", "pi", "grok") & (F.col("_provider") != provider)
    # A count of 0 is a count; what is missing is a record that names none.
    bare = F.coalesce(*[F.col(f"tokens.{t}") for t in TOKENS]).isNull()
    found = F.array_compact(F.array(F.when(other, F.lit("provider_mismatch")), F.when(bare, F.lit("missing_tokens"))))
    issues = kept.select(F.lit("warning").alias("severity"), F.explode(found).alias("code"), "source_path", "line_no", "provider")
    return as_records(kept), as_issues(issues.withColumn("message", F.col("code")))


def numbered(records: DataFrame, slot_lines: int = SLOT_LINES) -> DataFrame:
    """seq: a record's ordinal in its file, from 0."""
    order = ["line_no", *(["model"] if "model" in records.columns else [])]
    return numbered_in_slots(records, "source_path", F.floor(F.col("line_no") / slot_lines), order)


def cumulative_to_delta(rows: DataFrame, keys: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """Running totals as differences to the row before with the same keys.

    A total that falls counts as 0; one missing in the row before counts as 0
    there; the first row is its own difference. Missing totals stay missing.
    """
    before = F.lag(F.struct(*columns), 1).over(Window.partitionBy(*keys).orderBy(*order))
    rows = rows.withColumn("_before", before)
    return rows.withColumns({c: F.when(F.col(c).isNotNull(), F.greatest(F.lit(0), F.col(c) - F.coalesce(F.col(f"_before.{c}"), F.lit(0)))) for c in columns}).drop("_before")


def split_cached_input(tokens: Column) -> Column:
    """Input counts that include cached ones, without these."""
    cached = F.coalesce(tokens["cached_input"], F.lit(0))
    plain = F.when(tokens["input"].isNotNull(), F.greatest(F.lit(0), tokens["input"] - cached))
    found = {"input": plain, "output": tokens["output"], "cached_input": tokens["cached_input"]}
    return F.struct(*[found.get(t, F.lit(None)).cast("bigint").alias(t) for t in TOKENS])


def _counter(source: Column) -> Column:
    """The three counters of an object."""
    return F.struct(*[V.count(V.first_present_number(source, p)).alias(t) for t, p in COUNTERS.items()])


def _any_counter(counters: Column) -> Column:
    """A column of _counter(); null if it has none of them. Asked of the computed column, so that lookups aren't done twice."""
    return F.when(F.coalesce(*[counters[t] for t in COUNTERS]).isNotNull(), counters)


def counter_rows(rows: DataFrame) -> DataFrame:
    """Parsed rows of a counter log reduced to what windows and records need."""
    r = F.col("r")
    event = F.coalesce(V.string(r["type"]) == "event_msg", F.lit(False))
    plain = F.when(event, V.leaf(r, ALIASES["usage"][0])).otherwise(F.coalesce(*[V.leaf(r, p) for p in ALIASES["usage"][1:]]))
    asked = event & (V.string(r["payload"]["type"]) == "token_count") & r["payload"]["info"].isNotNull()
    # Plain projections, not held(): they are compiled in small parts, and no filter stands between them and what is written or dealt next.
    rows = rows.select(
        "source_path", "line_no", F.when(event, V.leaf(r, _TOTALS)).alias("_t"), plain.alias("_p"), F.coalesce(asked, F.lit(False)).alias("_asked"),
        V.first_string(r, ALIASES["model"]).alias("_model"), V.first_string(r, ALIASES["context"]).alias("_context"), *[c.alias(k) for k, c in normalise_times(r).items()],
    )
    counters = {n: F.when(F.col(k).isNotNull(), _counter(F.col(k))) for n, k in (("_totals", "_t"), ("_plain", "_p"))}
    rows = rows.withColumns(counters).drop("_t", "_p")
    rows = rows.withColumns({c: _any_counter(F.col(c)) for c in ("_totals", "_plain")})
    empty = F.col("_asked") & F.col("_totals").isNull() & F.col("_plain").isNull()
    return _with_times(rows.withColumns({"_session": F.col("_context"), "_empty": empty}).drop("_asked"), F.lit(None).cast("timestamp"))


#: For in_slots(): the totals before a row's are those of the last row that had any, as cumulative_to_delta() takes them.
TOTALS_BEFORE = {"_before": ("_totals", False)}


def counter_usage(rows: DataFrame) -> DataFrame:
    """tokens of each row: the difference of running totals to those in _before where it has them, else its own usage. Cached input is split off."""
    delta = F.struct(*[F.greatest(F.lit(0), F.col(f"_totals.{t}") - F.coalesce(F.col(f"_before.{t}"), F.lit(0))).alias(t) for t in COUNTERS])
    # greatest() passes over nulls, but a count that is missing stays missing.
    delta = F.struct(*[F.when(F.col(f"_totals.{t}").isNotNull(), delta[t]).alias(t) for t in COUNTERS])
    used = F.when(F.col("_totals").isNotNull(), delta).otherwise(F.col("_plain"))
    return rows.withColumn("tokens", F.when(used.isNotNull(), split_cached_input(used))).drop("_before")


def ingest_counter_log(lines: DataFrame, provider: str = "codex", read_at: Column | None = None, cut: Callable[[DataFrame], DataFrame] = lambda df: df, cut_used: Callable[[DataFrame], DataFrame] = lambda df: df) -> tuple[DataFrame, DataFrame]:
    """Records and issues of logs whose counters run up. cut is as in ingest_generic(); cut_used gets the rows with usage, which are read twice to be numbered."""
    _, issues = parse_rows(skip_bulk(lines), recover=True, places=COUNTER_PLACES)
    parsed, _ = parse_rows(skip_bulk(telling(lines)), recover=True, places=COUNTER_PLACES)
    rows = counter_usage(fill_from_file(cut(counter_rows(parsed)), TOTALS_BEFORE))
    missing = rows.where("_empty").select(F.lit("warning").alias("severity"), F.lit("missing_tokens").alias("code"), F.lit("token count without usage").alias("message"), "source_path", "line_no", F.lit(provider).alias("provider"))
    kept = rows.where(F.col("tokens").isNotNull() & has_usage(F.col("tokens"), F.lit(None)))
    kept = kept.withColumn("observed_at", F.coalesce("observed_at", read_at if read_at is not None else F.current_timestamp()))
    kept = cut_used(kept.select("source_path", "line_no", "model", "own_model", "session_id", "started_at", "ended_at", "observed_at", "tokens")).withColumn("provider", F.lit(provider))
    return as_records(numbered(kept)), issues.unionByName(as_issues(missing))


def ingest_turn_log(lines: DataFrame, provider: str = "grok", cut: Callable[[DataFrame], DataFrame] = lambda df: df) -> tuple[DataFrame, DataFrame]:
    """Records and issues of logs of finished turns: one record for each model of a turn. cut is as in ingest_generic()."""
    parsed, issues = parse_rows(lines, places=["timestamp", "params.update.sessionUpdate", "params.update.usage.modelUsage"])
    issues = issues.where("code = 'malformed_jsonl'")
    update = F.col("r.params.update")
    usage = F.try_variant_get(update["usage"]["modelUsage"], "$", "map<string, variant>")
    done = parsed.where(V.string(update["sessionUpdate"]) == "turn_completed").select("source_path", "line_no", V.number(F.col("r.timestamp")).alias("at"), usage.alias("usage"))
    rows = done.where("at IS NOT NULL").select("source_path", "line_no", F.timestamp_seconds(F.col("at").cast("bigint")).alias("at"), F.explode("usage").alias("model", "u"))
    n = lambda k: V.number(F.try_variant_get("u", F.lit(f"$.{k}"), "variant"))
    rows = held(rows, "source_path", "line_no", "at", "model", *[V.count(n(k)).alias(c) for k, c in (("inputTokens", "i"), ("outputTokens", "o"), ("totalTokens", "t"), ("cachedReadTokens", "c"))], n("costUsdTicks").cast("decimal(28,0)").alias("ticks"))
    rows = cut(rows)
    # Cached reads are part of the input only where the total says so.
    inclusive = F.coalesce(F.col("t") == F.col("i") + F.col("o"), F.lit(False))
    split = F.when(inclusive & F.col("i").isNotNull(), F.greatest(F.lit(0), F.col("i") - F.coalesce("c", F.lit(0)))).otherwise(F.col("i"))
    zero = lambda c: F.nullif(c, F.lit(0))
    tokens = F.struct(*[{"input": zero(split), "output": zero(F.col("o")), "cache_read": zero(F.col("c"))}.get(t, F.lit(None)).cast("bigint").alias(t) for t in TOKENS])
    # Ticks are 1e-10 of a dollar: the digits stay, the point moves.
    cost = F.when(F.col("ticks").isNotNull(), F.struct((F.col("ticks").cast("decimal(28,0)") * F.lit("0.0000000001").cast("decimal(10,10)")).cast("decimal(38,10)").alias("amount"), F.lit("USD").alias("currency")))
    session = F.element_at(F.split("source_path", "/"), -2)
    records = rows.select("source_path", "line_no", "model", F.col("model").alias("own_model"), session.alias("session_id"), F.col("at").alias("started_at"), F.col("at").alias("observed_at"), tokens.alias("tokens"), cost.alias("imported_cost"), F.lit(provider).alias("provider"), (~inclusive).alias("_changed"))
    kept = records.where(has_usage(F.col("tokens"), F.lit(None)))
    changed = records.groupBy("source_path").agg(F.count_if("_changed").alias("n")).where("n > 0")
    warned = changed.select(F.lit("warning").alias("severity"), F.lit("token_convention_changed").alias("code"), F.lit("totals don't show whether cached reads are part of the input").alias("message"), "source_path", F.lit(provider).alias("provider"), "n")
    return as_records(numbered(kept)), issues.unionByName(as_issues(warned))


def child_sessions(texts: DataFrame) -> DataFrame:
    """source_path and session_id of sessions that a parent has started and counts: of subagents/*/meta.json, the id named there or else the directory's name."""
    named = V.string(V.parse_object(F.col("value"), ["child_session_id"])["child_session_id"])
    folder = F.regexp_extract("source_path", r"/subagents/([^/]+)/meta\.json$", 1)
    return texts.where(folder != "").select("source_path", F.coalesce(named, folder).alias("session_id")).distinct()


def drop_child_sessions(records: DataFrame, children: DataFrame) -> DataFrame:
    return records.join(children.select("session_id"), "session_id", "left_anti").select(*records.columns)


#: Columns that an event table must have.
EVENT_COLUMNS = ("event_id", "session_id", "model", "started_at", "completed_at", "input_tokens", "output_tokens", "cache_read_tokens", "cache_write_tokens")


def scan_session_events(table: DataFrame, source_path: str, provider: str = "grok") -> tuple[DataFrame, DataFrame]:
    """Records and issues of an event table; one issue if it lacks a column."""
    missing = [c for c in EVENT_COLUMNS if c not in table.columns]
    spark = table.sparkSession
    if missing:
        row = [("error", "unsupported_schema", f"missing columns: {', '.join(missing)}", source_path, None, provider, None)]
        from ..schema import ISSUE_SCHEMA

        return as_records(spark.createDataFrame([], "provider string, started_at timestamp, observed_at timestamp")), spark.createDataFrame(row, ISSUE_SCHEMA)
    return session_events_to_records(table.withColumn("source_path", F.lit(source_path)), provider)


def session_events_to_records(table: DataFrame, provider: str = "grok") -> tuple[DataFrame, DataFrame]:
    """Records of an event table with source_path; counts of what was left out, an issue each."""
    positive = lambda c: F.when(F.col(c) > 0, F.col(c).cast("bigint"))
    instant = lambda c: F.date_trunc("MILLISECOND", F.try_to_timestamp(F.col(c).cast("string")))
    named = {"input": "input_tokens", "output": "output_tokens", "cache_read": "cache_read_tokens"}
    tokens = F.struct(*[(positive(named[t]) if t in named else F.lit(None)).cast("bigint").alias(t) for t in TOKENS])
    start = instant("started_at")
    end = F.coalesce(instant("completed_at"), start)
    rows = table.select("source_path", F.col("event_id").alias("_event"), "session_id", F.nullif(F.trim("model"), F.lit("")).alias("model"), start.alias("started_at"), end.alias("ended_at"), tokens.alias("tokens"))
    some = has_usage(F.col("tokens"), F.lit(None))
    rows = rows.withColumns({"_none": ~some, "_bad": some & F.col("started_at").isNull(), "_hit": some & F.col("started_at").isNotNull() & F.col("tokens.cache_read").isNotNull()})
    counts = rows.groupBy("source_path").agg(F.count_if("_none").alias("no_token_usage"), F.count_if("_bad").alias("invalid_timestamp"), F.count_if("_hit").alias("ambiguous_cache_tokens"))
    issues = counts.unpivot("source_path", ["no_token_usage", "invalid_timestamp", "ambiguous_cache_tokens"], "code", "n").where("n > 0")
    issues = issues.select("*", F.lit("warning").alias("severity"), F.col("code").alias("message"), F.lit(provider).alias("provider"))
    kept = rows.where(~F.col("_none") & ~F.col("_bad")).select("*", F.col("ended_at").alias("observed_at"), F.col("_hit").alias("pricing_unavailable"), F.lit(provider).alias("provider"), F.col("model").alias("own_model"))
    return as_records(numbered_in_slots(kept, "source_path", F.date_trunc("HOUR", "started_at"), ["started_at", "_event"])), as_issues(issues)


def numbered_in_slots(rows: DataFrame, key: str, slot: Column, order: list[str]) -> DataFrame:
    """seq: each row's ordinal, from 0, among those of its key; slot rises with the order. Neither may be null.

    One key may hold most rows, so rows are numbered within slots, and moved on
    by the counts of the slots before, of which there are few.
    """
    dealt = rows.withColumn("_slot", slot)
    own = F.row_number().over(Window.partitionBy(key, "_slot").orderBy(*order))
    before = Window.partitionBy("_key").orderBy("_other").rowsBetween(Window.unboundedPreceding, -1)
    counts = dealt.groupBy(F.col(key).alias("_key"), F.col("_slot").alias("_other")).agg(F.count("*").alias("_n"))
    counts = counts.select("_key", "_other", F.sum("_n").over(before).alias("_before")).where("_before > 0")
    found = dealt.withColumn("_own", own).join(counts, (F.col(key) == F.col("_key")) & (F.col("_slot") == F.col("_other")), "left")
    return found.withColumn("seq", (F.col("_own") + F.coalesce("_before", F.lit(0)) - 1).cast("bigint")).drop("_slot", "_own", "_key", "_other", "_before")


def source_issues(files: DataFrame, lines: DataFrame, records: DataFrame, roots: DataFrame) -> DataFrame:
    """Issues of sources that gave nothing: missing_path, empty_directory, empty_file and no_records.

    roots has root and exists; files come from a listing, since a file of no byte
    has no line.
    """
    filled = lines.where(F.trim("value") != "").select(F.col("source_path").alias("path")).distinct()
    empty = files.join(filled, "path", "left_anti").select(F.col("path").alias("source_path"), F.lit("empty_file").alias("code"))
    with_records = records.select(F.col("source_path").alias("path")).distinct()
    none = files.join(filled, "path", "left_semi").join(with_records, "path", "left_anti").select(F.col("path").alias("source_path"), F.lit("no_records").alias("code"))
    gone = roots.where("NOT exists").select(F.col("root").alias("source_path"), F.lit("missing_path").alias("code"))
    above = files.select(F.explode(folders_above(F.col("path"))).alias("root")).distinct()
    held = roots.where("exists").join(above, "root", "left_anti")
    bare = held.select(F.col("root").alias("source_path"), F.lit("empty_directory").alias("code"))
    found = empty.unionByName(none).unionByName(gone).unionByName(bare)
    return as_issues(found.select("*", F.lit("warning").alias("severity"), F.col("code").alias("message")))
