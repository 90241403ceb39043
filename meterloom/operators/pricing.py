"""Rates, the rate book made of them, and the cost of each record."""

from __future__ import annotations

import heapq
from collections.abc import Iterable
from dataclasses import dataclass
from decimal import Decimal

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.metrics import token_total
from ..schema import COST_TYPE, RATE_TYPE, RATES_TYPE, TOKENS

RULE_SCHEMA = (
    f"provider string, model string, aliases array<string>, currency string, price_unit string, source_url string, checked_at timestamp, "
    f"effective_from timestamp, effective_to timestamp, rates {RATES_TYPE}, threshold bigint, long_rates {RATES_TYPE}, ord int"
)
#: Bounds of rules without dates.
_ALWAYS = ("1000-01-01 00:00:00", "9999-01-01 00:00:00")
_MILLIONTH = Decimal("0.000001")
#: Slices of a rate book, and their bytes, that are sent to all tasks; records meet a larger book by day.
SENT_SLICES, SENT_BYTES = 50_000, 16 << 20
_SALTS = 16
#: How a catalog document names the categories.
_NAMES = dict(zip(TOKENS, ("input", "output", "cachedInput", "cacheRead", "cacheWrite5m", "cacheWrite1h")))


def _documents(spark: SparkSession, path: str) -> DataFrame:
    rates = f"struct<{', '.join(f'{n}: double' for n in _NAMES.values())}>"
    schema = f"checkedAt string, sourceUrls array<string>, rules array<struct<provider: string, model: string, modelAliases: array<string>, currency: string, priceUnit: string, sourceUrl: string, checkedAt: string, effectiveFrom: string, effectiveTo: string, rates: {rates}, longContext: struct<appliesAboveInputTokens: bigint, rates: {rates}>>>"
    return spark.read.json(path, schema=schema, multiLine=True)


def load_catalogs(spark: SparkSession, path: str) -> DataFrame:
    """What catalog documents say of themselves: path, checked_at, source_urls and the number of rules, one row a document."""
    return _documents(spark, path).select(F.col("_metadata.file_path").alias("path"), F.try_to_timestamp("checkedAt").alias("checked_at"), F.col("sourceUrls").alias("source_urls"), F.coalesce(F.size("rules"), F.lit(0)).alias("n_rules"))


def load_rates(spark: SparkSession, path: str) -> DataFrame:
    """Rules of a catalog document (JSON: checkedAt, sourceUrls, rules), one a row, in RULE_SCHEMA."""
    rows = _documents(spark, path).select(F.posexplode("rules").alias("ord", "r"))

    def of(column: str) -> Column:
        return F.when(F.col(column).isNotNull(), F.struct(*[F.col(f"{column}.{n}").cast(RATE_TYPE).alias(t) for t, n in _NAMES.items()]))

    when = lambda c: F.try_to_timestamp(F.col(c))
    return rows.select(
        F.col("r.provider").alias("provider"), F.col("r.model").alias("model"), F.coalesce("r.modelAliases", F.array().cast("array<string>")).alias("aliases"), F.col("r.currency").alias("currency"), F.col("r.priceUnit").alias("price_unit"),
        F.col("r.sourceUrl").alias("source_url"), when("r.checkedAt").alias("checked_at"), when("r.effectiveFrom").alias("effective_from"), when("r.effectiveTo").alias("effective_to"),
        of("r.rates").alias("rates"), F.col("r.longContext.appliesAboveInputTokens").alias("threshold"), of("r.longContext.rates").alias("long_rates"), F.col("ord").cast("int").alias("ord"),
    )


def rules_from(spark: SparkSession, rules: Iterable[dict]) -> DataFrame:
    """Rules given as dictionaries with the names of RULE_SCHEMA; missing ones are null, order is the given one."""
    names = [x.split()[0] for x in ("provider", "model", "aliases", "currency", "price_unit", "source_url", "checked_at", "effective_from", "effective_to", "rates", "threshold", "long_rates")]
    made = []
    for i, r in enumerate(rules):
        row = {n: r.get(n) for n in names} | {"ord": i, "aliases": r.get("aliases") or []}
        for k in ("rates", "long_rates"):
            if row[k] is not None:
                row[k] = tuple(None if row[k].get(t) is None else Decimal(str(row[k][t])) for t in TOKENS)
        made.append(tuple(row[n] for n in [*names, "ord"]))
    return spark.createDataFrame(made, RULE_SCHEMA)


def named(rules: DataFrame) -> DataFrame:
    """One row for each lower-cased name of a rule, its aliases included."""
    names = F.array_distinct(F.transform(F.concat(F.array("model"), F.coalesce("aliases", F.array().cast("array<string>"))), F.lower))
    return rules.withColumn("name", F.explode(names))


def with_fallback(names: DataFrame) -> DataFrame:
    """Adds the vendors' rules under provider pi, for names that no pi rule has."""
    vendor = ((F.col("provider") == "claude") & F.col("name").startswith("claude")) | ((F.col("provider") == "codex") & F.col("name").rlike("^(gpt|o[0-9])")) | ((F.col("provider") == "grok") & F.col("name").startswith("grok"))
    own = names.where("provider = 'pi'").select("name").distinct()
    return names.unionByName(names.where(vendor).join(own, "name", "left_anti").withColumn("provider", F.lit("pi")))


_SLICE_TYPES = {"provider": "string", "name": "string", "valid_from": "timestamp", "valid_to": "timestamp", "ord": "int", "currency": "string", "source_url": "string", "checked_at": "timestamp", "rates": RATES_TYPE, "threshold": "bigint", "long_rates": RATES_TYPE}
_SLICES = ", ".join(f"{k} {t}" for k, t in _SLICE_TYPES.items())
_RULE = ("valid_to", "ord", "currency", "source_url", "checked_at", "rates", "threshold", "long_rates")


def _swept(rules: pa.Table) -> pa.Table:
    """The slices of one name's rules, by a sweep over their bounds with a heap of open rules."""
    begins, ends = (rules.column(c).cast(pa.int64()).to_pylist() for c in ("_from", "_to"))
    order = sorted(range(len(begins)), key=begins.__getitem__)
    places, bounds = rules.column("ord").to_pylist(), sorted({*begins, *ends})
    waiting, opened, held = iter(order), [], []
    following = next(waiting, None)
    for first, last in zip(bounds, bounds[1:]):
        while following is not None and begins[following] <= first:
            heapq.heappush(opened, (-begins[following], places[following], following))
            following = next(waiting, None)
        while opened and ends[opened[0][2]] <= first:
            heapq.heappop(opened)
        if opened:
            held.append((first, last, opened[0][2]))
    instant = lambda i: pa.array([h[i] for h in held], pa.int64()).cast(rules.schema.field("_from").type)
    rows = rules.take(pa.array([h[2] for h in held], pa.int64()))
    made = {"valid_from": instant(0), "valid_to": instant(1)}
    return pa.table({n: made[n] if n in made else rows.column(n) for n in _SLICE_TYPES})


def rate_book(rules: DataFrame) -> DataFrame:
    """Disjoint slices of time for each provider and name: valid_from <= t < valid_to has one rule at most.

    Of rules that hold in a slice, the one that began last wins, then the one
    listed first. All rules of a name are gone through in one task, sorted by
    their bounds, in n log n steps for n rules.
    """
    begin, end = (F.lit(x).cast("timestamp") for x in _ALWAYS)
    names = with_fallback(named(rules)).withColumns({"_from": F.coalesce("effective_from", begin), "_to": F.coalesce("effective_to", end)})
    kept = names.select("provider", "name", "_from", "_to", *[F.col(c).cast(_SLICE_TYPES[c]).alias(c) for c in _RULE[1:]])
    return kept.groupBy("provider", "name").applyInArrow(_swept, _SLICES)


@dataclass(frozen=True)
class RateIndex:
    """A rate book for lookups. small, where the book is, has a row for each provider and name with its slices in order of time."""

    slices: DataFrame
    small: DataFrame | None


def rate_index(book: DataFrame, most: int = SENT_SLICES) -> RateIndex:
    """Measures a book. One of most slices and SENT_BYTES at most comes to the driver and is a local table from then on."""
    found = book.select(*_SLICE_TYPES).limit(most + 1).toArrow()
    if found.num_rows > most or found.nbytes > SENT_BYTES:
        return RateIndex(book, None)
    found = found.sort_by([("provider", "ascending"), ("name", "ascending"), ("valid_from", "ascending")]).combine_chunks()
    keys = list(zip(found.column("provider").to_pylist(), found.column("name").to_pylist()))
    heads = [i for i, k in enumerate(keys) if not i or k != keys[i - 1]]
    ends = pa.array([*heads, len(keys)], pa.int32())
    whole = lambda c: found.column(c).combine_chunks()
    rules = pa.StructArray.from_arrays([whole(c) for c in _RULE], list(_RULE)) if keys else pa.array([], pa.struct([found.schema.field(c) for c in _RULE]))
    steps = [[1 << k for k in reversed(range((b - a).bit_length()))] for a, b in zip(heads, [*heads[1:], len(keys)])]
    table = pa.table({
        "provider": pa.array([keys[i][0] for i in heads], pa.string()), "name": pa.array([keys[i][1] for i in heads], pa.string()), "steps": pa.array(steps, pa.list_(pa.int32())),
        "starts": pa.ListArray.from_arrays(ends, whole("valid_from")) if keys else pa.array([], pa.list_(found.schema.field("valid_from").type)),
        "rules": pa.ListArray.from_arrays(ends, rules) if keys else pa.array([], pa.list_(rules.type)),
    })
    schema = f"provider string, name string, steps array<int>, starts array<timestamp>, rules array<struct<{', '.join(f'{c}: {_SLICE_TYPES[c]}' for c in _RULE)}>>"
    return RateIndex(book, book.sparkSession.createDataFrame(table, schema))


def validate_rates(rules: DataFrame) -> DataFrame:
    """What makes a catalog unfit for pricing: ord, model and problem. Any row disables all pricing."""
    bad = F.array_compact(
        F.array(
            F.when(F.col("checked_at").isNull(), F.lit("checked_at is missing")),
            F.when(F.coalesce(F.trim("source_url"), F.lit("")) == "", F.lit("source_url is missing")),
            F.when(F.col("effective_from") >= F.col("effective_to"), F.lit("effective_from is not before effective_to")),
            F.when(F.col("threshold") <= 0, F.lit("threshold is not positive")),
            F.when(F.col("threshold").isNull() != F.col("long_rates").isNull(), F.lit("threshold and long rates need each other")),
            F.when(_unlike_keys(), F.lit("long rates name other categories")),
            F.when(_negative("rates") | _negative("long_rates"), F.lit("a rate is negative")),
            F.when(F.col("rates").isNull() | ~_any_rate("rates"), F.lit("rates are missing")),
        )
    )
    return rules.select("ord", "model", F.explode(bad).alias("problem"))


def _unlike_keys() -> Column:
    differ = [F.col(f"rates.{t}").isNull() != F.col(f"long_rates.{t}").isNull() for t in TOKENS]
    out = differ[0]
    for x in differ[1:]:
        out = out | x
    return F.col("long_rates").isNotNull() & out


def _negative(column: str) -> Column:
    out = F.lit(False)
    for t in TOKENS:
        out = out | F.coalesce(F.col(f"{column}.{t}") < 0, F.lit(False))
    return out


def _any_rate(column: str) -> Column:
    return F.coalesce(*[F.col(f"{column}.{t}") for t in TOKENS]).isNotNull()


def lint_rates(rules: DataFrame) -> DataFrame:
    """Stricter findings on a catalog: required fields, and dated rules of a model that follow each other without a gap, the last one open, with the same aliases."""
    required = rules.select("ord", "model", F.explode(F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(f"{c} is missing")) for c in ("provider", "model", "currency", "price_unit", "source_url", "checked_at", "rates")]))).alias("problem"))
    by = Window.partitionBy("provider", "model").orderBy(F.asc_nulls_first("effective_from"), "ord")
    whole = Window.partitionBy("provider", "model")
    dated = rules.withColumns({"_n": F.count("*").over(whole), "_prev": F.lag("effective_to").over(by), "_first": F.row_number().over(by) == 1, "_last": F.lead("ord").over(by).isNull(), "_alias": F.array_join(F.array_sort("aliases"), "\n")})
    dated = dated.withColumns({"_a0": F.min("_alias").over(whole), "_a1": F.max("_alias").over(whole)}).where("_n > 1")
    problems = F.array_compact(
        F.array(
            F.when(~F.col("_first") & ~F.col("_prev").eqNullSafe(F.col("effective_from")), F.lit("does not follow the rule before")),
            F.when(F.col("_last") & F.col("effective_to").isNotNull(), F.lit("last rule is not open")),
            F.when(F.col("_first") & (F.col("_a0") != F.col("_a1")), F.lit("aliases differ between dates")),
        )
    )
    return required.unionByName(dated.select("ord", "model", F.explode(problems).alias("problem")))


def validate_catalogs(catalogs: DataFrame) -> DataFrame:
    """What makes catalog documents unfit as a whole: path and problem. catalogs is of load_catalogs()."""
    bad = F.array_compact(
        F.array(
            F.when(F.col("checked_at").isNull(), F.lit("checked_at is missing")),
            F.when(F.coalesce(F.size("source_urls"), F.lit(0)) <= 0, F.lit("source_urls are missing")),
            F.when(F.col("n_rules") <= 0, F.lit("rules are missing")),
        )
    )
    return catalogs.select("path", F.explode(bad).alias("problem"))


def catalog_is_valid(rules: DataFrame, catalogs: DataFrame | None = None) -> bool:
    """A look at the catalog alone, which is small. One without a rule is unfit, as is one whose documents lack what they must say of themselves."""
    rules_ok = rules.limit(1).count() and not validate_rates(rules).limit(1).count()
    return bool(rules_ok and (catalogs is None or not validate_catalogs(catalogs).limit(1).count()))


def _amount(tokens: dict[str, Column], rates: Column) -> Column:
    """Micro-units of currency: rates are for a million tokens. Decimal throughout, rounded half up once."""
    parts = [F.coalesce(tokens[t].cast("decimal(16,0)") * rates[t], F.lit(Decimal(0)).cast("decimal(35,8)")) for t in TOKENS]
    total = parts[0]
    for p in parts[1:]:
        total = (total + p).cast("decimal(37,8)")
    return F.round(total, 0)


def _rule_at(starts: Column, steps: Column, rules: Column, at: Column) -> Column:
    """The rule of the last slice that begins at an instant or before, if it holds there: a search that halves its step each time."""
    found = F.aggregate(steps, F.lit(0), lambda n, step: F.when(F.get(starts, n + step - 1) <= at, n + step).otherwise(n))
    rule = F.get(rules, found - 1)
    return F.when(at < rule["valid_to"], rule)


def matched(records: DataFrame, book: DataFrame | RateIndex) -> DataFrame:
    """Records with the struct _rule of the slice that holds at their instant; null without one.

    A small book goes to the records, which stay where they are. One that is too
    large to send is cut down to the days and names that records have, and meets
    them by these; days are salted, as most records may be of one.
    """
    index = book if isinstance(book, RateIndex) else rate_index(book)
    if index.small is None:
        return _matched_by_day(records, index.slices)
    # Its size is measured: see rate_index().
    known = F.broadcast(index.small.select(F.col("provider").alias("_p"), F.col("name").alias("_name"), "steps", "starts", "rules"))
    rows = records.join(known, (F.col("provider") == F.col("_p")) & (F.lower("model") == F.col("_name")), "left")
    return rows.withColumn("_rule", _rule_at(F.col("starts"), F.col("steps"), F.col("rules"), F.col("event_ts"))).drop("_p", "_name", "steps", "starts", "rules")


def _matched_by_day(records: DataFrame, slices: DataFrame) -> DataFrame:
    day, name = F.to_date("event_ts"), F.lower("model")
    days = records.select(F.col("provider").alias("_p"), name.alias("_name"), day.alias("_day")).where("_name IS NOT NULL AND _day IS NOT NULL").distinct()
    spans = days.groupBy("_p", "_name").agg(F.min("_day").alias("_d0"), F.max("_day").alias("_d1"))
    rules = slices.select(F.col("provider").alias("_p"), F.col("name").alias("_name"), "valid_from", F.struct(*_RULE).alias("rule"))
    # Slices without bounds are cut to the days of their name's records before they are dealt out by day.
    first, last = F.greatest(F.to_date("valid_from"), F.col("_d0")), F.least(F.to_date("rule.valid_to"), F.col("_d1"))
    dealt = rules.join(spans, ["_p", "_name"]).where(first <= last).withColumn("_day", F.explode(F.sequence(first, last))).join(days, ["_p", "_name", "_day"], "left_semi")
    held = dealt.groupBy("_p", "_name", "_day").agg(F.array_sort(F.collect_list(F.struct("valid_from", "rule"))).alias("s"))
    bits = F.ceil(F.log2(F.size("s") + 1)).cast("int")
    steps = F.transform(F.sequence(bits, F.lit(0), F.lit(-1)), lambda k: F.call_function("shiftleft", F.lit(1), k))
    held = held.select("_p", "_name", "_day", steps.alias("steps"), F.transform("s", lambda x: x["valid_from"]).alias("starts"), F.transform("s", lambda x: x["rule"]).alias("rules"), F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))).alias("_salt"))
    salt = F.pmod(F.xxhash64("event_ts", "session_id", "seq"), F.lit(_SALTS)).cast("int")
    on = (F.col("provider") == F.col("_p")) & (name == F.col("_name")) & (day == F.col("_day")) & (salt == F.col("_salt"))
    rows = records.join(held, on, "left")
    return rows.withColumn("_rule", _rule_at(F.col("starts"), F.col("steps"), F.col("rules"), F.col("event_ts"))).drop("_p", "_name", "_day", "_salt", "steps", "starts", "rules")


def price(records: DataFrame, book: DataFrame | RateIndex, valid: bool = True) -> DataFrame:
    """Adds cost, or cost_reason where there is none.

    An imported cost always wins, a billed 0 too. Then, in this order: an unfit
    catalog, ambiguous tokens, no model, no tokens, no rule, an amount of 0.
    Slices of the book are disjoint, so a record meets one rule at most and keeps
    its row, and with a book of usual size its place: see matched().
    """
    rows = matched(records, book)
    rates, tokens = F.col("_rule.rates"), F.col("tokens")
    # A rule that prices one of the two ways to name cached tokens prices both.
    both = F.when(tokens["cache_read"].isNotNull() | tokens["cached_input"].isNotNull(), F.coalesce(tokens["cache_read"], F.lit(0)) + F.coalesce(tokens["cached_input"], F.lit(0)))
    only_cached = rates["cached_input"].isNotNull() & rates["cache_read"].isNull()
    only_read = rates["cache_read"].isNotNull() & rates["cached_input"].isNull()
    counted = {t: tokens[t] for t in TOKENS}
    counted["cached_input"] = F.when(only_cached, both).when(only_read, F.lit(None)).otherwise(tokens["cached_input"])
    counted["cache_read"] = F.when(only_read, both).when(only_cached, F.lit(None)).otherwise(tokens["cache_read"])
    context = F.coalesce(counted["input"], F.lit(0)) + F.coalesce(counted["cached_input"], F.lit(0))
    chosen = F.when(context > F.col("_rule.threshold"), F.col("_rule.long_rates")).otherwise(rates)
    micros = _amount(counted, chosen)
    reason = (
        F.when(F.lit(not valid), "missing_pricing_metadata")
        .when(F.coalesce("pricing_unavailable", F.lit(False)), "ambiguous_tokens")
        .when(F.coalesce(F.trim("model"), F.lit("")) == "", "unknown_model")
        .when(token_total(tokens) == 0, "missing_tokens")
        .when(F.col("_rule").isNull(), "unknown_model")
        .when(micros == 0, "missing_tokens")
    )
    imported = F.col("imported_cost.amount").isNotNull()
    nothing = F.lit(None)
    billed = F.struct(F.col("imported_cost.amount").alias("amount"), F.col("imported_cost.currency").alias("currency"), F.lit("imported").alias("source"), nothing.cast("string").alias("source_url"), nothing.cast("timestamp").alias("checked_at"), nothing.cast("string").alias("note"))
    amount = (micros * F.lit(_MILLIONTH)).cast("decimal(38,10)")
    computed = F.struct(amount.alias("amount"), F.col("_rule.currency").alias("currency"), F.lit("calculated").alias("source"), F.col("_rule.source_url").alias("source_url"), F.col("_rule.checked_at").alias("checked_at"), nothing.cast("string").alias("note"))
    rows = rows.withColumn("cost_reason", F.when(~imported, reason))
    cost = F.when(imported, billed.cast(COST_TYPE)).when(F.col("cost_reason").isNull(), computed.cast(COST_TYPE))
    return rows.withColumn("cost", cost).drop("_rule")


def rate_varies(model_split: DataFrame, book: DataFrame | RateIndex, start: Column, end: Column) -> DataFrame:
    """provider and model of a split with a flag: whether another rule holds at the end of a range than at its start."""
    book = book if isinstance(book, RateIndex) else rate_index(book)
    models = model_split.select("provider", "model", F.lit(None).cast("string").alias("session_id"), F.lit(None).cast("bigint").alias("seq"))
    first = matched(models.withColumn("event_ts", start), book).select("provider", "model", F.col("_rule.ord").alias("_a"))
    last = matched(models.withColumn("event_ts", end), book).select("provider", "model", F.col("_rule.ord").alias("_b"))
    return first.join(last, ["provider", "model"]).select("provider", "model", (~F.col("_a").eqNullSafe(F.col("_b"))).alias("rate_varies"))


def rate_sheet(rules: DataFrame) -> DataFrame:
    """One row for each rate of a rule, in the order of rules, tiers and categories, with labels for display."""
    n = F.col("threshold")
    # 272000 is an upper limit, 199999 the last number below a round one.
    low = F.when((n + 1) % 1000 == 0, F.concat(F.lit("<"), ((n + 1) / 1000).cast("int"), F.lit("K"))).otherwise(F.concat(F.lit("≤"), (n / 1000).cast("int"), F.lit("K")))
    high = F.when((n + 1) % 1000 == 0, F.concat(F.lit("≥"), ((n + 1) / 1000).cast("int"), F.lit("K"))).otherwise(F.concat(F.lit(">"), (n / 1000).cast("int"), F.lit("K")))
    tiers = F.array(F.struct(F.lit("base").alias("tier"), F.when(n.isNotNull(), low).alias("context"), F.col("rates").alias("r")), F.struct(F.lit("long").alias("tier"), high.alias("context"), F.col("long_rates").alias("r")))
    rows = rules.select("ord", "provider", "model", "currency", "effective_from", "effective_to", F.try_parse_url("source_url", F.lit("HOST")).alias("source_host"), F.explode(tiers).alias("t")).where("t.r IS NOT NULL")
    rates = F.array(*[F.struct(F.lit(i).alias("category_ord"), F.lit(t).alias("category"), F.col(f"t.r.{t}").alias("rate")) for i, t in enumerate(TOKENS)])
    rows = rows.select("ord", "provider", "model", "currency", "effective_from", "effective_to", "source_host", "t.tier", "t.context", F.explode(rates).alias("c"))
    return rows.select("*", "c.category_ord", "c.category", "c.rate").drop("c").where("rate IS NOT NULL").orderBy("ord", "tier", "category_ord")
