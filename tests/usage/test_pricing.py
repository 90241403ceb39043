from datetime import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from meterloom.functions.timez import resolve_range
from meterloom.operators import currency, filters, pricing, rollup
from meterloom.plans.summary import summarise
from meterloom.schema import TOKENS, as_records

META = {"currency": "USD", "price_unit": "1M", "source_url": "https://a.example.com/x", "checked_at": datetime(2026, 1, 1)}


def rules(spark, *found):
    return pricing.rules_from(spark, [META | {"provider": "codex", "model": "m", "aliases": []} | r for r in found])


def records(spark, *rows):
    made = []
    for r in rows:
        tokens = tuple(r.get(t) for t in TOKENS)
        cost = r.get("cost")
        made.append((r.get("provider", "codex"), r.get("model", "m"), r.get("session", "s"), r.get("at", datetime(2026, 5, 6, 12)), r.get("observed", datetime(2026, 5, 6, 12)), tokens, None if cost is None else (Decimal(str(cost[0])), cost[1]), r.get("ambiguous"), "f"))
    schema = f"provider string, model string, session_id string, started_at timestamp, observed_at timestamp, tokens struct<{', '.join(f'{t}: bigint' for t in TOKENS)}>, imported_cost struct<amount: decimal(38,10), currency: string>, pricing_unavailable boolean, source_path string"
    return as_records(spark.createDataFrame(made, schema))


def priced(spark, rule_rows, *rows, valid=True):
    out = pricing.price(records(spark, *rows), pricing.rate_book(rules(spark, *rule_rows)), valid)
    return [r.cost_reason or float(r.cost.amount) for r in out.orderBy("session_id").collect()]


MILLION = 1_000_000
TIERED = {"rates": {"input": 4, "cached_input": 0.4}, "threshold": 272000, "long_rates": {"input": 8, "cached_input": 0.8}}


def test_amounts(spark):
    assert priced(spark, [{"rates": {"input": 5, "cached_input": 0.5, "output": 30}}], {"input": MILLION, "cached_input": MILLION, "output": MILLION}) == [35.5]
    assert priced(spark, [{"rates": {"input": 3, "output": 15, "cache_read": 0.3}}], {"input": MILLION, "output": MILLION, "cache_read": MILLION}) == [18.3]


def test_long_context_is_strictly_above(spark):
    rows = [{"session": "a", "input": 271999}, {"session": "b", "input": 272000}, {"session": "c", "input": 272001}]
    assert priced(spark, [TIERED], *rows) == [1.087996, 1.088, 2.176008]
    assert priced(spark, [TIERED], {"input": 100000, "cached_input": 172001}) == [0.937601]


def test_vendor_fallback_prices_cache_reads_as_cached_input(spark):
    rule = TIERED | {"model": "gpt-x"}
    assert priced(spark, [rule], {"provider": "pi", "model": "GPT-X", "input": 100000, "cache_read": 200000}) == [0.96]
    own = {"provider": "pi", "model": "gpt-x", "rates": {"input": 1}}
    assert priced(spark, [rule, own], {"provider": "pi", "model": "gpt-x", "input": MILLION}) == [1.0]


def test_dated_rules_and_slices(spark):
    dated = [{"effective_to": datetime(2026, 5, 1), "rates": {"input": 1, "output": 2}}, {"effective_from": datetime(2026, 5, 1), "rates": {"input": 10, "output": 20}}]
    row = {"input": MILLION, "output": MILLION}
    assert priced(spark, dated, row | {"session": "a", "at": datetime(2026, 4, 30, 23, 59, 59)}, row | {"session": "b", "at": datetime(2026, 5, 1)}) == [3, 30]
    assert priced(spark, dated, row | {"at": None, "observed": datetime(2026, 6, 1)}) == [30]
    mixed = [{"rates": {"input": 1}}, {"effective_from": datetime(2026, 1, 1), "effective_to": datetime(2026, 9, 1), "rates": {"input": 2}}, {"effective_from": datetime(2026, 3, 1), "effective_to": datetime(2026, 6, 1), "rates": {"input": 3}}, {"effective_from": datetime(2026, 3, 1), "rates": {"input": 4}}]
    book = pricing.rate_book(rules(spark, *mixed)).orderBy("valid_from").collect()
    assert [r.ord for r in book] == [0, 1, 2, 3, 3] and all(a.valid_to == b.valid_from for a, b in zip(book, book[1:]))


def test_reasons_in_order(spark):
    rule = [{"rates": {"input": 1}}]
    rows = [
        {"session": "a", "input": 1, "cost": (0, "USD")}, {"session": "b", "input": 5, "ambiguous": True, "model": None}, {"session": "c", "model": None, "input": 1},
        {"session": "d"}, {"session": "e", "model": "none", "input": 1}, {"session": "f", "output": 9},
    ]
    assert priced(spark, rule, *rows) == [0.0, "ambiguous_tokens", "unknown_model", "missing_tokens", "unknown_model", "missing_tokens"]
    assert priced(spark, rule, {"input": 1}, valid=False) == ["missing_pricing_metadata"]


def test_catalog_checks(spark):
    good = rules(spark, {"rates": {"input": 1}})
    assert pricing.catalog_is_valid(good) and not pricing.lint_rates(good).count()
    for bad in ({"rates": {"input": -1}}, {"rates": {"input": 1}, "threshold": 5}, {"rates": {"input": 1}, "threshold": 5, "long_rates": {"output": 1}}, {"rates": {"input": 1}, "checked_at": None}, {"rates": {"input": 1}, "effective_from": datetime(2026, 2, 1), "effective_to": datetime(2026, 1, 1)}, {"rates": {}}):
        assert not pricing.catalog_is_valid(rules(spark, bad)), bad
    gap = rules(spark, {"effective_to": datetime(2026, 1, 1), "rates": {"input": 1}}, {"effective_from": datetime(2026, 2, 1), "effective_to": datetime(2026, 3, 1), "rates": {"input": 1}, "aliases": ["z"]})
    assert {r.problem for r in pricing.lint_rates(gap).collect()} == {"does not follow the rule before", "last rule is not open", "aliases differ between dates"}


def test_rate_sheet(spark):
    rows = pricing.rate_sheet(rules(spark, TIERED, TIERED | {"threshold": 199999})).collect()
    assert [r.context for r in rows] == ["≤272K"] * 2 + [">272K"] * 2 + ["<200K"] * 2 + ["≥200K"] * 2
    assert rows[0].category == "input" and rows[0].source_host == "a.example.com"


def test_catalog_document(spark, tmp_path):
    path = tmp_path / "rates.json"
    path.write_text('{"checkedAt":"2026-01-01T00:00:00Z","sourceUrls":["u"],"rules":[{"provider":"codex","model":"M","modelAliases":["n"],"currency":"USD","priceUnit":"1M","sourceUrl":"https://x.example.com","checkedAt":"2026-01-01T00:00:00Z","rates":{"input":2.5},"longContext":{"appliesAboveInputTokens":10,"rates":{"input":5}}}]}')
    found = pricing.load_rates(spark, f"file://{path}")
    assert pricing.catalog_is_valid(found)
    out = pricing.price(records(spark, {"model": "N", "input": 10}, {"model": "m", "input": 11}), pricing.rate_book(found)).orderBy("tokens.input").collect()
    assert [float(r.cost.amount) for r in out] == [0.000025, 0.000055]


def test_rollups(spark):
    rows = [{"session": "a", "input": 100, "output": 50, "provider": "claude", "model": "x", "cost": (1, "USD")}, {"session": "a", "input": 100, "provider": "claude", "model": "x"}, {"session": "b", "input": 100, "cost": (1, "credits"), "at": datetime(2026, 5, 7)}]
    span = resolve_range("thisWeek", datetime.fromisoformat("2026-05-06T00:00:00+00:00"), "UTC")
    s = summarise(records(spark, *rows), span, rules(spark, {"rates": {"output": 1}}))
    t = s.totals.first()
    assert (t.records, t.sessions, t.input, t.active_models, t.cost_amount) == (3, 2, 300, 2, None)
    split = {r.provider: r for r in s.provider_split.collect()}
    assert list(split) == ["claude", "codex", "pi", "grok"] and split["pi"].records == 0
    assert split["claude"].cost_amount == 1 and split["claude"].cost_note == "partial" and split["codex"].cost_currency == "credits"
    assert [r.records for r in s.trend.collect()] == [2, 1] and sum(r.records for r in s.sessions.collect()) == 3
    assert {r.currency: float(r.cost_amount) for r in rollup.cost_by_currency(s.provider_split).collect()} == {"USD": 1, "credits": 1}
    again = summarise(records(spark, *rows).repartition(7), span, rules(spark, {"rates": {"output": 1}}))
    assert again.model_split.collect() == s.model_split.collect()
    s.close()
    again.close()
    assert rollup.totals(again.priced.limit(0)).first().records == 0


def test_tier_is_per_record(spark):
    book = pricing.rate_book(rules(spark, TIERED))
    out = rollup.sessions(pricing.price(records(spark, {"input": 200000}, {"input": 200000}), book)).first()
    assert float(out.cost_amount) == 1.6 and out.records == 2


def test_currency(spark):
    doc = '{"result":"success","base_code":"USD","time_last_update_utc":"Fri, 01 May 2026 00:00:01 +0000","rates":{"USD":1,"TWD":31,"JPY":150.5,"bad":2,"ZZZ":0,"NEG":-1,"STR":"3"}}'
    texts = lambda x: spark.createDataFrame([(x,)], "value string")
    fx = currency.fx_from_payload(texts(doc))
    assert {r.code: r.rate for r in fx.collect()} == {"USD": 1, "TWD": 31, "JPY": 150.5}
    for bad in (doc.replace('"USD":1', '"USD":2'), doc.replace('"base_code":"USD"', '"base_code":"EUR"'), doc.replace("success", "error"), "no json"):
        with pytest.raises(Exception):
            currency.fx_from_payload(texts(bad)).collect()
    assert currency.resolve_currency("twd", {"TWD": "32.5"}, fx).rate == 32.5 and currency.resolve_currency("TWD", {}, fx).rate == 31
    unknown = currency.resolve_currency("XXX", {}, fx)
    assert (unknown.code, unknown.requested, unknown.rate) == ("USD", "XXX", 1)
    costs = spark.createDataFrame([(1.5, "USD"), (100.0, "EUR")], "cost_amount double, cost_currency string")
    to = currency.Display("TWD", "TWD", 32.0, "manual")
    assert sorted(map(tuple, currency.convert_cost(costs, to).collect())) == [(48.0, "TWD"), (100.0, "EUR")]
    assert sorted(map(tuple, currency.convert_by_table(costs, fx, "TWD").collect())) == [(46.5, "TWD"), (100.0, "EUR")]
    converted = currency.convert_rates(rules(spark, TIERED), to).first()
    assert (converted.rates.input, converted.long_rates.input, converted.currency) == (128.0, 256.0, "TWD")
    assert [r.code for r in rollup.currency_codes(spark, fx, spark.createDataFrame([("EUR",), (None,)], "code string")).collect()] == ["EUR", "JPY", "TWD", "USD"]


def test_filters(spark):
    issues = spark.createDataFrame([("codex",), ("pi",), (None,)], "provider string")
    assert filters.issues_for_provider(issues, "pi").count() == 2 and filters.issues_for_provider(issues).count() == 3
    rows = records(spark, {"at": datetime(2026, 5, 6)}, {"at": datetime(2026, 5, 6, 23, 59, 59, 999000)}, {"at": datetime(2026, 5, 7)})
    span = resolve_range("today", datetime.fromisoformat("2026-05-06T10:00:00+00:00"), "UTC")
    assert filters.in_range(rows, span).count() == 2 and filters.for_provider(rows, "pi").count() == 0
    assert rows.where(F.col("utc_date") == "2026-05-06").count() == 2


def drawn_rules(n, seed=1):
    """Overlapping dated rules of two names, some without bounds, some beginning together."""
    import random

    rng = random.Random(seed)
    day = lambda: datetime(2026, 1 + rng.randrange(12), 1 + rng.randrange(28))
    out = []
    for i in range(n):
        a, b = sorted((day(), day()))
        rule = {"model": "ab"[i % 2], "aliases": ["c"] if i % 5 == 0 else [], "rates": {"input": i + 1}}
        out.append(rule | ({"effective_from": a} if i % 7 else {}) | ({"effective_to": b} if i % 3 and a < b else {}))
    return out


def test_book_like_brute_force(spark):
    found = drawn_rules(60)
    book = pricing.rate_book(rules(spark, *found)).collect()
    first, last = datetime(1000, 1, 1), datetime(9999, 1, 1)
    for name in "abc":
        mine = [(r.get("effective_from", first), r.get("effective_to", last), i) for i, r in enumerate(found) if name in (r["model"], *r["aliases"])]
        bounds = sorted({x for a, b, _ in mine for x in (a, b)})
        want = []
        for a, b in zip(bounds, bounds[1:]):
            open_ = [(-(f - first), i) for f, t, i in mine if f <= a and b <= t]
            want += [(a, b, min(open_)[1])] if open_ else []
        assert sorted((r.valid_from, r.valid_to, r.ord) for r in book if r.name == name) == want


def test_small_and_large_books_price_alike(spark):
    """A book that is sent and one that records meet by day give the same costs; times lie before, at and after bounds."""
    from datetime import timedelta

    book = pricing.rate_book(rules(spark, *drawn_rules(40)))
    bounds = sorted({r.valid_from for r in book.collect() if r.valid_from.year > 1900})
    times = [b + timedelta(seconds=s) for b in bounds for s in (-1, 0, 1)] + [None]
    rows = [{"model": m, "at": t, "observed": t, "input": MILLION, "session": f"{m}{t}"} for m in ("a", "B", "c", "none", None) for t in times]
    got = []
    for index in (pricing.rate_index(book), pricing.rate_index(book, most=3)):
        out = pricing.price(records(spark, *rows), index).select("session_id", "cost.amount", "cost_reason")
        got.append(sorted(map(str, out.collect())))
    assert pricing.rate_index(book, most=3).small is None and got[0] == got[1] and len(got[0]) == len(rows)
    assert sum("unknown_model" in x for x in got[0]) < len(rows) - 100


def test_records_stay_where_they_are(spark):
    rows = records(spark, {"input": 5}).repartition(3)
    plan = pricing.price(rows, pricing.rate_book(rules(spark, {"rates": {"input": 1}})))._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and plan.count("Exchange hashpartitioning") == 0


def test_large_catalog_of_one_name(spark):
    """A hundred thousand dated rules of one name, one after the other."""
    k = F.col("id")
    at = lambda n: F.timestamp_seconds(F.lit(1_000_000_000) + n * 3600)
    none = F.lit(None)
    rates = F.struct(*[(k + 1 if t == "input" else none).cast("decimal(14,8)").alias(t) for t in TOKENS])
    many = spark.range(100_000).select(
        F.lit("codex").alias("provider"), F.lit("m").alias("model"), F.array().cast("array<string>").alias("aliases"), F.lit("USD").alias("currency"), F.lit("1M").alias("price_unit"), F.lit("https://a.example.com").alias("source_url"), F.lit(datetime(2026, 1, 1)).alias("checked_at"),
        at(k).alias("effective_from"), at(k + 1).alias("effective_to"), rates.alias("rates"), none.cast("bigint").alias("threshold"), none.cast(pricing.RATES_TYPE).alias("long_rates"), k.cast("int").alias("ord"),
    )
    index = pricing.rate_index(pricing.rate_book(many))
    assert index.small is None
    when = [datetime.fromtimestamp(1_000_000_000 + 3600 * n + 1800) for n in (0, 777, 50_000, 99_999, 100_000)]
    out = pricing.price(records(spark, *[{"at": t, "input": MILLION, "session": str(i)} for i, t in enumerate(when)]), index)
    assert [r.cost_reason or int(r.cost.amount) for r in out.orderBy("session_id").collect()] == [1, 778, 50_001, 100_000, "unknown_model"]


def test_catalogs_as_a_whole(spark, tmp_path):
    import json

    rule = {"provider": "codex", "model": "m", "currency": "USD", "sourceUrl": "https://a.example.com", "checkedAt": "2026-01-01", "rates": {"input": 1}}
    whole = {"checkedAt": "2026-01-01T00:00:00Z", "sourceUrls": ["https://a.example.com"], "rules": [rule]}
    bad = {"none": {}, "date": whole | {"checkedAt": "soon"}, "urls": whole | {"sourceUrls": []}, "rules": whole | {"rules": []}}
    said = {"none": 3, "date": 1, "urls": 1, "rules": 1, "good": 0}
    for name, doc in {"good": whole, **bad}.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(doc))
        path = f"file://{tmp_path}/{name}.json"
        catalogs = pricing.load_catalogs(spark, path)
        assert pricing.validate_catalogs(catalogs).count() == said[name]
        assert pricing.catalog_is_valid(pricing.load_rates(spark, path), catalogs) == (name == "good")
    assert not pricing.catalog_is_valid(rules(spark))
    assert priced(spark, [], {"input": 1}, valid=pricing.catalog_is_valid(rules(spark))) == ["missing_pricing_metadata"]


def test_rates_of_seven_digits_and_more(spark, tmp_path):
    """Rates in small units of currency are large numbers; they are loaded, converted and priced like others."""
    import json

    large = 4_800_000_000.25
    rule = {"provider": "codex", "model": "m", "currency": "USD", "priceUnit": "1M", "sourceUrl": "https://a.example.com", "checkedAt": "2026-01-01", "rates": {"input": large}}
    (tmp_path / "large.json").write_text(json.dumps({"rules": [rule]}))
    found = pricing.load_rates(spark, f"file://{tmp_path}/large.json")
    assert found.select(F.col("rates.input").cast("double")).first()[0] == large and not pricing.validate_rates(found).count()
    out = pricing.price(records(spark, {"input": MILLION}), pricing.rate_book(found)).first()
    assert out.cost.amount == Decimal("4800000000.25")


def test_queries_over_rates_of_large_keys(spark, tmp_path):
    from meterloom.plans import rate_queries

    spark.range(1_200_000, 1_200_010).select(F.col("id").alias("p_partkey")).write.parquet(f"{tmp_path}/part.parquet")
    for name in ("loaded_rates", "rate_problems", "rate_sheet", "converted_rates"):
        assert getattr(rate_queries, name)(spark, str(tmp_path)).count() >= 1
    assert rate_queries.loaded_rates(spark, str(tmp_path)).agg(F.max("long_input")).first()[0] == 1_200_008 * 0.5


def test_shown_amounts_round_in_binary_fractions(spark):
    """1.460373 and 3.925769 times 7.5 are ties in decimals; in binary fractions each goes its own way, as here and in SQL."""
    amounts = ["1.460373", "3.925769", "-1.460373", "0.000001"]
    rows = spark.createDataFrame([(a, "USD") for a in amounts], "a string, cost_currency string").select(F.col("a").cast("decimal(38,10)").alias("cost_amount"), "cost_currency")
    table = spark.createDataFrame([("QFX", 7.5)], "code string, rate double")
    found = currency.convert_by_table(rows, table, "QFX").select(currency.shown(F.col("cost_amount"))).collect()
    away = lambda x: float(int(abs(x) * 1e6 + 0.5)) / 1e6 * (1 if x > 0 else -1)
    assert [r[0] for r in found] == [away(float(a) * 7.5) for a in amounts] and found[0][0] == 10.952798
