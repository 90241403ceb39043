"""Display currencies."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import TOKENS


def fx_from_payload(texts: DataFrame, text_col: str = "value") -> DataFrame:
    """code, rate and updated_at of a public rate document; raises where the document is not what it should be.

    It must say success, have USD as its base and at 1, and a valid time. Codes
    of other than three letters and rates that are not positive numbers are left out.
    """
    v = F.try_parse_json(F.col(text_col))
    get = lambda path, kind: F.try_variant_get(v, path, kind)
    updated = F.try_to_timestamp(F.regexp_replace(F.regexp_replace(get("$.time_last_update_utc", "string"), r"^[A-Za-z]{3}, ", ""), " GMT$", " +0000"), F.lit("d MMM yyyy HH:mm:ss Z"))
    good = (get("$.result", "string") == "success") & (get("$.base_code", "string") == "USD") & (get("$.rates.USD", "double") == 1) & updated.isNotNull()
    rates = F.when(F.coalesce(good, F.lit(False)), F.try_variant_get(v, "$.rates", "map<string, variant>")).otherwise(F.raise_error(F.lit("not a usable exchange-rate document")))
    rows = texts.select(updated.alias("updated_at"), F.explode(rates).alias("code", "r"))
    numeric = F.when(F.schema_of_variant("r").rlike("^(BIGINT|DECIMAL|DOUBLE)"), F.try_variant_get("r", "$", "double"))
    rows = rows.select("code", numeric.alias("rate"), F.lit("public").alias("source"), "updated_at")
    return rows.where(F.col("code").rlike("^[A-Z]{3}$") & (F.col("rate") > 0) & (F.col("rate") < float("inf")))


@dataclass(frozen=True)
class Display:
    """What amounts in USD are shown in; requested may be a code without a rate, then code is USD."""

    requested: str
    code: str
    rate: float
    source: str


def _positive(x: object) -> float | None:
    try:
        out = float(str(x).strip())
    except ValueError:
        return None
    return out if 0 < out < float("inf") else None


def resolve_currency(code: str, manual: dict[str, object], fx: DataFrame | None) -> Display:
    """A manual rate, else a public one, else USD. One row of the rate table comes to the driver."""
    wanted = (code or "USD").strip().upper()
    if wanted == "USD":
        return Display(wanted, "USD", 1.0, "base")
    for k, v in manual.items():
        if k.strip().upper() == wanted and (rate := _positive(v)):
            return Display(wanted, wanted, rate, "manual")
    found = fx.where(F.upper("code") == wanted).orderBy(F.desc("updated_at")).limit(1).collect() if fx is not None else []
    return Display(wanted, wanted, found[0].rate, "public") if found else Display(wanted, "USD", 1.0, "base")


def convert_cost(df: DataFrame, to: Display, amount: str = "cost_amount", currency: str = "cost_currency") -> DataFrame:
    """Amounts in USD in the display currency, unrounded; others stay as they are."""
    usd = F.col(currency) == "USD"
    value = F.col(amount).cast("double")
    return df.withColumns({amount: F.when(usd, value * to.rate).otherwise(value), currency: F.when(usd, F.lit(to.code)).otherwise(F.col(currency))})


def convert_by_table(df: DataFrame, fx: DataFrame, to: str, amount: str = "cost_amount", currency: str = "cost_currency") -> DataFrame:
    """Like convert_cost(), with the rate taken by a join to the rate table, which has a row for each currency."""
    rate = fx.where(F.col("code") == to).select(F.lit("USD").alias("_usd"), F.col("rate").alias("_rate"))
    rows = df.join(rate, F.col(currency) == F.col("_usd"), "left")
    value = F.col(amount).cast("double")
    done = F.col("_rate").isNotNull()
    return rows.withColumns({amount: F.when(done, value * F.col("_rate")).otherwise(value), currency: F.when(done, F.lit(to)).otherwise(F.col(currency))}).drop("_usd", "_rate")


def shown(amount: F.Column) -> F.Column:
    """An amount rounded to six digits in binary fractions throughout, as SQL engines do: whole millionths, half away from zero.

    round() to six digits goes by a double's shortest decimal text instead, which is a tie more or less often.
    """
    return F.round(amount * 1e6) / 1e6


def convert_rates(rules: DataFrame, to: Display) -> DataFrame:
    """Rules in USD, long-context rates too, in the display currency."""
    usd = F.col("currency") == "USD"

    def times(column: str) -> F.Column:
        scaled = F.struct(*[(F.col(f"{column}.{t}").cast("double") * to.rate).alias(t) for t in TOKENS])
        plain = F.struct(*[F.col(f"{column}.{t}").cast("double").alias(t) for t in TOKENS])
        return F.when(F.col(column).isNotNull(), F.when(usd, scaled).otherwise(plain))

    return rules.withColumns({"rates": times("rates"), "long_rates": times("long_rates")}).withColumn("currency", F.when(usd, F.lit(to.code)).otherwise(F.col("currency")))
