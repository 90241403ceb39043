"""Lookups in JSON values, strict about types.

A text is parsed once, by from_json, into a struct that names every place to be
looked up; what stands there is a VARIANT, which keeps a string apart from a
number. Places that are missing, and those below a value that is no object, are
null, and so is the struct of an object that is something else.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Set where a text is no JSON, no object, or has a value of another kind where an object is looked for.
ODD = "_corrupt_record"


def shape(paths: Iterable[str]) -> str:
    """The type of a struct with a VARIANT at each path such as message.usage.input."""
    tree: dict = {}
    for path in paths:
        at = tree
        for step in path.split("."):
            at = at.setdefault(step, {})

    def kind(node: dict) -> str:
        return f"struct<{', '.join(f'`{k}`: {kind(x)}' for k, x in node.items())}>" if node else "variant"

    return kind(tree)


def parse_object(text: Column, paths: Iterable[str]) -> Column:
    """The struct of shape(), with ODD beside its fields; all null where the text is no JSON object."""
    return F.from_json(text, f"{shape(paths)[:-1]}, {ODD}: string>")


def leaf(row: Column, path: str) -> Column:
    for step in path.split("."):
        row = row[step]
    return row


def kind(v: Column) -> Column:
    return F.schema_of_variant(v)


def is_object(v: Column) -> Column:
    return F.coalesce(kind(v).startswith("OBJECT"), F.lit(False))


def given(*leaves: Column) -> Column:
    """The first of VARIANTs that is there and not JSON null."""
    return F.coalesce(*[F.when(~F.is_variant_null(x), x) for x in leaves])


def string(v: Column) -> Column:
    """The value if it is a string that is not blank."""
    text = F.try_variant_get(v, "$", "string")
    return F.when((kind(v) == "STRING") & (F.trim(text) != ""), text)


def number(v: Column) -> Column:
    # BIGINT, DOUBLE, FLOAT and DECIMAL(p,s); no other kind begins like these.
    return F.when(F.substring(kind(v), 1, 3).isin("BIG", "DOU", "FLO", "DEC"), F.try_variant_get(v, "$", "double"))


def first_string(row: Column, paths: Iterable[str]) -> Column:
    """The first of the paths that holds a non-blank string; other types are passed over."""
    return F.coalesce(*[string(leaf(row, p)) for p in paths])


def first_present_number(row: Column, paths: Iterable[str]) -> Column:
    """The first of the paths that is there and not null, if that is a number; a value of another type hides later paths."""
    return number(given(*[leaf(row, p) for p in paths]))


def first_number(row: Column, paths: Iterable[str]) -> Column:
    """The first of the paths that holds a number."""
    return F.coalesce(*[number(leaf(row, p)) for p in paths])


def count(number_: Column) -> Column:
    """A token count: whole, null if missing."""
    return F.floor(number_).cast("bigint")


def instant(text: Column) -> Column:
    """A point in time to the millisecond; ISO text, or as in e-mail headers; null for anything else."""
    iso = F.try_to_timestamp(text)
    mail = F.try_to_timestamp(F.regexp_replace(F.regexp_replace(text, r"^[A-Za-z]{3}, ", ""), " GMT$", " +0000"), F.lit("d MMM yyyy HH:mm:ss Z"))
    return F.date_trunc("MILLISECOND", F.coalesce(iso, F.when(text.rlike("^[A-Za-z0-9]"), mail)))
