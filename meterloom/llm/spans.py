"""Places of regular-expression matches in a text, as SQL expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Matches are gone through in runs of so many, so that a text with very many of them takes linear time.
_RUN = 1000


def matches(text: Column, pattern: str) -> Column:
    """array<struct<start, end, value, before>> of the leftmost non-overlapping matches, in order.

    start and end count code points, end exclusive; before is the text since the
    match before. The pattern must not match an empty string; null gives null.
    """
    rx = F.lit(pattern)
    values = F.regexp_extract_all(text, rx, F.lit(0))
    both = F.struct(values.alias("v"), F.when(F.size(values) > 0, F.split(text, pattern, -1)).alias("p"))
    # A lambda's variable holds the arrays, so that they are computed once.
    return F.transform(F.array(both), _located)[0]


def _located(both: Column) -> Column:
    v, p = both["v"], both["p"]
    kind = "array<struct<start:int,end:int,value:string,before:string>>"

    def step(state: Column, i: Column) -> Column:
        start = state["at"] + F.length(F.get(p, i))
        end = start + F.length(F.get(v, i))
        one = F.struct(start.alias("start"), end.alias("end"), F.get(v, i).alias("value"), F.get(p, i).alias("before"))
        return F.struct(end.alias("at"), F.concat(state["found"], F.array(one)).cast(kind).alias("found"))

    def run(state: Column, first: Column) -> Column:
        empty = F.struct(state["at"].alias("at"), F.array().cast(kind).alias("found"))
        part = F.aggregate(F.sequence(first, F.least(first + _RUN, F.size(v)) - 1), empty, step)
        return F.transform(F.array(part), lambda x: F.struct(x["at"].alias("at"), F.concat(state["found"], F.array(x["found"])).cast(f"array<{kind}>").alias("found")))[0]

    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{kind}>").alias("found"))
    runs = F.aggregate(F.sequence(F.lit(0), F.size(v) - 1, F.lit(_RUN)), start, run, lambda s: F.flatten(s["found"]))
    return F.when(F.size(v) == 0, F.array().cast(kind)).when(v.isNotNull(), runs)


def joined(spans: Column) -> Column:
    """kind:start:end of each, with commas between; spans are structs with these fields, in order."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
