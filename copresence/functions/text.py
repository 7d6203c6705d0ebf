"""Reading arrays and counters that were stored as text."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def parse_span(text: Column) -> Column:
    """'{a,b}' or '{a,b,c,d}' to ranges of bins."""
    numbers = F.from_json(F.translate(text, "{}", "[]"), "array<int>")
    pair = lambda i: F.struct(F.get(numbers, F.lit(i)).alias("lo"), F.get(numbers, F.lit(i + 1)).alias("hi"))
    return F.when(F.size(numbers) > 2, F.array(pair(0), pair(2))).otherwise(F.array(pair(0)))


def parse_counter(text: Column) -> Column:
    """"{'zone': n, ...}" to a map."""
    return F.from_json(F.replace(text, F.lit("'"), F.lit('"')), "map<string,int>")


def expand_counter(text: Column) -> Column:
    """Every key repeated as often as it was counted."""
    return F.flatten(F.transform(F.map_entries(parse_counter(text)), lambda e: F.array_repeat(e["key"], e["value"])))
