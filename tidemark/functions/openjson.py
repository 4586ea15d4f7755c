"""Open properties: JSON objects whose keys are not known beforehand, changed key by key without touching the other values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def json_string(value: Column) -> Column:
    """A text as a JSON string; `null` for null."""
    inside = F.to_json(F.array(value))
    return F.coalesce(F.substring(inside, F.lit(2), F.length(inside) - 2), F.lit("null"))


def members(text: Column) -> Column:
    """A JSON object's members as (key, value), in order; value is JSON text of the value's own type.

    Of a key that stands twice the last member counts. Null, and text that is no JSON object, has no members. The object is
    read twice in the JVM: as variants, which tell a string from other values, and as texts. Numbers beyond a double's
    digits are kept as the nearest double, whole ones as they are.
    """
    typed, plain = F.from_json(text, "map<string,variant>"), F.from_json(text, "map<string,string>")
    kind = F.transform(F.map_values(typed), F.schema_of_variant)
    rows = F.arrays_zip(F.map_keys(plain).alias("key"), F.map_values(plain).alias("text"), kind.alias("kind"))
    last = F.filter(rows, lambda r, k: ~F.exists(F.slice(rows, k + 2, F.size(rows)), lambda s: s["key"] == r["key"]))
    value = lambda r: F.when(r["kind"] == "STRING", json_string(r["text"])).otherwise(F.coalesce(r["text"], F.lit("null")))
    found = F.transform(last, lambda r: F.struct(r["key"].alias("key"), value(r).alias("value")))
    return F.coalesce(found, F.array().cast("array<struct<key:string,value:string>>"))


def member(key: str, value: Column) -> Column:
    """One member with JSON text as value."""
    return F.struct(F.lit(key).alias("key"), value.alias("value"))


def written(found: Column) -> Column:
    """Members as JSON text of an object, in order of their keys."""
    return F.concat(F.lit("{"), F.array_join(F.transform(F.array_sort(found), lambda m: F.concat(json_string(m["key"]), F.lit(":"), m["value"])), ","), F.lit("}"))


def merged(low: Column, high: Column) -> Column:
    """Members of both, those of high where a key stands in both."""
    names = F.transform(high, lambda m: m["key"])
    return F.concat(F.filter(low, lambda m: ~F.array_contains(names, m["key"])), high)
