"""Nested metadata to key/value rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.binding import bind
from .catalog import contains_text

OBJECT = "map<string,variant>"


def flat_entries(doc: Column) -> Column:
    """JSON text to ``array<struct<key, value>>`` with ``A > B > C`` keys.

    The loop runs inside the row and ends when no object is left, so any depth works without a
    shuffle: a text with n opening braces is nested at most n deep. Arrays are values and are not
    opened; empty objects leave nothing. Where two paths give the same key the deeper one wins.
    """

    def opened(v: Column) -> Column:
        return v.try_cast(OBJECT)

    def entry(key: Column, value: Column, level: Column) -> Column:
        return F.struct(key.alias("key"), value.alias("value"), level.alias("level"))

    def expand(e: Column) -> Column:
        inner = F.transform(
            F.map_entries(opened(e["value"])),
            lambda c: entry(F.concat(e["key"], F.lit(" > "), c["key"]), c["value"], e["level"] + 1),
        )
        return F.when(opened(e["value"]).isNotNull(), inner).otherwise(F.array(e))

    def state(entries: Column) -> Column:
        nested = F.exists(entries, lambda e: opened(e["value"]).isNotNull())
        return F.struct(entries.alias("entries"), F.coalesce(nested, F.lit(False)).alias("nested"))

    def step(acc: Column, _: Column) -> Column:
        # A level without objects is the last: the steps left over only look at the flag.
        return F.when(acc["nested"], bind(F.flatten(F.transform(acc["entries"], expand)), state)).otherwise(acc)

    top = F.transform(
        F.map_entries(opened(F.try_parse_json(doc))), lambda e: entry(e["key"], e["value"], F.lit(0))
    )
    depth = F.length(doc) - F.length(F.replace(doc, F.lit("{"), F.lit("")))

    def as_text(e: Column) -> Column:
        value = F.coalesce(e["value"].cast("string"), F.lit("<null>"))
        return F.struct(e["key"], value.alias("value"), e["level"])

    return F.transform(
        F.aggregate(F.sequence(F.lit(1), F.greatest(depth, F.lit(1))), bind(top, state), step)["entries"], as_text)


def _without_repeats(entries: Column) -> Column:
    """Keeps the deepest entry of each key, the last of equals; documents without repeats are left alone."""

    def beaten(e: Column, i: Column) -> Column:
        def better(o: Column, j: Column) -> Column:
            later = (o["level"] > e["level"]) | ((o["level"] == e["level"]) & (j > i))
            return (o["key"] == e["key"]) & later

        flags = F.transform(entries, better)
        return F.exists(flags, lambda b: b)

    unique = F.size(F.array_distinct(entries["key"])) == F.size(entries)
    return F.when(unique, entries).otherwise(F.filter(entries, lambda e, i: ~beaten(e, i)))


def flatten_metadata(docs: DataFrame, doc: str = "doc", key: str = "path") -> DataFrame:
    """``(path, key, value)`` rows from one JSON document per file."""
    flat = docs.select(F.col(key), bind(flat_entries(F.col(doc)), _without_repeats).alias("_flat"))
    # The outer form keeps Spark from testing the array in a filter of its own, which would flatten twice.
    opened = flat.select(key, F.explode_outer("_flat").alias("_e")).filter(F.col("_e").isNotNull())
    return opened.select(F.col(key), F.col("_e.key").alias("key"), F.col("_e.value").alias("value"))


def unreadable_metadata(docs: DataFrame, doc: str = "doc", key: str = "path") -> DataFrame:
    """``(path, error)`` for documents that give no rows because they are no JSON objects, repeated keys included."""
    parsed = F.try_parse_json(F.col(doc))
    error = F.when(parsed.isNull(), "not JSON, or a key is repeated").otherwise("not an object")
    return docs.filter(F.col(doc).isNotNull() & parsed.try_cast(OBJECT).isNull()).select(key, error.alias("error"))


def search_metadata(rows: DataFrame, query: str, key: str = "path") -> DataFrame:
    """Rows whose key or value contains the text, case-insensitive, sorted by key within each file."""
    hit = contains_text(F.col("key"), query) | contains_text(F.col("value"), query)
    return (rows.filter(hit) if query else rows).orderBy(key, "key")
