"""Favorites: a toggled set of identifiers, in the order in which they were added."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def parse_favorites(text: Column) -> Column:
    """A stored list. Text that is no JSON array gives an empty list; elements that are no strings go."""
    array = F.try_parse_json(F.coalesce(text, F.lit("[]")))
    elements = F.try_variant_get(array, "$", "array<variant>")
    kept = F.filter(elements, lambda x: F.schema_of_variant(x) == "STRING")
    return F.coalesce(F.transform(kept, lambda x: x.try_cast("string")), F.array().cast("array<string>"))


def save_favorites(items: Column) -> Column:
    return F.to_json(items)


def toggle(items: Column, item: Column) -> Column:
    """Without the item if it is there, with it at the end if not."""
    return F.when(F.array_contains(items, item), F.array_remove(items, item)).otherwise(F.array_append(items, item))


def toggled_set(events: DataFrame) -> DataFrame:
    """events: user_id, item, seq. The active items of every user after all toggles, with the place of each by its last addition.

    An item is active after an odd number of toggles, and its last toggle added it.
    """
    active = events.groupBy("user_id", "item").agg(F.count(F.lit(1)).alias("n"), F.max("seq").alias("added")).filter("n % 2 = 1")
    return active.withColumn("place", F.row_number().over(Window.partitionBy("user_id").orderBy("added"))).drop("n")


def favorites_view(items: DataFrame, favorites: DataFrame) -> DataFrame:
    """The items whose identifier is listed, in catalog order."""
    return items.join(favorites.select("id").distinct(), "id", "left_semi").orderBy("ord")


def debounced(events: DataFrame, quiet_ms: int = 250) -> DataFrame:
    """Of each user's events, those that no other follows within quiet_ms: what a trailing debounce lets through."""
    following = F.lead("ts").over(Window.partitionBy("user_id").orderBy("ts", "seq"))
    gap = F.unix_micros(following) - F.unix_micros(F.col("ts"))
    return events.withColumn("gap", gap).filter((F.col("gap").isNull()) | (F.col("gap") >= quiet_ms * 1000)).drop("gap")
