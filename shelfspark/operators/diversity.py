"""First results of each query with a share for every type, and small bonuses, by weights that a caller sets.

The weights' defaults change nothing: then the results are those of first_results().
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfspark.functions.text import lookup, ru

from .recommend import BUCKETS, recommend_batch


@dataclass(frozen=True)
class Weights:
    """middle_age: points for an age in the very middle of an item's range, falling to none beyond its ends. several: points for each reason beyond the first. per_type: so many results of a type before every other type had as many, in queries for all formats; None for no quota."""

    middle_age: float = 0.0
    several: float = 0.0
    per_type: int | None = None


def _bonus(weights: Weights) -> Column:
    half, middle = (F.col("age_max") - F.col("age_min")) / 2, (F.col("age_min") + F.col("age_max")) / 2
    near = F.greatest(F.lit(0.0), 1 - F.abs(F.col("q_age") - middle) / (half + 1))
    return weights.middle_age * F.coalesce(near, F.lit(0.0)) + weights.several * F.greatest(F.lit(0), F.size("reasons") - 1)


def diverse_results(items: DataFrame, queries: DataFrame, limit: int, weights: Weights = Weights(), key: str = "id") -> DataFrame:
    """qid, bucket, id, place (from 1) and points: the first `limit` results of each query over its buckets in order, without repeated identifiers.

    Within a bucket, results go by rounds: a round takes per_type of each type, best
    first. Rows that share an identifier are one result, the first of them (with `ord` as the key, each is one); then a type's
    row with `limit` better ones before it can't be shown, and windows with that limit are cut before they are shuffled.
    """
    asked = queries.select("qid", F.col("age").alias("q_age"), F.col("format").alias("q_format"))
    found = recommend_batch(items, queries, exact_limit=None if weights.middle_age or weights.several or weights.per_type else limit)
    ages = items.select("ord", "age_min", "age_max")
    rows = found.join(ages, "ord").join(asked, "qid")
    rows = rows.withColumns({"points": F.round(F.col("score") + _bonus(weights), 6), "b": lookup(BUCKETS, F.col("bucket"))})
    best = [F.col("points").desc(), F.size("missed"), ru(F.col("title")), F.col("ord")]
    once = rows.withColumn("k", F.row_number().over(Window.partitionBy("qid", key).orderBy("b", *best))).filter("k = 1")
    of_type = F.row_number().over(Window.partitionBy("qid", "b", "app_type").orderBy(*best))
    once = once.withColumn("of_type", of_type).filter(F.col("of_type") <= limit)
    turns = F.floor((F.col("of_type") - 1) / (weights.per_type or 1))
    once = once.withColumn("turn", F.when((F.col("q_format") == "all") & F.lit(weights.per_type is not None), turns).otherwise(0))
    order = ["b", "turn", *best]
    place = F.row_number().over(Window.partitionBy("qid").orderBy(*order))
    return once.withColumn("place", place).filter(F.col("place") <= limit).select("qid", "bucket", "id", "app_type", "place", "points")
