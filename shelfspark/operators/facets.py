"""Facet domains, and counts of results with one value toggled."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfspark.functions import values as V
from shelfspark.functions.text import falsy, has, ru, strings, sure

from .recommend import Query, age_match, format_match, situation_match
from .search import matches_search, needle_columns


def sorted_domain(items: DataFrame, column: str) -> DataFrame:
    """Distinct values of an array column in Russian order."""
    return items.select(F.explode(column).alias("value")).distinct().orderBy(ru(F.col("value")))


def first_seen_domain(items: DataFrame, column: str = "duration_category") -> DataFrame:
    """value, first_ord: distinct set values in the order of their first row."""
    rows = items.filter(F.col(column).isNotNull() & (F.col(column) != ""))
    return rows.groupBy(F.col(column).alias("value")).agg(F.min("ord").alias("first_ord")).orderBy("first_ord")


def age_bounds(items: DataFrame) -> DataFrame:
    return items.agg(F.min("age_min").alias("min_age"), F.max("age_max").alias("max_age"))


def facet_counts(items: DataFrame, query: Query) -> DataFrame:
    """facet, value, n, selected, unavailable: how many exact results each value would leave.

    A row is an exact result where it meets every condition, and a value changes one
    of them only. So each row states for the values that concern it whether it would
    be a result, and one aggregation, combined before its shuffle, counts them: the
    catalog is read once and joined with nothing. Of themes and moods, several may be
    chosen: a value that isn't adds to the chosen ones, one that is goes from them.
    Values that no row has are left out, but for formats and situations, which are fixed.
    """
    asked = {"age": query.age, "format": query.format, "situation": query.situation, "search": query.search}
    kinds = {"age": "double", "format": "string", "situation": "string", "search": "string"}
    given = {f"q_{k}": F.lit(v).cast(kinds[k]) for k, v in asked.items()}
    given |= {f"q_{k}": c for k, c in needle_columns(F.lit(query.search)).items()}
    chosen = {"interests": query.interests, "moods": query.moods}
    every = lambda column, values: reduce(and_, [has(F.col(column), v) for v in values], F.lit(True))
    category = falsy(F.col("duration_category"))
    met = {
        "age": age_match(),
        "search": matches_search("q_") if query.search else F.lit(True),
        "format": format_match(),
        "situation": situation_match(),
        "duration": sure(category == query.duration) if query.duration else F.lit(True),
        **{column: every(column, values) for column, values in chosen.items()},
    }
    rows = items.withColumns(given).withColumns({f"ok_{k}": c for k, c in met.items()})
    rest = lambda facet: reduce(and_, [F.col(f"ok_{k}") for k in met if k != facet])

    def entry(facet: str, value, hit, seen) -> Column:
        value = value if isinstance(value, Column) else F.lit(value)
        return F.struct(F.lit(facet).alias("facet"), value.alias("value"), hit.alias("hit"), seen.alias("seen"))

    yes = F.lit(True)
    entries = [F.array(*[entry("format", f, rest("format") & format_match(F.lit(f)), yes) for f in V.FORMAT_LABELS])]
    entries.append(F.array(*[entry("situation", f, rest("situation") & situation_match(F.lit(f)), yes) for f in V.SITUATION_LABELS]))
    entries.append(F.when(category.isNotNull(), F.array(entry("duration", category, rest("duration"), yes))))
    for column, values in chosen.items():
        others = F.filter(F.array_distinct(column), lambda x: x.isNotNull() & ~F.array_contains(strings(values), x))  # noqa: B023
        entries.append(F.transform(others, lambda x: entry(column, x, rest(column) & F.col(f"ok_{column}"), yes)))  # noqa: B023
        left = {v: [x for x in values if x != v] for v in values}
        if left:
            entries.append(F.array(*[entry(column, v, rest(column) & every(column, more), has(F.col(column), v)) for v, more in left.items()]))
    none = F.array().cast("array<struct<facet:string,value:string,hit:boolean,seen:boolean>>")
    stated = rows.select(F.explode(F.concat(*[F.coalesce(e, none) for e in entries])).alias("x")).select("x.*")
    counts = stated.groupBy("facet", "value").agg(F.count_if("hit").alias("n"), F.bool_or("seen").alias("seen")).filter("seen").drop("seen")
    fixed = [("format", f) for f in V.FORMAT_LABELS] + [("situation", s) for s in V.SITUATION_LABELS]
    # The fixed values stand in the result of an empty catalog too.
    always = items.sparkSession.createDataFrame([(*f, 0) for f in fixed], "facet string, value string, n bigint")
    counts = counts.unionByName(always).groupBy("facet", "value").agg(F.sum("n").alias("n"))
    one = {"format": query.format, "situation": query.situation, "duration": query.duration}
    selected = F.lit(False)
    for facet, value in one.items():
        selected = selected | ((F.col("facet") == facet) & (F.col("value") == (value or "")))
    for facet, values in chosen.items():
        selected = selected | ((F.col("facet") == facet) & F.array_contains(strings(values), F.col("value")))
    out = counts.withColumn("selected", sure(selected))
    return out.select("facet", "value", "n", "selected", ((F.col("n") == 0) & ~F.col("selected")).alias("unavailable"))


def quick_interests(items: DataFrame) -> DataFrame:
    """The first themes in Russian order."""
    return sorted_domain(items, "interests").limit(V.QUICK_INTERESTS)
