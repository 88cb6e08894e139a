"""Section pages: filters, stable sorts, domains and the near-match fallback."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfspark.functions import values as V
from shelfspark.functions.text import has, ru, show_number, sure, truthy

from .recommend import Query, recommend
from .search import haystack_hit


@dataclass(frozen=True)
class Section:
    """The state of a section page; an empty string is unset. Any sort but age, duration and new is by identifier in Russian collation."""

    kind: str
    age: float | None = None
    search: str = ""
    theme: str = ""
    mood: str = ""
    duration: str = ""
    primary: str = ""
    secondary: str = ""
    tertiary: str = ""
    sort: str = ""


def conditions(s: Section) -> Column:
    """The page's filters. Cheap comparisons come first, the text search last."""
    out = F.col("app_type") == s.kind
    if s.age is not None:
        out &= (F.col("age_min") <= s.age) & (F.col("age_max") >= s.age)
    if s.duration:
        out &= sure(F.col("duration_category") == s.duration)
    if s.primary:
        of = {"book": F.col("reading_mode").isin(s.primary, "both"), "cartoon": F.col("cartoon_format") == s.primary, "movie": F.col("audience_type") == s.primary}
        out &= sure(of[s.kind])
    if s.secondary:
        of = {"book": "language_difficulty", "cartoon": "purpose", "movie": "discussion_potential"}
        out &= sure(F.col(of[s.kind]) == s.secondary)
    if s.tertiary:
        out &= sure(F.col("studio") == s.tertiary) if s.kind == "cartoon" else has(F.col("genres"), s.tertiary)
    if s.theme:
        out &= has(F.col("interests"), s.theme)
    if s.mood:
        out &= has(F.col("moods"), s.mood)
    if s.search:
        out &= haystack_hit(F.lit(s.search))
    return out


def sort_keys(sort: str) -> list[Column]:
    keys = {
        "age": [F.col("age_min")],
        "duration": [F.coalesce("duration_minutes", "page_count", F.lit(9999))],
        "new": [F.coalesce("year", F.lit(0)).desc()],
    }.get(sort, [ru(F.col("id"))])
    return [*keys, F.col("ord")]


def result_count(items: DataFrame, state: Section) -> DataFrame:
    """n: how many rows the section shows."""
    return items.filter(conditions(state)).agg(F.count(F.lit(1)).alias("n"))


def section(items: DataFrame, state: Section) -> DataFrame:
    """The matching rows in the page's order."""
    return items.filter(conditions(state)).orderBy(*sort_keys(state.sort))


def as_query(s: Section) -> Query:
    """The recommendation query that a section state stands for; secondary, tertiary and sort are left out."""
    return Query(
        age=s.age,
        format="reading" if s.kind == "book" else s.kind,
        interests=(s.theme,) if s.theme else (),
        moods=(s.mood,) if s.mood else (),
        situation={"independent": "independent", "together": "family"}.get(s.primary),
        duration=s.duration or None,
        search=s.search,
    )


def near_matches(items: DataFrame, state: Section) -> DataFrame:
    """Where nothing matches: up to six rows of the section among what recommend() finds in the whole catalog, in catalog order."""
    if not items.filter(conditions(state)).isEmpty():
        return items.limit(0)
    found = recommend(items, as_query(state))
    return items.filter(F.col("app_type") == state.kind).join(found.select("id").distinct(), "id", "left_semi").orderBy("ord").limit(V.NEAR_LIMIT)


def domain(items: DataFrame, column: str, array: bool) -> DataFrame:
    """Distinct values of a column, empty ones left out, in Russian order."""
    value = F.explode(truthy(F.col(column))) if array else F.col(column)
    return items.select(value.alias("value")).filter("value is not null and value <> ''").distinct().orderBy(ru(F.col("value")))


def section_domains(items: DataFrame, kind: str) -> DataFrame:
    """facet, value of a section's select boxes."""
    rows = items.filter(F.col("app_type") == kind)
    tertiary = ("tertiary", F.array("studio")) if kind == "cartoon" else ("tertiary", F.col("genres"))
    boxes = [("theme", F.col("interests")), ("mood", F.col("moods")), ("duration", F.array("duration_category")), tertiary]
    each = F.explode(F.array(*[F.struct(F.lit(name).alias("facet"), values.alias("values")) for name, values in boxes]))
    exploded = rows.select(each.alias("x")).select("x.facet", F.explode(truthy(F.col("x.values"))).alias("value"))
    return exploded.distinct().orderBy("facet", ru(F.col("value")))


def active_filters(s: Section) -> list[str]:
    """The tags of the filters that are set."""
    age = f"{s.age:g} лет" if s.age else ""
    return [x for x in (age, s.theme, s.mood, s.duration, s.primary, s.secondary, s.tertiary) if x]


def filter_tags(states: DataFrame) -> Column:
    """The same for a table of section states (age, theme, mood, duration, primary, secondary, tertiary)."""
    age = F.when(F.coalesce("age", F.lit(0.0)) != 0, F.concat(show_number(F.col("age")), F.lit(" лет")))
    return truthy(F.array(age, *[F.col(c) for c in ("theme", "mood", "duration", "primary", "secondary", "tertiary")]))
