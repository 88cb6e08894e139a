"""Projections for cards and detail pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfspark.functions import values as V
from shelfspark.functions.text import falsy, lookup, truthy

UNSET = "Не указано"


def minutes() -> Column:
    return F.when(F.coalesce("duration_minutes", F.lit(0)) != 0, F.concat(F.col("duration_minutes").cast("string"), F.lit(" минут")))


def content_cards(items: DataFrame) -> DataFrame:
    """id, details (up to three parts joined by a dot), tags (the first two themes), rating."""
    mode = F.when(F.col("reading_mode") == "independent", "читает сам").when(F.col("reading_mode") == "both", "сам или вместе").otherwise("читаем вместе")
    form = F.when(F.col("cartoon_format") == "feature", "полнометражный").otherwise("короткий формат или сериал")
    audience = F.when(F.col("audience_type") == "teen", "подростковый").otherwise("семейный")
    year = F.when(F.coalesce("year", F.lit(0)) != 0, F.col("year").cast("string"))
    parts = (
        F.when(F.col("app_type") == "book", F.array(F.col("creator"), mode, F.get("genres", F.lit(0))))
        .when(F.col("app_type") == "cartoon", F.array(form, minutes(), F.col("studio")))
        .otherwise(F.array(year, audience, minutes()))
    )
    return items.select("id", F.array_join(truthy(parts), " · ").alias("details"), F.array_join(F.slice("interests", 1, 2), ", ").alias("tags"), "official_rating")


def recommendation_cards(scored: DataFrame) -> DataFrame:
    """Scored items: id, creator, tags (three), reasons (two), missed (one)."""
    creator = F.coalesce(falsy(F.col("creator")), falsy(F.col("studio")), F.lit("Автор не указан"))
    return scored.select(
        "id",
        F.concat(creator, F.lit(" · "), F.col("age_label")).alias("meta"),
        F.array_join(F.slice(F.concat("interests", "genres"), 1, 3), ", ").alias("tags"),
        F.array_join(F.slice("reasons", 1, 2), "; ").alias("reasons"),
        F.array_join(F.slice("missed", 1, 1), "; ").alias("missed"),
    )


def detail_facts(items: DataFrame) -> DataFrame:
    """id, place (country and year), volume, suitable, genres with a default."""
    year = F.when(F.coalesce("year", F.lit(0)) != 0, F.col("year").cast("string"))
    place = F.coalesce(falsy(F.array_join(truthy(F.array(F.col("country"), year)), ", ")), F.lit(UNSET))
    pages = F.when(F.coalesce("page_count", F.lit(0)) != 0, F.concat(F.col("page_count").cast("string"), F.lit(" страниц")))
    suitable = F.array_compact(F.array(*[F.when(F.col(c), V.SITUATION_LABELS[c]) for c in ("bedtime", "family", "independent")]))
    return items.select(
        "id",
        F.coalesce("creator", F.lit(UNSET)).alias("creator"),
        place.alias("place"),
        F.coalesce(minutes(), pages, F.col("duration_category"), F.lit(UNSET)).alias("volume"),
        fact(suitable).alias("suitable"),
        fact(F.col("genres")).alias("genres"),
    )


def fact(values: Column) -> Column:
    """A list of facts, with a default for none."""
    return F.when(F.size(values) > 0, F.array_join(values, ", ")).otherwise("не указано")


def by_slug(items: DataFrame, slug: str, kind: str | None = None) -> DataFrame:
    """The first item of a slug, of a type if one is given."""
    rows = items.filter(F.col("slug") == slug)
    return (rows.filter(F.col("app_type") == kind) if kind else rows).orderBy("ord").limit(1)


def home_picks(items: DataFrame) -> DataFrame:
    """The items at fixed places of each type's list; places that aren't there are left out."""
    from pyspark.sql import Window

    most = max(V.HOME_PICKS.values()) + 1
    at = F.row_number().over(Window.partitionBy("app_type").orderBy("ord"))
    front = items.withColumn("at", at).filter(F.col("at") <= most).withColumn("at", F.col("at") - 1)
    return front.filter(F.col("at") == lookup(V.HOME_PICKS, F.col("app_type")))


def page_meta(title: Column, text: Column, path: Column, filter_key: Column) -> Column:
    """What a page tells search engines; filtered pages aren't indexed."""
    robots = F.when(falsy(filter_key).isNotNull(), "noindex,follow").otherwise("index,follow")
    return F.struct(title.alias("title"), text.alias("description"), path.alias("canonical"), robots.alias("robots"))
