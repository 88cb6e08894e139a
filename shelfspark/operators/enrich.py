"""Typed items: one wide projection over raw rows, and texts normalised once for search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfspark.functions import values as V
from shelfspark.functions.text import capitalise, falsy, has, lookup, norm, strings, strip, sure, truthy


def app_type() -> Column:
    return F.when(F.col("content_type") == "fairy-tale", "book").otherwise(F.col("content_type"))


def official_rating() -> Column:
    rating = falsy(F.col("rating"))
    known = rating.isNotNull() & falsy(F.col("rating_source")).isNotNull()
    return F.when(known & ~sure(rating.rlike(f"(?iu){V.UNCONFIRMED}")), rating)


def reading_mode() -> Column:
    alone, family = sure(F.col("independent")), sure(F.col("family"))
    return F.when(alone & family, "both").when(alone, "independent").otherwise("together")


def length_category() -> Column:
    pages, category = F.coalesce("page_count", F.lit(0)), F.coalesce("duration_category", F.lit(""))
    return F.when((pages > 250) | (category == "длинная книга"), "long").when((pages > 80) | (category == "на несколько вечеров"), "medium").otherwise("short")


def language_difficulty() -> Column:
    return F.when(F.col("age_max") <= 6, "easy").when(F.col("age_min") >= 10, "advanced").otherwise("medium")


def age_label() -> Column:
    return F.concat(F.col("age_min").cast("string"), F.lit("–"), F.col("age_max").cast("string"), F.lit(" лет"))


def classic_or_modern() -> Column:
    category = F.lower(F.coalesce("category_label", F.lit("")))
    return F.when(category.contains("классичес") | (F.col("content_type") == "fairy-tale"), "classic").when(category.contains("современн"), "modern")


def cartoon_format() -> Column:
    return F.when(F.coalesce("duration_minutes", F.lit(999)) <= 30, "short-or-series").otherwise("feature")


def cartoon_purpose() -> Column:
    educational = sure(F.arrays_overlap("interests", strings(V.EDUCATIONAL)))
    return F.when(educational & has(F.col("moods"), V.FUNNY), "mixed").when(educational, "educational").otherwise("entertainment")


def cartoon_pace() -> Column:
    return F.when(is_calm(), "calm").when(has(F.col("moods"), V.THRILLING), "dynamic").otherwise("moderate")


def is_calm() -> Column:
    return sure(F.arrays_overlap("moods", strings(V.CALM_MOODS)))


def description() -> Column:
    """The given description, or one made of genre, ages and up to four themes and moods."""
    genre = F.coalesce(falsy(strip(F.get("genres", F.lit(0)))), F.lit("Произведение"))
    heading = F.concat(capitalise(genre), F.lit(" для детей "), F.col("age_min").cast("string"), F.lit("–"), F.col("age_max").cast("string"), F.lit(" лет."))
    tags = F.slice(truthy(F.concat("interests", "moods")), 1, 4)
    made = F.when(F.size(tags) > 0, F.concat(heading, F.lit(" Темы и настроение: "), F.array_join(tags, ", "), F.lit("."))).otherwise(heading)
    return F.coalesce(falsy(strip(F.col("short_description"))), made)


def content_path() -> Column:
    return F.concat(F.lit("/"), lookup(V.SECTION_PATHS, app_type()), F.lit("/"), F.col("slug"))


def artwork_seed() -> Column:
    """The sum of the identifier's character codes modulo 6; none where there is an image."""
    total = F.aggregate(F.filter(F.split("id", ""), lambda x: x != ""), F.lit(0), lambda a, x: a + F.ascii(x))
    return F.when(falsy(F.col("image_url")).isNull(), (total % 6).cast("int"))


def enrich(raw: DataFrame) -> DataFrame:
    """Raw rows with their typed columns; columns of other types are null. Search texts come normalised."""
    kind = app_type()
    of = lambda name, c: F.when(kind == name, c)
    listed = F.concat(F.array("title", "original_title", "creator", "studio"), F.coalesce("genres", strings([])), F.coalesce("interests", strings([])), F.coalesce("moods", strings([])))
    added = {
        "app_type": kind,
        "official_rating": official_rating(),
        "age_label": age_label(),
        "description": description(),
        "path": content_path(),
        "artwork_seed": artwork_seed(),
        "type_label": lookup(V.TYPE_LABELS, F.col("content_type")),
        "reading_mode": of("book", reading_mode()),
        "length_category": of("book", length_category()),
        "language_difficulty": of("book", language_difficulty()),
        "classic_or_modern": of("book", classic_or_modern()),
        "cartoon_format": of("cartoon", cartoon_format()),
        "purpose": of("cartoon", cartoon_purpose()),
        "pace": of("cartoon", cartoon_pace()),
        "audience_type": of("movie", F.when(F.col("age_min") >= 11, "teen").otherwise("family")),
        "discussion_potential": of("movie", F.when(sure(F.col("family")), "high").otherwise("medium")),
        "search_texts": F.transform(truthy(listed), norm),
        "norm_interests": F.transform("interests", norm),
        "norm_moods": F.transform("moods", norm),
    }
    return raw.withColumns(added)
