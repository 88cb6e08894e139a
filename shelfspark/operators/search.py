"""Text search: direct hits, and phrases that speak of an intent."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfspark.functions import values as V
from shelfspark.functions.text import norm, sure

from .enrich import is_calm


def needle_columns(search: Column) -> dict[str, Column]:
    """What depends on the phrase alone: computed once for each query, not for each row."""
    needle = norm(F.coalesce(search, F.lit("")))
    out = {"needle": needle}
    for name, pattern in V.INTENTS.items():
        out[f"asks_{name}"] = sure(needle.rlike(pattern))
    age = F.regexp_extract(needle, V.AGE_PHRASE.replace("WHITE", V.WHITE), 1)
    out["asks_age"] = F.nullif(age, F.lit("")).cast("int")
    return out


def direct_hit(needle: Column) -> Column:
    return sure(F.exists("search_texts", lambda x: x.contains(needle)))


def matches_search(prefix: str = "") -> Column:
    """Whether an enriched row matches the needle columns beside it: always for an empty needle, by a direct hit, or by all of its recorded intents."""
    q = lambda name: F.col(f"{prefix}{name}")
    needle = q("needle")
    reading = F.col("content_type").isin("book", "fairy-tale")
    watching = F.col("content_type").isin("cartoon", "movie")
    asked = (
        (q("asks_read"), sure(reading)),
        (q("asks_watch"), sure(watching)),
        (q("asks_bedtime"), sure(F.col("bedtime"))),
        (q("asks_family"), sure(F.col("family"))),
        (q("asks_independent"), sure(F.col("independent"))),
        (q("asks_calm"), is_calm()),
        (q("asks_age").isNotNull(), sure(q("asks_age").between(F.col("age_min"), F.col("age_max")))),
    )
    refuted = F.lit(False)
    recorded = F.lit(False)
    for trigger, holds in asked:
        refuted = refuted | (trigger & ~holds)
        recorded = recorded | trigger
    # Mentions of the row's own themes and moods only ever speak for it.
    for column in ("norm_interests", "norm_moods"):
        recorded = recorded | sure(F.exists(column, lambda x: needle.contains(x)))
    return F.when(needle == "", True).when(direct_hit(needle), True).otherwise(recorded & ~refuted)


def haystack_text() -> Column:
    """The section's own search looks through one text of titles, description, creator, studio and themes, normalised."""
    parts = F.concat(F.array("title", "original_title", "description", "creator", "studio"), F.coalesce("interests", F.array().cast("array<string>")))
    return norm(F.array_join(F.filter(parts, lambda x: x.isNotNull() & (x != "")), " "))


def haystack_hit(search: Column) -> Column:
    return sure(haystack_text().contains(norm(search)))
