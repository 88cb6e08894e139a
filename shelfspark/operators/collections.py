"""Editorial collections: expansion, cards, and a check of their items."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfspark.functions import values as V
from shelfspark.functions.text import lookup


def expand(collections: DataFrame, items: DataFrame) -> DataFrame:
    """collection_id, pos and the item: identifiers in their order, missing ones left out, the first item of an identifier."""
    listed = collections.select(F.col("id").alias("collection_id"), F.posexplode("itemIds").alias("pos", "id"))
    # Items meet the lists before the first of an identifier is picked: the catalog itself isn't dealt by identifier.
    found = listed.join(items, "id")
    first = found.withColumn("k", F.row_number().over(Window.partitionBy("collection_id", "pos").orderBy("ord"))).filter("k = 1").drop("k")
    why = F.concat(F.lit("соответствует темам «"), F.array_join(F.slice("interests", 1, 2), "» и «"), F.lit("» и возрастной рекомендации "), F.col("age_label"))
    return first.withColumn("why", why).orderBy("collection_id", "pos")


def orphans(collections: DataFrame, items: DataFrame) -> DataFrame:
    """Identifiers that no item has."""
    listed = collections.select(F.col("id").alias("collection_id"), F.explode("itemIds").alias("id"))
    return listed.join(items.select("id"), "id", "left_anti").select("collection_id", "id")


def cards(collections: DataFrame) -> DataFrame:
    day = lambda c: F.date_format(c, "dd.MM.yyyy")
    return collections.select(
        "id",
        "slug",
        "title",
        F.size("itemIds").alias("n_items"),
        F.coalesce("ageLabel", F.lit("Для всей семьи")).alias("age_label"),
        day("publishedAt").alias("published"),
        day("updatedAt").alias("updated"),
        F.array_join(F.transform("contentTypes", lambda t: lookup(V.PLURALS, t)), ", ").alias("types"),
    )


def by_slug(collections: DataFrame, slug: str) -> DataFrame:
    """The first collection of a slug."""
    return collections.filter(F.col("slug") == slug).orderBy("ord").limit(1)
