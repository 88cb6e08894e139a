"""What the registered queries read, derived from the given tables: answers, stored lists, URLs, paths, collections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfspark.functions.text import strings


def _nth(values: list, at: Column) -> Column:
    """values[at % len(values)]."""
    options = F.array(*[F.lit(v).cast("string") for v in values])
    return F.get(options, F.pmod(at, F.lit(len(values))).cast("int"))


def answers(spark: SparkSession, d: str) -> DataFrame:
    """A set of wizard answers for each customer; some leave answers out."""
    k = F.col("c_custkey")
    return spark.read.parquet(f"{d}/customer.parquet").select(
        F.concat(F.lit("c"), k.cast("string")).alias("qid"),
        F.when(k % 11 != 0, k % 15 + 2).cast("int").alias("age"),
        _nth(["all", "reading", "cartoon", "movie", None], k).alias("format"),
        _nth(["", "rest", "anxious", "sad", "bored", "angry", "changes", "laugh", "learn", "other", None], k).alias("feeling"),
        F.when(k % 3 == 0, "").when(k % 3 == 1, F.lower("c_mktsegment")).alias("interest"),
        _nth(["", "short", "medium", "hour", "long", None], k).alias("time"),
        _nth(["", "self", "family", "adult", None, "friends", "self"], k).alias("interaction"),
    )


def stored_lists(spark: SparkSession, d: str) -> DataFrame:
    """user_id, stored: what a browser might hold for each user, from the items of the user's clicks."""
    clicks = spark.read.parquet(f"{d}/events.parquet").filter("event_type = 'click'")
    item = F.concat(F.lit("w-"), F.lpad((F.col("event_id") % 40).cast("string"), 6, "0"))
    users = clicks.groupBy("user_id").agg(F.to_json(F.sort_array(F.collect_set(item))).alias("list"))
    u, name = F.col("user_id") % 10, F.col("user_id").cast("string")
    stored = (
        F.when(u == 0, F.concat(F.lit("not json "), name))
        .when(u == 1, F.concat(F.lit('{"a":'), name, F.lit("}")))
        .when(u == 2, F.concat(F.lit("["), name, F.lit(',null,{"b":"c"},true,'), F.substring("list", F.lit(2), F.length("list"))))
        .when(u == 3, "[]")
        .when(u == 5, F.concat(F.lit('["b","b",""'), F.lit("]")))
        .when(u == 6, name)
        .when(u != 4, F.col("list"))
    )
    return users.select("user_id", stored.alias("stored"))


def query_urls(items: DataFrame) -> DataFrame:
    """id, params: the query part of a URL made of each catalog row, well formed and not."""
    k, plus = F.col("ord"), F.replace(F.col("title"), F.lit(" "), F.lit("+"))
    text = lambda c: F.coalesce(c, F.lit("")).cast("string")
    first = lambda c: text(F.get(c, F.lit(0)))
    params = (
        F.when(k % 6 == 0, F.concat(F.lit("age="), text(F.col("age_min")), F.lit("&format="), F.col("content_type"), F.lit("&interests="), F.array_join("interests", "%7C"), F.lit("&q="), plus, F.lit("%2Bc")))
        .when(k % 6 == 1, F.concat(F.lit("age="), text(F.col("age_min")), F.lit(".5&format=radio&moods=%7C%7C"), first(F.col("moods")), F.lit("&situation=family")))
        .when(k % 6 == 2, F.concat(F.lit("age=99&situation=never&q="), plus, F.lit("&duration=")))
        .when(k % 6 == 3, F.concat(F.lit("age=0&interests=a%7C%7C"), first(F.col("interests")), F.lit("&interests=z")))
        .when(k % 6 == 4, F.concat(F.lit("age=x&q=%20%20&format=reading&situation=bedtime&duration="), F.replace(text(F.col("duration_category")), F.lit(" "), F.lit("%20"))))
        .otherwise("")
    )
    return items.select("id", params.alias("params"))


def section_urls(items: DataFrame) -> DataFrame:
    """id, params: the state of a section page made of each catalog row; some ages and sorts are none."""
    k, plus = F.col("ord"), F.replace(F.col("title"), F.lit(" "), F.lit("+"))
    age = F.when(k % 4 == 0, "40").when(k % 4 == 1, "").otherwise(F.col("age_max").cast("string"))
    sort = F.get(strings(["age", "duration", "new", "best", ""]), F.pmod(k, F.lit(5)).cast("int"))
    theme = F.coalesce(F.get("interests", F.lit(2)), F.lit(""))
    params = F.concat(F.lit("age="), age, F.lit("&mode=both&sort="), sort, F.lit("&q="), plus, F.when(k % 3 == 0, F.concat(F.lit("&theme="), theme, F.lit("&extra=x"))).otherwise(""))
    return items.select("id", F.when(k % 7 != 0, params).otherwise("").alias("params"))


def paths(items: DataFrame) -> DataFrame:
    """id, path: a page of the site for each catalog row, existing or not."""
    k, slug = F.col("ord"), F.col("slug")
    path = (
        F.when(k % 10 == 0, F.concat(F.lit("/catalog/"), slug))
        .when(k % 10 == 1, F.concat(F.col("path"), F.lit("/")))
        .when(k % 10 == 2, F.concat(F.lit("/collections/"), slug, F.lit("%20+x")))
        .when(k % 10 == 3, F.concat(F.lit("/nowhere/"), slug))
        .when(k % 10 == 4, F.get(strings(["/", "/books/", "/catalog", "/cartoons", "/movies", "/collections", "/recommend", "/favorites", "/booksx"]), F.pmod(F.floor(k / 10), F.lit(9)).cast("int")))
        .otherwise(F.col("path"))
    )
    return items.select("id", path.alias("path"))


#: Items of a derived collection.
COLLECTION_ITEMS = 8


def brand_collections(items: DataFrame) -> DataFrame:
    """A collection for each creator: the first items of the catalog, their types, and dates from the creator's number."""
    own = items.filter("creator is not null")
    few = own.withColumn("k", F.row_number().over(Window.partitionBy("creator").orderBy("ord"))).filter(F.col("k") <= COLLECTION_ITEMS)
    listed = few.groupBy("creator").agg(F.transform(F.sort_array(F.collect_list(F.struct("ord", "id"))), lambda x: x["id"]).alias("itemIds"), F.array_sort(F.collect_set("app_type")).alias("contentTypes"))
    b = F.substring("creator", 7, 10).cast("int")
    published = F.date_add(F.lit("2026-06-10").cast("date"), b)
    return listed.select(
        b.alias("ord"), F.concat(F.lit("col-"), b.cast("string")).alias("id"), F.concat(F.lit("collection-"), (b / 2).cast("int").cast("string")).alias("slug"), F.concat(F.lit("Подборка "), F.col("creator")).alias("title"),
        "itemIds", "contentTypes", F.when(b % 2 == 0, "4–12 лет").alias("ageLabel"), published.alias("publishedAt"), F.when(b % 3 == 0, F.date_add(published, 36)).alias("updatedAt"),
    )
