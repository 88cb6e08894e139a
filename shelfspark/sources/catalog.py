"""Catalog rows: the JSON file, and a catalog derived from the `part` table.

Raw rows have the columns of FIELDS and a numeric year. `ord` is the row's place in the file; every
sort ends in it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfspark.functions.text import strings

from .json_array import json_objects

REQUIRED = ("id", "slug", "title", "contentType", "recommendedAgeMin", "recommendedAgeMax")
#: JSON key, column, type.
FIELDS = (
    ("id", "id", "string"),
    ("slug", "slug", "string"),
    ("title", "title", "string"),
    ("originalTitle", "original_title", "string"),
    ("contentType", "content_type", "string"),
    ("categoryLabel", "category_label", "string"),
    ("creator", "creator", "string"),
    ("contributor", "contributor", "string"),
    ("studioOrPublisher", "studio", "string"),
    ("countryOrTradition", "country", "string"),
    ("referenceEditionOrRelease", "edition", "string"),
    ("isbnOrIdentifier", "identifier", "string"),
    ("pageCount", "page_count", "int"),
    ("durationMinutes", "duration_minutes", "int"),
    ("officialAgeRatingRu", "rating", "string"),
    ("officialAgeRatingSource", "rating_source", "string"),
    ("recommendedAgeMin", "age_min", "int"),
    ("recommendedAgeMax", "age_max", "int"),
    ("ageGroups", "age_groups", "array<string>"),
    ("genres", "genres", "array<string>"),
    ("interests", "interests", "array<string>"),
    ("moods", "moods", "array<string>"),
    ("suitableForBedtime", "bedtime", "boolean"),
    ("suitableForFamily", "family", "boolean"),
    ("suitableForIndependentUse", "independent", "boolean"),
    ("durationCategory", "duration_category", "string"),
    ("imageUrl", "image_url", "string"),
    ("shortDescription", "short_description", "string"),
    ("editorialNote", "editorial_note", "string"),
    ("descriptionStatus", "description_status", "string"),
    ("metadataSource", "metadata_source", "string"),
    ("verificationStatus", "verification_status", "string"),
    ("annotationStatus", "annotation_status", "string"),
    ("note", "note", "string"),
)


def from_json_rows(rows: DataFrame) -> DataFrame:
    """rows: ord, raw (one JSON object as text). Rows without a required key go; a key that is null stays.

    A year is kept only where the JSON value is a number.
    """
    keys = F.json_object_keys("raw")
    present = F.lit(True)
    for key in REQUIRED:
        present = present & F.coalesce(F.array_contains(keys, key), F.lit(False))
    kept = rows.filter(present).withColumn("v", F.try_parse_json("raw"))
    columns = [F.expr(f"try_variant_get(v, '$.{key}', '{kind}')").alias(column) for key, column, kind in FIELDS]
    year = F.expr("variant_get(v, '$.originalYear')")
    numeric = F.expr("schema_of_variant(variant_get(v, '$.originalYear'))").rlike("^(BIGINT|INT|DECIMAL|DOUBLE|FLOAT)")
    return kept.select("ord", *columns, F.when(numeric, year.try_cast("int")).alias("year"))


def load_json(spark: SparkSession, path: str) -> DataFrame:
    """A file that holds one JSON array of rows. An empty catalog is an error."""
    texts = spark.read.text(path, wholetext=True)
    items = texts.select(F.posexplode(F.expr("cast(try_parse_json(value) as array<variant>)")).alias("ord", "item"))
    return require_rows(from_json_rows(items.select(F.col("ord").cast("bigint").alias("ord"), F.to_json("item").alias("raw"))))


def load_json_array(spark: SparkSession, path: str) -> DataFrame:
    """What load_json gives, for a file of any size: the array is read by byte ranges, in many tasks. Its elements should be objects."""
    return require_rows(from_json_rows(json_objects(spark, path)))


def load_json_lines(spark: SparkSession, path: str) -> DataFrame:
    """Rows as JSON lines with their own `ord` key: the form for catalogs too large for one array."""
    raw = spark.read.text(path).withColumnRenamed("value", "raw")
    return from_json_rows(raw.select(F.get_json_object("raw", "$.ord").cast("bigint").alias("ord"), "raw"))


def require_rows(df: DataFrame) -> DataFrame:
    if df.isEmpty():
        raise ValueError("the catalog is empty")
    return df


_THEMES = ["наука", "дружба", "семья", "животные", "приключения", "школа", "история", "космос"]
_MOODS = ["спокойное", "уютное", "смешное", "захватывающее", "трогательное", "таинственное"]


#: Rows of a task that derives or enriches them: its columns are many times wider than the file's, so file splits would be too large.
TASK_ROWS = 1 << 15


def in_small_tasks(rows: DataFrame, key: str) -> DataFrame:
    """The rows, dealt by key so that a task has about TASK_ROWS of them, however few files they come from."""
    tasks = -(-rows.count() // TASK_ROWS)
    return rows.repartition(tasks, key) if tasks > 1 else rows


def derived_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One raw row per `part` row, by fixed rules."""
    part = in_small_tasks(spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_name", "p_brand", "p_type", "p_size"), "p_partkey")
    k, z, n = F.col("p_partkey"), F.col("p_size"), F.col("p_name")
    b = F.substring("p_brand", 7, 10).cast("int")
    kind = k % 16
    reading = kind < 8
    content = F.when(kind < 3, "fairy-tale").when(kind < 8, "book").when(kind < 13, "cartoon").otherwise("movie")
    label = (
        F.when(kind < 3, "Классическая сказка")
        .when((kind < 8) & (k % 2 == 0), "Классическая книга")
        .when(kind < 8, "Современная книга")
        .when(kind < 13, "Мультфильм")
        .otherwise("Фильм")
    )
    words = F.split(n, " ")
    theme = F.when(k % 9 < 8, F.array(F.get(strings(_THEMES), (k % 9).cast("int")))).otherwise(F.array().cast("array<string>"))
    mood = lambda i: F.get(strings(_MOODS), i.cast("int"))
    pages, minutes = z * 7, z * 2 + 3
    duration = (
        F.when(k % 11 == 0, None)
        .when(reading, F.when(pages <= 40, "короткая история").when(pages <= 80, "на один вечер").when(pages <= 250, "на несколько вечеров").otherwise("длинная книга"))
        .otherwise(F.when(minutes <= 15, "до 15 минут").when(minutes <= 30, "до 30 минут").when(minutes <= 60, "до 60 минут").when(minutes <= 90, "до 90 минут").otherwise("больше 90 минут"))
    )
    rating = F.when(k % 5 == 1, "0+").when(k % 5 == 2, "6+").when(k % 5 == 3, "требует сверки").when(k % 5 == 4, "12+")
    age_min = z % 11 + 2
    none = F.lit(None).cast("string")
    columns = {
        "ord": k.cast("bigint"),
        "id": F.concat(F.lit("w-"), F.lpad(k.cast("string"), 6, "0")),
        "slug": F.concat(F.replace(n, F.lit(" "), F.lit("-")), F.lit("-"), k.cast("string")),
        "title": F.concat(n, F.lit(" "), k.cast("string")),
        "original_title": F.when(k % 3 != 0, F.upper(n)),
        "content_type": content,
        "category_label": label,
        "creator": F.when(k % 7 != 0, F.col("p_brand")),
        "contributor": none,
        "studio": F.when(k % 6 != 0, F.concat(F.lit("Studio "), (b % 5).cast("string"))),
        "country": F.when(k % 8 != 0, F.concat(F.lit("Country "), (b % 4).cast("string"))),
        "year": F.when(~(k % 10).isin(0, 1), 1950 + k % 75).cast("int"),
        "rating": rating,
        "rating_source": F.when(k % 7 != 3, "registry"),
        "age_min": age_min.cast("int"),
        "age_max": (age_min + 2 + k % 4).cast("int"),
        "genres": F.array(F.lower("p_type")),
        "interests": F.concat(F.array(F.get(words, 0), F.get(words, 1)), theme),
        "moods": F.when(b % 6 == z % 6, F.array(mood(b % 6))).otherwise(F.array(mood(b % 6), mood(z % 6))),
        "bedtime": z % 2 == 0,
        "family": z % 3 != 0,
        "independent": age_min >= 6,
        "page_count": F.when(reading & (k % 11 != 0), pages).cast("int"),
        "duration_minutes": F.when(~reading & (k % 11 != 0), minutes).cast("int"),
        "duration_category": duration,
        "image_url": F.when(k % 20 == 0, F.concat(F.lit("https://example.invalid/"), k.cast("string"))),
        "short_description": F.when(k % 4 == 1, "   ").when(k % 4 > 1, F.concat(F.lit("Story about "), n)),
        "editorial_note": none,
    }
    return part.select(*[c.alias(name) for name, c in columns.items()])


COLLECTION_SCHEMA = (
    "id string, slug string, title string, description string, introduction string, itemIds array<string>, contentTypes array<string>, "
    "ageLabel string, publishedAt date, updatedAt date, seoTitle string, seoDescription string, featured boolean, status string"
)


def load_collections(spark: SparkSession, path: str) -> DataFrame:
    """Editorial collections from a JSON array; `ord` is their place."""
    texts = spark.read.text(path, wholetext=True)
    rows = texts.select(F.posexplode(F.from_json("value", f"array<struct<{COLLECTION_SCHEMA.replace(' string', ':string').replace(' array<string>', ':array<string>').replace(' date', ':date').replace(' boolean', ':boolean')}>>")).alias("ord", "c"))
    return rows.select("ord", "c.*")


def derived_collections(spark: SparkSession) -> DataFrame:
    """Four collections over the derived catalog; some of their items don't exist."""
    rows = []
    types = (["book", "cartoon", "movie"], ["book"], ["cartoon"], ["movie", "book"])
    import datetime as dt

    for i in range(4):
        ids = [f"w-{(i * 37 + j * 13) % 260 + 1:06d}" for j in range(6 + i)]
        ids.insert(2, "w-none")
        day = dt.date(2026, 6, 10 + i)
        rows.append((i, f"col-{i}", f"collection-{i}", f"Подборка {i}", "Описание", "Вступление", ids, types[i], "4–12 лет" if i % 2 == 0 else None, day, day + dt.timedelta(36) if i < 2 else None, f"Подборка {i} для детей", "Описание подборки", i == 0, "published"))
    return spark.createDataFrame(rows, "ord int, " + COLLECTION_SCHEMA)
