"""Inline catalog rows for behaviour tests."""

from __future__ import annotations

from shelfspark.operators.enrich import enrich
from shelfspark.sources.catalog import FIELDS

COLUMNS = ("ord", "year", *[c for _, c, _ in FIELDS])
SCHEMA = "ord bigint, year int, " + ", ".join(f"{c} {t}" for _, c, t in FIELDS)

BASE = {
    "id": "1",
    "slug": "ezhik",
    "title": "Ёжик в тумане",
    "content_type": "cartoon",
    "category_label": "Мультфильм",
    "creator": "Юрий Норштейн",
    "studio": "Союзмультфильм",
    "country": "СССР",
    "year": 1975,
    "duration_minutes": 10,
    "rating": "0+",
    "age_min": 4,
    "age_max": 8,
    "genres": ["сказка"],
    "interests": ["дружба", "животные"],
    "moods": ["спокойное"],
    "bedtime": True,
    "family": True,
    "independent": False,
    "duration_category": "до 15 минут",
    "age_groups": [],
}


def raw(spark, *changes: dict):
    rows = []
    for i, change in enumerate(changes):
        row = {"id": str(i + 1), "ord": i}
        row = {**BASE, **row, **change}
        rows.append(tuple(row.get(c) for c in COLUMNS))
    return spark.createDataFrame(rows, SCHEMA)


def items(spark, *changes: dict):
    return enrich(raw(spark, *changes))
