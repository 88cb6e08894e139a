from __future__ import annotations

import pytest
from fixtures import items
from pyspark.sql import functions as F
from shelfspark.functions.text import norm
from shelfspark.operators.search import matches_search, needle_columns
from shelfspark.operators.section import Section, section


def hits(rows, phrase):
    found = rows.withColumns({f"q_{k}": c for k, c in needle_columns(F.lit(phrase)).items()}).filter(matches_search("q_"))
    return sorted(r.id for r in found.collect())


@pytest.mark.parametrize(
    "phrase,expected",
    [
        ("ежик", True),
        ("  ЁЖИК  в тумане", True),
        ("   ", True),
        ("почитать перед сном", False),
        ("посмотреть перед сном", True),
        ("почитать и посмотреть", False),
        ("самая смешная книга", False),
        ("ребёнок боится темноты", True),
        ("что-нибудь для 112 лет", False),
        ("мультик на 6 лет", True),
        ("мультик на 9 лет", False),
        ("история про животные", True),
        ("зебра", False),
    ],
)
def test_phrases(spark, phrase, expected):
    assert hits(items(spark, {}), phrase) == (["1"] if expected else [])


def test_age_is_read_without_a_left_boundary(spark):
    assert hits(items(spark, {"age_min": 11, "age_max": 13}), "112 лет") == ["1"]


def test_an_empty_theme_is_a_mention(spark):
    assert hits(items(spark, {"interests": [""]}), "зебра") == ["1"]


def test_white_space_class(spark):
    odd = "a" + "".join(map(chr, [9, 10, 11, 12, 13, 32, 0xA0, 0x1680, 0x2003, 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF])) + "b "
    assert spark.createDataFrame([(odd,)], "t string").select(norm(F.col("t"))).first()[0] == "a b"


def test_section_search_joins_fields(spark):
    rows = items(spark, {"original_title": "Hedgehog", "short_description": "Fog tale"})
    assert section(rows, Section("cartoon", search="hedgehog FOG")).count() == 1
    assert hits(rows, "hedgehog fog") == []


def test_nulls_never_leak(spark):
    rows = items(spark, {"creator": None, "studio": None, "genres": [], "interests": [], "moods": [], "bedtime": None, "family": None, "independent": None})
    assert hits(rows, "почитать на ночь всей семьёй самому") == []
