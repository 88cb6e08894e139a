"""Searches by way of the trigram index against the predicates over all rows."""

from __future__ import annotations

import pytest
from fixtures import items
from pyspark.sql import functions as F
from shelfspark.operators import text_index
from shelfspark.operators.search import haystack_hit, matches_search, needle_columns

TITLES = ["Ёжик в тумане", "Ежи и ёлка", "Лунный кот", "Кот   учёный", "Туман над рекой", "ab", "abc", "", "Почитать перед сном", "Космос"]


@pytest.fixture(scope="module")
def catalog(spark):
    rows = [{"id": f"i{k}", "ord": k * 29, "title": TITLES[k % len(TITLES)] + (f" {k}" if k >= 10 else ""), "interests": ["дружба"] if k % 3 else ["звёзды", None], "creator": f"Автор {k % 7}"} for k in range(60)]
    return items(spark, *rows)


@pytest.fixture(scope="module")
def index(spark, catalog, tmp_path_factory):
    text_index.PAGE = 64
    yield text_index.TextIndex.build(catalog, f"file://{tmp_path_factory.mktemp('texts')}/index")
    text_index.PAGE = 4096


def plain(catalog, phrase):
    asked = {f"q_{k}": c for k, c in needle_columns(F.lit(phrase)).items()}
    return {r.id for r in catalog.withColumns(asked).filter(matches_search("q_")).collect()}


@pytest.mark.parametrize("phrase", ["туман", " ТУМАН  ", "ежик", "кот", "кот уч", "ab", "a", "", "abc", "нет такого", "перед сном", "про дружбу и дружба", "автор 3", "звезды", "8 лет"])
def test_search(catalog, index, phrase):
    assert {r.id for r in index.search(phrase).collect()} == plain(catalog, phrase)


@pytest.mark.parametrize("search", ["туман", "  Ёж ", "кот", "автор 6", "ту", "", "норштейн", "союзмульт", "дружба", "xyz"])
def test_haystack(catalog, index, search):
    assert {r.id for r in index.haystack(search).collect()} == {r.id for r in catalog.filter(haystack_hit(F.lit(search))).collect()}


def test_columns_stay(catalog, index):
    found = index.search("лунный кот")
    assert found.columns == catalog.columns and sorted(found.select("id", "ord", "title").collect()) == sorted(catalog.filter("title like 'Лунный кот%'").select("id", "ord", "title").collect())


def test_only_the_rarest_trigrams_and_their_pages_are_read(index):
    """A needle of a frequent word and a rare one is looked for at the rare one's pages."""
    rare = index.candidates("haystack", "автор 6")
    every = index.candidates("haystack", "автор")
    assert 0 < rare.count() <= every.count()
    assert sum(r.n for r in rare.select(F.bitmap_count("bits").alias("n")).collect()) < sum(r.n for r in every.select(F.bitmap_count("bits").alias("n")).collect())
    assert index.candidates("haystack", "xyzxyz").count() == 0 and index.candidates("haystack", "ab") is None
    plan = index._postings("haystack", ["тум"])._jdf.queryExecution().executedPlan().toString()
    assert "folder" in plan[plan.index("PartitionFilters") :][:200]
    assert "gram" in plan[plan.index("PushedFilters") :][:200]


def test_trigrams(spark):
    rows = spark.createDataFrame([("abcab",), ("ab",), ("",), ("aaaa",), ("ё😀x",)], "t string").select(text_index.trigrams(F.col("t")).alias("g")).collect()
    assert [r.g for r in rows] == [["abc", "bca", "cab"], [], [], ["aaa"], ["ё😀x"]]


def test_postings_of_a_page(spark):
    """The bits that numpy lays out against the trigrams of each row, on two pages, with nulls and characters beyond 16 bits."""
    texts = [["abcab", None], ["ab", ""], ["аё😀x", "bcab"], ["aaaa", "abc"], None]
    rows = spark.createDataFrame([(i // 3, i * 7, [t for t in ts or [] if t is not None]) for i, ts in enumerate(texts)], "index_page bigint, place int, texts array<string>")
    got = {}
    for r in rows.coalesce(1).sortWithinPartitions("index_page").mapInArrow(lambda batches: text_index._postings(batches, 32), text_index._POSTING).collect():
        at = {p for p in range(32) if r.bits[p // 8] >> (p % 8) & 1}
        assert len(at) == r.n and len(r.bits) == 4
        got[r.index_page, r.gram] = at
    want = {}
    for i, ts in enumerate(texts):
        for t in ts or []:
            for k in range(len(t or "") - 2):
                want.setdefault((i // 3, t[k : k + 3]), set()).add(i * 7)
    assert got == want
