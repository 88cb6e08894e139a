from __future__ import annotations

import dataclasses
import json

import pytest
from fixtures import items
from pyspark.sql import functions as F
from shelfspark.operators import cards, collections, facets, favorites, similar
from shelfspark.operators.recommend import Query, evaluate, query_frame
from shelfspark.operators.section import Section, active_filters, near_matches, result_count, section
from shelfspark.sources import codec
from shelfspark.sources.catalog import derived_catalog, derived_collections, load_json
from shelfspark.operators.enrich import enrich


def one(rows, *columns):
    return rows.select(*columns).first()


def test_unverified_rating_is_hidden(spark):
    rows = items(spark, {}, {"rating_source": "r"}, {"rating": "Требует сверки", "rating_source": "r"}, {"rating": "", "rating_source": "r"})
    assert [r.official_rating for r in rows.orderBy("ord").collect()] == [None, "0+", None, None]


def test_paths(spark):
    rows = items(spark, {}, {"content_type": "fairy-tale"}, {"content_type": "movie"})
    assert [r.path for r in rows.orderBy("ord").collect()] == ["/cartoons/ezhik", "/books/ezhik", "/movies/ezhik"]


def test_description(spark):
    rows = items(spark, {"short_description": "   "}, {"short_description": " Да. "}, {"genres": [], "interests": [], "moods": [], "short_description": None})
    assert [r.description for r in rows.orderBy("ord").collect()] == [
        "Сказка для детей 4–8 лет. Темы и настроение: дружба, животные, спокойное.",
        "Да.",
        "Произведение для детей 4–8 лет.",
    ]


def test_artwork_seed(spark):
    rows = items(spark, {"id": "abc-004"}, {"image_url": "x"})
    assert [r.artwork_seed for r in rows.orderBy("ord").collect()] == [sum(map(ord, "abc-004")) % 6, None]


def test_cartoon_columns(spark):
    rows = items(spark, {"interests": ["космос"], "moods": ["смешное"]}, {"duration_minutes": None, "moods": ["захватывающее"]})
    got = [(r.cartoon_format, r.purpose, r.pace) for r in rows.orderBy("ord").collect()]
    assert got == [("short-or-series", "mixed", "moderate"), ("feature", "entertainment", "dynamic")]


def test_json_catalog(spark, tmp_path):
    base = {"id": "a", "slug": "s", "title": "t", "contentType": "book", "recommendedAgeMin": 2, "recommendedAgeMax": 4, "genres": [], "interests": ["x"], "moods": []}
    rows = [base | {"originalYear": 1975}, base | {"id": "b", "originalYear": "1975"}, base | {"id": "c", "title": None}, {k: v for k, v in base.items() if k != "slug"}, base | {"id": "e", "originalYear": None}]
    path = tmp_path / "catalog.json"
    path.write_text(json.dumps(rows, ensure_ascii=False))
    got = load_json(spark, str(path)).orderBy("ord").collect()
    assert [(r.ord, r.id, r.year) for r in got] == [(0, "a", 1975), (1, "b", None), (2, "c", None), (4, "e", None)]
    assert got[0].interests == ["x"] and got[2].title is None
    empty = tmp_path / "empty.json"
    empty.write_text("[]")
    with pytest.raises(ValueError):
        load_json(spark, str(empty))


def test_derived_catalog_facts(spark):
    rows = enrich(derived_catalog(spark, "/root/testdata/sf0.01"))
    assert {r.content_type: r["count"] for r in rows.groupBy("content_type").count().collect()} == {"book": 625, "cartoon": 625, "fairy-tale": 375, "movie": 375}
    assert rows.filter("duration_category is null").count() == 182 and rows.filter("year is not null").count() == 1600
    assert rows.filter("official_rating is not null").count() == 1029 and facets.sorted_domain(rows, "interests").count() == 24


def test_section_sorts_are_stable(spark):
    rows = items(spark, {"id": "3", "year": 2000}, {"id": "1", "duration_minutes": 40, "year": None}, {"id": "2", "age_min": 2, "duration_minutes": None})
    order = lambda sort: [r.id for r in section(rows, Section("cartoon", sort=sort)).collect()]
    assert order("") == ["1", "2", "3"] and order("age") == ["2", "3", "1"] and order("duration") == ["3", "1", "2"] and order("new") == ["3", "2", "1"]


def test_near_matches_only_where_nothing_matches(spark):
    rows = items(spark, {}, {"content_type": "movie"})
    assert near_matches(rows, Section("cartoon", age=6)).count() == 0
    assert [r.id for r in near_matches(rows, Section("cartoon", age=6, theme="роботы")).collect()] == ["1"]


def test_active_filters():
    assert active_filters(Section("book", age=6.0, theme="дружба", primary="both")) == ["6 лет", "дружба", "both"]


def test_collation(spark):
    words = ["яма", "жук", "Apple", "ёж", "Ель", "еж", "ель"]
    rows = items(spark, {"interests": words})
    assert [r.value for r in facets.sorted_domain(rows, "interests").collect()] == ["еж", "ёж", "ель", "Ель", "жук", "яма", "Apple"]


def test_similar_by_score_counts_candidates_repeats(spark):
    rows = items(spark, {}, {"interests": ["дружба", "дружба"], "moods": [], "genres": []}, {"interests": ["животные"], "moods": [], "genres": [], "age_min": 14, "age_max": 16})
    got = similar.similar_by_score(rows, rows.filter("id = '1'")).orderBy("rank").collect()
    assert [(r.id, r.score) for r in got] == [("2", 11.0), ("3", 3.0)]


def test_similar_against_all_pairs(spark, sf_dir):
    rows = enrich(derived_catalog(spark, sf_dir))
    plain = rows.select("id", "ord", "app_type", "age_min", "age_max", "interests", "moods", "genres").collect()
    got = {}
    for r in similar.similar_by_score(rows, rows).collect():
        got.setdefault(r.source_id, []).append((r["rank"], r.id, r.score))
    for a in plain[::7]:
        scored = []
        for b in plain:
            if b.id != a.id:
                mid = abs((b.age_min + b.age_max) / 2 - (a.age_min + a.age_max) / 2)
                shared = 3 * sum(x in a.interests for x in b.interests) + 2 * sum(x in a.moods for x in b.moods) + 2 * sum(x in a.genres for x in b.genres)
                scored.append((-(max(0, 5 - mid) + shared), b.ord, b.id))
        assert [(x[1], x[2]) for x in sorted(got[a.id])] == [(i, -s) for s, _, i in sorted(scored)[:3]]


def test_collections(spark):
    rows, listed = enrich(derived_catalog(spark, "/root/testdata/sf0.01")), derived_collections(spark)
    got = collections.expand(listed, rows).filter("collection_id = 'col-0'").collect()
    assert [r.pos for r in got] == [0, 1, 3, 4, 5, 6]
    assert {r.id for r in collections.orphans(listed, rows).collect()} == {"w-none"}
    assert collections.by_slug(listed, "collection-2").count() == 1
    assert collections.cards(listed).filter("id = 'col-1'").first().age_label == "Для всей семьи"


@pytest.mark.parametrize("stored,expected", [("not json", []), ('{"a":1}', []), ('["a",1,null,"b"]', ["a", "b"]), (None, []), ('["b","b"]', ["b", "b"]), ("[]", [])])
def test_stored_favorites(spark, stored, expected):
    df = spark.createDataFrame([(stored,)], "s string")
    assert df.select(favorites.parse_favorites(F.col("s"))).first()[0] == expected


def test_toggle_twice_is_identity(spark):
    df = spark.createDataFrame([(["a", "b"],)], "x array<string>")
    once = favorites.toggle(F.col("x"), F.lit("c"))
    assert df.select(once, favorites.toggle(once, F.lit("c")), favorites.toggle(F.col("x"), F.lit("a"))).first()[:] == (["a", "b", "c"], ["a", "b"], ["b"])


def test_batch_toggles(spark):
    events = [(1, "a", 1), (1, "b", 2), (1, "a", 3), (1, "c", 4), (1, "a", 5), (2, "b", 6), (2, "b", 7)]
    got = favorites.toggled_set(spark.createDataFrame(events, "user_id int, item string, seq int")).orderBy("place").collect()
    assert [(r.user_id, r.item) for r in got] == [(1, "b"), (1, "c"), (1, "a")]


def test_query_params_round_trip(spark):
    from shelfspark.operators.recommend import Query, query_frame

    cases = {"a": Query(6, "cartoon", ("дружба", "a&b=c"), ("x+y",), "family", "до 15 минут", "мама мыла"), "b": Query(), "c": Query(6.5, "reading")}
    df = query_frame(spark, cases)
    coded = df.withColumn("params", codec.encode_query(df))
    names = ["age", "format", "interests", "moods", "situation", "duration", "search"]
    back = coded.select(*[F.col(n).alias(f"o_{n}") for n in names], *[c.alias(n) for n, c in codec.decode_query(F.col("params")).items()]).collect()
    for r in back:
        assert [r[n] for n in names] == [r[f"o_{n}"] for n in names]


def test_param_edges(spark):
    df = spark.createDataFrame([("age=0&format=radio&interests=a||b&interests=z&situation=never&duration=",), ("age=x",), ("age=17.5",), ("",)], "p string")
    got = df.select(*[c.alias(n) for n, c in codec.decode_query(F.col("p")).items()]).collect()
    assert got[0][:] == (None, "all", ["a", "b"], [], None, "", "") and got[1].age is None and got[2].age is None and got[3].search == ""


def test_routes(spark):
    df = spark.createDataFrame([("/books/",), ("/catalog/a+b%20c",), ("/movies/x",), ("/none",), ("",)], "p string")
    got = [tuple(r[0]) for r in df.select(codec.route(F.col("p"))).collect()]
    assert got == [("section", "book", None), ("detail", None, "a+b c"), ("detail", "movie", "x"), ("not-found", None, None), ("home", None, None)]


def test_page_meta(spark):
    df = spark.createDataFrame([("",), ("age=6",)], "k string").select(cards.page_meta(F.lit("t"), F.lit("d"), F.lit("/"), F.col("k")).alias("m"))
    assert [r.m.robots for r in df.collect()] == ["index,follow", "noindex,follow"]


def test_facet_counts_toggle_the_chosen_value(spark):
    rows = items(spark, {}, {"interests": ["семья"]})
    got = {(r.facet, r.value): r for r in facets.facet_counts(rows, Query(6, "all", ("дружба",))).collect()}
    assert got["interests", "дружба"].n == 2 and got["interests", "семья"].n == 0 and got["interests", "семья"].unavailable
    assert got["interests", "дружба"].selected and got["format", "movie"].n == 0 and got["duration", "до 15 минут"].n == 1


@pytest.mark.parametrize(
    "query",
    [
        Query(6, "all", ("дружба", "red"), ("уютное",), None, None, ""),
        Query(None, "reading", (), (), "family", "на один вечер", ""),
        Query(5, "cartoon", ("дружба", "нет такого"), ("уютное", "спокойное"), "bedtime", "до 30 минут", "story"),
        Query(8.5, "all", (), (), None, None, "почитать на ночь"),
    ],
)
def test_facet_counts_are_those_of_each_changed_query(spark, sf_dir, query):
    rows = enrich(derived_catalog(spark, sf_dir)).cache()
    got = {(r.facet, r.value): (r.n, r.selected, r.unavailable) for r in facets.facet_counts(rows, query).collect()}
    changed = {}
    for facet, value in got:
        old = getattr(query, facet)
        new = value if facet not in ("interests", "moods") else tuple(x for x in old if x != value) if value in old else (*old, value)
        changed[f"{facet}|{value}"] = dataclasses.replace(query, **{facet: new})
    found = evaluate(rows, query_frame(spark, changed)).filter("size(missed) = 0").groupBy("qid").count().collect()
    exact = {r["qid"]: r["count"] for r in found}
    for (facet, value), (n, selected, unavailable) in got.items():
        old = getattr(query, facet)
        assert n == exact.get(f"{facet}|{value}", 0)
        assert selected == (value in old if isinstance(old, tuple) else value == old)
        assert unavailable == (n == 0 and not selected)
    seen = {v for column in ("interests", "moods") for r in rows.select(column).collect() for v in r[0]}
    assert {v for f, v in got if f in ("interests", "moods")} == seen
    rows.unpersist()


def test_facet_counts_of_no_rows_and_unset_columns(spark):
    none = items(spark, {}).limit(0)
    assert {(r.facet, r.n) for r in facets.facet_counts(none, Query()).collect()} == {("format", 0), ("situation", 0)}
    bare = items(spark, {"interests": None, "moods": None, "duration_category": None}, {"interests": ["a", "a", None], "duration_category": ""})
    got = {(r.facet, r.value): r.n for r in facets.facet_counts(bare, Query()).collect()}
    assert got["interests", "a"] == 1 and got["format", "all"] == 2 and not any(f == "duration" for f, _ in got)


def test_default_sort_is_collated(spark):
    rows = items(spark, {"id": "B"}, {"id": "a"}, {"id": "C"})
    assert [r.id for r in section(rows, Section("cartoon")).collect()] == ["a", "B", "C"]
    assert result_count(rows, Section("cartoon")).first().n == 3
