"""Results with a turn for every type: defaults change nothing, quotas hold, bonuses count."""

from __future__ import annotations

import random
from collections import Counter

import pytest
from fixtures import items
from shelfspark.operators.diversity import Weights, diverse_results
from shelfspark.operators.recommend import Query, first_results, query_frame

QUERIES = {"all": Query(6), "theme": Query(6, "all", ("a1",)), "one type": Query(6, "cartoon"), "no age": Query(None, "all", ("a2",)), "few": Query(6, "all", ("nowhere",), (), "family"), "none": Query(16, "movie")}


@pytest.fixture(scope="module")
def catalog(spark):
    rng = random.Random(5)
    kinds = ["book"] * 14 + ["cartoon"] * 5 + ["movie"] * 3 + ["fairy-tale"] * 2
    rows = [
        {"id": f"i{k % 60}", "ord": k, "title": f"T{rng.randrange(40)}", "content_type": rng.choice(kinds), "age_min": rng.randrange(2, 7), "age_max": rng.randrange(7, 12), "interests": [f"a{rng.randrange(4)}"], "family": rng.random() < 0.5}
        for k in range(66)
    ]
    return items(spark, *rows)


def listed(df):
    return {(r.qid, r.place): (r.bucket, r.id) for r in df.collect()}


@pytest.mark.parametrize("limit", [1, 6, 25, 100])
def test_defaults_are_the_plain_order(spark, catalog, limit):
    queries = query_frame(spark, QUERIES)
    assert listed(diverse_results(catalog, queries, limit)) == listed(first_results(catalog, queries, limit))


@pytest.mark.parametrize("quota", [1, 2])
def test_every_type_has_its_turn(spark, catalog, quota):
    """Among the first results of a bucket no type is more than one turn ahead of another that has any left."""
    found = diverse_results(catalog, query_frame(spark, QUERIES), 60, Weights(per_type=quota)).orderBy("qid", "place").collect()
    for qid in ("all", "theme", "no age"):
        exact = [r.app_type for r in found if r.qid == qid and r.bucket == "exact"]
        whole, seen = Counter(exact), Counter()
        for kind in exact:
            seen[kind] += 1
            turn = (seen[kind] - 1) // quota
            assert all(seen[t] >= min(whole[t], turn * quota) for t in whole)
    plain = listed(first_results(catalog, query_frame(spark, {"one type": QUERIES["one type"]}), 60))
    assert {k: v for k, v in ((((r.qid, r.place), (r.bucket, r.id))) for r in found) if k[0] == "one type"} == plain


def test_the_same_rows_in_another_order(spark, catalog):
    """With room for all, weights and quotas drop and add nothing."""
    queries = query_frame(spark, QUERIES)
    some = lambda w: {(r.qid, r.bucket, r.id) for r in diverse_results(catalog, queries, 500, w).collect()}
    assert some(Weights()) == some(Weights(5.0, 3.0, 1)) == some(Weights(per_type=3))


def test_bonuses(spark):
    """The middle of the range goes first, and more reasons do."""
    rows = [{"id": "edge", "age_min": 6, "age_max": 12}, {"id": "middle", "age_min": 4, "age_max": 8}, {"id": "beyond", "age_min": 2, "age_max": 6}]
    df, query = items(spark, *rows), query_frame(spark, {"q": Query(6, "cartoon")})
    order = lambda w: [r.id for r in diverse_results(df, query, 5, w).orderBy("place").collect()]
    assert order(Weights()) == ["edge", "middle", "beyond"]
    assert order(Weights(middle_age=4.0))[0] == "middle"
    points = {r.id: r.points for r in diverse_results(df, query, 5, Weights(middle_age=4.0)).collect()}
    assert points["middle"] - 140 == 4.0 and points["edge"] - 140 == 1.0 and points["beyond"] == pytest.approx(140 + 4 * (1 - 2 / 3), abs=1e-6)
    more = items(spark, {"id": "plain", "interests": []}, {"id": "two", "bedtime": True})
    asked = query_frame(spark, {"q": Query(6, "cartoon", (), (), "bedtime")})
    assert {r.id: r.points for r in diverse_results(more, asked, 5, Weights(several=2.0)).collect()}["two"] == 165 + 2.0


def test_no_rows(spark, catalog):
    assert diverse_results(catalog.limit(0), query_frame(spark, QUERIES), 5, Weights(per_type=1)).count() == 0
