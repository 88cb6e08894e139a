"""Arrays of objects read by byte ranges, against the standard parser."""

from __future__ import annotations

import json
import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from shelfspark.sources.catalog import load_json, load_json_array
from shelfspark.sources.json_array import json_objects

SPLIT = "spark.sql.files.maxPartitionBytes"


def read(spark, tmp_path, text, split=None):
    path = tmp_path / f"{random.getrandbits(64)}.json"
    path.write_text(text, encoding="utf-8")
    before = spark.conf.get(SPLIT)
    spark.conf.set(SPLIT, str(split or 1 << 27))
    try:
        rows = json_objects(spark, str(path)).orderBy("ord").collect()
    finally:
        spark.conf.set(SPLIT, before)
    assert [r.ord for r in rows] == list(range(len(rows)))
    return [json.loads(r.raw) for r in rows]


ROWS = [
    {"a": "braces } { and ] [ in a string", "b": [1, [2, {"c": "}"}], {}]},
    {},
    {"quote": 'say "x}" and \\ and \\" and \\\\', "line": "a\nb\tc", "ё": "«}»"},
    {"deep": {"x": {"y": {"z": [{"q": "},{"}]}}}},
    {"end": "\\"},
    {"last": "]"},
]


@pytest.mark.parametrize("split", [None, 7, 40, 64])
@pytest.mark.parametrize("form", [{}, {"indent": 2}, {"separators": (",", ":")}, {"ensure_ascii": False}])
def test_strings_with_brackets_and_quotes(spark, tmp_path, split, form):
    assert read(spark, tmp_path, " \n" + json.dumps(ROWS, **form) + "\n ", split) == ROWS


def test_many_objects_in_many_tasks(spark, tmp_path):
    rng = random.Random(3)
    rows = [{"id": k, "text": "".join(rng.choice('ab{}[]",\\é ') for _ in range(rng.randrange(40)))} for k in range(800)]
    assert read(spark, tmp_path, json.dumps(rows, ensure_ascii=False), 900) == rows


@pytest.mark.parametrize("text", ["[]", "", " [ ] "])
def test_no_objects(spark, tmp_path, text):
    assert read(spark, tmp_path, text) == []


_VALUES = st.recursive(st.none() | st.booleans() | st.integers(-9, 9) | st.text('ab{}[]",:\\ é', max_size=6), lambda x: st.lists(x, max_size=3) | st.dictionaries(st.text('k}"', max_size=3), x, max_size=3), max_leaves=6)


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.dictionaries(st.text('k{"', max_size=3), _VALUES, max_size=3), max_size=6), st.integers(5, 60))
def test_any_objects(spark, tmp_path, rows, split):
    assert read(spark, tmp_path, json.dumps(rows, ensure_ascii=False), split) == rows


def test_the_same_catalog(spark, tmp_path):
    rows = [{"id": f"{k}", "slug": f"s{k}", "title": 'T "}" [' + str(k), "contentType": "book", "recommendedAgeMin": 3, "recommendedAgeMax": 8 + k, "interests": ["a}", "b"], "originalYear": 1990 if k % 2 else "1990"} for k in range(20)]
    rows[3].pop("slug")
    path = tmp_path / "c.json"
    path.write_text(json.dumps(rows, ensure_ascii=False), encoding="utf-8")
    assert sorted(load_json_array(spark, str(path)).collect()) == sorted(load_json(spark, str(path)).collect())
    empty = tmp_path / "e.json"
    empty.write_text("[]")
    with pytest.raises(ValueError):
        load_json_array(spark, str(empty))
