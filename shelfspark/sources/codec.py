"""Queries and section states as URLs, and paths as pages.

Decoding takes a key's first value; unknown values fall back to the default.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfspark.functions import values as V
from shelfspark.functions.text import falsy, js_number, show_number, strings, truthy

SECTION_KEYS = {"search": "q", "theme": "theme", "mood": "mood", "duration": "duration", "primary": "mode", "secondary": "detail", "tertiary": "extra"}


def param(params: Column, key: str) -> Column:
    """The first value of a key in `a=b&c=d`, decoded; null if it isn't there."""
    pairs = F.filter(F.split(params, "&"), lambda p: F.try_url_decode(F.substring_index(p, "=", 1)) == key)
    first = F.get(pairs, F.lit(0))
    value = F.when(first.contains("="), F.substring(first, F.instr(first, "=") + 1, F.length(first))).otherwise(F.lit(""))
    return F.when(first.isNotNull(), F.coalesce(F.try_url_decode(value), value))


def _one_of(value: Column, allowed, otherwise=None) -> Column:
    return F.when(value.isin(*allowed), value).otherwise(otherwise)


def _age(value: Column, low, high) -> Column:
    n = js_number(value)
    return F.when((n >= low) & (n <= high), n)


def decode_query(params: Column) -> dict[str, Column]:
    listed = lambda key: F.coalesce(truthy(F.split(param(params, key), r"\|")), strings([]))
    return {
        "age": _age(param(params, "age"), *V.QUERY_AGES),
        "format": _one_of(param(params, "format"), ("reading", "cartoon", "movie"), "all"),
        "interests": listed("interests"),
        "moods": listed("moods"),
        "situation": _one_of(param(params, "situation"), tuple(V.SITUATION_LABELS)),
        "duration": param(params, "duration"),
        "search": F.coalesce(param(params, "q"), F.lit("")),
    }


def _joined(parts: list[tuple[str, Column]]) -> Column:
    """The parts that aren't null, encoded; a blank is written as +."""
    return F.concat_ws("&", *[F.concat(F.lit(f"{key}="), F.url_encode(value)) for key, value in parts])


def encode_query(df: DataFrame) -> Column:
    listed = lambda c: F.when(F.size(c) > 0, F.array_join(c, "|"))
    return _joined(
        [
            ("age", show_number(F.col("age"))),
            ("format", F.when(F.col("format") != "all", F.col("format"))),
            ("interests", listed("interests")),
            ("moods", listed("moods")),
            ("situation", falsy(F.col("situation"))),
            ("duration", falsy(F.col("duration"))),
            ("q", falsy(F.col("search"))),
        ]
    )


def decode_section(params: Column, min_age, max_age) -> dict[str, Column]:
    """A section state; ages outside the catalog's bounds are unset, and so are unknown sorts."""
    out = {"age": _age(param(params, "age"), min_age, max_age)}
    out |= {name: F.coalesce(param(params, key), F.lit("")) for name, key in SECTION_KEYS.items()}
    return out | {"sort": _one_of(param(params, "sort"), ("age", "duration", "new"), "")}


def encode_section(df: DataFrame) -> Column:
    return _joined([("age", show_number(F.col("age"))), *[(key, falsy(F.col(name))) for name, key in SECTION_KEYS.items()], ("sort", falsy(F.col("sort")))])


def route(path: Column) -> Column:
    """A path as page, type and slug. One trailing slash goes; /catalog stands for /books."""
    p = F.coalesce(falsy(F.regexp_replace(path, "/$", "")), F.lit("/"))
    none = F.lit(None).cast("string")
    page = lambda name, kind=none, slug=none: F.struct(F.lit(name).alias("page"), kind.alias("type"), slug.alias("slug"))
    out = F.when(p == "/", page("home")).when(p.isin("/books", "/catalog"), page("section", F.lit("book")))
    for kind in ("cartoon", "movie"):
        out = out.when(p == f"/{V.SECTION_PATHS[kind]}", page("section", F.lit(kind)))
    after = lambda prefix: F.try_url_decode(F.replace(F.substring(p, len(prefix) + 1, 1 << 20), F.lit("+"), F.lit("%2B")))
    for kind, name in V.SECTION_PATHS.items():
        out = out.when(p.startswith(f"/{name}/"), page("detail", F.lit(kind), after(f"/{name}/")))
    out = out.when(p.startswith("/catalog/"), page("detail", none, after("/catalog/")))
    out = out.when(p == "/collections", page("collections")).when(p.startswith("/collections/"), page("collection", none, after("/collections/")))
    return out.when(p == "/recommend", page("wizard")).when(p == "/favorites", page("favorites")).otherwise(page("not-found"))
