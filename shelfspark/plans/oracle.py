"""The registered queries in SQL, written apart from the DataFrame forms."""

from __future__ import annotations

from shelfspark.operators.recommend import Query

from . import scenarios as S
from . import sql_values as V

WHITE = V.WHITE


def s(value: str | None) -> str:
    return "NULL" if value is None else "'" + value.replace("'", "''") + "'"


def arr(values) -> str:
    return "[" + ", ".join(map(s, values)) + "]::VARCHAR[]"


def norm(x: str) -> str:
    return f"trim(regexp_replace(replace(lower({x}), 'ё', 'е'), '{WHITE}+', ' ', 'g'))"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WHITE}+|{WHITE}+$', '', 'g')"


def case(mapping: dict, key: str, otherwise: str = "NULL") -> str:
    return f"CASE {key} " + " ".join(f"WHEN {s(k)} THEN {s(v)}" for k, v in mapping.items()) + f" ELSE {otherwise} END"


ITEMS = f"""
raw AS (
  SELECT CAST(p_partkey AS BIGINT) AS k, p_size AS z, CAST(substr(p_brand, 7) AS INTEGER) AS b, p_name AS n,
         split_part(p_name, ' ', 1) AS w1, split_part(p_name, ' ', 2) AS w2, p_brand, p_type,
         {arr(["наука", "дружба", "семья", "животные", "приключения", "школа", "история", "космос"])} AS tl,
         {arr(["спокойное", "уютное", "смешное", "захватывающее", "трогательное", "таинственное"])} AS ml
  FROM part),
cat AS (
  SELECT k AS ord, 'w-' || lpad(CAST(k AS VARCHAR), 6, '0') AS id, replace(n, ' ', '-') || '-' || k AS slug, n || ' ' || k AS title,
    CASE WHEN k % 3 <> 0 THEN upper(n) END AS original_title,
    CASE WHEN k % 16 < 3 THEN 'fairy-tale' WHEN k % 16 < 8 THEN 'book' WHEN k % 16 < 13 THEN 'cartoon' ELSE 'movie' END AS content_type,
    CASE WHEN k % 16 < 3 THEN 'Классическая сказка' WHEN k % 16 < 8 AND k % 2 = 0 THEN 'Классическая книга' WHEN k % 16 < 8 THEN 'Современная книга'
         WHEN k % 16 < 13 THEN 'Мультфильм' ELSE 'Фильм' END AS category_label,
    CASE WHEN k % 7 <> 0 THEN p_brand END AS creator,
    CASE WHEN k % 6 <> 0 THEN 'Studio ' || (b % 5) END AS studio,
    CASE WHEN k % 8 <> 0 THEN 'Country ' || (b % 4) END AS country,
    CASE WHEN k % 10 NOT IN (0, 1) THEN CAST(1950 + k % 75 AS INTEGER) END AS year,
    CASE k % 5 WHEN 1 THEN '0+' WHEN 2 THEN '6+' WHEN 3 THEN 'требует сверки' WHEN 4 THEN '12+' END AS rating,
    CASE WHEN k % 7 <> 3 THEN 'registry' END AS rating_source,
    CAST(2 + z % 11 AS INTEGER) AS age_min, CAST(2 + z % 11 + 2 + k % 4 AS INTEGER) AS age_max,
    [lower(p_type)] AS genres,
    CASE WHEN k % 9 < 8 THEN [w1, w2, tl[(k % 9) + 1]] ELSE [w1, w2] END AS interests,
    CASE WHEN b % 6 = z % 6 THEN [ml[b % 6 + 1]] ELSE [ml[b % 6 + 1], ml[z % 6 + 1]] END AS moods,
    z % 2 = 0 AS bedtime, z % 3 <> 0 AS family, 2 + z % 11 >= 6 AS independent,
    CASE WHEN k % 16 < 8 AND k % 11 <> 0 THEN z * 7 END AS page_count,
    CASE WHEN k % 16 >= 8 AND k % 11 <> 0 THEN 3 + 2 * z END AS duration_minutes,
    CASE WHEN k % 11 = 0 THEN NULL
         WHEN k % 16 < 8 THEN CASE WHEN z * 7 <= 40 THEN 'короткая история' WHEN z * 7 <= 80 THEN 'на один вечер' WHEN z * 7 <= 250 THEN 'на несколько вечеров' ELSE 'длинная книга' END
         ELSE CASE WHEN 3 + 2 * z <= 15 THEN 'до 15 минут' WHEN 3 + 2 * z <= 30 THEN 'до 30 минут' WHEN 3 + 2 * z <= 60 THEN 'до 60 минут' WHEN 3 + 2 * z <= 90 THEN 'до 90 минут' ELSE 'больше 90 минут' END
    END AS duration_category,
    CASE WHEN k % 20 = 0 THEN 'https://example.invalid/' || k END AS image_url,
    CASE WHEN k % 4 = 1 THEN '   ' WHEN k % 4 > 1 THEN 'Story about ' || n END AS short_description
  FROM raw),
item AS (
  SELECT *,
    CASE WHEN content_type = 'fairy-tale' THEN 'book' ELSE content_type END AS app_type,
    CASE WHEN rating <> '' AND rating_source <> '' AND NOT regexp_matches(rating, '(?i){V.UNCONFIRMED}') THEN rating END AS official_rating,
    age_min || '–' || age_max || ' лет' AS age_label,
    coalesce(nullif({strip("short_description")}, ''), upper(genres[1][1]) || genres[1][2:] || ' для детей ' || age_min || '–' || age_max || ' лет.'
      || ' Темы и настроение: ' || array_to_string(list_concat(interests, moods)[1:4], ', ') || '.') AS description,
    list_transform(list_filter(list_concat([title, original_title, creator, studio], genres, interests, moods), lambda x: x <> ''), lambda x: {norm("x")}) AS texts
  FROM cat)
"""


def with_items(body: str, more: str = "") -> str:
    return f"WITH {ITEMS}{', ' + more if more else ''} {body}"


PATH = f"'/' || ({case(V.SECTION_PATHS, 'app_type')}) || '/' || slug"
SEED = "CASE WHEN coalesce(image_url, '') = '' THEN CAST(list_sum(list_transform(string_split(id, ''), lambda x: ascii(x))) % 6 AS INTEGER) END"
BOOK = """
  CASE WHEN independent AND family THEN 'both' WHEN independent THEN 'independent' ELSE 'together' END AS reading_mode,
  CASE WHEN coalesce(page_count, 0) > 250 OR duration_category = 'длинная книга' THEN 'long' WHEN coalesce(page_count, 0) > 80 OR duration_category = 'на несколько вечеров' THEN 'medium' ELSE 'short' END AS length_category,
  CASE WHEN age_max <= 6 THEN 'easy' WHEN age_min >= 10 THEN 'advanced' ELSE 'medium' END AS language_difficulty,
  CASE WHEN contains(lower(category_label), 'классичес') OR content_type = 'fairy-tale' THEN 'classic' WHEN contains(lower(category_label), 'современн') THEN 'modern' END AS classic_or_modern"""
EDU = f"list_has_any(interests, {arr(V.EDUCATIONAL)})"
CARTOON = f"""
  CASE WHEN coalesce(duration_minutes, 999) <= 30 THEN 'short-or-series' ELSE 'feature' END AS cartoon_format,
  CASE WHEN {EDU} AND list_contains(moods, 'смешное') THEN 'mixed' WHEN {EDU} THEN 'educational' ELSE 'entertainment' END AS purpose,
  CASE WHEN list_has_any(moods, {arr(V.CALM_MOODS)}) THEN 'calm' WHEN list_contains(moods, 'захватывающее') THEN 'dynamic' ELSE 'moderate' END AS pace"""
MOVIE = """
  CASE WHEN age_min >= 11 THEN 'teen' ELSE 'family' END AS audience_type,
  CASE WHEN family THEN 'high' ELSE 'medium' END AS discussion_potential"""


def matches(needle: str, search: str) -> str:
    """SQL for the search rule; needle is the normalised phrase."""
    trigger = {k: f"regexp_matches({needle}, '{p}')" for k, p in V.INTENTS.items()}
    age = f"regexp_extract({needle}, '{V.AGE_PHRASE.replace('WHITE', WHITE)}', 1)"
    holds = {
        "read": "content_type IN ('book', 'fairy-tale')",
        "watch": "content_type IN ('cartoon', 'movie')",
        "bedtime": "bedtime",
        "family": "family",
        "independent": "independent",
        "calm": f"list_has_any(moods, {arr(V.CALM_MOODS)})",
    }
    intents = [f"CASE WHEN {trigger[k]} THEN {holds[k]} END" for k in holds]
    intents.append(f"CASE WHEN {age} <> '' THEN TRY_CAST({age} AS INTEGER) BETWEEN age_min AND age_max END")
    intents += [f"CASE WHEN len(list_filter({c}, lambda x: contains({needle}, {norm('x')}))) > 0 THEN true END" for c in ("interests", "moods")]
    recorded = f"list_filter([{', '.join(intents)}], lambda x: x IS NOT NULL)"
    direct = f"len(list_filter(texts, lambda x: contains(x, {needle}))) > 0"
    return f"({needle} = '' OR {direct} OR (len({recorded}) > 0 AND len(list_filter({recorded}, lambda x: NOT x)) = 0))"


def query_rows(queries: dict[str, Query]) -> str:
    rows = [
        f"({s(k)}, {'NULL' if q.age is None else float(q.age)}::DOUBLE, {s(q.format)}, {arr(q.interests)}, {arr(q.moods)}, {s(q.situation)}, {s(q.duration)}, {s(q.search)})" for k, q in queries.items()
    ]
    return "q(qid, q_age, q_format, q_interests, q_moods, q_situation, q_duration, q_search) AS (VALUES " + ", ".join(rows) + ")"


def evaluated(source: str = "q") -> str:
    """CTEs up to `ev`: every row for every query, scored."""
    needle = norm("q_search")
    watch, read = arr(V.WATCH_DURATIONS), arr(V.READ_DURATIONS)
    place = lambda x: f"CASE WHEN list_contains({watch}, q_duration) THEN coalesce(list_position({watch}, {x}), 0) ELSE coalesce(list_position({read}, {x}), 0) END"
    return f"""
known AS (SELECT DISTINCT unnest(interests) AS i FROM item),
qk AS (SELECT {source}.*, list_filter(q_interests, lambda x: list_contains(kl, x)) AS q_known FROM {source}, (SELECT list(i) AS kl FROM known)),
matched AS (
  SELECT *,
    coalesce(q_age IS NULL OR q_age BETWEEN age_min AND age_max, false) AS m_age,
    CASE q_format WHEN 'all' THEN true WHEN 'reading' THEN content_type IN ('book', 'fairy-tale') ELSE content_type = q_format END AS m_format,
    CASE WHEN q_situation IS NULL THEN true WHEN q_situation = 'bedtime' THEN bedtime WHEN q_situation = 'family' THEN family ELSE independent END AS m_situation,
    list_filter(q_interests, lambda x: list_contains(interests, x)) AS m_interests,
    list_filter(q_moods, lambda x: list_contains(moods, x)) AS m_moods,
    coalesce(duration_category = q_duration, false) AS m_duration,
    coalesce(({place("q_duration")}) > 0 AND ({place("duration_category")}) > 0 AND abs(({place("q_duration")}) - ({place("duration_category")})) = 1, false) AS m_near,
    {matches(needle, "q_search")} AS m_search
  FROM item CROSS JOIN qk),
ev AS (
  SELECT *,
    CAST(CASE WHEN m_age THEN 100 ELSE 0 END + CASE WHEN m_format AND q_format <> 'all' THEN 40 ELSE 0 END + CASE WHEN q_situation IS NOT NULL AND m_situation THEN 25 ELSE 0 END
      + 14 * len(m_interests) + 7 * len(m_moods) + CASE WHEN q_duration IS NULL THEN 0 WHEN m_duration THEN 16 WHEN m_near THEN 7 ELSE 0 END
      + CASE WHEN q_search <> '' AND m_search THEN 24 ELSE 0 END AS INTEGER) AS score,
    list_filter([
      CASE WHEN q_age IS NOT NULL AND m_age THEN 'Подходит для ' || age_label END,
      CASE WHEN q_situation IS NOT NULL AND m_situation THEN {case(V.SITUATION_LABELS, "q_situation")} END,
      CASE WHEN len(m_interests) > 0 THEN 'Совпадает по интересу: ' || array_to_string(m_interests[1:2], ', ') END,
      CASE WHEN len(m_moods) > 0 THEN 'Совпадает настроение: ' || array_to_string(m_moods[1:2], ', ') END,
      CASE WHEN m_duration THEN 'Подходит по длительности: ' || q_duration END,
      CASE WHEN q_search <> '' AND m_search THEN 'Соответствует поисковому запросу' END], lambda x: x IS NOT NULL) AS reasons,
    list_filter([
      CASE WHEN NOT m_age THEN 'Не совпадает по возрасту' END,
      CASE WHEN NOT m_format THEN 'Другой тип произведения' END,
      CASE WHEN NOT m_situation THEN 'Не совпадает ситуация использования' END,
      CASE WHEN len(m_interests) < len(q_interests) THEN CASE WHEN len(q_known) = 0 THEN 'Выбранный интерес пока не представлен в базе' ELSE 'Совпадает ' || len(m_interests) || ' из ' || len(q_interests) || ' интересов' END END,
      CASE WHEN len(m_moods) < len(q_moods) THEN 'Настроение отличается от выбранного' END,
      CASE WHEN q_duration IS NOT NULL AND NOT m_duration THEN CASE WHEN m_near THEN 'Немного отличается по длительности: ' || duration_category ELSE 'Заметно отличается по длительности' END END,
      CASE WHEN q_search <> '' AND NOT m_search THEN 'Не совпадает с текстом поиска' END], lambda x: x IS NOT NULL) AS missed
  FROM matched)"""


#: Relaxation step by step: each step keeps its filter only for queries that it leaves some row.
RELAXED = """
exact AS (SELECT * FROM ev WHERE len(missed) = 0),
ne AS (SELECT q.qid, (SELECT count(*) FROM exact e WHERE e.qid = q.qid) AS n FROM (SELECT DISTINCT qid FROM qk) q),
p1 AS (SELECT * FROM ev WHERE len(missed) > 0 AND m_age),
p2f AS (SELECT * FROM p1 WHERE len(q_known) = 0 OR list_has_any(interests, q_known)),
p2 AS (SELECT * FROM p2f UNION ALL SELECT * FROM p1 WHERE qid NOT IN (SELECT qid FROM p2f)),
p3f AS (SELECT * FROM p2 WHERE q_duration IS NULL OR m_duration OR m_near),
p3 AS (SELECT * FROM p3f UNION ALL SELECT * FROM p2 WHERE qid NOT IN (SELECT qid FROM p3f)),
p4 AS (SELECT * FROM p3 WHERE m_format),
p5f AS (SELECT * FROM p4 WHERE m_situation),
p5 AS (SELECT * FROM p5f UNION ALL SELECT * FROM p4 WHERE qid NOT IN (SELECT qid FROM p5f)),
pr AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, len(missed), title, ord) AS rank FROM p5),
partial AS (SELECT pr.* FROM pr JOIN ne USING (qid) WHERE ne.n < 3 AND rank <= 6 - ne.n),
al AS (SELECT p3.*, row_number() OVER (PARTITION BY p3.qid ORDER BY score DESC, len(missed), title, ord) AS rank FROM p3 JOIN ne USING (qid)
       WHERE NOT m_format AND q_format <> 'all' AND ne.n = 0 AND p3.qid NOT IN (SELECT qid FROM partial)),
alternate AS (SELECT * FROM al WHERE rank <= 4),
er AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, len(missed), title, ord) AS rank FROM exact),
found AS (SELECT 'exact' AS bucket, 0 AS bo, * FROM er UNION ALL SELECT 'partial', 1, * FROM partial UNION ALL SELECT 'alternate', 2, * FROM alternate)"""
SHOWN = "qid, bucket, id, score, array_to_string(reasons, '; ') AS reasons, array_to_string(missed, '; ') AS missed"
NO_EXACT_RANK = "CASE WHEN bucket <> 'exact' THEN CAST(rank AS INTEGER) END AS rank"


def recommended(queries: dict[str, Query], body: str) -> str:
    return with_items(body, f"{query_rows(queries)}, {evaluated()}, {RELAXED}")


CUSTOMER_ANSWERS = """SELECT 'c' || c_custkey AS qid, CASE WHEN c_custkey % 11 <> 0 THEN c_custkey % 15 + 2 END AS age, ['all', 'reading', 'cartoon', 'movie', NULL][c_custkey % 5 + 1] AS format,
  ['', 'rest', 'anxious', 'sad', 'bored', 'angry', 'changes', 'laugh', 'learn', 'other', NULL][c_custkey % 11 + 1] AS feeling, CASE c_custkey % 3 WHEN 0 THEN '' WHEN 1 THEN lower(c_mktsegment) END AS interest,
  ['', 'short', 'medium', 'hour', 'long', NULL][c_custkey % 6 + 1] AS time, ['', 'self', 'family', 'adult', NULL, 'friends', 'self'][c_custkey % 7 + 1] AS interaction FROM customer"""


def wizard_rows(answers: str | None = None) -> str:
    lit = lambda v: "NULL" if v is None else str(v) if isinstance(v, int) else s(v)
    rows = ", ".join("(" + ", ".join(lit(v) for v in a) + ")" for a in S.ANSWERS)
    moods = "CASE feeling " + " ".join(f"WHEN {s(k)} THEN {arr(v)}" for k, v in V.FEELING_MOODS.items()) + " ELSE []::VARCHAR[] END"
    return f"""answers(qid, age, format, feeling, interest, time, interaction) AS ({answers or f"VALUES {rows}"}),
wq AS (SELECT qid, CAST(coalesce(age, 7) AS DOUBLE) AS q_age, coalesce(format, 'all') AS q_format,
  list_filter([interest, CASE WHEN feeling = 'learn' THEN 'наука' END], lambda x: x <> '') AS q_interests, {moods} AS q_moods,
  CASE WHEN interaction = 'self' THEN 'independent' WHEN interaction IN ('family', 'adult') THEN 'family' END AS q_situation,
  {case(V.TIME_DURATIONS, "time")} AS q_duration, '' AS q_search FROM answers)"""


COLLECTIONS = "coll AS (SELECT CAST(i AS INTEGER) AS i, 'col-' || i AS cid, list_concat([format('w-{:06d}', CAST(i * 37 % 260 + 1 AS BIGINT)), format('w-{:06d}', CAST((i * 37 + 13) % 260 + 1 AS BIGINT)), 'w-none'], list_transform(range(2, 6 + i), lambda j: format('w-{:06d}', CAST((i * 37 + j * 13) % 260 + 1 AS BIGINT)))) AS ids FROM range(4) t(i)), listed AS (SELECT cid, unnest(ids) AS id, generate_subscripts(ids, 1) - 1 AS pos FROM coll)"


def section(kind: str, where: str, more: str = "") -> str:
    derived = {"book": BOOK, "cartoon": CARTOON, "movie": MOVIE}[kind]
    return with_items(f"SELECT id, ord, age_min, duration_minutes, page_count, year FROM sec WHERE {where}", f"sec AS (SELECT *, {derived} FROM item WHERE app_type = '{kind}')" + more)


def domains(kind: str, tertiary: str) -> str:
    rows = f"FROM item WHERE app_type = '{kind}'"
    return with_items(
        f"""SELECT DISTINCT facet, value FROM (SELECT 'theme' AS facet, unnest(interests) AS value {rows} UNION ALL SELECT 'mood', unnest(moods) {rows}
            UNION ALL SELECT 'duration', duration_category {rows} UNION ALL SELECT 'tertiary', {tertiary} {rows}) WHERE value <> ''"""
    )


HAY = norm("array_to_string(list_filter(list_concat([title, original_title, description, creator, studio], interests), lambda x: x <> ''), ' ')")
CLICKS = "clicks AS (SELECT user_id, event_id % 40 AS item, event_id AS seq FROM events WHERE event_type = 'click')"


def parameter(key: str) -> str:
    """The first value of a key of `params`, decoded; NULL if the key isn't there."""
    first = f"list_filter(str_split(params, '&'), lambda x: split_part(x, '=', 1) = '{key}')[1]"
    return f"url_decode(replace(CASE WHEN contains({first}, '=') THEN substr({first}, strpos({first}, '=') + 1) WHEN {first} IS NOT NULL THEN '' END, '+', ' '))"


def age_between(value: str, low: int, high: int) -> str:
    number = f"CASE WHEN trim({value}) = '' THEN 0 ELSE try_cast({value} AS DOUBLE) END"
    return f"CASE WHEN {number} BETWEEN {low} AND {high} THEN {number} END"


def encoded(parts: list[tuple[str, str]]) -> str:
    """Parts that are neither NULL nor empty, as a form encodes them."""
    return "concat_ws('&', " + ", ".join(f"'{key}=' || replace(replace(replace(url_encode(nullif({value}, '')), '%20', '+'), '~', '%7E'), '%2A', '*')" for key, value in parts) + ")"


def codecs() -> dict[str, str]:
    """URL, JSON, router and collection queries, with their inputs derived from the tables as plans/inputs.py says."""
    number = "CASE WHEN age = floor(age) THEN CAST(CAST(age AS BIGINT) AS VARCHAR) ELSE CAST(age AS VARCHAR) END"
    listed = lambda key: f"coalesce(array_to_string(list_filter(str_split({parameter(key)}, '|'), lambda x: x <> ''), '|'), '')"
    only = lambda key, allowed, otherwise="NULL": f"CASE WHEN {parameter(key)} IN ({', '.join(map(s, allowed))}) THEN {parameter(key)} ELSE {otherwise} END"
    keys = {"search": "q", "theme": "theme", "mood": "mood", "duration": "duration", "primary": "mode", "secondary": "detail", "tertiary": "extra"}
    state = ", ".join(f"coalesce({parameter(key)}, '') AS \"{name}\"" for name, key in keys.items())
    query_urls = """urls AS (SELECT id, CASE ord % 6 WHEN 0 THEN 'age=' || age_min || '&format=' || content_type || '&interests=' || array_to_string(interests, '%7C') || '&q=' || replace(title, ' ', '+') || '%2Bc'
      WHEN 1 THEN 'age=' || age_min || '.5&format=radio&moods=%7C%7C' || coalesce(moods[1], '') || '&situation=family' WHEN 2 THEN 'age=99&situation=never&q=' || replace(title, ' ', '+') || '&duration='
      WHEN 3 THEN 'age=0&interests=a%7C%7C' || coalesce(interests[1], '') || '&interests=z' WHEN 4 THEN 'age=x&q=%20%20&format=reading&situation=bedtime&duration=' || replace(coalesce(duration_category, ''), ' ', '%20') ELSE '' END AS params FROM item)"""
    section_urls = """urls AS (SELECT id, CASE WHEN ord % 7 = 0 THEN '' ELSE 'age=' || (CASE ord % 4 WHEN 0 THEN '40' WHEN 1 THEN '' ELSE CAST(age_max AS VARCHAR) END) || '&mode=both&sort=' || ['age', 'duration', 'new', 'best', ''][ord % 5 + 1]
      || '&q=' || replace(title, ' ', '+') || (CASE WHEN ord % 3 = 0 THEN '&theme=' || coalesce(interests[3], '') || '&extra=x' ELSE '' END) END AS params FROM item)"""
    paths = f"""paths AS (SELECT id, CASE ord % 10 WHEN 0 THEN '/catalog/' || slug WHEN 1 THEN {PATH} || '/' WHEN 2 THEN '/collections/' || slug || '%20+x' WHEN 3 THEN '/nowhere/' || slug
      WHEN 4 THEN ['/', '/books/', '/catalog', '/cartoons', '/movies', '/collections', '/recommend', '/favorites', '/booksx'][ord // 10 % 9 + 1] ELSE {PATH} END AS path FROM item)"""
    stored = """SELECT user_id, CASE user_id % 10 WHEN 0 THEN 'not json ' || user_id WHEN 1 THEN '{"a":' || user_id || '}' WHEN 2 THEN '[' || user_id || ',null,{"b":"c"},true,' || substr(l, 2) WHEN 3 THEN '[]' WHEN 4 THEN NULL
      WHEN 5 THEN '["b","b",""]' WHEN 6 THEN CAST(user_id AS VARCHAR) ELSE l END AS stored
      FROM (SELECT user_id, '["' || string_agg(DISTINCT format('w-{:06d}', event_id % 40), '","' ORDER BY format('w-{:06d}', event_id % 40)) || '"]' AS l FROM events WHERE event_type = 'click' GROUP BY user_id)"""
    return {
        "json_favorites_sanitize": f"""SELECT user_id, CASE WHEN json_valid(stored) AND json_type(try_cast(stored AS JSON)) = 'ARRAY'
            THEN array_to_string(list_transform(list_filter(json_extract(try_cast(stored AS JSON), '$[*]'), lambda x: json_type(x) = 'VARCHAR'), lambda x: json_extract_string(x, '$')), '|') ELSE '' END AS items FROM ({stored})""",
        "params_decode": with_items(
            f"""SELECT id, {age_between(parameter("age"), 1, 17)} AS age, {only("format", ("reading", "cartoon", "movie"), "'all'")} AS format, {listed("interests")} AS interests, {listed("moods")} AS moods,
            {only("situation", ("bedtime", "family", "independent"))} AS situation, {parameter("duration")} AS duration, coalesce({parameter("q")}, '') AS search FROM urls""",
            query_urls,
        ),
        "params_encode": with_items(
            f"""SELECT id, {encoded([("age", number), ("format", "nullif(format, 'all')"), ("interests", "array_to_string(interests, '|')"), ("moods", "array_to_string(moods, '|')"), ("situation", "situation"), ("duration", "duration_category"), ("q", "short_description")])} AS params
            FROM (SELECT *, CASE WHEN ord % 4 <> 0 THEN age_min + ord % 2 / 2 END AS age, CASE WHEN ord % 3 = 0 THEN 'all' ELSE content_type END AS format, CASE WHEN family THEN 'family' ELSE '' END AS situation FROM item)"""
        ),
        "section_params": with_items(
            f"""SELECT *, {encoded([("age", number), *[(key, f'"{name}"') for name, key in keys.items()], ("sort", "sort")])} AS params FROM (
            SELECT id, {age_between(parameter("age"), 2, 17)} AS age, {state}, {only("sort", ("age", "duration", "new"), "''")} AS sort FROM urls)""",
            section_urls,
        ),
        "active_filters": with_items(
            f"""SELECT id, array_to_string(list_filter([CASE WHEN age <> 0 THEN {number} || ' лет' END, theme, mood, duration, "primary", secondary, tertiary], lambda x: x <> ''), '|') AS tags FROM (
            SELECT id, {age_between(parameter("age"), 2, 17)} AS age, {state} FROM urls)""",
            section_urls,
        ),
        "page_meta": with_items(
            f"""SELECT id, title || ' (' || age_label || ')' AS title, description, {PATH} AS canonical, CASE WHEN params <> '' THEN 'noindex,follow' ELSE 'index,follow' END AS robots FROM item JOIN urls USING (id)""",
            section_urls,
        ),
        "favorites_save": f"""WITH {CLICKS} SELECT user_id, '["' || string_agg(format('w-{{:06d}}', item), '","' ORDER BY added) || '"]' AS stored, CAST(count(*) AS INTEGER) AS n
            FROM (SELECT user_id, item, max(seq) AS added FROM clicks GROUP BY user_id, item HAVING count(*) % 2 = 1) GROUP BY user_id""",
        "routes": with_items(
            f"""SELECT id, path, page, CASE page WHEN 'section' THEN CASE head WHEN 'cartoons' THEN 'cartoon' WHEN 'movies' THEN 'movie' ELSE 'book' END
              WHEN 'detail' THEN CASE head WHEN 'books' THEN 'book' WHEN 'cartoons' THEN 'cartoon' WHEN 'movies' THEN 'movie' END END AS type,
              CASE WHEN page IN ('detail', 'collection') THEN url_decode(rest) END AS slug FROM (
            SELECT id, path, head, rest, CASE WHEN p = '' THEN 'home' WHEN head IN ('books', 'catalog', 'cartoons', 'movies') THEN CASE WHEN rest IS NULL THEN 'section' ELSE 'detail' END
              WHEN head = 'collections' THEN CASE WHEN rest IS NULL THEN 'collections' ELSE 'collection' END WHEN p = '/recommend' THEN 'wizard' WHEN p = '/favorites' THEN 'favorites' ELSE 'not-found' END AS page
            FROM (SELECT id, path, p, split_part(p, '/', 2) AS head, CASE WHEN contains(substr(p, 2), '/') THEN regexp_extract(p, '^/[^/]*/(.*)$', 1) END AS rest
                  FROM (SELECT id, path, regexp_replace(path, '/$', '') AS p FROM paths)))""",
            paths,
        ),
        "collections_file": with_items(
            """SELECT CAST(dense_rank() OVER (ORDER BY b) - 1 AS INTEGER) AS ord, 'col-' || b AS id, 'collection-' || b // 2 AS slug, 'Подборка ' || creator AS title, strftime(DATE '2026-06-10' + b, '%Y-%m-%d') AS published, CAST(k - 1 AS INTEGER) AS pos, id AS item_id
            FROM (SELECT id, creator, CAST(substr(creator, 7) AS INTEGER) AS b, row_number() OVER (PARTITION BY creator ORDER BY ord) AS k FROM item WHERE creator IS NOT NULL) WHERE k <= 8"""
        ),
        "collection_cards": with_items(
            """SELECT 'col-' || b AS id, 'collection-' || b // 2 AS slug, 'Подборка ' || creator AS title, CAST(n AS INTEGER) AS n_items, CASE WHEN b % 2 = 0 THEN '4–12 лет' ELSE 'Для всей семьи' END AS age_label,
            strftime(DATE '2026-06-10' + b, '%d.%m.%Y') AS published, CASE WHEN b % 3 = 0 THEN strftime(DATE '2026-06-10' + (b + 36), '%d.%m.%Y') END AS updated,
            array_to_string(list_transform(types, lambda x: CASE x WHEN 'book' THEN 'книги' WHEN 'cartoon' THEN 'мультфильмы' WHEN 'movie' THEN 'фильмы' END), ', ') AS types
            FROM (SELECT creator, CAST(substr(creator, 7) AS INTEGER) AS b, count(*) AS n, list_sort(list_distinct(list(app_type))) AS types
              FROM (SELECT *, row_number() OVER (PARTITION BY creator ORDER BY ord) AS k FROM item WHERE creator IS NOT NULL) WHERE k <= 8 GROUP BY creator)"""
        ),
    }


def oracle() -> dict[str, str]:
    out = {
        "catalog_enriched": with_items(
            f"SELECT id, ord, slug, title, original_title, app_type, official_rating, age_label, description, {PATH} AS path, {SEED} AS artwork_seed, ({case(V.TYPE_LABELS, 'content_type')}) AS type_label, country, year, duration_category, array_to_string(interests, '|') AS interests, array_to_string(moods, '|') AS moods, array_to_string(genres, '|') AS genres FROM item"
        ),
        "type_partition_counts": with_items("SELECT app_type, count(*) AS n FROM item GROUP BY app_type"),
        "facet_interests": with_items("SELECT DISTINCT unnest(interests) AS value FROM item"),
        "facet_moods": with_items("SELECT DISTINCT unnest(moods) AS value FROM item"),
        "facet_durations_first_seen": with_items("SELECT duration_category AS value, min(ord) AS first_ord FROM item WHERE duration_category <> '' GROUP BY 1"),
        "quick_interests": with_items("SELECT value FROM (SELECT DISTINCT unnest(interests) AS value FROM item) ORDER BY value COLLATE ru LIMIT 8"),
        "age_bounds": with_items("SELECT min(age_min) AS min_age, max(age_max) AS max_age FROM item"),
        "official_rating": with_items("SELECT id, official_rating FROM item WHERE official_rating IS NOT NULL"),
        "book_attributes": with_items(f"SELECT id, creator AS author, {BOOK} FROM item WHERE app_type = 'book'"),
        "cartoon_attributes": with_items(f"SELECT id, studio, {CARTOON} FROM item WHERE app_type = 'cartoon'"),
        "movie_attributes": with_items(f"SELECT id, {MOVIE} FROM item WHERE app_type = 'movie'"),
        "neutral_description": with_items("SELECT id, description FROM item"),
        "content_path": with_items(f"SELECT id, {PATH} AS path FROM item"),
        "artwork_seed": with_items(f"SELECT id, {SEED} AS artwork_seed FROM item"),
        "card_details": with_items(
            """SELECT id, array_to_string(list_filter(CASE app_type
              WHEN 'book' THEN [creator, CASE WHEN independent AND family THEN 'сам или вместе' WHEN independent THEN 'читает сам' ELSE 'читаем вместе' END, genres[1]]
              WHEN 'cartoon' THEN [CASE WHEN coalesce(duration_minutes, 999) <= 30 THEN 'короткий формат или сериал' ELSE 'полнометражный' END, duration_minutes || ' минут', studio]
              ELSE [CAST(year AS VARCHAR), CASE WHEN age_min >= 11 THEN 'подростковый' ELSE 'семейный' END, duration_minutes || ' минут'] END, lambda x: x <> ''), ' · ') AS details,
              array_to_string(interests[1:2], ', ') AS tags, official_rating FROM item"""
        ),
        "detail_facts": with_items(
            """SELECT id, coalesce(creator, 'Не указано') AS creator,
              coalesce(nullif(concat_ws(', ', country, CAST(year AS VARCHAR)), ''), 'Не указано') AS place,
              coalesce(duration_minutes || ' минут', page_count || ' страниц', duration_category, 'Не указано') AS volume,
              coalesce(nullif(concat_ws(', ', CASE WHEN bedtime THEN 'Перед сном' END, CASE WHEN family THEN 'Всей семьёй' END, CASE WHEN independent THEN 'Самостоятельно' END), ''), 'не указано') AS suitable,
              genres[1] AS genres FROM item"""
        ),
        "normalize_documents": f"SELECT doc_id, md5({norm('text')}) AS normalized_md5, CAST(length({norm('text')}) AS BIGINT) AS n FROM documents",
        "section_books_age": section("book", "6 BETWEEN age_min AND age_max"),
        "section_cartoons_duration": section("cartoon", "cartoon_format = 'short-or-series' AND studio = 'Studio 2'"),
        "section_movies_new": section("movie", "audience_type = 'family' AND discussion_potential = 'high' AND list_contains(moods, 'уютное')"),
        "section_books_mode": section("book", "reading_mode IN ('together', 'both') AND language_difficulty = 'medium' AND duration_category = 'на один вечер' AND list_contains(interests, 'дружба')"),
        "section_haystack": section("movie", f"contains({HAY}, {norm(s('  STORY  about r'))})"),
        "section_facets": domains("cartoon", "studio"),
        "section_facets_book": domains("book", "unnest(genres)"),
        "section_facets_movie": domains("movie", "unnest(genres)"),
        "section_result_counts": with_items("SELECT app_type AS kind, count(*) AS n FROM item WHERE 7 BETWEEN age_min AND age_max GROUP BY app_type"),
        "collection_slug": with_items("SELECT 'col-' || b AS id, 'Подборка ' || creator AS title FROM (SELECT DISTINCT creator, CAST(substr(creator, 7) AS INTEGER) AS b FROM item WHERE creator IS NOT NULL) WHERE b // 2 = 3 ORDER BY b LIMIT 1"),
        "json_catalog": with_items(
            """SELECT ord, id, CASE WHEN ord % 17 <> 0 THEN slug END AS slug, title, content_type, age_min, age_max, CASE WHEN ord % 10 <> 7 THEN year END AS year, array_to_string(interests, '|') AS interests
               FROM cat WHERE ord % 13 <> 0"""
        ),
        "params_round_trip": with_items(
            """SELECT id, CAST(age_min AS DOUBLE) AS age, CASE WHEN content_type IN ('cartoon', 'movie') THEN content_type ELSE 'reading' END AS format, array_to_string(interests, '|') AS interests,
               array_to_string(moods, '|') AS moods, CASE WHEN bedtime THEN 'bedtime' END AS situation, duration_category AS duration, title AS search FROM cat"""
        ),
        "section_near": with_items(
            "SELECT id, title FROM item WHERE app_type = 'movie' AND id IN (SELECT id FROM found) ORDER BY ord LIMIT 6",
            f"{query_rows({'q': Query(5, 'movie', ('роботы',), ('уютное',), None, 'до 30 минут', '')})}, {evaluated()}, {RELAXED}",
        ),
        "neighbour_duration": with_items(
            f"""SELECT x.id, x.duration_category AS selected, y.duration_category AS candidate, coalesce(CASE WHEN list_contains({arr(V.WATCH_DURATIONS)}, selected) THEN abs(list_position({arr(V.WATCH_DURATIONS)}, selected) - list_position({arr(V.WATCH_DURATIONS)}, candidate)) = 1
              ELSE abs(list_position({arr(V.READ_DURATIONS)}, selected) - list_position({arr(V.READ_DURATIONS)}, candidate)) = 1 END, false) AS neighbour FROM item x JOIN item y ON y.ord = x.ord + 1"""
        ),
        "evaluate_scores": with_items("SELECT qid, id, score, array_to_string(reasons, '; ') AS reasons, array_to_string(missed, '; ') AS missed FROM ev", f"{query_rows(S.SCENARIOS)}, {evaluated()}"),
        "recommend_batch": recommended(S.SCENARIOS, f"SELECT {SHOWN}, {NO_EXACT_RANK} FROM found"),
        "recommend_exact": recommended({"q2": S.SCENARIOS["q2"]}, "SELECT id, score, CAST(rank AS INTEGER) AS rank FROM found WHERE bucket = 'exact'"),
        "recommend_partial": recommended({k: S.SCENARIOS[k] for k in ("q3", "q4", "q5", "q6")}, "SELECT qid, id, score, CAST(rank AS INTEGER) AS rank FROM found WHERE bucket = 'partial'"),
        "recommend_alternate": recommended({k: S.SCENARIOS[k] for k in ("q7", "q8", "q9")}, "SELECT qid, id, score, CAST(rank AS INTEGER) AS rank FROM found WHERE bucket = 'alternate'"),
        "recommendation_cards": recommended(
            {k: S.SCENARIOS[k] for k in ("q3", "q4")},
            """SELECT id, coalesce(nullif(creator, ''), nullif(studio, ''), 'Автор не указан') || ' · ' || age_label AS meta, array_to_string(list_concat(interests, genres)[1:3], ', ') AS tags,
               array_to_string(reasons[1:2], '; ') AS reasons, array_to_string(missed[1:1], '; ') AS missed FROM found""",
        ),
        "wizard_query": f"WITH {wizard_rows(CUSTOMER_ANSWERS)} SELECT qid, q_age AS age, q_format AS format, array_to_string(q_interests, '|') AS interests, array_to_string(q_moods, '|') AS moods, q_situation AS situation, q_duration AS duration FROM wq",
        "wizard_results": with_items(
            "SELECT qid, bucket, id, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY bo, rank) AS place FROM found) WHERE place <= 6",
            f"{wizard_rows()}, {evaluated('wq')}, {RELAXED}",
        ),
        "wizard_explanation": f"""WITH {wizard_rows(CUSTOMER_ANSWERS)} SELECT qid, 'Сейчас лучше выбрать ' || (CASE feeling WHEN 'anxious' THEN 'спокойный и уютный' WHEN 'laugh' THEN 'смешной' WHEN 'learn' THEN 'познавательный' ELSE 'подходящий по настроению' END) || ' '
               || (CASE format WHEN 'reading' THEN 'историю для чтения' WHEN 'cartoon' THEN 'мультфильм' WHEN 'movie' THEN 'фильм' ELSE 'книгу, мультфильм или фильм' END) || ' '
               || (CASE interaction WHEN 'self' THEN 'для самостоятельного знакомства' ELSE 'для совместного времени' END) || '. ' || {s(V.WIZARD_NOTE)} AS sentence FROM answers""",
        "home_picks": with_items("SELECT id, app_type FROM (SELECT *, row_number() OVER (PARTITION BY app_type ORDER BY ord) - 1 AS spot FROM item) WHERE spot = CASE app_type WHEN 'book' THEN 10 WHEN 'cartoon' THEN 0 ELSE 4 END"),
        "slug_lookup": with_items("SELECT id, slug FROM item WHERE app_type = 'cartoon' AND slug = (SELECT min(slug) FROM item WHERE app_type = 'cartoon') ORDER BY ord LIMIT 1"),
        "collection_expand": with_items(
            "SELECT cid AS collection_id, CAST(pos AS INTEGER) AS pos, id, 'соответствует темам «' || array_to_string(interests[1:2], '» и «') || '» и возрастной рекомендации ' || age_label AS why FROM listed JOIN item USING (id)", COLLECTIONS
        ),
        "collection_orphans": with_items("SELECT cid AS collection_id, id FROM listed WHERE id NOT IN (SELECT id FROM item)", COLLECTIONS),
        "similar_theme": with_items(
            "SELECT source_id, CAST(rank AS INTEGER) AS rank, id FROM (SELECT a.id AS source_id, b.id, row_number() OVER (PARTITION BY a.id ORDER BY b.ord) AS rank FROM item a JOIN item b ON a.app_type = b.app_type AND a.id <> b.id AND list_has_any(a.interests, b.interests)) WHERE rank <= 3"
        ),
        "similar_scored": with_items(
            """SELECT source_id, CAST(rank AS INTEGER) AS rank, id, score FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY score DESC, ord) AS rank FROM (
              SELECT a.id AS source_id, b.id, b.ord, greatest(0.0::DOUBLE, 5 - abs((b.age_min + b.age_max) / 2 - (a.age_min + a.age_max) / 2))
                + 3 * len(list_filter(b.interests, lambda x: list_contains(a.interests, x))) + 2 * len(list_filter(b.moods, lambda x: list_contains(a.moods, x))) + 2 * len(list_filter(b.genres, lambda x: list_contains(a.genres, x))) AS score
              FROM (SELECT * FROM item WHERE id IN (SELECT id FROM listed)) a JOIN item b ON a.id <> b.id)) WHERE rank <= 3""",
            COLLECTIONS,
        ),
        "favorites_parity": f"WITH {CLICKS} SELECT user_id, item, CAST(row_number() OVER (PARTITION BY user_id ORDER BY max(seq)) AS INTEGER) AS place FROM clicks GROUP BY user_id, item HAVING count(*) % 2 = 1",
        "favorites_view": with_items("SELECT id, title FROM item WHERE ord IN (SELECT item FROM clicks GROUP BY user_id, item HAVING count(*) % 2 = 1)", CLICKS),
        "debounced_events": "SELECT event_id, user_id FROM (SELECT *, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nx FROM events) WHERE nx IS NULL OR epoch_us(nx) - epoch_us(ts) >= 250000",
    }
    out["recommend_diverse"] = recommended(
        S.SCENARIOS,
        f"""SELECT qid, bucket, id, CAST(place AS INTEGER) AS place, points FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY bo, turn, points DESC, len(missed), title, ord) AS place FROM (
          SELECT *, CASE WHEN q_format = 'all' THEN row_number() OVER (PARTITION BY qid, bo, app_type ORDER BY points DESC, len(missed), title, ord) ELSE 0 END AS turn FROM (
            SELECT *, round(score + {S.DIVERSE_MIDDLE} * coalesce(greatest(0.0, 1 - abs(q_age - (age_min + age_max) / 2) / ((age_max - age_min) / 2 + 1)), 0.0) + {S.DIVERSE_SEVERAL} * greatest(0, len(reasons) - 1), 6) AS points FROM found))) WHERE place <= {S.DIVERSE_LIMIT}""",
    )
    out["favorites_log"] = out["favorites_parity"]
    out["json_file_catalog"] = with_items("SELECT ord, id, slug, title, content_type, age_min, age_max, year, array_to_string(interests, '|') AS interests, 'a \"quoted } text\" [,\\' || title AS note FROM item")
    ok = {
        "age": "(q_age IS NULL OR q_age BETWEEN i.age_min AND i.age_max)",
        "format": "(q_format = 'all' OR q_format = i.content_type)",
        "situation": "(q_situation IS NULL OR i.bedtime)",
        "interests": "list_has_all(i.interests, q_interests)",
        "moods": "list_has_all(i.moods, q_moods)",
        "duration": "(q_duration IS NULL OR i.duration_category IS NOT DISTINCT FROM q_duration)",
        "search": f"(q_search = '' OR {matches(norm('q_search'), 'q_search')})",
    }
    given = ["q_age IS NOT NULL", "q_format <> 'all'", "q_situation IS NOT NULL", "len(q_interests) > 0", "len(q_moods) > 0", "q_duration IS NOT NULL", "q_search <> ''"]
    gone = lambda k: f"(r >> {k}) & 1 = 1"
    out["relaxing_filters"] = with_items(
        f"""SELECT qid, array_to_string(list_filter([{', '.join(f"CASE WHEN {gone(k)} THEN '{name}' END" for k, name in enumerate(ok))}], lambda x: x IS NOT NULL), ',') AS filters, n
          FROM (SELECT *, min(bit_count(r)) OVER (PARTITION BY qid) AS least FROM sums) WHERE bit_count(r) = least""",
        f"""q AS (SELECT id AS qid, age_max + 1.0 + ord % 3 AS q_age, CASE WHEN ord % 4 = 0 THEN 'all' WHEN content_type = 'movie' THEN 'cartoon' ELSE 'movie' END AS q_format,
            list_concat(interests[1:2], CASE WHEN ord % 3 = 0 THEN ['роботы'] ELSE [] END) AS q_interests, moods AS q_moods, CASE WHEN ord % 100 = 0 THEN 'bedtime' END AS q_situation,
            CASE WHEN ord % 7 > 2 THEN duration_category END AS q_duration, CASE WHEN ord % 8 = 0 THEN split_part(title, ' ', 1) ELSE '' END AS q_search FROM item WHERE ord % 50 = 0),
          flags AS (SELECT qid, {', '.join(f"{x} AS ok{k}" for k, x in enumerate(ok.values()))}, {', '.join(f"{x} AS on{k}" for k, x in enumerate(given))} FROM q, item i),
          sums AS (SELECT qid, r, count(*) AS n FROM flags, range(128) t(r) WHERE {' AND '.join(f"(ok{k} OR {gone(k)}) AND (on{k} OR NOT {gone(k)})" for k in range(len(ok)))} GROUP BY qid, r)""",
    )
    toggled = lambda c: f"CASE WHEN facet <> '{c}' THEN q.{c} WHEN list_contains(q.{c}, value) THEN list_filter(q.{c}, lambda y: y <> value) ELSE list_append(q.{c}, value) END"
    out["facet_counts_index"] = with_items(
        f"""SELECT qid, facet, value, count(*) FILTER (WHERE i.id IS NOT NULL) AS n, bool_or(selected) AS selected, count(*) FILTER (WHERE i.id IS NOT NULL) = 0 AND NOT bool_or(selected) AS unavailable
        FROM t LEFT JOIN item i ON (t.age IS NULL OR t.age BETWEEN i.age_min AND i.age_max)
          AND (f = 'all' OR i.content_type = f OR (f = 'reading' AND i.content_type IN ('book', 'fairy-tale')))
          AND (s IS NULL OR (s = 'bedtime' AND i.bedtime) OR (s = 'family' AND i.family) OR (s = 'independent' AND i.independent))
          AND (du IS NULL OR i.duration_category = du) AND list_has_all(i.interests, ti) AND list_has_all(i.moods, tm) GROUP BY qid, facet, value""",
        f"""q AS (SELECT id AS qid, CASE WHEN ord % 4 > 0 THEN age_min + CASE WHEN ord % 3 = 0 THEN 0.5 ELSE 1 END END AS age,
            CASE WHEN ord % 5 = 0 THEN 'all' WHEN content_type IN ('cartoon', 'movie') THEN content_type ELSE 'reading' END AS format, interests[1:ord % 3] AS interests, moods[1:ord // 50 % 2] AS moods,
            CASE ord % 7 WHEN 0 THEN 'bedtime' WHEN 1 THEN 'family' END AS situation, CASE WHEN ord % 9 = 0 THEN duration_category END AS duration FROM item WHERE ord % 50 = 0),
          val AS (SELECT 'format' AS facet, unnest(['all', 'reading', 'cartoon', 'movie']) AS value UNION ALL SELECT 'situation', unnest(['bedtime', 'family', 'independent']) UNION ALL
            SELECT DISTINCT 'duration', duration_category FROM item WHERE duration_category <> '' UNION ALL SELECT DISTINCT 'interests', unnest(interests) FROM item UNION ALL SELECT DISTINCT 'moods', unnest(moods) FROM item),
          t AS (SELECT qid, facet, value, age, CASE facet WHEN 'format' THEN value ELSE format END AS f, CASE facet WHEN 'situation' THEN value ELSE situation END AS s,
            CASE facet WHEN 'duration' THEN value ELSE duration END AS du, {toggled("interests")} AS ti, {toggled("moods")} AS tm,
            CASE facet WHEN 'format' THEN value = format WHEN 'situation' THEN coalesce(value = situation, false) WHEN 'duration' THEN coalesce(value = duration, false) WHEN 'interests' THEN list_contains(q.interests, value) ELSE list_contains(q.moods, value) END AS selected FROM q, val)""",
    )
    row_queries = """q AS (SELECT id AS qid, CASE WHEN ord % 4 > 0 THEN age_min + CASE WHEN ord % 3 = 0 THEN 0.5 ELSE 1 END END::DOUBLE AS q_age,
            CASE WHEN ord % 5 = 0 THEN 'all' WHEN content_type IN ('cartoon', 'movie') THEN content_type ELSE 'reading' END AS q_format, interests[1:ord % 3] AS q_interests, moods[1:ord // 50 % 2] AS q_moods,
            CASE ord % 7 WHEN 0 THEN 'bedtime' WHEN 1 THEN 'family' END AS q_situation, CASE WHEN ord % 9 = 0 THEN duration_category END AS q_duration, '' AS q_search FROM item WHERE ord % 50 = 0)"""
    out["recommend_many"] = with_items(f"SELECT {SHOWN}, {NO_EXACT_RANK} FROM found", f"{row_queries}, {evaluated()}, {RELAXED}")
    out["similar_scored_all"] = out["similar_scored"].replace("(SELECT * FROM item WHERE id IN (SELECT id FROM listed)) a", "item a")
    out["favorites_stream"] = out["favorites_parity"]
    out["debounced_stream"] = out["debounced_events"].replace("250000", str(S.STREAM_QUIET_MS * 1000))
    out |= codecs()
    fq = S.FACET_QUERY
    toggle = lambda c, v: f"CASE WHEN list_contains({c}, {v}) THEN list_filter({c}, lambda y: y <> {v}) ELSE list_append({c}, {v}) END"
    fixed = ", ".join([f"('format', {s(f)})" for f in V.FORMATS] + [f"('situation', {s(f)})" for f in V.SITUATION_LABELS])
    out["facet_counts"] = with_items(
        f"""SELECT facet, value, coalesce(n, 0) AS n, selected, coalesce(n, 0) = 0 AND NOT selected AS unavailable FROM (
          SELECT fv.*, c.n, CASE facet WHEN 'format' THEN value = '{fq.format}' WHEN 'situation' THEN false WHEN 'duration' THEN false WHEN 'interests' THEN list_contains({arr(fq.interests)}, value) ELSE false END AS selected
          FROM fv LEFT JOIN (SELECT qid, count(*) AS n FROM ev WHERE len(missed) = 0 GROUP BY qid) c ON c.qid = facet || '|' || value)""",
        f"""fv AS (SELECT * FROM (VALUES {fixed}) t(facet, value) UNION ALL SELECT DISTINCT 'interests', unnest(interests) FROM item UNION ALL SELECT DISTINCT 'moods', unnest(moods) FROM item
            UNION ALL SELECT DISTINCT 'duration', duration_category FROM item WHERE duration_category <> ''),
        q AS (SELECT facet || '|' || value AS qid, {float(fq.age)}::DOUBLE AS q_age, CASE WHEN facet = 'format' THEN value ELSE '{fq.format}' END AS q_format,
          CASE WHEN facet = 'interests' THEN {toggle(arr(fq.interests), 'value')} ELSE {arr(fq.interests)} END AS q_interests, CASE WHEN facet = 'moods' THEN {toggle(arr(fq.moods), 'value')} ELSE {arr(fq.moods)} END AS q_moods,
          CASE WHEN facet = 'situation' THEN value END AS q_situation, CASE WHEN facet = 'duration' THEN value END AS q_duration, '' AS q_search FROM fv), {evaluated()}""",
    )
    for name, phrase in S.SEARCHES.items():
        out[name] = with_items(f"SELECT id, title FROM item WHERE {matches(norm(s(phrase)), s(phrase))}")
    out["search_direct_index"], out["section_haystack_index"] = out["search_direct"], out["section_haystack"]
    return out
