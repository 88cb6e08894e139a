"""Inputs that the registered queries share."""

from shelfspark.operators.recommend import Query

SCENARIOS = {
    "q1": Query(),
    "q2": Query(6, "cartoon", ("дружба",), (), "family"),
    "q3": Query(7, "all", (), ("спокойное", "уютное"), "family", "до 15 минут"),
    "q4": Query(6, "cartoon", ("red", "ring"), ("спокойное",), "family", "до 30 минут"),
    "q5": Query(6, "cartoon", ("роботы",)),
    "q6": Query(2, "movie", (), (), "independent"),
    "q7": Query(17, "movie", ("red",), (), None, "до 15 минут"),
    "q8": Query(6, "movie", (), (), None, "короткая история"),
    "q9": Query(1, "movie"),
    "q10": Query(6.5, "reading", ("космос", "космос"), ("смешное",), "bedtime", "на один вечер"),
    "q11": Query(None, "reading", (), (), None, None, "Почитать перед сном"),
    "q12": Query(8, "all", (), (), None, None, "  "),
    "q13": Query(9, "movie", ("история",), (), "family", "до 60 минут", "кино про историю"),
}
SEARCHES = {
    "search_direct": "Brand#2",
    "search_intent_bedtime_reading": "почитать на ночь",
    "search_intent_anxious": "ребёнок боится",
    "search_intent_age": "что-нибудь для 112 лет",
    "search_intent_contradiction": "почитать и посмотреть",
}
HAYSTACK = "  STORY  about r"
FACET_QUERY = Query(6, "all", ("дружба",), (), None, None)
ANSWERS = [
    ("a1", 7, "all", "", "", "", ""),
    ("a2", 5, "reading", "anxious", "дружба", "short", "adult"),
    ("a3", 9, "cartoon", "learn", "животные", "medium", "self"),
    ("a4", 12, "movie", "laugh", "", "hour", "family"),
    ("a5", 3, "cartoon", "sad", "школа", "long", "family"),
    ("a6", None, None, None, None, None, None),
]
ANSWER_COLUMNS = ("qid", "age", "format", "feeling", "interest", "time", "interaction")
# How late a replayed event may be (a third of the events' month), and the quiet time of the streamed debounce.
STREAM_DELAY = "10 days"
STREAM_QUIET_MS = 3_600_000
# Results, and points for the middle age and for each further reason, of the diverse recommendation.
DIVERSE_LIMIT, DIVERSE_MIDDLE, DIVERSE_SEVERAL = 12, 6.0, 2.0
