"""Labels, scales, weights and trigger patterns that results depend on."""

# Labels of content types.
TYPE_LABELS = {"fairy-tale": "Сказка", "book": "Книга", "cartoon": "Мультфильм", "movie": "Фильм"}
# Labels of the format filter.
FORMAT_LABELS = {"all": "Всё", "reading": "Книги и сказки", "cartoon": "Мультфильмы", "movie": "Фильмы"}
# Labels of situations; also a reason's text.
SITUATION_LABELS = {"bedtime": "Перед сном", "family": "Всей семьёй", "independent": "Самостоятельно"}
# Duration scales, short to long.
WATCH_DURATIONS = ["до 15 минут", "до 30 минут", "до 60 минут", "до 90 минут", "больше 90 минут"]
READ_DURATIONS = ["короткая история", "на один вечер", "на несколько вечеров", "длинная книга"]
# Paths of the sections, and the singular and plural names of their contents.
SECTION_PATHS = {"book": "books", "cartoon": "cartoons", "movie": "movies"}
SECTION_TITLES = {"book": "Книги", "cartoon": "Мультфильмы", "movie": "Фильмы"}
PLURALS = {"book": "книги", "cartoon": "мультфильмы", "movie": "фильмы"}
# Themes that make a cartoon educational.
EDUCATIONAL = ["наука", "история", "природа", "техника", "космос"]
CALM_MOODS = ["спокойное", "уютное"]
FUNNY, THRILLING = "смешное", "захватывающее"
# Scores.
AGE_SCORE, FORMAT_SCORE, SITUATION_SCORE = 100, 40, 25
INTEREST_SCORE, MOOD_SCORE = 14, 7
DURATION_SCORE, NEAR_DURATION_SCORE, SEARCH_SCORE = 16, 7, 24
# Result sizes.
PARTIAL_LIMIT, ENOUGH_EXACT, ALTERNATE_LIMIT = 6, 3, 4
SIMILAR_LIMIT, NEAR_LIMIT, WIZARD_LIMIT, QUICK_INTERESTS = 3, 6, 6, 8
# Positions that the home page shows.
HOME_PICKS = {"book": 10, "cartoon": 0, "movie": 4}
# What a search phrase may ask for, as patterns over the normalised phrase.
INTENTS = {
    "read": "почитать|читать|чтение|книг|сказк",
    "watch": "посмотреть|мульт|фильм|кино",
    "bedtime": "перед сном|на ночь|заснуть|засып",
    "family": "всей семь|семейный вечер|с родителями",
    "independent": "самостоятельно|самому|сама",
    "calm": "тревож|волнуе|успок|боится|страшно",
}
AGE_PHRASE = r"(\d{1,2})WHITE*(?:лет|год|года)"
# A rating text that is not confirmed.
UNCONFIRMED = "требует|зависит|уточн|сверк"
# The wizard's answers.
FEELING_MOODS = {
    "rest": ["спокойное"],
    "anxious": ["спокойное", "уютное"],
    "sad": ["трогательное", "уютное"],
    "bored": ["захватывающее"],
    "angry": ["спокойное"],
    "changes": ["трогательное"],
    "laugh": ["смешное"],
}
TIME_DURATIONS = {"short": "до 15 минут", "medium": "до 30 минут", "hour": "до 60 минут"}
LEARN_INTEREST = "наука"
WIZARD_AGE = 7
# Query ages that a URL may carry.
QUERY_AGES = (1, 17)
# JavaScript's white space, as a regex class that Java and RE2 share.
WHITE = r"[\x{9}-\x{d} \x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"
# The wizard's closing sentence.
WIZARD_NOTE = "Мы сохранили возрастную рекомендацию и сначала искали точные совпадения, а затем — ближайшие варианты."
