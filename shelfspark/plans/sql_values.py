"""The SQL's own fixed values, stated apart from those of the DataFrame forms, so that a wrong value there shows."""

# Labels, scales and trigger patterns that results depend on.

# Labels of content types and situations, and the paths of sections.
TYPE_LABELS = {"fairy-tale": "Сказка", "book": "Книга", "cartoon": "Мультфильм", "movie": "Фильм"}
SITUATION_LABELS = {"bedtime": "Перед сном", "family": "Всей семьёй", "independent": "Самостоятельно"}
FORMATS = ["all", "reading", "cartoon", "movie"]
SECTION_PATHS = {"book": "books", "cartoon": "cartoons", "movie": "movies"}
# Duration scales, short to long.
WATCH_DURATIONS = ["до 15 минут", "до 30 минут", "до 60 минут", "до 90 минут", "больше 90 минут"]
READ_DURATIONS = ["короткая история", "на один вечер", "на несколько вечеров", "длинная книга"]
# Themes that make a cartoon educational, and calm moods.
EDUCATIONAL = ["наука", "история", "природа", "техника", "космос"]
CALM_MOODS = ["спокойное", "уютное"]
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
# The wizard's answers and its closing sentence.
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
WIZARD_NOTE = "Мы сохранили возрастную рекомендацию и сначала искали точные совпадения, а затем — ближайшие варианты."
# JavaScript's white space, as a regex class.
WHITE = r"[\x{9}-\x{d} \x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"
