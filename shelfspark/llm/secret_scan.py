"""Secret scans: fixed patterns, and strings that a primed compressor can't predict.

The patterns give the base spans. Beside them, every candidate (a run of 16 or
more of `[A-Za-z0-9+/_=.-]` in which digits and letters mix, or capitals and small letters change places all
the time, after a leading `name=`, that is no host name; or 12 to 64 printable characters between quotes, of three kinds at least) within AROUND characters of a sensitive word is
priced: zstandard, primed with a dictionary of identifiers, reads the
candidate's surroundings and then, as a block of its own, the candidate. The
block's bytes are what the candidate adds. Its novelty is their share of what a
random string of the same length and alphabet adds there: 1 where neither
dictionary nor surroundings help, less where they do. A candidate that reaches
the threshold is reported with kind `novel`, unless a base span overlaps it.
Copies of the candidate in its surroundings are blanked out before, unless a span
that is already reported holds them: a string that repeats is reported once at
least, and a copy near a reported one is not reported again.

Dictionary and threshold come from the corpus: identifiers (words joined by `_`
or by capitals, or before `=`, `:` or `(`) and plain words are counted over all documents; the
WORDS most frequent identifiers of those in MIN_DOCS documents or more, and the WORDS most frequent plain words, are the bounded sample
that is kept. A half of them, by hash, goes to the dictionary, after a few words
that are known beforehand. The other half is priced against it, as identifiers and as compounds of three words and a digit,
which is what an ordinary candidate looks like that the dictionary does not know: the threshold is
the QUANTILE of those prices, so that 5 % of such strings reach it (PRIOR strings at PRIOR_NOVELTY count
besides), but never more than random keys of each kind reach, save a share of LOST. Strings of letters alone must be as dear as random ones (LETTERS).

Defined results: null or empty text has no spans; offsets count code points,
ends are exclusive; each row stands alone, so repeated rows repeat their spans; a
null identifier stays null; a corpus without identifiers has the known words and
the prior; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import random
import re
import string
from bisect import bisect_left, bisect_right
from collections import Counter

import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ASSIGN = re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
KINDS = ("assign", "access", "hex", "novel")
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_.=-])(?:[A-Za-z_]+=)?([A-Za-z0-9+/_.=-]{16,})")
QUOTED = re.compile(r"""(?<=["'`])[!-~]{12,64}(?=["'`])""")
KINDS_OF = tuple(map(re.compile, ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]")))
SWITCH = re.compile(r"(?=[a-z][A-Z]|[A-Z][a-z])")
HOST = re.compile(r"(?:[a-z0-9-]+\.)+[a-z]{2,}")
WORD = re.compile(r"(?<![A-Za-z])[a-z]{4,24}(?![A-Za-z])")
SENSITIVE = re.compile(r"(?ai:passw|secret|token|api.?key|auth(?!or)|credential|bearer|private|signature|access)")
#: Identifiers: words joined by underscores, by capitals, or before a sign of assignment or call (looked for from the sign backwards).
JOINED = re.compile(r"[A-Za-z][A-Za-z0-9]{0,40}(?:_[A-Za-z0-9]{1,40})+")
CAMEL = re.compile(r"\b[a-z]{2,40}(?:[A-Z][a-z]{1,40})+\b")
HUMP, SIGN = re.compile(r"[a-z][A-Z]"), re.compile(r"[=:(]")
BEFORE = re.compile(r"""(?<![A-Za-z0-9_])([A-Za-z][A-Za-z0-9]{2,40})["']?\x20?\Z""")
#: Characters before and after a candidate that count as its surroundings.
AROUND = 160
WORDS, MIN_DOCS = 2000, 3
QUANTILE, PRIOR, PRIOR_NOVELTY = 0.95, 100, 0.88
#: The part of random keys of each of KEY_KINDS kinds that the threshold may lose.
LOST, KEY_KINDS = 0.02, 4
BASE64 = string.ascii_letters + string.digits + "+/"
#: Changes between capitals and small letters, as a share of the characters, from which letters alone are a candidate. Names joined by capitals have fewer.
SWITCHES = 0.38
#: Price of a string of letters alone from which it is reported.
LETTERS = 0.97
LEVEL = 19
_PART = re.compile(r"[A-Z]?[a-z]{2,}|[A-Z]{2,}")
#: Identifiers and words that code and configuration repeat, known beforehand.
IDENTIFIERS = (
    "access_key access_token account api_key apikey application argument authorization base64 bearer boolean bucket "
    "cache callback certificate class client_id client_secret config connection const content-type cookie credentials "
    "database default define description document encoding endpoint environment error example exception export false "
    "filename float function handler hash header hostname http https import index input integer interface json key "
    "length license localhost login message method module name namespace null object option output package parameter "
    "password path port private process property protocol public query region request response return secret select "
    "self server service session settings signature static status string struct system table template test text "
    "timeout timestamp token true type undefined update url user username utf-8 value variable version void while"
)


def dictionary(words: list[str]) -> bytes:
    """The identifiers, and the known words and the identifiers' parts between each of the usual separators, so that a word matches with what joins it."""
    parts = dict.fromkeys(x for w in [*IDENTIFIERS.split(), *words] for x in _PART.findall(w))
    return "\n".join([" ".join(words), *(s.join(["", *parts, ""]) for s in " /.-_")]).encode()


class Novelty:
    """Prices strings in their surroundings, against a dictionary of identifiers."""

    def __init__(self, words: list[str] = (), limit: float = PRIOR_NOVELTY):
        primer = zstandard.ZstdCompressionDict(dictionary(words), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        primer.precompute_compress(level=LEVEL)
        self.compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=primer, write_content_size=False, write_dict_id=False, write_checksum=False)
        self.limit = limit

    def added(self, near: bytes, text: str) -> int:
        """Bytes of a block that holds text, after its surroundings; its header left out."""
        out = self.compressor.compressobj()
        out.compress(near)
        out.flush(zstandard.COMPRESSOBJ_FLUSH_BLOCK)
        out.compress(text.encode("utf-8", "surrogatepass"))
        return len(out.flush(zstandard.COMPRESSOBJ_FLUSH_BLOCK)) - 3

    def novelty(self, before: str, text: str, after: str) -> float:
        """Bytes that text adds, as a share of what a random string of its length and alphabet adds. Capitals count as a way of joining words: the lower price of text and of its lower case holds."""
        near = f"{before}\n{after}\n".encode("utf-8", "surrogatepass")
        most = sum(self.added(near, like) for like in random_likes(text)) / DRAWS
        least = self.added(near, text)
        if text != text.lower():
            least = min(least, self.added(near, text.lower()))
        return least / max(1.0, most)


#: Random strings that a candidate is compared with.
DRAWS = 3


def random_likes(text: str) -> list[str]:
    """DRAWS strings of the same length over the same characters, drawn by a seed from the text."""
    rng = random.Random(xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")))
    return ["".join(rng.choices(sorted(set(text)), k=len(text))) for _ in range(DRAWS)]


def limit_of(prices: list[float]) -> float:
    """The threshold: the quantile of prices, leaning on the prior where they are few."""
    if not prices:
        return PRIOR_NOVELTY
    at = sorted(prices)[min(len(prices) - 1, int(QUANTILE * len(prices)))]
    return min(1.0, (len(prices) * at + PRIOR * PRIOR_NOVELTY) / (len(prices) + PRIOR))


def compounds(words: list[str]) -> list[str]:
    """Ordinary strings of three words each and a digit, with the usual separators."""
    return [f"{a}{'-_./'[k % 4]}{b}{'-_./'[k % 4]}{c}{k % 10}" for k, (a, b, c) in enumerate(zip(words[::3], words[1::3], words[2::3]))]


def random_keys(n: int = 200, seed: int = 5) -> list[str]:
    """Keys as they are issued: letters and digits, hexadecimal, base64, and tokens of three parts."""
    rng = random.Random(seed)
    some = lambda alphabet, k: "".join(rng.choices(alphabet, k=k))
    token = lambda: ".".join([base64.b64encode(b'{"alg":"HS256","typ":"JWT"}').decode().rstrip("="), some(BASE64, 40), some(BASE64, 43)])
    kinds = (lambda: some(BASE64[:62], rng.randint(16, 40)), lambda: some("0123456789ABCDEF", rng.choice([32, 40, 64])), lambda: some(BASE64, rng.randint(20, 64)), token)
    return [kinds[k % KEY_KINDS]() for k in range(n)]


def learn(words: list[str], plain: list[str] = ()) -> tuple[list[str], float]:
    """From identifiers and plain words the words of the dictionary and the threshold."""
    odd = lambda w: xxhash.xxh3_64_intdigest(w.encode()) & 1
    known = [w for w in [*words, *plain] if odd(w)]
    held = [w for w in words if not odd(w) and len(w) >= 8] + compounds([w for w in plain if not odd(w)])
    price = Novelty(known).novelty
    keys = [price("", w, "") for w in random_keys()]
    of_kind = [sorted(keys[k::KEY_KINDS]) for k in range(KEY_KINDS)]
    return known, min(limit_of([price("", w, "") for w in held]), *(x[int(LOST * len(x))] for x in of_kind))


def _worded(batches):
    for batch in batches:
        times: Counter[str] = Counter()
        for x in batch.column("text"):
            times.update(WORD.findall(x.as_py() or ""))
        yield pa.RecordBatch.from_arrays([pa.array(list(times), pa.string()), pa.array(list(times.values()), pa.int64())], names=["word", "n"])


def frequent_words(rows: DataFrame) -> list[str]:
    """The most frequent plain words of all documents, by number of times, then by spelling: WORDS at most, each MIN_DOCS times at least."""
    counted = rows.select("text").mapInArrow(_worded, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    return [r.word for r in counted.filter(F.col("n") >= MIN_DOCS).orderBy(F.desc("n"), "word").limit(WORDS).collect()]


def identifiers_of(text: str) -> set[str]:
    found = set(JOINED.findall(text)) if "_" in text else set()
    if HUMP.search(text):
        found.update(CAMEL.findall(text))
    for sign in SIGN.finditer(text):
        m = BEFORE.search(text, max(0, sign.start() - 44), sign.start())
        if m:
            found.add(m[1])
    # What looks like a key itself must not teach the dictionary.
    return {w for w in found if sum(map(str.isdigit, w)) < 4}


def _identified(batches):
    for batch in batches:
        times: dict[str, int] = {}
        for x in batch.column("text"):
            for word in identifiers_of(x.as_py() or ""):
                times[word] = times.get(word, 0) + 1
        yield pa.RecordBatch.from_arrays([pa.array(list(times), pa.string()), pa.array(list(times.values()), pa.int64())], names=["word", "n"])


def identifiers(rows: DataFrame) -> list[str]:
    """The most frequent identifiers of all documents, by number of documents, then by spelling: WORDS at most."""
    counted = rows.select("text").mapInArrow(_identified, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    return [r.word for r in counted.filter(F.col("n") >= MIN_DOCS).orderBy(F.desc("n"), "word").limit(WORDS).collect()]


class Covered:
    """Disjoint spans, to ask whether one overlaps another."""

    def __init__(self, spans: list[tuple[int, int, int]]):
        self.starts, self.ends = [], []
        for start, _, end in sorted(spans):
            if self.ends and start < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], end)
            else:
                self.starts.append(start)
                self.ends.append(end)

    def overlaps(self, start: int, end: int) -> bool:
        k = bisect_right(self.ends, start)
        return k < len(self.starts) and self.starts[k] < end

    def add(self, start: int, end: int) -> None:
        k = bisect_left(self.starts, start)
        self.starts.insert(k, start)
        self.ends.insert(k, end)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end), by start, then kind."""
    spans = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 12]
    if "AKIA" in text:
        spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    spans += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(spans)


def surroundings(text: str, start: int, end: int, reported: Covered) -> tuple[str, str]:
    """AROUND characters before and after, with copies of the string blanked that no reported span overlaps."""
    word, low = text[start:end], max(0, start - AROUND)
    sides = [text[low:start], text[end : end + AROUND]]
    # A copy may be cut by the window's edge.
    for side, (a, b, at) in enumerate(((max(0, low - len(word)), start, low), (end, end + AROUND + len(word), end))):
        found = text.find(word, a, b)
        while found >= 0:
            stop = found + len(word)
            if not reported.overlaps(found, stop):
                x, y = max(0, found - at), min(stop - at, len(sides[side]))
                if x < y:
                    sides[side] = sides[side][:x] + " " * (y - x) + sides[side][y:]
            found = text.find(word, stop, b)
    return sides[0], sides[1]


def candidates(text: str):
    """(start, end) and whether it is of letters alone, of all strings that may be secrets, by their start."""
    found = []
    for m in CANDIDATE.finditer(text):
        word = m[1]
        letters = any(c.isalpha() for c in word)
        if HOST.fullmatch(word) or not letters:
            continue
        if any(c.isdigit() for c in word):
            found.append((m.start(1), m.end(1), False))
        elif len(SWITCH.findall(word)) >= SWITCHES * len(word):
            found.append((m.start(1), m.end(1), True))
    for m in QUOTED.finditer(text):
        if sum(kind.search(m[0]) is not None for kind in KINDS_OF) >= 3 and not CANDIDATE.fullmatch(m[0]):
            found.append((m.start(), m.end(), False))
    return sorted(found, key=lambda x: (x[0], -x[1]))


def novel_spans(text: str, base: list[tuple[int, int, int]], price: Novelty) -> list[tuple[int, int, int]]:
    out, covered = [], Covered(base)
    if not SENSITIVE.search(text):
        return out
    for start, end, letters in candidates(text):
        if covered.overlaps(start, end):
            continue
        if not SENSITIVE.search(text[max(0, start - AROUND) : end + AROUND]):
            continue
        before, after = surroundings(text, start, end, covered)
        if price.novelty(before, text[start:end], after) >= (max(price.limit, LETTERS) if letters else price.limit):
            out.append((start, 3, end))
            covered.add(start, end)
    return out


def _spell(spans) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def scan_text(text: str, price: Novelty) -> tuple[int, int, int, str, str, int]:
    base = base_spans(text)
    every = sorted(base + novel_spans(text, base, price))
    kinds = [k for _, k, _ in base]
    digest = hashlib.sha256(_spell(base).encode()).hexdigest()
    return kinds.count(0), kinds.count(1), kinds.count(2), digest, _spell(every), len(every) - len(base)


def secret_scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_novel."""
    rows = docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), docs["text"].cast("string").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(learn(identifiers(rows), frequent_words(rows)))

    def run(batches):
        price = Novelty(*shared.value)
        for batch in batches:
            found = [scan_text(x.as_py() or "", price) for x in batch.column("text")]
            types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *[pa.array([r[i] for r in found], t) for i, t in enumerate(types)]],
                names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_novel"],
            )

    return rows.mapInArrow(run, "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string, n_novel bigint")
