"""BPE encoding and decoding as streaming transducers with bounded lookahead.

A merge at rank r can only change, to the left of where it acts, a merge of a
later rank whose right part begins with its left part; so what text to come can
still change reaches back at most the longest chain of such merges. lookahead()
computes a sufficient reach from the merge list (an upper bound; some thousand
symbols for a list of 49,000 merges). A run of symbols is then encoded block by
block: tokens that end before the last `lookahead` symbols are final and are
emitted, the rest waits for more input. Every word goes this way, whatever its
length; words of up to PIECE code points are remembered.

Texts go through in windows of about CHUNK code points, cut before a blank, or
where there is none before a code point that normalisation can't join to what
stands before it. A word longer than a window feeds its symbols to the transducer
window by window. So beside the text itself a worker holds some windows, a
transducer's rest and what it remembers, however long a text or a word is.

Decoding maps each id to its string's bytes and feeds them through an
incremental UTF-8 state machine that holds at most three bytes.

Ids are little-endian on every platform that Spark runs on here; array("I") is
checked to be 32 bits wide.

Defined results: null text counts as empty: no tokens, the digests of nothing; a
null identifier stays null; each row stands alone, so ties and repeated rows
repeat their results; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import json
import re
import unicodedata
from array import array
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from tokenizers import Regex, normalizers, pre_tokenizers

from .common import tokenizer_file

assert array("I").itemsize == 4

#: White space as the tokenizer's normaliser takes it (Unicode's White_Space).
WHITE = "[\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]+"
#: Code points of a text that are encoded at a time, up to the next blank.
CHUNK = 1 << 16
#: Blank-free pieces up to this length are encoded once and remembered.
PIECE = 64
#: Pieces, and words, that are remembered since the last turn; those of the turn before stay beside them.
REMEMBERED = 250_000
#: Ids of a block that a long stretch gives out.
BLOCK_IDS = 1 << 14


def _ranges(points: list[int]) -> str:
    """The inside of a regex class that holds the code points, given in order."""
    out, at = [], 0
    while at < len(points):
        end = at
        while end + 1 < len(points) and points[end + 1] == points[end] + 1:
            end += 1
        out.append(f"\\U{points[at]:08x}-\\U{points[end]:08x}")
        at = end + 1
    return "".join(out)


def unicode_classes() -> tuple[str, str, dict[int, str]]:
    """Letters and numbers as insides of regex classes, and lower-case forms that Python doesn't know.

    Python's tables say what an assigned code point is. The tokenizers library
    may follow a later Unicode version; for code points that Python holds for
    unassigned its own tables are asked.
    """
    is_letter = pre_tokenizers.Split(Regex(r"\p{L}"), "removed").pre_tokenize_str
    is_number = pre_tokenizers.Split(Regex(r"\p{N}"), "removed").pre_tokenize_str
    lower = normalizers.Lowercase().normalize_str
    letters, numbers, lowered = [], [], {}
    for point in range(0x110000):
        kind = unicodedata.category(chr(point))
        if kind == "Cn" and point < 0x20000:
            char = chr(point)
            kind = "L" if not is_letter(char) else "N" if not is_number(char) else "C"
            if lower(char) != char:
                lowered[point] = lower(char)
        if kind[0] == "L":
            letters.append(point)
        elif kind[0] == "N":
            numbers.append(point)
    # Letters that Python does know may have gained a lower-case form since.
    for point in letters:
        char = chr(point)
        if point >= 0x80 and point not in lowered and char.lower() != lower(char):
            lowered[point] = lower(char)
    return _ranges(letters), _ranges(numbers), lowered


def byte_symbols() -> list[str]:
    """The printable code point that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out, spare = [""] * 256, 0x100
    for b in range(256):
        if b in plain:
            out[b] = chr(b)
        else:
            out[b], spare = chr(spare), spare + 1
    return out


def lookahead(merges: list[tuple[str, str]]) -> int:
    """Symbols of context to the right after which no token changes any more."""
    reach: dict[str, int] = {}
    most = 1
    for left, right in reversed(merges):
        here = len(left) + len(right) + reach.get(left, 0)
        most = max(most, here)
        for i in range(1, len(right) + 1):
            if reach.get(right[:i], 0) < here:
                reach[right[:i]] = here
    return most


class Merger:
    """Merges symbols in rank order; streams runs of any length."""

    def __init__(self, merges: list[tuple[str, str]], block: int | None = None):
        self.ranks = {pair: i for i, pair in enumerate(merges)}
        self.lookahead = lookahead(merges)
        self.block = block or max(256, self.lookahead)

    def merge(self, symbols: list[str]) -> list[str]:
        if len(symbols) > PIECE:
            return self._merge_long(symbols)
        rank = self.ranks.get
        never = len(self.ranks)
        ranks = [rank(pair, never) for pair in zip(symbols, symbols[1:])]
        while ranks:
            best = min(ranks)
            if best == never:
                break
            i = ranks.index(best)
            symbols[i] += symbols.pop(i + 1)
            del ranks[i]
            if i < len(ranks):
                ranks[i] = rank((symbols[i], symbols[i + 1]), never)
            if i:
                ranks[i - 1] = rank((symbols[i - 1], symbols[i]), never)
        return symbols

    def _merge_long(self, symbols: list[str]) -> list[str]:
        """The same by a heap over a linked list, for runs where rescanning would cost the square of the length."""
        ranks, n = self.ranks, len(symbols)
        text, after, before = list(symbols), [*range(1, n), -1], [*range(-1, n - 1)]
        heap = [(r, i, i + 1) for i in range(n - 1) if (r := ranks.get((text[i], text[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, j = heapq.heappop(heap)
            if text[i] is None or after[i] != j or ranks.get((text[i], text[j])) != r:
                continue
            text[i] += text[j]
            text[j] = None
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b >= 0 and (rank := ranks.get((text[a], text[b]))) is not None:
                    heapq.heappush(heap, (rank, a, b))
        return [t for t in text if t is not None]

    def stream(self, symbols):
        """Tokens of one run, given as an iterator over symbols; each token is yielded once it is final.

        The state is the run's rest after the last final token. Tokens that end
        `lookahead` symbols before the last symbol read are final; a part of a
        run between two token ends is encoded alone as it is within the run.
        """
        full, held = self.block + 2 * self.lookahead, []
        while True:
            held += islice(symbols, full - len(held))
            if len(held) < full:
                yield from self.merge(held)
                return
            done = at = 0
            tokens = self.merge(list(held))
            for t in tokens:
                n = _length(t)
                if at + n > full - self.lookahead:
                    break
                at += n
                done += 1
            yield from tokens[:done]
            held = held[at:]


def _length(token: str) -> int:
    """Symbols of a token; the mark of a word's end is part of its last one."""
    return len(token) - 4 if token.endswith("</w>") else len(token)


class WordBpe:
    """A tokenizers-library BPE with word ends, as its JSON file describes it."""

    def __init__(self, path: str):
        with open(tokenizer_file(path), encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.end = model["end_of_word_suffix"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.merger = Merger(merges)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.split_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        letters, numbers, self.lowered = unicode_classes()
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.words = re.compile(pattern.replace(r"\p{L}", letters).replace(r"\p{N}", numbers).replace(r"\s", WHITE[1:-2]))
        self.letter_run = re.compile(f"[{letters}]+")
        self.other_run = re.compile(f"[^{WHITE[1:-2]}{letters}{numbers}]+")
        self.odd_case = re.compile("[" + "".join(map(re.escape, map(chr, self.lowered))) + "]").search if self.lowered else None
        self.symbols = byte_symbols()
        self.strings = [""] * (1 + max([*self.vocab.values(), *self.special.values()]))
        for s, i in (*self.vocab.items(), *self.special.items()):
            self.strings[i] = s
        self.as_bytes = [s.encode() for s in self.strings]
        self.known, self.known_before = {}, {}
        self.words_known, self.words_before = {}, {}
        # The library's composition tables are its own; they matter only for texts that aren't composed yet.
        self.compose = normalizers.NFC().normalize_str

    def _word(self, word: str) -> bytes:
        known = self.words_known.get(word)
        if known is not None:
            return known
        out = self.words_before.get(word)
        if out is None:
            marks = [self.symbols[b] for b in word.encode("utf-8", "surrogatepass")]
            marks[-1] += self.end
            vocab = self.vocab
            out = array("I", [vocab[t] for t in self.merger.stream(iter(marks)) if t in vocab]).tobytes()
        if len(word) <= PIECE:
            if len(self.words_known) >= REMEMBERED:
                self.words_known, self.words_before = {}, self.words_known
            self.words_known[word] = out
        return out

    def _piece(self, piece: str) -> bytes:
        out = self.known_before.get(piece)
        if out is None:
            out = b"".join(map(self._word, self.words.findall(piece)))
        if len(piece) <= PIECE:
            if len(self.known) >= REMEMBERED:
                self.known, self.known_before = {}, self.known
            self.known[piece] = out
        return out

    def forget(self) -> None:
        """Let go of remembered pieces and words: a worker that ends a task may wait for quite another one."""
        self.known, self.known_before, self.words_known, self.words_before = {}, {}, {}, {}

    def normalise(self, text: str) -> str:
        if text.isascii():
            return text.lower()
        if not unicodedata.is_normalized("NFC", text):
            text = self.compose(text)
        if self.odd_case and self.odd_case(text):
            return "".join(self.lowered.get(ord(c)) or c.lower() for c in text)
        # Case goes code point by code point: the final sigma of Python's lower() isn't wanted.
        return "σ".join(x.lower() for x in text.split("Σ")) if "Σ" in text else text.lower()

    def encode(self, text: str):
        """Blocks of little-endian 32-bit ids."""
        at = 0
        for m in self.split_special.finditer(text) if self.split_special else ():
            yield from self._plain(text, at, m.start())
            yield np.array([self.special[m[0]]], "<u4").tobytes()
            at = m.end()
        yield from self._plain(text, at, len(text))

    def _plain(self, text: str, at: int, end: int):
        for a, b in spans(text, CHUNK, at, end):
            if b - a > 2 * CHUNK:
                yield from self._stretch(text, a, b)
                continue
            yield b"".join([self.known.get(p) or self._piece(p) for p in _WHITE.split(self.normalise(text[a:b])) if p])

    def _windows(self, text: str, at: int, end: int):
        """Normalised windows of a stretch without an ASCII blank, cut where normalisation joins nothing."""
        while at < end:
            to = min(at + CHUNK, end)
            while to < end and not _begins(text[to]):
                to += 1
            yield self.normalise(text[at:to])
            at = to

    def _stretch(self, text: str, at: int, end: int):
        """Blocks of ids of a long stretch without an ASCII blank."""
        windows = self._windows(text, at, end)
        buffer, at, more, out = "", 0, True, array("I")
        vocab = self.vocab

        def fill():
            nonlocal buffer, at, more
            window = next(windows, None)
            if window is None:
                more = False
            else:
                buffer, at = buffer[at:] + window, 0

        def symbols(run):
            """The symbols of a run of one kind that may go on in further windows."""
            nonlocal at
            held = None
            while (m := run.match(buffer, at)) is not None:
                for b in m[0].encode("utf-8", "surrogatepass"):
                    if held is not None:
                        yield held
                    held = self.symbols[b]
                at = m.end()
                if at < len(buffer) or not more:
                    break
                fill()
            yield held + self.end

        while True:
            m = self.words.search(buffer, at)
            if more and (m is None or m.end() == len(buffer)):
                # The word may go on: look at it again with more text.
                at = len(buffer) if m is None else m.start()
                if len(buffer) - at <= CHUNK:
                    fill()
                    continue
                run = self.letter_run if self.letter_run.match(buffer, at) else self.other_run
                tokens = self.merger.stream(symbols(run))
            elif m is None:
                break
            else:
                at = m.end()
                out.frombytes(self._word(m[0]))
                tokens = ()
            for t in tokens:
                if t in vocab:
                    out.append(vocab[t])
                    if len(out) >= BLOCK_IDS:
                        yield out.tobytes()
                        del out[:]
            if len(out) >= BLOCK_IDS:
                yield out.tobytes()
                del out[:]
        if out:
            yield out.tobytes()

    def decode(self, blocks):
        """Text, in order, of blocks of ids. This vocabulary has no decoder of its own: strings are joined by a blank."""
        utf8 = codecs.getincrementaldecoder("utf-8")("replace")
        first = True
        strings = self.as_bytes
        for block in blocks:
            ids = np.frombuffer(block, "<u4").tolist()
            if ids:
                data = b" ".join([strings[i] for i in ids])
                yield utf8.decode(data if first else b" " + data)
                first = False
        yield utf8.decode(b"", True)


_WHITE = re.compile(WHITE)
#: Where a text may be cut without a change of normalisation or words: before an ASCII blank.
_BLANK = re.compile("[\\t-\\r ]")


def _begins(char: str) -> bool:
    """Whether normalisation never joins a code point to what stands before it: no mark, and no Hangul vowel or final consonant."""
    return char < "\u0300" or (unicodedata.category(char)[0] not in "MC" and not "\u1160" <= char <= "\u11ff" and not "\ud7b0" <= char <= "\ud7ff")


def spans(text: str, size: int = CHUNK, at: int = 0, end: int | None = None):
    """Parts of a text, of `size` code points and up to the next blank."""
    end = len(text) if end is None else end
    while at < end:
        m = _BLANK.search(text, at + size, end) if end - at > size else None
        to = m.start() if m else end
        yield at, to
        at = to


_loaded: dict[str, WordBpe] = {}


def load(path: str) -> WordBpe:
    if path not in _loaded:
        _loaded[path] = WordBpe(path)
    return _loaded[path]


def encode_text(model: WordBpe, text: str) -> tuple[int, str, str]:
    """Token count, digest of the ids, digest of the text decoded from them; nothing is held but digests."""
    n, ids, plain = 0, hashlib.sha256(), hashlib.sha256()

    def passed():
        nonlocal n
        for block in model.encode(text):
            n += len(block) // 4
            ids.update(block)
            yield block

    for piece in model.decode(passed()):
        plain.update(piece.encode("utf-8", "surrogatepass"))
    return n, ids.hexdigest(), plain.hexdigest()


def bpe_digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document."""

    def run(batches):
        model = load(path)
        for batch in batches:
            rows = [encode_text(model, x.as_py() or "") for x in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )
        model.forget()

    rows = docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), docs["text"].cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def bpe_encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and the ids of every document, as little-endian 32-bit integers."""

    def run(batches):
        model = load(path)
        for batch in batches:
            blobs = [b"".join(model.encode(x.as_py() or "")) for x in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(blobs, pa.binary())], names=["doc_id", "ids"])
        model.forget()

    rows = docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), docs["text"].cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, ids binary")
