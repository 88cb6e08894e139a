"""Language-model scores: a bigram model with Katz backoff, learnt from all training documents.

Tokens are the words of the lower-cased (A-Z) text and one end, which is also what
stands before the first word. With c the counts of training tokens and pairs, C(v) the
pairs that begin with v, and d the share of a count that Good-Turing keeps,

    P(w | v) = d2(c(vw)) c(vw) / C(v)     if the pair was seen,
               alpha(v) P(w)              if only v was,      P(w) else;
    P(w)     = d1(c(w)) c(w) / N          if the word was seen; one unknown word has the rest.

alpha(v) = (1 - sum of d2 c / C(v)) / (1 - sum of P(w)), both over the words seen after
v: probabilities after v sum to one exactly. d(r) is Turing's (r + 1) n(r+1) / (r n(r))
for r up to 5 where that lies between 0 and 1; for other counts, Good-Turing under
Zipf's law of n(r), (r + 1) / (r + 2), which is below one for every r, so that each
word leaves something to the unseen ones.

Words are 64-bit hashes. The tables are: words (word, n); pairs (before, word, n, and the
word's own n), in files by group of buckets; contexts (before, its backoff). The pairs of a batch of documents are
packed by bucket, the hash of the pair's last word, with the documents in which
they occur, so that one shuffle serves counting and scoring: a bucket holds all
of a word's pairs, hence c(w) and P(w) as well, and answers with a few sums for
each document. What depends on numbers that are not yet known goes into the
answer unevaluated: how many seen pairs have count 1 to 5 (they meet d2 later), and
which contexts an unseen pair backs off from (they meet alpha). C(v) needs no join:
the token before a token is one of the same circle of tokens, so a document's sum of
log C(v) is its sum of log c(w), but for unseen pairs, whose context adds C(v) alpha(v).

Frequent words (more than one in HOT tokens: fewer than HOT of them, counted
exactly and broadcast) are spread over buckets by the word before; pairs with more than one in HOT_PAIR
tokens, over SALTS buckets besides. Buckets number as many as the bytes of text ask for. EACH of
them, or more beyond COARSE groups, travel in one pack to one task, which cuts the packs into those of its buckets
and sorts these; frequent words before a word are written as their places in the list of frequent words.

Defined results: null or empty text is the end alone; a null identifier counts as
held out (its text is empty, of checksum 0); rows that repeat identifier and text each get the score; without
training documents every token is the unknown word, of probability 1; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, drop, settle, stage, text_of
from .textops import mix, span_hashes, word_bounds

FOLDS = 10
#: The hash that stands for the end of a text.
END = 1
#: Bytes of text in a bucket, the groups of buckets that packs are dealt to at most, and the buckets of a group.
BUCKET_BYTES, COARSE, EACH = 4 << 20, 4096, 8
#: Bytes of text that are packed together, unless one text is longer, and rows of an answer that are given at a time.
BLOCK_BYTES, ROWS = 4 << 20, 1 << 15
#: Documents whose sums a task holds over its buckets.
DOCS = 1 << 18
HOT, HOT_PAIR, SALTS = 1 << 16, 1 << 10, 64
#: Counts that Turing's estimate discounts.
TURING = 5
#: Added to each count in the base score.
ADDED = 0.1
_U = np.uint64


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS == 0


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, key (of identifier and text), held, text."""
    text = text_of(docs, text_col)
    return docs.select(docs[id_col].cast("bigint").alias("doc_id"), F.xxhash64(docs[id_col].cast("bigint"), text).alias("key"), held_out(docs[id_col]).alias("held"), text.alias("text"))


def tokens_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all tokens, text by text, and the number of each text's tokens."""
    whole = [(x.as_py() or "").encode("utf-8", "surrogatepass").lower() for x in texts]
    raw = np.frombuffer(b" ".join(whole), np.uint8)
    starts, ends = word_bounds(raw)
    words = span_hashes(raw, starts, ends) if len(starts) else np.empty(0, _U)
    edges = np.cumsum([len(x) + 1 for x in whole])
    upto = np.searchsorted(starts, edges)
    return np.insert(words, upto, _U(END)), np.diff(upto, prepend=0) + 1


def before(tokens: np.ndarray) -> np.ndarray:
    """The token before each token; before the first of a text, the end (of the text before it)."""
    return np.concatenate([np.array([END], _U), tokens[:-1]])


def _pair(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    return mix(mix(context) + word * _U(0x9E3779B97F4A7C15))


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


class Hot:
    """Frequent words and pairs with their counts, for lookups."""

    def __init__(self, words: list[tuple[int, int]], pairs: list[tuple[int, int, int]] = ()):
        self.words, self.word_counts = _sorted([(w & (1 << 64) - 1, n) for w, n in words])
        of = lambda c, w: int(_pair(np.array([c & (1 << 64) - 1], _U), np.array([w & (1 << 64) - 1], _U))[0])
        self.pairs, self.pair_counts = _sorted([(of(c, w), n) for c, w, n in pairs])

    def bucket(self, context: np.ndarray, word: np.ndarray, salt: int, buckets: int) -> np.ndarray:
        """The bucket of each pair."""
        place, pair = mix(word), None
        hot = known(self.words, word)
        if hot.any():
            pair = _pair(context[hot], word[hot])
            salted = known(self.pairs, pair)
            pair[salted] = mix(pair[salted] + _U(salt + 1))
            place[hot] = pair
        return (place % _U(buckets)).astype(np.int64)


def _sorted(counts: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    counts = sorted(counts)
    return np.array([x for x, _ in counts], _U), np.array([n for _, n in counts], np.int64)


def known(values: np.ndarray, asked: np.ndarray) -> np.ndarray:
    if not len(values):
        return np.zeros(len(asked), bool)
    return values[np.minimum(np.searchsorted(values, asked), len(values) - 1)] == asked


def looked_up(values: np.ndarray, counts: np.ndarray, asked: np.ndarray, otherwise: np.ndarray) -> np.ndarray:
    """The counts of those that are among values, otherwise for the rest."""
    if not len(values):
        return otherwise
    at = np.minimum(np.searchsorted(values, asked), len(values) - 1)
    return np.where(values[at] == asked, counts[at], otherwise)


# --- counts of words, and of pairs of frequent words


def word_counts(docs: DataFrame) -> DataFrame:
    """word, n over training documents."""

    def run(batches):
        for batch in batches:
            words, n = np.unique(tokens_of(batch.column("text"))[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([_signed(words), pa.array(n)], names=["word", "n"])

    return docs.filter(~F.col("held")).select("text").mapInArrow(run, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def pair_counts(docs: DataFrame, words: list[int]) -> DataFrame:
    """before, word, n of training pairs of two of the given words."""
    among = np.sort(np.array([w & (1 << 64) - 1 for w in words], _U))

    def run(batches):
        for batch in batches:
            word, _ = tokens_of(batch.column("text"))
            context = before(word)
            both = known(among, word) & known(among, context)
            word, context = word[both], context[both]
            _, first, n = np.unique(_pair(context, word), return_index=True, return_counts=True)
            yield pa.RecordBatch.from_arrays([_signed(context[first]), _signed(word[first]), pa.array(n)], names=["before", "word", "n"])

    counted = docs.filter(~F.col("held")).select("text").mapInArrow(run, "before bigint, word bigint, n bigint")
    return counted.groupBy("before", "word").agg(F.sum("n").alias("n"))


def discounts(counts: dict[int, int]) -> list[float]:
    """d(1) to d(TURING), from the numbers of n-grams that occur 1, 2, .. TURING + 1 times."""
    out = []
    for r in range(1, TURING + 1):
        turing = (r + 1) * counts.get(r + 1, 0) / (r * counts[r]) if counts.get(r) else 0.0
        out.append(turing if 0.0 < turing < 1.0 else (r + 1) / (r + 2))
    return out


def kept(n: Column, d: list[float]) -> Column:
    """The count that is kept of n: d(n) n."""
    out = F.when(F.lit(False), 0.0)
    for r, share in enumerate(d, 1):
        out = out.when(n == r, F.lit(share * r))
    return out.otherwise(n * (n + 1) / (n + 2))


def kept_of(n: np.ndarray, d: list[float]) -> np.ndarray:
    share = (n + 1) / (n + 2)
    for r, x in enumerate(d, 1):
        share[n == r] = x
    return share * n


def counts_of_counts(table: DataFrame, column: str = "n") -> dict[int, int]:
    few = table.filter(F.col(column) <= TURING + 1).groupBy(column).agg(F.count(F.lit(1)).alias("k")).collect()
    return {r[column]: r["k"] for r in few}


# --- packs of pairs, by bucket

_PACK = "coarse bigint, fine bigint, salt bigint, pack binary"
_LEVEL = 1


def coarse_of(buckets: int) -> int:
    return min(-(-buckets // EACH), COARSE)


def _pack(word, context, n, docs, keys, held, hot: Hot) -> bytes:
    """word, context, n: pairs, those of a word together, and how many places each has; docs: the places' documents, as indexes into keys."""
    used, docs = np.unique(docs, return_inverse=True)
    new = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
    each = np.diff(np.append(new, len(word)))
    often = known(hot.words, context)
    at = np.searchsorted(hot.words, context[often])
    parts = (keys[used].astype("<i8"), word[new].astype("<u8"), context[~often].astype("<u8"), each.astype("<u4"), n.astype("<u4"), at.astype("<u2"), docs.astype("<u2"), np.packbits(often), np.packbits(held[used]))
    sizes = np.array([len(p) for p in parts], "<u4")
    return zstandard.ZstdCompressor(level=_LEVEL).compress(b"".join([sizes.tobytes(), *[p.tobytes() for p in parts]]))


_KINDS = ("<i8", "<u8", "<u8", "<u4", "<u4", "<u2", "<u2", "u1", "u1")


def _unpack(pack: bytes, hot: Hot) -> tuple[np.ndarray, ...]:
    """word, context, n of the pairs, docs of the places, keys, held."""
    raw = zstandard.ZstdDecompressor().decompress(pack)
    sizes, at, parts = np.frombuffer(raw, "<u4", len(_KINDS)), 4 * len(_KINDS), []
    for size, kind in zip(sizes.tolist(), _KINDS):
        parts.append(np.frombuffer(raw, kind, size, at))
        at += parts[-1].nbytes
    keys, word, rare, each, n, frequent, docs, often, held = parts
    often = np.unpackbits(often, count=len(n)).astype(bool)
    context = np.empty(len(n), _U)
    context[~often], context[often] = rare, hot.words[frequent]
    return np.repeat(word, each), context, n.astype(np.int64), docs.astype(np.int32), keys, np.unpackbits(held, count=len(keys)).astype(bool)


def _pack_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64()] * 3 + [pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=[c.split()[0] for c in _PACK.split(", ")])


def blocks_of(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of about BLOCK_BYTES of text, and of so few rows that 16 bits number them."""
    upto = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        end = int(np.searchsorted(upto, (upto[at - 1] if at else 0) + BLOCK_BYTES))
        end = min(max(end, at + 1), at + (1 << 15), batch.num_rows)
        yield batch.slice(at, end - at)
        at = end


def packs(docs: DataFrame, hot: Hot, buckets: int) -> DataFrame:
    """The pairs of each batch of documents, packed by group of buckets."""
    shared, coarse = docs.sparkSession.sparkContext.broadcast(hot), coarse_of(buckets)

    def run(batches):
        for whole in batches:
            for batch in blocks_of(whole):
                rows = _block_packs(batch, shared.value, buckets, coarse)
                for i in range(0, len(rows), 16):
                    yield _pack_batch(rows[i : i + 16])

    return docs.select("key", "held", "text").mapInArrow(run, _PACK)


def _block_packs(batch: pa.RecordBatch, hot: Hot, buckets: int, coarse: int) -> list[tuple]:
    word, each = tokens_of(batch.column("text"))
    context, doc = before(word), np.repeat(np.arange(len(each), dtype=np.int32), each)
    keys, held = batch.column("key").to_numpy(), batch.column("held").to_numpy(zero_copy_only=False)
    salt = int(keys[0] % SALTS)
    group = (hot.bucket(context, word, salt, buckets) % coarse).astype(np.int32)
    # By group, then word, then the word before: places of a pair stand together but for collisions, which only split a pair.
    order = np.argsort(group.astype(_U) << _U(50) | (mix(word) >> _U(39)) << _U(25) | mix(context) >> _U(39))
    word, context, doc, group = word[order], context[order], doc[order], group[order]
    del order
    first = np.flatnonzero(np.concatenate([[True], (word[1:] != word[:-1]) | (context[1:] != context[:-1]) | (group[1:] != group[:-1])]))
    n = np.diff(np.append(first, len(word)))
    edges = np.flatnonzero(np.concatenate([[True], group[first][1:] != group[first][:-1]]))
    out = []
    for a, b in zip(edges.tolist(), [*edges[1:].tolist(), len(first)]):
        lo, hi = first[a], first[b - 1] + n[b - 1]
        out.append((int(group[lo]), 0, salt, _pack(word[first[a:b]], context[first[a:b]], n[a:b], doc[lo:hi], keys, held, hot)))
    return out


def _fine_packs(row: dict, hot: Hot, buckets: int, coarse: int) -> list[tuple]:
    """A group's pack as packs of its buckets."""
    word, context, n, docs, keys, held = _unpack(row["pack"], hot)
    fine = (hot.bucket(context, word, row["salt"], buckets) // coarse).astype(np.int32)
    of_place = np.repeat(fine, n)
    out = []
    for f in np.unique(fine).tolist():
        own = fine == f
        out.append((row["coarse"], f, row["salt"], _pack(word[own], context[own], n[own], docs[of_place == f], keys, held, hot)))
    return out


def dealt(packed: DataFrame, hot: Hot, buckets: int) -> DataFrame:
    """Packs by group, one group a task. Where groups have more than EACH buckets, packs are cut by bucket and sorted by Spark; else a task holds its group's, compressed."""
    coarse = coarse_of(buckets)
    rows = packed.repartitionById(coarse, F.col("coarse").cast("int")) if hasattr(packed, "repartitionById") else packed.repartition(coarse, "coarse")
    if buckets <= coarse * EACH:
        return rows
    shared = packed.sparkSession.sparkContext.broadcast(hot)

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                out = _fine_packs(row, shared.value, buckets, coarse)
                for i in range(0, len(out), 1024):
                    yield _pack_batch(out[i : i + 1024])

    return rows.mapInArrow(run, _PACK).sortWithinPartitions("coarse", "fine")


# --- a bucket's answer

#: kind 0, sums of a document (key): tokens, known ones, base, rest, seen pairs of count 1 .. 5. kind 1, a pair (before, word, n, n of the word). kind 2, tokens of a document (key) that back off after before.
_ANSWER = "kind int, key bigint, before bigint, word bigint, n bigint, word_n bigint, base double, rest double, seen array<int>"


class Sums:
    """Sums of documents over a task's buckets, given out when they are many."""

    def __init__(self):
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.rows = 0

    def add(self, keys: np.ndarray, sums: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.parts.append((keys, sums))
        self.rows += len(keys)
        if self.rows > 2 * DOCS:
            self._merge()
            if self.rows > DOCS:
                yield from self.given()

    def _merge(self) -> None:
        keys, of_key = np.unique(np.concatenate([k for k, _ in self.parts]), return_inverse=True)
        every = np.concatenate([x for _, x in self.parts], axis=1)
        self.parts = [(keys, np.stack([np.bincount(of_key, weights=row, minlength=len(keys)) for row in every]))]
        self.rows = len(keys)

    def given(self) -> Iterator[pa.RecordBatch]:
        if self.parts:
            self._merge()
            keys, sums = self.parts[0]
            whole = lambda row: np.rint(sums[row]).astype(np.int64)
            seen = pa.array(np.rint(sums[4:].T).astype(np.int32).reshape(-1))
            yield from _answer(len(keys), 0, key=keys, n=whole(0), word_n=whole(1), base=sums[2], rest=sums[3], seen=pa.FixedSizeListArray.from_arrays(seen, TURING).cast(pa.list_(pa.int32())))
        self.parts, self.rows = [], 0


def _bucket_answer(rows: list[bytes], hot: Hot, total: int, distinct: int, d1: list[float], unknown: float, kept_sums: Sums) -> Iterator[pa.RecordBatch]:
    parts = [_unpack(r, hot) for r in rows]
    word, context = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    n = np.concatenate([p[2] for p in parts])
    keys, held = np.concatenate([p[4] for p in parts]), np.concatenate([p[5] for p in parts])
    offset = np.cumsum([0] + [len(p[4]) for p in parts])
    doc = np.concatenate([p[3] + np.int32(o) for p, o in zip(parts, offset)])
    del parts
    at = np.repeat(np.arange(len(n), dtype=np.int32), n)
    train = np.bincount(at, weights=~held[doc], minlength=len(n))

    pair, first, of_pair = np.unique(_pair(context, word), return_index=True, return_inverse=True)
    of_pair = of_pair.astype(np.int32)
    pair_n = np.bincount(of_pair, weights=train, minlength=len(pair)).astype(np.int64)
    salted = known(hot.pairs, pair)
    pair_n = looked_up(hot.pairs, hot.pair_counts, pair, pair_n)
    del pair
    values, of_word = np.unique(word, return_inverse=True)
    of_word = of_word.astype(np.int32)
    word_n = np.bincount(of_word, weights=train, minlength=len(values)).astype(np.int64)
    word_n = looked_up(hot.words, hot.word_counts, values, word_n)
    del train, values
    # A salted pair has its row elsewhere.
    shown = (pair_n > 0) & ~salted
    own = first[shown]
    yield from _answer(len(own), 1, before=context[own].view(np.int64), word=word[own].view(np.int64), n=pair_n[shown], word_n=word_n[of_word[own]])
    del word, first, salted, shown, own

    # Numbers of a pair, then of a place.
    c2, c1 = pair_n[of_pair], word_n[of_word]
    back = c2[at] == 0
    if back.any():
        asked, times = np.unique(np.rec.fromarrays([context[at[back]].view(np.int64), keys[doc[back]]], names="c,k"), return_counts=True)
        yield from _answer(len(asked), 2, key=asked["k"], before=asked["c"], n=times)
    del context, of_pair, of_word, back

    with np.errstate(divide="ignore", invalid="ignore"):
        alone = np.log10(np.where(c1 > 0, kept_of(c1, d1) / max(total, 1), unknown))
        # Pairs of count 1 to TURING get d2 later.
        paired = np.log10(c2) + np.where(c2 > TURING, np.log10((c2 + 1) / (c2 + 2)), 0.0)
        rest = np.where(c2 > 0, paired, alone) - np.where(c1 > 0, np.log10(c1), 0.0)
    del alone, paired
    base = np.log10((c1 + ADDED) / (total + ADDED * (distinct + 1)))
    sums = lambda x: np.bincount(doc, weights=x[at], minlength=len(keys))
    yield from kept_sums.add(keys, np.stack([sums(np.ones(len(n))), sums(c1 > 0), sums(base), sums(rest), *[sums(c2 == r) for r in range(1, TURING + 1)]]))


def _answer(rows: int, kind: int, **columns) -> Iterator[pa.RecordBatch]:
    for at in range(0, rows, ROWS):
        n = min(ROWS, rows - at)
        yield _answer_rows(n, kind, **{name: x[at : at + n] for name, x in columns.items()})


def _answer_rows(rows: int, kind: int, **columns) -> pa.RecordBatch:
    types = {"key": pa.int64(), "before": pa.int64(), "word": pa.int64(), "n": pa.int64(), "word_n": pa.int64(), "base": pa.float64(), "rest": pa.float64(), "seen": pa.list_(pa.int32())}
    arrays = [pa.array(np.full(rows, kind, np.int32))]
    for name, t in types.items():
        found = columns.get(name)
        arrays.append(pa.nulls(rows, t) if found is None else found if isinstance(found, pa.Array) else pa.array(np.ascontiguousarray(found), t))
    return pa.RecordBatch.from_arrays(arrays, names=["kind", *types])


def answers(packed: DataFrame, hot: Hot, buckets: int, total: int, distinct: int, d1: list[float], unknown: float) -> DataFrame:
    shared, coarse = packed.sparkSession.sparkContext.broadcast(hot), coarse_of(buckets)
    sorted_by_bucket = buckets > coarse * EACH

    def in_buckets(batches):
        """The packs of one bucket after another."""
        held: dict[tuple, list[bytes]] = {}
        for batch in batches:
            for row in batch.to_pylist():
                for group, fine, _, pack in [(row["coarse"], row["fine"], 0, row["pack"])] if sorted_by_bucket else _fine_packs(row, shared.value, buckets, coarse):
                    if sorted_by_bucket and held and (group, fine) not in held:
                        yield held.popitem()[1]
                    held.setdefault((group, fine), []).append(pack)
        while held:
            yield held.popitem()[1]

    def run(batches):
        sums = Sums()
        for packs in in_buckets(batches):
            yield from _bucket_answer(packs, shared.value, total, distinct, d1, unknown, sums)
        yield from sums.given()

    return packed.mapInArrow(run, _ANSWER)


def contexts(pairs: DataFrame, d1: list[float], d2: list[float], total: int) -> DataFrame:
    """before, n (its pairs), alpha: the exactly normalised backoff weight."""
    lower = kept(F.col("word_n"), d1) / total
    summed = pairs.groupBy("before").agg(F.sum("n").alias("n"), F.sum(kept(F.col("n"), d2)).alias("kept"), F.sum(lower).alias("lower"))
    return summed.select("before", "n", ((1 - F.col("kept") / F.col("n")) / (1 - F.col("lower"))).alias("alpha"))


def lm_scores(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = keyed(docs)
    own = stage(rows.select("doc_id", "key", "held"), "keys")
    words = stage(word_counts(rows), "words")
    size = words.agg(F.sum("n"), F.count(F.lit(1))).first()
    total, distinct = size[0] or 0, size[1]
    d1 = discounts(counts_of_counts(words))
    unknown = 1 - (words.agg(F.sum(kept(F.col("n"), d1))).first()[0] / total if total else 0.0)
    # Fewer than HOT words can hold more than one in HOT of the tokens, and likewise for pairs.
    frequent = [(r.word, r.n) for r in words.filter(F.col("n") * HOT > total).collect()]
    among = [w for w, n in frequent if n * HOT_PAIR > total]
    salted = [(r.before, r.word, r.n) for r in pair_counts(rows, among).filter(F.col("n") * HOT_PAIR > total).collect()] if among else []
    hot = Hot(frequent, salted)
    settle(spark)

    buckets = 1 + (docs.agg(F.sum(F.octet_length(text_of(docs)))).first()[0] or 0) // BUCKET_BYTES
    found = answers(dealt(packs(rows, hot, buckets), hot, buckets), hot, buckets, total, distinct, d1, unknown)
    found = stage(found, "answers")
    drop(words)
    settle(spark)
    count_of = dict(frequent)
    rest = spark.createDataFrame([(c, w, n, count_of[w]) for c, w, n in salted], "before bigint, word bigint, n bigint, word_n bigint")
    pairs = found.filter("kind = 1").select("before", "word", "n", "word_n").unionByName(rest)
    d2 = discounts(counts_of_counts(pairs))
    # A context adds C(v) alpha(v) for each token that backs off from it; one that was never seen, nothing.
    weights = contexts(pairs, d1, d2, max(total, 1)).select("before", F.log10(F.col("n") * F.col("alpha")).alias("weight"))
    backed = found.filter("kind = 2").select("key", "before", "n").join(weights, "before").groupBy("key").agg(F.sum(F.col("n") * F.col("weight")).alias("backed"))
    turing = sum((F.sum(F.get("seen", F.lit(r))) * F.log10(F.lit(x)) for r, x in enumerate(d2)), F.lit(0.0))
    sums = found.filter("kind = 0").groupBy("key").agg(F.sum("n").alias("n"), F.sum("word_n").alias("known"), F.sum("base").alias("base"), (F.sum("rest") + turing).alias("rest"))
    # Rows that repeat identifier and text were summed under one key.
    times = own.groupBy("key").agg(F.count(F.lit(1)).alias("times"))
    of_key = stage(sums.join(times, "key").join(backed, "key", "left"), "scores")
    whole = lambda c: F.floor(F.col(c) / F.col("times")).cast("bigint")
    return own.join(of_key, "key").select(
        "doc_id",
        F.col("held").alias("held_out"),
        whole("n").alias("n_tokens"),
        whole("known").alias("n_known"),
        F.lit(total).cast("bigint").alias("train_tokens"),
        (F.col("base") / F.col("times")).alias("base_score"),
        ((F.col("rest") + F.coalesce("backed", F.lit(0.0))) / F.col("times")).alias("score"),
    )
