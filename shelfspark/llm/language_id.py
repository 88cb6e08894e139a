"""Language ID by compression: the language whose dictionary encodes a text in the fewest bytes.

Fitting takes, for each language, the labelled rows with the smallest hash of
their identifier: at most SAMPLE_DOCS, the documented bound of the sample. Each
of them gives up to SHARE bytes of letters to the language's raw-content
dictionary, in PIECES whole-word pieces spread evenly over the whole text, so
that a dictionary holds something of every sampled row and never more than
SAMPLE_DOCS * SHARE bytes. A text is reduced to lower-case runs of letters, cut
into blocks of BLOCK bytes, and every block is compressed against every
dictionary; the sums over the whole text decide. The score is the margin between
the best and second language, relative to the second; under MIN_SCORE the answer
is marked as rejected.

Defined results: null text, or text without a letter (a character of Unicode's
categories L), is `und` with score 0; equal sums go to the language that sorts
first; rows with null lang, text or identifier are not learned from, and a row
without an identifier is not held out; of rows that repeat an identifier and a
language the smallest text is learned from; of more than MAX_LANGUAGES languages
those with the most rows are learned, equal ones in order of name; without any
labelled row every text is `und`; with one language learned its score is 1;
repeated rows are judged alike; other columns are ignored.
"""

from __future__ import annotations

import re

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Labelled rows per language that fitting reads at most, bytes that each of them gives, and the pieces that they come in.
SAMPLE_DOCS = 400
SHARE = 640
PIECES = 8
#: Languages that are learned at most, so that the model stays small.
MAX_LANGUAGES = 256
BLOCK = 4096
LEVEL = 9
MIN_SCORE = 0.02
_HASHES = 1 << 40
UNKNOWN = "und"
_RUN = re.compile(r"[^\W\d_]+")


def letters(text: str) -> bytes:
    """Lower-case runs that hold a letter. Numbers such as one half or a Roman eight count as word characters, but not as letters."""
    runs = _RUN.findall(text.lower())
    return " ".join([r for r in runs if r.isalpha() or any(map(str.isalpha, r))]).encode("utf-8", "surrogatepass")


def spread(data: bytes, size: int = SHARE, pieces: int = PIECES) -> bytes:
    """All of data if it has at most `size` bytes; else whole words from `pieces` places over its whole length."""
    if len(data) <= size:
        return data
    each, step, out = size // pieces, (len(data) - size // pieces) / (pieces - 1), []
    for k in range(pieces):
        at = round(k * step)
        # From the first whole word to the last one; a word longer than the piece is left out.
        begin = at if at == 0 else data.find(b" ", at - 1) + 1
        end = at + each if at + each >= len(data) else data.rfind(b" ", 0, at + each + 1)
        if 0 <= begin < end and (at == 0 or begin):
            out.append(data[begin:end])
    if out:
        return b" ".join(out)
    # No blank anywhere near: as much of the text as there are whole code points.
    return data[:size].decode("utf-8", "ignore").encode()


def fold(doc_id: Column, folds: int = 5) -> Column:
    """crc32 of the identifier as text, modulo folds."""
    return F.pmod(F.crc32(doc_id.cast("string")), F.lit(folds))


def _given(batches):
    for batch in batches:
        parts = [spread(letters(x.as_py())) for x in batch.column("text")]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("lang"), pa.array(parts, pa.binary())], names=["doc_id", "lang", "part"])


def fit(labelled: DataFrame) -> list[tuple[str, bytes]]:
    """labelled: doc_id, text, lang. (lang, dictionary) in order of lang. At most SAMPLE_DOCS rows a language, of SHARE bytes each, reach the driver."""
    usable = labelled.filter("lang is not null and text is not null and doc_id is not null")
    sizes = usable.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(MAX_LANGUAGES).collect()
    if not sizes:
        return []
    # A bound on the hash leaves about twice the sample of a large language to rank.
    bound = F.element_at(F.create_map(*[F.lit(x) for r in sizes for x in (r.lang, _HASHES if r.n <= 4 * SAMPLE_DOCS else _HASHES * 2 * SAMPLE_DOCS // r.n)]), F.col("lang"))
    hashed = usable.select("doc_id", "lang", F.pmod(F.xxhash64("doc_id"), F.lit(_HASHES)).alias("hash")).filter(F.col("hash") < bound).distinct()
    order = Window.partitionBy("lang").orderBy("hash", "doc_id")
    rows = hashed.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= SAMPLE_DOCS).select("doc_id", "lang").collect()
    spark = labelled.sparkSession
    wanted = F.broadcast(spark.createDataFrame([(r.doc_id, r.lang) for r in rows], "doc_id bigint, lang string"))
    # Beside each other rows of one identifier and language are rare; the smallest text stands for them.
    texts = usable.join(wanted, ["doc_id", "lang"], "left_semi").groupBy("doc_id", "lang").agg(F.min("text").alias("text"))
    by_lang: dict[str, list] = {r.lang: [] for r in rows}
    for r in texts.mapInArrow(_given, "doc_id bigint, lang string, part binary").collect():
        by_lang[r.lang].append((r.doc_id, bytes(r.part)))
    return [(name, b" ".join(t for _, t in sorted(by_lang[name]))) for name in sorted(by_lang)]


class Classifier:
    def __init__(self, model: list[tuple[str, bytes]]):
        self.names = [n for n, _ in model]
        self.compress = []
        for _, content in model:
            primer = zstandard.ZstdCompressionDict(content or b" ", dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            primer.precompute_compress(level=LEVEL)
            self.compress.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=primer, write_content_size=False, write_dict_id=False, write_checksum=False).compress)

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        data = letters(text or "")
        if not data or not self.names:
            return UNKNOWN, 0.0, True
        blocks = [data[i : i + BLOCK] for i in range(0, len(data), BLOCK)]
        sizes = [sum(len(f(b)) for b in blocks) for f in self.compress]
        best = min(range(len(sizes)), key=sizes.__getitem__)
        if len(sizes) == 1:
            return self.names[0], 1.0, False
        second = min(s for i, s in enumerate(sizes) if i != best)
        score = (second - sizes[best]) / second
        return self.names[best], score, score < MIN_SCORE


def predict(docs: DataFrame, model: list[tuple[str, bytes]]) -> DataFrame:
    """docs: doc_id, held_out, text. Adds lang_pred, score, rejected in place of the text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        classify = Classifier(shared.value).predict
        for batch in batches:
            rows = [classify(x.as_py()) for x in batch.column("text")]
            types = (pa.string(), pa.float64(), pa.bool_())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), *[pa.array([r[i] for r in rows], t) for i, t in enumerate(types)]],
                names=["doc_id", "held_out", "lang_pred", "score", "rejected"],
            )

    return docs.select("doc_id", "held_out", "text").mapInArrow(run, "doc_id bigint, held_out boolean, lang_pred string, score double, rejected boolean")


def language_id(docs: DataFrame) -> DataFrame:
    """Learn from the labelled rows outside the held-out fold; predict every row."""
    rows = docs.select(
        docs["doc_id"].cast("bigint").alias("doc_id"),
        docs["text"].cast("string").alias("text"),
        docs["lang"].cast("string").alias("lang"),
        F.coalesce(fold(docs["doc_id"]) == 0, F.lit(False)).alias("held_out"),
    )
    return predict(rows, fit(rows.filter("not held_out")))
