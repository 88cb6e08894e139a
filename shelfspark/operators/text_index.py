"""A trigram index for the two text searches.

For each page of PAGE places (`ord`) and trigram the index has a bitmap of the rows one of whose
texts holds the trigram. A row that contains a needle holds all of its trigrams, so the
rows to look at are an intersection; the plain predicate then decides. The
postings lie in folders by a hash of the trigram, and a search reads those of its
needle's RAREST trigrams only; the catalog lies sorted by place, and is read at the
pages that are left. A needle of fewer than three characters is looked for in all rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.functions import values as V
from shelfspark.functions.text import norm, sure
from shelfspark.sources.catalog import TASK_ROWS

from .search import haystack_hit, haystack_text, matches_search, needle_columns

PAGE, FOLDERS = 4096, 64
#: Trigrams of a needle whose bitmaps are intersected.
RAREST = 3
#: What each kind of search looks through: the row's texts, one of which must hold the needle.
FIELDS = {"direct": lambda: F.col("search_texts"), "haystack": lambda: F.array(haystack_text())}


def trigrams(text: Column) -> Column:
    """The distinct runs of three characters: what _postings_of() finds, for a text beside its row."""
    n = F.length(text)
    return F.when(n >= 3, F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(n - 2, F.lit(1))), lambda i: F.substring(text, i, F.lit(3))))).otherwise(F.array().cast("array<string>"))


_POSTING = "gram string, index_page bigint, bits binary, n bigint"
#: Trigrams of a page whose bits are laid out at a time.
_SOME = 4096


def _postings_of(page: int, places: list[int], texts: list[list[str]], size: int) -> Iterator[pa.RecordBatch]:
    """Each trigram of a page's texts with a bit for each of its `size` places that holds it."""
    held = [(p, t) for p, ts in zip(places, texts) for t in ts if len(t) > 2]
    if not held:
        return
    sizes = np.array([len(t) for _, t in held])
    codes = np.frombuffer("".join(t for _, t in held).encode("utf-32-le"), np.uint32).astype(np.uint64)
    # A run starts wherever its text has two more characters.
    starts = np.setdiff1d(np.arange(len(codes) - 2), np.concatenate([np.cumsum(sizes) - 2, np.cumsum(sizes) - 1]), assume_unique=True)
    runs, own = np.unique(codes[starts] << np.uint64(42) | codes[starts + 1] << np.uint64(21) | codes[starts + 2], return_inverse=True)
    pairs = np.unique(own * size + np.repeat([p for p, _ in held], sizes)[starts])
    low = np.uint64((1 << 21) - 1)
    for first in range(0, len(runs), _SOME):
        some = runs[first : first + _SOME]
        part = pairs[np.searchsorted(pairs, first * size) : np.searchsorted(pairs, (first + len(some)) * size)] - first * size
        bits = np.zeros(len(some) * size, bool)
        bits[part] = True
        bits = bits.reshape(len(some), size)
        letters = np.stack([some >> np.uint64(42), some >> np.uint64(21) & low, some & low], 1).astype(np.uint32).tobytes().decode("utf-32-le")
        packed = np.packbits(bits, axis=1, bitorder="little")
        columns = [pa.array([letters[i : i + 3] for i in range(0, len(letters), 3)]), pa.array(np.full(len(some), page)), pa.array([b.tobytes() for b in packed], pa.binary()), pa.array(bits.sum(1, dtype=np.int64))]
        yield pa.RecordBatch.from_arrays(columns, names=["gram", "index_page", "bits", "n"])


def _postings(batches, size: int) -> Iterator[pa.RecordBatch]:
    """The postings of one page after another, from rows (index_page, place, texts) sorted by page."""
    at, places, texts = None, [], []
    for batch in batches:
        for page, place, own in zip(*(batch.column(c).to_pylist() for c in ("index_page", "place", "texts"))):
            if page != at and places:
                yield from _postings_of(at, places, texts, size)
                places, texts = [], []
            at = page
            places.append(place)
            texts.append(own)
    if places:
        yield from _postings_of(at, places, texts, size)


def _folder(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(FOLDERS)).cast("int")


class TextIndex:
    """The index of an enriched catalog, in a folder: rows, and postings by kind of search."""

    def __init__(self, spark: SparkSession, path: str, schema):
        self.spark, self.path, self.schema = spark, path, schema

    @classmethod
    def build(cls, items: DataFrame, path: str, kinds: tuple[str, ...] = tuple(FIELDS)) -> TextIndex:
        """The index for some kinds of search. A row's texts move once, to its page's task, which cuts them; trigrams are not rows of a shuffle."""
        index, size = cls(items.sparkSession, path.rstrip("/"), items.schema), PAGE
        paged = items.withColumn("index_page", F.floor(F.col("ord") / PAGE).cast("bigint"))
        # Numbers of tasks by rows, as sizes of shuffles don't tell how large these bitmaps and wide rows are in memory.
        tasks = max(1, -(-items.count() // TASK_ROWS))
        paged.repartitionByRange(tasks, "index_page").sortWithinPartitions("ord").write.parquet(f"{index.path}/rows")
        place = (F.col("ord") % PAGE).cast("int").alias("place")
        for kind in kinds:
            texts = F.filter(F.coalesce(FIELDS[kind](), F.array().cast("array<string>")), lambda t: t.isNotNull()).alias("texts")
            dealt = paged.select("index_page", place, texts).repartition(tasks, "index_page").sortWithinPartitions("index_page")
            postings = dealt.mapInArrow(lambda batches: _postings(batches, size), _POSTING)
            # A folder's trigrams lie sorted, so that the files' statistics find them.
            postings.withColumn("folder", _folder(F.col("gram"))).repartition(FOLDERS, "folder").sortWithinPartitions("folder", "gram", "index_page").write.partitionBy("folder").parquet(f"{index.path}/{kind}")
        return index

    def _postings(self, kind: str, grams: list[str]) -> DataFrame:
        folders = {r.f for r in self.spark.createDataFrame([(g,) for g in grams], "gram string").select(_folder(F.col("gram")).alias("f")).collect()}
        table = self.spark.read.schema(f"{_POSTING}, folder int").parquet(f"{self.path}/{kind}")
        return table.filter(F.col("folder").isin(sorted(folders)) & F.col("gram").isin(grams))

    def candidates(self, kind: str, needle: str) -> DataFrame | None:
        """index_page, bits: places that may hold a normalised needle; None if any may."""
        grams = sorted({needle[i : i + 3] for i in range(len(needle) - 2)})
        if not grams:
            return None
        # Counts alone first: the bitmaps of frequent trigrams are not read.
        counts = {r.gram: r.n for r in self._postings(kind, grams).groupBy("gram").agg(F.sum("n").alias("n")).collect()}
        rare = sorted(grams, key=lambda g: (counts.get(g, 0), g))[:RAREST]
        if any(g not in counts for g in rare):
            return self.spark.createDataFrame([], "index_page bigint, bits binary")
        found = self._postings(kind, rare).groupBy("index_page").agg(F.bitmap_and_agg("bits").alias("bits"), F.count(F.lit(1)).alias("k"))
        return found.filter((F.col("k") == len(rare)) & (F.bitmap_count("bits") > 0)).select("index_page", "bits")

    def rows(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/rows").drop("index_page").select(self.schema.names)

    def _looked_at(self, kind: str, needle: str) -> DataFrame:
        found = self.candidates(kind, needle)
        if found is None:
            return self.rows()
        rows = self.spark.read.parquet(f"{self.path}/rows")
        place = F.col("ord") % PAGE
        byte = F.substring("bits", (F.floor(place / 8) + 1).cast("int"), F.lit(1))
        bit = F.getbit(F.conv(F.hex(byte), 16, 10).cast("int"), (place % 8).cast("int")) == 1
        return rows.join(found, "index_page").filter(bit).select(self.schema.names)

    def haystack(self, search: str) -> DataFrame:
        """The rows that haystack_hit() takes."""
        return self._looked_at("haystack", self._normal(search)).filter(haystack_hit(F.lit(search)))

    def search(self, phrase: str) -> DataFrame:
        """The rows that matches_search() takes. A phrase that speaks of an intent, or names a row's theme or mood, concerns rows without the phrase, and is looked for in all."""
        asked = {f"q_{k}": c for k, c in needle_columns(F.lit(phrase)).items()}
        needle = self._normal(phrase)
        intents = self.spark.range(1).select(F.greatest(*[asked[f"q_asks_{k}"].cast("int") for k in V.INTENTS], asked["q_asks_age"].isNotNull().cast("int")).alias("x")).first().x
        rows = self.rows()
        if intents or not rows.filter(sure(F.exists(F.concat("norm_interests", "norm_moods"), lambda x: F.lit(needle).contains(x)))).isEmpty():
            return rows.withColumns(asked).filter(matches_search("q_")).select(self.schema.names)
        return self._looked_at("direct", needle).withColumns(asked).filter(matches_search("q_")).select(self.schema.names)

    def _normal(self, text: str) -> str:
        return self.spark.range(1).select(norm(F.lit(text)).alias("x")).first().x
