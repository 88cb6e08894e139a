"""Exact dedup over a log-structured merge index of digests. DataFrame functions only.

The input goes through memtables one after another (a slice of the rows each, by hash of the identifier): MEMTABLES of
them, more if one would have over MEMTABLE_ROWS rows, fewer if under LEAST_ROWS. A memtable is aggregated by digest, range-partitioned and
sorted, and flushed as a run: its files hold disjoint ranges of digests, with
Parquet min/max statistics and Bloom filters. Before the next memtable is flushed,
each run gets a filter of its digests, FILTER_RATIO bits for each, in pages; a digest
of the memtable is a hit if it occurs there twice or one of the filters knows it. Whenever FAN runs of a
level are there, compaction merges them into one of the next level. It keeps, for each digest, the
smallest and largest identifier and the row count.

The probes decide what goes on: at the end, only the entries of digests that were hits are
gathered from the runs, by a filter of these, and summed; a digest that no filter knew meets no join
and no shuffle any more.

Hits receive byte verification: a filter of the hit rows' identifiers picks the rows that may be hits
without reading more than an identifier, and only their texts are hashed again and move, to be compared
byte for byte with the text of the row that stays. Rows whose bytes differ from it
(a digest collision) are grouped by the text itself. Every other row is alone.
Spark broadcasts a filter's pages only where their size allows, and joins by page
where not.

Defined results: null text counts as empty; a null identifier is below every
other and may stay only where its group has no other; rows that repeat an
identifier and its text all carry that identifier's verdict; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import delete, drop, new_path, stage

#: Rows of a memtable at most and at least; so many memtables a table has between these.
MEMTABLE_ROWS, LEAST_ROWS, MEMTABLES = 1 << 26, 1 << 12, 4
#: So many runs of a level merge.
FAN = 2
#: Bits of a filter for each digest in it: one in FILTER_RATIO unknown digests passes.
FILTER_RATIO = 16
_PAGE_BITS = 32768
_NONE = -(1 << 63)
_RUN = "digest binary, min_id bigint, max_id bigint, n bigint"
#: Bloom filters of runs fit the digests that a file holds, instead of a fixed megabyte for each file.
RUN_FILTERS = {"parquet.bloom.filter.enabled#digest": "true", "parquet.bloom.filter.adaptive.enabled": "true", "parquet.bloom.filter.max.bytes": "131072"}


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


class DigestFilter:
    """A bitmap over digests (or another column), as a table of pages: (page, bits). Its size follows their number, and it is made when it is first asked."""

    def __init__(self, digests: DataFrame, count: int | None = None, column: str = "digest"):
        self.digests, self.column, self._count, self._table = digests, column, count, None

    @property
    def pages(self) -> int:
        if self._count is None:
            self._count = self.digests.count()
        return max(1, -(-self._count * FILTER_RATIO // _PAGE_BITS))

    def slot(self, value: Column) -> Column:
        return F.pmod(F.xxhash64(value), F.lit(self.pages * _PAGE_BITS))

    def probe(self, rows: DataFrame) -> DataFrame:
        """The rows whose value may be in the filter: all that are, and few others."""
        if self._table is None:
            slot = self.digests.select(self.slot(F.col(self.column)).alias("s"))
            bits = slot.groupBy(F.floor(F.col("s") / _PAGE_BITS).cast("bigint").alias("page")).agg(F.bitmap_construct_agg((F.col("s") % _PAGE_BITS).cast("bigint")).alias("bits"))
            self._table = stage(bits, "filter")
        slot = self.slot(F.col(self.column))
        known = self._table.select(F.col("page").alias("filter_page"), F.col("bits").alias("filter_bits"))
        byte = F.substring(F.col("filter_bits"), (F.floor(slot % _PAGE_BITS / 8) + 1).cast("int"), F.lit(1))
        bit = F.floor(F.conv(F.hex(byte), 16, 10).cast("int") / F.pow(F.lit(2), slot % 8)) % 2
        return rows.join(known, (F.floor(slot / _PAGE_BITS).cast("bigint") == F.col("filter_page")) & (bit == 1), "left_semi")

    def drop(self) -> None:
        if self._table is not None:
            drop(self._table)


class DigestIndex:
    """Runs of (digest, min_id, max_id, n), sorted by digest in files of disjoint ranges, in the shared folder."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        #: Path, level and filter of each run, oldest first.
        self.runs: list[tuple[str, int, DigestFilter]] = []

    def _write(self, rows: DataFrame) -> tuple[str, DataFrame]:
        path = new_path(self.spark, "run")
        rows.repartitionByRange("digest").sortWithinPartitions("digest").write.options(**RUN_FILTERS).parquet(path)
        return path, self._read(path)

    def _read(self, path: str) -> DataFrame:
        return self.spark.read.schema(_RUN).parquet(path)

    def flush(self, memtable: DataFrame, alone: bool = False) -> DataFrame:
        """memtable: id, digest. Adds a run and gives the digests that are hits, staged unless no other memtable comes (alone)."""
        own = memtable.groupBy("digest").agg(F.min("id").alias("min_id"), F.max("id").alias("max_id"), F.count(F.lit(1)).alias("n"))
        path, run = self._write(own)
        hits = run.filter("n > 1").select("digest")
        for _, _, known in self.runs:
            hits = hits.unionByName(known.probe(run.select("digest")))
        if not alone:
            hits = stage(hits.distinct(), "hits")
        self.runs.append((path, 0, DigestFilter(run)))
        while len(self.runs) >= FAN and len({level for _, level, _ in self.runs[-FAN:]}) == 1:
            self._merge(FAN)
        return hits

    def _merge(self, count: int) -> None:
        """Merge the newest `count` runs into one of the next level. Their ranges are dealt anew, and one exchange serves merging and sorting."""
        newest = self.runs[-count:]
        merged = None
        for path, _, _ in newest:
            merged = self._read(path) if merged is None else merged.unionByName(self._read(path))
        path = new_path(self.spark, "run")
        (
            merged.repartitionByRange("digest")
            .groupBy("digest")
            .agg(F.min("min_id").alias("min_id"), F.max("max_id").alias("max_id"), F.sum("n").alias("n"))
            .sortWithinPartitions("digest")
            .write.options(**RUN_FILTERS)
            .parquet(path)
        )
        run = self._read(path)
        for old, _, known in newest:
            delete(self.spark, old)
            known.drop()
        self.runs[-count:] = [(path, max(level for _, level, _ in newest) + 1, DigestFilter(run))]

    def groups_of(self, hits: DataFrame | None) -> DataFrame:
        """digest, min_id, max_id, n of the digests that occur more than once; all of them are among the hits, or any may be where no memtable came after another."""
        runs = [self._read(path) for path, _, _ in self.runs]
        if len(runs) == 1 and hits is None:
            return runs[0].filter("n > 1")
        entries = runs[0]
        for run in runs[1:]:
            entries = entries.unionByName(run)
        # What the filter passes by chance is alone, and goes by its count.
        known = DigestFilter(hits).probe(entries)
        return known.groupBy("digest").agg(F.min("min_id").alias("min_id"), F.max("max_id").alias("max_id"), F.sum("n").alias("n")).filter("n > 1")

    def compact(self) -> DataFrame:
        """Merge all runs into one."""
        if not self.runs:
            return self.spark.createDataFrame([], _RUN)
        if len(self.runs) > 1:
            self._merge(len(self.runs))
        return self._read(self.runs[0][0])


def memtable_size(rows: int) -> int:
    return min(MEMTABLE_ROWS, max(LEAST_ROWS, -(-rows // MEMTABLES)))


def exact_dedup(docs: DataFrame, digest=sha256, id_col: str = "doc_id", text_col: str = "text", memtable_rows: int | None = None) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256. `digest` may be any function of the text."""
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    base = docs.select(F.coalesce(docs[id_col].cast("bigint"), F.lit(_NONE)).alias("id"), text.alias("text"))
    digests = stage(base.select("id", digest(F.col("text")).alias("digest"), sha256(F.col("text")).alias("sha")), "digests")
    index = DigestIndex(docs.sparkSession)
    rows = digests.count()
    memtables = max(1, -(-rows // (memtable_rows or memtable_size(rows))))
    found = None
    for k in range(memtables):
        slot = F.pmod(F.xxhash64("id"), F.lit(memtables))
        hits = index.flush(digests.filter(slot == k).select("id", "digest") if memtables > 1 else digests.select("id", "digest"), alone=memtables == 1)
        found = hits if found is None else found.unionByName(hits)
    hits = stage(index.groups_of(None if memtables == 1 else stage(found.distinct(), "hits")), "hits")

    # Only rows whose identifier the filter passes carry their text any further; first the text that stays, by digest and
    # identifier, so that a large group of copies is not gathered; a filter of these identifiers keeps the copies of all but the smallest tables from moving.
    known = DigestFilter(digests.select("id", "digest").join(hits.select("digest"), "digest", "left_semi").select("id"), hits.agg(F.sum("n")).first()[0] or 0, "id")
    maybe = known.probe(base).withColumn("digest", digest(F.col("text")))
    staying = DigestFilter(hits.select(F.col("max_id").alias("id")), column="id") if memtables > 1 else known
    stays = staying.probe(base).withColumn("digest", digest(F.col("text"))).join(hits.select("digest", F.col("max_id").alias("id")), ["digest", "id"])
    kept_text = stage(stays.groupBy("digest").agg(F.min("text").alias("kept_text")), "kept")
    # One join on the digest, between two scans: Spark can split a digest with many rows.
    odd = stage(maybe.join(kept_text, "digest").filter("text <> kept_text").select("id", "digest", F.col("text").alias("odd")), "odd")
    drop(kept_text)
    known.drop()
    staying.drop()

    # A collision splits its digest: the odd rows group by their bytes, the others no longer count them.
    odd_groups = odd.groupBy("digest", "odd").agg(F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("n"))
    odd_rows = odd.join(odd_groups, ["digest", "odd"]).select("id", "keep_id", "n", sha256(F.col("odd")).alias("sha"))
    less = odd.groupBy("digest").agg(F.count(F.lit(1)).alias("less"))
    groups = stage(
        hits.join(less, "digest", "left").select("digest", F.col("max_id").alias("keep_id"), (F.col("n") - F.coalesce("less", F.lit(0))).alias("n"), F.col("less").isNotNull().alias("split")),
        "groups",
    )
    # Rows without a hit are alone; the join carries the hits' groups only.
    plain = digests.join(groups, "digest", "left").select(
        "id", "digest", "sha", F.coalesce("keep_id", "id").alias("keep_id"), F.coalesce("n", F.lit(1).cast("bigint")).alias("n"), F.coalesce("split", F.lit(False)).alias("split")
    )
    gone = odd.select(F.col("digest").alias("odd_digest"), F.col("id").alias("odd_id"), sha256(F.col("odd")).alias("odd_sha")).distinct()
    same = (F.col("id") == F.col("odd_id")) & (F.col("digest") == F.col("odd_digest")) & (F.col("sha") == F.col("odd_sha"))
    whole = plain.filter("not split").unionByName(plain.filter("split").join(gone, same, "left_anti"))
    out = whole.select("id", "keep_id", "n", "sha").unionByName(odd_rows)
    shown = lambda c: F.when(F.col(c) != _NONE, F.col(c))
    return out.select(
        shown("id").alias("doc_id"),
        shown("keep_id").alias("keep_id"),
        F.col("n").alias("group_size"),
        (F.col("id") == F.col("keep_id")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )
