"""Merkle dataset manifest: a root over all documents, and an inclusion proof for each.

Leaves are hashes of a document's fields, each led by its byte count. Per language the
leaves ascend by identifier; every FAN consecutive nodes (the last run may be shorter)
become the hash of their hex digests, until one is left: the subroot. The subroots, by
language, become the root in the same way.

Places come from one range partitioning by (language, identifier, leaf): a row's place
is its number in its partition and the counts of the partitions before. Places cut
into aligned buckets of SPAN = FAN ** LEVELS leaves: a bucket is a whole subtree, so
each is hashed by itself, in an executor, by DuckDB: a level is one query, an ordered
string_agg of each run and its sha256. Spark deals whole buckets to tasks as Arrow
batches, combines the buckets' roots (they are the leaves of the next climb, so a
climb of 4 levels divides the rows by 4096), and joins each bucket with the part of its
proof that lies outside of it. A second pass over the buckets then gives each leaf its
proof and the root that folds from its own, possibly tampered leaf. No task holds more
than the buckets at hand; the driver receives the root alone.

Defined results: null fields count as `-`; a null language is a group of its own, below
the others; a null identifier lies below the others of its language and is not
tampered with; rows that repeat an identifier are ordered by their leaves and each
has a place; equal rows have interchangeable places; a document that is alone is its
own subroot, and where it is the only language, the root, with a proof of no sibling;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, drop, stage

FAN, LEVELS = 8, 4
SPAN = FAN**LEVELS
#: Leaves of whole buckets that DuckDB reads at a time, at least (and one bucket more at most).
ROWS = 2 * SPAN
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaves(docs: DataFrame) -> DataFrame:
    """key (of the language), doc_id, leaf, tampered: the leaf of the row, and of the row as tampered with."""
    own = {c: docs[c] for c in FIELDS}
    digest = lambda fields: F.sha2(F.concat(*[field(fields[c]) for c in FIELDS]), 256)
    hit = F.coalesce(F.crc32(docs["doc_id"].cast("string").cast("binary")) % 3 == 0, F.lit(False))
    changed = digest(own | {"text": F.translate(docs["text"].cast("string"), UPPER, LOWER)})
    key = F.coalesce(F.concat(F.lit("="), docs["lang"].cast("string")), F.lit(""))
    return docs.select(key.alias("key"), docs["doc_id"].cast("bigint").alias("doc_id"), digest(own).alias("leaf"), F.when(hit, changed).alias("changed")).select(
        "key", "doc_id", "leaf", F.coalesce("changed", "leaf").alias("tampered")
    )


def placed(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows (staged, with a key) with pos, the place within the key by `order`, and n, the key's rows."""
    ordered = rows.repartitionByRange("key", *order).sortWithinPartitions("key", *order)
    # Staged, so that a partition's numbers stay what they are: partition in the upper bits, row in the lower.
    numbered = stage(ordered.withColumn("seq", F.monotonically_increasing_id()), "placed")
    part = F.shiftright("seq", 33)
    counts = numbered.groupBy("key", part.alias("part")).agg(F.count(F.lit(1)).alias("k"), F.min("seq").alias("first"))
    # A row for each partition that a key reaches.
    upto = F.sum("k").over(Window.partitionBy("key").orderBy("part"))
    offsets = stage(counts.select("key", "part", "first", (upto - F.col("k")).alias("before"), F.sum("k").over(Window.partitionBy("key")).alias("n")), "offsets")
    joined = numbered.withColumn("part", part).join(offsets, ["key", "part"])
    return joined.withColumn("pos", F.col("before") + F.col("seq") - F.col("first")).drop("seq", "part", "first", "before")


def _depth(n: Column) -> Column:
    """Levels of a bucket in a tree of n nodes: as many as its subtree has, at most LEVELS."""
    out = F.lit(LEVELS)
    for levels in range(LEVELS - 1, -1, -1):
        out = F.when(n <= FAN**levels, levels).otherwise(out)
    return out


def bucketed(nodes: DataFrame) -> DataFrame:
    """Nodes (key, pos, n, h) with bucket, p (the place in it) and depth."""
    return nodes.withColumns({"bucket": F.floor(F.col("pos") / SPAN).cast("bigint"), "p": F.col("pos") % SPAN, "depth": _depth(F.col("n"))})


class Levels:
    """The levels of whole buckets, each one DuckDB query over the one below."""

    def __init__(self):
        import duckdb

        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "256MB"})
        self.db.execute("SET enable_progress_bar = false")

    def climb(self, rows: pa.Table) -> int:
        """rows: b, p, depth, h. Tables n0, n1, .. of nodes and r0, r1, .. of runs; returns the number of levels."""
        self.db.register("nodes_in", rows)
        self.db.execute("CREATE OR REPLACE TEMP TABLE n0 AS SELECT b, p, depth, h FROM nodes_in WHERE p >= 0")
        levels = self.db.execute("SELECT coalesce(max(depth), 0) FROM n0").fetchall()[0][0]
        for k in range(levels):
            self.db.execute(f"CREATE OR REPLACE TEMP TABLE r{k} AS SELECT b, p // {FAN} AS p, depth, string_agg(h, '' ORDER BY p) AS s FROM n{k} WHERE depth > {k} GROUP BY b, p // {FAN}, depth")
            self.db.execute(f"CREATE OR REPLACE TEMP TABLE n{k + 1} AS SELECT b, p, depth, sha256(s) AS h FROM r{k}")
        return levels

    def roots(self, rows: pa.Table) -> pa.Table:
        """b, h: each bucket's root."""
        levels = self.climb(rows)
        return self.db.sql(" UNION ALL ".join(f"SELECT b, h FROM n{k} WHERE depth = {k}" for k in range(levels + 1))).to_arrow_table()

    def paths(self, rows: pa.Table) -> pa.Table:
        """row (the number in rows), lefts, rights: the siblings on both sides of each node's path, from its own run to the bucket's root."""
        levels = self.climb(rows)
        self.db.execute("CREATE OR REPLACE TEMP TABLE w AS SELECT row, b, p, [] :: VARCHAR[] AS lefts, [] :: VARCHAR[] AS rights FROM nodes_in WHERE p >= 0")
        for k in range(levels):
            at = f"64 * (w.p // {FAN**k} % {FAN})"
            self.db.execute(
                f"CREATE OR REPLACE TEMP TABLE w AS SELECT w.row, w.b, w.p, CASE WHEN s IS NULL THEN lefts ELSE list_append(lefts, s[1 : {at}]) END AS lefts, "
                f"CASE WHEN s IS NULL THEN rights ELSE list_append(rights, s[{at} + 65 :]) END AS rights FROM w LEFT JOIN r{k} AS r ON r.b = w.b AND r.p = w.p // {FAN ** (k + 1)}"
            )
        return self.db.sql("SELECT row, lefts, rights FROM w ORDER BY row").to_arrow_table()

    def outer_paths(self, rows: pa.Table) -> pa.Table:
        """row, lefts, rights from each node to the root: its bucket's outer lists (the row of p = -1) follow its own."""
        self.db.register("inner_paths", self.paths(rows))
        return self.db.sql(
            "SELECT i.row, i.lefts || o.lefts AS lefts, i.rights || o.rights AS rights FROM inner_paths AS i JOIN nodes_in AS n ON n.row = i.row JOIN nodes_in AS o ON o.b = n.b AND o.p = -1 ORDER BY i.row"
        ).to_arrow_table()

    def proofs(self, rows: pa.Table) -> pa.Table:
        """row, proof_sha256, folded_root: the hash of all siblings, and what the tampered leaf and they fold to."""
        self.db.register("inner_paths", self.paths(rows))
        self.db.execute(
            "CREATE OR REPLACE TEMP TABLE f AS SELECT i.row, i.lefts || o.lefts AS lefts, i.rights || o.rights AS rights, n.tampered AS cur "
            "FROM inner_paths AS i JOIN nodes_in AS n ON n.row = i.row JOIN nodes_in AS o ON o.b = n.b AND o.p = -1"
        )
        steps = self.db.execute("SELECT coalesce(max(len(lefts)), 0) FROM f").fetchall()[0][0]
        self.db.execute("CREATE OR REPLACE TEMP TABLE f AS SELECT *, sha256(list_aggregate(list_transform(lefts, lambda x, i: x || rights[i]), 'string_agg', '')) AS proof FROM f WHERE len(lefts) > 0 UNION ALL SELECT *, sha256('') FROM f WHERE len(lefts) = 0")
        for k in range(1, steps + 1):
            self.db.execute(f"CREATE OR REPLACE TEMP TABLE f AS SELECT row, lefts, rights, CASE WHEN len(lefts) >= {k} THEN sha256(lefts[{k}] || cur || rights[{k}]) ELSE cur END AS cur, proof FROM f")
        return self.db.sql("SELECT row, proof AS proof_sha256, cur AS folded_root FROM f ORDER BY row").to_arrow_table()


def whole_buckets(batches):
    """Tables of whole buckets, with b and row added, from batches sorted by (key, bucket)."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            rows += batch.num_rows
        if rows < ROWS:
            continue
        table = _numbered(pa.Table.from_batches(held))
        # The last bucket may go on in the next batch.
        cut = int(table["b"].to_numpy().searchsorted(table["b"][-1].as_py()))
        if cut:
            yield table.slice(0, cut)
            held = table.slice(cut).drop_columns(["b", "row"]).to_batches()
            rows = table.num_rows - cut
    if held:
        yield _numbered(pa.Table.from_batches(held))


def _numbered(table: pa.Table) -> pa.Table:
    """With b, the number of the bucket in the table, and row."""
    table = table.combine_chunks()
    new = np.zeros(table.num_rows, np.int64)
    if table.num_rows > 1:
        differs = lambda c: pc.not_equal(table[c].slice(1), table[c].slice(0, table.num_rows - 1)).to_numpy()
        new[1:] = differs("key") | differs("bucket")
    return table.append_column("b", pa.array(np.cumsum(new))).append_column("row", pa.array(np.arange(table.num_rows)))


def dealt(nodes: DataFrame) -> DataFrame:
    return nodes.repartition("key", "bucket").sortWithinPartitions("key", "bucket", "p")


def bucket_roots(nodes: DataFrame) -> DataFrame:
    """key, bucket, n, h: the root of each bucket of nodes (key, pos, n, h)."""

    def run(batches):
        levels = Levels()
        for table in whole_buckets(batches):
            found = {r["b"]: r["h"] for r in levels.roots(table).to_pylist()}
            first = table.filter(pc.equal(table["p"], 0))
            out = first.select(["key", "bucket", "n"]).append_column("h", pa.array([found[b] for b in first["b"].to_pylist()], pa.string()))
            yield from out.combine_chunks().to_batches()

    return dealt(bucketed(nodes).select("key", "bucket", "p", "depth", "n", "h")).mapInArrow(run, "key string, bucket bigint, n bigint, h string")


def climb(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """The nodes of every climb, lowest first, and one root for each key: key, h."""
    climbs, most = [nodes], nodes.agg(F.max("n")).first()[0]
    roots = stage(bucket_roots(nodes), "roots")
    while most > SPAN:
        nodes = roots.select("key", F.col("bucket").alias("pos"), F.ceil(F.col("n") / SPAN).cast("bigint").alias("n"), "h")
        climbs.append(nodes)
        most = -(-most // SPAN)
        roots = stage(bucket_roots(nodes), "roots")
    return climbs, roots.select("key", "h")


_LISTS = "lefts array<string>, rights array<string>"


def outer_of_buckets(nodes: DataFrame, outer: DataFrame) -> DataFrame:
    """For nodes of one climb and what lies outside of their buckets (key, bucket, lefts, rights), the same for the nodes, as buckets of the climb below."""
    rows = bucketed(nodes).select("key", "bucket", "p", "pos", "depth", "h").unionByName(
        outer.select("key", "bucket", F.lit(-1).cast("bigint").alias("p"), "lefts", "rights"), allowMissingColumns=True
    )

    def run(batches):
        levels = Levels()
        for table in whole_buckets(batches):
            found = levels.outer_paths(table)
            own = table.take(found["row"])
            yield from pa.table([own["key"], own["pos"], found["lefts"], found["rights"]], names=["key", "bucket", "lefts", "rights"]).combine_chunks().to_batches()

    return dealt(rows).mapInArrow(run, f"key string, bucket bigint, {_LISTS}")


def descend(climbs: list[DataFrame], outer: DataFrame) -> DataFrame:
    """From what lies outside of the topmost buckets to what lies outside of the lowest."""
    for nodes in reversed(climbs[1:]):
        outer = stage(outer_of_buckets(nodes, outer), "outer")
    return outer


def merkle_manifest(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified."""
    spark = docs.sparkSession
    bounded_batches(spark)
    hashed = stage(leaves(docs), "leaves")
    rows = stage(placed(hashed, ["doc_id", "leaf"]), "rows")
    drop(hashed)
    names = "doc_id bigint, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    if rows.isEmpty():
        return spark.createDataFrame([], names)
    climbs, subroots = climb(rows.withColumnRenamed("leaf", "h").select("key", "pos", "n", "h"))

    # The languages are the leaves of the upper tree, all under one key.
    tops = stage(subroots.select(F.lit("").alias("key"), F.col("key").alias("lang_key"), "h"), "tops")
    langs = stage(placed(tops, ["lang_key"]), "langs")
    lang_climbs, top = climb(langs.select("key", "pos", "n", "h"))
    root = top.first().h
    none = F.array().cast("array<string>")
    over = descend(lang_climbs, spark.range(1).select(F.lit("").alias("key"), F.lit(0).cast("bigint").alias("bucket"), none.alias("lefts"), none.alias("rights")))
    of_lang = outer_of_buckets(langs.select("key", "pos", "n", "h"), over).select(F.col("bucket").alias("pos"), "lefts", "rights")
    outer = langs.join(of_lang, "pos").select(F.col("lang_key").alias("key"), F.lit(0).cast("bigint").alias("bucket"), "lefts", "rights")
    outer = descend(climbs, stage(outer, "outer")).join(subroots.withColumnRenamed("h", "subroot"), "key")

    work = bucketed(rows).select("key", "bucket", "p", "depth", "doc_id", F.col("leaf").alias("h"), "tampered").unionByName(
        outer.select("key", "bucket", F.lit(-1).cast("bigint").alias("p"), "lefts", "rights", "subroot"), allowMissingColumns=True
    )

    def run(batches):
        levels = Levels()
        for table in whole_buckets(batches):
            found = levels.proofs(table)
            own = table.take(found["row"])
            # A bucket's rows follow its outer row, which has the subroot.
            heads = table.filter(pc.equal(table["p"], -1))
            subroot = heads["subroot"].take(own["b"])
            columns = [own["doc_id"], own["h"], subroot, found["proof_sha256"], found["folded_root"]]
            yield from pa.table(columns, names=["doc_id", "leaf", "subroot", "proof_sha256", "folded_root"]).combine_chunks().to_batches()

    proved = dealt(work).mapInArrow(run, "doc_id bigint, leaf string, subroot string, proof_sha256 string, folded_root string")
    return proved.select("doc_id", "leaf", "subroot", F.lit(root).alias("root"), "proof_sha256", "folded_root", (F.col("folded_root") == root).alias("verified"))
