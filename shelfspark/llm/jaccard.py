"""Exact n-gram Jaccard join with adaptive multi-match prefixes.

A document's set is its distinct word shingles, as 64-bit hashes. Two documents
link when 100 * |intersection| >= percent * |union|. The result is one class
per document (the smallest identifier that links reach) and never the pairs of
a class.

1. Shingle frequencies over all documents: tasks deal shingles of a chunk of
   documents out to buckets as packed arrays; a bucket counts its shingles and
   answers each chunk with those that occur more than once. A shingle of many
   documents of a chunk goes out once, with their number, so that a bucket's
   size follows the chunks and not the documents of its commonest shingle.
   Chunks and buckets hold a million shingles each, and beyond 15 billion
   shingles (some 100 GB of text) as many as the root of 64 times their number,
   so that a packed array keeps 64 shingles on average: 32 million at 100 TB.
2. Documents of the same word sequence (by a digest of it) fall into one
   representative. Copies were counted, which moves all of their shingles back
   in the order and finds no fewer links.
3. Prefixes: shingles are ordered by rising frequency. With o = ceil(percent *
   n / 100) the first n - o + l shingles of a document share at least l with
   the like prefix of any document it links to. Each document picks its own l
   from 1 to MOST_MATCHES by estimated cost: entries scanned, and candidates
   left when l matches are asked for. A pair must share min(l, l') entries.
   Shingles that occur once lie in front and find nobody, so that a document
   whose prefix they fill is done.
4. Candidates: of entries with at most FEW documents, all pairs; of the others,
   each document with the entry's smallest one. Pairs are verified in two
   rounds: first each document with its smallest candidate, then, after links
   are closed, the pairs whose classes still differ.
5. Entries with more documents whose classes still differ, or chains of such
   entries where that costs less, are dealt out by blocks of documents of about
   the same set size, as only those can link; each pair of blocks is one task
   group, which verifies by a matrix product what no class joins yet. A block
   holds BLOCK documents at most, and fewer where sets are large, so that it has
   BLOCK_SHINGLES shingles at most (or one document).
6. Classes: smallest labels along links, with pointer jumping.

Defined results: null text, or text without words, has an empty set, links with
nothing and is its own class; a text with fewer words than a shingle is one
shingle; a null identifier counts as the smallest one; rows that repeat an
identifier count as one document; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bit_filter, drop, passes, stage
from .textops import shingles

#: Shingles of a chunk, and mean shingles of a bucket, at least; and mean shingles of a chunk in a bucket, at least.
CHUNK = 1_000_000
PACKED = 64
#: Documents of a chunk that make a shingle common in it.
COMMON = 8
_MANY = 65_535
#: Rows of a chunk: its head is numbered from -1 down, its common shingles' owners from here down.
_SIDE = -(1 << 62)
MOST_MATCHES = 8
#: Bytes of text that a shingle is taken for in the choice of bucket numbers.
BYTES_A_WORD = 6
#: Cost of verifying one candidate, in entries scanned.
VERIFY_COST = 8.0
FEW = 8
BLOCK, BLOCK_SHINGLES = 128, 1 << 18
#: Entries of a token that meet its statistics in one task, about.
SALTED = 256
_NONE = -(1 << 63)


def _bytes(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass").lower()


def _expanded(batches):
    """Chunk heads as rows: id, n, signature."""
    for batch in batches:
        for ids, sizes, signatures in zip(batch.column("tokens"), batch.column("owners"), batch.column("times")):
            ids, data = np.frombuffer(ids.as_buffer(), np.int64), signatures.as_py()
            each = [data[i : i + 16] for i in range(0, len(data), 16)]
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.frombuffer(sizes.as_buffer(), np.int64)), pa.array(each, pa.binary())], names=["id", "n", "signature"])


def _dealt(width: int, bits: int, chunk: int = CHUNK):
    """Chunks of documents: for each bucket a part of its shingles' bits, with document numbers; under a negative number of its own the chunk's head: identifiers, set sizes and digests of the word sequences."""

    def run(batches):
        from pyspark import TaskContext

        at = TaskContext.get().partitionId() << 28
        ids, sets, signatures, held = [], [], [], 0

        def flush():
            nonlocal at, ids, sets, signatures, held
            sizes = np.array([len(s) for s in sets], np.int64)
            tokens = np.concatenate(sets)
            owners = np.repeat(np.arange(len(sets), dtype=np.uint16), sizes)
            order = np.argsort(tokens, kind="stable")
            # What travels of a shingle: its bucket's bits and the 32 after them.
            tokens, owners = tokens[order] >> np.uint64(32 - bits), owners[order]
            first = np.flatnonzero(np.concatenate(([True], tokens[1:] != tokens[:-1]))) if len(tokens) else np.empty(0, np.int64)
            runs = np.diff(np.append(first, len(tokens)))
            # A shingle of many documents here goes to its bucket once, with their number; its owners stay with the chunk.
            common = runs >= COMMON
            among = np.repeat(common, runs)
            side = (tokens[first[common]], runs[common].astype(np.int64), owners[among])
            keep = ~among
            keep[first[common]] = True
            weights = np.ones(len(tokens), np.uint16)
            weights[first[common]] = runs[common]
            owners[first[common]] = _MANY
            tokens, owners, weights = tokens[keep], owners[keep], weights[keep]
            edges = np.searchsorted(tokens >> np.uint64(32), np.arange((1 << bits) + 1, dtype=np.uint64))
            low = tokens.astype(np.uint32)
            full = [b for b in range(1 << bits) if edges[b] < edges[b + 1]]
            plain = [(weights[edges[b] : edges[b + 1]] == 1).all() for b in full]
            cut = lambda x: [x[edges[b] : edges[b + 1]].tobytes() for b in full]
            out = pa.RecordBatch.from_arrays(
                [
                    pa.array([-1 - at, _SIDE - at, *full], pa.int64()),
                    pa.array([at] * (len(full) + 2), pa.int64()),
                    pa.array([np.array(ids, np.int64).tobytes(), side[0].tobytes(), *cut(low)], pa.binary()),
                    pa.array([sizes.tobytes(), side[1].tobytes(), *cut(owners)], pa.binary()),
                    pa.array([b"".join(signatures), side[2].tobytes(), *[None if p else w for p, w in zip(plain, cut(weights))]], pa.binary()),
                ],
                names=["bucket", "chunk", "tokens", "owners", "times"],
            )
            at, ids, sets, signatures, held = at + 1, [], [], [], 0
            return out

        for batch in batches:
            for doc, x in zip(batch.column("id").to_pylist(), batch.column("text")):
                data = _bytes(x.as_py())
                s = shingles(data, width)
                ids.append(doc)
                sets.append(s)
                signatures.append(xxhash.xxh3_128_digest(b" ".join(data.split())))
                held += len(s)
                if held >= chunk or len(ids) >= 65_000:
                    yield flush()
        if ids:
            yield flush()

    return run


def _count_bucket(pdf: pd.DataFrame) -> pd.DataFrame:
    """Of one bucket, for each chunk the shingles that occur more than once, with their frequency. Heads pass."""
    if pdf["bucket"].iloc[0] < 0:
        return pdf[["chunk", "bucket", "tokens", "owners", "times"]]
    tokens = [np.frombuffer(x, np.uint32) for x in pdf["tokens"]]
    weights = [np.ones(len(t), np.uint16) if w is None else np.frombuffer(w, np.uint16) for t, w in zip(tokens, pdf["times"])]
    _, inverse = np.unique(np.concatenate(tokens), return_inverse=True)
    times = np.bincount(inverse, np.concatenate(weights))
    often = np.minimum(times, 65_535).astype(np.uint16)[inverse]
    out, at = [], 0
    for chunk, bucket, own, owners in zip(pdf["chunk"], pdf["bucket"], tokens, pdf["owners"]):
        here = often[at : at + len(own)]
        at += len(own)
        keep = here > 1
        if keep.any():
            out.append((chunk, bucket, own[keep].tobytes(), np.frombuffer(owners, np.uint16)[keep].tobytes(), here[keep].tobytes()))
    return pd.DataFrame(out, columns=["chunk", "bucket", "tokens", "owners", "times"])


def pick_matches(times: np.ndarray, first: int) -> int:
    """How many matches to ask for: times are frequencies in prefix order, first is the prefix length for one match."""
    upto = np.cumsum(times.astype(np.float64))
    best, chosen = None, 1
    for matches in range(1, MOST_MATCHES + 1):
        reach = min(first + matches - 1, len(times))
        if reach < matches:
            break
        scanned = upto[reach - 1]
        cost = scanned + VERIFY_COST * (scanned - reach) / matches
        if best is None or cost < best:
            best, chosen = cost, matches
        if first + matches - 1 >= len(times):
            break
    return chosen


def _prefixes(percent: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        head = pdf[(pdf["bucket"] < 0) & (pdf["bucket"] > _SIDE)].iloc[0]
        side = pdf[pdf["bucket"] <= _SIDE].iloc[0]
        ids, sizes = np.frombuffer(head["tokens"], np.int64), np.frombuffer(head["owners"], np.int64)
        rest = pdf[pdf["bucket"] >= 0]
        columns = ([], [], [], [], [])
        if len(rest):
            tokens = np.concatenate([(np.uint64(b) << np.uint64(32)) | np.frombuffer(x, np.uint32).astype(np.uint64) for b, x in zip(rest["bucket"], rest["tokens"])])
            owners = np.concatenate([np.frombuffer(x, np.uint16) for x in rest["owners"]])
            times = np.concatenate([np.frombuffer(x, np.uint16) for x in rest["times"]])
            # Shingles whose owners stayed here: one entry for each owner.
            many = owners == _MANY
            if many.any():
                held, runs = np.frombuffer(side["tokens"], np.uint64), np.frombuffer(side["owners"], np.int64)
                ends = np.cumsum(runs)
                order = np.argsort(tokens[many])
                asked, frequency = tokens[many][order], times[many][order]
                at = np.searchsorted(held, asked)
                width = runs[at]
                slots = np.arange(width.sum()) - np.repeat(np.cumsum(width) - width, width) + np.repeat(ends[at] - width, width)
                owners = np.concatenate([owners[~many], np.frombuffer(side["times"], np.uint16)[slots]])
                tokens = np.concatenate([tokens[~many], np.repeat(asked, width)])
                times = np.concatenate([times[~many], np.repeat(frequency, width)])
            order = np.lexsort((tokens, times, owners))
            tokens, owners, times = tokens[order], owners[order], times[order]
            edges = np.searchsorted(owners, np.arange(len(ids) + 1))
            for k in range(len(ids)):
                a, b, n = edges[k], edges[k + 1], int(sizes[k])
                # Shingles that occur once come first; what is left of the prefix lies among the others.
                first = n - (percent * n + 99) // 100 + 1 - (n - (b - a))
                if a == b or first < 1:
                    continue
                matches = pick_matches(times[a:b], first)
                reach = min(first + matches - 1, b - a)
                columns[0].append(tokens[a : a + reach].astype(np.int64))
                columns[1].append(np.full(reach, ids[k]))
                columns[2].append(np.full(reach, n))
                columns[3].append(np.full(reach, matches))
                columns[4].append(times[a : a + reach].astype(np.int64))
        return pd.DataFrame({c: np.concatenate(v) if v else np.empty(0, np.int64) for c, v in zip(("token", "id", "n", "matches", "times"), columns)})

    return run


def _links(percent: int):
    def run(batches):
        for batch in batches:
            left, right = [], []
            for a, b, x, y in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), batch.column("set_a"), batch.column("set_b")):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                at = np.searchsorted(y, x)
                shared = int((y[np.minimum(at, len(y) - 1)] == x).sum())
                if 100 * shared >= percent * (len(x) + len(y) - shared):
                    left.append(a)
                    right.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])

    return run


def block_links(ids: np.ndarray, sets: list[np.ndarray], labels: np.ndarray, side: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links that join classes, between documents of side 0 and 1, or among all where there is one side. Enough to close the classes, not every pair."""
    n = len(ids)
    values, where = np.unique(np.concatenate(sets), return_inverse=True)
    rows = np.repeat(np.arange(n), [len(s) for s in sets])
    times = np.bincount(where, minlength=len(values))
    keep = times[where] > 1
    slot = np.cumsum(times > 1) - 1
    rows, where = rows[keep], slot[where[keep]]
    width = int((times > 1).sum())
    shared = np.zeros((n, n), np.float32)
    for at in range(0, width, 4096):
        part = (where >= at) & (where < at + 4096)
        matrix = np.zeros((n, min(4096, width - at)), np.float32)
        matrix[rows[part], where[part] - at] = 1
        shared += matrix @ matrix.T
    sizes = np.array([len(s) for s in sets], np.float64)
    linked = 100 * shared >= percent * (sizes[:, None] + sizes[None, :] - shared)
    linked &= labels[:, None] != labels[None, :]
    if side.any() and not side.all():
        linked &= side[:, None] != side[None, :]
    root = {x: x for x in labels.tolist()}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    for i, j in zip(*np.nonzero(np.triu(linked, 1))):
        p, q = find(int(labels[i])), find(int(labels[j]))
        if p != q:
            root[max(p, q)] = min(p, q)
            out.append((int(ids[i]), int(ids[j])))
    return out


def _block_group(percent: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates(["id"])
        if pdf["label"].nunique() < 2:
            return pd.DataFrame({"a": np.empty(0, np.int64), "b": np.empty(0, np.int64)})
        side = pdf["upper"].to_numpy().astype(int)
        found = block_links(pdf["id"].to_numpy(), [np.frombuffer(x, np.uint64) for x in pdf["tokens"]], pdf["label"].to_numpy(), side, percent)
        return pd.DataFrame(found, columns=["a", "b"]).astype(np.int64)

    return run


def classes(links: DataFrame) -> DataFrame:
    """links: a, b. One row for each document in a link: id, label (the smallest identifier that links reach)."""
    both = stage(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a != b").distinct(), "links")
    labels = stage(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("label")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("id", "b"), "b").groupBy("a").agg(F.min("label").alias("near"))
        step = labels.join(near, labels["id"] == near["a"], "left").select("id", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        step = stage(step, "labels")
        # The label's own label, for chains to halve.
        jump = step.select(F.col("id").alias("label"), F.col("label").alias("far"))
        following = stage(step.join(jump, "label", "left").select("id", "was", F.least("label", F.coalesce("far", "label")).alias("label")), "labels")
        changed = following.filter("was != label").limit(1).count()
        drop(step, labels)
        labels = following.select("id", "label")
        labels.staged_path = following.staged_path
        if not changed:
            drop(both)
            return labels


def _settle(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished steps."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()


def near_classes(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id of every row."""
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(docs[id_col].cast("bigint"), F.lit(_NONE)).alias("id"), docs[text_col].cast("string").alias("text"))
    # Bucket numbers follow the number of shingles, as the bytes of text tell it.
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    each = max(CHUNK, int((PACKED * (size // BYTES_A_WORD)) ** 0.5))
    bits = max(6, min(28, (size // BYTES_A_WORD // each).bit_length()))
    schema = "bucket bigint, chunk bigint, tokens binary, owners binary, times binary"
    dealt = rows.mapInArrow(_dealt(width, bits, each), schema)
    answers = stage(dealt.groupBy("bucket").applyInPandas(_count_bucket, "chunk bigint, bucket bigint, tokens binary, owners binary, times binary"), "answers")
    _settle(spark)
    profiles = stage(answers.filter((F.col("bucket") < 0) & (F.col("bucket") > _SIDE)).mapInArrow(_expanded, "id bigint, n bigint, signature binary"), "profiles")
    firsts = stage(profiles.filter("n > 0").groupBy("signature").agg(F.min("id").alias("first")), "firsts")
    # Copies were counted, which only moves their shingles back in the order; their entries go here.
    copies = profiles.join(firsts, "signature").filter("id != first").select("id")
    entries = stage(answers.groupBy("chunk").applyInPandas(_prefixes(percent), "token bigint, id bigint, n bigint, matches bigint, times bigint").join(copies, "id", "left_anti"), "entries")
    drop(answers)
    _settle(spark)

    # An entry knows how often its token occurs at most, and so over how many salts its entries are dealt.
    salts = F.floor(F.col("times") / SALTED).cast("int") + 1
    stats = entries.groupBy("token").agg(F.count(F.lit(1)).alias("m"), F.min("id").alias("hub"), F.first(salts).alias("salts")).filter("m > 1")
    stats = stage(stats.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts"), "stats")
    salted = entries.withColumn("salt", F.pmod(F.xxhash64("id"), salts).cast("int")).drop("times")
    sized = stage(salted.join(stats, ["token", "salt"]), "sized")
    drop(entries, stats)
    fits = lambda x, y: 100 * F.least(x, y) >= percent * F.greatest(x, y)
    few = sized.filter(F.col("m") <= FEW)
    left = few.select("token", F.col("id").alias("a"), F.col("n").alias("na"), F.col("matches").alias("la"))
    right = few.select("token", F.col("id").alias("b"), F.col("n").alias("nb"), F.col("matches").alias("lb"))
    paired = left.join(right, "token").filter((F.col("a") < F.col("b")) & fits(F.col("na"), F.col("nb")))
    counted = paired.groupBy("a", "b").agg(F.count(F.lit(1)).alias("c"), F.min(F.least("la", "lb")).alias("need")).filter("c >= need").select("a", "b")
    hubs = sized.filter((F.col("m") > FEW) & (F.col("id") != F.col("hub"))).select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct()
    pairs = stage(counted.unionByName(hubs).distinct(), "pairs")

    # Sets of the documents that some candidate concerns.
    asked = sized.select("id").distinct()

    wanted = spark.sparkContext.broadcast(bit_filter(asked))

    def packed(batches):
        for batch in batches:
            ids = batch.column("id").to_numpy()
            at = np.flatnonzero(passes(wanted.value, ids))
            sets = [shingles(_bytes(batch.column("text")[i].as_py()), width).tobytes() for i in at.tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(sets, pa.binary())], names=["id", "tokens"])

    sets = stage(rows.mapInArrow(packed, "id bigint, tokens binary").join(asked, "id", "left_semi"), "sets")

    def verified(some: DataFrame, label: str) -> DataFrame:
        joined = some.join(sets.select(F.col("id").alias("a"), F.col("tokens").alias("set_a")), "a").join(sets.select(F.col("id").alias("b"), F.col("tokens").alias("set_b")), "b")
        size = lambda c: F.octet_length(c)
        joined = joined.filter((size("set_a") > 0) & (size("set_b") > 0) & fits(size("set_a"), size("set_b")))
        return stage(joined.select("a", "b", "set_a", "set_b").mapInArrow(_links(percent), "a bigint, b bigint"), label)

    nearest = pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
    links = verified(nearest, "links1")
    labels = classes(links)
    _settle(spark)

    def with_labels(some: DataFrame, column: str) -> DataFrame:
        named = labels.select(F.col("id").alias(column), F.col("label").alias(f"label_{column}"))
        return some.join(named, column, "left").withColumn(f"label_{column}", F.coalesce(f"label_{column}", column))

    open_pairs = with_labels(with_labels(pairs.join(nearest, ["a", "b"], "left_anti"), "a"), "b").filter("label_a != label_b").select("a", "b")
    more = verified(open_pairs, "links2")
    links = stage(links.unionByName(more), "links")
    drop(more, pairs)
    old, labels = labels, classes(links)
    drop(old)
    _settle(spark)

    # Entries of many documents, where more than one class is left: pairs of blocks. Entries that chain the same
    # documents together are dealt as one group where that means fewer comparisons.
    many = with_labels(sized.filter(F.col("m") > FEW), "id")
    mixed = many.groupBy("token").agg(F.min("label_id").alias("low_label"), F.max("label_id").alias("high_label"), F.max("salt").alias("last")).filter("low_label != high_label")
    # The salts of a token go on from 0 to the last that it has; those between that hold nothing do no harm.
    mixed = mixed.select("token", F.explode(F.sequence(F.lit(0), F.col("last"))).alias("salt"))
    left_over = stage(many.join(mixed, ["token", "salt"], "left_semi").select("token", "salt", "id", "n", "m", "hub", F.col("label_id").alias("label")), "open")
    chained = classes(left_over.select(F.col("hub").alias("a"), F.col("id").alias("b"))).select("id", F.col("label").alias("chain"))
    each = left_over.select("id", "n", "label").distinct().join(chained, "id")
    alone = left_over.groupBy("token").agg(F.max("m").alias("m"), F.min("hub").alias("id"), F.max("salt").alias("last")).join(chained, "id")
    costs = alone.groupBy("chain").agg(F.sum(F.col("m") * F.col("m")).alias("cost"))
    sizes = each.groupBy("chain").agg(F.count(F.lit(1)).alias("size"))
    chains = stage(sizes.join(costs, "chain").withColumn("whole", F.col("size") * F.col("size") <= F.col("cost")).select("chain", "whole"), "chains")
    as_chain = each.join(chains.filter("whole"), "chain").select("whole", F.col("chain").alias("unit"), "id", "n", "label")
    split = alone.join(chains.filter("not whole"), "chain").select("token", F.explode(F.sequence(F.lit(0), F.col("last"))).alias("salt"))
    by_entry = left_over.join(split, ["token", "salt"]).select(F.lit(False).alias("whole"), F.col("token").alias("unit"), "id", "n", "label")
    # Classes of set size, each wider than a link can span: documents link within a class or to the next one.
    ratio = max(0.01, math.log(100 / percent) + 1e-9)
    units = stage(as_chain.unionByName(by_entry).withColumn("band", F.floor(F.log("n") / ratio).cast("int")), "units")
    room = F.greatest(F.lit(1.0), F.least(F.lit(float(BLOCK)), F.lit(float(BLOCK_SHINGLES)) / F.exp((F.col("band") + 1) * ratio)))
    bands = units.groupBy("whole", "unit", "band").agg(F.count(F.lit(1)).alias("size")).withColumn("blocks", F.ceil(F.col("size") / room).cast("int"))
    above = bands.select("whole", "unit", (F.col("band") - 1).alias("band"), F.col("blocks").alias("above"))
    below = bands.select("whole", "unit", (F.col("band") + 1).alias("band"), F.col("blocks").alias("below"))
    key = ["whole", "unit", "band"]
    bands = stage(bands.join(above, key, "left").join(below, key, "left").fillna(0, ["above", "below"]), "bands")
    own = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    others = lambda count, step: F.transform(F.sequence(F.lit(0), F.col(count) - 1), lambda k: F.struct((F.col("band") + step).alias("band"), k.alias("block")))
    some = lambda count, step: F.when(F.col(count) > 0, others(count, step)).otherwise(F.array().cast("array<struct<band:int,block:int>>"))
    dealt_blocks = (
        units.join(bands, key)
        .withColumn("own", F.struct("band", own.alias("block")))
        .withColumn("other", F.explode(F.concat(some("below", -1), some("blocks", 0), some("above", 1))))
        .select("whole", "unit", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), (F.col("own") > F.col("other")).alias("upper"), "id", "label")
    )
    block_rows = dealt_blocks.join(sets, "id")
    found = block_rows.groupBy("whole", "unit", "low", "high").applyInPandas(_block_group(percent), "a bigint, b bigint")
    links = stage(links.unionByName(found.distinct()), "links")
    drop(sized, sets, left_over, chains, units, bands)
    old, labels = labels, classes(links)
    drop(old, links)
    _settle(spark)

    named = profiles.join(firsts, "signature", "left").withColumn("first", F.when(F.col("n") > 0, F.col("first")).otherwise(F.col("id")))
    found = labels.select(F.col("id").alias("first"), "label")
    out = named.join(found, "first", "left").select("id", "n", F.coalesce("label", "first").alias("component"))
    shown = lambda c: F.when(F.col(c) == _NONE, None).otherwise(F.col(c))
    return out.select(shown("id").alias("doc_id"), F.col("n").alias("n_shingles"), shown("component").alias("component_id"))


def near_filter(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """docs with one document of each class left: that with the smallest identifier. Rows that repeat its identifier stay too."""
    found = near_classes(docs, width, percent)
    gone = stage(found.filter(~F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("gone_id")).distinct(), "gone")
    return docs.join(gone, docs["doc_id"].eqNullSafe(gone["gone_id"]), "left_anti")
