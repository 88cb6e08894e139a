"""Vector code compression: four codebooks, learnt on the distinct parts of all vectors.

A vector's components become the integers floor(1024 * x), and the vector four equal
consecutive parts. Equal parts of a position fold into one row with its weight; the
rounds of Lloyd's algorithm read these rows only. Each round assigns every distinct
part to the nearest entry of its position's codebook (integer arithmetic, ties to the
lower index), sums parts by entry, with their weights, inside each task, and replaces
the entries by floor(sum / count). The last assignment's codes and errors are joined
back to the vectors by position and part. Parts (and labels) that hold more than
1 / HEAVY of all rows are at most 4 * HEAVY rows of their own, which are broadcast;
all others meet in a shuffled join, so no task gathers the copies of one vector.

What is held in one place is bounded: the codebooks (4 * ENTRIES entries) in the
driver and in each task, and one Arrow batch.

Defined results: vectors that are null or hold a null or non-finite component are
dropped, and so are those whose length is not that of the smallest vec_id among the
vectors whose length is a positive multiple of four; a component beyond 2^17 counts
as 2^17; repeated rows and repeated identifiers each give a row; the first codebooks
take rows by vec_id (null last), then by their integers; fewer than ENTRIES rows give
as many entries; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, drop, stage

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Keys with more than one in HEAVY rows are joined by a broadcast of at most so many (times the positions).
HEAVY = 1024
LIMIT = 1 << 17
#: Rows whose distances to all entries are held at a time.
_ROWS = 4096


def integer_parts(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> tuple[DataFrame, int]:
    """Staged rows (row, vec_id, label, parts: four arrays of integers) of the kept vectors, and the length of a part."""
    vec = vectors[vec_col].cast("array<double>")
    whole = vec.isNotNull() & ~F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    clean = vectors.select(vectors[id_col].cast("bigint").alias("vec_id"), vectors[label_col].alias("label"), vec.alias("v")).filter(whole)
    clean = clean.filter((F.size("v") > 0) & (F.size("v") % PARTS == 0))
    front = clean.orderBy(F.asc_nulls_last("vec_id"), "v").select(F.size("v").alias("n")).first()
    width = front.n // PARTS if front else 1
    whole_number = lambda x: F.floor(F.greatest(F.least(x, F.lit(float(LIMIT))), F.lit(float(-LIMIT))) * SCALE).cast("int")
    ints = clean.filter(F.size("v") == width * PARTS).withColumn("v", F.transform("v", whole_number))
    parts = F.array(*[F.slice("v", 1 + k * width, width) for k in range(PARTS)])
    return stage(ints.select(F.monotonically_increasing_id().alias("row"), "vec_id", "label", parts.alias("parts")), "parts"), width


def nearest(parts: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index and squared distance of each row's nearest entry; ties go to the lower index. Exact: in doubles while 53 bits hold every sum, else in 64-bit integers."""
    top = int(max(np.abs(parts).max(initial=0), np.abs(book).max(initial=0))) + 1
    kind = np.float64 if 4 * top * top * max(1, parts.shape[1]) < 1 << 53 else np.int64
    index, error = np.empty(len(parts), np.int64), np.empty(len(parts), np.int64)
    b = book.astype(kind)
    norms = (b * b).sum(1)
    for at in range(0, len(parts), _ROWS):
        x = parts[at : at + _ROWS].astype(kind)
        apart = norms - 2 * (x @ b.T)
        best = apart.argmin(1)
        index[at : at + _ROWS] = best
        error[at : at + _ROWS] = (apart[np.arange(len(x)), best] + (x * x).sum(1)).astype(np.int64)
    return index, error


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width).astype(np.int64)


def lloyd_round(distinct: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks after one round over distinct rows (position, part, n)."""
    width = books.shape[2]
    shared = distinct.sparkSession.sparkContext.broadcast(books)

    def run(batches):
        books = shared.value
        sums, counts = np.zeros(books.shape, np.int64), np.zeros(books.shape[:2], np.int64)
        for batch in batches:
            position, n = batch.column("position").to_numpy(), batch.column("n").to_numpy()
            part = _matrix(batch.column("part"), width)
            for p in np.unique(position):
                own = position == p
                code, _ = nearest(part[own], books[p])
                np.add.at(sums[p], code, part[own] * n[own, None])
                np.add.at(counts[p], code, n[own])
        p, e = np.nonzero(counts)
        rows = len(p)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.repeat(p * books.shape[1] + e, width + 1), pa.int64()),
                pa.array(np.tile(np.arange(-1, width), rows), pa.int64()),
                pa.array(np.column_stack([counts[p, e], sums[p, e]]).reshape(-1), pa.int64()),
            ],
            names=["entry", "at", "value"],
        )

    summed = distinct.mapInArrow(run, "entry bigint, at bigint, value bigint").groupBy("entry", "at").agg(F.sum("value").alias("value"))
    new = books.copy()
    found = np.zeros((PARTS * books.shape[1], width + 1), np.int64)
    for r in summed.collect():  # a number for each component of each entry, whatever the input
        found[r.entry, r.at + 1] = r.value
    used = found[:, 0] > 0
    new.reshape(-1, width)[used] = found[used, 1:] // found[used, :1]
    shared.unpersist()
    return new


def first_books(rows: DataFrame, width: int) -> np.ndarray:
    front = rows.orderBy(F.asc_nulls_last("vec_id"), "parts").limit(ENTRIES).select("parts").collect()
    return np.array([r.parts for r in front], np.int64).reshape(len(front), PARTS, width).transpose(1, 0, 2).copy()


def distinct_parts(rows: DataFrame) -> DataFrame:
    """position, part, n: the distinct parts of each position and how many rows hold them."""
    return rows.select(F.posexplode("parts").alias("position", "part")).groupBy("position", "part").agg(F.count(F.lit(1)).alias("n"))


def assigned(distinct: DataFrame, books: np.ndarray) -> DataFrame:
    """distinct with code and error added."""
    width = books.shape[2]
    shared = distinct.sparkSession.sparkContext.broadcast(books)

    def run(batches):
        for batch in batches:
            position, part = batch.column("position").to_numpy(), _matrix(batch.column("part"), width)
            code, error = np.empty(len(position), np.int64), np.empty(len(position), np.int64)
            for p in np.unique(position):
                own = position == p
                code[own], error[own] = nearest(part[own], shared.value[p])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(code), pa.array(error)], names=[*batch.schema.names, "code", "error"])

    return distinct.mapInArrow(run, "position int, part array<int>, n bigint, code bigint, error bigint")


def join_by_weight(left: DataFrame, right: DataFrame, keys: list[str], total: int) -> DataFrame:
    """An inner join with a right side of one row a key and its weight n in left. Keys of more than 1 / HEAVY of the rows are broadcast: at most HEAVY for each time that a row of the table occurs in left."""
    on = lambda r: [left[k].eqNullSafe(r[f"r_{k}"]) for k in keys]
    named = right.select(*[F.col(k).alias(f"r_{k}") for k in keys], "n", *[c for c in right.columns if c not in (*keys, "n")])
    heavy, light = named.filter(F.col("n") * HEAVY > total), named.filter(F.col("n") * HEAVY <= total)
    shown = [*left.columns, *[c for c in right.columns if c not in (*keys, "n")]]
    rest = left.join(F.broadcast(heavy.select(*[f"r_{k}" for k in keys])), on(heavy), "left_anti")
    return left.join(F.broadcast(heavy), on(heavy)).select(*shown).unionByName(rest.join(light, on(light)).select(*shown))


def books_sha256(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()


def vector_codes(vectors: DataFrame) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256."""
    bounded_batches(vectors.sparkSession)
    rows, width = integer_parts(vectors)
    books = first_books(rows, width)
    distinct = stage(distinct_parts(rows), "distinct")
    for _ in range(ROUNDS if books.shape[1] else 0):
        books = lloyd_round(distinct, books)
    total = rows.count()
    coded = stage(assigned(distinct, books), "coded")
    drop(distinct)
    each = rows.select("row", "vec_id", "label", F.posexplode("parts").alias("position", "part"))
    joined = join_by_weight(each, coded, ["position", "part"], total).select("row", "vec_id", "label", "position", "code", "error")
    two_digits = F.lower(F.lpad(F.hex("code"), 2, "0"))
    own = joined.groupBy("row").agg(
        F.first("vec_id").alias("vec_id"),
        F.first("label").alias("label"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", two_digits.alias("digits")))), lambda x: x["digits"]), "").alias("code"),
        F.sum("error").alias("error"),
    )
    own = stage(own, "codes")
    drop(coded, rows)
    labels = own.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.sum("error").alias("label_error"))
    out = join_by_weight(own, stage(labels, "labels"), ["label"], total)
    return out.select("vec_id", "code", "error", "label_error", F.lit(books_sha256(books)).alias("codebooks_sha256"))
