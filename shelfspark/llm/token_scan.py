"""Token counts of documents in flat token files, found by scanning for separators.

A token file is a flat run of 16-bit big-endian ids; documents follow one
another and each ends with the end-of-document id. There is no index. A scan
cuts every file into blocks of BLOCK_TOKENS, finds the separators of a block in
one vectorised comparison, and keeps of each block its length, its separators
and what lies before its first and after its last one. A prefix scan over a
file's blocks (two cumulative sums) then gives every document its number, its
start and its length, whether it lies within a block or across many.

write_token_files() tokenises documents into such files through Spark's text
writer: the end-of-document id is chosen so that its two bytes are one UTF-8
character, which the writer puts after each row as its line separator. Each
document begins with HEADER ids that spell its identifier in base HEADER_BASE,
none of which is the separator; token counts leave them out.

Defined results: null or empty text has 0 tokens; ids without a separator after
them at a file's end are no document; two separators in a row frame a document
of no ids, which has no header and a null identifier; rows that repeat an
identifier are counted one by one; an empty table gives an empty result.
"""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import new_path, stage, tokenizer_file

#: 0xC480 spells U+0100 in UTF-8; it lies over every id of a 50k vocabulary.
END_OF_DOCUMENT = 0xC480
BLOCK_TOKENS = 1 << 16
HEADER, HEADER_BASE = 5, 40_000


def header_of(doc_id: int) -> list[int]:
    """Five ids for a 64-bit identifier: its value plus 2^63, in base HEADER_BASE."""
    value, out = (doc_id if doc_id is not None else -(1 << 63)) + (1 << 63), []
    for _ in range(HEADER):
        value, digit = divmod(value, HEADER_BASE)
        out.append(digit)
    return out


def ids_of(headers: np.ndarray) -> list[int | None]:
    """The identifiers that rows of five ids spell."""
    value = np.zeros(len(headers), np.uint64)
    for digit in range(HEADER - 1, -1, -1):
        value = value * np.uint64(HEADER_BASE) + headers[:, digit].astype(np.uint64)
    out = (value ^ np.uint64(1 << 63)).view(np.int64).tolist()
    return [x if x > -(1 << 63) else None for x in out]


_encoders: dict = {}


def encoder(path: str, pattern: str):
    import tiktoken

    if path not in _encoders:
        with open(tokenizer_file(path), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encoders[path] = tiktoken.Encoding("flat", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _encoders[path]


def write_token_files(docs: DataFrame, tokenizer_path: str, pattern: str) -> str:
    """Flat token files of every document, one for each partition; gives their folder."""

    def run(batches):
        enc = encoder(tokenizer_path, pattern)
        if enc.n_vocab > END_OF_DOCUMENT:
            raise ValueError("the vocabulary reaches the end-of-document id")
        for batch in batches:
            out = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                ids = enc.encode_ordinary(text) if text else []
                out.append(np.array(header_of(doc_id) + ids, ">u2").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["ids"])

    path = new_path(docs.sparkSession, "tokens")
    rows = docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), docs["text"].cast("string").alias("text"))
    flat = rows.mapInArrow(run, "ids binary").select(F.col("ids").cast("string").alias("value"))
    flat.write.option("lineSep", bytes([END_OF_DOCUMENT >> 8, END_OF_DOCUMENT & 255]).decode()).text(path)
    return path


def scan_block(ids: np.ndarray, end: int) -> np.ndarray:
    """Offsets of the separators in one block."""
    return np.flatnonzero(ids == end)


def scan_blocks(spark: SparkSession, path: str, end: int = END_OF_DOCUMENT, dtype: str = ">u2", block_tokens: int = BLOCK_TOKENS, header: int = 0) -> DataFrame:
    """One row per block: file, block, n, separators (offsets in the block), and the first `header` ids after each."""
    width = np.dtype(dtype).itemsize

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                name, data = batch.column("path")[i].as_py(), batch.column("content")[i].as_buffer()
                flat = np.frombuffer(data, dtype, len(data) // width)
                for k, at in enumerate(range(0, len(flat), block_tokens)):
                    block = flat[at : at + block_tokens]
                    found = scan_block(block, end)
                    heads: list = []
                    if header:
                        begins = np.concatenate(([-1], found)) + 1 if k == 0 else found + 1
                        padded = np.concatenate((flat[at : at + block_tokens + header].astype(np.int32), np.full(header, -1, np.int32)))
                        own = padded[begins[:, None] + np.arange(header)]
                        whole = ((own >= 0) & (own != end)).all(1)
                        heads = [x if ok else None for x, ok in zip(ids_of(np.where(whole[:, None], own, 0)), whole.tolist())]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([name]), pa.array([k], pa.int64()), pa.array([len(block)], pa.int64()), pa.array([found.tolist()], pa.list_(pa.int64())), pa.array([heads], pa.list_(pa.int64()))],
                        names=["file", "block", "n", "separators", "heads"],
                    )

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(path).select("path", "content")
    return files.mapInArrow(run, "file string, block bigint, n bigint, separators array<bigint>, heads array<bigint>")


def stitch(blocks: DataFrame) -> DataFrame:
    """file, doc_index, start, n_ids, doc_id of every document, by a prefix scan over each file's blocks. doc_id comes from the ids that follow a file's begin and each separator, null without."""
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    last = F.when(F.size("separators") > 0, F.element_at("separators", -1))
    # In a struct, so that a null identifier is told from none.
    last_head = F.when(F.size("heads") > 0, F.struct(F.element_at("heads", -1).alias("id")))
    placed = blocks.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).withColumns(
        {
            "first_doc": F.coalesce(F.sum(F.size("separators")).over(before), F.lit(0)),
            "open_from": F.coalesce(F.last(F.col("base") + last, ignorenulls=True).over(before), F.lit(-1).cast("bigint")) + 1,
            "open_head": F.last(last_head, ignorenulls=True).over(before),
        }
    )
    ends = placed.select("file", "block", "base", "first_doc", "open_from", "open_head", "separators", "heads", F.posexplode("separators").alias("k", "at"))
    start = F.when(F.col("k") == 0, F.col("open_from")).otherwise(F.col("base") + F.get("separators", F.col("k") - 1) + 1)
    own = F.get("heads", F.when(F.col("block") == 0, F.col("k")).otherwise(F.col("k") - 1))
    doc_id = F.when((F.col("k") == 0) & (F.col("block") > 0), F.col("open_head.id")).otherwise(own)
    return ends.select("file", (F.col("first_doc") + F.col("k")).alias("doc_index"), start.alias("start"), (F.col("base") + F.col("at") - start).alias("n_ids"), doc_id.alias("doc_id"))


def token_counts(docs: DataFrame, tokenizer_path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens of every document, counted in the flat files that its tokens are written to."""
    spark = docs.sparkSession
    path = write_token_files(docs, tokenizer_path, pattern)
    blocks = stage(scan_blocks(spark, path, header=HEADER), "blocks")
    n = F.greatest(F.col("n_ids") - HEADER, F.lit(0))
    return stitch(blocks).select("doc_id", n.alias("n_tokens"), F.regexp_extract("file", r"([^/]+)$", 1).alias("file"), "doc_index", "start")
