"""What the corpus operators share: tables in the shared folder, and input columns."""

from __future__ import annotations

import atexit
import gc
import os
import shutil
import tempfile
import time
import uuid
from urllib.parse import urlsplit

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Staged tables that are still there, by path. What a result still reads is deleted when the driver ends.
_ALIVE: dict[str, SparkSession] = {}
#: Bytes of an Arrow batch to or from a Python worker, however long single texts are.
BATCH_BYTES = 8 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Where that is unset, a temporary one, but only if the driver is the one executor."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="shelfspark-")
        spark.conf.set("spark.checkpoint.dir", path)
        atexit.register(shutil.rmtree, urlsplit(path).path, True)
    return path.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    if not _ALIVE:
        atexit.register(drop_all)
    _ALIVE[path] = spark
    return path


def bounded_batches(spark: SparkSession) -> None:
    """Batches of BATCH_BYTES, unless the session asks for smaller ones: a batch of long texts must not fill a worker."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key, None)
    if now is None or not 0 < _bytes_of(now) <= BATCH_BYTES:
        spark.conf.set(key, f"{BATCH_BYTES}b")


def _bytes_of(size: str) -> int:
    digits = size.rstrip("bBkKmMgGtT")
    return int(digits) << {"k": 10, "m": 20, "g": 30, "t": 40}.get(size[len(digits) : len(digits) + 1].lower(), 0)


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write a table to the shared folder and read it back: the lineage ends there and survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, label)
    bounded_batches(spark)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_path = path
    return out


def drop(*tables: DataFrame) -> None:
    """Delete staged tables that no later step reads."""
    for df in tables:
        path = getattr(df, "staged_path", None)
        if path:
            delete(df.sparkSession, path)


def settle(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished steps, which it does when the driver's objects for them are collected: Python's first, whose hold on the JVM's ends a little later."""
    gc.collect()
    for _ in range(2):
        time.sleep(0.4)
        spark.sparkContext._jvm.System.gc()


def delete(spark: SparkSession, path: str) -> None:
    _ALIVE.pop(path, None)
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(jvm.org.apache.hadoop.conf.Configuration() if spark.sparkContext._jsc is None else spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def drop_all() -> None:
    """Delete every staged table that is left; their results can't be read any more."""
    for path, spark in list(_ALIVE.items()):
        try:
            delete(spark, path)
        except Exception:  # the session may have ended before the driver; a local folder can still go
            _ALIVE.pop(path, None)
            if urlsplit(path).scheme in ("", "file"):
                shutil.rmtree(urlsplit(path).path, True)


def tokenizer_file(name: str) -> str:
    """A vocabulary file by its path, or by its name among the public tokenizers, wherever those are on this machine."""
    if os.path.exists(name):
        return name
    import public_tokenizers

    return str(public_tokenizers.path(os.path.basename(name)))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def text_of(df: DataFrame, column: str = "text") -> Column:
    """The text, with null as empty."""
    return F.coalesce(df[column].cast("string"), F.lit(""))


#: Bits of a filter that goes to the executors: four megabytes, whatever the input. One that fills up passes more rows on to the join that settles them.
FILTER_BITS = 1 << 25
_PAGE_BITS = 32768


def filter_slot(value):
    """The bit that a 64-bit number sets; for a Column and for numpy arrays alike."""
    if isinstance(value, Column):
        return F.shiftright(value, 25).bitwiseXOR(value).bitwiseAND(F.lit(FILTER_BITS - 1))
    return (value ^ (value >> 25)) & (FILTER_BITS - 1)


def bit_filter(values: DataFrame) -> np.ndarray:
    """A bitmap of the one column of 64-bit numbers. It lets through all of them and, by chance, others: a join has to settle those."""
    slot = filter_slot(F.col(values.columns[0]))
    pages = values.select(slot.alias("s")).groupBy(F.floor(F.col("s") / _PAGE_BITS).cast("int").alias("page")).agg(F.bitmap_construct_agg(F.col("s") % _PAGE_BITS).alias("bits"))
    out = np.zeros(FILTER_BITS // 8, np.uint8)
    for page in pages.collect():  # FILTER_BITS / 8 bytes at most
        at = page["page"] * (_PAGE_BITS // 8)
        out[at : at + _PAGE_BITS // 8] = np.frombuffer(bytes(page["bits"]), np.uint8)
    return out


def passes(bits: np.ndarray, values: np.ndarray) -> np.ndarray:
    slot = filter_slot(values)
    return (bits[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 == 1
