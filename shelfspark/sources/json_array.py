"""A JSON array of objects that many tasks read: one file, cut anywhere.

Spark reads the file as text with `}` as the end of a line, so its own byte ranges cut it,
and each task gets whole fragments. Whether a fragment begins inside of a string
is the parity of the quotes before it, how deep it lies is the sum of the brackets before
it outside of strings, and which element it belongs to is the number of objects that
ended before it at the array's level. All three are prefix sums: running sums within a
byte range, and the totals of the ranges before. The fragments of an element then meet by its number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .staging import staged


def _count(text: Column, characters: str) -> Column:
    """How many of the characters stand in a text."""
    return F.length(text) - F.length(F.translate(text, characters, ""))


def _before(rows: DataFrame, value: str, name: str) -> DataFrame:
    """rows (range, at) with the sum of a column over all rows before."""
    totals = rows.groupBy("range").agg(F.sum(value).alias("total"))
    # A row for each byte range of the file.
    offsets = totals.select(F.col("range"), (F.sum("total").over(Window.orderBy("range")) - F.col("total")).alias("offset"))
    running = F.sum(value).over(Window.partitionBy("range").orderBy("at")) - F.col(value)
    return rows.join(offsets, "range").withColumn(name, F.col("offset") + running).drop("offset")


def json_objects(spark: SparkSession, path: str) -> DataFrame:
    """ord, raw: the objects of the one array in a file, from 0, as text. Elements that are no objects are not counted. One file, not a folder of several."""
    lines = spark.read.text(path, lineSep="}").select("value", F.col("_metadata.file_block_start").alias("range"), F.monotonically_increasing_id().alias("at"))
    # Staged, so that the numbers stay what they are.
    rows = staged(lines, "fragments").withColumn("plain", F.regexp_replace("value", r"\\.", ""))
    rows = _before(rows.withColumn("quotes", _count(F.col("plain"), '"')), "quotes", "quotes_before")
    inside = F.col("quotes_before") % 2 == 1
    ended_inside = (F.col("quotes_before") + F.col("quotes")) % 2 == 1
    outer = F.regexp_replace(F.concat(F.when(inside, '"').otherwise(""), F.col("plain")), '"[^"]*("|$)', "")
    # The last fragment has no brace after it, but nothing that counts either.
    closes = F.when(ended_inside, 0).otherwise(1)
    rows = rows.select("range", "at", "value", closes.alias("closes"), (_count(outer, "{[") - _count(outer, "]") - closes).alias("deeper"))
    rows = _before(rows, "deeper", "depth")
    ends = (F.col("closes") == 1) & (F.col("depth") + F.col("deeper") == 1)
    rows = _before(rows.withColumn("ends", F.when(ends, 1).otherwise(0)), "ends", "ord")
    parts = rows.groupBy("ord").agg(F.sort_array(F.collect_list(F.struct("range", "at", "value"))).alias("parts"), F.max("ends").alias("whole"))
    joined = F.concat(F.array_join(F.transform("parts", lambda x: x["value"]), "}"), F.lit("}"))
    # Before an object stand the array's bracket or a comma, and elements that are no objects.
    front = F.regexp_replace(joined, r"^[^{]*", "")
    return parts.filter("whole = 1").select(F.col("ord").cast("bigint").alias("ord"), front.alias("raw"))
