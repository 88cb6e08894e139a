"""Favorites as an append-only log of toggles, with snapshots.

A version is a micro-batch: batch k of a stream is the folder log/version=k. A batch
that is delivered again replaces its own folder, so it counts once; it is written beside and
takes the place of the folder only then, so that it may be read from the log itself. A snapshot folds
all versions up to one into a row for each user and item: the number of toggles and the
place of the last; such rows add up, so a reader takes the newest snapshot that is not
after its version and the versions since. Folders without Spark's mark of a finished
write are not read.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_TOGGLES = "user_id bigint, item bigint, seq bigint"
_FOLDED = "user_id bigint, item bigint, n bigint, added bigint"


class FavoritesLog:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _file(self, name: str):
        """A path of the log, and its file system."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _versions(self, kind: str) -> list[int]:
        """Finished versions of a kind, ascending."""
        pattern, files = self._file(f"{kind}/version=*/_SUCCESS")
        found = files.globStatus(pattern)
        return sorted(int(re.search(r"version=(\d+)/_SUCCESS$", f.getPath().toString())[1]) for f in found or [])

    def latest(self) -> int | None:
        return max(self._versions("log") + self._versions("snapshot"), default=None)

    def append(self, batch: DataFrame, version: int) -> None:
        """batch: user_id, item, seq. A version that a snapshot has already folded stays as it is."""
        if version <= max(self._versions("snapshot"), default=-1):
            return
        made, files = self._file(f"log/_new-{uuid.uuid4().hex}")
        batch.select("user_id", "item", "seq").write.parquet(made.toString())
        target, _ = self._file(f"log/version={version}")
        files.delete(target, True)
        if not files.rename(made, target):
            raise OSError(f"{target.toString()} could not be replaced")

    def write_stream(self, events: DataFrame, checkpoint: str):
        """events: a stream of user_id, item, seq. A started query that appends a version for each micro-batch until the input is used up."""
        writer = events.writeStream.foreachBatch(self.append).option("checkpointLocation", checkpoint)
        return writer.trigger(availableNow=True).start()

    def _folded(self, version: int) -> DataFrame:
        before = [v for v in self._versions("snapshot") if v <= version]
        since = [v for v in self._versions("log") if (before[-1] if before else -1) < v <= version]
        toggles = self.spark.read.schema(_TOGGLES).parquet(*[f"{self.path}/log/version={v}" for v in since]) if since else self.spark.createDataFrame([], _TOGGLES)
        rows = toggles.select("user_id", "item", F.lit(1).cast("bigint").alias("n"), F.col("seq").alias("added"))
        if before:
            rows = rows.unionByName(self.spark.read.schema(_FOLDED).parquet(f"{self.path}/snapshot/version={before[-1]}"))
        return rows.groupBy("user_id", "item").agg(F.sum("n").alias("n"), F.max("added").alias("added"))

    def compact(self, version: int | None = None) -> None:
        """A snapshot of all versions up to one; the versions before stay readable."""
        version = self.latest() if version is None else version
        if version is not None and version not in self._versions("snapshot"):
            self._folded(version).write.mode("overwrite").parquet(f"{self.path}/snapshot/version={version}")

    def as_of(self, version: int | None = None) -> DataFrame:
        """user_id, item, place: the active items of each user after a version (the latest), by their last addition."""
        version = self.latest() if version is None else version
        active = self._folded(-1 if version is None else version).filter("n % 2 = 1")
        return active.select("user_id", "item", F.row_number().over(Window.partitionBy("user_id").orderBy("added")).alias("place"))
