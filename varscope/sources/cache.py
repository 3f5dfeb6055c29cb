"""Description cache as a store of small sorted upserts.

The store is a folder of numbered Parquet folders: ``base-N`` holds the whole cache, each
``fresh-N`` what was written after it. An upsert writes its own rows only. A reader takes
the newest base and what came after it, and of a key the row written last. When
``COMPACT`` upserts have gathered, they are merged into a new base. Every folder is one
Spark job, which counts once its commit mark is there: a failed write changes nothing, and
readers of an older base are not disturbed.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COLUMNS = "key string, description string, example string"
COMPACT = 8
_PART = re.compile(r"(base|fresh)-(\d+)$")


class CacheStore:
    def __init__(self, spark: SparkSession, path: str, compact: int = COMPACT):
        self.spark, self.path, self.compact = spark, path, compact

    def parts(self) -> list[tuple[int, str]]:
        """(number, kind) of the newest base and of the committed writes after it, in order."""
        jvm = self.spark._jvm
        folder = jvm.org.apache.hadoop.fs.Path(self.path)
        system = folder.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not system.exists(folder):
            return []
        found = []
        for status in system.listStatus(folder):
            match = _PART.search(status.getPath().getName())
            if match and system.exists(jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS")):
                found.append((int(match[2]), match[1]))
        found.sort()
        bases = [k for k, (_, kind) in enumerate(found) if kind == "base"]
        return found[bases[-1] :] if bases else found

    def _place(self, number: int, kind: str) -> str:
        return f"{self.path}/{kind}-{number:08d}"

    def _write(self, rows: DataFrame, kind: str) -> None:
        parts = self.parts()
        number = parts[-1][0] + 1 if parts else 0
        # sorted by key, so that a reader's aggregation and a look-up by key skip row groups
        rows.select("key", "description", "example").sortWithinPartitions("key").write.mode("overwrite").parquet(
            self._place(number, kind)
        )

    def read(self) -> DataFrame:
        """``key, description, example``: the last written row of each key."""
        parts = self.parts()
        if not parts:
            return self.spark.createDataFrame([], COLUMNS)
        tables = [
            self.spark.read.schema(COLUMNS).parquet(self._place(number, kind)).withColumn("_at", F.lit(number))
            for number, kind in parts
        ]
        if len(tables) == 1 and parts[0][1] == "base":
            return tables[0].drop("_at")
        rows = tables[0]
        for table in tables[1:]:
            rows = rows.unionByName(table)
        # of one upsert that repeats a key the largest text counts, whatever the partitioning
        newest = rows.groupBy("key").agg(F.max(F.struct("_at", "description", "example")).alias("_last"))
        return newest.select("key", "_last.description", "_last.example")

    def upsert(self, fresh: DataFrame) -> None:
        """Write ``fresh`` over the cache; the rest of it is not touched."""
        self._write(fresh, "fresh")
        if sum(kind == "fresh" for _, kind in self.parts()) >= self.compact:
            self._write(self.read(), "base")
