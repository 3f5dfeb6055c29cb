"""Session helpers: durable intermediate tables and checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Rows and bytes a broadcast side may hold; anything larger goes through a shuffle join.
BROADCAST_ROW_LIMIT = 100_000
BROADCAST_BYTE_LIMIT = 64 << 20
# Bytes of stored files that one task reads at most.
SPLIT_BYTES = 8 << 20
ARROW_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def tune(spark: SparkSession) -> None:
    """Session settings the extraction depends on for speed.

    The JVM never compiles a method above 8,000 bytes of bytecode, so a larger generated
    stage would stay interpreted; Spark then does better with its split projections.

    Source text packs to a tenth or less, and reading it is slow by the byte: with Spark's
    splits of 128 MB one task would have millions of files. A smaller split stays. Where the
    session has Spark's default, rows go to Python in smaller batches, as texts may be long.
    """
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")
    if spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes() > SPLIT_BYTES:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(SPLIT_BYTES))
    if spark.conf.get(ARROW_BATCH) == "10000":
        spark.conf.set(ARROW_BATCH, "1000")


def shared_folder(spark: SparkSession) -> str:
    """Folder for intermediate tables, as named by ``spark.checkpoint.dir``.

    Only a local master may fall back to a temporary folder: on a cluster a machine-local
    path would be lost with its executor.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current is None:
        context.setCheckpointDir(tempfile.mkdtemp(prefix="run-", dir="/tmp"))
        current = context.getCheckpointDir()
    return current


_scopes: list[list[str]] = []


def new_table_path(spark: SparkSession) -> str:
    path = f"{shared_folder(spark)}/varscope-{uuid.uuid4().hex}"
    if _scopes:
        _scopes[-1].append(path)
    return path


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Drops, at its end, the intermediate tables that were stored inside it.

    Results must be written or collected before: a DataFrame reads them when it runs.
    """
    _scopes.append([])
    try:
        yield
    finally:
        jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
        for name in _scopes.pop():
            path = jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(conf).delete(path, True)


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Used where a result feeds several branches (so that source text is read once) or
    where row positions must be frozen. A lost executor only re-reads the table.
    """
    spark = df.sparkSession
    path = new_table_path(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fits_broadcast(df: DataFrame, limit: int = BROADCAST_ROW_LIMIT, max_bytes: int = BROADCAST_BYTE_LIMIT) -> bool:
    """True when ``df`` holds at most ``limit`` rows and ``max_bytes``, measured as JSON text.

    Stops reading right after the limit.
    """
    size = F.octet_length(F.to_json(F.struct("*"))).alias("size")
    rows, total = df.limit(limit + 1).select(size).agg(F.count("*"), F.sum("size")).first()
    return rows <= limit and (total or 0) <= max_bytes


def heavy_keys(counted: DataFrame, count_col: str, limit: int = BROADCAST_ROW_LIMIT) -> int | None:
    """Smallest power of two so that at most ``limit`` keys hold that many rows or more.

    ``counted`` has one row per key. Only the histogram (at most 64 rows) reaches the
    driver. ``None`` means no key is heavy enough to need special care.
    """
    histogram = (
        counted.filter(F.col(count_col) >= 1 << 16)
        .groupBy(F.floor(F.log2(F.col(count_col))).cast("int").alias("power"))
        .count()
        .collect()
    )
    keys = 0
    threshold = None
    for row in sorted(histogram, key=lambda r: -r["power"]):
        keys += row["count"]
        if keys > limit:
            break
        threshold = 1 << row["power"]
    return threshold
