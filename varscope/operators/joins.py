"""Joins in which one key may own a third of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varscope.session import fits_broadcast, heavy_keys

# Copies of a per-key side when it is shuffled; the rows of a key spread over these. More
# shuffle partitions ask for more, as a key may hold a third of all rows.
LEAST_SALTS, MOST_SALTS, PER_SALT = 32, 1024, 16


def salts_for(df: DataFrame) -> int:
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(LEAST_SALTS, min(MOST_SALTS, partitions // PER_SALT))


def join_per_key(
    rows: DataFrame,
    side: DataFrame,
    keys: Sequence[str],
    salt_by: Sequence[str],
    small: bool | None = None,
) -> DataFrame:
    """Left join ``rows`` with ``side``, which has one row per key.

    A side counted to be small is broadcast. A larger one is copied ``salts_for`` times and
    the rows of a key are spread over the copies by a hash of ``salt_by``.
    """
    keys = list(keys)
    if small is None:
        small = fits_broadcast(side)
    if small:
        return rows.join(F.broadcast(side), keys, "left")
    count = salts_for(rows)
    salts = F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda n: n.cast("bigint"))
    copies = side.withColumn("_salt", F.explode(salts))
    salt = F.pmod(F.xxhash64(*salt_by), F.lit(count))
    return rows.withColumn("_salt", salt).join(copies, [*keys, "_salt"], "left").drop("_salt")


def join_heavy(
    rows: DataFrame,
    side: DataFrame,
    keys: Sequence[str],
    counted: DataFrame,
    count_col: str,
    how: str = "inner",
) -> DataFrame:
    """Join (``inner``, ``left`` or ``left_anti``) with a side of one row per key, of any size.

    ``counted`` tells how many rows each key has. Keys with very many rows are few by
    arithmetic: those rows of ``side`` are broadcast, so the heavy rows stay where they
    are, and the rest is shuffled.
    """
    keys = list(keys)
    threshold = heavy_keys(counted, count_col)
    if threshold is None:
        return rows.join(side, keys, how)
    heavy = counted.filter(F.col(count_col) >= threshold).select(*keys)
    heavy_side = side.join(F.broadcast(heavy), keys, "left_semi")
    heavy_rows = rows.join(F.broadcast(heavy), keys, "left_semi")
    other_rows = rows.join(F.broadcast(heavy), keys, "left_anti")
    if fits_broadcast(heavy_side):
        found = heavy_rows.join(F.broadcast(heavy_side), keys, how)
    else:  # few rows, but of very much text: a salted shuffle instead
        met = join_per_key(heavy_rows, heavy_side.withColumn("_met", F.lit(True)), keys, heavy_rows.columns, small=False)
        found = {"inner": met.filter("_met"), "left": met, "left_anti": met.filter("_met is null")}[how].drop("_met")
        if how == "left_anti":
            found = found.select(*heavy_rows.columns)
    return found.unionByName(other_rows.join(side, keys, how))
