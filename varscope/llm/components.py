"""Connected components of an edge table, in rounds of two star operations.

Every round is a few joins and aggregations over the edges, stored once. The number of
rounds grows with the logarithm of the longest path; nothing reaches the driver but the
count and a checksum of the edges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varscope.operators.joins import join_heavy
from varscope.session import materialize


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = materialize(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n")))
    # the centre of a large star has very many edges
    found = join_heavy(both.filter("v > u"), least.select("u", "m"), ["u"], least, "n")
    return found.select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    others = edges.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return others.unionByName(least.withColumnRenamed("m", "v")).distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, root`` for every node of an edge; ``root`` is the smallest node of its component."""
    both = F.sort_array(F.array(a, b))
    edges = materialize(edges.filter(F.col(a) != F.col(b)).select(both[1].alias("u"), both[0].alias("v")).distinct())
    seen = None
    while True:
        edges = materialize(_small_star(_large_star(edges)))
        state = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if state == seen:
            break
        seen = state
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return stars.unionByName(stars.select(F.col("root").alias("node"), "root").distinct())
