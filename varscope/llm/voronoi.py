"""Exact top-k search by inner product, as a Voronoi join of queries and vectors.

Method. A few pivots divide the space; every vector belongs to the cell of its nearest
pivot. Cells are summarised by their count and radius. From pivots and radii follow, for
each pair of a query cell and a data cell, the largest and the smallest inner product
that can occur. The smallest products of cells that hold enough vectors together bound
the k-th best score of every query in the cell from below; a data cell whose largest
product is below that bound is not sent to the query cell. What is sent is searched
exactly, block against block, and the best of all blocks are ranked.

Scale. Pivots and summaries are all the driver sees: their number grows with the square
root of the rows up to ``MOST_PIVOTS``, and with it the number of join keys. Vectors travel
in packed blocks of at most ``BLOCK`` vectors, queries in blocks of ``QUERY_BLOCK``; a
pair of blocks is a row, and at most k results per query leave it, so no cell has to fit
a task and a vector held by a third of all rows is spread like any other.

Defined results. Vectors that are null or hold a null or a component that is not finite
take no part, nor do rows without ``vec_id``. Rows are told apart even if they share a
``vec_id``: each is a candidate of every other row, and each that is a query gets results
of its own. Only vectors of equal dimension are compared. Scores must fit 64 bits. Equal
scores rank by ``vec_id``. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from varscope.session import materialize

K = 5
SCALE = 256
EVERY = 50
# Pivots are the root of the rows by PER_PIVOT; a cell is split into SPREAD parts or more,
# and a query block is copied to each of them.
LEAST_PIVOTS, MOST_PIVOTS, PER_PIVOT = 16, 1024, 8
SPREAD = 8
BLOCK = 1024
QUERY_BLOCK = 256

PACKED = "dim int, cell int, n long, radius double, rows binary, ids binary, vectors binary"
FOUND = "query_row long, query_id long, vec_id long, score long"


def pivots_for(rows: int) -> int:
    return int(min(MOST_PIVOTS, max(LEAST_PIVOTS, rows**0.5 / PER_PIVOT)))


def whole_vectors(table: DataFrame, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``row, vec_id, vector`` with components floor(SCALE * x). Store it: rows are numbered by place."""
    x = F.col(vector)
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) != float("inf")))
    rows = table.filter(F.col(vec_id).isNotNull() & x.isNotNull()).filter(finite)
    scaled = F.transform(x, lambda c: F.floor(SCALE * c.cast("double")).cast("bigint"))
    return rows.select(
        F.monotonically_increasing_id().alias("row"), F.col(vec_id).cast("bigint").alias("vec_id"), scaled.alias("vector")
    )


def matrix(column: pa.ListArray) -> np.ndarray:
    """Vectors of one dimension as rows."""
    flat = np.asarray(column.flatten(), np.int64)
    return flat.reshape(len(column), -1)


def _pack(pivots: dict[int, np.ndarray], block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], list] = {}
        for batch in batches:
            dims = np.asarray(pa.compute.list_value_length(batch.column("vector")))
            for dim in np.unique(dims).tolist():
                rows = pa.array(dims == dim)
                ids = np.asarray(batch.column("vec_id").filter(rows), np.int64)
                numbers = np.asarray(batch.column("row").filter(rows), np.int64)
                vectors = matrix(batch.column("vector").filter(rows))
                away = distances(vectors, pivots[dim])
                cell = away.argmin(1)
                for c in np.unique(cell).tolist():
                    mine = cell == c
                    held.setdefault((dim, c), []).append((numbers[mine], ids[mine], vectors[mine], away[mine, c]))
                    if sum(len(p[0]) for p in held[dim, c]) >= block:
                        yield from packed_rows(dim, c, held.pop((dim, c)), block)
        for (dim, c), parts in held.items():
            yield from packed_rows(dim, c, parts, block)

    return run


def distances(vectors: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    largest = max(int(np.abs(vectors).max(initial=0)), int(np.abs(pivots).max(initial=0)))
    if 4 * largest**2 * max(1, vectors.shape[1]) < 1 << 53:  # sums of doubles are exact
        v, p = vectors.astype(float), pivots.astype(float)
        return np.sqrt((v**2).sum(1)[:, None] + (p**2).sum(1) - 2 * (v @ p.T))
    out = np.empty((len(vectors), len(pivots)))
    for k, pivot in enumerate(pivots):
        out[:, k] = np.sqrt(((vectors - pivot).astype(float) ** 2).sum(1))
    return out


def packed_rows(dim: int, cell: int, parts: list, block: int) -> Iterator[pa.RecordBatch]:
    rows, ids, vectors, away = (np.concatenate(x) for x in zip(*parts))
    order = np.argsort(ids, kind="stable")
    for k in range(0, len(ids), block):
        part = order[k : k + block]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([dim], pa.int32()), pa.array([cell], pa.int32()), pa.array([len(part)], pa.int64()),
                pa.array([float(away[part].max())]),
                *(pa.array([x[part].tobytes()], pa.binary()) for x in (rows, ids, vectors)),
            ],
            ["dim", "cell", "n", "radius", "rows", "ids", "vectors"],
        )


def reachable(
    pivots: np.ndarray, queries: dict[int, float], data: dict[int, tuple[int, float]], k: int
) -> list[tuple[int, int]]:
    """Pairs (query cell, data cell) that can hold one of the k best. Values: radius; (count, radius)."""
    pairs = []
    centres = pivots.astype(float)
    length = np.sqrt((centres**2).sum(1))
    cells = np.array(list(data), np.int64)
    n, radius = np.array([data[c][0] for c in data]), np.array([data[c][1] for c in data])
    for q, q_radius in queries.items():
        middle = centres[cells] @ centres[q]
        off = q_radius * length[cells] + radius * length[q] + q_radius * radius
        slack = 1e-9 * (np.abs(middle) + off) + 1e-6
        low, high = middle - off - slack, middle + off + slack
        order = np.argsort(-low, kind="stable")
        enough = np.flatnonzero(np.cumsum(n[order]) > k)  # one of them may be the query itself
        least = low[order[enough[0]]] if len(enough) else -np.inf
        pairs += [(q, int(c)) for c in cells[high >= least]]
    return pairs


def best(rows: np.ndarray, ids: np.ndarray, vectors: np.ndarray, query_rows: np.ndarray, queries: np.ndarray, k: int):
    """(query row, id, score) arrays of each query's k best in one block; ids are in ascending order."""
    largest = int(np.abs(vectors).max(initial=0)) * int(np.abs(queries).max(initial=0)) * max(1, vectors.shape[1])
    if largest < 1 << 53:  # sums of doubles are exact
        scores = (queries.astype(float) @ vectors.T.astype(float)).astype(np.int64)
    else:
        scores = queries @ vectors.T
    order = np.argsort(-scores, axis=1, kind="stable")[:, : k + 1]
    query = np.repeat(np.arange(len(query_rows)), order.shape[1])
    score = np.take_along_axis(scores, order, 1).ravel()
    other = rows[order].ravel() != query_rows[query]
    return query[other], ids[order].ravel()[other], score[other]


def _search(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for row in range(batch.num_rows):
                get = lambda name: np.frombuffer(batch.column(name)[row].as_buffer(), np.int64)  # noqa: B023, E731
                ids, query_rows, query_ids = get("ids"), get("query_rows"), get("query_ids")
                query, vec, score = best(
                    get("rows"), ids, get("vectors").reshape(len(ids), -1), query_rows,
                    get("queries").reshape(len(query_rows), -1), k,
                )
                found.append((query_rows[query], query_ids[query], vec, score))
            number, query, vec, score = (np.concatenate(x) for x in zip(*found))
            order = np.lexsort((vec, -score, number))
            number, query, vec, score = number[order], query[order], vec[order], score[order]
            new = np.concatenate([[True], number[1:] != number[:-1]])
            rank = np.arange(len(number)) - np.maximum.accumulate(np.where(new, np.arange(len(number)), 0))
            top = rank < k
            yield pa.RecordBatch.from_arrays(
                [pa.array(x[top]) for x in (number, query, vec, score)], ["query_row", "query_id", "vec_id", "score"]
            )

    return run


def top_k(
    table: DataFrame,
    k: int = K,
    every: int = EVERY,
    pivots: int | None = None,
    vec_id: str = "vec_id",
    vector: str = "embedding",
) -> DataFrame:
    """``query_id, rank, vec_id, score`` for the queries, the rows with ``vec_id`` divisible by ``every``."""
    spark = table.sparkSession
    rows = materialize(whole_vectors(table, vec_id, vector))
    pivots = pivots or pivots_for(rows.count())
    spread = max(SPREAD, pivots // 16)
    # the pivots: a number of vectors per dimension, chosen by a hash of their id
    first = Window.partitionBy(F.size("vector")).orderBy(F.xxhash64("vec_id"), "vec_id", "vector")
    chosen = rows.withColumn("place", F.row_number().over(first)).filter(F.col("place") <= pivots)
    by_dim: dict[int, set] = {}
    for row in chosen.select("vector").collect():
        by_dim.setdefault(len(row[0]), set()).add(tuple(row[0]))
    centres = {dim: np.array(sorted(v), np.int64).reshape(len(v), dim) for dim, v in by_dim.items()}

    data = materialize(rows.mapInArrow(_pack(centres, BLOCK), PACKED))
    asked = rows.filter(F.pmod("vec_id", F.lit(every)) == 0)
    queries = materialize(asked.mapInArrow(_pack(centres, QUERY_BLOCK), PACKED))

    def summary(packed: DataFrame) -> dict[int, dict[int, tuple[int, float]]]:
        out: dict[int, dict[int, tuple[int, float]]] = {}
        for r in packed.groupBy("dim", "cell").agg(F.sum("n").alias("n"), F.max("radius").alias("radius")).collect():
            out.setdefault(r["dim"], {})[r["cell"]] = (r["n"], r["radius"])
        return out

    of_data, of_queries = summary(data), summary(queries)
    pairs = [
        (dim, q, c)
        for dim, cells in of_queries.items()
        for q, c in reachable(centres[dim], {q: r for q, (_, r) in cells.items()}, of_data[dim], k)
    ]
    wanted = spark.createDataFrame(pairs, "dim int, query_cell int, cell int")
    asked = queries.select(
        "dim", F.col("cell").alias("query_cell"), F.col("rows").alias("query_rows"), F.col("ids").alias("query_ids"),
        F.col("vectors").alias("queries"), F.explode(F.sequence(F.lit(0), F.lit(spread - 1))).alias("part"),
    )
    sent = data.withColumn("part", F.pmod(F.xxhash64("rows"), F.lit(spread)).cast("int")).join(
        F.broadcast(wanted), ["dim", "cell"]
    )
    met = sent.join(asked, ["dim", "query_cell", "part"]).select(
        "rows", "ids", "vectors", "query_rows", "query_ids", "queries"
    )
    found = met.mapInArrow(_search(k), FOUND)
    ranked = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(ranked))
        .filter(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
