"""Exact top-k inner products by a Voronoi join: cells around pivots, bounds from cell summaries, blocks solved locally."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docvet.llm.shared import Scratch, stored

K, EVERY = 10, 100
#: Pivots, at most; rows of a block of data or of queries. They bound what a task holds.
MOST_PIVOTS, BLOCK_ROWS, QUERY_ROWS = 256, 8192, 4096


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """The packed vectors as rows, shorter ones filled with 0."""
    out = np.zeros((len(column), width))
    for k, x in enumerate(column.to_pylist()):
        v = np.frombuffer(x, np.float64)
        out[k, : len(v)] = v
    return out


def _packed(batches):
    """vec_id and the vector's floor(1024 * x) as packed doubles, of vectors without null or non-finite components."""
    for batch in batches:
        ids, vectors = [], []
        for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if v is None or i is None or any(x is None for x in v):
                continue
            x = np.array(v, np.float64)
            if np.isfinite(x).all():
                ids.append(i)
                vectors.append(np.floor(1024 * x).tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(vectors, pa.binary())], ["vec_id", "vector"])


def _assigner(pivots: np.ndarray):
    def run(batches):
        half = (pivots**2).sum(1) / 2
        for batch in batches:
            x = _matrix(batch.column(1), pivots.shape[1])
            cell = np.argmax(x @ pivots.T - half, axis=1) if len(x) else np.zeros(0, np.int64)
            far = np.sqrt(((x - pivots[cell]) ** 2).sum(1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int32()), pa.array(far)], ["vec_id", "vector", "cell", "far"])

    return run


def needed(pivots: np.ndarray, counts: np.ndarray, radius: np.ndarray, query_radius: np.ndarray, k: int, own: np.ndarray | None = None, most: int = 1) -> np.ndarray:
    """Which cells (columns) can hold one of the k best of a query of which cells (rows), from the summaries alone.

    With q = p + d and x = r + e, |d| and |e| at most the radii: q.x lies within |d||r| + (|p| + |d|)|e| of p.r. The lower
    bounds of cells with together k rows that can't be the query's own bound the k-th best score from below. own: rows of
    a cell that one query's id has there at most (one by default); most: that it has in all cells.
    """
    dot, norm = pivots @ pivots.T, np.sqrt((pivots**2).sum(1))
    slack = query_radius[:, None] * norm[None, :] + (norm + query_radius)[:, None] * radius[None, :]
    low, high = dot - slack, dot + slack
    own = np.ones(len(pivots)) if own is None else own
    out = np.zeros(dot.shape, bool)
    for g in range(len(pivots)):
        order = np.argsort(-low[g])
        enough = np.searchsorted(np.cumsum(counts[order]) - np.minimum(np.cumsum(own[order]), most), k)
        least = low[g, order[enough]] if enough < len(order) else -np.inf
        out[g] = (high[g] >= least - 1e-6 * (1 + abs(least) if np.isfinite(least) else 0)) & (counts > 0)
    return out


def best(ids: np.ndarray, scores: np.ndarray, own: int, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to the smaller id, without the query's own id."""
    at = np.flatnonzero(ids != own)
    if len(at) > k:
        s = scores[at]
        at = at[s >= np.partition(s, len(s) - k)[len(s) - k]]
    return at[np.lexsort((ids[at], -scores[at]))[:k]]


def _solver(width: int, k: int):
    def run(queries: pa.Table, rows: pa.Table) -> pa.Table:
        out: list[list] = [[], [], []]
        if queries.num_rows and rows.num_rows:
            ids, x = rows.column("vec_id").to_numpy(), _matrix(rows.column("vector").combine_chunks(), width)
            own, q = queries.column("query_id").to_numpy(), _matrix(queries.column("asked").combine_chunks(), width)
            for i in range(0, len(own), 256):
                for name, scores in zip(own[i : i + 256].tolist(), q[i : i + 256] @ x.T, strict=True):
                    at = best(ids, scores, name, k)
                    out[0] += [name] * len(at)
                    out[1] += ids[at].tolist()
                    out[2] += scores[at].astype(np.int64).tolist()
        return pa.table([pa.array(c, pa.int64()) for c in out], ["query_id", "vec_id", "score"])

    return run


def top_k(embeddings: DataFrame, k: int = K, every: int = EVERY) -> DataFrame:
    """For each row whose vec_id is divisible by every, its k highest integer inner products with all other rows:
    query_id, rank (from 1), vec_id, score; all others where there are fewer; ties go to the smaller vec_id.

    A component x counts as floor(1024 * x). Vectors that are null, hold null or non-finite components or have no vec_id
    take no part; a shorter vector counts as if filled up with 0. Rows with the query's vec_id are its own, and together
    one query: of different vectors the one whose bytes are smallest asks. A candidate's vec_id that comes in several rows
    counts with each. Scores are exact below 2**53.

    Pivots are distinct vectors chosen by a hash, at most MOST_PIVOTS; they and the cells' summaries (rows, radius) are all
    that the driver sees, and what is broadcast has at most MOST_PIVOTS**2 short rows. Bounds tell which cells a group of queries needs; queries go to blocks of those cells, and a cell
    with many rows, of equal vectors too, is several blocks. Each block of data with each block of queries is solved by a
    task, and the best of the blocks' best are taken.
    """
    spark = embeddings.sparkSession
    with Scratch(spark) as tmp:
        found = _best(tmp, embeddings, k, every)
        return stored(found, "top") if found is not None else spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")


def _best(tmp: Scratch, embeddings: DataFrame, k: int, every: int) -> DataFrame | None:
    """top_k(), or None where there are no queries."""
    spark = tmp.spark
    rows = embeddings.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>")).mapInArrow(_packed, "vec_id long, vector binary")
    rows = tmp.stored(rows, "vectors")
    total, width = rows.agg(F.count("*"), F.max(F.length("vector"))).first()
    if not total:
        return None
    width = max(1, width // 8)
    most = int(min(MOST_PIVOTS, max(1, total**0.5 // 8)))
    chosen = rows.orderBy(F.xxhash64("vec_id"), "vec_id", "vector").limit(4 * most).collect()
    pivots = _matrix(pa.array(list(dict.fromkeys(bytes(r.vector) for r in chosen))[:most]), width)
    cells = tmp.stored(rows.mapInArrow(_assigner(pivots), "vec_id long, vector binary, cell int, far double"), "cells")
    query = F.col("vec_id") % every == 0
    queries = cells.filter(query).groupBy("vec_id").agg(F.min_by(F.struct("vector", "cell", "far"), "vector").alias("v"), F.count("*").alias("n"))
    queries = tmp.stored(queries.select("vec_id", "v.*", "n"), "queries")
    counts, radius, query_counts, query_radius = np.zeros((4, len(pivots)))
    for r in cells.groupBy("cell").agg(F.count("*").alias("n"), F.max("far").alias("far")).collect():
        counts[r.cell], radius[r.cell] = r.n, r.far
    for r in queries.groupBy("cell").agg(F.count("*").alias("n"), F.max("far").alias("far")).collect():
        query_counts[r.cell], query_radius[r.cell] = r.n, r.far
    if not query_counts.any():
        return None
    own = np.zeros(len(pivots))
    for r in cells.filter(query).groupBy("cell", "vec_id").count().groupBy("cell").agg(F.max("count").alias("n")).collect():
        own[r.cell] = r.n
    may = needed(pivots, counts, radius, query_radius, k, own, queries.agg(F.max("n")).first()[0]) & (query_counts > 0)[:, None]

    splits = np.maximum(1, -(-counts // BLOCK_ROWS)).astype(int)
    first, parts, at, filled = [], [], 0, 0  # of each group of queries its first block and number of blocks
    for n in query_counts.astype(int).tolist():
        if filled and filled + n > QUERY_ROWS:
            at, filled = at + 1, 0
        parts.append(max(1, -(-n // QUERY_ROWS)))
        first.append(at)
        at, filled = (at + parts[-1], 0) if parts[-1] > 1 else (at, filled + n)
    # Tables of at most as many rows as there are pairs of cells; the blocks that they stand for are made where they are used.
    groups = spark.createDataFrame([(g, first[g], parts[g]) for g in range(len(pivots))], "cell int, first int, parts int")
    to_cells = spark.createDataFrame([(g, j, int(splits[j])) for g, j in np.argwhere(may).tolist()], "cell int, qcell int, qsplits int")
    spans = [(j, int(splits[j]), _joined([(first[g], first[g] + parts[g] - 1) for g in np.flatnonzero(may[:, j])])) for j in range(len(pivots))]
    to_blocks = spark.createDataFrame(spans, "cell int, splits int, spans array<struct<low: int, high: int>>")

    data = cells.join(F.broadcast(to_blocks), "cell").withColumn("block", F.explode(F.expr("flatten(transform(spans, s -> sequence(s.low, s.high)))")))
    data = data.select("vec_id", "vector", "cell", F.pmod(F.xxhash64("vec_id"), "splits").cast("int").alias("split"), "block")
    asked = queries.join(F.broadcast(groups), "cell").withColumn("qblock", (F.col("first") + F.pmod(F.xxhash64("vec_id"), "parts")).cast("int"))
    asked = asked.join(F.broadcast(to_cells), "cell").withColumn("qsplit", F.explode(F.expr("sequence(0, qsplits - 1)")))
    asked = asked.select(F.col("vec_id").alias("query_id"), F.col("vector").alias("asked"), "qcell", "qsplit", "qblock")
    found = asked.groupBy("qcell", "qsplit", "qblock").cogroup(data.groupBy("cell", "split", "block")).applyInArrow(_solver(width, k), "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")


def _joined(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans of whole numbers, ends included, without overlaps."""
    out: list[tuple[int, int]] = []
    for low, high in sorted(spans):
        if out and low <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(high, out[-1][1]))
        else:
            out.append((low, high))
    return out
