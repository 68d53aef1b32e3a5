"""Exact top-k search by columnar branch and bound."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import by_blocks

#: Queries that one broadcast holds at most (64 dimensions: 4 MB); more queries take more passes.
QUERY_BLOCK = 8_192
#: Rows of a chunk in vertical layout, queries scored against it at once, dimensions added at a time.
CHUNK, TILE, DIM_BLOCK = 8_192, 128, 16
#: A pair list replaces the dense block once fewer than this share of the pairs survives.
SPARSE = 0.2

OUT = "query_id long, query_row long, vec_id long, score long"


def quantised(column: pa.Array, scale: float) -> tuple[list[tuple[int, np.ndarray, np.ndarray]], None]:
    """(dimension, rows, matrix of floor(scale * x)) for each length of vector; invalid vectors are left out."""
    column = column.cast(pa.list_(pa.float64()))
    lengths = np.asarray(column.value_lengths().fill_null(-1))
    flat = column.flatten()
    values = np.asarray(flat.fill_null(np.nan), dtype=np.float64)
    ends = np.cumsum(np.maximum(lengths, 0))
    found = []
    for d in np.unique(lengths[lengths > 0]):
        rows = np.flatnonzero(lengths == d)
        at = values[(ends[rows] - d)[:, None] + np.arange(d)]
        good = np.isfinite(at).all(axis=1)
        found.append((int(d), rows[good], np.floor(at[good] * scale)))
    return found


class Running:
    """The best k of each query so far, by score, ties to the smaller id."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.scores = np.full((n, k), np.iinfo(np.int64).min)
        self.ids = np.full((n, k), np.iinfo(np.int64).max)
        self.full = np.zeros(n, np.int64)

    def threshold(self) -> np.ndarray:
        return np.where(self.full >= self.k, self.scores[:, -1].astype(np.float64), -np.inf)

    def add(self, q: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        if not len(q):
            return
        touched = np.unique(q)
        kept = np.arange(self.k)[None, :] < self.full[touched][:, None]
        old_q = np.repeat(touched, self.k).reshape(-1, self.k)[kept]
        q = np.concatenate([old_q, q])
        ids = np.concatenate([self.ids[touched][kept], ids])
        scores = np.concatenate([self.scores[touched][kept], scores])
        order = np.lexsort((ids, -scores, q))
        q, ids, scores = q[order], ids[order], scores[order]
        starts = np.searchsorted(q, touched)
        rank = np.arange(len(q)) - np.repeat(starts, np.diff(np.append(starts, len(q))))
        best = rank < self.k
        self.scores[q[best], rank[best]] = scores[best]
        self.ids[q[best], rank[best]] = ids[best]
        self.full[touched] = np.minimum(np.diff(np.append(starts, len(q))), self.k)


def search_chunk(queries: np.ndarray, query_ids: np.ndarray, at: np.ndarray, chunk: np.ndarray, ids: np.ndarray, best: Running) -> None:
    """Adds the chunk's rows to the running best of the queries ``at``.

    The distances grow by blocks of dimensions over a vertical layout. After each block a pair survives only if
    what it has, plus the most that the dimensions to come can add (Cauchy-Schwarz over their mass), reaches the
    query's k-th score; survivors are compacted to a list of pairs. All values are whole numbers.
    """
    d = chunk.shape[1]
    if max(1.0, np.abs(queries).max(initial=0)) * max(1.0, np.abs(chunk).max(initial=0)) * d >= 2.0**52:
        whole = np.array([[int(x) for x in row] for row in chunk], dtype=object)
        low, high = -(2**63), 2**63 - 1
        for i, row in enumerate(queries):
            other = np.flatnonzero(ids != query_ids[i])
            got = [min(max(int(x), low), high) for x in whole[other] @ np.array([int(x) for x in row], dtype=object)]
            best.add(np.full(len(other), at[i]), ids[other], np.array(got, dtype=np.int64))
        return
    order = np.argsort(-np.square(chunk).sum(axis=0), kind="stable")
    vertical = np.ascontiguousarray(chunk.T[order])
    blocks = [slice(i, min(i + DIM_BLOCK, d)) for i in range(0, d, DIM_BLOCK)]
    left = np.sqrt(np.stack([np.square(vertical[b.stop :]).sum(axis=0) for b in blocks]))
    for first in range(0, len(queries), TILE):
        tile, own = queries[first : first + TILE][:, order], at[first : first + TILE]
        mass = np.sqrt(np.stack([np.square(tile[:, b.stop :]).sum(axis=1) for b in blocks]))
        need = best.threshold()[own]
        part = np.zeros((len(tile), len(ids)))
        pairs = None
        for i, b in enumerate(blocks):
            if pairs is None:
                part += tile[:, b] @ vertical[b]
                if i + 1 < len(blocks) and np.isfinite(need).any():
                    alive = part + mass[i][:, None] * left[i][None, :] >= need[:, None] - 0.5
                    if np.count_nonzero(alive) < SPARSE * alive.size:
                        pairs = np.nonzero(alive)
                        score = part[pairs]
            else:
                q, c = pairs
                score = score + np.einsum("ij,ij->i", tile[q, b], vertical[b].T[c])
                alive = score + mass[i][q] * left[i][c] >= need[q] - 0.5
                pairs, score = (q[alive], c[alive]), score[alive]
        if pairs is None:
            part[query_ids[first : first + TILE][:, None] == ids[None, :]] = -np.inf
            if len(ids) > best.k:
                need = np.maximum(need, -np.partition(-part, best.k - 1, axis=1)[:, best.k - 1])
            pairs = np.nonzero((part >= need[:, None]) & np.isfinite(part))
            score = part[pairs]
        q, c = pairs
        keep = query_ids[first : first + TILE][q] != ids[c]
        q, c, score = q[keep], c[keep], score[keep]
        best.add(own[q], ids[c], score.astype(np.int64))


def scanner(shared, k: int, scale: float):
    """The local search of one partition: its rows against the broadcast queries."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query_ids, query_rows, groups = shared.value
        best = Running(len(query_ids), k)
        waiting: dict[int, list] = {}

        def flush(d: int) -> None:
            ids, rows = (np.concatenate(x) for x in zip(*waiting.pop(d), strict=True))
            own = groups[d][0]
            for i in range(0, len(ids), CHUNK):
                search_chunk(groups[d][1], query_ids[own], own, rows[i : i + CHUNK], ids[i : i + CHUNK], best)

        for data in batches:
            ids = np.asarray(data.column(0), dtype=np.int64)
            for d, rows, matrix in quantised(data.column(1), scale):
                if d in groups and len(rows):
                    waiting.setdefault(d, []).append((ids[rows], matrix))
                    if sum(len(x[0]) for x in waiting[d]) >= CHUNK:
                        flush(d)
        for d in list(waiting):
            flush(d)
        q, rank = np.nonzero(np.arange(k)[None, :] < best.full[:, None])
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (query_ids[q], query_rows[q], best.ids[q, rank], best.scores[q, rank])], names=["query_id", "query_row", "vec_id", "score"])

    return scan


def exact_topk(vectors: DataFrame, is_query: Column, *, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 10, scale: float = 1024.0, query_block: int = QUERY_BLOCK) -> DataFrame:
    """The k rows with the highest integer inner product for each query row, ties to the smaller id.

    Components become floor(scale * x) in double precision. Queries are the rows where ``is_query`` holds; a query's
    own id is no candidate. Rows with a null id, and vectors that are null, empty or hold a null or non-finite
    component, take no part; vectors of different lengths do not meet. Repeated query rows each get their own result
    (``query_row`` tells them apart); repeated candidate rows each count. An empty table gives an empty result. A
    score beyond a long is clipped to its range.

    The queries travel to the rows in blocks of at most ``query_block``, one scan for each block, so what is
    broadcast has a fixed bound; each partition returns its own best k for each query, and one window over those
    picks the winners.
    """
    spark = vectors.sparkSession
    base = vectors.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"), F.coalesce(is_query, F.lit(False)).alias("q"))
    rows = base.select("id", "v")
    numbers, passes = 0, []
    for block in by_blocks(base.where("q").select("id", "v").toLocalIterator(), query_block):
        ids = np.array([r[0] for r in block], dtype=np.int64)
        groups = {d: (own, matrix) for d, own, matrix in quantised(pa.array([r[1] for r in block], pa.list_(pa.float64())), scale) if len(own)}
        shared = spark.sparkContext.broadcast((ids, np.arange(numbers, numbers + len(ids)), groups))
        numbers += len(ids)
        passes.append(rows.mapInArrow(scanner(shared, k, scale), OUT))
    if not passes:
        return spark.createDataFrame([], "query_id long, query_row long, rank int, vec_id long, score long")
    found = passes[0]
    for other in passes[1:]:
        found = found.unionByName(other)
    order = Window.partitionBy("query_id", "query_row").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "query_row", "rank", "vec_id", "score")
