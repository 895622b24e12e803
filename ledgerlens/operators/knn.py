"""Exact nearest neighbours of many queries in one scan of the vectors.

``Nearest`` keeps the k nearest vectors of every query of a block: one matrix product per tile gives approximate squared
distances, those that may still count are computed directly, and exactly k per query stay, by (distance to
``ORDER_DECIMALS`` decimals, id), however many vectors tie.

Two plans use it. Few queries are broadcast, below a checked bound, and meet the vectors where these are read. More queries are
joined in blocks: vectors and queries are packed into blocks of rows, the vectors' dealt to groups that fit in memory and every
query block sent to every group; a task loads its group and streams the query blocks past it. Nothing passes the
driver but counts, and at most k rows per group and query leave a task. A window per query merges them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Distances are ordered on this many decimals, then by id: float noise in
# the last bits never decides an order.
ORDER_DECIMALS = 9
TILE_ROWS = 8192
TILE_QUERIES = 256
PAIRS = 1 << 16
VECTOR_GROUP_BYTES = 64 << 20
QUERY_BLOCK_ROWS = 512
_LAST = np.iinfo(np.int64).max

Mask = Callable[[int, int, int, int], np.ndarray]


class Nearest:
    """The k nearest of the vectors seen so far, for every query of a block."""

    def __init__(self, queries: np.ndarray, k: int):
        self.q, self.k = queries, k
        self.q2 = (queries * queries).sum(axis=1)
        self.key = np.full((len(queries), k), np.inf)
        self.distance = np.full((len(queries), k), np.inf)
        self.id = np.full((len(queries), k), _LAST)
        self.ref = np.full((len(queries), k), -1)

    def update(self, ids: np.ndarray, x: np.ndarray, first_ref: int = 0, mask: Mask | None = None) -> None:
        """Vectors ``x`` of the ids; ``mask(lo, hi, a, z)`` says which of the rows lo..hi queries a..z may take."""
        for lo in range(0, len(ids), TILE_ROWS):
            hi = min(lo + TILE_ROWS, len(ids))
            tile = x[lo:hi].astype(np.float64)
            t2 = (tile * tile).sum(axis=1)
            for a in range(0, len(self.q), TILE_QUERIES):
                z = min(a + TILE_QUERIES, len(self.q))
                near = t2[None, :] + self.q2[a:z, None] - 2.0 * (self.q[a:z] @ tile.T)
                if mask is not None:
                    near = np.where(mask(lo, hi, a, z).T, near, np.inf)
                self._take(a, near, tile, ids[lo:hi], first_ref + lo, 1e-7 * (1.0 + t2.max() + self.q2[a:z]))

    def _take(self, a: int, near: np.ndarray, tile: np.ndarray, ids: np.ndarray, first_ref: int, slack: np.ndarray) -> None:
        """``slack`` covers the rounding of the expanded form."""
        limit = self.key[a:a + len(near), -1] + slack
        may = near <= np.where(np.isfinite(limit), limit, np.finfo(float).max)[:, None]
        counts = may.sum(axis=1)
        many = np.flatnonzero(counts > 4 * self.k)
        if len(many):
            kth = np.partition(near[many], self.k - 1, axis=1)[:, self.k - 1]
            may[many] &= near[many] <= np.where(np.isfinite(kth), kth + slack[many], np.finfo(float).max)[:, None]
            counts[many] = may[many].sum(axis=1)
        rows = np.flatnonzero(counts)
        at = 0
        while at < len(rows):                                     # as many queries as make PAIRS pairs, one at least
            upto = at + max(1, int(np.searchsorted(np.cumsum(counts[rows[at:]]), PAIRS, side="right")))
            q, v = np.nonzero(may[rows[at:upto]])
            q = rows[at:upto][q]
            for p in range(0, len(q), PAIRS):                     # vectors that tie for one query
                self._merge(a + q[p:p + PAIRS], v[p:p + PAIRS], tile, ids, first_ref)
            at = upto

    def _merge(self, q: np.ndarray, v: np.ndarray, tile: np.ndarray, ids: np.ndarray, first_ref: int) -> None:
        exact = ((tile[v] - self.q[q]) ** 2).sum(axis=1)
        own = np.unique(q)
        owner = np.concatenate([q, np.repeat(own, self.k)])
        distance = np.concatenate([exact, self.distance[own].ravel()])
        key = np.concatenate([np.round(exact, ORDER_DECIMALS), self.key[own].ravel()])
        id_ = np.concatenate([ids[v], self.id[own].ravel()])
        ref = np.concatenate([first_ref + v, self.ref[own].ravel()])
        order = np.lexsort((id_, key, owner))
        nth = np.arange(len(order)) - np.searchsorted(owner[order], owner[order], side="left")
        order = order[nth < self.k].reshape(len(own), self.k)
        self.distance[own], self.key[own], self.id[own], self.ref[own] = distance[order], key[order], id_[order], ref[order]

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Query number, id, order key, distance and reference of every neighbour held."""
        q, n = np.nonzero(np.isfinite(self.key))
        return q, self.id[q, n], self.key[q, n], self.distance[q, n], self.ref[q, n]


def matrix(col: pa.Array, n: int, dim: int) -> np.ndarray:
    return col.flatten().to_numpy(zero_copy_only=False).reshape(n, dim)


def _ids(col: pa.Array) -> np.ndarray:
    return col.to_numpy(zero_copy_only=False).astype(np.int64)


def broadcast_search(vectors: DataFrame, sent, k: int, dim: int, payload: tuple, mask_of: Callable | None, schema: str) -> DataFrame:
    """Vectors where they are read against the broadcast ``(qids, matrix, filters)``; payload columns go with the neighbours.

    Columns 0 and 1 of ``vectors`` are id and vector.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qids, qmat, filters = sent.value
        best, held, base = Nearest(qmat, k), None, 0
        for b in batches:
            n = b.num_rows
            if n == 0 or len(qids) == 0:
                continue
            mask = None if mask_of is None else (lambda lo, hi, a, z, b=b: mask_of(b.slice(lo, hi - lo), filters, a, z))
            best.update(_ids(b.column(0)), matrix(b.column(1), n, dim), base, mask)
            if payload:                     # rows that are still held, and those of this batch that came in
                both = pa.Table.from_batches([b]).select(list(payload))
                both = both if held is None else pa.concat_tables([held, both])
                used, at = np.unique(best.ref, return_inverse=True)
                gap = int(len(used) > 0 and used[0] < 0)
                held = both.take(pa.array(used[gap:]))
                best.ref = at.reshape(best.ref.shape) - gap
                base = held.num_rows
        q, ids, key, distance, ref = best.rows()
        if len(q):
            cols = [pa.array(qids[q]), pa.array(ids), pa.array(key), pa.array(distance)]
            if payload:
                taken = held.take(pa.array(ref))
                cols += [taken.column(c).combine_chunks() for c in payload]
            yield pa.RecordBatch.from_arrays(cols, names=["qid", "id", "order_key", "distance", *payload])

    return vectors.mapInArrow(run, schema)


def _packed(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as w:
        w.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _unpacked(data: bytes) -> pa.RecordBatch:
    with pa.ipc.open_stream(data) as r:
        return r.read_next_batch()


def blocks(df: DataFrame, rows: int, groups: int) -> DataFrame:
    """``(grp, data)``: the rows in blocks of at most ``rows``, dealt to the groups in turn."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = TaskContext.get().partitionId() * 7919
        for b in batches:
            for at in range(0, b.num_rows, rows):
                data = _packed(b.slice(at, rows))
                yield pa.RecordBatch.from_arrays([pa.array([n % groups], pa.int32()), pa.array([data], pa.binary())], ["grp", "data"])
                n += 1

    return df.mapInArrow(pack, "grp int, data binary")


def block_search(vectors: DataFrame, queries: DataFrame, k: int, dim: int, mask_of: Callable | None,
                 filters_of: Callable | None, group_bytes: int = VECTOR_GROUP_BYTES) -> DataFrame:
    """``(qid, id, order_key, distance)`` of at most k neighbours per vector group and query.

    Columns 0 and 1 are id and vector on both sides, any others feed the filters.
    """
    spark = vectors.sparkSession
    n = vectors.select(vectors.columns[0]).count()
    spread = min(spark.sparkContext.defaultParallelism, -(-n // 1024))
    groups = max(1, -(-n * dim * 4 // group_bytes), spread)
    rows = max(1, min(TILE_ROWS, -(-n // (4 * groups))))
    every = F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("grp")
    both = (blocks(vectors, rows, groups).select("grp", F.lit(0).alias("kind"), "data")
            .unionAll(blocks(queries, QUERY_BLOCK_ROWS, 1).select(every, F.lit(1).alias("kind"), "data")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grp, held = None, []
        for b in batches:
            for g, kind, data in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                if g != grp:
                    grp, held = g, []
                block = _unpacked(data)
                if kind == 0:
                    held.append((_ids(block.column(0)), matrix(block.column(1), block.num_rows, dim), block))
                    continue
                if not held:
                    continue
                qids = _ids(block.column(0))
                best = Nearest(matrix(block.column(1), block.num_rows, dim).astype(np.float64), k)
                filters = None if filters_of is None else filters_of(block)
                for ids, x, own in held:
                    mask = None if mask_of is None else (lambda lo, hi, a, z, own=own, f=filters: mask_of(own.slice(lo, hi - lo), f, a, z))
                    best.update(ids, x, 0, mask)
                q, ids, key, distance, _ = best.rows()
                yield pa.RecordBatch.from_arrays([pa.array(qids[q]), pa.array(ids), pa.array(key), pa.array(distance)],
                                                 names=["qid", "id", "order_key", "distance"])

    return (both.repartitionById(groups, "grp").sortWithinPartitions("grp", "kind")
            .mapInArrow(run, "qid long, id long, order_key double, distance double"))


def ranked(found: DataFrame, k: int) -> DataFrame:
    """The k nearest of each query over all tasks, with ``rank``."""
    w = Window.partitionBy("qid").orderBy("order_key", "id")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).drop("order_key")
