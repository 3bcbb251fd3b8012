"""Exact nearest neighbours: a stated query set against all rows, in blocks.

A block of queries is broadcast, more are read tile by tile from the shared folder; every task keeps the k best of its
rows for each query (matrix products on Arrow batches, the few candidates compared exactly), so the shuffle carries
k rows for each query and task. Order is by distance, then id.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.vectors import first_not_finite, metric_name, splitmix64, wrong_width
from ..sources.storage import scratch

#: Numbers in the vectors of a block of queries.
BLOCK_VALUES, HITS = 4_000_000, "qid long, vec_id long, distance double, rank int"
#: Pairs of a query and a row compared at once by a matrix product, and numbers gathered for exact comparisons.
PAIRS, GATHERED = 1 << 20, 1 << 21
#: Buckets are joined where no more than one pair in so many meets in them.
SPARSE = 16


def validate_vectors(df: DataFrame, dim: int, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """A row for each bad vector: ``vec_id, problem, position`` (of the first value that isn't finite)."""
    at = first_not_finite(vec_col)
    bad = df.select(F.col(id_col).alias("vec_id"), wrong_width(vec_col, dim).alias("w"), at.alias("at"))
    return bad.where(F.col("w") | F.col("at").isNotNull()).select("vec_id", F.when(F.col("w"), "dimension").otherwise("non_finite").alias("problem"), F.when(~F.col("w"), F.col("at")).alias("position"))


def require_valid(df: DataFrame, dim: int, id_col: str = "vec_id", vec_col: str = "embedding") -> None:
    """Raise before anything is stored if a vector of the batch is bad."""
    bad = validate_vectors(df, dim, id_col, vec_col).orderBy("vec_id").limit(1).collect()
    if bad:
        raise ValueError(f"vector {bad[0][0]}: {bad[0][1]} at {bad[0][2]}")


def matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def pair_distances(q: np.ndarray, x: np.ndarray, metric: str) -> np.ndarray:
    """Distances of all pairs by matrix products: fast, but the last bits depend on a pair's place."""
    s = comparison(q, x, metric)
    return np.sqrt(np.maximum(s, 0, out=s), out=s) if metric == "euclidean" else s


def comparison(q: np.ndarray, x: np.ndarray, metric: str) -> np.ndarray:
    """What orders as the distances do, without their square roots."""
    near = q @ x.T
    if metric == "euclidean":
        near *= -2
        near += (q * q).sum(1)[:, None]
        near += (x * x).sum(1)[None, :]
        return near
    n = np.multiply.outer(np.sqrt((q * q).sum(1)), np.sqrt((x * x).sum(1)))
    zero = n == 0
    n[zero] = 1
    near /= n
    np.subtract(1, near, out=near)
    near[zero] = 1
    return near


def exact_distances(q: np.ndarray, x: np.ndarray, metric: str, step: int = 1 << 20) -> np.ndarray:
    """Distances of rows of ``q`` and ``x``, pair by pair: equal vectors have equal distances, to the last bit."""
    out, step = np.empty(len(q)), max(1, step // max(1, q.shape[1]))
    for s in range(0, len(q), step):
        a, b = q[s : s + step], x[s : s + step]
        if metric == "euclidean":
            out[s : s + step] = np.sqrt(((a - b) ** 2).sum(1))
        else:
            n = np.sqrt((a * a).sum(1)) * np.sqrt((b * b).sum(1))
            out[s : s + step] = np.where(n == 0, 1.0, 1 - (a * b).sum(1) / np.where(n == 0, 1, n))
    return out


def fewest(x: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray | slice:
    """Which rows are among the ``k`` of smallest id of those equal to them: no other row can be among k nearest."""
    if len(x) <= k or not x.shape[1]:
        return slice(None)
    mix = splitmix64(np.arange(x.shape[1]), 0) | np.uint64(1)
    h = (np.ascontiguousarray(x).view(np.uint64) * mix).sum(1)
    if len(np.unique(h)) == len(h) or len(np.unique(ids)) < len(ids):
        return slice(None)
    order = np.lexsort((ids, h))
    h, x = h[order], x[order]
    new = np.append(True, (h[1:] != h[:-1]) | (x[1:] != x[:-1]).any(1))
    at = np.arange(len(order))
    return np.sort(order[at - np.maximum.accumulate(np.where(new, at, 0)) < k])


def meetings(asks: np.ndarray, has: np.ndarray) -> np.ndarray:
    """How many times each row of keys ``asks`` meets a row of ``has``, over all tables."""
    n = np.zeros(len(asks), np.int64)
    for a, b in zip(asks.T, has.T):
        b = np.sort(b)
        n += np.searchsorted(b, a, "right") - np.searchsorted(b, a, "left")
    return n


def met(asks: np.ndarray, has: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of rows that share a key in some table, once each."""
    found = []
    for a, b in zip(asks.T, has.T):
        order = np.argsort(b, kind="stable")
        low, high = (np.searchsorted(b[order], a, side) for side in ("left", "right"))
        n = high - low
        at = np.repeat(np.arange(len(a)), n)
        found.append(at * len(has) + order[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)])
    return np.divmod(np.unique(np.concatenate(found)), len(has))


class Best:
    """The k nearest of each query by (distance, id), gathered from blocks of rows.

    Whatever the number of queries, rows and ties, ``PAIRS`` pairs are compared at once, and exactly as many as
    have ``GATHERED`` numbers.
    """

    def __init__(self, queries: int, k: int):
        self.n, self.k, self.worst, self.held = queries, k, np.full(queries, np.inf), np.zeros(queries, np.int64)
        self.i, self.d = np.zeros((queries, k), np.int64), np.zeros((queries, k))

    def look(self, q: np.ndarray, x: np.ndarray, ids: np.ndarray, metric: str, rows: np.ndarray | None = None, other: np.ndarray | None = None, keys: tuple[np.ndarray, np.ndarray] | None = None) -> None:
        """Take the block ``x`` into account for all queries ``q`` or those in ``rows``; ``other``: ids not to be paired.

        Matrix products pick whatever can be among the k nearest, rounding allowed for; those few are then compared exactly.
        With ``keys`` (of queries and rows, a column for each table) only pairs that share a key in some table count.
        """
        rows = np.arange(self.n) if rows is None else rows
        if not self.k or not len(rows) or not len(x):
            return
        some = fewest(x, ids, self.k + (other is not None))
        x, ids = x[some], ids[some]
        if keys is not None:
            asks, has = keys[0][rows], keys[1][some]
            if (pairs := meetings(asks, has)).sum() * SPARSE <= len(rows) * len(x):
                stop = np.searchsorted(np.cumsum(pairs), np.arange(PAIRS // SPARSE, pairs.sum(), PAIRS // SPARSE), "right")
                for part in np.split(np.arange(len(rows)), np.unique(stop)):
                    a, c = met(asks[part], has)
                    self._exact(q, x, ids, metric, rows, part[a], c, other)
                return
        wide = min(len(x), max(2048, PAIRS // len(rows)))
        tall = max(1, PAIRS // wide)
        for s in range(0, len(x), wide):
            for r in range(0, len(rows), tall):
                self._tile(q, x[s : s + wide], ids[s : s + wide], metric, rows[r : r + tall], other, keys and (asks[r : r + tall], has[s : s + wide]))

    def _exact(self, q, x, ids, metric, rows, at, col, other=None) -> None:
        """Merge the pairs of ``rows[at]`` and ``x[col]``."""
        if other is not None:
            apart = other[rows[at]] != ids[col]
            at, col = at[apart], col[apart]
        step = max(1, GATHERED // q.shape[1]) if q.shape[1] else PAIRS
        for s in range(0, len(at), step):
            a, c = rows[at[s : s + step]], col[s : s + step]
            d = exact_distances(q[a], x[c], metric)
            ok = np.isfinite(d)
            self.merge(a[ok], ids[c[ok]], d[ok])

    def _tile(self, q, x, ids, metric, rows, other, keys) -> None:
        whole, q = q, q[rows]
        near, limit = comparison(q, x, metric), self.worst[rows]
        if other is not None:
            near[other[rows][:, None] == ids[None, :]] = np.inf
        if metric == "euclidean":
            limit, slack = limit * limit, 1e-12 * ((q * q).sum(1) + (x * x).sum(1).max(initial=0.0)) + 1e-300
        else:
            slack = np.full(len(q), 1e-10)
        free = ~np.isfinite(limit)
        if keys is not None and free.any():
            apart = np.ones((free.sum(), len(x)), bool)
            for a, b in zip(keys[0][free].T, keys[1].T):
                apart &= a[:, None] != b[None, :]
            near[free] = np.where(apart, np.inf, near[free])
        if near.shape[1] > self.k and free.any():
            limit[free] = np.partition(near[free], self.k - 1, axis=1)[:, self.k - 1] + slack[free]
        found = near <= (limit + slack)[:, None]
        if not np.isfinite(limit).all():
            found &= np.isfinite(near)
        at, col = np.nonzero(found)
        if keys is not None:
            own = np.zeros(len(at), bool)
            for a, b in zip(keys[0].T, keys[1].T):
                own |= a[at] == b[col]
            at, col = at[own], col[own]
        self._exact(whole, x, ids, metric, rows, at, col)

    def merge(self, q: np.ndarray, i: np.ndarray, d: np.ndarray) -> None:
        """Hits as three columns: the query's row, the id, the distance."""
        asked, q = np.unique(q, return_inverse=True)
        own = np.arange(self.k)[None, :] < self.held[asked][:, None]
        q, i, d = np.concatenate([np.nonzero(own)[0], q]), np.concatenate([self.i[asked][own], i]), np.concatenate([self.d[asked][own], d])
        order = np.lexsort((i, d, q))
        q, i, d = q[order], i[order], d[order]
        rank = np.arange(len(q)) - np.searchsorted(q, np.arange(len(asked)))[q]
        keep = rank < self.k
        q, rank = q[keep], rank[keep]
        self.i[asked[q], rank], self.d[asked[q], rank] = i[keep], d[keep]
        self.held[asked] = np.bincount(q, minlength=len(asked))
        full = asked[self.held[asked] == self.k]
        if self.k:
            self.worst[full] = self.d[full, self.k - 1]

    def batch(self, qid: np.ndarray) -> pa.RecordBatch:
        own = np.arange(self.k)[None, :] < self.held[:, None]
        return pa.RecordBatch.from_arrays([pa.array(qid[np.nonzero(own)[0]]), pa.array(self.i[own]), pa.array(self.d[own])], ["qid", "vec_id", "distance"])


def arrays(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors of a table of two columns."""
    return t.column(0).to_numpy().astype(np.int64), matrix(t.column(1).combine_chunks())


def in_blocks(queries: DataFrame, query_id: str = "qid", vec_col: str = "embedding", size: int | None = None):
    """Arrays of ids and vectors, of ``size`` rows or about ``BLOCK_VALUES`` numbers at most; of more queries than
    that the driver reads one partition at a time."""
    asked = queries.select(F.col(query_id).cast("long").alias("qid"), F.col(vec_col).cast("array<double>").alias("q")).where("q is not null")
    one = asked.first()
    if one is None:
        return
    size = size or max(1, BLOCK_VALUES // max(1, len(one["q"])))
    some = asked.limit(size + 1).toArrow()
    if some.num_rows <= size:
        yield arrays(some)
        return
    rows: list = []
    for r in asked.toLocalIterator():
        rows.append(r)
        if len(rows) == size:
            yield np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.float64)
            rows = []
    if rows:
        yield np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.float64)


def by_blocks(spark: SparkSession, blocks, search) -> DataFrame:
    """``search(block)`` of every block of queries, as one table.

    A single block stays a plan. With more, each block's hits are written to the shared folder before the next
    but one is read, so neither the driver's memory nor the plan grows with the queries.
    """
    now, after = next(blocks, None), next(blocks, None)
    if now is None:
        return spark.createDataFrame([], HITS)
    if after is None:
        return search(now)
    folder = scratch(spark, "hits")
    while now is not None:
        search(now).write.mode("append").parquet(folder)
        now, after = after, next(blocks, None)
    return spark.read.schema(HITS).parquet(folder)


def knn(corpus: DataFrame, queries: DataFrame, k: int, metric: str = "cosine", id_col: str = "vec_id", query_id: str = "qid", vec_col: str = "embedding", exclude_self: bool = False, block: int | None = None, keys: Callable | None = None, query_col: str | None = None, reading: Callable = matrix) -> DataFrame:
    """``(qid, vec_id, distance, rank)`` of the k nearest rows of each query; k = 0 gives no rows, null vectors none.

    Up to ``block`` queries (by default of ``BLOCK_VALUES`` numbers in all) are broadcast. More are written to the shared folder once, in tiles of ``block`` rows that
    every task reads one after the other for each of its blocks of the corpus: one job, whatever the number of queries.
    ``keys`` (an array of vectors to a row of keys each) leaves only pairs that share one, column by column.
    ``reading`` makes vectors of a batch's ``vec_col`` (texts, say), whose vectors then needn't travel; queries have
    theirs in ``query_col``.
    """
    metric, spark = metric_name(metric), corpus.sparkSession
    if k < 0:
        raise ValueError("k must not be negative")
    if k == 0:
        return spark.createDataFrame([], HITS)
    side = corpus.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).alias("v")).where("v is not null")
    asked = queries.select(F.col(query_id).cast("long").alias("qid"), F.col(query_col or vec_col).cast("array<double>").alias("q")).where("q is not null")
    one = asked.first()
    if one is None:
        return spark.createDataFrame([], HITS)
    block = block or max(1, BLOCK_VALUES // max(1, len(one["q"]), k))
    few = asked.limit(block + 1).toArrow()  # at most a block of queries
    if few.num_rows <= block:
        handle = spark.sparkContext.broadcast(arrays(few))

        def run(batches):
            qid, q = handle.value
            held, asks = Best(len(qid), k), keys and keys(q)
            for ids, x in _read(batches, reading):
                held.look(q, x, ids, metric, other=qid if exclude_self else None, keys=keys and (asks, keys(x)))
            yield held.batch(qid)

        return ranked(side.mapInArrow(run, "qid long, vec_id long, distance double"), k)
    folder = scratch(spark, "queries")
    asked.write.option("maxRecordsPerFile", block).parquet(folder)

    def tiled(batches):
        from pyarrow import fs, parquet

        disk, root = fs.FileSystem.from_uri(folder if "://" in folder else "file://" + folder)
        tiles = sorted(x.path for x in disk.get_file_info(fs.FileSelector(root)) if x.path.endswith(".parquet"))
        for ids, x in _joined(_read(batches, reading)):
            own = keys and keys(x)
            for path in tiles:
                if not (t := parquet.read_table(path, filesystem=disk)).num_rows:
                    continue
                qid, q = arrays(t)
                held = Best(len(qid), k)
                held.look(q, x, ids, metric, other=qid if exclude_self else None, keys=keys and (keys(q), own))
                yield held.batch(qid)

    return ranked(side.mapInArrow(tiled, "qid long, vec_id long, distance double"), k)


def _read(batches, reading: Callable = matrix, step: int = 2048):
    """Ids and vectors of ``step`` rows at a time."""
    for b in batches:
        for s in range(0, b.num_rows, step):
            part = b.slice(s, step)
            yield part.column(0).to_numpy(), reading(part.column(1))


def _joined(parts, values: int = 16_000_000):
    """Ids and vectors of several parts at a time, up to ``values`` numbers."""
    ids, xs, n = [], [], 0
    for own, x in parts:
        if n and n + x.size > values:
            yield np.concatenate(ids), np.concatenate(xs)
            ids, xs, n = [], [], 0
        if len(x):
            ids.append(own)
            xs.append(x)
            n += x.size
    if ids:
        yield np.concatenate(ids), np.concatenate(xs)


def ranked(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("qid").orderBy("distance", "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def recall(truth: DataFrame, got: DataFrame, k: int) -> DataFrame:
    """One row: the mean over queries of the share of true neighbours found."""
    hit = got.select("qid", "vec_id").distinct().withColumn("hit", F.lit(1))
    per = truth.select("qid", "vec_id").join(hit, ["qid", "vec_id"], "left").groupBy("qid").agg(F.count("hit").alias("hits"), F.count("*").alias("n"))
    return per.agg(F.avg(F.col("hits") / F.col("n")).alias("recall"))
