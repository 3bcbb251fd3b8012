"""Approximate neighbours: inverted-file cells, random hyperplanes, and layered proximity graphs in shards."""

from __future__ import annotations

import heapq
import io

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vectors import levels, metric_name
from ..sources.storage import Versions, digest, joined_digest
from .knn import PAIRS, Best, by_blocks, comparison, exact_distances, in_blocks, knn, matrix, pair_distances, ranked, require_valid

SAMPLE = 10_000


def _unit(x: np.ndarray) -> np.ndarray:
    n = np.sqrt((x * x).sum(1, keepdims=True))
    return np.where(n > 0, x / np.where(n > 0, n, 1), x)


def nearest_cells(x: np.ndarray, centroids: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` nearest centroids of each row, nearest first; a bounded number of pairs at a time."""
    out, step = np.zeros((len(x), min(n, len(centroids))), np.int32), max(1, PAIRS // max(1, len(centroids)))
    for s in range(0, len(x), step):
        d = pair_distances(x[s : s + step], centroids, "euclidean")
        out[s : s + step] = d.argmin(1)[:, None] if n == 1 else d.argsort(1)[:, :n]
    return out


def visits(x: np.ndarray, centroids: np.ndarray, n: int) -> np.ndarray:
    """Which cells each row visits, a bit each: its ``n`` nearest."""
    out, step = np.zeros((len(x), -(-len(centroids) // 8)), np.uint8), 4096
    for s in range(0, len(x), step):
        probe = np.zeros((len(x[s : s + step]), len(centroids)), bool)
        np.put_along_axis(probe, nearest_cells(x[s : s + step], centroids, n).astype(np.int64), True, 1)
        out[s : s + step] = np.packbits(probe, axis=1)
    return out


def visitors(visits: np.ndarray, cell: int) -> np.ndarray:
    return np.flatnonzero(visits[:, cell >> 3] >> np.uint8(7 - (cell & 7)) & np.uint8(1))


def train_cells(vectors: DataFrame, cells: int, metric: str = "cosine", iterations: int = 10, seed: int = 0, id_col: str = "vec_id", vec_col: str = "embedding", sample: int = SAMPLE) -> np.ndarray:
    """Centroids by k-means on a bounded sample: the ``sample`` rows of least XXH64 of their id."""
    got = vectors.select(F.col(vec_col).cast("array<double>").alias("v"), F.xxhash64(id_col).alias("h")).where("v is not null").orderBy("h").limit(sample).toArrow()
    x = matrix(got.column("v").combine_chunks())
    x = _unit(x) if metric_name(metric) == "cosine" else x
    c = x[np.random.default_rng(seed).permutation(len(x))[:cells]]
    for _ in range(iterations):
        at = pair_distances(x, c, "euclidean").argmin(1)
        for j in range(len(c)):
            if (at == j).any():
                c[j] = x[at == j].mean(0)
    return c


def assign_cells(vectors: DataFrame, centroids: np.ndarray, metric: str = "cosine", id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``(vec_id, cell, embedding)`` of every row."""
    handle = vectors.sparkSession.sparkContext.broadcast(centroids)

    def run(batches):
        for b in batches:
            x = matrix(b.column(1))
            x = _unit(x) if metric_name(metric) == "cosine" else x
            cell = nearest_cells(x, handle.value, 1)[:, 0] if len(x) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(cell.astype(np.int32)), b.column(1)], ["vec_id", "cell", "embedding"])

    return vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("embedding")).mapInArrow(run, "vec_id long, cell int, embedding array<double>")


def ivf_search(index: DataFrame, centroids: np.ndarray, queries: tuple[np.ndarray, np.ndarray], k: int, nprobe: int, metric: str = "cosine") -> DataFrame:
    """k nearest rows among each query's ``nprobe`` nearest cells; ``queries`` is one bounded block."""
    metric = metric_name(metric)
    qid, q = queries
    handle = index.sparkSession.sparkContext.broadcast((qid, q, visits(_unit(q) if metric == "cosine" else q, centroids, nprobe)))

    def run(batches):
        qid, q, probe = handle.value
        held = Best(len(qid), k)
        for b in batches:
            ids, cell, x = b.column(0).to_numpy(), b.column(1).to_numpy(), matrix(b.column(2))
            for c in np.unique(cell):
                rows, asks = np.flatnonzero(cell == c), visitors(probe, int(c))
                if len(asks):
                    held.look(q, x[rows], ids[rows], metric, asks)
        yield held.batch(qid)

    return ranked(index.mapInArrow(run, "qid long, vec_id long, distance double"), k)


def lsh_keys(x: np.ndarray, tables: int, bits: int, seed: int = 0, step: int = 4096) -> np.ndarray:
    """A row's side of ``bits`` random hyperplanes in each of ``tables`` tables: its bucket there."""
    planes = np.random.default_rng(seed).standard_normal((tables, bits, x.shape[1])).reshape(tables * bits, x.shape[1])
    keys = np.zeros((len(x), tables), np.min_scalar_type((1 << bits) - 1))
    for s in range(0, len(x), step):
        side = (x[s : s + step] @ planes.T).reshape(-1, tables, bits) > 0
        keys[s : s + step] = (side * (1 << np.arange(bits))).sum(2)
    return keys


def lsh_search(vectors: DataFrame, queries: DataFrame, k: int, dim: int, tables: int = 16, bits: int = 6, seed: int = 0, metric: str = "cosine", block: int | None = None) -> DataFrame:
    """k nearest of the rows that share a bucket with the query, compared exactly; no table of pairs is made.

    Buckets of a block of rows are joined with those of the queries where they are small; where most pairs share one,
    a matrix product goes ahead and buckets are looked up for what is near enough.
    """

    def keys(x):
        if len(x) and x.shape[1] != dim:
            raise ValueError(f"vectors are of width {x.shape[1]}, not {dim}")
        return lsh_keys(x, tables, bits, seed)

    return knn(vectors, queries, k, metric, block=block, keys=keys)


class Graph:
    """A layered proximity graph over the vectors of one shard."""

    def __init__(self, dim: int, metric: str = "cosine", m: int = 16, ef_construction: int = 100, seed: int = 0x5EED):
        if dim < 1 or m < 2 or ef_construction < 1:
            raise ValueError("dim >= 1, m >= 2 and ef_construction >= 1 are needed")
        self.dim, self.metric, self.m, self.efc, self.seed = dim, metric_name(metric), m, ef_construction, seed
        self.x, self.links, self.entry, self.top = np.zeros((0, dim)), [], -1, -1

    def __len__(self):
        return len(self.links)

    def _far(self, q: np.ndarray, ids) -> np.ndarray:
        x = self.x[ids]
        return 1 - x @ q if self.metric == "cosine" else ((x - q) ** 2).sum(1)

    def _beam(self, q, starts: list[tuple[float, int]], ef: int, level: int) -> list[tuple[float, int]]:
        seen = {i for _, i in starts}
        open_, kept = list(starts), [(-d, i) for d, i in starts]
        heapq.heapify(open_)
        heapq.heapify(kept)
        while open_:
            d, i = heapq.heappop(open_)
            if len(kept) >= ef and d > -kept[0][0]:
                break
            new = [j for j in self.links[i][level] if j not in seen]
            if not new:
                continue
            seen.update(new)
            for e, j in zip(self._far(q, new).tolist(), new):
                if len(kept) < ef or e < -kept[0][0]:
                    heapq.heappush(open_, (e, j))
                    heapq.heappush(kept, (-e, j))
                    if len(kept) > ef:
                        heapq.heappop(kept)
        return sorted((-d, i) for d, i in kept)

    def _diverse(self, ids: np.ndarray, d: np.ndarray, m: int) -> list[int]:
        """Of candidates in order, keep what is nearer to the node than to all kept; fill up with the nearest left out."""
        if len(ids) <= m:
            return ids.tolist()
        x = self.x[ids]
        near = x @ x.T
        if self.metric == "cosine":
            near = 1 - near
        else:
            sq = np.diagonal(near)
            near = sq[:, None] + sq[None, :] - 2 * near
        closer = np.packbits(near < d[None, :], axis=1, bitorder="little")  # of a kept one: whom it shuts out
        kept, spare, shut = [], [], 0
        for c in range(len(ids)):
            if shut >> c & 1:
                spare.append(c)
                continue
            kept.append(c)
            if len(kept) == m:
                break
            shut |= int.from_bytes(closer[c].tobytes(), "little")
        return ids[kept + spare[: m - len(kept)]].tolist()

    def build(self, x: np.ndarray) -> "Graph":
        """Insert the rows of ``x`` after those held; in one call or in many, the graph is the same.

        Candidates are the nearest of all earlier nodes, not a beam's finds: shards are small enough to be scanned.
        """
        x = np.asarray(x, np.float64).reshape(len(x), self.dim)
        x = (_unit(x) if self.metric == "cosine" else x).astype(np.float32).astype(np.float64)
        start = len(self)
        self.x = np.concatenate([self.x, x])
        sq = (self.x * self.x).sum(1)
        upper = [[i for i, own in enumerate(self.links) if len(own) > layer] for layer in range(self.top + 1)]
        for n, level in zip(range(start, len(self.x)), levels(np.arange(start, len(self.x)), self.seed, self.m).tolist()):
            level = min(level, 127)
            d = self.x[:n] @ self.x[n]
            d = 1 - d if self.metric == "cosine" else np.maximum(sq[:n] + sq[n] - 2 * d, 0)
            self.links.append([[] for _ in range(level + 1)])
            for layer in range(min(level, self.top), -1, -1):
                ids = np.array(upper[layer]) if layer else np.arange(n)
                self.links[n][layer] = self._select(ids, d[ids], self.m)
                cap = self.cap(layer)
                for j in self.links[n][layer]:
                    own = self.links[j][layer]
                    own.append(n)
                    if len(own) > cap:
                        own = np.array(own)
                        self.links[j][layer] = self._select(own, self._far(self.x[j], own), cap)
            if level > self.top:
                self.entry, self.top = n, level
                upper += [[] for _ in range(level + 1 - len(upper))]
            for layer in range(1, level + 1):
                upper[layer].append(n)
        return self

    def _select(self, ids: np.ndarray, d: np.ndarray, m: int) -> list[int]:
        if len(ids) > max(self.efc, m + 1):
            near = np.argpartition(d, self.efc - 1)[: self.efc]
            ids, d = ids[near], d[near]
        order = np.lexsort((ids, d))
        return self._diverse(ids[order], d[order], m)

    def cap(self, layer: int) -> int:
        return self.m * (1 if layer else 2)

    def to_bytes(self) -> bytes:
        """The graph with its vectors, as a checked archive of plain arrays."""
        near = [ids for layers in self.links for ids in layers]
        out = io.BytesIO()
        head = np.array([self.dim, self.metric == "cosine", self.m, self.efc, self.seed, self.entry, self.top], np.int64)
        np.savez(out, head=head, x=self.x.astype(np.float32), layers=np.array([len(v) for v in self.links], np.int32), degree=np.array([len(v) for v in near], np.int32), near=np.array([j for v in near for j in v], np.int32))
        return out.getvalue()

    @staticmethod
    def vectors(data: bytes) -> np.ndarray:
        """The vectors of a stored graph, without its links."""
        with np.load(io.BytesIO(data), allow_pickle=False) as f:
            return f["x"].astype(np.float64)

    @classmethod
    def _stored(cls, data: bytes) -> tuple["Graph", dict]:
        """A graph without its links and the stored arrays; raises ``ValueError`` for anything that ``to_bytes`` can't have made."""
        try:
            with np.load(io.BytesIO(data), allow_pickle=False) as f:
                head, x, layers, degree, near = (f[k] for k in ("head", "x", "layers", "degree", "near"))
            dim, cosine, m, efc, seed, entry, top = head.tolist()
            g = cls(dim, "cosine" if cosine else "euclidean", m, efc, seed)
        except Exception as e:
            raise ValueError(f"not a graph: {e}") from e
        n = len(layers)
        level = np.arange(len(degree)) - np.repeat(np.cumsum(layers) - layers, layers) if n else np.zeros(0)
        rules = {
            "vectors": x.shape == (n, dim) and bool(np.isfinite(x).all()),
            "layers": bool(((layers >= 1) & (layers <= 128)).all()) and int(layers.sum()) == len(degree),
            "degrees": len(level) == len(degree) and bool(((degree >= 0) & (degree <= np.where(level == 0, 2 * m, m))).all()) and int(degree.sum()) == len(near),
            "neighbours": bool(((near >= 0) & (near < n)).all()),
            "entry": (entry, top) == (-1, -1) if not n else 0 <= entry < n and int(layers[entry]) == top + 1 == int(layers.max()),
        }
        if bad := [k for k, ok in rules.items() if not ok]:
            raise ValueError(f"broken graph: {', '.join(bad)}")
        if n and (layers[near] <= np.repeat(level, degree)).any():
            raise ValueError("broken graph: a link to a node below its layer")
        g.x, g.entry, g.top = x.astype(np.float64), entry, top
        return g, {"layers": layers, "degree": degree, "near": near}

    @classmethod
    def from_bytes(cls, data: bytes) -> "Graph":
        """Raises ``ValueError`` for anything that ``to_bytes`` can't have made."""
        g, s = cls._stored(data)
        lists = iter(np.split(s["near"], np.cumsum(s["degree"])[:-1]) if len(s["degree"]) else [])
        g.links = [[next(lists).tolist() for _ in range(k)] for k in s["layers"].tolist()]
        return g

    @classmethod
    def walked(cls, data: bytes, q: np.ndarray, k: int, ef: int):
        """Walks of all queries through a stored graph together: blocks ``(row of q, node, distance)`` of the k best of
        at least ``ef`` nodes seen.

        Distances are looked up in a matrix product, so this is for graphs that are cheaply scanned. A round follows the
        links of all nodes that are among a query's ``ef`` nearest seen, where ``search`` follows one at a time.
        """
        g, s = cls._stored(data)
        n, start, ef = len(g.x), np.cumsum(s["layers"]) - s["layers"], max(ef, k)
        if not n or not k:
            return
        first = np.cumsum(s["degree"]) - s["degree"]

        def table(level: int) -> np.ndarray:
            """Neighbours of each node on a layer; ``n`` is none."""
            nodes = np.flatnonzero(s["layers"] > level)
            own, at = s["degree"][start[nodes] + level].astype(np.int64), first[start[nodes] + level].astype(np.int64)
            within = np.arange(own.sum()) - np.repeat(np.cumsum(own) - own, own)
            out = np.full((n, max(1, own.max())), n)
            out[np.repeat(nodes, own), within] = s["near"][np.repeat(at, own) + within]
            return out

        tables, step = [table(level) for level in range(g.top + 1)], max(1, PAIRS // (n + 1))
        for b in range(0, len(q), step):
            ask = q[b : b + step]
            rows, d = np.arange(len(ask)), np.full((len(ask), n + 1), np.inf)
            d[:, :n] = comparison(ask, g.x, g.metric)
            at = np.full(len(ask), g.entry)
            for t in tables[:0:-1]:
                while True:
                    near = t[at]
                    to = near[rows, d[rows[:, None], near].argmin(1)]
                    if not (better := d[rows, to] < d[rows, at]).any():
                        break
                    at = np.where(better, to, at)
            seen, done = np.zeros(d.shape, bool), np.zeros(d.shape, bool)
            seen[rows, at] = True
            row, node = rows, at
            while len(row):
                done[row, node] = True
                seen.ravel()[(row[:, None] * (n + 1) + tables[0][node]).ravel()] = True
                seen[:, n] = False
                live = np.unique(row)
                v = np.where(seen[live], d[live], np.inf)
                limit = np.partition(v, ef - 1, axis=1)[:, ef - 1] if ef <= n else np.full(len(live), np.inf)
                row, node = np.nonzero((v <= limit[:, None]) & np.isfinite(v) & ~done[live])
                row = live[row]
            d[~seen] = np.inf
            best = np.argpartition(d, k - 1, axis=1)[:, :k] if k <= n else np.tile(np.arange(n), (len(ask), 1))
            row, node = np.repeat(rows, best.shape[1]), best.ravel()
            row, node = row[ok := np.isfinite(d[row, node])], node[ok]
            yield b + row, node, exact_distances(ask[row], g.x[node], g.metric)

    def search(self, q, k: int, ef: int | None = None) -> list[tuple[float, int]]:
        if not len(self) or not k:
            return []
        q = np.asarray(q, np.float64)
        q = _unit(q[None])[0] if self.metric == "cosine" else q
        at = [(float(self._far(q, [self.entry])[0]), self.entry)]
        for layer in range(self.top, 0, -1):
            at = self._beam(q, at, 1, layer)[:1]
        found = self._beam(q, at, max(ef or max(4 * k, 50), k), 0)[:k]
        return [(d if self.metric == "cosine" else float(np.sqrt(max(d, 0))), i) for d, i in found]


SHARD_ROWS, FEWEST = 2000, 250
SHARDS = "shard int, ids array<long>, graph binary"
#: What a step of a walk costs, in rows of a scan by matrix product; and up to how many shards queries are routed.
STEP_COST, MAX_SHARDS = 40, 100_000


def shard_count(spark: SparkSession, rows: int, shard_rows: int = SHARD_ROWS) -> int:
    """About ``shard_rows`` rows each; a small table is spread over the cores, to no less than ``FEWEST`` rows each."""
    return max(1, -(-rows // shard_rows), min(spark.sparkContext.defaultParallelism, -(-rows // FEWEST)))


def routed(vectors: DataFrame, shards: int, metric: str, shard_rows: int = SHARD_ROWS) -> tuple[DataFrame, np.ndarray]:
    """``(shard, vec_id, embedding)`` by nearest centroid, and each shard's centroid.

    A cell of more than ``shard_rows`` rows is dealt over several shards by its ids' hash.
    """
    centroids = train_cells(vectors, shards, metric)
    rows = assign_cells(vectors.where("embedding is not null"), centroids, metric)
    parts = {r[0]: -(-r[1] // shard_rows) for r in rows.groupBy("cell").count().collect()}  # a row a cell
    first, number = {}, 0
    for c in sorted(parts):
        first[c], number = number, number + parts[c]
    plan = rows.sparkSession.createDataFrame([(c, first[c], parts[c]) for c in parts], "cell int, first int, parts int")
    rows = rows.join(F.broadcast(plan), "cell").withColumn("shard", (F.col("first") + F.pmod(F.xxhash64("vec_id"), F.col("parts"))).cast("int"))
    return rows.select("shard", "vec_id", "embedding"), np.repeat(centroids[sorted(parts)], [parts[c] for c in sorted(parts)], 0)


def by_hash(vectors: DataFrame, shards: int) -> DataFrame:
    rows = vectors.select(F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int").alias("shard"), F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    return rows.where("embedding is not null")


def graph_shards(rows: DataFrame, shards: int, dim: int, metric: str = "cosine", m: int = 16, ef_construction: int = 100, seed: int = 0x5EED) -> DataFrame:
    """``(shard, ids, graph)`` of rows ``(shard, vec_id, embedding)``: one row for each shard's graph, so a search
    needs no shuffle of vectors."""

    def build(t: pa.Table) -> pa.Table:
        ids = t.column("vec_id").to_numpy()
        order = np.argsort(ids, kind="stable")
        g = Graph(dim, metric, m, ef_construction, seed).build(matrix(t.column("embedding").combine_chunks())[order])
        return pa.table({"shard": t.column("shard")[:1].cast(pa.int32()), "ids": pa.array([ids[order].tolist()], pa.list_(pa.int64())), "graph": pa.array([g.to_bytes()], pa.binary())})

    tasks = min(shards, max(4 * rows.sparkSession.sparkContext.defaultParallelism, shards // 16))  # a stated number isn't coalesced
    return rows.repartition(tasks, "shard").groupBy("shard").applyInArrow(build, SHARDS)


def shard_links(index: DataFrame) -> DataFrame:
    """``(shard, node, level, neighbors)`` of the shards' graphs."""

    def run(batches):
        for b in batches:
            for shard, ids, data in zip(*(b.column(i) for i in range(3))):
                links, ids = Graph.from_bytes(data.as_py()).links, ids.as_py()
                rows = [(ids[n], level, [ids[j] for j in near]) for n, layers in enumerate(links) for level, near in enumerate(layers)]
                node, level, near = zip(*rows) if rows else ((), (), ())
                yield pa.RecordBatch.from_arrays([pa.array([shard.as_py()] * len(rows), pa.int32()), pa.array(node, pa.int64()), pa.array(level, pa.int32()), pa.array(near, pa.list_(pa.int64()))], ["shard", "node", "level", "neighbors"])

    return index.mapInArrow(run, "shard int, node long, level int, neighbors array<long>")


def shard_search(index: DataFrame, queries: tuple[np.ndarray, np.ndarray], k: int, ef: int = 100, centroids: np.ndarray | None = None, probes: int | None = None, metric: str = "cosine", walk: bool | None = None) -> DataFrame:
    """The k best of every query of one bounded block: each task merges those of its shards.

    With ``centroids`` (a row for each shard) a query visits its ``probes`` nearest shards only. A shard is walked by its
    graph, or scanned for all of its queries at once by a matrix product if that costs less; ``walk`` decides for all. Walks in a shard that is cheaply scanned go together.
    """
    qid, q = queries
    visit = None
    if centroids is not None and probes is not None and probes < len(centroids):
        visit = visits(_unit(q) if metric_name(metric) == "cosine" else q, centroids, probes)
    handle = index.sparkSession.sparkContext.broadcast((qid, q, visit))

    def run(batches):
        qid, q, visit = handle.value
        held = Best(len(qid), k)
        for b in batches:
            for shard, ids, data in zip(b.column("shard").to_pylist(), b.column("ids"), b.column("graph")):
                asks = np.arange(len(qid)) if visit is None else visitors(visit, shard)
                if not len(asks):
                    continue
                raw, ids = data.as_py(), ids.values.to_numpy()
                small = len(ids) <= STEP_COST * max(ef, k)
                if not walk and (walk is False or small):
                    held.look(q, Graph.vectors(raw), ids, metric_name(metric), asks)
                    continue
                if small:
                    for n, i, d in Graph.walked(raw, q[asks], k, ef):
                        held.merge(asks[n], ids[i], d)
                    continue
                g = Graph.from_bytes(raw)
                hits = [(n, i, d) for n in asks.tolist() for d, i in g.search(q[n], k, ef)]
                if hits:
                    n, i, d = map(np.array, zip(*hits))
                    held.merge(n, ids[i], d)
        yield held.batch(qid)

    return ranked(index.select("shard", "ids", "graph").mapInArrow(run, "qid long, vec_id long, distance double"), k)


def graph_links(vectors: DataFrame, shards: int, dim: int, metric: str = "cosine", m: int = 16, ef_construction: int = 100, seed: int = 0x5EED) -> DataFrame:
    """``(shard, node, level, neighbors)`` of graphs built for the purpose."""
    return shard_links(graph_shards(by_hash(vectors, shards), shards, dim, metric, m, ef_construction, seed))


def graph_search(vectors: DataFrame, queries: tuple[np.ndarray, np.ndarray], shards: int, dim: int, k: int, ef: int = 100, metric: str = "cosine", m: int = 16, ef_construction: int = 100, seed: int = 0x5EED) -> DataFrame:
    """Walk graphs built for the purpose; to search more than once, keep a ``GraphIndex``."""
    return shard_search(graph_shards(by_hash(vectors, shards), shards, dim, metric, m, ef_construction, seed), queries, k, ef, metric=metric, walk=True)


class GraphIndex:
    """Proximity graphs of all vectors, kept in a folder of versions.

    Adding writes graphs of the new rows only, as a segment of their own. A batch with a bad vector changes nothing.
    """

    FORMAT = 1

    def __init__(self, spark: SparkSession, path: str, dim: int | None = None, metric: str | None = None, m: int = 16, ef_construction: int = 100, seed: int = 0x5EED, verify: bool = True):
        """Open the folder's index, or start an empty one of width ``dim``; what is stored wins over ``m`` and its like."""
        self.spark, self.versions = spark, Versions(spark, path)
        state = self.versions.current()
        if state is None:
            Graph(dim or 0, metric or "cosine", m, ef_construction)
            state = {"format": self.FORMAT, "version": 0, "dim": dim, "metric": metric_name(metric or "cosine"), "m": m, "ef_construction": ef_construction, "seed": seed, "rows": 0, "segments": [], "shards": [], "digest": [0, 0]}
        elif state["format"] != self.FORMAT or dim not in (None, state["dim"]) or metric and metric_name(metric) != state["metric"]:
            raise ValueError(f"the stored index is of format {state['format']}, width {state['dim']}, metric {state['metric']}")
        self.state = state
        if verify and digest(self.shards()) != state["digest"]:
            raise ValueError("the shards aren't what the manifest says")

    def __len__(self) -> int:
        return self.state["rows"]

    def __repr__(self) -> str:
        return f"GraphIndex({', '.join(f'{k}={self.state[k]!r}' for k in ('rows', 'dim', 'metric', 'm', 'ef_construction'))})"

    dim = property(lambda self: self.state["dim"])
    metric = property(lambda self: self.state["metric"])

    def _read(self, name: str, schema: str) -> DataFrame:
        folders = [f"{self.versions.folder(v)}/{name}" for v in self.state["segments"]]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def shards(self) -> DataFrame:
        return self._read("shards", SHARDS)

    def vectors(self) -> DataFrame:
        """``(vec_id, embedding)`` as stored (of unit length under cosine)."""

        def run(batches):
            for b in batches:
                for ids, data in zip(b.column("ids"), b.column("graph")):
                    x = Graph.vectors(data.as_py()).astype(np.float32)
                    yield pa.RecordBatch.from_arrays([ids.values, pa.array(x.tolist(), pa.list_(pa.float32()))], ["vec_id", "embedding"])

        return self.shards().select("ids", "graph").mapInArrow(run, "vec_id long, embedding array<float>")

    def _write(self, version: int, rows: DataFrame, n: int, first: int, shard_rows: int) -> tuple[int, list[int]]:
        """Write the graphs and centroids of ``rows`` as a segment; how many shards, and their digest."""
        s, folder = self.state, self.versions.fresh(version)
        dealt, centroids = routed(rows, shard_count(self.spark, n, shard_rows), self.metric, shard_rows)
        dealt = dealt.withColumn("shard", (F.col("shard") + first).cast("int"))
        graph_shards(dealt, len(centroids), self.dim, self.metric, s["m"], s["ef_construction"], s["seed"]).write.parquet(f"{folder}/shards")
        self.spark.createDataFrame([(first + i, c) for i, c in enumerate(centroids.tolist())], "shard int, centroid array<double>").write.parquet(f"{folder}/centroids")
        return len(centroids), digest(self.spark.read.schema(SHARDS).parquet(f"{folder}/shards"))

    def _commit(self, version: int, change: dict) -> "GraphIndex":
        state = self.state | change | {"version": version}
        self.versions.commit(state)
        self.state = state
        return self

    def add(self, vectors: DataFrame, shard_rows: int = SHARD_ROWS) -> "GraphIndex":
        """Add rows ``(vec_id, embedding)``, whose ids must be new and differ; all are checked before anything is stored."""
        rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<float>").alias("embedding"))
        require_valid(rows, self.dim)
        if not (n := rows.count()):
            return self
        twice = rows.groupBy("vec_id").count().where("count > 1").select("vec_id")
        held = self.shards().select(F.explode("ids").alias("vec_id")).join(rows.select("vec_id"), "vec_id", "left_semi")
        if found := (twice.unionByName(held) if self.state["segments"] else twice).limit(1).collect():
            raise ValueError(f"vector {found[0][0]}: its id is taken")
        version, s = self.state["version"] + 1, self.state
        shards, own = self._write(version, rows, n, sum(s["shards"]), shard_rows)
        return self._commit(version, {"rows": s["rows"] + n, "segments": [*s["segments"], version], "shards": [*s["shards"], shards], "digest": joined_digest(s["digest"], own)})

    def compact(self, shard_rows: int = SHARD_ROWS) -> "GraphIndex":
        """Build all segments anew as one, so that a search visits no more shards than one of a fresh index."""
        if len(self.state["segments"]) < 2:
            return self
        version = self.state["version"] + 1
        shards, own = self._write(version, self.vectors(), self.state["rows"], 0, shard_rows)
        return self._commit(version, {"segments": [version], "shards": [shards], "digest": own})

    def search(self, queries: DataFrame, k: int, ef: int = 100, probes: int | None = None, walk: bool | None = None) -> DataFrame:
        """``(qid, vec_id, distance, rank)`` for queries ``(qid, embedding)``; of many shards a fifth, four at least, are
        visited by a query unless ``probes`` says otherwise."""
        require_valid(queries, self.dim, "qid")
        n, centroids = sum(self.state["shards"]), None
        if 0 < n <= MAX_SHARDS:
            got = self._read("centroids", "shard int, centroid array<double>").orderBy("shard").collect()  # a row a shard
            centroids = np.array([r[1] for r in got], np.float64).reshape(len(got), -1)
        probes = max(4, -(-n // 5)) if probes is None else probes
        return by_blocks(self.spark, in_blocks(queries), lambda rows: shard_search(self.shards(), rows, max(k, 0), max(ef, k), centroids, probes, self.metric, walk))

    def links(self) -> DataFrame:
        return shard_links(self.shards())

    def vector(self, vec_id: int) -> list[float]:
        """The stored vector (of unit length under cosine); ``IndexError`` if there is none."""

        def run(batches):
            for b in batches:
                for ids, data in zip(b.column("ids"), b.column("graph")):
                    at = np.flatnonzero(ids.values.to_numpy() == vec_id)
                    yield pa.RecordBatch.from_arrays([pa.array(Graph.from_bytes(data.as_py()).x[at].tolist(), pa.list_(pa.float64()))], ["v"])

        found = self.shards().where(F.array_contains("ids", F.lit(vec_id).cast("long"))).select("ids", "graph").mapInArrow(run, "v array<double>").limit(1).collect()
        if not found:
            raise IndexError(vec_id)
        return found[0][0]


def adjacency_expand(frontier: DataFrame, links: DataFrame, level: int) -> DataFrame:
    """Neighbours of the frontier's nodes on one layer."""
    near = links.where(F.col("level") == level).join(frontier.select("node").distinct(), "node", "left_semi")
    return near.select("shard", "node", F.explode("neighbors").alias("neighbor"))


def diverse_select(found: DataFrame, vectors: DataFrame, m: int) -> DataFrame:
    """Of each query's ranked hits, the m that ``Graph`` would link: a fold over the hits' array."""
    from ..functions.vectors import distance

    rows = found.join(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v")), "vec_id")
    arr = F.sort_array(F.collect_list(F.struct("rank", "vec_id", "distance", "v")))
    rows = rows.groupBy("qid").agg(arr.alias("hits"))
    kind = "array<struct<rank:int,vec_id:bigint,distance:double,v:array<double>>>"
    zero = F.struct(F.expr(f"cast(array() as {kind})").alias("kept"), F.expr(f"cast(array() as {kind})").alias("spare"))

    def step(a, c):
        room = F.size(a["kept"]) < m
        ok = room & F.forall(a["kept"], lambda s: distance(c["v"], s["v"], "cosine") >= c["distance"])
        return F.struct(F.when(ok, F.concat(a["kept"], F.array(c))).otherwise(a["kept"]).alias("kept"), F.when(room & ~ok, F.concat(a["spare"], F.array(c))).otherwise(a["spare"]).alias("spare"))

    picked = F.aggregate("hits", zero, step, lambda a: F.concat(a["kept"], F.slice(a["spare"], 1, F.greatest(m - F.size(a["kept"]), F.lit(0)))))
    return rows.select("qid", F.posexplode(picked).alias("pos", "h")).select("qid", (F.col("pos") + 1).alias("pick"), F.col("h.vec_id").alias("vec_id"))
