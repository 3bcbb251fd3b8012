"""SimHash near-duplicate groups (operator 1).

Fingerprints: each text's shingles of lower-cased words are hashed with XXH64 (seed 42); a bit of the
fingerprint is 1 if more than half of the hashes set it. Two fingerprints link at ``radius`` or fewer
differing bits, and the answer is each document's connected component.

Search: equal fingerprints are folded first, so copies never meet as pairs. The 64 bits are cut into
``radius + 2`` blocks; two fingerprints within the radius agree on at least two whole blocks, so each
pair of blocks keys a shard and no link can be missed. Every shard is a BK-tree (children keyed by the
integer Hamming distance to their parent) and a search follows only edges whose distance is within the
radius of the query's. Trees travel with their shard through one shuffle rather than as broadcasts, as
fingerprints grow with the data. A shard above ``max_shard`` rows is split into several trees, and its
rows query each of them. Of a shard's links only a spanning forest is emitted.

Defined cases: null or word-less text has fingerprint 0 and links like any other; a text with fewer
words than a shingle is one shingle; repeated shingles count as often as they occur; rows with a null
id are dropped from links but none are dropped from the output; an empty table gives an empty result;
other columns of the input are not touched and not read.
"""

from __future__ import annotations

from heapq import heappush, heappushpop
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import driver_freed, drop_written, freed, small_batches, table, written
from .components import connected_components
from .substring import _set, bit_map

SHINGLE, RADIUS, MAX_SHARD = 4, 4, 4096


def fingerprint(data: bytes | None, shingle: int = SHINGLE) -> int:
    """The 64-bit fingerprint of a UTF-8 text."""
    words = (data or b"").lower().split()
    if not words:
        return 0
    digest = xxhash.xxh64_digest
    joined = b" ".join(words)
    if len(words) <= shingle:
        return int.from_bytes(digest(joined, 42))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - shingle + 1].tolist()
    ends = ends[shingle - 1 :].tolist()
    counts, n = np.zeros(64, np.int64), len(ends)
    for i in range(0, n, 1 << 16):
        raw = b"".join([digest(joined[s:e], 42) for s, e in zip(starts[i : i + (1 << 16)], ends[i : i + (1 << 16)])])
        counts += np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int32)
    return int.from_bytes(np.packbits(counts * 2 > n).tobytes())


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``(doc_id, fp)`` for each row."""

    small_batches(docs.sparkSession)
    def run(batches):
        for b in batches:
            fps = [fingerprint(x.as_buffer().to_pybytes() if x.is_valid else b"", shingle) for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.array(fps, np.uint64).view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("t")).mapInArrow(freed(run), "doc_id long, fp long")


def block_masks(radius: int) -> list[int]:
    """Masks of every pair of the ``radius + 2`` blocks, as signed longs."""
    edges = np.linspace(0, 64, radius + 3).round().astype(int).tolist()
    blocks = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:])]
    masks = [x | y for x, y in combinations(blocks, 2)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


class BKTree:
    """A BK-tree over distinct integers."""

    __slots__ = ("value", "children")

    def __init__(self, value: int):
        self.value, self.children = value, {}

    def add(self, value: int) -> None:
        node = self
        while d := (node.value ^ value).bit_count():
            nxt = node.children.get(d)
            if nxt is None:
                node.children[d] = BKTree(value)
                return
            node = nxt

    def within(self, value: int, radius: int) -> list[int]:
        found, todo = [], [self]
        while todo:
            node = todo.pop()
            d = (node.value ^ value).bit_count()
            if d <= radius:
                found.append(node.value)
            if node.children:
                todo += [c for k, c in node.children.items() if d - radius <= k <= d + radius]
        return found


    def any_within(self, value: int, radius: int) -> bool:
        todo = [self]
        while todo:
            node = todo.pop()
            d = (node.value ^ value).bit_count()
            if d <= radius:
                return True
            todo += [c for k, c in node.children.items() if d - radius <= k <= d + radius]
        return False


def _forest(members: list[int], queries: list[int], node_of: dict[int, int], radius: int):
    """Edges of a spanning forest of the links between a tree's members and the queries."""
    up = {x: x for x in node_of}

    def root(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    tree, inside = None, set(members)
    for x in members:
        if tree is None:
            tree = BKTree(x)
            continue
        hits = tree.within(x, radius)
        tree.add(x)
        yield from _joined(x, hits, up, root, node_of)
    for x in queries:
        if tree is not None and x not in inside:
            yield from _joined(x, tree.within(x, radius), up, root, node_of)


def _joined(x, hits, up, root, node_of):
    for y in hits:
        a, b = root(x), root(y)
        if a != b:
            keep, gone = (a, b) if node_of[a] < node_of[b] else (b, a)
            up[gone] = keep
            yield node_of[gone], node_of[keep]


def _links(radius: int):
    def flush(rows, out):
        if len(rows) > 1:
            node_of = {fp & 0xFFFFFFFFFFFFFFFF: node for fp, node, _ in rows}
            members = [fp & 0xFFFFFFFFFFFFFFFF for fp, _, own in rows if own]
            out += _forest(members, list(node_of), node_of, radius)

    def run(batches):
        last, rows = None, []
        for b in batches:
            cols = [c.to_numpy(zero_copy_only=False) for c in b.columns]
            t, key, shard, fp, node, own = cols
            cut = np.flatnonzero((np.diff(t) != 0) | (np.diff(key) != 0) | (np.diff(shard) != 0)) + 1
            cuts, out = [0, *cut.tolist(), len(t)], []
            fp, node, own = fp.tolist(), node.tolist(), own.tolist()
            for s, e in zip(cuts, cuts[1:]):
                if s == e:
                    continue
                k = (t[s], key[s], shard[s])
                if k != last:
                    flush(rows, out)
                    last, rows = k, []
                if e - s == 1:
                    rows.append((fp[s], node[s], own[s]))
                else:
                    rows += zip(fp[s:e], node[s:e], own[s:e])
            if out:
                a = np.array(out, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(a[:, 0]), pa.array(a[:, 1])], ["a", "b"])
        out = []
        flush(rows, out)
        if out:
            a = np.array(out, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(a[:, 0]), pa.array(a[:, 1])], ["a", "b"])

    return run


def fingerprint_links(reps: DataFrame, radius: int = RADIUS, max_shard: int = MAX_SHARD) -> DataFrame:
    """Links ``(a, b)`` between the nodes of distinct fingerprints ``(fp, node)``, a spanning forest a shard."""
    masks = F.array(*[F.lit(m).cast("long") for m in block_masks(radius)])
    rows = reps.select("fp", "node", F.posexplode(masks).alias("t", "mask")).select("t", F.col("fp").bitwiseAND(F.col("mask")).alias("key"), "fp", "node")
    large = rows.groupBy("t", "key").agg(F.count("*").alias("n")).where(F.col("n") > max_shard).select("t", "key", F.ceil(F.col("n") / max_shard).cast("int").alias("g"))
    rows = rows.join(large, ["t", "key"], "left").withColumn("g", F.coalesce("g", F.lit(1)))
    rows = rows.select("t", "key", F.explode(F.sequence(F.lit(0), F.col("g") - 1)).alias("shard"), "fp", "node", F.pmod(F.xxhash64("fp"), F.col("g")).alias("home"))
    rows = rows.select("t", "key", "shard", "fp", "node", (F.col("home") == F.col("shard")).alias("own"))
    return rows.repartition("t", "key", "shard").sortWithinPartitions("t", "key", "shard").mapInArrow(freed(_links(radius)), "a long, b long")


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, radius: int = RADIUS, max_shard: int = MAX_SHARD) -> DataFrame:
    """``(doc_id, fingerprint, component_id)`` for each row of ``docs``."""
    fps = written(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    reps = fps.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("node"))
    labels = connected_components(fingerprint_links(reps, radius, max_shard))
    of_fp = reps.join(labels, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    out = fps.join(of_fp, "fp", "left")
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


#: Near copies: words in a shingle, least Jaccard similarity, bits and radius of the fingerprint, links of a row in a tree before the rest waits.
WORDS, LEAST, BITS, NEAR, NEIGHBOURS = 5, 0.8, 128, 28, 4
#: About so many rows share a shard; so few of the pairs at TYPICAL bits (similarity 0.8) may meet in none.
SHARD, MISSED, TYPICAL = 32, 0.005, 20
#: Rows of a tree wait with those rows that have more than ``NEIGHBOURS`` if they are as near to one; NEAR and a margin.
WAITING = 36
#: Cells of the counts that order shingles by how rare they are, and the parts they are summed in.
CELLS, PARTS, BEFORE = 1 << 20, 64, 8


def shingle_set(data: bytes | None, shingle: int = WORDS) -> np.ndarray:
    """Sorted 128-bit hashes of the distinct shingles of a UTF-8 text, as rows of two words."""
    words = (data or b"").lower().split()
    digest = xxhash.xxh3_128_digest
    grams = {b" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))} if words else ()
    return np.frombuffer(b"".join(sorted(map(digest, grams))), np.uint64).reshape(-1, 2)


def wide_fingerprint(hashes: np.ndarray) -> bytes:
    """The ``BITS``-bit fingerprint of a set of shingles, each counted once."""
    counts, n = np.zeros(BITS, np.int64), len(hashes)
    for i in range(0, n, 1 << 15):
        counts += np.unpackbits(hashes[i : i + (1 << 15)].view(np.uint8), axis=1).sum(0, dtype=np.int32)
    return np.packbits(counts * 2 > n).tobytes()


def _wide(docs: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """``(doc_id, s1, s2, fp)``: a digest of each row's shingles and its wide fingerprint."""

    small_batches(docs.sparkSession)
    def run(batches):
        for b in batches:
            sets = [shingle_set(x.as_buffer().to_pybytes() if x.is_valid else b"", shingle) for x in b.column(1)]
            s = np.frombuffer(b"".join(xxhash.xxh3_128_digest(x.tobytes()) for x in sets), np.int64).reshape(-1, 2)
            fps = pa.array([wide_fingerprint(x) for x in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s[:, 0]), pa.array(s[:, 1]), fps], ["doc_id", "s1", "s2", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("t")).mapInArrow(freed(run), "doc_id long, s1 long, s2 long, fp binary")


def shard_bits(rows: int) -> list[np.ndarray]:
    """The bits that key each table of shards: more bits for more rows, and as many tables as ``MISSED`` asks for."""
    k = max(4, int(np.ceil(np.log2(max(rows, 1) / SHARD))))
    meet = np.prod([(BITS - TYPICAL - i) / (BITS - i) for i in range(k)])
    rng = np.random.Generator(np.random.PCG64(5))
    return [rng.choice(BITS, k, replace=False) for _ in range(int(np.ceil(np.log(MISSED) / np.log(1 - meet))))]


def nearest(tree: BKTree, value: int, radius: int, limit: int, nodes: dict[int, list[int]], below: int) -> list[tuple[int, int]]:
    """Of the nodes below ``below`` whose fingerprints are within ``radius``, the ``limit`` nearest: once so many are
    found, only edges within the farthest one's distance are followed."""
    found: list[tuple[int, int, int]] = []  # a heap, the farthest first
    todo = [tree]
    while todo:
        at = todo.pop()
        d = (at.value ^ value).bit_count()
        reach = radius if len(found) < limit else -found[0][0]
        if d <= reach:
            for node in nodes[at.value]:
                if node < below:
                    (heappush if len(found) < limit else heappushpop)(found, (-d, node, at.value))
            reach = radius if len(found) < limit else -found[0][0]
        if at.children:
            todo += [c for k, c in sorted(at.children.items(), key=lambda x: -abs(x[0] - d)) if d - reach <= k <= d + reach]
    return [(fp, node) for _, node, fp in found]


def _near_links(masks: list[int], limit: int = NEIGHBOURS):
    """``masks`` has the bits that key each table: a pair is handed on by the first table whose key both share."""

    def flush(table, rows, pairs, marks):
        if len(rows) < 2:
            return
        nodes: dict[int, list[int]] = {}
        for fp, node, own in rows:
            if own:
                nodes.setdefault(fp, []).append(node)
        tree = None
        for fp in sorted(nodes):
            if tree is None:
                tree = BKTree(fp)
            else:
                tree.add(fp)
        asking: dict[int, int] = {}
        for fp, node, _ in rows if tree is not None else ():
            near = nearest(tree, fp, NEAR, limit, nodes, node)
            pairs += ((node, other) for x, other in near if all((x ^ fp) & m for m in masks[:table]))
            if len(near) == limit:
                asking[node] = fp
        if asking:
            tree = None
            for fp in sorted(set(asking.values())):
                if tree is None:
                    tree = BKTree(fp)
                else:
                    tree.add(fp)
            marks += ((node, node in asking) for fp, node, _ in rows if node in asking or tree.any_within(fp, WAITING))

    def made(pairs, marks):
        a = np.unique(np.array(pairs, np.int64).reshape(-1, 2), axis=0)
        m = sorted(set(marks))
        none, flags = pa.nulls(len(a), pa.bool_()), pa.array([f for _, f in m], pa.bool_())
        m = np.array([n for n, _ in m], np.int64)
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([a[:, 0], m])), pa.array(np.concatenate([a[:, 1], m])), pa.concat_arrays([none, flags])], ["a", "b", "asks"])

    def run(batches):
        last, rows = None, []
        for b in batches:
            t, key, shard, node, own = (b.column(c).to_numpy(zero_copy_only=False) for c in ("t", "key", "shard", "node", "own"))
            fp = [int.from_bytes(x) for x in b.column("fp").to_pylist()]
            cut = np.flatnonzero((np.diff(t) != 0) | (np.diff(key) != 0) | (np.diff(shard) != 0)) + 1
            cuts, pairs, marks = [0, *cut.tolist(), len(t)], [], []
            for s, e in zip(cuts, cuts[1:]):
                if s == e:
                    continue
                k = (t[s], key[s], shard[s])
                if k != last:
                    flush(last[0] if last else 0, rows, pairs, marks)
                    last, rows = k, []
                rows += zip(*(x[s:e] for x in (fp, node.tolist(), own.tolist())))
            if pairs or marks:
                yield made(pairs, marks)
        pairs, marks = [], []
        flush(last[0] if last else 0, rows, pairs, marks)
        if pairs or marks:
            yield made(pairs, marks)

    return run


def near_candidates(reps: DataFrame, max_shard: int = MAX_SHARD) -> DataFrame:
    """``(a, b, asks)``: pairs of nodes of ``(node, fp)`` that may be near copies, each row's nearest ``NEIGHBOURS`` in
    a tree; where a tree may hold more for a row, marks with ``a = b``, with ``asks``, for it and for the tree's rows within
    ``WAITING`` bits of it, without."""
    tables, names = shard_bits(reps.count()), ["fp", "node"]
    masks = [sum(1 << (BITS - 1 - b) for b in bits.tolist()) for bits in tables]

    def deal(batches):
        for b in batches:
            if not b.num_rows:
                continue
            bits = np.unpackbits(np.frombuffer(b"".join(b.column("fp").to_pylist()), np.uint8).reshape(b.num_rows, -1), axis=1).astype(np.int64)
            for t, chosen in enumerate(tables):
                key = bits[:, chosen] @ (1 << np.arange(len(chosen)))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), t, np.int32)), pa.array(key), *(b.column(c) for c in names)], ["t", "key", *names])

    rows = reps.select(*names).mapInArrow(freed(deal), "t int, key long, fp binary, node long")
    large = rows.groupBy("t", "key").agg(F.count("*").alias("n")).where(F.col("n") > max_shard).select("t", "key", F.ceil(F.col("n") / max_shard).cast("int").alias("g"))
    rows = rows.join(large, ["t", "key"], "left").withColumn("g", F.coalesce("g", F.lit(1)))
    rows = rows.select("t", "key", F.explode(F.sequence(F.lit(0), F.col("g") - 1)).alias("shard"), *names, F.pmod(F.xxhash64("node"), F.col("g")).alias("home"))
    rows = rows.select("t", "key", "shard", *names, (F.col("home") == F.col("shard")).alias("own"))
    return rows.repartition("t", "key", "shard").sortWithinPartitions("t", "key", "shard").mapInArrow(freed(_near_links(masks)), "a long, b long, asks boolean").distinct()


def node_sets(nodes: DataFrame, docs: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """``(node, s)``: sorted 64-bit hashes of the shingles of the texts whose ids are in ``nodes``, and of a few besides
    whose bit in a map is set too: texts aren't shuffled for this."""

    def sets(batches):
        for b in batches:
            b = b.filter(pa.array(_set(wanted.value, b.column("h").to_numpy())))
            yield pa.RecordBatch.from_arrays([b.column("node"), pa.array([np.sort(shingle_set(x.as_buffer().to_pybytes() if x.is_valid else b"", shingle)[:, 0]).tobytes() for x in b.column("t")], pa.binary())], ["node", "s"])

    wanted = nodes.sparkSession.sparkContext.broadcast(bit_map(nodes.select(F.xxhash64("node").alias("h"))))
    texts = docs.select(F.col(id_col).cast("long").alias("node"), F.col(text_col).cast("binary").alias("t")).where("node is not null").select("node", F.xxhash64("node").alias("h"), "t")
    out = written(texts.mapInArrow(freed(sets), "node long, s binary"), "shingles")
    wanted.destroy()
    return out


def rarity(sets: DataFrame) -> np.ndarray:
    """Of each of ``CELLS`` cells, how many of the sets' shingles fall there."""

    def count(batches):
        total = np.zeros(CELLS, np.int64)
        for b in batches:
            for s in range(0, b.num_rows, 1000):
                h = np.frombuffer(b"".join(b.column(0)[s : s + 1000].to_pylist()), np.uint64)
                total += np.bincount((h & np.uint64(CELLS - 1)).astype(np.int64), minlength=CELLS)
        for p, part in enumerate(np.minimum(total, 2**31 - 1).astype(np.uint32).reshape(PARTS, -1)):
            at = np.flatnonzero(part).astype(np.uint32)
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([at.tobytes()], pa.binary()), pa.array([part[at].tobytes()], pa.binary())], ["part", "at", "n"])

    def add(t: pa.Table) -> pa.Table:
        total = np.zeros(CELLS // PARTS, np.int64)
        for at, n in zip(t.column("at").to_pylist(), t.column("n").to_pylist()):
            total[np.frombuffer(at, np.uint32)] += np.frombuffer(n, np.uint32)
        return pa.table({"part": t.column("part")[:1], "n": pa.array([np.minimum(total, 2**32 - 1).astype(np.uint32).tobytes()], pa.binary())})

    out = np.zeros(CELLS, np.uint32)
    width = CELLS // PARTS
    for part, n in sets.select("s").mapInArrow(freed(count), "part int, at binary, n binary").groupBy("part").applyInArrow(add, "part int, n binary").collect():  # PARTS rows, 4 * CELLS bytes
        out[part * width : (part + 1) * width] = np.frombuffer(bytes(n), np.uint32)
    return out


def rest_candidates(sets: DataFrame, least: float) -> tuple[DataFrame, DataFrame]:
    """Pairs ``(a, b)`` of different groups of ``(node, group, asks, s)`` that can be ``least`` similar; ``a`` asks. And
    the table that they are made from, to be dropped after them.

    Two sets of that similarity share a shingle among the first of each, in any order: of n shingles the first
    n - ceil(least n) + 1. With the rarest first, few sets meet; shingles within one group aren't joined. A shingle
    makes a pair only if none of the last ``BEFORE`` ahead of it is common too, as the first common one makes it in
    any case, and only if what follows in both sets can still make up the common shingles that the similarity takes.
    """
    handle = sets.sparkSession.sparkContext.broadcast(rarity(sets))

    def first(batches):
        for b in batches:
            token, row, size, place = [], [], [], []
            for i, x in enumerate(b.column("s").to_pylist()):
                h = np.frombuffer(x, np.uint64)
                k = len(h) - int(np.ceil(least * len(h) - 1e-9)) + 1 if len(h) else 0
                order = np.lexsort((h, handle.value[(h & np.uint64(CELLS - 1)).astype(np.int64)]))[:k]
                token.append(h[order].view(np.int64))
                row += [i] * k
                size += [len(h)] * k
                place += range(k)
            at = pa.array(row, pa.int64())
            cols = [pa.array(np.concatenate(token) if token else np.zeros(0, np.int64)), *(b.column(c).take(at) for c in ("node", "group", "asks")), pa.array(size, pa.int32()), pa.array(place, pa.int32())]
            yield pa.RecordBatch.from_arrays(cols, ["token", "node", "group", "asks", "n", "place"])

    posted = written(sets.mapInArrow(freed(first), "token long, node long, group long, asks boolean, n int, place int"), "postings")
    met = posted.groupBy("token").agg(F.min("group").alias("low"), F.max("group").alias("high")).where("low <> high").select("token")
    ahead = Window.partitionBy("node", "n").orderBy("place", "token").rowsBetween(-BEFORE, -1)
    first_posted, posted = posted, written(posted.join(met, "token", "left_semi").withColumn("before", F.collect_list("token").over(ahead)), "postings")
    drop_written(first_posted)
    handle.destroy()
    a, b = posted.where("asks").alias("a"), posted.alias("b")
    need = F.ceil((F.col("a.n") + F.col("b.n")) * (least / (1 + least)) - 1e-9)
    on = (F.col("a.token") == F.col("b.token")) & (F.col("a.node") > F.col("b.node")) & (F.col("a.group") != F.col("b.group"))
    on = on & (F.col("a.n") - F.col("a.place") >= need) & (F.col("b.n") - F.col("b.place") >= need) & ~F.arrays_overlap("a.before", "b.before")
    return a.join(b, on).select(F.col("a.node").alias("a"), F.col("b.node").alias("b")).distinct(), posted


def near_pairs(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Those of ``pairs`` whose sets ``(node, s)`` have a Jaccard similarity of ``least`` or more."""

    def same(batches):
        for b in batches:
            ok = []
            for x, y in zip(b.column("x"), b.column("y")):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                both = len(np.intersect1d(x, y, assume_unique=True)) if min(len(x), len(y)) >= least * max(len(x), len(y)) else 0
                ok.append(both > 0 and both >= least * (len(x) + len(y) - both))
            ok = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column("a").filter(ok), b.column("b").filter(ok)], ["a", "b"])

    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("s").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("s").alias("y")), "b")
    return both.select("a", "b", "x", "y").mapInArrow(freed(same), "a long, b long")


def near_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = WORDS, least: float = LEAST, max_shard: int = MAX_SHARD) -> DataFrame:
    """``(doc_id, component_id)``: groups of texts linked by a shingle similarity of ``least`` or more.

    Texts of equal shingles are folded first. Wide fingerprints find candidates: each table of shards is keyed by some
    of their bits and searched by BK-trees; each row's nearest are then compared exactly by their shingles. Where a
    tree may hold more, links that are left are those between different groups found so far: rows of such trees that are within ``WAITING`` bits of one that may have more meet
    by their rarest shingles (which loses none that is similar enough) and are compared exactly too.
    """
    rows = written(_wide(docs, id_col, text_col, shingle), "fingerprints")
    reps = written(rows.where("doc_id is not null").groupBy("s1", "s2").agg(F.min("doc_id").alias("node"), F.first("fp").alias("fp")), "texts")
    found = written(near_candidates(reps, max_shard), "candidates")
    pairs, marks = found.where("asks is null").select("a", "b"), found.where("asks is not null")
    nodes = found.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    sets = node_sets(nodes, docs, id_col, text_col, shingle)
    edges = written(near_pairs(pairs, sets, least), "links")
    driver_freed(docs.sparkSession)
    labels = connected_components(edges)
    marks = marks.groupBy(F.col("a").alias("node")).agg(F.max("asks").alias("asks"))
    done = [reps, found, sets, edges]
    if marks.limit(1).count():
        grouped = marks.join(labels, "node", "left").select("node", "asks", F.coalesce("component", "node").alias("group"))
        rest, posted = rest_candidates(grouped.join(sets, "node"), least)
        rest = written(rest, "candidates")
        drop_written(posted)
        labels = connected_components(edges.unionByName(near_pairs(rest, sets, least)))
        done.append(rest)
    of_text = written(reps.join(labels, "node", "left").select("s1", "s2", F.coalesce("component", "node").alias("component_id")), "groups")
    for x in done:
        drop_written(x)
    driver_freed(docs.sparkSession)
    return rows.join(of_text, ["s1", "s2"], "left").select("doc_id", "component_id")


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with one row of each group of near copies: that whose id is the group's smallest; of repeated ids one row.

    Rows with a null id belong to no group and stay.
    """
    found = near_components(docs, id_col, text_col, **options)
    first = found.where("doc_id = component_id").select(F.col("doc_id").alias("__vs_first")).distinct()
    w = Window.partitionBy("__vs_first").orderBy(F.col(text_col))
    kept = docs.where(F.col(id_col).isNotNull()).join(first, F.col(id_col).cast("long") == F.col("__vs_first"))
    kept = kept.withColumn("__vs_row", F.row_number().over(w)).where("__vs_row = 1").drop("__vs_first", "__vs_row")
    return kept.unionByName(docs.where(F.col(id_col).isNull()))


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(table(spark, sf_dir, "documents"))
