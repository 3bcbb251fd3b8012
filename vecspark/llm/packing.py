"""Best-fit packing of token sequences by linear grouping (operator 5).

Documents become ids and an end id; only those longer than a sequence are cut. What is planned is the
histogram of piece lengths, which has at most ``capacity`` rows however many documents there are:

1. lengths above a ``SMALL``-th of a sequence (whole sequences aside) are sorted and cut into groups of equal
   cardinality, each rounded up to its largest;
2. a linear programme over configurations (column generation with a knapsack) packs these few sizes;
3. the configurations, rounded down, take actual documents for all their slots: the largest of a slot's group, and
   for the last slot the largest that the actual lengths of the others leave room for, of its group or above;
4. everything else is placed best-fit, by decreasing length, into the room left or into new sequences.

The plan maps ranges of ranks within a length to ranges of sequences. Ranks are dealt without gathering a
length in one task: counts of (length, salt) give each salt its first rank.

Defined cases: null or empty text is a piece of one end id; repeated rows are packed each; null ids stay null;
an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import warnings
import zlib
from bisect import bisect_left, bisect_right, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import freed, shuffle_partitions, small_batches, table, written
from .bpe import Encoder, default_vocabulary, packed, vocabulary

#: A piece is small up to the ``SMALL``-th part of a sequence.
CAPACITY, GROUPS, SMALL, END_ID = 2048, 64, 6, 0


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, vocab_path: str | None = None) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32)`` of each row."""
    small_batches(docs.sparkSession)
    path = vocab_path or default_vocabulary()

    def run(batches):
        enc, end, step = Encoder(vocabulary(path), packed), packed([END_ID]), 4 * capacity
        for b in batches:
            rows: tuple[list, ...] = ([], [], [], [], [])
            ids = b.column(0).to_pylist()
            for doc, got in zip(ids, enc.texts(b.column(1).to_pylist())):
                got.append(end)
                raw = b"".join(got)
                for k, s in enumerate(range(0, len(raw), step)):
                    part = raw[s : s + step]
                    for col, x in zip(rows, (doc, k, s // 4, len(part) // 4, zlib.crc32(part))):
                        col.append(x)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(rows, kinds)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("t")).mapInArrow(freed(run), "doc_id long, piece int, start long, length long, ids_crc32 long")


def best_configuration(sizes: list[int], price: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The configuration of greatest price that fits (an unbounded knapsack), and its price."""
    value = np.zeros(capacity + 1)
    for size, p in zip(sizes, price.tolist()):
        if p > 1e-12:
            for _ in range(capacity // size):
                more = np.maximum(value[size:], value[:-size] + p)
                if (more == value[size:]).all():
                    break
                value[size:] = more
    chosen, c = np.zeros(len(sizes), int), int(np.argmax(value >= value[capacity] - 1e-12))
    while value[c] > 1e-12:
        for g, (size, p) in enumerate(zip(sizes, price.tolist())):
            if p > 1e-12 and size <= c and value[c - size] + p >= value[c] - 1e-12:
                chosen[g] += 1
                c -= size
                break
        else:
            c -= 1
    return float(chosen @ price), chosen


def configurations(sizes: list[int], demand: list[int], capacity: int, rounds: int = 3000) -> list[tuple[np.ndarray, float]]:
    """Configurations of the sizes and how often each is used, by the linear programme's optimum.

    A basis is valid in any round; should ``rounds`` not suffice for the proof that none is better, a warning says so.
    """
    n, size, want = len(sizes), np.array(sizes), np.array(demand, float)
    basis = np.diag(capacity // size).astype(float)
    for _ in range(rounds):
        price = np.linalg.solve(basis.T, np.ones(n))
        worth, new = best_configuration(sizes, price, capacity)
        if worth <= 1 + 1e-7:
            break
        amount, enter = np.linalg.solve(basis, want), np.linalg.solve(basis, new.astype(float))
        ratio = np.where(enter > 1e-9, amount / np.where(enter > 1e-9, enter, 1), np.inf)
        basis[:, int(ratio.argmin())] = new
    else:
        warnings.warn(f"configurations of {n} sizes may not be optimal after {rounds} rounds", stacklevel=2)
    return list(zip(basis.T.round().astype(int), np.linalg.solve(basis, want)))


def plan(histogram: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS, small: int | None = None, count: dict | None = None) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Rows ``(length, first rank, count, first sequence, offset)`` and the number of sequences.

    ``count`` is told how many pieces configurations placed (``grouped``) and in how many sequences (``sequences``).
    """
    small = capacity // SMALL if small is None else small
    rows: list[tuple[int, int, int, int, int]] = []
    used = dict.fromkeys(histogram, 0)
    opened = 0
    room: dict[int, list[tuple[int, int]]] = {}  # room left -> ranges of sequences
    keys: list[int] = []

    def put(length, n, seq, offset):
        rows.append((length, used[length], n, seq, offset))
        used[length] += n

    def leave(left, seq, n):
        if left:
            if not room.get(left):
                room[left] = []
                insort(keys, left)
            room[left].append((seq, n))

    large = [(x, histogram[x]) for x in sorted(histogram, reverse=True) if small < x < capacity and histogram[x]]
    total = sum(n for _, n in large)
    stock = dict(large)
    lengths = sorted(stock)  # those with pieces left
    grouped = 0

    def largest(limit, taken):
        """The greatest length up to ``limit`` of which a piece is left beside those taken."""
        i = bisect_right(lengths, limit) - 1
        while i >= 0 and stock[lengths[i]] <= taken.get(lengths[i], 0):
            i -= 1
        return lengths[i] if i >= 0 else 0

    if total:
        card, here, sizes, least, demand = -(-total // groups), 0, [], [], []
        for x, n in large:  # groups of equal cardinality, by decreasing length; a length's pieces may be of several
            while n:
                if not sizes or here == card:
                    here = 0
                    if not sizes or sizes[-1] != x:  # groups that round to the same size are one
                        sizes.append(x)
                        least.append(x)
                        demand.append(0)
                k = min(n, card - here)
                least[-1], demand[-1] = x, demand[-1] + k
                n, here = n - k, here + k
        for pattern, times in configurations(sizes, demand, capacity):
            slots = [g for g, k in enumerate(pattern) for _ in range(k)]
            m = int(times + 1e-6)
            while m > 0:
                picked, taken, fill = [], {}, 0
                for j, g in enumerate(slots):
                    x = largest(sizes[g] if j < len(slots) - 1 else capacity - fill, taken)
                    if x < least[g]:
                        break
                    picked.append(x)
                    taken[x] = taken.get(x, 0) + 1
                    fill += x
                if not picked or len(picked) < len(slots):
                    break  # too few of a group's pieces are left; the next step places what remains
                run = min(m, *(stock[x] // k for x, k in taken.items()))
                fill = 0
                for x in picked:
                    put(x, run, opened, fill)
                    fill += x
                for x, k in taken.items():
                    stock[x] -= k * run
                    if not stock[x]:
                        lengths.remove(x)
                grouped += run * len(slots)
                leave(capacity - fill, opened, run)
                opened += run
                m -= run
    if count is not None:
        count |= {"grouped": grouped, "sequences": opened, "large": total}
    rest = {x: n for x, n in histogram.items() if n and not small < x < capacity}
    rest |= {x: n for x, n in stock.items() if n}
    for x in sorted(rest, reverse=True):
        n = rest[x]
        while n:
            i = bisect_left(keys, x)
            if i < len(keys):
                left = keys[i]
                seq, m = room[left].pop()
                if not room[left]:
                    keys.pop(i)
                k = min(n, m)
                put(x, k, seq, capacity - left)
                if m > k:
                    leave(left, seq + k, m - k)
                leave(left - x, seq, k)
                n -= k
            else:
                per = capacity // x
                m = max(1, n // per)
                k = min(per, n)
                for j in range(k):
                    put(x, m, opened, j * x)
                leave(capacity - k * x, opened, m)
                opened += m
                n -= m * k
    return rows, opened


def ranked(df: DataFrame, key: str, salt: list[str]) -> DataFrame:
    """``df`` with ``rank``, from 0 and without gaps within ``key``, and no task for a whole key."""
    n = 4 * shuffle_partitions(df.sparkSession)
    df = df.withColumn("_salt", F.pmod(F.xxhash64(*salt), F.lit(n)))
    first = df.groupBy(key, "_salt").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(key).orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    first = first.select(key, "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    within = Window.partitionBy(key, "_salt").orderBy(*salt)
    return df.withColumn("_in", F.row_number().over(within) - 1).join(first, [key, "_salt"]).withColumn("rank", F.col("_in") + F.col("_first")).drop("_salt", "_in", "_first")


def best_fit_packing(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, groups: int = GROUPS, small: int | None = None, vocab_path: str | None = None) -> DataFrame:
    """A row for each piece with its sequence and its place there."""
    parts = written(pieces(docs, id_col, text_col, capacity, vocab_path), "pieces")
    histogram = {r[0]: r[1] for r in parts.groupBy("length").count().collect()}  # at most ``capacity`` rows
    rows, _ = plan(histogram, capacity, groups, small)
    order = np.array(sorted(rows), np.int64).reshape(-1, 5)

    def place(batches):
        code = order[:, 0] << 44 | order[:, 1]
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            at = np.searchsorted(code, length << 44 | rank, side="right") - 1
            seq = order[at, 3] + rank - order[at, 1]
            cols = [b.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(seq), pa.array(order[at, 4])], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    out = ranked(parts, "length", ["doc_id", "piece", "ids_crc32"])
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", F.col("rank").cast("long")).mapInArrow(freed(place), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_packing(table(spark, sf_dir, "documents"))
