"""Substring deduplication by content-defined chunks (operator 8).

A gear hash rolls over each text's bytes (its last 16, in vectorised doubling steps). A chunk ends after white space
where the hash's upper bits are zero or, where the last 16 bytes hold no white space (scripts without it, long tokens),
before any character, by more bits; so an insertion moves no boundary beyond its own chunks. Chunks have at least
``MIN`` and at most ``MAX`` bytes and are compared by a 128-bit digest. Of equal chunks the first (by document id, then
place) stays. Runs of repeated chunks grow byte by byte to the ends of what they share with the first occurrence, at
whole words; those of at least ``min_run`` bytes, some 40 words, are cut out of the texts.

Texts are chunked once, into a table of a row for each text. Digests are counted by tasks before they are shuffled;
bit maps of fixed size (no false negatives, any false positive is decided by a join) keep chunks that don't repeat, and
texts that nothing is cut of or compared with, out of the later shuffles. A digest of more than ``HOT`` chunks is
joined in ``SALTS`` parts. No group of copies meets in one task and no pairs are made.

Defined cases: null text stays null and has no chunks; empty text stays empty; rows that repeat an id and text
count once and are rewritten alike; a null id comes first; a text of one character over and over is cut at ``MAX``
bytes, never within a character; an empty table gives an empty result; other columns pass through unread.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import drop_written, freed, small_batches, table, written

MIN, MAX, BITS, LONE_BITS, WINDOW, MIN_RUN = 16, 512, 3, 5, 16, 200
#: How far a run is compared beyond its chunks, to either side: a chunk that it covered whole would be of the run itself.
REACH = MAX
#: Bits of a bit map; chunks of a digest above which it is joined in parts, and these parts.
MARKS, HOT, SALTS = 1 << 26, 10_000, 16
GEAR = np.random.Generator(np.random.PCG64(20240229)).integers(0, 1 << 32, 256, np.uint32)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def gear_hash(buf: np.ndarray) -> np.ndarray:
    """The hash of the ``WINDOW`` bytes that end at each place: sum of gear(byte) << age."""
    h, s = GEAR[buf], 1
    while s < WINDOW:
        new = h.copy()
        new[s:] += h[:-s] << np.uint32(s)
        h, s = new, 2 * s
    return h


def proposed(buf: np.ndarray, block: int = 1 << 20) -> np.ndarray:
    """The places after which the content of ``buf`` proposes to cut; in blocks that overlap by a window."""
    out = []
    for s in range(0, len(buf), block):
        first = max(0, s - WINDOW)
        part = buf[first : s + block]
        h, space = gear_hash(part), _SPACE[part]
        seen = np.cumsum(space, dtype=np.int32)
        lone = seen == np.concatenate([np.zeros(min(WINDOW, len(seen)), np.int32), seen[:-WINDOW]])
        after = buf[first + 1 : s + block + 1]
        lone[: len(after)] &= after & 0xC0 != 0x80
        at = np.flatnonzero((space & (h >> np.uint32(32 - BITS) == 0)) | (lone & (h >> np.uint32(32 - LONE_BITS) == 0)))
        out.append(at[at >= s - first] + first + 1)
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def boundaries(data: bytes, places: list[int]) -> list[int]:
    """Chunk ends of ``data``, given the places that its content proposes."""
    ends, last = [], 0

    def force(upto):
        nonlocal last
        while upto - last > MAX:
            cut = last + MAX
            while cut > last + MIN and data[cut] & 0xC0 == 0x80:
                cut -= 1
            ends.append(cut)
            last = cut

    for p in places:
        if p - last >= MIN:
            force(p)
            ends.append(p)
            last = p
    force(len(data))
    if len(data) > last:
        ends.append(len(data))
    return ends


def chunk_ends(texts: list[bytes], block: int = 1 << 20):
    """Chunk ends of each text; texts are hashed together in blocks, apart by ``WINDOW`` zero bytes."""
    gap, at = b"\0" * WINDOW, 0
    while at < len(texts):
        group, size = [], 0
        while at < len(texts) and (not group or size + len(texts[at]) <= block):
            group.append(texts[at])
            size += len(texts[at]) + WINDOW
            at += 1
        cut = proposed(np.frombuffer(gap + gap.join(group), np.uint8))
        start = WINDOW
        for t in group:
            lo, hi = np.searchsorted(cut, [start + 1, start + len(t) + 1])
            yield boundaries(t, (cut[lo:hi] - start).tolist())
            start += len(t) + WINDOW


def chunk_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc, key, ends, digests)`` of each text, packed; ``key`` tells texts of one id apart."""

    small_batches(docs.sparkSession)
    def run(batches):
        digest = xxhash.xxh3_128_digest
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                texts = [x.as_buffer().to_pybytes() for x in part.column("t")]
                ends, digests = [], []
                for t, e in zip(texts, chunk_ends(texts)):
                    ends.append(np.array(e, np.int32).tobytes())
                    digests.append(b"".join([digest(t[x:y]) for x, y in zip([0, *e], e)]))
                yield pa.RecordBatch.from_arrays([part.column("doc"), part.column("key"), pa.array(ends, pa.binary()), pa.array(digests, pa.binary())], ["doc", "key", "ends", "digests"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.xxhash64(text_col).alias("key"), F.col(text_col).cast("string").cast("binary").alias("t")).where("t is not null")
    return written(rows.mapInArrow(freed(run), "doc long, key long, ends binary, digests binary"), "chunks")


def _digest_counts(chunked: DataFrame) -> DataFrame:
    """``(h, n)``: how often the first half of a digest occurs."""

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 2000):
                d = np.frombuffer(b"".join(b.column(0)[at : at + 2000].to_pylist()), np.int64)[::2]
                u, n = np.unique(d, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(n, pa.int64())], ["h", "n"])

    return chunked.select("digests").mapInArrow(freed(run), "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))


def bit_map(hashes: DataFrame) -> np.ndarray:
    """A bit map of ``MARKS`` bits with those of the column ``h`` set; MARKS / 8 bytes come to the driver at most."""

    def packed(batches):
        for b in batches:
            maps = []
            for x in b.column(1):
                bits = np.zeros(1 << 15, np.uint8)
                bits[x.values.to_numpy()] = 1
                maps.append(np.packbits(bits).tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(maps, pa.binary())], ["part", "bits"])

    at = F.col("h").bitwiseAND(MARKS - 1)
    parts = hashes.select(F.shiftright(at, 15).alias("part"), at.bitwiseAND((1 << 15) - 1).cast("int").alias("p")).groupBy("part").agg(F.collect_set("p"))
    out = np.zeros(MARKS >> 3, np.uint8)
    for part, bits in parts.mapInArrow(packed, "part long, bits binary").toLocalIterator():
        out[part << 12 : (part + 1) << 12] = np.frombuffer(bytes(bits), np.uint8)
    return out


def _set(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    at = h & (MARKS - 1)
    return (bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)


def _in_map(handle):
    """Whether a hash's bit is set: only the hashes go through Python."""

    @F.pandas_udf("boolean")
    def test(h):
        import pandas as pd

        return pd.Series(_set(handle.value, h.to_numpy(np.int64)))

    return test


def _marked(chunked: DataFrame, repeated, hot) -> DataFrame:
    """``(d1, d2, salt, hot, doc, key, start, stop)`` of the chunks whose digest's bit is set in ``repeated``."""
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.int64(), pa.int64(), pa.int32(), pa.int32()]
    names = ["d1", "d2", "salt", "hot", "doc", "key", "start", "stop"]

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 2000):
                part = b.slice(at, 2000)
                ends = [np.frombuffer(x, np.int32) for x in part.column("ends").to_pylist()]
                n = np.array([len(x) for x in ends])
                d = np.frombuffer(b"".join(part.column("digests").to_pylist()), np.int64).reshape(-1, 2)
                stop = np.concatenate(ends) if ends else np.zeros(0, np.int32)
                start = np.concatenate([[0], stop[:-1]]).astype(np.int32)
                start[(np.cumsum(n) - n)[n > 0]] = 0
                keep = np.flatnonzero(_set(repeated.value, d[:, 0]))
                row = np.repeat(np.arange(len(n)), n)[keep]
                d, many = d[keep], _set(hot.value, d[keep, 0])
                salt = np.where(many, row % SALTS, 0)
                cols = [d[:, 0], d[:, 1], salt, many, None, None, start[keep], stop[keep]]
                own = {4: part.column("doc").take(pa.array(row)), 5: part.column("key").take(pa.array(row))}
                yield pa.RecordBatch.from_arrays([own[i] if i in own else pa.array(c, k) for i, (c, k) in enumerate(zip(cols, kinds))], names)

    return chunked.mapInArrow(freed(run), "d1 long, d2 long, salt int, hot boolean, doc long, key long, start int, stop int")


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc, key, start, stop, before, after, sdoc, skey, sstart)``: runs of chunks that occur earlier, joined where
    their first occurrences touch too; the bytes up to the runs beside, at most ``REACH``; and the first occurrence."""
    spark = docs.sparkSession
    chunked = chunk_table(docs, id_col, text_col)
    counts = written(_digest_counts(chunked).where("n > 1"), "repeated")
    repeated, hot = (spark.sparkContext.broadcast(bit_map(counts.where(F.col("n") > least).select("h"))) for least in (1, HOT))
    drop_written(counts)
    found = _marked(chunked, repeated, hot)
    place = F.struct("doc", "key", "start")
    again = found.groupBy("d1", "d2").agg(F.min(place).alias("at"), F.max(place).alias("last"), F.max("hot").alias("hot")).where(F.col("at") != F.col("last"))
    again = again.select("d1", "d2", "at", F.explode(F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))).alias("salt"))
    later = found.join(again, ["d1", "d2", "salt"]).where(~place.eqNullSafe(F.col("at")))
    later = later.groupBy("doc", "key").agg(F.collect_set(F.struct("start", "stop", F.col("at.doc").alias("sdoc"), F.col("at.key").alias("skey"), F.col("at.start").alias("sstart"))).alias("c"))
    names = ["doc", "key", "start", "stop", "before", "after", "sdoc", "skey", "sstart"]
    kinds = [pa.int64(), pa.int64(), *[pa.int32()] * 4, pa.int64(), pa.int64(), pa.int32()]

    def joined(batches):
        for b in batches:
            out = []
            for doc, key, c in zip(*(x.to_pylist() for x in b.columns)):
                mine = []
                for x in sorted(c, key=lambda x: x["start"]):
                    last = mine[-1] if mine else None
                    if last and last[1] == x["start"] and last[2:4] == [x["sdoc"], x["skey"]] and last[4] - last[0] == x["sstart"] - x["start"]:
                        last[1] = x["stop"]
                    else:
                        mine.append([x["start"], x["stop"], x["sdoc"], x["skey"], x["sstart"]])
                ends, starts = [0, *(m[1] for m in mine)], [*(m[0] for m in mine[1:]), 2**31 - 1]
                out += [(doc, key, m[0], m[1], min(REACH, m[0] - e), min(REACH, n - m[1]), *m[2:]) for m, e, n in zip(mine, ends, starts)]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(list(zip(*out)) or [[]] * 9, kinds)], names)

    spans = written(later.mapInArrow(freed(joined), "doc long, key long, start int, stop int, before int, after int, sdoc long, skey long, sstart int"), "spans")
    drop_written(chunked)
    for x in (repeated, hot):
        x.destroy()
    return spans


def extended_spans(spans: DataFrame, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc, key, spans)``: each text's runs with the bytes beside their first occurrence."""
    spark = docs.sparkSession
    sources = spark.sparkContext.broadcast(bit_map(spans.select(F.xxhash64("sdoc", "skey").alias("h"))))
    texts = docs.select(F.col(id_col).cast("long").alias("d"), F.xxhash64(text_col).alias("k"), F.col(text_col).cast("string").cast("binary").alias("t")).where("t is not null")
    texts = texts.where(_in_map(sources)(F.xxhash64("d", "k")))
    beside = spans.join(texts, F.col("sdoc").eqNullSafe(F.col("d")) & (F.col("skey") == F.col("k")))
    left = F.expr("substring(t, greatest(sstart - before, 0) + 1, least(before, sstart))").alias("left")
    right = F.expr("substring(t, sstart + (stop - start) + 1, after)").alias("right")
    return beside.select("doc", "key", F.struct("start", "stop", left, right).alias("span")).groupBy("doc", "key").agg(F.collect_set("span").alias("spans"))


def _within_word(raw: bytes, at: int) -> bool:
    """Whether ``at`` lies within a character, or between two letters or digits of a script that parts words."""
    if 0 < at < len(raw):
        if raw[at] & 0xC0 == 0x80:
            return True
        a, b = raw[max(0, at - 4) : at].decode("utf-8", "ignore")[-1:], raw[at : at + 4].decode("utf-8", "ignore")[:1]
        return a.isalnum() and b.isalnum() and max(a, b) < "\u2e80"
    return False


def extended(raw: bytes, start: int, stop: int, left: bytes, right: bytes) -> tuple[int, int]:
    """The span grown byte by byte while the bytes beside it equal those beside its first occurrence, to whole words."""
    a, b, n, m = start, stop, len(left), 0
    while n and a and left[n - 1] == raw[a - 1]:
        a, n = a - 1, n - 1
    while m < len(right) and b < len(raw) and right[m] == raw[b]:
        b, m = b + 1, m + 1
    while a < start and (_within_word(raw, a) or _SPACE[raw[a]]):
        a += 1
    while b > stop and _within_word(raw, b):
        b -= 1
    return a, b


def runs(spans: list[tuple[int, int]], min_run: int) -> list[tuple[int, int]]:
    """Spans in order, joined where they touch, without those shorter than ``min_run``."""
    out: list[list[int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(e, out[-1][1])
        else:
            out.append([s, e])
    return [(s, e) for s, e in out if e - s >= min_run]


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_run: int = MIN_RUN, spans_out: str | None = None) -> DataFrame:
    """``docs`` with repeated passages cut out of the text; ``spans_out`` names a column for what was cut."""
    names = docs.columns
    spans = repeated_spans(docs, id_col, text_col)
    found = extended_spans(spans, docs, id_col, text_col).select(F.col("doc").alias("__vs_d"), F.col("key").alias("__vs_k"), F.col("spans").alias("__vs_spans"))
    touched = docs.sparkSession.sparkContext.broadcast(bit_map(spans.select(F.xxhash64("doc", "key").alias("h"))))
    rows = docs.withColumn("__vs_doc", F.col(id_col).cast("long")).withColumn("__vs_key", F.xxhash64(text_col))
    rows = rows.withColumn("__vs_hit", _in_map(touched)(F.xxhash64("__vs_doc", "__vs_key")))
    gone = "array<struct<start:int,stop:int>>"

    @F.pandas_udf(f"struct<text string, spans {gone}>")
    def cut(texts, spans):
        import pandas as pd

        out, gone = [], []
        for t, s in zip(texts, spans):
            raw = t.encode() if s is not None and isinstance(t, str) else b""
            found = runs([extended(raw, x["start"], x["stop"], x["left"], x["right"]) for x in s], min_run) if raw else []
            if found:
                at, left = 0, []
                for a, b in found:
                    left.append(raw[at:a])
                    at = b
                t = b"".join([*left, raw[at:]]).decode()
            out.append(t if isinstance(t, str) else None)
            gone.append([{"start": a, "stop": b} for a, b in found])
        return pd.DataFrame({"text": pd.Series(out, dtype="object"), "spans": pd.Series(gone, dtype="object")})

    hit = rows.where("__vs_hit").join(found, F.col("__vs_doc").eqNullSafe(F.col("__vs_d")) & (F.col("__vs_key") == F.col("__vs_k")), "left")
    hit = hit.withColumn("__vs_cut", F.when(F.col("__vs_spans").isNotNull(), cut.asNondeterministic()(F.col(text_col).cast("string"), F.col("__vs_spans"))))
    text = F.when(F.col("__vs_spans").isNotNull(), F.col("__vs_cut.text")).otherwise(F.col(text_col))
    none = F.expr(f"cast(array() as {gone})")

    def shaped(df, text, cuts):
        cols = [text.alias(c) if c == text_col else F.length(text).cast("long").alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in names]
        return df.select(*cols, *([cuts.alias(spans_out)] if spans_out else []))

    return shaped(rows.where("not __vs_hit"), F.col(text_col), none).unionByName(shaped(hit, text, F.coalesce("__vs_cut.spans", none)))


def op8_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return substring_dedup(docs, spans_out="removed")
