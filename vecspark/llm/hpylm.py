"""Hierarchical Pitman-Yor language model and its scores (operator 3).

Restaurants: a token's context is the whole word before it, hashed to one of ``K2`` numbers; it backs off to the
class of that word's last byte, and all of those share the root (the word alone), whose base is uniform over the
vocabulary and one unknown word. Seatings are sampled by Gibbs sweeps over table counts: for up to ``EXACT``
customers of a dish from the full conditional (generalised Stirling numbers), beyond it by seating customers in
growing groups. Scores average the predictive probabilities of the samples that follow the burn-in.

Distribution: everything about a word lies in one bucket of its hash; there are as many buckets as the table's
tokens need (``TOKENS`` each), whatever the number of shuffle partitions. Tasks turn blocks of documents into one
compact row for each bucket (sorted hashes, contexts, documents and counts as arrays), so the shuffle carries few
rows and no word, however frequent, adds more than one entry for each document and context. The first pass counts
each restaurant's customers, which no bucket has all of. The second samples every bucket and sums what the buckets
must share: each restaurant's tables, vocabulary and token counts. While a bucket samples, it takes for the tables
of a whole restaurant its customers times the tables for each customer that the bucket's restaurants of like size
have. The third pass samples alike (same seed) and scores with the shared sums, which makes the probabilities of
all words add up to one; partial sums go back to the documents' blocks. Restaurants' totals come to the driver
packed, in arrays whose size ``K2`` fixes; the seatings of words in restaurants grow with the input and stay in
the buckets.

Defined cases: null text counts as empty, an empty text is one end token; a null id counts as the empty text for
the split; repeated rows count and are scored each; with no training row every word is unknown; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import table

K1, SLOTS = 64, 15
K2 = K1 << SLOTS
EXACT, BURN, SAMPLES, THETA = 32, 3, 3, 1.0
TOKENS = 2_000_000
BLOCK_CHARS, BLOCK_DOCS = 6_000_000, 60_000


def contexts(words: list[bytes], hashes: np.ndarray) -> np.ndarray:
    """The restaurant of what follows each word; the empty word is the start of a text."""
    last = np.fromiter((w[-1] if w else 0 for w in words), np.int64, len(words))
    return (last % K1) << SLOTS | (hashes >> np.uint64(64 - SLOTS)).astype(np.int64)


class _Words(dict):
    def __missing__(self, word):
        self[word] = n = len(self)
        return n


def _blocks(batches):
    """(ids, texts, training flags) of several Arrow batches at a time."""
    ids, texts, flags, size = [], [], [], 0
    for b in batches:
        for i, t, f in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist()):
            raw = t.as_buffer().to_pybytes() if t.is_valid else b""
            if texts and (size + len(raw) > BLOCK_CHARS or len(texts) >= BLOCK_DOCS):
                yield ids, texts, flags
                ids, texts, flags, size = [], [], [], 0
            ids.append(i)
            texts.append(raw)
            flags.append(f)
            size += len(raw)
    if texts:
        yield ids, texts, flags


def _tokens(texts: list[bytes]):
    """Distinct words' hashes and restaurants; each token's word and restaurant; each text's length."""
    words = _Words()
    end = words[b""]
    number, parts, lengths = words.__getitem__, [], []
    for t in texts:
        w = t.lower().split()
        parts.append(np.fromiter(map(number, w), np.int32, len(w)))
        lengths.append(len(w) + 1)
    names = list(words)
    hashes = np.frombuffer(b"".join(map(xxhash.xxh64_digest, names)), ">u8").astype(np.uint64)
    klass = contexts(names, hashes)
    lengths = np.array(lengths)
    stops = np.cumsum(lengths)
    tok = np.full(int(stops[-1]), end, np.int64)
    ctx = np.full(len(tok), klass[end])
    mask = np.ones(len(tok), bool)
    mask[stops - 1] = False
    flat = np.concatenate(parts) if parts else np.zeros(0, np.int32)
    tok[mask] = flat
    ctx[np.flatnonzero(mask) + 1] = klass[flat]
    return hashes, tok, ctx, lengths


def _customers(batches):
    """Training tokens that follow each context, as ``at`` and ``a``; at ``K2`` the tokens of all rows."""
    total, tokens = np.zeros(K2, np.int64), 0
    for _, texts, flags in _blocks(batches):
        _, _, ctx, lengths = _tokens(texts)
        total += np.bincount(ctx[np.repeat(np.array(flags, bool), lengths)], minlength=K2)
        tokens += len(ctx)
    at = np.flatnonzero(total)
    if tokens:
        at, total = np.append(at, K2), np.append(total[at], tokens)
        for s in range(0, len(at), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(at[s : s + 100_000], pa.int32()), pa.array(total[s : s + 100_000])], ["at", "a"])


def _packed(sums: DataFrame, columns: int) -> np.ndarray:
    """Rows ``at`` and sums, brought to the driver as arrays; a column for each sum."""

    def pack(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([c.to_numpy(zero_copy_only=False).tobytes()], pa.binary()) for c in b.columns], [f"c{i}" for i in range(columns + 1)])

    out = np.zeros((columns, K2 + K1 + 16), np.int64)
    for r in sums.mapInArrow(pack, ", ".join(f"c{i} binary" for i in range(columns + 1))).toLocalIterator():
        for i in range(columns):
            out[i, np.frombuffer(r[0], np.int32)] = np.frombuffer(r[i + 1], np.int64)
    return out


def _entries(texts: list[bytes], buckets: int):
    """Sorted distinct (word, context, document) of a block: hashes by bucket, and code and count of each entry."""
    hashes, tok, ctx, lengths = _tokens(texts)
    doc = np.repeat(np.arange(len(texts)), lengths)
    bucket = (hashes % np.uint64(buckets)).astype(np.int64)
    order = np.lexsort((hashes, bucket))
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    code = np.sort(rank[tok] << 37 | ctx << 16 | doc)
    first = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
    count = np.diff(np.concatenate([first, [len(code)]]))
    return hashes[order], np.searchsorted(bucket[order], np.arange(buckets + 1)), code[first], count, lengths


SCHEMA = "bucket int, block long, hashes binary, per_word binary, ctx binary, doc binary, cnt binary, train binary, ids binary, null_ids binary, tokens binary"


def _split(ctx: np.ndarray) -> bytes:
    """Contexts in three bytes each: all low pairs, then all high bytes."""
    return ctx.astype(np.uint16).tobytes() + (ctx >> 16).astype(np.uint8).tobytes()


def _joined(raw: bytes) -> np.ndarray:
    n = len(raw) // 3
    return np.frombuffer(raw, np.uint16, n).astype(np.int64) | np.frombuffer(raw, np.uint8, n, 2 * n).astype(np.int64) << 16


def _rows(buckets: int, scoring: bool):
    """Blocks of documents to a row for each bucket; without ``scoring``, training counts alone."""

    def run(batches):
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        for number, (ids, texts, flags) in enumerate(_blocks(batches)):  # a repeated task names its blocks alike
            hashes, cuts, code, count, lengths = _entries(texts, buckets)
            train = np.array(flags, bool)
            if not scoring:
                own = train[code & 0xFFFF]
                code, count = code[own] >> 16, count[own]
                first = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]])) if len(code) else np.zeros(0, int)
                count = np.add.reduceat(count, first) if len(code) else count
                code = code[first] << 16
            word = code >> 37
            block, at = task << 32 | number, np.searchsorted(word, cuts)
            out: list[list] = [[] for _ in range(11)]
            for k in range(buckets):
                s, e, w0, w1 = at[k], at[k + 1], cuts[k], cuts[k + 1]
                if s == e and (k or not scoring):
                    continue
                n = np.bincount(word[s:e] - w0, minlength=w1 - w0)
                used = np.flatnonzero(n)
                top = scoring and not k
                row = (k, block, hashes[w0:w1][used], n[used].astype(np.uint32), _split(code[s:e] >> 16 & K2 - 1), (code[s:e] & 0xFFFF).astype(np.uint16) if scoring else None, count[s:e].astype(np.uint32), np.packbits(train) if scoring else None, np.array([i or 0 for i in ids], np.int64) if top else None, np.array([i is None for i in ids]) if top else None, lengths.astype(np.int64) if top else None)
                for col, x in zip(out, row):
                    col.append(x.tobytes() if isinstance(x, np.ndarray) else x)
            kinds = [pa.int32(), pa.int64(), *[pa.binary()] * 9]
            names = [x.split()[0] for x in SCHEMA.split(", ")]
            for s in range(0, len(out[0]), 16):
                yield pa.RecordBatch.from_arrays([pa.array(c[s : s + 16], t) for c, t in zip(out, kinds)], names)

    return run


def _read(t: pa.Table):
    """Word hash, context, document number in the block, count and training flag of all entries, by block."""
    blobs = {c: t.column(c).to_pylist() for c in ("hashes", "per_word", "ctx", "doc", "cnt", "train")}
    hashes = [np.repeat(np.frombuffer(h, np.uint64), np.frombuffer(n, np.uint32)) for h, n in zip(blobs["hashes"], blobs["per_word"])]
    ctx = [_joined(x) for x in blobs["ctx"]]
    cnt = [np.frombuffer(x, np.uint32).astype(np.int64) for x in blobs["cnt"]]
    doc = [np.frombuffer(x, np.uint16) if x is not None else None for x in blobs["doc"]]
    train = [np.unpackbits(np.frombuffer(x, np.uint8)).astype(bool)[d] if x is not None else None for x, d in zip(blobs["train"], doc)]
    return hashes, ctx, doc, cnt, train


def _summed(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    u, at = np.unique(key, return_inverse=True)
    return u, np.bincount(at, weights=n, minlength=len(u)).astype(np.int64)


def stirling(d: float, top: int = EXACT) -> np.ndarray:
    """Logarithms of the generalised Stirling numbers: seatings of c customers at t tables."""
    s = np.full((top + 1, top + 1), -np.inf)
    s[0, 0] = 0
    for c in range(top):
        for t in range(1, c + 2):
            stay = s[c, t] + math.log(c - d * t) if t <= c and c - d * t > 0 else -np.inf
            s[c + 1, t] = np.logaddexp(s[c, t - 1], stay)
    return s


def sample_tables(c: np.ndarray, mass: np.ndarray, d: float, logs: np.ndarray, rng) -> np.ndarray:
    """Table counts given customers and each restaurant's mass for a new table."""
    t = np.ones(len(c), np.int64)
    for k in range(2, EXACT + 1):
        at = np.flatnonzero(c == k)
        if len(at):
            w = logs[k, 1 : k + 1] + np.log(mass[at])[:, None] * np.arange(1, k + 1)
            t[at] = 1 + (w + rng.gumbel(size=w.shape)).argmax(1)
    at = np.flatnonzero(c > EXACT)
    if len(at):
        n, a = c[at], mass[at]
        j, now = np.ones(len(at), np.int64), np.ones(len(at), np.int64)
        while (todo := n - j).any():
            step = np.minimum(todo, np.maximum(1, j // 16))
            now += rng.binomial(step, np.clip(a / (a + j - d * now), 0, 1))
            j += step
        t[at] = now
    return t


def _discount(ones: float, twos: float) -> float:
    return min(max(ones / (ones + 2 * twos) if ones + twos else 0.5, 0.1), 0.95)


class Seating:
    """One bucket's restaurants and their samples; ``full`` has the customers of every whole restaurant."""

    def __init__(self, hashes, ctx, cnt, full: np.ndarray, buckets: int, seed: int):
        self.words, at = np.unique(hashes, return_inverse=True)
        n_words = len(self.words)
        self.k2, c2 = _summed(at.astype(np.int64) << 21 | ctx, cnt)
        w2, x2 = self.k2 >> 21, self.k2 & K2 - 1
        self.k1, up2 = np.unique(w2 << 21 | x2 >> SLOTS, return_inverse=True)
        w1, x1 = self.k1 >> 21, self.k1 & K2 - 1
        self.c2, self.x2, self.x1, self.samples = c2, x2, x1, []
        self.count = np.bincount(w2, weights=c2, minlength=n_words).astype(np.int64)
        rng = np.random.default_rng([seed, int(self.words[0] & np.uint64(0xFFFFFFFF)) if n_words else 0])
        base = 1.0 / (n_words * buckets + 1)
        t2 = np.ones(len(c2), np.int64)
        c1 = np.bincount(up2, weights=t2, minlength=len(self.k1)).astype(np.int64)
        t1 = np.ones(len(c1), np.int64)
        c0 = np.bincount(w1, weights=t1, minlength=n_words).astype(np.int64)
        t0 = np.ones(n_words, np.int64)
        self.ones = [(int((n == 1).sum()), int((n == 2).sum())) for n in (c2, c1, c0)]
        d2, d1, d0 = (_discount(*n) for n in self.ones)
        logs = [stirling(d) for d in (d2, d1, d0)]
        whole = np.maximum(full[x2], 1)
        size = np.frexp(whole)[1]
        customers = np.maximum(np.bincount(size, weights=c2), 1)
        for sweep in range(BURN + SAMPLES):
            tt2 = whole * (np.bincount(size, weights=t2) / customers)[size]
            tt1 = np.bincount(x1, weights=t1, minlength=K1) * buckets
            full1 = np.bincount(x1, weights=c1, minlength=K1) * buckets
            p0 = (c0 - d0 * t0 + (THETA + d0 * t0.sum() * buckets) * base) / (THETA + c0.sum() * buckets)
            p1 = (c1 - d1 * t1 + (THETA + d1 * tt1[x1]) * p0[w1]) / (THETA + full1[x1])
            t2 = sample_tables(c2, (THETA + d2 * tt2) * p1[up2], d2, logs[0], rng)
            c1 = np.bincount(up2, weights=t2, minlength=len(self.k1)).astype(np.int64)
            t1 = sample_tables(c1, (THETA + d1 * tt1[x1]) * p0[w1], d1, logs[1], rng)
            c0 = np.bincount(w1, weights=t1, minlength=n_words).astype(np.int64)
            t0 = sample_tables(c0, np.full(n_words, (THETA + d0 * t0.sum() * buckets) * base), d0, logs[2], rng)
            if sweep >= BURN:
                self.samples.append((t2, c1, t1, c0, t0))

    def shared(self) -> tuple[np.ndarray, np.ndarray]:
        """What all buckets' sums are needed of: places, and a column of numbers for each sample."""
        u, at = np.unique(self.x2, return_inverse=True)
        cols = []
        meta = [len(self.words), self.count.sum(), *(x for pair in self.ones for x in pair)]
        for t2, _, t1, _, t0 in self.samples:
            cols.append(np.concatenate([np.bincount(at, weights=t2, minlength=len(u)), np.bincount(self.x1, weights=t1, minlength=K1), [t0.sum()], meta]))
        return np.concatenate([u, np.arange(K2, K2 + K1 + 1 + len(meta))]), np.array(cols).astype(np.int64)


class Totals:
    """Sums of all buckets: customers and, by sample, tables of each restaurant; vocabulary and tokens."""

    def __init__(self, full: np.ndarray, sums: np.ndarray):
        self.full, self.t2 = full, sums[:, :K2].astype(np.float32)
        self.full1 = sums[:, :K2].reshape(len(sums), K1, -1).sum(2)
        self.t1, self.t0 = sums[:, K2 : K2 + K1], sums[:, K2 + K1]
        self.words, self.tokens, *n = map(int, sums[0, K2 + K1 + 1 : K2 + K1 + 9])
        self.discounts = [_discount(*n[i : i + 2]) for i in (0, 2, 4)]


def predict(s: Seating, total: Totals, hashes: np.ndarray, ctx: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Training count of each word, and log10 of its probability after the context."""
    d2, d1, d0 = total.discounts
    base = 1.0 / (total.words + 1)

    def at(keys, key):
        i = np.minimum(np.searchsorted(keys, key), max(len(keys) - 1, 0))
        return (i, keys[i] == key) if len(keys) else (i, np.zeros(len(key), bool))

    x1 = ctx >> SLOTS
    w, known = at(s.words, hashes)
    i2, has2 = at(s.k2, w.astype(np.int64) << 21 | ctx)
    i1, has1 = at(s.k1, w.astype(np.int64) << 21 | x1)
    has2, has1 = has2 & known, has1 & known
    get = lambda v, i, ok: np.where(ok, v[i], 0) if len(v) else np.zeros(len(i))
    c2, full2, p = get(s.c2, i2, has2), total.full[ctx].astype(float), np.zeros(len(ctx))
    for k, (t2, c1, t1, c0, t0) in enumerate(s.samples):
        p0 = (get(c0, w, known) - d0 * get(t0, w, known) + (THETA + d0 * total.t0[k]) * base) / (THETA + total.t1[k].sum())
        p1 = (get(c1, i1, has1) - d1 * get(t1, i1, has1) + (THETA + d1 * total.t1[k][x1]) * p0) / (THETA + total.full1[k][x1])
        p += (c2 - d2 * get(t2, i2, has2) + (THETA + d2 * total.t2[k][ctx]) * p1) / (THETA + full2)
    return get(s.count, w, known), np.log10(p / max(len(s.samples), 1))


def score(docs: DataFrame, train_rows=None, id_col: str = "doc_id", text_col: str = "text", seed: int = 11, buckets: int | None = None) -> DataFrame:
    """Token counts, the unigram baseline and the model's score of each row.

    ``train_rows`` is the condition of the rows that the model learns from; by default those whose id's CRC-32
    leaves another remainder than 2 by 7.
    """
    spark = docs.sparkSession
    held = F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 7 == 2
    train = ~held if train_rows is None else train_rows
    rows = docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).cast("string").cast("binary").alias("t"), F.coalesce(train, F.lit(False)).alias("f"))

    sums = rows.mapInArrow(_customers, "at int, a long").groupBy("at").agg(F.sum("a").alias("a"))
    full = _packed(sums, 1)[0]
    buckets = buckets or max(1, -(-int(full[K2]) // TOKENS))
    full = full[:K2].astype(np.float32)
    customers = spark.sparkContext.broadcast(full)

    def learn(t: pa.Table) -> pa.Table:
        hashes, ctx, _, cnt, _ = _read(t)
        s = Seating(np.concatenate(hashes), np.concatenate(ctx), np.concatenate(cnt), customers.value, buckets, seed)
        at, cols = s.shared()
        return pa.table({"at": pa.array(at, pa.int32()), **{f"s{k}": pa.array(v) for k, v in enumerate(cols)}})

    model = rows.where("f").mapInArrow(_rows(buckets, False), SCHEMA).select("bucket", "block", "hashes", "per_word", "ctx", "doc", "cnt", "train")
    names = [f"s{k}" for k in range(SAMPLES)]
    sums = model.groupBy("bucket").applyInArrow(learn, "at int, " + ", ".join(f"{c} long" for c in names))
    handle = spark.sparkContext.broadcast(Totals(full, _packed(sums.groupBy("at").agg(*(F.sum(c).alias(c) for c in names)), SAMPLES)))

    def judge(t: pa.Table) -> pa.Table:
        total = handle.value
        hashes, ctx, doc, cnt, flag = _read(t)
        s = Seating(*(np.concatenate([v[f] for v, f in zip(col, flag)]) for col in (hashes, ctx, cnt)), total.full, buckets, seed)
        out: dict[str, list] = {c: [] for c in ("block", "doc", "known", "base", "model")}
        for h, x, d, w in zip(hashes, ctx, doc, cnt):  # a block at a time bounds what the arithmetic takes
            seen, logp = predict(s, total, h, x)
            size = int(d.max()) + 1 if len(d) else 0
            sums = [np.bincount(d, weights=v, minlength=size) for v in (w * (seen > 0), w * np.log10(seen + 1), w * logp)]
            own = np.flatnonzero(np.bincount(d, minlength=size))
            for c, v in zip(("doc", "known", "base", "model"), (own.astype(np.uint16), sums[0][own].astype(np.uint32), sums[1][own], sums[2][own])):
                out[c].append(v.tobytes())
        out["block"] = t.column("block")
        cols = {c: out[c] if c == "block" else pa.array(out[c], pa.binary()) for c in out}
        return pa.table({**cols, **{c: t.column(c) for c in ("ids", "null_ids", "tokens")}})

    def gather(t: pa.Table) -> pa.Table:
        top = next(i for i, x in enumerate(t.column("ids").to_pylist()) if x is not None)
        ids, none, tokens = (np.frombuffer(t.column(c)[top].as_py(), k) for c, k in (("ids", np.int64), ("null_ids", bool), ("tokens", np.int64)))
        known, base, model = np.zeros(len(ids), np.int64), np.zeros(len(ids)), np.zeros(len(ids))
        order = np.argsort([zlib.crc32(x) for x in t.column("model").to_pylist()], kind="stable")  # sums in one order, run by run
        for i in order.tolist():
            d = np.frombuffer(t.column("doc")[i].as_py(), np.uint16)
            known[d] += np.frombuffer(t.column("known")[i].as_py(), np.uint32)
            base[d] += np.frombuffer(t.column("base")[i].as_py())
            model[d] += np.frombuffer(t.column("model")[i].as_py())
        total = handle.value
        base -= tokens * math.log10(float(total.tokens) + total.words + 1)
        return pa.table({"doc_id": pa.array(ids, mask=none), "n_tokens": tokens, "n_known": known, "train_tokens": np.full(len(ids), total.tokens), "base_score": base, "score": model})

    parts = rows.mapInArrow(_rows(buckets, True), SCHEMA).groupBy("bucket").applyInArrow(judge, "block long, doc binary, known binary, base binary, model binary, ids binary, null_ids binary, tokens binary")
    out = parts.groupBy("block").applyInArrow(gather, "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 7 == 2
    return out.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def perplexity(scored: DataFrame) -> DataFrame:
    """Perplexity for each token of held-out and of training rows, of the model and the baseline."""
    per = lambda c: F.pow(F.lit(10.0), -F.sum(c) / F.sum("n_tokens"))
    return scored.groupBy("held_out").agg(per("score").alias("perplexity"), per("base_score").alias("base_perplexity"), F.sum("n_tokens").alias("n_tokens"))


def op3_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))
