"""Byte-pair encoding and decoding of whole texts (operator 9), equal to the tokenizers library.

A text is split at its special tokens, normalised (NFC, lower case) and cut into words by the vocabulary
file's pattern: texts beyond Latin letters by the library's own Unicode tables. Words meet, in this order: a bounded memo of the worker; the lexicon, a minimal acyclic
transducer of the corpus's frequent words whose arcs add up to a word's number and so to its ids, kept in
one file that workers map into memory; and for unseen words the exact merges, done for many words at once.

Defined cases: null text counts as empty and has no ids; empty text the same; text of any length is encoded
whole; repeated rows give repeated results; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
import mmap
import os
import re
import sys
import tempfile
import unicodedata
from array import array

import numpy as np
import pyarrow as pa
import tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import drop_written, freed, small_batches, table, written

END = "</w>"
NONE = np.int64(1 << 40)
#: Sizes of the two merge tables: small ones stay in a core's cache.
FIRST_BITS, SECOND_BITS = 20, 20
#: Latin letters and numbers below U+0180, as the pattern's \p{L} and \p{N} have them.
_L = "a-zA-ZªµºÀ-ÖØ-öø-ſ"
_N = "0-9²³¹¼-¾"
_S = "\t-\r \u0085 "
FAST = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_L}]+|[{_N}]|[^{_S}{_L}{_N}]+")
BEYOND = re.compile("[ƀ-\U0010ffff]")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in set(plain) else chr(next(spare)) for b in range(256)]


class Vocabulary:
    """Ids, merges and special tokens of a vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        #: The library's own normaliser and pattern, for texts beyond Latin letters: its Unicode tables are newer than Python's.
        self.normal = tokenizers.Tokenizer.from_str(json.dumps({**spec, "added_tokens": [], "model": {"type": "BPE", "vocab": {}, "merges": []}})).normalizer
        self.cut = tokenizers.pre_tokenizers.Split(tokenizers.Regex(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]), "removed", invert=True)
        self.tokens = [""] * (max([*vocab.values(), *self.specials.values()]) + 1)
        for s, i in [*vocab.items(), *self.specials.items()]:
            self.tokens[i] = s
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(self.specials, key=len, reverse=True))) + ")") if self.specials else None
        symbols = byte_symbols()
        self.inner = np.array([vocab[c] for c in symbols], np.int64)
        self.final = np.array([vocab[c + END] for c in symbols], np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in merges]
        self.rank = {(vocab[a], vocab[b]): (r, vocab[a + b]) for r, (a, b) in reversed(list(enumerate(pairs)))}
        keys = np.array([a << 20 | b for a, b in self.rank], np.int64)
        values = np.array([r << 20 | i for r, i in self.rank.values()], np.int64)
        self._first, left = self._slots(keys, values, FIRST_BITS, 0x9E3779B97F4A7C15)
        for odd in range(0xBF58476D1CE4E5B9, 0xBF58476D1CE4E5B9 + 2000, 2):
            self._second, rest = self._slots(keys[left], values[left], SECOND_BITS, odd)
            if not rest.any():
                self._odd = odd
                break
        else:
            raise ValueError("no second table without collisions")

    @staticmethod
    def _slots(keys, values, bits, odd):
        at = ((keys.view(np.uint64) * np.uint64(odd)) >> np.uint64(64 - bits)).astype(np.int64)
        k, v = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.int64)
        k[at[::-1]], v[at[::-1]] = keys[::-1], values[::-1]
        return (k, v), k[at] != keys

    def merge_of(self, keys: np.ndarray) -> np.ndarray:
        """Rank and new id, packed, of each packed pair; NONE where the pair never merges."""
        shape, keys = keys.shape, np.ascontiguousarray(keys).ravel()
        u, out = keys.view(np.uint64), np.full(len(keys), NONE)
        for (k, v), odd, bits in ((self._first, 0x9E3779B97F4A7C15, FIRST_BITS), (self._second, self._odd, SECOND_BITS)):
            at = (u * np.uint64(odd)) >> np.uint64(64 - bits)
            hit = np.flatnonzero(k[at] == keys)
            out[hit] = v[at[hit]]
        return out.reshape(shape)

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return np.where(right >= 0, self.merge_of(left << 20 | (right & 0xFFFFF)), NONE)

    def words(self, text: str) -> list[str]:
        """The normalised words of ``text``; a special token is a word of its own."""
        if self.split and "<|" in text:
            out = []
            for i, part in enumerate(self.split.split(text)):
                out += [part] if i % 2 else self._words(part)
            return out
        return self._words(text)

    def _words(self, text: str) -> list[str]:
        try:
            text.encode("latin-1")
            return FAST.findall(text.lower())
        except UnicodeEncodeError:
            low = unicodedata.normalize("NFC", text).lower()
        if BEYOND.search(text) or BEYOND.search(low):
            return [w for w, _ in self.cut.pre_tokenize_str(self.normal.normalize_str(text))]
        return FAST.findall(low)

    def merge_one(self, word: str) -> list[int]:
        """The ids of one word, by a heap of its possible merges."""
        if word in self.specials:
            return [self.specials[word]]
        raw = word.encode("utf-8", "surrogatepass")
        ids = [*self.inner[list(raw[:-1])].tolist(), int(self.final[raw[-1]])]
        after, before = [*range(1, len(ids)), -1], [*range(-1, len(ids) - 1)]
        heap = [(*self.rank[p], i, p) for i in range(len(ids) - 1) if (p := (ids[i], ids[i + 1])) in self.rank]
        heap = [(r, i, new, p) for r, new, i, p in heap]
        heapq.heapify(heap)
        while heap:
            _, i, new, p = heapq.heappop(heap)
            j = after[i] if ids[i] >= 0 else -1
            if j < 0 or (ids[i], ids[j]) != p:
                continue
            ids[i], ids[j], after[i] = new, -1, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for k in (before[i], i):
                if k >= 0 and after[k] >= 0 and (p := (ids[k], ids[after[k]])) in self.rank:
                    r, new = self.rank[p]
                    heapq.heappush(heap, (r, k, new, p))
        return [x for x in ids if x >= 0]

    def merge_many(self, words: list[str]) -> list[list[int]]:
        """The ids of many words: in each step, every word's merge of least rank, leftmost first."""
        out: list = [None] * len(words)
        raws = [w.encode("utf-8", "surrogatepass") for w in words]
        plain = []
        for i, (w, raw) in enumerate(zip(words, raws)):
            if len(raw) > 48 or w in self.specials:
                out[i] = self.merge_one(w)
            else:
                plain.append(i)
        plain.sort(key=lambda i: len(raws[i]))
        for s in range(0, len(plain), 4096):
            block = plain[s : s + 4096]
            longest = len(raws[block[-1]])
            lens = np.array([len(raws[i]) for i in block])
            flat = np.frombuffer(b"".join(raws[i].ljust(longest, b"\0") for i in block), np.uint8).reshape(-1, longest)
            a = np.full((len(block), longest + 1), -1, np.int64)
            a[:, :longest] = self.inner[flat]
            rows = np.arange(len(block))
            a[rows, lens - 1] = self.final[flat[rows, lens - 1]]
            a[:, :longest][np.arange(longest) >= lens[:, None]] = -1
            done = a.copy()
            act, cols = rows, np.arange(longest + 1)
            best = np.full(a.shape, NONE)  # of each place the merge with its right neighbour
            best[:, :-1] = self._pairs(a[:, :-1], a[:, 1:])
            while len(act):
                at = best.argmin(1)
                found = best[np.arange(len(a)), at]
                on = found < NONE
                if not on.all():
                    done[act[~on]] = a[~on]
                    act, a, best, at, found = act[on], a[on], best[on], at[on], found[on]
                    if not len(act):
                        break
                row = np.arange(len(a))
                shift = np.minimum(cols + (cols > at[:, None]), longest)
                a, best = np.take_along_axis(a, shift, 1), np.take_along_axis(best, shift, 1)
                a[:, -1], best[:, -1] = -1, NONE
                new = found & 0xFFFFF
                a[row, at] = new
                best[row, at] = self._pairs(new, a[row, np.minimum(at + 1, longest)])
                far = np.flatnonzero(at > 0)
                best[far, at[far] - 1] = self._pairs(a[far, at[far] - 1], new[far])
            for i, row, n in zip(block, done.tolist(), (done >= 0).sum(1).tolist()):
                out[i] = row[:n]
        return out


@functools.lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class Lexicon:
    """A minimal acyclic transducer: word -> number by the sums on its arcs, number -> ids."""

    def __init__(self, buffer):
        head = np.frombuffer(buffer, np.int64, 4)
        arcs, words, ids, self.start = (int(x) for x in head)
        at, parts = 32, []
        for n in (arcs, arcs, arcs, words + 1, ids):
            parts.append(np.frombuffer(buffer, np.int64, n, at))
            at += 8 * n
        self.keys, self.target, self.add, self.offsets, self.ids = parts

    @staticmethod
    def compile(words: dict[str, list[int]]) -> bytes:
        """States shared by equal suffixes are found bottom-up from the sorted words."""
        items = sorted((w.encode("utf-8", "surrogatepass"), i) for w, i in words.items())
        register: dict = {}
        states: list[tuple] = []  # of each state: (final, ((byte, target), ...))

        def settle(node):
            key = (node[0], tuple(node[1]))
            if key not in register:
                register[key] = len(states)
                states.append(key)
            return register[key]

        path, last = [[False, []]], b""
        for w, _ in items:
            k = len(os.path.commonprefix([w, last]))
            while len(path) > k + 1:
                node = path.pop()
                path[-1][1].append((last[len(path) - 1], settle(node)))
            path += [[False, []] for _ in range(len(w) - k)]
            path[-1][0] = True
            last = w
        while len(path) > 1:
            node = path.pop()
            path[-1][1].append((last[len(path) - 1], settle(node)))
        start = settle(path[0])
        size: list[int] = []
        keys, target, add = [], [], []
        for s, (final, arcs) in enumerate(states):  # targets come before their sources
            n = int(final)
            for b, t in arcs:
                keys.append(s << 8 | b)
                target.append(t << 1 | states[t][0])
                add.append(n)
                n += size[t]
            size.append(n)
        offsets = np.cumsum([0, *(len(i) for _, i in items)])
        ids = [x for _, i in items for x in i]
        return b"".join(np.array(x, np.int64).tobytes() for x in ([len(keys), len(items), len(ids), start], keys, target, add, offsets, ids))

    def find(self, words: list[str]) -> list[list[int] | None]:
        """Ids of each word that the lexicon holds: all words step through the automaton together."""
        raws = [w.encode("utf-8", "surrogatepass") for w in words]
        out: list = [None] * len(words)
        if not len(self.keys):
            return out
        longest = min(64, max(map(len, raws), default=0))
        lens = np.array([len(r) for r in raws])
        live = np.flatnonzero(lens <= longest)
        flat = np.frombuffer(b"".join(raws[i].ljust(longest, b"\0") for i in live), np.uint8).reshape(len(live), longest)
        state, number, final = np.full(len(live), self.start), np.zeros(len(live), np.int64), np.zeros(len(live), bool)
        go = np.arange(len(live))
        for c in range(longest):
            go = go[lens[live[go]] > c]
            if not len(go):
                break
            key = state[go] << 8 | flat[go, c]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            ok = self.keys[at] == key
            final[go[~ok]] = False
            go, at = go[ok], at[ok]
            state[go], final[go] = self.target[at] >> 1, (self.target[at] & 1).astype(bool)
            number[go] += self.add[at]
            lens_now = lens[live[go]]
            final[go] &= lens_now == c + 1
        for i in np.flatnonzero(final):
            n = number[i]
            out[live[i]] = self.ids[self.offsets[n] : self.offsets[n + 1]].tolist()
        return out


@functools.lru_cache(maxsize=2)
def _mapped(digest: str, handle) -> Lexicon:
    """The lexicon, mapped from an unlinked file of this worker (a few MB by its word limit)."""
    with tempfile.TemporaryFile() as f:
        f.write(handle.data)
        f.flush()
        return Lexicon(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))


class _Blob:
    """A compiled lexicon that is hashable for the workers' cache."""

    def __init__(self, data: bytes):
        self.data, self.digest = data, hashlib.sha256(data).hexdigest()

    def __hash__(self):
        return hash(self.digest)

    def __eq__(self, other):
        return self.digest == other.digest


class Encoder:
    """Words to whatever ``form`` makes of their ids, with a bounded memo."""

    def __init__(self, vocab: Vocabulary, form, lexicon: Lexicon | None = None, limit: int = 200_000):
        self.vocab, self.form, self.lexicon, self.limit, self.memo = vocab, form, lexicon, limit, {}

    def learn(self, lists: list[list[str]]) -> None:
        """Make sure that the memo holds each word."""
        new = set().union(*lists).difference(self.memo) if lists else set()
        if len(self.memo) + len(new) > self.limit and self.memo:
            self.memo.clear()
            new = set().union(*lists)
        new = list(new)
        ids = self.lexicon.find(new) if self.lexicon and new else [None] * len(new)
        rest = [i for i, x in enumerate(ids) if x is None]
        for i, x in zip(rest, self.vocab.merge_many([new[i] for i in rest])):
            ids[i] = x
        self.memo.update(zip(new, map(self.form, ids)))

    def texts(self, texts: list[str | None], chars: int = 1_000_000):
        """Lists of what ``form`` made, a list for each text, in blocks of bounded size."""
        block, size = [], 0
        for t in [*texts, False]:
            if t is False or size > chars:
                self.learn(block)
                get = self.memo.__getitem__
                for words in block:
                    yield list(map(get, words))
                block, size = [], 0
            if t is not False:
                block.append(self.vocab.words(t or ""))
                size += len(t or "")


def packed(ids: list[int]) -> bytes:
    return np.array(ids, "<u4").tobytes() if sys.byteorder == "big" else array("I", ids).tobytes()


def frequent_words(docs: DataFrame, text_col: str, vocab_path: str, n: int) -> list[str]:
    """The most frequent words of all texts, at most ``n``; exact counts, combined in each task.

    A histogram of counts, of a fixed number of steps, gives the least count at which no more than ``n`` words are left.
    """

    small_batches(docs.sparkSession)
    def count(batches):
        from collections import Counter

        vocab = vocabulary(vocab_path)
        for b in batches:
            c: Counter = Counter()
            for t in b.column(0).to_pylist():
                c.update(vocab.words(t or ""))
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.string()), pa.array(list(c.values()), pa.int64())], ["word", "n"])

    found = docs.select(F.col(text_col).cast("string")).mapInArrow(freed(count), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    found = written(found.withColumn("step", F.floor(F.log2("n") * 64).cast("int")), "words")
    least, total = 0, 0
    for step, words in sorted(map(tuple, found.groupBy("step").count().collect()), reverse=True):  # at most 64 * 63 rows
        total += words
        if total > n:
            least = step + 1
            break
    out = sorted(r[0] for r in found.where(F.col("step") >= least).select("word").collect())
    drop_written(found)
    return out


def encode_decode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocab_path: str | None = None, lexicon_words: int = 50_000) -> DataFrame:
    """``(doc_id, ids_text, decoded)`` digests of each row: count of ids, SHA-256 of ids and of the decoded text.

    ``lexicon_words`` bounds the lexicon; 0 leaves it out. It changes the speed only.
    """
    small_batches(docs.sparkSession)
    spark, path = docs.sparkSession, vocab_path or default_vocabulary()
    handle = None
    if lexicon_words:
        vocab = vocabulary(path)
        words = [w for w in frequent_words(docs, text_col, path, lexicon_words) if w not in vocab.specials]
        handle = spark.sparkContext.broadcast(_Blob(Lexicon.compile(dict(zip(words, vocab.merge_many(words))))))

    def run(batches):
        vocab = vocabulary(path)
        tokens = vocab.tokens
        lexicon = _mapped(handle.value.digest, handle.value) if handle else None
        form = lambda ids: (len(ids), " ".join(map(str, ids)), " ".join([tokens[i] for i in ids]))
        enc = Encoder(vocab, form, lexicon, 250_000)
        for b in batches:
            n, ids, text = [], [], []
            for got in enc.texts(b.column(1).to_pylist()):
                n.append(sum(x[0] for x in got))
                ids.append(hashlib.sha256(" ".join([x[1] for x in got]).encode()).hexdigest())
                text.append(hashlib.sha256(" ".join([x[2] for x in got]).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(text, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("t")).mapInArrow(freed(run), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def token_ids(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocab_path: str | None = None) -> DataFrame:
    """``(doc_id, ids)``: the ids themselves."""
    small_batches(docs.sparkSession)
    path = vocab_path or default_vocabulary()

    def run(batches):
        enc = Encoder(vocabulary(path), packed)
        for b in batches:
            ids = [np.frombuffer(b"".join(x), "<u4").astype(np.int32) for x in enc.texts(b.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("t")).mapInArrow(freed(run), "doc_id long, ids array<int>")


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(table(spark, sf_dir, "documents"))
