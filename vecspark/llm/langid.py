"""Language identification by hierarchical discrimination (operator 10).

Hashed character n-grams (1 to 3) of letters feed linear support vector machines, trained by dual coordinate
descent: one for each language family against the rest, then one for each pair of languages within a family.
A text's family is decided first, its language by the pairs' votes within it.

Training takes, of each language, the ``per_language`` labelled ids of least XXH64 and ``max_rows`` in all (a
documented bound for the classifier alone; of a repeated id the row of least language and text); prediction covers
every row, whole texts.

Defined cases: null text or text without a letter is ``und`` with score 0; with no labelled row everything is
``und``; with one language all texts with letters are of it; ties go to the language first in the alphabet;
repeated rows get equal results; labelled rows of a null id are not learned from; an empty table gives an empty
result; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import small_batches, table

DIMS, PER_LANGUAGE, MAX_ROWS, UND = 2048, 500, 4000, "und"
#: A text whose n-grams fit its language worse, in deviations of the training rows, is of none of the languages.
MIN_FIT = -12.0
#: Well-known families of ISO 639-1 codes; a language not listed is a family of its own.
FAMILIES = {
    "germanic": "af da de en fy is lb nb nl nn no sv yi",
    "romance": "ca es fr gl it oc pt ro",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "uralic": "et fi hu",
    "turkic": "az kk tr tt uz",
    "semitic": "ar he mt",
    "indo-aryan": "bn gu hi mr ne pa ur",
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes.split()}


@functools.cache
def _letters() -> np.ndarray:
    return np.array([chr(i).isalpha() for i in range(0x110000)], bool)


def features(texts: list[str], dims: int = DIMS) -> np.ndarray:
    """A row for each text: square roots of hashed n-gram shares, of unit length; zeros without a letter."""
    lower = [t.lower() for t in texts]
    raw = np.frombuffer("".join(f" {t} " for t in lower).encode("utf-32-le", "surrogatepass"), np.uint32)
    doc = np.repeat(np.arange(len(lower)), [len(t) + 2 for t in lower])
    c = np.where(_letters()[raw], raw, 32)
    keep = np.ones(len(c), bool)
    keep[1:] = (c[1:] != 32) | (c[:-1] != 32) | (doc[1:] != doc[:-1])  # runs of other characters are one gap
    c, doc = c[keep], doc[keep]
    out = np.zeros(len(texts) * dims)
    shift = np.uint32(32 - dims.bit_length() + 1)
    one = c * np.uint32(0x9E3779B1)
    grams = [(one, c != 32)]
    if len(c) > 1:
        two = (c[:-1] * np.uint32(0x85EBCA6B) ^ c[1:]) * np.uint32(0xC2B2AE35)
        same = doc[1:] == doc[:-1]
        grams.append((two, same))
    if len(c) > 2:
        three = ((c[:-2] * np.uint32(0x27D4EB2F) ^ c[1:-1]) * np.uint32(0x165667B1) ^ c[2:]) * np.uint32(0x9E3779B1)
        grams.append((three, doc[2:] == doc[:-2]))
    for h, ok in grams:
        at = doc[: len(h)][ok] * dims + (h[ok] >> shift)
        out += np.bincount(at, minlength=len(out))
    out = np.sqrt(out.reshape(len(texts), dims))
    lettered = np.bincount(doc, weights=c != 32, minlength=len(texts)) > 0
    norm = np.sqrt((out * out).sum(1))
    return np.where(lettered[:, None], out / np.maximum(norm, 1e-12)[:, None], 0)


def svm(x: np.ndarray, y: np.ndarray, c: float = 1.0, epochs: int = 12, seed: int = 7) -> np.ndarray:
    """Weights (the last is the bias) of a linear SVM with hinge loss, by dual coordinate descent."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w, alpha, norm = np.zeros(x.shape[1]), np.zeros(len(x)), (x * x).sum(1)
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(x)):
            g = y[i] * (x[i] @ w) - 1
            new = min(max(alpha[i] - g / norm[i], 0), c)
            if new != alpha[i]:
                w += (new - alpha[i]) * y[i] * x[i]
                alpha[i] = new
    return w


class Fit:
    """How well a text's n-grams fit a language: their mean log share in its training rows, in deviations of those rows.

    Unlike the machines' scores this says whether a text is of a language at all, not which of them is nearest. The
    deviations widen for short texts as those of the training rows do.
    """

    def __init__(self, x: np.ndarray, langs: list[str], sizes: np.ndarray):
        lang, share = np.array(langs), x * x
        every = share.mean(0) + 1e-6 if len(x) else None
        self.log, self.mid, self.var = {}, {}, {}
        for k in sorted(set(langs)):
            own, n = share[lang == k], np.maximum(sizes[lang == k], 1)
            self.log[k], ll = self._log(own, every), np.zeros(len(own))
            for part in (0, 1):  # each half by the other, as rows fit shares of their own too well
                ll[part::2] = own[part::2] @ self._log(own[1 - part :: 2], every)
            self.mid[k] = float(np.median(ll))
            far, short = np.abs(ll - self.mid[k]), n <= np.median(n)
            (u, d), (v, e) = ((np.mean(1 / n[m]), (1.4826 * np.median(far[m])) ** 2) if m.any() else (0.0, 0.0) for m in (short, ~short))
            slope = max((d - e) / (u - v), 0.0) if u > v else 0.0
            few = 1 + 30 / len(own)  # of few rows neither the shares nor their spread are well known
            self.var[k] = (max(e - slope * v, 1e-4) * few, slope * few) if len(own) > 1 else (np.inf, 0.0)

    @staticmethod
    def _log(rows: np.ndarray, every: np.ndarray) -> np.ndarray:
        p = rows.sum(0) + 2 * every
        return np.log(p / p.sum())

    def score(self, x: np.ndarray, langs: list[str], sizes: np.ndarray) -> np.ndarray:
        out = np.full(len(x), -np.inf)
        for k in set(langs) & set(self.log):
            m = np.array([g == k for g in langs])
            a, b = self.var[k]
            out[m] = ((x[m] * x[m]) @ self.log[k] - self.mid[k]) / np.sqrt(a + b / np.maximum(sizes[m], 1))
        return out


class Model:
    fit: Fit | None = None

    def __init__(self, x: np.ndarray, langs: list[str]):
        self.langs = sorted(set(langs))
        self.family = [FAMILY_OF.get(k, f"own:{k}") for k in self.langs]
        self.families = sorted(set(self.family))
        lang, fam = np.array(langs), np.array([FAMILY_OF.get(k, f"own:{k}") for k in langs])
        self.top = np.array([svm(x, np.where(fam == f, 1.0, -1.0)) for f in self.families]) if len(self.families) > 1 else None
        self.pairs = {}
        for f in self.families:
            own = [k for k, g in zip(self.langs, self.family) if g == f]
            for i, a in enumerate(own):
                for b in own[i + 1 :]:
                    m = (lang == a) | (lang == b)
                    self.pairs[a, b] = svm(x[m], np.where(lang[m] == a, 1.0, -1.0))

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        prob = lambda w: 1 / (1 + np.exp(-4 * np.clip(x @ w[:-1] + w[-1], -30, 30)))
        n, lettered = len(x), x.any(1)
        if not self.langs:
            return [UND] * n, np.zeros(n)
        if self.top is None:
            family, sure = np.zeros(n, int), np.ones(n)
        else:
            p = np.stack([prob(w) for w in self.top], 1)
            family, sure = p.argmax(1), p.max(1) / np.maximum(p.sum(1), 1e-12)
        votes = {k: np.zeros(n) for k in self.langs}
        mine = {k: [] for k in self.langs}
        for (a, b), w in self.pairs.items():
            p = prob(w)
            votes[a] += p >= 0.5
            votes[b] += p < 0.5
            mine[a].append(p)
            mine[b].append(1 - p)
        total = np.stack([np.where(family == self.families.index(f), votes[k], -1) for k, f in zip(self.langs, self.family)], 1)
        best = total.argmax(1)
        within = np.stack([np.mean(mine[k], 0) if mine[k] else np.ones(n) for k in self.langs], 1)[np.arange(n), best]
        return [self.langs[i] if ok else UND for i, ok in zip(best, lettered)], np.where(lettered, np.round(sure * within, 6), 0.0)


def _by_blocks(texts: list[str | None], chars: int = 500_000, rows: int = 256):
    block, size = [], 0
    for t in texts:
        if block and (size + len(t or "") > chars or len(block) == rows):
            yield block
            block, size = [], 0
        block.append(t or "")
        size += len(t or "")
    if block:
        yield block


def train(docs: DataFrame, train_rows, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE, max_rows: int = MAX_ROWS) -> Model:
    """Fit on at most ``max_rows`` labelled rows for which the condition ``train_rows`` holds."""
    small_batches(docs.sparkSession)
    rows = docs.where(train_rows).where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    keys = rows.select(F.col(lang_col).cast("string").alias("lang"), F.col(id_col).alias("__vs_id"), F.xxhash64(F.col(id_col).cast("string")).alias("h"))
    # Hashes are spread evenly, so of a language's n ids those in the lowest (2 * per_language + 200) / n of the range
    # hold the per_language least. Only they are shuffled. Of more than max_rows languages the first ones matter alone.
    sizes = keys.groupBy("lang").agg(F.approx_count_distinct("h").alias("n")).orderBy("lang").limit(max_rows)
    low = keys.join(F.broadcast(sizes), "lang").where((F.col("h") / 2.0**64 + 0.5) * F.col("n") < 2 * per_language + 200)
    w = Window.partitionBy("lang").orderBy("h", "__vs_id")
    picked = low.select("lang", "__vs_id", "h").distinct().withColumn("k", F.row_number().over(w)).where(F.col("k") <= per_language)
    picked = picked.orderBy("k", "lang").limit(max_rows).select("__vs_id").distinct()
    slim = rows.select(F.col(id_col).alias("__vs_own"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("t"))
    chosen = slim.join(F.broadcast(picked), F.col("__vs_own") == F.col("__vs_id"), "left_semi")  # at most max_rows ids
    chosen = chosen.groupBy("__vs_own").agg(F.min(F.struct("lang", "t")).alias("x"))

    def run(batches):
        for b in batches:
            texts, langs, at = b.column(0).to_pylist(), b.column(1).to_pylist(), 0
            for block in _by_blocks(texts):
                x = features(block)
                part, at = langs[at : at + len(block)], at + len(block)
                ok = x.any(1)
                yield pa.RecordBatch.from_arrays([pa.array([k for k, o in zip(part, ok) if o], pa.string()), pa.array([r.tobytes() for r in x[ok].astype(np.float32)], pa.binary()), pa.array([len(t) for t, o in zip(block, ok) if o], pa.int64())], ["lang", "x", "n"])

    got = chosen.select("x.t", "x.lang").mapInArrow(run, "lang string, x binary, n long").limit(max_rows).collect()
    got.sort()
    x, langs = np.array([np.frombuffer(r[1], np.float32) for r in got], np.float64).reshape(len(got), DIMS), [r[0] for r in got]
    model = Model(x, langs)
    model.fit = Fit(x, langs, np.array([r[2] for r in got], np.int64))
    return model


def predict(docs: DataFrame, model: Model, text_col: str = "text", lang_out: str = "lang_pred", score_out: str = "score", fit_out: str | None = None) -> DataFrame:
    """``docs`` with the predicted language and its score (and how well it fits); only the text is looked at."""
    handle = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("struct<lang string, score double, fit double>")
    def classify(texts):
        import pandas as pd

        langs, scores, fits = [], [], []
        for block in _by_blocks([t if isinstance(t, str) else None for t in texts]):
            x = features(block)
            k, s = handle.value.predict(x)
            langs += k
            scores += s.tolist()
            fits += handle.value.fit.score(x, k, np.array([len(t) for t in block])).tolist() if fit_out else [0.0] * len(k)
        return pd.DataFrame({"lang": pd.Series(langs, dtype="object"), "score": pd.Series(scores, dtype="float64"), "fit": pd.Series(fits, dtype="float64")})

    classify = classify.asNondeterministic()  # keeps it from being computed once for each use
    out = docs.withColumn("__vs_found", classify(F.col(text_col).cast("string"))).withColumn(lang_out, F.col("__vs_found.lang")).withColumn(score_out, F.col("__vs_found.score"))
    return (out.withColumn(fit_out, F.col("__vs_found.fit")) if fit_out else out).drop("__vs_found")


def held_out(id_col: str = "doc_id"):
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 4 == 2


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Train on the rows not held out and predict all."""
    model = train(docs, ~held_out(id_col), id_col, text_col, lang_col)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("t"))
    return predict(rows, model, "t").select("doc_id", "held_out", "lang_pred", "score")


def filter_language(docs: DataFrame, min_score: float = 0.2, min_fit: float = MIN_FIT, **columns) -> DataFrame:
    """``docs`` without those of no language (``und``), of a score below ``min_score`` or of a fit below ``min_fit``;
    their columns as they were."""
    id_col = columns.get("id_col", "doc_id")
    model = train(docs, ~held_out(id_col), **columns)
    found = predict(docs, model, columns.get("text_col", "text"), "__vs_pred", "__vs_score", "__vs_fit")
    return found.where((F.col("__vs_pred") != UND) & (F.col("__vs_score") >= min_score) & (F.col("__vs_fit") >= min_fit)).select(*[F.col(f"`{c}`") for c in docs.columns])


def op10_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))
