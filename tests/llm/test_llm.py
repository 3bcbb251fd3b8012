"""Operators of subpackage llm against brute force, round trips and edge cases."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

pytest.importorskip("vecspark.llm")
from vecspark.llm import audio, bpe, chat, hpylm, langid, packing, quality, simhash, substring, warc  # noqa: E402
from vecspark.llm._common import scratch  # noqa: E402

LONG = " ".join(f"w{i % 977}" for i in range(30_000))
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
SF = "/root/testdata/sf0.001"


def random_texts(n, seed):
    r = random.Random(seed)
    vocab = ["the", "of", "and", "Tion", "ering", "été", "über", "niño"] + ["".join(r.choices("abcdefgh", k=r.randint(2, 9))) for _ in range(300)]
    return [" ".join(r.choices(vocab, k=r.randint(1, 120))) for _ in range(n)]


@pytest.fixture(scope="module")
def rows():
    texts = random_texts(60, 3)
    out = [(i, t, ["en", "fr", "de", "es"][i % 4], "s", len(t)) for i, t in enumerate(texts)]
    base = " ".join(f"word{i}" for i in range(200))
    out += [(100, base, "en", None, 1), (101, base, "en", "s", None), (102, base + " tail", None, "s", 3)]
    out += [(200, None, None, None, None), (201, "", "en", "s", 0), (202, LONG, "en", "s", 9), (203, "...", "en", "s", 3), (204, " \n\t", "en", "s", 3), (205, " x y", "fr", "s", 3), (None, "no id here", "en", "s", 1)]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


# SimHash


def slow_fingerprint(text, k=4):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    grams = [b" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))]
    hs = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs))


def slow_components(fps, radius=4):
    up = {i: i for i in fps}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(fps)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if (fps[a] ^ fps[b]).bit_count() <= radius:
                x, y = sorted((root(a), root(b)))
                up[y] = x
    return {i: root(i) for i in ids}


def test_simhash_equals_brute_force(spark, docs, rows):
    got = {r.doc_id: (int(r.fingerprint, 16), r.component_id) for r in simhash.simhash_components(docs).collect() if r.doc_id is not None}
    want = {r[0]: slow_fingerprint(r[1]) for r in rows if r[0] is not None}
    assert {k: v[0] for k, v in got.items()} == want
    assert {k: v[1] for k, v in got.items()} == slow_components(want)


@pytest.mark.parametrize("max_shard", [3, 4096])
def test_links_lose_nothing(spark, max_shard):
    r = random.Random(1)
    fps = []
    for _ in range(30):
        x = r.getrandbits(64)
        fps += [x] + [x ^ sum(1 << b for b in r.sample(range(64), r.randint(1, 6))) for _ in range(8)]
    fps = dict(enumerate(dict.fromkeys(fps)))
    reps = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v, k) for k, v in fps.items()], "fp long, node long")
    from vecspark.llm.components import connected_components

    got = {r.node: r.component for r in connected_components(simhash.fingerprint_links(reps, 4, max_shard)).collect()}
    want = slow_components(fps)
    assert {k: got.get(k, k) for k in fps} == want


def test_components_of_a_long_chain(spark):
    from vecspark.llm.components import connected_components

    e = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(5, 5), (None, 3), (500, 501), (500, 501)], "a long, b long")
    got = {r.node: r.component for r in connected_components(e).collect()}
    assert got == {**{i: 0 for i in range(201)}, 500: 500, 501: 500}


def test_near_dedup_keeps_one(spark, docs, rows):
    twice = docs.unionByName(docs.where("doc_id = 100")).withColumn("__vs_other", docs.doc_id)
    kept = [r.doc_id for r in simhash.near_dedup(twice).select("doc_id").collect()]
    assert kept.count(100) == 1 and 101 not in kept and 102 not in kept and None in kept and set(range(60)) <= set(kept)


def test_near_dedup_finds_similar_texts(spark):
    r, texts = random.Random(11), []
    for g in range(150):
        words = [f"v{r.randrange(5000)}" for _ in range(r.randint(80, 300))]
        other = list(words)
        for _ in range(max(1, round(len(words) * r.choice([0.01, 0.02, 0.03, 0.06])))):
            other[r.randrange(len(words))] = f"x{r.randrange(5000)}"
        texts += [(2 * g, " ".join(words)), (2 * g + 1, " ".join(other).upper())]
    kept = {x.doc_id for x in simhash.near_dedup(spark.createDataFrame(texts, "doc_id long, text string")).collect()}

    def grams(t):
        w = t.lower().split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}

    sets = [grams(t) for _, t in texts]
    alike = {2 * g + 1 for g in range(150) if len(sets[2 * g] & sets[2 * g + 1]) >= 0.8 * len(sets[2 * g] | sets[2 * g + 1])}
    assert 50 < len(alike) < 140
    gone = {i for i, _ in texts} - kept
    assert gone <= alike and len(gone) >= 0.97 * len(alike)


def test_near_components_of_one_large_group_equal_brute_force(spark):
    """A group of copies that are more or less alike: every link of 0.8 or more counts, whatever the trees leave over."""
    r = random.Random(21)
    base, texts = [f"v{r.randrange(5000)}" for _ in range(150)], []
    for i in range(300):
        words = list(base)
        for _ in range(r.randint(0, 9)):
            words[r.randrange(150)] = f"x{r.randrange(5000)}"
        texts.append((i, " ".join(words)))
    sets = [{tuple(t.split()[i : i + 5]) for i in range(146)} for _, t in texts]
    up = list(range(300))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(300):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                up[b] = a
    want = {i: root(i) for i in range(300)}
    assert 20 < len(set(want.values())) < 250
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    assert {x.doc_id: x.component_id for x in simhash.near_components(df).collect()} == want
    assert {x.doc_id: x.component_id for x in simhash.near_components(df, max_shard=40).collect()} == want


def test_only_rows_near_a_large_group_wait(spark):
    """Rows that share a tree with a large group, but no likeness, aren't compared by their rarest shingles."""
    r, texts = random.Random(31), []
    base = [f"v{r.randrange(5000)}" for _ in range(150)]
    for i in range(20):
        words = list(base)
        words[r.randrange(150)] = f"x{i}"
        texts.append((i, " ".join(words)))
    texts += [(i, " ".join(f"v{r.randrange(5000)}" for _ in range(150))) for i in range(20, 400)]
    rows = simhash._wide(spark.createDataFrame(texts, "doc_id long, text string"), "doc_id", "text", 5)
    found = simhash.near_candidates(rows.withColumnRenamed("doc_id", "node")).where("asks is not null").collect()
    asking = {x.a for x in found if x.asks}
    assert set(range(10, 20)) <= asking <= set(range(20)) and set(range(20)) <= {x.a for x in found}
    assert len({x.a for x in found}) <= 30


# WARC


def test_warc_round_trip(spark):
    big = "<p>é" + "x" * 2000
    pages = spark.createDataFrame([(1, "http://a", big), (5, None, big), (3, "http://c\r\nX: y", big), (4, "u", None), (6, "u", ""), (7, "u", "short"), (8, "u", "short"), (None, "u", big), (9, "u", "y" * 600_000), (5, "again", big)], "page_id long, url string, html string")
    folder = scratch(spark, "t")
    index = warc.write_bundles(pages.withColumn("digest", pages.url), folder, frame_bytes=5000)
    got = sorted((tuple(r) for r in warc.read_bundles(index, folder).collect()), key=str)
    sha = lambda s: hashlib.sha1(s.encode()).hexdigest()
    n = len(big.encode())
    want = [(1, n, sha(big), "revisit", 5), (5, n, sha(big), "response", None), (5, n, sha(big), "response", None), (3, n, sha(big), "revisit", 5), (4, 0, sha(""), "response", None), (6, 0, sha(""), "response", None), (7, 5, sha("short"), "response", None), (8, 5, sha("short"), "response", None), (None, n, sha(big), "revisit", 5), (9, 600_000, sha("y" * 600_000), "response", None)]
    assert got == sorted(want, key=str)
    some = index.where("page_id in (7, 5)")
    got = sorted((tuple(r) for r in warc.read_bundles(some, folder, task_bytes=100).collect()), key=str)
    assert got == sorted((w for w in want if w[0] in (7, 5)), key=str)
    with pytest.raises(Exception, match="in the place of page 70"):
        warc.read_bundles(some.replace(7, 70), folder).collect()
    (fields, block), *rest = warc.read_record(index, folder, 9)
    assert not rest and block.endswith(b"y" * 600_000) and fields["warc-type"] == "response"
    empty = spark.createDataFrame([], pages.schema)
    folder = scratch(spark, "t")
    index = warc.write_bundles(empty, folder)
    assert index.count() == 0 and warc.read_bundles(index, folder).count() == 0


# Language model


def test_scores_and_base_equal_brute_force(spark, docs, rows):
    twice = docs.unionByName(docs.where("doc_id = 3"))
    got = hpylm.score(twice).collect()
    assert len(got) == len(rows) + 1
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    toks = lambda t: (t or "").encode().lower().split() + [b""]
    c = Counter()
    for r in [*rows, rows[3]]:
        if not held(r[0]):
            c.update(toks(r[1]))
    n, v = sum(c.values()), len(c)
    by = {r[0]: r[1] for r in rows}
    for r in got:
        w = toks(by[r.doc_id])
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(r.doc_id), len(w), sum(c[x] > 0 for x in w), n)
        assert math.isclose(r.base_score, sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w), rel_tol=1e-9)
        assert r.score < 0


def lm_totals(s, full):
    at, cols = s.shared()
    sums = np.zeros((hpylm.SAMPLES, hpylm.K2 + hpylm.K1 + 16), np.int64)
    sums[:, at] = cols
    return hpylm.Totals(full, sums)


def test_probabilities_add_up():
    rng = np.random.default_rng(0)
    hashes = np.sort(rng.integers(0, 1 << 63, 50).astype(np.uint64))
    w, x = rng.integers(0, 50, 4000), rng.choice([0, 8, 9, 800], 4000)
    code, n = np.unique(w * 4096 + x, return_counts=True)
    ctx = code & 0xFFF
    full = np.bincount(ctx, weights=n, minlength=hpylm.K2).astype(np.float32)
    s = hpylm.Seating(hashes[code >> 12], ctx, n, full, 1, 5)
    total = lm_totals(s, full)
    for ctx in (0, 9, 17):
        known = hpylm.predict(s, total, s.words, np.full(len(s.words), ctx))[1]
        unknown = hpylm.predict(s, total, np.array([1], np.uint64), np.array([ctx]))[1]
        assert math.isclose((10**known).sum() + 10 ** unknown[0], 1, rel_tol=1e-9)


def test_stirling_and_tables():
    assert math.isclose(math.exp(hpylm.stirling(0.5, 4)[3, 2]), 1.5, rel_tol=1e-9)
    rng = np.random.default_rng(1)
    c = np.array([1, 2, 10, 40, 5000])
    t = hpylm.sample_tables(c, np.full(5, 0.5), 0.5, hpylm.stirling(0.5), rng)
    assert (t >= 1).all() and (t <= c).all() and t[0] == 1


def test_table_counts_follow_all_seatings():
    """Drawn table counts against every seating of five customers, written out."""
    d, mass, weight = 0.4, 0.7, Counter()

    def seat(tables, left, w):
        if not left:
            weight[len(tables)] += w
            return
        for i, n in enumerate(tables):
            seat([*tables[:i], n + 1, *tables[i + 1 :]], left - 1, w * (n - d))
        seat([*tables, 1], left - 1, w * mass)

    seat([1], 4, mass)
    got = Counter(hpylm.sample_tables(np.full(40_000, 5), np.full(40_000, mass), d, hpylm.stirling(d), np.random.default_rng(3)).tolist())
    for t, w in weight.items():
        assert abs(got[t] / 40_000 - w / sum(weight.values())) < 0.01


def test_score_equals_plain_formula(spark):
    rng = np.random.default_rng(4)
    texts = [" ".join(f"w{int(x)}" for x in rng.zipf(1.5, 30) % 40) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = {r.doc_id: r.score for r in hpylm.score(df, seed=11).collect()}
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    name = lambda w: xxhash.xxh64_intdigest(w)
    rest = lambda w: int(hpylm.contexts([w], np.array([name(w)], np.uint64))[0])
    pairs = {i: [(name(b), rest(a)) for a, b in zip([b"", *t.encode().split()], [*t.encode().split(), b""])] for i, t in enumerate(texts)}
    train = Counter(x for i, p in pairs.items() if not held(i) for x in p)
    keys = sorted(train)
    full = np.zeros(hpylm.K2, np.float32)
    for (_, u), n in train.items():
        full[u] += n
    s = hpylm.Seating(np.array([k[0] for k in keys], np.uint64), np.array([k[1] for k in keys]), np.array([train[k] for k in keys]), full, 1, 11)
    total = lm_totals(s, full)
    d2, d1, d0 = total.discounts
    words = s.words.tolist()
    at2, at1 = ({int(k): j for j, k in enumerate(v)} for v in (s.k2, s.k1))
    for i, p in pairs.items():
        want = 0.0
        for w, u in p:
            j = words.index(w) if w in words else None
            mean = 0.0
            for t2, c1, t1, c0, t0 in s.samples:
                a = at2.get((j << 21) | u) if j is not None else None
                b = at1.get((j << 21) | u >> hpylm.SLOTS) if j is not None else None
                same1 = [k for k in range(len(s.k1)) if s.x1[k] == u >> hpylm.SLOTS]
                same2 = [k for k in range(len(s.k2)) if s.x2[k] == u]
                p0 = ((c0[j] - d0 * t0[j] if j is not None else 0) + (1 + d0 * t0.sum()) / (len(words) + 1)) / (1 + c0.sum())
                p1 = ((c1[b] - d1 * t1[b] if b is not None else 0) + (1 + d1 * sum(t1[k] for k in same1)) * p0) / (1 + sum(c1[k] for k in same1))
                p2 = ((s.c2[a] - d2 * t2[a] if a is not None else 0) + (1 + d2 * sum(t2[k] for k in same2)) * p1) / (1 + sum(s.c2[k] for k in same2))
                mean += p2 / len(s.samples)
            want += math.log10(mean)
        assert math.isclose(got[i], want, rel_tol=1e-6)


def test_scores_do_not_depend_on_partitions(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    key, out = "spark.sql.shuffle.partitions", []
    before = spark.conf.get(key)
    try:
        for n in (4, 16):
            spark.conf.set(key, n)
            out.append({r.doc_id: r.score for r in hpylm.score(d.repartition(n)).collect()})
    finally:
        spark.conf.set(key, before)
    assert all(math.isclose(v, out[1][k], rel_tol=1e-9) for k, v in out[0].items())


def test_model_beats_baseline(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    r = {x.held_out: x for x in hpylm.perplexity(hpylm.score(d)).collect()}
    assert r[True].perplexity < r[True].base_perplexity


# Audio


def test_audio_round_trip(docs, rows):
    got = {r.doc_id: r for r in audio.media_features(docs).collect()}
    for i, t, *_ in rows:
        raw = (t or "").encode()
        pad = raw + b" " * (max(192, -(-len(raw) // 192) * 192) - len(raw))
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(pad), hashlib.sha256(pad).hexdigest(), zlib.crc32(pad[-16:]))
        assert r.media_bytes == len(pad) + 44
    assert got[100].feature == got[101].feature and got[200].feature == got[201].feature


def test_resampler_and_segments():
    t = np.arange(8000) / 16000
    low, high = np.sin(2 * np.pi * 500 * t).astype(np.float32), np.sin(2 * np.pi * 7000 * t).astype(np.float32)
    assert len(audio.resample(low)) == 4000
    assert np.abs(audio.resample(low)[100:-100]).max() > 0.9 and np.abs(audio.resample(high)[100:-100]).max() < 0.1
    up = audio.resample(low, 3, 2)
    assert len(up) == 12000 and abs(np.abs(up[100:-100]).max() - 1) < 0.1
    e = np.array([-40.0] * 5 + [-10] * 5 + [-24] * 2 + [-10] * 3 + [-40] * 5)
    assert len(audio.segments(e)) == 1
    assert audio.segments(np.full(5, -3.0)) == []


def test_fixed_shape_tensors(spark, docs, rows):
    import pyarrow as pa

    folder = scratch(spark, "tensors")
    index = audio.store_tensors(audio.store_media(docs), folder)
    table = pa.concat_tables(pa.ipc.open_file(f"{folder.removeprefix('file://')}/{f}").read_all() for (f,) in index.select("file").distinct().collect())
    assert table.schema.field("mel").type.shape == [audio.PATCH, audio.MELS]
    assert all(s < e for s, e in zip(table["start_s"].to_pylist(), table["end_s"].to_pylist()))
    assert table.num_rows == sum(r.patches for r in index.collect())
    text = {r[0]: audio.padded((r[1] or "").encode()) for r in rows}
    for doc in (3, 202):
        part = table.filter(pa.compute.equal(table["doc_id"], doc)).sort_by("start_s").combine_chunks()
        mel, energy = audio.log_mel(text[doc])
        got = part["mel"].chunk(0).to_numpy_ndarray().reshape(-1, audio.MELS)
        assert np.abs(got[: len(mel)] / 4 - np.clip(mel, -32, 31.75)).max() <= 0.1251 and (got[len(mel) :] == audio.FLOOR).all()
        assert sum(part["segments"].to_pylist(), []) == [x for pair in audio.segments(energy) for x in pair]


def test_log_mel_by_definition_and_in_any_blocks():
    data = np.random.default_rng(3).integers(0, 256, 5000).astype(np.uint8).tobytes()
    x = (np.frombuffer(data, np.uint8) - 128.0) / 128
    h = np.zeros(32)
    h[:] = audio.phases(audio.UP, audio.DOWN)[0]
    slow = np.array([sum(h[k] * x[2 * i - k] for k in range(32) if 2 * i - k >= 0) for i in range(2500)])
    whole = audio.log_mel(data)
    for f in (0, 1, 7, len(whole[0]) - 1):
        frame = slow[f * audio.HOP : f * audio.HOP + audio.FRAME]
        power = np.array([abs(sum(frame * np.hanning(audio.FRAME + 1)[:-1] * np.exp(-2j * np.pi * b * np.arange(audio.FRAME) / audio.FRAME))) ** 2 for b in range(audio.FRAME // 2 + 1)])
        assert np.allclose(np.log(power @ audio.mel_bank() + 1e-6), whole[0][f], atol=2e-3)
        assert math.isclose(10 * math.log10((frame**2).mean() + 1e-10), whole[1][f], abs_tol=1e-3)
    for block in (256, 1024, 4096):
        part = audio.log_mel(data, block)
        assert all(a.shape == b.shape and np.allclose(a, b, atol=1e-4) for a, b in zip(whole, part))


# Packing and BPE


@pytest.fixture(scope="module")
def library():
    tokenizers = pytest.importorskip("tokenizers")
    return tokenizers.Tokenizer.from_file(bpe.default_vocabulary())


ODD = ["Σας ΟΔΟΣ İ", "<|endoftext|>a<|startoftext|>", "a\x1cb\x85c", "ﬁ½²³ Ⅷ 日本語", "x" * 3000, "'S 'LL it's", "​q", "<|", "🎉🎉 ok👍🏽", "é é", "中" * 300]


def test_words_of_any_code_points_equal_the_library(library):
    r = random.Random(5)
    code = lambda: r.choice([r.randrange(0x300), r.randrange(0x3000), r.randrange(0xD800), r.randrange(0xE000, 0x110000)])
    texts = ["".join(chr(code()) for _ in range(r.randrange(1, 60))) for _ in range(3000)]
    for text, ids in zip(texts, bpe.Encoder(bpe.vocabulary(bpe.default_vocabulary()), lambda ids: ids).texts(texts)):
        assert [i for w in ids for i in w] == library.encode(text, add_special_tokens=False).ids, ascii(text)


def test_encoding_equals_the_library(spark, docs, rows, library):
    more = spark.createDataFrame([(1000 + i, t) for i, t in enumerate(ODD)], "doc_id long, text string")
    both = docs.select("doc_id", "text").unionByName(more)
    texts = {r[0]: r[1] or "" for r in rows} | {1000 + i: t for i, t in enumerate(ODD)}
    for words in (0, 50):
        for r in bpe.encode_decode(both, lexicon_words=words).collect():
            ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
            assert r.n_tokens == len(ids), texts[r.doc_id][:40]
            assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
            assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_lexicon_shares_suffixes():
    v = bpe.vocabulary(bpe.default_vocabulary())
    words = [a + b for a in ("walk", "talk", "balk") for b in ("ing", "ed", "s")] + ["é", "walk"]
    lex = bpe.Lexicon(bpe.Lexicon.compile(dict(zip(words, v.merge_many(words)))))
    assert len(lex.keys) < sum(map(len, words)) // 2
    assert lex.find(words) == v.merge_many(words)
    assert lex.find(["wal", "walkin", "", "x" * 100, "walkings"]) == [None] * 5
    assert bpe.Lexicon(bpe.Lexicon.compile({})).find(["a"]) == [None]


def test_packing(spark, docs, rows, library):
    twice = docs.unionByName(docs.where("doc_id = 202"))
    assert packing.best_fit_packing(docs).count() > 0
    got = packing.best_fit_packing(twice, capacity=256).collect()
    want = Counter()
    for i, t, *_ in [*rows, next(r for r in rows if r[0] == 202)]:
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        for k, s in enumerate(range(0, len(ids), 256)):
            want[i, k, s, len(ids[s : s + 256]), zlib.crc32(ids[s : s + 256].tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    seqs = defaultdict(list)
    for r in got:
        seqs[r.sequence_id].append((r.offset, r.length))
    for parts in seqs.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 256
    assert len(seqs) <= math.ceil(sum(r.length for r in got) / 256) * 1.05 + 1


@pytest.mark.parametrize("seed", range(4))
def test_plan_is_valid_and_tight(seed):
    r = random.Random(seed)
    hist = Counter(min(2048, max(1, int(r.lognormvariate(6, 1)))) for _ in range(4000))
    rows, n = packing.plan(dict(hist))
    fill, ranks = defaultdict(list), defaultdict(list)
    for x, first, k, seq, off in rows:
        ranks[x].append((first, k))
        for j in range(k):
            fill[seq + j].append((off, x))
    for x, c in hist.items():
        at = 0
        for f, k in sorted(ranks[x]):
            assert f == at
            at += k
        assert at == c
    for parts in fill.values():
        at = 0
        for o, x in sorted(parts):
            assert o == at
            at += x
        assert at <= 2048
    assert n == len(fill) <= math.ceil(sum(x * c for x, c in hist.items()) / 2048) * 1.005 + 2
    assert packing.plan({}) == ([], 0)


def test_configurations_place_most_large_pieces(monkeypatch):
    r = random.Random(8)
    hist = dict(Counter(min(2048, max(1, int(r.lognormvariate(6.3, 0.9)))) for _ in range(6000)))
    told: dict = {}
    rows, n = packing.plan(hist, count=told)
    assert told["grouped"] >= 0.7 * told["large"] and told["grouped"] >= 2 * told["sequences"]
    together = lambda rows: {(seq, off): x for x, _, k, seq, off in rows}
    monkeypatch.setattr(packing, "configurations", lambda *a: [])
    alone, least = packing.plan(hist)
    assert together(alone) != together(rows) and n <= 1.002 * least


def test_configurations_are_optimal():
    from itertools import product

    sizes, demand, capacity = [60, 45, 33], [40, 60, 90], 100
    got = packing.configurations(sizes, demand, capacity)
    for g in range(3):
        assert math.isclose(sum(p[g] * k for p, k in got), demand[g], abs_tol=1e-6)
    every = [p for p in product(range(4), repeat=3) if 0 < sum(a * b for a, b in zip(p, sizes)) <= capacity]
    prices = np.linalg.solve(np.array([p for p, _ in got], float), np.ones(3))  # no configuration is worth more than a sequence
    assert all(np.dot(p, prices) <= 1 + 1e-6 for p in every)
    with pytest.warns(UserWarning, match="may not be optimal"):
        packing.configurations(sizes, demand, capacity, rounds=1)


# Quality


def slow_base(text):
    words = [w for w in __import__("re").split("[\x20\x09-\x0d]+", text or "") if w]
    win = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    c = Counter(win)
    hit = {i + k for i, w in enumerate(win) if c[w] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if line.strip(" \t\n\v\f\r"):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum((text or "").count(x) for x in "#*$%&|<>"), dup, len(hit)


def test_quality_base_counts(docs, rows):
    extra = ["a b c a b c", "x\nx\nx\n\n\n", "## | <a>\n## | <a>", "one two three " * 40]
    for t in extra + [r[1] for r in rows]:
        assert quality.base_counts(t or "") == slow_base(t)
    got = {r.doc_id: r for r in quality.quality(docs).collect()}
    for i, t, *_ in rows:
        n, *_, rep = slow_base(t)
        assert got[i].base_failed == (n < 50 or 100 * rep > 50 * n)
        assert not (got[i].base_failed and got[i].kept)


def slow_kneser_ney(texts):
    """Modified Kneser-Ney of order 4 by its definition: a function of a context (3 symbols) and a symbol."""
    counts = [Counter() for _ in range(5)]
    for t in texts:
        padded = "   " + "".join(" " if c in "\t\n\v\f\r" else "0" if c in "0123456789" else c for c in t) + " "
        counts[4].update(padded[i : i + 4] for i in range(len(padded) - 3))
    for k in (3, 2, 1):
        counts[k].update(g[1:] for g in counts[k + 1])
    disc, total = {}, {}
    for k in range(1, 5):
        n = Counter(counts[k].values())
        y = n[1] / (n[1] + 2 * n[2]) if n[1] + n[2] else 0.5
        raw = [1 - 2 * y * n[2] / n[1] if n[1] else 0.5, 2 - 3 * y * n[3] / n[2] if n[2] else 1.0, 3 - 4 * y * n[4] / n[3] if n[3] else 1.5]
        disc[k] = [min(max(v, 0.01), i - 0.01) for i, v in enumerate(raw, 1)]
        for g, c in counts[k].items():
            total.setdefault(g[:-1], []).append(c)

    def p(g):
        k = len(g)
        if not k:
            return 1 / 65536
        all_ = total.get(g[:-1])
        if not all_:
            return p(g[1:])
        off = lambda c: disc[k][min(c, 3) - 1]
        c = counts[k][g]
        return ((c - off(c)) if c else 0) / sum(all_) + sum(map(off, all_)) / sum(all_) * p(g[1:])

    return p


def coded(grams):
    return np.array([sum(ord(c) << 16 * (3 - i) for i, c in enumerate(g)) for g in grams], np.uint64)


def test_kneser_ney_equals_its_definition(spark):
    texts = random_texts(40, 9) + ["数字 42\tund", "早上好" * 5]
    df = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string").repartition(3)
    rows = quality._rows(df, "doc_id", "text", "lang").withColumn("own", F.lit(7).cast("long"))
    model, small = quality.models(rows, core=1.0)[7], quality.models(rows, 300, core=1.0)[7]
    p = slow_kneser_ney(texts)
    grams = ["the ", "   t", "eri ", "zzzz", "qthe", "好早上好", " 0  ", "数字 0", "éñ漢☃"]
    assert np.allclose(model.log10(coded(grams)), [math.log10(p(g)) for g in grams], atol=1e-5)
    every = np.arange(65536, dtype=np.uint64)
    for m in (model, small):  # what the least counts leave out goes to the lower orders
        for ctx in ("the", "   ", "zzz", "上好早"):
            assert math.isclose((10 ** m.log10(coded(["\0" + ctx])[0] << np.uint64(16) | every)).sum(), 1, rel_tol=1e-4)
    assert sum(len(h) for h, _ in small.grams) <= 300 < sum(len(h) for h, _ in model.grams)


def test_unlike_texts_of_any_script_differ(spark):
    r = random.Random(6)
    zh = ["".join(r.choices("的一是不了人我在有他这为之大来以个中上们", k=80)) for _ in range(40)] + ["".join(chr(r.randrange(0x4E00, 0x9FFF)) for _ in range(80)) for _ in range(2)]
    ru = [" ".join("".join(r.choices("оеаинтсрвл", k=r.randint(2, 7))) for _ in range(60)) for _ in range(40)] + ["ъ" * 200, " ".join(["ыъщ"] * 60)]
    df = spark.createDataFrame([(i, t, k) for k, ts in (("zh", zh), ("ru", ru)) for i, t in enumerate(ts, 100 * (k == "ru"))], "doc_id long, text string, lang string")
    got = {x.doc_id: x.log10_p for x in quality.scored(df).collect()}
    assert len({round(v, 9) for v in got.values()}) == len(got)
    assert max(got[40], got[41]) < min(got[i] for i in range(40)) and got[140] < got[100] and got[141] < got[100]


def test_junk_is_rejected(spark):
    texts = random_texts(300, 5)
    clean = [(i, (t + ". ") * 2 if len(t.split()) < 50 else t, "en") for i, t in enumerate(texts)]
    r = random.Random(0)
    junk = [" ".join(f"#{i}*$%&|" for i in range(100)), " ".join("".join(r.choices("qxzjkvw", k=9)) for _ in range(100))]
    junk += [" | ".join(t.split()[:80]) for t in texts if len(t.split()) > 60][:8] + [" ".join(w + r.choice("#$%&*") * 3 for w in t.split()) for t in texts if len(t.split()) > 60][:8]
    rows = clean + [(900 + i, t, "en") for i, t in enumerate(junk)]
    got = {x.doc_id: x for x in quality.quality(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert not any(x.kept for i, x in got.items() if i >= 900)
    good = [x for i, x in got.items() if i < 900 and not x.base_failed]
    assert sum(x.kept for x in good) >= 0.97 * len(good)


def test_thresholds_are_exact_quantiles_of_all_rows(spark):
    """Shares that bound who teaches, and medians of bands, are those of all rows, however these are dealt."""
    r = random.Random(8)
    texts = [(g, "a" * r.randint(50, 5000) + "#" * r.randint(0, 2000)) for g in (1, 2) for _ in range(6000)]
    df = spark.createDataFrame(texts, "own long, t string")
    want = {}
    for g in (1, 2):
        share = sorted(quality.odd_share(t) for h, t in texts if h == g)
        want[g] = share[math.ceil(0.75 * len(share)) - 1]
    assert quality.plainest(df.repartition(1)) == want == quality.plainest(df.repartition(9))
    fits = [(lang, r.gauss(-1, 0.1), r.randint(100, 9000)) for lang in ("en", None) for _ in range(6001)]
    good = spark.createDataFrame(fits, "lang string, log10_p double, symbols long").repartition(5)
    for lang, mid in ((x.l, x.mid) for x in quality.bands(good, prior=0).collect()):
        assert math.isclose(mid, sorted(p for h, p, _ in fits if h == lang)[3000], rel_tol=1e-12)
    assert quality.exact_quantile(good, [], "log10_p").first()[0] == sorted(p for _, p, _ in fits)[6000]


def test_bands_on_disjoint_halves_and_small_languages(spark):
    """Bands of one half of the labelled rows hold for the other; a language of few rows gets nearly the band of all."""
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = quality.scored(d).withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))).where("not base_failed")
    own = quality.bands(rows.where("key % 2 = 0"))
    other = rows.where("key % 2 <> 0").join(own, F.col("lang") == F.col("l")).join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id")
    kept = F.abs(F.col("log10_p") - F.col("mid")) <= quality.WIDTH * F.sqrt(F.col("a") + F.col("b") / F.col("symbols"))
    share = {r.quality: r.kept for r in other.groupBy("quality").agg(F.avg(kept.cast("double")).alias("kept")).collect()}
    assert share[1] >= 0.97 and share[0] <= 0.1
    few = {r.l: r for r in quality.bands(rows.withColumn("lang", F.when(F.col("doc_id") % 200 == 1, "xx").otherwise(F.col("lang")))).collect()}
    most = quality.bands(rows.withColumn("lang", F.lit("all"))).first()
    assert abs(few["xx"].mid - most.mid) < 0.05


# Chat


def test_escape_is_reversible():
    r = random.Random(2)
    parts = chat.CONTROL + ["\\", "<", "[", "\n", "x", "n", "|>", "/INST]", "im_end"]
    for _ in range(3000):
        turns = [("".join(r.choices(parts, k=r.randint(0, 6))), "".join(r.choices(parts, k=r.randint(0, 8)))) for _ in range(3)]
        text = chat.format_turns(turns)
        assert chat.read_turns(text) == turns
        assert not any(c in chat.escape(turns[0][1]) for c in chat.CONTROL)


def test_reply_trees(spark):
    rows = [(1, 10, None, "user", "q", 0.0), (1, 11, 10, "assistant", "a1", 1.0), (1, 12, 10, "assistant", "a2", 5.0), (1, 13, 12, "user", None, 0.0), (1, 14, 11, None, "deep", 9.0), (2, 1, 99, "user", "orphan", None), (3, 1, 2, "u", "x", 0.0), (3, 2, 1, "u", "y", 0.0), (None, 1, None, "user", "no id", 0.0), (1, 10, None, "user", "q", 0.0)]
    df = spark.createDataFrame(rows, "conv_id long, node long, parent long, role string, text string, score double")
    got = {(r.conv_id, r.branch): chat.read_turns(r.formatted) for r in chat.formatted_paths(df, top=2).collect()}
    assert got == {(1, 1): [("user", "q"), ("assistant", "a1"), ("", "deep")], (1, 2): [("user", "q"), ("assistant", "a2"), ("user", "")], (2, 1): [("user", "orphan")], (None, 1): [("user", "no id")]}
    chain = spark.createDataFrame([(7, i, i - 1 if i else None, "user", str(i), 0.0) for i in range(70)], df.schema)
    assert [t for _, t in chat.read_turns(chat.formatted_paths(chain).first().formatted)] == [str(i) for i in range(70)]
    assert chat.formatted_paths(spark.createDataFrame([], df.schema)).count() == 0


def test_linear_conversations(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "</s>ok"), (1, 1, "assistant", "</s>ok"), (2, 5, "assistant", None), (3, None, "user", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.read_back(chat.formatted_paths(chat.linear(df))).collect()}
    assert got[1].n_turns == 3 and got[1].loss_sha256 == hashlib.sha256(b"</s>ok</s>ok").hexdigest() and got[2].loss_chars == 0 and got[3].n_turns == 1


# Substring


def test_chunks_resist_insertions():
    text = " ".join(random_texts(30, 11)).encode()
    a, b = (list(substring.chunk_ends([t]))[0] for t in (text, b"inserted words " + text))
    cut = lambda t, ends: {t[s:e] for s, e in zip([0, *ends], ends)}
    x, y = cut(text, a), cut(b"inserted words " + text, b)
    assert len(x - y) <= 2 and max(map(len, x)) <= substring.MAX
    both = list(substring.chunk_ends([b"zzz " * 50, text, b"", text], block=100))
    assert both[1] == both[3] == a and both[2] == []


def slow_ends(raw):
    """Chunk ends by a rolling hash, byte by byte."""
    gear = [int(x) for x in substring.GEAR]
    spaces = b" \t\n\v\f\r"
    ends, last, h = [], 0, 0
    padded = bytes(substring.WINDOW) + raw
    for i in range(1, len(raw) + 1):
        window = padded[i : i + substring.WINDOW]
        h = sum(gear[c] << (substring.WINDOW - 1 - k) for k, c in enumerate(window)) & 0xFFFFFFFF
        lone = not any(c in spaces for c in window) and (i == len(raw) or raw[i] & 0xC0 != 0x80)
        if raw[i - 1] in spaces and h >> 29 == 0 or lone and h >> 27 == 0:
            if i - last >= substring.MIN:
                while i - last > substring.MAX:
                    cut = last + substring.MAX
                    while raw[cut] & 0xC0 == 0x80:
                        cut -= 1
                    ends.append(cut)
                    last = cut
                ends.append(i)
                last = i
    while len(raw) - last > substring.MAX:
        cut = last + substring.MAX
        while raw[cut] & 0xC0 == 0x80:
            cut -= 1
        ends.append(cut)
        last = cut
    return ends + [len(raw)] * (len(raw) > last)


def test_chunk_ends_equal_brute_force():
    r = random.Random(12)
    texts = [t.encode() for t in random_texts(6, 13)] + ["".join(chr(r.randrange(0x4E00, 0x9FFF)) for _ in range(900)).encode(), ("é" * 2000).encode(), b"", b"x", "".join(r.choices("abc/", k=800)).encode()]
    for t, ends in zip(texts, substring.chunk_ends(texts)):
        assert ends == slow_ends(t)
    assert np.array_equal(substring.proposed(np.frombuffer(texts[6], np.uint8), 100), substring.proposed(np.frombuffer(texts[6], np.uint8)))


def test_chunks_resist_insertions_without_white_space():
    r = random.Random(14)
    text = "".join(chr(r.randrange(0x4E00, 0x9FFF)) for _ in range(4000))
    a, b = (list(substring.chunk_ends([t.encode()]))[0] for t in (text, "新" + text))
    cut = lambda t, ends: {t[s:e] for s, e in zip([0, *ends], ends)}
    x, y = cut(text.encode(), a), cut(("新" + text).encode(), b)
    assert len(x) > 40 and len(x - y) <= 2


def slow_substring(rows, min_run):
    """Chunks, first occurrences, runs and their growth over whole texts, by plain loops."""
    first, chunks, texts = {}, [], {i: (t or "").encode() for i, t in rows}
    for i, raw in texts.items():
        at = 0
        for e in slow_ends(raw):
            chunks.append((i, at, e, raw[at:e]))
            at = e
    for i, s, e, c in sorted(chunks):
        first.setdefault(c, (i, s))
    spaces, out = b" \t\n\v\f\r", {}

    def within(raw, at):
        if not 0 < at < len(raw):
            return False
        if raw[at] & 0xC0 == 0x80:
            return True
        a, b = raw[:at].decode()[-1], raw[at:].decode()[0]
        return a.isalnum() and b.isalnum() and max(a, b) < "\u2e80"

    for i, t in rows:
        raw, mine = texts[i], []
        for j, s, e, c in sorted(x for x in chunks if x[0] == i):
            f, at = first[c]
            if (f, at) != (i, s):
                if mine and mine[-1][1] == s and mine[-1][2] == f and mine[-1][3] + e - mine[-1][0] == at + e - s:
                    mine[-1][1] = e
                else:
                    mine.append([s, e, f, at])
        spans = []
        for k, (s, e, f, at) in enumerate(mine):
            low, high = mine[k - 1][1] if k else 0, mine[k + 1][0] if k + 1 < len(mine) else len(raw)
            a, b, src, back = s, e, texts[f], at + e - s
            while a > low and at and src[at - 1] == raw[a - 1]:
                a, at = a - 1, at - 1
            while b < high and back < len(src) and src[back] == raw[b]:
                b, back = b + 1, back + 1
            while a < s and (within(raw, a) or raw[a] in spaces):
                a += 1
            while b > e and within(raw, b):
                b -= 1
            spans.append([a, b])
        joined = []
        for a, b in spans:
            if joined and a <= joined[-1][1]:
                joined[-1][1] = max(b, joined[-1][1])
            else:
                joined.append([a, b])
        keep, at = b"", 0
        for a, b in joined:
            if b - a >= min_run:
                keep, at = keep + raw[at:a], b
        out[i] = None if t is None else (keep + raw[at:]).decode()
    return out


@pytest.mark.parametrize("hot", [1, 10_000])
def test_substring_equals_brute_force(spark, docs, rows, hot, monkeypatch):
    monkeypatch.setattr(substring, "HOT", hot)
    passage = " ".join(random_texts(1, 77)[0].split()[:80] + [f"p{i}" for i in range(60)])
    new = [(300 + i, f"{a} {passage} {a[::-1]}", "en", "s", 1) for i, a in enumerate(random_texts(6, 78))] + [(310, "é" * 2000, "fr", "s", 1), (311, "é" * 2000, "fr", "s", 1)]
    new += [(320 + i, f"{a}{'新的中文段落没有空格但是很长' * 12}{a}", "zh", "s", 1) for i, a in enumerate(("天地", "玄黄宇宙"))]
    all_rows = [r for r in rows if r[0] is not None] + new
    df = spark.createDataFrame(all_rows + [new[0]], SCHEMA)
    got = substring.substring_dedup(df).collect()
    want = slow_substring([(r[0], r[1]) for r in all_rows], substring.MIN_RUN)
    assert len(got) == len(all_rows) + 1
    for r in got:
        assert r.text == want[r.doc_id]
        assert r.n_chars == (None if r.text is None else len(r.text))
    assert sum(passage in r.text for r in got if r.doc_id and 300 <= r.doc_id < 310 and r.text) <= 2
    for r in got:
        if r.doc_id is not None and r.doc_id < 60:
            assert r.text == rows[r.doc_id][1]


def test_shared_passages_are_cut_to_their_ends(spark):
    r, rows, planted = random.Random(9), [], []
    for i in range(120):
        words = lambda n: " ".join("".join(r.choices("abcdefghijklmnoéü", k=r.randint(2, 9))) for _ in range(n))
        passage, ends = words(50), [(words(30), words(30)), (words(40), words(20))]
        rows += [(2 * i + k, f"{a} {passage} {b}") for k, (a, b) in enumerate(ends)]
        planted.append((passage, f"{ends[1][0]} {ends[1][1]}"))
    got = dict(tuple(x) for x in substring.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert all(got[2 * i] == rows[2 * i][1] for i in range(120))
    assert sum(got[2 * i + 1] == rest for i, (_, rest) in enumerate(planted)) >= 118


# Language ID


def test_language_id(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    odd = spark.createDataFrame([(-1, None, "en", "s", 0), (-2, "123 ...", "en", "s", 0), (-3, "", None, None, None)], SCHEMA)
    got = langid.identify(d.unionByName(odd).withColumn("score", d.doc_id)).collect()
    truth = {r.doc_id: r.lang for r in d.select("doc_id", "lang").collect()}
    out = [r for r in got if r.held_out and r.doc_id in truth]
    assert sum(r.lang_pred == truth[r.doc_id] for r in out) >= 0.97 * len(out)
    assert {r.doc_id: (r.lang_pred, r.score) for r in got if r.doc_id < 0} == {-1: ("und", 0.0), -2: ("und", 0.0), -3: ("und", 0.0)}
    assert all(0 <= r.score <= 1 for r in got)
    kept = langid.filter_language(d.unionByName(odd).withColumn("__vs_x", d.doc_id))
    assert kept.columns == [*d.columns, "__vs_x"] and kept.where("doc_id < 0").count() == 0


def test_texts_of_no_learned_language_are_dropped(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    r = random.Random(4)
    noise = [" ".join("".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=r.randint(2, 9))) for _ in range(n)) for n in (20, 100, 500)]
    others = [
        "Wczoraj wieczorem poszedłem z przyjaciółmi do kina, żeby zobaczyć nowy film, który wszyscy chwalili, ale nam się nie podobał.",
        "Eilen illalla menin ystävien kanssa elokuviin katsomaan uutta elokuvaa, jota kaikki kehuivat, mutta emme pitäneet siitä lainkaan.",
        "Вчера вечером я пошёл с друзьями в кино, чтобы посмотреть новый фильм, который все хвалили.",
        "昨天晚上我和朋友们去电影院看了一部大家都称赞的新电影，但是我们不喜欢。",
    ]
    more = spark.createDataFrame([(10_000_000 + 4 * i, t, None) for i, t in enumerate(noise + others)], docs.schema)
    kept = [x.doc_id for x in langid.filter_language(docs.unionByName(more)).select("doc_id").collect()]
    assert not [i for i in kept if i >= 10_000_000]
    assert len(kept) >= 0.97 * docs.count()


def test_training_rows_do_not_depend_on_partitions_or_repeats(spark):
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    few = langid.train(d.repartition(1), ~langid.held_out(), per_language=11, max_rows=40)
    many = langid.train(d.unionByName(d).repartition(17), ~langid.held_out(), per_language=11, max_rows=40)  # each row twice
    assert (few.top == many.top).all() and all((w == many.pairs[k]).all() for k, w in few.pairs.items())


def test_columns_named_like_its_own(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    odd = d.unionByName(d.limit(1).withColumn("doc_id", F.lit(None).cast("long")))
    for name in ("id", "h", "n", "k", "t", "x", "__vs_found_"):
        odd = odd.withColumn(name, F.col("source"))
    assert langid.filter_language(odd).columns == odd.columns and langid.identify(odd).count() == d.count() + 1


def test_unlabelled_rows_are_undetermined(spark):
    df = spark.createDataFrame([(1, "some text", None), (2, "more", None)], "doc_id long, text string, lang string")
    assert {r.lang_pred for r in langid.identify(df).collect()} == {"und"}


# Empty tables


def test_empty_tables(none):
    assert simhash.simhash_components(none).count() == 0
    assert simhash.near_dedup(none).count() == 0
    assert hpylm.score(none).count() == 0
    assert audio.media_features(none).count() == 0
    assert packing.best_fit_packing(none).count() == 0
    assert quality.quality(none).count() == 0
    assert substring.substring_dedup(none).count() == 0
    assert bpe.encode_decode(none).count() == 0
    assert langid.identify(none).count() == 0


def test_pipeline(spark, docs):
    pipeline = pytest.importorskip("corpus_pipeline")
    from vecspark.llm._common import written

    names = [n for n, _ in pipeline.STAGES]
    assert len(names) == 5
    now = spark.read.parquet(f"{SF}/documents.parquet")
    columns = now.columns
    for name, stage in pipeline.STAGES:
        now = written(stage(spark, now, SF), name)
        if name != names[-1]:
            assert now.columns == columns
    whole = pipeline.run(spark, SF)
    assert sorted(map(tuple, whole.select("doc_id", "piece", "ids_crc32").collect())) == sorted(map(tuple, now.select("doc_id", "piece", "ids_crc32").collect()))
    odd = docs
    for name, stage in pipeline.STAGES:
        odd = written(stage(spark, odd, SF), name)
    assert odd.count() > 0
    empty = spark.createDataFrame([], SCHEMA)
    for name, stage in pipeline.STAGES:
        empty = written(stage(spark, empty, SF), name)
    assert empty.count() == 0


def test_pipeline_stages_hand_back_what_the_driver_freed(spark, monkeypatch):
    """Memory freed outside of the driver's heap stayed with the C library's threads, more with each stage."""
    import re

    pipeline = pytest.importorskip("corpus_pipeline")
    pid = spark._jvm.java.lang.ProcessHandle.current().pid()

    def held():
        with open(f"/proc/{pid}/smaps_rollup") as f:
            return int(re.search(r"\nRss:\s+(\d+)", f.read())[1]) / 1024

    for name in ("filter_language", "filter_quality", "near_dedup", "substring_dedup", "best_fit_packing"):
        monkeypatch.setattr(pipeline, name, lambda docs: docs)
    for _, stage in pipeline.STAGES:
        native = [spark._jvm.java.util.zip.Deflater() for _ in range(500)]
        for i, x in enumerate(native):
            if i % 10:
                x.end()
        before = held()
        stage(spark, None, SF)
        assert held() < before - 25
