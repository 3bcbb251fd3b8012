"""The retrieval library's operators against brute force and their stated behaviour."""

import numpy as np
import pytest

from vecspark.functions.embed import HashedEmbedder, get_embedder
from vecspark.functions.text import check_window, packed_chunks
from vecspark.functions.vectors import levels, metric_name
from vecspark.operators import ann
from vecspark.operators.corpus import Corpus, CorruptSnapshot, DocumentNotFound, ReadOnly, dense_ids
from vecspark.operators.knn import knn, require_valid
from vecspark.operators.retrieval import ask
from vecspark.sources.storage import Files, scratch
from vecspark.sources.text_files import generated_vectors

SCHEMA = "vec_id long, embedding array<float>"
NOTES = [
    ("Graph index", "A layered proximity graph links every vector to near ones.\n\nSearch walks down the layers greedily."),
    ("Linear scan", "The linear scan compares a query with every vector and is always exact."),
    ("Vectors of text", "Hashing tokens into signed buckets gives text a vector without any model."),
]


def slow_knn(x, q, k, metric):
    d = np.sqrt(((x - q) ** 2).sum(1)) if metric == "l2" else np.array([1.0 if not (r @ r and q @ q) else 1 - r @ q / np.sqrt((r @ r) * (q @ q)) for r in x])
    return sorted(zip(d.round(9).tolist(), range(len(x))))[:k]


@pytest.mark.parametrize("metric", ["l2", "cosine"])
def test_knn_equals_brute_force(spark, metric):
    x = np.random.default_rng(0).integers(-2, 3, (300, 4)).astype(float)  # many ties, some zero vectors
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], SCHEMA).repartition(3)
    q = df.where("vec_id < 9").withColumnRenamed("vec_id", "qid")
    got = {}
    for r in knn(df, q, 7, metric, block=4).collect():
        got.setdefault(r.qid, []).append((r.rank, round(r.distance, 9), r.vec_id))
    for i in range(9):
        want = slow_knn(x, x[i], 7, metric)
        assert [d for _, d, _ in sorted(got[i])] == pytest.approx([d for d, _ in want], abs=1e-9) and [j for *_, j in sorted(got[i])] == [j for _, j in want]
    assert knn(df, q, 0).count() == 0 and knn(df.limit(0), q, 3).count() == 0 and knn(df, q.limit(0), 3).count() == 0


@pytest.mark.parametrize("metric", ["l2", "cosine"])
@pytest.mark.parametrize("block", [None, 2])
def test_equal_vectors_come_by_id(spark, metric, block):
    """Every third row is the same vector: whatever the partitions, its copies come in the order of their ids."""
    r = np.random.default_rng(5)
    same = r.standard_normal(48)
    rows = [(i, (same if i % 3 == 0 else r.standard_normal(48)).astype(np.float32).tolist()) for i in range(3000)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(7)
    q = df.where("vec_id in (0, 9, 30)").withColumnRenamed("vec_id", "qid")
    for x in (0, 9, 30):
        got = [h.vec_id for h in sorted(knn(df, q, 10, metric, block=block).where(f"qid = {x}").collect(), key=lambda h: h["rank"])]
        assert got == list(range(0, 30, 3))


@pytest.mark.parametrize("metric", ["euclidean", "cosine"])
@pytest.mark.parametrize("ties", [False, True])
def test_nearest_in_bounded_memory(metric, ties):
    """Neither many queries nor many equal vectors take memory by their number; hits are those of brute force."""
    import tracemalloc

    from vecspark.operators.knn import Best

    r = np.random.default_rng(3)
    x, n = r.standard_normal((3000, 64)), 800 if ties else 12_000
    if ties:
        x[::3] = x[0]
    q, ids = (x[:1].repeat(n, 0) if ties else r.standard_normal((n, 64))), r.permutation(3000) * 7
    tracemalloc.start()
    held = Best(n, 5)
    for s in (0, 2900):
        held.look(q, x[s : s + 2900], ids[s : s + 2900], metric)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 150e6
    got = held.batch(np.arange(n)).to_pydict()
    for one in (0, 1, n - 1):
        d = np.sqrt(((x - q[one]) ** 2).sum(1)) if metric == "euclidean" else 1 - x @ q[one] / np.sqrt((x * x).sum(1) * (q[one] @ q[one]))
        want = [i for _, i in sorted(zip(d.round(9).tolist(), ids.tolist()))[:5]]
        assert [i for a, i in zip(got["qid"], got["vec_id"]) if a == one] == want


def test_commit_is_atomic(spark):
    """Whatever a writer that breaks off leaves, a reader finds the last whole version, and the next write goes on."""
    path = scratch(spark, "corpus")
    docs = lambda *t: spark.createDataFrame([(x, "some text of " + x) for x in t], "title string, text string")
    Corpus(spark, path, HashedEmbedder(16)).add(docs("one"))
    steps, real = [], Files.put

    class Crash(Exception):
        pass

    for stop in range(6):
        c = Corpus(spark, path, HashedEmbedder(16))
        calls = 0

        def step(*a, name="", f=None):
            nonlocal calls
            calls += 1
            if calls > stop:
                raise Crash(name)
            return f(*a)

        commit, fresh = c.versions.commit, c.versions.fresh
        c.versions.commit = lambda s: step(s, name="commit", f=commit)
        c.versions.fresh = lambda v: step(v, name="fresh", f=fresh)
        before = c.state["version"]
        try:
            c.add(docs(f"try {stop}"))
            assert c.state["version"] == before + 1
        except Crash as e:
            steps.append(str(e))
            again = Corpus(spark, path, HashedEmbedder(16))
            assert again.state["version"] == before and again.documents().count() == len(again.documents().collect())
    assert steps == ["fresh", "commit"] and Files.put is real
    c = Corpus(spark, path, HashedEmbedder(16))
    titles = {r.title for r in c.documents().collect()}
    assert "one" in titles and "try 0" not in titles and "try 2" in titles
    files = Files(spark)
    files.put(f"{path}/v=99/other.json", "no manifest here")
    assert Corpus(spark, path, HashedEmbedder(16)).state["version"] == c.state["version"]
    files.put(f"{path}/f.txt", "a")
    files.put(f"{path}/f.txt", "b")
    assert files.read(f"{path}/f.txt") == "b"
    stale = Corpus(spark, path, HashedEmbedder(16))
    c.add(docs("faster"))
    with pytest.raises(FileExistsError):
        stale.add(docs("slower"))


def test_limits_and_settings(spark, corpus):
    from vecspark.operators.corpus import Invalid
    from vecspark.settings import Settings, TooLarge, guarded

    before = corpus.state
    for title, text in (("\t\n", "text"), ("x" * 201, "text"), ("title", " \n"), (None, "text"), ("title", None)):
        with pytest.raises(Invalid):
            corpus.add(spark.createDataFrame([("fine", "fine"), (title, text)], "title string, text string"))
    assert corpus.state == before
    q = lambda t: spark.createDataFrame([(1, t)], "qid long, question string")
    for bad, k, ef in ((" ", 5, None), ("x" * 2001, 5, None), ("ok", 0, None), ("ok", 51, None), ("ok", 5, 0), ("ok", 5, 2001)):
        with pytest.raises(Invalid):
            corpus.ask(q(bad), k, ef)
    small = Corpus(spark, corpus.path, HashedEmbedder(128), settings=Settings(uploads=False, max_question=5, floor=2.0))
    with pytest.raises(ReadOnly):
        small.add(spark.createDataFrame([("a", "b")], "title string, text string"))
    with pytest.raises(Invalid):
        small.ask(q("too long"))
    assert small.ask(q("scan")).first().sources is None and small.stats().first().limits.question == 5
    assert guarded([b"ab", b"c"], 3) == b"abc"
    for parts, declared in (([b"x" * 9], None), ([], 9)):
        with pytest.raises(TooLarge):
            guarded(parts, declared, Settings(max_body=8))


def test_document_validation_equals_sql(spark, tmp_path):
    """Whatever the texts are: blank, missing, longer than a document may be."""
    import duckdb

    from vecspark.functions.text import document_problems
    from vecspark.plans import queries

    texts = ["fine", " \n", None, "x" * 1_000_001]
    rows = [(i, texts[i % 4]) for i in range(140)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, queries.document_validation_rejects(spark, str(tmp_path)).collect()))
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    assert got == sorted(db.execute(queries.SQL["document_validation_rejects"]).fetchall())
    judged = spark.createDataFrame(rows[:4], "doc_id long, text string").selectExpr("*", "'a title' title", "180 max_words", "40 overlap").select("doc_id", document_problems("title", "text").alias("p"))
    assert [r.p for r in judged.orderBy("doc_id").collect()] == ["", "text", "text", "text"]


def test_generators(spark, corpus):
    import time

    from vecspark.operators.retrieval import NO_DOCUMENTS, REFUSED, generated_answers

    q = spark.createDataFrame([(1, "which scan is exact?"), (2, "zzz qqq"), (3, "how does a layered graph search?")], "qid long, question string")
    say = lambda question, context: f"It is so [1]. {context[:11]}" if "scan" in question else " "
    got = {r.qid: r for r in corpus.ask(q, floor=0.15, generator=generated_answers(say, "made")).collect()}
    assert got[1].answer == "It is so [1]. [1] (source" and got[1].sources[0].cited and got[1].sources[0].doc_title == "Linear scan" and got[1].model == "made"
    assert got[2].answer == NO_DOCUMENTS and got[3].answer == REFUSED
    slow = lambda question, context: time.sleep(3)
    with pytest.raises(Exception, match="TimeoutError"):
        corpus.ask(q, floor=0.15, generator=generated_answers(slow, "made", 0.2)).collect()


def test_stored_vectors_and_index_answer_alike(spark, corpus):
    q = spark.createDataFrame([(1, "which scan is exact?"), (2, "signed buckets of text")], "qid long, question string")
    rows = lambda df: sorted((r.qid, r.answer, [(s.chunk_id, s.doc_title, s.score) for s in r.sources]) for r in df.collect())
    assert rows(corpus.ask(q)) == rows(corpus.ask(q, ef_search=50)) == rows(corpus.ask(q, ef_search=50))


def test_seeding(spark, tmp_path):
    from vecspark.seed import main

    (tmp_path / "b_note.md").write_text("# B\n\nsecond")
    (tmp_path / "a_note.txt").write_text("first")
    (tmp_path / "skip.pdf").write_text("no")
    path = scratch(spark, "seeded")
    args = [f"file://{tmp_path}", path, "--embedder", "hashed", "--dim", "16"]
    assert main(args, spark) == 2 and main(args, spark) == 0
    assert [r.title for r in Corpus(spark, path, HashedEmbedder(16)).documents().collect()] == ["a note", "b note"]


def test_digests_count_equal_rows(spark):
    from vecspark.sources.storage import digest

    df = spark.range(5)
    assert digest(df.unionByName(df)) != digest(df) and digest(df.unionByName(df)) != digest(df.limit(0)) and digest(df.unionByName(df))[1] != 0


def test_graphs_are_walked_together(spark, monkeypatch):
    """Walks of all queries at once find what single walks find; recall is measured on walks of every shard's graph."""
    from vecspark.plans import queries

    r = np.random.default_rng(6)
    for metric in ("l2", "cosine"):
        x, q = r.standard_normal((700, 12)), r.standard_normal((40, 12))
        g = ann.Graph(12, metric, m=6, ef_construction=40).build(x)
        data, found = g.to_bytes(), {}
        for row, node, d in ann.Graph.walked(data, q, 5, 40):
            for a, b, c in zip(row.tolist(), node.tolist(), d.tolist()):
                found.setdefault(a, []).append((c, b))
        alone = [g.search(one, 5, 40) for one in q]
        both = [len({i for _, i in a} & {i for _, i in found[n]}) for n, a in enumerate(alone)]
        assert np.mean(both) >= 4.8 and all(len(found[n]) == 5 for n in range(40))
        far = {i: c for n, a in enumerate(alone) for c, i in a if n == 0}
        assert all(abs(far[i] - c) < 1e-5 for c, i in found[0] if i in far)
        assert list(ann.Graph.walked(ann.Graph(12, metric).to_bytes(), q, 5, 40)) == []
    asked, real = [], ann.GraphIndex.search
    monkeypatch.setattr(ann.GraphIndex, "search", lambda self, q, k, *a, **b: (asked.append((sum(self.state["shards"]), b)), real(self, q, k, *a, **b))[1])
    assert queries.recall_hnsw(spark, "/root/testdata/sf0.001").first()[0] >= 0.95
    assert all(b["walk"] is True and b["probes"] == shards for shards, b in asked) and asked


def test_index_ids_and_compaction(spark):
    v = generated_vectors(spark, 400, 8, clusters=10)
    index = ann.GraphIndex(spark, scratch(spark, "graphs"), 8).add(v.where("vec_id < 200"))
    for bad in (v.where("vec_id = 7"), v.where("vec_id = 300").unionByName(v.where("vec_id = 300"))):
        with pytest.raises(ValueError, match="taken"):
            index.add(bad)
    index.add(v.where("vec_id >= 200"))
    q = v.where("vec_id % 50 = 0").withColumnRenamed("vec_id", "qid")
    before = sorted(map(tuple, index.search(q, 5, probes=99).collect()))
    assert index.compact().state["segments"] == [3] and sorted(map(tuple, index.search(q, 5, probes=99).collect())) == before
    assert sorted(map(tuple, index.search(q, 5, 200, probes=99, walk=True).select("qid", "vec_id", "rank").collect())) == [(a, b, r) for a, b, _, r in before]


def test_validation(spark):
    ok = spark.createDataFrame([(1, [1.0, 2.0])], SCHEMA)
    require_valid(ok, 2)
    for bad in ([1.0], [1.0, float("nan")], [float("inf"), 0.0], None):
        with pytest.raises(ValueError, match="vector 2"):
            require_valid(ok.unionByName(spark.createDataFrame([(2, bad)], SCHEMA)), 2)
    with pytest.raises(ValueError):
        metric_name("dot")


def slow_chunks(text, size, overlap):
    import re

    paras = [w for w in (p.split() for p in re.split(r"\n\s*\n", text)) if w]
    out, cur = [], []
    for w in paras:
        if len(w) > size:
            if cur:
                out.append(cur)
            cur, at = [], 0
            while True:
                out.append(w[at : at + size])
                if at + size >= len(w):
                    break
                at += size - overlap
        elif cur and len(cur) + len(w) > size:
            out.append(cur)
            t = min(overlap, size - len(w), len(cur))
            cur = (cur[-t:] if t else []) + w
        else:
            cur = cur + w
    return out + ([cur] if cur else [])


@pytest.mark.parametrize("size,overlap", [(10, 3), (4, 0), (1, 0), (100, 20)])
def test_packed_chunks(spark, size, overlap):
    r = np.random.default_rng(1)
    texts = ["", " \n\n ", None, "one", "\n\n".join(" ".join(f"w{i}" for i in range(r.integers(1, 25))) for _ in range(12)), " ".join(f"w{i}" for i in range(500))]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    for row in df.select("i", packed_chunks("text", size, overlap).alias("c")).collect():
        assert [list(c) for c in row.c] == slow_chunks(texts[row.i] or "", size, overlap)
    with pytest.raises(ValueError):
        check_window(5, 5)


def test_embedder():
    e = HashedEmbedder(64)
    a, b, c, z = np.array(e.embed(["graph search layers", "search the layers", "other words entirely", "ÄÖ"]))
    assert np.isclose(a @ a, 1) and a @ b > a @ c and not z.any()
    assert get_embedder("hashed", 32).dim == 32
    with pytest.raises(ValueError):
        get_embedder("none")


def test_embedding_in_bounded_memory(spark, monkeypatch):
    """A batch of many texts takes no lists of Python floats, and tokens are remembered up to a bound."""
    import tracemalloc

    import pyarrow as pa
    from pyspark.sql.classic.dataframe import DataFrame

    from vecspark.functions import embed

    runs = []
    with monkeypatch.context() as m:
        m.setattr(DataFrame, "mapInArrow", lambda self, run, schema: runs.append(run))
        for digest in ("blake2b", "md5"):
            embed.with_embedding(spark.createDataFrame([("a",)], "text string"), "text", HashedEmbedder(384, digest))
    texts = [None if i == 3 else f"some words w{i} of x{i} text" for i in range(4000)]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])
    for run, digest in zip(runs, ("blake2b", "md5")):
        tracemalloc.start()
        got = 0
        for b in run([batch]):
            assert b.column(1)[:2].to_pylist() == HashedEmbedder(384, digest).embed([t or "" for t in b.column(0)[:2].to_pylist()])
            got += b.num_rows
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert got == 4000 and peak < 20e6
    e = HashedEmbedder(64)
    places = [e.place(f"t{i}") for i in range(150_000)]
    assert len(e._memo) <= 100_000 and e.place("t1") == places[1]


def test_hashed_weights_in_one_exchange(spark):
    """The vectors of ``HashedEmbedder``, without joining all tokens with a dictionary of them."""
    from vecspark.functions.embed import hashed_weights, token_dictionary

    texts = ["one two two Three", "", None, "x1 x1 y2 ÄÖ one", " ".join(f"t{i % 700}" for i in range(3000))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for dim in (7, 384):
        e, got = HashedEmbedder(dim, "md5"), np.zeros((5, dim))
        rows = hashed_weights(df, "doc_id", "text", dim)
        for r in rows.collect():
            assert r.weight != 0
            got[r.doc_id, r.bucket] = r.weight
        assert np.allclose(got, np.array(e.embed(texts)), atol=1e-12)
        assert all((r.bucket, float(r.sign)) == e.place(r.token) for r in token_dictionary(df, "text", dim).collect())
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.split("Initial Plan")[0].count("Exchange") == 1


def test_numbered_chunks(spark):
    """Ids of chunks by document and ordinal, whatever the partitions; documents are chunked once."""
    from vecspark.operators.retrieval import chunk_documents, numbered_chunks

    docs = spark.createDataFrame([(i * 37 % 101, " ".join(f"w{j}" for j in range(i * 7 % 60))) for i in range(101)], "doc_id long, text string").repartition(5)
    want = sorted((r.doc_id, r.ordinal, r.text) for r in chunk_documents(docs, 10, 3).collect())
    got = sorted((r.chunk_id, r.doc_id, r.ordinal, r.text) for r in numbered_chunks(docs, max_words=10, overlap=3).collect())
    assert got == [(i, *r) for i, r in enumerate(want)] and len(got) > 200
    assert numbered_chunks(docs.limit(0)).count() == 0


def test_answers_search_once(spark):
    """What was found is used four times for an answer; texts are embedded and compared once."""
    import tempfile
    from pathlib import Path

    log = Path(tempfile.mkdtemp(prefix="calls-", dir="/tmp"))

    class Counted(HashedEmbedder):
        def matrix(self, texts):
            if texts and any("passage" in t for t in texts):
                with tempfile.NamedTemporaryFile(dir=log, delete=False):
                    pass
            return super().matrix(texts)

    chunks = spark.createDataFrame([(0, 0, 0, "a passage of text"), (1, 1, 0, "another passage")], "chunk_id long, doc_id long, ordinal int, text string").coalesce(1)
    q = spark.createDataFrame([(1, "text"), (2, "another")], "qid long, question string")
    got = {r.qid: [(s.chunk_id, s.cited) for s in r.sources] for r in ask(chunks, q, embedder=Counted(64)).collect()}
    assert got == {1: [(0, True)], 2: [(1, True)]} and len(list(log.iterdir())) == 1


def test_dense_ids(spark):
    df = spark.range(1000).selectExpr("id * 7 % 1000 as k")
    got = dense_ids(df, ["k"], "n", 5).collect()
    assert all(r.n == r.k + 5 for r in got) and len(got) == 1000
    assert dense_ids(df.limit(0), ["k"], "n").count() == 0


@pytest.fixture
def corpus(spark):
    c = Corpus(spark, scratch(spark, "corpus"), HashedEmbedder(128))
    c.add(spark.createDataFrame(NOTES, "title string, text string"))
    return c


def test_lifecycle(spark, corpus):
    ids = {r.title: r.doc_id for r in corpus.documents().collect()}
    before = {(r.doc_id, r.ordinal): r.embedding for r in corpus._held().collect()}
    gone = spark.createDataFrame([(ids["Linear scan"],)], "doc_id long")
    corpus.delete(gone)
    assert sorted(r.chunk_id for r in corpus.chunks().collect()) == list(range(2))
    assert all(before[r.doc_id, r.ordinal] == r.embedding for r in corpus._held().collect())
    with pytest.raises(DocumentNotFound):
        corpus.delete(gone)
    corpus.add(spark.createDataFrame([("New", "word")], "title string, text string"), batch_id=1)
    for repeated in (1, 0):
        corpus.add(spark.createDataFrame([("New", "word")], "title string, text string"), batch_id=repeated)
    rows = {r.title: r for r in Corpus(spark, corpus.path, HashedEmbedder(128)).documents().collect()}
    assert rows["New"].doc_id == 3 and rows["New"].n_chunks == 1 and len(rows) == 3
    corpus.replace(spark.createDataFrame([(3, "New", "some words now")], "doc_id long, title string, text string"))
    assert {r.title: r.n_chunks for r in corpus.documents().collect()}["New"] == 1
    corpus.read_only = True
    with pytest.raises(ReadOnly):
        corpus.delete(gone)
    assert corpus.stats().first().documents == 3


def test_corrupt_snapshots(spark, corpus):
    with pytest.raises(CorruptSnapshot):
        Corpus(spark, corpus.path, HashedEmbedder(64))
    files, path = Files(spark), f"{corpus.path}/v=1/manifest.json"
    good = files.read(path)
    for bad in (good[:40], good.replace('"format": 1', '"format": 9'), good.replace('"next_doc_id": 3', '"next_doc_id": 1')):
        files.put(path, bad)
        with pytest.raises(CorruptSnapshot):
            Corpus(spark, corpus.path, HashedEmbedder(128))
    files.put(path, good)
    corpus.chunks().limit(1).write.mode("append").parquet(f"{corpus.path}/v=1/chunks")
    with pytest.raises(CorruptSnapshot):
        Corpus(spark, corpus.path, HashedEmbedder(128))


def test_answers(spark, corpus):
    q = spark.createDataFrame([(1, "which scan is exact?"), (2, "how does a layered graph search?"), (3, "zzz qqq")], "qid long, question string")
    got = {r.qid: r for r in ask(corpus.chunks(), q, floor=0.15, embedder=corpus.embedder).collect()}
    titles = {r.doc_id: r.title for r in corpus.documents().collect()}
    assert titles[got[1].sources[0].doc_id] == "Linear scan" and got[1].sources[0].cited and "[1]" in got[1].answer
    assert titles[got[2].sources[0].doc_id] == "Graph index"
    assert got[3].sources is None and got[3].model == "mock"


def test_recall_of_approximate_search(spark):
    v = generated_vectors(spark, 1500, 24, clusters=40).cache()
    x = np.array([r[1] for r in sorted(v.collect())], float)
    queries = [(i, x[i].tolist()) for i in range(0, 1500, 75)]
    truth = {i: {j for _, j in slow_knn(x, x[i], 10, "cosine")} for i, _ in queries}
    block = np.array([i for i, _ in queries]), np.array([q for _, q in queries])
    share = lambda df: np.mean([r.vec_id in truth[r.qid] for r in df.collect()]) if df else 0
    c = ann.train_cells(v, 30)
    assert share(ann.ivf_search(ann.assign_cells(v, c), c, block, 10, 8)) >= 0.95
    assert share(ann.graph_search(v, block, 2, 24, 10, 100)) >= 0.95
    asked = spark.createDataFrame(queries, "qid long, embedding array<double>")
    assert share(ann.lsh_search(v, asked, 10, 24, tables=16, bits=5)) >= 0.9
    caps = ann.graph_links(v, 1, 24, m=4, ef_construction=32).selectExpr("level", "size(neighbors) n").groupBy("level").max("n").collect()
    assert all(r[1] <= (8 if r[0] == 0 else 4) for r in caps)


def test_cells_of_many_queries_in_bounded_memory(spark):
    import tracemalloc

    r = np.random.default_rng(4)
    q, c = r.standard_normal((20_000, 8)), r.standard_normal((1000, 8))
    index = spark.createDataFrame([], "vec_id long, cell int, embedding array<double>")
    tracemalloc.start()
    ann.ivf_search(index, c, (np.arange(len(q)), q), 5, 30, "l2")
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 150e6
    seen = ann.visits(q, c, 30)
    near = ((q[7] - c) ** 2).sum(1).argsort()[:30]
    assert [j for j in range(1000) if 7 in ann.visitors(seen, j)] == sorted(near.tolist()) and len(ann.nearest_cells(q[:0], c, 3)) == 0


@pytest.mark.parametrize("bits,block", [(2, None), (9, None), (9, 7)])
def test_hashed_search_makes_no_pairs(spark, bits, block):
    """The nearest of all rows that share a bucket, whether few or most do; no join makes rows of pairs."""
    x = np.random.default_rng(8).standard_normal((700, 12)).astype(np.float32)
    x[1::50] = x[0]
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], SCHEMA).repartition(3)
    hits = ann.lsh_search(v, v.where("vec_id < 20").withColumnRenamed("vec_id", "qid"), 6, 12, tables=5, bits=bits, block=block)
    planes = np.random.default_rng(0).standard_normal((5, bits, 12))
    side = np.einsum("nd,tbd->ntb", x.astype(float), planes) > 0
    share = (side[:20, None] == side[None]).all(3).any(2)
    d = np.array([[1 - a @ b / np.sqrt((a @ a) * (b @ b)) for b in x.astype(float)] for a in x[:20].astype(float)]).round(9)
    got = sorted((r.qid, r["rank"], r.vec_id) for r in hits.collect())
    assert got == [(q, n + 1, j) for q in range(20) for n, (_, j) in enumerate(sorted((d[q, j], j) for j in np.flatnonzero(share[q]).tolist())[:6])]
    assert "Join" not in hits._jdf.queryExecution().toString()
    with pytest.raises(Exception, match="width 12"):
        ann.lsh_search(v, v.withColumnRenamed("vec_id", "qid"), 6, 13).collect()


def test_levels():
    got = np.bincount(levels(np.arange(2000), 0x5EED, 16), minlength=4)
    assert got.tolist() == [1887, 101, 11, 1]


def test_entry_without_llm(spark):
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).parent.parent
    code = "import sys; sys.modules['vecspark.llm'] = None; import __spark_entry__ as e; q = e.queries(); assert q and not any(k.startswith('op') for k in q) and 'pipeline' not in q; assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True)


def test_graph_in_parts_and_as_bytes():
    x = np.random.default_rng(2).standard_normal((400, 8))
    whole = ann.Graph(8, "l2", m=4, ef_construction=24).build(x)
    half = ann.Graph.from_bytes(ann.Graph(8, "l2", m=4, ef_construction=24).build(x[:150]).to_bytes()).build(x[150:])
    assert half.links == whole.links and (half.entry, half.top) == (whole.entry, whole.top)
    empty = ann.Graph.from_bytes(ann.Graph(3).to_bytes())
    assert len(empty) == 0 and empty.search([1, 0, 0], 5) == []
    data = whole.to_bytes()
    flipped = bytearray(data)
    flipped[len(data) // 2] ^= 1
    for bad in (b"", data[: len(data) // 2], data[:-1], bytes(flipped)):
        with pytest.raises(ValueError):
            ann.Graph.from_bytes(bad)
    whole.links[3][0][0] = 400
    with pytest.raises(ValueError, match="neighbours"):
        ann.Graph.from_bytes(whole.to_bytes())


def test_graph_index(spark):
    v = generated_vectors(spark, 900, 16, clusters=30)
    x = np.array([r[1] for r in sorted(v.collect())], float)
    path = scratch(spark, "graphs")
    assert ann.GraphIndex(spark, path, 16).search(v.limit(0).withColumnRenamed("vec_id", "qid"), 5).count() == 0
    ann.GraphIndex(spark, path, 16).add(v.where("vec_id < 600"), shard_rows=300).add(v.where("vec_id >= 600"))
    index = ann.GraphIndex(spark, path)
    assert len(index) == 900 and index.dim == 16 and "900" in repr(index) and index.links().selectExpr("count(distinct node)").first()[0] == 900
    q = v.where("vec_id % 90 = 0").withColumnRenamed("vec_id", "qid")
    got = index.search(q, 10).collect()
    hit = [r.vec_id in {j for _, j in slow_knn(x, x[r.qid], 10, "cosine")} for r in got]
    assert len(got) == 100 and np.mean(hit) >= 0.95 and all(r.vec_id == r.qid for r in got if r["rank"] == 1)
    assert index.search(q, 0).count() == 0
    assert np.allclose(index.vector(7), x[7] / np.sqrt(x[7] @ x[7]), atol=1e-6)
    with pytest.raises(IndexError):
        index.vector(900)
    before = index.state
    for bad in ([0.0] * 15, [float("nan")] * 16):
        with pytest.raises(ValueError):
            index.add(spark.createDataFrame([(1000, [1.0] * 16), (1001, bad)], SCHEMA))
    with pytest.raises(ValueError):
        index.search(spark.createDataFrame([(1, [1.0])], "qid long, embedding array<float>"), 3)
    assert ann.GraphIndex(spark, path).state == before
    with pytest.raises(ValueError):
        ann.GraphIndex(spark, path, 17)
    with pytest.raises(ValueError):
        ann.GraphIndex(spark, scratch(spark, "none"))
    index.shards().limit(1).write.mode("append").parquet(f"{path}/v=1/shards")
    with pytest.raises(ValueError):
        ann.GraphIndex(spark, path)


def test_additions_append(spark, corpus):
    corpus.add(spark.createDataFrame([("More", "\n\n".join(["words " * 150] * 4)), ("Blank", "x")], "title string, text string"))
    assert corpus.state["segments"] == [1, 2]
    again = Corpus(spark, corpus.path, HashedEmbedder(128))
    ids = [(r.chunk_id, r.doc_id, r.ordinal) for r in again.chunks().orderBy("doc_id", "ordinal").collect()]
    assert [i for i, _, _ in ids] == list(range(len(ids))) and len(ids) > 4
    again.delete(spark.createDataFrame([(0,)], "doc_id long"))
    assert again.state["segments"] == [3] and Corpus(spark, corpus.path, HashedEmbedder(128)).documents().count() == 4


def test_settings():
    from vecspark.settings import Settings, health

    assert Settings.read({}) == Settings() and health() == {"status": "ok"}
    assert Settings.read({"VECSPARK_UPLOADS": "off", "VECSPARK_FLOOR": "-0.5", "VECSPARK_MAX_TEXT": " "}) == Settings(uploads=False, floor=-0.5)
    for name, text in (("UPLOADS", "maybe"), ("FLOOR", "nan"), ("MAX_TEXT", "0"), ("MAX_TITLE", "1.5"), ("ANSWER_TIMEOUT", "0"), ("ANSWER_TIMEOUT", "inf")):
        with pytest.raises(ValueError, match=name):
            Settings.read({f"VECSPARK_{name}": text})
