"""A collection of chunked documents: add, delete, replace, stats, integrity, versioned snapshots.

A version adds a folder of Parquet tables, a segment, and its manifest names the segments it consists of. Adding
documents writes the new segment only, as new ids come after all others; deleting and replacing write all anew, and
so does an addition that would be segment number ``SEGMENTS + 1``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.embed import Embedder, HashedEmbedder, with_embedding
from ..functions.text import document_problems, query_problems, stripped
from ..sources.storage import Versions, digest, joined_digest, written
from ..settings import Settings
from .ann import GraphIndex
from .ids import dense_ids
from .retrieval import MAX_WORDS, OVERLAP, ask, chunk_documents

FORMAT, SEGMENTS = 1, 64


class DocumentNotFound(KeyError):
    pass


class ReadOnly(PermissionError):
    pass


class CorruptSnapshot(ValueError):
    pass


class Invalid(ValueError):
    """A document or question beyond the limits; nothing was changed."""


def without(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """Survivors of a delete."""
    return rows.join(gone.select("doc_id").distinct(), "doc_id", "left_anti")


def chunk_counts(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """``(doc_id, n_chunks)``, documents without chunks included."""
    n = chunks.groupBy("doc_id").agg(F.count("*").alias("n"))
    return documents.select("doc_id").join(n, "doc_id", "left").select("doc_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_chunks"))


def integrity(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """``(rule, violations)`` of a collection's constraints."""
    orphan = chunks.join(documents.select("doc_id"), "doc_id", "left_anti").agg(F.lit("orphan_chunks").alias("rule"), F.count("*").alias("violations"))
    titles = chunks.join(documents.select("doc_id", F.col("title").alias("t")), "doc_id").where("doc_title <> t").agg(F.lit("title_mismatch").alias("rule"), F.count("*").alias("violations"))
    ids = chunks.agg(F.lit("ids_not_dense").alias("rule"), F.when((F.count("*") == 0) | ((F.count_distinct("chunk_id") == F.count("*")) & (F.min("chunk_id") == 0) & (F.max("chunk_id") == F.count("*") - 1)), 0).otherwise(1).cast("long").alias("violations"))
    counts = documents.select("doc_id", "n_chunks").join(chunk_counts(documents, chunks).withColumnRenamed("n_chunks", "n"), "doc_id").where("n <> n_chunks").agg(F.lit("count_mismatch").alias("rule"), F.count("*").alias("violations"))
    return orphan.unionByName(titles).unionByName(ids).unionByName(counts)


class Corpus:
    """Documents ``(doc_id, title, n_chunks)``, chunks ``(chunk_id, doc_id, doc_title, ordinal, text)`` and vectors."""

    TABLES = ("documents", "chunks", "vectors")

    def __init__(self, spark: SparkSession, path: str, embedder: Embedder | None = None, max_words: int = MAX_WORDS, overlap: int = OVERLAP, read_only: bool | None = None, verify: bool = True, settings: Settings | None = None):
        """``verify`` reads all tables once and holds them against the manifest and the constraints. ``settings`` are
        read from the environment by default: limits, score floor, and whether changes are allowed."""
        self.settings = settings or Settings.read()
        read_only = not self.settings.uploads if read_only is None else read_only
        self.spark, self.versions, self.embedder = spark, Versions(spark, path), embedder or HashedEmbedder()
        self.path, self.max_words, self.overlap, self.read_only = self.versions.path, max_words, overlap, read_only
        self.state = {"format": FORMAT, "version": 0, "next_doc_id": 0, "embedder": getattr(self.embedder, "identity", {"type": type(self.embedder).__name__}), "last_batch": -1, "segments": [], "rows": {t: [0, 0] for t in self.TABLES}}
        self._load(verify)

    def _load(self, verify: bool) -> None:
        try:
            if (state := self.versions.current()) is None:
                return
            if state["format"] != FORMAT:
                raise CorruptSnapshot("another format")
            if state["embedder"] != self.state["embedder"]:
                raise CorruptSnapshot(f"made with {state['embedder']}, not {self.state['embedder']}")
            self.state = state
            if not verify:
                return
            for t in self.TABLES:
                if digest(self.table(t)) != state["rows"][t]:
                    raise CorruptSnapshot(f"table {t} isn't what the manifest says")
            bad = [r for r in integrity(self.table("documents"), self.table("chunks")).collect() if r.violations]
            top = self.table("documents").agg(F.max("doc_id")).first()[0]
            if bad or (top is not None and top >= state["next_doc_id"]):
                raise CorruptSnapshot(f"broken rules: {bad or 'next_doc_id'}")
        except CorruptSnapshot:
            raise
        except Exception as e:
            raise CorruptSnapshot(str(e)) from e

    SCHEMAS = {"documents": "doc_id long, title string, n_chunks long", "chunks": "chunk_id long, doc_id long, doc_title string, ordinal int, text string", "vectors": "chunk_id long, embedding array<float>"}

    def table(self, name: str) -> DataFrame:
        if not self.state["segments"]:
            return self.spark.createDataFrame([], self.SCHEMAS[name])
        return self.spark.read.schema(self.SCHEMAS[name]).parquet(*[f"{self.versions.folder(v)}/{name}" for v in self.state["segments"]])

    def documents(self) -> DataFrame:
        return self.table("documents").orderBy("doc_id")

    def chunks(self) -> DataFrame:
        return self.table("chunks")

    def _commit(self, documents: DataFrame, rows: DataFrame, next_doc_id: int, batch_id=None, append: bool = False) -> None:
        """``rows`` are chunks with their embedding. ``append``: they and ``documents`` come after all that is held."""
        version = self.state["version"] + 1
        folder = self.versions.fresh(version)
        full = dense_ids(rows, ["doc_id", "ordinal"], "chunk_id", self.state["rows"]["chunks"][0] if append else 0)
        full.select("chunk_id", "doc_id", "doc_title", "ordinal", "text").write.parquet(f"{folder}/chunks")
        full.select("chunk_id", F.col("embedding").cast("array<float>").alias("embedding")).write.parquet(f"{folder}/vectors")
        chunks = self.spark.read.schema(self.SCHEMAS["chunks"]).parquet(f"{folder}/chunks")
        documents.select("doc_id", "title").join(chunk_counts(documents, chunks), "doc_id").write.parquet(f"{folder}/documents")
        state = self.state | {"version": version, "next_doc_id": next_doc_id, "last_batch": self.state["last_batch"] if batch_id is None else batch_id, "segments": self.state["segments"] * append + [version]}
        state["rows"] = {t: digest(self.spark.read.schema(self.SCHEMAS[t]).parquet(f"{folder}/{t}")) for t in self.TABLES}
        if append:
            state["rows"] = {t: joined_digest(self.state["rows"][t], own) for t, own in state["rows"].items()}
        self.versions.commit(state)
        self.state = state

    def _guard(self) -> None:
        if self.read_only:
            raise ReadOnly("changes are switched off")

    def _held(self) -> DataFrame:
        return self.table("chunks").join(self.table("vectors"), "chunk_id").drop("chunk_id")

    def _chunked(self, docs: DataFrame) -> DataFrame:
        rows = chunk_documents(docs, self.max_words, self.overlap).drop("n_words").join(docs.select("doc_id", F.col("title").alias("doc_title")), "doc_id")
        return with_embedding(rows, "text", self.embedder).withColumn("embedding", F.col("embedding").cast("array<float>"))

    def _valid(self, docs: DataFrame) -> DataFrame:
        """``docs`` with trimmed titles; raises for the first that breaks a limit."""
        own = docs.withColumn("max_words", F.lit(self.max_words)).withColumn("overlap", F.lit(self.overlap))
        bad = own.select("title", document_problems("title", "text", max_title=self.settings.max_title, max_text=self.settings.max_text).alias("p")).where("p <> ''").orderBy("title").limit(1).collect()
        if bad:
            raise Invalid(f"document {bad[0][0]!r}: {bad[0][1]}")
        return docs.withColumn("title", stripped("title"))

    def add(self, docs: DataFrame, batch_id: int | None = None) -> None:
        """Add rows (title, text); ids go on from the counter, by title and text, or by a column ``arrival`` if there is one.

        Batch ids go up: one that isn't above the last that was committed is a repetition and skipped. A document
        beyond the limits raises before anything is written.
        """
        self._guard()
        if batch_id is not None and batch_id <= self.state["last_batch"]:
            return
        start, order = self.state["next_doc_id"], ["arrival"] if "arrival" in docs.columns else ["title", "text"]
        new = written(dense_ids(self._valid(docs).select("title", "text", *[c for c in order if c == "arrival"]), order, "doc_id", start), "new-documents")
        titles, rows, after = new.select("doc_id", "title"), self._chunked(new), start + new.count()
        if append := len(self.state["segments"]) < SEGMENTS:
            return self._commit(titles, rows, after, batch_id, append)
        self._commit(self.table("documents").select("doc_id", "title").unionByName(titles), self._held().unionByName(rows), after, batch_id)

    def _found(self, ids: DataFrame) -> None:
        missing = ids.select("doc_id").join(self.table("documents"), "doc_id", "left_anti").limit(1).collect()
        if missing:
            raise DocumentNotFound(missing[0][0])

    def delete(self, ids: DataFrame) -> None:
        """Remove documents; the others' vectors are kept as they are."""
        self._guard()
        self._found(ids)
        self._commit(without(self.table("documents"), ids).select("doc_id", "title"), without(self._held(), ids), self.state["next_doc_id"])

    def replace(self, docs: DataFrame) -> None:
        """Replace documents (doc_id, title, text) under their ids; only their texts are embedded."""
        self._guard()
        self._found(docs)
        new = written(self._valid(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "title", "text"), "replaced")
        rows = without(self._held(), new).unionByName(self._chunked(new))
        titles = without(self.table("documents"), new).select("doc_id", "title").unionByName(new.select("doc_id", "title"))
        self._commit(titles, rows, self.state["next_doc_id"])

    def index(self) -> GraphIndex:
        """A graph index of the stored vectors, kept beside this version's tables and built when first asked for."""
        found = GraphIndex(self.spark, f"{self.path}/index-{self.state['version']}", self.embedder.dim)
        return found if len(found) else found.add(self.table("vectors").select(F.col("chunk_id").alias("vec_id"), "embedding"))

    def ask(self, questions: DataFrame, k: int = 5, ef_search: int | None = None, **options) -> DataFrame:
        """Answers from the stored vectors, exactly or, with ``ef_search``, by the graph index; a question beyond the
        limits raises."""
        own = questions.withColumn("k", F.lit(k)).withColumn("ef_search", F.lit(100 if ef_search is None else ef_search))
        bad = own.select("qid", query_problems("question", max_question=self.settings.max_question).alias("p")).where("p <> ''").orderBy("qid").limit(1).collect()
        if bad:
            raise Invalid(f"question {bad[0][0]}: {bad[0][1]}")
        options = {"floor": self.settings.floor, "embedder": self.embedder} | options
        if ef_search is None:
            options["vectors"] = self.table("vectors")
        else:
            index = self.index()
            options["search"] = lambda asked, n: index.search(asked, n, ef_search)
        return ask(self.chunks(), questions, k, **options)

    def stats(self) -> DataFrame:
        return stats(self.table("documents"), self.table("chunks"), self.embedder.dim, "mock", not self.read_only, self.settings)


def stats(documents: DataFrame, chunks: DataFrame, dim: int, generation: str = "mock", uploads: bool = True, settings: Settings = Settings()) -> DataFrame:
    """One row: counts, dimension and nested limits."""
    n = documents.agg(F.count("*").alias("documents")).select("documents", F.lit(1).alias("j")).join(chunks.agg(F.count("*").alias("chunks")).select("chunks", F.lit(1).alias("j")), "j").drop("j")
    return n.withColumn("dim", F.lit(dim)).withColumn("generation", F.lit(generation)).withColumn("limits", F.struct(F.lit(settings.max_title).alias("title"), F.lit(settings.max_text).alias("text"), F.lit(settings.max_question).alias("question"))).withColumn("uploads", F.lit(uploads))
